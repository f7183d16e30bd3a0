"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Edge cases: rows with a null text pass every stage and are packed as one end id; rows with a null doc_id are scored, lose repeated
lines as the last of all, are in no group of near-duplicates and are packed; of rows repeated with one doc_id the first keeps its lines, and all
stay, as one document; without labels nothing is toxic; without benchmark items nothing is cut; an empty table gives no
sequence; columns besides ``COLUMNS`` are dropped by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, decontaminate, jaccard, linededup, packing, toxicity

#: The columns that every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine fitted on the labelled ones scores under 0.5."""
    machine = toxicity.trained(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, machine).where("_score < 0.5").select(*COLUMNS)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one equals within one word."""
    return _counted(linededup.deduplicated(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; documents alone stay."""
    others = jaccard.classes(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark passages; those that are mostly such words go."""
    return _counted(decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 4096: one row a piece."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("line_dedup", lines_once),
    ("jaccard", one_of_each),
    ("decontaminate", benchmark_out),
    ("packing", sequences),
]

#: The factorization machine and the tokenizer have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each leaves is written to the shared folder before the next begins."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
