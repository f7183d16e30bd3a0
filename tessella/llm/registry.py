"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chunkstore import op4_chunkstore
from .decontaminate import op9_decontaminate
from .imatch import op1_imatch
from .jaccard import op7_jaccard
from .linededup import op2_line_dedup
from .packing import op5_packing
from .pii import op3_pii
from .suffixdedup import op6_suffix_dedup
from .toxicity import op8_toxicity
from .warc import op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_imatch,
        op2_line_dedup,
        op3_pii,
        op4_chunkstore,
        op5_packing,
        op6_suffix_dedup,
        op7_jaccard,
        op8_toxicity,
        op9_decontaminate,
        op10_warc,
    )
}

ORACLE_SQL: dict[str, str] = {}
