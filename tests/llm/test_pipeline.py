import random

import corpus_pipeline
from tessella.llm import decontaminate, jaccard, linededup


def test_stages_against_brute_force(spark, tmp_path):
    from .test_operators import made

    docs = {k: t for k, t in made(5).items() if t is not None}
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    item = " ".join(docs[0].split()[:12])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard", "decontaminate", "packing"]
    once = linededup.brute(list(docs.items()))
    groups = jaccard.brute(list(once.items()))
    left = {d: t for d, t in once.items() if groups[d][1] == d}
    hits = decontaminate.brute(list(left.items()), [(1, item)])
    left = {d: t for d, t in left.items() if hits[d][1] <= 0.5 * hits[d][0]}
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == list(corpus_pipeline.COLUMNS)
    got = {r["doc_id"]: r["text"] for r in df.collect()}
    assert set(got) == set(left) and all(got[d] == left[d] for d in left if not hits[d][1])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(left)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _score int, go string, items int"


def written(spark, path, docs, labels, items):
    spark.createDataFrame([(*d, "en", "s", len(d[1] or ""), 1, "x", 2) for d in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [], [])).count() == 0


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Null texts and ids, repeated rows and columns with inner names go through; no document without a fault is lost."""
    r = random.Random(3)
    say = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    one, item = say(40), say(14)
    docs = [(1, one), (1, one), (2, None), (3, ""), (None, say(30)), (None, None), (4, one + " end"), (5, say(30) + " " + item + " " + say(30)), (6, item + " x"), (7, say(50) + "\n" + say(8))]
    d = written(spark, tmp_path, docs, [], [(1, item), (2, None), (None, "a b")])
    df = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, d)
        assert df.columns == list(corpus_pipeline.COLUMNS)
    rows = df.collect()
    assert sorted(str(x["doc_id"]) for x in rows) == ["1", "1", "2", "3", "4", "5", "7", "None", "None"]
    text = {x["doc_id"]: x["text"] for x in rows}
    assert text[4] == "" and item not in text[5] and text[7] == docs[-1][1] and text[2] is None and sorted(len(x["text"]) for x in rows if x["doc_id"] == 1) == [0, len(one)]
    assert all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in rows)
    packed = corpus_pipeline.run(spark, d).collect()
    assert {x["doc_id"] for x in packed} == {1, 2, 3, 4, 5, 7, None} and sum(x["length"] for x in packed if x["doc_id"] in (2, 3, 4)) == 3


def test_toxic_documents_go(spark, tmp_path):
    """The first stage drops what it scores 0.5 or more, and nothing else."""
    r = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        words = [f"w{r.randrange(3000)}" for _ in range(40)]
        if i % 6 == 0:
            words[r.randrange(40)], words[r.randrange(40)] = "moron", "scum"
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 6 == 0)))
    d = written(spark, tmp_path, docs, labels, [])
    left = {x["doc_id"] for x in corpus_pipeline.toxic_out(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()}
    assert sum(i in left for i in range(600) if i % 6) == 500 and sum(i in left for i in range(0, 600, 6)) <= 2
