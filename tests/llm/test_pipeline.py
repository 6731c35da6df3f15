"""The pipeline's stages against brute force, each on what the stage before it kept."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import quality
from tests.llm.fixtures import prose
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    named, good, single, private, packed = (f for _, f in corpus_pipeline.STAGES)
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())

    a = named(spark, docs, SF)
    assert a.columns == COLUMNS and a.count() == docs.count()
    b = good(spark, a, SF)
    left = {r.doc_id for r in b.collect()}
    assert b.columns == COLUMNS and all(i in left for i, q in labels.items() if q == 1)
    c = single(spark, b, SF)
    rows = [(r.doc_id, r.text) for r in b.collect()]
    assert {r.doc_id for r in c.collect()} == set(brute_components(rows).values())
    d = private(spark, c, SF)
    texts = {r.doc_id: r for r in d.collect()}
    assert d.columns == COLUMNS and set(texts) == {r.doc_id for r in c.collect()}
    assert not any("@mail" in r.text for r in texts.values()) and all(r.n_chars == len(r.text) for r in texts.values())
    e = packed(spark, d, SF).collect()
    assert {r.doc_id for r in e} == set(texts)


def test_stage_on_odd_rows(spark):
    """Nulls in every column, empty and repeated rows, equal and very long texts, a further column; and no rows."""
    en = [prose(k, 60) for k in range(40)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(en)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "   ", "en", "s", 3), (103, "12345 !!", "en", "s", 8)]
    rows += [(104, en[0], None, None, None), (105, en[1], "en", "s", 5), (105, en[1], "en", "s", 5), (None, en[2], "en", "s", 1)]
    rows += [(106, " ".join(en) + " the river zed@corp.example.com stone", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x"))
    named, good, single, private, packed = (f for _, f in corpus_pipeline.STAGES)
    a = named(spark, docs, SF)
    assert a.columns == COLUMNS
    assert sorted((r.doc_id for r in a.collect()), key=str) == sorted([*range(40), 104, 105, 105, None, 106], key=str)
    b = good(spark, docs, SF)
    assert b.columns == COLUMNS and {100, 101, 102} <= {r.doc_id for r in docs.collect()}
    kept = {r.doc_id for r in quality.classify(docs, quality.fit(docs)).filter("kept").collect()}
    assert {r.doc_id for r in b.collect()} == kept
    c = single(spark, docs, SF)
    assert sorted((r.doc_id for r in c.collect()), key=str) == sorted([*range(40), 100, 101, 102, 103, None, 106], key=str)
    d = {r.doc_id: r for r in private(spark, docs, SF).collect()}
    assert d[100].text is None and d[100].n_chars is None and d[101].text == "" and d[0].text == en[0] and d[106].text.endswith("the river [EMAIL] stone")
    assert d[106].n_chars == len(d[106].text)
    e = packed(spark, docs, SF).collect()
    assert {r.doc_id for r in e} == {r.doc_id for r in docs.collect()} and [r.length for r in e if r.doc_id == 100] == [1]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_drop_what_they_should(spark):
    """Each stage's own fault, planted, goes; all else stays."""
    en = [prose(k, 80) for k in range(60)]
    strange = "".join(chr(0x4E00 + 7 * k) + " " * (k % 5 == 0) for k in range(300))
    junk = "|!|!| ###### @@@@ " * 40
    near = en[3].split()
    near[10:11] = ["changed"]
    rows = [(k, t, "en") for k, t in enumerate(en)] + [(70, strange, None), (71, junk, "en"), (72, " ".join(near), "en")]
    docs = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    named, good, single = (f for _, f in corpus_pipeline.STAGES[:3])
    assert {r.doc_id for r in named(spark, docs, SF).collect()} >= {*range(60), 72} and 70 not in {r.doc_id for r in named(spark, docs, SF).collect()}
    assert {r.doc_id for r in good(spark, docs, SF).collect()} >= {*range(60), 72} and 71 not in {r.doc_id for r in good(spark, docs, SF).collect()}
    assert {r.doc_id for r in single(spark, docs, SF).collect()} == {*range(60), 70, 71}


def test_run_chains_the_stages(spark, tmp_path):
    """run() on a table of its own equals the stages one after the other, each from what the one before wrote."""
    texts = [prose(k, 70) for k in range(50)] + [prose(1, 70), "", None, "mail me at a.b@c.example.org " + prose(99, 60)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, want, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        want = spark.read.parquet(f"{tmp_path}/{k}")
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    got = key(corpus_pipeline.run(spark, str(tmp_path)))
    assert got == key(want) and {x[0] for x in got} == {*range(50), 53}
