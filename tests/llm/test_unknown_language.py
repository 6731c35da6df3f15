"""The pipeline's language stage rejects what was not learned."""

import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_unknown_languages_go(spark):
    r = random.Random(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    unknown = ["minä olen hyvin onnellinen kun aurinko paistaa järven yli", "wszystko co dobre szybko się kończy", "güneş doğarken köyün çocukları okula doğru koştular", "все счастливые семьи похожи", "qqq zzz xxx"]
    unknown += [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40)) for _ in range(5)]
    rows = spark.createDataFrame([(-9 * k - 9, t, None, "s", len(t)) for k, t in enumerate(unknown)], docs.schema)
    left = {x.doc_id for x in corpus_pipeline.identified(spark, docs.union(rows), SF).collect()}
    assert left == {x.doc_id for x in docs.collect()}


def test_texts_in_two_languages_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    by = {}
    for r in docs.filter("lang is not null and length(text) > 400").collect():
        by.setdefault(r.lang, r.text)
    mixed = [a[:200] + " " + b[:200] for a in by.values() for b in by.values() if a != b]
    rows = spark.createDataFrame([(-9 * k - 9, t, None, "s", len(t)) for k, t in enumerate(mixed)], docs.schema)
    left = {x.doc_id for x in corpus_pipeline.identified(spark, docs.union(rows), SF).collect()}
    assert mixed and left == {x.doc_id for x in docs.union(rows).collect()}
