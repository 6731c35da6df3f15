"""Ranked lexical search against brute force: ties, repeated and null ids, odd texts, whole long ones."""

import collections
import math
import re

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lakeloom.llm import lexical as L
from tests.llm.fixtures import documents, odd_rows, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    N, total = len(counted), sum(n for _, _, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counted:
            m = 10 + (90 * n * N) // total
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) & set(c))
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **more):
    index = L.build(documents(spark, docs).repartition(4), **more)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    return sorted((tuple(r) for r in L.search(index, asked).collect()), key=repr)


def test_search_equals_brute_force(spark):
    docs = [(i, prose(i % 150, 20 + i % 60)) for i in range(400)]  # copies: ties by doc_id
    items = [(i, prose(1000 + i, 12)) for i in range(30)] + [(50, docs[7][1]), (51, "the THE The of"), (51, "winter")]
    assert searched(spark, docs, items) == brute(docs, items)


def test_odd_texts(spark):
    docs = odd_rows() + [(11, "ÀB àb x1 _y"), (12, "x1"), (12, "x1"), (13, "B\x00c")]
    items = [(1, None), (2, ""), (3, "?!"), (4, "X1 àb ÀB"), (5, prose(1, 10)), (None, "c b one"), (6, "nowhere")]
    got = searched(spark, docs, items)
    assert got == brute(docs, items)
    assert {r[0] for r in got} == {4, 5, None}
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == []


def test_blocks_and_slices(spark, monkeypatch):
    text = "ab,Cd é " * 1000 + "z" * 700
    monkeypatch.setattr(L, "BYTES", 100)
    assert L.counted(text.encode()) == collections.Counter(t.encode() for t in terms(text))
    assert L.counted(b"") == {}


def test_bounds_hold_and_pass_over_documents():
    r = np.random.default_rng(1)
    tf, n = r.integers(1, 2000, 5000), r.integers(1, 10**6, 5000)
    exact = L.impacts(tf, n, 1000, 10**6)
    level = -(-exact // L.STEP)
    assert level.max() < 256 and (exact < 10**6).all()
    assert ((level - 1) * L.STEP < exact).all() and (exact <= level * L.STEP).all()
    block = L._Block()
    for i in range(3000):
        block.add(i, prose(i, 30).encode())
    row = block.row(0, 3000, 90_000)
    work = L._Search([(0, [b"winter", b"lamp", b"river"], [900, 700, 800])], 10, 3000, 90_000)
    work.add(*(row.column(n)[0].as_py() for n in L._NAMES[1:]))
    assert 10 <= work.scored < 0.5 * work.bounded


def test_row_groups_of_the_index_are_small(spark, monkeypatch):
    """A reader holds a whole row group, so blocks of some MB mustn't share one by the hundred."""
    monkeypatch.setattr(L, "BYTES", 4_000)
    words = np.random.default_rng(2).integers(0, 10**9, (150, 400)).astype(str)
    docs = [(i, " ".join("t" + w for w in row)) for i, row in enumerate(words)]
    monkeypatch.setitem(L._WRITTEN, "parquet.block.size", str(16_000))
    index = L.build(documents(spark, docs).coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.blocks.inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) == index.blocks.count() > 100 and max(groups) <= 8, groups
