"""Near copies of texts by banded min-hash signatures, in DataFrame functions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.graph import connected_components
from lakeloom.operators.passages import words
from lakeloom.sources.scratch import materialise

#: Signatures are minima of (a * h + b) % PRIME; with these numbers two sets of Jaccard similarity s share a band with
#: probability 1 - (1 - s**ROWS)**BANDS: 0.98 at 0.75, 0.997 at 0.85, 0.02 at 0.25.
PRIME, BANDS, ROWS = 2_147_483_647, 10, 4


def coefficients(bands: int = BANDS, rows: int = ROWS) -> list[tuple[int, int]]:
    r = random.Random(0)
    return [(r.randrange(1, PRIME), r.randrange(PRIME)) for _ in range(bands * rows)]


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _shingles(own: Column, n: int) -> Column:
    """60-bit hashes of the runs of n words, with repeats; of all words if there are fewer. own must be a column."""
    places = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.greatest(F.size(own) - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(F.md5(F.array_join(F.slice(own, i, n), " ")), 1, 15), 16, 10).cast("long"))


def near_copies(docs: DataFrame, *, percent: int = 75, n: int = 5, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_copies, cluster_id): texts whose sets of n-word shingles have a Jaccard similarity of percent or more fall
    in one cluster, named by its smallest doc_id; n_copies counts the rows with the same text, but for the case
    of A-Z.

    Equal texts are one node. Of each node the minima of bands * rows hashes over its shingles are aggregated (in the task
    that reads it, for the most part), and nodes that agree in a whole band meet: each with the smallest and the largest node
    of the band, so that a band shared by a large group gives two candidates a node, not all pairs. Candidates are checked
    exactly, by their shingle sets, and links followed to components. So every link found is true, and what min-hashing
    misses is that two like texts share no band, or that neither of the two they meet there is like them; README has the
    measured recall.

    Null texts and texts without words are clusters of their own, as are rows with a null doc_id, which have a null
    cluster_id; rows that repeat a doc_id share a node where their texts are equal.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = docs.withColumn("node", F.md5(_lower(F.col("text"))))
    h = F.col("h") % PRIME
    minima = [F.min((F.lit(a) * h + F.lit(b)) % PRIME).alias(f"m{k}") for k, (a, b) in enumerate(coefficients(bands, rows))]
    signed = keyed.select("node", words(_lower(F.col("text"))).alias("w")).select("node", F.explode(_shingles(F.col("w"), n)).alias("h")).groupBy("node").agg(*minima)
    keys = [F.struct(F.lit(b).alias("band"), F.xxhash64(*(F.col(f"m{b * rows + k}") for k in range(rows))).alias("key")) for b in range(bands)]
    banded = materialise(signed.select("node", F.explode(F.array(*keys)).alias("x")).select("node", "x.*"), "bands")
    ends = banded.groupBy("band", "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    met = banded.join(ends, ["band", "key"]).select("node", F.explode(F.array("low", "high")).alias("other"))
    pairs = met.filter("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    pairs = materialise(pairs, "candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = keyed.join(asked, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = sets.select("node", words(_lower(F.col("text"))).alias("w")).select("node", F.array_distinct(_shingles(F.col("w"), n)).alias("s"))
    sets = materialise(sets, "sets")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = both.filter(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")
    found = connected_components(links).withColumnRenamed("component", "group")
    of = keyed.select("doc_id", "node").join(found, "node", "left").select("doc_id", "node", F.coalesce("group", "node").alias("group"))
    of = materialise(of, "grouped")
    # texts without words are in no band
    has = banded.filter("band = 0").select("node", F.lit(True).alias("has_words"))
    of = of.join(has, "node", "left").withColumn("has_words", F.coalesce("has_words", F.lit(False)))
    named = of.groupBy("group").agg(F.min("doc_id").alias("cluster_id"))
    copies = of.groupBy("node").agg(F.count("*").alias("n_copies"))
    out = of.join(named, "group", "left").join(copies, "node", "left")
    own = F.when(~F.col("has_words") | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("cluster_id"))
    return out.select("doc_id", F.when(F.col("node").isNull(), F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"), own.alias("cluster_id"))
