"""Which texts hold which passages whole: a substring join by rare anchors instead of comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.scratch import materialise

#: Words of an anchor, and the words that a passage needs at least.
ANCHOR, LEAST = 4, 3


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def _grams(words: Column, n: Column | int) -> Column:
    """Hashes of all runs of n words, in order. words must be a column: an expression would be computed for each run."""
    n = F.lit(n) if isinstance(n, int) else n
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(words, i, n)))


def passages_in(docs: DataFrame, passages: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, at): the texts that hold a passage character by character, and where it first begins, from 1.

    A passage's inner words stand in such a text as whole words, its first and last may be parts of longer ones. So each
    passage is anchored at the run of ANCHOR inner words (fewer, if it has fewer) that is rarest in the corpus: a first
    scan counts the passages' runs, a second finds the texts that hold an anchor, and only their pairs are compared. A run
    that no text holds rules its passage out. Both scans are a hash of each word's run met by equality, so Spark broadcasts
    the runs while they are small by the size of their written table and shuffles them beyond; no pairs are formed but
    those of a text and an anchor in it.

    Passages of fewer than LEAST words, null and empty ones, and null texts are in nothing. Rows that repeat, on either
    side, give rows that repeat (each row of items with each row of docs).
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    items = passages.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("passage"))
    each = items.select("passage").distinct().withColumn("w", words(F.col("passage"))).filter(F.size("w") >= LEAST)
    each = each.select("passage", F.slice("w", F.lit(2), F.size("w") - 2).alias("inner"))
    n = F.least(F.lit(ANCHOR), F.size("inner"))
    # a passage's runs, its text only as a hash until the end
    runs = each.select(F.xxhash64("passage").alias("p"), n.alias("n"), F.posexplode(_grams(F.col("inner"), n)).alias("place", "gram"))
    runs = materialise(runs, "passage-runs")
    sizes = sorted(r.n for r in runs.select("n").distinct().collect())  # ANCHOR numbers at most
    if not sizes:
        return docs.join(items, F.lit(False)).select("doc_id", "item_id", F.lit(0).cast("long").alias("at"))

    def met(wanted: DataFrame, *keep: str) -> DataFrame:
        """The runs of all texts that are among the wanted ones."""
        found = None
        for size in sizes:
            own = docs.select(*keep, words(F.col("text")).alias("__w")).select(*keep, F.lit(size).alias("n"), F.explode(_grams(F.col("__w"), size)).alias("gram"))
            found = own if found is None else found.unionByName(own)
        return found.join(wanted, ["n", "gram"])

    counts = met(runs.select("n", "gram").distinct()).groupBy("n", "gram").agg(F.count("*").alias("count"))
    # a run without a count leaves its passage without a rarest one
    rarest = runs.join(counts, ["n", "gram"], "left").groupBy("p", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "place", "gram")).alias("r"))
    anchors = materialise(rarest.filter("r.count > 0").select("p", "n", "r.gram"), "anchors")
    pairs = materialise(met(anchors, "doc_id").select("doc_id", "p").distinct(), "candidates")
    named = items.withColumn("p", F.xxhash64("passage"))
    pairs = pairs.withColumnRenamed("doc_id", "__id")
    found = docs.join(pairs, F.col("doc_id").eqNullSafe(F.col("__id"))).join(named, "p").withColumn("at", F.instr("text", F.col("passage")).cast("long"))
    return found.filter("at > 0").select("doc_id", "item_id", "at")


def first_words(text: Column, n: int) -> Column:
    """A text up to the end of its n-th word; the whole text up to its last word, if it has fewer. Null without words."""
    space, word = r"[\x20\x09-\x0D]*", r"[^\x20\x09-\x0D]+"
    found = F.regexp_extract(text, rf"^{space}{word}(?:[\x20\x09-\x0D]+{word}){{0,{n - 1}}}", 0)
    return F.nullif(found, F.lit(""))
