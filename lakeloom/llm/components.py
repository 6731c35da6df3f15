"""Connected components of a table of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): component is the smallest node that can be reached.

    Each round points every node at the first of itself and its neighbours, replaces the ends of all links by what they
    point at, and drops links within one node. First is by a hash of the node, so the number of rounds is logarithmic in
    the length of a path on average whatever order its ids are in (rising ids, as versions of a page have, included); a
    star takes two or three. At last every component is named after its smallest node. Links with a null end and links
    of a node with itself count for nothing, repeated links once; no links give no rows. Only whether links are left
    reaches the driver.
    """
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    links = materialise(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select("b", "a"))
        to = both.groupBy("node").agg(F.min(ranked("other")).alias("first"))
        to = materialise(to.select("node", F.least(ranked("node"), F.col("first"))["id"].alias("to")), "to")
        a, b = to.select(F.col("node").alias("a"), F.col("to").alias("to_a")), to.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = links.join(a, "a").join(b, "b").filter("to_a <> to_b")
        links = materialise(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        if found is None:
            found = to.select("node", F.col("to").alias("root"))
        else:
            step = to.select(F.col("node").alias("root"), "to")
            found = found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        found = materialise(found, "found")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    named = found.groupBy("root").agg(F.min("node").alias("component"))
    return materialise(found.join(named, "root").select("node", "component"), "components")
