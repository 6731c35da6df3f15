"""Graphs as tables of edges: components, triangles and damped ranking, in rounds of joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.scratch import discard, materialise, shuffles_removed
from lakeloom.sources.tables import write_bucketed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node that can be reached.

    Each round hangs every node on the least of itself and its neighbours by a hash of the node and of the round, and
    replaces the ends of edges by what they hang on; edges within one node go. The hash changes from round to round, so a
    chain shrinks by a constant factor each, whatever its order. Null ends, loops and repeated edges count for nothing.
    """
    kind = edges.schema["a"].dataType
    left = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps, turn = None, 0
    while not left.isEmpty():
        turn += 1
        key = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(left.select("b", "a"))
        least = both.groupBy("node").agg(F.min(key("other")).alias("other"))
        to = materialise(least.select("node", F.least(key("node"), F.col("other"))["id"].alias("to")), "hung")
        a, b = to.toDF("a", "to_a"), to.toDF("b", "to_b")
        moved = left.join(a, "a").join(b, "b").filter("to_a <> to_b")
        left = materialise(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if steps is None:
            steps = to.toDF("node", "root")
        else:
            steps = steps.join(to.toDF("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        steps = materialise(steps, "roots")
    if steps is None:
        return left.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("component"))
    # hanging on a neighbour needn't end at the smallest node, and two nodes may hang on each other: name by the smallest
    named = steps.groupBy("root").agg(F.min("node").alias("component"))
    return steps.join(named, "root").select("node", "component")


def _numbered(degree: DataFrame) -> DataFrame:
    """(node, number) of the nodes of (node, d): numbers from 0, without gaps, in order of d and of nodes."""
    order = degree.repartitionByRange("d", "node").sortWithinPartitions("d", "node")
    placed = materialise(order.select("node", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), "placed")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(F.broadcast(sizes), "part").select("node", (F.col("place") + F.col("before")).cast("int").alias("number"))


def _colour(x: np.ndarray, colours: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % colours


def _cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of an unordered pair of colours."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    return high * (high + 1) // 2 + low


_PARTS = "cell int, side int, us array<int>, lows array<int>, highs array<int>, low array<int>, high array<int>"


def _runs(arrays: list[np.ndarray]) -> pa.ListArray:
    size = np.array([len(x) for x in arrays])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(arrays).astype(np.int32)))


#: Edges dealt at once, about.
_EDGES = 200_000


def _dealt(colours: int, cells: range):
    """From (u, vs), for each of the cells: u's edges to v of one colour, to be looked up in the cell of both colours (side 0),
    and the vs of the cell's two colours, to be paired there (side 1). A row has those of many u: how many of `low` and of
    `high` each has; in a cell of one colour all are in `low`."""
    pairs = [(_cell(np.int64(i), np.int64(j)), i, j) for j in range(colours) for i in range(j + 1) if _cell(np.int64(i), np.int64(j)) in cells]

    def out(us: np.ndarray, lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
        v, own = lists.flatten().to_numpy(), _colour(us, colours)
        c = _colour(v, colours)
        order = np.argsort(c.astype(np.int16), kind="stable")
        row = np.repeat(np.arange(len(us)), lists.value_lengths().to_numpy())[order]
        cuts = np.cumsum(np.bincount(c, minlength=colours))[:-1]
        of, rows = np.split(v[order], cuts), np.split(row, cuts)
        size = [np.bincount(x, minlength=len(us)) for x in rows]
        none, blocks = v[:0], []
        for cell, i, j in pairs:
            for x, y in {(i, j), (j, i)}:
                kept = (own == x) & (size[y] > 0)
                blocks.append((cell, 0, us[kept], size[y][kept], none, of[y][kept[rows[y]]], none))
            if i == j:  # one alone makes no pair
                kept = size[i] > 1
                blocks.append((cell, 1, us[kept], size[i][kept], none, of[i][kept[rows[i]]], none))
            else:
                kept = (size[i] > 0) & (size[j] > 0)
                blocks.append((cell, 1, us[kept], size[i][kept], size[j][kept], of[i][kept[rows[i]]], of[j][kept[rows[j]]]))
        blocks = [x for x in blocks if len(x[2])]
        if blocks:
            cell, side, *lists = zip(*blocks)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(side, pa.int32()), *map(_runs, lists)], names=["cell", "side", "us", "lows", "highs", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, lists, at = batch.column(0).to_numpy(), batch.column(1), 0
            total = np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _EDGES, "right")))
                yield from out(us[at:to], lists.slice(at, to - at))
                at = to

    return run


#: Pairs made at once, about.
_PAIRS = 1_000_000


class _Edges:
    """A set of pairs of numbers; most that aren't in it are told by a table of bits of their hashes."""

    def __init__(self, keys: list[np.ndarray]):
        self.keys = np.sort(np.concatenate([np.zeros(0, np.int64), *keys]))
        self.shift = np.uint64(64 - max(10, 2 + len(self.keys).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self._hash(self.keys)] = True

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def held(self, keys: np.ndarray) -> np.ndarray:
        """Where in keys those are that are in the set."""
        likely = np.flatnonzero(self.seen[self._hash(keys)])
        at = np.searchsorted(self.keys, keys[likely])
        return likely[self.keys[np.minimum(at, len(self.keys) - 1)] == keys[likely]] if len(self.keys) else likely[:0]


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the parts of cells, side 0 first: how many triangles found here each number is in."""

    def counts(edges: _Edges, us: np.ndarray, lows: np.ndarray, highs: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        u = np.repeat(us, lows)
        if len(highs):  # each of low with all of high
            later, start = np.repeat(highs, lows), np.repeat(np.cumsum(highs) - highs, lows)
        else:
            start, high = np.arange(1, len(low) + 1), low
            later = np.repeat(np.cumsum(lows), lows) - start
        total, at = np.cumsum(later), 0
        while at < len(low):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
            n = later[at:to]
            left = np.repeat(np.arange(at, to), n)
            a, b = low[left], high[np.arange(len(left)) + np.repeat(start[at:to] - np.cumsum(n) + n, n)]
            hit = edges.held(np.minimum(a, b) << 32 | np.maximum(a, b))
            number, times = np.unique(np.concatenate([u[left[hit]], a[hit], b[hit]]), return_counts=True)
            if len(number):
                yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(times.astype(np.int64))], names=["number", "n"])
            at = to

    now, keys, edges = None, [], None
    for batch in batches:
        for at in range(len(batch)):
            cell, side = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            us, lows, highs, low, high = (batch.column(k)[at].values.to_numpy().astype(np.int64) for k in range(2, 7))
            if cell != now:
                now, keys, edges = cell, [], None
            if side == 0:
                keys.append(np.repeat(us, lows) << 32 | low)
            else:
                if edges is None:
                    edges, keys = _Edges(keys), []
                yield from counts(edges, us, lows, highs, low, high)


#: Numbers sent at once are this times the edges at most, or so many.
_SENT = 3
_SENT_AT_LEAST = 100_000_000


def triangles(edges: DataFrame, *, looked_up: int = 8_000_000, sent_at_least: int = _SENT_AT_LEAST) -> DataFrame:
    """(node, triangles) of every node of the undirected edges (a, b) that lies in a triangle: in how many.

    Each edge points from its end of lower degree to the other (ties by the node), so that no node has more than about
    sqrt(2 * edges) edges going out, however many come in; pairs of a node's outgoing edges are looked up among all edges.
    A hub so gives few pairs. Loops, repeated edges and their directions count for nothing.

    Pairs are many times more than edges, so they are made where they are looked up and never shuffled: nodes have one of k
    colours, and each two colours a task, which gets the edges between them (about `looked_up` at most, or fewer, so that
    all cores have work) and each node's outgoing edges to them. So each edge is sent k + 1 times in all, as one of a list,
    but in rounds of tasks: what a round sends is bounded by the edges, whatever k is, and goes before the next. Tables
    and shuffles between go too as soon as they are read. Numbers take the place of nodes, below 2 ** 31.
    """
    spark = edges.sparkSession
    with shuffles_removed(spark):
        plain = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        count = plain.count()
        degree = plain.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
        numbered = materialise(_numbered(degree), "numbered")
        if numbered.count() >= 1 << 31:
            raise ValueError("triangles: more than 2 ** 31 nodes")
        half = materialise(plain.join(numbered.toDF("a", "u"), "a").select("u", "b"), "half")
        discard(plain)
        turned = half.join(numbered.toDF("b", "v"), "b").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        # dealt before it is collected, as pairs take less than lists of one or two
        going = materialise(turned.repartition("u").groupBy("u").agg(F.collect_list("v").alias("vs")), "going")
        discard(half)
        tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        colours = 1
        while colours * (colours + 1) // 2 < max(tasks, count // looked_up):
            colours += 1
        cells = range(colours * (colours + 1) // 2)
        sent = (colours + 1) * count
        rounds = max(1, min(len(cells), -(-sent // max(_SENT * count, sent_at_least))))
        found = []
        for k in range(rounds):
            now = cells[len(cells) * k // rounds : len(cells) * (k + 1) // rounds]
            parts = going.mapInArrow(_dealt(colours, now), _PARTS).repartitionById(len(now), F.col("cell") - now.start).sortWithinPartitions("cell", "side")
            sums = parts.mapInArrow(_closed, "number int, n long")
            found.append(sums if k == rounds - 1 else materialise(sums.groupBy("number").agg(F.sum("n").alias("n")), "found"))
    everywhere = reduce(DataFrame.unionAll, found).groupBy("number").agg(F.sum("n").alias("triangles"))
    return everywhere.join(numbered, "number").select("node", "triangles")


def ranks(edges: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-9, rounds: int = 100) -> tuple[DataFrame, int]:
    """(node, rank) of every node of the directed, weighted edges (a, b, w), and the rounds taken.

    A node gives the damped share of its rank to the nodes it points at, by weight; nodes without outgoing edges give theirs
    to all. Ranks sum to 1. It ends when ranks change by less than `tolerance` together. Shares are computed once, as a table
    in buckets by a, so that a round shuffles ranks and sums, and edges never; what a node receives is summed before the
    shuffle in each task. Edges with null ends or
    weights not above 0 count for nothing, repeated ones add up.
    """
    buckets = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # all edges of a node are in one bucket from here on: sums, shares and the joins of all rounds need no shuffle of edges
    edges = edges.filter("a is not null and b is not null and w > 0").repartition(buckets, "a").groupBy("a", "b").agg(F.sum("w").alias("w"))
    share = write_bucketed(edges.select("a", "b", (F.col("w") / F.sum("w").over(Window.partitionBy("a"))).alias("share")), ["a"], buckets)
    gives = share.select(F.col("a").alias("node")).distinct().withColumn("gives", F.lit(True))
    nodes = share.select(F.col("b").alias("node")).distinct().withColumn("gives", F.lit(False)).unionAll(gives).groupBy("node").agg(F.max("gives").alias("gives"))
    nodes = materialise(nodes, "nodes")
    n = nodes.count()
    state = materialise(nodes.withColumn("rank", F.lit(1.0 / max(1, n))), "ranks")
    done = 0
    while n and done < rounds:
        done += 1
        lost = state.filter("not gives").agg(F.sum("rank")).first()[0] or 0.0
        # each bucket's ranks are held, not sorted with the edges
        got = share.join(state.select(F.col("node").alias("a"), "rank").hint("shuffle_hash"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)
        after = materialise(state.join(got, "node", "left").select("node", "gives", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")), "ranks")
        change = after.agg(F.sum("change")).first()[0]
        state = after.drop("change")
        if change < tolerance:
            break
    return state.select("node", "rank"), done
