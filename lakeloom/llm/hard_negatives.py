"""Hard-negative mining (operator 12), by distributed radix selection.

Vectors become integers, floor(scale * x), and are packed some thousand to a row, written once. An anchor's positives are
its k best rows of its own label; each pair of an anchor and a positive has a window of scores, and its hard negatives are
the k best rows of other labels inside. Both are one operation: of the rows that a window admits, take the k first by
falling score and rising vec_id.

Windows are settled by rounds. Groups of anchors meet columns of candidates in tasks, which score all their pairs and
count, for each open window, the scores by digit: by their distance from the window's upper end, shifted so that some
2^DIGIT buckets span what is left of the window. Only counts leave a task, and only of buckets up to the one that holds
the task's own k-th score, as the k-th of all can't lie beyond. Summed counts say which bucket holds the k-th score. A
window whose bucket still holds too many rows is refined by the next digit, down to single scores; the others are settled.
At last the rows at or above each window's limit are gathered, k a task and window at most (of equal scores those of
smallest vec_id), and ranked. Neither scores nor rows are kept between rounds, so memory is bounded by the blocks of a
task, and no round's tables grow with more than windows times columns.

All scores are exact integers, limited to the range of 62 bits and sign. Rows with a null vec_id, label or vector, or with a
null or non-finite component, take no part. Missing components of shorter vectors count as 0. Each row is an anchor, positive
or candidate of its own, also where a vec_id repeats (rows with an anchor's vec_id are other rows, but for itself); equal
scores go by vec_id, then by label; an anchor without other rows of its label, and a positive without rows in its window,
gives no rows. An empty table gives none. Extra columns are ignored. No vector reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import materialise, partitions
from lakeloom.llm.exact_topk import _matrix, _scores

#: Scores beyond this count as this.
MOST = 2**62 - 1
#: Bits of a digit; a window is settled when its limit admits no more than SLACK times the rows it needs.
DIGIT, SLACK = 10, 4
#: Vectors in a packed row, anchors scored at once, and anchors in a group at most.
PACKED, SLICE, GROUP = 2048, 256, 20_000

_PACK = "number long, ids binary, labels binary, kind string, width int, vectors binary, longest double"
_ANCHORS = "anchor long, anchor_id long, label long, kind string, width int, vector binary, longest double"
_WINDOW = "struct<at: long, same: boolean, low: long, high: long, shift: int, need: long>"


def _rows(values: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*values)) if values else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def _pack(scale: float):
    names = ["number", "ids", "labels", "kind", "width", "vectors", "longest"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.binary(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), PACKED):
                part = batch.slice(at, PACKED)
                x = _matrix(part.column(2), scale)
                most = np.abs(x).max(initial=0)
                kind = "<i1" if most < 2**7 else "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
                longest = float(np.sqrt((x**2).sum(axis=1).max(initial=0)))
                ids, labels = (part.column(i).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for i in (0, 1))
                yield _rows([(made, ids, labels, kind, x.shape[1], x.astype(kind).tobytes(), longest)], names, types)
                made += PACKED  # a row's number is that of its pack and its place there

    return run


def _unpack(ids: bytes, labels: bytes, kind: str, width: int, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8").astype(np.int64)
    return own, np.frombuffer(labels, "<i8").astype(np.int64), np.frombuffer(vectors, kind).astype(np.float64).reshape(len(own), width)


def _anchors(every: int):
    names = ["anchor", "anchor_id", "label", "kind", "width", "vector", "longest"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                number, *packed = (batch.column(n)[i].as_py() for n in ("number", "ids", "labels", "kind", "width", "vectors"))
                ids, labels, x = _unpack(*packed)
                kind = packed[2]
                found = [(number + j, int(ids[j]), int(labels[j]), kind, x.shape[1], x[j].astype(kind).tobytes(), float(np.sqrt((x[j] ** 2).sum()))) for j in np.flatnonzero(ids % every == 0).tolist()]
                if found:
                    yield _rows(found, names, types)

    return run


class _Group:
    """A group's anchors and their windows, window by window in arrays."""

    def __init__(self, held: list[tuple]):
        self.anchor = np.array([h[0] for h in held], np.int64)
        self.label = np.array([h[1] for h in held], np.int64)
        vectors = [np.frombuffer(h[4], h[2]).astype(np.float64) for h in held]
        self.vectors = np.zeros((len(held), max((len(v) for v in vectors), default=0)))
        for row, v in zip(self.vectors, vectors):
            row[: len(v)] = v
        flat = [(i, w["at"], w["same"], w["low"], w["high"], w["shift"], w["need"]) for i, h in enumerate(held) for w in h[5]]
        self.row, self.at, self.same, self.low, self.high, self.shift, self.need = (np.array(c, bool if n == 2 else np.int64) for n, c in enumerate(zip(*flat)))

    def admitted(self, number: int, labels: np.ndarray, vectors: np.ndarray, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, candidate, score) of the pairs of some rows that lie in their window and reach its floor, slice by slice."""
        for a in range(0, len(self.anchor), SLICE):
            first, last = np.searchsorted(self.row, [a, a + SLICE])
            if first == last:
                continue
            score = np.clip(_scores(self.vectors[a : a + SLICE], vectors), -MOST, MOST)
            own = self.anchor[a : a + SLICE] - number
            inside = (own >= 0) & (own < len(labels))
            self_row = np.where(inside, own, -1)
            for w in range(first, last, SLICE):
                wins = np.arange(w, min(last, w + SLICE))
                s = score[self.row[wins] - a]
                ok = (s >= np.maximum(self.low, floor)[wins][:, None]) & (s <= self.high[wins][:, None])
                ok &= (labels[None, :] == self.label[self.row[wins]][:, None]) == self.same[wins][:, None]
                mine = self_row[self.row[wins] - a]
                ok[np.flatnonzero(mine >= 0), mine[mine >= 0]] = False
                i, j = np.nonzero(ok)
                if len(i):
                    yield wins[i], j, s[i, j]


class _Counts:
    """Counts of scores by bucket, of each window up to the bucket of the k-th score seen."""

    names, types = ["anchor", "at", "bucket", "n"], [pa.int64()] * 4

    def __init__(self, group: _Group):
        self.group = group
        self.floor = group.low.copy()
        self.window = self.bucket = self.n = np.zeros(0, np.int64)

    def add(self, number: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        g = self.group
        for window, _, score in g.admitted(number, labels, vectors, self.floor):
            bucket = (g.high[window] - score) >> g.shift[window]
            self._merge(window, bucket, np.ones(len(window), np.int64))

    def _merge(self, window: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> None:
        g = self.group
        window, bucket, n = (np.concatenate([old, new]) for old, new in ((self.window, window), (self.bucket, bucket), (self.n, n)))
        order = np.lexsort((bucket, window))
        window, bucket, n = window[order], bucket[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], (window[1:] != window[:-1]) | (bucket[1:] != bucket[:-1])]))
        window, bucket, n = window[start], bucket[start], np.add.reduceat(n, start)
        before = np.cumsum(n) - n
        before -= before[np.searchsorted(window, window)]
        kept = before < g.need[window]
        self.window, self.bucket, self.n = window[kept], bucket[kept], n[kept]
        # a window with enough rows needs none below the bucket of its k-th score
        last = np.searchsorted(self.window, np.arange(len(g.need)), "right") - 1
        total = np.bincount(self.window, self.n, len(g.need))
        full = total >= g.need
        b = self.bucket[last[full]]
        self.floor[full] = np.maximum(g.low[full], g.high[full] - ((b + 1) << g.shift[full]) + 1)

    def out(self) -> list[np.ndarray]:
        g = self.group
        return [g.anchor[g.row[self.window]], g.at[self.window], self.bucket, self.n]


class _Gather:
    """The first rows of each window, as many as it needs at most."""

    names, types = ["anchor", "at", "vec_id", "label", "score"], [pa.int64()] * 5

    def __init__(self, group: _Group):
        self.group = group
        self.floor = group.low.copy()
        self.window = self.vec = self.label = self.score = np.zeros(0, np.int64)

    def add(self, number: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        g = self.group
        for window, j, score in g.admitted(number, labels, vectors, self.floor):
            new = (window, ids[j], labels[j], score)
            window, vec, label, score = (np.concatenate(x) for x in zip((self.window, self.vec, self.label, self.score), new))
            order = np.lexsort((label, vec, -score, window))
            window, vec, label, score = window[order], vec[order], label[order], score[order]
            kept = np.arange(len(window)) - np.searchsorted(window, window) < g.need[window]
            self.window, self.vec, self.label, self.score = window[kept], vec[kept], label[kept], score[kept]
            full = np.bincount(self.window, minlength=len(g.need)) >= g.need
            last = np.searchsorted(self.window, np.flatnonzero(full), "right") - 1
            self.floor[full] = np.maximum(g.low[full], self.score[last])

    def out(self) -> list[np.ndarray]:
        g = self.group
        return [g.anchor[g.row[self.window]], g.at[self.window], self.vec, self.label, self.score]


def _meet(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows of a group and column, anchors first, sorted so."""
        now, held, work = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            if work:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(work.out(), kind.types)], names=kind.names)

        for batch in batches:
            for i in range(len(batch)):
                g, c, side, number, label = (batch.column(n)[i].as_py() for n in range(5))
                if (g, c) != now:
                    yield from out()
                    now, held, work = (g, c), [], None
                ids, labels, shape, width, vectors, windows = (batch.column(n)[i].as_py() for n in range(5, 11))
                if side == 0:
                    held.append((number, label, shape, width, vectors, windows))
                elif held:
                    work = work or kind(_Group(held))
                    work.add(number, *_unpack(ids, labels, shape, width, vectors))
        yield from out()

    return run


def _round(packs: DataFrame, anchors: DataFrame, windows: DataFrame, kind: type) -> DataFrame:
    """What all tasks of groups of anchors and columns of candidates have found, for the given windows."""
    n = partitions(packs.sparkSession)
    own = windows.groupBy("anchor").agg(F.collect_list(F.struct("at", "same", "low", "high", "shift", "need")).alias("windows"))
    asked = anchors.join(own, "anchor")
    groups = max(1, -(-anchors.count() // GROUP), round(n**0.5))
    columns = max(1, round(n / groups))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    none = F.lit(None).cast("binary")
    left = asked.select(part("anchor", groups).alias("g"), every(columns).alias("c"), F.lit(0).alias("side"), F.col("anchor").alias("number"), "label", none.alias("ids"), none.alias("labels"), "kind", "width", F.col("vector").alias("vectors"), "windows")
    right = packs.select(every(groups).alias("g"), part("number", columns).alias("c"), F.lit(1).alias("side"), "number", F.lit(None).cast("long").alias("label"), "ids", "labels", "kind", "width", "vectors", F.lit(None).cast(f"array<{_WINDOW}>").alias("windows"))
    met = left.unionByName(right).repartitionById(n, (F.col("g") * columns + F.col("c")).cast("int")).sortWithinPartitions("g", "c", "side")
    return met.mapInArrow(_meet(kind), ", ".join(f"{x} long" for x in kind.names))


def _shift(low: str, high: str):
    """How far distances in a window are shifted for a digit."""
    return F.expr(f"cast(greatest(0, length(bin({high} - {low})) - {DIGIT}) as int)")


def select(packs: DataFrame, anchors: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """(anchor, at, rank, vec_id, label, score): the k first rows that each window (anchor, at, same, low, high) admits."""
    # `limit` is the lowest score that is taken for sure to hold the k first, top the window's own upper end
    state = windows.filter("low <= high").select("anchor", "at", "same", "low", "high", F.col("high").alias("top"), F.lit(k).cast("long").alias("need"), F.lit(True).alias("open"))
    state = materialise(state, "windows")
    while not (open_ := state.filter("open")).isEmpty():
        asked = open_.withColumn("shift", _shift("low", "high"))
        counts = _round(packs, anchors, asked, _Counts).groupBy("anchor", "at", "bucket").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("anchor", "at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        reached = counts.withColumn("upto", upto).join(asked.select("anchor", "at", "need"), ["anchor", "at"]).filter("upto >= need")
        # the first bucket whose summed count reaches the number needed
        kth = reached.groupBy("anchor", "at").agg(F.min(F.struct("bucket", "n", "upto")).alias("kth")).select("anchor", "at", "kth.*")
        found = state.filter("open").withColumn("shift", _shift("low", "high")).join(kth, ["anchor", "at"], "left")
        top = F.expr("high - shiftleft(bucket, shift)")
        bottom = F.greatest("low", F.expr("high - shiftleft(bucket + 1, shift) + 1"))
        left_over = F.expr("need - (upto - n)")  # of the k-th score's bucket
        short = F.col("bucket").isNull()  # fewer rows than needed: all of them are taken
        done = short | (F.col("shift") == 0) | (F.col("n") <= left_over + (SLACK - 1) * k)
        new = found.select("anchor", "at", "same", F.when(short, F.col("low")).otherwise(bottom).alias("low"), F.when(short, F.col("high")).otherwise(top).alias("high"), "top", F.when(short, F.col("need")).otherwise(left_over).alias("need"), (~done).alias("open"))
        state = materialise(state.filter("not open").unionByName(new), "windows")
    last = state.select("anchor", "at", "same", "low", F.col("top").alias("high"), F.lit(0).alias("shift"), F.lit(k).cast("long").alias("need"))
    found = _round(packs, anchors, last, _Gather)
    rank = F.row_number().over(Window.partitionBy("anchor", "at").orderBy(F.desc("score"), "vec_id", "label"))
    return found.select("*", rank.alias("rank")).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 3, high: int = 9, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by
    `every` and each of its best rows of its label, the best rows of other labels whose score lies between low and high
    tenths of the positive's."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    usable = x.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    packs = materialise(usable.mapInArrow(_pack(scale), _PACK), "packs")
    anchors = materialise(packs.mapInArrow(_anchors(every), _ANCHORS), "anchors")
    longest = packs.agg(F.max("longest")).first()[0] or 0.0
    # no score is larger than the product of lengths, here rounded up by more than it can lose
    bound = F.least(F.lit(float(2**61)), F.col("longest") * longest * (1 + 1e-9) + 2).cast("long")
    bound = F.when(F.col("longest") * longest < 2**60, bound).otherwise(F.lit(MOST))
    whole = anchors.select("anchor", F.lit(0).cast("long").alias("at"), F.lit(True).alias("same"), (-bound).alias("low"), bound.alias("high"))
    best = select(packs, anchors, whole, positives)
    best = materialise(best.select("anchor", F.col("rank").cast("long").alias("at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # tenths without products that a long can't hold; a negative score has no score between its tenths
    ceiling = F.expr(f"{low} * (positive_score div 10) + ({low} * (positive_score % 10) + 9) div 10")
    floor = F.expr(f"{high} * (positive_score div 10) + ({high} * (positive_score % 10)) div 10")
    inside = best.filter("positive_score >= 0").select("anchor", "at", F.lit(False).alias("same"), ceiling.alias("low"), floor.alias("high"))
    found = select(packs, anchors, inside, negatives)
    named = found.join(best, ["anchor", "at"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
