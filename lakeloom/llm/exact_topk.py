"""Exact top-k search by inner product (operator 2), with block-at-a-time pruning.

Vectors become integers, floor(scale * x), packed some thousand to a row. Queries fall into groups of `chunk` or fewer,
by a hash, and candidates into columns; each group meets each column in one task, which holds the group and streams through
the column, in stretches of `stretch` vectors. A stretch is ordered by recursive halving along the component that varies
most, and cut into blocks of `block` vectors. A block keeps the maximum and minimum of each term (component) and, as its
forward index, its vectors. For a query, sum(max(q * minimum, q * maximum)) over the terms bounds every score in the
block. A query visits the blocks by falling bound and scores them until a bound is below the k-th score it has; that
score carries on to the next stretches. In a block, the terms that vary most, FRONT of all, are scored first; with what
the lengths of the remaining parts can add at most (Cauchy-Schwarz), vectors below the k-th score are done with. What is
left, k rows a query and column at most, is merged by a window over the query.

All scores are exact: products run in floating point only where every sum is an integer it holds exactly, else in
Python's integers, limited to the range of a long. Ties go to the smaller vec_id. Vectors that are null or hold null or
non-finite components, and rows with null vec_id, take no part; an empty vector scores 0 against all; where lengths
differ, missing components count as 0. A vec_id that repeats is one query (its smallest vector) and several candidates;
no row with a query's own id is among its results. An empty table gives no rows. No vector reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import partitions

_LOW = np.iinfo(np.int64).min
#: The share of terms that are scored first, and the share of a block's pairs up to which the others are scored one by one.
FRONT, FEW = 0.75, 0.25
#: Vectors in one packed row.
_PACKED = 2048


def _matrix(lists: pa.Array, scale: float) -> np.ndarray:
    """The vectors as rows of integers held in doubles; shorter ones end in zeros."""
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.floor(scale * np.asarray(lists.flatten()).astype(np.float64))
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), max(sizes, default=0)))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The exact inner products of all rows of q and of c."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * width
    if most < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    return np.clip(whole(q).dot(whole(c).T), _LOW + 1, np.iinfo(np.int64).max).astype(np.int64) if width else np.zeros((len(q), len(c)), np.int64)


def _order(x: np.ndarray, block: int) -> np.ndarray:
    """Row numbers such that stretches of `block` rows lie close together."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block or not x.shape[1]:
            done.append(rows)
            continue
        term = int(np.argmax(x[rows].var(axis=0)))
        half = block * max(1, round(len(rows) / block / 2))
        rows = rows[np.argpartition(x[rows, term], min(half, len(rows) - 1))]
        todo += [rows[half:], rows[:half]]
    return np.concatenate(done) if done else np.arange(0)


class Search:
    """The k best of all rows seen so far, for each of some queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, block: int):
        self.ids, self.queries, self.k, self.block = ids, queries, k, block
        self.rows = np.zeros(0, np.int64)  # of the best: which query, score, vec_id
        self.best = self.found = self.rows
        self.kth = np.full(len(ids), _LOW)
        self.scored = self.possible = 0

    def _merge(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        rows, best, found = (np.concatenate([old, *new]) for old, new in zip((self.rows, self.best, self.found), zip(*parts)))
        order = np.lexsort((found, -best, rows))
        rows, best, found = rows[order], best[order], found[order]
        first = np.searchsorted(rows, np.arange(len(self.ids)))
        kept = np.arange(len(rows)) - first[rows] < self.k
        self.rows, self.best, self.found = rows[kept], best[kept], found[kept]
        last = np.searchsorted(self.rows, np.arange(len(self.ids)), "right") - 1
        full = np.bincount(self.rows, minlength=len(self.ids)) >= self.k
        self.kth[full] = self.best[last[full]]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = _order(vectors, self.block)
        blocks = [order[i : i + self.block] for i in range(0, len(order), self.block)]
        width = min(self.queries.shape[1], vectors.shape[1])
        q = self.queries[:, :width]
        # bounds are rounded up by what doubles can lose
        high = np.array([vectors[b][:, :width].max(axis=0) for b in blocks]).reshape(len(blocks), width)
        low = np.array([vectors[b][:, :width].min(axis=0) for b in blocks]).reshape(len(blocks), width)
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        bound += (np.maximum(q, 0) @ np.abs(high).T + np.abs(np.minimum(q, 0)) @ np.abs(low).T) * 1e-13
        turn = np.argsort(-bound, axis=1)
        self.possible += len(self.ids) * len(ids)
        scored = self._parts(q, vectors[:, :width], blocks, ids)
        for r in range(len(blocks)):
            at = turn[:, r]
            open_ = np.flatnonzero(bound[np.arange(len(at)), at] >= self.kth)
            if not len(open_):
                break
            parts = []
            for b in np.unique(at[open_]):
                mine, rows = open_[at[open_] == b], blocks[b]
                for some in np.array_split(mine, -(-len(mine) // 512)):
                    i, j, s = scored(some, b)
                    i, j = some[i], rows[j]
                    other = ids[j] != self.ids[i]
                    parts.append((i[other], s[other], ids[j][other]))
            self._merge(parts)

    def _parts(self, q: np.ndarray, vectors: np.ndarray, blocks: list[np.ndarray], ids: np.ndarray):
        """A function that, for some queries and a block, gives the pairs that can be among the k best, with their scores."""
        width = q.shape[1]
        most = np.abs(q).max(initial=0) * np.abs(vectors).max(initial=0) * width
        if width < 4 or most >= 2**53:

            def whole(some: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                score = _scores(q[some], vectors[blocks[b]])
                self.scored += score.size
                i, j = np.nonzero(score >= self.kth[some][:, None])
                return i, j, score[i, j]

            return whole
        # sums below these sizes are whole numbers that single or double precision hold exactly
        real = np.float32 if most < 2**24 else np.float64
        by = np.argsort(-vectors.var(axis=0), kind="stable")
        front, back = (np.sort(x) for x in np.split(by, [int(FRONT * width)]))
        q_front, q_back = np.ascontiguousarray(q[:, front], real), np.ascontiguousarray(q[:, back], real)
        c_front, c_back = ([np.ascontiguousarray(vectors[b][:, x].T, real) for b in blocks] for x in (front, back))
        # lengths, rounded up by more than their products and sums can lose
        length = lambda x, axis: (np.sqrt((x.astype(np.float64) ** 2).sum(axis=axis)) * (1 + 1e-6)).astype(real)
        q_rest, c_rest = length(q_back, 1), [length(x, 0) for x in c_back]
        wait = 0

        def some_first(some: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nonlocal wait
            kth = self.kth[some][:, None]
            least = np.maximum(kth, -(2**60)).astype(real)
            part = q_front[some] @ c_front[b]
            if wait == 0:
                high = np.multiply.outer(q_rest[some], c_rest[b])
                high += part
                high += np.abs(high) * 1e-5 + 1
                i, j = np.nonzero(high >= least)
                if len(i) <= FEW * part.size:
                    score = part[i, j] + np.einsum("ij,ij->i", q_back[some[i]], c_back[b].T[j])
                    self.scored += len(i)
                    kept = score >= least[i, 0]
                    return i[kept], j[kept], score[kept].astype(np.int64)
                wait = 8  # blocks until this is worth a try again
            else:
                wait -= 1
            part += q_back[some] @ c_back[b]
            self.scored += part.size
            if part.shape[1] > self.k and np.count_nonzero(part >= least) > 2 * self.k * len(some):
                # of each query the block's own k best will do
                part[self.ids[some][:, None] == ids[blocks[b]]] = -np.inf
                least = np.maximum(least, np.partition(part, -self.k, axis=1)[:, -self.k, None])
            i, j = np.nonzero((part >= least) & (part > -np.inf))
            return i, j, part[i, j].astype(np.int64)

        return some_first


_GRID = "number long, ids binary, kind string, width int, vectors binary"
_GRID_ARROW = pa.schema([("number", pa.int64()), ("ids", pa.binary()), ("kind", pa.string()), ("width", pa.int32()), ("vectors", pa.binary())])


def _pack(scale: float):
    """From (vec_id, v) rows of _PACKED vectors: their ids, and their integers in the smallest kind that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), _PACKED):
                part = batch.slice(at, _PACKED)
                x = _matrix(part.column(1), scale)
                most = np.abs(x).max(initial=0)
                kind = "<i1" if most < 2**7 else "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
                row = (made, part.column(0).to_numpy().astype("<i8").tobytes(), kind, x.shape[1], x.astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _GRID_ARROW.types)], schema=_GRID_ARROW)
                made += 1

    return run


def _unpack(ids: bytes, kind: str, width: int, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8").astype(np.int64)
    return own, np.frombuffer(vectors, kind).astype(np.float64).reshape(len(own), width)


def _stacked(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several packed rows as one; shorter vectors end in zeros."""
    width = max(x.shape[1] for _, x in parts)
    return np.concatenate([i for i, _ in parts]), np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, x in parts])


def _search(k: int, block: int, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (g, c, side, ids, kind, width, vectors), sorted by the first three: a group's queries, then a column."""
        now, search = None, None
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            nonlocal search, held
            if held and asked:
                search = search or Search(*_stacked(asked), k, block)
                search.add(*_stacked(held))
            held = []

        def out() -> Iterator[pa.RecordBatch]:
            add()
            if search:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (search.ids[search.rows], search.found, search.best)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for g, c, side, *packed in zip(*(batch.column(x).to_pylist() for x in range(7))):
                if (g, c) != now:
                    yield from out()
                    now, search, asked = (g, c), None, []
                if side == 0:
                    asked.append(_unpack(*packed))
                else:
                    held.append(_unpack(*packed))
                    if sum(len(i) for i, _ in held) >= stretch:
                        add()
        yield from out()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 256, stretch: int = 16_384, chunk: int = 50_000) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of vectors for each row of queries."""
    n = partitions(vectors.sparkSession)

    def usable(df: DataFrame) -> DataFrame:
        x = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
        return x.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)

    # broad columns: the more vectors a task has seen, the higher its k-th score
    groups = max(1, -(-queries.filter(F.col(id_col).isNotNull()).count() // chunk), round(n**0.5))
    columns = max(1, round(n / groups))
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))

    def grid(df: DataFrame, side: int, g, c) -> DataFrame:
        packed = df.mapInArrow(_pack(scale), _GRID)
        return packed.select(g.alias("g"), c.alias("c"), F.lit(side).alias("side"), "ids", "kind", "width", "vectors")

    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    part = lambda m: F.pmod(F.xxhash64("number"), F.lit(m))
    rows = grid(asked, 0, part(groups), every(columns))
    others = grid(usable(vectors), 1, every(groups), part(columns))
    met = rows.unionByName(others).repartitionById(n, (F.col("g") * columns + F.col("c")).cast("int")).sortWithinPartitions("g", "c", "side")
    near = met.mapInArrow(_search(k, block, stretch), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.select("*", rank.alias("rank")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
