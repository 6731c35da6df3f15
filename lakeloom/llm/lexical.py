"""Ranked lexical search (operator 13), by a two-level quantised index.

Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A document's score for an item is
the sum, over the item's distinct terms, of w * impact, where w depends on the term alone and impact, an integer below a
million, on the term's frequency in the document and the document's length.

A first scan counts documents and terms. The second writes the index: documents in blocks of some thousand, or of some MB
of text, and for each term of a block the places of its documents with two levels. The first is a byte, the impact divided
by STEP and rounded up. byte * STEP is at least the impact and (byte - 1) * STEP below it, so that sums of w * byte over an
item's terms give each document's upper bound, and its lower bound is that less STEP times the summed w of the terms it
holds. The second level are the frequencies and lengths, from which exact impacts are computed.

Groups of items meet columns of blocks in tasks. In a block an item's bounds are summed over its terms' postings; the k-th
largest of lower bounds and exact scores so far is the item's limit, and every document whose upper bound reaches it is
scored exactly, in integers. What is left of a task, k rows an item, is ranked over all tasks. Nothing is cut: a document
that is passed over has an upper bound below k documents' lower bounds.

A null or empty text, or one without terms, has no terms, isn't counted and is never found. Rows with one doc_id are documents
of their own; of equal scores the smaller doc_id comes first (a null one last). Items are rows too: each row of items gets its
own ranks, also where item_ids repeat or are null; items without terms that a document holds have no rows, and neither has
an empty table of items or documents. Extra columns are ignored. Neither items nor documents pass through the driver, but for
the two sums of the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import give_back, materialise, partitions

#: Impacts are below a million, so that 255 steps of this size cover them.
STEP = 3922
#: Bounds of a block: documents, and bytes of text (a longer document is a block of its own).
DOCUMENTS, BYTES = 4096, 4_000_000
#: Items in a group at most.
ITEMS = 2000
#: How the index is written. A reader holds a row group's rows at once, and by default a writer looks at its size after a
#: hundred rows first, which are some hundred MB of blocks here.
_WRITTEN = {"parquet.block.size": str(4 * BYTES), "parquet.page.size.row.check.min": "1"}

_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TABLE = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))

_BLOCK = "number long, ids binary, known binary, lengths binary, terms array<binary>, counts binary, places binary, bytes binary, frequencies binary"
_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
_TYPES = [pa.int64(), *[pa.binary()] * 3, pa.list_(pa.binary()), *[pa.binary()] * 4]


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    m = 10 + (90 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in slices of some MB that end between terms."""
    at = 0
    while at < len(text):
        end = at + BYTES
        part = text[at:end].translate(_TABLE)
        while end < len(text) and not part.endswith(b" "):
            more = text[end : end + 256].translate(_TABLE)
            cut = more.find(b" ") + 1 or len(more)
            part += more[:cut]
            end += cut
        yield part.split()
        at = end


def counted(text: bytes) -> Counter:
    """How often each term stands in a text."""
    found: Counter = Counter()
    for part in slices(text):
        found.update(part)
    return found


class _Block:
    """A block while its documents arrive."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.terms, self.frequencies, self.sizes = [], [], []
        self.ids, self.known, self.lengths = [], [], []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = counted(text)
        if not found:
            return
        number = self.numbers.setdefault
        self.terms += [number(t, len(self.numbers)) for t in found]
        self.frequencies += found.values()
        self.sizes.append(len(found))
        self.ids.append(0 if doc_id is None else doc_id)
        self.known.append(doc_id is not None)
        self.lengths.append(sum(found.values()))
        self.bytes += len(text)

    def row(self, number: int, documents: int, total: int) -> pa.RecordBatch:
        terms = np.array(self.terms, np.int32)
        order = np.argsort(terms, kind="stable")
        places = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        tf, lengths = np.array(self.frequencies, "<i8")[order], np.array(self.lengths, "<i8")
        level = -(-impacts(tf, lengths[places], documents, total) // STEP)
        values = [number, np.array(self.ids, "<i8").tobytes(), np.array(self.known, "?").tobytes(), lengths.tobytes(), list(self.numbers)]
        values += [np.bincount(terms, minlength=len(self.numbers)).astype("<i4").tobytes(), places.astype("<i4").tobytes(), level.astype("u1").tobytes(), tf.astype("<i4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], names=_NAMES)


def _blocks(documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(len(batch)):
                if texts[i].is_valid:
                    block.add(ids[i].as_py(), texts[i].as_py())
                if len(block.ids) >= DOCUMENTS or block.bytes >= BYTES:
                    yield block.row(made, documents, total)
                    made, block = made + 1, _Block()
            del ids, texts, batch
            give_back()
        if block.ids:
            yield block.row(made, documents, total)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = terms = 0
    for batch in batches:
        for text in batch.column(0):
            own = sum(map(len, slices(text.as_py() or b"")))
            n, terms = n + (own > 0), terms + own
        del batch
        give_back()
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([terms], pa.int64())], names=["n", "terms"])


@dataclass(frozen=True)
class Index:
    """Blocks of documents, how many documents have terms, and how many terms they have together."""

    blocks: DataFrame
    documents: int
    terms: int


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents, block by block, written in the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    n, terms = (x or 0 for x in rows.select("text").mapInArrow(_sums, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first())
    return Index(materialise(rows.mapInArrow(_blocks(n, max(1, terms)), _BLOCK), "index", **_WRITTEN), n, terms)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, counts in zip(*batch.columns):
            yield pa.RecordBatch.from_arrays([terms.values, pa.array(np.frombuffer(counts.as_py(), "<i4").astype(np.int64))], names=["term", "n"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(counted(x.as_py() or b"")) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item", "item_id", "terms"])


class _Search:
    """The k best documents of all blocks seen, for each of some items."""

    names, types = ["item", "doc_id", "score"], [pa.int64()] * 3

    def __init__(self, asked: list[tuple], k: int, documents: int, total: int):
        self.items = [a[0] for a in asked]
        self.asked = [dict(zip(a[1], a[2])) for a in asked]
        self.wanted = set().union(*self.asked)
        self.k, self.documents, self.total = k, documents, total
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in asked]
        self.scored = self.bounded = 0

    def add(self, ids: bytes, known: bytes, lengths: bytes, terms: list[bytes], counts: bytes, places: bytes, level: bytes, frequencies: bytes) -> None:
        lengths = np.frombuffer(lengths, "<i8")
        ends = np.cumsum(np.frombuffer(counts, "<i4"))
        places, level, tf = np.frombuffer(places, "<i4"), np.frombuffer(level, "u1"), np.frombuffer(frequencies, "<i4").astype(np.int64)
        ids, known = np.frombuffer(ids, "<i8"), np.frombuffer(known, "?")
        at = {term: slice(int(ends[t - 1]) if t else 0, int(ends[t])) for t, term in enumerate(terms) if term in self.wanted}
        first = {term: (places[span], level[span].astype(np.int64)) for term, span in at.items()}
        upper, held = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i, weights in enumerate(self.asked):
            mine = [(t, w) for t, w in weights.items() if w and t in first]
            if not mine:
                continue
            upper[:] = 0
            held[:] = 0
            for t, w in mine:
                own, byte = first[t]
                upper[own] += w * byte
                held[own] += w
            self._rank(i, mine, at, places, tf, lengths, ids, known, upper * STEP, (upper - held) * STEP)

    def _rank(self, i, mine, at, places, tf, lengths, ids, known, upper, lower) -> None:
        score, found, sure = self.best[i]
        limit = 1
        sums = np.concatenate([score, lower])
        if len(sums) > self.k:
            limit = max(1, int(np.partition(sums, -self.k)[-self.k]))
        rows = np.flatnonzero(upper >= limit)
        self.bounded += len(upper)
        self.scored += len(rows)
        if not len(rows):
            return
        exact = np.zeros(len(upper), np.int64)
        chosen = np.zeros(len(upper), bool)
        chosen[rows] = True
        for t, w in mine:
            own, f = places[at[t]], tf[at[t]]
            kept = chosen[own]
            own = own[kept]
            exact[own] += w * impacts(f[kept], lengths[own], self.documents, self.total)
        rows = rows[exact[rows] > 0]
        score, found, sure = np.concatenate([score, exact[rows]]), np.concatenate([found, ids[rows]]), np.concatenate([sure, known[rows]])
        if len(score) > self.k:
            order = np.lexsort((found, ~sure, -score))[: self.k]
            score, found, sure = score[order], found[order], sure[order]
        self.best[i] = score, found, sure

    def out(self) -> pa.RecordBatch:
        item = np.repeat(np.array(self.items, np.int64), [len(b[0]) for b in self.best])
        score, found, sure = (np.concatenate([b[n] for b in self.best]) for n in range(3))
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(found, mask=~sure), pa.array(score)], names=self.names)


def _meet(k: int, documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows of a group and column, items first, sorted so."""
        now, held, work = None, [], None
        for batch in batches:
            for i in range(len(batch)):
                g, c, side, item = (batch.column(n)[i].as_py() for n in range(4))
                if (g, c) != now:
                    if work:
                        yield work.out()
                    now, held, work = (g, c), [], None
                if side == 0:
                    held.append((item, batch.column(4)[i].as_py(), batch.column(5)[i].as_py()))
                elif held:
                    work = work or _Search(held, k, documents, total)
                    part = [batch.column(n)[i] for n in range(6, 14)]
                    work.add(*(x.as_py() for x in part))
            del batch
            give_back()
        if work:
            yield work.out()

    return run


def search(index: Index, items: DataFrame, *, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of an index for each row of items."""
    spark, blocks, documents, total = index.blocks.sparkSession, index.blocks, index.documents, index.terms
    asked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"), F.monotonically_increasing_id().alias("item"))
    kind = asked.schema["item_id"].dataType.simpleString()
    asked = materialise(asked.mapInArrow(_asked, f"item long, item_id {kind}, terms array<binary>"), "items")
    # terms of items with their frequencies: the blocks' terms that no item holds go before they are summed
    wanted = asked.select("item", F.explode("terms").alias("term"))
    df = blocks.select("terms", "counts").mapInArrow(_frequencies, "term binary, n long").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = wanted.join(df, "term").select("item", "term", weight.alias("w"))
    rows = weighted.groupBy("item").agg(F.collect_list("term").alias("asked"), F.collect_list("w").alias("weights"))
    n = partitions(spark)
    groups = max(1, -(-asked.count() // ITEMS))
    columns = max(1, round(n / groups))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    block = [("ids", "binary"), ("known", "binary"), ("lengths", "binary"), ("terms", "array<binary>"), ("counts", "binary"), ("places", "binary"), ("bytes", "binary"), ("frequencies", "binary")]
    left = rows.select(part("item", groups).alias("g"), every(columns).alias("c"), F.lit(0).alias("side"), "item", "asked", "weights", *(null(t, c) for c, t in block))
    right = blocks.select(every(groups).alias("g"), part("number", columns).alias("c"), F.lit(1).alias("side"), F.col("number").alias("item"), null("array<binary>", "asked"), null("array<long>", "weights"), *(c for c, _ in block))
    met = left.unionByName(right).repartitionById(n, (F.col("g") * columns + F.col("c")).cast("int")).sortWithinPartitions("g", "c", "side")
    found = met.mapInArrow(_meet(k, documents, max(1, total)), "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.select("*", rank.alias("rank")).filter(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
