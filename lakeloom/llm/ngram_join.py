"""N-gram Jaccard join (operator 3), with token-combination prefixes.

A document is the set of its distinct shingles (`words` words in a row). Two link if their Jaccard similarity is at least
`share`. Documents with equal sets are one class, found by a 128-bit digest and stood for by its smallest doc_id.

Prefixes. Order all shingles of the corpus from rare to frequent (then by hash). Sets of m and n shingles can only link
if they have t = share / (1 + share) * (m + n) in common, so of n - t + 1 first shingles of one, its prefix, the other's
prefix must hold one as well. Sizes fall into bands, and a set is indexed once for each band that a partner's size can be
in, with the prefix for that band's smallest size: similar sizes need short prefixes. Rare shingles (in fewer than
FREQUENT documents) are indexed singly. Frequent ones form groups by hash, and k of a group are indexed together (k = 2,
from VERY_FREQUENT on 3): as up to k - 1 shared shingles of a group then go unseen, the prefix is extended until it holds
n - t + 1 shingles beyond the first k - 1 of each group. The groups' (k - 1) add up to less than t, so a set never runs
out.

1. Every task makes batches of documents and sends the distinct shingles of a batch, with their numbers, packed, to hash
   partitions of the shingles, which sum them up and send back those in two or more documents; which documents have a
   shingle stays with the batch. So a passage of very many documents costs an entry a batch. A shingle of one document
   never links, so a document in which q or more occur nowhere else is done with. What is left is a table of all
   documents, with set size and digest, and the shared shingles of those that can link.
2. These sets' prefixes are indexed. In each entry all sets are checked against one, the hub: the one whose shingles are
   most frequent, as an original among its edited copies. So a group of copies costs a check each, not one a pair. Two
   sets of an entry that don't both link with the hub can only link if they share a shingle outside the hub, unless both
   share more with it than they need in common with each other. Pairs of the latter kind are checked. For the former,
   what each set has outside the hub is indexed under the hub and the shingle, and all pairs of such an entry that are in
   different components are checked, for its first 16 sets, then 64, 256, ... No link between components is missed.
3. A check intersects the two sets of shared shingles; sets travel to the checks, in groups of GROUP per first set.

Shingles are hashed to 64 bits, of which 48 (and the partition) are compared. Lower case of A-Z only, words between
ASCII white space. Texts that are null or have no word have empty sets and link with nothing; with fewer than `words`
words, the whole sequence is the one shingle. Rows that repeat a doc_id are one document that links if any of its texts
does; rows with null doc_id are returned with a null component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.byte_bpe import slices
from lakeloom.llm.common import documents, give_back, materialise, partitions
from lakeloom.llm.components import components
from lakeloom.llm.langid import mix

#: Documents from which on a shingle is indexed in pairs, and in threes.
FREQUENT, VERY_FREQUENT = 32, 1024
#: Between the smallest sizes of neighbouring bands: broad ones need longer prefixes, but a set is indexed for fewer.
RATIO = 1.34
#: Shingles in one batch that a task sends; shingles that a partition of them may get; sets checked with one first set.
BATCH, PARTITION, GROUP = 1_000_000, 6_000_000, 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


# --- shingles ---


def shingles(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
    values = split.flatten()
    full = np.asarray(pc.not_equal(values, ""))
    coded = values.filter(pa.array(full)).dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum(full)])[offsets]
    of_word = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = of_word[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.uint64)
    count = max(0, len(hashes) - words + 1)
    rolled = np.zeros(count, np.uint64)
    for k in range(words):
        rolled = rolled * _MULTIPLIER + hashes[k : k + count]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                whole = whole * _MULTIPLIER + h
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# --- which shingles are shared ---


def _pack(x: np.ndarray) -> bytes:
    """Unsigned integers, byte by byte of the same weight, compressed; the first byte says how many bytes one has."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


_SENT = "r int, batch long, docs boolean, a binary, b binary, c binary, d binary"
_SENT_ARROW = pa.schema([("r", pa.int32()), ("batch", pa.int64()), ("docs", pa.bool_()), *((x, pa.binary()) for x in "abcd")])


def _deltas(x: np.ndarray) -> bytes:
    """Rising unsigned integers, packed."""
    return _pack(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def _summed(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _sender(words: int, reducers: int):
    """From (doc_id, text), by batches of documents: for each partition of shingles a row with the distinct ones (a) and in
    how many of the batch's documents each is (b); and a row for the batch itself, with the documents' ids (a), set sizes
    (b), which ids are null and the digests (c), and the documents of all its shingles, by partition and shingle, after
    where each partition's begin (d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        sets: list[np.ndarray] = []
        held = 0

        def send() -> pa.RecordBatch:
            batch = task << 24 | made
            sizes = np.array([len(x) for x in sets], np.int64)
            null = np.array([x is None for x in ids])
            sent = np.where(null, 0, sizes)
            flat = np.concatenate([x[:n] for x, n in zip(sets, sent)])
            doc = np.repeat(np.arange(len(sets), dtype=np.uint64), sent)
            to = (mix(flat) % np.uint64(reducers)).astype(np.int64)
            short = flat >> np.uint64(16)
            order = np.lexsort((short, to))
            short, to, doc = short[order], to[order], doc[order]
            first = np.flatnonzero(np.append(True, (short[1:] != short[:-1]) | (to[1:] != to[:-1]))) if len(short) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(short))).astype(np.uint64)
            ends = np.searchsorted(to[first], np.arange(reducers + 1))
            rows = [(r, batch, False, _deltas(short[first[a:b]]), _pack(count[a:b]), first[a].tobytes(), b"") for r, a, b in zip(range(reducers), ends, ends[1:]) if b > a]
            digests = b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets)
            rows.append((batch % reducers, batch, True, np.array([x or 0 for x in ids], "<i8").tobytes(), sizes.astype("<i8").tobytes(), null.tobytes() + digests, _pack(doc)))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), _SENT_ARROW.types)], schema=_SENT_ARROW)

        for whole in batches:
            for part in slices(whole, "text", 4_000_000):
                for doc, found in zip(part.column(0).to_pylist(), shingles(part.column(1), words)):
                    ids.append(doc)
                    sets.append(found)
                    held += len(found)
                if held >= BATCH:
                    yield send()
                    ids, sets, held, made = [], [], 0, made + 1
        if ids:
            yield send()
        give_back()

    return run


def _count(group: pa.Table) -> pa.Table:
    """Of the shingles of one partition those in two or more documents, by batch: the shingles (a), where their documents
    begin among the batch's (b), 8 * log2 of how many documents have each (c), and how many of the
    batch (d). However many documents share a shingle, a batch has one entry for it."""
    rows = group.to_pylist()
    out = [r for r in rows if r["docs"]]
    rows = [r for r in rows if not r["docs"]]
    if rows:
        short = [_summed(r["a"]) for r in rows]
        ends = np.cumsum([0, *map(len, short)])
        own = np.concatenate([_unpack(r["b"]) for r in rows]).astype(np.int64)
        _, inverse = np.unique(np.concatenate(short), return_inverse=True)
        total = np.bincount(inverse, own)[inverse]
        del inverse
        for r, x, a, b in zip(rows, short, ends, ends[1:]):
            kept = np.flatnonzero(total[a:b] > 1)
            if len(kept):
                count = own[a:b]
                level = np.floor(8 * np.log2(total[a:b][kept])).astype(np.uint64)
                begin = np.frombuffer(r["c"], np.int64)[0] + np.cumsum(count) - count
                out.append(r | {"a": _deltas(x[kept]), "b": _deltas(begin[kept]), "c": _pack(level), "d": _pack(count[kept].astype(np.uint64))})
    found = pa.Table.from_pylist(out, _SENT_ARROW)
    give_back()
    return found


def needed(n: int, share: tuple[int, int]) -> int:
    """How many shingles a set of n must share at least with any set that it links with."""
    return -(-share[0] * n // share[1])


_SETS = "doc_id long, n_shingles long, d1 long, d2 long, shared binary, level binary"
_SETS_ARROW = pa.schema([*((x, pa.int64()) for x in ("doc_id", "n_shingles", "d1", "d2")), ("shared", pa.binary()), ("level", pa.binary())])


def _sets(share: tuple[int, int]):
    def run(group: pa.Table) -> pa.Table:
        """All documents of one batch: doc_id, set size, the set's digest (null: an empty set), and of those that can link
        the shared shingles in order and their levels."""
        rows = group.to_pylist()
        docs = next(r for r in rows if r["docs"])
        rows = [r for r in rows if not r["docs"]]
        ids, sizes = np.frombuffer(docs["a"], "<i8"), np.frombuffer(docs["b"], "<i8")
        null, digests = np.frombuffer(docs["c"][: len(ids)], bool), np.frombuffer(docs["c"][len(ids) :], "<i8").reshape(-1, 2)
        out: list[tuple[bytes | None, bytes | None]] = [(None, None)] * len(ids)
        if rows:
            count = np.concatenate([_unpack(r["d"]) for r in rows]).astype(np.int64)
            begin = np.concatenate([_summed(r["b"]) for r in rows]).astype(np.int64)
            at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            doc = _unpack(docs["d"]).astype(np.int64)[at]
            short = np.repeat(np.concatenate([_summed(r["a"]) for r in rows]), count)
            level = np.repeat(np.concatenate([_unpack(r["c"]) for r in rows]), count)
            shared = np.bincount(doc, minlength=len(ids))
            least = -(-share[0] * sizes // share[1])
            linkable = (shared >= least) & (sizes > 0) & ~null  # fewer than n - least + 1 shingles occur nowhere else
            some = linkable[doc]
            short, doc, level = short[some], doc[some], level[some]
            order = np.lexsort((short, level, doc))
            short, doc, level = short[order], doc[order], level[order]
            ends = np.searchsorted(doc, np.arange(len(ids) + 1))
            out = [(short[a:b].astype("<i8").tobytes(), level[a:b].astype(np.uint8).tobytes()) if ok else (None, None) for ok, a, b in zip(linkable, ends, ends[1:])]
        empty = sizes == 0
        columns = [pa.array(ids, mask=null), pa.array(sizes), *(pa.array(digests[:, k], mask=empty) for k in (0, 1)), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())]
        return pa.Table.from_arrays(columns, schema=_SETS_ARROW)

    return run


# --- prefixes ---


def band(n: int) -> int:
    """The size band of a set."""
    return int(np.log(n) / np.log(RATIO) + 1e-9)


def smallest(b: int) -> int:
    """The smallest size in a band."""
    n = max(1, int(RATIO**b) - 1)
    while band(n) < b:
        n += 1
    return n


def common(m: int, n: int, share: tuple[int, int]) -> int:
    """How many shingles sets of m and n have in common at least if they link."""
    return -(-share[0] * (m + n) // (share[0] + share[1]))


def groups(least: int) -> tuple[int, int]:
    """How many groups of pairs and of threes there are for sets that have `least` shingles in common: their k - 1 add up
    to less than that."""
    twos, threes = max(1, least // 8), least // 16
    return (twos, threes) if twos + 2 * threes < least else (1, 0) if least > 1 else (0, 0)


def signatures(n: int, shared: np.ndarray, level: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The hashes under which a set is indexed. shared: its shingles that other documents have, rare ones first."""
    alone, own = n - len(shared), band(n)
    tokens = shared.tolist()
    frequent, very = int(np.searchsorted(level, 8 * np.log2(FREQUENT))), int(np.searchsorted(level, 8 * np.log2(VERY_FREQUENT)))
    spread = mix(shared.astype(np.uint64)).tolist()
    out: set[int] = set()
    for other in range(band(-(-share[0] * n // share[1])), band(share[1] * n // share[0]) + 1):
        low = smallest(other)
        q = n - common(n, max(low, -(-share[0] * n // share[1])), share) + 1
        if alone >= q:
            continue
        bands = (min(own, other), max(own, other))
        twos, threes = groups(common(smallest(own), low, share))
        held: dict[tuple[int, int], list[int]] = {}
        got = alone
        for k, token in enumerate(tokens):
            if got >= q:
                break
            if k < frequent or not twos:
                out.add(hash((bands, token)))
                got += 1
                continue
            size = 3 if k >= very and threes else 2
            group = held.setdefault((size, spread[k] % (threes if size == 3 else twos)), [])
            got += len(group) >= size - 1
            group.append(token)
        for (size, g), members in held.items():
            # in the order of all shingles on either side
            out.update(hash((bands, size, g, *some)) for some in combinations(members, size))
    return np.array(sorted(out), np.int64)


_INDEX = "signature long, rarity long, node long, n long, m long"


def _index(share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, shared, level in zip(*(batch.column(k).to_pylist() for k in range(4))):
                levels = np.frombuffer(level, np.uint8)
                found = signatures(n, np.frombuffer(shared, "<i8"), levels, share)
                if len(found):
                    # originals have only shingles that many others have
                    rarity = 255 * n - int(levels.sum(dtype=np.int64))
                    same = (pa.array(np.full(len(found), x)) for x in (rarity, node, n, len(levels)))
                    yield pa.RecordBatch.from_arrays([pa.array(found), *same], ["signature", "rarity", "node", "n", "m"])

    return run


# --- pairs and checks ---


_HUBS = "signature long, hub long, node long, n long, m long"


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From _INDEX, sorted by signature, rarity, node: every other row of an entry with the entry's first node, its hub."""
    now = hub = None
    for batch in batches:
        signature, node = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        first = np.flatnonzero(np.append(True, signature[1:] != signature[:-1]))
        hubs = np.repeat(node[first], np.diff(np.append(first, len(signature))))
        if now is not None and signature[0] == now:
            hubs[: first[1] if len(first) > 1 else len(hubs)] = hub
        now, hub = signature[-1], hubs[-1]
        kept = pa.array(hubs != node)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hubs), *(batch.column(k) for k in (2, 3, 4))], ["signature", "hub", "node", "n", "m"]).filter(kept)


def _links(share: tuple[int, int], m: np.ndarray | int, n: np.ndarray | int, both: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of m and n with so many common shingles link."""
    return (share[0] + share[1]) * both >= share[0] * (m + n)


def _uncovered(share: tuple[int, int]):
    """From (signature, node, n, common, component), sorted by signature, where common is what the node shares with the
    entry's hub: the pairs that may link without sharing a shingle outside the hub."""

    def of(rows: list[tuple[np.ndarray, ...]]) -> set[tuple[int, int]]:
        node, n, common_, component = (np.concatenate(x) for x in zip(*rows))
        if (component == component[0]).all():
            return set()
        names, inverse, size = np.unique(component, return_inverse=True, return_counts=True)
        out = set()
        # every pair of two components has one that isn't in the largest
        for i in np.flatnonzero(inverse != np.argmax(size)):
            # what they share with the hub bounds what they have in common inside it
            at = np.flatnonzero((component != component[i]) & _links(share, n, n[i], np.minimum(common_, common_[i])) & (node != node[i]))
            out.update((min(a, b), max(a, b)) for a, b in zip(node[at].tolist(), [int(node[i])] * len(at)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, seen = None, [], set()

        def out() -> pa.RecordBatch:
            found = list(seen)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            signature, *rest = (batch.column(k).to_numpy() for k in range(5))
            first = np.flatnonzero(np.append(True, signature[1:] != signature[:-1]))
            for a, b in zip(first, np.append(first[1:], len(signature))):
                if signature[a] != now:
                    if rows:
                        seen |= of(rows)
                    now, rows = signature[a], []
                rows.append(tuple(x[a:b] for x in rest))
            if len(seen) > 200_000:
                yield out()
        if rows:
            seen |= of(rows)
        if seen:
            yield out()

    return run


def _pairs(first: int, last: int, share: tuple[int, int]):
    """From (signature, node, n, m, component), sorted by the first two, pairs of sets in different components of which
    one is among the sets number first to last of an entry. (null, null) says that some entry needs more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, mixed, lead = None, 0, False, None
        heads: list[tuple[int, int, int, int]] = []
        seen: set[tuple[int | None, int | None]] = set()
        more = False

        def out() -> pa.RecordBatch:
            rows = list(seen)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["a", "b"])

        for batch in batches:
            for signature, node, n, m, component in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if signature != now:
                    now, place, heads, lead, mixed = signature, 0, [], component, False
                mixed |= component != lead
                # no more than its shared shingles can be common
                for a, size, most, other in heads:
                    if other != component and a != node and _links(share, size, n, min(most, m)):
                        seen.add((min(a, node), max(a, node)))
                if first <= place < last:
                    heads.append((node, n, m, component))
                more |= mixed and place > last
                place += 1
                if len(seen) > 200_000:
                    yield out()
        if more:
            seen.add((None, None))
        if seen:
            yield out()

    return run


_CHECKED = "a long, b long, n long, m long, common long, link boolean, outside array<long>"


def _check(share: tuple[int, int], outside: bool):
    """From (a, chunk, b, n, shared), where the row with null b is that of a itself and comes first: what b has in common
    with a, whether they link, and, if asked for, b's shared shingles outside a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, []
        for batch in batches:
            rows = []
            for a, chunk, b, n, shared in zip(*(batch.column(k).to_pylist() for k in range(5))):
                shared = np.frombuffer(shared, "<i8")
                if (a, chunk) != key:
                    key, mine = (a, chunk), []
                if b is None:
                    mine.append((n, np.sort(shared)))
                    continue
                for size, own in mine:
                    inside = own[np.minimum(np.searchsorted(own, shared), len(own) - 1)] == shared
                    both = int(inside.sum())
                    rows.append((a, b, n, len(shared), both, _links(share, size, n, both), shared[~inside] if outside else None))
            if rows:
                kinds = (*[pa.int64()] * 5, pa.bool_(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], ["a", "b", "n", "m", "common", "link", "outside"])

    return run


def checked(pairs: DataFrame, sets: DataFrame, share: tuple[int, int], outside: bool = False) -> DataFrame:
    """The pairs (a, b), each with what its check gives."""
    n = partitions(pairs.sparkSession)
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    split = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / GROUP)).alias("chunk"))
    other = split.join(sets.select(F.col("node").alias("b"), "n", "shared"), "b").select("a", "chunk", "b", "n", "shared")
    own = split.select("a", "chunk").distinct().join(sets.select(F.col("node").alias("a"), "n", "shared"), "a")
    rows = other.unionAll(own.select("a", "chunk", F.lit(None).cast("long").alias("b"), "n", "shared"))
    return rows.repartition(n, "a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b")).mapInArrow(_check(share, outside), _CHECKED)


def _named(df: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """df with the components so far."""
    return df.join(found, "node", "left").select(*columns, F.coalesce("component", "node").alias("component"))


def _prepared(docs: DataFrame, words: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of every row doc_id, n_shingles and digest; the documents' classes (doc_id, first); and the sets that can link."""
    parts = partitions(docs.sparkSession)
    rows = documents(docs)
    # a shingle for each word, a word for each six bytes
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    reducers = max(parts, -(-total // 6 // PARTITION))
    sent = rows.mapInArrow(_sender(words, reducers), _SENT)
    back = sent.repartition(reducers, "r").groupBy("r").applyInArrow(_count, _SENT)
    known = materialise(back.repartition(reducers, "batch").groupBy("batch").applyInArrow(_sets(share), _SETS), "sets")
    classes = known.filter("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"))
    classes = materialise(classes, "classes")
    placed = known.join(classes, ["d1", "d2"]).filter("doc_id is not null").select("doc_id", "first")
    sets = known.filter("shared is not null").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "shared", "level", "d1", "d2")
    # one set for each class: that of its first document
    sets = sets.join(classes.withColumnRenamed("first", "node"), ["node", "d1", "d2"], "left_semi")
    return known.select("doc_id", "n_shingles", "d1", "d2"), placed, materialise(sets.select("node", "n", "shared", "level"), "linkable")


def links(docs: DataFrame, *, words: int = 5, share: tuple[int, int] = (3, 4)) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b, n_links) for each two classes of equal sets that link, a < b, and for each class of several
    documents, a = b; and the classes (doc_id, class). n_links: of pairs of documents. Every two sets of an index entry are
    checked, so a large group of near copies costs a check a pair."""
    _, placed, sets = _prepared(docs, words, share)
    members = materialise(placed.distinct().withColumnRenamed("first", "class"), "members")
    index = sets.mapInArrow(_index(share), _INDEX).select("signature", "node", "n", "m", F.col("node").alias("component"))
    index = index.repartition(partitions(docs.sparkSession), "signature").sortWithinPartitions("signature", "node")
    pairs = materialise(index.mapInArrow(_pairs(0, 1 << 62, share), "a long, b long").distinct(), "pairs")
    found = checked(pairs, sets, share).filter("link").select("a", "b").distinct()
    size = members.groupBy("class").agg(F.count("*").alias("k"))
    between = found.join(size.toDF("a", "k"), "a").join(size.toDF("b", "l"), "b").select("a", "b", (F.col("k") * F.col("l")).alias("n_links"))
    within = size.filter("k > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), F.expr("k * (k - 1) div 2").alias("n_links"))
    return between.unionAll(within), members


def join(docs: DataFrame, *, words: int = 5, share: tuple[int, int] = (3, 4)) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; share: the least similarity as a fraction. Links within components
    are mostly not verified: links() gives them."""
    parts = partitions(docs.sparkSession)
    known, placed, sets = _prepared(docs, words, share)
    # a doc_id that repeats with other texts is in several classes, which it links
    firsts = materialise(placed.groupBy("doc_id").agg(F.min("first").alias("first"), F.max("first").alias("last")), "firsts")
    own = placed.join(firsts.filter("first < last").select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))

    sort = lambda df, *more: df.repartition(parts, "signature").sortWithinPartitions("signature", *more)
    index = sets.mapInArrow(_index(share), _INDEX)
    hubs = materialise(sort(index, "rarity", "node").mapInArrow(_hubs, _HUBS), "hubs")
    near = materialise(checked(hubs.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets, share, outside=True), "near")
    links = near.filter("link").select("a", "b").unionAll(own)
    found = components(links)

    known_common = near.groupBy(F.col("a").alias("hub"), F.col("b").alias("node")).agg(F.max("common").alias("common"))
    rows = _named(hubs.join(known_common, ["hub", "node"]), found, "signature", "node", "n", "common")
    uncovered = sort(rows).mapInArrow(_uncovered(share), "a long, b long").distinct()
    # what is outside a hub becomes an entry of its own, with the hub
    outside = near.select(F.col("b").alias("node"), "n", "m", F.explode("outside").alias("token"), "a").select(F.xxhash64("a", "token").alias("signature"), "node", "n", "m").distinct()
    outside = materialise(outside, "outside")

    first, last = 0, 16
    while True:
        pairs = sort(_named(outside, found, "signature", "node", "n", "m"), "node").mapInArrow(_pairs(first, last, share), "a long, b long").distinct()
        pairs = materialise(pairs if first else pairs.unionAll(uncovered).distinct(), "pairs")
        fresh = materialise(checked(pairs.filter("a is not null"), sets, share).filter("link").select("a", "b"), "checked")
        if not fresh.isEmpty():
            links = links.unionAll(fresh)
            found = components(links)
        if pairs.filter("a is null").isEmpty():
            break
        first, last = last, 4 * last

    named = known.join(firsts.select("doc_id", "first"), "doc_id", "left").join(found.select(F.col("node").alias("first"), "component"), "first", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id")).alias("component_id"))
