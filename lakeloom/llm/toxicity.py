"""Toxicity (operator 10): a support vector machine on a subsequence string kernel, with Nystroem landmarks.

Units are the words of a text (lower case, letters only, so characters put between letters fall away), and runs of single
letters, joined. The kernel of two units sums, over all subsequences of three letters, the products of their weights;
a subsequence weighs DECAY ** span in each place it occurs with a span of at most SPAN, so gaps and inserted letters cost
weight but not the match. Kernels are normalised to 1 for equal units.

fit() takes at most about `sample` labelled texts, picked by a hash of the id, as bags of units, of which at least one
tells why a text is toxic. Units that stand in toxic texts only, or at a far higher rate than in clean ones, and too often
for chance (near copies, which share half of their pairs of neighbouring units, counting once) are telling; no share of the texts is asked for, so insults of a rare language
count as well. Telling units are positive, and of each toxic text without any the one in most toxic texts that stands in
no clean one. Each toxic text has the same weight. Units of clean texts are negative: the most frequent, and twice those
that the machine holds for worst. The rest stay unlabelled.
Landmarks are positives far from each other and the negatives nearest to them. A linear machine with
squared hinge loss is trained on the landmark features. As every such feature is linear in a unit's subsequences, the
machine is a table of weights by subsequence, an offset, and the unit's norm. A text's score is a logistic function,
fitted on the sample, of the decisions for its two highest units (one that occurs twice is two).

Where a text has fewer units, null, empty and letterless ones included, the offset, which is the decision for a unit that
shares nothing with any landmark, takes their place. Without any toxic or any clean label the score is 0 or 1. Texts are
read whole; equal texts get equal scores, repeated rows are returned each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.byte_bpe import slices
from lakeloom.llm.common import materialise
from lakeloom.llm.langid import mix

DECAY, SPAN = 0.6, 6
#: Letters of a unit at most; pieces of longer ones overlap, so no letter is left out.
PIECE, OVERLAP = 40, 8
#: Letters whose subsequences are worked out at once.
_AT_ONCE = 100_000
#: Hash functions that tell near copies.
HASHES = 64
#: A telling unit's rate in toxic texts is so many times that in clean ones; the chance that one is so by accident.
RATE, CHANCE = 12, 0.002
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
_MAYBE = r"(?:^|[\s\v\x1c-\x1f\x{85}\p{Z}])\pL[\s\v\x1c-\x1f\x{85}\p{Z}]\pL[\s\v\x1c-\x1f\x{85}\p{Z}]\pL(?:[\s\v\x1c-\x1f\x{85}\p{Z}]|$)"
_SINGLES = re.compile(r"(?<!\S)[^\W\d_](?:\s[^\W\d_]){2,}(?!\S)")


def subsequences(unit: str) -> dict[str, float]:
    out: dict[str, float] = {}
    for i in range(len(unit)):
        for a, b in _STEPS:
            if i + a + b < len(unit):
                u = unit[i] + unit[i + a] + unit[i + a + b]
                out[u] = out.get(u, 0.0) + DECAY ** (a + b + 1)
    return out


def norm(found: dict[str, float]) -> float:
    return sum(x * x for x in found.values()) ** 0.5


def cut(unit: str) -> list[str]:
    """A unit's pieces, of at most PIECE letters."""
    return [unit[i : i + PIECE] for i in range(0, max(1, len(unit) - OVERLAP), PIECE - OVERLAP)] if len(unit) > PIECE else [unit]


def units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units of all texts, and of each unit that occurs its number and its text's number."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    split = pc.utf8_split_whitespace(low)
    values = split.flatten().dictionary_encode()
    of = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
    words = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in values.dictionary.to_pylist()]
    numbers: dict[str, int] = {}
    pieces: list[list[int]] = []
    for w in words:
        pieces.append([numbers.setdefault(x, len(numbers)) for x in cut(w) if len(x) > 2])
    sizes = np.array([len(x) for x in pieces], np.int64)
    flat = np.array([x for p in pieces for x in p], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    index = np.asarray(values.indices).astype(np.int64) if len(values) else np.zeros(0, np.int64)
    n = sizes[index] if len(index) else index
    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    unit, text = flat[np.repeat(starts[index], n) + shift] if len(flat) else np.zeros(0, np.int64), np.repeat(of, n)
    may = np.flatnonzero(np.asarray(pc.match_substring_regex(low, _MAYBE)))
    spelled = [(int(k), x) for k in may for m in _SINGLES.finditer(low[k].as_py()) for x in cut("".join(m.group().split()))]
    if spelled:
        unit = np.concatenate([unit, [numbers.setdefault(x, len(numbers)) for _, x in spelled]])
        text = np.concatenate([text, [k for k, _ in spelled]])
    return list(numbers), unit, text


def signatures(texts: pa.Array) -> np.ndarray:
    """HASHES smallest hashes of each text's pairs of neighbouring units, each under another hash function."""
    found, unit, text = units(texts)
    out = np.full((len(texts), HASHES), np.iinfo(np.uint32).max, np.uint32)
    if len(unit):
        order = np.argsort(text, kind="stable")
        hashes, text = np.array([xxhash.xxh3_64_intdigest(u) for u in found], np.uint64)[unit[order]], text[order]
        start = np.append(True, text[1:] != text[:-1])
        before = np.where(start, np.uint64(0), np.roll(hashes, 1))
        pair, at = mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes), np.flatnonzero(start)
        for k in range(HASHES):
            out[text[at], k] = np.minimum.reduceat(mix(pair + np.uint64(k)) >> np.uint64(32), at)
    return out


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in texts.to_pylist()], pa.int64())


def near_copies(signature: np.ndarray) -> np.ndarray:
    """For each row the number of its group: rows that agree in half of their hashes are in one."""
    key = np.arange(len(signature))
    for k in range(1, len(signature)):
        for other in np.unique(key[:k][(signature[:k] == signature[k]).sum(axis=1) >= signature.shape[1] / 2]):
            key[key == other] = key[k]
    return key


def _triples(points: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]]:
    """For each way to span three letters of one unit: that unit, the weight, and the three letters, of all places."""
    for a, b in _STEPS:
        c = a + b
        if len(points) > c:
            at = np.flatnonzero(of[:-c] == of[c:])
            yield of[at], DECAY ** (c + 1), points[at], points[at + a], points[at + c]


def norms(points: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
    """norm(subsequences(unit)) of each of `count` units, whose letters are numbered from 0 on."""
    out, kinds = np.zeros(count), int(points.max(initial=0)) + 1
    first, start = np.searchsorted(of, np.arange(count + 1)), 0
    most = max(1, (1 << 62) // kinds**3)  # units whose keys fit a long
    while start < count:
        end = max(start + 1, min(count, start + most, int(np.searchsorted(first, first[start] + _AT_ONCE, "right")) - 1))
        part = slice(first[start], first[end])
        rows = [(((u - start) * kinds + x) * kinds + y) * kinds + z for u, _, x, y, z in _triples(points[part], of[part])]
        weights = [np.full(len(u), w) for u, w, *_ in _triples(points[part], of[part])]
        if rows and sum(map(len, rows)):
            key = np.concatenate(rows)
            order = np.argsort(key, kind="stable")
            key = key[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            each = np.add.reduceat(np.concatenate(weights)[order], begin)
            out[start:end] = np.bincount(key[begin] // kinds**3, each * each, end - start)
        start = end
    return np.sqrt(out)


@dataclass
class Model:
    letters: str  # in the order of the table's axes, from 1 on; 0 is any other letter
    table: np.ndarray
    offset: float
    slope: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    shift: float = 0.0
    constant: float | None = None

    def decide(self, found: list[str]) -> np.ndarray:
        """The machine's decision for each unit."""
        if not found:
            return np.zeros(0)
        points = np.frombuffer("".join(found).encode("utf-32-le"), "<u4").astype(np.int64)
        of = np.repeat(np.arange(len(found)), [len(u) for u in found])
        code = np.zeros(0x110000, np.int64)
        code[[ord(c) for c in self.letters]] = np.arange(1, len(self.letters) + 1)
        total, flat, n = np.zeros(len(found)), self.table.ravel(), len(self.letters) + 1
        for u, w, x, y, z in _triples(code[points], of):
            total += np.bincount(u, flat[(x * n + y) * n + z] * w, len(found))
        present = np.zeros(0x110000, bool)
        present[points] = True
        number = np.cumsum(present) - 1
        return total / np.maximum(1e-12, norms(number[points], of, len(found))) + self.offset

    def highest(self, texts: pa.Array) -> np.ndarray:
        """The highest and the second highest decision among each text's units, as two columns."""
        found, unit, text = units(texts)
        out = np.full((len(texts), 2), self.offset)
        if len(unit):
            decision = self.decide(found)
            # by text, then decision
            order = np.argsort(decision, kind="stable")
            place = np.empty(len(found), np.int64)
            place[order] = np.arange(len(found))
            key = np.sort(text * len(found) + place[unit])
            text, decision = key // len(found), decision[order][key % len(found)]
            last = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
            out[text[last], 0] = decision[last]
            two = last[(last > 0) & (text[last - 1] == text[last])]
            out[text[two], 1] = decision[two - 1]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        first, second = self.highest(texts).T
        # term by term: a matrix product may round a row by where it stands
        return 1 / (1 + np.exp(-np.clip(first * self.slope[0] + second * self.slope[1] + self.shift, -500, 500)))


class Kernel:
    """Kernels of units with some landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, self.rows = landmarks, {}
        for k, x in enumerate(landmarks):
            found = subsequences(x)
            size = norm(found)
            for u, w in found.items():
                self.rows.setdefault(u, np.zeros(len(landmarks)))[k] = w / size

    def __call__(self, some: list[str]) -> np.ndarray:
        out = np.zeros((len(some), len(self.landmarks)))
        for k, x in enumerate(some):
            found = subsequences(x)
            for u, w in found.items():
                if u in self.rows:
                    out[k] += w * self.rows[u]
            out[k] /= max(1e-12, norm(found))
        return out


def landmarks(positive: list[str], negative: list[str], most: int) -> list[str]:
    """Positives, each as far from those before it as can be, and the negatives nearest to them."""
    chosen, near = [], np.zeros(len(positive))
    while len(chosen) < min(most, len(positive)):
        k = int(np.argmin(near))
        if near[k] > 0.9:
            break
        chosen.append(positive[k])
        near = np.maximum(near, Kernel([positive[k]])(positive)[:, 0])
        near[k] = 2
    hard = Kernel(chosen)(negative).max(axis=1) if negative and chosen else np.zeros(0)
    return chosen + [negative[k] for k in np.argsort(-hard, kind="stable")[:most]]


def train(positive: list[str], negative: list[str], most: int = 300, weights: np.ndarray | None = None, rounds: int = 50) -> Model:
    """The machine from labelled units, by Newton's method; weights: of the positives."""
    chosen = landmarks(positive, negative, most)
    kernel = Kernel(chosen)
    values, vectors = np.linalg.eigh(kernel(chosen))
    kept = values > 1e-6 * values.max()
    to = vectors[:, kept] / np.sqrt(values[kept])
    x = kernel(positive + negative) @ to
    x = np.column_stack([x, np.ones(len(x))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    weights = np.ones(len(positive)) if weights is None else weights
    weight = np.concatenate([0.5 * weights / weights.sum(), np.full(len(negative), 0.5 / max(1, len(negative)))])
    ridge, w = np.append(np.full(x.shape[1] - 1, 1e-4), 1e-9), np.zeros(x.shape[1])
    loss = lambda w: (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + 0.5 * (ridge * w * w).sum()
    now = loss(w)
    for _ in range(rounds):
        at = y * (x @ w) < 1
        xa = x[at] * weight[at, None]
        step = np.linalg.solve(2 * xa.T @ x[at] + np.diag(ridge), ridge * w - 2 * xa.T @ (y[at] - x[at] @ w))
        part = 1.0
        while part > 1e-4 and loss(w - part * step) > now:
            part /= 2
        w, last, now = w - part * step, now, loss(w - part * step)
        if last - now < 1e-9 * last:
            break
    w, b = w[:-1], w[-1]
    alpha = to @ w
    letters = "".join(sorted({c for u in kernel.rows for c in u}))
    place, n = {c: k + 1 for k, c in enumerate(letters)}, len(letters) + 1
    table = np.zeros((n, n, n))
    for u, row in kernel.rows.items():
        table[place[u[0]], place[u[1]], place[u[2]]] = row @ alpha
    return Model(letters, table, float(b))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, positives: int = 1500, negatives: int = 6000, hard: int = 2000, most: int = 300) -> Model:
    """From doc_id, text and doc_id, toxic (0/1). What reaches the driver: `positives`, `negatives` and twice `hard` units,
    and a signature and numbers for each text of the sample. The labels of the sample, whose size is bounded, are sent to all tasks, so texts aren't shuffled."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model("", np.zeros((1, 1, 1)), -1.0, constant=float(bad > 0))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    # a quarter of the sample from toxic texts, as far as there are so many
    part = F.when(F.col("toxic") == 1, min(1.0, sample / 4 / bad)).otherwise(min(1.0, sample * 3 / 4 / good))
    picked = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(known.filter(spread < part)), "doc_id").select("text", "toxic")
    picked = materialise(picked, "sample")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                rows = [x.tobytes() for x in signatures(batch.column(0))]
                yield pa.RecordBatch.from_arrays([_digests(batch.column(0)), pa.array(rows, pa.binary()), batch.column(1)], ["digest", "signature", "toxic"])

    # near copies get one key, and count once
    seen = picked.mapInArrow(signed, "digest long, signature binary, toxic int").distinct().orderBy("digest", "toxic").toArrow()
    digests, first = np.unique(seen["digest"].to_numpy(), return_index=True)
    rows = seen["signature"].to_pylist()
    keys = near_copies(np.array([np.frombuffer(rows[k], np.uint32) for k in first], np.uint32).reshape(len(first), HASHES))
    of_text, toxic = keys[np.searchsorted(digests, seen["digest"].to_numpy())], seen["toxic"].to_numpy()
    n_bad, n_good = (max(1.0, float(len(np.unique(of_text[toxic == t])))) for t in (1, 0))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                found, unit, text = units(batch.column(0))
                key = keys[np.searchsorted(digests, _digests(batch.column(0)).to_numpy())]
                pairs = np.unique(unit * len(batch) + text)
                unit, text = pairs // len(batch), pairs % len(batch)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()).take(pa.array(unit)), pa.array(key[text]), pa.array(batch.column(1).to_numpy()[text])], ["item", "key", "toxic"])

    held = materialise(picked.mapInArrow(bags, "item string, key long, toxic int").distinct(), "bags")
    share, b, g = n_bad / (n_bad + n_good), F.col("bad"), F.col("good")
    # Chernoff's bound of the chance that as many of the texts with a unit are toxic
    chance = b * F.log(b / (b + g) / share) + F.when(g > 0, g * F.log(g / (b + g) / (1 - share))).otherwise(0.0)
    telling = F.when((b > 1) & (b / n_bad >= RATE * (g + 0.5) / (n_good + 1)), chance >= -np.log(CHANCE)).otherwise(False)
    counted = held.groupBy("item").agg(*(F.sum((F.col("toxic") == t).cast("long")).alias(n) for t, n in ((1, "bad"), (0, "good"))))
    counted = materialise(counted.withColumn("told", telling), "units")
    of = held.filter("toxic = 1").join(counted.filter("told or good = 0"), "item").select("key", "item", "bad", "told")
    texts = of.groupBy("key").agg(F.sum(F.col("told").cast("long")).alias("n"), F.max(F.struct("bad", "item"))["item"].alias("witness"))
    each = of.join(texts, "key").filter(F.when(F.col("n") > 0, F.col("told")).otherwise(F.col("item") == F.col("witness")))
    each = each.groupBy("item").agg(F.sum(1 / F.greatest(F.lit(1), F.col("n"))).alias("weight"))
    each = each.orderBy(F.desc("weight"), "item").limit(positives).collect()
    positive, weights = [r["item"] for r in each], np.array([r["weight"] for r in each])
    if not positive:
        return Model("", np.zeros((1, 1, 1)), -1.0, constant=bad / (bad + good))
    clean = counted.filter("not told and good > 0")
    negative = [r["item"] for r in clean.orderBy(F.desc("good"), "item").limit(negatives).collect()]
    model = train(positive, negative, most, weights)

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.decide(batch.column(0).to_pylist()))], ["item", "decision"])

    for _ in range(2):
        mined = clean.select("item").mapInArrow(worst, "item string, decision double").orderBy(F.desc("decision"), "item").limit(hard)
        negative = list(dict.fromkeys(negative + [r["item"] for r in mined.collect()]))
        model = train(positive, negative, most, weights)

    def high(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                first, second = model.highest(batch.column(0)).T
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), batch.column(1)], ["first", "second", "toxic"])

    seen = picked.mapInArrow(high, "first double, second double, toxic int").toArrow()
    if len(seen):
        model.slope, model.shift = _logistic(np.stack([seen["first"].to_numpy(), seen["second"].to_numpy()], axis=1), seen["toxic"].to_numpy(), bad / (bad + good))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Slopes and shift for P(y = 1), by Newton's method; classes weigh by their share of all labels."""
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    z, t = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.array([0.05] * x.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -30, 30)))
        g = z.T @ (weight * (p - y)) + ridge * t * ([1] * x.shape[1] + [0])
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), g)
        t = t - step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
    return t[:-1], float(t[-1])


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in keep and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 8_000_000):
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sent.value.score(batch.column(len(keep))))], [*keep, "score"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{schema}score double")
