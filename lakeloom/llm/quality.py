"""Quality classifier (operator 7), a weak-label model.

Overlapping heuristic labellers (LABELLERS) each call a text bad, good, or abstain. How often each pattern of votes occurs
is counted over all texts, and expectation-maximisation on these counts estimates the labellers' accuracies (how often
each calls bad texts bad and good ones good) and the share of bad texts, without any label. That gives each pattern a
posterior, and the posteriors of about `sample` texts, picked by a hash of the id, are the labels that a hashed linear
scorer is trained on: character-class trigrams and binned statistics, hashed to BUCKETS features, logistic loss.

A text's score is the probability that it is good; it is kept if that is at least a half. Null texts count as empty;
empty and very short texts get abstentions, and so what the shape of few characters says. Texts are read whole; equal
texts get equal scores; an empty table gives no rows, and a model without any rows scores all texts 1.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.byte_bpe import slices
from lakeloom.llm.langid import mix

BUCKETS = 2048
GOOD, BAD, ABSTAIN = 0, 1, 2
#: Classes of characters: these and digits, lower case, upper case, other letters, white space, other symbols.
_OWN = "\n.,!?'\"-:;()|"
_LOWER, _UPPER, _LETTER, _DIGIT, _SPACE, _SYMBOL = range(len(_OWN), len(_OWN) + 6)
_CLASSES = len(_OWN) + 6

#: Name, statistic, votes bad from, votes good up to, and the least number of words to vote at all.
LABELLERS = (
    ("symbols", "symbol_share", 0.06, 0.015, 5),
    ("shouting", "upper_share", 0.35, 0.12, 8),
    ("exclaiming", "exclaim_rate", 0.20, 0.04, 8),
    ("tables", "bar_rate", 0.10, 0.02, 8),
    ("stutter", "stutter_share", 0.12, 0.03, 8),
    ("repeated lines", "line_repeats", 0.40, 0.15, 8),
    ("small vocabulary", "word_repeats", 0.75, 0.60, 25),
    ("unmarked words", "marked_share", 0.50, 0.25, 30),
)
_STATISTICS = [x[1] for x in LABELLERS]


@functools.cache
def _class_of() -> np.ndarray:
    table = np.full(0x110000, _SYMBOL, np.uint8)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            table[c] = _LOWER if s.islower() else _UPPER if s.isupper() else _LETTER
        elif s.isdigit():
            table[c] = _DIGIT
        elif s.isspace():
            table[c] = _SPACE
    for k, s in enumerate(_OWN):
        table[ord(s)] = k
    return table


def _classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts the classes of their characters, and of each character its text's number."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return _class_of()[points], np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of _STATISTICS for each text, and its number of words."""
    texts = [t or "" for t in texts]
    kinds, of = _classes(texts)
    counts = np.bincount(of * _CLASSES + kinds, minlength=len(texts) * _CLASSES).reshape(-1, _CLASSES)
    size = np.maximum(1, counts.sum(axis=1))
    letters = np.maximum(1, counts[:, _LOWER] + counts[:, _UPPER] + counts[:, _LETTER])
    words_of = [t.split() for t in texts]
    words = np.array([len(w) for w in words_of], np.int64)
    n = np.maximum(1, words)
    stutter = np.array([sum(map(eq, w, w[1:])) for w in words_of])
    kinds_of = np.array([len(set(w)) for w in words_of])
    # a text of n words needs fewer kinds the longer it is
    expected = np.minimum(n, 12 * np.sqrt(n))
    lines_of = [[x for x in t.split("\n") if x.strip()] for t in texts]
    repeats = np.array([1 - len(set(x)) / len(x) if len(x) > 2 else 0.0 for x in lines_of])
    marked = np.array([sum(not w[-1].isalnum() for w in ws) for ws in words_of])
    out = {
        "symbol_share": counts[:, _SYMBOL] / size,
        "upper_share": counts[:, _UPPER] / letters,
        "exclaim_rate": counts[:, _OWN.index("!")] / n,
        "bar_rate": counts[:, _OWN.index("|")] / n,
        "stutter_share": stutter / n,
        "line_repeats": repeats,
        "word_repeats": 1 - kinds_of / np.maximum(1, expected),
        "marked_share": marked / n,
    }
    return np.stack([out[k] for k in _STATISTICS], axis=1), words


def votes(stats: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.full(stats.shape, ABSTAIN, np.int64)
    for k, (_, _, bad, good, least) in enumerate(LABELLERS):
        out[stats[:, k] <= good, k] = GOOD
        out[stats[:, k] >= bad, k] = BAD
        out[words < least, k] = ABSTAIN
    return out


def pattern(votes_: np.ndarray) -> np.ndarray:
    return votes_ @ 3 ** np.arange(votes_.shape[1])


def features(texts: list[str | None], stats: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A row of BUCKETS values for each text, of length 1."""
    texts = [t or "" for t in texts]
    kinds, of = _classes(texts)
    out = np.zeros((len(texts), BUCKETS), np.float32)
    if len(kinds) > 2:
        wide = kinds.astype(np.int64)
        code = (wide[:-2] * _CLASSES + wide[1:-1]) * _CLASSES + wide[2:]
        bucket = (mix(np.arange(_CLASSES**3, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
        whole = of[:-2] == of[2:]
        n = np.bincount((of[:-2] * BUCKETS + bucket[code])[whole], minlength=out.size).reshape(out.shape)
        out += np.sqrt(n / np.maximum(1, n.sum(axis=1, keepdims=True)))
    for k in range(stats.shape[1]):
        level = np.minimum(15, (stats[:, k] * 20).astype(np.int64)) + 16 * (words >= LABELLERS[k][4])
        at = mix((np.uint64(1 << 20) + np.uint64(64 * k)) + level.astype(np.uint64)) % np.uint64(BUCKETS)
        out[np.arange(len(texts)), at.astype(np.int64)] += 0.35
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def estimate(patterns: dict[int, int], rounds: int = 100) -> tuple[np.ndarray, float]:
    """Expectation-maximisation over the counts of vote patterns: accuracies [labeller, class] (the share of its votes
    that are right where the text is good, bad) and the share of bad texts."""
    n = len(LABELLERS)
    codes, weight = np.array([*patterns], np.int64), np.array([*patterns.values()], float)
    seen = codes[:, None] // 3 ** np.arange(n) % 3
    right = np.tile([0.995, 0.30], (n, 1))
    share = 0.1
    for _ in range(rounds):
        bad = posterior_of(seen, right, share)
        share = float(np.clip((weight * bad).sum() / weight.sum(), 1e-4, 0.9))
        for k in range(n):
            for c, p in ((GOOD, 1 - bad), (BAD, bad)):
                said = weight * p * (seen[:, k] != ABSTAIN)
                # a prior of a few votes keeps labellers that hardly ever vote where they were
                right[k, c] = ((said * (seen[:, k] == c)).sum() + 8 * (0.995, 0.30)[c]) / (said.sum() + 8)
        # Kinds of bad text are disjoint, so each labeller misses most of them. Without a bound on false alarms, the
        # likelihood would take the two labellers that agree best for the truth and all others' votes for errors.
        right[:, GOOD] = np.clip(right[:, GOOD], 0.99, 0.9995)
        right[:, BAD] = np.clip(right[:, BAD], 0.05, 0.999)
    return right, share


def posterior_of(seen: np.ndarray, right: np.ndarray, share: float) -> np.ndarray:
    """The probability that a text with these votes is bad."""
    good = np.log(1 - share) + np.where(seen == GOOD, np.log(right[:, GOOD]), np.where(seen == BAD, np.log(1 - right[:, GOOD]), 0)).sum(axis=1)
    bad = np.log(share) + np.where(seen == BAD, np.log(right[:, BAD]), np.where(seen == GOOD, np.log(1 - right[:, BAD]), 0)).sum(axis=1)
    return 1 / (1 + np.exp(np.clip(good - bad, -500, 500)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray
    bad_share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        # row by row: a matrix product may round a row by where it stands
        return 1 / (1 + np.exp(np.clip(np.einsum("ij,j->i", x, self.weights) + self.bias, -500, 500)))


def train(x: np.ndarray, bad: np.ndarray, rounds: int = 400, rate: float = 4.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; the classes weigh alike, up to a factor of ten."""
    weight = np.where(bad > 0.5, min(10.0, max(1.0, (1 - bad).sum() / max(1.0, bad.sum()))), 1.0)
    weight /= weight.sum()
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w.copy(), b
    for k in range(rounds):
        # products in x's own single precision; anything else would copy all of x in every round
        p = 1 / (1 + np.exp(-np.clip(x @ vw.astype(x.dtype) + vb, -500, 500)))
        g = weight * (p - bad)
        nw, nb = vw - rate * (x.T @ g.astype(x.dtype) + decay * vw), vb - rate * g.sum()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


def fit(docs: DataFrame, *, sample: int = 4000, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """What reaches the driver: counts of vote patterns (3 ** labellers at most) and about `sample` feature rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                codes, n = np.unique(pattern(votes(*statistics(batch.column(0).to_pylist()))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["code", "n"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = rows.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    if not counted:
        return Model(np.zeros(BUCKETS), -500.0, np.ones((len(LABELLERS), 2)), 0.0)
    patterns = {r["code"]: r["n"] for r in counted}
    right, share = estimate(patterns)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                texts = batch.column(0).to_pylist()
                stats, words = statistics(texts)
                x = features(texts, stats, words).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array(pattern(votes(stats, words))), pa.array([r.tobytes() for r in x], pa.binary())], ["code", "x"])

    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    some = rows.filter(spread < min(1.0, sample / sum(patterns.values()))).select("text").mapInArrow(featured, "code long, x binary").toArrow()
    if not len(some):
        return Model(np.zeros(BUCKETS), -500.0, right, share)
    x = np.frombuffer(b"".join(some["x"].to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    seen = some["code"].to_numpy()[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    w, b = train(x, posterior_of(seen, right, share))
    return Model(w, b, right, share)


def classify(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in keep, quality (0 to 1) and kept of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 2_000_000):
                texts = batch.column(len(keep)).to_pylist()
                found = sent.value.score(features(texts, *statistics(texts)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found.astype(np.float64)), pa.array(found >= 0.5)], [*keep, "quality", "kept"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{schema}quality double, kept boolean")
