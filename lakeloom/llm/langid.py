"""Language identification (operator 6) with language-bitmask n-gram filters.

The model is one Bloom filter for all languages, bit-sliced: slot s holds a mask with a bit for each language, and an
n-gram is in a language if that bit is set in all of its slots. One lookup of an n-gram so returns every language that
contains it. Of a text, the bits are counted per language over all its n-grams (characters of lower-cased words with
their borders); of each count, the hits that the filter's fill rate alone would give are taken off. The language with
the largest corrected count wins (ties: first by name); the score is its share of the two largest.

fit() learns from rows with text and language, at most about `sample` rows of each language, picked by a hash of the id.
An n-gram enters the filter of a language if it was seen there `least` times and its rate there is `ratio` or more of
its highest rate in any language; of those, the `grams` most frequent.

Texts that are null or have no letter are `und` with score 0; letters without any known n-gram give the language with
most training rows and score 0; without any training row all is `und`. Texts are read whole; equal texts get equal
results; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.byte_bpe import slices

UNDETERMINED = "und"
ORDERS = (2, 3, 4)
HASHES = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, runs of non-letters as one zero, and where each text's first letter is; a
    zero stands before it and after its last."""
    texts = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    letters = _letters()[points]
    points = np.where(letters, points, 0)
    kept = letters.copy()
    kept[1:] |= letters[:-1]  # the first non-letter of a run
    kept[0] = True
    return points[kept], np.cumsum(kept)[starts - 1]


def grams(points: np.ndarray, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the start positions and 64-bit hashes of the n-grams that stay in one word with its borders."""
    wide = points.astype(np.uint64)
    for n in orders:
        count = len(wide) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, np.uint64)
        inside = np.ones(count, bool)
        for k in range(n):
            part = wide[k : k + count]
            h = (h + part + np.uint64(1)) * _ODD
            if 0 < k < n - 1:
                inside &= part > 0
        if n < 3:  # a border alone is no n-gram; a short word with both its borders is one
            inside &= (wide[:count] > 0) | (wide[n - 1 : n - 1 + count] > 0)
        at = np.flatnonzero(inside)
        yield at, mix(h[at])


@dataclass
class Model:
    languages: list[str]
    common: str = UNDETERMINED  # of the most training rows
    slots: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.uint64))  # [slot, word of the mask]

    def __post_init__(self):
        used = self.slots[:, [k // 64 for k in range(len(self.languages))]] >> np.array([k % 64 for k in range(len(self.languages))], np.uint64) & np.uint64(1)
        self.false = used.mean(axis=0) ** HASHES if len(self.languages) else np.zeros(0)
        self.false_any = 1 - float(np.prod(1 - self.false))

    def masks(self, h: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.slots))
        found = self.slots[(h % size).astype(np.int64)]
        for k in range(1, HASHES):
            found = found & self.slots[(mix(h + np.uint64(k)) % size).astype(np.int64)]
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Each text's language, its score, and the share of the text's n-grams that some language knows: of a text in two
        languages most, of one in a language that wasn't learned few."""
        points, starts = word_characters(texts)
        lettered = np.bincount(np.searchsorted(starts, np.flatnonzero(points), "right") - 1, minlength=len(texts)) > 0
        hits, total, known_to_any = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts))
        for at, h in grams(points) if self.languages else ():
            # an n-gram that starts with a border belongs to the text of the letter after it
            text = np.searchsorted(starts, at + (points[at] == 0), "right") - 1
            total += np.bincount(text, minlength=len(texts))
            found = self.masks(h)
            known_to_any += np.bincount(text[found.any(axis=1)], minlength=len(texts))
            for k in range(len(self.languages)):
                hits[:, k] += np.bincount(text[(found[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(bool)], minlength=len(texts))
        names, scores, shares = [], [], []
        for row, n, some, ok in zip(hits, total, known_to_any, lettered):
            if not ok or not self.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                shares.append(0.0)
                continue
            real = np.maximum(row - n * self.false, 0) / np.maximum(1 - self.false, 1e-9)
            best = int(np.argmax(real))
            second = float(np.delete(real, best).max(initial=0))
            known = real[best] > 0
            names.append(self.languages[best] if known else self.common)
            scores.append(float(real[best] / (real[best] + second)) if known else 0.0)
            shares.append(float(max(some - n * self.false_any, 0) / max(1 - self.false_any, 1e-9) / n) if n else 0.0)
        return names, scores, shares


def fit(labelled: DataFrame, *, sample: int = 1500, ratio: float = 0.5, least: int = 3, grams_kept: int = 60_000, slots: int = 1 << 20) -> Model:
    """From doc_id, text, lang of rows to learn from. What reaches the driver: at most grams_kept n-grams a language."""
    rows = labelled.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([])
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    picked = rows.filter(spread < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                lang = np.array(batch.column(1).to_pylist(), dtype=object)
                for name in dict.fromkeys(lang.tolist()):
                    points, _ = word_characters([t for t, x in zip(batch.column(0).to_pylist(), lang) if x == name])
                    for _, h in grams(points):
                        value, n = np.unique(h, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    seen = picked.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    likely = seen.withColumn("rate", rate).withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).filter(F.col("rate") >= ratio * F.col("most"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = likely.withColumn("place", place).filter(F.col("place") <= grams_kept).select("lang", "gram").toArrow()
    table = np.zeros((slots, -(-len(languages) // 64)), np.uint64)
    h, code = kept["gram"].to_numpy().view(np.uint64), np.array([languages.index(x) for x in kept["lang"].to_pylist()], np.int64)
    for k in range(HASHES):
        at = ((mix(h + np.uint64(k)) if k else h) % np.uint64(slots)).astype(np.int64)
        np.bitwise_or.at(table, (at, code // 64), np.uint64(1) << (code % 64).astype(np.uint64))
    return Model(languages, max(languages, key=lambda x: sizes[x]), table)


def identify(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", known: bool = False) -> DataFrame:
    """The columns in keep, lang_pred and score of every row; if asked for, also the share of known n-grams."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 1_000_000):
                names, scores, shares = sent.value.judge(batch.column(len(keep)).to_pylist())
                more = [pa.array(shares, pa.float64())] if known else []
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), *more], [*keep, "lang_pred", "score", *["known"] * known])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{schema}lang_pred string, score double{', known double' if known else ''}")
