"""Byte-level BPE encoding and decoding (operator 8), with the tokenizers library over Arrow batches.

A vocabulary is either a tokenizers JSON file or a file of base64 tokens with ranks. For rank files the merges are
derived so that the library merges exactly the pairs whose joined bytes are a token, by that token's rank.

Encoding cuts a text before each space. Where no two white spaces are neighbours, no pre-token of the pattern crosses
such a cut, so the pieces' ids join into those of the text, and each distinct piece of an Arrow batch is encoded once.
Texts with two white spaces in a row are encoded whole by the library.

Nulls count as empty texts; an empty text has no ids; texts of any length are encoded whole; special tokens' strings
are ordinary text. Ids are kept as little-endian unsigned 32-bit integers in one binary value per text.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import documents, give_back

#: Two white spaces in a row, or a zero character: such texts are encoded whole.
_ODD = r"[\s\v\x1c-\x1f\x{85}\x{180e}\p{Z}]{2}|\x00"
#: Pieces in one string for the library; pieces whose ids are gathered at once.
_JOINED, _GATHERED = 100, 400_000
_CODECS: dict[str, Codec] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others
    from code point 256 on, in order."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in kept else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def from_ranks(path: str):
    """A tokenizers.Tokenizer that encodes as the ranks say."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks, char = read_ranks(path), byte_characters()
    shown = {token: "".join(char[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                merges.append((shown[left], shown[right]))
    tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern()), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


class Codec:
    """Encodes and decodes texts by one vocabulary; codec(name) keeps one for each in a worker."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary_path(name)
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True
            byte = {c: b for b, c in enumerate(byte_characters())}
            self.token_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.tokenizer.get_vocab().items()}
        else:
            self.tokenizer = from_ranks(path)
            self.token_bytes = {rank: token for token, rank in read_ranks(path).items()}
        self.zero = self.tokenizer.token_to_id(byte_characters()[0])
        if self.zero is None or any(0 in t and len(t) > 1 for t in self.token_bytes.values()):
            raise ValueError(f"{name}: byte 0 must be a token that no other token contains")

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _table(self, spaced: list[str], bare: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in one array, and where each piece's end there, in a zero; the first is preceded by -1.

        Many pieces that start with a space, each followed by a zero character, make one string for the library: that
        character is a token of its own, never merged, and a pre-token at most ends with it. Other pieces go alone, as
        an apostrophe after a zero would start no contraction."""
        strings = ["\0".join(spaced[i : i + _JOINED]) + "\0" for i in range(0, len(spaced), _JOINED)]
        zero = np.array([self.zero], np.uint32)
        flat = np.concatenate([zero[:0], *self._encoded(strings), *(x for ids in self._encoded(bare) for x in (ids, zero))])
        return flat, np.concatenate([[-1], np.flatnonzero(flat == self.zero)])

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the bounds of each text's there."""
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        cut = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        first = np.asarray(cut.offsets[:-1]) - cut.offsets[0].as_py()
        values = cut.flatten()
        words = values.dictionary_encode()
        spaced = [" " + w for w in words.dictionary.to_pylist()]
        bare = values.take(pa.array(first)).to_pylist()
        flat, ends = self._table(spaced, bare)
        index = np.array(words.indices, np.int64)
        index[first] = len(spaced) + np.arange(len(first))
        begin, length = ends[index] + 1, np.diff(ends)[index] - 1
        chunk_end = np.cumsum(length)
        bounds = np.concatenate([[0], chunk_end[np.concatenate([first[1:], [len(index)]]) - 1]]) if len(first) else np.zeros(1, np.int64)
        ids = np.empty(bounds[-1], np.uint32)
        for at in range(0, len(index), _GATHERED):
            some = slice(at, at + _GATHERED)
            base = chunk_end[at] - length[at]
            shift = np.repeat(begin[some] - (chunk_end[some] - length[some] - base), length[some])
            ids[base : base + len(shift)] = flat[shift + np.arange(len(shift))]
        if odd.any():
            parts = np.split(ids, bounds[1:-1])
            for k, found in zip(np.flatnonzero(odd), self._encoded(texts.filter(pa.array(odd)).to_pylist())):
                parts[k] = found
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids.astype("<u4", copy=False), bounds

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text the ids, little-endian unsigned 32-bit."""
        ids, bounds = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def offsets(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Of each text the code points where its tokens start and end; tokens that share a character share its span."""
        found = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        return [([a for a, _ in e.offsets], [b for _, b in e.offsets]) for e in found]

    @functools.cached_property
    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes in one array, and by id where each begins and how many it has."""
        size = np.zeros(max(self.token_bytes) + 1, np.int64)
        size[list(self.token_bytes)] = [len(t) for t in self.token_bytes.values()]
        flat = b"".join(self.token_bytes.get(i, b"") for i in range(len(size)))
        return np.frombuffer(flat, np.uint8), np.cumsum(size) - size, size

    def decode_array(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all tokens, and the bounds of each token's there."""
        flat, start, size = self._flat
        count = size[ids]
        bounds = np.concatenate([[0], np.cumsum(count)])
        return flat[np.repeat(start[ids] - bounds[:-1], count) + np.arange(bounds[-1])].tobytes(), bounds

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """The bytes of the tokens, joined before anything reads them as characters."""
        tokens = self.token_bytes
        return b"".join([tokens[i] for i in (np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids).tolist()])


def codec(name: str) -> Codec:
    if name not in _CODECS:
        _CODECS[name] = Codec(name)
    return _CODECS[name]


def slices(batch: pa.RecordBatch, column: str, most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of the column, one row at least: bounds what Python holds at once. After
    the last, memory that was freed goes back to the system."""
    array = batch.column(batch.schema.get_field_index(column))
    lengths = np.asarray(pc.fill_null(pc.binary_length(array), 0)).astype("f8")
    at, ends = 0, np.cumsum(lengths)
    while at < len(batch):
        base = ends[at - 1] if at else 0.0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", *, decode: bool = False, offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids[, decoded][, starts, ends]) of every row.

    ids: binary, little-endian unsigned 32-bit; decoded: the bytes that these ids decode to; starts, ends: code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, bounds = c.encode_array(batch.column(1))
                parts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
                out = {"doc_id": batch.column(0), "n_tokens": pa.array(np.diff(bounds)), "ids": pa.array([x.tobytes() for x in parts], pa.binary())}
                if decode:
                    out["decoded"] = pa.array(map(c.decode, parts), pa.binary())
                if offsets:
                    spans = c.offsets(batch.column(1).to_pylist())
                    out["starts"] = pa.array([a for a, _ in spans], pa.list_(pa.int32()))
                    out["ends"] = pa.array([b for _, b in spans], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decode + ", starts array<int>, ends array<int>" * offsets
    return documents(docs, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary, text string) of ids as encode() gives them; text: the bytes as UTF-8, where a sequence
    of ids ends inside a character with U+FFFD. Null ids: null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            data = [None if ids is None else c.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": pa.array(data, pa.binary()), "text": pa.array([None if d is None else d.decode("utf-8", "replace") for d in data], pa.string())})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary, text string")
