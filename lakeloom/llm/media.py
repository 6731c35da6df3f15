"""Media columns (operator 4), by signature sniffing.

sniff() runs one Aho-Corasick automaton over a value, which gives every place where a format's magic bytes stand. A
validator for that format then walks the structure from there (chunk lengths, checksums, block chains, end marks) and
says where the object ends, or that it isn't one. The object at the first byte decides the value's type, whatever type
was declared; objects further in are embedded media, whose spans can be carved.

Texts become media by store(): UTF-8, zero bytes up to a positive multiple of 64, as 8-bit samples of a mono WAV file.

Null texts count as empty (64 zero bytes); empty values have type application/octet-stream; null media give null
results. Memory is bounded by one value, and so is work: what validators walk over is kept for a value's other hits, so
repeated signatures take linear time. Nothing is shuffled. Equal values give equal results, repeated rows are returned each.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.byte_bpe import slices
from lakeloom.llm.common import documents

UNKNOWN = "application/octet-stream"
PAD = 64
#: Bytes of a gzip header up to its checksum at most, where it has one.
GZIP_HEADER = 8192

# Fixed values of the formats: magic bytes, and how far into the object they stand.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"BM": ("image/bmp", 0),
    b"RIFF": ("riff", 0),
    b"OggS": ("audio/ogg", 0),
    b"ftyp": ("video/mp4", 4),
    b"\x1f\x8b\x08": ("application/gzip", 0),
    b"PK\x03\x04": ("application/zip", 0),
    b"%PDF-": ("application/pdf", 0),
}
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
MP4_BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"styp", b"udta", b"uuid", b"meta", b"pdin", b"ssix", b"prft"}
BMP_HEADERS = {12, 40, 52, 56, 64, 108, 124}

Found = tuple[str, int, int]


class _Value:
    """The bytes of one value, and what its validators share: where marks stand, and what walks over it have found. Each
    place of a walk is visited once however many hits lead to it, so repeated signatures take linear time."""

    def __init__(self, data: bytes):
        self.data = data
        self.walks: dict[tuple, object] = {}

    def _positions(self, mark: bytes) -> np.ndarray:
        return np.array([m.start() for m in re.finditer(re.escape(mark), self.data)], np.int64)

    @functools.cached_property
    def zeros(self) -> np.ndarray:
        return np.flatnonzero(np.frombuffer(self.data, np.uint8) == 0)

    @functools.cached_property
    def chunks(self) -> _Chunks:
        return _Chunks(self.data)

    @functools.cached_property
    def ends_of_zip(self) -> np.ndarray:
        return self._positions(b"PK\x05\x06")

    @functools.cached_property
    def marks(self) -> np.ndarray:
        """Where a JPEG mark stands that is no stuffed byte and no restart."""
        x = np.frombuffer(self.data, np.uint8)
        after = x[1:]
        return np.flatnonzero((x[:-1] == 0xFF) & (after != 0) & ~((after >= 0xD0) & (after <= 0xD7)))

    def walk(self, kind: str, state, step):
        """Follows step() from state to the result that it ends in, and keeps that for all states on the way. step(state)
        gives (True, next state) or (False, result)."""
        way = []
        while (kind, state) not in self.walks:
            way.append(state)
            more, state = step(state)
            if not more:
                result = state
                break
        else:
            result = self.walks[kind, state]
        for at in way:
            self.walks[kind, at] = result
        return result


class _Chunks:
    """The chains of RIFF chunks of a value. Each place's chain is followed once; a place keeps the next one, one further on
    whose distance grows with the chain's length, and how many of each name follow, so that where a chain passes an end
    is found in logarithmic time from any start, whatever ends the objects have."""

    NAMES = (b"fmt ", b"data")

    def __init__(self, data: bytes):
        self.data = data
        self.places: dict[int, tuple[int, int, int, int, int]] = {}  # next, further, depth, and the names from here on

    def _known(self, to: int) -> None:
        way, data = [], self.data
        while to not in self.places and to + 8 <= len(data):
            name, length = struct.unpack_from("<4sI", data, to)
            way.append((to, name))
            to += 8 + length + (length & 1)
        self.places.setdefault(to, (to, to, 0, 0, 0))
        for at, name in reversed(way):
            _, further, depth, *counts = self.places[to]
            _, beyond, middle, *_ = self.places[further]
            same = depth - middle == middle - self.places[beyond][2]
            self.places[at] = (to, beyond if same else to, depth + 1, *(n + (name == x) for n, x in zip(counts, self.NAMES)))
            to = at

    def passed(self, start: int, end: int) -> tuple[int, bool]:
        """The first place of the chain from start on that has no room for a chunk before end, and whether both names were
        seen on the way."""
        self._known(start)
        to = start
        while to + 8 <= end:
            near, further, *_ = self.places[to]
            to = further if further + 8 <= end else near
        first, last = self.places[start], self.places[to]
        return to, first[3] > last[3] and first[4] > last[4]


def _after(places: np.ndarray, at: int) -> int:
    """The first of the sorted places from `at` on, or -1."""
    k = int(places.searchsorted(at))
    return int(places[k]) if k < len(places) else -1


def _png(v: _Value, at: int) -> Found | None:
    data = v.data

    def step(to: int):
        """From chunk to chunk; the result is the object's end, or None."""
        if to + 12 > len(data):
            return False, None
        size, kind = struct.unpack_from(">I4s", data, to)
        end = to + 12 + size
        if end > len(data) or not kind.isalpha() or kind == b"IEND" and size:
            return False, None
        if zlib.crc32(memoryview(data)[to + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return False, None
        return (False, end) if kind == b"IEND" else (True, end)

    if not data.startswith(b"\0\0\0\rIHDR", at + 8):
        return None
    end = v.walk("png", at + 8, step)
    return ("image/png", at, end) if end else None


def _jpeg(v: _Value, at: int) -> Found | None:
    data = v.data

    def step(state: tuple[int, bool]):
        """From segment to segment, with whether there was a frame; the result is the object's end, or None."""
        to, frame = state
        if to + 4 > len(data) or data[to] != 0xFF:
            return False, None
        mark = data[to + 1]
        if mark == 0xFF:
            return True, (to + 1, frame)
        if mark in (0x00, 0x01) or 0xD0 <= mark <= 0xD9:
            return False, None
        size = struct.unpack_from(">H", data, to + 2)[0]
        to += 2 + size
        if size < 2 or to > len(data):
            return False, None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        if mark != 0xDA:
            return True, (to, frame)
        # entropy-coded data, up to the next mark
        to = _after(v.marks, to) if frame else -1
        if to < 0:
            return False, None
        return (False, to + 2) if data[to + 1] == 0xD9 else (True, (to, frame))

    end = v.walk("jpeg", (at + 2, False), step)
    return ("image/jpeg", at, end) if end else None


def _gif(v: _Value, at: int) -> Found | None:
    data = v.data
    if at + 13 > len(data):
        return None

    def colours(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def block(to: int):
        """From data block to data block; the result is what follows the last."""
        return (True, to + 1 + data[to]) if to < len(data) and data[to] else (False, to + 1)

    def step(state: tuple[int, bool]):
        """From part to part, with whether there was an image; the result is the object's end, or None."""
        to, images = state
        if to >= len(data):
            return False, None
        if data[to] == 0x3B:
            return False, to + 1 if images else None
        if data[to] == 0x21:
            return True, (v.walk("gif blocks", to + 2, block), images)
        if data[to] == 0x2C and to + 10 < len(data):
            return True, (v.walk("gif blocks", to + 10 + colours(data[to + 9]) + 1, block), True)
        return False, None

    end = v.walk("gif", (at + 13 + colours(data[at + 10]), False), step)
    return ("image/gif", at, end) if end else None


def _bmp(v: _Value, at: int) -> Found | None:
    data = v.data
    if at + 26 > len(data):
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", data, at + 2)
    ok = reserved == 0 and header in BMP_HEADERS and 14 + header <= start <= size and at + size <= len(data)
    return ("image/bmp", at, at + size) if ok else None


def _riff(v: _Value, at: int) -> Found | None:
    data = v.data
    if at + 20 > len(data):
        return None
    size, kind = struct.unpack_from("<I4s", data, at + 4)
    end = at + 8 + size
    if kind not in RIFF_TYPES or end > len(data) or at + 20 > end:
        return None

    to, both = v.chunks.passed(at + 12, end)
    return (RIFF_TYPES[kind], at, end) if end <= to <= end + 1 and (kind != b"WAVE" or both) else None


def _ogg(v: _Value, at: int) -> Found | None:
    data = v.data

    def step(to: int):
        """From page to page; the result is the end of the stream, or None."""
        if not data.startswith(b"OggS", to) or to + 27 > len(data):
            return False, None
        body = to + 27 + data[to + 26]
        if data[to + 4] or body > len(data):
            return False, None
        end = body + sum(data[to + 27 : body])
        if end > len(data):
            return False, None
        return (False, end) if data[to + 5] & 4 else (True, end)

    if at + 27 > len(data) or not data[at + 5] & 2:
        return None
    end = v.walk("ogg", at, step)
    return ("audio/ogg", at, end) if end else None


def _mp4(v: _Value, at: int) -> Found | None:
    data = v.data

    def step(state: tuple[int, bool]):
        """From box to box, with whether one held media; the result is the object's end, or None."""
        to, media = state
        kind = data[to + 4 : to + 8]
        if to + 8 > len(data) or kind not in MP4_BOXES:
            return False, to if media else None
        size = struct.unpack_from(">I", data, to)[0]
        if size == 1 and to + 16 <= len(data):
            size = struct.unpack_from(">Q", data, to + 8)[0]
        if size < 8 or to + size > len(data):
            return False, None
        return True, (to + size, media or kind in (b"moov", b"moof", b"mdat", b"meta"))

    end = v.walk("mp4", (at, False), step)
    return ("video/mp4", at, end) if end else None


def _gzip(v: _Value, at: int) -> Found | None:
    """The header is read here, so that what many hits have in common, where a name or the data begins, is done once. A
    header with a checksum of its own that is longer than GZIP_HEADER, as no name of a file makes it, isn't one."""
    data = v.data
    if at + 18 > len(data) or data[at + 3] & 0xE0:
        return None
    flags, to = data[at + 3], at + 10
    if flags & 4:
        to += 2 + struct.unpack_from("<H", data, to)[0]
    for flag in (8, 16):
        if flags & flag:
            to = _after(v.zeros, to) + 1
            if to == 0:
                return None
    if flags & 2:
        if to + 2 > len(data) or to - at > GZIP_HEADER or struct.unpack_from("<H", data, to)[0] != zlib.crc32(memoryview(data)[at:to]) & 0xFFFF:
            return None
        to += 2

    def inflate(to: int):
        """The result is the end of the compressed data with its checksum and length, or None."""
        unzip, rest, check, size = zlib.decompressobj(-15), memoryview(data)[to:], 0, 0
        try:
            while not unzip.eof:
                # in stretches, as what is left over is copied
                piece = unzip.decompress(unzip.unconsumed_tail or rest[:65536], 1 << 20)
                if not unzip.unconsumed_tail:
                    rest = rest[65536:]
                check, size = zlib.crc32(piece, check), size + len(piece)
                if not unzip.eof and not unzip.unconsumed_tail and not len(rest):
                    return False, None
        except zlib.error:
            return False, None
        end = len(data) - len(rest) - len(unzip.unused_data)
        ok = end + 8 <= len(data) and struct.unpack_from("<II", data, end) == (check, size & 0xFFFFFFFF)
        return False, end + 8 if ok else None

    if to >= len(data):
        return None
    end = v.walk("gzip", to, inflate)
    return ("application/gzip", at, end) if end else None


def _zip(v: _Value, at: int) -> Found | None:
    data, to = v.data, _after(v.ends_of_zip, at)
    if to < 0 or to + 22 > len(data):
        return None
    size, start, comment = struct.unpack_from("<IIH", data, to + 12)
    end = to + 22 + comment
    ok = at + start + size == to and data.startswith(b"PK\x01\x02", at + start) and end <= len(data)
    return ("application/zip", at, end) if ok else None


_VERSION = re.compile(rb"\d\.\d")


def _pdf(v: _Value, at: int) -> Found | None:
    """Up to the last end mark before the next document's head, so each stretch is read once."""
    data = v.data
    following = data.find(b"%PDF-", at + 5)
    end = data.rfind(b"%%EOF", at, following if following > 0 else len(data))
    ok = _VERSION.match(data, at + 5) and end > 0 and data.find(b"obj", at, end) > 0
    return ("application/pdf", at, end + 5) if ok else None


VALIDATORS = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "audio/ogg": _ogg, "video/mp4": _mp4, "application/gzip": _gzip, "application/zip": _zip, "application/pdf": _pdf}


@functools.cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, (kind, before) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, before + len(magic) - 1))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[Found]:
    """(type, start, end) of every validated object in data, by start."""
    value = _Value(data)
    hits = _automaton().iter(data.decode("latin-1"))
    found = (VALIDATORS[kind](value, last - back) for last, (kind, back) in hits if last >= back)
    return sorted({x for x in found if x}, key=lambda x: (x[1], -x[2], x[0]))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as 8-bit mono samples; its length is even."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def wav_samples(data: bytes, start: int, end: int) -> bytes:
    """The data chunk of the WAV object in that span."""
    to = start + 12
    while to + 8 <= end:
        name, length = struct.unpack_from("<4sI", data, to)
        if name == b"data":
            return data[to + 8 : to + 8 + length]
        to += 8 + length + (length & 1)
    raise ValueError("a WAV object without a data chunk")


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % PAD or PAD * (not data))


def describe(samples: bytes, kind: str, embedded: int) -> str:
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts[counts > 0] / max(1, len(samples))
    return f"{kind};samples={len(samples)};mean={np.dot(counts, np.arange(256)) / max(1, len(samples)):.3f};entropy={abs(-(share * np.log2(share)).sum()):.4f};distinct={np.count_nonzero(counts)};embedded={embedded}"


_EMBEDDED = "array<struct<type:string,start:long,end:long>>"


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary, declared) of every text. What is declared is the unspecific type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([to_wav(padded(t)) for t in texts], pa.binary()), pa.array([UNKNOWN] * len(texts))], ["doc_id", "n_bytes", "media", "declared"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary, declared string")


def sniff_column(df: DataFrame, *, media_col: str = "media", declared_col: str = "declared", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in keep, media, declared, and what sniffing finds: type (corrected), was_right, end of the first
    object, embedded spans, samples (WAV objects: the bytes read back from the stored form) and feature."""
    kept = df.select(*keep, F.col(media_col).alias("media"), F.col(declared_col).alias("declared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media"):
                rows = []
                for data, declared in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()):
                    if data is None:
                        rows.append((None,) * 6)
                        continue
                    found = sniff(data)
                    head = found.pop(0) if found and found[0][1] == 0 else (UNKNOWN, 0, len(data))
                    samples = wav_samples(data, 0, head[2]) if head[0] == "audio/wav" else None
                    spans = [{"type": k, "start": a, "end": b} for k, a, b in found]
                    rows.append((head[0], head[0] == declared, head[2], spans, samples, describe(data if samples is None else samples, head[0], len(spans))))
                types = (pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(zip(*rows), types))], [*batch.schema.names, "type", "was_right", "end", "embedded", "samples", "feature"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", type string, was_right boolean, end long, embedded {_EMBEDDED}, samples binary, feature string"
    return kept.mapInArrow(run, schema)


def carve(df: DataFrame, *, media_col: str = "media", embedded_col: str = "embedded", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each embedded object: the columns in keep, type, start, end and its bytes."""
    rows = df.select(*keep, F.col(media_col).alias("media"), F.explode(embedded_col).alias("e"))
    return rows.select(*keep, "e.type", "e.start", "e.end", F.expr("substring(media, int(e.start) + 1, int(e.end - e.start))").alias("bytes"))
