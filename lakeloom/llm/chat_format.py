"""Chat formatting (operator 1), as a prefix tree.

Conversations that share their first turns share those turns' tokens. Every turn gets a 128-bit hash of itself and all
turns before it, so a conversation is a path of hashes. Sorted by path, conversations come depth-first: each is formatted
from the turn on in which it leaves the one before it. What results is cut into sequences; each is one row:

    sequence_id
    ids: the token ids, little-endian unsigned 32-bit; positions: of each token its position id, likewise
    nodes: of each turn in the sequence, in order: start, end (tokens), position (of its first token in its own
           conversation), parent (index of the node before it in the conversation, -1: none), attends (the intervals of
           the sequence that hold its ancestors, merged), loss_start and loss_end (the tokens under the loss mask;
           equal: none)
    conversations: conv_id, node (the index of its last turn), part and more (see below)

A token's position id is that of its node plus its distance from the node's start; it attends to the node's intervals
and to its own node up to itself. A turn's head, text and end are encoded one by one, so their borders are borders of
tokens. A shared turn occurs once in a sequence; it occurs again only where a sequence is full (`most` characters) or a
sorted partition ends, as every sequence stands for itself. Partitions are cut by path and conv_id, so a first turn or a
whole conversation that very many share spreads over tasks.

A turn is `### role: text</turn>` and a newline. In a text, a backslash goes before each backslash, `</turn>` and `#`
that two more `#` follow; in a role also before colons. unformat() reverses that.

Rows go by turn, then role, then text; null turns come first; repeated rows are repeated turns. Null roles and texts
count as empty. Rows with null conv_id make one conversation without an id. An empty table gives no rows. A conversation
of more than `most` characters, as one of a third of all rows would be, is formatted in parts, each an example of its
own, which read_back() joins again turn by turn; no task holds more than a part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.byte_bpe import codec
from lakeloom.llm.common import give_back, materialise, partitions

#: Characters after which a sequence, or a part of a conversation, is full.
SEQUENCE_CHARS = 1 << 20
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LOSS_ROLE = "assistant"

_HEAD, _END = "### ", "</turn>"
_TEXT = re.compile(r"\\|</turn>|#(?=##)")
_ROLE = re.compile(r"\\|</turn>|#(?=##)|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.S)

_NODE = "struct<start:long,end:long,position:long,parent:int,attends:array<struct<start:long,end:long>>,loss_start:long,loss_end:long>"
SCHEMA = f"sequence_id string, ids binary, positions binary, nodes array<{_NODE}>, conversations array<struct<conv_id:long,node:int,part:int,more:boolean>>"


def escape(text: str, pattern: re.Pattern = _TEXT) -> str:
    return pattern.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """The formatted turn, as what stands before its text, the text, and what stands after."""
    return f"{_HEAD}{escape(role, _ROLE)}: ", escape(text), f"{_END}\n"


def unformat(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; ValueError if it isn't one."""
    at = 0
    while at < len(text):
        turn = _TURN.match(text, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        yield unescape(turn[1]), unescape(turn[2])
        at = turn.end()


_PATHS = "conv_id long, part int, more boolean, path array<long>, roles array<string>, texts array<string>"
_PATHS_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("more", pa.bool_()), ("path", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def _paths(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From turns, sorted by conversation, the conversations' parts; a path has two numbers a turn."""
        rows: list[tuple] = []
        held = own = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), _PATHS_ARROW.types)], schema=_PATHS_ARROW)

        last = object()
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                role, text = role or "", text or ""
                if conv != last or own >= most:
                    part = 0
                    if conv == last:
                        part = rows[-1][1] + 1
                        rows[-1] = (*rows[-1][:2], True, *rows[-1][3:])
                    else:
                        last, chain = conv, b""
                    if held >= 4 * most:
                        yield out()
                        rows, held = [], 0
                    rows.append((conv, part, False, [], [], []))
                    own = 0
                chain = xxhash.xxh3_128_digest(chain + hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())
                rows[-1][3].extend(int.from_bytes(chain[k : k + 8], "big", signed=True) for k in (0, 8))
                rows[-1][4].append(role)
                rows[-1][5].append(text)
                own += len(text) + len(role) + 64
                held += len(text) + len(role) + 64
        if rows:
            yield out()

    return run


class _Sequence:
    """The sequence being made; nodes of the current path are a stack."""

    def __init__(self):
        self.parts: list[str] = []  # three a node
        self.length = 0
        self.nodes: list[tuple[int, bool]] = []  # parent, whether the text is under the loss mask
        self.conversations: list[dict] = []
        self.stack: list[tuple[tuple[int, int], int]] = []  # (hash, index of the node)

    def add(self, conv: int | None, part: int, more: bool, path: list[int], roles: list[str], texts: list[str]) -> None:
        turns = list(zip(path[::2], path[1::2]))
        shared = 0
        while shared < min(len(turns), len(self.stack)) and self.stack[shared][0] == turns[shared]:
            shared += 1
        del self.stack[shared:]
        for k in range(shared, len(turns)):
            whole = format_turn(roles[k], texts[k])
            self.parts.extend(whole)
            self.length += sum(map(len, whole))
            self.nodes.append((self.stack[-1][1] if self.stack else -1, roles[k] == LOSS_ROLE))
            self.stack.append((turns[k], len(self.nodes) - 1))
        self.conversations.append({"conv_id": conv, "node": self.stack[-1][1], "part": part, "more": more})

    def row(self, name: str, vocabulary: str) -> dict:
        # heads and ends are alike, and encoded once
        number: dict[str, int] = {}
        of = np.array([number.setdefault(x, len(number)) for x in self.parts])
        known, bounds = codec(vocabulary).encode_array(pa.array(list(number), pa.string()))
        size = np.diff(bounds)[of]
        ends = np.cumsum(size)
        ids = known[np.repeat(bounds[of] - (ends - size), size) + np.arange(ends[-1])]
        at = [0, *ends.tolist()]
        nodes: list[dict] = []
        for k, (parent, loss) in enumerate(self.nodes):
            start, body, tail, end = at[3 * k : 3 * k + 4]
            node = {"start": start, "end": end, "position": 0, "parent": parent, "attends": [], "loss_start": body if loss else start, "loss_end": tail if loss else start}
            if parent >= 0:
                up = nodes[parent]
                node["position"] = up["position"] + up["end"] - up["start"]
                before, own = up["attends"], {"start": up["start"], "end": up["end"]}
                joined = before and before[-1]["end"] == own["start"]
                node["attends"] = [*before[:-1], {"start": before[-1]["start"], "end": own["end"]}] if joined else [*before, own]
            nodes.append(node)
        first = np.array([x["position"] - x["start"] for x in nodes], np.int64)
        positions = np.arange(len(ids)) + np.repeat(first, [x["end"] - x["start"] for x in nodes])
        return {"sequence_id": name, "ids": ids.tobytes(), "positions": positions.astype("<u4").tobytes(), "nodes": nodes, "conversations": self.conversations}


_ARROW = pa.schema(
    [
        ("sequence_id", pa.string()),
        ("ids", pa.binary()),
        ("positions", pa.binary()),
        ("nodes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("loss_start", pa.int64()), ("loss_end", pa.int64())]))),
        ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32()), ("part", pa.int32()), ("more", pa.bool_())]))),
    ]
)


def format_conversations(conversations: DataFrame, *, most: int = SEQUENCE_CHARS, vocabulary: str = VOCABULARY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The sequences, one a row, as the module's docstring says."""
    n = partitions(conversations.sparkSession)
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    paths = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_paths(most), _PATHS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, now = TaskContext.get().partitionId(), 0, _Sequence()
        for batch in batches:
            for at in range(0, len(batch), 64):
                for row in zip(*(batch.column(k).slice(at, 64).to_pylist() for k in range(6))):
                    now.add(*row)
                    if now.length >= most or len(now.conversations) >= most:
                        yield pa.RecordBatch.from_pylist([now.row(f"{task}-{made}", vocabulary)], _ARROW)
                        now, made = _Sequence(), made + 1
            del batch
            give_back()
        if now.conversations:
            yield pa.RecordBatch.from_pylist([now.row(f"{task}-{made}", vocabulary)], _ARROW)

    return paths.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(emit, SCHEMA)


_READ = "conv_id long, part int, whole boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, said string, loss string"
_READ_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("said", pa.string()), ("loss", pa.string())])


def read_back(sequences: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Of each conversation in the sequences: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    all taken from the decoded tokens by following the nodes from the last turn back. Conversations in parts, the only
    ones whose texts travel, are joined part by part in one stream each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for i in range(len(batch)):  # a sequence's nodes as dicts at a time, of those in the batch
                row = {name: batch.column(name)[i].as_py() for name in ("ids", "nodes", "conversations")}
                data, bounds = c.decode_array(np.frombuffer(row["ids"], "<u4"))
                at_byte, nodes, rows = bounds.tolist(), row["nodes"], []
                texts: dict[int, tuple[str, str]] = {}  # a node that conversations share is decoded once
                done: dict[int, tuple] = {}  # the same last turn is read once
                for conv in row["conversations"]:
                    whole = conv["part"] == 0 and not conv["more"]
                    if conv["node"] not in done:
                        way, at = [], conv["node"]
                        while at >= 0:
                            way.append(at)
                            at = nodes[at]["parent"]
                        way.reverse()
                        for k in way:
                            if k not in texts:
                                texts[k] = tuple(data[at_byte[nodes[k][a]] : at_byte[nodes[k][b]]].decode() for a, b in (("start", "end"), ("loss_start", "loss_end")))
                        formatted = "".join(texts[k][0] for k in way)
                        turns = list(unformat(formatted))
                        loss = "".join(unescape(texts[k][1]) for k in way)
                        done[conv["node"]] = (len(turns), "".join(f"{role}\n{body}\n" for role, body in turns), len(loss), loss, len(formatted))
                    n, said, loss_chars, loss, size = done[conv["node"]]
                    digests = (hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest()) if whole else (None, None)
                    rows.append((conv["conv_id"], conv["part"], whole, n, digests[0], loss_chars, digests[1], size, None if whole else said, None if whole else loss))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), _READ_ARROW.types)], schema=_READ_ARROW)
            del batch
            give_back()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From parts, sorted by conversation and part."""
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now = None  # conv_id, turns, hash of what is said, characters and hash of the loss, formatted characters

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])], names)

        for batch in batches:
            for conv, n, loss_chars, size, said, loss in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if now is None or now[0] != conv:
                    if now is not None:
                        yield out()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += n
                now[2].update(said.encode())
                now[3] += loss_chars
                now[4].update(loss.encode())
                now[5] += size
        if now is not None:
            yield out()

    read = materialise(sequences.select("ids", "nodes", "conversations").mapInArrow(run, _READ), "read-back")
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    parts = read.filter("not whole").repartition(partitions(sequences.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    joined = parts.select("conv_id", "n_turns", "loss_chars", "formatted_chars", "said", "loss").mapInArrow(join, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return read.filter("whole").select(*names).unionAll(joined)
