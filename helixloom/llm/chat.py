r"""Chat formatting by columnar byte assembly.

Template of a conversation, control strings being <s> </s> [INST] [/INST] [ROLE] [/ROLE]:

    <s>  then for each turn  [INST] text [/INST]   of a user
                             text</s>              of an assistant
                             [ROLE]role[/ROLE]text</s>   of any other role

Control strings inside texts and roles get a backslash after their first character, and such with n backslashes
there get n + 1, so the marks stay unique and the change can be undone. Every turn is five segments (opening,
role, middle, text, closing). Lengths, cumulative offsets and the index of every output byte in a pool of
headers and contents are numpy arrays; a batch's output is one preallocated Arrow buffer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_TURNS = 8192
PIECE_BYTES = 16 << 20
_GATHER = 1 << 20  # output bytes that are indexed at once
_TAIL = r"/?(?:s>|INST\]|ROLE\])"
_CONTROL = rf"([<\[])(\\*)({_TAIL})"
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAIL})")
#: Opening, middle and closing of a user, an assistant and any other role.
_MARKS = ((b"[INST] ", b"", b" [/INST]"), (b"", b"", b"</s>"), (b"[ROLE]", b"[/ROLE]", b"</s>"))
_BEGIN = b"<s>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(texts, ""), _CONTROL, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and lengths of a string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets[:-1], np.diff(offsets)


def assemble(first: np.ndarray, begins: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted strings, one from each turn of `first` to the next; and of all turns whether the loss counts,
    and start and end of their texts in bytes of their string. begins: whether the string opens its conversation."""
    roles = pc.fill_null(roles, "")
    kind = np.where(pc.equal(roles, "user").to_numpy(False), 0, np.where(pc.equal(roles, "assistant").to_numpy(False), 1, 2))
    named = pc.if_else(pa.array(kind == 2), roles, "")
    role_data, role_at, role_size = _bytes_of(escape(named))
    text_data, text_at, text_size = _bytes_of(escape(texts))
    marks = [m for three in _MARKS for m in three] + [_BEGIN + three[0] for three in _MARKS]
    mark_size = np.array([len(m) for m in marks])
    mark_at = np.cumsum(mark_size) - mark_size
    header = np.frombuffer(b"".join(marks), np.uint8)
    pool = np.concatenate([header, role_data, text_data])

    n = len(kind)
    opens = np.zeros(n, bool)
    opens[first] = begins
    opening = np.where(opens, 9 + kind, 3 * kind)
    source = np.stack([mark_at[opening], len(header) + role_at, mark_at[3 * kind + 1], len(header) + len(role_data) + text_at, mark_at[3 * kind + 2]], 1).ravel()
    size = np.stack([mark_size[opening], role_size, mark_size[3 * kind + 1], text_size, mark_size[3 * kind + 2]], 1).ravel()
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if n else 0

    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    shift = source - starts
    low = 0
    while low < len(size):  # so many segments that their bytes' indices stay small
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _GATHER, "right")))
        a, b = int(starts[low]), int(ends[high - 1])
        if b - a > 4 * _GATHER:  # one long text
            out[a:b] = pool[source[low] : source[low] + b - a]
        else:
            np.take(pool, np.arange(a, b) + np.repeat(shift[low:high], size[low:high]), out=out[a:b])
        low = high

    bounds = np.r_[starts[5 * first], total].astype(np.int32)
    strings = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), buffer)
    base = np.repeat(starts[5 * first], np.diff(np.r_[first, n]))
    return strings, kind == 1, starts[3::5] - base, ends[3::5] - base


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("n_turns", pa.int32()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))])


def _pieces(rows: pa.Table, piece: int) -> pa.RecordBatch:
    """Formats whole conversations, or one piece of a long one; the first string is piece number `piece`."""
    ids = rows.column("conv_id").combine_chunks()
    texts = [rows.column(c).combine_chunks() for c in ("role", "text")]
    key, null = pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(False)
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (null[1:] != null[:-1])])
    number = np.zeros(len(first), np.int32)
    number[0] = piece
    strings, loss, start, end = assemble(first, number == 0, *texts)
    turns = np.diff(np.r_[first, len(key)])
    at = np.r_[0, np.cumsum(np.add.reduceat(loss.astype(np.int64), first))].astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(at), pa.array(x[loss].astype(np.int32))) for x in (start, end)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(number), pa.array(turns.astype(np.int32)), strings, *spans], schema=_SCHEMA)


def _formatter(piece_turns: int, piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, piece, current = None, 0, None  # rows of the last conversation, its pieces so far, its id
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            ids = rows.column("conv_id").combine_chunks()
            if piece and ids[0].as_py() != current:
                piece = 0
            last = ids[-1]
            same = pc.is_null(ids) if not last.is_valid else pc.fill_null(pc.equal(ids, last), False)
            cut = int(np.flatnonzero(same.to_numpy(False))[0])
            if cut:
                yield _pieces(rows.slice(0, cut), piece)
                piece = 0
            held = rows.slice(cut)
            if held.num_rows >= piece_turns or held.nbytes >= piece_bytes:
                yield _pieces(held, piece)
                held, piece, current = None, piece + 1, last.as_py()
        if held is not None:
            yield _pieces(held, piece)

    return run


def format_conversations(turns: DataFrame, piece_turns: int = PIECE_TURNS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(conv_id, piece, n_turns, formatted, loss_starts, loss_ends) of turns (conv_id, turn, role, text).

    A conversation is one string, its turns in order of turn (null first), then role and text; a long one goes on
    in further pieces, cut between turns, so that no task holds more than a piece of it. loss_starts and loss_ends
    are the assistants' texts, in bytes of formatted. Null roles and texts are empty ones; rows of a null conv_id
    are one conversation; repeated rows are turns of their own. No rows, no conversations. Other columns are
    not read.
    """
    picked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return dealt.mapInArrow(_formatter(piece_turns, piece_bytes), "conv_id long, piece int, n_turns int, formatted string, loss_starts array<int>, loss_ends array<int>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted string, or of a piece."""
    at, out = len(_BEGIN) if formatted.startswith("<s>") else 0, []
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            end = formatted.index(" [/INST]", at)
            out.append(("user", unescape(formatted[at + 7 : end])))
            at = end + 8
            continue
        role = "assistant"
        if formatted.startswith("[ROLE]", at):
            end = formatted.index("[/ROLE]", at)
            role, at = unescape(formatted[at + 6 : end]), end + 7
        end = formatted.index("</s>", at)
        out.append((role, unescape(formatted[at:end])))
        at = end + 4
    return out


class _Digest:
    def __init__(self):
        self.turns, self.chars, self.loss_chars, self.all, self.loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, spans: list[tuple[int, int]]) -> None:
        for role, text in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        self.chars += len(formatted)
        data = formatted.encode()
        for a, b in spans:
            text = unescape(data[a:b].decode())
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from format_conversations()'s
    rows alone; a conversation's pieces are read one after another."""
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "formatted", "loss_starts", "loss_ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        current, digest, rows = None, None, []
        for batch in batches:
            for conv, text, starts, ends in zip(*batch.columns):
                if digest is None or conv.as_py() != current:
                    if digest is not None:
                        rows.append((current, *digest.row()))
                    current, digest = conv.as_py(), _Digest()
                digest.add(text.as_py(), list(zip(starts.as_py(), ends.as_py())))
            if rows:
                yield out(rows)
                rows = []
        if digest is not None:
            yield out([(current, *digest.row())])

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
