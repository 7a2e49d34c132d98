"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are token sequences. A document that shares a run of min_match tokens (a seed)
with an item is compared with it: the longest common runs of unmarked tokens are found by running Karp-Rabin
(window hashes from prefix sums, extended to maximal runs), marked as tiles, and the search goes on with shorter
runs down to min_match. Tiles may lie in any order, so a reordered passage is covered like one in order. An
item leaks when tiles cover min_coverage of its tokens.

The benchmark's seeds go to the tasks with the function, in blocks of at most BLOCK_TOKENS tokens; a larger
benchmark takes more blocks, each with a pass of its own over the documents. Documents never move.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

MIN_MATCH = 4
MIN_COVERAGE = 0.7
BLOCK_TOKENS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd
_PUNCT = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_VOCABULARY = 1 << 20


class _Words(dict):
    """Hashes of words; those seen before are looked up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _VOCABULARY:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def tokens(text: str, words: dict) -> np.ndarray:
    """Hashes of the lower-cased words, ASCII punctuation left out."""
    found = text.lower().encode().translate(_LOWER, _PUNCT).split()
    return np.fromiter(map(words.__getitem__, found), np.uint64, len(found))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])


class _Rolling:
    """Karp-Rabin hashes of all windows of any length, modulo 2**64."""

    def __init__(self, seq: np.ndarray, power: np.ndarray):
        self.n, self.power = len(seq), power
        self.prefix = np.r_[np.uint64(0), np.cumsum(seq * power[: len(seq)])]

    def windows(self, size: int) -> np.ndarray:
        """Hashes of windows, brought to the same power so that equal windows have equal hashes."""
        if self.n < size:
            return np.empty(0, np.uint64)
        return (self.prefix[size:] - self.prefix[:-size]) * self.power[self.n - size :: -1][: self.n - size + 1]


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (document position, item position, length): greedy string tiling, longest first.

    Of equally long runs the first in the item, then in the document, is marked. Pairs of places are never listed,
    so memory grows with the two lengths only, however often runs repeat.
    """
    tiles = []
    if min(len(doc), len(item)) < min_match:
        return tiles
    # What no token of the item can match is left out of the document, with a token between its parts that the item lacks.
    use = np.flatnonzero(np.isin(doc, item))
    gaps = np.flatnonzero(np.diff(use) > 1) + 1
    none = next(x for x in np.arange(len(item) + 1, dtype=np.uint64) if x not in item)
    doc, origin = np.insert(doc[use], gaps, none), np.insert(use, gaps, -1)
    n, m = len(doc), len(item)
    power = _powers(max(n, m))
    # Both are scaled to the power of the longer one, or hashes could not be compared.
    top = max(n, m)
    padded = [np.r_[s, np.zeros(top - len(s), np.uint64)] for s in (doc, item)]
    rolling = [_Rolling(s, power) for s in padded]
    free = [np.ones(n, bool), np.ones(m, bool)]

    def windows(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs of `size` tokens that are free."""
        seq, ok = (doc, item)[which], free[which]
        blocked = np.r_[0, np.cumsum(~ok)]
        use = np.flatnonzero(blocked[size:] == blocked[:-size])
        return use, rolling[which].windows(size)[: len(seq) - size + 1][use]

    def matches(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places in the document and in the item, and which of the item's hashes each has. The item's are sorted, as it is the shorter."""
        at, h = windows(0, size)
        place, own = windows(1, size)
        known = np.unique(own)
        if not len(known):
            return at[:0], place[:0], at[:0], place[:0]
        of = np.minimum(np.searchsorted(known, h), len(known) - 1)
        same = known[of] == h
        return at[same], place, of[same], np.searchsorted(known, own)

    # The longest run: double the size while there are matches, then halve the interval.
    def longest(most: int) -> int:
        if most < min_match or not len(matches(min_match)[0]):
            return 0
        low, high = min_match, most + 1
        while high - low > 1:
            mid = min(low * 2, (low + high) // 2)
            low, high = (mid, high) if len(matches(mid)[0]) else (low, mid)
        return low

    most = min(n, m)
    while size := longest(most):
        at, place, of, own = matches(size)
        order = np.argsort(of, kind="stable")
        at, bounds = at[order], np.searchsorted(of[order], np.arange(len(place) + 1))
        next_of, marked = bounds.copy(), len(tiles)  # places before the next are not free any more
        for j, k in zip(place.tolist(), own.tolist()):
            if not (free[1][j] and free[1][j + size - 1]):  # what is marked is as long as the run, or longer
                continue
            while next_of[k] < bounds[k + 1] and not (free[0][at[next_of[k]]] and free[0][at[next_of[k]] + size - 1]):
                next_of[k] += 1
            if next_of[k] < bounds[k + 1] and (doc[(i := int(at[next_of[k]])) : i + size] == item[j : j + size]).all():
                free[0][i : i + size] = False
                free[1][j : j + size] = False
                tiles.append((int(origin[i]), j, size))
        most = size if len(tiles) > marked else size - 1
    return tiles


class Matcher:
    """The seeds of a block of items, and the scan of a document for them."""

    def __init__(self, items: list[tuple[int, str]], min_match: int, min_coverage: float):
        self.min_match, self.min_coverage, self.words = min_match, min_coverage, _Words()
        self.items, seeds, owner, place = [], [], [], []
        self.short: dict[tuple, list[int]] = {}
        for item_id, text in items:
            seq = tokens(text or "", self.words)
            if 0 < len(seq) < min_match:
                self.short.setdefault(tuple(seq.tolist()), []).append(item_id)
            if len(seq) >= min_match:
                h = self.seeds(seq)
                seeds.append(h)
                owner.append(np.full(len(h), len(self.items)))
                place.append(np.arange(len(h)))
                self.items.append((item_id, seq))
        none = np.empty(0, np.int64)
        h = np.concatenate(seeds or [none.astype(np.uint64)])
        order = np.argsort(h, kind="stable")
        self.h, self.owner, self.place = h[order], np.concatenate(owner or [none])[order], np.concatenate(place or [none])[order]
        self.bits = max(16, int(len(h)).bit_length() + 4)
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.h >> np.uint64(64 - self.bits)] = True

    def seeds(self, seq: np.ndarray) -> np.ndarray:
        k = self.min_match
        h = np.zeros(max(0, len(seq) - k + 1), np.uint64)
        for i in range(k):
            h = h * _BASE + seq[i : len(seq) - k + 1 + i]
        h ^= h >> np.uint64(31)
        return h * _BASE

    def leaks(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item id, coverage, tiles, longest tile) of the items that the text leaks."""
        if not text:
            return []
        out = [(item_id, 1.0, 1, len(line)) for line in self.lines(text) for item_id in self.short.get(line, [])]
        return out + self.long_leaks(text) if self.items else out

    def lines(self, text: str) -> set[tuple]:
        """The token sequences of the lines, where there are short items to look for."""
        return {tuple(tokens(line, self.words).tolist()) for line in text.splitlines()} if self.short else set()

    def long_leaks(self, text: str) -> list[tuple[int, float, int, int]]:
        seq = tokens(text, self.words)
        h = self.seeds(seq)
        h = h[self.maybe[h >> np.uint64(64 - self.bits)]]
        if not len(h):
            return []
        h = np.unique(h)
        low, high = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        if not (n := high - low).any():
            return []
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner, place = self.owner[at], self.place[at]
        out = []
        for o in np.unique(owner):
            item_id, item = self.items[o]
            within = np.zeros(len(item), bool)  # no tile can cover more than the seeds do
            for i in range(self.min_match):
                within[place[owner == o] + i] = True
            if within.sum() < self.min_coverage * len(item):
                continue
            tiles = tile(seq, item, self.min_match)
            covered = sum(t[2] for t in tiles) / len(item)
            if covered >= self.min_coverage:
                out.append((item_id, covered, len(tiles), max(t[2] for t in tiles)))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_tokens: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The items, in blocks of so many tokens; the size is measured first. Where there are several, leaks() ends its pass with one before it asks for the next."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0  # tokens have a byte and a space at least
    parts = int(size // block_tokens) + 1
    return parts, ([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).distinct().collect()] for part in range(parts))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest_tile): a row per document row and item that it leaks.

    Null and empty texts leak nothing. An item of fewer than min_match tokens leaks where it is a whole line, as
    it could not be told from chance within one. Repeated documents each get their rows, repeated items count
    once. An empty table of either kind gives no rows; other columns are not read.
    """
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, item_id long, coverage double, tiles int, longest_tile int"
    def scan(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, min_match, min_coverage)
            for batch in batches:
                ids, rows = batch.column(0), []
                for i, text in enumerate(batch.column(1)):
                    rows += [(ids[i].as_py(), *leak) for leak in matcher.leaks(text.as_py())]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "coverage", "tiles", "longest_tile"])

        return picked.mapInArrow(run, schema)

    parts, blocks = _blocks(benchmark, item_col, item_text_col, block_tokens)
    if parts == 1:
        return scan(next(blocks))
    return functools.reduce(DataFrame.union, [stored(scan(items), "leaks") for items in blocks])


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs without the rows that leak an item, by the rules of leaks(); columns and other rows, null and empty texts and repeated rows too, as they are."""
    at = docs.columns.index(text_col)

    def scan(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, min_match, min_coverage)
            for batch in batches:
                clean = [not matcher.leaks(text.as_py()) for text in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    parts, blocks = _blocks(benchmark, "item_id", "text", block_tokens)
    if parts == 1:
        return scan(docs, next(blocks))
    last = None
    for items in blocks:
        before, docs = last, stored(scan(docs, items), "clean")
        last = docs
        if before is not None:
            discard(before)
    return docs
