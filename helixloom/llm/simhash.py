"""SimHash near-duplicates through BK-trees.

Fingerprints of all documents are made in one pass; equal ones are one item from then on, so copies cost
nothing further. Items are dealt to shards so that near items meet in a shard (see block_keys and sketch_keys);
tasks grow the BK-trees of their shards and search them for every item. The links found are reduced in the
task to one per item, so a group of n items sends n links on, not its pairs. A shard of more than SHARD_ITEMS
items is dealt out again in chunks, every two of which meet in a tree of at most twice that size. Links are
joined to components by shuffles (components.py); nothing is gathered on the driver.

The trees travel with the shards by shuffle instead of broadcast: their total size grows with the corpus, so
no bound for broadcasting them could be kept.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bktree
from .common import order_of, stored
from .components import components

SEED = 42
SHARD_ITEMS = 8192
SKETCH = 6
_AT_ONCE = 1 << 17  # shingles that are counted at once
#: Byte value to eight one-byte counters, bit i in byte i.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_ODD = np.random.default_rng(7).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of `words` lower-cased words, in order, repeats included; of all words if fewer."""
    found = text.lower().split()  # of bytes: ASCII letters, ASCII white space
    if not found:
        return np.empty(0, np.uint64)
    hashed, line = xxhash.xxh64_intdigest, b" ".join(found)
    if len(found) <= words:
        return np.array([hashed(line, SEED)], np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    return np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())), np.uint64, len(found) - words + 1)


def bit_counts(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, for consecutive groups of `size` hashes, none empty."""
    first = np.cumsum(size) - size
    parts = (size + 254) // 255  # a one-byte counter holds 255
    of = np.repeat(np.arange(len(size)), parts)
    begins = np.cumsum(parts) - parts
    at = first[of] + 255 * (np.arange(len(of)) - begins[of])
    lanes = np.add.reduceat(_LANES[h.view(np.uint8).reshape(-1, 8)], at, axis=0)
    counts = np.ascontiguousarray(lanes).view(np.uint8)
    return counts.astype(np.int64) if len(of) == len(size) else np.add.reduceat(counts, begins, axis=0, dtype=np.int64)


def group_fingerprints(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The fingerprint of each group, made in pieces of about _AT_ONCE hashes."""
    ends, out, low = np.cumsum(size), [], 0
    while low < len(size):
        start = int(ends[low] - size[low])
        high = max(low + 1, int(np.searchsorted(ends, start + _AT_ONCE, "right")))
        counts = bit_counts(h[start : ends[high - 1]], size[low:high])
        out.append(np.packbits(counts * 2 > size[low:high, None], axis=1, bitorder="little").view(np.uint64).ravel())
        low = high
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class _Counts:
    """Bit counts, and least permuted hashes, of a batch of documents."""

    def __init__(self, n: int, sketch: int):
        self.bits, self.total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
        self.least = np.full((n, sketch), np.iinfo(np.uint64).max, np.uint64)
        self.held, self.owner, self.size = [], [], 0

    def add(self, doc: int, hashes: np.ndarray) -> None:
        self.total[doc] = len(hashes)
        for i in range(0, len(hashes), _AT_ONCE):
            piece = hashes[i : i + _AT_ONCE]
            self.held.append(piece)
            self.owner.append(doc)
            self.size += len(piece)
            if self.size >= _AT_ONCE:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        h, owner = np.concatenate(self.held), np.array(self.owner)
        size = np.array([len(x) for x in self.held])
        first = np.cumsum(size) - size
        np.add.at(self.bits, owner, bit_counts(h, size))
        for k in range(self.least.shape[1]):
            mixed = h * _ODD[k]
            mixed ^= mixed >> np.uint64(29)
            np.minimum.at(self.least[:, k], owner, np.minimum.reduceat(mixed, first))
        self.held, self.owner, self.size = [], [], 0

    def fingerprints(self) -> np.ndarray:
        self.flush()
        return np.packbits(self.bits * 2 > self.total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _printed(picked: DataFrame, words: int, sketch: int) -> DataFrame:
    """The columns of picked but the last, the text; then fp and, with sketch, keys."""
    names = [*picked.columns[:-1], "fp", "keys"][: len(picked.columns) + bool(sketch)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _Counts(batch.num_rows, sketch)
            for i, text in enumerate(batch.columns[-1]):
                if text.is_valid:
                    counts.add(i, shingle_hashes(text.as_buffer().to_pybytes(), words))
            out = [*batch.columns[:-1], pa.array(counts.fingerprints().view(np.int64))]
            if sketch:
                flat = pa.array(counts.least.view(np.int64).ravel())
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, sketch, dtype=np.int32)), flat))
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = [f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]] + ["fp long"] + ["keys array<long>"] * bool(sketch)
    return picked.mapInArrow(run, ", ".join(schema))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, sketch: int = 0) -> DataFrame:
    """(doc_id, fp) and, with sketch, keys: the least of the shingles' hashes under `sketch` permutations.

    A fingerprint bit is 1 if over half the hashes have it; a text without words, or null, has fingerprint 0.
    """
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _printed(picked, words, sketch)


#: Widths of the blocks by radius; a key is two blocks.
_BLOCKS = {2: (16, 16, 16, 16), 3: (13, 13, 13, 13, 12)}


def block_keys(items: DataFrame, radius: int = 2) -> DataFrame:
    """(key, fp): a key for every two blocks. Fingerprints that differ in at most `radius` bits (3 at most) agree in
    two blocks at least, so they share a key, of 32 bits for a radius up to 2 (six keys) and 25 for 3 (ten)."""
    if radius > 3:
        raise ValueError("block keys are exact up to radius 3; sketch_keys() serves wider ones")
    widths = _BLOCKS[max(radius, 2)]
    at = [sum(widths[:i]) for i in range(len(widths))]
    block = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in zip(at, widths)]
    keys = [F.lit(n << 32) + block[i] * F.lit(1 << 16) + block[j] for n, (i, j) in enumerate(itertools.combinations(range(len(widths)), 2))]
    return items.select(F.explode(F.array(*keys)).alias("key"), "fp")


def sketch_keys(items: DataFrame) -> DataFrame:
    """(key, fp): the least hashes of fingerprints(..., sketch). Documents of Jaccard similarity J share one of
    six with probability 1 - (1 - J)**6: 0.9999 at 0.8, 0.998 at 0.65; for radii that no block scheme can prune."""
    return items.select(F.posexplode("keys"), "fp").select(F.xxhash64("pos", "col").alias("key"), "fp").distinct()


def _linker(radius: int, limit: int):
    """Rows (key, fp) sorted by key, to links (0, fp, first fp of its group); shards over the limit pass through as (1 + chunk, key, fp)."""

    def linked(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        start = np.r_[True, key[1:] != key[:-1]]
        alone = start & np.r_[start[1:], True]
        fp, start = fp[~alone], start[~alone]
        if not fp.size:
            return None
        root = np.maximum.accumulate(np.where(start, np.arange(len(fp)), 0))
        label = bktree.groups(fp.view(np.uint64), root, radius)
        moved = label != np.arange(len(fp))
        return _rows(np.zeros(int(moved.sum()), np.int64), fp[moved], fp[label[moved]]) if moved.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)  # what is not dealt with yet
        hot, passed = None, 0  # the large shard that is under way, and rows of it passed on
        for batch in batches:
            key = np.r_[key, batch.column(0).to_numpy()]
            fp = np.r_[fp, batch.column(1).to_numpy()]
            while len(key):
                first = int(np.searchsorted(key, key[0], "right"))
                open_at = int(np.searchsorted(key, key[-1], "left"))
                if key[0] != hot:
                    hot, passed = None, 0
                if hot is not None or first > limit:  # what there is of a large shard goes on
                    yield _rows(1 + np.arange(passed, passed + first) // limit, key[:first], fp[:first])
                    hot, passed = key[0], passed + first
                    key, fp = key[first:], fp[first:]
                    continue
                if open_at == 0:
                    break
                large = np.flatnonzero(np.diff(np.flatnonzero(np.r_[True, key[1 : open_at + 1] != key[:open_at]])) > limit)
                to = open_at
                if len(large):  # up to the first large shard
                    to = int(np.flatnonzero(np.r_[True, key[1 : open_at + 1] != key[:open_at]])[large[0]])
                if (out := linked(key[:to], fp[:to])) is not None:
                    yield out
                key, fp = key[to:], fp[to:]
        if len(key) and (out := linked(key, fp)) is not None:
            yield out

    return run


def _rows(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])


def links(keys: DataFrame, radius: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(a, b): links that connect exactly the items connected by pairs of one shard within the radius."""

    def run(rows: DataFrame, limit: int) -> DataFrame:
        dealt = rows.repartition("key").sortWithinPartitions("key", "fp")
        return dealt.mapInArrow(_linker(radius, limit), "kind long, a long, b long")

    found = stored(run(keys, shard_items), "links")
    large = found.where("kind > 0").select(F.col("a").alias("key"), (F.col("kind") - 1).alias("chunk"), F.col("b").alias("fp"))
    counts = large.groupBy(F.col("key").alias("of")).agg((F.max("chunk") + 1).alias("chunks"))
    meets = large.join(counts, F.col("key") == F.col("of")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).where("other <> chunk")
    meets = meets.select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), "fp")
    again = run(meets, 1 << 40)
    return found.where("kind = 0").select("a", "b").union(again.select("a", "b"))


def classes(prints: DataFrame, keys: DataFrame, radius: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(fp, root, component_id): for every fingerprint its component's least fingerprint and least doc_id."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = stored(components(links(keys, radius, shard_items)), "components")
    rooted = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first_id").alias("least_id"))
    joined = rooted.join(ids.withColumnRenamed("root", "r"), F.col("root") == F.col("r"), "left")
    return joined.select("fp", "root", F.coalesce("least_id", "first_id").alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs; fp as a signed long.

    Documents are linked when their fingerprints differ in at most `radius` bits, 3 at most (block_keys finds all
    of those). Texts without words, null ones too, have fingerprint 0 and are linked like others. A null id takes
    part with its fingerprint and is never a component's id unless all of its ids are null. Repeated rows stay
    rows. An empty table gives no rows; other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "prints")
    ids = classes(prints, block_keys(prints.select("fp").distinct(), radius), radius, shard_items)
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def radius_for(similarity: float) -> int:
    """Bits that may differ: a bit differs with probability angle / pi, and similarity is the cosine."""
    return int(64 * math.acos(similarity) / math.pi)


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, fp, component_id) as near_dedup(), for fingerprints of five-word shingles whose cosine
    similarity, as SimHash estimates it, is 0.8 or more (13 bits or fewer); shards come from sketch_keys()."""
    prints = stored(fingerprints(docs, id_col, text_col, words, SKETCH), "prints")
    ids = classes(prints, sketch_keys(prints), radius_for(similarity), shard_items)
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def without_similar(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of similar_documents(); columns as they are.

    The row of the smallest id stays, of rows of that id the one whose text has the smallest hash, and one of rows
    that repeat id and text. Rows without an id come after all others. Null texts and those without words are alike.
    An empty table stays empty; other columns may have any names.
    """
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), order_of(key, text).alias("_ord"), F.xxhash64(text).alias("_row"), text.alias("_text"))
    prints = stored(_printed(rows.select("_ord", "_row", "_text"), words, SKETCH), "prints")
    roots = stored(components(links(sketch_keys(prints), radius_for(similarity))), "components")
    first = prints.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp")).agg(F.min(F.struct("_ord", "_row")).alias("stays"))
    first = first.select(F.col("stays._ord").alias("o"), F.col("stays._row").alias("r"))
    left = rows.drop("_text").join(first, (F.col("_ord") == F.col("o")) & (F.col("_row") == F.col("r")), "left_semi").dropDuplicates(["_ord", "_row"])
    return left.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
