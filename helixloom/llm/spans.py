"""Substring deduplication by sliding sentence spans.

A span is a run of several consecutive sentences: from each sentence on, and up to each sentence, the shortest
run of at least min_sentences and min_words words. So a repeated passage of min_words words in two sentences or
more is covered to its ends by spans that lie in it. Spans are hashed (96 bits), their hashes meet globally, and
of each span the occurrence in the document of the smallest id stays; sentences covered by another one go.

Sentences end at a line's end or after . ! ? and white space; those of over long_words words are cut at commas,
colons and semicolons too. What is still longer is cut where the content says so: after a word whose hash is
the least among those of long_words // 4 words on either side, so that cuts in a repeated passage are the same
wherever it begins; and pieces that are still longer (words that repeat) after every
long_words words. Hashes ignore case and white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, discard, order_of, stored

MIN_SENTENCES = 2
MIN_WORDS = 24
LONG_WORDS = 16
_SENTENCE = re.compile(r"[.!?]+\s+|\n\s*")
_CLAUSE = re.compile(r"[,;:]+\s+")
_WORD = re.compile(r"\S+\s*")


def _cuts(pattern: re.Pattern, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Parts of text[start:end], each up to the end of a match."""
    for m in pattern.finditer(text, start, end):
        yield start, m.end()
        start = m.end()
    if start < end:
        yield start, end


def _set_by_content(words: list[str], long_words: int) -> list[int]:
    """How many words there are up to each cut of a long clause, the last one left out."""
    n, reach = len(words), max(1, long_words // 4)
    h = list(map(xxhash.xxh3_64_intdigest, words))
    cuts, at, i = [], 0, 0
    while i < n:
        after = min(h[i + 1 : i + 1 + reach], default=h[i])
        if after < h[i]:
            i = h.index(after, i + 1)
            continue
        if i < n - 1 and (i == 0 or h[i] < min(h[max(0, i - reach) : i])):
            while i + 1 - at > long_words:
                at += long_words
                cuts.append(at)
            at = i + 1
            cuts.append(at)
        i += 1
    cuts += range(at + long_words, n, long_words)
    return cuts


def sentences(text: str, long_words: int = LONG_WORDS) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of each sentence with words; together they hold all words of the text."""
    out = []
    for a, b in _cuts(_SENTENCE, text, 0, len(text)):
        words = text[a:b].lower().split()
        if len(words) <= long_words:
            if words:
                out.append((a, b, words))
            continue
        for c, d in _cuts(_CLAUSE, text, a, b):
            words = text[c:d].lower().split()
            if len(words) <= long_words:
                if words:
                    out.append((c, d, words))
                continue
            ends = [m.end() for m in _WORD.finditer(text, c, d)]
            ends = [ends[k - 1] for k in _set_by_content(words, long_words)]
            for at, to in zip([c, *ends], [*ends, d]):
                if part := text[at:to].lower().split():
                    out.append((at, to, part))
    return out


def runs(counts: list[int], min_sentences: int, min_words: int) -> list[tuple[int, int]]:
    """(first, end) of the spans: the shortest from each sentence on and up to each sentence."""
    n, total = len(counts), np.r_[0, np.cumsum(counts)]
    first = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + min_words, "left"), first + min_sentences)
    start = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, first + 1 - min_sentences)
    found = set(zip(first[end <= n].tolist(), end[end <= n].tolist()))
    found |= set(zip(start[start >= 0].tolist(), (first[start >= 0] + 1).tolist()))
    return sorted(found)


def _hashed(text: str, min_sentences: int, min_words: int, long_words: int) -> tuple[dict[bytes, tuple[int, int]], list[tuple[int, int]]]:
    """Digest to place of each span of the text; and places of those that repeat one before, without overlap."""
    cut = sentences(text, long_words)
    each = [xxhash.xxh3_128_digest(" ".join(w)) for _, _, w in cut]
    first, again = {}, []
    for a, b in runs([len(w) for _, _, w in cut], min_sentences, min_words):
        h = xxhash.xxh3_128_digest(b"".join(each[a:b]))
        if first.setdefault(h, (a, b))[1] <= a:
            again.append((a, b))
    return first, again


def remove(text: str, covered: np.ndarray, cut: list) -> str:
    """The text without the covered sentences; what lies between the others stays as it is."""
    parts, at = [], 0
    for gone, (a, b, _) in zip(covered, cut):
        if gone:
            parts.append(text[at:a])
            at = b
    return "".join([*parts, text[at:]])


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, text, sentences_removed, words_removed, first_ids): one row per row of docs.

    text is what is left; first_ids are the documents that keep a span removed here. In one document a later
    repetition goes too. Rows of one id count as one document: none is taken for a repetition of another. Rows
    without an id come after all others, in the order of their texts' hashes, equal ones as one document. Null texts stay null, empty ones empty. An empty table gives no rows; other columns
    are not read.
    """
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # A row's address is its place in the order of ids, and a tag that tells rows of one id but different texts apart.
    picked = picked.withColumns({"ord": order_of(F.col("doc_id"), F.col("text")), "tag": F.hash("text")})
    options = (min_sentences, min_words, long_words)
    kind = np.dtype([("h1", "<i8"), ("h2", "<i4"), ("rest", "<i4")])

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, digests, places = [], [], []  # a repetition within its text has no digest

            def out() -> pa.RecordBatch:
                index, null = pa.array(owner, pa.int64()), np.array([d is None for d in digests])
                h = np.frombuffer(b"".join(d or bytes(16) for d in digests), kind)
                at = np.array(places, np.int32)
                return pa.RecordBatch.from_arrays([pa.array(h["h1"].copy(), mask=null), pa.array(h["h2"].copy(), mask=null), batch.column(0).take(index), batch.column(1).take(index), pa.array(at[:, 0].copy()), pa.array((at[:, 1] - at[:, 0]).astype(np.int16))], names=["h1", "h2", "ord", "tag", "a", "n"])

            for i, text in enumerate(batch.column(2)):
                if text.is_valid:
                    found, again = _hashed(text.as_py(), *options)
                    owner += [i] * (len(found) + len(again))
                    digests += [*found, *[None] * len(again)]
                    places += [*found.values(), *again]
                if len(owner) >= 200_000:
                    yield out()
                    owner, digests, places = [], [], []
            if owner:
                yield out()

    spans = stored(picked.select("ord", "tag", "text").mapInArrow(hash_all, "h1 long, h2 int, ord long, tag int, a int, n short"), "spans")
    # Rows per hash are combined before they are sent; a span found everywhere is a row per task here and on the side that AQE splits below.
    known = spans.where("h1 is not null")
    first = known.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.count("*").alias("rows")).where("rows > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    later = known.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where("ord > first").select("ord", "tag", "a", "n", "first")
    again = spans.where("h1 is null").select("ord", "tag", "a", "n", F.lit(None).cast("long").alias("first"))
    gone = later.union(again).groupBy(F.col("ord").alias("o"), F.col("tag").alias("t")).agg(F.collect_set(F.struct("a", "n")).alias("at"), F.array_sort(F.collect_set(F.when(F.col("first") < NO_ID, F.col("first")))).alias("first_ids"))
    gone = stored(gone, "spans-gone")
    discard(spans)
    joined = picked.join(gone, (F.col("ord") == F.col("o")) & (F.col("tag") == F.col("t")), "left").select("doc_id", "text", "at", "first_ids")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_sentences, n_words = [], [], []
            for text, at in zip(batch.column(1), batch.column(2)):
                if not at.is_valid:
                    texts.append(text.as_py())
                    n_sentences.append(0)
                    n_words.append(0)
                    continue
                text = text.as_py()
                cut = sentences(text, long_words)
                covered = np.zeros(len(cut), bool)
                for span in at.as_py():
                    covered[span["a"] : span["a"] + span["n"]] = True
                texts.append(remove(text, covered, cut))
                n_sentences.append(int(covered.sum()))
                n_words.append(sum(len(c[2]) for c, is_gone in zip(cut, covered) if is_gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_sentences, pa.int32()), pa.array(n_words, pa.int32()), batch.column(3)], names=["doc_id", "text", "sentences_removed", "words_removed", "first_ids"])

    return joined.mapInArrow(cut_out, "doc_id long, text string, sentences_removed int, words_removed int, first_ids array<long>")
