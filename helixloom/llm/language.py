"""Language identification by compression.

For each language, pieces of labelled documents make a raw-content Zstandard dictionary. A text's words (runs of
letters, lower-cased) are cut into pieces of PIECE bytes, each piece is compressed with every dictionary, and
the language of the least sum of sizes is chosen. Texts are rejected when the runner-up is nearly as good.

Fitting reads a bounded sample: at most sample_docs documents for each language, piece_bytes of each, chosen by
a hash of their ids; dictionaries hold dictionary_bytes each. All are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 400
PIECE_BYTES = 600
DICTIONARY_BYTES = 112 * 1024
PIECE = 2048
LEVEL = 6
MIN_MARGIN = 0.01
MAX_LANGUAGES = 512
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}+")


def letters(text: str) -> bytes:
    return " ".join(_WORD.findall(text.lower())).encode()


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, piece_bytes: int = PIECE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionary contents by language, from rows whose language and text are not null.

    The sample takes the documents with the least hashes. The languages' counts are taken first, so that only
    about as many rows as needed come to the driver: twice sample_docs for each language at most, as pieces.
    """
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is {lang_col} a language?")
    if not counts:
        return {}
    spread = 1 << 40
    bound = F.lit(0)
    for lang, n in counts.items():  # about 1.3 times as many as needed
        bound = F.when(F.col("lang") == lang, F.lit(spread if n <= sample_docs else int(spread * 1.3 * sample_docs / n))).otherwise(bound)
    hashed = rows.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(spread))).where(F.col("h") <= bound)
    # A piece from somewhere in the text, not its beginning.
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - piece_bytes, F.lit(0)) + 1).cast("int") + 1
    pieces = hashed.select("lang", "h", F.substring("text", start, F.lit(piece_bytes)).alias("piece"))
    best: dict[str, list] = {lang: [] for lang in counts}
    for r in pieces.toLocalIterator():
        best[r.lang].append((r.h, r.piece))
        if len(best[r.lang]) > 2 * sample_docs:
            best[r.lang] = sorted(best[r.lang])[:sample_docs]
    return {lang: b" ".join(letters(p) for _, p in sorted(found)[:sample_docs])[:dictionary_bytes] for lang, found in best.items() if found}


class Classifier:
    def __init__(self, contents: dict[str, bytes], min_margin: float = MIN_MARGIN):
        self.languages, self.min_margin = sorted(contents), min_margin
        self.compressors = []
        for lang in self.languages:
            raw = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=raw, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

    def sizes(self, data: bytes) -> np.ndarray:
        """Compressed bytes by language, without the frames' own."""
        out = np.zeros(len(self.languages), np.int64)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        for k, c in enumerate(self.compressors):
            compress = c.compress
            out[k] = sum(len(compress(p)) for p in pieces)
        return out - 6 * len(pieces)

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected). Without a letter, or a language learned: und, 0, rejected.

        The score is five times the margin, the runner-up's excess as a share of its size, and 1 at most.
        """
        data = letters(text) if text and self.languages else b""
        if not data:
            return UNKNOWN, 0.0, True
        size = self.sizes(data)
        order = np.argsort(size, kind="stable")
        first = int(order[0])
        if len(order) == 1:
            return self.languages[first], 1.0, False
        margin = float(size[order[1]] - size[first]) / max(1.0, float(size[order[1]]))
        return self.languages[first], min(1.0, max(0.0, 5 * margin)), margin < self.min_margin


def predict(docs: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected): one row per row of docs; null and letterless texts are und and rejected."""
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Classifier(contents, min_margin)
        for batch in batches:
            rows = [found.classify(t.as_py()) for t in batch.column(1)]
            lang, score, rejected = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def with_known_language(docs: DataFrame, contents: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs without the rows whose language is rejected; columns and other rows as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Classifier(contents, min_margin)
        for batch in batches:
            yield batch.filter(pa.array([not found.classify(t.as_py())[2] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_part(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")))
