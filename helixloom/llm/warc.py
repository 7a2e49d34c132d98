"""WARC archives whose records are compressed one by one with a Zstandard dictionary of the archive's own.

An archive is a task's output: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then a frame per
record. Spark's text writer puts the frames into files, in any file system it knows, and its committer sees to it
that a task which is run again leaves one file; the line separator it insists on is an empty skippable frame
(eight ASCII bytes), which Zstandard readers pass over. The dictionary is trained from the first TRAIN_BYTES of
the archive's own records, which are held for that; later ones stream through.

Which of equal payloads is the response is settled first, on digests alone; pages are dealt to archives once.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of the formats: skippable frames, WARC 1.1 and its revisit profile.
_DICTIONARY_MAGIC = 0x184D2A5D
_SEPARATOR = "P*M\x18\x00\x00\x00\x00"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = b"WARC/1.1\r\n"

ARCHIVE_BYTES = 24 << 20
TRAIN_BYTES = 1 << 20
DICTIONARY_BYTES = 48 << 10
MIN_REVISIT = 1000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _head(fields: list[tuple[str, object]]) -> bytes:
    clean = ((k, str(v).replace("\r", "%0D").replace("\n", "%0A")) for k, v in fields if v is not None)
    return _VERSION + "".join(f"{k}: {v}\r\n" for k, v in clean).encode() + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response, or for refers_to a revisit without payload. The ids of pages are in fields of their own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = lambda page: f"<{uuid.uuid5(_IDS, f'{page} {digest}').urn}>"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", None if refers_to is None else name(refers_to)), ("WARC-Profile", None if refers_to is None else _PROFILE),
        ("WARC-Page-ID", page_id), ("WARC-Refers-To-Page-ID", refers_to), ("WARC-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    return _head(fields) + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained from the records; where they are too few for that, their own last bytes."""
    try:
        return zstandard.train_dictionary(size, [r for r in records if r], steps=1, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-size:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> None:
    """Writes pages (page_id, url, html) to `path` as part-*.warc.zst, a record per row.

    Of equal payloads of min_revisit bytes or more, the page with the largest id is a response and the others are
    revisits of it; rows that repeat that page are responses too, and a null id is less than any other. Payloads
    are equal when length, SHA-1 and SHA-256 are. A null html is an empty payload, a null url no URI. Rows that
    repeat page and payload lie in one archive. An empty table gives a folder without archives; other columns are
    not read.
    """
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sha = F.sha1("html")
    slim = stored(picked.select("page_id", F.octet_length("html").alias("size"), sha.alias("sha1"), F.sha2("html", 256).alias("sha2")), "warc-digests")
    groups = slim.where(F.col("size") >= min_revisit).groupBy("size", "sha1", "sha2").agg(F.count("*").alias("n"), F.max("page_id").alias("keep")).where("n > 1 and keep is not null")
    revisits = slim.join(groups, ["size", "sha1", "sha2"]).where(~F.col("page_id").eqNullSafe(F.col("keep")))
    key = F.xxhash64("page_id", "sha1").alias("k")
    revisits = revisits.select(key, F.lit(0).alias("kind"), "page_id", F.lit(None).cast("string").alias("url"), F.lit("").alias("html"), "sha1", "keep").distinct()
    archives = max(1, round((slim.agg(F.sum("size")).first()[0] or 0) / archive_bytes))
    # Pages move once: what is known of revisits travels with them, before the page itself. Copies have keys of their own.
    rows = picked.withColumn("sha1", sha).select(key, F.lit(1).alias("kind"), "page_id", "url", "html", "sha1", F.lit(None).cast("long").alias("keep"))
    rows = rows.union(revisits).repartition(archives, "k").sortWithinPartitions("k", "kind")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, compressor = [], 0, None
        at, keeps = None, {}  # of the key that is under way: (page, digest) to the page it revisits

        def begin() -> list[bytes]:
            nonlocal compressor
            made = build_dictionary(held)
            compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True)
            content = made.as_bytes()
            first = struct.pack("<II", _DICTIONARY_MAGIC, len(content)) + content
            info = b"software: helixloom\r\nformat: WARC File Format 1.1\r\n"
            info = _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(_IDS, made.as_bytes().hex()).urn}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n"
            return [first, compressor.compress(info), *map(compressor.compress, held)]

        def out(frames: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

        for batch in batches:
            frames = []
            ks, kinds, ids, urls, htmls, digests, kept = batch.columns
            for k, kind, page_id, url, html, digest, keep in zip(*(c.to_pylist() for c in (ks, kinds, ids, urls)), htmls, digests.to_pylist(), kept.to_pylist()):
                if k != at:
                    at, keeps = k, {}
                if kind == 0:
                    keeps[page_id, digest] = keep
                    continue
                payload = html.as_buffer().to_pybytes()
                made = record(page_id, url, payload, digest, keeps.get((page_id, digest)), date)
                if compressor:
                    frames.append(compressor.compress(made))
                    continue
                held.append(made)
                size += len(made)
                if size >= TRAIN_BYTES:
                    frames += begin()
                    held = []
            if frames:
                yield out(frames)
        if held:
            yield out(begin())

    frames = rows.mapInArrow(compress, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", _SEPARATOR).text(path)
    _rename(pages.sparkSession, path)


def _rename(spark: SparkSession, path: str) -> None:
    """part-*.txt become part-*.warc.zst, several at a time."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)]

    def rename(name: str) -> None:
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(path, name), jvm.org.apache.hadoop.fs.Path(path, name[:-4] + ".warc.zst")):
            raise OSError(f"{path}/{name} could not be renamed")

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(rename, [n for n in names if n.startswith("part-") and n.endswith(".txt")]))


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of an archive's records, in order; it is decompressed as it is read."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != _DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    content = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    stream = zstandard.ZstdDecompressor(dict_data=content).stream_reader(memoryview(archive)[8 + size :], read_across_frames=True)
    plain = io.BufferedReader(stream, 1 << 16)
    while line := plain.readline():
        if line != _VERSION:
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := plain.readline()) != b"\r\n":
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            fields[k] = v
        block = plain.read(int(fields["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        yield fields, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of all responses and revisits.

    A response's payload is measured and digested anew, and must agree with its fields; a revisit's are in its
    fields. A folder without archives gives no rows.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for fields, block in records(archive.as_buffer()):
                    if (kind := fields["WARC-Type"]) == "warcinfo":
                        continue
                    size, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
                    rows.append((number(fields.get("WARC-Page-ID")), fields.get("WARC-Target-URI"), size, digest, kind, number(fields.get("WARC-Refers-To-Page-ID"))))
                    if len(rows) == 10_000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content").mapInArrow(run, schema)
