import glob
import hashlib

import pytest

from helixloom.llm.common import new_path
from helixloom.llm.warc import build_dictionary, read_archives, records, write_archives

ROWS = [(1, "http://a/1", "x" * 999), (2, "http://a/2", "x" * 999), (3, "u\r\nWARC-Type: evil", "y" * 1000), (4, None, "y" * 1000), (9, "http://é", "y" * 1000), (5, "u", None), (6, "u", ""), (7, "u", "é" * 60_000), (8, "u", "z\r\n\r\nWARC/1.1\r\n" * 80), (9, "http://é", "y" * 1000), (None, "n", "y" * 1000), (None, "n", "q" * 2000), (None, "n", "q" * 2000)]
ROWS += [(100 + i, f"u{i}", f"<html>{i % 40}" + "page of words " * (50 + i % 40) + "</html>") for i in range(400)]


def brute(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, u, h in rows:
        data = (h or "").encode()
        ids = [x for x in groups[h or ""] if x is not None]
        keep = max(ids) if len(data) >= 1000 and len(groups[h or ""]) > 1 and ids else None
        revisit = keep is not None and i != keep
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("size", [24 << 20, 20_000])
def test_round_trip(spark, size):
    table = spark.createDataFrame([(*r, "c", 1) for r in ROWS], "page_id long, url string, html string, sha1 string, size int")
    path = new_path(spark, "warc")
    write_archives(table, path, archive_bytes=size)
    got = read_archives(spark, path).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute(ROWS)
    assert {r.url for r in got if r.page_id == 9} == {"http://é"} and [r.url for r in got if r.page_id == 4] == [None]
    files = glob.glob(f"{path}/*.warc.zst")
    assert files and (size > 20_000 or len(files) > 3)
    for f in files:
        data = open(f, "rb").read()
        assert int.from_bytes(data[:4], "little") == 0x184D2A5D
        assert next(records(data))[0]["WARC-Type"] == "warcinfo"


def test_empty_table_and_few_records(spark):
    table = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    for n, rows in ((0, []), (1, ROWS[:1])):
        path = new_path(spark, "warc")
        write_archives(spark.createDataFrame(rows, table.schema), path)
        assert read_archives(spark, path).count() == n
    assert build_dictionary([]).as_bytes() and build_dictionary([b"a"]).as_bytes()
