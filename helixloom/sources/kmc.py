"""The sorted k-mer count tables of the KMC counter (files .kmc_pre and .kmc_suf), as a Python data source.

spark.dataSource.register(KmcSource); spark.read.format("kmc").load(prefix)  ->  kmer string, cnt long

The files are read where the path is, by every executor: a shared file system is needed. A task reads a range of
records; the prefix of a record comes from the table of first records of all prefixes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format.
_VERSION = 0x200
_MARKS = (b"KMCP", b"KMCS")
_TASK_RECORDS = 4_000_000


@dataclass
class KmcHeader:
    k: int
    mode: int
    counter_size: int
    prefix_length: int
    signature_length: int
    min_count: int
    max_count: int
    total: int
    both_strands: bool
    first_records: np.ndarray


def read_header(prefix: str) -> KmcHeader:
    """The header, found from the end of the file, and the first record of each prefix in each bin."""
    with open(prefix + ".kmc_pre", "rb") as f:
        data = f.read()
    if data[:4] != _MARKS[0] or data[-4:] != _MARKS[0]:
        raise ValueError(f"{prefix}.kmc_pre has no markers")
    size = struct.unpack_from("<I", data, len(data) - 8)[0]
    at = len(data) - size - 8
    k, mode, counter, lut, sig, low, high, total, strands = struct.unpack_from("<7IQB", data, at)
    version = struct.unpack_from("<I", data, at + 7 * 4 + 8 + 4 + 24)[0]
    if version != _VERSION:
        raise ValueError(f"version {version:#x} of the k-mer table is not read")
    table = np.frombuffer(data, "<u8", (at - 4 * (4**sig + 1) - 8 - 4) // 8, 4)
    return KmcHeader(k, mode, counter, lut, sig, low, high, total, strands == 0, table)


@dataclass
class _Range(InputPartition):
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, prefix: str, task_records: int):
        self.prefix, self.task_records = prefix, task_records

    def partitions(self) -> list[InputPartition]:
        total = read_header(self.prefix).total
        return [_Range(i, min(i + self.task_records, total)) for i in range(0, total, self.task_records)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        h = read_header(self.prefix)
        packed = (h.k - h.prefix_length) // 4
        width = packed + h.counter_size
        letters = np.frombuffer(b"ACGT", np.uint8)
        with open(self.prefix + ".kmc_suf", "rb") as f:
            for low in range(part.low, part.high, 1 << 18):
                n = min(1 << 18, part.high - low)
                f.seek(4 + low * width)
                rec = np.frombuffer(f.read(n * width), np.uint8).reshape(n, width)
                slot = np.searchsorted(h.first_records, np.arange(low, low + n), "right") - 1
                code = slot % 4**h.prefix_length
                bases = [(code >> 2 * (h.prefix_length - 1 - i)) & 3 for i in range(h.prefix_length)]
                bases += [(rec[:, i // 4] >> (6 - 2 * (i % 4))) & 3 for i in range(4 * packed)]
                text = letters[np.stack(bases, 1).astype(np.int64)]
                count = np.zeros(n, np.int64)
                for i in range(h.counter_size):
                    count |= rec[:, packed + i].astype(np.int64) << 8 * i
                kmer = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * h.k, h.k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(text)))
                yield pa.RecordBatch.from_arrays([kmer, pa.array(count)], names=["kmer", "cnt"])


class KmcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kmc"

    def schema(self) -> str:
        return "kmer string, cnt long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("taskRecords", _TASK_RECORDS)))


def read_kmc(spark: SparkSession, prefix: str):
    spark.dataSource.register(KmcSource)
    return spark.read.format("kmc").load(prefix)
