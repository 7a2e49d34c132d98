"""Text files as Spark reads them: whether a job wrote them whole, and the order of their lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line's place: its file's rank from this bit on, then twice the start of its block and its number in the task.
_FILE = 42
_SCHEME = r"^(\w[\w+.-]*):/+"  # Spark writes file:/ in one place and file:/// in another


def done(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote to the folder has ended well."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def records(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(value, _f, _b, _i): file, start of the block, and a number that grows along a block. By these three, records of
    a folder of parts are in the order of its files' names, which is the order they were written in."""
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))


def places(spark: SparkSession, path: str) -> DataFrame:
    """(value, place): lines, place a long that grows along the files. A task reads no more lines than a block has bytes."""
    files = sorted({re.sub(_SCHEME, r"\1:/", f) for f in spark.read.text(path).inputFiles()})
    lines, rank = records(spark, path), F.lit(0)
    if len(files) > 1:
        ranks = spark.createDataFrame(list(zip(files, range(len(files)))), "_file string, _rank long")
        lines = lines.join(F.broadcast(ranks), F.regexp_replace("_f", _SCHEME, "$1:/") == F.col("_file"), "left")  # a row per file
        rank = F.coalesce("_rank", F.raise_error(F.concat(F.lit("a file that was not there: "), F.col("_f"))).cast("long"))
    return lines.select("value", (rank.cast("long") * (1 << _FILE) + F.col("_b") * 2 + F.col("_i") % (1 << 33)).alias("place"))
