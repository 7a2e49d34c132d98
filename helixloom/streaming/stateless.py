"""Operators that need one row at a time run on streams as they are: new scores, alleles, and splitting by chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.metrics import DEFAULT_WEIGHTS
from ..operators.genotypes import call_alleles
from ..operators.rewindow import rescore


def window_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The long table as a stream of Parquet files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def rescored(stream: DataFrame, weights: tuple[float, float, float] = DEFAULT_WEIGHTS) -> DataFrame:
    return rescore(stream, weights)


def called(stream: DataFrame, a: float = 95, b: float = 60, n: float = 30) -> DataFrame:
    return call_alleles(stream, a, b, n)


def split_stream(stream: DataFrame, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes the stream as Parquet, a folder for each chromosome."""
    writer = stream.writeStream.partitionBy("chrom").option("path", output).option("checkpointLocation", checkpoint).format("parquet")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
