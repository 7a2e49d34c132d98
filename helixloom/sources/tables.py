"""Small text tables that commands take and make."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the region summary.
SUMMARY = ("Block", "Sample", "Chromosome", "Start", "End", "Length", "TotalBlocks", "IBSBlocks", "IBSProportion", "MeanScore")


def read_list(spark: SparkSession, path: str, column: str = "chrom") -> DataFrame:
    """One value per line; blank lines and those that begin with # are left out."""
    value = F.trim("value")
    return spark.read.text(path).where((value != "") & ~value.startswith("#")).select(value.alias(column)).distinct()


def read_file_list(spark: SparkSession, path: str) -> list[str]:
    """Paths, one per line, in order; the list is as long as there are samples."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    types = dict(zip(SUMMARY, ("int", "string", "string", "int", "int", "int", "int", "int", "double", "double")))
    return raw.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def write_summary(summary: DataFrame, path: str) -> None:
    out = summary.orderBy("sample", "block").coalesce(1)
    two = lambda c: F.format_string("%.2f", F.col(c))
    cols = [F.col("block"), F.col("sample"), F.col("chrom"), F.col("start"), F.col("end"), F.col("length"), F.col("total_blocks"), F.col("ibs_blocks"), two("ibs_proportion"), two("mean_score")]
    out.select(*[c.alias(n) for c, n in zip(cols, SUMMARY)]).write.option("sep", "\t").option("header", True).csv(path)


def read_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """(ID, CHR, START, END, sample, allele) of a genotype table with a header and # comments; N is -1."""
    wide = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(path)
    samples = wide.columns[4:]
    return wide.unpivot(["ID", "CHR", "START", "END"], samples, "sample", "g").select("ID", *[F.col(c).cast("int").alias(c) for c in ("CHR", "START", "END")], "sample", F.when(F.col("g") == "N", -1).otherwise(F.col("g").cast("int")).alias("allele"))


def read_hapmap(spark: SparkSession, path: str) -> DataFrame:
    """(ID, CHR, START, alleles, sample, call) of a HapMap table: samples from the twelfth column on."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    c = wide.columns
    return wide.unpivot([F.col(f"`{c[0]}`").alias("ID"), F.col(f"`{c[1]}`").alias("alleles"), F.col(f"`{c[2]}`").alias("CHR"), F.col(f"`{c[3]}`").cast("int").alias("START")], [F.col(f"`{x}`") for x in c[11:]], "sample", "call")


def read_chromosomes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, len, num, cum_len, start, mid) of a table without header."""
    raw = spark.read.option("sep", "\t").schema("chrom string, len long, num int, cum_len long").csv(path)
    return raw.withColumns({"start": F.col("cum_len") - F.col("len"), "mid": F.col("cum_len") - F.col("len") / 2})


def write_tsv(df: DataFrame, path: str, order: Sequence[str] = (), header: bool = True) -> None:
    """One tab-separated file; pass order for a sorted one."""
    (df.orderBy(*order) if order else df).coalesce(1).write.option("sep", "\t").option("header", header).csv(path)


def write_by(df: DataFrame, column: str, path: str, header: bool = False) -> None:
    """A folder of tab-separated files for each value of column."""
    df.repartition(column).write.partitionBy(column).option("sep", "\t").option("header", header).csv(path)
