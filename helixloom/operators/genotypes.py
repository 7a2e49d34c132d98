"""Alleles from scores, marker filters, and the tables that genetics programs read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import allele, genotype


def call_alleles(windows: DataFrame, a: float = 95, b: float = 60, n: float = 30, chroms: DataFrame | None = None) -> DataFrame:
    """windows with allele; only those of chroms (chrom) if given."""
    if chroms is not None:
        windows = windows.join(chroms.select("chrom"), "chrom", "left_semi")
    return windows.withColumn("allele", allele(F.col("score"), a, b, n))


def allele_counts(called: DataFrame) -> DataFrame:
    """(chrom, win_id, c0, c1, c2, cn, samples) of each window."""
    return called.groupBy("chrom", "win_id").agg(*[F.count_if(F.col("allele") == v).alias(c) for c, v in (("c0", 0), ("c1", 1), ("c2", 2), ("cn", -1))], F.count("*").alias("samples"))


def bad_windows(called: DataFrame, maf: float = 0.05, max_missing: float = 0.8) -> DataFrame:
    """(chrom, win_id) of windows that are monomorphic, too rare in an allele, or missing too often."""
    c = allele_counts(called)
    valid = F.col("samples") - F.col("cn")
    mono = F.greatest("c0", "c1", "c2", "cn") == F.col("samples")
    rare = (valid > 0) & ((F.col("c0") <= maf * valid) | (F.col("c2") <= maf * valid))
    gone = (F.col("cn") >= max_missing * F.col("samples")) | (F.col("cn") + F.col("c1") >= max_missing * F.col("samples"))
    return c.where(mono | rare | gone).select("chrom", "win_id")


def good_markers(called: DataFrame, maf: float = 0.05, max_missing: float = 0.8) -> DataFrame:
    return called.join(bad_windows(called, maf, max_missing), ["chrom", "win_id"], "left_anti")


def contig_map(windows: DataFrame) -> DataFrame:
    """(chrom, contig_id): chromosomes numbered from 1 in the order in which they are first met."""
    seen = windows.groupBy("chrom").agg(F.min("win_ord").alias("_at"))
    return seen.select("chrom", F.row_number().over(Window.orderBy("_at", "chrom")).alias("contig_id"))


def genotype_table(called: DataFrame, samples: Sequence[str]) -> DataFrame:
    """(ID, CHR, START, END, one column per sample): the allele codes, -1 where a sample has none."""
    wide = called.groupBy(F.col("win_id").alias("ID"), F.col("contig_id").alias("CHR"), F.col("start").alias("START"), F.col("end").alias("END"))
    return wide.pivot("sample", list(samples)).agg(F.first("allele")).na.fill(-1, list(samples))


def ped(called: DataFrame) -> DataFrame:
    """(sample, genotypes): each sample's pairs of alleles in order of the windows, tab separated."""
    pairs = F.array_sort(F.collect_list(F.struct("win_ord", genotype(F.col("allele"), "\t").alias("g"))))
    return called.groupBy("sample").agg(pairs.alias("p")).select("sample", F.array_join(F.transform("p", lambda x: x["g"]), "\t").alias("genotypes"))


def marker_map(called: DataFrame) -> DataFrame:
    """(contig_id, marker, zero, start): a row per window, markers numbered in order."""
    markers = called.select("contig_id", "win_ord", "start").distinct()
    at = Window.partitionBy("contig_id").orderBy("win_ord")
    counts = markers.groupBy("contig_id").agg(F.count("*").alias("n"))
    before = counts.select(F.col("contig_id").alias("c"), F.coalesce(F.sum("n").over(Window.orderBy("contig_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    numbered = markers.withColumn("i", F.row_number().over(at) - 1).join(before, F.col("contig_id") == F.col("c"))
    return numbered.select("contig_id", (F.col("i") + F.col("off")).alias("marker"), F.lit(0).alias("zero"), "start")


def matrix(called: DataFrame) -> DataFrame:
    """(sample, codes): the codes in order of the windows, missing ones (-1) as 1, tab separated."""
    codes = F.array_sort(F.collect_list(F.struct("win_ord", F.when(F.col("allele") == -1, 1).otherwise(F.col("allele")).alias("v"))))
    return called.groupBy("sample").agg(codes.alias("p")).select("sample", F.array_join(F.transform("p", lambda x: x["v"].cast("string")), "\t").alias("codes"))
