"""Wider windows from runs of narrow ones, and new scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import DEFAULT_WEIGHTS, check_weights, mean_depth, score


def bucket_size(current: int, new: int, step: int = 0) -> int:
    """How many windows make one of the new size."""
    if step > 0:
        raise ValueError("sliding windows cannot be merged")
    if current < 1 or new <= current:
        raise ValueError("the new window must be larger than the current one")
    return new // current + 1


def widen(windows: DataFrame, n: int, weights: tuple[float, float, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Every n consecutive windows of a sample's chromosome as one: (sample, chrom, win_id, start, end, ...).

    Sums of k-mers and hits; the first left and the last right distance; what lies between counts as inner. A
    variation cut in two by a border (a right distance, then a left one) counts once. eff_len is end - start.
    Counts are added window by window and cut to whole numbers at each (kmer_count = kd * ob).
    """
    check_weights(weights)
    per = Window.partitionBy("sample", "chrom").orderBy("win_ord")
    rows = windows.withColumn("bucket", F.floor((F.row_number().over(per) - 1) / n))
    inside = Window.partitionBy("sample", "chrom", "bucket").orderBy("win_ord")
    rows = rows.withColumn("_prev", F.lag("rd").over(inside))
    cut = (F.coalesce("_prev", F.lit(0)) > 0) & (F.col("ld") > 0) & (F.col("va") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("win_ord", (F.col("kd") * F.col("ob")).alias("x"))))
    out = rows.groupBy("sample", "chrom", "bucket").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("total_kmers").alias("total_kmers"),
        F.sum("ob").alias("ob"),
        (F.sum("va") - F.count_if(cut)).alias("va"),
        F.min_by("ld", "win_ord").alias("ld"),
        F.max_by("rd", "win_ord").alias("rd"),
        F.sum(F.col("id") + F.col("ld") + F.col("rd")).alias("_all"),
        F.aggregate(ordered, F.lit(0).cast("long"), lambda a, x: (a + x["x"]).cast("long")).alias("kmer_count"),
    )
    out = out.withColumns({"id": F.col("_all") - F.col("ld") - F.col("rd"), "eff_len": F.col("end") - F.col("start"), "win_id": F.concat_ws("_", F.col("chrom").cast("string"), F.col("start").cast("string")), "ibs": F.lit(-1)})
    out = out.withColumn("kd", mean_depth(F.col("kmer_count"), F.col("ob")))
    return rescore(out.drop("_all").withColumnRenamed("bucket", "win_ord"), weights)


def rescore(windows: DataFrame, weights: tuple[float, float, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """windows with the score under other weights; a projection, on tables and on streams."""
    check_weights(weights)
    return windows.withColumn("score", score(F.col("ob"), F.col("total_kmers"), F.col("id"), F.col("ld") + F.col("rd"), F.col("eff_len"), weights))
