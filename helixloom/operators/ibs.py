"""Identical and variable regions: runs of windows by score, with a tolerance for gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import float_cut


def region_predicate(score: Column, cut: float = 95, variable: bool = False) -> Column:
    return score < float_cut(cut) if variable else score >= float_cut(cut)


def label_regions(windows: DataFrame, chroms: DataFrame | None = None, cut: float = 95, max_gap: int = 4, variable: bool = False) -> DataFrame:
    """windows (sample, chrom, win_ord, score, ...) with ibs, the number of the region or -1, and seg, lo, hi.

    In a sample's chromosome, windows in order of win_ord, a window that meets the cut starts a region if it is
    the first or more than max_gap windows that do not have passed since the last. Regions are numbered from 1
    through the sample, chromosome after chromosome: in the order of chroms (chrom, contig_idx), else by name.
    Numbering runs within each chromosome, and the chromosomes' counts (one row each) are then added up, so no
    task holds a sample. seg is the region that runs at a window, lo and hi its first and last place.
    """
    per = Window.partitionBy("sample", "chrom").orderBy("win_ord")
    meets = region_predicate(F.col("score"), cut, variable)
    rows = windows.withColumns({"rn": F.row_number().over(per), "_is": meets})
    rows = rows.withColumn("_prev", F.max(F.when(F.col("_is"), F.col("rn"))).over(per.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_new", (F.col("_is") & (F.col("_prev").isNull() | (F.col("rn") - F.col("_prev") - 1 > max_gap))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    counts = rows.groupBy("sample", "chrom").agg(F.sum("_new").alias("_n"))
    if chroms is not None:
        counts = counts.join(chroms.select("chrom", "contig_idx"), "chrom")
        order = Window.partitionBy("sample").orderBy("contig_idx")
    else:
        order = Window.partitionBy("sample").orderBy("chrom")
    offsets = counts.select("sample", "chrom", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    rows = rows.join(offsets, ["sample", "chrom"])
    rows = rows.withColumns({"seg": F.col("_off") + F.col("_run"), "ibs": F.when(F.col("_is"), F.col("_off") + F.col("_run")).otherwise(-1)})
    part = Window.partitionBy("sample", "chrom", "_run")
    rows = rows.withColumns({"lo": F.min(F.when(F.col("_is"), F.col("rn"))).over(part), "hi": F.max(F.when(F.col("_is"), F.col("rn"))).over(part)})
    return rows.drop("_is", "_prev", "_new", "_run", "_off")


def summarize_regions(labelled: DataFrame) -> DataFrame:
    """(sample, chrom, block, start, end, length, total_blocks, ibs_blocks, ibs_proportion, mean_score) of regions.

    A region holds all windows from its first to its last that meets the cut, those between that do not included.
    """
    inside = labelled.where(F.col("lo").isNotNull() & F.col("rn").between(F.col("lo"), F.col("hi")))
    out = inside.groupBy("sample", "chrom", F.col("seg").alias("block")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("total_blocks"), F.count_if(F.col("ibs") > 0).alias("ibs_blocks"), F.avg("score").alias("mean_score")
    )
    return out.withColumns({"length": F.col("end") - F.col("start"), "ibs_proportion": F.col("ibs_blocks") / F.col("total_blocks")})


def region_bed(labelled: DataFrame) -> DataFrame:
    """(sample, chrom, start, end) of the windows in regions."""
    return labelled.where("ibs > 0").select("sample", "chrom", "start", "end")
