"""Attribute tables of windows and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attribute to column of the long table; the last two belong to windows, not to cells.
ATTRIBUTES = {"obs": "ob", "var": "va", "kd": "kd", "score": "score", "inDist": "id", "tailDist": "tail", "totalkmers": "total_kmers", "winlen": "eff_len"}
WINDOW_ATTRIBUTES = ("totalkmers", "winlen")


def attribute_table(cohort: DataFrame, attribute: str, samples: Sequence[str]) -> DataFrame:
    """(window_id, one column per sample), or (window_id, value) for an attribute of windows."""
    if attribute not in ATTRIBUTES:
        raise ValueError(f"no attribute {attribute}: one of {', '.join(ATTRIBUTES)}")
    column = ATTRIBUTES[attribute]
    rows = cohort.withColumn("tail", F.col("ld") + F.col("rd"))
    if attribute in WINDOW_ATTRIBUTES:
        name = "total_kmers" if attribute == "totalkmers" else "window_length"
        return rows.groupBy(F.col("win_id").alias("window_id")).agg(F.first(column).alias(name))
    return rows.groupBy(F.col("win_id").alias("window_id")).pivot("sample", list(samples)).agg(F.first(column))


def sample_table(cohort: DataFrame, samples: Sequence[str] | None = None) -> DataFrame:
    """One row per window and sample, with the distances summed up."""
    rows = cohort if samples is None else cohort.where(F.col("sample").isin(*samples))
    return rows.select(
        "sample", F.col("win_id").alias("window_id"), F.col("chrom").alias("seqname"), "start", "end", "eff_len", "total_kmers", F.col("ob").alias("observed_kmers"),
        F.col("va").alias("variations"), (F.col("id") + F.col("ld") + F.col("rd")).alias("kmer_distance"), F.col("kd").alias("mean_kmer_depth"), "score",
    )
