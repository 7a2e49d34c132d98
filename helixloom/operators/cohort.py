"""Merging samples, and statistics over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameters that tables of one cohort must share.
SHARED = ("window", "step", "kmer", "IBS", "nwindow", "wti", "wtt", "wtk")


def check_compatible(params: Sequence[dict[str, str]]) -> None:
    for other in params[1:]:
        for key in SHARED:
            if params[0].get(key) != other.get(key):
                raise ValueError(f"tables differ in {key}: {params[0].get(key)} and {other.get(key)}")


def merge(tables: Sequence[DataFrame]) -> DataFrame:
    """One long table of the tables' samples: rows lie side by side, so nothing is joined or moved.

    Totals and lengths of windows are taken from each table; validate() finds tables that do not fit together.
    """
    return reduce(lambda a, b: a.unionByName(b), tables)


def validate(cohort: DataFrame) -> DataFrame:
    """(chrom, win_id, problem): windows whose cells do not make a cohort; none if all is well.

    missing: not every sample has the window; repeated: a sample has it more than once.
    """
    samples = cohort.select("sample").distinct().agg(F.count("*").alias("all"))
    per = cohort.groupBy("chrom", "win_id").agg(F.count_distinct("sample").alias("have"), F.count("*").alias("cells"))
    joined = per.crossJoin(F.broadcast(samples))  # one row
    found = F.when(F.col("cells") > F.col("have"), "repeated").when(F.col("have") < F.col("all"), "missing")
    return joined.select("chrom", "win_id", found.alias("problem")).where("problem is not null")


def window_stats(cohort: DataFrame) -> DataFrame:
    """Least, greatest and mean score, observed k-mers and variations of each window over its samples."""
    out = cohort.groupBy("chrom", "win_id").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("score", "ob", "va") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    )
    return out.withColumns({c: F.col(c).cast("float") for c in ("mean_ob", "mean_va")})


def align(cohort: DataFrame, samples: Sequence[str]) -> DataFrame:
    """cohort with sample_idx, the place of the sample in the list; a sample that is not in it is an error."""
    at = F.array_position(F.array(*[F.lit(s) for s in samples]), F.col("sample")).cast("int") - 1
    return cohort.withColumn("sample_idx", F.when(at >= 0, at).otherwise(F.raise_error(F.concat(F.lit("unknown sample "), F.col("sample"))).cast("int")))
