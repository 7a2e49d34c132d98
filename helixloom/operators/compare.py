"""Comparing the regions of two tables by their k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_regions(one: DataFrame, two: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(sample, region_one, region_two, kmers_one, kmers_two, common, known) of every two regions of a sample.

    one and two hold the regions' k-mers, (sample, region, kmer) with repeats. common counts distinct k-mers of
    both, known those that table (kmer) holds too. Regions are paired (they are few for a sample), their k-mers
    meet by an equi-join, so pairs without a common k-mer cost one row.
    """
    def sizes(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy("sample", F.col("region").alias(f"region_{n}")).agg(F.count("kmer").alias(f"kmers_{n}"))

    a = one.where("kmer is not null").select("sample", F.col("region").alias("region_one"), "kmer").distinct()
    b = two.where("kmer is not null").select("sample", F.col("region").alias("region_two"), "kmer").distinct()
    if table is None:
        a = a.withColumn("known", F.lit(0))
    else:
        held = table.select("kmer", F.lit(1).alias("known")).distinct()
        a = a.join(held, "kmer", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    met = a.join(b, ["sample", "kmer"]).groupBy("sample", "region_one", "region_two").agg(F.count("*").alias("common"), F.sum("known").alias("known"))
    pairs = sizes(one, "one").join(sizes(two, "two"), "sample")
    out = pairs.join(met, ["sample", "region_one", "region_two"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("common", "known")})
