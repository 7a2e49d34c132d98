"""Statistics of markers and samples for association studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def site_summary(called: DataFrame, by: tuple[str, ...] = ("chrom", "win_id")) -> DataFrame:
    """(*by, maf, miss, het) of each marker from alleles 0, 1, 2 and -1, rounded to three places."""
    c = called.groupBy(*by).agg(*[F.count_if(F.col("allele") == v).alias(n) for n, v in (("c0", 0), ("c1", 1), ("c2", 2))], F.count("*").alias("n"))
    seen = F.col("c0") + F.col("c1") + F.col("c2")
    alt = F.when(seen > 0, (F.col("c2") * 2 + F.col("c1")) / (seen * 2))
    return c.select(*by, F.round(F.least(alt, 1 - alt), 3).alias("maf"), F.round((F.col("n") - seen) / F.col("n"), 3).alias("miss"), F.round(F.when(seen > 0, F.col("c1") / seen), 3).alias("het"))


def keep_markers(summary: DataFrame, maf: float, miss: float, het: float) -> DataFrame:
    return summary.where((F.col("maf") >= maf) & (F.col("miss") <= miss) & (F.col("het") <= het))


def polymorphic(called: DataFrame, by: tuple[str, ...] = ("chrom", "win_id")) -> DataFrame:
    return called.groupBy(*by).agg(F.count_distinct("allele").alias("values")).where(F.col("values") > 1).select(*by)


def chromosome_offsets(lengths: DataFrame) -> DataFrame:
    """(chr, len, offset, mid): where chromosomes begin when laid end to end in order."""
    order = Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, 0)
    out = lengths.withColumn("offset", F.sum("len").over(order) - F.col("len"))
    return out.withColumn("mid", F.col("offset") + F.col("len") / 2)


def best_per_bin(hits: DataFrame, width: int = 500_000) -> DataFrame:
    """(chr, pos, pval): the least p of each half-megabase position, ties kept once each; pos in megabases."""
    rows = hits.withColumn("pos", F.bround(F.col("start") / width, 0) / (1_000_000 / width))
    best = F.rank().over(Window.partitionBy("chr", "pos").orderBy("pval"))
    return rows.withColumn("_r", best).where("_r = 1").select("chr", "pos", "pval").distinct()


def significant(hits: DataFrame, alpha: float = 0.05) -> DataFrame:
    """hits with logp, those that pass Bonferroni's bound for their number."""
    n = hits.agg(F.count("*").alias("_n"))
    rows = hits.crossJoin(F.broadcast(n)).withColumn("logp", -F.log10("pval"))  # one row
    return rows.where(F.col("logp") >= -F.log10(F.lit(alpha) / F.col("_n"))).drop("_n")


def position_grid(lengths: DataFrame, width: int = 500_000) -> DataFrame:
    """(chr, pos): every half megabase of each chromosome, in megabases."""
    return lengths.select("chr", F.explode(F.sequence(F.lit(0), (F.col("len") / width).cast("int"))).alias("i")).select("chr", (F.col("i") * width / 1e6).alias("pos"))


def sample_positions(samples: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(sample, grp, position): samples numbered by name, or by the order of their group, then name."""
    s = samples.select("sample").distinct()
    if groups is None:
        return s.select("sample", F.lit(None).cast("string").alias("grp"), F.row_number().over(Window.orderBy("sample")).alias("position"))
    joined = s.join(groups.select("sample", "grp", "grp_order"), "sample", "left")
    return joined.select("sample", "grp", F.row_number().over(Window.orderBy(F.col("grp_order").asc_nulls_last(), "sample")).alias("position"))


def kinship(genos: DataFrame) -> DataFrame:
    """(a, b, k): relationship of every two samples from genotypes (marker, sample, g in 0 to 2), none missing.

    Invariant markers go, the rest are centred, and products are summed over markers by a join on the marker;
    the sums are scaled to 0 .. 1 + inbreeding, the diagonal to a minimum of 1, the rest to the top at most.
    """
    g = genos.select("marker", "sample", F.col("g").cast("double").alias("g"))
    m = g.groupBy("marker").agg(F.avg("g").alias("mean"), F.count("*").alias("n")).where("mean > 0 and mean < 2")
    kept = g.join(m, "marker")
    inbreeding = kept.groupBy("sample").agg((F.sum(1 - F.abs(F.col("g") - 1)) / (2 * F.count("*"))).alias("fi")).agg((1 - F.min("fi")).alias("inb"))
    c = kept.select("marker", "sample", (F.col("g") - F.col("mean")).alias("x"))
    d = c.select("marker", F.col("sample").alias("b"), F.col("x").alias("y"))
    products = c.join(d, "marker").groupBy(F.col("sample").alias("a"), "b").agg(F.sum(F.col("x") * F.col("y")).alias("k"))
    on = F.col("a") == F.col("b")
    limits = products.agg(F.min(F.when(on, F.col("k"))).alias("dl"), F.max(F.when(on, F.col("k"))).alias("du"), F.min("k").alias("low"))
    s = products.crossJoin(F.broadcast(limits.crossJoin(inbreeding)))  # one row
    s = s.withColumn("top", 1 + F.col("inb"))
    s = s.withColumns({"k": F.col("top") * (F.col("k") - F.col("low")) / (F.col("du") - F.col("low")), "dmin": F.col("top") * (F.col("dl") - F.col("low")) / (F.col("du") - F.col("low"))})
    lifted = F.when(on, (F.col("k") - F.col("dmin") + 1) / ((F.col("top") + 1 - F.col("dmin")) * 0.5)).otherwise(F.col("k") / F.col("dmin"))
    s = s.withColumn("k", F.when(F.col("dmin") < 1, lifted).otherwise(F.col("k")))
    most = s.where(~on).agg(F.max("k").alias("omax"))
    s = s.crossJoin(F.broadcast(most))  # one row
    return s.select("a", "b", F.when(~on & (F.col("omax") > F.col("top")), F.col("k") * F.col("top") / F.col("omax")).otherwise(F.col("k")).alias("k"))


def histogram(scores: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, n) of score from 0 to 100."""
    return scores.groupBy(F.least(F.floor(F.col("score") / (100 / bins)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
