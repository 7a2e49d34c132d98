"""Gene annotation in GTF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import places


def attribute(text: Column, name: str) -> Column:
    """A quoted attribute without spaces in its value, or null."""
    found = F.regexp_extract(text, rf'(?:^|;)\s*{name} "?([^";\s]+)"?\s*(?:;|$)', 1)
    return F.when(found != "", found)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, type, start, end, strand, gene_id, transcript_id, line_no) of all records; # lines and blank ones are left out.

    A line of fewer than nine columns is an error, and so is a transcript with the name of its gene.
    """
    raw = places(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("c", F.split("value", "\t"))
    ok = F.when(F.size("c") >= 9, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("fewer than nine columns: "), F.col("value"))).cast("array<string>"))
    rows = raw.select("place", ok.alias("c"))
    rows = rows.select("place", F.col("c")[0].alias("chrom"), F.col("c")[2].alias("type"), F.col("c")[3].cast("int").alias("start"), F.col("c")[4].cast("int").alias("end"), F.col("c")[6].alias("strand"), attribute(F.col("c")[8], "gene_id").alias("gene_id"), attribute(F.col("c")[8], "transcript_id").alias("transcript_id"))
    same = F.col("transcript_id") == F.col("gene_id")
    rows = rows.withColumn("transcript_id", F.when(same, F.raise_error(F.concat(F.lit("transcript and gene are both "), F.col("gene_id")))).otherwise(F.col("transcript_id")))
    return rows.select("chrom", "type", "start", "end", "strand", "gene_id", "transcript_id", F.col("place").alias("line_no"))


def write_gtf(feats: DataFrame, path: str, source: str = "helixloom") -> None:
    """features() as GTF, in order of chromosome and start: a folder of parts that follow each other by their names."""
    gene = F.when(F.col("kind") == "gene", F.col("id")).when(F.col("kind") == "transcript", F.col("parent"))
    tx = F.when(F.col("kind") == "transcript", F.col("id")).when(F.col("kind") == "exon", F.col("parent"))
    attrs = F.concat_ws(" ", F.when(gene.isNotNull(), F.concat(F.lit('gene_id "'), gene, F.lit('";'))), F.when(tx.isNotNull(), F.concat(F.lit('transcript_id "'), tx, F.lit('";'))))
    line = F.concat_ws("\t", "chrom", F.lit(source), "kind", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attrs)
    feats.orderBy("chrom", "start", "line_no").select(line.alias("value")).write.text(path)
