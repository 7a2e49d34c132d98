"""The commands, each from files to files, with the options and defaults of the command line they stand for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import DEFAULT_WEIGHTS, check_thresholds
from ..functions.sequence import sanitize
from ..operators import attributes, cohort, compare, genotypes, ibs, rewindow
from ..operators.annotation import features
from ..operators.kmers import count_kmers, kmers
from ..sources.fasta import fetch, read_chunks, read_fasta
from ..sources.gtf import read_gtf
from ..sources.kmc import read_header as read_kmc_header
from ..sources.kmc import read_kmc
from ..sources.tables import read_file_list, read_list, read_summary, write_by, write_summary, write_tsv
from ..sources.wintable import PARAMS, Header, read_header, read_windows, write_windows
from .screening import screen, screen_features


CHUNK = 1 << 20  # bases of a contig that a task takes at once


def count(spark: SparkSession, sequences: str, k: int, output: str, min_count: int = 1, both_strands: bool = True) -> None:
    """A k-mer count table (Parquet) of a FASTA file."""
    count_kmers(read_chunks(spark, sequences, k, CHUNK).repartition("contig", "offset"), k, both_strands, min_count=min_count).write.parquet(output)


def screen_variations(spark: SparkSession, reference: str, kmer_table: str, output: str, sample: str, feature: str = "window", window: int = 0, step: int = 0, gtf: str | None = None, min_count: int = 1, weights: tuple[float, float, float] = DEFAULT_WEIGHTS, k: int | None = None, both_strands: bool = True) -> None:
    """Window table of one sample, as text and, at <output>.parquet, as the long table that the text is made from: k-mers
    are looked up and folded once. kmer_table is the prefix of a binary table, or with k a Parquet folder (kmer, cnt)."""
    if feature not in ("window", "gene", "transcript"):
        raise ValueError("feature is window, gene or transcript")
    if feature == "window" and window <= 0 or feature != "window" and not gtf:
        raise ValueError("windows need a size, genes and transcripts an annotation")
    if step and feature != "window" or step < 0 or min_count < 1:
        raise ValueError("step goes with windows; min_count is 1 or more")
    if k is None:
        head = read_kmc_header(kmer_table)
        k, both_strands, counts = head.k, head.both_strands, read_kmc(spark, kmer_table)
    else:
        counts = spark.read.parquet(kmer_table)
    contigs = read_fasta(spark, reference)
    if feature == "window":
        found = screen(contigs.select("contig", "seq"), counts, k, window, step, min_count, both_strands, weights, CHUNK)
        found = found.withColumn("win_id", F.concat_ws("_", "contig", F.col("start").cast("string")))
    else:
        found = screen_features(features(read_gtf(spark, gtf)), contigs.select("contig", "seq"), counts, k, feature, min_count, both_strands, weights).withColumn("win_id", F.col("win"))
    found.withColumnRenamed("contig", "chrom").withColumns({"ibs": F.lit(-1), "sample": sanitize(F.lit(sample)), "sample_idx": F.lit(0)}).drop("win").write.parquet(f"{output}.parquet")
    rows = spark.read.parquet(f"{output}.parquet")
    name = spark.range(1).select(sanitize(F.lit(sample)).alias("s")).first().s
    lengths = {r.contig: r.length for r in contigs.select("contig_idx", "contig", "length").orderBy("contig_idx").toLocalIterator()}
    values = (window if feature == "window" else 0, step, k, "false", rows.count(), *weights)
    write_windows(rows, Header(reference.rpartition("/")[2], lengths, dict(zip(PARAMS, map(str, values))), [f"screen_variations -k {kmer_table} -r {reference} -s {sample} -f {feature} -w {window} -p {step}"], [name]), output)


def _load(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    head = read_header(spark, path)
    return head, read_windows(spark, path, head)


def merge_cohort(spark: SparkSession, output: str, inputs: Sequence[str] = (), list_file: str | None = None) -> None:
    """Tables of several samples as one; give paths or a file that lists them."""
    if bool(inputs) == bool(list_file):
        raise ValueError("give paths or a list of them, not both")
    loaded = [_load(spark, p) for p in (inputs or read_file_list(spark, list_file))]
    cohort.check_compatible([h.params for h, _ in loaded])
    names = [s for h, _ in loaded for s in h.samples]
    if len(set(names)) < len(names):
        raise ValueError("a sample is in more than one table")
    merged = cohort.align(cohort.merge([df.drop("sample_idx") for _, df in loaded]), names)
    if bad := cohort.validate(merged).limit(1).collect():
        raise ValueError(f"window {bad[0].win_id} is {bad[0].problem}")
    first = loaded[0][0]
    write_windows(merged, Header(first.reference, first.contigs, first.params, [c for h, _ in loaded for c in h.commands], names), output)


def _chroms(spark: SparkSession, head: Header) -> DataFrame:
    return spark.createDataFrame(list(enumerate(head.contigs)), "contig_idx int, chrom string")


def find_regions(spark: SparkSession, table: str, output: str, variable: bool = False, max_gap: int = 4, cut: float = 95, summary: bool = False, bed: bool = False) -> None:
    """Table with region numbers; summary and BED files beside it. With a step, max_gap is window / step."""
    head, rows = _load(spark, table)
    if int(head.params.get("step", 0)) > 0:
        max_gap = int(head.params["window"]) // int(head.params["step"])
    found = ibs.label_regions(rows.drop("ibs"), _chroms(spark, head), cut, max_gap, variable)
    write_windows(found, Header(head.reference, head.contigs, head.params | {"IBS": "true"}, [*head.commands, f"find_regions -i {table}"], head.samples), output)
    if summary:
        write_summary(ibs.summarize_regions(found), f"{output}.summary")
    if bed:
        write_by(ibs.region_bed(found), "sample", f"{output}.bed")


def split_table(spark: SparkSession, table: str, output: str) -> None:
    """A table for each chromosome, <output>/<chromosome>, with the same header."""
    head, rows = _load(spark, table)
    for chrom in head.contigs:
        write_windows(rows.where(F.col("chrom") == chrom), head, f"{output}/{chrom}")


def write_attributes(spark: SparkSession, table: str, output: str, chosen: Sequence[str] = tuple(attributes.ATTRIBUTES)) -> None:
    head, rows = _load(spark, table)
    for a in chosen:
        write_tsv(attributes.attribute_table(rows, a, head.samples), f"{output}.{a}.tsv", ["window_id"])


def write_samples(spark: SparkSession, table: str, output: str, sample: str | None = None) -> None:
    head, rows = _load(spark, table)
    if sample is not None and sample not in head.samples:
        raise ValueError(f"no sample {sample}")
    write_by(attributes.sample_table(rows, None if sample is None else [sample]), "sample", output, header=True)


def widen_windows(spark: SparkSession, table: str, output: str, window: int) -> None:
    head, rows = _load(spark, table)
    n = rewindow.bucket_size(int(head.params["window"]), window, int(head.params.get("step", 0)))
    out = rewindow.widen(rows, n, head.weights)
    out = cohort.align(out, head.samples)
    sizes = out.agg(F.max("eff_len").alias("w"), F.count_distinct("chrom", "win_id").alias("n")).first()
    write_windows(out, Header(head.reference, head.contigs, head.params | {"window": str(sizes.w), "nwindow": str(sizes.n)}, head.commands, head.samples), output)


def rescore_table(spark: SparkSession, table: str, output: str, weights: tuple[float, float, float] = DEFAULT_WEIGHTS) -> None:
    head, rows = _load(spark, table)
    params = head.params | dict(zip(("wti", "wtt", "wtk"), map(str, weights)))
    write_windows(rewindow.rescore(rows, weights), Header(head.reference, head.contigs, params, head.commands, head.samples), output)


def _called(spark: SparkSession, table: str, a: float, b: float, n: float, chroms: str | None) -> tuple[Header, DataFrame]:
    head, rows = _load(spark, table)
    wanted = read_list(spark, chroms) if chroms else None
    ids = _chroms(spark, head).select("chrom", (F.col("contig_idx") + 1).alias("contig_id"))
    return head, genotypes.call_alleles(rows, *check_thresholds(a, b, n), wanted).join(F.broadcast(ids), "chrom")  # a row per contig of the header


def to_genotypes(spark: SparkSession, table: str, output: str, score_a: float = 95, score_b: float = 60, score_n: float = 30, maf: float = 0, max_missing: float = 1, chroms: str | None = None) -> None:
    head, called = _called(spark, table, score_a, score_b, score_n, chroms)
    if maf > 0 or max_missing < 1:
        called = genotypes.good_markers(called, maf, max_missing)
    write_tsv(genotypes.genotype_table(called, head.samples), f"{output}.genotypes", ["CHR", "START"])
    write_tsv(called.select("chrom", "contig_id").distinct(), f"{output}.contigs", ["contig_id"])


def to_plink(spark: SparkSession, table: str, output: str, score_a: float = 95, score_b: float = 60, score_n: float = 30, maf: float = 0.05, max_missing: float = 0.8, chroms: str | None = None) -> None:
    _, called = _called(spark, table, score_a, score_b, score_n, chroms)
    called = genotypes.good_markers(called, maf, max_missing)
    ped = genotypes.ped(called).orderBy("sample").select(F.concat_ws("\t", "sample", "sample", *[F.lit(x) for x in ("0", "0", "0", "-9")], "genotypes").alias("value"))
    ped.coalesce(1).write.text(f"{output}.ped")
    write_tsv(genotypes.marker_map(called), f"{output}.map", ["marker"], header=False)
    write_tsv(called.select("chrom", "contig_id").distinct(), f"{output}.contigs", ["contig_id"], header=False)


def to_matrix(spark: SparkSession, table: str, output: str, score_a: float = 95, score_b: float = 60, score_n: float = 30, maf: float = 0.05, max_missing: float = 0.8, chroms: str | None = None) -> None:
    _, called = _called(spark, table, score_a, score_b, score_n, chroms)
    called = genotypes.good_markers(called, maf, max_missing)
    genotypes.matrix(called).orderBy("sample").select(F.concat_ws("\t", "sample", "codes").alias("value")).coalesce(1).write.text(f"{output}.matrix")
    markers = called.select("win_id", "contig_id", "start", "win_ord").distinct()
    write_tsv(markers.select(F.col("win_id").alias("name"), F.col("contig_id").alias("chromosome"), F.col("start").alias("position"), "win_ord").orderBy("contig_id", "win_ord").drop("win_ord"), f"{output}.map")


def compare_region_tables(spark: SparkSession, ref_one: str, ref_two: str, summary_one: str, summary_two: str, kmer_table: DataFrame, k: int, output: str) -> None:
    """Every two regions of a sample, by the k-mers of their sequences."""
    def region_kmers(ref: str, path: str) -> tuple[DataFrame, DataFrame]:
        s = read_summary(spark, path).select(F.col("Sample").alias("sample"), F.struct(F.col("Chromosome").alias("contig"), F.col("Start").alias("start"), F.col("End").alias("end")).alias("region"))
        cut = fetch(read_fasta(spark, ref), s.select("sample", "region", "region.contig", "region.start", (F.col("region.end") - F.col("region.start")).alias("length")))
        found = kmers(cut.select(F.struct("sample", "region").alias("contig"), "seq"), k)
        have = found.select("contig.sample", "contig.region", "kmer")
        return s.join(have, ["sample", "region"], "left"), s

    one, _ = region_kmers(ref_one, summary_one)
    two, _ = region_kmers(ref_two, summary_two)
    out = compare.compare_regions(one, two, kmer_table)
    write_tsv(out.select("region_one.*", *[F.col("region_two")[c].alias(f"{c}_two") for c in ("contig", "start", "end")], "kmers_one", "kmers_two", "common", "known"), output, header=False)


def pipeline(spark: SparkSession, reference: str, samples: dict[str, str], output: str, k: int = 31, window: int = 5000, min_count: int = 1) -> None:
    """Counts, screening, cohort and regions for sequences of several samples; a step whose output is there is not done again."""
    from ..sources.files import done

    for name, path in samples.items():
        if not done(spark, f"{output}/counts/{name}"):
            count(spark, path, k, f"{output}/counts/{name}", min_count)
        if not done(spark, f"{output}/tables/{name}"):
            screen_variations(spark, reference, f"{output}/counts/{name}", f"{output}/tables/{name}", name, window=window, k=k)
    if not done(spark, f"{output}/cohort"):
        merge_cohort(spark, f"{output}/cohort", [f"{output}/tables/{n}" for n in samples])
    if not done(spark, f"{output}/regions"):
        find_regions(spark, f"{output}/cohort", f"{output}/regions", summary=True)
