"""Command line: python -m helixloom COMMAND ... (or with spark-submit); every command goes from files to files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.attributes import ATTRIBUTES
from .plans import commands as C


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixloom", description=__doc__)
    subs = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, table: bool = True) -> argparse.ArgumentParser:
        p = subs.add_parser(name, help=text, description=text)
        if table:
            p.add_argument("-i", "--input", required=True, help="window table")
        p.add_argument("-o", "--output", required=True, help="folder, or prefix of folders, to write")
        return p

    def weights(p: argparse.ArgumentParser) -> None:
        for flag, default, what in (("--wi", 0.3, "inner distance"), ("--wt", 0.3, "tail distance"), ("--wr", 0.4, "k-mer ratio")):
            p.add_argument(flag, type=float, default=default, help=f"weight of the {what}")

    def scores(p: argparse.ArgumentParser, maf: float, missing: float) -> None:
        for flags, default in ((("-a", "--score_a"), 95), (("-b", "--score_b"), 60), (("--score_n",), 30)):
            p.add_argument(*flags, type=float, default=default)
        p.add_argument("--chrs", help="list of chromosomes")
        p.add_argument("--maf", type=float, default=maf)
        p.add_argument("--max-missing", type=float, default=missing)

    p = add("count", "count the k-mers of a FASTA file", table=False)
    p.add_argument("-r", "--sequences", required=True)
    p.add_argument("-k", type=int, required=True)
    p.add_argument("-c", "--min-count", type=int, default=1)
    p.add_argument("--one-strand", action="store_true")

    p = add("screen", "screen a sample's k-mers in windows of a reference", table=False)
    p.add_argument("-r", "--reference", required=True)
    p.add_argument("-k", "--kmc", required=True, help="prefix of a binary table, or with --kmer-length a folder of counts")
    p.add_argument("-s", "--sample", required=True)
    p.add_argument("-f", "--feature", required=True, choices=("window", "gene", "transcript"))
    p.add_argument("-w", "--window", type=int, default=0)
    p.add_argument("-p", "--step", type=int, default=0)
    p.add_argument("-g", "--gtf")
    p.add_argument("-c", "--min-k-count", type=int, default=1)
    p.add_argument("--kmer-length", type=int)
    weights(p)

    p = add("cohort", "merge the tables of several samples", table=False)
    p.add_argument("-i", "--input", help="tables, by commas")
    p.add_argument("-l", "--list", help="file that lists them")

    p = add("regions", "find identical, or variable, regions")
    p.add_argument("--var", action="store_true")
    p.add_argument("--min", type=int, default=4, help="windows below the cut that a region may hold in a row")
    p.add_argument("--score", type=float, default=95)
    p.add_argument("--summary", action="store_true")
    p.add_argument("--bed", action="store_true")

    add("split", "split a table by chromosome")
    p = add("attributes", "write attributes as tables of windows and samples")
    p.add_argument("-a", "--attributes", help="some of " + ",".join(ATTRIBUTES))
    p = add("samples", "write a table for each sample")
    p.add_argument("-s", "--sample")
    p = add("widen", "merge consecutive windows")
    p.add_argument("-w", "--window", type=int, required=True)
    weights(add("rescore", "compute scores with other weights"))
    scores(add("genotypes", "write a genotype table"), 0, 1)
    scores(add("plink", "write PED and MAP"), 0.05, 0.8)
    scores(add("matrix", "write a matrix of codes and its map"), 0.05, 0.8)

    p = add("compare", "compare the regions of two references by k-mers", table=False)
    for flag in ("--ref-one", "--ref-two", "--summary-one", "--summary-two", "--kmc"):
        p.add_argument(flag, required=True)
    p = add("pipeline", "count, screen, merge and find regions for the sequences of several samples", table=False)
    p.add_argument("-r", "--reference", required=True)
    p.add_argument("-s", "--samples", required=True, help="name=file, by commas")
    p.add_argument("-k", type=int, default=31)
    p.add_argument("-w", "--window", type=int, default=5000)
    p.add_argument("-c", "--min-count", type=int, default=1)
    return top


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    called = {"score_a": getattr(a, "score_a", None), "score_b": getattr(a, "score_b", None), "score_n": getattr(a, "score_n", None), "maf": getattr(a, "maf", None), "max_missing": getattr(a, "max_missing", None), "chroms": getattr(a, "chrs", None)}
    todo = {
        "count": lambda: C.count(spark, a.sequences, a.k, a.output, a.min_count, not a.one_strand),
        "screen": lambda: C.screen_variations(spark, a.reference, a.kmc, a.output, a.sample, a.feature, a.window, a.step, a.gtf, a.min_k_count, (a.wi, a.wt, a.wr), a.kmer_length),
        "cohort": lambda: C.merge_cohort(spark, a.output, a.input.split(",") if a.input else (), a.list),
        "regions": lambda: C.find_regions(spark, a.input, a.output, a.var, a.min, a.score, a.summary, a.bed),
        "split": lambda: C.split_table(spark, a.input, a.output),
        "attributes": lambda: C.write_attributes(spark, a.input, a.output, a.attributes.split(",") if a.attributes else tuple(ATTRIBUTES)),
        "samples": lambda: C.write_samples(spark, a.input, a.output, a.sample),
        "widen": lambda: C.widen_windows(spark, a.input, a.output, a.window),
        "rescore": lambda: C.rescore_table(spark, a.input, a.output, (a.wi, a.wt, a.wr)),
        "genotypes": lambda: C.to_genotypes(spark, a.input, a.output, **called),
        "plink": lambda: C.to_plink(spark, a.input, a.output, **called),
        "matrix": lambda: C.to_matrix(spark, a.input, a.output, **called),
        "pipeline": lambda: C.pipeline(spark, a.reference, dict(x.split("=", 1) for x in a.samples.split(",")), a.output, a.k, a.window, a.min_count),
    }
    if a.command == "compare":
        from .sources.kmc import read_header, read_kmc

        todo["compare"] = lambda: C.compare_region_tables(spark, a.ref_one, a.ref_two, a.summary_one, a.summary_two, read_kmc(spark, a.kmc), read_header(a.kmc).k, a.output)
    todo[a.command]()


if __name__ == "__main__":
    run(SparkSession.builder.appName("helixloom").getOrCreate(), sys.argv[1:])
