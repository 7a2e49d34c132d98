"""Files: round trips, errors, and the commands from end to end."""

import glob
import random
import struct

import numpy as np
import pytest

from helixloom.operators.annotation import features, merge_intervals, spliced
from helixloom.operators.kmers import count_kmers
from helixloom.plans import commands as C
from helixloom.sources.fasta import fasta_index, fetch, read_fasta, write_fasta
from helixloom.sources.gtf import read_gtf, write_gtf
from helixloom.sources.kmc import read_header, read_kmc
from helixloom.sources.tables import read_genotypes, read_hapmap, read_list, read_summary
from helixloom.sources.wintable import read_header as table_header
from helixloom.sources.wintable import Header, read_windows, write_windows


def write(path, text):
    path.write_text(text)
    return str(path)


def lines(folder):
    return [x for f in sorted(glob.glob(f"{folder}/part-*")) for x in open(f).read().splitlines()]


def test_fasta(spark, tmp_path):
    path = write(tmp_path / "a.fa", ">c1 first -> one\nACGTN\nACG\n>c2\nacgtacgt\nacgtacgt\nac\n>c3 x\nTT\n")
    rows = read_fasta(spark, path).orderBy("contig_idx").collect()
    assert [(r.contig_idx, r.contig, r.description, r.seq) for r in rows] == [(0, "c1", "first -> one", "ACGTNACG"), (1, "c2", "", "acgtacgtacgtacgtac"), (2, "c3", "x", "TT")]
    data = open(path).read()
    for r in fasta_index(spark, path).collect():
        assert data[r.offset : r.offset + r.line_bases] == data[data.index(f">{r.name}") :].split("\n")[1]
        assert r.line_width == r.line_bases + 1 and r.length == len(next(x.seq for x in rows if x.contig == r.name))
    ask = spark.createDataFrame([("c1", 2, 4)], "contig string, start int, length int")
    assert fetch(read_fasta(spark, path), ask).first().seq == "GTNA"
    with pytest.raises(Exception, match="no such range"):
        fetch(read_fasta(spark, path), spark.createDataFrame([("c3", 1, 4)], ask.schema)).collect()
    for text, what in ((">a\nAC\n>a\nG\n", "more than once"), (">a\nAC!\n", "no nucleotide"), ("AC\n>a\nGG\n", "does not begin|nucleotide")):
        with pytest.raises(ValueError, match=what):
            read_fasta(spark, write(tmp_path / "bad.fa", text))
    with pytest.raises(ValueError):
        read_fasta(spark, "x.fa.gz")
    write_fasta(spark.createDataFrame([("c", "A" * 70, 1), ("b", "G", 0)], "contig string, seq string, ord int"), f"{tmp_path}/out")
    assert lines(f"{tmp_path}/out") == [">b", "G", ">c", "A" * 60, "A" * 10]


GTF = """#comment
c\ts\tgene\t10\t20\t.\t+\t.\tgene_id "g1";
c\ts\tmRNA\t5\t40\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c\ts\texon\t5\t10\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c\ts\texon\t8\t15\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c\ts\texon\t16\t18\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c\ts\tCDS\t1\t2\t.\t+\t.\tgene_id "g1";

c\ts\ttranscript\t50\t60\t.\t-\t.\tgene_id "g2"; transcript_id "t2";
c\ts\texon\t50\t52\t.\t-\t.\tgene_id "g2"; transcript_id "t2";
c\ts\tmRNA\t1\t70\t.\t+\t.\tgene_id "g3"; transcript_id "t3";
c\ts\tgene\t30\t35\t.\t+\t.\tgene_id "g3";
"""


def test_gtf(spark, tmp_path):
    feats = features(read_gtf(spark, write(tmp_path / "a.gtf", GTF)))
    rows = {(r.kind, r.id): (r.parent, r.start, r.end, r.strand) for r in feats.collect()}
    assert rows["gene", "g1"] == ("c", 5, 40, "+")
    assert rows["gene", "g2"] == ("c", 50, 60, "-")
    assert rows["gene", "g3"] == ("c", 30, 35, "+")
    assert rows["exon", "t1-e-3"] == ("t1", 16, 18, "+") and len(rows) == 10
    seq = "".join(random.Random(1).choices("ACGT", k=80))
    contigs = spark.createDataFrame([("c", seq)], "contig string, seq string")
    got = {r.owner: r.seq for r in spliced(feats, contigs, True).collect()}
    assert got == {"g1": seq[4:15] + seq[15:18], "g2": seq[49:52]}
    write_gtf(feats, f"{tmp_path}/out.gtf")
    again = features(read_gtf(spark, f"{tmp_path}/out.gtf"))
    assert {(r.kind, r.id, r.start, r.end) for r in again.where("kind <> 'exon'").collect()} == {(k, i, v[1], v[2]) for (k, i), v in rows.items() if k != "exon"}
    for bad in ("c\ts\tgene\t1\n", 'c\ts\tmRNA\t1\t2\t.\t+\t.\tgene_id "a"; transcript_id "a";\n'):
        with pytest.raises(Exception, match="fewer than nine|are both"):
            read_gtf(spark, write(tmp_path / "bad.gtf", bad)).collect()


def test_touching_loci_stay_apart(spark):
    loci = spark.createDataFrame([("c", "+", 1, 5), ("c", "+", 6, 9), ("c", "+", 2, 3), ("c", "+", 9, 12), ("c", "-", 4, 7)], "chrom string, strand string, start int, end int")
    assert sorted((r.strand, r.start, r.end) for r in merge_intervals(loci, []).collect()) == [("+", 1, 5), ("+", 6, 12), ("-", 4, 7)]


def write_kmc(prefix, counts, k, lut, counter, sig=2, strands=0):
    """A table in one bin."""
    code = lambda s: sum("ACGT".index(c) << 2 * (len(s) - 1 - i) for i, c in enumerate(s))
    items = sorted(counts.items())
    starts = np.zeros(4**lut, "<u8")
    for kmer, _ in items:
        starts[code(kmer[:lut]) + 1 :] += 1
    header = struct.pack("<7IQB3x24xI", k, 0, counter, lut, sig, 1, 10**6, len(items), strands, 0x200)
    with open(f"{prefix}.kmc_pre", "wb") as f:
        f.write(b"KMCP" + starts.tobytes() + struct.pack("<Q", len(items)) + bytes(4 * (4**sig + 1)) + header + struct.pack("<I", len(header)) + b"KMCP")
    with open(f"{prefix}.kmc_suf", "wb") as f:
        f.write(b"KMCS" + b"".join(code(s[lut:]).to_bytes((k - lut) // 4, "big") + n.to_bytes(counter, "little") for s, n in items) + b"KMCS")


@pytest.mark.parametrize(("k", "lut", "counter"), [(9, 1, 1), (31, 3, 4)])
def test_kmc(spark, tmp_path, k, lut, counter):
    rng = random.Random(k)
    counts = {"".join(rng.choices("ACGT", k=k)): rng.randrange(1, 256**counter) for _ in range(300)} | {"T" * k: 255}
    write_kmc(f"{tmp_path}/t", counts, k, lut, counter)
    head = read_header(f"{tmp_path}/t")
    assert (head.k, head.counter_size, head.total, head.both_strands) == (k, counter, len(counts), True)
    assert {r.kmer: r.cnt for r in read_kmc(spark, f"{tmp_path}/t").collect()} == counts
    small = spark.read.format("kmc").option("taskRecords", 64).load(f"{tmp_path}/t")
    assert {r.kmer: r.cnt for r in small.collect()} == counts and small.rdd.getNumPartitions() > 4
    write_kmc(f"{tmp_path}/e", {}, k, lut, counter)
    assert read_kmc(spark, f"{tmp_path}/e").count() == 0


@pytest.fixture(scope="module")
def screened(spark, tmp_path_factory):
    """Tables of three samples, their cohort and its regions."""
    folder, rng = tmp_path_factory.mktemp("cmd"), random.Random(4)
    seqs = {c: "".join(rng.choices("ACGT", k=n)) for c, n in (("chrB", 900), ("chrA", 500))}

    def fasta(name, change):
        body = "".join(f">{c}\n" + "".join(rng.choice("ACGT") if rng.random() < change and i < 300 else b for i, b in enumerate(s)) + "\n" for c, s in seqs.items())
        return write(folder / f"{name}.fa", body)

    ref = fasta("ref", 0)
    samples = {n: fasta(n, x) for n, x in (("s1", 0), ("s2", 0.2), ("s3", 0.6))}
    C.pipeline(spark, ref, samples, f"{folder}/p", k=9, window=60)
    return str(folder), ref


def test_commands(spark, screened):
    folder, ref = screened
    cohort, regions = f"{folder}/p/cohort", f"{folder}/p/regions"
    head = table_header(spark, cohort)
    assert head.samples == ["s1", "s2", "s3"] and list(head.contigs) == ["chrB", "chrA"] and head.params["kmer"] == "9"
    rows = read_windows(spark, cohort, head).collect()
    assert len(rows) == 3 * int(head.params["nwindow"]) and all(abs(r.score - 100) < 1e-6 for r in rows if r.sample == "s1")
    assert [x.split("\t")[0] for x in lines(cohort) if not x.startswith("#")][0] == "chrB"
    found = read_windows(spark, regions).collect()
    assert {r.ibs for r in found if r.sample == "s1"} == {1, 2} and {r.ibs for r in found if r.sample == "s3" and r.start < 200} == {-1}
    summary = read_summary(spark, f"{regions}.summary").collect()
    assert {(r.Sample, r.Chromosome, r.Block) for r in summary if r.Sample == "s1"} == {("s1", "chrB", 1), ("s1", "chrA", 2)}
    assert all(r.Length == r.End - r.Start for r in summary)

    C.split_table(spark, cohort, f"{folder}/split")
    assert {r.chrom for r in read_windows(spark, f"{folder}/split/chrA").collect()} == {"chrA"}
    C.rescore_table(spark, cohort, f"{folder}/re", (0.5, 0.2, 0.3))
    assert table_header(spark, f"{folder}/re").weights == (0.5, 0.2, 0.3)
    C.widen_windows(spark, cohort, f"{folder}/wide", 120)
    wide = read_windows(spark, f"{folder}/wide").collect()
    assert sum(r.ob for r in wide) == sum(r.ob for r in rows) and sum(r.total_kmers for r in wide) == sum(r.total_kmers for r in rows)
    C.write_attributes(spark, cohort, f"{folder}/attr", ["obs", "winlen"])
    assert lines(f"{folder}/attr.obs.tsv")[0] == "window_id\ts1\ts2\ts3" and lines(f"{folder}/attr.winlen.tsv")[0] == "window_id\twindow_length"
    C.write_samples(spark, cohort, f"{folder}/samples", "s2")
    assert [x.rsplit("/", 1)[1] for x in glob.glob(f"{folder}/samples/sample=*")] == ["sample=s2"]
    C.to_genotypes(spark, cohort, f"{folder}/gt")
    gt = lines(f"{folder}/gt.genotypes")
    assert gt[0] == "ID\tCHR\tSTART\tEND\ts1\ts2\ts3" and len(gt) == 1 + int(head.params["nwindow"])
    C.to_plink(spark, cohort, f"{folder}/pl", maf=0.05, max_missing=1)
    ped, marks = lines(f"{folder}/pl.ped"), lines(f"{folder}/pl.map")
    assert len(ped) == 3 and all(len(x.split("\t")) == 6 + 2 * len(marks) for x in ped) and marks
    C.to_matrix(spark, cohort, f"{folder}/mx", maf=0.05, max_missing=1)
    assert all(len(x.split("\t")) == 1 + len(marks) for x in lines(f"{folder}/mx.matrix"))
    C.compare_region_tables(spark, ref, ref, f"{regions}.summary", f"{regions}.summary", count_kmers(read_fasta(spark, ref).select("contig", "seq"), 9, False), 9, f"{folder}/cmp")
    assert all(len(x.split("\t")) == 10 for x in lines(f"{folder}/cmp"))

    with pytest.raises(ValueError, match="more than one"):
        C.merge_cohort(spark, f"{folder}/x", [cohort, cohort])
    with pytest.raises(ValueError, match="differ in wti"):
        C.merge_cohort(spark, f"{folder}/x", [cohort, f"{folder}/re"])
    with pytest.raises(ValueError, match="not both"):
        C.merge_cohort(spark, f"{folder}/x")
    with pytest.raises(ValueError, match="no sample"):
        C.write_samples(spark, cohort, f"{folder}/x", "nobody")


def test_genes(spark, screened, tmp_path):
    folder, ref = screened
    gtf = write(tmp_path / "g.gtf", 'chrA\ts\tmRNA\t11\t200\t.\t+\t.\tgene_id "g"; transcript_id "t";\nchrA\ts\texon\t11\t80\t.\t+\t.\tgene_id "g"; transcript_id "t";\nchrA\ts\texon\t101\t200\t.\t+\t.\tgene_id "g"; transcript_id "t";\nchrA\ts\tgene\t300\t310\t.\t+\t.\tgene_id "bare";\n')
    C.screen_variations(spark, ref, f"{folder}/p/counts/s1", f"{tmp_path}/out", "a/b", feature="gene", gtf=gtf, k=9)
    rows = {r.win_id: r for r in read_windows(spark, f"{tmp_path}/out").collect()}
    assert rows["g"].total_kmers == 162 and (rows["g"].start, rows["g"].end) == (11, 200) and rows["bare"].total_kmers == 0
    assert table_header(spark, f"{tmp_path}/out").samples == ["a_b"]
    for bad in ({"feature": "exon"}, {"feature": "gene"}, {"window": 0}, {"window": 50, "min_count": 0}):
        with pytest.raises(ValueError):
            C.screen_variations(spark, ref, "t", "o", "s", k=9, **bad)


def test_small_tables(spark, tmp_path):
    assert sorted(r.chrom for r in read_list(spark, write(tmp_path / "l", "# x\nchr1\n\n chr2 \nchr1\n")).collect()) == ["chr1", "chr2"]
    gt = read_genotypes(spark, write(tmp_path / "g", "# Genotype\nID\tCHR\tSTART\tEND\ta\tb\nw\t1\t0\t9\t2\tN\n"))
    assert sorted((r.sample, r.allele) for r in gt.collect()) == [("a", 2), ("b", -1)]
    hm = read_hapmap(spark, write(tmp_path / "h", "\t".join(["rs#", "alleles", "chrom", "pos", *"defghij", "x"]) + "\n" + "\t".join(["m", "A/G", "1", "5", *"0000000", "G"]) + "\n"))
    assert [(r.ID, r.START, r.sample, r.call) for r in hm.collect()] == [("m", 5, "x", "G")]


def test_samples_must_agree_on_a_window(spark, tmp_path):
    schema = "chrom string, start int, end int, win_id string, sample_idx int, total_kmers int, eff_len int, ibs int, va int, ob int, id int, ld int, rd int, kd double, score double"
    head = Header(contigs={"c": 9}, samples=["s", "t"])
    rows = [("c", 0, 9, "w", i, 5, 9, -1, 0, 5, 0, 0, 0, 1.0, 100.0) for i in range(2)]
    write_windows(spark.createDataFrame(rows, schema), head, str(tmp_path / "ok"))
    assert read_windows(spark, str(tmp_path / "ok")).count() == 2
    rows[1] = ("c", 0, 9, "w", 1, 6, 9, -1, 0, 5, 0, 0, 0, 1.0, 100.0)
    for wrong, says in ((rows, "samples differ"), (rows[:1], "1 of 2 samples")):
        with pytest.raises(ValueError, match=says):
            write_windows(spark.createDataFrame(wrong, schema), head, str(tmp_path / "no"))


@pytest.fixture
def parts(spark):
    """Small tables are written in several parts too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda folder: sorted(glob.glob(f"{folder}/part-*"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fasta_in_parts(spark, tmp_path, parts):
    """No task writes or numbers a whole file: parts follow each other, and the index is that of all of them."""
    rng = random.Random(3)
    seqs = [(f"c{rng.random()}", "".join(rng.choices("ACGT", k=rng.choice([1, 59, 60, 61, 200]))), i) for i in range(80)]
    path = f"{tmp_path}/out put"
    write_fasta(spark.createDataFrame(rng.sample(seqs, 80), "contig string, seq string, ord int").repartition(3), path)
    files = parts(path)
    assert len(files) > 1
    data = "".join(open(f).read() for f in files)
    assert [x.split("\n")[0] for x in data.split(">")[1:]] == [c for c, _, _ in seqs]
    found = read_fasta(spark, path).collect()
    assert sorted((r.contig_idx, r.contig, r.seq) for r in found) == [(i, c, s) for c, s, i in seqs]
    index = fasta_index(spark, path).collect()
    assert [(r.name, r.length) for r in index] == [(c, len(s)) for c, s, _ in seqs]
    for r, (c, s, _) in zip(index, seqs):
        assert data[r.offset - len(c) - 2 : r.offset] == f">{c}\n" and data[r.offset : r.offset + r.line_bases] == s[:60] and r.line_width == r.line_bases + 1


def test_gtf_in_parts(spark, tmp_path, parts):
    rows = [("gene", f"g{i}", f"c{i % 5}", f"c{i % 5}", 7 * i + 1, 7 * i + 3, "+", i) for i in range(90)]
    path = f"{tmp_path}/out put"
    write_gtf(spark.createDataFrame(rows, "kind string, id string, parent string, chrom string, start int, end int, strand string, line_no long").repartition(3), path)
    assert len(parts(path)) > 1
    want = [r[1] for r in sorted(rows, key=lambda r: (r[3], r[4]))]
    assert [x.split('"')[1] for x in lines(path)] == want
    assert [r.gene_id for r in sorted(read_gtf(spark, path).collect(), key=lambda r: r.line_no)] == want


def test_windows_in_parts(spark, tmp_path, parts):
    head = Header("r.fa", {f"c{i * 37 % 101}": 10 * i for i in range(101)}, {"window": "10"}, ["q"], ["a", "b"])
    rows = [(c, 10 * j, 10 * j + 10, f"{c}_{j}", s, i, 5, 13, 4, 0, 1, 1, 0, -1, 4, 1.0, 80.0) for c in head.contigs for j in range(2) for i, s in enumerate("ab")]
    schema = "chrom string, start int, end int, win_id string, sample string, sample_idx int, total_kmers int, eff_len int, ob int, va int, id int, ld int, rd int, ibs int, kmer_count int, kd double, score double"
    path = f"{tmp_path}/out put"
    write_windows(spark.createDataFrame(random.Random(4).sample(rows, len(rows)), schema).repartition(3), head, path)
    assert len(parts(path)) > 1
    text = lines(path)
    assert [x.split("\t")[3] for x in text if x[0] != "#"] == [f"{c}_{j}" for c in head.contigs for j in range(2)]
    assert list(table_header(spark, path).contigs.items()) == list(head.contigs.items())
    found = sorted(read_windows(spark, path).collect(), key=lambda r: (r.win_ord, r.sample_idx))
    assert [(r.win_id, r.sample) for r in found] == [(r[3], r[4]) for r in rows]
