import pytest

from helixloom.__main__ import parser, run
from helixloom.sources.wintable import read_header, read_windows


def test_defaults():
    a = parser().parse_args("screen -r r -k t -o o -s s -f window -w 50".split())
    assert (a.min_k_count, a.step, a.wi, a.wt, a.wr) == (1, 0, 0.3, 0.3, 0.4)
    a = parser().parse_args("regions -i x -o y".split())
    assert (a.min, a.score, a.var, a.summary) == (4, 95, False, False)
    assert (parser().parse_args("genotypes -i x -o y".split()).maf, parser().parse_args("plink -i x -o y".split()).max_missing) == (0, 0.8)
    with pytest.raises(SystemExit):
        parser().parse_args("screen -r r".split())


def test_from_sequences_to_a_cohort(spark, tmp_path):
    fasta = tmp_path / "r.fa"
    fasta.write_text(">c\n" + "ACGTTGCAAGGCTTAACCGGATATCGCGTA" * 6 + "\n")
    run(spark, f"count -r {fasta} -k 9 -o {tmp_path}/counts".split())
    for s in ("a", "b"):
        run(spark, f"screen -r {fasta} -k {tmp_path}/counts --kmer-length 9 -s {s} -f window -w 40 -p 15 -o {tmp_path}/{s}".split())
    run(spark, f"cohort -i {tmp_path}/a,{tmp_path}/b -o {tmp_path}/both".split())
    run(spark, f"rescore -i {tmp_path}/both --wi 0.5 --wt 0.2 --wr 0.3 -o {tmp_path}/re".split())
    run(spark, f"regions -i {tmp_path}/re -o {tmp_path}/regions".split())
    head = read_header(spark, f"{tmp_path}/regions")
    assert head.samples == ["a", "b"] and head.params["step"] == "15" and head.params["IBS"] == "true"
    assert {r.ibs for r in read_windows(spark, f"{tmp_path}/regions").collect()} == {1}


def test_pipeline(spark, tmp_path):
    fasta = tmp_path / "r.fa"
    fasta.write_text(">c\n" + "ACGTTGCAAGGCTTAACCGGATATCGCGTA" * 6 + "\n")
    run(spark, f"pipeline -r {fasta} -s a={fasta},b={fasta} -k 9 -w 60 -o {tmp_path}/out".split())
    assert {r.score for r in read_windows(spark, f"{tmp_path}/out/cohort").collect()} == {100.0}
