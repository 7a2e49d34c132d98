"""Regions, wider windows, and streams."""

import random

from helixloom.operators.ibs import label_regions, summarize_regions
from helixloom.operators.rewindow import widen
from helixloom.streaming.stateless import called, rescored, split_stream, window_stream


def table(spark, seed=1, n=60):
    rng = random.Random(seed)
    rows = [(s, c, i, i * 10, i * 10 + 10, f"{c}_{i}", rng.choice([50.0, 96.0, 99.5]), 20, rng.randrange(21), rng.randrange(4), rng.randrange(5), rng.choice([0, 2]), rng.choice([0, 3]), rng.random() * 9, 18) for s in ("x", "y") for c in ("c2", "c10") for i in range(n)]
    return rows, spark.createDataFrame(rows, "sample string, chrom string, win_ord int, start int, end int, win_id string, score double, total_kmers int, ob int, va int, id int, ld int, rd int, kd double, eff_len int")


def test_regions_are_numbered_through_the_sample(spark):
    rows, df = table(spark)
    order = spark.createDataFrame([("c10", 0), ("c2", 1)], "chrom string, contig_idx int")
    got = {(r.sample, r.win_id): r.ibs for r in label_regions(df, order, 95, 1).collect()}
    blocks = {}
    for s in ("x", "y"):
        block = 0
        for c in ("c10", "c2"):
            none = None
            for r in [r for r in rows if r[0] == s and r[1] == c]:
                if r[6] >= 95:
                    if none is None or none > 1:
                        block += 1
                    none = 0
                    assert got[s, r[5]] == block
                    blocks.setdefault((s, block), []).append(r)
                else:
                    none = None if none is None else none + 1
                    assert got[s, r[5]] == -1
    summary = {(r.sample, r.block): r for r in summarize_regions(label_regions(df, order, 95, 1)).collect()}
    assert set(summary) == set(blocks)
    for key, members in blocks.items():
        r = summary[key]
        assert (r.start, r.end, r.ibs_blocks, r.total_blocks) == (members[0][3], members[-1][4], len(members), members[-1][2] - members[0][2] + 1)


def test_widen(spark):
    rows, df = table(spark, 2)
    got = {(r.sample, r.chrom, r.start): r for r in widen(df, 7).collect()}
    for s in ("x", "y"):
        for c in ("c2", "c10"):
            own = [r for r in rows if r[0] == s and r[1] == c]
            for i in range(0, len(own), 7):
                b = own[i : i + 7]
                r, kt = got[s, c, b[0][3]], 0
                for w in b:
                    kt = int(kt + w[13] * w[8])
                assert r.va == sum(w[9] for w in b) - sum(b[j - 1][12] > 0 and b[j][11] > 0 and b[j][9] > 0 for j in range(1, len(b)))
                assert (r.ld, r.rd, r.ob, r.kmer_count) == (b[0][11], b[-1][12], sum(w[8] for w in b), kt)
                assert r.id == sum(w[10] + w[11] + w[12] for w in b) - r.ld - r.rd and r.eff_len == b[-1][4] - b[0][3]


def test_streams(spark, tmp_path):
    _, df = table(spark, 3)
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = called(rescored(window_stream(spark, f"{tmp_path}/in", 1), (0.5, 0.2, 0.3)))
    split_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").where("chrom = 'c2'").count() == 120
