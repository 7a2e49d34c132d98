"""The fold, windows and k-mers against sequential statements of the rules."""

import random

import pytest

from helixloom.functions import metrics as M
from helixloom.functions import sequence as S
from helixloom.operators import kmers as KM
from helixloom.operators import windows as W
from helixloom.operators.rewindow import bucket_size
from helixloom.plans.screening import screen

K = 5


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def dist(gap, k):
    d = gap - (k - 1)
    return d if d > 0 else abs(d + 1)


def fold(seq, counts, k, c, weights=(0.3, 0.3, 0.4)):
    total = ob = va = inner = ld = kc = gap = 0
    hit_before, runs, last = False, 0, None
    for p in range(len(seq) - k + 1):
        kmer = seq[p : p + k]
        if not set(kmer) <= set("ACGT"):
            continue
        total += 1
        runs += last is None or p != last + 1
        last = p
        n = counts.get(min(kmer, rc(kmer)), 0)
        if n < c:
            gap += 1
            continue
        ob += 1
        kc += n
        if gap:
            va += 1
            if hit_before:
                inner += dist(gap, k)
            else:
                ld = gap
        hit_before, gap = True, 0
    va += gap > 0
    eff = total + (k - 1) * runs
    score = 0.0
    if ob and total and eff:
        wi, wt, wr = weights
        score = ((wr * (ob / total)) + (wi * (1 - inner / eff)) + (wt * (1 - (ld + gap) / eff))) * 100
    return total, ob, va, inner, ld, gap, kc, eff, score


def sequences(seed, n):
    rng = random.Random(seed)
    out = {f"c{i}": "".join(rng.choices("ACGTN", [5, 5, 5, 5, 1], k=rng.choice([0, 3, K, 30, 31, 200]))) for i in range(n)}
    return out | {"only_n": "N" * 50, "poly": "A" * 80, "exact": "ACGTACGTAC" * 3, "lower": "acgtacgtacgtnacgtt"}


@pytest.mark.parametrize(("step", "c"), [(0, 1), (0, 3), (7, 1), (40, 2)])
def test_screen(spark, step, c):
    seqs, window = sequences(1, 25), 30
    table = {}
    for s in sequences(2, 12).values():
        for p in range(len(s) - K + 1):
            if set(s[p : p + K]) <= set("ACGT"):
                x = min(s[p : p + K], rc(s[p : p + K]))
                table[x] = table.get(x, 0) + 1
    contigs = spark.createDataFrame(list(seqs.items()), "contig string, seq string")
    counts = spark.createDataFrame(list(table.items()), "kmer string, cnt long")
    got = {(r.contig, r.start, r.end): (r.total_kmers, r.ob, r.va, r.id, r.ld, r.rd, r.kmer_count, r.eff_len, r.score) for r in screen(contigs, counts, K, window, step, c, chunk=16).collect()}
    want = {}
    for name, s in seqs.items():
        s, at = s.upper(), 0
        while at < len(s):
            end = min(at + window, len(s))
            if end - at >= K:
                want[name, at, end] = fold(s[at:end], table, K, c)
            if step == 0 and end == len(s):
                break
            at += step or window - K + 1
    assert got == want


def test_a_sample_that_is_the_reference_scores_100(spark):
    s = "".join(random.Random(3).choices("ACGT", k=600))
    contigs = spark.createDataFrame([("c", s)], "contig string, seq string")
    for r in screen(contigs, KM.count_kmers(contigs, 9), 9, 100).collect():
        assert (r.ob, r.va, r.id, r.ld, r.rd) == (r.total_kmers, 0, 0, 0, 0) and abs(r.score - 100) < 1e-9
    for r in screen(contigs, KM.count_kmers(contigs, 9).limit(0), 9, 100).collect():
        assert (r.ob, r.va, r.rd, r.score) == (0, 1, r.total_kmers, 0.0)


def test_tiles(spark):
    lengths = spark.createDataFrame([("a", 20000), ("b", 5010), ("c", 5000), ("d", 30)], "contig string, length int")
    got = sorted((r.contig, r.start, r.end) for r in W.tiles(lengths, 5000, 31).collect())
    assert got == [("a", i * 4970, min(i * 4970 + 5000, 20000)) for i in range(4)] + [("a", 19880, 20000), ("b", 0, 5000), ("b", 4970, 5010), ("c", 0, 5000)]
    with pytest.raises(ValueError):
        W.tiles(lengths, 20, 31)


def test_kmer_functions(spark):
    df = spark.createDataFrame([("ACGTACGTA",), ("TTTTTTTTT",)], "k string")
    code = S.pack(df.k)
    rows = df.select(df.k, code.alias("c"), S.unpack(code, 9).alias("u"), S.revcomp(S.revcomp(df.k)).alias("r"), (S.canonical(df.k) == S.canonical(S.revcomp(df.k))).alias("same")).collect()
    assert all(r.u == r.k == r.r and r.same for r in rows) and rows[1].c == 4**9 - 1
    long = spark.createDataFrame([(("ACGT" * 8)[:31],)], "k string")
    assert long.select(S.unpack(S.pack(long.k), 31).alias("u")).first().u == ("ACGT" * 8)[:31]
    text = spark.createDataFrame([("Aé b\nZ",)], "t string")
    assert text.select(S.pseudo_sequence(text.t)).first()[0] == "ANCC"
    assert spark.createDataFrame([("x" * 125,)], "s string").select(S.fold_lines("s")).first()[0].split("\n") == ["x" * 60, "x" * 60, "x" * 5]
    assert spark.createDataFrame([('a/b:c*"d|e',)], "s string").select(S.sanitize("s")).first()[0] == "a_b_c__d_e"


def test_gap_distance_and_weights(spark):
    gaps = {1: 28, 2: 27, 28: 1, 29: 0, 30: 1, 31: 1, 32: 2, 60: 30}
    df = spark.createDataFrame([(g,) for g in gaps], "g int")
    assert {r.g: r.d for r in df.select("g", M.gap_distance(df.g, 31).alias("d")).collect()} == gaps
    M.check_weights((0.7, 0.2, 0.1))
    for bad in ((0.5, 0.5, 0.5), (1.2, -0.2, 0)):
        with pytest.raises(ValueError):
            M.check_weights(bad)
    assert M.check_thresholds(95, 0, 30) == (95, 0, 0)
    for bad in ((60, 95, 30), (95, 20, 30), (101, 60, 30)):
        with pytest.raises(ValueError):
            M.check_thresholds(*bad)
    assert bucket_size(1000, 5000) == 6
    for bad in ((1000, 900), (0, 10)):
        with pytest.raises(ValueError):
            bucket_size(*bad)
    with pytest.raises(ValueError):
        bucket_size(1000, 5000, step=10)
