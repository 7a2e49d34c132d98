import hashlib
import re
from collections import Counter, defaultdict

from helixloom.llm.exact_dedup import directory, exact_dedup
from helixloom.llm.licences import LICENCES, license_scan
from helixloom.llm.mixing import apportion, mix, mixed_documents, sized, targets

DOCS = "doc_id long, text string, source string, size string, norm string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], DOCS)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((i, t or ""))
    out = Counter()
    for norm, found in groups.items():
        best = min(found, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        left = True
        for r in sorted(found, key=lambda r: r != best):
            out[r[0], best[0], len(found), r == best and left, hashlib.sha256(norm.encode()).hexdigest()] += 1
            left = left and r != best
    return out


def test_exact_dedup(spark):
    rows = [(1, "a b", "x"), (2, "ab", None), (3, "a  b", "x"), (4, "a\x0bb ", "y"), (5, None, "y"), (6, "", "y"), (7, " \n", "z"), (None, "a  b", "z"), (8, "a b", "z"), (9, "Z", "z"), (9, "Z", "z"), (-3, "é" * 5000, "z")]
    rows += [(100 + i, "copy of copies", "hot") for i in range(300)]
    got = Counter(tuple(r)[:5] for r in exact_dedup(docs(spark, rows), bucket_keys=2, max_depth=4).collect())
    assert got == brute_exact(rows)
    assert exact_dedup(docs(spark, [])).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    hashes = spark.range(500).selectExpr("xxhash64(id) h")
    slots = directory(hashes, bucket_keys=40, max_depth=6).collect()
    h = [r.h % 2**64 >> 58 for r in hashes.collect()]
    by = {r.slot: r for r in slots}
    for r in slots:
        held = lambda d: sum((x >> 6 - d) == (r.slot >> 6 - d) for x in h)
        assert held(r.local_depth) <= 40 or r.local_depth == 6
        assert r.local_depth == 0 or held(r.local_depth - 1) > 40
        assert r.bucket == r.slot >> 6 - r.local_depth << 6 - r.local_depth
    assert set(h) == set(by)


def brute_seats(votes, n):
    seats = [0] * len(votes)
    for _ in range(n):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    return seats


def test_apportion_is_highest_quotients(spark):
    groups = {"a": ([53.0, 24.0, 23.0, 0.0], 7), "b": ([1.0, 1.0, 1.0, 1.0], 2), "c": ([1000.0, 3.0, 2.0, 0.5, 77.7], 401), "d": ([5.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], 3)}
    items = spark.createDataFrame([(g, i, v, n) for g, (vs, n) in groups.items() for i, v in enumerate(vs)], "g string, i int, v double, n long")
    got = {(r.g, r.i): r.s for r in apportion(items, ["g"], ["i"], "v", "n", "s").collect()}
    for g, (vs, n) in groups.items():
        assert [got[g, i] for i in range(len(vs))] == brute_seats(vs, n), g


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in done]
        level = (total - sum(done.values())) / max(sum(w[s] for s in rest), 1e-300)
        over = [s for s in rest if level * w[s] > cap * sizes[s]]
        if not over:
            return done | {s: level * w[s] for s in rest}
        done |= {s: float(cap * sizes[s]) for s in over}


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, None: 40, "é": 300, "Z": 0, "zz": 7}
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    for s, t in brute_targets(sizes).items():
        assert abs(got[s] - t) < 1e-6, s


def test_mix(spark):
    rows = [(i, "w " * (i % 97), f"s{i % 5}") for i in range(900)] + [(5000, "long " * 30_000, "s1"), (5001, None, None), (5002, "a b c", None)]
    rows += [(7000, "same row again", "hot")] * 2000
    table = docs(spark, rows)
    got = mix(sized(table), shard_words=2048).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    for s in size:
        assert abs(taken[s] - target[s]) <= max(64, 0.02 * target[s]), (s, taken[s], target[s])
    again = mix(sized(table.repartition(3)), shard_words=2048).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix(sized(docs(spark, []))).count() == 0


def test_mixed_documents_keep_their_columns(spark):
    table = docs(spark, [(i, f"some words of document {i}", "ab"[i % 2]) for i in range(200)])
    out = mixed_documents(table)
    assert out.columns == [*table.columns, "mix_taken", "mix_rounds"]
    assert all(r.norm == "y" and r.mix_taken > 0 for r in out.collect())


def test_license_scan(spark):
    mit = LICENCES[0][1]
    rows = [(1, mit, ""), (2, "Copyright (c) 2020 Some Body\n\n" + mit.upper().replace(" ", "  "), ""), (3, mit + " more", ""), (4, None, ""), (5, "", ""), (6, "released under THE mit licence", ""), (7, "x " * 50_000, ""), (1, mit, "")]
    got = sorted((r.doc_id, r.license_id) for r in license_scan(docs(spark, rows)).collect())
    assert got == [(1, "MIT"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "MIT"), (7, None)]
    assert license_scan(docs(spark, [])).count() == 0
