import numpy as np
import pytest
import xxhash

from helixloom.llm import bktree
from helixloom.llm.components import components
from helixloom.llm.simhash import block_keys, fingerprints, links, near_dedup, shingle_hashes, similar_documents, without_similar


def brute_print(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(n, pairs):
    label = list(range(n))
    def top(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in pairs:
        x, y = top(a), top(b)
        label[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]


def near(n, centres, flips, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        base = base ^ np.where(rng.random(n) < 0.7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(base)


@pytest.mark.parametrize("radius", [0, 2, 13])
def test_trees_find_every_pair(radius):
    fp = near(400, 5, 4, radius)
    root = np.sort(np.random.default_rng(1).integers(0, 3, len(fp)))
    root = np.searchsorted(root, root)
    got = {(int(a), int(b)) for q, n in bktree.search(fp, root, radius) for a, b in zip(q, n)}
    want = {(i, j) for i in range(len(fp)) for j in range(i) if root[i] == root[j] and int(fp[i] ^ fp[j]).bit_count() <= radius}
    assert got == want
    assert bktree.groups(fp, root, radius).tolist() == brute_groups(len(fp), want)


def test_open_pairs_are_bounded(monkeypatch):
    monkeypatch.setattr(bktree, "_FRONT", 7)
    fp = near(150, 1, 3, 9)
    root = np.zeros(len(fp), np.int64)
    got = {(int(a), int(b)) for q, n in bktree.search(fp, root, 3) for a, b in zip(q, n)}
    assert got == {(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 3}


@pytest.mark.parametrize("limit", [8192, 5])
def test_links_with_large_shards(spark, limit):
    fp = near(300, 8, 3, 3)
    items = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    edges = links(block_keys(items), 2, limit)
    got = {r.node: r.root for r in components(edges).collect()}
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    want = brute_groups(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 2])
    same = {}
    for x, i in at.items():
        same.setdefault(want[i], set()).add(got.get(x, x))
    assert all(len(s) == 1 for s in same.values()) and len({next(iter(s)) for s in same.values()}) == len(same)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7000, 7000), (-5, 9000), (9000, -5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {-5: -5, 9000: -5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = ["The cat  sat", "the CAT sat", "the cat sat on", "É la", "é la", "one", "", None, " \n\x0b", "a " * 40_000, "x y z " * 300, "  a b"]


def test_near_dedup(spark):
    base = " ".join(f"w{i * 7 % 1000}" for i in range(3000))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, base), (51, base + " more"), (52, "start " + base), (53, base.replace("w7 ", "q ", 1)), (54, base), (54, base), (None, "one")]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, component_id int")
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in near_dedup(table).collect()]
    assert len(got) == len(rows)
    prints = [brute_print(t, 3) for _, t in rows]
    label = brute_groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {}
    for (i, _), g in zip(rows, label):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = [(i, p, least[g]) for (i, _), p, g in zip(rows, prints, label)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert near_dedup(table.limit(0)).count() == 0


def test_similar_documents(spark):
    words = [f"w{i}" for i in range(400)]
    def but(*at):
        return " ".join("changed" if i in at else w for i, w in enumerate(words))
    rows = [(1, but()), (2, but(10)), (3, but(100, 200)), (4, but(50, 51, 300)), (5, " ".join(f"v{i}" for i in range(400))), (6, ""), (7, None)]
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}


def test_hashes_of_long_text_do_not_depend_on_slices(spark, monkeypatch):
    from helixloom.llm import simhash

    text = " ".join(f"t{i % 911}" for i in range(5000))
    monkeypatch.setattr(simhash, "_AT_ONCE", 100)
    counts = simhash._Counts(2, 3)
    counts.add(1, shingle_hashes(text.encode(), 3))
    assert counts.fingerprints().tolist() == [0, brute_print(text, 3)]
    assert fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string"), words=5).first().fp % 2**64 == brute_print(text, 5)


def test_without_similar_keeps_one_row_of_each_component(spark):
    """Null ids, ids that repeat and equal rows: one row stays of each component, by id first."""
    a = " ".join(f"alpha{i}" for i in range(60))
    b, c = " ".join(f"beta{i}" for i in range(50)), " ".join(f"gamma{i}" for i in range(50))
    rows = [(1, a), (None, a + " more"), (None, b), (None, b), (7, c), (7, c + " end"), (7, "other words of the same id stand here"), (9, None), (3, ""), (None, None)]
    table = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, _row int, root string")
    got = without_similar(table)
    assert got.columns == table.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    sevens = [x for x in left if x[0] == 7]
    assert len(sevens) == 2 and (7, rows[6][1]) in sevens
    assert sorted((x for x in left if x[0] != 7), key=str) == sorted([(1, a), (None, b), (3, "")], key=str)
    assert without_similar(table.limit(0)).count() == 0
