import random
import time
import tracemalloc

import numpy as np

from helixloom.llm.decontaminate import Matcher, leaks, tile, without_leaks


def brute_tiles(doc, item, least):
    used_d, used_i, out = set(), set(), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and i + k not in used_d and j + k not in used_i:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return out
        i, j, k = best
        used_d |= set(range(i, i + k))
        used_i |= set(range(j, j + k))
        out.append(best)


def test_tiles_are_greedy():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
        doc = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
        if item and rng.random() < 0.7:
            a = rng.randrange(len(item))
            doc = doc[:5] + item[a:] + doc[5:9] + item[:a] + doc[9:]
        got = tile(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        want = brute_tiles(doc, item, 3)
        assert sorted(t[2] for t in got) == sorted(t[2] for t in want)
        assert sum(t[2] for t in got) == sum(t[2] for t in want)
        used = [set(), set()]
        for i, j, k in got:
            assert doc[i : i + k] == item[j : j + k]
            for taken, at in zip(used, (i, j)):
                assert not taken & set(range(at, at + k))
                taken |= set(range(at, at + k))


def test_repeated_words_take_time_and_memory_by_length():
    n = 1_000_000
    one, mixed = "word " * n, "a b word word word c " * (n // 6)
    items = [(1, "word " * 200), (2, "word word word word x word word word y " * 20), (3, ("a b word word word c " * 3 + "x ") * 10)]
    matcher = Matcher(items, 4, 0.7)
    for text, want in ((one, {1}), (mixed, {3})):
        tracemalloc.start()
        began = time.process_time()
        found = matcher.leaks(text)
        took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert {f[0] for f in found} == want and took < 60 and peak < 300e6, (found, took, peak)


def test_short_items_are_whole_lines():
    m = Matcher([(1, "Yes."), (2, "one two"), (3, ITEM)], 4, 0.7)
    assert m.leaks("one two three\nyes, one") == []
    assert sorted(m.leaks("a line\nYES!\nOne, two.\n" + ITEM)) == [(1, 1.0, 1, 1), (2, 1.0, 1, 2), (3, 1.0, 1, 22)]


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards boil green tea near an old stone bridge at dawn"


def docs(spark):
    w = ITEM.split()
    filler = " ".join(f"filler{i}" for i in range(300))
    rows = [(1, f"{filler} {ITEM}. {filler}"), (2, f"{filler} {' '.join(w[12:])} {filler} {' '.join(w[:12])}"), (3, filler), (4, None), (5, ""), (6, ITEM.upper().replace(" ", ",\n")), (7, " ".join(w[:9])), (8, " ".join(w[::-1])), (9, "long " * 60_000 + ITEM), (1, f"{filler} {ITEM}. {filler}")]
    return spark.createDataFrame([(i, t, i, i) for i, t in rows], "doc_id long, text string, item_id long, coverage long")


def test_leaks(spark):
    bench = spark.createDataFrame([(10, ITEM), (11, "never seen words in any of these documents here"), (12, None), (13, "too short"), (10, ITEM)], "item_id long, text string")
    for tokens in (2_000_000, 20):
        got = sorted((r.doc_id, r.item_id, r.coverage) for r in leaks(docs(spark), bench, block_tokens=tokens).collect())
        assert got == [(1, 10, 1.0), (1, 10, 1.0), (2, 10, 1.0), (6, 10, 1.0), (9, 10, 1.0)]
        left = without_leaks(docs(spark), bench, block_tokens=tokens)
        assert left.columns == ["doc_id", "text", "item_id", "coverage"]
        assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7, 8]
    assert leaks(docs(spark), bench.limit(0)).count() == 0
    assert leaks(docs(spark).limit(0), bench).count() == 0


def test_reordered_and_partial_coverage():
    w = ITEM.split()
    m = Matcher([(1, ITEM)], 4, 0.7)
    assert m.leaks(" ".join(w[16:] + ["x"] + w[8:16] + ["y"] + w[:8]))[0][:3] == (1, 1.0, 3)
    assert m.leaks(" ".join(w[:10])) == []
