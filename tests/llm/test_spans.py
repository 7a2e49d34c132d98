import random

from hypothesis import given, settings
from hypothesis import strategies as st

from helixloom.llm.spans import runs, sentences, span_dedup

WORDS = st.lists(st.text("ab .!?,\n ", max_size=60), max_size=3).map("x".join)


@settings(max_examples=200, deadline=None)
@given(WORDS)
def test_sentences_hold_all_words_in_order(text):
    cut = sentences(text, 4)
    assert [w for _, _, ws in cut for w in ws] == text.lower().split()
    assert all(a < b for a, b, _ in cut) and all(x[1] <= y[0] for x, y in zip(cut, cut[1:]))
    assert all(text[a:b].lower().split() == ws and len(ws) <= 4 for a, b, ws in cut)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=12), st.integers(1, 3), st.integers(1, 15))
def test_runs_are_the_shortest(counts, least, words):
    n, want = len(counts), set()
    for a in range(n):
        ends = [b for b in range(a + least, n + 1) if sum(counts[a:b]) >= words]
        want |= {(a, ends[0])} if ends else set()
    for b in range(1, n + 1):
        starts = [a for a in range(0, b - least + 1) if sum(counts[a:b]) >= words]
        want |= {(starts[-1], b)} if starts else set()
    assert set(runs(counts, least, words)) == want


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 14))).capitalize() + "." for _ in range(n))


def brute(rows, least=2, words=24):
    """Everything by lists of words, document after document."""
    from helixloom.llm.spans import remove
    cuts = {k: sentences(t) for k, (_, t) in enumerate(rows) if t}
    holders, out = {}, []
    for k, cut in cuts.items():
        for a, b in runs([len(c[2]) for c in cut], least, words):
            holders.setdefault(tuple(w for c in cut[a:b] for w in c[2]), set()).add(float("inf") if rows[k][0] is None else rows[k][0])
    for k, (i, t) in enumerate(rows):
        if not t:
            out.append((i, t, 0))
            continue
        cut, gone, own = cuts[k], set(), {}
        for a, b in runs([len(c[2]) for c in cut], least, words):
            key = tuple(w for c in cut[a:b] for w in c[2])
            if min(holders[key]) < (float("inf") if i is None else i) or own.setdefault(key, (a, b))[1] <= a:
                gone |= set(range(a, b))
        out.append((i, remove(t, [x in gone for x in range(len(cut))], cut), len(gone)))
    return out


def test_span_dedup(spark):
    passage, single = prose(1, 9), "One endless sentence " + " ".join(f"v{i}" for i in range(60)) + ", and then some."
    rows = [(3, prose(2, 5) + "\n" + passage + "\n" + prose(3, 5)), (1, passage.upper() + " " + prose(4, 6)), (7, prose(5, 4) + " " + passage), (8, prose(6, 8)), (9, None), (10, ""), (11, "Ha. Ou. Er."), (12, "Ha. Ou. Er. " + prose(7, 3)), (13, single), (14, prose(8, 3) + " " + single + " " + prose(9, 3)), (15, passage + " " + passage), (15, passage + " " + passage), (16, "x. " * 30_000), (None, passage), (20, prose(10, 4) + "\n\n\n" + prose(11, 2))]
    table = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, spans string, a int")
    got = span_dedup(table).collect()
    assert sorted((str(r.doc_id), r.text, r.sentences_removed) for r in got if r.text) == sorted((str(i), t, n) for i, t, n in brute(rows) if t)
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].sentences_removed == 0 and by[9].text is None and by[10].text == ""
    assert by[3].text.split() == (prose(2, 5) + " " + prose(3, 5)).split()
    assert by[14].text.split() == (prose(8, 3) + " " + prose(9, 3)).split() and by[14].first_ids == [13]
    assert by[12].sentences_removed == 0 and by[20].text.count("\n") == 3
    assert span_dedup(table.limit(0)).count() == 0


def test_passages_that_begin_inside_a_long_clause():
    """Of a passage put at any word of two texts without punctuation, most words lie in spans that both have."""
    rng = random.Random(6)
    for _ in range(60):
        passage, texts = [f"p{rng.randrange(10**6)}" for _ in range(60)], []
        for _ in range(2):
            words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
            at = rng.randrange(100)
            texts.append(" ".join(words[:at] + passage + words[at:]))
        held = []
        for t in texts:
            cut = [w for _, _, w in sentences(t)]
            held.append({tuple(w for c in cut[a:b] for w in c) for a, b in runs([len(c) for c in cut], 2, 24)})
        assert len({w for span in held[0] & held[1] for w in span}) >= 30
