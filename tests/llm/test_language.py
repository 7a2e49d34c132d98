import random
import zlib

from pyspark.sql import functions as F

from helixloom.llm.language import Classifier, fit, held_out, predict, train_part, with_known_language

SYLLABLES = {"xa": "ba ko li tu re", "xb": "sch ung ver äu ost", "xc": "ño ci rra que ll"}


def text(lang, n, seed):
    rng = random.Random(seed)
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(n))


def docs(spark):
    rows = [(i, text(lang, 5 + i % 90, i), lang, "x", 0.5) for i in range(600) for lang in [list(SYLLABLES)[i % 3]]]
    rows += [(1000, None, "xa", "x", 1.0), (1001, "", None, "x", 1.0), (1002, "123 !? 4", "xb", "x", 1.0), (1003, text("xb", 30_000, 1), None, "x", 1.0), (None, text("xa", 50, 3), None, None, None), (5, text("xc", 40, 5), None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")


def test_held_out_accuracy_and_edges(spark):
    table = docs(spark)
    split = {r.doc_id: r.h for r in table.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, h in split.items())
    contents = fit(train_part(table))
    assert sorted(contents) == sorted(SYLLABLES)
    got = predict(table, contents).collect()
    assert len(got) == table.count()
    by = {r.doc_id: r for r in got}
    test = [i for i in range(600) if split[i] and i != 5]
    assert sum(by[i].lang_pred == list(SYLLABLES)[i % 3] for i in test) >= 0.97 * len(test)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "xb", "xa"]
    assert by[1000].rejected and all(0 <= r.score <= 1 for r in got)
    kept = with_known_language(table, contents)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.rejected)


def test_sample_is_bounded_and_repeatable(spark):
    a = fit(train_part(docs(spark)), sample_docs=20, piece_bytes=50)
    b = fit(train_part(docs(spark).repartition(5)), sample_docs=20, piece_bytes=50)
    assert a == b
    assert all(len(x) <= 20 * 51 * 2 for x in a.values())


def test_nothing_to_learn_from(spark):
    empty = docs(spark).limit(0)
    assert fit(empty) == {} and predict(empty, {}).count() == 0
    assert Classifier({}).classify("some words") == ("und", 0.0, True)
    assert Classifier({"xa": b"some words"}).classify("words") == ("xa", 1.0, False)
