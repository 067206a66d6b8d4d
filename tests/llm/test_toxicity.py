import math
import random
import zlib

import numpy as np
import pytest

from ownergraph.llm import toxicity


def test_shared_orders_and_own_top():
    ordinary = {g: 3 for g in toxicity.grams_of("house")}
    toxic = {g: 2 for g in toxicity.grams_of("idiot")}
    ratio = toxicity.kneser_ney(ordinary, toxic)
    word = toxicity.Evidence(ratio)
    assert word["idiot"] > 3 / toxicity.SPAN and word["house"] < -3 / toxicity.SPAN and word["idiots"] > 0
    assert word["zzz"] == pytest.approx(ratio["\x02" * 4] / toxicity.SPAN)  # nothing but the start is known, and it is shared


def test_equal_classes_tell_nothing():
    rnd = random.Random(1)
    counts = [{}, {}]
    for c in counts:
        for _ in range(300):
            for g in toxicity.grams_of("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 7)))):
                c[g] = c.get(g, 0) + 1
    ratio = toxicity.kneser_ney(*counts)
    same = toxicity.kneser_ney(counts[0], dict(counts[0]))
    assert all(abs(v) < 1e-12 for v in same.values())
    assert any(v > 0 for v in ratio.values()) and any(v < 0 for v in ratio.values())


def test_logistic_separates():
    rnd = np.random.default_rng(1)
    x = np.r_[rnd.normal(0, 1, (500, 2)), rnd.normal(3, 1, (100, 2))]
    fitted = toxicity.logistic(x, np.r_[np.zeros(500), np.ones(100)])
    assert toxicity.curve(fitted, (4.0, 4.0)) > 0.95 > 0.05 > toxicity.curve(fitted, (-1.0, -1.0))


def corpus(n=600):
    rnd = random.Random(2)
    plain = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(5, 200))]
        bad = i % 7 == 0
        if bad:
            for _ in range(rnd.randrange(1, 4)):
                words.insert(rnd.randrange(len(words)), "zwork" + rnd.choice(["s", "y", "ing", "ed"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (-1, None), (-2, ""), (None, "aei"), (0, rows[0][1])], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS fold")
    known = spark.createDataFrame([*labels, (1, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) + 4
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.predicted == 0 for r in got if r.doc_id in (-1, -2))
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, known).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    one, two = (toxicity.score_toxicity(docs, toxicity.fit(docs, spark.createDataFrame(x, schema))).orderBy("doc_id").collect() for x in (labels, turned))
    assert all(math.isclose(a.score, b.score, rel_tol=1e-9) for a, b in zip(one, two, strict=True))


def test_the_score_is_monotone_in_the_length_normalised_ratio(spark):
    """And the ratio is that of the plain form, word by word."""
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    counted = toxicity.count_grams(toxicity.labelled(docs, known)).collect()
    ratio = toxicity.kneser_ney(*({r.gram: n for r in counted if (n := sum(r[f"n{f}{y}"] for f in "02"))} for y in (0, 1)))

    def plain(text):
        best = 0.0
        for word in toxicity.words_of(text):
            grams = list(toxicity.grams_of(word))
            best = max(best, sum(ratio[g] if g in ratio else ratio.get(g[:-1], 0.0) for g in grams) / max(toxicity.SPAN, len(grams)))
        return best

    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    pairs = sorted((plain(t), scores[i]) for i, t in rows)
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(pairs, pairs[1:], strict=False)) and pairs[0][1] < 0.1 < 0.9 < pairs[-1][1]
    assert all(s == pytest.approx(toxicity.curve(model.fitted, (x,)), rel=1e-9) for x, s in pairs)


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(0, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, none) == 0.0
    assert [r.score for r in toxicity.score_toxicity(docs, 0.0).collect()] == [0.0, 0.0]
    assert toxicity.fit(docs.limit(0), none) == 0.0 and toxicity.score_toxicity(docs.limit(0), 0.0).count() == 0


def test_no_score_depends_on_what_tasks_hold(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    every, some, none = (toxicity.score_toxicity(docs, toxicity.fit(docs, known, max_grams=n)).orderBy("doc_id").collect() for n in (10**6, 300, 0))
    for a, b, c in zip(every, some, none, strict=True):
        assert a.doc_id == b.doc_id == c.doc_id and a.score == pytest.approx(b.score, rel=1e-9) and a.score == pytest.approx(c.score, rel=1e-9)


def test_ratios_against_the_plain_form(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grams = toxicity.count_grams(toxicity.labelled(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    counted = grams.collect()
    got = {(r.model, r.gram): r.ratio for r in toxicity.ratios(grams).collect()}
    for m, folds in ((toxicity.WHOLE, "02"), (2, "0"), (0, "2")):
        counts = [{r.gram: n for r in counted if (n := sum(r[f"n{f}{y}"] for f in folds))} for y in (0, 1)]
        want = toxicity.kneser_ney(*counts)
        assert {g for k, g in got if k == m} == want.keys()
        assert all(got[m, g] == pytest.approx(v, rel=1e-9, abs=1e-12) for g, v in want.items())
