import hashlib
import random
from collections import Counter

from ownergraph.llm import fingerprint


def jaccard(a, b):
    a, b = Counter((a or "").split()), Counter((b or "").split())
    return sum((a & b).values()) / (sum((a | b).values()) or 1)


def edited(text, following):
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def test_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["é😀", "a"]
    texts = {i * 7 - 20: " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 120))) for i in range(120)}
    texts[3] = None
    texts[1000] = texts[1007] = "same words in both"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS fingerprint").repartition(5)
    rows = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted(texts)
    assert sorted(rows) == order
    off_edited, off_next = [], []
    for i, k in enumerate(order):
        text, following = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        r, e = rows[k], edited(text, following)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(e.encode()).hexdigest())
        if text.split() and e.split():
            off_edited.append(r.near_edited - jaccard(text, e))
        if text.split() and following.split():
            off_next.append(r.near_next - jaccard(text, following))
    assert rows[1000].fingerprint == rows[1007].fingerprint and rows[1000].near_next == 1.0
    assert rows[3].fingerprint == "" and rows[3].n_chars == 0
    for off in (off_edited, off_next):  # the spread of 48 samples, which all documents share as they share their terms
        assert abs(sum(off) / len(off)) < 0.05 and max(map(abs, off)) < 0.35


def test_weights_count(spark):
    """Samples agree as often as generalised Jaccard says, for weights that differ term by term."""
    rows = [(d, t, float(1 + (t * (d + 3)) % 7)) for d in range(2) for t in range(50)]
    df = spark.createDataFrame(rows, "doc long, t long, w double").selectExpr("doc", "xxhash64(t) AS hashed", "w", "100 AS total")
    got = [r.f for r in fingerprint.signatures(df, ["doc"], {"f": ("w", "total")}, 400).orderBy("doc").collect()]
    same = sum(got[0][4 * i : 4 * i + 4] == got[1][4 * i : 4 * i + 4] for i in range(400)) / 400
    a, b = ([w for d, _, w in rows if d == x] for x in range(2))
    want = sum(map(min, a, b)) / sum(map(max, a, b))
    assert abs(same - want) < 0.08


def test_edges(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    r = fingerprint.fingerprints(one).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest()
    odd = spark.createDataFrame([(None, "x y"), (1, "p q r s"), (1, "p q r s"), (1, "zz"), (2, " \n "), (3, "w " * 30000)], "doc_id long, text string")
    rows = fingerprint.fingerprints(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter({1: 3, None: 1, 2: 1, 3: 1})
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 2
    assert fingerprint.fingerprints(odd.limit(0)).count() == 0


def test_lost_samples_are_taken_again(spark):
    """However many values are ruled out at first, the results are those of all values."""
    rnd = random.Random(5)
    rows = [(i // 2, " ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(0, 90)))) for i in range(60)]
    docs = spark.createDataFrame([*rows, rows[7], (200, None), (201, " ")], "doc_id long, text string").repartition(4)
    every = Counter(fingerprint.fingerprints(docs, sure=None).collect())
    assert Counter(fingerprint.fingerprints(docs, sure=0.3).collect()) == every
    assert Counter(fingerprint.fingerprints(docs).collect()) == every


def test_rows_of_one_id_are_told_apart_by_text(spark):
    """No row number depends on how the input is dealt, so a task that runs again finds the same rows."""
    docs = spark.createDataFrame([(d, f"{d} {i % 4} " * (3 + i)) for d in (1, 2) for i in range(9)], "doc_id long, text string")
    assert Counter(fingerprint.fingerprints(docs.repartition(1)).collect()) == Counter(fingerprint.fingerprints(docs.repartition(7)).collect())
    plan = fingerprint.fingerprints(docs)._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" not in plan
