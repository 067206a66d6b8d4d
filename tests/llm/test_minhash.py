import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ownergraph.llm import minhash


def plain_set(text, k):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ")
    for blank in "\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def plain_components(texts, k, percent=80):
    """Every pair that shares a shingle, on full sets."""
    sets = {i: plain_set(t, k) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for ids in holders.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                shared[min(a, b), max(a, b)] += 1
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}, sets


def check(spark, texts, k):
    want, sets = plain_components(texts, k)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = minhash.near_duplicates(docs, k, 80).collect()
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return want, {r.doc_id: r.component_id for r in rows}


@pytest.mark.parametrize("k", [2, 5])
def test_components_against_brute_force(spark, k):
    """Families of near copies of all likenesses around the threshold, chains of edits, short texts and copies."""
    rnd = random.Random(k)
    words = [f"w{i}" for i in range(3000)]
    texts, n = {}, 0
    for family in range(30):
        base = [rnd.choice(words) for _ in range(rnd.randrange(4, 260))]
        for _ in range(20):
            other = list(base)
            for _ in range(rnd.randrange(0, max(2, len(base) // (9 * k)))):
                other[rnd.randrange(len(other))] = rnd.choice(words)
            texts[n] = " ".join(other)
            n += 1
            if family % 3 == 0:
                base = other  # a chain: ends need not be alike
    for _ in range(60):
        texts[n] = " ".join(rnd.choice(words[:6]) for _ in range(rnd.randrange(0, 6)))
        n += 1
    want, got = check(spark, texts, k)
    assert got == want


def test_edges(spark):
    texts = {1: None, 2: "", 3: " \n\t", 4: "One", 5: "one ", 6: "ONE\x0b", 7: "É é", 8: "é é", 9: "a b c d e f g h i j k", 10: "A b c d e f g h i j k\n", 11: "x " * 30000}
    want, got = check(spark, texts, 2)
    assert got == want and got[6] == 4 and got[8] == 8 and got[1] == 1
    docs = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (7, "c d"), (3, "c d"), (None, None)], "doc_id long, text string").selectExpr("*", "'x' AS bands", "1 AS kept")
    rows = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2).collect())
    assert rows == Counter({(None, None, True): 2, (7, 7, True): 2, (7, 3, False): 1, (3, 3, True): 1}) or rows == Counter({(None, None, True): 2, (7, 7, True): 2, (7, 3, False): 1, (3, 3, True): 1})
    assert minhash.near_duplicates(docs.limit(0), 2).count() == 0


def test_signatures_estimate_the_likeness():
    rnd = np.random.default_rng(1)
    hits, true = [], []
    for _ in range(300):
        a = np.unique(rnd.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.r_[a[:30], rnd.integers(0, 2**63, 10, dtype=np.uint64)])
        hits.append((minhash.one_permutation(a) == minhash.one_permutation(b)).mean())
        true.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(hits) - np.mean(true)) < 0.02


def test_hot_group(spark):
    """Thousands of copies and of near copies are pairs by the member, not by the square."""
    base = " ".join(f"v{i}" for i in range(120))
    rows = [(i, base) for i in range(3000)] + [(3000 + i, f"{base} tail{i}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = minhash.near_duplicates(docs, 2).groupBy("component_id").count().collect()
    assert [(r.component_id, r["count"]) for r in got] == [(0, 4500)]


def test_alike_in_the_middle_of_crowded_buckets(spark):
    """Thousands share a passage and fill every bucket; the few that are alike are no centre of any."""
    passage = " ".join(f"p{i}" for i in range(101))  # 100 shingles of two words
    own = lambda i, n: " ".join(f"o{i}x{j}" for j in range(n))
    rows = [(i, f"{passage} {own(i, 40)}") for i in range(3000)]  # 100 of 180 among themselves, 100 of 150 with the others
    rows += [(5000 + i, f"{passage} {own(5000 + i, 10)}") for i in range(12)]  # 100 of 120
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2).collect()}
    assert got == {i: min(i, 5000) for i, _ in rows}


def halves(rnd, family, each, n_words, exchanged):
    """A family of two halves whose texts differ in some words; one pair across them reaches the similarity."""
    base = [f"f{family}w{i}" for i in range(n_words)]
    places = sorted(rnd.sample(range(0, n_words - 2, 3), exchanged + 1))
    out = []
    for half in range(2):
        for i in range(each):
            words = list(base)
            if half:
                for p in places[:exchanged]:
                    words[p] = f"f{family}h{p}"
            words[places[-1]] = f"f{family}o{half}x{i}"
            if i == 0:  # nearer to the other half by one exchanged word, and without a word of its own
                words[places[0]] = f"f{family}h{places[0]}" if not half else base[places[0]]
                words[places[-1]] = base[places[-1]]
            out.append(" ".join(words))
    return out


def test_halves_that_one_pair_joins(spark):
    """Stars between random members miss the one alike pair across two halves of a family; the exact join must not."""
    rnd = random.Random(9)
    texts = dict(enumerate(t for f in range(6) for t in halves(rnd, f, 60, 300, 18)))
    want, got = check(spark, texts, 2)
    assert got == want


def test_a_large_family_near_the_threshold(spark):
    rnd = random.Random(10)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for n in range(500):
        words = list(base)
        for _ in range(rnd.randrange(0, 13)):
            words[rnd.randrange(len(words))] = f"e{rnd.randrange(800)}"
        texts[n] = " ".join(words)
    want, got = check(spark, texts, 2)
    assert got == want


def test_stage_with_repeated_ids_of_different_texts(spark):
    docs = spark.createDataFrame([(7, "a b"), (7, "c d"), (3, "c d"), (9, "a b"), (None, "a b"), (8, None), (8, "")], "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs, 2).collect())
    assert kept == Counter([(7, "a b"), (3, "c d"), (None, "a b"), (8, None), (8, "")])
