import random
from collections import Counter, defaultdict

from ownergraph.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows, min_chars=40, min_docs=5):
    """Brute force: (doc_id, text) to (doc_id, text, n_lines, n_dropped)."""
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))
    low = -(2**63)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(low if i is None else i)
    shared = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if shared.get(key(x), low if i is None else i) == (low if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def got(docs, **more):
    return Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, **more).collect())


def test_against_brute_force(spark):
    rnd = random.Random(4)
    pool = ["".join(rnd.choice("abcDEF ä\t") for _ in range(n)) for n in (0, 3, 38, 39, 40, 41, 42, 60, 200) for _ in range(4)]
    rows = [(i, "\n".join(rnd.choice([rnd.choice(pool), f"  {rnd.choice(pool).upper()}\r", f"own {i} {rnd.random()}"]) for _ in range(rnd.randrange(0, 9)))) for i in range(300)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_edges(spark):
    """Nulls, empty texts, ties, repeated rows, clashing columns, and an empty table."""
    line = "x" * 40
    rows = [(1, line), (2, f"{line}\n{line}"), (3, f" {line.upper()} "), (4, line), (None, line), (5, f"a\n{line}\n"), (5, f"a\n{line}\n"), (5, "other"), (6, None), (7, ""), (8, "x" * 39)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS n_lines", "'k' AS n_dropped", "doc_id AS lang")
    assert got(docs) == plain(rows)
    found = line_dedup.dedup_lines(docs)
    assert sorted(found.columns) == ["doc_id", "lang", "n_dropped", "n_lines", "text"]
    by = defaultdict(list)
    for r in found.collect():
        by[r.doc_id].append(r.text)
    assert by[None] == [""] and by[2] == [""] and sorted(by[5]) == [f"a\n{line}\n", f"a\n{line}\n", "other"] and by[6] == [""]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_a_line_that_a_third_of_all_documents_hold(spark):
    line = "the very same line of some length in many documents"
    rows = [(i, f"{line}\nown {i}" if i % 3 == 0 else f"own {i}") for i in range(3000)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)) == plain(rows)
