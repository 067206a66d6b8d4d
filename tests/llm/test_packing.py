import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ownergraph.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def lengths_of(links):
    out = []
    while links:
        out.append(links[0])
        links = links[1]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_each_length_as_often_as_it_occurs(seed):
    rnd = random.Random(seed)
    histogram = Counter(rnd.randrange(1, 65) for _ in range(rnd.choice([1, 5, 500, 20000])))
    patterns = packing.spfhp(histogram, 64)
    used = Counter()
    for count, links in patterns:
        assert count > 0 and sum(lengths_of(links)) <= 64
        for length in lengths_of(links):
            used[length] += count
    assert used == histogram
    if sum(histogram.values()) >= 500:
        need = sum(n * x for x, n in histogram.items())
        assert need / (64 * sum(c for c, _ in patterns)) > 0.95


def test_longest_first_into_the_shortest_pack():
    assert sorted((c, sorted(lengths_of(x))) for c, x in packing.spfhp({6: 1, 5: 1, 2: 2, 1: 1}, 8)) == [(1, [1, 2, 5]), (1, [2, 6])]


def rows_of(spark, docs):
    return packing.pack_documents(docs, PATH).collect()


def test_operator_against_brute_force(spark):
    rnd = random.Random(1)
    texts = [None, "", "a", "hello <|endoftext|> you", "x" * 5000, *[" ".join(rnd.choice(["the", "of", "änd", "42", "\n"]) for _ in range(rnd.randrange(2500))) for _ in range(60)]]
    given = [(i, t) for i, t in enumerate(texts)] + [(3, "hello <|endoftext|> you")]
    docs = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "1 AS length", "'x' AS start")
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in given:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            piece = np.array(ids[at : at + 1024], "<u4")
            want[(i, at, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    rows = rows_of(spark, docs)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    assert sorted(held) == list(range(len(held)))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_and_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(spark, docs) == []
    one = spark.createDataFrame([(None, "hi there")], "doc_id long, text string")
    got = packing.pack_documents(one, PATH, with_ids=True).collect()
    assert got[0].ids == [*Tokenizer.from_file(PATH).encode("hi there").ids, 0] and got[0].doc_id is None
