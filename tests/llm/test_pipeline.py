"""Each stage against plain Python on its own input, over a small table with planted cases."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ownergraph.llm import minhash, secrets, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("aeioulmnrstdgp") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    shared = "This very line is in many of the documents of this corpus."
    rows, labels = [], []
    for i in range(400):
        text = "\n".join(prose(rnd.randrange(8, 30)) for _ in range(rnd.randrange(1, 5)))
        toxic = i % 8 == 0
        if toxic:
            text += " zworks zworking " + prose(3)
        if i % 5 == 1:
            text = f"  {shared.upper() if i % 10 == 1 else shared}\t\n" + text
        if i % 50 == 3:
            text += " password=abcdef123456 " + prose(2)
        rows.append([i, text, "en", "s", len(text)])
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    for i in range(400, 440):  # copies and near copies of documents that are not toxic
        text = rows[(i - 399) * 8 + 1][1] if i % 2 else rows[(i - 399) * 8 + 1][1] + " endword"
        rows.append([i, text, "en", "s", len(text)])
    rows += [[500, None, None, None, None], [501, "", "en", "s", 0], [502, "a" * 20000, "en", "s", 20000]]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([tuple(r) for r in rows], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], folder).write.parquet(f"{folder}/out{k}")
        out.append(spark.read.parquet(f"{folder}/out{k}"))
    return folder, out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(stages):
    _, out = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "secret scans", "packing"]
    for df in out[1:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity(stages, spark):
    folder, out = stages
    before, after = by_id(out[0]), by_id(out[1])
    assert {i for i in before if i not in after} == {i for i in range(400) if i % 8 == 0}
    assert all(tuple(after[i]) == tuple(before[i]) for i in after)
    model = toxicity.fit(out[0], spark.read.parquet(f"{folder}/labels.parquet"))
    assert {r.doc_id for r in toxicity.score_toxicity(out[0], model).where("predicted = 0").collect()} == set(after)


def test_line_dedup(stages):
    _, out = stages
    before, after = by_id(out[1]), by_id(out[2])
    assert set(before) == set(after)
    holders = defaultdict(set)
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, r in before.items():
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    for i, r in before.items():
        want = "\n".join(x for x in (r.text or "").split("\n") if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == i)
        assert (after[i].text, after[i].n_chars) == (want, len(want))


def test_near_copies(stages):
    _, out = stages
    before, after = by_id(out[2]), by_id(out[3])
    hashes = minhash._WordHashes()
    sets = {i: set(minhash.shingle_set(r.text, 5, hashes).tolist()) for i, r in before.items()}
    least = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    assert set(after) == {i for i in ids if least[i] == i} and len(after) < len(before)
    assert all(tuple(after[i]) == tuple(before[i]) for i in after)


def test_secrets(stages):
    _, out = stages
    before, after = by_id(out[3]), by_id(out[4])
    coder = secrets.encoding(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    assert set(before) == set(after)
    for i, r in before.items():
        found = secrets.all_spans(r.text or "", coder)[1]
        want = r.text if not found else secrets.redacted(r.text, found)
        assert after[i].text == want and (not found or "abcdef123456" not in want)


def test_packing_and_run(stages, spark):
    folder, out = stages
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, r in by_id(out[4]).items():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
        for at in range(0, n, 1024):
            want[i, at, min(1024, n - at), n] += 1
    for df in (out[5], corpus_pipeline.run(spark, folder)):
        rows = df.collect()
        assert Counter((r.doc_id, r.start, r.length, r.doc_tokens) for r in rows) == want
        held = defaultdict(int)
        for r in rows:
            held[r.sequence_id] += r.length
        assert max(held.values()) <= 1024


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
