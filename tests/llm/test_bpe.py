import random
from itertools import chain

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ownergraph.llm import bpe

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", " ", "\n\n  a", "ΑΣ Σ.", "İstanbul", "é É", "\x1c\x1d a\x85b\xa0c", "’s it's IT'S 'LL'd", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>",
       "<|endo", "日本語テスト", "😀😀 x😀", "١٢٣ ½ Ⅷ", "​‍﻿", "à́b", "ǅ ß ẞ ﬁ", "\U0001F1E6\U0001F1E7", "\t\t\tx \r\n y", "क्षि กำ ཀྵ"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    with open(path, "rb") as f:
        return bpe.Codec(f.read()), Tokenizer.from_file(path)


def ids_of(codec, text):
    memory = bpe.Pieces(codec, tuple)
    return [i for part in codec.encode(text, memory) for i in chain.from_iterable(part)]


def texts(n, seed):
    rnd = random.Random(seed)
    pools = ["abcdefghij ETAOIN '\n", "äöüßéèñ Ç ", " \t\n\r\x0b\x0c\xa0 ", "0123456789٣४½", "!?.,;:'\"-_/<|>", "αβΣσς жД", "日本語ह्こ", "😀\U00020000́̈"]
    for _ in range(n):
        yield "".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randrange(1, 80)))


def test_equals_the_library(both):
    codec, library = both
    for text in [*ODD, *texts(1500, 1)]:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(codec, text) == want, text
        assert codec.decoder().feed(want, True) == library.decode(want, skip_special_tokens=False), text


def test_long_runs_stream_through_the_window(both, monkeypatch):
    codec, library = both
    codec.window = 4 * codec.lookahead
    rnd = random.Random(2)
    for alphabet in ("ab", "the", "abcdefghijklmnopqrstuvwxyz", "äé", "=-", "7"):
        text = "".join(rnd.choice(alphabet) for _ in range(codec.window * 5))
        assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids
    text = "".join(rnd.choice(["the", "ing", "anti", "s", "er", "un"]) for _ in range(codec.window * 2))
    assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_every_pre_token_goes_through_the_bounded_window(both, monkeypatch):
    codec, library = both
    codec.window = 2 * codec.lookahead
    most, fed, plain = [0], [0], bpe.Transducer.feed

    def feed(self, raw):
        fed[0] += len(raw)
        for part in plain(self, raw):
            yield part
            most[0] = max(most[0], len(self.held))

    monkeypatch.setattr(bpe.Transducer, "feed", feed)
    rnd = random.Random(8)
    text = "".join(rnd.choice("theinganrsto") for _ in range(400_000)) + "".join(rnd.choice("a1b2") for _ in range(300_000))
    assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids
    assert fed[0] >= 400_000 and most[0] <= codec.window + bpe.FEED


def test_no_emitted_token_changes_with_what_follows(both):
    codec, _ = both
    rnd = random.Random(3)
    for _ in range(300):
        raw = "".join(rnd.choice("theinganrsto") for _ in range(4 * codec.lookahead)).encode()
        cut = 3 * codec.lookahead
        part, whole = codec._merged(codec._symbols(raw[:cut], False)), codec._merged(codec._symbols(raw, True))
        end = 0
        for a, b in zip(part, whole, strict=False):
            end += codec.width[a]
            if end > cut - codec.lookahead:
                break
            assert a == b


def test_chunks_change_nothing(both, monkeypatch):
    codec, library = both
    monkeypatch.setattr(bpe, "CHUNK", 7)
    for text in texts(400, 4):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(codec, text) == want
        decoder, out = codec.decoder(), ""
        for i in want:
            out += decoder.feed([i])
        assert out + decoder.feed([], True) == library.decode(want, skip_special_tokens=False)


def test_operator(spark):
    import hashlib

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Hello Wörld <|endoftext|>"), (3, "Hello Wörld <|endoftext|>"), (None, "x " * 50000)], "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    rows = bpe.bpe_digests(docs.selectExpr("*", "1 AS ids", "2 AS n_tokens"), public_tokenizers.path(FILES[0])).collect()
    assert len(rows) == 5
    for r in rows:
        text = {1: "", 2: "", 3: "Hello Wörld <|endoftext|>", None: "x " * 50000}[r.doc_id]
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    path = public_tokenizers.path(FILES[1])
    back = bpe.bpe_decode(bpe.bpe_encode(docs, path), path).collect()
    assert sorted(r.text for r in back) == sorted((r.text or "") for r in docs.collect())
    assert bpe.bpe_digests(docs.limit(0), path).count() == 0


def test_the_short_way_gives_the_same():
    with open(public_tokenizers.path(FILES[1]), "rb") as f:
        codec = bpe.Codec(f.read())
    quick, slow = bpe.Pieces(codec, tuple, codec.native()), bpe.Pieces(codec, tuple)
    for text in [*ODD, *texts(1500, 6)]:
        assert [x for part in codec.encode(text, quick) for x in part] == [x for part in codec.encode(text, slow) for x in part]
