import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from ownergraph.llm import webp


def picture(seed, height=11, width=13, colours=None, alpha=False):
    rnd = np.random.default_rng(seed)
    if colours:
        table = rnd.integers(0, 256, (colours, 4), np.uint8)
        out = table[rnd.integers(0, colours, (height, width))]
    else:
        out = (np.add.outer(np.arange(height) * 3, np.arange(width) * 5)[:, :, None] + rnd.integers(0, 9, (height, width, 4))).astype(np.uint8)
    if not alpha:
        out[:, :, 3] = 255
    return out


def test_a_picture_of_another_encoder():
    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(data).shape == (1, 1, 4)


def test_distances_cover_their_neighbourhood():
    assert len(webp.DISTANCES) == len(set(webp.DISTANCES)) == 120
    assert {(x, y) for x in range(-7, 9) for y in range(8) if y or x > 0} == set(webp.DISTANCES)


@pytest.mark.parametrize("mode", range(14))
def test_each_prediction(mode):
    for seed, (h, w) in enumerate([(1, 1), (1, 9), (9, 1), (10, 11)]):
        given = picture(seed, h, w, alpha=True)
        assert (webp.decode(webp.encode(given, predict=(mode,))) == given).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    given = picture(colours, 17, 19, colours=colours, alpha=True)
    assert (webp.decode(webp.encode(given, palette=True)) == given).all()
    assert (webp.decode(webp.encode(given, palette=True, references=True, cache_bits=3)) == given).all()


def test_parts_together():
    rnd = random.Random(5)
    for seed in range(60):
        given = picture(seed, rnd.randrange(1, 20), rnd.randrange(1, 20), colours=rnd.choice([None, 3, 40]), alpha=rnd.random() < 0.5)
        data = webp.encode(
            given, predict=rnd.choice([(), (1, 2, 11, 12, 13), (5,)]), cross=rnd.choice([None, (3, -20, 100), (-128, 127, -1)]), green=rnd.random() < 0.5,
            cache_bits=rnd.choice([0, 1, 4, 11]), references=rnd.random() < 0.5, groups=rnd.choice([0, 1, 3]),
        )
        assert (webp.decode(data) == given).all()


def test_long_runs_make_long_references():
    given = np.zeros((60, 100, 4), np.uint8)
    given[:, :, 3] = 255
    given[30:, 50:] = 7
    data = webp.encode(given, references=True, cache_bits=2)
    assert len(data) < 400 and (webp.decode(data) == given).all()


def test_selection_and_halves_by_hand():
    assert webp._select(0xFF102030, 0xFF112233, 0xFF102030) == 0xFF112233
    assert webp._half(0x00050505, 0x00080808) == 0x00040404  # rounds to zero
    assert webp._full(0xFFF0F0F0, 0xFFF0F0F0, 0xFF101010) == 0xFFFFFFFF


def test_broken_files():
    good = webp.encode(picture(1), references=True)
    for bad in (b"", b"RIFF", good[:25], good[:60], b"\0" * 40, good.replace(b"VP8L", b"VP8 ")):
        with pytest.raises(webp.Broken):
            webp.decode(bad)
    flat = webp.store(b"x" * 1152, 576)
    with pytest.raises(webp.Broken):
        webp.decode(flat[:-300])


def test_arrays_read_what_symbols_read(monkeypatch):
    payload = bytes(random.Random(1).randrange(256) for _ in range(576 * 3))
    data = webp.store(payload, 576)
    fast = webp.decode(data)
    monkeypatch.setattr(webp, "_read_flat", lambda *a: None)
    assert (webp.decode(data) == fast).all() and fast[:, :, :3].tobytes() == payload


def test_operator(spark):
    texts = {1: None, 2: "", 3: "é" * 288, 4: "a" * 577, 5: "b" * (576 * 17000)}
    docs = spark.createDataFrame([*texts.items(), (4, "a" * 577)], "doc_id long, text string").selectExpr("*", "1 AS media", "'x' AS feature")
    rows = webp.media_digests(docs).collect()
    assert len(rows) == 6 and len({tuple(r) for r in rows}) == 5
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
    pixels = webp.decode_media(webp.store_texts(docs.where("doc_id = 4"))).first()
    assert (pixels.width, pixels.height, len(pixels.pixels)) == (192, 2, 192 * 2 * 4)
    assert webp.decode_media(spark.createDataFrame([(1, None), (2, b"no")], "doc_id long, media binary")).where("pixels IS NULL").count() == 2
    assert webp.media_digests(docs.limit(0)).count() == 0


def test_stored_payloads_go_through_three_inverse_transforms(monkeypatch):
    """On real rows: each inverse step is called, and changes the samples."""
    import pyarrow.parquet as pq

    from ownergraph.llm import webp

    called = {}

    def counted(name):
        plain = getattr(webp, name)

        def run(pixels, *rest):
            out = plain(pixels, *rest)
            if rest[-1:] != (-1,):
                called[name] = called.get(name, 0) + int((out != pixels).any())
            return out

        monkeypatch.setattr(webp, name, run)

    for name in ("_unpredict", "_cross", "_green"):
        counted(name)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    for text in texts:
        raw = (text or "").encode()
        payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        pixels = webp.decode(webp.store(payload, 576))
        assert pixels[:, :, :3].tobytes() == payload and (pixels[:, :, 3] == 255).all()
    assert all(n > 0.9 * len(texts) for n in called.values()) and len(called) == 3


def test_sums_along_columns_are_the_predictor():
    import numpy as np

    from ownergraph.llm import webp

    samples = np.random.default_rng(3).integers(0, 256, (9, 13, 4), dtype=np.uint8)
    assert (webp.decode(webp.encode(samples, predict=(2,))) == samples).all()
    assert (webp.decode(webp.encode(samples, predict=(2, 1))) == samples).all()


def test_stored_payloads_use_codes_references_cache_and_palette(monkeypatch):
    """On real rows, read symbol by symbol: what the stored bytes hold, and the same pixels as by arrays."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()[:60]
    payloads = [raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff") for raw in ((t or "").encode() for t in [None, "ab" * 900, "abc" * 40_000, *texts])]
    stored = [webp.store(p, 576) for p in payloads]
    arrays = [webp.decode(s) for s in stored]
    made, kinds, palettes, flat = webp._Code.read, [], [], []
    read_flat, unpalette = webp._read_flat, webp._unpalette

    def read(self, bits):
        symbol = made(self, bits)
        if len(self.lengths) >= 280:
            kinds[-1].add(0 if symbol < 256 else 1 if symbol < 280 else 2)
            if symbol < 256 and self.single is None:
                kinds[-1].add(("bits", self.lengths[symbol]))
        return symbol

    def spied_flat(bits, codes, total):
        out = read_flat(bits, codes, total)
        flat.append(total > 16 and out is not None)
        return out

    monkeypatch.setattr(webp._Code, "read", read)
    monkeypatch.setattr(webp, "_read_arrays", lambda *a: None, raising=False)
    monkeypatch.setattr(webp, "_read_flat", spied_flat)
    monkeypatch.setattr(webp, "_unpalette", lambda *a: palettes.append(1) or unpalette(*a))
    for payload, data, fast in zip(payloads, stored, arrays, strict=True):
        kinds.append(set())
        slow = webp.decode(data)
        assert (slow == fast).all() and slow[:, :, :3].tobytes()[: len(payload)] == payload
    assert not any(flat) and len(palettes) >= 3
    assert sum(1 in k for k in kinds) > 0.5 * len(kinds) and sum(2 in k for k in kinds) > 0.7 * len(texts)
    assert sum(len([x for x in k if isinstance(x, tuple)]) > 2 for k in kinds) > 0.9 * len(texts)


def test_arrays_read_parts_together_as_symbols_do(monkeypatch):
    rnd, arrays, used = random.Random(7), webp._read_arrays, []
    monkeypatch.setattr(webp, "STRETCH", 1 << 9)
    monkeypatch.setattr(webp, "_read_arrays", lambda *a: (lambda out: used.append(out is not None) or out)(arrays(*a)))
    for seed in range(80):
        given = picture(seed, rnd.randrange(8, 40), rnd.randrange(8, 40), colours=rnd.choice([None, 3, 40]), alpha=rnd.random() < 0.5)
        data = webp.encode(given, green=rnd.random() < 0.5, cache_bits=rnd.choice([0, 1, 4, 11]), references=rnd.random() < 0.7)
        assert (webp.decode(data) == given).all()
    assert sum(used) > 60
    for seed in range(200):  # bytes of no picture end in an error or in some picture, never in another error
        raw = bytearray(webp.store(bytes(random.Random(seed).choices(b"abcdef \xff", k=576 * 6)), 576))
        raw[rnd.randrange(21, len(raw))] ^= 1 << rnd.randrange(8)
        try:
            webp.decode(bytes(raw[: rnd.choice([len(raw), len(raw) - 9])]))
        except webp.Broken:
            pass


def test_side_by_side_is_as_one_by_one(monkeypatch):
    rnd = random.Random(11)
    words = ["word", "of", "a", "tëxt", "\xff", "日本", "0", "aaaaaaaa", "z" * 50]
    raws = [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 30, 300, 3000]))).encode() for _ in range(60)]
    raws += [rnd.randbytes(n) for n in (1, 576, 5000, 40_000)] + [b"", b"ab" * 2000, b"q" * (576 * 16_390), bytes(range(256)) * 40]
    payloads = [raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff") for raw in raws]
    stored = webp.store_all(payloads, 576)
    assert stored == [webp.store(p, 576) for p in payloads]
    for stretch in (webp.STRETCH, 800):
        monkeypatch.setattr(webp, "STRETCH", stretch)
        some = [i for i, p in enumerate(payloads) if stretch > 800 or len(p) < 50_000]
        for payload, pixels in zip([payloads[i] for i in some], webp.decode_all([stored[i] for i in some]), strict=True):
            assert pixels[:, :, :3].tobytes()[: len(payload)] == payload and (pixels[:, :, 3] == 255).all()
    mixed = [webp.encode(picture(i, 9 + i, 30 - i), cache_bits=i % 5, references=i % 2 == 0, groups=i % 3) for i in range(12)] + stored[:30]
    assert all((a == webp.decode(b)).all() for a, b in zip(webp.decode_all(mixed), mixed, strict=True))
    with pytest.raises(webp.Broken):
        webp.decode_all([stored[0], stored[1][:-20]])


def test_a_hit_on_an_empty_slot_is_read_symbol_by_symbol():
    """Slots begin as transparent black, which array reading leaves to the symbol reader."""
    bits = webp._head(10, 10, True)
    bits.bits(0, 1)
    bits.bits(1 | 2 << 1, 5)  # a cache of two bits
    bits.bits(0, 1)
    lengths = [0] * 284
    lengths[5], lengths[282] = 1, 1
    green = webp._write_code(bits, lengths)
    for one in (7, 8, 255, 0):
        bits.bits(1 | int(one > 1) << 2, 3)
        bits.bits(one, 8 if one > 1 else 1)
    for i in range(100):
        bits.bits(*green[5 if i % 3 == 0 else 282])
    pixels = webp.decode(webp._riff(bits.close())).reshape(-1, 4)
    assert pixels[0].tolist() == [7, 5, 8, 255] and set(map(tuple, pixels.tolist())) <= {(7, 5, 8, 255), (0, 0, 0, 0)}
