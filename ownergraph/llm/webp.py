"""Lossless WebP: bytes to pixel arrays and back.

``decode`` reads the whole format: prefix codes in groups, back-references with their 2-D distances, the
colour cache, and the predictor, cross-colour, subtract-green and palette transforms.  Pictures with one group
of codes are read as arrays, others and the smallest ones symbol by symbol.  ``encode`` can use each part of the format; media columns store
payloads after the predictor, cross-colour and subtract-green transforms (and a palette, where there are few
colours), with references, a cache and prefix codes by their own counts.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ownergraph.llm.common import map_lists, map_rows
from ownergraph.session import table

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LITERALS, LENGTH_CODES, DISTANCE_CODES, MAX_SIDE = 256, 24, 40, 1 << 14
OPAQUE = 0xFF000000
#: Pictures that are stored and read side by side; sort keys of 16 bits hold a slot and the picture's number.
TOGETHER = 32
# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
_REVERSED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)


class Broken(ValueError):
    """Bytes that are no lossless WebP picture."""


# ---------------------------------------------------------------- bits


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.held = data, 0, 0, 0

    def bits(self, n: int) -> int:
        while self.held < n:
            more = self.data[self.at : self.at + 8]
            if not more:
                raise Broken("the bits end too early")
            self.value |= int.from_bytes(more, "little") << self.held
            self.held += 8 * len(more)
            self.at += len(more)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.held -= n
        return out

    def position(self) -> int:
        return 8 * self.at - self.held

    def peek15(self) -> int:
        if self.held < 15:
            more = self.data[self.at : self.at + 8]
            self.value |= int.from_bytes(more, "little") << self.held
            self.held += 8 * len(more)
            self.at += len(more)
        return self.value & 0x7FFF

    def skip(self, n: int) -> None:
        if n > self.held:
            raise Broken("the bits end too early")
        self.value >>= n
        self.held -= n


class _Writer:
    def __init__(self):
        self.value, self.n = 0, 0
        self.done = bytearray()

    def bits(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        while self.n >= 64:
            self.done += (self.value & (2**64 - 1)).to_bytes(8, "little")
            self.value >>= 64
            self.n -= 64

    def samples(self, codes: np.ndarray) -> None:
        """Eight bits each."""
        whole, odd = divmod(self.n, 8)
        self.done += (self.value & ((1 << (8 * whole)) - 1)).to_bytes(whole, "little")
        rest = self.value >> (8 * whole)
        if odd == 0:
            self.done += codes.tobytes()
            self.value = self.n = 0
            return
        shifted = codes << np.uint8(odd)
        shifted[1:] |= codes[:-1] >> np.uint8(8 - odd)
        shifted[0] |= np.uint8(rest)
        self.done += shifted.tobytes()
        self.value, self.n = int(codes[-1]) >> (8 - odd), odd

    def close(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.n + 7) // 8, "little")


# ---------------------------------------------------------------- prefix codes


def _canonical(lengths) -> dict[int, tuple[int, int]]:
    """Symbol to (code as it stands in the stream, bits)."""
    code, last, out = 0, 0, {}
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[symbol] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


class _Code:
    """A prefix code: one symbol of no bits, or a table over the next bits."""

    def __init__(self, lengths: bytes):
        self.lengths, self._table, self.single, self.top = lengths, None, None, 0
        many = [lengths.count(n) for n in range(16)]
        symbols = len(lengths) - many[0]
        if not symbols:
            raise Broken("a prefix code without symbols")
        if symbols == 1:
            self.single = len(lengths.rstrip(b"\0")) - 1
            return
        if sum([n << (15 - i) for i, n in enumerate(many) if i]) != 1 << 15:
            raise Broken("a prefix code that is not complete")
        self.top = max(n for n in range(16) if many[n])

    @property
    def table(self) -> list[tuple[int, int]]:
        """Symbol and bits by the next ``top`` bits as they stand in the stream."""
        if self._table is None:
            self._table = [None] * (1 << self.top)
            for symbol, (code, n) in _canonical(self.lengths).items():
                for i in range(code, 1 << self.top, 1 << n):
                    self._table[i] = (symbol, n)
        return self._table

    def read(self, bits: _Reader) -> int:
        if self.single is not None:
            return self.single
        symbol, n = self.table[bits.peek15() & ((1 << self.top) - 1)]
        bits.skip(n)
        return symbol


@lru_cache(maxsize=64)
def _code(lengths: bytes) -> _Code:
    return _Code(lengths)


#: Extra bits, the least run, and whether it repeats the last length.
_RUNS = {16: (2, 3, True), 17: (3, 3, False), 18: (7, 11, False)}


@lru_cache(maxsize=4096)
def _one(symbol: int, alphabet: int) -> _Code:
    return _Code(bytes(symbol) + b"\1" + bytes(alphabet - 1 - symbol))


def _read_code(bits: _Reader, alphabet: int) -> _Code:
    lengths = bytearray(alphabet)
    if bits.bits(1):  # one or two symbols
        two = bits.bits(1)
        first = bits.bits(8 if bits.bits(1) else 1)
        symbols = [first, bits.bits(8)] if two else [first]
        if not two and first < alphabet:
            return _one(first, alphabet)
        for s in symbols:
            if s >= alphabet:
                raise Broken("a symbol beyond its alphabet")
            lengths[s] = 1
        return _code(bytes(lengths))
    order = [0] * 19
    many = 4 + bits.bits(4)
    given = bits.bits(3 * many)
    for i, s in enumerate(CODE_LENGTH_ORDER[:many]):
        order[s] = given >> 3 * i & 7
    meta = _code(bytes(order))
    left = alphabet if not bits.bits(1) else 2 + bits.bits(2 + 2 * bits.bits(3))
    at, last = 0, 8
    table, mask = ([(meta.single, 0)], 0) if meta.single is not None else (meta.table, (1 << meta.top) - 1)
    value, held = bits.value, bits.held
    while at < alphabet and left:
        left -= 1
        if held < 22:
            more = bits.data[bits.at : bits.at + 24]
            value |= int.from_bytes(more, "little") << held
            held += 8 * len(more)
            bits.at += len(more)
        s, n = table[value & mask]
        value >>= n
        held -= n
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
            continue
        wide, least, repeated = _RUNS[s]
        n = least + (value & ((1 << wide) - 1))
        value >>= wide
        held -= wide
        if held < 0:
            break
        if at + n > alphabet:
            raise Broken("more code lengths than symbols")
        if repeated:
            lengths[at : at + n] = bytes([last]) * n
        at += n
    if held < 0:
        raise Broken("the bits end too early")
    bits.value, bits.held = value, held
    return _Code(bytes(lengths))


# ---------------------------------------------------------------- pictures of symbols


def _prefixed(symbol: int, bits: _Reader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.bits(extra) + 1


def _read_pixels(bits: _Reader, width: int, height: int, top: bool, later: list | None = None) -> np.ndarray | None:
    """Width x height ARGB values; only the main picture can have several groups of codes.

    With ``later``, a picture that can be read as arrays is put there instead.
    """
    cache_bits = bits.bits(4) if bits.bits(1) else 0
    if cache_bits > 11:
        raise Broken("a colour cache that is too large")
    group_of, block, across, groups = None, 0, 0, 1
    if top and bits.bits(1):
        block = bits.bits(3) + 2
        across = -(-width >> block)
        entropy = _read_pixels(bits, across, -(-height >> block), False)
        group_of = ((entropy >> 8) & 0xFFFF).tolist()
        groups = max(group_of) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    alphabets = (LITERALS + LENGTH_CODES + cache_size, LITERALS, LITERALS, LITERALS, DISTANCE_CODES)
    codes = [[_read_code(bits, n) for n in alphabets] for _ in range(groups)]
    total = width * height
    if groups == 1 and None not in (one := [c.single for c in codes[0][:4]]) and one[0] < LITERALS:
        return np.full(total, one[3] << 24 | one[1] << 16 | one[0] << 8 | one[2], np.uint32)
    if groups == 1 and (flat := _read_flat(bits, codes[0], total)) is not None:
        return flat
    if groups == 1 and total >= FEW and (codes[0][0].single is None or codes[0][0].single < LITERALS):
        if later is not None:
            later.append(_Job(bits, codes[0], width, total, cache_bits))
            return None
        if (found := _read_arrays(bits, codes[0], width, total, cache_bits)) is not None:
            return found
    out, cache, n = [0] * total, [0] * cache_size, 0
    shift = 32 - cache_bits
    green, red, blue, alpha, distance = codes[0]
    while n < total:
        if group_of is not None:
            y, x = divmod(n, width)
            green, red, blue, alpha, distance = codes[group_of[(y >> block) * across + (x >> block)]]
        s = green.read(bits)
        if s < LITERALS:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            pixel = a << 24 | r << 16 | s << 8 | b
            out[n] = pixel
            n += 1
            if cache_bits:
                cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
        elif s < LITERALS + LENGTH_CODES:
            length = _prefixed(s - LITERALS, bits)
            d = _prefixed(distance.read(bits), bits)
            if d <= len(DISTANCES):
                dx, dy = DISTANCES[d - 1]
                d = max(1, dx + dy * width)
            else:
                d -= len(DISTANCES)
            if d > n or n + length > total:
                raise Broken("a reference outside of the picture")
            for n in range(n, n + length):
                pixel = out[n] = out[n - d]
                if cache_bits:
                    cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
            n += 1
        else:
            pixel = out[n] = cache[s - LITERALS - LENGTH_CODES]
            n += 1
            cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
    return np.array(out, np.uint32)


def _read_flat(bits: _Reader, codes: list[_Code], total: int) -> np.ndarray | None:
    """All pixels at once, if every sample has eight bits or none and no symbol but literals has a code."""
    channels = codes[:4]
    if any(channels[0].lengths[LITERALS:]):
        return None
    if any(c.single is None and c.lengths[:LITERALS] != b"\x08" * LITERALS for c in channels):
        return None
    coded = [i for i, c in enumerate(channels) if c.single is None]
    need, at = total * len(coded), bits.position()
    raw = np.frombuffer(bits.data, np.uint8, offset=at >> 3)
    odd = at & 7
    if len(raw) * 8 - odd < 8 * need:
        raise Broken("the bits end too early")
    samples = raw[:need] if not odd else (raw[:need] >> np.uint8(odd)) | (np.append(raw[1 : need + 1], np.uint8(0))[:need] << np.uint8(8 - odd))
    bits.at, bits.value, bits.held = (at >> 3) + need, 0, 0
    if odd:
        bits.value, bits.held, bits.at = int(bits.data[bits.at]) >> odd, 8 - odd, bits.at + 1
    samples = _REVERSED[samples].reshape(total, len(coded))
    pixels = np.empty((total, 4), np.uint8)  # B, G, R, A in memory
    for channel, byte in ((0, 1), (1, 2), (2, 0), (3, 3)):
        pixels[:, byte] = samples[:, coded.index(channel)] if channel in coded else channels[channel].single
    return pixels.view("<u4").reshape(total).astype(np.uint32, copy=False)


#: Pictures of fewer pixels are read symbol by symbol; longer ones in stretches of so many bits, which keeps arrays small.
FEW, STRETCH = 64, 28_000
#: Bits 0 to 15 of what begins at a bit are the lengths of four codes there; then: a cache hit, or a reference.
HIT, COPY = 1 << 16, 1 << 17
_EXTRA = np.array([0, 0, 0, 0, *((s - 2) >> 1 for s in range(4, DISTANCE_CODES))])
_BASE = np.array([1, 2, 3, 4, *(((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(4, DISTANCE_CODES))])
_ASIDE, _ABOVE = np.array(DISTANCES).T
_COUNT, _TWO = np.arange(STRETCH, dtype=np.int32), np.zeros(2, np.int32)


class _Job:
    """A picture of one group of codes that is read as arrays: where its symbols begin, and how far they are read."""

    def __init__(self, bits: _Reader, codes: list[_Code], width: int, total: int, cache_bits: int):
        first = bits.position()
        self.codes, self.width, self.total, self.cache_bits = codes, width, total, cache_bits
        self.data, self.at, self.done = bits.data[first >> 3 :], first & 7, 0
        self.bits, self.first = bits, first >> 3


def _roots(source: np.ndarray) -> np.ndarray:
    """Where the pointers to earlier places end."""
    while True:
        further = source[source]
        if (further == source).all():
            return source
        source = further


def _before(keys: np.ndarray) -> np.ndarray:
    """The last earlier place with the same key (16 or 32 bits), or -1."""
    if keys.dtype == np.uint16:
        order = np.argsort(keys, kind="stable")
    else:  # in two halves, which sort by counting
        order = np.argsort(keys.astype(np.uint16), kind="stable")
        order = order[np.argsort((keys >> np.uint32(16)).astype(np.uint16)[order], kind="stable")]
    out, sorted_keys = np.full(len(keys), -1), keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


def _tables(codes: list[_Code], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their bits by the next ``wide`` bits, the first bit highest, for one code after the other."""
    lengths = np.frombuffer(b"".join([c.lengths for c in codes]), np.uint8)
    sizes = np.array([len(c.lengths) for c in codes])
    used = np.flatnonzero(lengths)
    owner = np.repeat(np.arange(len(codes)), sizes)[used]
    n = lengths[used].astype(np.int64)
    order = np.argsort((owner * 16 + n).astype(np.uint16), kind="stable")
    n[np.array([c.single is not None for c in codes])[owner]] = 0
    n, symbols = n[order], (used - (np.cumsum(sizes) - sizes)[owner])[order]
    spans = 1 << (wide - n)
    return np.repeat(symbols, spans), np.repeat(n, spans)


def _read_arrays(bits: _Reader, codes: list[_Code], width: int, total: int, cache_bits: int) -> np.ndarray | None:
    """All pixels of one group of codes; null for the rare pictures that only the symbol reader takes."""
    return _read_all([_Job(bits, codes, width, total, cache_bits)])[0]


def _read_all(jobs: list[_Job]) -> list[np.ndarray | None]:
    """All pixels of up to 32 pictures, side by side.

    What begins at a bit tells where the next symbol begins, whatever the pixels are: that is taken for every bit at
    once, and the chain from the first bit followed.  Then literals are looked up, and references and cache hits are
    pointers to earlier pixels: a hit points to the last one of its slot, and slots follow from literals and symbols.
    """
    wide = max(c.top for job in jobs for c in job.codes)
    tables = [_tables([job.codes[i] for job in jobs], wide) for i in range(5)]
    greens, distances = tables[0], tables[4]
    kinds = sum(n << 4 * i for i, (_, n) in enumerate(tables[:4])).astype(np.int32)
    kinds[greens[0] >= LITERALS] |= COPY
    kinds[greens[0] >= LITERALS + LENGTH_CODES] ^= HIT | COPY
    coded = [i for i in (1, 2, 3) if any(job.codes[i].single is None for job in jobs)]
    shifts, four, bytewise = (24 - wide - np.arange(8)).astype(np.int32), np.int32(15), np.array([0, 8, 16, 24])
    totals, widths = np.array([job.total for job in jobs]), np.array([job.width for job in jobs])
    pending, chunks = list(range(len(jobs))), []
    while pending:
        parts, size, chain, lasts, reached = [], 0, [], [], []
        for j in pending:
            job = jobs[j]
            base = job.at >> 3
            if base >= len(job.data):
                raise Broken("the bits end too early")
            raw = job.data[base : base + STRETCH // 8]
            end = 8 * len(raw)
            raw += job.data[base + len(raw) : base + len(raw) + 16].ljust(16, b"\0")
            turned = _REVERSED[np.frombuffer(raw, np.uint8)].astype(np.int32)
            turned = turned[:-2] << 16 | turned[1:-1] << 8 | turned[2:]
            windows = turned[:, None] >> shifts
            windows &= np.int32((1 << wide) - 1)
            windows = windows.reshape(-1)
            kind = kinds[j << wide : (j + 1) << wide].take(windows, mode="clip")
            plain = _COUNT[:end] + (kind[:end] & four) if end <= len(_COUNT) else np.arange(end, dtype=np.int32) + (kind[:end] & four)
            special = np.flatnonzero(kind[:end] >= HIT)
            after = plain[special]
            for i in coded:
                n = kind.take(plain, mode="clip")
                n >>= np.int32(4 * i)
                n &= four
                plain += n
            if len(special):
                plain[special] = after
                copies = np.flatnonzero(kind[special] >= COPY)
                to = after[copies]
                special = special[copies]
                to = to + _EXTRA[greens[0][(j << wide) + windows[special]] - LITERALS]
                found = (j << wide) + windows[to]
                plain[special] = to + distances[1][found] + _EXTRA[distances[0][found]]
            where, follow, own = job.at & 7, memoryview(plain), []
            add = own.append
            while where < end:
                add(where)
                where = follow[where]
            chain.append(np.fromiter(own, np.int64, len(own)) + 8 * size)
            lasts.append(len(own))
            reached.append(where)
            parts.append((raw, turned, plain))
            size += len(raw)
        data = np.frombuffer(b"".join([x[0] for x in parts]), np.uint8)
        triples = np.concatenate([x for _, t, _ in parts for x in (t, _TWO)])

        def window(places, of):
            return (triples[places >> 3] >> (24 - wide - (places & 7)) & ((1 << wide) - 1)) + (of << wide)

        chain, owner, lasts = np.concatenate(chain), np.array(pending), np.cumsum(lasts).tolist()
        many = np.diff(lasts, prepend=0)
        of = np.repeat(owner, many)
        found = window(chain, of)
        symbol, after = greens[0][found], chain + greens[1][found]
        literal = np.flatnonzero(symbol < LITERALS)
        copies = np.flatnonzero((symbol >= LITERALS) & (symbol < LITERALS + LENGTH_CODES))
        kind = np.where(symbol < LITERALS, 0, HIT)
        kind[copies] = COPY
        counts, back = np.ones(len(chain), np.int64), np.zeros(len(chain), np.int64)
        if len(copies):
            to, code = after[copies], symbol[copies] - LITERALS
            for out in (counts, back):
                if out is back:
                    found = window(to, of[copies])
                    code, to = distances[0][found], to + distances[1][found]
                extra = (data[(to >> 3)[:, None] + np.arange(4)].astype(np.int64) << bytewise).sum(axis=1) >> (to & 7)
                out[copies] = _BASE[code] + (extra & ((1 << _EXTRA[code]) - 1))
                to = to + _EXTRA[code]
            near = back[copies]
            short = np.minimum(near, len(DISTANCES)) - 1
            back[copies] = np.where(near <= len(DISTANCES), np.maximum(1, _ASIDE[short] + _ABOVE[short] * widths[of[copies]]), near - len(DISTANCES))
        values, place, value = symbol, after[literal], symbol[literal] << 8
        for i, shift in ((1, 16), (2, 0), (3, 24)):
            if i in coded or len({job.codes[i].single for job in jobs}) > 1:
                found = window(place, of[literal])
                value |= tables[i][0][found] << shift
                place += tables[i][1][found]
            else:
                value |= jobs[0].codes[i].single << shift
        values[literal] = value
        sums = np.cumsum(counts)
        upto = np.concatenate([[0], sums])
        begun = sums - counts - np.repeat(upto[np.array(lasts) - many] - np.array([jobs[j].done for j in pending]), many)
        keep, still = begun < totals[of], []
        for k, j in enumerate(pending):
            job, low, high = jobs[j], lasts[k] - int(many[k]), lasts[k]
            passed, begin = job.done + int(upto[high] - upto[low]), 8 * (job.at >> 3)
            if passed < job.total:
                job.done, job.at = passed, begin + reached[k]
                still.append(j)
                continue
            last = low + int(keep[low:high].sum()) - 1
            if begun[last] + counts[last] > job.total:
                raise Broken("a reference outside of the picture")
            offset = 8 * sum([len(x[0]) for x in parts[:k]])
            job.at = begin + int(parts[k][2][chain[last] - offset])
            if job.at > 8 * len(job.data):
                raise Broken("the bits end too early")
        pending = still
        chunks.append((of[keep], kind[keep], values[keep], counts[keep], back[keep]))
    if len(chunks) == 1:
        of, kind, values, counts, back = chunks[0]
    else:
        of, kind, values, counts, back = map(np.concatenate, zip(*chunks, strict=True))
        order = np.argsort(of, kind="stable")
        of, kind, values, counts, back = of[order], kind[order], values[order], counts[order], back[order]
    stops = np.cumsum(totals)
    start = np.cumsum(counts) - counts
    if (back > start - (stops - totals)[of]).any():
        raise Broken("a reference outside of the picture")
    pixels, source, unknown = np.zeros(int(stops[-1]), np.int64), np.arange(int(stops[-1])), set()
    pixels[start] = values
    source -= np.repeat(back, counts)
    hits = np.flatnonzero(kind == HIT)
    if len(hits):
        slot = np.zeros(len(pixels), np.int64)
        slot[start] = (values * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - np.array([job.cache_bits for job in jobs])[of])
        slot[start[hits]] = values[hits] - LITERALS - LENGTH_CODES
        slot[start] += of << 11
        found = start[hits]
        before = _before(slot[_roots(source)].astype(np.uint16))[found]
        if (before < 0).any():  # a slot that nothing has been put into
            unknown = set(of[hits[before < 0]].tolist())
        source[found] = np.where(before < 0, found, before)
    pixels = pixels[_roots(source)].astype(np.uint32)
    out = [None if j in unknown else x for j, x in enumerate(np.split(pixels, stops[:-1]))]
    for job, found in zip(jobs, out, strict=True):
        if found is not None:
            job.bits.at, job.bits.value, job.bits.held = job.first + (job.at >> 3), 0, 0
            job.bits.bits(job.at & 7)
    return out


# ---------------------------------------------------------------- transforms


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _bytes(x: int) -> tuple[int, int, int, int]:
    return x >> 24, x >> 16 & 255, x >> 8 & 255, x & 255


def _join(parts) -> int:
    a, r, g, b = (0 if p < 0 else 255 if p > 255 else p for p in parts)
    return a << 24 | r << 16 | g << 8 | b


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for x, y, z in zip(_bytes(left), _bytes(top), _bytes(corner), strict=True):
        to_left += abs(y - z)
        to_top += abs(x - z)
    return left if to_left < to_top else top


def _full(a: int, b: int, c: int) -> int:
    return _join(x + y - z for x, y, z in zip(_bytes(a), _bytes(b), _bytes(c), strict=True))


def _half(a: int, b: int) -> int:
    return _join(x + int((x - y) / 2) for x, y in zip(_bytes(a), _bytes(b), strict=True))


#: Predictions from the left, top, top right and top left neighbours, by mode.
PREDICTIONS = (
    lambda l, t, tr, tl: OPAQUE,
    lambda l, t, tr, tl: l,
    lambda l, t, tr, tl: t,
    lambda l, t, tr, tl: tr,
    lambda l, t, tr, tl: tl,
    lambda l, t, tr, tl: _average(_average(l, tr), t),
    lambda l, t, tr, tl: _average(l, tl),
    lambda l, t, tr, tl: _average(l, t),
    lambda l, t, tr, tl: _average(tl, t),
    lambda l, t, tr, tl: _average(t, tr),
    lambda l, t, tr, tl: _average(_average(l, tl), _average(t, tr)),
    lambda l, t, tr, tl: _select(l, t, tl),
    lambda l, t, tr, tl: _full(l, t, tl),
    lambda l, t, tr, tl: _half(_average(l, t), tl),
)


#: The modes that predict a pixel from the one before and the one above it.
FROM_LEFT, FROM_TOP = 1, 2


def _predict(out: list[int], n: int, width: int, mode: int) -> int:
    """The prediction of pixel n from those before it; the first row and column have modes of their own."""
    if n == 0:
        return OPAQUE
    if n < width:
        return out[n - 1]
    if n % width == 0:
        return out[n - width]
    return PREDICTIONS[mode](out[n - 1], out[n - width], out[n - width + 1], out[n - width - 1])


def _unpredict(pixels: np.ndarray, width: int, block: int, modes: np.ndarray) -> np.ndarray:
    across = -(-width >> block)
    modes = ((modes >> 8) & 15).tolist()
    if max(modes) >= len(PREDICTIONS):
        raise Broken("a prediction mode that is not defined")
    if set(modes) == {FROM_TOP}:  # sums along the columns
        parts = pixels.astype("<u4").view(np.uint8).reshape(-1, width, 4).copy()
        parts[0, 0, 3:] += np.uint8(255)
        parts[0] = np.cumsum(parts[0], axis=0, dtype=np.uint8)
        return np.cumsum(parts, axis=0, dtype=np.uint8).view("<u4").reshape(-1).astype(np.uint32, copy=False)
    if set(modes) == {FROM_LEFT}:  # sums along the first column, then along the rows
        parts = pixels.astype("<u4").view(np.uint8).reshape(-1, width, 4).copy()
        parts[0, 0, 3:] += np.uint8(255)
        parts[:, 0] = np.cumsum(parts[:, 0], axis=0, dtype=np.uint8)
        return np.cumsum(parts, axis=1, dtype=np.uint8).view("<u4").reshape(-1).astype(np.uint32, copy=False)
    out = pixels.tolist()
    for n in range(len(out)):
        y, x = divmod(n, width)
        out[n] = _add(out[n], _predict(out, n, width, modes[(y >> block) * across + (x >> block)]))
    return np.array(out, np.uint32)


_SIGNED = np.arange(256, dtype=np.uint8).view(np.int8).astype(np.int32)


def _cross(pixels: np.ndarray, width: int, block: int, elements: np.ndarray, sign: int) -> np.ndarray:
    """Add (sign 1) or take away (-1) what green tells of red and blue, and red of blue."""
    out = pixels.astype("<u4")
    parts = out.view(np.uint8).reshape(-1, 4)
    blue, green, red = parts[:, 0], parts[:, 1], parts[:, 2]
    if (elements == elements[0]).all():  # three small tables
        factors = _SIGNED[[int(elements[0]) >> i & 0xFF for i in (0, 8, 16)]]
        to_red, to_blue, red_to_blue = (sign * (factors[:, None] * _SIGNED >> 5)).astype(np.uint8)
        plain = red.copy()
        red += to_red[green]
        blue += to_blue[green]
        blue += red_to_blue[red if sign > 0 else plain]
        return out.astype(np.uint32, copy=False)
    across, n = -(-width >> block), np.arange(len(pixels))
    element = elements[(n // width >> block) * across + (n % width >> block)]
    factors, plain = [_SIGNED[element >> i & 0xFF] for i in (0, 8, 16)], red.copy()
    red += (sign * (factors[0] * _SIGNED[green] >> 5)).astype(np.uint8)
    blue += (sign * (factors[1] * _SIGNED[green] >> 5)).astype(np.uint8)
    blue += (sign * (factors[2] * _SIGNED[red if sign > 0 else plain] >> 5)).astype(np.uint8)
    return out.astype(np.uint32, copy=False)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    out = pixels.astype("<u4")
    parts = out.view(np.uint8).reshape(-1, 4)
    for i in (0, 2):
        if sign > 0:
            parts[:, i] += parts[:, 1]
        else:
            parts[:, i] -= parts[:, 1]
    return out.astype(np.uint32, copy=False)


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _running(colours: np.ndarray) -> np.ndarray:
    parts = np.cumsum(colours.astype("<u4").view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8)
    return np.ascontiguousarray(parts).view("<u4").reshape(-1).astype(np.uint32)


def _unpalette(pixels: np.ndarray, width: int, height: int, colours: np.ndarray) -> np.ndarray:
    pack = _palette_bits(len(colours))
    packed = (pixels >> 8 & 0xFF).reshape(height, -1)
    x = np.arange(width)
    bits = 8 >> pack
    index = (packed[:, x >> pack] >> ((x & ((1 << pack) - 1)) * bits).astype(np.uint32)) & ((1 << bits) - 1)
    return np.append(colours, np.zeros(256, np.uint32))[index].reshape(-1).astype(np.uint32)


def decode(data: bytes) -> np.ndarray:
    """Height x width x 4 samples (red, green, blue, alpha) of a lossless WebP file."""
    bits, coded, height, undo, has_alpha = _opened(data)
    return _undone(_read_pixels(bits, coded, height, True), height, undo, has_alpha)


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """The samples of files, up to 32 of whose pictures are read side by side; one broken file is an error for all."""
    if len(files) > TOGETHER:
        return decode_all(files[:TOGETHER]) + decode_all(files[TOGETHER:])
    opened, jobs, pixels = [_opened(data) for data in files], [], []
    for bits, coded, height, _, _ in opened:
        before = len(jobs)
        found = _read_pixels(bits, coded, height, True, jobs)
        pixels.append(before if len(jobs) > before else found)
    read = _read_all(jobs) if jobs else []
    out = []
    for data, found, (_, _, height, undo, has_alpha) in zip(files, pixels, opened, strict=True):
        found = read[found] if isinstance(found, int) else found
        out.append(decode(data) if found is None else _undone(found, height, undo, has_alpha))
    return out


def _opened(data: bytes) -> tuple[_Reader, int, int, list, int]:
    """Where the main picture begins, its sides, the transforms to undo, and whether alpha counts."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Broken("no WebP file")
    at, body = 12, None
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            body = data[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    if not body or body[0] != 0x2F:
        raise Broken("no lossless picture")
    bits = _Reader(body[1:])
    width, height = bits.bits(14) + 1, bits.bits(14) + 1
    has_alpha = bits.bits(1)
    if bits.bits(3):
        raise Broken("a version that is not defined")
    undo, seen, coded = [], set(), width
    while bits.bits(1):
        kind = bits.bits(2)
        if kind in seen:
            raise Broken("a transform that comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.bits(3) + 2
            side = _read_pixels(bits, -(-coded >> block), -(-height >> block), False)
            undo.append((kind, coded, block, side))
        elif kind == PALETTE:
            size = bits.bits(8) + 1
            colours = _running(_read_pixels(bits, size, 1, False))
            undo.append((kind, coded, 0, colours))
            coded = -(-coded >> _palette_bits(size))
        else:
            undo.append((kind, coded, 0, None))
    return bits, coded, height, undo, has_alpha


def _undone(pixels: np.ndarray, height: int, undo: list, has_alpha: int) -> np.ndarray:
    for kind, wide, block, side in reversed(undo):
        if kind == PREDICTOR:
            pixels = _unpredict(pixels, wide, block, side)
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, wide, block, side, 1)
        elif kind == PALETTE:
            pixels = _unpalette(pixels, wide, height, side)
        else:
            pixels = _green(pixels, 1)
    out = pixels.astype("<u4").view(np.uint8).reshape(height, -1, 4)[:, :, [2, 1, 0, 3]]
    if not has_alpha:
        out[:, :, 3] = 255
    return out


# ---------------------------------------------------------------- writing


def _lengths(counts: dict[int, int], alphabet: int, most: int) -> list[int]:
    """Lengths of a prefix code for the counted symbols, none above ``most``."""
    lengths = [0] * alphabet
    while True:
        heap = [(n, s, (s,)) for s, n in sorted(counts.items())]
        heapq.heapify(heap)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
            return lengths
        depth = Counter()
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= most:
            for s, n in depth.items():
                lengths[s] = n
            return lengths
        counts = {s: (n + 1) // 2 for s, n in counts.items()}


def _write_code(bits: _Writer, lengths: list[int]) -> dict[int, tuple[int, int]]:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used, default=0) < 256:
        used = used or [0]
        bits.bits(1, 1)
        bits.bits(len(used) - 1, 1)
        bits.bits(int(used[0] > 1), 1)
        bits.bits(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            bits.bits(used[1], 8)
            return _canonical(lengths)
        return {used[0]: (0, 0)}
    bits.bits(0, 1)
    symbols, i = [], 0
    last = 8
    while i < len(lengths):
        n = 1
        while i + n < len(lengths) and lengths[i + n] == lengths[i]:
            n += 1
        if lengths[i] == 0 and n >= 3:
            n = min(n, 138)
            symbols.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
        elif lengths[i] and lengths[i] == last and n >= 3:
            n = min(n, 6)
            symbols.append((16, n - 3, 2))
        else:
            n = 1
            symbols.append((lengths[i], 0, 0))
            last = lengths[i] or last
        i += n
    meta = _lengths(Counter(s for s, _, _ in symbols), 19, 7)
    if sum(map(bool, meta)) == 1:  # one symbol has no bits; its length must still be written
        code = {s: (0, 0) for s, _, _ in symbols}
    else:
        code = _canonical(meta)
    bits.bits(15, 4)
    for s in CODE_LENGTH_ORDER:
        bits.bits(meta[s], 3)
    bits.bits(0, 1)
    for s, extra, n in symbols:
        bits.bits(*code[s])
        bits.bits(extra, n)
    return _canonical(lengths) if len(used) > 1 else {used[0]: (0, 0)}


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra value and extra bits of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * extra + 2 + (v >> extra & 1), v & ((1 << extra) - 1), extra


def _write_pixels(bits: _Writer, pixels: list[int], width: int, top: bool, cache_bits: int = 0, references: bool = False, groups: int = 0) -> None:
    """Symbols of a picture; ``groups`` is the number of code groups, dealt to blocks of four in turn."""
    bits.bits(int(cache_bits > 0), 1)
    if cache_bits:
        bits.bits(cache_bits, 4)
    across, high = -(-width >> 2), -(-(len(pixels) // width) >> 2)
    groups = min(groups, across * high)
    if top:
        bits.bits(int(groups > 0), 1)
        if groups:
            bits.bits(0, 3)
            _write_pixels(bits, [i % groups << 8 for i in range(across * high)], across, False)
    near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(DISTANCES)))}
    cache, shift, seen, n, tokens = {}, 32 - cache_bits, {}, 0, []
    while n < len(pixels):
        group = 0
        if top and groups:
            y, x = divmod(n, width)
            group = ((y >> 2) * across + (x >> 2)) % groups
        was, run = seen.get(tuple(pixels[n : n + 3])) if references else None, 0
        if was is not None:
            while n + run < len(pixels) and run < 4096 and pixels[n + run] == pixels[was + run]:
                run += 1
        slot = (CACHE_FACTOR * pixels[n] & 0xFFFFFFFF) >> shift if cache_bits else None
        if run >= 3:
            d = n - was
            tokens.append((group, "copy", run, near.get(d, d + len(DISTANCES))))
        elif cache_bits and cache.get(slot) == pixels[n]:
            run = 1
            tokens.append((group, "hit", slot, 0))
        else:
            run = 1
            tokens.append((group, "pixel", pixels[n], 0))
        for i in range(n, n + run):
            if references:
                seen[tuple(pixels[i : i + 3])] = i
            if cache_bits:
                cache[(CACHE_FACTOR * pixels[i] & 0xFFFFFFFF) >> shift] = pixels[i]
        n += run
    alphabets = (LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCE_CODES)

    def symbols(kind: str, value: int, distance: int) -> list[tuple[int, int, int, int]]:
        if kind == "pixel":
            a, r, g, b = _bytes(value)
            return [(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
        if kind == "hit":
            return [(0, LITERALS + LENGTH_CODES + value, 0, 0)]
        length, far = _prefix(value), _prefix(distance)
        return [(0, LITERALS + length[0], *length[1:]), (4, *far)]

    counts = [[Counter() for _ in alphabets] for _ in range(max(1, groups if top else 1))]
    for group, *token in tokens:
        for code, symbol, _, _ in symbols(*token):
            counts[group][code][symbol] += 1
    codes = [[_write_code(bits, _lengths(c or {0: 1}, size, 15)) for c, size in zip(group, alphabets, strict=True)] for group in counts]
    for group, *token in tokens:
        for code, symbol, extra, n in symbols(*token):
            bits.bits(*codes[group][code][symbol])
            bits.bits(extra, n)


def _riff(body: bytes) -> bytes:
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def _head(width: int, height: int, alpha: bool) -> _Writer:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError(f"a side is not from 1 to {MAX_SIDE}")
    bits = _Writer()
    bits.bits(0x2F, 8)
    bits.bits(width - 1, 14)
    bits.bits(height - 1, 14)
    bits.bits(int(alpha), 1)
    bits.bits(0, 3)
    return bits


def _write_palette(bits: _Writer, argb: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """The transform's colours, and the packed picture of their numbers."""
    pack = _palette_bits(len(colours))
    bits.bits(1, 1)
    bits.bits(PALETTE, 2)
    bits.bits(len(colours) - 1, 8)
    parts = colours.astype("<u4").view(np.uint8).reshape(-1, 4)
    steps = np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
    _write_pixels(bits, np.ascontiguousarray(steps).view("<u4").reshape(-1).tolist(), len(colours), False)
    index = np.searchsorted(colours, argb).astype(np.uint32)
    packed = np.zeros((len(argb), -(-argb.shape[1] >> pack)), np.uint32)
    for x in range(argb.shape[1]):
        packed[:, x >> pack] |= index[:, x] << np.uint32((x & ((1 << pack) - 1)) * (8 >> pack))
    return packed << np.uint32(8) | np.uint32(OPAQUE)


def encode(samples: np.ndarray, palette: bool = False, predict: tuple[int, ...] = (), cross: tuple[int, int, int] | None = None,
           green: bool = False, cache_bits: int = 0, references: bool = False, groups: int = 0) -> bytes:
    """A lossless WebP file of height x width x 4 samples, with the chosen parts of the format.

    ``predict`` are modes dealt to blocks of four pixels in turn, ``cross`` the (green to red, green to blue, red to blue) factors.
    """
    height, width, _ = samples.shape
    argb = np.ascontiguousarray(samples[:, :, [2, 1, 0, 3]], np.uint8).view("<u4").reshape(-1).astype(np.uint32)
    bits = _head(width, height, bool((samples[:, :, 3] != 255).any()))
    wide = width
    if palette:
        colours = np.unique(argb)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        argb = _write_palette(bits, argb.reshape(height, width), colours)
        wide = argb.shape[1]
        argb = argb.reshape(-1)
    blocks = (-(-wide >> 2)) * (-(-height >> 2))
    if predict:
        modes = [predict[i % len(predict)] for i in range(blocks)]
        bits.bits(1, 1)
        bits.bits(PREDICTOR, 2)
        bits.bits(0, 3)
        _write_pixels(bits, [m << 8 for m in modes], -(-wide >> 2), False)
        plain = argb.tolist()
        less = [_predict(plain, n, wide, modes[(n // wide >> 2) * (-(-wide >> 2)) + (n % wide >> 2)]) for n in range(len(plain))]
        a, b = np.array(plain, "<u4").view(np.uint8), np.array(less, "<u4").view(np.uint8)
        argb = (a - b).view("<u4").astype(np.uint32)
    if cross:
        to_red, to_blue, red_to_blue = (x & 255 for x in cross)
        elements = np.full(blocks, red_to_blue << 16 | to_blue << 8 | to_red, np.uint32)
        bits.bits(1, 1)
        bits.bits(CROSS_COLOUR, 2)
        bits.bits(0, 3)
        _write_pixels(bits, elements.tolist(), -(-wide >> 2), False)
        argb = _cross(argb, wide, 2, elements, -1)
    if green:
        bits.bits(1, 1)
        bits.bits(SUBTRACT_GREEN, 2)
        argb = _green(argb, -1)
    bits.bits(0, 1)
    _write_pixels(bits, argb.tolist(), wide, True, cache_bits, references, groups)
    return _riff(bits.close())


#: Of stored payloads: the cross-colour element (red to blue, green to blue, green to red), and the largest blocks of the format.
ELEMENT, BLOCKS = 4 << 16 | 8 << 8 | 8, 9
#: Pictures of up to so many colours get a palette; the cache holds 2 to this power of colours at most.
FEW_COLOURS, MOST_CACHE = 16, 9
LONGEST_COPY, FARTHEST = 4096, (1 << 20) - len(DISTANCES)
#: Bits of the code of code lengths; 16 is not used.
_META = [4, 5, *[4] * 11, 5, 5, 5, 0, 4, 4]
_TURNED = np.zeros(1 << 15, np.int64)
for _bit in range(15):
    _TURNED |= (np.arange(1 << 15) >> _bit & 1) << (14 - _bit)
_GAP = 4 * 138

Fields = tuple[np.ndarray, np.ndarray]


@lru_cache(maxsize=1)
def _length_fields() -> tuple[Fields, Fields, Fields]:
    """Values and bits of: the head of a code with its code of code lengths, runs of zeros, and code lengths."""
    code, head = _canonical(_META), _Writer()
    head.bits(0, 1)
    head.bits(15, 4)
    for s in CODE_LENGTH_ORDER:
        head.bits(_META[s], 3)
    head.bits(0, 1)
    gaps = []
    for gap in range(_GAP + 138):
        value = n = 0
        while gap:
            run = min(gap, 138)
            more = [(code[18], run - 11, 7)] if run >= 11 else [(code[17], run - 3, 3)] if run >= 3 else [(code[0], 0, 0)] * run
            for (prefix, bits), extra, wide in more:
                value |= (prefix | extra << bits) << n
                n += bits + wide
            gap -= run
        gaps.append((value, n))
    lengths = [code[i] for i in range(16)]
    return tuple((np.array([v for v, _ in x], np.uint64), np.array([n for _, n in x], np.int64)) for x in ([(head.value, head.n)], gaps, lengths))


def _code_fields(counts: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Complete prefix codes of the alphabets that begin at ``base`` (and end with the last one), by counts: fields as
    they are written, where each code's fields begin, and the codes of all symbols with their bits.

    A length follows from a symbol's share; the room that is left goes to the frequent ones; 11 bits at most.
    """
    many, ends = len(base) - 1, base[1:]
    values, lengths = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    owner = np.searchsorted(base, used, side="right") - 1
    sizes = np.bincount(owner, minlength=many)
    last = np.cumsum(sizes)
    first = last - sizes
    low = used - base[owner]  # within its alphabet
    plain = (sizes > 2) | ((sizes > 0) & (low[last - 1] >= 256))
    starts = np.concatenate([[0], np.cumsum(np.where(plain, 3 + 3 * sizes, 1))])
    value, n = np.zeros(int(starts[-1]), np.uint64), np.zeros(int(starts[-1]), np.int64)
    for i in np.flatnonzero(~plain).tolist():
        own = low[first[i] : last[i]].tolist() or [0]
        wide = 8 if own[0] > 1 else 1
        written, bits = 1 | (len(own) - 1) << 1 | (wide >> 3) << 2 | own[0] << 3, 3 + wide
        if len(own) == 2:
            written, bits = written | own[1] << bits, bits + 8
            values[base[i] + own[1]] = 1
            lengths[base[i] + own[0]] = lengths[base[i] + own[1]] = 1
        value[starts[i]], n[starts[i]] = written, bits
    some = np.flatnonzero(plain)
    if not len(some):
        return value, n, starts, values, lengths
    mine = plain[owner]
    used, owner, low = used[mine], owner[mine], low[mine]
    number = (np.cumsum(plain) - 1)[owner]  # of the code among the plain ones
    sizes = sizes[some]
    last = np.cumsum(sizes)
    first = last - sizes
    share = counts[used]
    share = np.maximum(share, (np.add.reduceat(share, first) // 1024 + 1)[number])
    part, power = np.frexp(np.add.reduceat(share, first)[number] / share)
    hist = np.bincount(16 * number + np.maximum(power - (part == 0.5), 1), minlength=16 * len(some)).tolist()
    for at in range(0, len(hist), 16):
        left = 32768 - sum([hist[at + i] << (15 - i) for i in range(1, 14)])
        while left:
            for i in range(2, 14):
                if (n_ := hist[at + i]) and (more := min(n_, left >> (15 - i))):
                    hist[at + i] = n_ - more
                    hist[at + i - 1] += more
                    left -= more << (15 - i)
    length = np.empty(len(used), np.int64)
    length[np.argsort((number << 40) - share, kind="stable")] = np.repeat(np.arange(len(hist)) & 15, hist)
    order = np.argsort((16 * number + length).astype(np.uint16), kind="stable")
    spans = 32768 >> length[order]
    values[used[order]] = _TURNED[(np.cumsum(spans) - spans) & 32767]  # each complete code ends where the next begins
    lengths[used] = length
    head, gaps, each = _length_fields()
    place = starts[owner] + 1 + 3 * (np.arange(len(used)) - first[number])
    gap = low.copy()
    gap[1:] -= low[:-1] + 1
    gap[first] = low[first]
    place = np.concatenate([place, starts[some] + 1 + 3 * sizes])
    gap = np.concatenate([gap, ends[some] - 1 - used[last - 1]])
    long = np.minimum(gap, _GAP)
    for out, k in ((value, 0), (n, 1)):
        out[starts[some]] = head[k][0]
        out[place] = gaps[k][long]
        out[place + 1] = gaps[k][gap - long]
        out[place[: len(used)] + 2] = each[k][length]
    return value, n, starts, values, lengths


def _packed(fields: list[list[Fields]]) -> list[bytes]:
    """Fields of up to 63 bits, one after the other, for each picture."""
    value, n = (np.concatenate([f[k] for picture in fields for f in picture]) for k in (0, 1))
    many = [sum([len(f[1]) for f in picture]) for picture in fields]
    end = np.cumsum(n)
    stop = end[np.cumsum(many) - 1]
    size = np.diff(stop, prepend=0)
    words = (size >> 6) + 1
    begin = np.cumsum(words) - words
    at = end - n + np.repeat(64 * begin - (stop - size), many)
    some = n > 0
    value, n, at = value[some], n[some], at[some]
    word, shift = at >> 6, at & 63
    out = np.zeros(int(words.sum()) + 1, "<u8")
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(value << shift.astype(np.uint64), first)
    over = np.flatnonzero(shift + n > 64)
    out[word[over] + 1] |= value[over] >> (64 - shift[over]).astype(np.uint64)
    data = out.tobytes()
    return [data[8 * b : 8 * b + (s + 7 >> 3)] for b, s in zip(begin.tolist(), size.tolist(), strict=True)]


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, extra values and extra bits of lengths or distances."""
    v = values - 1
    extra = np.maximum(np.frexp(v)[1] - 2, 0)
    return np.where(v < 4, v, 2 * extra + 2 + (v >> extra & 1)), np.where(v < 4, 0, v & ((1 << extra) - 1)), np.where(v < 4, 0, extra)


@lru_cache(maxsize=16)
def _near_codes(width: int) -> np.ndarray:
    """Codes of short distances by how far back they are; 0 for none."""
    steps = np.maximum(1, _ASIDE + _ABOVE * width)
    out = np.zeros(8 * width + 9, np.int64)
    out[steps[::-1]] = np.arange(len(steps), 0, -1)
    return out


def _copies(pixels: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of stretches of three pixels and more that the last ones with the same three begin as well."""
    none = np.zeros(0, np.int64)
    if len(pixels) < 4:
        return none, none, none
    a, b, c = pixels[:-2], pixels[1:-1], pixels[2:]
    keys = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B) ^ c * np.uint32(0xC2B2AE35)
    keys ^= (keys >> np.uint32(15)) ^ owner[:-2].astype(np.uint32) * np.uint32(0x27D4EB2F)
    before, here = _before(keys), np.arange(len(keys))
    same = (before >= 0) & (a == a[before]) & (b == b[before]) & (c == c[before])
    same &= (here - before <= FARTHEST) & (owner[before] == owner[2:])
    back = np.where(same, here - before, 0)
    start = np.flatnonzero(np.concatenate([[True], back[1:] != back[:-1]]))
    stop = np.append(start[1:], len(back))
    keep = back[start] > 0
    start, stop = start[keep], stop[keep] + 2
    if not len(start):
        return none, none, none
    many = np.minimum(stop, np.append(start[1:], len(pixels))) - start
    keep = many >= 3
    start, many = start[keep], many[keep]
    back = back[start]
    pieces = -(-many // LONGEST_COPY)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, back = np.repeat(start, pieces) + nth * LONGEST_COPY, np.repeat(back, pieces)
        many = np.minimum(np.repeat(many, pieces) - nth * LONGEST_COPY, LONGEST_COPY)
    return start, many, back


def _picture_fields(pictures: list[np.ndarray], widths: list[int]) -> list[list[Fields]]:
    """Main pictures with references, a cache and prefix codes by their own counts."""
    sizes = np.array([len(p) for p in pictures])
    cache = [min(max(len(p).bit_length() - 5, 1), MOST_CACHE) for p in pictures]
    pixels, owner = np.concatenate(pictures), np.repeat(np.arange(len(pictures)), sizes)
    slots = (pixels * np.uint32(CACHE_FACTOR)) >> np.array([32 - c for c in cache], np.uint32)[owner]
    last = _before((slots + (owner << MOST_CACHE)).astype(np.uint16))
    hit = (last >= 0) & (pixels == pixels[last])
    start, many, back = _copies(pixels, owner)
    inside = np.zeros(len(pixels) + 1, np.int8)
    inside[start] += 1
    inside[start + many] -= 1
    token = np.cumsum(inside[:-1], dtype=np.int8) == 0
    token[start] = True
    hit[start] = False
    is_copy = np.zeros(len(pixels), bool)
    is_copy[start] = True
    places = np.flatnonzero(token)
    is_copy, is_hit, of = is_copy[places], hit[places], 5 * owner[places]
    literal, hits, copies = np.flatnonzero(~(is_copy | is_hit)), np.flatnonzero(is_hit), np.flatnonzero(is_copy)
    parts = pixels[places[literal]].astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    distance = back + len(DISTANCES)
    for width in set(widths):
        near = _near_codes(width)
        code = near[np.minimum(back, len(near) - 1)]
        distance = np.where((back < len(near)) & (code > 0) & (np.array(widths)[owner[start]] == width), code, distance)
    far, long = _prefixes(distance), _prefixes(many)
    symbol = np.empty(len(places), np.int64)
    symbol[literal], symbol[hits], symbol[copies] = parts[:, 1], slots[places[hits]] + np.int64(LITERALS + LENGTH_CODES), long[0] + LITERALS
    alphabets = [n for c in cache for n in (LITERALS + LENGTH_CODES + (1 << c), LITERALS, LITERALS, LITERALS, DISTANCE_CODES)]
    base = np.concatenate([[0], np.cumsum(alphabets)])
    symbol += base[of]
    given = [base[of[literal] + i] + parts[:, k] for i, k in ((1, 2), (2, 0), (3, 3))]
    far_symbol = base[of[copies] + 4] + far[0]
    counts = np.bincount(np.concatenate([symbol, *given, far_symbol]), minlength=int(base[-1]))
    written, bits, starts, codes, lengths = _code_fields(counts, base)
    value, n = codes[symbol], lengths[symbol]
    for rows, items in (
        (literal, [(codes[s], lengths[s]) for s in given]),
        (copies, [(long[1].astype(np.uint64), long[2]), (codes[far_symbol], lengths[far_symbol]), (far[1].astype(np.uint64), far[2])]),
    ):
        values, wide = value[rows], n[rows]
        for more, extra in items:
            values |= more << wide.astype(np.uint64)
            wide += extra
        value[rows], n[rows] = values, wide
    stops = np.searchsorted(places, np.cumsum(sizes)).tolist()
    out, low = [], 0
    for j, stop in enumerate(stops):
        head = np.array([1 | cache[j] << 1], np.uint64), np.array([6])  # the cache, and one group of codes
        a, b = starts[5 * j], starts[5 * j + 5]
        out.append([head, (written[a:b], bits[a:b]), (value[low:stop], n[low:stop])])
        low = stop
    return out


def _fields_of(bits: _Writer) -> Fields:
    value, n = int.from_bytes(bits.done, "little") | bits.value << 8 * len(bits.done), 8 * len(bits.done) + bits.n
    at = range(0, n, 32)
    return np.array([value >> i & 0xFFFFFFFF for i in at], np.uint64), np.array([min(32, n - i) for i in at])


@lru_cache(maxsize=1)
def _stored_transforms() -> Fields:
    """Predictor, cross-colour and subtract-green: the same for all sizes, as one value in all blocks takes no bits."""
    bits = _Writer()
    for kind, value in ((PREDICTOR, FROM_LEFT << 8), (CROSS_COLOUR, ELEMENT)):
        bits.bits(1, 1)
        bits.bits(kind, 2)
        bits.bits(BLOCKS - 2, 3)
        _write_pixels(bits, [value], 1, False)
    bits.bits(1, 1)
    bits.bits(SUBTRACT_GREEN, 2)
    bits.bits(0, 1)
    return _fields_of(bits)


def store(payload: bytes, row: int) -> bytes:
    """A payload of whole rows as an opaque picture; see ``store_all``."""
    return store_all([payload], row)[0]


def store_all(payloads: list[bytes], row: int) -> list[bytes]:
    """Payloads of whole rows, up to 32 side by side, each as an opaque picture of three samples a pixel: a palette where there are few
    colours, predicted from the pixel before, less what red and green tell of the others; then references, cache hits
    and literals in prefix codes by the picture's own counts.

    Very long payloads get wider rows, so that the height stays within the format.
    """
    if len(payloads) > TOGETHER:
        return store_all(payloads[:TOGETHER], row) + store_all(payloads[TOGETHER:], row)
    heads, pictures, widths, alike = [], [], [], {}
    for j, payload in enumerate(payloads):
        wide = row
        while len(payload) // wide > MAX_SIDE:
            wide *= 2
        height, width = -(-len(payload) // wide), wide // 3
        if width > MAX_SIDE:
            raise ValueError("a payload beyond what one picture holds")
        parts = np.full((height, width, 4), 255, np.uint8)
        parts[:, :, [2, 1, 0]] = np.frombuffer(payload.ljust(height * wide, b"\xff"), np.uint8).reshape(height, width, 3)
        bits = _head(width, height, False)
        argb = parts.view("<u4").reshape(height, width)
        if len(set(argb[0, :64].tolist())) <= FEW_COLOURS and len(colours := np.unique(argb)) <= FEW_COLOURS:
            parts = _write_palette(bits, argb, colours).astype("<u4").view(np.uint8).reshape(height, -1, 4)
        heads.append(_fields_of(bits))
        pictures.append(parts)
        widths.append(parts.shape[1])
        alike.setdefault(parts.shape[1], []).append(j)
    for width, which in alike.items():  # those of one width on top of each other
        parts = np.concatenate([pictures[j] for j in which])
        stops = np.cumsum([len(pictures[j]) for j in which])
        first = np.concatenate([[0], stops[:-1]])
        less = parts.copy()
        less[:, 1:] -= parts[:, :-1]
        less[1:, 0] -= parts[:-1, 0]
        less[first, 0] = parts[first, 0]
        less[first, 0, 3] -= np.uint8(255)
        argb = _green(_cross(less.view("<u4").reshape(-1).astype(np.uint32, copy=False), width, BLOCKS, np.array([ELEMENT], np.uint32), -1), -1)
        for j, picture in zip(which, np.split(argb, stops[:-1] * width), strict=True):
            pictures[j] = picture
    fields = _picture_fields(pictures, widths)
    return [_riff(body) for body in _packed([[head, _stored_transforms(), *rest] for head, rest in zip(heads, fields, strict=True)])]


# ---------------------------------------------------------------- operators

ROW = 576
#: Bytes of the texts that a task stores and reads side by side, so that arrays fit a processor's cache.
TOGETHER_BYTES = 40_000


@lru_cache(maxsize=1024)
def _areas(side: int) -> tuple[list[int], list[int]]:
    """Begins and lengths of up to eight parts of a side."""
    parts = np.array_split(np.arange(side), min(8, side))
    return [int(p[0]) for p in parts], [len(p) for p in parts]


def feature_of(pixels: np.ndarray) -> str:
    """Mean and spread of each colour, and which of 8 x 8 areas are brighter than the whole: a small description of a picture."""
    colours = pixels[:, :, :3]
    flat = colours.reshape(-1, 3)
    grey = colours.sum(axis=2, dtype=np.uint32)
    (rows, high), (columns, wide) = _areas(grey.shape[0]), _areas(grey.shape[1])
    sums = np.add.reduceat(np.add.reduceat(grey, rows, axis=0, dtype=np.uint64), columns, axis=1)
    sizes = np.outer(high, wide)
    bright = (sums * np.uint64(grey.size) > np.uint64(grey.sum(dtype=np.uint64)) * sizes.astype(np.uint64)).reshape(-1)
    marks = "".join("1" if b else "0" for b in bright)
    means, spreads = flat.mean(axis=0), flat.std(axis=0)
    return "m=" + "/".join(f"{x:.3f}" for x in means) + ";s=" + "/".join(f"{x:.3f}" for x in spreads) + f";h={int(marks, 2):x}"


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` per row: the text in UTF-8 (null: empty), padded with bytes 255 to whole rows, as a picture."""

    def make():
        def row(given):
            raw = (given["text"] or "").encode("utf-8", "replace")
            size = max(ROW, -(-len(raw) // ROW) * ROW)
            return [{"doc_id": given["doc_id"], "n_bytes": len(raw), "media": store(raw.ljust(size, b"\xff"), ROW)}]

        return row

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """``doc_id, width, height, pixels`` per row of ``doc_id, media``; pixels are rows of red, green, blue and alpha.

    Null media and bytes that are no lossless WebP give nulls; rows that repeat each get a row; other columns
    are not read; an empty table gives an empty table.
    """

    def make():
        def row(given):
            try:
                pixels = decode(given["media"] or b"")
            except Broken:
                return [{"doc_id": given["doc_id"], "width": None, "height": None, "pixels": None}]
            return [{"doc_id": given["doc_id"], "width": pixels.shape[1], "height": pixels.shape[0], "pixels": pixels.tobytes()}]

        return row

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_rows(media.select("doc_id", "media"), make, f"doc_id {kind}, width int, height int, pixels binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each whole text, read the stored bytes back, and describe both; media and pixels stay in the task.

    Defined results: a null or empty text is one row of 255; rows that repeat each get a row; other columns are
    not read; an empty table gives an empty table.
    """

    def make():
        def described(rows):
            payloads = [raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\xff") for _, raw in rows]
            media = store_all(payloads, ROW)
            out = []
            for (doc_id, raw), stored, pixels in zip(rows, media, decode_all(media), strict=True):
                payload = pixels[:, :, :3].tobytes()[: max(ROW, -(-len(raw) // ROW) * ROW)]
                out.append({
                    "doc_id": doc_id, "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature_of(pixels),
                })
            return out

        def batch(given):
            out, rows, size = [], [], 0
            for one in given:
                raw = (one["text"] or "").encode("utf-8", "replace")
                if rows and (len(rows) == TOGETHER or size + len(raw) > TOGETHER_BYTES):
                    out += described(rows)
                    rows, size = [], 0
                rows.append((one["doc_id"], raw))
                size += len(raw)
            return out + (described(rows) if rows else [])

        return batch

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_lists(
        docs.select("doc_id", "text"), make,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op8_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over ``documents``."""
    return media_digests(table(spark, sf_dir, "documents"))
