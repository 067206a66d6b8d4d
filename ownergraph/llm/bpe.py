"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

The vocabulary is a tokenizer file of the ``tokenizers`` library.  Every pre-token streams through the
transducer, a window of twice the lookahead: a token is emitted once it is stable, that is once it ends
``lookahead`` symbols before the window does; what follows a stable boundary encodes by itself, so the window
moves there and its memory stays constant.  The end of a pre-token makes all that is held stable.  A bounded
memory of short pre-tokens stands in front of it.

``lookahead`` follows from the merge list.  A merge (u, v) can be undone from its right only by an earlier
merge that takes v (or that takes a part of v, or of u, before they are formed), which again depends on what
follows it: extent(u, v) = max over earlier merges (v, x) of |x| + extent(v, x), over the merges that form v,
and over those of u less |v|.  Merges form their parts first, so one pass in order of rank has them all.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession

from ownergraph.llm.common import map_rows
from ownergraph.session import table

#: Entries of a task's memory of pre-tokens, and the longest of them.
CACHED_PIECES, CACHED_CHARS = 400_000, 40
#: Characters that are pre-tokenised at once, and bytes that the transducer is fed with.
CHUNK, FEED = 1 << 18, 1 << 10
#: Pieces up to here are merged by plain scans, longer ones with a heap.
SCAN = 48
#: The rank of a pair that does not merge, and a symbol that another has taken.
NEVER, GONE = 1 << 30, -1
#: The white space of the tokenizers' regular expressions.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(points: list[int]) -> str:
    out, start, last = [], None, None
    for p in [*points, None]:
        if start is not None and p != last + 1:
            out.append(f"\\u{start:04x}-\\u{last:04x}")
            start = None
        if start is None:
            start = p
        last = p
    return "".join(out)


@lru_cache(maxsize=1)
def _classes() -> tuple[str, str, str]:
    """Letters, numbers, and what old and new Unicode tables may differ on or cases depend on: that goes to the library."""
    plane = [(p, unicodedata.category(chr(p)), unicodedata.ucd_3_2_0.category(chr(p))) for p in range(0x10000)]
    letters = _ranges([p for p, c, _ in plane if c[0] == "L"])
    numbers = _ranges([p for p, c, _ in plane if c[0] == "N"])
    unsure = _ranges([p for p, c, old in plane if old == "Cn" or c[0] != old[0] or p in (0x3A3, 0x130) or c == "Cs"])
    return letters, numbers, unsure + "\\U00010000-\\U0010ffff"


def _byte_alphabet() -> list[str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Codec:
    """Encoder and decoder of one tokenizer file with byte-level BPE, with or without a word-end suffix."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain byte-level BPE is read")
        self.library = Tokenizer.from_str(data.decode())
        self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, merge in enumerate(model["merges"]):  # distinct pairs, in order of rank
            self.ranks[tuple(merge.split(" ") if isinstance(merge, str) else merge)] = rank
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.splitter = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.lowers = bool(spec["normalizer"])
        self.byte_decoder = bool(spec["decoder"])
        letters, numbers, unsure = _classes()
        self.unsure = re.compile(f"[{unsure}]")
        self.spaces = re.compile(f"[{SPACES}]+")
        self.cut = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])|(?<=[{letters}])(?=[{numbers}])|(?<=[{numbers}])(?=[{letters}])")
        tails = "'s|'t|'re|'ve|'m|'ll|'d"
        if self.lowers:
            self.pieces = re.compile(f"{tails}|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+")
        else:
            self.pieces = re.compile(f"{tails}| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
        self.alphabet = _byte_alphabet()
        self.bytes_of = {c: b for b, c in enumerate(self.alphabet)}
        self.inner = [self.vocab[c] for c in self.alphabet]
        self.final = [self.vocab[c + self.suffix] for c in self.alphabet]
        self.result = [self.vocab[u + v] for u, v in self.ranks]
        self.rank_of = {(self.vocab[u], self.vocab[v]): rank for (u, v), rank in self.ranks.items()}.get
        self.width = {i: self._width(t) for t, i in self.vocab.items()}
        self.lookahead = self._lookahead()
        self.window = max(2 * self.lookahead, 16)

    def _width(self, token: str) -> int:
        """Symbols of a token; the last one may carry the word's end."""
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) and token != self.suffix else 0)

    def _lookahead(self) -> int:
        """Symbols to the right of a token that can still change it."""
        long = self._width
        formed: dict[str, int] = defaultdict(int)
        taken: dict[str, int] = defaultdict(int)
        made = set()
        for (u, v), _ in sorted(self.ranks.items(), key=lambda x: x[1]):
            for part in (u, v):
                if part not in made and long(part) > 1:
                    raise ValueError(f"the merge list uses {part!r} before it is formed")
            extent = max(formed[v], taken[v], max(formed[u], taken[u]) - long(v), 0)
            taken[u] = max(taken[u], long(v) + extent)
            formed[u + v] = max(formed[u + v], extent)
            made.add(u + v)
        return max([0, *formed.values(), *taken.values()])

    def _merged(self, ids: list[int]) -> list[int]:
        """The tokens of symbols that nothing follows: the lowest merge first, from the left."""
        rank_of, result = self.rank_of, self.result
        if len(ids) <= SCAN:
            ranks = [rank_of(pair, NEVER) for pair in zip(ids, ids[1:], strict=False)]
            while ranks and (best := min(ranks)) != NEVER:
                i = ranks.index(best)
                ids[i : i + 2] = (result[best],)
                del ranks[i]
                if i:
                    ranks[i - 1] = rank_of((ids[i - 1], ids[i]), NEVER)
                if i < len(ranks):
                    ranks[i] = rank_of((ids[i], ids[i + 1]), NEVER)
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, *pair) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank_of(pair, NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, u, v = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != u or ids[j] != v:
                continue
            ids[i], ids[j] = result[rank], GONE
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of((ids[i], ids[k]), NEVER)) != NEVER:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := rank_of((ids[h], ids[i]), NEVER)) != NEVER:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x != GONE]

    def _symbols(self, raw: bytes, last: bool) -> list[int]:
        out = list(map(self.inner.__getitem__, raw))
        if last and out:
            out[-1] = self.final[raw[-1]]
        return out

    def encode_bytes(self, raw: bytes) -> Iterator[list[int]]:
        """The ids of one pre-token, as they become stable."""
        stream = Transducer(self)
        for at in range(0, len(raw), FEED):
            yield from stream.feed(raw[at : at + FEED])
        yield stream.finish()

    def _segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary stretches, and the ids of added tokens between them."""
        at = 0
        if self.splitter is not None and "<|" in text:
            for found in self.splitter.finditer(text):
                yield text[at : found.start()], None
                yield "", self.added[found[0]]
                at = found.end()
        yield text[at:] if at else text, None

    def _chunks(self, text: str) -> Iterator[str]:
        """Parts of bounded length; cuts before white space, or between letters and numbers, change no pre-token."""
        at = 0
        while len(text) - at > CHUNK and (found := self.cut.search(text, at + CHUNK)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii() and self.unsure.search(text):
            if self.library.normalizer is not None:
                text = self.library.normalizer.normalize_str(text)
            back = self.bytes_of
            return [bytes(back[c] for c in s).decode() for s, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        if self.lowers:
            text = self.spaces.sub(" ", unicodedata.normalize("NFC", text)).lower()
        return self.pieces.findall(text)

    def encode(self, text: str, memory: Pieces) -> Iterator[list]:
        """What ``memory`` holds for each pre-token, for a bounded stretch of the text at a time."""
        for part, special in self._segments(text):
            if special is not None:
                yield [memory.wrap((special,))]
                continue
            for chunk in self._chunks(part):
                yield list(map(memory.__getitem__, self._pieces(chunk)))

    def decoder(self) -> Decoder:
        return Decoder(self)

    def native(self):
        """A function that encodes a short pre-token by the same merges in the tiktoken library; None with a word-end suffix."""
        if self.suffix or self.result != sorted(set(self.result)):
            return None
        import public_tokenizers
        import tiktoken

        ranks = {bytes(self.bytes_of[c] for c in token): i for token, i in self.vocab.items()}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Transducer:
    """Bytes of one pre-token in, stable ids out; it never holds more than a window and what one feed brings."""

    def __init__(self, codec: Codec):
        self.codec, self.held = codec, b""

    def feed(self, raw: bytes) -> Iterator[list[int]]:
        codec = self.codec
        self.held += raw
        while len(self.held) > codec.window:
            ready, end = [], 0
            for token in codec._merged(codec._symbols(self.held[: codec.window], False)):
                if end + codec.width[token] > codec.window - codec.lookahead:
                    break
                end += codec.width[token]
                ready.append(token)
            self.held = self.held[end:]
            yield ready

    def finish(self) -> list[int]:
        """The rest, once no byte follows."""
        rest, self.held = self.held, b""
        return self.codec._merged(self.codec._symbols(rest, True))


class Pieces(dict):
    """A bounded memory from pre-tokens to their ids, in the form that ``wrap`` gives them."""

    def __init__(self, codec: Codec, wrap, short=None):
        """``short`` may encode pre-tokens that are remembered and hold no character that Unicode tables differ on."""
        super().__init__()
        self.codec, self.wrap, self.short = codec, wrap, short

    def __missing__(self, piece: str):
        if self.short is not None and len(piece) <= CACHED_CHARS and (piece.isascii() or not self.codec.unsure.search(piece)):
            value = self.wrap(self.short(piece))
        else:
            value = self.wrap(tuple(chain.from_iterable(self.codec.encode_bytes(piece.encode("utf-8", "replace")))))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = value
        return value


class Decoder:
    """Ids in, text out, at any cut of the ids: keeps the bytes of an unfinished character, or whether a token came before."""

    def __init__(self, codec: Codec):
        self.codec, self.begun = codec, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        tokens = self.codec.tokens
        if not self.codec.byte_decoder:  # tokens as they are, one blank between them
            text = " ".join(map(tokens.__getitem__, ids))
            if ids and self.begun:
                text = " " + text
            self.begun = self.begun or bool(ids)
            return text
        back = self.codec.bytes_of
        return self.utf8.decode(bytes([back[c] for c in "".join(map(tokens.__getitem__, ids))]), last)


@lru_cache(maxsize=2)
def load(data: bytes) -> Codec:
    return Codec(data)


def read_vocabulary(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast: a few MB, whatever the input."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids`` per row: the ids of the whole text (null: empty), as the tokenizers library gives them."""
    shared = read_vocabulary(docs.sparkSession, vocabulary)

    def make():
        codec = load(shared.value)
        memory = Pieces(codec, tuple)

        def row(given):
            ids = [i for part in codec.encode(given["text"] or "", memory) for i in chain.from_iterable(part)]
            return [{"doc_id": given["doc_id"], "ids": ids}]

        return row

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` per row of ``doc_id, ids``; null ids give an empty text."""
    shared = read_vocabulary(encoded.sparkSession, vocabulary)

    def make():
        codec = load(shared.value)
        return lambda given: [{"doc_id": given["doc_id"], "text": codec.decoder().feed(given["ids"] or [], True)}]

    return map_rows(encoded.select("doc_id", "ids"), make, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row: encode, decode what was encoded, and keep digests only.

    Defined results: null and empty texts have no token and the digests of nothing; rows that repeat each
    get a row; other columns are not read; an empty table gives an empty table.  A text of any length needs
    the memory of one stretch.
    """
    shared = read_vocabulary(docs.sparkSession, vocabulary)

    def make():
        codec = load(shared.value)
        memory = Pieces(codec, tuple)
        said = {i: str(i) for i in codec.tokens}

        def row(given):
            ids_sha, text_sha, n, decoder = hashlib.sha256(), hashlib.sha256(), 0, codec.decoder()
            for part in codec.encode(given["text"] or "", memory):
                ids = list(chain.from_iterable(part))
                if ids:
                    ids_sha.update(((" " if n else "") + " ".join(map(said.__getitem__, ids))).encode())
                    text_sha.update(decoder.feed(ids).encode())
                    n += len(ids)
            text_sha.update(decoder.feed([], True).encode())
            return [{"doc_id": given["doc_id"], "n_tokens": n, "ids_sha256": ids_sha.hexdigest(), "decoded_sha256": text_sha.hexdigest()}]

        return row

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Contract query over ``documents``; the vocabulary's path is a parameter."""
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))
