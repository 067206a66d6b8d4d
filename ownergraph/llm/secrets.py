"""Secret scans: known shapes, and runs that a tiktoken vocabulary spends many tokens on.

Prose and code names are what the vocabulary was made from, so they take few tokens; random strings take one
token for about two characters.  Known digests and identifiers are random too and are left out by shape.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ownergraph.llm.bpe import read_vocabulary
from ownergraph.llm.common import map_rows
from ownergraph.session import table

#: A run is suspect from this length, and below so many characters a token.
MIN_RUN, MAX_RATIO = 20, 2.2
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the length may stand in the pattern
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
#: Digests in hexadecimal (MD5, SHA-1, SHA-2) and what stands before them or before digests in base64.
_DIGEST = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}")
_DIGEST_NAME = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512)|integrity|checksum|digest|etag|commit)[\"']?[\s:=_-]*[\"']?", re.IGNORECASE)
_NAMED = re.compile(r"sha(?:1|256|384|512)-")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words and short numbers with separators between all of them: names, paths, slugs.  Each part is of one kind, so the pattern is unambiguous.
_NAMES = re.compile(r"[/_+=-]*(?:[A-Za-z]+|[0-9]{1,8})(?:[/_+=-]+(?:[A-Za-z]+|[0-9]{1,8}))+[/_+=-]*")
_LETTERS = re.compile(r"[A-Za-z]+")
#: Links, and what follows an @; runs in them are parts of known identifiers.
_LINK = re.compile(r"(https?://|www\.)\S*")
_HOST = re.compile(r"@[\w.-]*")


@lru_cache(maxsize=2)
def encoding(data: bytes):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the known shapes, each kind leftmost and without overlaps, in code points."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _is_name(run: str, coder) -> bool:
    """Whether separated parts are numbers and words; a word is one token, or takes no more tokens than the threshold."""
    if not _NAMES.fullmatch(run):
        return False
    sizes = ((len(w), len(coder.encode_ordinary(w))) for w in _LETTERS.findall(run))
    return all(tokens == 1 or letters >= MAX_RATIO * tokens for letters, tokens in sizes)


def _reaches(spans: list[tuple[int, int]], at: int) -> bool:
    """Whether the last of the disjoint ``spans`` that starts before ``at`` goes on to it."""
    i = bisect_left(spans, (at,))
    return i > 0 and spans[i - 1][1] >= at


def _introduced(text: str) -> list[list[tuple[int, int]]]:
    """Disjoint spans, however long, that make a run which they reach a digest or a part of an identifier."""
    return [
        [m.span() for m in _DIGEST_NAME.finditer(text)],
        [(m.end(1) - 1, m.end()) for m in _LINK.finditer(text)],  # a run counts from the end of the link's prefix on
        [m.span() for m in _HOST.finditer(text)],
    ]


def _covers(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The disjoint stretches that ``spans``, by start, cover."""
    out: list[tuple[int, int]] = []
    for start, end, _ in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def random_spans(text: str, base: list[tuple[int, int, str]], coder) -> list[tuple[int, int, str]]:
    """Runs with letters and digits, outside of the base spans, that are no digest or identifier, and that take more
    than a token for each ``MAX_RATIO`` characters; names whose numbers alone take the tokens are identifiers."""
    out = []
    covered, introduced = _covers(base), None
    for m in _RUN.finditer(text):
        run, start, end = m[0], m.start(), m.end()
        if run.isalpha() or run.isdigit() or not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
            continue
        i = bisect_left(covered, (end,))
        if i > 0 and covered[i - 1][1] > start:
            continue
        if _DIGEST.fullmatch(run) or _UUID.fullmatch(run) or _NAMED.match(run) or text[end : end + 1] == "@":
            continue
        if len(run) >= MAX_RATIO * len(coder.encode_ordinary(run)) or _is_name(run, coder):
            continue
        if introduced is None:
            introduced = _introduced(text)
        if not any(_reaches(spans, start) for spans in introduced):
            out.append((start, end, "random"))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def all_spans(text: str, coder) -> tuple[list, list]:
    """Base spans, and these with the method's, by start and then kind."""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, coder), key=lambda s: (s[0], KINDS.index(s[2])))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``[SECRET]`` for each stretch that spans cover; spans come by start."""
    parts, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan_secrets(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` per row of ``docs``.

    ``spans`` is kind:start:end by start, then kind, joined by commas; positions are code points, ends exclusive.
    Defined results: null and empty texts have no span; rows that repeat each get a row; other columns are not read; an empty
    table gives an empty table.
    """
    shared = read_vocabulary(docs.sparkSession, vocabulary)

    def make():
        coder = encoding(shared.value)

        def row(given):
            text = given["text"] or ""
            base, spans = all_spans(text, coder)
            count = {k: sum(s[2] == k for s in spans) for k in KINDS}
            return [{
                "doc_id": given["doc_id"], "n_assign": count["assign"], "n_access": count["access"], "n_hex": count["hex"],
                "n_random": count["random"], "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(),
                "spans": _joined(spans),
            }]

        return row

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(
        docs.select("doc_id", "text"), make,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string",
    )


def redact_secrets(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with ``[SECRET]`` in place of every span in ``text``; all rows stay, other columns are carried.

    A null text stays null; ``n_chars``, where there is one, follows the text.
    """
    shared = read_vocabulary(docs.sparkSession, vocabulary)

    def make():
        coder = encoding(shared.value)

        def row(given):
            text = given["text"]
            if text:
                _, spans = all_spans(text, coder)
                if spans:
                    given["text"] = redacted(text, spans)
                    if "n_chars" in given:
                        given["n_chars"] = len(given["text"])
            return [given]

        return row

    return map_rows(docs, make, docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Contract query over ``documents``; the vocabulary's path is a parameter."""
    import public_tokenizers

    return scan_secrets(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
