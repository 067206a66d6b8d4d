"""MinHash near-dedup: one permutation, optimal densification, banded buckets, star-shaped candidate edges.

Documents with equal shingle sets are one class first, so copies cost one row each and no pair.  Classes
meet in band buckets; every member of a bucket is compared with the bucket's centre only, so a bucket of n
gives n - 1 pairs.  Every candidate is confirmed on the full sets.  A star can miss two members that are
alike while neither is like the centre: two more turns of stars join the components that share a bucket by
other members.  Whatever then still shares a bucket across components is joined exactly, by the rarest
shingles of the full sets, so that every alike pair of a bucket is linked and every other one refuted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.llm.common import bounded_batches
from ownergraph.operators.components import connected_components
from ownergraph.session import discard, materialise, table

BINS, ROWS = 128, 4
#: Shuffle partitions to a file of the tables between steps.
SHRINK = 4
#: Turns of stars between components before the exact join; they only make that join smaller.
TURNS = 2
#: Pairs of one document that meet in a task.
FAN = 256
BANDS = BINS // ROWS
_SHIFT = np.uint64(64 - 7)
_EDGES = np.arange(BINS, dtype=np.uint64) << _SHIFT
#: For every bin the order in which it asks the others when it is empty.
_PROBES = np.stack([np.random.default_rng(i).permutation(BINS) for i in range(BINS)])
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BAND_SEEDS = np.random.default_rng(BINS).integers(1, 2**63, BANDS, dtype=np.uint64)
#: Words whose hashes a task remembers, and the longest of them.
CACHED_WORDS, CACHED_BYTES = 200_000, 48


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


def shingle_set(text: str | None, words: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles; fewer words are one shingle, none give none.

    A-Z are lower-cased; words are runs without U+0020 and U+0009 to U+000D, which is what bytes.split() splits at.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(words, len(ids))
    n = len(ids) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mix(out ^ ids[i : i + n])
    return np.unique(out)


def one_permutation(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash in each of the bins; an empty bin takes that of the first filled one in its own order."""
    at = np.searchsorted(shingles, _EDGES)
    first = shingles[np.minimum(at, len(shingles) - 1)]
    filled = (at < len(shingles)) & ((first >> _SHIFT) == np.arange(BINS, dtype=np.uint64))
    if not filled.all():
        empty = np.flatnonzero(~filled)
        probes = _PROBES[empty]
        first[empty] = first[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
    return first


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    key = _BAND_SEEDS
    for i in range(ROWS):
        key = _mix(key ^ rows[:, i])
    return key.view(np.int64)


def sketch(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``doc_id, n_shingles, class_key, bands`` per row; the key of the whole set and the bands are null for empty sets."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, shingle_words, hashes)
                sizes.append(len(found))
                if len(found):
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(one_permutation(found)))
                else:
                    keys.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("print"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "print", "n_shingles", "class_key", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("print"))
    return rows.mapInArrow(run, "doc_id long, print long, n_shingles long, class_key binary, bands array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Those of the written ``pairs`` (a, b) whose full sets reach the similarity, as ``src, dst``.

    Sorted by a, so that a's set is made once.  The text of an a with many pairs is dealt to several tasks.
    """
    bounded_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, left = _WordHashes(), None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            text_a, text_b = batch.column("text_a"), batch.column("text_b")
            keep = []
            for i, key in enumerate(a):
                if key != last:
                    last, left = key, shingle_set(text_a[i].as_py(), shingle_words, hashes)
                right = shingle_set(text_b[i].as_py(), shingle_words, hashes)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, k in zip(v, keep, strict=True) if k], pa.binary()) for v in (a, b)], names=["src", "dst"]
            )

    crowds = materialise(
        pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > FAN).select("a", F.ceil(F.col("n") / FAN).cast("int").alias("deals")),
        "minhash-crowds", SHRINK,
    )
    dealt = pairs.join(crowds, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "deals"), F.lit(0)).cast("int").alias("deal"))
    lefts = (
        texts.select(F.col("class_key").alias("a"), F.col("text").alias("text_a")).join(crowds, "a", "left")
        .select("a", "text_a", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)).alias("deal"))
    )
    joined = (
        dealt.join(texts.select(F.col("class_key").alias("b"), F.col("text").alias("text_b")), "b")
        .join(lefts.hint("merge"), ["a", "deal"])
        .select("a", "b", "text_a", "text_b")
    )
    found = materialise(joined.mapInArrow(run, "src binary, dst binary"), "minhash-links", SHRINK)
    discard(crowds)
    return found


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``, by links of at least ``percent`` % Jaccard.

    ``component_id`` is the smallest doc_id that links reach.  Defined results: empty sets (null, empty or
    blank texts) link with nothing and are their own component; a null doc_id is never linked, keeps a null
    component and is kept; rows that repeat a doc_id each get a row; an empty table gives an empty table.
    """
    return _verdicts(docs, shingle_words, percent).drop("print")


def _verdicts(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The rows of ``near_duplicates`` with ``print``, the hash of their text."""
    rows = docs.select("doc_id", "text")
    sketched = materialise(sketch(rows, shingle_words), "minhash-sketch")
    linkable = sketched.where("doc_id IS NOT NULL AND class_key IS NOT NULL")
    classes = linkable.groupBy("class_key").agg(F.min(F.struct("doc_id", "print")).alias("first"))
    members = (
        linkable.select("doc_id", "print", "class_key", "bands")
        .join(classes.select(F.col("first.doc_id").alias("doc_id"), F.col("first.print").alias("print"), "class_key"), ["doc_id", "print", "class_key"])
        .dropDuplicates(["class_key"])
        .select("class_key", F.explode("bands").alias("band"))
    )
    crowded = members.groupBy("band").agg(F.min("class_key").alias("centre"), F.max("class_key").alias("other")).where("centre <> other")
    buckets = materialise(members.join(crowded, "band").select("band", "class_key", "centre"), "minhash-buckets")
    wanted = buckets.select("class_key").distinct().join(classes, "class_key").select(
        "class_key", F.col("first.doc_id").alias("doc_id"), F.col("first.print").alias("print")
    )
    texts = materialise(
        rows.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("print"))
        .join(wanted.hint("shuffle_hash"), ["doc_id", "print"])
        .groupBy("class_key").agg(F.min("text").alias("text")),
        "minhash-texts",
    )
    pairs = materialise(buckets.where("class_key <> centre").select(F.col("centre").alias("a"), F.col("class_key").alias("b")).distinct(), "minhash-pairs", SHRINK)
    links = [_confirmed(pairs, texts, shingle_words, percent)]
    discard(pairs)
    parts = connected_components(links[0])
    for turn in range(TURNS):
        crowds = materialise(_still_open(buckets, parts), "minhash-buckets", SHRINK)
        discard(buckets)
        buckets = crowds
        if buckets.isEmpty():
            break
        pairs = materialise(_next_stars(buckets, turn), "minhash-pairs", SHRINK)
        links.append(_confirmed(pairs, texts, shingle_words, percent))
        after = _merged(parts, links[-1])
        discard(pairs, parts)
        parts = after
    members = materialise(_still_open(buckets, parts).select("class_key", "part").distinct(), "minhash-open", SHRINK)
    if not members.isEmpty():
        pairs = materialise(_exact_pairs(members, texts, shingle_words, percent), "minhash-pairs", SHRINK)
        links.append(_confirmed(pairs, texts, shingle_words, percent))
        after = _merged(parts, links[-1])
        discard(pairs, parts)
        parts = after
    discard(buckets, members, texts, *links)
    smallest = (
        parts.join(classes, F.col("node") == F.col("class_key"))
        .groupBy("component").agg(F.min("first.doc_id").alias("smallest"))
    )
    named = classes.join(parts, F.col("class_key") == F.col("node"), "left").join(smallest, "component", "left").select(
        "class_key", F.coalesce("smallest", "first.doc_id").alias("found")
    )
    return (
        sketched.select("doc_id", "print", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class_key")).alias("class_key"))
        .join(named, "class_key", "left")
        .select("doc_id", "print", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _merged(parts: DataFrame, found: DataFrame) -> DataFrame:
    """``parts`` (node, component) after further links; only the components that these touch are walked through."""
    if found.isEmpty():
        return materialise(parts, "minhash-parts", SHRINK)
    part = parts.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    ends = found
    for end in ("src", "dst"):
        ends = ends.join(part, F.col(end) == F.col("__n"), "left").withColumn(end, F.coalesce("__c", end)).drop("__n", "__c")
    step = connected_components(ends)
    moved = parts.join(step.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select(
        "node", F.coalesce("to", "component").alias("component")
    )
    after = materialise(moved.unionByName(step.join(parts, "node", "left_anti")), "minhash-parts", SHRINK)
    discard(step)
    return after


def _still_open(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """``band, class_key, part`` of the buckets that hold several components and more than the two members of one pair."""
    labelled = buckets.select("band", "class_key").join(parts, F.col("class_key") == F.col("node"), "left").select(
        "band", "class_key", F.coalesce("component", "class_key").alias("part")
    )
    bands = (
        labelled.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
        .where("low <> high AND n > 2").select("band")
    )
    return labelled.join(bands, "band")


def _next_stars(buckets: DataFrame, turn: int) -> DataFrame:
    """Candidate pairs across the components of a bucket: one member of the largest with one of each other component.

    Which members these are differs from bucket to bucket and turn to turn, so that a large component's members take turns.
    """
    standing = buckets.groupBy("band", "part").agg(
        F.min_by("class_key", F.xxhash64("class_key", "band", F.lit(turn))).alias("class_key"), F.count("*").alias("n")
    )
    centres = standing.groupBy("band").agg(F.max(F.struct("n", F.xxhash64("part", F.lit(turn)).alias("order"), "part", "class_key")).alias("centre"))
    return (
        standing.join(centres, "band").where("part <> centre.part")
        .select(F.least("class_key", "centre.class_key").alias("a"), F.greatest("class_key", "centre.class_key").alias("b")).distinct()
    )


def _exact_pairs(members: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different parts, among them all that reach the similarity: a prefix-filter join on the full sets.

    Shingles that one part alone has are left out; rare ones come before frequent ones.  Two alike sets of n and m
    shingles share ceil((n + m) * percent / (100 + percent)) of them, so the first that they share has at least as
    many left in either order: an item with fewer left cannot be the first that a pair of these sizes shares.  A core
    that thousands hold stands at the end of that order and is reached only by sets that hardly differ from it.  An
    item's largest part is met by the others alone, so that what belongs together already is not compared again.
    """
    bounded_batches(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t, shingle_words, hashes).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_key"), batch.column("part"), pa.array(sets, pa.list_(pa.int64()))], names=["class_key", "part", "shingles"]
            )

    sets = materialise(
        members.join(texts, "class_key").select("class_key", "part", "text").mapInArrow(run, "class_key binary, part binary, shingles array<long>"),
        "minhash-sets",
    )
    items = sets.select("class_key", "part", F.size("shingles").alias("n"), F.explode("shingles").alias("x"))
    across = (
        items.groupBy("x").agg(F.count("*").alias("often"), F.min("part").alias("low"), F.max("part").alias("high"))
        .where("low <> high").select("x", "often")
    )
    need = F.ceil(F.col("n") * percent / 100)
    prefixes = (
        items.join(across, "x")
        .groupBy("class_key", "part", "n").agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("ordered"))
        .withColumn("m", F.size("ordered")).where(F.col("m") >= need)
        .select("class_key", "part", "n", "m", F.posexplode(F.slice("ordered", F.lit(1), (F.col("m") - need + 1).cast("int"))).alias("at", "item"))
        .select("item.x", "class_key", "part", "n", (F.col("m") - F.col("at")).alias("rest"))
    )
    prefixes = materialise(prefixes, "minhash-prefixes", SHRINK)
    discard(sets)
    largest = (
        prefixes.groupBy("x", "part").agg(F.count("*").alias("held"))
        .groupBy("x").agg(F.max(F.struct("held", "part"))["part"].alias("main"), F.count("*").alias("parts"))
        .where("parts > 1").select("x", "main")
    )
    held = materialise(prefixes.join(largest, "x"), "minhash-postings", SHRINK)
    discard(prefixes)
    left, right = (held.select("x", *(F.col(c).alias(f"{c}_{side}") for c in ("class_key", "part", "main", "n", "rest"))) for side in "lr")
    fits = (
        (F.col("part_l") != F.col("part_r")) & ((F.col("part_r") == F.col("main_r")) | (F.col("part_l") < F.col("part_r")))
        & (F.least("rest_l", "rest_r") * (100 + percent) >= (F.col("n_l") + F.col("n_r")) * percent)
        & (F.least("n_l", "n_r") * 100 >= F.greatest("n_l", "n_r") * percent)
    )
    return (
        left.where("part_l <> main_l").join(right, (left.x == right.x) & fits)
        .select(F.least("class_key_l", "class_key_r").alias("a"), F.greatest("class_key_l", "class_key_r").alias("b")).distinct()
    )


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that no smaller doc_id is a near copy of; all columns as they were.

    Rows go by doc_id and text, so that one doc_id's other texts stay.
    """
    gone = _verdicts(docs, shingle_words, percent).where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("print").alias("__print")).distinct()
    same = (docs["doc_id"].cast("long") == F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__print"))
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: two-word shingles, links from 80 % of the union."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM sets),
classes AS (SELECT s, min(doc_id) AS rep, any_value(n) AS n FROM sized WHERE n > 0 GROUP BY s),
items AS (SELECT rep, n, unnest(s) AS x FROM classes),
pairs AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= 80 * (na + nb - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
part AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles, coalesce(p.c, z.doc_id) AS component_id,
       z.doc_id = coalesce(p.c, z.doc_id) AS kept
FROM sized z LEFT JOIN classes k ON z.s = k.s AND z.n > 0 LEFT JOIN part p ON p.rep = k.rep
"""
