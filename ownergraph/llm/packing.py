"""Packing: shortest-pack-first over the length histogram, then patterns joined back to documents by rank.

Each document's ids are cut at multiples of the sequence size; the pieces' lengths make a histogram of at
most ``size`` bins, which is all that the driver sees.  The driver packs bins, not pieces: from the longest
length down, as many as there are go to the shortest pack that they fit in, and a pattern of lengths gets a
count.  Each length's pieces have ranks; a pattern claims a range of them, so a piece finds its sequence by
its rank alone.  Ranks come from counts in buckets, so that a length of half the pieces is no single group.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ownergraph.llm import bpe
from ownergraph.llm.common import bounded_batches
from ownergraph.session import materialise, table

SIZE, END = 1024, 0


def spfhp(histogram: dict[int, int], size: int) -> list[tuple[int, tuple]]:
    """Patterns (count, chain); a chain is (length, rest of the chain) from the last length to the first, or None.

    Lengths are placed longest first, each into the pack that is shortest so far, if it fits there.
    """
    packs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    spaces: list[int] = []

    def add(space: int, count: int, links: tuple) -> None:
        if not packs[space]:
            heapq.heappush(spaces, -space)
        packs[space].append((count, links))

    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        while left:
            while spaces and not packs[-spaces[0]]:
                heapq.heappop(spaces)
            if not spaces or -spaces[0] < length:
                add(size - length, left, (length, None))
                break
            space = -spaces[0]
            count, links = packs[space].pop()
            if not packs[space]:
                heapq.heappop(spaces)
            took = min(count, left)
            if took < count:
                add(space, count - took, links)
            add(space - length, took, (length, links))
            left -= took
    return [pack for space in sorted(packs) for pack in packs[space]]


def placements(patterns: list[tuple[int, tuple]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: where its ranges of ranks begin, their first sequence, and the offset in it."""
    used: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for count, links in patterns:
        lengths = []
        while links:
            lengths.append(links[0])
            links = links[1]
        offset = 0
        for length in reversed(lengths):
            out[length].append((used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in out.items()}


def cut_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) per piece: ids of the whole text, then the end id."""
    shared = bpe.read_vocabulary(docs.sparkSession, vocabulary)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.load(shared.value)
        memory = bpe.Pieces(codec, lambda ids: pack_ids(f"<{len(ids)}I", *ids), codec.native())
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows, kept, starts, lengths, sums, totals = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = b"".join([b"".join(part) for part in codec.encode(text or "", memory)]) + last
                n = len(raw) // 4
                for at in range(0, n, size):
                    piece = raw[4 * at : 4 * (at + size)]
                    rows.append(i)
                    starts.append(at)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(n)
                    if with_ids:
                        kept.append(np.frombuffer(piece, "<u4").astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; each sequence holds at most ``size`` and has no gap from 0.

    ``pieces`` must not change between two reads.  Columns of those two names are replaced, all others are
    carried; lengths of null or below 1 are an error; an empty table gives an empty table.
    """
    spark = pieces.sparkSession
    bounded_batches(spark)
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    if any(x is None or not 1 <= x <= size for x in histogram):
        raise ValueError(f"a piece's length is not from 1 to {size}")
    plan = spark.sparkContext.broadcast(placements(spfhp(histogram, size)))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "start", *(c for c in ("ids_crc32", "doc_tokens") if c in pieces.columns)]
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)))
    counts = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__bucket").orderBy(*order)
    ranked = (
        dealt.withColumn("__rank", F.row_number().over(within) - 1)
        .join(bases, ["length", "__bucket"])
        .withColumn("__rank", F.col("__rank") + F.col("__base"))
        .select(*pieces.columns, "__rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("__rank").to_numpy(zero_copy_only=False)
            sequences, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                rows = lengths == length
                begins, first, at = plan.value[int(length)]
                k = np.searchsorted(begins, ranks[rows], "right") - 1
                sequences[rows] = first[k] + ranks[rows] - begins[k]
                offsets[rows] = at[k]
            columns = [batch.column(c) for c in batch.schema.names if c != "__rank"]
            names = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Cut and pack the whole texts of ``docs``.

    Defined results: a null or empty text is the end id alone; rows that repeat are packed each for itself;
    other columns are not read; an empty table gives an empty table.
    """
    return pack(materialise(cut_pieces(docs, vocabulary, size, end, with_ids), "packing-pieces"), size)


def op4_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Contract query over ``documents``; the vocabulary's path is a parameter."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
