"""Sinks and scans of finished tables: sorted Parquet that is put in place whole, arrays, compressed name blocks, numbered rows."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ownergraph.errors import CountMismatch, NameMismatch

#: Bytes of names in a block before compression, and zlib's level.
BLOCK, LEVEL = 1 << 16, 6


def put_in_place(spark: SparkSession, partial: str, target: str) -> None:
    """``partial`` becomes ``target``; the old one is moved aside first and deleted last, so a crash leaves one of both."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{target}.old-{uuid.uuid4().hex[:8]}"
    had = system.exists(path(target))
    if had and not system.rename(path(target), path(aside)):
        raise CountMismatch(f"{target} could not be moved aside")
    if not system.rename(path(partial), path(target)):
        if had:
            system.rename(path(aside), path(target))
        raise CountMismatch(f"{partial} could not be put in place")
    if had:
        system.delete(path(aside), True)


def write_sorted(df: DataFrame, target: str, keys: list[str] | None = None) -> int:
    """Parquet in the total order of ``keys`` (all columns where there is no key), checked, then put in place; rows written."""
    spark, partial = df.sparkSession, f"{target}.partial"
    df.orderBy(*(keys or df.columns)).write.mode("overwrite").option("compression", "zstd").parquet(partial)
    before, after = df.count(), spark.read.schema(df.schema).parquet(partial).count()
    if before != after:
        raise CountMismatch(f"{before} rows were to be written to {target}, {after} were")
    put_in_place(spark, partial, target)
    return after


def numbered_rows(df: DataFrame) -> DataFrame:
    """Rows of a Parquet scan with ``file_row``, their place in their file, and ``file``."""
    return df.select("*", F.col("_metadata.row_index").alias("file_row"), F.col("_metadata.file_name").alias("file"))


def by_position(left: DataFrame, right: DataFrame, on: str = "position") -> DataFrame:
    """Rows of two tables that stand at the same position; both carry it as a column, as files of many writers have no order."""
    return left.join(right, on)


def write_array(df: DataFrame, order: str, column: str, path: str, dtype: str) -> int:
    """``column`` in the order of ``order`` as one ``.npy`` file on the driver, streamed a partition at a time."""
    ordered = df.select(order, column).orderBy(order).select(column)
    n = df.count()
    with open(f"{path}.partial", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(np.dtype(dtype)), "fortran_order": False, "shape": (n,)})
        held: list = []
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            held.append(row[0])
            if len(held) == 1 << 16:
                f.write(np.array(held, dtype).tobytes())
                held.clear()
        f.write(np.array(held, dtype).tobytes())
    import os

    os.replace(f"{path}.partial", path)
    return n


def read_array(spark: SparkSession, path: str, name: str, chunk: int = 1 << 20) -> DataFrame:
    """``idx, name`` of an array that all tasks can reach; every task maps its own ranges."""
    size = len(np.load(path, mmap_mode="r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.load(path, mmap_mode="r")
        for batch in batches:
            for at in batch.column("id").to_pylist():
                part = np.asarray(values[at * chunk : (at + 1) * chunk]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at * chunk, at * chunk + len(part))), pa.array(part)], names=["idx", name])

    return spark.range(-(-size // chunk)).mapInArrow(run, f"idx long, {name} long")


def name_blocks(names: DataFrame, size: int = BLOCK) -> DataFrame:
    """``first, n, data`` of names (idx, nome) in order of idx: compressed blocks of whole names, none across two blocks.

    Ranges of idx are packed apart.  A null name is kept apart from an empty one; a name longer than a block has its own.
    """
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = names.select(F.col("idx").cast("long"), F.col("nome").cast("string")).repartitionByRange(parts, "idx").sortWithinPartitions("idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, used = [], [], 0

        def block() -> pa.RecordBatch:
            data = zlib.compress(b"".join(held), LEVEL)
            return pa.RecordBatch.from_arrays([pa.array([first]), pa.array([data], pa.binary())], names=["ids", "data"])

        for batch in batches:
            for i, name in zip(batch.column("idx").to_pylist(), batch.column("nome").to_pylist(), strict=True):
                raw = b"\x01\n" if name is None else name.replace("\\", "\\\\").replace("\n", "\\n").encode() + b"\n"
                if held and used + len(raw) > size:
                    yield block()
                    first, held, used = [], [], 0
                first.append(i)
                held.append(raw)
                used += len(raw)
        if held:
            yield block()

    return dealt.mapInArrow(run, "ids array<long>, data binary")


def read_names(blocks: DataFrame) -> DataFrame:
    """``idx, nome`` of name blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column("ids").to_pylist(), batch.column("data").to_pylist(), strict=True):
                lines = zlib.decompress(data).split(b"\n")[:-1]
                plain = [None if x == b"\x01" else _unescaped(x.decode()) for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(plain, pa.string())], names=["idx", "nome"])

    return blocks.mapInArrow(run, "idx long, nome string")


def _unescaped(text: str) -> str:
    return text if "\\" not in text else "\\".join(p.replace("\\n", "\n") for p in text.split("\\\\"))


def check_names(names: DataFrame, blocks: DataFrame) -> None:
    """Every name is read back as it was."""
    back = read_names(blocks).select("idx", F.col("nome").alias("__back"), F.lit(True).alias("__there"))
    wrong = names.select(F.col("idx").cast("long"), "nome").join(back, "idx", "full").where("__there IS NULL OR NOT (nome <=> __back)")
    if bad := wrong.limit(3).collect():
        raise NameMismatch(f"names that are not read back as they were: {', '.join(str(r['idx']) for r in bad)}")


def in_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """``file, n`` of files whose rows are not in the order of ``keys``; none in a sorted table."""
    key = F.struct(*keys)
    seen = numbered_rows(df).select(key.alias("k"), "file_row", "file")
    before = F.lag("k").over(Window.partitionBy("file").orderBy("file_row"))
    return seen.withColumn("before", before).where(F.col("before") > F.col("k")).groupBy("file").agg(F.count("*").alias("n"))
