"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in an Arrow batch: long texts must not add up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the contracts: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session small, by rows and by bytes; a lazy plan reads the settings when it runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], list[dict]]], schema: str | StructType) -> DataFrame:
    """Each row of ``df`` to any number of rows, in Arrow batches.

    ``make`` runs once in each task and returns the row function, so that models and caches are built there.
    """

    def make_list():
        row = make()
        return lambda rows: [made for given in rows for made in row(given)]

    return map_lists(df, make_list, schema)


def map_lists(df: DataFrame, make: Callable[[], Callable[[list[dict]], list[dict]]], schema: str | StructType) -> DataFrame:
    """As ``map_rows``, with a function that takes the rows of an Arrow batch together."""
    bounded_batches(df.sparkSession)
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, rows = to_arrow_schema(target), make()
        for batch in batches:
            out = rows(batch.to_pylist())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, target)
