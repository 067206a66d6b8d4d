"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``.  Between stages the rows are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.llm import line_dedup, minhash, packing, secrets, toxicity
from ownergraph.session import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL has neither the models nor the tokenizers; tests hold the stages against plain Python.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with ``n_chars`` as the text now has them."""
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of the documents that are there."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, except in one; documents stay."""
    return _documents(line_dedup.dedup_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest doc_id."""
    return minhash.drop_near_duplicates(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become ``[SECRET]``; documents stay."""
    import public_tokenizers

    return secrets.redact_secrets(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
