"""Line dedup: explode normalised lines, hash, count documents per hash, drop, and reassemble by position.

Only DataFrame functions.  The text is shuffled once, to meet the positions that go; all other exchanges
carry hashes and positions.  A line that a third of all documents hold is counted by partial aggregates,
and the join that brings its verdict back is one whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.llm.common import BLANKS, LOWER, UPPER, text_or_empty
from ownergraph.session import keep, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Stands for a null doc_id: one document, smaller than all others.
NO_ID = -(2**63)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` less the lines that many documents share, and ``n_lines``, ``n_dropped``.

    A line's key is the line stripped of blanks with A-Z lower-cased.  Keys of ``min_chars`` code points
    or more in at least ``min_docs`` documents lose all their lines except in the largest doc_id with it.

    Defined results: a null or empty text is one empty line and becomes "" ; a null doc_id counts as one
    document below all others; rows that repeat a doc_id are one document and each keeps its own row; a
    document whose lines all go stays with ""; columns named ``n_lines`` or ``n_dropped`` are replaced, all
    others are carried; an empty table gives an empty table.
    """
    base = docs.drop("n_lines", "n_dropped").withColumns({
        "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
        "__text": text_or_empty(),
        "__print": F.xxhash64(text_or_empty()),
    })
    lines = base.select("__id", "__print", F.posexplode(F.split("__text", "\n", -1)).alias("__pos", "__line"))
    keyed = (
        lines.withColumn("__key", F.btrim("__line", F.lit(BLANKS)))
        .where(F.char_length("__key") >= min_chars)
        .withColumn("__key", F.translate("__key", UPPER, LOWER))
        .select("__id", "__print", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(1), "__key").alias("__h2"))
    )
    counted = (
        keyed.groupBy("__h1", "__h2")
        .agg(F.count_distinct("__id").alias("__n"), F.max("__id").alias("__keeper"))
        .where(F.col("__n") >= min_docs)
        .select("__h1", "__h2", "__keeper")
    )
    shared = keep(counted)  # a table of its own, so that Spark may split the join's hot partitions
    gone = (
        keyed.join(shared, ["__h1", "__h2"])
        .where(F.col("__id") < F.col("__keeper"))
        .groupBy("__id", "__print")
        .agg(F.collect_set("__pos").alias("__gone"))
    )
    parts = F.split("__text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("__gone"))
    return (
        base.join(gone.hint("shuffle_hash"), ["__id", "__print"], "left")
        .withColumn("__parts", parts)
        .withColumn("n_lines", F.size("__parts").cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
        .withColumn(
            "text",
            F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(
                F.array_join(F.transform(kept, lambda i: F.get("__parts", i)), "\n")
            ),
        )
        .drop("__id", "__print", "__text", "__parts", "__gone")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: per document the lines, those dropped, and the digest of what is kept."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT doc_id, pos, line, (keeper IS NOT NULL AND doc_id < keeper) AS gone
  FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
