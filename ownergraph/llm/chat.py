"""Chat formatting: typed content parts become one string per conversation, with a loss mask and references.

Only DataFrame functions.  Every turn is visited once: text parts are escaped, image, audio and document parts
become placeholders in their order, and each placeholder's reference and expanded token count is recorded.
The template marks turns with ``<s>[role]`` and ``</s>``; the first characters of all control strings (of this
and of the usual templates) are escaped inside texts and roles, and escaping can be undone.

One conversation is one output row, so its turns meet in one task; everything else is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ownergraph.llm.common import text_or_empty
from ownergraph.session import table

#: Characters that control strings begin or end with, and what stands for them; the ampersand comes first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lb;"), ("]", "&rb;"))
OPEN, NAMED, CLOSE = "<s>[", "]", "</s>"
ATTACHED = ("image", "audio", "document")
#: Side of the square that an image token covers, audio tokens a second, document tokens a page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A turn of plain text as its only content part."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    ))


def _is_attached(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*ATTACHED), F.lit(False))


def _rendered(part: Column) -> Column:
    return F.when(_is_attached(part), F.concat(F.lit("<"), part["kind"], F.lit(">"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _expanded(part: Column) -> Column:
    """Tokens that stand for a placeholder once it is filled in; at least one."""
    across = F.ceil(F.coalesce(part["width"], F.lit(0)) / IMAGE_PATCH)
    down = F.ceil(F.coalesce(part["height"], F.lit(0)) / IMAGE_PATCH)
    return F.greatest(
        F.lit(1).cast("long"),
        F.when(part["kind"] == "image", across * down)
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .otherwise(F.coalesce(part["pages"], F.lit(0)) * F.lit(PAGE_TOKENS)).cast("long"),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans, attachments, attachment_tokens`` per conversation.

    ``turns`` has ``conv_id, turn, role`` and ``parts`` (an array of structs kind, text, ref, width, height,
    seconds, pages), or ``text`` for a single text part.  ``loss_spans`` are (start, stop) code points of
    the assistant's bodies; ``attachments`` (turn, kind, ref, tokens) come in the order of the placeholders.

    Defined results: null texts, roles and parts are empty, parts of an unknown kind are text; turns go by turn
    (nulls first), ties by role and then body; rows that repeat are turns each; a null conv_id is a
    conversation; other columns are not read; no turns give no row.
    """
    parts = F.col("parts") if "parts" in turns.columns else text_part(F.col("text"))
    rendered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(parts, F.array()).alias("parts")).select(
        "conv_id", "turn", "role",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(NAMED)).alias("head"),
        F.array_join(F.transform("parts", _rendered), "").alias("body"),
        F.transform(
            F.filter("parts", _is_attached),
            lambda p: F.struct(F.col("turn").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens")),
        ).alias("attached"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    size = F.char_length("head") + F.char_length("body") + len(CLOSE)
    placed = rendered.withColumns({
        "at": F.row_number().over(order),
        "end": F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    }).select(
        "conv_id",
        F.struct(
            "at",
            F.concat("head", "body", F.lit(CLOSE)).alias("text"),
            (F.col("end") - len(CLOSE) - F.char_length("body")).alias("start"),
            (F.col("end") - len(CLOSE)).alias("stop"),
            (F.col("role") == TRAINED_ROLE).alias("trained"),
            "attached",
        ).alias("turn"),
    )
    return placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"))).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def _turns_of(formatted: str) -> Column:
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda s: s != "")

    def turn(piece: Column) -> Column:
        named = F.substring(piece, len(OPEN) + 1, 2**31 - 1)
        role = F.substring_index(named, NAMED, 1)
        body = F.substr(named, F.char_length(role) + len(NAMED) + 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns`` (role, text) from the formatted string alone; placeholders stay as they stand."""
    return formatted.select("conv_id", _turns_of("formatted").alias("turns"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over ``conversations`` and conversation -7; every column is read back from the output."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", text_or_empty().alias("text"))
    control = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED_ROLE).alias("role"), F.lit(control).alias("text"),
    )
    made = format_conversations(rows.unionByName(own)).withColumn("turns", _turns_of("formatted"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length(F.array_join(loss, "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join(loss, ""), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(s) + 4 * (length(s) - length(replace(s, '&', ''))) + 3 * (length(s) - length(translate(s, '<>[]', ''))) + 9 AS n
  FROM (SELECT *, role || text AS s FROM turns))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
