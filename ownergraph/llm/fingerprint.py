"""Document fingerprints by consistent weighted sampling, with DataFrame functions alone.

A term of weight S has, for each sample, two gamma(2, 1) variables r and c and a uniform b that depend on the
term and the sample only.  With t = floor(ln S / r + b), its value is c * exp(-r * (t - b + 1)); the sample of a
document is the (term, t) of the smallest value.  Two documents agree in a sample with the probability of
their generalised Jaccard similarity: the sum over terms of the smaller weight by that of the larger one.

The values of a row go into one long each: the logarithm of the value above, the identity of (term, t) below.
The smallest long is then the sample, and an aggregate of plain longs finds it.  Texts move once, by doc_id;
everything that follows up to the finished fingerprints stays in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ownergraph.llm.common import BLANKS, text_or_empty
from ownergraph.session import materialise, table

SAMPLES = 48
#: Samples that one row of the aggregate holds; more make its generated code too long to be compiled well.
TOGETHER = 4
#: Hexadecimal digits of a sample in the fingerprint.
DIGITS = 4
BLANK_RUN = "[ \t\n\\x0B\f\r]+"
#: Stands for a null doc_id, which comes before all others.
NO_ID = -(2**63)
#: A value is left out at first only if it is the smallest with a probability below exp(-SURE); documents with a sample
#: whose smallest value does not prove that no smaller one was left out are taken again, with all values.
SURE = 20.0
_UNIT21, _UNIT22 = 2.0**-21, 2.0**-22


def _scaled(log_value: Column) -> Column:
    return F.floor((log_value + F.lit(512.0)) * F.lit(2.0**20))


def _sample(sample: Column, hashed: Column, weight: Column, log_weight: Column, total: Column, sure: float | None) -> Column:
    """One term's value and identity in one sample, as a long; null without a weight or, given ``sure``, where it is hardly the smallest.

    A value is exponential with the term's weight as its rate, and the smallest one with the ``total``, so it is
    beyond sure / total with a probability of exp(-sure).  No value is below (1 - v) * u / weight, where u and v are the
    products of the uniforms behind r and c: that needs no logarithm and rules most terms of a long text out.
    """
    one, two = F.xxhash64(hashed, sample), F.xxhash64(sample, hashed)

    def product(bits: Column) -> Column:
        first = (F.shiftrightunsigned(bits, 43) + F.lit(0.5)) * _UNIT21
        return first * ((F.shiftrightunsigned(bits, 22).bitwiseAND(F.lit(0x1FFFFF)) + F.lit(0.5)) * _UNIT21)

    u, v = product(one), product(two)
    r, b = -F.log(u), one.bitwiseAND(F.lit(0x3FFFFF)) * F.lit(_UNIT22)
    t = F.floor(log_weight / r + b)
    value = F.log(-F.log(v)) - r * (t - b + F.lit(1.0))
    # t of tiny r is large; its low bits tell levels of one term apart
    identity = (two.bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseXOR(t.bitwiseAND(F.lit(0xFFFFF)) * F.lit(0x9E3)).bitwiseAND(F.lit(0xFFFFFFFF))
    packed = F.shiftleft(_scaled(value), 32).bitwiseOR(identity)
    return packed if sure is None else F.when((F.lit(1.0) - v) * u * total <= weight * F.lit(sure), packed)


def signatures(
    weights: DataFrame, keys: list[str], columns: dict[str, tuple[str, str]], samples: int = SAMPLES, sure: float | None = None
) -> DataFrame:
    """``keys`` and a fingerprint for each of ``columns`` (name: columns of weight and total) from rows of ``keys``, ``hashed`` and these.

    The total is the sum of a document's weights or less.  Weights that are null or not above 0 take no part; a
    document without any has a fingerprint of zeros, and one without rows none.  ``sure`` rules values out as
    ``_sample`` says; ``lost_`` and the name then says whether one that was ruled out may be the smallest of its sample: all of
    those are above sure / total, so a smallest value below that is right.
    """
    logged = weights.select(
        *keys, "hashed",
        *(F.when(F.col(w) > 0, F.col(w).cast("double")).alias(f"__weight_{n}") for n, (w, _) in columns.items()),
        *(F.when(F.col(w) > 0, F.log(w)).alias(f"__log_{n}") for n, (w, _) in columns.items()),
        *(F.col(t).cast("double").alias(f"__total_{n}") for n, (_, t) in columns.items()),
        F.explode(F.sequence(F.lit(0), F.lit(samples // TOGETHER - 1))).alias("__group"),
    )
    least = logged.groupBy(*keys, "__group").agg(*(
        F.min(_sample(F.col("__group") * TOGETHER + d, F.col("hashed"), F.col(f"__weight_{n}"), F.col(f"__log_{n}"), F.col(f"__total_{n}"), sure)).alias(f"__{n}_{d}")
        for d in range(TOGETHER) for n in columns
    ), *(F.max(f"__total_{n}").alias(f"__total_{n}") for n in columns))

    def digits(name: str) -> Column:
        return F.concat(*(
            F.lpad(F.lower(F.hex(F.shiftrightunsigned(c, 16).bitwiseXOR(c).bitwiseAND(F.lit(16**DIGITS - 1)))), DIGITS, "0")
            for c in (F.coalesce(f"__{name}_{d}", F.lit(0)) for d in range(TOGETHER))
        ))

    def lost(name: str) -> Column:
        if sure is None:
            return F.lit(False)
        proven = _scaled(F.log(F.lit(sure) / F.col(f"__total_{name}"))) - 1  # less one for what rounding may change
        return reduce(Column.__or__, (F.coalesce(F.shiftright(f"__{name}_{d}", 32) >= proven, F.lit(True)) for d in range(TOGETHER)))

    parts = least.select(*keys, F.struct("__group", *(digits(n).alias(n) for n in columns), *(lost(n).alias(f"lost_{n}") for n in columns)).alias("__part"))
    found = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("__part")).alias("__parts"))
    return found.select(
        *keys, *(F.array_join(F.col(f"__parts.{n}"), "").alias(n) for n in columns), *(F.array_contains(F.col(f"__parts.lost_{n}"), True).alias(f"lost_{n}") for n in columns)
    )


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of samples in which two fingerprints agree; two documents without terms are alike, one without is like no other."""
    same = sum((F.substring(a, DIGITS * d + 1, DIGITS) == F.substring(b, DIGITS * d + 1, DIGITS)).cast("int") for d in range(samples))
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(same / F.lit(float(samples)))


def term_weights(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``keys``, ``hashed`` and, per text column, how often the term occurs and ``n_`` it: at least all terms less two.

    Terms are runs without blanks; a split at blanks gives at most two empty ones, at its ends.
    """
    counted = texts.select(*keys, *columns, *(F.greatest(F.size(F.split(c, BLANK_RUN)) - 2, F.lit(1)).alias(f"n_{c}") for c in columns))
    totals = [f"n_{c}" for c in columns]
    sides = F.posexplode(F.array(*columns)).alias("__side", "__text")
    words = counted.select(*keys, *totals, sides).select(*keys, *totals, "__side", F.explode(F.split("__text", BLANK_RUN)).alias("__word")).where("__word <> ''")
    return words.select(*keys, *totals, F.xxhash64("__word").alias("hashed"), "__side").groupBy(*keys, *totals, "hashed").agg(
        *(F.sum((F.col("__side") == i).cast("long")).alias(c) for i, c in enumerate(columns))
    )


def neighbours(ids: DataFrame, parts: int) -> DataFrame:
    """``id, need`` (distinct ids) with ``next``, ``previous`` and the need of the previous one, in a ring by id.

    Ranges of ids are sorted apart; only the ends of each range, two rows, meet in one place.
    """
    dealt = materialise(ids.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "fingerprint-ids")
    ends = dealt.groupBy("part").agg(F.min("id").alias("first"), F.max(F.struct("id", "need")).alias("last"))
    ring = Window.orderBy("part")
    whole = ends.agg(F.min("first").alias("least"), F.max("last").alias("most"))
    ends = ends.withColumns({"after": F.lead("first").over(ring), "before": F.lag("last").over(ring)}).crossJoin(F.broadcast(whole)).select(
        "part", F.coalesce("after", "least").alias("after"), F.coalesce("before", "most").alias("before")
    )
    inside = Window.partitionBy("part").orderBy("id")
    return (
        dealt.withColumns({"__next": F.lead("id").over(inside), "__last": F.lag(F.struct("id", "need")).over(inside)})
        .join(F.broadcast(ends), "part")
        .select("id", F.coalesce("__next", "after").alias("next"), F.coalesce("__last", "before").alias("__p"))
        .select("id", "next", F.col("__p.id").alias("previous"), F.col("__p.need").alias("previous_need"))
    )


def fingerprints(docs: DataFrame, samples: int = SAMPLES, sure: float | None = SURE) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row of ``docs``.

    The edited text has its last quarter (code points, rounded down) replaced by as many first ones of the next
    document by doc_id, or by all that it has; the first document follows the last.

    Defined results: a null text is empty; a text without terms has the fingerprint ""; a null doc_id comes
    first; where rows repeat a doc_id, the next document is the smallest text (for the edit) and the smallest
    fingerprint (for the likeness) of the next doc_id, and each row keeps its own result; a single document
    follows itself; other columns are not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_or_empty().alias("text"))
    # rows of one id are told apart by their texts' order, the same however often a task runs; the exchange that carries
    # the texts lies below it and is the same for all uses, so it is made once
    numbered = base.withColumn("row", F.row_number().over(Window.partitionBy("id").orderBy("text")))
    ids = base.groupBy("id").agg(F.max(F.floor(F.char_length("text") / 4)).alias("need"))
    links = materialise(neighbours(ids, parts), "fingerprint-links")
    placed = numbered.join(links.hint("shuffle_hash"), "id")
    heads = (
        # the smallest text has the smallest head; to choose the row by number would keep the exchange from being reused
        placed.select(F.col("previous").alias("id"), F.substring("text", F.lit(1), F.col("previous_need").cast("int")).alias("head"))
        .groupBy("id").agg(F.min("head").alias("head"))
    )
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    texts = placed.join(heads.hint("shuffle_hash"), "id").select(
        "id", "row", "next", "text",
        F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("head", F.lit(1), quarter)).alias("edited"),
    )
    weighed = {"fingerprint": ("text", "n_text"), "edited_fingerprint": ("edited", "n_edited")}

    def signed(given: DataFrame, sure: float | None) -> DataFrame:
        return signatures(term_weights(given, ["id", "row"], ["text", "edited"]), ["id", "row"], weighed, samples, sure)

    facts = texts.select(
        "id", "row", "next", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        *((F.btrim(t, F.lit(BLANKS)) != "").alias(f"has_{f}") for t, f in (("text", "fingerprint"), ("edited", "edited_fingerprint"))),
    )
    made = materialise(
        # rows of one id are told apart beside the key, so that both sides stay dealt by id as they are
        facts.join(
            signed(texts, sure).withColumnsRenamed({"id": "__id", "row": "__row"}).hint("shuffle_hash"),
            (F.col("id") == F.col("__id")) & (F.col("row") - F.col("__row") == 0), "left",
        ).select(
            "id", "row", F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"), "next", "n_chars", "edited_sha256",
            *(F.when(F.col(f"has_{f}"), F.col(f)).otherwise("").alias(f) for f in weighed),
            reduce(Column.__or__, (F.col(f"has_{f}") & F.col(f"lost_{f}") for f in weighed)).alias("lost"),
        ),
        "fingerprint-made",
    )
    if sure is not None and not made.where("lost").isEmpty():
        lost = made.where("lost").select("id", "row")
        whole = signed(texts.join(lost, ["id", "row"], "left_semi"), None).select("id", "row", *(F.col(f).alias(f"__{f}") for f in weighed))
        made = materialise(
            made.join(whole, ["id", "row"], "left").withColumns({f: F.when(F.col("lost") & (F.col(f) != ""), F.col(f"__{f}")).otherwise(F.col(f)) for f in weighed}),
            "fingerprint-whole",
        )
    following = made.groupBy("id").agg(F.min("fingerprint").alias("__following")).withColumnRenamed("id", "next")
    return made.join(following.hint("shuffle_hash"), "next").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"),
        likeness("fingerprint", "__following", samples).alias("near_next"),
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over ``documents``."""
    return fingerprints(table(spark, sf_dir, "documents"))
