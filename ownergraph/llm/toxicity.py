"""Toxicity: class-conditional Kneser-Ney models, compared by length-normalised log-likelihood.

Each class has counts of letter n-grams within words; the highest order is its own, all lower orders are
continuation counts that both classes share.  An n-gram that one class has not seen falls back to the same
shared probability as in the other, so rare words of ordinary text tell nothing, while a rare form of a toxic
word still carries its stem.  The log-likelihoods of an expression, a word, under both models are normalised
by its length and compared; a document is as toxic as its most toxic expression, however long the rest is.
The score is a logistic curve of that ratio alone, fitted on documents that the models have not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ownergraph.llm.common import bounded_batches
from ownergraph.session import materialise, table

#: Letters of an n-gram, and the absolute discount.
ORDER, DISCOUNT = 5, 0.75
#: The most n-grams that tasks hold in memory.  Words with others get their values by a join; no score depends on it.
MAX_GRAMS = 1_000_000
#: Labelled documents that the logistic curve is fitted on: those whose hash is smallest.
CALIBRATION_DOCS = 20_000
#: Expressions of fewer n-grams than these are normalised as if they had as many: a short word proves less.
SPAN = 16
#: A share of the characters in all, for the order below single letters.
UNIFORM = 1 / 200
#: Score from which a document is predicted to be toxic.
THRESHOLD = 0.7
#: The model of all rows; those that score folds 0 and 2 go by the fold.
WHOLE = -1
#: Shuffle partitions to a file of the orders' tables.
SHRINK = 4
#: Words that a task remembers, and the longest of them.
CACHED_WORDS, CACHED_CHARS = 200_000, 40
_WORD = re.compile(r"[^\W\d_]+")
_START, _END = "\x02", "\x03"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(word: str) -> Iterator[str]:
    padded = _START * (ORDER - 1) + word + _END
    return (padded[i : i + ORDER] for i in range(len(padded) - ORDER + 1))


def fold_of(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic, fold`` of the rows that may be learned from: remainder 0 or 2.  Labels that disagree count as toxic."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold_of("doc_id") != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").where(fold_of("doc_id") != 1)
    return rows.join(known.hint("shuffle_hash"), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), fold_of("doc_id").cast("int").alias("fold"))


def count_grams(train: DataFrame) -> DataFrame:
    """``gram, n00, n01, n20, n21``: how often each n-gram occurs by fold (0, 2) and class, over all of ``train``."""
    bounded_batches(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(found: dict) -> pa.RecordBatch:
            grams: dict[tuple, int] = defaultdict(int)
            for (fold, toxic), words in found.items():
                for word, n in words.items():
                    for g in grams_of(word):
                        grams[fold, toxic, g] += n
            folds, classes, names = zip(*grams, strict=True) if grams else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(folds, pa.int32()), pa.array(classes, pa.int32()), pa.array(names, pa.string()), pa.array(list(grams.values()), pa.int64())],
                names=["fold", "toxic", "gram", "n"],
            )

        found: dict[tuple, Counter] = defaultdict(Counter)
        for batch in batches:
            for row in batch.to_pylist():
                found[row["fold"], row["toxic"]].update(words_of(row["text"]))
            if sum(map(len, found.values())) > CACHED_WORDS:
                yield flush(found)
                found.clear()
        yield flush(found)

    counted = train.select("fold", "toxic", "text").mapInArrow(run, "fold int, toxic int, gram string, n long")
    part = lambda f, t: F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}{t}")
    return counted.groupBy("gram").agg(*(part(f, t) for f in (0, 2) for t in (0, 1)))


def kneser_ney(ordinary: dict[str, int], toxic: dict[str, int]) -> dict[str, float]:
    """Log of toxic by ordinary probability of an n-gram's last letter: by n-gram, and by context for n-grams that neither class has.

    The plain form of ``ratios``, for tests.
    """
    classes = (ordinary, toxic)
    seen = [(Counter(), Counter()) for _ in classes]  # by context: occurrences and different letters
    for (total, kinds), counts in zip(seen, classes, strict=True):
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
    lower, current = {}, ordinary.keys() | toxic.keys()
    for order in range(ORDER - 1, 0, -1):
        counts = Counter(g[1:] for g in current)
        total, kinds = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        lower[order], current = (counts, total, kinds), counts.keys()

    memory: dict[str, float] = {"": UNIFORM}

    def shared(g: str) -> float:
        p = memory.get(g)
        if p is None:
            counts, total, kinds = lower[len(g)]
            h, below = g[:-1], shared(g[1:])
            n = total.get(h, 0)
            p = memory[g] = below if not n else max(counts.get(g, 0) - DISCOUNT, 0) / n + DISCOUNT * kinds[h] / n * below
        return p

    def left_over(y: int, h: str) -> float:
        total, kinds = seen[y]
        return DISCOUNT * kinds[h] / total[h] if h in total else 1.0

    ratio = {}
    for g in ordinary.keys() | toxic.keys():
        h, below = g[:-1], shared(g[1:])
        p = [
            (max(classes[y].get(g, 0) - DISCOUNT, 0) / seen[y][0][h] if h in seen[y][0] else 0.0) + left_over(y, h) * below
            for y in (0, 1)
        ]
        ratio[g] = math.log(p[1] / p[0])
    for h in seen[0][0].keys() | seen[1][0].keys():
        ratio[h] = math.log(left_over(1, h) / left_over(0, h))
    return ratio


def ratios(grams: DataFrame) -> DataFrame:
    """``model, gram, often, ratio``: ``kneser_ney`` of every model over all of ``grams``; contexts have a null ``often``.

    ``WHOLE`` learns from both folds, and each fold's model from the other one.
    """
    model = lambda m, n0, n1: F.struct(F.lit(m).alias("model"), "gram", F.expr(n0).alias("n0"), F.expr(n1).alias("n1"))
    models = F.array(model(WHOLE, "n00 + n20", "n01 + n21"), model(2, "n00", "n01"), model(0, "n20", "n21"))
    each = materialise(grams.select(F.explode(models).alias("m")).select("m.*").where("n0 + n1 > 0"), "toxicity-grams")
    orders, current = {}, each
    for order in range(ORDER - 1, 0, -1):
        counts = current.groupBy("model", F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("c"))
        orders[order] = current = materialise(counts, "toxicity-order", SHRINK)
    shared = None
    for order in range(1, ORDER):
        counts = orders[order].withColumn("h", F.substring("gram", 1, order - 1))
        totals = counts.groupBy("model", "h").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"))
        rows = counts.join(totals, ["model", "h"])
        if shared is None:
            rows = rows.withColumn("below", F.lit(UNIFORM))
        else:
            rows = rows.withColumn("rest", F.substring("gram", 2, order - 1)).join(
                shared.select("model", F.col("gram").alias("rest"), F.col("p").alias("below")), ["model", "rest"]
            )
        p = F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / F.col("n") + DISCOUNT * F.col("kinds") / F.col("n") * F.col("below")
        shared = materialise(rows.select("model", "gram", p.alias("p")), "toxicity-shared", SHRINK)
    tops = each.withColumn("h", F.substring("gram", 1, ORDER - 1))
    seen = tops.groupBy("model", "h").agg(*(
        x for y in "01" for x in (F.sum(f"n{y}").alias(f"t{y}"), F.count_if(F.col(f"n{y}") > 0).alias(f"k{y}"))
    ))
    left_over = {y: F.when(F.col(f"t{y}") > 0, DISCOUNT * F.col(f"k{y}") / F.col(f"t{y}")).otherwise(1.0) for y in "01"}
    own = {y: F.when(F.col(f"t{y}") > 0, F.greatest(F.col(f"n{y}") - DISCOUNT, F.lit(0.0)) / F.col(f"t{y}")).otherwise(0.0) for y in "01"}
    p = {y: own[y] + left_over[y] * F.col("below") for y in "01"}
    joined = tops.join(seen, ["model", "h"]).withColumn("rest", F.substring("gram", 2, ORDER - 1)).join(
        shared.select("model", F.col("gram").alias("rest"), F.col("p").alias("below")), ["model", "rest"]
    )
    found = joined.select("model", "gram", (F.col("n0") + F.col("n1")).alias("often"), F.log(p["1"] / p["0"]).alias("ratio"))
    contexts = seen.select("model", F.col("h").alias("gram"), F.lit(None).cast("long").alias("often"), F.log(left_over["1"] / left_over["0"]).alias("ratio"))
    return materialise(found.unionByName(contexts), "toxicity-ratios", SHRINK)


class Evidence(dict):
    """Length-normalised log-likelihood ratios of words under one model, remembered up to a bound.

    Where ``ratio`` is not complete, a word with an n-gram that is not there has None.
    """

    def __init__(self, ratio: dict[str, float], complete: bool = True):
        super().__init__()
        self.ratio, self.complete = ratio, complete

    def __missing__(self, word: str) -> float | None:
        get, value = self.ratio.get, 0.0
        for g in grams_of(word):
            r = get(g)
            if r is None and not self.complete:
                value = None
                break
            value += get(g[:-1], 0.0) if r is None else r
        if value is not None:
            value /= max(SPAN, len(word) + 1)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, text: str | None) -> tuple[float, list[str]]:
        """The ratio of the most toxic word, none below 0, and the words without a value here."""
        words = set(words_of(text))
        values = [(w, self[w]) for w in words]
        return max([0.0, *(v for _, v in values if v is not None)]), sorted(w for w, v in values if v is None)


class Model(NamedTuple):
    """All ratios as a table, those that tasks hold by model, whether these are all, and the curve."""

    table: DataFrame
    held: Broadcast
    complete: bool
    fitted: tuple | None


def word_values(words: DataFrame, table: DataFrame) -> DataFrame:
    """``model, word, value`` of distinct ``model, word``, from all ratios."""
    padded = F.concat(F.lit(_START * (ORDER - 1)), F.col("word"), F.lit(_END))
    at = F.sequence(F.lit(1), F.char_length("word") + 1)
    grams = words.select("model", "word", F.explode(F.transform(at, lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("gram"))
    of = lambda key, name: table.select("model", F.col("gram").alias(key), F.col("ratio").alias(name))
    known = grams.withColumn("h", F.substring("gram", 1, ORDER - 1)).join(of("gram", "own"), ["model", "gram"], "left").join(of("h", "context"), ["model", "h"], "left")
    total = F.sum(F.coalesce("own", "context", F.lit(0.0)))
    return known.groupBy("model", "word").agg(total.alias("total")).select(
        "model", "word", (F.col("total") / F.greatest(F.lit(SPAN), F.char_length("word") + 1)).alias("value")
    )


def evidence(rows: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """The ``carried`` columns of ``rows``, and ``__ratio``: the length-normalised ratio of the most toxic word of
    ``text`` under the model in ``__model``."""
    bounded_batches(rows.sparkSession)
    held, complete = model.held, model.complete
    own = "__top double, __late array<string>"
    names = [f.name for f in StructType.fromDDL(own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {m: Evidence(ratio, complete) for m, ratio in held.value.items()}
        for batch in batches:
            pairs = zip(batch.column("__model").to_pylist(), batch.column("text").to_pylist(), strict=True)
            top, late = zip(*(by[m].of(t) for m, t in pairs), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*carried, "__model")), pa.array(top, pa.float64()), pa.array(late, pa.list_(pa.string()))],
                names=[*carried, "__model", *names],
            )

    schema = StructType([*rows.select(*carried, "__model").schema.fields, *StructType.fromDDL(own).fields])
    measured = rows.mapInArrow(run, schema)
    if complete:
        return measured.select(*carried, F.col("__top").alias("__ratio"))
    measured = materialise(measured.withColumn("__row", F.monotonically_increasing_id()), "toxicity-measured")
    late = measured.select("__row", F.col("__model").alias("model"), F.explode("__late").alias("word"))
    values = word_values(late.select("model", "word").distinct(), model.table)
    added = late.join(values, ["model", "word"]).groupBy("__row").agg(F.max("value").alias("__high"))
    return measured.join(added, "__row", "left").select(*carried, F.greatest("__top", "__high").alias("__ratio"))


def logistic(features: np.ndarray, classes: np.ndarray, ridge: float = 1e-2) -> tuple:
    """Means, spreads and weights of a logistic curve, by Newton's method."""
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(features)), (features - mean) / spread]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - classes) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def curve(fitted: tuple, features: tuple[float, ...]) -> float:
    mean, spread, w = fitted
    x = w[0] + sum(w[i + 1] * (f - mean[i]) / spread[i] for i, f in enumerate(features))
    return float(1 / (1 + math.exp(-min(30.0, max(-30.0, x)))))


def fit(docs: DataFrame, labels: DataFrame, max_grams: int = MAX_GRAMS, calibration_docs: int = CALIBRATION_DOCS) -> Model | float:
    """The model of all labelled rows outside of remainder 1 and its curve; without both classes, a constant score.

    All these rows are counted, and all their n-grams are in the model's table; at most ``max_grams`` of each model (by
    powers of two of the count) are also held by the tasks.  The curve takes the ``calibration_docs`` of smallest hash,
    each scored by a model of the other fold.
    """
    spark = docs.sparkSession
    train = materialise(labelled(docs, labels), "toxicity-train")
    present = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(present) < 2:
        return float(min(present, default=0))
    found = ratios(count_grams(train))
    size = F.floor(F.log2("often"))
    sizes = {r["size"]: r["count"] for r in found.where(f"model = {WHOLE} AND often IS NOT NULL").groupBy(size.alias("size")).count().collect()}  # at most 64 rows
    least, kept = 0, 0
    for size in sorted(sizes, reverse=True):
        if kept + sizes[size] > max_grams:
            least = size + 1
            break
        kept += sizes[size]
    complete = least == 0
    wanted = found if complete else found.where(F.col("often") >= F.lit(2**least))
    rows = wanted.select("model", "gram", "ratio").toArrow().to_pydict()  # at most max_grams n-grams a model, and their contexts
    by: dict[int, dict[str, float]] = {WHOLE: {}, 0: {}, 2: {}}
    for m, g, r in zip(rows["model"], rows["gram"], rows["ratio"], strict=True):
        by[m][g] = r
    model = Model(found, spark.sparkContext.broadcast({WHOLE: by[WHOLE]}), complete, None)
    halves = model._replace(held=spark.sparkContext.broadcast({0: by[0], 2: by[2]}))

    ids = train.select("doc_id", "toxic", "fold").orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_docs)
    chosen = train.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    sample = evidence(chosen.select("toxic", "text", F.col("fold").alias("__model")), halves, ["toxic"]).toArrow().to_pydict()
    classes = np.array(sample["toxic"], float)
    if len(set(classes)) < 2:
        return float(min(present))
    return model._replace(fitted=logistic(np.array(sample["__ratio"], float)[:, None], classes))


def scored(docs: DataFrame, model: Model | float, carried: list[str]) -> DataFrame:
    """The ``carried`` columns of ``docs`` and ``__score``, from the whole text alone."""
    if isinstance(model, float):
        return docs.select(*carried, F.lit(model).alias("__score"))
    mean, spread, w = model.fitted
    x = float(w[0]) + float(w[1]) * (F.col("__ratio") - float(mean[0])) / float(spread[0])
    score = 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), x))))
    return evidence(docs.withColumn("__model", F.lit(WHOLE)), model, carried).select(*carried, score.alias("__score"))


def score_toxicity(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row, from the whole text alone.

    Defined results: null and empty texts, and texts without letters, have no evidence and get the curve's score
    for none; a null doc_id is not held out; rows that repeat each get a row; other columns are not read; an empty table
    gives an empty table.
    """
    rows = docs.select("doc_id", F.coalesce(fold_of("doc_id") == 1, F.lit(False)).alias("held_out"), "text")
    return scored(rows, model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all columns; the model learns from ``labels`` of ``docs``."""
    return scored(docs, fit(docs, labels), docs.columns).where(F.col("__score") < threshold).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over ``documents`` and ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
