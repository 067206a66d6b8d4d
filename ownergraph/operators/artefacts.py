"""The published artefacts of a graph: catalogue, rates, sorted adjacency, labels and names, written as one set and opened with checks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.errors import IncompatibleArtefacts, InconsistentArtefacts, IndexOutOfRange, RateMismatch, UnorderedExistence, UnorderedNeighbours
from ownergraph.functions import decoding as D
from ownergraph.functions import identity as I
from ownergraph.operators import graph as G
from ownergraph.sources import sinks

#: What is published; everything else stays inside.
PUBLISHED = ("catalogo", "taxas", "nomes", "existencia", "offsets", "adjacencia", "componentes")
MOST = 2**31 - 1
_KINDS = (I.COMPANY, I.PERSON, I.FOREIGNER)
_CONFIDENCES = (I.EXACT, I.ESTIMATED, I.WEAK, I.UNMERGEABLE)


def region_rates(nodes: DataFrame) -> DataFrame:
    """``regiao_fiscal, taxa_de_colisao``: the rate must be a function of the region, or the table would not hold it."""
    rated = nodes.where("taxa_de_colisao IS NOT NULL")
    found = rated.groupBy("regiao_fiscal").agg(F.min("taxa_de_colisao").alias("taxa_de_colisao"), F.max("taxa_de_colisao").alias("__most"))
    if bad := found.where("__most <> taxa_de_colisao OR regiao_fiscal IS NULL").limit(5).collect():
        raise RateMismatch(f"regions with several rates, or rates without a region: {', '.join(str(r['regiao_fiscal']) for r in bad)}")
    return found.drop("__most")


def check_rates(nodes: DataFrame, rates: DataFrame) -> None:
    """Every node's rate is read back from the table of regions."""
    estimated = nodes.where(F.col("confianca") == I.ESTIMATED).select("idx", "regiao_fiscal", "taxa_de_colisao")
    back = estimated.join(rates.withColumnRenamed("taxa_de_colisao", "__back"), "regiao_fiscal", "left").where("NOT (taxa_de_colisao <=> __back)")
    if bad := back.limit(3).collect():
        raise RateMismatch(f"rates that the table of regions does not give: {', '.join(str(r['idx']) for r in bad)}")


def catalogue(nodes: DataFrame) -> DataFrame:
    """``idx, cnpj, atributos, regiao_fiscal`` of every node: kind, confidence and slice flag in six bits."""
    place = lambda c, values: sum((F.when(c == v, i).otherwise(0) for i, v in enumerate(values)), F.lit(0))
    packed = D.pack_attributes(place(F.col("tipo"), _KINDS), place(F.col("confianca"), _CONFIDENCES), F.col("no_recorte"))
    return nodes.select("idx", F.col("cnpj_basico").alias("cnpj"), packed.cast("int").alias("atributos"), "regiao_fiscal")


def look_up(wanted: DataFrame, the_catalogue: DataFrame, names: DataFrame, rates: DataFrame, key: str = "idx") -> DataFrame:
    """All that the catalogue tells of wanted nodes (by ``idx`` or ``cnpj``): number, kind, name, confidence, flag, region and rate."""
    told = D.unpack_attributes(F.col("atributos"))
    value = lambda c, values: F.element_at(F.array(*(F.lit(v) for v in values)), c + 1)
    found = wanted.select(key).distinct().join(the_catalogue, key).withColumn("__a", told)
    return found.join(names.select("idx", "nome"), "idx", "left").join(rates, "regiao_fiscal", "left").select(
        "idx", "cnpj", value(F.col("__a.kind"), _KINDS).alias("tipo"), "nome", value(F.col("__a.confidence"), _CONFIDENCES).alias("confianca"),
        F.col("__a.in_slice").alias("no_recorte"), "regiao_fiscal",
        F.when(value(F.col("__a.confidence"), _CONFIDENCES) == I.ESTIMATED, F.col("taxa_de_colisao")).alias("taxa_de_colisao"),
    )


def twin_faults(a: DataFrame, b: DataFrame, position: str, key: str) -> DataFrame:
    """Positions that one table lacks or that have another key there."""
    left, right = a.select(position, F.col(key).alias("__a"), F.lit(True).alias("__l")), b.select(position, F.col(key).alias("__b"), F.lit(True).alias("__r"))
    return left.join(right, position, "full").where("__l IS NULL OR __r IS NULL OR NOT (__a <=> __b)").select(position)


def check_twins(a: DataFrame, b: DataFrame, position: str, key: str) -> None:
    """Two tables that must agree row by row: the same positions with the same keys."""
    if bad := twin_faults(a, b, position, key).limit(3).collect():
        raise InconsistentArtefacts(f"positions that do not agree: {', '.join(str(r[position]) for r in bad)}")


def check_existence_order(existence: DataFrame) -> None:
    """Written in strictly rising order: no file has a company at or below the one before."""
    if not sinks.in_order(existence, ["cnpj"]).isEmpty() or existence.count() != existence.distinct().count():
        raise UnorderedExistence("companies are not in strictly rising order")


def check_layout(offsets: DataFrame, adjacency: DataFrame) -> None:
    """Positions fit 32 bits, lists rise strictly, and both ends of a link have the same role."""
    if (n := adjacency.count()) > MOST:
        raise IndexOutOfRange(f"{n} positions do not fit 32 bits")
    if not sinks.in_order(adjacency, ["src", "dst"]).isEmpty():
        raise UnorderedNeighbours("a neighbour stands before a smaller one")
    G.check_adjacency(adjacency)
    ends = adjacency.groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("n"))
    after = offsets.select((F.col("idx") - 1).alias("idx"), F.col("offset").alias("next"))
    wrong = offsets.join(after, "idx", "left").join(ends, "idx", "left").where(F.coalesce("next", F.lit(n)) - F.col("offset") != F.coalesce("n", F.lit(0)))
    if bad := wrong.limit(3).collect():
        raise IncompatibleArtefacts(f"lists that are not as long as their offsets say: {', '.join(str(r['idx']) for r in bad)}")


def write_artefacts(nodes: DataFrame, links: DataFrame, labels: DataFrame, existence: DataFrame, folder: str, period: str) -> dict[str, int]:
    """All tables of ``PUBLISHED`` in order of their keys, and a manifest with their rows and the period, written last."""
    adj = G.adjacency(links).select("src", "dst", "role")
    rates = region_rates(nodes)
    check_rates(nodes, rates)
    tables = {
        "catalogo": (catalogue(nodes), ["idx"]), "taxas": (rates, ["regiao_fiscal"]), "existencia": (existence.select("cnpj"), ["cnpj"]),
        "offsets": (G.offsets(G.degrees(adj, nodes)), ["idx"]), "adjacencia": (adj, ["src", "dst"]), "componentes": (labels.select("idx", "component"), ["idx"]),
    }
    spark = nodes.sparkSession
    rows = {name: sinks.write_sorted(df, f"{folder}/{name}.parquet", keys) for name, (df, keys) in tables.items()}
    names = nodes.where("nome IS NOT NULL").select("idx", "nome")
    sinks.name_blocks(names).write.mode("overwrite").parquet(f"{folder}/nomes.parquet")
    sinks.check_names(names, spark.read.parquet(f"{folder}/nomes.parquet"))
    rows["nomes"] = names.count()
    manifest = spark.createDataFrame([(json.dumps({"competencia": period, "linhas": rows}, sort_keys=True),)], "value string")
    manifest.coalesce(1).write.mode("overwrite").text(f"{folder}/manifesto")
    return rows


def open_artefacts(spark: SparkSession, folder: str, period: str | None = None) -> dict[str, DataFrame]:
    """The published tables, if they are of one period and fit together; otherwise a refusal that says what does not."""
    try:
        manifest = json.loads(spark.read.text(f"{folder}/manifesto").first()[0])
        found = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in PUBLISHED}
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            raise IncompatibleArtefacts(f"{folder} has not all of {', '.join(PUBLISHED)} and a manifest") from error
        raise
    if period is not None and manifest["competencia"] != period:
        raise IncompatibleArtefacts(f"the artefacts are of {manifest['competencia']}, not of {period}")
    there = {name: (sinks.read_names(df) if name == "nomes" else df).count() for name, df in found.items()}
    if wrong := [f"{k}: {there[k]} rows, {v} announced" for k, v in manifest["linhas"].items() if there.get(k) != v]:
        raise IncompatibleArtefacts("; ".join(wrong))
    if len({there[k] for k in ("catalogo", "offsets", "componentes")}) != 1:
        raise IncompatibleArtefacts("catalogue, offsets and labels are not of the same nodes")
    check_layout(found["offsets"], found["adjacencia"])
    return found
