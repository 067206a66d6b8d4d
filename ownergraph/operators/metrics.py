"""Metrics of the graph, from degrees and component labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.operators.components import component_sizes


def histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n"))


def hubs(degrees: DataFrame, k: int, node: str = "idx") -> DataFrame:
    """The k largest degrees; ties by node."""
    return degrees.orderBy(F.desc("degree"), node).limit(k)


def graph_metrics(degrees: DataFrame, components: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean, median and largest degree, components, giant, nodes outside of it."""
    a = degrees.agg(
        F.count("*").alias("nos"),
        F.expr("coalesce(sum(degree), 0) div 2").alias("arestas"),
        F.avg("degree").alias("grau_medio"),
        F.floor(F.percentile("degree", 0.5)).alias("grau_mediano"),
        F.max("degree").alias("grau_maximo"),
    )
    b = component_sizes(components).agg(F.count("*").alias("componentes"), F.max("size").alias("gigante"), (F.sum("size") - F.max("size")).alias("fora_do_gigante"))
    return a.crossJoin(b)


def report(degrees: DataFrame, components: DataFrame, k: int = 10) -> DataFrame:
    """All metrics as rows ``parte, valor, n``: the figures of ``graph_metrics``, both histograms, and the hubs."""
    figures = graph_metrics(degrees, components)
    names = [c for c in figures.columns if c != "grau_medio"]
    one = figures.select(F.explode(F.array(*(F.struct(F.lit(c).alias("parte"), F.col(c).cast("long").alias("valor")) for c in names))).alias("x"))
    return (
        one.select("x.parte", "x.valor", F.lit(1).cast("long").alias("n"))
        .unionByName(histogram(degrees, "degree").select(F.lit("grau").alias("parte"), F.col("degree").alias("valor"), "n"))
        .unionByName(histogram(component_sizes(components), "size").select(F.lit("componente").alias("parte"), F.col("size").alias("valor"), "n"))
        .unionByName(hubs(degrees, k).select(F.lit("hub").alias("parte"), F.col("idx").alias("valor"), F.col("degree").alias("n")))
    )
