"""The engine's tables, cut from the driver's: graphs of several shapes, and registry-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.session import table


class Tables:
    """The input tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def dense_links(t: Tables) -> DataFrame:
    """Supplier's and customer's nation: few nodes, many links, loops and mutual pairs."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    orders = t.orders.select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("qualificacao_socio"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("no_socio")), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("no_empresa")), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("no_empresa", "no_socio", "qualificacao_socio")
    )


def sparse_links(t: Tables, giant: bool = False) -> DataFrame:
    """Every lineitem links its order (even) with its part, quantity and discount (odd): many small components.

    Without the discount the same lineitems form a giant component and hundreds of small ones.
    """
    combination = F.col("l_partkey") * 51 + F.col("l_quantity").cast("long")
    if not giant:
        combination = combination * 11 + F.round(F.col("l_discount") * 100).cast("long")
    lines = t.lineitem.select("l_orderkey", (combination * 2 + 1).alias("no_socio"))
    orders = t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("qualificacao_socio"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") * 2).alias("no_empresa"), "no_socio", "qualificacao_socio")


def linked_nodes(links: DataFrame) -> DataFrame:
    return links.select(F.col("no_empresa").alias("idx")).unionByName(links.select(F.col("no_socio").alias("idx"))).distinct()


def establishments(t: Tables) -> DataFrame:
    """Lineitems as establishments of their order, with repeated head offices."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("cnpj_basico"),
        F.lpad(F.col("l_linenumber").cast("string"), 4, "0").alias("cnpj_ordem"),
        two(F.col("l_suppkey") % 100).alias("cnpj_dv"),
        F.when(F.col("l_returnflag") == "A", "1").otherwise("2").alias("identificador_matriz_filial"),
        two(F.col("l_partkey") % 9).alias("situacao_cadastral"),
        F.when(F.col("l_partkey") % 3 == 0, "SP").otherwise("RJ").alias("uf"),
    )


def partners(t: Tables) -> DataFrame:
    """Customers as partners of all kinds: companies, people, foreigners, and people without a name."""
    k = F.col("c_custkey")
    code = (k % 4 + 1).cast("string")
    mask = F.concat(F.lit("***"), F.lpad((k % 97 * 7919 % 1000000).cast("string"), 6, "0"), F.lit("**"))
    number = F.concat(F.lpad((k % 60).cast("string"), 8, "0"), F.lit("000100"))
    return t.customer.select(
        F.lpad(F.col("c_nationkey").cast("string"), 8, "0").alias("cnpj_basico"),
        F.when(code == "4", "2").otherwise(code).alias("identificador_socio"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("José da "), F.col("c_mktsegment"), F.lit(" "), (k % 13).cast("string"))).alias("nome_socio_ou_razao_social"),
        F.when(code == "1", number).when(code == "3", F.lit(None).cast("string")).otherwise(mask).alias("cnpj_cpf_socio"),
        F.lpad((k % 60).cast("string"), 2, "0").alias("qualificacao_socio"),
        F.when(k % 3 == 0, "249").alias("pais"),
    )


def slice_of_nations(t: Tables, region: int = 1) -> DataFrame:
    return t.nation.where(F.col("n_regionkey") == region).select(F.lpad(F.col("n_nationkey").cast("string"), 8, "0").alias("cnpj_basico"))
