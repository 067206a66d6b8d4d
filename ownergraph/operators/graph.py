"""The graph: nodes with a dense index, links, and the symmetric adjacency without loops and parallel pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ownergraph.errors import (
    BrokenSymmetry, IndexNotDense, IndexOutOfRange, LostEdge, RoleNotNumeric, RoleOutOfRange, UnknownEndpoint, UnorderedExistence, UnorderedNeighbours,
)
from ownergraph.functions import identity as I
from ownergraph.operators.identities import identified_partners
from ownergraph.session import materialise

#: Role of a link that has none, and the range of role codes.
NO_ROLE, ROLES = -1, (-128, 127)


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """``df`` with 0..n-1 in the order of ``key``, which must be unique and filled.

    Ranges of keys are numbered apart and shifted by the sizes of those before: one small row for each range meets in one place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id()), "dense-index")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("__part").orderBy(key)
    return (
        dealt.join(F.broadcast(shifts), "__part")  # as many rows as shuffle partitions
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("__shift"))
        .drop("__part", "__shift")
    )


def index_faults(df: DataFrame, name: str = "idx", key: str | None = None) -> DataFrame:
    """One row ``n, distinct_n, least, most, unordered``: sound if n = distinct_n = most + 1, least = 0 and nothing is unordered."""
    facts = df.agg(F.count("*").alias("n"), F.count_distinct(name).alias("distinct_n"), F.min(name).alias("least"), F.max(name).alias("most"))
    if key is None:
        return facts.withColumn("unordered", F.lit(0).cast("long"))
    after = df.select((F.col(name) + 1).alias(name), F.col(key).alias("__before"))
    return facts.crossJoin(df.join(after, name).agg(F.count_if(F.col("__before") >= F.col(key)).alias("unordered")))


def check_index(df: DataFrame, name: str = "idx", key: str | None = None) -> None:
    r = index_faults(df, name, key).first()
    if r["n"] and (r["n"] != r["distinct_n"] or r["least"] != 0 or r["most"] != r["n"] - 1 or r["unordered"]):
        raise IndexNotDense(f"{r['n']} rows, {r['distinct_n']} values from {r['least']} to {r['most']}, {r['unordered']} out of order")


def existence(the_slice: DataFrame) -> DataFrame:
    """``cnpj`` of every company in the slice, linked or not."""
    found = the_slice.select(F.col("cnpj_basico").cast("int").alias("cnpj"))
    if repeated := found.groupBy("cnpj").count().where("count > 1 OR cnpj IS NULL").limit(1).collect():
        raise UnorderedExistence(f"company {repeated[0]['cnpj']} exists {repeated[0]['count']} times")
    return found


def nodes(identities: DataFrame, partners: DataFrame, companies: DataFrame, the_slice: DataFrame, expose_people: bool = False) -> DataFrame:
    """All companies with a link on either side and all partners, numbered by key; people's names and numbers only if exposed."""
    linked = (
        partners.select("cnpj_basico")
        .unionByName(identities.where(F.col("tipo") == I.COMPANY).select("cnpj_basico"))
        .distinct()
        .join(the_slice.select("cnpj_basico"), "cnpj_basico", "left_semi")
    )
    # companies are cut down to those before their keys are hashed
    own = companies.join(linked, "cnpj_basico", "left_semi").select(
        I.company_id(F.col("cnpj_basico")).alias("identificador"), F.col("cnpj_basico").alias("c_base"), F.col("razao_social").alias("c_name"), F.lit(True).alias("c_in")
    )
    whole = identities.join(own, "identificador", "full_outer").select(
        "identificador",
        F.coalesce("tipo", F.lit(I.COMPANY)).alias("tipo"),
        F.coalesce("c_name", "nome").alias("nome"),
        F.coalesce("c_base", "cnpj_basico").alias("cnpj_basico"),
        "cpf_mascarado",
        "pais",
        F.coalesce("c_in", "no_recorte").alias("no_recorte"),
        F.coalesce("confianca", F.lit(I.EXACT)).alias("confianca"),
        "taxa_de_colisao",
    )
    return dense_index(project_privacy(whole, expose_people), "__key").withColumnRenamed("__key", "chave")


def project_privacy(df: DataFrame, expose_people: bool = False) -> DataFrame:
    """Names, keys and masks of people and foreigners are null unless exposed; the region stays in place of the mask."""
    hidden = F.col("tipo").isin(I.PERSON, I.FOREIGNER) & F.lit(not expose_people)
    public = lambda c: F.when(hidden, F.lit(None).cast("string")).otherwise(F.col(c))
    return df.select(
        F.col("identificador").alias("__key"), public("identificador").alias("identificador"), "tipo", public("nome").alias("nome"), "cnpj_basico",
        public("cpf_mascarado").alias("cpf_mascarado"), I.fiscal_region(F.col("cpf_mascarado")).alias("regiao_fiscal"), "pais", "no_recorte", "confianca", "taxa_de_colisao",
    )


def node_counts(the_nodes: DataFrame, the_existence: DataFrame) -> DataFrame:
    """``nos, isoladas`` and counts by kind: isolated companies exist without being nodes."""
    n = the_nodes.agg(
        F.count("*").alias("nos"),
        *(F.count_if(F.col("tipo") == k).alias(k) for k in I.KINDS.values()),
        F.count_if((F.col("tipo") == I.COMPANY) & F.col("no_recorte")).alias("__inside"),
        F.count_if(~F.col("no_recorte")).alias("conectores"),
    )
    return n.crossJoin(the_existence.agg(F.count("*").alias("__all"))).withColumn("isoladas", F.col("__all") - F.col("__inside")).drop("__all", "__inside")


def edges(partners: DataFrame, the_nodes: DataFrame) -> DataFrame:
    """``no_empresa, no_socio, qualificacao_socio`` for every link; an end that is no node is an error that names its side."""
    keys = the_nodes.select(F.col("chave"), F.col("idx"))
    links = identified_partners(partners).select(I.company_id(F.col("cnpj_basico")).alias("__c"), F.col("identificador").alias("__p"), "qualificacao_socio")
    found = links.join(keys.select(F.col("chave").alias("__c"), F.col("idx").alias("no_empresa")), "__c", "left").join(
        keys.select(F.col("chave").alias("__p"), F.col("idx").alias("no_socio")), "__p", "left"
    ).select("no_empresa", "no_socio", "qualificacao_socio")
    check_endpoints(found)
    return found


def endpoint_faults(links: DataFrame) -> DataFrame:
    return links.agg(F.count_if(F.col("no_empresa").isNull()).alias("empresas"), F.count_if(F.col("no_socio").isNull()).alias("socios"))


def check_endpoints(links: DataFrame) -> None:
    r = endpoint_faults(links).first()
    if r["empresas"] or r["socios"]:
        raise UnknownEndpoint(f"{r['empresas']} links have an unknown company, {r['socios']} an unknown partner")


def check_range(links: DataFrame, n: int) -> None:
    r = links.agg(F.min(F.least("no_empresa", "no_socio")).alias("a"), F.max(F.greatest("no_empresa", "no_socio")).alias("b")).first()
    if r["a"] is not None and (r["a"] < 0 or r["b"] >= n):
        raise IndexOutOfRange(f"ends go from {r['a']} to {r['b']}; there are {n} nodes")


def check_conservation(partners: DataFrame, links: DataFrame) -> None:
    before, after = partners.count(), links.count()
    if before != after:
        raise LostEdge(f"{before} links went in, {after} edges came out")


def edge_counters(links: DataFrame) -> DataFrame:
    """``vinculos, lacos, pares, pares_paralelos, pares_divergentes`` over ordered pairs."""
    pairs = links.groupBy("no_empresa", "no_socio").agg(F.count("*").alias("n"), F.count_distinct("qualificacao_socio").alias("roles"))
    loop = F.col("no_empresa") == F.col("no_socio")
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("vinculos"),
        F.coalesce(F.sum(F.when(loop, F.col("n"))), F.lit(0)).alias("lacos"),
        F.count("*").alias("pares"),
        F.count_if(F.col("n") > 1).alias("pares_paralelos"),
        F.count_if(F.col("roles") > 1).alias("pares_divergentes"),
    )


def check_roles(links: DataFrame) -> None:
    role = F.col("qualificacao_socio").try_cast("int")
    bad = links.where(F.col("qualificacao_socio").isNotNull() & role.isNull()).limit(1).collect()
    if bad:
        raise RoleNotNumeric(f"role {bad[0]['qualificacao_socio']!r} is no number")
    if far := links.where(~role.between(*ROLES)).limit(1).collect():
        raise RoleOutOfRange(f"role {far[0]['qualificacao_socio']} is not within {ROLES}")


def collapse(links: DataFrame) -> DataFrame:
    """``a, b, role, roles`` for each unordered pair of different nodes, with the smallest role."""
    role = F.coalesce(F.col("qualificacao_socio").try_cast("smallint"), F.lit(NO_ROLE).cast("smallint"))
    return (
        links.where("no_empresa <> no_socio")
        .select(F.least("no_empresa", "no_socio").alias("a"), F.greatest("no_empresa", "no_socio").alias("b"), role.alias("role"))
        .groupBy("a", "b")
        .agg(F.min("role").alias("role"), F.count_distinct("role").alias("roles"))
    )


def collapse_counters(links: DataFrame) -> DataFrame:
    """``lacos, arestas, pares_divergentes, pares_mutuos`` of the adjacency."""
    ordered = links.groupBy("no_empresa", "no_socio").agg(F.count("*").alias("n"))
    a = ordered.agg(
        F.coalesce(F.sum(F.when(F.col("no_empresa") == F.col("no_socio"), F.col("n"))), F.lit(0)).alias("lacos"),
        F.count_if(F.col("no_empresa") != F.col("no_socio")).alias("__ordered"),
    )
    b = collapse(links).agg(F.count("*").alias("arestas"), F.count_if(F.col("roles") > 1).alias("pares_divergentes"))
    return a.crossJoin(b).select("lacos", "arestas", "pares_divergentes", (F.col("__ordered") - F.col("arestas")).alias("pares_mutuos"))


def adjacency(links: DataFrame) -> DataFrame:
    """``src, dst, role`` in both directions."""
    pairs = collapse(links).select("a", "b", "role")
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "role").unionByName(
        pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "role")
    )


def neighbour_lists(adj: DataFrame) -> DataFrame:
    """``src, neighbours`` with the ordered array of (dst, role).  A hub's list is as long as its degree."""
    return adj.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "role"))).alias("neighbours"))


def degrees(adj: DataFrame, the_nodes: DataFrame, node: str = "idx") -> DataFrame:
    """``idx, degree`` of every node, 0 without neighbours."""
    counted = adj.groupBy(F.col("src").alias(node)).agg(F.count("*").alias("degree"))
    return the_nodes.select(node).join(counted, node, "left").select(node, F.coalesce("degree", F.lit(0)).alias("degree"))


def offsets(the_degrees: DataFrame, node: str = "idx") -> DataFrame:
    """``idx, offset``: neighbours of all nodes before; ranges of nodes are summed apart and shifted."""
    parts = int(the_degrees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(the_degrees.repartitionByRange(parts, node).withColumn("__part", F.spark_partition_id()), "offsets")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy("__part").agg(F.sum("degree").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("__part").orderBy(node).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(shifts), "__part").select(node, (F.coalesce(F.sum("degree").over(inside), F.lit(0)) + F.col("__shift")).alias("offset"))


def symmetry_faults(adj: DataFrame) -> DataFrame:
    """Rows of the adjacency whose opposite, with the same role, is missing."""
    back = adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "role")
    return adj.join(back, ["src", "dst", "role"], "left_anti")


def check_adjacency(adj: DataFrame) -> None:
    if not symmetry_faults(adj).isEmpty():
        raise BrokenSymmetry("an edge has no opposite of its role")
    if not adj.groupBy("src", "dst").count().where("count > 1").isEmpty():
        raise UnorderedNeighbours("a neighbour stands twice in a list")


def adjacent(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with whether they are neighbours."""
    marked = adj.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("__met"))
    return pairs.join(marked, ["a", "b"], "left").withColumn("adjacent", F.coalesce("__met", F.lit(False))).drop("__met")


def neighbours_of(wanted: DataFrame, the_nodes: DataFrame, adj: DataFrame, node: str = "idx") -> DataFrame:
    """``idx, dst, role`` of the wanted nodes; one that is no node is an error, never an empty answer."""
    if unknown := wanted.join(the_nodes.select(node), node, "left_anti").limit(5).collect():
        raise IndexOutOfRange(f"no such node: {', '.join(str(r[0]) for r in unknown)}")
    return wanted.join(adj.withColumnRenamed("src", node), node).select(node, "dst", "role")
