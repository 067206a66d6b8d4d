"""Shortest paths and neighbourhoods for many requests at once.

A search goes from both ends, one whole level at a time, always on the side with fewer nodes in front.  All
requests take their levels together: a round is a join with the adjacency and an aggregate, and what it
found is a written table.  "No path", "not searched that far" and "gave up" are different answers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.errors import InconsistentArtefacts, InvalidRequest
from ownergraph.session import materialise

FOUND, APART, BEYOND, SPENT = "encontrado", "componentes_diferentes", "alem_do_limite", "orcamento_excedido"
NO_LIMIT, BUDGET = 2**31 - 1, 250_000
MAX_HOPS_CAP = 1000


def find_paths(pairs: DataFrame, adj: DataFrame, components: DataFrame, max_depth: int = NO_LIMIT, budget: int = BUDGET) -> DataFrame:
    """``pair, desfecho, distancia, nos, visitados`` for every row of ``pairs`` (pair, a, b; unique pair).

    Ends are nodes of ``components`` (idx, component).  The smaller end is the origin of the search; among nodes at
    the same depth the parent is the smallest, and of several meeting points the smallest is taken, so the path is one.
    """
    lab = components.select(F.col("idx").alias("__i"), F.col("component").alias("__c"))
    labelled = (
        pairs.join(lab.select(F.col("__i").alias("a"), F.col("__c").alias("ca")), "a", "left")
        .join(lab.select(F.col("__i").alias("b"), F.col("__c").alias("cb")), "b", "left")
        .select("pair", "a", "b", "ca", "cb")
    )
    requests = materialise(labelled, "paths-requests")
    if not requests.where("ca IS NULL OR cb IS NULL").isEmpty():
        raise InvalidRequest("an end of a pair is no node")
    outcome = F.when(F.col("ca") != F.col("cb"), APART).when(F.col("a") == F.col("b"), FOUND).when(F.lit(max_depth < 1), BEYOND)
    trivial = F.when(F.col("a") == F.col("b"), F.array("a"))
    done = [
        requests.withColumn("desfecho", outcome).where("desfecho IS NOT NULL").select(
            "pair", "desfecho",
            F.when(F.col("desfecho") == FOUND, 0).cast("int").alias("distancia"),
            F.when(F.col("desfecho") == FOUND, trivial).otherwise(F.array().cast("array<bigint>")).alias("nos"),
            F.when(F.col("desfecho") == FOUND, 1).otherwise(0).cast("long").alias("visitados"),
        )
    ]
    open_ = requests.withColumn("o", outcome).where("o IS NULL").select(
        "pair", (F.col("a") > F.col("b")).alias("swapped"), F.least("a", "b").alias("o"), F.greatest("a", "b").alias("d")
    )
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("o").alias("node")), F.struct(F.lit(1).alias("side"), F.col("d").alias("node")))).alias("e")
    seen = [materialise(open_.select("pair", ends).select("pair", "e.side", "e.node", F.lit(0).alias("depth"), F.array("e.node").alias("path")), "paths-seen")]
    one = F.lit(1).cast("long")
    state = materialise(
        open_.select("pair", "swapped", *(F.lit(0).alias(f"l{s}") for s in (0, 1)), *(one.alias(f"f{s}") for s in (0, 1)), *(one.alias(f"n{s}") for s in (0, 1))), "paths-state"
    )
    links = adj.select(F.col("src").alias("node"), "dst")
    while True:
        visited = F.col("n0") + F.col("n1")
        judged = state.withColumn(
            "desfecho", F.when(F.col("l0") + F.col("l1") + 1 > max_depth, BEYOND).when(visited > budget, SPENT)
        ).withColumn("visitados", visited)
        stopped = judged.where("desfecho IS NOT NULL")
        done.append(stopped.select("pair", "desfecho", F.lit(None).cast("int").alias("distancia"), F.array().cast("array<bigint>").alias("nos"), "visitados"))
        going = judged.where("desfecho IS NULL").drop("desfecho", "visitados").withColumn("side", F.when(F.col("f0") <= F.col("f1"), 0).otherwise(1))
        if going.isEmpty():
            break
        whole = reduce(DataFrame.unionByName, seen)
        front = whole.join(
            going.select("pair", "side", F.when(F.col("side") == 0, F.col("l0")).otherwise(F.col("l1")).alias("depth")), ["pair", "side", "depth"]
        )
        grown = (
            front.join(links, "node")
            .select("pair", "side", F.col("dst").alias("__n"), F.struct(F.col("node").alias("parent"), "path").alias("via"), "depth")
            .withColumnRenamed("__n", "node")
            .join(whole.select("pair", "side", "node"), ["pair", "side", "node"], "left_anti")
            .groupBy("pair", "side", "node")
            .agg(F.min("via").alias("via"), F.min("depth").alias("depth"))
            .select("pair", "side", "node", (F.col("depth") + 1).alias("depth"), F.concat("via.path", F.array("node")).alias("path"))
        )
        level = materialise(grown, "paths-seen")
        other = whole.select("pair", (1 - F.col("side")).alias("side"), "node", F.col("depth").alias("depth2"), F.col("path").alias("path2"))
        met = (
            level.join(other, ["pair", "side", "node"])
            .groupBy("pair")
            .agg(F.min(F.struct((F.col("depth") + F.col("depth2")).alias("total"), "node", "side", "path", "path2")).alias("m"))
        )
        sizes = level.groupBy("pair").agg(F.count("*").alias("grown"))
        stepped = materialise(going.join(sizes, "pair", "left").join(met, "pair", "left"), "paths-state")
        if not stepped.where("grown IS NULL").isEmpty():
            raise InconsistentArtefacts("nodes of one component do not reach each other")
        seen.append(level)
        found = stepped.where("m IS NOT NULL")
        from_o = F.when(F.col("m.side") == 0, F.col("m.path")).otherwise(F.col("m.path2"))
        from_d = F.when(F.col("m.side") == 0, F.col("m.path2")).otherwise(F.col("m.path"))
        forth = F.concat(from_o, F.slice(F.reverse(from_d), 2, F.greatest(F.size(from_d) - 1, F.lit(0))))
        done.append(found.select(
            "pair", F.lit(FOUND).alias("desfecho"), F.col("m.total").cast("int").alias("distancia"),
            F.when(F.col("swapped"), F.reverse(forth)).otherwise(forth).alias("nos"), (F.col("n0") + F.col("n1") + F.col("grown")).alias("visitados"),
        ))
        side = F.col("side")
        state = stepped.where("m IS NULL").select(
            "pair", "swapped",
            *((F.col(f"l{s}") + F.when(side == s, 1).otherwise(0)).alias(f"l{s}") for s in (0, 1)),
            *(F.when(side == s, F.col("grown")).otherwise(F.col(f"f{s}")).alias(f"f{s}") for s in (0, 1)),
            *((F.col(f"n{s}") + F.when(side == s, F.col("grown")).otherwise(0)).alias(f"n{s}") for s in (0, 1)),
        )
    return reduce(DataFrame.unionByName, done)


def neighbourhoods(origins: DataFrame, adj: DataFrame, hops: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` of each origin (``origin, idx, depth``) and how far it went (``origin, saltos, nivel_recusado, truncada``).

    A level enters whole or not at all: the first one that would pass ``cap`` is refused and its size told.
    """
    if hops < 0 or cap < 1:
        raise InvalidRequest(f"hops must be 0 or more and the cap 1 or more, not {hops} and {cap}")
    links = adj.select(F.col("src").alias("idx"), "dst")
    start = origins.select(F.col("idx").alias("origin")).distinct()
    seen = [materialise(start.select("origin", F.col("origin").alias("idx"), F.lit(0).alias("depth")), "hops-seen")]
    refused = []
    going = start
    for hop in range(1, hops + 1):
        whole = reduce(DataFrame.unionByName, seen)
        front = whole.where(F.col("depth") == hop - 1).join(going, "origin", "left_semi")
        grown = materialise(
            front.join(links, "idx").select("origin", F.col("dst").alias("idx")).distinct().join(whole.select("origin", "idx"), ["origin", "idx"], "left_anti"), "hops-level"
        )
        if grown.isEmpty():
            break
        sizes = grown.groupBy("origin").agg(F.count("*").alias("n")).join(whole.groupBy("origin").agg(F.count("*").alias("was")), "origin")
        judged = materialise(sizes.withColumn("fits", F.col("n") + F.col("was") <= cap), "hops-judged")
        refused.append(judged.where("NOT fits").select("origin", F.col("n").alias("nivel_recusado")))
        going = judged.where("fits").select("origin")
        seen.append(grown.join(going, "origin", "left_semi").withColumn("depth", F.lit(hop)))
    whole = reduce(DataFrame.unionByName, seen)
    reached = whole.groupBy("origin").agg(F.max("depth").alias("saltos"))
    if refused:
        reached = reached.join(reduce(DataFrame.unionByName, refused), "origin", "left")
    else:
        reached = reached.withColumn("nivel_recusado", F.lit(None).cast("long"))
    facts = reached.select("origin", "saltos", F.coalesce("nivel_recusado", F.lit(0)).alias("nivel_recusado")).withColumn("truncada", F.col("nivel_recusado") > 0)
    return whole, facts


def induced_edges(members: DataFrame, adj: DataFrame) -> DataFrame:
    """``origin, src, dst, role`` of the edges with both ends among an origin's members."""
    a = members.select("origin", F.col("idx").alias("src"))
    b = members.select("origin", F.col("idx").alias("dst"))
    return a.join(adj.where("src < dst"), "src").join(b, ["origin", "dst"], "left_semi").select("origin", "src", "dst", "role")


def cycles(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``origin, ciclos``: edges less a tree's."""
    n = members.groupBy("origin").agg(F.count("*").alias("n"))
    e = edges.groupBy("origin").agg(F.count("*").alias("e"))
    return n.join(e, "origin", "left").select("origin", (F.coalesce("e", F.lit(0)) - F.col("n") + 1).alias("ciclos"))
