"""Connected components of an undirected edge list by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.session import discard, materialise

#: Shuffle partitions to a file of the tables between rounds.
SHRINK = 4
#: Links that one task may finish by itself; beyond it, rounds contract the graph further.
FEW_LINKS = 16_384


def _contract(links: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round: every node's parent, and the links between parents.

    A node's parent is the one of itself and its neighbours that a hash puts first.  The hash changes every second
    round: with one order a star is done in two, and with new ones a chain halves whatever its names are.
    """
    order = lambda name: F.struct(F.xxhash64(name, F.lit(turn // 2)).alias("h"), F.col(name).alias("x"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.min(order("b")).alias("m"))
    parents = materialise(first.select(F.col("a").alias("node"), F.least("m", order("a"))["x"].alias("parent")), "cc-parents", SHRINK)
    ends = links
    for end in ("a", "b"):
        ends = ends.join(parents.select(F.col("node").alias(end), F.col("parent").alias(f"p{end}")), end)
    kept = ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
    return parents, materialise(kept, "cc-links", SHRINK)


def _finish(links: DataFrame) -> DataFrame:
    """``node, component`` of at most FEW_LINKS links, by union and find in one task."""
    kind = links.schema["a"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        types = None
        for batch in batches:
            types = batch.schema.field("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        if root:
            yield pa.RecordBatch.from_arrays([pa.array(list(root), types), pa.array([find(x) for x in list(root)], types)], names=["node", "component"])

    return links.coalesce(1).mapInArrow(run, f"node {kind.simpleString()}, component {kind.simpleString()}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Rounds contract every node into a parent, so that links and nodes shrink geometrically and settled parts are not
    walked again; once few links are left, one task finishes them.  Labels then go back through the rounds, the last
    first.  Each round ends in written tables: no lineage grows and a lost executor costs one round.  Null ends and
    loops link nothing.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    links = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links", SHRINK)
    rounds: list[DataFrame] = []
    while links.count() > FEW_LINKS:
        parents, fewer = _contract(links, len(rounds))
        discard(links)
        rounds.append(parents)
        links = fewer
    labels = _finish(links)
    for parents in reversed(rounds):
        known = labels.select(F.col("node").alias("parent"), F.col("component").alias("found"))
        labels = parents.join(known, "parent", "left").select("node", F.coalesce("found", "parent").alias("component"))
    if rounds:  # the component is named by a parent; its smallest node is looked up
        labels = materialise(labels, "cc-labels", SHRINK)
        names = labels.groupBy("component").agg(F.min("node").alias("least"))
        labels = labels.join(names, "component").select("node", F.col("least").alias("component"))
    found = materialise(labels, "cc-components", SHRINK)
    discard(links, *rounds)
    return found


def canonical_components(nodes: DataFrame, edges: DataFrame, node: str = "idx", src: str = "src", dst: str = "dst") -> DataFrame:
    """``idx, component`` for every node; components are numbered by size, larger first, then by smallest node."""
    from ownergraph.operators.graph import dense_index

    found = connected_components(edges, src, dst)
    labelled = nodes.select(node).join(found, F.col(node) == F.col("node"), "left").select(node, F.coalesce("component", node).alias("__least"))
    sizes = labelled.groupBy("__least").agg(F.count("*").alias("__n")).withColumn("__order", F.struct((-F.col("__n")).alias("n"), "__least"))
    numbered = dense_index(sizes, "__order", "component")
    return labelled.join(numbered.select("__least", "component"), "__least").select(node, "component")


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def check_canonical(components: DataFrame, node: str = "idx") -> None:
    """Sizes fall, and among equals the smallest node rises."""
    from ownergraph.errors import LabelNotCanonical

    facts = components.groupBy("component").agg(F.count("*").alias("n"), F.min(node).alias("least"))
    after = facts.select((F.col("component") - 1).alias("component"), F.col("n").alias("n2"), F.col("least").alias("least2"))
    bad = facts.join(after, "component").where("n2 > n OR (n2 = n AND least2 < least)")
    first = facts.agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).first()
    if not bad.isEmpty() or (first["n"] and (first["a"] != 0 or first["b"] != first["n"] - 1)):
        raise LabelNotCanonical("components are not numbered by size and smallest node")


def component_summary(components: DataFrame) -> DataFrame:
    """``componentes, gigante, fora_do_gigante, isolados``"""
    return component_sizes(components).agg(
        F.count("*").alias("componentes"), F.max("size").alias("gigante"), (F.sum("size") - F.max("size")).alias("fora_do_gigante"),
        F.count_if(F.col("size") == 1).alias("isolados"),
    )


def largest_components(components: DataFrame, k: int = 10) -> DataFrame:
    return component_sizes(components).orderBy(F.desc("size"), "component").limit(k)
