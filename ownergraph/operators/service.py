"""Requests to answers: what a company is, how two are linked, who is near, and who asks too often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ownergraph.functions import decoding as D
from ownergraph.functions import identity as I
from ownergraph.functions.documents import cnpj_format
from ownergraph.operators import traversal as T
from ownergraph.session import materialise

VERSION = "0.2.0"
NO_LINK, UNKNOWN, NODE = "sem_vinculo", "desconhecida", "no"
#: Outcomes that say there is no link at all.
ABSENT = (NO_LINK, T.APART)


def resolve(requests: DataFrame, catalogue: DataFrame, existence: DataFrame, key: str = "cnpj") -> DataFrame:
    """``requests`` with ``idx`` and ``status``: a node, a company without links, or unknown."""
    nodes = catalogue.select(F.col(key), "idx")
    exists = existence.select(F.col(key), F.lit(True).alias("__exists"))
    status = F.when(F.col("idx").isNotNull(), NODE).when(F.col("__exists"), NO_LINK).otherwise(UNKNOWN)
    return requests.join(nodes, key, "left").join(exists, key, "left").withColumn("status", status).drop("__exists")


def unknown_ends(pairs: DataFrame, catalogue: DataFrame, existence: DataFrame) -> DataFrame:
    """``pair, desconhecidas``: every unknown end of a pair (pair, de, para), in order; these beat all other answers."""
    ends = pairs.select("pair", F.posexplode(F.array("de", "para")).alias("at", "cnpj"))
    bad = resolve(ends, catalogue, existence).where(F.col("status") == UNKNOWN)
    return bad.groupBy("pair").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cnpj"))), lambda x: x["cnpj"]).alias("desconhecidas"))


def explain_path(outcome: Column, distance: Column, limit: int) -> Column:
    """One sentence an outcome, which never lets "not found" pass for "not there"."""
    hops = D.plural(distance, "salto", "saltos")
    most = "1 salto" if limit == 1 else f"{limit} saltos"
    return (
        F.when(outcome == T.FOUND, F.concat(F.lit("Existe um caminho societário, de "), hops, F.lit(".")))
        .when(outcome == NO_LINK, F.lit("Uma das empresas existe no recorte sem nenhum vínculo registrado."))
        .when(outcome == T.APART, F.lit("Nenhum caminho liga as duas empresas, qualquer que seja o limite."))
        .when((outcome == T.BEYOND) & distance.isNotNull(), F.concat(F.lit("O vínculo existe, de "), hops, F.lit(f", além do limite de {most}; o trajeto não é mostrado.")))
        .when(outcome == T.BEYOND, F.lit(f"Existe um caminho, mais longo que {most}; o vínculo não está negado."))
        .when(outcome == T.SPENT, F.lit("Existe um caminho, e a busca parou no orçamento de nós antes de achá-lo; o vínculo não está negado."))
    )


def path_answers(pairs: DataFrame, catalogue: DataFrame, existence: DataFrame, adj: DataFrame, components: DataFrame, limit: int = 10, budget: int = T.BUDGET) -> DataFrame:
    """``pair, desfecho, afirma_ausencia, explicacao, distancia, nos, visitados`` for pairs (pair, de, para) of known companies.

    The search itself has no limit of depth; what lies beyond ``limit`` is told with its distance and without its path.
    """
    one = resolve(pairs.withColumnRenamed("de", "cnpj"), catalogue, existence).select("pair", F.col("idx").alias("a"), F.col("status").alias("sa"), "para")
    both = resolve(one.withColumnRenamed("para", "cnpj"), catalogue, existence).select("pair", "a", "sa", F.col("idx").alias("b"), F.col("status").alias("sb"))
    known = both.where((F.col("sa") != UNKNOWN) & (F.col("sb") != UNKNOWN))
    searched = T.find_paths(known.where("a IS NOT NULL AND b IS NOT NULL").select("pair", "a", "b"), adj, components, T.NO_LIMIT, budget)
    far = (F.col("desfecho") == T.FOUND) & (F.col("distancia") > limit)
    answers = searched.select(
        "pair", F.when(far, T.BEYOND).otherwise(F.col("desfecho")).alias("desfecho"), "distancia",
        F.when(far, F.array().cast("array<bigint>")).otherwise(F.col("nos")).alias("nos"), "visitados",
    ).unionByName(known.where("a IS NULL OR b IS NULL").select(
        "pair", F.lit(NO_LINK).alias("desfecho"), F.lit(None).cast("int").alias("distancia"), F.array().cast("array<bigint>").alias("nos"), F.lit(0).cast("long").alias("visitados"),
    ))
    return answers.withColumns({
        "afirma_ausencia": F.col("desfecho").isin(*ABSENT), "explicacao": explain_path(F.col("desfecho"), F.col("distancia"), limit),
    })


def answer_nodes(listed: DataFrame, catalogue: DataFrame, degrees: DataFrame, expose_people: bool = False) -> DataFrame:
    """Nodes of an answer (``request, position, idx``) as they are shown: people by their place in the answer only."""
    hidden = (F.col("tipo") != I.COMPANY) & F.lit(not expose_people)
    return (
        listed.join(catalogue, "idx").join(degrees, "idx").select(
            "request", "position", "tipo", F.when(~hidden, F.col("nome")).alias("nome"), D.partner_label(F.col("tipo"), F.col("position")).alias("rotulo"),
            cnpj_format(F.col("cnpj_basico")).alias("cnpj"), "regiao_fiscal", "confianca", "taxa_de_colisao", "no_recorte", F.col("degree").alias("vinculos_no_recorte"),
        )
    )


def explain_neighbourhood(n: Column, hops: Column, refused: Column) -> Column:
    reach = F.when(hops == 0, F.lit("só a própria empresa")).otherwise(F.concat(F.lit("até "), D.plural(hops, "salto", "saltos")))
    rest = F.when(refused > 0, F.concat(F.lit("; o nível seguinte, de "), D.plural(refused, "nó", "nós"), F.lit(", não coube no teto e ficou fora inteiro."))).otherwise("; nada ficou fora.")
    return F.concat(D.plural(n, "nó", "nós"), F.lit(", "), reach, rest)


def company_summary(requests: DataFrame, catalogue: DataFrame, existence: DataFrame, degrees: DataFrame, components: DataFrame) -> DataFrame:
    """``cnpj, tem_vinculo, nome, no_recorte, vinculos_no_recorte, tamanho_do_componente_no_recorte, explicacao`` of known companies."""
    found = resolve(requests, catalogue.select("cnpj", "idx"), existence).where(F.col("status") != UNKNOWN)
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    labelled = components.join(sizes, "component").select("idx", "size")
    whole = found.join(catalogue.drop("cnpj"), "idx", "left").join(degrees, "idx", "left").join(labelled, "idx", "left")
    links, nodes = D.plural(F.col("degree"), "vínculo", "vínculos"), D.plural(F.col("size"), "nó", "nós")
    linked = F.col("status") == NODE
    text = F.concat(links, F.lit(" no recorte, em componente de "), nodes, F.when(F.col("no_recorte") == F.lit(False), "; conector de fora do recorte.").otherwise("."))
    return whole.select(
        "cnpj", linked.alias("tem_vinculo"), F.when(linked, F.col("nome")).alias("nome"), F.when(linked, F.col("no_recorte")).otherwise(True).alias("no_recorte"),
        F.coalesce("degree", F.lit(0)).alias("vinculos_no_recorte"), F.col("size").alias("tamanho_do_componente_no_recorte"),
        F.when(linked, text).otherwise("Existe no recorte sem nenhum vínculo registrado.").alias("explicacao"),
    )


def rate_limit(requests: DataFrame, per_window: int = 60, seconds: int = 60) -> DataFrame:
    """``requests`` (client, ts, id) with ``window_start, count_in_window, allowed, retry_after``; refused ones count too.

    Windows are fixed and the same for all clients.  A client's requests of one window are one group: a minute's worth.
    """
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    start = epoch - F.pmod(epoch, F.lit(seconds))
    order = Window.partitionBy("client", "window_start").orderBy("ts", "id")
    return requests.withColumn("window_start", start).withColumn("count_in_window", F.row_number().over(order)).withColumns({
        "allowed": F.col("count_in_window") <= per_window, "retry_after": F.lit(seconds) - F.pmod(epoch, F.lit(seconds)),
    })


def neighbourhood_answers(
    requests: DataFrame, catalogue: DataFrame, existence: DataFrame, nodes: DataFrame, adj: DataFrame, hops: int = 2, cap: int = 1000, expose_people: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Head, nodes and edges of the answers to ``requests`` (request, cnpj) of known companies.

    Nodes stand in order of depth and index; edges are pairs of these positions, never of indices, and all edges
    between two nodes of an answer are there.  A company without links has an empty answer.
    """
    known = resolve(requests, catalogue, existence).where(F.col("status") != UNKNOWN).select("request", "cnpj", "idx")
    members, facts = T.neighbourhoods(known.where("idx IS NOT NULL").select("idx"), adj, hops, cap)
    place = Window.partitionBy("origin").orderBy("depth", "idx")
    placed = materialise(members.withColumn("position", F.row_number().over(place) - 1), "answer-members")
    sizes = placed.groupBy("origin").agg(F.count("*").alias("n"))
    told = known.join(facts.join(sizes, "origin").withColumnRenamed("origin", "idx"), "idx", "left")
    linked = F.col("idx").isNotNull()
    head = told.select(
        "request", "cnpj", linked.alias("tem_vinculo"), F.lit(hops).alias("saltos_pedidos"), F.coalesce("saltos", F.lit(0)).alias("saltos"), F.lit(cap).alias("teto_de_nos"),
        F.coalesce("truncada", F.lit(False)).alias("truncada"), F.coalesce("nivel_recusado", F.lit(0)).alias("nivel_recusado"),
        F.when(linked, explain_neighbourhood(F.col("n"), F.col("saltos"), F.col("nivel_recusado"))).otherwise(F.lit("Existe no recorte sem nenhum vínculo registrado.")).alias("explicacao"),
    )
    asked = known.where("idx IS NOT NULL").select("request", F.col("idx").alias("origin"))
    listed = asked.join(placed, "origin").select("request", "position", "idx", "depth")
    shown = answer_nodes(listed, nodes, _degrees(adj, nodes), expose_people).join(listed.select("request", "position", F.col("depth").alias("profundidade")), ["request", "position"])
    at = lambda end: placed.select("origin", F.col("idx").alias(end), F.col("position").alias(f"__{end}"))
    pairs = T.induced_edges(placed, adj).join(at("src"), ["origin", "src"]).join(at("dst"), ["origin", "dst"])
    edges = asked.join(pairs, "origin").select("request", F.least("__src", "__dst").alias("de"), F.greatest("__src", "__dst").alias("para"))
    return head, shown, edges


def _degrees(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    from ownergraph.operators.graph import degrees

    return degrees(adj, nodes)


def health(nodes: DataFrame, adj: DataFrame, components: DataFrame, existence: DataFrame | None = None, period: str | None = None, digests: DataFrame | None = None) -> DataFrame:
    """One row: version, period, whether the tables fit together, their sizes, and the digests of what is published."""
    a = nodes.agg(F.count("*").alias("nos"))
    b = adj.agg(F.expr("count(*) div 2").alias("arestas"))
    c = components.agg(F.count("*").alias("rotulos"), F.count_distinct("component").alias("componentes"))
    whole = a.crossJoin(b).crossJoin(c).withColumn("coerente", F.col("nos") == F.col("rotulos"))  # one row each
    if existence is not None:
        whole = whole.crossJoin(existence.agg(F.count("*").alias("empresas_no_recorte")))
    if digests is not None:  # a row a published file
        whole = whole.crossJoin(digests.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "sha256")))).alias("artefatos")))
    return whole.withColumns({"versao": F.lit(VERSION), "competencia": F.lit(period)})
