import random
from collections import deque

import pytest

from ownergraph import errors as E
from ownergraph.operators import components as C
from ownergraph.operators import graph as G
from ownergraph.operators import identities as P
from ownergraph.operators import metrics as M
from ownergraph.operators import release as R
from ownergraph.operators import service as V
from ownergraph.operators import traversal as T

LINKS = "no_empresa long, no_socio long, qualificacao_socio string"


def graph(spark, n, pairs):
    links = spark.createDataFrame([(a, b, "49") for a, b in pairs], LINKS)
    nodes = spark.range(n).withColumnRenamed("id", "idx")
    adj = G.adjacency(links)
    return nodes, adj, C.canonical_components(nodes, adj)


def plain(n, pairs):
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def distances(near, a):
    found, queue = {a: 0}, deque([a])
    while queue:
        x = queue.popleft()
        for y in near[x]:
            if y not in found:
                found[y] = found[x] + 1
                queue.append(y)
    return found


def test_collapse_and_counters(spark):
    links = spark.createDataFrame([(0, 0, "49"), (0, 1, "49"), (0, 1, "22"), (1, 0, "50"), (1, 2, None)], LINKS)
    c = G.edge_counters(links).first()
    assert (c.vinculos, c.lacos, c.pares, c.pares_paralelos, c.pares_divergentes) == (5, 1, 4, 1, 1)
    c = G.collapse_counters(links).first()
    assert (c.lacos, c.arestas, c.pares_divergentes, c.pares_mutuos) == (1, 2, 1, 1)
    adj = G.adjacency(links)
    assert sorted(map(tuple, adj.collect())) == [(0, 1, 22), (1, 0, 22), (1, 2, -1), (2, 1, -1)]
    G.check_adjacency(adj)
    with pytest.raises(E.BrokenSymmetry):
        G.check_adjacency(adj.where("src < dst"))
    with pytest.raises(E.UnorderedNeighbours):
        G.check_adjacency(adj.union(adj))
    with pytest.raises(E.RoleNotNumeric):
        G.check_roles(spark.createDataFrame([(0, 1, "x")], LINKS))
    with pytest.raises(E.RoleOutOfRange):
        G.check_roles(spark.createDataFrame([(0, 1, "200")], LINKS))
    with pytest.raises(E.UnknownEndpoint, match="1 links have an unknown company"):
        G.check_endpoints(spark.createDataFrame([(None, 1, "1")], LINKS))
    with pytest.raises(E.IndexOutOfRange):
        G.check_range(links, 2)
    with pytest.raises(E.LostEdge):
        G.check_conservation(links, links.limit(1))


def test_dense_index(spark):
    keys = [f"k{i:03d}" for i in random.Random(1).sample(range(500), 300)]
    df = G.dense_index(spark.createDataFrame([(k,) for k in keys], "k string").repartition(5), "k")
    assert {r.k: r.idx for r in df.collect()} == {k: i for i, k in enumerate(sorted(keys))}
    G.check_index(df, "idx", "k")
    with pytest.raises(E.IndexNotDense):
        G.check_index(df.where("idx <> 5"))
    assert G.dense_index(spark.createDataFrame([], "k string"), "k").count() == 0


def test_offsets_and_lists(spark):
    nodes, adj, _ = graph(spark, 5, [(0, 3), (3, 1), (1, 0)])
    degrees = G.degrees(adj, nodes)
    assert [r.degree for r in degrees.orderBy("idx").collect()] == [2, 2, 0, 2, 0]
    assert [r.offset for r in G.offsets(degrees).orderBy("idx").collect()] == [0, 2, 4, 4, 6]
    assert [[x.dst for x in r.neighbours] for r in G.neighbour_lists(adj).orderBy("src").collect()] == [[1, 3], [0, 3], [0, 1]]
    with pytest.raises(E.IndexOutOfRange):
        G.neighbours_of(spark.createDataFrame([(9,)], "idx long"), nodes, adj)


@pytest.mark.parametrize("extra", [[], [(0, 6)]])
def test_components_by_hand(spark, extra):
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (6, 7), (8, 9), (10, 11), (11, 10), (12, 12), *extra]
    _, _, labels = graph(spark, 13, pairs)
    sizes = [r.size for r in C.component_sizes(labels).orderBy("component").collect()]
    assert sizes == ([8, 2, 2, 1] if extra else [6, 2, 2, 2, 1])
    C.check_canonical(labels)
    with pytest.raises(E.LabelNotCanonical):
        C.check_canonical(labels.selectExpr("idx", "5 - component AS component"))


def test_long_chain_and_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)]
    found = {r.node: r.component for r in C.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 100 for i in range(100, 400))
    assert C.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def shapes():
    rnd = random.Random(7)
    yield "chain", 12, [(i, i + 1) for i in range(11)]
    yield "star and pair", 8, [(0, 1), (0, 2), (0, 3), (0, 4), (5, 6)]
    yield "two shortest", 4, [(0, 1), (0, 2), (1, 3), (2, 3)]
    yield "triangle with a tail", 6, [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)]
    yield "complete", 6, [(i, j) for i in range(6) for j in range(i)]
    yield "no edge but one", 5, [(3, 4)]
    yield "random", 40, [(rnd.randrange(40), rnd.randrange(40)) for _ in range(55)]


def reference_path(near, a, b):
    """Level by level from both ends, in plain Python: the path that the tie-breaks prescribe, and the nodes seen."""
    o, d = min(a, b), max(a, b)
    seen = [{o: (o,)}, {d: (d,)}]
    front = [[o], [d]]
    if a == b:
        return [a], 1
    while True:
        s = 0 if len(front[0]) <= len(front[1]) else 1
        new = {}
        for x in sorted(front[s]):
            for y in sorted(near[x]):
                if y not in seen[s] and y not in new:
                    new[y] = (*seen[s][x], y)
        seen[s] |= new
        front[s] = list(new)
        met = [y for y in new if y in seen[1 - s]]
        if met:
            m = min(met, key=lambda y: (len(seen[0][y]) + len(seen[1][y]), y))
            path = [*seen[0][m], *reversed(seen[1][m][:-1])]
            return (path if a <= b else path[::-1]), len(seen[0]) + len(seen[1])


@pytest.mark.parametrize(("name", "n", "pairs"), list(shapes()), ids=[s[0] for s in shapes()])
def test_paths_against_plain_search(spark, name, n, pairs):
    nodes, adj, labels = graph(spark, n, pairs)
    near = plain(n, pairs)
    rnd = random.Random(3)
    asked = [(i, *(rnd.randrange(n), rnd.randrange(n))) for i in range(25)]
    got = {r.pair: r for r in T.find_paths(spark.createDataFrame(asked, "pair long, a long, b long"), adj, labels).collect()}
    assert len(got) == 25
    for k, a, b in asked:
        d = distances(near, a).get(b)
        if d is None:
            assert (got[k].desfecho, got[k].distancia, got[k].nos, got[k].visitados) == (T.APART, None, [], 0)
        else:
            path, visited = reference_path(near, a, b)
            assert (got[k].desfecho, got[k].distancia, got[k].nos, got[k].visitados) == (T.FOUND, d, path, visited)
    if name == "chain":
        limited = {r.pair: r for r in T.find_paths(spark.createDataFrame([(0, 0, 5), (1, 0, 4), (2, 3, 3)], "pair long, a long, b long"), adj, labels, max_depth=4).collect()}
        assert [limited[i].desfecho for i in range(3)] == [T.BEYOND, T.FOUND, T.FOUND] and limited[0].distancia is None
        spent = T.find_paths(spark.createDataFrame([(0, 0, 11)], "pair long, a long, b long"), adj, labels, budget=4).first()
        assert (spent.desfecho, spent.nos) == (T.SPENT, [])
        with pytest.raises(E.InvalidRequest):
            T.find_paths(spark.createDataFrame([(0, 0, 99)], "pair long, a long, b long"), adj, labels)


def test_neighbourhood_by_hand(spark):
    nodes, adj, _ = graph(spark, 6, [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)])
    origin = nodes.where("idx = 0")

    def ask(hops, cap):
        members, facts = T.neighbourhoods(origin, adj, hops, cap)
        f = facts.first()
        return sorted(r.idx for r in members.collect()), f.saltos, f.nivel_recusado, f.truncada, sorted((r.src, r.dst) for r in T.induced_edges(members, adj).collect())

    assert ask(1, 100) == ([0, 1, 2], 1, 0, False, [(0, 1), (0, 2), (1, 2)])
    assert ask(1, 2) == ([0], 0, 2, True, [])
    assert ask(2, 3) == ([0, 1, 2], 1, 1, True, [(0, 1), (0, 2), (1, 2)])
    assert ask(10, 100)[:4] == ([0, 1, 2, 3, 4], 3, 0, False)
    assert ask(0, 1) == ([0], 0, 0, False, [])
    members, _ = T.neighbourhoods(origin, adj, 10, 100)
    assert T.cycles(members, T.induced_edges(members, adj)).first().ciclos == 1
    with pytest.raises(E.InvalidRequest):
        T.neighbourhoods(origin, adj, -1, 1)


def test_metrics(spark):
    nodes, adj, labels = graph(spark, 8, [(0, 1), (0, 2), (0, 3), (0, 4), (5, 6)])
    degrees = G.degrees(adj, nodes)
    m = M.graph_metrics(degrees, labels).first()
    assert (m.nos, m.arestas, m.grau_medio, m.grau_mediano, m.grau_maximo, m.componentes, m.gigante, m.fora_do_gigante) == (8, 5, 1.25, 1, 4, 3, 5, 3)
    assert [(r.idx, r.degree) for r in M.hubs(degrees, 2).collect()] == [(0, 4), (1, 1)]


COLUMNS = "cnpj_basico string, identificador_socio string, nome_socio_ou_razao_social string, cnpj_cpf_socio string, qualificacao_socio string, pais string"


def golden(spark):
    the_slice = spark.createDataFrame([(x,) for x in ("11111111", "22222222", "33333333", "44444444")], "cnpj_basico string")
    companies = spark.createDataFrame([("11111111", "ALFA LTDA"), ("22222222", "BRAVO LTDA"), ("33333333", "CHARLIE LTDA"), ("44444444", "DELTA LTDA")], "cnpj_basico string, razao_social string")
    partners = spark.createDataFrame([("11111111", "2", "FULANO", "***456789**", "49", None), ("11111111", "1", "BRAVO", "22222222000191", "22", None), ("33333333", "1", "FORA", "99999999000199", "22", None)], COLUMNS)
    found, _ = P.identities(partners, the_slice)
    return the_slice, companies, partners, found


def test_nodes_and_edges(spark):
    the_slice, companies, partners, found = golden(spark)
    nodes = G.nodes(found, partners, companies, the_slice).cache()
    rows = {r.cnpj_basico or r.tipo: r for r in nodes.collect()}
    assert set(rows) == {"11111111", "22222222", "33333333", "99999999", "pessoa_fisica"}
    assert rows["22222222"].nome == "BRAVO LTDA" and rows["99999999"].no_recorte is False and rows["11111111"].no_recorte is True
    person = rows["pessoa_fisica"]
    assert (person.nome, person.identificador, person.cpf_mascarado, person.regiao_fiscal, person.no_recorte) == (None, None, None, "9", None)
    assert R.named_persons(nodes).first().n == 0
    assert R.named_persons(G.nodes(found, partners, companies, the_slice, expose_people=True)).first().n == 1
    c = G.node_counts(nodes, G.existence(the_slice)).first()
    assert (c.nos, c.pessoa_juridica, c.pessoa_fisica, c.conectores, c.isoladas) == (5, 4, 1, 1, 1)
    links = G.edges(partners, nodes)
    assert links.count() == 3
    with pytest.raises(E.UnknownEndpoint):
        G.edges(partners, nodes.where("cnpj_basico IS NULL OR cnpj_basico <> '99999999'"))
    with pytest.raises(E.UnorderedExistence):
        G.existence(the_slice.union(the_slice))


def test_answers(spark):
    """ALFA - person - BRAVO, DELTA - person - ECHO, one company alone, one outside, one unknown."""
    names = ["11111111", None, "22222222", "44444444", None, "55555555", "99999999"]
    nodes, adj, labels = graph(spark, 7, [(0, 1), (2, 1), (3, 4), (5, 4), (0, 6)])
    catalogue = spark.createDataFrame([(i, x, "pessoa_juridica" if x else "pessoa_fisica", f"N{i}" if x else "FULANO", x, "9", "exata", None, x != "99999999" if x else None) for i, x in enumerate(names)],
        "idx long, cnpj string, tipo string, nome string, cnpj_basico string, regiao_fiscal string, confianca string, taxa_de_colisao double, no_recorte boolean")
    exists = spark.createDataFrame([(x,) for x in ("11111111", "22222222", "33333333", "44444444", "55555555")], "cnpj string")
    asked = spark.createDataFrame([(0, "11111111", "22222222"), (1, "11111111", "44444444"), (2, "33333333", "11111111"), (3, "33333333", "33333333"), (4, "66666666", "33333333"), (5, "99999999", "11111111")], "pair long, de string, para string")
    got = {r.pair: r for r in V.path_answers(asked, catalogue.where("cnpj IS NOT NULL"), exists, adj, labels).collect()}
    assert {k: (r.desfecho, r.afirma_ausencia, r.distancia) for k, r in got.items()} == {
        0: ("encontrado", False, 2), 1: ("componentes_diferentes", True, None), 2: ("sem_vinculo", True, None), 3: ("sem_vinculo", True, None), 5: ("encontrado", False, 1),
    }
    assert got[0].nos == [0, 1, 2] and "2 saltos" in got[0].explicacao
    short = {r.pair: r for r in V.path_answers(asked, catalogue.where("cnpj IS NOT NULL"), exists, adj, labels, limit=1).collect()}
    assert (short[0].desfecho, short[0].distancia, short[0].nos) == ("alem_do_limite", 2, [])
    assert [tuple(r) for r in V.unknown_ends(asked, catalogue, exists).collect()] == [(4, ["66666666"])]
    degrees = G.degrees(adj, nodes)
    listed = spark.createDataFrame([(1, p, i) for p, i in enumerate(got[0].nos)], "request long, position long, idx long")
    shown = V.answer_nodes(listed, catalogue, degrees).orderBy("position").collect()
    assert [(r.nome, r.rotulo) for r in shown] == [("N0", None), (None, "Sócio 2"), ("N2", None)] and shown[0].cnpj == "11.111.111/0001-91"
    exposed = V.answer_nodes(listed, catalogue, degrees, expose_people=True).where("position = 1").first()
    assert exposed.nome == "FULANO"
    asked = spark.createDataFrame([("11111111",), ("33333333",), ("66666666",), ("99999999",)], "cnpj string")
    firms = {r.cnpj: r for r in V.company_summary(asked, catalogue, exists, degrees, labels).collect()}
    assert set(firms) == {"11111111", "33333333", "99999999"} and (firms["33333333"].tem_vinculo, firms["33333333"].vinculos_no_recorte) == (False, 0)
    assert firms["11111111"].tamanho_do_componente_no_recorte == 4 and "conector" in firms["99999999"].explicacao
    assert V.health(nodes, adj, labels).first().coerente


def test_rate_limit(spark):
    rows = spark.sql("SELECT id, 'a' AS client, timestamp_seconds(120 + id) AS ts FROM range(3) UNION ALL SELECT 9, 'a', timestamp_seconds(181) UNION ALL SELECT 8, 'b', timestamp_seconds(121)")
    got = {r.id: (r.allowed, r.retry_after) for r in V.rate_limit(rows, 2).collect()}
    assert got == {0: (True, 60), 1: (True, 59), 2: (False, 58), 9: (True, 59), 8: (True, 59)}


def test_release(tmp_path):
    for name in ("a.parquet", "b.parquet"):
        (tmp_path / name).write_bytes(name.encode())
    one, two = tmp_path / "1.tar.gz", tmp_path / "2.tar.gz"
    for target in (one, two):
        R.pack(str(tmp_path), ["b.parquet", "a.parquet"], str(target), "2026-06")
    assert one.read_bytes() == two.read_bytes()
    R.verify(str(one), ["a.parquet", "b.parquet"], "2026-06")
    with pytest.raises(E.ReleaseMismatch):
        R.verify(str(one), ["a.parquet"], "2026-06")
    with pytest.raises(E.ReleaseMismatch):
        R.verify(str(one), ["a.parquet", "b.parquet"], "2026-07")
