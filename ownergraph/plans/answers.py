"""Further registered queries: typing of whole tables, catalogue, artefacts, sinks, and the answers built on them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.functions import decoding as D
from ownergraph.operators import artefacts as A
from ownergraph.operators import components as C
from ownergraph.operators import graph as G
from ownergraph.operators import metrics as M
from ownergraph.operators import service as V
from ownergraph.operators import silver as S
from ownergraph.plans.catalogue import _C, _HOPS, _IDENT, _components, _graph, _graph_of, _whole_graph, query
from ownergraph.session import materialise, shared_dir
from ownergraph.sources import archives, sinks

PERIOD = "2026-06"

# ---------------------------------------------------------------- typing


def _companies(t) -> tuple[DataFrame, DataFrame]:
    """Customers as raw company records, every tenth with a poorer copy, and a slice of all of them."""
    k = F.col("c_custkey")
    cents = F.expr("cast(round(abs(c_acctbal) * 100) as bigint)")
    capital = F.concat((F.expr("cast(round(abs(c_acctbal) * 100) as bigint) div 100")).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    whole = t.customer.select(
        F.lpad(k.cast("string"), 8, "0").alias("cnpj_basico"), F.concat("c_mktsegment", F.when(k % 5 == 0, " 11144477735").otherwise("")).alias("razao_social"),
        F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("natureza_juridica"), F.lpad((k % 60).cast("string"), 2, "0").alias("qualificacao_do_responsavel"),
        F.when(k % 13 != 0, capital).alias("capital_social"), F.element_at(F.array(*map(F.lit, ("00", "01", "03", "05", "09", ""))), (k % 6 + 1).cast("int")).alias("porte"),
        F.lit(None).cast("string").alias("ente_federativo_responsavel"),
    )
    poorer = whole.where("cast(cnpj_basico as int) % 10 = 0").withColumns({"razao_social": F.lit(None).cast("string"), "capital_social": F.lit(None).cast("string")})
    return whole.unionByName(poorer), whole.select("cnpj_basico")


def _legend(t, digits: int, where: str) -> DataFrame:
    return t.nation.where(where).select(F.lpad(F.col("n_nationkey").cast("string"), digits, "0").alias("codigo"), F.col("n_name").alias("descricao"))


_TYPED = """raw AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS cnpj_basico, c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN ' [NUMERO SUPRIMIDO]' ELSE '' END AS razao_social,
  c_nationkey AS n, c_custkey % 60 AS q, CASE WHEN c_custkey % 13 <> 0 THEN CAST(round(abs(c_acctbal) * 100) AS BIGINT) END AS cents, c_custkey % 6 AS p FROM customer)"""


@query(f"""WITH {_TYPED} SELECT cnpj_basico, razao_social, lpad(CAST(n AS VARCHAR), 4, '0') AS natureza_juridica, a.n_name AS natureza_juridica_descricao,
b.n_name AS qualificacao_do_responsavel_descricao, cents / 100.0::DOUBLE AS capital_social,
CASE p WHEN 0 THEN 'Não informado' WHEN 1 THEN 'Micro empresa' WHEN 2 THEN 'Empresa de pequeno porte' WHEN 3 THEN 'Demais' WHEN 5 THEN 'Não informado' END AS porte_descricao
FROM raw LEFT JOIN nation a ON a.n_nationkey = n AND a.n_nationkey <> 3 LEFT JOIN nation b ON b.n_nationkey = q AND b.n_nationkey < 20""")
def type_companies(t):
    companies, the_slice = _companies(t)
    typed = S.type_companies(companies, the_slice, _legend(t, 4, "n_nationkey <> 3"), _legend(t, 2, "n_nationkey < 20"))[0]
    return typed.select(
        "cnpj_basico", "razao_social", "natureza_juridica", "natureza_juridica_descricao", "qualificacao_do_responsavel_descricao", F.col("capital_social").cast("double").alias("capital_social"), "porte_descricao"
    )


@query(f"""WITH {_TYPED} SELECT count(*) AS empresas, count(*) FILTER (WHERE k % 10 = 0) AS cnpj_repetidos, count(*) FILTER (WHERE k % 5 = 0) AS nomes_suprimidos,
count(*) FILTER (WHERE cents IS NULL) AS capital_ausente, count(*) FILTER (WHERE n = 3) AS natureza_sem_descricao, count(*) FILTER (WHERE q >= 20) AS qualificacao_sem_descricao,
count(*) FILTER (WHERE p = 4) AS porte_sem_descricao FROM raw""")
def type_companies_counters(t):
    companies, the_slice = _companies(t)
    return S.type_companies(companies, the_slice, _legend(t, 4, "n_nationkey <> 3"), _legend(t, 2, "n_nationkey < 20"))[1]


def _links(t) -> tuple[DataFrame, DataFrame]:
    """Orders as raw partner records, and a slice of two thirds of the customers."""
    k = F.col("o_orderkey")
    rows = t.orders.select(
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("cnpj_basico"), (k % 4).cast("string").alias("identificador_socio"), F.concat(F.lit("SOCIO "), k.cast("string"), F.when(k % 6 == 0, " 11144477735").otherwise("")).alias("nome_socio_ou_razao_social"),
        F.lit("***444777**").alias("cnpj_cpf_socio"), F.lpad((k % 30).cast("string"), 2, "0").alias("qualificacao_socio"),
        F.when(k % 9 == 0, "18991231").when(k % 9 == 1, "2015031").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("data_entrada_sociedade"),
        F.when(k % 3 == 0, F.lpad((k % 40).cast("string"), 3, "0")).alias("pais"), F.when(k % 2 == 0, D.PLACEHOLDER).otherwise("***123456**").alias("representante_legal"),
        F.when(k % 2 == 0, " ").otherwise("FULANA").alias("nome_representante"), F.lpad((k % 26).cast("string"), 2, "0").alias("qualificacao_representante_legal"), (k % 11).cast("string").alias("faixa_etaria"),
    )
    return rows, t.customer.where("c_custkey % 3 > 0").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("cnpj_basico"))


_PARTNER_ROWS = """inside AS (SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderkey % 9 > 1 THEN CAST(o_orderdate AS DATE) END AS d FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)),
typed AS (SELECT *, CASE WHEN k % 3 = 0 THEN k % 40 END AS p FROM inside)"""


@query(f"""WITH {_PARTNER_ROWS} SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS cnpj_basico, 'SOCIO ' || k || CASE WHEN k % 6 = 0 THEN ' [NUMERO SUPRIMIDO]' ELSE '' END AS nome,
CASE k % 4 WHEN 1 THEN 'Pessoa jurídica' WHEN 2 THEN 'Pessoa física' WHEN 3 THEN 'Estrangeiro' END AS tipo, a.n_name AS qualificacao, strftime(d, '%Y-%m-%d') AS entrada, b.n_name AS pais,
CASE WHEN k % 2 = 1 THEN '***123456**' END AS representante, CASE WHEN k % 2 = 1 THEN 'FULANA' END AS nome_representante, c.n_name AS qualificacao_representante,
CASE WHEN k % 11 = 10 THEN NULL WHEN k % 11 = 0 THEN 'Não se aplica' WHEN k % 11 = 1 THEN '0 a 12 anos' WHEN k % 11 = 9 THEN 'Acima de 80 anos' WHEN k % 11 = 2 THEN '13 a 20 anos' ELSE (k % 11 * 10 - 9) || ' a ' || (k % 11 * 10) || ' anos' END AS faixa
FROM typed LEFT JOIN nation a ON a.n_nationkey = k % 30 LEFT JOIN nation b ON b.n_nationkey = p LEFT JOIN nation c ON c.n_nationkey = k % 26""")
def type_partners(t):
    partners, the_slice = _links(t)
    typed = S.type_partners(partners, the_slice, _legend(t, 2, "true"), _legend(t, 3, "true"), PERIOD)[0]
    return typed.select(
        "cnpj_basico", F.col("nome_socio_ou_razao_social").alias("nome"), F.col("identificador_socio_descricao").alias("tipo"), F.col("qualificacao_socio_descricao").alias("qualificacao"),
        F.col("data_entrada_sociedade").cast("string").alias("entrada"), F.col("pais_descricao").alias("pais"), F.col("representante_legal").alias("representante"), "nome_representante",
        F.col("qualificacao_representante_legal_descricao").alias("qualificacao_representante"), F.col("faixa_etaria_descricao").alias("faixa"),
    )


@query(f"""WITH {_PARTNER_ROWS} SELECT count(*) AS vinculos, count(*) FILTER (WHERE k % 6 = 0) AS nomes_suprimidos, count(*) FILTER (WHERE k % 2 = 0) AS representantes_sem_documento,
count(*) FILTER (WHERE d IS NULL) AS datas_invalidas, count(*) FILTER (WHERE k % 30 > 24) AS qualificacao_socio_sem_descricao, count(*) FILTER (WHERE k % 26 > 24) AS qualificacao_representante_sem_descricao,
count(*) FILTER (WHERE p > 24) AS pais_sem_descricao, count(*) FILTER (WHERE p IS NULL) AS pais_ausente FROM typed""")
def type_partners_counters(t):
    partners, the_slice = _links(t)
    return S.type_partners(partners, the_slice, _legend(t, 2, "true"), _legend(t, 3, "true"), PERIOD)[1]


# ---------------------------------------------------------------- sinks and scans


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS arquivos_fora_de_ordem FROM orders")
def sorted_sink(t):
    target = f"{shared_dir(t.spark)}/sorted-{uuid.uuid4().hex}"
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    for _ in range(2):  # the second run takes the first one's place
        sinks.write_sorted(rows, target, ["o_custkey", "o_orderkey"])
    back = t.spark.read.parquet(target)
    return back.agg(F.count("*").alias("n")).crossJoin(sinks.in_order(back, ["o_custkey", "o_orderkey"]).agg(F.count("*").alias("arquivos_fora_de_ordem")))  # one row each


@query("SELECT count(*) AS n, count(*) AS places, count(*) - 1 AS last FROM orders")
def numbered_scan(t):
    return sinks.numbered_rows(t.orders.select("o_orderkey", "_metadata")).agg(
        F.count("*").alias("n"), F.count_distinct("file", "file_row").alias("places"), F.max("file_row").alias("last")
    )


@query("""SELECT a.o_orderkey, b.c_name FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) a
JOIN (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) b USING (p)""")
def positional_join(t):
    left = G.dense_index(t.orders.select("o_orderkey"), "o_orderkey", "position")
    right = G.dense_index(t.customer.select("c_custkey", "c_name"), "c_custkey", "position")
    return sinks.by_position(left, right).select("o_orderkey", "c_name")


@query("SELECT doc_id AS idx, text AS nome FROM documents")
def name_blocks_roundtrip(t):
    names = t.documents.select(F.col("doc_id").alias("idx"), F.col("text").alias("nome"))
    return sinks.read_names(materialise(sinks.name_blocks(names), "names"))


# ---------------------------------------------------------------- catalogue, artefacts, answers


def _told(t) -> DataFrame:
    """Customers as nodes of all kinds."""
    k = F.col("c_custkey")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    confidence = pick(4, "exata", "estimada", "fraca", "nao_fundivel")
    region = (F.col("c_nationkey") % 10).cast("string")
    return t.customer.select(
        k.alias("idx"), F.lpad(k.cast("string"), 8, "0").alias("cnpj_basico"), pick(3, "pessoa_juridica", "pessoa_fisica", "estrangeiro").alias("tipo"), F.col("c_name").alias("nome"),
        confidence.alias("confianca"), pick(3, True, False, None).alias("no_recorte"), region.alias("regiao_fiscal"), F.when(confidence == "estimada", region.cast("double") / 8).alias("taxa_de_colisao"),
    )


@query("""SELECT c_custkey AS idx, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS cnpj, ['pessoa_juridica', 'pessoa_fisica', 'estrangeiro'][c_custkey % 3 + 1] AS tipo, c_name AS nome,
['exata', 'estimada', 'fraca', 'nao_fundivel'][c_custkey % 4 + 1] AS confianca, CAST([true, false, NULL][c_custkey % 3 + 1] AS VARCHAR) AS no_recorte, CAST(c_nationkey % 10 AS VARCHAR) AS regiao_fiscal,
CASE WHEN c_custkey % 4 = 1 THEN (c_nationkey % 10) / 8.0 END::DOUBLE AS taxa_de_colisao FROM customer""")
def catalogue_lookup(t):
    nodes = _told(t)
    rates = A.region_rates(nodes)
    A.check_rates(nodes, rates)
    found = A.look_up(nodes.select("idx"), materialise(A.catalogue(nodes), "catalogue"), nodes.select("idx", "nome"), rates)
    return found.withColumn("no_recorte", F.col("no_recorte").cast("string"))


@query("SELECT DISTINCT CAST(c_nationkey % 10 AS VARCHAR) AS regiao_fiscal, ((c_nationkey % 10) / 8.0)::DOUBLE AS taxa_de_colisao FROM customer WHERE c_custkey % 4 = 1")
def region_rates(t):
    return A.region_rates(_told(t))


def _opened(t) -> tuple[dict[str, DataFrame], str]:
    """The artefacts of the registry-like graph, written and opened again."""
    nodes, links = _whole_graph(t)
    labels = C.canonical_components(nodes, G.adjacency(links))
    exists = G.existence(t.nation.select(F.lpad(F.col("n_nationkey").cast("string"), 8, "0").alias("cnpj_basico")))
    folder = f"{shared_dir(t.spark)}/artefacts-{uuid.uuid4().hex}"
    A.write_artefacts(nodes, links, labels, exists, folder, PERIOD)
    return A.open_artefacts(t.spark, folder, PERIOD), folder


_SHAPE = f"""WITH {_IDENT}, own AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS base FROM nation),
ends AS (SELECT substr(sha256('pessoa_juridica|' || cnpj_basico), 1, 16) AS a, identificador AS b FROM keyed),
all_nodes AS (SELECT a AS x FROM ends UNION SELECT b FROM ends), pairs AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ends WHERE a <> b)"""


@query(f"""{_SHAPE} SELECT (SELECT count(*) FROM all_nodes) AS nos, (SELECT 2 * count(*) FROM pairs) AS posicoes, (SELECT count(*) FROM own) AS existentes""")
def artefact_sizes(t):
    found, _ = _opened(t)
    return (
        found["catalogo"].agg(F.count("*").alias("nos")).crossJoin(found["adjacencia"].agg(F.count("*").alias("posicoes"))).crossJoin(found["existencia"].agg(F.count("*").alias("existentes")))
    )  # one row each


@query(f"""{_SHAPE} SELECT '0.2.0' AS versao, '{PERIOD}' AS competencia, (SELECT count(*) FROM all_nodes) AS nos, (SELECT count(*) FROM pairs) AS arestas, true AS coerente,
(SELECT count(*) FROM own) AS empresas_no_recorte, true AS tem_somas""")
def health_report(t):
    found, folder = _opened(t)
    sums = archives.inventory(t.spark, folder, A.PUBLISHED)
    told = V.health(found["catalogo"], found["adjacencia"], found["componentes"], found["existencia"], PERIOD, sums)
    return told.select("versao", "competencia", "nos", "arestas", "coerente", "empresas_no_recorte", (F.size("artefatos") >= len(A.PUBLISHED)).alias("tem_somas"))


def _near(t):
    """Neighbourhood answers of the ids divisible by 50 in the giant graph."""
    _, adj, nodes = _graph_of(t, True)
    company = F.col("idx") % 2 == 0
    shown = nodes.select(
        "idx", F.when(company, "pessoa_juridica").otherwise("pessoa_fisica").alias("tipo"), F.concat(F.lit("n"), F.col("idx").cast("string")).alias("nome"),
        F.when(company, F.expr("idx div 2") % 100000000).alias("cnpj_basico"), F.lit("8").alias("regiao_fiscal"), F.lit("exata").alias("confianca"),
        F.lit(None).cast("double").alias("taxa_de_colisao"), F.lit(True).alias("no_recorte"),
    )
    catalogue = nodes.select(F.col("idx").alias("cnpj"), "idx")
    asked = nodes.where("idx % 50 = 0").select(F.col("idx").alias("request"), F.col("idx").alias("cnpj"))
    return V.neighbourhood_answers(asked, catalogue, catalogue.select("cnpj"), shown, adj, 2, 1000)


_PLACED = f"WITH {_graph(_C)}, {_HOPS}, placed AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY depth, idx) - 1 AS position FROM members)"


@query(f"""{_PLACED}, s AS (SELECT origin, count(*) AS n, max(depth) AS d FROM members GROUP BY 1)
SELECT origin AS request, d AS saltos, false AS truncada, CASE n WHEN 1 THEN '1 nó' ELSE n || ' nós' END || ', ' || CASE d WHEN 0 THEN 'só a própria empresa' WHEN 1 THEN 'até 1 salto' ELSE 'até 2 saltos' END || '; nada ficou fora.' AS explicacao FROM s""")
def neighbourhood_answer_heads(t):
    return _near(t)[0].select("request", "saltos", "truncada", "explicacao")


@query(f"""{_PLACED}, d AS (SELECT src, count(*) AS degree FROM adj GROUP BY 1)
SELECT origin AS request, position, depth AS profundidade, degree AS vinculos_no_recorte, CASE WHEN idx % 2 = 0 THEN 'n' || idx END AS nome, CASE WHEN idx % 2 = 1 THEN 'Sócio ' || (position + 1) END AS rotulo
FROM placed JOIN d ON src = idx""")
def neighbourhood_answer_nodes(t):
    return _near(t)[1].select("request", "position", "profundidade", "vinculos_no_recorte", "nome", "rotulo")


@query(f"""{_PLACED} SELECT m.origin AS request, least(m.position, n.position) AS de, greatest(m.position, n.position) AS para
FROM placed m JOIN adj ON src = m.idx AND src < dst JOIN placed n ON n.origin = m.origin AND n.idx = dst""")
def neighbourhood_answer_edges(t):
    return _near(t)[2]


@query("SELECT c_custkey, replace(replace(replace(format('{:,.2f}', round(c_acctbal, 2)), ',', '#'), '.', ','), '#', '.') AS valor FROM customer")
def decimal_text(t):
    return t.customer.select("c_custkey", D.decimal(F.col("c_acctbal")).alias("valor"))


@query(f"""WITH {_graph(_C)}, d AS (SELECT src AS idx, count(*) AS degree FROM adj GROUP BY 1)
SELECT 'grau' AS parte, degree AS valor, count(*) AS n FROM d GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'hub', idx, degree FROM d ORDER BY degree DESC, idx LIMIT 10)""")
def metrics_report(t):
    _, adj, nodes, labels = _components(t, True)
    return M.report(G.degrees(adj, nodes), labels).where("parte IN ('grau', 'hub')")


@query("SELECT o_orderkey AS idx FROM orders WHERE o_orderkey % 3 = 0")
def twin_positions(t):
    """Positions where two tables disagree, planted by a changed key."""
    a = t.orders.select("o_orderkey", F.col("o_custkey").alias("key"))
    b = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("o_custkey")).alias("key"))
    return A.twin_faults(a, b, "o_orderkey", "key").select(F.col("o_orderkey").alias("idx"))

