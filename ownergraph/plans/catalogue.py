"""The registered queries of the engine and their SQL.

Every query applies an operator to a whole table that is cut from the driver's (``slices``); the SQL says the same
in DuckDB's words.  Queries that SQL cannot express have none and are held against plain Python in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.functions import decoding as D
from ownergraph.functions import documents as N
from ownergraph.functions import identity as I
from ownergraph.operators import components as C
from ownergraph.operators import graph as G
from ownergraph.operators import identities as P
from ownergraph.operators import metrics as M
from ownergraph.operators import quality as Q
from ownergraph.operators import release as R
from ownergraph.operators import service as V
from ownergraph.operators import silver as S
from ownergraph.operators import traversal as T
from ownergraph.plans import slices as X
from ownergraph.session import materialise, shared_dir
from ownergraph.sources import archives, registry
from ownergraph.streaming import windows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the tables under its name, with its SQL."""

    def register(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(X.Tables(spark, sf_dir))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- common SQL

_DENSE = """SELECT CAST(s_nationkey AS BIGINT) AS no_empresa, CAST(c_nationkey AS BIGINT) AS no_socio, left(o_orderpriority, 1) AS qualificacao_socio
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""
_GIANT = "l_partkey * 51 + CAST(l_quantity AS BIGINT)"
_B, _C = (
    f"SELECT 2 * l_orderkey AS no_empresa, 2 * ({x}) + 1 AS no_socio, left(o_orderpriority, 1) AS qualificacao_socio FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    for x in (f"({_GIANT}) * 11 + CAST(round(l_discount * 100) AS BIGINT)", _GIANT)
)
_PAIRS = """SELECT least(no_empresa, no_socio) AS a, greatest(no_empresa, no_socio) AS b, min(CAST(qualificacao_socio AS SMALLINT)) AS role,
  count(DISTINCT qualificacao_socio) AS roles FROM links WHERE no_empresa <> no_socio GROUP BY 1, 2"""
_ADJ = "SELECT a AS src, b AS dst, role FROM pairs UNION ALL SELECT b, a, role FROM pairs"


def _graph(links: str) -> str:
    return f"links AS ({links}), pairs AS ({_PAIRS}), adj AS ({_ADJ}), nodes AS (SELECT no_empresa AS idx FROM links UNION SELECT no_socio FROM links)"


_LABELS = """least_of(idx, m) USING KEY (idx) AS (SELECT idx, idx FROM nodes UNION
    SELECT e.src, min(c.m) FROM least_of c JOIN adj e ON e.dst = c.idx JOIN recurring.least_of o ON o.idx = e.src WHERE c.m < o.m GROUP BY e.src),
  sized AS (SELECT m, count(*) AS n FROM least_of GROUP BY m),
  numbered AS (SELECT m, n, row_number() OVER (ORDER BY n DESC, m) - 1 AS component FROM sized)"""


def _graph_of(t: X.Tables, giant: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, adjacency and nodes of a sparse graph, the first as a table of its own."""
    links = materialise(X.sparse_links(t, giant), "links")
    return links, G.adjacency(links), X.linked_nodes(links)


def _components(t: X.Tables, giant: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    links, adj, nodes = _graph_of(t, giant)
    return links, adj, nodes, materialise(C.canonical_components(nodes, adj), "components")


# ---------------------------------------------------------------- slices, keys, joins

_EST = """SELECT CAST(l_orderkey AS VARCHAR) AS cnpj_basico, lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS ordem, lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') AS dv,
  lpad(CAST(l_partkey % 9 AS VARCHAR), 2, '0') AS sit, l_returnflag = 'A' AS matriz, CASE WHEN l_partkey % 3 = 0 THEN 'SP' ELSE 'RJ' END AS uf FROM lineitem"""


@query(f"SELECT cnpj_basico, arg_min(sit, (ordem, dv, sit)) AS situacao_cadastral, min(uf) AS uf FROM ({_EST}) WHERE matriz AND uf = 'SP' GROUP BY cnpj_basico")
def slice_head_office(t):
    return S.slice_by_state(X.establishments(t), "SP")[0]


@query(f"""WITH g AS (SELECT cnpj_basico, count(*) AS n FROM ({_EST}) WHERE matriz AND uf = 'SP' GROUP BY 1)
SELECT count(*) AS empresas, count(*) FILTER (WHERE n > 1) AS repetidas FROM g""")
def slice_counters(t):
    return S.slice_by_state(X.establishments(t), "SP")[1]


@query("""SELECT l_orderkey || '-' || l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, k LIMIT 5""")
def dup_key_sample(t):
    return registry.duplicate_keys(t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k")), "k")


@query("""WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS k, CASE WHEN l_quantity > 25 THEN ' ' ELSE CAST(l_suppkey AS VARCHAR) END AS c1,
  CASE WHEN l_tax <= 0.04 THEN CAST(l_partkey AS VARCHAR) END AS c2, l_returnflag AS c3 FROM lineitem),
f AS (SELECT *, (trim(c1) <> '')::INT + (c2 IS NOT NULL)::INT + 1 AS full_fields, count(*) OVER (PARTITION BY k) AS copies FROM r)
SELECT k, c1, c2, c3, copies FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY full_fields DESC, c1 NULLS LAST, c2 NULLS LAST, c3 NULLS LAST) = 1""")
def dedup_most_complete(t):
    rows = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"),
        F.when(F.col("l_quantity") > 25, " ").otherwise(F.col("l_suppkey").cast("string")).alias("c1"),
        F.when(F.col("l_tax") <= 0.04, F.col("l_partkey").cast("string")).alias("c2"),
        F.col("l_returnflag").alias("c3"),
    )
    return S.most_complete(rows, "k", ["c1", "c2", "c3"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_slice(t):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_missing(t):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_suppkey FROM lineitem)""")
def semi_join_union_keys(t):
    keys = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).union(t.lineitem.select("l_suppkey")).distinct()
    return t.customer.select("c_custkey", "c_name").join(keys, "c_custkey", "left_semi")


_LEGEND = "legend AS (SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3)"


@query(f"""WITH {_LEGEND} SELECT n_nationkey, a.r_name AS papel, b.r_name AS outro_papel FROM nation
LEFT JOIN legend a ON n_regionkey = a.r_regionkey LEFT JOIN legend b ON n_nationkey % 7 = b.r_regionkey""")
def decode_left_join(t):
    legend = t.region.where("r_regionkey < 3")
    one = F.broadcast(legend.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("papel")))
    two = F.broadcast(legend.select(F.col("r_regionkey").alias("__other"), F.col("r_name").alias("outro_papel")))
    nations = t.nation.select("n_nationkey", "n_regionkey", (F.col("n_nationkey") % 7).alias("__other"))
    return nations.join(one, "n_regionkey", "left").join(two, "__other", "left").select("n_nationkey", "papel", "outro_papel")


@query(f"""WITH {_LEGEND}, c AS (SELECT CASE WHEN n_nationkey % 5 > 0 THEN n_regionkey END AS code FROM nation)
SELECT count(*) FILTER (WHERE code IS NULL OR code NOT IN (SELECT r_regionkey FROM legend)) AS com_nulos,
       count(*) FILTER (WHERE code NOT IN (SELECT r_regionkey FROM legend)) AS preenchidos FROM c""")
def undecoded_counts(t):
    legend = t.region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("code"))
    codes = t.nation.select(F.when(F.col("n_nationkey") % 5 > 0, F.col("n_regionkey")).alias("code"))
    missing = codes.join(F.broadcast(legend), "code", "left_anti")
    return missing.agg(F.count("*").alias("com_nulos"), F.count("code").alias("preenchidos"))


def _case(code: str, legend: dict[str, str]) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in legend.items()) + " END"


@query(f"""SELECT c_custkey, {_case("CAST(c_custkey % 12 AS VARCHAR)", D.AGE_BANDS)} AS faixa, {_case("CAST(c_custkey % 5 AS VARCHAR)", D.PARTNER_TYPES)} AS tipo,
CASE WHEN c_custkey % 7 = 0 THEN 'Não informado' ELSE {_case("lpad(CAST(c_custkey % 7 AS VARCHAR), 2, '0')", D.SIZE_CLASSES)} END AS porte FROM customer""")
def decode_case_unknown_null(t):
    k = F.col("c_custkey")
    size = F.when(k % 7 == 0, " ").otherwise(F.lpad((k % 7).cast("string"), 2, "0"))
    return t.customer.select(
        "c_custkey", D.decode((k % 12).cast("string"), D.AGE_BANDS).alias("faixa"), D.decode((k % 5).cast("string"), D.PARTNER_TYPES).alias("tipo"), D.size_class(size).alias("porte")
    )


@query("""SELECT c_custkey, CAST(CASE WHEN c_custkey % 4 > 0 THEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) END AS VARCHAR) AS no_recorte FROM customer""")
def in_subquery_flag(t):
    inside = F.broadcast(t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("__in")))
    flag = F.when(F.col("c_custkey") % 4 > 0, F.coalesce("__in", F.lit(False)))
    return t.customer.join(inside, "c_nationkey", "left").select("c_custkey", flag.cast("string").alias("no_recorte"))


@query("""SELECT coalesce(p_partkey, 3 * c_custkey) AS k, p_name, c_name FROM part FULL JOIN customer ON p_partkey = 3 * c_custkey""")
def full_outer_universe(t):
    a, b = t.part.select(F.col("p_partkey").alias("k"), "p_name"), t.customer.select((F.col("c_custkey") * 3).alias("k"), "c_name")
    return a.join(b, "k", "full_outer").select("k", "p_name", "c_name")


@query("""SELECT n_regionkey AS valor, count(*) AS n FROM nation GROUP BY 1""")
def value_histogram(t):
    return M.histogram(t.nation.select(F.col("n_regionkey").alias("valor")), "valor")


# ---------------------------------------------------------------- scalar functions

_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 3 THEN {_CENTS} / 100.0 ELSE -1 END::DOUBLE AS capital FROM orders")
def decimal_comma_parse(t):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, rest = F.expr("cast(round(o_totalprice * 100) as bigint) div 100").cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    text = F.concat(whole, F.when(F.col("o_orderkey") % 10 == 3, ".").otherwise(","), rest)
    return t.orders.select("o_orderkey", F.coalesce(D.comma_decimal(text).cast("double"), F.lit(-1.0)).alias("capital"))


_RAW_DATE = "CASE o_orderkey % 6 WHEN 1 THEN left(d, 7) WHEN 2 THEN '00210823' WHEN 3 THEN '20261231' WHEN 4 THEN left(d, 4) || '1345' WHEN 5 THEN NULL ELSE d END"


@query(f"""SELECT o_orderkey, CASE WHEN regexp_matches(x, '^[0-9]{{8}}$') AND CAST(try_strptime(x, '%Y%m%d') AS DATE) BETWEEN DATE '1900-01-01' AND DATE '2026-06-30'
THEN strftime(try_strptime(x, '%Y%m%d'), '%Y-%m-%d') END AS entrada FROM (SELECT o_orderkey, {_RAW_DATE} AS x FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d FROM orders))""")
def guarded_date_parse(t):
    d, k = F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey") % 6
    raw = F.when(k == 1, F.substring(d, 1, 7)).when(k == 2, "00210823").when(k == 3, "20261231").when(k == 4, F.concat(F.substring(d, 1, 4), F.lit("1345"))).when(k != 5, d)
    return t.orders.select("o_orderkey", D.guarded_date(raw, D.last_day("2026-06")).cast("string").alias("entrada"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '***' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '**' END AS representante,
CASE WHEN c_custkey % 4 IN (0, 1) THEN NULL ELSE c_name END AS nome FROM customer""")
def blank_and_placeholder_null(t):
    k = F.col("c_custkey")
    mask = F.when(k % 3 == 0, D.PLACEHOLDER).otherwise(F.concat(F.lit("***"), F.lpad(k.cast("string"), 6, "0"), F.lit("**")))
    name = F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.lit(None).cast("string")).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", D.placeholder_to_null(mask).alias("representante"), D.blank_to_null(name).alias("nome"))


_DIGIT = "CAST(substr({0}, CAST(i AS INT), 1) AS INT)"


def _cpf(x: str) -> str:
    total = lambda n: f"list_sum(list_transform(range(1, {n + 1}), lambda i: {_DIGIT.format(x)} * ({n + 2} - i)))"
    return f"""(regexp_matches({x}, '^[0-9]{{11}}$') AND {x} <> repeat(left({x}, 1), 11)
  AND ({total(9)} * 10 % 11) % 10 = CAST(substr({x}, 10, 1) AS INT) AND ({total(10)} * 10 % 11) % 10 = CAST(substr({x}, 11, 1) AS INT))"""


@query(f"SELECT c_custkey, {_cpf('x')} AS valido FROM (SELECT c_custkey, lpad(CAST(c_custkey * 98765 AS VARCHAR), 11, '0') AS x FROM customer)")
def cpf_check_digit(t):
    return t.customer.select("c_custkey", N.cpf_valid(F.lpad((F.col("c_custkey") * 98765).cast("string"), 11, "0")).alias("valido"))


_TEXT = """SELECT doc_id, text || ' CPF ' || lpad(CAST(doc_id * 131071 % 1000000000 AS VARCHAR), 9, '0') || CASE doc_id % 3 WHEN 0 THEN '-' WHEN 1 THEN '.' ELSE ' ' END
  || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(doc_id * 7 AS VARCHAR), 9 + CAST(doc_id % 3 AS INT), '0') || ' 111444777-35 123456797 111.444.777-35' AS text FROM documents"""


def _suppressed() -> str:
    known = "text"
    for shape in N.KNOWN_SHAPES:
        known = f"regexp_replace({known}, '{shape}', '{N.MARK}', 'g')"
    drop = lambda source, found: f"list_reduce(list_prepend({source}, {found}), lambda a, x: replace(a, x, '{N.MARK}'))"
    return f"""known AS (SELECT doc_id, text, {known} AS k FROM given),
split AS (SELECT doc_id, text, {drop("k", f"list_filter(regexp_extract_all(k, '{N.SPLIT_CPF}'), lambda y: {_cpf('(substr(y, 1, 9) || substr(y, 11, 2))')})")} AS k FROM known),
short AS (SELECT doc_id, text, {drop("k", f"list_filter(regexp_extract_all(k, '[0-9]+'), lambda y: length(y) = 9 AND {_cpf('lpad(y, 11, chr(48))')})")} AS k FROM split)"""


def _marked_texts(t):
    k = F.col("doc_id")
    sep = F.when(k % 3 == 0, "-").when(k % 3 == 1, ".").otherwise(" ")
    tail = F.concat(
        F.lit(" CPF "), F.lpad((k * 131071 % 1000000000).cast("string"), 9, "0"), sep, F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" "),
        F.lpad((k * 7).cast("string"), (9 + k % 3).cast("int"), F.lit("0")), F.lit(" 111444777-35 123456797 111.444.777-35"),
    )
    return t.documents.select("doc_id", F.concat("text", tail).alias("text"))


@query(f"WITH given AS ({_TEXT}), {_suppressed()} SELECT doc_id, sha256(k) AS limpo FROM short")
def suppress_documents(t):
    return _marked_texts(t).select("doc_id", F.sha2(N.suppress_documents(F.col("text")), 256).alias("limpo"))


@query(f"WITH given AS ({_TEXT}), {_suppressed()} SELECT count(*) AS n, count(*) FILTER (WHERE k <> text) AS suprimidos FROM short")
def suppress_counts(t):
    return _marked_texts(t).agg(F.count("*").alias("n"), F.count_if(N.suppress_documents(F.col("text")) != F.col("text")).alias("suprimidos"))


def _normal(x: str) -> str:
    particles = ", ".join(f"'{p}'" for p in I.PARTICLES)
    return f"""nullif(array_to_string(list_filter(regexp_split_to_array(upper(regexp_replace(translate(coalesce({x}, ''), '{I.ACCENTED}', '{I.PLAIN}'), '[^\\x00-\\x7F]', '', 'g')),
  '[ \\t\\n\\x0B\\f\\r\\x1C-\\x1F]+'), lambda w: w <> '' AND w NOT IN ({particles})), ' '), '')"""


@query(f"SELECT doc_id, {_normal('text')} AS nome FROM documents")
def normalize_name(t):
    return t.documents.select("doc_id", I.normalise_name(F.col("text")).alias("nome"))


@query("SELECT c_custkey, substr(sha256('pessoa_juridica|' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')), 1, 16) AS identificador FROM customer")
def node_identifier(t):
    return t.customer.select("c_custkey", I.company_id(F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("identificador"))


_PARTNERS = """SELECT lpad(CAST(c_nationkey AS VARCHAR), 8, '0') AS cnpj_basico, CASE c_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' ELSE '2' END AS code,
  CASE WHEN c_custkey % 10 <> 0 THEN 'José da ' || c_mktsegment || ' ' || (c_custkey % 13) END AS origem,
  CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey % 60 AS VARCHAR), 8, '0') || '000100' WHEN 2 THEN NULL
    ELSE '***' || lpad(CAST(c_custkey % 97 * 7919 % 1000000 AS VARCHAR), 6, '0') || '**' END AS doc,
  lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') AS qualificacao_socio, CASE WHEN c_custkey % 3 = 0 THEN '249' END AS pais FROM customer"""
_IDENT = f"""partners AS ({_PARTNERS}), named AS (SELECT *, {_normal('origem')} AS nome FROM partners),
classed AS (SELECT *, CASE code WHEN '1' THEN 'pessoa_juridica' WHEN '2' THEN 'pessoa_fisica' ELSE 'estrangeiro' END AS tipo,
  CASE WHEN code = '1' THEN 'exata' WHEN code = '2' AND nome IS NOT NULL AND doc IS NOT NULL THEN 'estimada' WHEN code = '3' AND nome IS NOT NULL THEN 'fraca' ELSE 'nao_fundivel' END AS confianca
  FROM named),
keyed AS (SELECT *, substr(sha256(CASE confianca WHEN 'exata' THEN 'pessoa_juridica|' || left(doc, 8) WHEN 'estimada' THEN 'pessoa_fisica|' || nome || '|' || doc
  WHEN 'fraca' THEN 'estrangeiro|' || nome || '|' || coalesce(pais, '') ELSE 'nao_fundivel|' || cnpj_basico || '|' || coalesce(doc, '') || '|' || coalesce(nome, '') || '|' || coalesce(pais, '') END), 1, 16)
  AS identificador FROM classed),
inside AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS base FROM nation WHERE n_regionkey = 1),
people AS (SELECT DISTINCT substr(doc, 9, 1) AS regiao, nome, doc FROM keyed WHERE confianca = 'estimada'),
rates AS (SELECT regiao, n, s / (CAST(n AS DOUBLE) * n) AS colisao, p, CAST(p AS DOUBLE) * s / (CAST(n AS DOUBLE) * n) AS fusoes,
    CAST(p AS DOUBLE) * s / (CAST(n AS DOUBLE) * n * n) AS taxa
  FROM (SELECT regiao, sum(q) AS n, CAST(sum(q * q) AS DOUBLE) AS s FROM (SELECT regiao, doc, count(*) AS q FROM people GROUP BY 1, 2) GROUP BY 1)
  JOIN (SELECT regiao, sum(q * (q - 1) // 2) AS p FROM (SELECT regiao, nome, count(*) AS q FROM people GROUP BY 1, 2) GROUP BY 1) USING (regiao)),
identities AS (SELECT identificador, any_value(tipo) AS tipo, min(origem) AS nome, CASE WHEN any_value(tipo) = 'pessoa_juridica' THEN min(left(doc, 8)) END AS cnpj_basico,
  CASE WHEN any_value(tipo) = 'pessoa_fisica' THEN min(doc) END AS cpf_mascarado, CASE WHEN any_value(tipo) = 'estrangeiro' THEN min(pais) END AS pais,
  bool_or(CASE WHEN confianca = 'exata' THEN left(doc, 8) IN (SELECT base FROM inside) END) AS no_recorte, any_value(confianca) AS confianca,
  round(any_value(taxa), 12) AS taxa_de_colisao, count(*) AS vinculos_no_recorte
  FROM keyed LEFT JOIN rates ON rates.regiao = substr(doc, 9, 1) AND confianca = 'estimada' GROUP BY identificador)"""


def _identities(t):
    return P.identities(X.partners(t), X.slice_of_nations(t))


@query(f"WITH {_IDENT} SELECT * REPLACE (CAST(no_recorte AS VARCHAR) AS no_recorte, coalesce(taxa_de_colisao, -1) AS taxa_de_colisao) FROM identities")
def identity_classes(t):
    return _identities(t)[0].withColumns({"taxa_de_colisao": F.coalesce(F.round("taxa_de_colisao", 12), F.lit(-1.0)), "no_recorte": F.col("no_recorte").cast("string")})


@query(f"WITH {_IDENT} SELECT confianca, count(*) AS n FROM identities GROUP BY 1")
def identity_histogram(t):
    return M.histogram(_identities(t)[0], "confianca")


_PART_RATES = """people AS (SELECT DISTINCT right(p_brand, 1) AS regiao, p_name AS nome, p_type || p_size AS mascara FROM part),
a AS (SELECT regiao, sum(q) AS n, CAST(sum(q * q) AS DOUBLE) AS s FROM (SELECT regiao, mascara, count(*) AS q FROM people GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT regiao, sum(q * (q - 1) // 2) AS p FROM (SELECT regiao, nome, count(*) AS q FROM people GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {_PART_RATES} SELECT regiao, CAST(n AS BIGINT) AS identidades, round(s / (CAST(n AS DOUBLE) * n), 12) AS colisao, CAST(p AS BIGINT) AS pares,
round(p * s / (CAST(n AS DOUBLE) * n), 12) AS fusoes, round(p * s / (CAST(n AS DOUBLE) * n * n), 12) AS taxa_de_colisao FROM a JOIN b USING (regiao)""")
def collision_rate_by_region(t):
    people = t.part.select(F.substring("p_brand", -1, 1).alias("regiao"), F.col("p_name").alias("nome"), F.concat("p_type", F.col("p_size").cast("string")).alias("mascara"))
    rates = P.collision_rates(people)
    return rates.select("regiao", "identidades", "pares", *(F.round(c, 12).alias(c) for c in ("colisao", "fusoes", "taxa_de_colisao")))


@query("SELECT regiao, taxas FROM (SELECT right(p_brand, 1) AS regiao, count(DISTINCT p_size) AS taxas FROM part GROUP BY 1) WHERE taxas > 1")
def rate_function_of_region(t):
    return P.rate_is_function_of_region(t.part.select(F.substring("p_brand", -1, 1).alias("regiao"), F.col("p_size").alias("taxa_de_colisao")))


_BASE12 = "lpad(CAST(s_suppkey * 7919 % 100000000 AS VARCHAR), 8, '0') || '0001'"


def _check(x: str, weights: tuple[int, ...]) -> str:
    total = " + ".join(f"CAST(substr({x}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights))
    return f"CAST(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END AS VARCHAR)"


_CNPJ = f"""b AS (SELECT s_suppkey, {_BASE12} AS x FROM supplier), c AS (SELECT s_suppkey, x, {_check('x', N.CNPJ_WEIGHTS[0])} AS d1 FROM b),
d AS (SELECT s_suppkey, x, d1 || {_check('(x || d1)', N.CNPJ_WEIGHTS[1])} AS dv FROM c)"""


@query(f"""WITH {_CNPJ} SELECT s_suppkey, substr(x, 1, 2) || '.' || substr(x, 3, 3) || '.' || substr(x, 6, 3) || '/' || substr(x, 9, 4) || '-' || dv AS cnpj FROM d""")
def cnpj_format(t):
    return t.supplier.select("s_suppkey", N.cnpj_format(F.col("s_suppkey") * 7919 % 100000000).alias("cnpj"))


@query(f"""WITH {_CNPJ} SELECT s_suppkey, s_suppkey % 3 = 0 OR (s_suppkey % 3 = 1 AND dv = '00') AS valido,
CASE WHEN s_suppkey % 3 = 0 OR (s_suppkey % 3 = 1 AND dv = '00') THEN left(x, 8) END AS basico,
CASE WHEN s_suppkey % 3 = 2 THEN 'shape' WHEN s_suppkey % 3 = 1 AND dv <> '00' THEN 'verifier' END AS erro FROM d""")
def cnpj_validate(t):
    base = F.col("s_suppkey") * 7919 % 100000000
    good = N.cnpj_format(base)
    text = F.when(F.col("s_suppkey") % 3 == 0, good).when(F.col("s_suppkey") % 3 == 1, F.concat(F.substring(good, 1, 16), F.lit("00"))).otherwise(F.substring(good, 1, 15))
    return t.supplier.select("s_suppkey", N.cnpj_parse(text).alias("p")).select("s_suppkey", F.col("p.valid").alias("valido"), F.col("p.basico").alias("basico"), F.col("p.error").alias("erro"))


@query("""SELECT n_nationkey, n_nationkey % 3 + 4 * (n_regionkey % 4) + 16 * CASE n_nationkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS pacote, n_nationkey % 3 AS tipo,
n_regionkey % 4 AS confianca, CASE n_nationkey % 3 WHEN 1 THEN 'true' WHEN 2 THEN 'false' END AS no_recorte FROM nation""")
def attr_pack_roundtrip(t):
    k = F.col("n_nationkey") % 3
    packed = t.nation.select("n_nationkey", D.pack_attributes(k, F.col("n_regionkey") % 4, F.when(k == 1, True).when(k == 2, False)).alias("pacote"))
    return packed.withColumn("u", D.unpack_attributes(F.col("pacote"))).select(
        "n_nationkey", "pacote", F.col("u.kind").alias("tipo"), F.col("u.confidence").alias("confianca"), F.col("u.in_slice").cast("string").alias("no_recorte")
    )


@query(f"WITH {_IDENT} SELECT identificador, coalesce(round(taxa, 12), -1) AS taxa FROM identities LEFT JOIN rates ON confianca = 'estimada' AND substr(cpf_mascarado, 9, 1) = regiao")
def collision_lookup(t):
    found, rates = _identities(t)
    region = F.when(F.col("confianca") == I.ESTIMATED, I.fiscal_region(F.col("cpf_mascarado")))
    lookup = F.broadcast(rates.select(F.col("regiao").alias("__r"), F.round("taxa_de_colisao", 12).alias("taxa")))
    return found.withColumn("__r", region).join(lookup, "__r", "left").select("identificador", F.coalesce("taxa", F.lit(-1.0)).alias("taxa"))


@query("SELECT c_custkey, replace(format('{:,}', c_custkey * 7919), ',', '.') AS milhar FROM customer")
def thousands_separator(t):
    return t.customer.select("c_custkey", D.thousands(F.col("c_custkey") * 7919).alias("milhar"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (user_id % 250) ELSE '1.1.1.' || (event_id % 9) END AS cliente FROM events""")
def client_from_proxies(t):
    sent = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("9.9.9.9, 1.1.1."), (F.col("event_id") % 9).cast("string"), F.lit(" , 2.2.2.2")))
    return t.events.select("event_id", D.client_of(sent, F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")), 2).alias("cliente"))


# ---------------------------------------------------------------- quality


def _flawed(t) -> Q.Tables:
    """Silver tables from customers, with some defects of every kind."""
    k = F.col("c_custkey")
    base = F.lpad(k.cast("string"), 8, "0")
    status = F.when(k % 400 != 0, "02")
    the_slice = t.customer.select(base.alias("cnpj_basico"), status.alias("situacao_cadastral"), F.lit("SP").alias("uf"))
    name = F.when(k % 300 == 0, "FULANO 11144477735").otherwise(F.col("c_name"))
    companies = t.customer.select(base.alias("cnpj_basico"), F.translate(F.col("c_name"), "0123456789", "").alias("razao_social"), (F.col("c_acctbal").cast("decimal(18,2)")).alias("capital_social"))
    mask = F.when(k % 250 == 0, "11144477735").otherwise(F.concat(F.lit("***"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit("**")))
    socios = t.customer.select(
        F.when(k % 200 == 0, "99999999").otherwise(base).alias("cnpj_basico"), F.lit("2").alias("identificador_socio"),
        F.when(k % 300 == 0, name).otherwise("JOAO DA SILVA").alias("nome_socio_ou_razao_social"), mask.alias("cnpj_cpf_socio"),
        F.lit("49").alias("qualificacao_socio"), F.lit(None).cast("string").alias("pais"), F.when(k % 350 == 0, F.lit("1899-12-31").cast("date")).alias("data_entrada_sociedade"),
    )
    identities = t.customer.where("c_custkey % 7 <> 0").select(
        I.node_id(F.lit("pessoa_fisica"), F.when(k % 300 == 0, "FULANO 11144477735").otherwise("JOAO SILVA"), mask).alias("identificador"), F.lit("pessoa_fisica").alias("tipo"), F.lit("estimada").alias("confianca"),
        F.when(k % 150 == 0, 0).otherwise(1).cast("long").alias("vinculos_no_recorte"), F.lit(0.5).alias("taxa_de_colisao"),
    )
    return {"recorte": the_slice, "empresas": companies, "socios": socios, "identidades": identities.unionByName(identities.where("vinculos_no_recorte = 0"))}


@query("""WITH k AS (SELECT c_custkey AS k, c_acctbal FROM customer), i AS (SELECT k FROM k WHERE k % 7 <> 0 UNION ALL SELECT k FROM k WHERE k % 7 <> 0 AND k % 150 = 0),
p AS (SELECT k, CASE WHEN k % 300 = 0 THEN 'F' ELSE 'J' END || CASE WHEN k % 250 = 0 THEN 'x' ELSE CAST(k % 1000000 AS VARCHAR) END AS quem FROM k),
f AS (
 SELECT 'sem_nulo_no_obrigatorio' AS regra, 'recorte.situacao_cadastral' AS detalhe, count(*) AS n FROM k WHERE k % 400 = 0
 UNION ALL SELECT 'documento_foi_suprimido', 'socios.nome_socio_ou_razao_social', count(*) FROM k WHERE k % 300 = 0
 UNION ALL SELECT 'coluna_estruturada_tem_a_forma_declarada', 'socios.cnpj_cpf_socio', count(*) FROM k WHERE k % 250 = 0
 UNION ALL SELECT 'faixas_plausiveis', 'empresas.capital_social', count(*) FROM k WHERE CAST(c_acctbal AS DECIMAL(18, 2)) < 0
 UNION ALL SELECT 'faixas_plausiveis', 'identidades.vinculos_no_recorte', count(*) FROM i WHERE k % 150 = 0
 UNION ALL SELECT 'faixas_plausiveis', 'socios.data_entrada_sociedade', count(*) FROM k WHERE k % 350 = 0
 UNION ALL SELECT 'chave_unica', 'identidades.identificador', count(*) FROM (SELECT quem FROM i JOIN p USING (k) GROUP BY quem HAVING count(*) > 1)
 UNION ALL SELECT 'cadeia_de_conservacao', 'socios e identidades', abs((SELECT count(*) FROM k) - (SELECT count(*) FROM i WHERE k % 150 <> 0))
 UNION ALL SELECT 'integridade_referencial', 'vinculo_sem_empresa', count(*) FROM k WHERE k % 200 = 0
 UNION ALL SELECT 'integridade_referencial', 'vinculo_sem_identidade', count(DISTINCT quem) FROM p WHERE quem NOT IN (SELECT quem FROM i JOIN p USING (k)))
SELECT * FROM f WHERE n > 0""")
def quality_findings(t):
    return Q.findings(_flawed(t))


@query("SELECT CAST(0 AS BIGINT) AS n")
def quality_forms_reject_docs(t):
    return Q.forms_reject_documents(t.spark).agg(F.count("*").alias("n"))


@query(f"""WITH {_IDENT} SELECT count(DISTINCT identificador) AS n FROM keyed WHERE confianca = 'fraca'""")
def quality_unknown_identities(t):
    partners = X.partners(t)
    kept = _identities(t)[0].where("confianca <> 'fraca'")
    found = P.identified_partners(partners).select("identificador").distinct().join(kept, "identificador", "left_anti")
    return found.agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- graph


@query("SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS idx FROM customer")
def dense_index(t):
    return G.dense_index(t.customer.select("c_name"), "c_name")


@query("SELECT count(*) AS n, count(*) AS distinct_n, CAST(0 AS BIGINT) AS least, count(*) - 1 AS most, CAST(0 AS BIGINT) AS unordered FROM customer")
def dense_index_check(t):
    return G.index_faults(G.dense_index(t.customer.select("c_name"), "c_name"), "idx", "c_name").withColumn("least", F.col("least").cast("long"))


@query("""WITH k AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN c_custkey + 1 ELSE c_custkey END AS idx, CASE WHEN c_custkey % 7 = 0 THEN -c_custkey ELSE c_custkey END AS chave FROM customer)
SELECT (SELECT count(*) FROM k) AS n, (SELECT count(DISTINCT idx) FROM k) AS distinct_n, (SELECT min(idx) FROM k) AS least, (SELECT max(idx) FROM k) AS most,
  (SELECT count(*) FROM k a JOIN k b ON b.idx = a.idx + 1 WHERE a.chave >= b.chave) AS unordered""")
def dense_index_broken(t):
    k = F.col("c_custkey")
    broken = t.customer.select(F.when(k % 11 == 0, k + 1).otherwise(k).alias("idx"), F.when(k % 7 == 0, -k).otherwise(k).alias("chave"))
    return G.index_faults(broken, "idx", "chave")


@query(f"SELECT no_empresa, no_socio, qualificacao_socio, count(*) AS n FROM ({_DENSE}) GROUP BY 1, 2, 3")
def edges_with_roles(t):
    return X.dense_links(t).groupBy("no_empresa", "no_socio", "qualificacao_socio").agg(F.count("*").alias("n"))


@query(f"""WITH links AS ({_DENSE}), p AS (SELECT no_empresa, no_socio, count(*) AS n, count(DISTINCT qualificacao_socio) AS r FROM links GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS vinculos, CAST(coalesce(sum(n) FILTER (WHERE no_empresa = no_socio), 0) AS BIGINT) AS lacos, count(*) AS pares,
count(*) FILTER (WHERE n > 1) AS pares_paralelos, count(*) FILTER (WHERE r > 1) AS pares_divergentes FROM p""")
def edge_counters(t):
    return G.edge_counters(X.dense_links(t))


@query(f"""WITH links AS ({_DENSE}), known AS (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)
SELECT count(*) FILTER (WHERE no_empresa NOT IN (SELECT n_nationkey FROM known)) AS empresas, count(*) FILTER (WHERE no_socio NOT IN (SELECT n_nationkey FROM known)) AS socios FROM links""")
def edge_endpoint_guard(t):
    known = t.nation.where("n_regionkey < 4").select(F.col("n_nationkey").cast("long").alias("k"))
    links = X.dense_links(t)
    a, b = (F.broadcast(known.select(F.col("k").alias(c), F.col("k").alias(f"ok_{c}"))) for c in ("no_empresa", "no_socio"))
    joined = links.join(a, "no_empresa", "left").join(b, "no_socio", "left")
    return G.endpoint_faults(joined.select(F.col("ok_no_empresa").alias("no_empresa"), F.col("ok_no_socio").alias("no_socio")))


@query(f"SELECT (SELECT count(*) FROM lineitem) AS vinculos, (SELECT count(*) FROM ({_DENSE})) AS arestas")
def edge_conservation(t):
    return t.lineitem.agg(F.count("*").alias("vinculos")).crossJoin(X.dense_links(t).agg(F.count("*").alias("arestas")))


@query(f"WITH links AS ({_DENSE}) {_PAIRS}")
def csr_collapse(t):
    return G.collapse(X.dense_links(t))


@query(f"""WITH {_graph(_DENSE)}, o AS (SELECT DISTINCT no_empresa, no_socio FROM links WHERE no_empresa <> no_socio)
SELECT (SELECT count(*) FROM links WHERE no_empresa = no_socio) AS lacos, count(*) AS arestas, count(*) FILTER (WHERE roles > 1) AS pares_divergentes,
(SELECT count(*) FROM o) - count(*) AS pares_mutuos FROM pairs""")
def csr_counters(t):
    return G.collapse_counters(X.dense_links(t))


@query(f"WITH {_graph(_B)} SELECT src, dst, role, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos FROM adj")
def csr_adjacency(t):
    lists = G.neighbour_lists(_graph_of(t)[1])
    return lists.select("src", F.posexplode("neighbours").alias("pos", "x")).select("src", F.col("x.dst").alias("dst"), F.col("x.role").alias("role"), F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {_graph(_B)}, d AS (SELECT idx, count(src) AS degree FROM nodes LEFT JOIN adj ON src = idx GROUP BY 1)
SELECT idx, CAST(coalesce(sum(degree) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM d""")
def csr_indptr(t):
    _, adj, nodes = _graph_of(t)
    return G.offsets(G.degrees(adj, nodes))


@query(f"WITH {_graph(_DENSE)}, cut AS (SELECT * FROM adj WHERE NOT (src < dst AND (src + dst) % 5 = 0)) SELECT c.* FROM cut c LEFT JOIN cut d ON c.src = d.dst AND c.dst = d.src AND c.role = d.role WHERE d.src IS NULL")
def symmetry_violations(t):
    return G.symmetry_faults(G.adjacency(X.dense_links(t)).where("NOT (src < dst AND (src + dst) % 5 = 0)"))


@query(f"WITH RECURSIVE {_graph(_B)}, {_LABELS} SELECT idx, component FROM least_of JOIN numbered USING (m)")
def connected_components(t):
    return _components(t)[3]


@query(f"""WITH RECURSIVE {_graph(_C)}, {_LABELS} SELECT count(*) AS componentes, max(n) AS gigante, CAST(sum(n) - max(n) AS BIGINT) AS fora_do_gigante, count(*) FILTER (WHERE n = 1) AS isolados FROM numbered""")
def component_summary(t):
    return C.component_summary(_components(t, True)[3])


@query(f"WITH RECURSIVE {_graph(_C)}, {_LABELS} SELECT n AS size, count(*) AS n FROM numbered GROUP BY 1")
def component_histogram(t):
    return M.histogram(C.component_sizes(_components(t, True)[3]), "size")


@query(f"WITH RECURSIVE {_graph(_B)}, {_LABELS} SELECT component, n AS size FROM numbered ORDER BY component LIMIT 10")
def largest_components(t):
    return C.largest_components(_components(t)[3])


@query(f"WITH {_graph(_C)} SELECT src AS idx, count(*) AS degree FROM adj GROUP BY 1")
def degree(t):
    _, adj, nodes = _graph_of(t, True)
    return G.degrees(adj, nodes)


@query(f"WITH {_graph(_C)} SELECT degree, count(*) AS n FROM (SELECT src, count(*) AS degree FROM adj GROUP BY 1) GROUP BY 1")
def degree_histogram(t):
    _, adj, nodes = _graph_of(t, True)
    return M.histogram(G.degrees(adj, nodes), "degree")


@query(f"WITH {_graph(_C)} SELECT src AS idx, count(*) AS degree FROM adj GROUP BY 1 ORDER BY degree DESC, idx LIMIT 10")
def hubs_topk(t):
    _, adj, nodes = _graph_of(t, True)
    return M.hubs(G.degrees(adj, nodes), 10)


@query(f"""WITH RECURSIVE {_graph(_B)}, {_LABELS}, d AS (SELECT src, count(*) AS degree FROM adj GROUP BY 1)
SELECT (SELECT count(*) FROM nodes) AS nos, (SELECT count(*) FROM pairs) AS arestas, round((SELECT avg(degree) FROM d), 9) AS grau_medio, (SELECT CAST(floor(median(degree)) AS BIGINT) FROM d) AS grau_mediano,
(SELECT max(degree) FROM d) AS grau_maximo, count(*) AS componentes, max(n) AS gigante, CAST(sum(n) - max(n) AS BIGINT) AS fora_do_gigante FROM numbered""")
def graph_metrics(t):
    _, adj, nodes, labels = _components(t)
    return M.graph_metrics(G.degrees(adj, nodes), labels).withColumn("grau_medio", F.round("grau_medio", 9))


@query(f"""WITH {_graph(_B)}, asked AS (SELECT a, b FROM pairs UNION SELECT a, b + 2 FROM pairs)
SELECT a, b, (a, b) IN (SELECT (src, dst) FROM adj) AS adjacent FROM asked""")
def adjacency_test(t):
    links, adj, _ = _graph_of(t)
    pairs = G.collapse(links).select("a", "b")
    return G.adjacent(pairs.union(pairs.select("a", F.col("b") + 2)).distinct(), adj)


@query(f"WITH {_graph(_C)} SELECT src AS idx, dst, role FROM adj")
def neighbours(t):
    _, adj, nodes = _graph_of(t, True)
    return G.neighbours_of(nodes, nodes, adj)


_WALKS = "walk(a, b, d) AS (SELECT idx, idx, 0 FROM nodes WHERE idx % 50 = 0 UNION SELECT a, e.dst, d + 1 FROM walk JOIN adj e ON e.src = b WHERE d < 64), dist AS (SELECT a, b, min(d) AS d FROM walk GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_graph(_B)}, {_WALKS} SELECT a AS origin, b AS idx, d AS depth FROM dist")
def bfs_distance(t):
    _, adj, nodes = _graph_of(t)
    return T.neighbourhoods(nodes.where("idx % 50 = 0"), adj, 64, T.NO_LIMIT)[0]


def _requests(t, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The query set, ids divisible by 50: each with the least of its component, and with a company that may have no link."""
    least = labels.groupBy("component").agg(F.min("idx").alias("para"))
    own = labels.where("idx % 50 = 0").join(least, "component").select((F.col("idx") * 2).alias("pair"), F.col("idx").alias("de"), "para")
    other = nodes.where("idx % 50 = 0").select((F.col("idx") * 2 + 1).alias("pair"), F.col("idx").alias("de"), (F.expr("idx div 2") % 100 * 2 + 2).alias("para"))
    return own.unionByName(other)


_ASKED = """least2 AS (SELECT idx, m FROM least_of), asked AS (SELECT 2 * idx AS pair, idx AS de, m AS para FROM least2 WHERE idx % 50 = 0
  UNION ALL SELECT 2 * idx + 1, idx, (idx // 2) % 100 * 2 + 2 FROM nodes WHERE idx % 50 = 0)"""


@query(f"""WITH RECURSIVE {_graph(_B)}, {_LABELS}, {_WALKS}, {_ASKED}
SELECT pair, CASE WHEN para NOT IN (SELECT idx FROM nodes) THEN 'sem_vinculo' WHEN d IS NULL THEN 'componentes_diferentes' WHEN d > 4 THEN 'alem_do_limite' ELSE 'encontrado' END AS desfecho,
para NOT IN (SELECT idx FROM nodes) OR d IS NULL AS afirma_ausencia, coalesce(d, -1) AS distancia
FROM asked LEFT JOIN dist ON a = de AND b = para WHERE para IN (SELECT idx FROM nodes) OR para // 2 IN (SELECT o_orderkey FROM orders)""")
def path_outcomes(t):
    _, adj, nodes, labels = _components(t)
    catalogue = nodes.select(F.col("idx").alias("cnpj"), "idx")
    exists = t.orders.select((F.col("o_orderkey") * 2).alias("cnpj"))
    answers = V.path_answers(_requests(t, nodes, labels), catalogue, exists, adj, labels, limit=4)
    return answers.select("pair", "desfecho", "afirma_ausencia", F.coalesce("distancia", F.lit(-1)).alias("distancia"))


@query()
def path_nodes(t):
    _, adj, nodes, labels = _components(t)
    pairs = _requests(t, nodes, labels).join(nodes.select(F.col("idx").alias("para")), "para", "left_semi")
    return T.find_paths(pairs.select("pair", F.col("de").alias("a"), F.col("para").alias("b")), adj, labels)


@query()
def path_budget(t):
    _, adj, nodes, labels = _components(t, True)
    least = labels.where("component = 0").agg(F.min("idx").alias("b"))
    pairs = labels.where("component = 0 AND idx % 50 = 0").crossJoin(F.broadcast(least)).select(F.col("idx").alias("pair"), F.col("idx").alias("a"), "b")
    return T.find_paths(pairs, adj, labels, max_depth=8, budget=200).select("pair", "desfecho", "distancia", "visitados")


_HOPS = """first AS (SELECT idx AS origin, idx, 0 AS depth FROM nodes WHERE idx % 50 = 0),
ring1 AS (SELECT DISTINCT origin, dst AS idx, 1 AS depth FROM first JOIN adj ON src = idx),
ring2 AS (SELECT DISTINCT origin, dst AS idx, 2 AS depth FROM ring1 JOIN adj ON src = idx WHERE (origin, dst) NOT IN (SELECT (origin, idx) FROM first UNION ALL SELECT (origin, idx) FROM ring1)),
members AS (SELECT * FROM first UNION ALL SELECT * FROM ring1 UNION ALL SELECT * FROM ring2)"""


def _hops(t, cap: int = T.NO_LIMIT):
    _, adj, nodes = _graph_of(t, True)
    members, facts = T.neighbourhoods(nodes.where("idx % 50 = 0"), adj, 2, cap)
    return adj, members, facts


@query(f"WITH {_graph(_C)}, {_HOPS} SELECT origin, idx, depth FROM members")
def neighborhood_nodes(t):
    return _hops(t)[1]


@query(f"""WITH {_graph(_C)}, {_HOPS} SELECT m.origin, src, dst, role FROM members m JOIN adj ON src = idx AND src < dst JOIN members n ON n.origin = m.origin AND n.idx = dst""")
def neighborhood_edges(t):
    adj, members, _ = _hops(t)
    return T.induced_edges(members, adj)


@query(f"""WITH {_graph(_C)}, {_HOPS}, s AS (SELECT origin, count(*) FILTER (WHERE depth = 1) AS r1, count(*) FILTER (WHERE depth = 2) AS r2 FROM members GROUP BY 1)
SELECT origin, CASE WHEN 1 + r1 > 6 THEN 0 WHEN r2 = 0 OR 1 + r1 + r2 > 6 THEN 1 ELSE 2 END AS saltos,
CASE WHEN 1 + r1 > 6 THEN r1 WHEN 1 + r1 + r2 > 6 THEN r2 ELSE 0 END AS nivel_recusado, 1 + r1 > 6 OR 1 + r1 + r2 > 6 AS truncada FROM s""")
def neighborhood_truncation(t):
    return _hops(t, 6)[2]


@query(f"""WITH {_graph(_C)}, {_HOPS}, e AS (SELECT m.origin, count(*) AS e FROM members m JOIN adj ON src = idx AND src < dst JOIN members n ON n.origin = m.origin AND n.idx = dst GROUP BY 1)
SELECT origin, coalesce(max(e), 0) - count(*) + 1 AS ciclos FROM members LEFT JOIN e USING (origin) GROUP BY 1""")
def neighborhood_cycles(t):
    adj, members, _ = _hops(t)
    return T.cycles(members, T.induced_edges(members, adj))


# ---------------------------------------------------------------- service


@query(f"""WITH {_graph(_B)}, asked AS (SELECT 2 * o_orderkey + o_orderkey % 2 * 20000000 AS cnpj FROM orders)
SELECT cnpj, coalesce(n.idx, -1) AS idx, CASE WHEN n.idx IS NOT NULL THEN 'no' WHEN o_orderkey IS NOT NULL THEN 'sem_vinculo' ELSE 'desconhecida' END AS status
FROM asked LEFT JOIN nodes n ON n.idx = cnpj LEFT JOIN orders ON 2 * o_orderkey = cnpj""")
def resolve_status(t):
    _, _, nodes = _graph_of(t)
    asked = t.orders.select((F.col("o_orderkey") * 2 + F.col("o_orderkey") % 2 * 20000000).alias("cnpj"))
    return V.resolve(asked, nodes.select(F.col("idx").alias("cnpj"), "idx"), t.orders.select((F.col("o_orderkey") * 2).alias("cnpj"))).withColumn("idx", F.coalesce("idx", F.lit(-1)))


@query("""SELECT n_nationkey AS pair, array_to_string(list_filter([n_nationkey, n_regionkey + 22], lambda x: x > 22), ',') AS desconhecidas FROM nation WHERE n_nationkey > 22 OR n_regionkey > 0""")
def unknown_ends(t):
    known = t.nation.where("n_nationkey <= 22").select(F.col("n_nationkey").alias("cnpj"), F.col("n_nationkey").alias("idx"))
    pairs = t.nation.select(F.col("n_nationkey").alias("pair"), F.col("n_nationkey").alias("de"), (F.col("n_regionkey") + 22).alias("para"))
    found = V.unknown_ends(pairs, known, known.select("cnpj"))
    return found.select("pair", F.array_join(F.transform("desconhecidas", lambda x: x.cast("string")), ",").alias("desconhecidas"))


def _company_answers(t, giant: bool) -> DataFrame:
    """Every order as a company: what is told of it."""
    _, adj, nodes, labels = _components(t, giant)
    companies = t.orders.select((F.col("o_orderkey") * 2).alias("cnpj"), F.col("o_orderpriority").alias("nome"))
    catalogue = companies.join(nodes.select(F.col("idx").alias("cnpj"), "idx"), "cnpj").withColumn("no_recorte", F.lit(True))
    return V.company_summary(companies.select("cnpj"), catalogue, companies.select("cnpj"), G.degrees(adj, nodes), labels)


_COMPANIES = "d AS (SELECT src AS idx, count(*) AS degree FROM adj GROUP BY 1), told AS (SELECT * FROM orders LEFT JOIN d ON d.idx = 2 * o_orderkey LEFT JOIN least_of USING (idx) LEFT JOIN numbered USING (m))"


@query(f"""WITH RECURSIVE {_graph(_C)}, {_LABELS}, {_COMPANIES}
SELECT 2 * o_orderkey AS cnpj, idx IS NOT NULL AS tem_vinculo, CASE WHEN idx IS NOT NULL THEN o_orderpriority END AS nome, coalesce(degree, 0) AS vinculos_no_recorte, coalesce(n, 0) AS tamanho_do_componente_no_recorte FROM told""")
def company_summary(t):
    found = _company_answers(t, True)
    return found.select("cnpj", "tem_vinculo", "nome", "vinculos_no_recorte", F.coalesce("tamanho_do_componente_no_recorte", F.lit(0)).alias("tamanho_do_componente_no_recorte"))


@query(f"""WITH RECURSIVE {_graph(_B)}, {_LABELS}, {_COMPANIES}
SELECT 2 * o_orderkey AS cnpj, CASE WHEN idx IS NULL THEN 'Existe no recorte sem nenhum vínculo registrado.'
  ELSE degree || CASE degree WHEN 1 THEN ' vínculo' ELSE ' vínculos' END || ' no recorte, em componente de ' || n || ' nós.' END AS explicacao FROM told""")
def company_explanations(t):
    return _company_answers(t, False).select("cnpj", "explicacao")


@query()
def response_nodes(t):
    the_nodes, links = _whole_graph(t)
    adj = materialise(G.adjacency(links), "adj")
    listed = the_nodes.select(F.lit(1).alias("request"), F.col("idx").alias("position"), "idx")
    return V.answer_nodes(listed, the_nodes, G.degrees(adj, the_nodes))


@query("""WITH e AS (SELECT event_id, user_id % 20 AS client, ts, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
w AS (SELECT *, s - s % 3600 AS window_start, row_number() OVER (PARTITION BY client, s - s % 3600 ORDER BY ts, event_id) AS c FROM e)
SELECT event_id, window_start, c AS count_in_window, c <= 3 AS allowed, 3600 - s % 3600 AS retry_after FROM w""")
def rate_limit_fixed_window(t):
    asked = t.events.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("client"), "ts")
    return V.rate_limit(asked, 3, 3600).select(F.col("id").alias("event_id"), "window_start", F.col("count_in_window").cast("long").alias("count_in_window"), "allowed", "retry_after")


@query("""WITH w AS (SELECT user_id % 20 AS client, CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS window_start, count(*) AS n FROM events GROUP BY 1, 2)
SELECT client, window_start, n, greatest(n - 3, 0) AS refused FROM w""")
def rate_limit_window_counts(t):
    asked = t.events.select((F.col("user_id") % 20).alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    return windows.request_counts(asked, 3, 3600).withColumn("window_start", F.unix_seconds("window_start"))


def _whole_graph(t):
    """Nodes and links of the registry-like tables."""
    the_slice = t.nation.select(F.lpad(F.col("n_nationkey").cast("string"), 8, "0").alias("cnpj_basico"))
    companies = t.nation.select(F.lpad(F.col("n_nationkey").cast("string"), 8, "0").alias("cnpj_basico"), F.col("n_name").alias("razao_social"))
    partners = X.partners(t)
    found, _ = P.identities(partners, the_slice)
    the_nodes = materialise(G.nodes(found, partners, companies, the_slice), "nodes")
    links = materialise(G.edges(partners, the_nodes), "edges")
    G.check_conservation(partners, links)
    return the_nodes, links


@query(f"""WITH {_IDENT}, own AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS base, n_name FROM nation),
linked AS (SELECT DISTINCT base, n_name FROM own WHERE base IN (SELECT cnpj_basico FROM keyed) OR base IN (SELECT cnpj_basico FROM identities WHERE tipo = 'pessoa_juridica')),
companies AS (SELECT substr(sha256('pessoa_juridica|' || base), 1, 16) AS k, base, n_name FROM linked),
all_nodes AS (SELECT coalesce(i.identificador, c.k) AS k, coalesce(tipo, 'pessoa_juridica') AS tipo, coalesce(n_name, nome) AS nome, coalesce(base, cnpj_basico) AS cnpj_basico, cpf_mascarado,
  coalesce(base IS NOT NULL, false) OR coalesce(i.cnpj_basico IN (SELECT base FROM own), false) AS inside FROM identities i FULL JOIN companies c ON i.identificador = c.k)
SELECT row_number() OVER (ORDER BY k) - 1 AS idx, tipo, CASE WHEN tipo = 'pessoa_juridica' THEN nome END AS nome, CASE WHEN tipo = 'pessoa_juridica' THEN k END AS identificador, cnpj_basico,
  substr(cpf_mascarado, 9, 1) AS regiao_fiscal FROM all_nodes""")
def node_table(t):
    return _whole_graph(t)[0].select("idx", "tipo", "nome", "identificador", "cnpj_basico", "regiao_fiscal")


@query(f"WITH {_IDENT} SELECT count(*) AS vinculos, count(*) FILTER (WHERE confianca = 'exata' AND left(doc, 8) = cnpj_basico) AS lacos FROM keyed")
def edge_table_counts(t):
    return G.edge_counters(_whole_graph(t)[1]).select("vinculos", "lacos")


@query(f"""WITH {_IDENT} SELECT identificador AS chave, tipo, CASE WHEN tipo = 'pessoa_juridica' THEN nome END AS nome, CASE WHEN tipo = 'pessoa_juridica' THEN cpf_mascarado END AS cpf_mascarado, substr(cpf_mascarado, 9, 1) AS regiao_fiscal FROM identities""")
def privacy_projection(t):
    shown = G.project_privacy(_identities(t)[0])
    return shown.select(F.col("__key").alias("chave"), "tipo", "nome", "cpf_mascarado", "regiao_fiscal")


@query("SELECT CAST(0 AS BIGINT) AS n")
def named_persons_zero(t):
    return R.named_persons(G.project_privacy(_identities(t)[0]))


@query(f"WITH {_IDENT} SELECT identificador, substr(cpf_mascarado, 9, 1) AS regiao FROM identities WHERE cpf_mascarado IS NOT NULL")
def mask_region(t):
    return _identities(t)[0].where("cpf_mascarado IS NOT NULL").select("identificador", I.fiscal_region(F.col("cpf_mascarado")).alias("regiao"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey // 7 % 2 = 0 THEN n_nationkey % 7 ELSE 6 - n_nationkey % 7 END * 210 AS x, n_nationkey // 7 * 130 AS y FROM nation""")
def page_layout_path(t):
    placed = t.nation.select("n_nationkey", D.path_position(F.col("n_nationkey")).alias("p"))
    return placed.select("n_nationkey", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query("""WITH r AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS o, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)
SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 0.0 ELSE round(165 * n_regionkey * cos(2 * pi() * o / n - pi() / 2), 6) + 0.0 END::DOUBLE AS x,
CASE WHEN n_regionkey = 0 THEN 0.0 ELSE round(165 * n_regionkey * sin(2 * pi() * o / n - pi() / 2), 6) + 0.0 END::DOUBLE AS y FROM r""")
def page_layout_rings(t):
    from pyspark.sql import Window

    ring = Window.partitionBy("n_regionkey")
    rows = t.nation.withColumns({"o": F.row_number().over(ring.orderBy("n_nationkey")) - 1, "n": F.count("*").over(ring)})
    placed = rows.select("n_nationkey", D.ring_position(F.col("n_regionkey"), F.col("o"), F.col("n")).alias("p"))
    return placed.select("n_nationkey", (F.round("p.x", 6) + 0.0).alias("x"), (F.round("p.y", 6) + 0.0).alias("y"))


# ---------------------------------------------------------------- sources and sinks


@query("""SELECT CAST(c_custkey AS VARCHAR) AS codigo, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name || ';' || chr(10) || 'é "x"' END AS descricao FROM customer""")
def bronze_csv_scan(t):
    text = F.concat_ws("", "c_name", F.lit(";\n"), F.lit('é "x"'))
    raw = t.customer.select(F.col("c_custkey").cast("string").alias("codigo"), F.when(F.col("c_custkey") % 9 == 0, "").otherwise(text).alias("descricao"))
    import uuid

    path = f"{shared_dir(t.spark)}/extract-{uuid.uuid4().hex}"
    raw.write.csv(path, sep=";", quote='"', escape='"', quoteAll=True, emptyValue="", encoding="ISO-8859-1", header=False)
    return registry.read_extract(t.spark, path, registry.DOMAIN, encoding="ISO-8859-1")


@query("SELECT count(*) AS n FROM nation")
def bronze_convert(t):
    import uuid

    source = t.nation.select(F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("codigo"), F.col("n_name").alias("descricao"))
    path = f"{shared_dir(t.spark)}/bronze-{uuid.uuid4().hex}"
    registry.convert(source, path, domain=True)
    return registry.read_table(t.spark, path).agg(F.count("*").alias("n"))


@query("SELECT '2026-0' || max(r_regionkey + 1) AS period FROM region WHERE r_regionkey <> 4")
def newest_complete_period(t):
    names = t.spark.createDataFrame([(x, i) for i, x in enumerate(archives.EXPECTED)], "name string, i int")
    listing = t.region.select(F.concat(F.lit("2026-0"), (F.col("r_regionkey") + 1).cast("string")).alias("period"), "r_regionkey").crossJoin(F.broadcast(names))
    return archives.newest_complete(listing.where("NOT (r_regionkey = 4 AND i = 7)").select("period", "name"))


@query("""SELECT column_name AS coluna FROM (DESCRIBE SELECT * FROM customer) WHERE column_type = 'VARCHAR'""")
def text_columns(t):
    return t.spark.createDataFrame([(c,) for c in registry.text_columns(t.customer)], "coluna string")


from ownergraph.plans import answers  # noqa: E402, F401  registers its queries here
