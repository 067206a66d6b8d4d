"""Quality gate: rules over the silver tables, each a table of findings; one broken rule stops the build."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.errors import QualityError
from ownergraph.functions.documents import suppress_documents
from ownergraph.operators.identities import identified_partners
from ownergraph.sources.registry import text_columns

# What must not cross over, what must be unique or filled, and the forms of structured columns.
CONTACT = ("correio_eletronico", "ddd_1", "telefone_1", "ddd_2", "telefone_2", "ddd_fax", "fax")
KEYS = {"recorte": "cnpj_basico", "empresas": "cnpj_basico", "identidades": "identificador"}
REQUIRED = {
    "recorte": ("cnpj_basico", "situacao_cadastral", "uf"), "empresas": ("cnpj_basico",), "socios": ("cnpj_basico", "identificador_socio"),
    "identidades": ("identificador", "tipo", "confianca", "vinculos_no_recorte"),
}
FORMS = {
    "cnpj_cpf_socio": r"^(\*\*\*[0-9]{6}\*\*|[0-9]{14})$", "representante_legal": r"^\*\*\*[0-9]{6}\*\*$", "cpf_mascarado": r"^\*\*\*[0-9]{6}\*\*$",
    "cnpj_basico": r"^[0-9]{8}$", "identificador": r"^[0-9a-f]{16}$",
}
#: Documents that no form may let through.
PROBES = ("11144477735", "111.444.777-35", "111444777-35", "111 444 777 35", "1234567890", "FULANO 11144477735")
Tables = dict[str, DataFrame]


def _finding(rule: str, detail, df: DataFrame, n=None) -> DataFrame:
    return df.select(F.lit(rule).alias("regra"), detail.alias("detalhe"), (F.lit(1) if n is None else n).cast("long").alias("n"))


def _counted(rule: str, df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Violations of several conditions in one pass, as a row each."""
    row = df.agg(*(F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions.values())))
    pairs = F.array(*(F.struct(F.lit(name).alias("d"), F.col(f"c{i}").alias("n")) for i, name in enumerate(conditions)))
    return _finding(rule, F.col("x.d"), row.select(F.explode(pairs).alias("x")).where("x.n > 0"), F.col("x.n"))


def no_contact(tables: Tables, spark: SparkSession) -> DataFrame:
    bad = [(f"{name}.{c}",) for name, df in tables.items() for c in df.columns if c in CONTACT]
    return _finding("contato_nao_atravessa", F.col("x"), spark.createDataFrame(bad, "x string"))


def documents_are_suppressed(name: str, df: DataFrame) -> DataFrame:
    """Suppressing again changes nothing, in any free text."""
    free = [c for c in text_columns(df) if c not in FORMS]
    conditions = {f"{name}.{c}": F.coalesce(suppress_documents(F.col(c)) != F.col(c), F.lit(False)) for c in free}
    return _counted("documento_foi_suprimido", df, conditions)


def structured_columns_keep_form(name: str, df: DataFrame) -> DataFrame:
    conditions = {f"{name}.{c}": F.coalesce(~F.col(c).rlike(f), F.lit(False)) for c, f in FORMS.items() if c in df.columns}
    return _counted("coluna_estruturada_tem_a_forma_declarada", df, conditions)


def forms_reject_documents(spark: SparkSession, forms: dict[str, str] = FORMS) -> DataFrame:
    """Every form against every probe: few rows, by construction."""
    rows = [(c, f, p) for c, f in forms.items() for p in PROBES]
    bad = spark.createDataFrame(rows, "c string, f string, p string").where(F.regexp("p", F.col("f")))
    return _finding("forma_declarada_recusa_documento", F.concat_ws(" ", "c", "p"), bad)


def conservation(tables: Tables) -> DataFrame:
    a = tables["recorte"].agg(F.count("*").alias("a")).crossJoin(tables["empresas"].agg(F.count("*").alias("b")))
    c = tables["socios"].agg(F.count("*").alias("a")).crossJoin(tables["identidades"].agg(F.coalesce(F.sum("vinculos_no_recorte"), F.lit(0)).alias("b")))
    told = lambda df, text: _finding("cadeia_de_conservacao", F.lit(text), df.where("a <> b"), F.abs(F.col("a") - F.col("b")))
    return told(a, "recorte e empresas").unionByName(told(c, "socios e identidades"))


def references(tables: Tables) -> DataFrame:
    without = tables["socios"].join(tables["empresas"], "cnpj_basico", "left_anti").agg(F.count("*").alias("n"))
    recomputed = identified_partners(tables["socios"]).select("identificador").distinct()
    unknown = recomputed.join(tables["identidades"], "identificador", "left_anti").agg(F.count("*").alias("n"))
    told = lambda df, text: _finding("integridade_referencial", F.lit(text), df.where("n > 0"), F.col("n"))
    return told(without, "vinculo_sem_empresa").unionByName(told(unknown, "vinculo_sem_identidade"))


def unique_key(name: str, df: DataFrame) -> DataFrame:
    repeated = df.groupBy(KEYS[name]).count().where("count > 1").agg(F.count("*").alias("n")).where("n > 0")
    return _finding("chave_unica", F.lit(f"{name}.{KEYS[name]}"), repeated, F.col("n"))


def required_filled(name: str, df: DataFrame) -> DataFrame:
    return _counted("sem_nulo_no_obrigatorio", df, {f"{name}.{c}": F.col(c).isNull() for c in REQUIRED[name]})


def plausible_ranges(tables: Tables) -> DataFrame:
    rule = "faixas_plausiveis"
    say = lambda c: F.coalesce(c, F.lit(False))
    return (
        _counted(rule, tables["empresas"], {"empresas.capital_social": say(F.col("capital_social") < 0)})
        .unionByName(_counted(rule, tables["identidades"], {
            "identidades.vinculos_no_recorte": say(F.col("vinculos_no_recorte") < 1),
            "identidades.taxa_de_colisao": say((F.col("taxa_de_colisao") < 0) | (F.col("taxa_de_colisao") > 1)),
        }))
        .unionByName(_counted(rule, tables["socios"], {"socios.data_entrada_sociedade": say(F.col("data_entrada_sociedade") < F.lit("1900-01-01").cast("date"))}))
    )


def minimum_count(name: str, df: DataFrame) -> DataFrame:
    return _finding("contagem_minima", F.lit(name), df.limit(1).agg(F.count("*").alias("n")).where("n = 0"))


def instrument_detects(bronze: DataFrame, column: str) -> bool:
    """The scanner finds documents where there are some: a rule that cannot fail proves nothing."""
    return not bronze.where(suppress_documents(F.col(column)) != F.col(column)).isEmpty()


def findings(tables: Tables) -> DataFrame:
    """``regra, detalhe, n`` of all rules over ``recorte, empresas, socios, identidades``; no row in sound tables."""
    spark = tables["recorte"].sparkSession
    rules = [no_contact(tables, spark), forms_reject_documents(spark), conservation(tables), references(tables), plausible_ranges(tables)]
    for name, df in tables.items():
        rules += [documents_are_suppressed(name, df), structured_columns_keep_form(name, df), required_filled(name, df), minimum_count(name, df)]
        if name in KEYS:
            rules.append(unique_key(name, df))
    return reduce(DataFrame.unionByName, rules)


def verify(tables: Tables) -> None:
    """Raise once, with every finding."""
    if found := findings(tables).orderBy("regra", "detalhe").collect():
        raise QualityError("; ".join(f"{r['regra']}: {r['detalhe']} ({r['n']})" for r in found))
