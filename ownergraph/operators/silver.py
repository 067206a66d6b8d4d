"""Silver: a territorial slice of the registry, typed, decoded, and without personal numbers in free text.

Every step returns its table and a one-row table of what had to be decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ownergraph.errors import DuplicateCompany, EmptySlice, LostLink, MalformedCapital, MissingCompany
from ownergraph.functions import decoding as D
from ownergraph.functions.documents import suppress_documents

CONTENT = ["razao_social", "natureza_juridica", "qualificacao_do_responsavel", "capital_social", "porte", "ente_federativo_responsavel"]


def total_order(*columns: Column) -> Column:
    """A struct that sorts like tuples with nulls last."""
    return F.struct(*(x for i, c in enumerate(columns) for x in (c.isNull().alias(f"n{i}"), c.alias(f"v{i}"))))


def slice_by_state(establishments: DataFrame, state: str) -> tuple[DataFrame, DataFrame]:
    """Companies whose head office is in ``state``; of several head offices the first by order, digits and status."""
    heads = establishments.where((F.col("identificador_matriz_filial") == "1") & (F.col("uf") == state))
    order = total_order(F.col("cnpj_ordem"), F.col("cnpj_dv"), F.col("situacao_cadastral"))
    status = F.min_by("situacao_cadastral", F.when(F.col("situacao_cadastral").isNotNull(), order))
    grouped = heads.groupBy("cnpj_basico").agg(status.alias("situacao_cadastral"), F.min("uf").alias("uf"), F.count("*").alias("n"))
    table = grouped.select("cnpj_basico", "situacao_cadastral", "uf")
    counters = grouped.agg(F.count("*").alias("empresas"), F.count_if(F.col("n") > 1).alias("repetidas"))
    if grouped.isEmpty():
        raise EmptySlice(f"no head office is in {state}")
    return table, counters


def most_complete(df: DataFrame, key: str, content: list[str]) -> DataFrame:
    """One row a key: the one with most filled fields, ties by the fields themselves, nulls last; ``copies`` tells of how many."""
    order = Window.partitionBy(key).orderBy(D.filled_fields(content).desc(), *(F.col(c).asc_nulls_last() for c in content))
    return df.withColumns({"__at": F.row_number().over(order), "copies": F.count("*").over(Window.partitionBy(key))}).where("__at = 1").drop("__at")


def type_companies(companies: DataFrame, the_slice: DataFrame, natures: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The slice's companies with typed capital, decoded codes and clean names."""
    inside = companies.join(the_slice.select("cnpj_basico"), "cnpj_basico", "left_semi")
    chosen = most_complete(inside, "cnpj_basico", CONTENT)
    if bad := chosen.where(F.col("capital_social").isNotNull() & ~F.col("capital_social").rlike(D.CAPITAL_FORM)).limit(5).collect():
        raise MalformedCapital(f"capital that is no amount: {', '.join(r['capital_social'] for r in bad)}")
    if lost := the_slice.join(inside, "cnpj_basico", "left_anti").limit(5).collect():
        raise MissingCompany(f"companies of the slice without a record: {', '.join(r['cnpj_basico'] for r in lost)}")
    nature = natures.select(F.col("codigo").alias("natureza_juridica"), F.col("descricao").alias("natureza_juridica_descricao"))
    role = roles.select(F.col("codigo").alias("qualificacao_do_responsavel"), F.col("descricao").alias("qualificacao_do_responsavel_descricao"))
    typed = (
        chosen.join(F.broadcast(nature), "natureza_juridica", "left")
        .join(F.broadcast(role), "qualificacao_do_responsavel", "left")
        .withColumns({"__name": suppress_documents(F.col("razao_social")), "porte_descricao": D.size_class(F.col("porte"))})
    )
    counters = typed.agg(
        F.count("*").alias("empresas"),
        F.count_if(F.col("copies") > 1).alias("cnpj_repetidos"),
        F.count_if(~F.col("__name").eqNullSafe(F.col("razao_social"))).alias("nomes_suprimidos"),
        F.count_if(D.comma_decimal(F.col("capital_social")).isNull()).alias("capital_ausente"),
        F.count_if(F.col("natureza_juridica_descricao").isNull()).alias("natureza_sem_descricao"),
        F.count_if(F.col("qualificacao_do_responsavel_descricao").isNull()).alias("qualificacao_sem_descricao"),
        F.count_if(F.col("porte_descricao").isNull()).alias("porte_sem_descricao"),
    )
    table = typed.select(
        "cnpj_basico", F.col("__name").alias("razao_social"), "natureza_juridica", "natureza_juridica_descricao", "qualificacao_do_responsavel",
        "qualificacao_do_responsavel_descricao", D.comma_decimal(F.col("capital_social")).alias("capital_social"), "porte", "porte_descricao",
        "ente_federativo_responsavel",
    )
    check_unique(table, "cnpj_basico")
    return table, counters


def type_partners(partners: DataFrame, the_slice: DataFrame, roles: DataFrame, countries: DataFrame, period: str) -> tuple[DataFrame, DataFrame]:
    """The links of the slice's companies, one row each; none may be lost or gained."""
    inside = partners.join(the_slice.select("cnpj_basico"), "cnpj_basico", "left_semi")

    def legend(df: DataFrame, code: str) -> DataFrame:
        return F.broadcast(df.select(F.col("codigo").alias(code), F.col("descricao").alias(f"{code}_descricao")))

    clean = inside.withColumns({
        "__name": suppress_documents(F.col("nome_socio_ou_razao_social")),
        "representante_legal": D.placeholder_to_null(F.col("representante_legal")),
        "nome_representante": suppress_documents(D.blank_to_null(F.col("nome_representante"))),
        "__date": D.guarded_date(F.col("data_entrada_sociedade"), D.last_day(period)),
    })
    typed = (
        clean.join(legend(roles, "qualificacao_socio"), "qualificacao_socio", "left")
        .join(legend(roles, "qualificacao_representante_legal"), "qualificacao_representante_legal", "left")
        .join(legend(countries, "pais"), "pais", "left")
    )
    missing = lambda c: F.count_if(F.col(c).isNotNull() & F.col(f"{c}_descricao").isNull())
    counters = typed.agg(
        F.count("*").alias("vinculos"),
        F.count_if(~F.col("__name").eqNullSafe(F.col("nome_socio_ou_razao_social"))).alias("nomes_suprimidos"),
        F.count_if(F.col("representante_legal").isNull()).alias("representantes_sem_documento"),
        F.count_if(F.col("__date").isNull()).alias("datas_invalidas"),
        missing("qualificacao_socio").alias("qualificacao_socio_sem_descricao"),
        missing("qualificacao_representante_legal").alias("qualificacao_representante_sem_descricao"),
        missing("pais").alias("pais_sem_descricao"),
        F.count_if(F.col("pais").isNull()).alias("pais_ausente"),
    )
    before, after = inside.count(), counters.first()["vinculos"]
    if before != after:
        raise LostLink(f"{before} links went in, {after} came out")
    table = typed.select(
        "cnpj_basico", "identificador_socio", D.decode(F.col("identificador_socio"), D.PARTNER_TYPES).alias("identificador_socio_descricao"),
        F.col("__name").alias("nome_socio_ou_razao_social"), "cnpj_cpf_socio", "qualificacao_socio", "qualificacao_socio_descricao",
        F.col("__date").alias("data_entrada_sociedade"), "pais", "pais_descricao", "representante_legal", "nome_representante",
        "qualificacao_representante_legal", "qualificacao_representante_legal_descricao", "faixa_etaria",
        D.decode(F.col("faixa_etaria"), D.AGE_BANDS).alias("faixa_etaria_descricao"),
    )
    return table, counters


def check_unique(df: DataFrame, key: str) -> None:
    if bad := df.groupBy(key).count().where("count > 1").orderBy(F.desc("count"), key).limit(5).collect():
        raise DuplicateCompany(f"repeated {key}: {', '.join(f'{r[0]} ({r[1]} times)' for r in bad)}")
