"""Partner identities: stable keys, what they merge, and how often that is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownergraph.functions import identity as I


def identified_partners(partners: DataFrame) -> DataFrame:
    """Links with normalised name, kind, confidence and the partner's key; the one place where the rule stands."""
    named = partners.select(
        "cnpj_basico", "identificador_socio", I.normalise_name(F.col("nome_socio_ou_razao_social")).alias("nome"),
        F.col("nome_socio_ou_razao_social").alias("nome_de_origem"), "cnpj_cpf_socio", "qualificacao_socio", "pais",
    )
    marked = named.withColumns({
        "tipo": I.kind_of(F.col("identificador_socio")),
        "confianca": I.confidence_of(F.col("identificador_socio"), F.col("nome"), F.col("cnpj_cpf_socio")),
    })
    key = I.partner_id(F.col("confianca"), F.col("cnpj_basico"), F.col("nome"), F.col("cnpj_cpf_socio"), F.col("pais"))
    return marked.withColumn("identificador", key)


def collision_rates(people: DataFrame) -> DataFrame:
    """Per region: identities, chance that two share a mask, pairs of one name, expected false merges, and the rate.

    ``people`` has ``regiao, nome, mascara`` with repetitions.  Sums are integers and every quotient is taken once,
    so the order of rows changes nothing.
    """
    distinct = people.select("regiao", "nome", "mascara").distinct()
    by_mask = distinct.groupBy("regiao", "mascara").agg(F.count("*").alias("q")).groupBy("regiao").agg(
        F.sum("q").alias("identidades"), F.sum(F.col("q") * F.col("q")).alias("quadrados")
    )
    by_name = distinct.groupBy("regiao", "nome").agg(F.count("*").alias("q")).groupBy("regiao").agg(F.sum(F.expr("q * (q - 1) div 2")).alias("pares"))
    n, s, p = (F.col(c).cast("double") for c in ("identidades", "quadrados", "pares"))
    return by_mask.join(by_name, "regiao").select(
        "regiao", "identidades", (s / (n * n)).alias("colisao"), "pares", (p * s / (n * n)).alias("fusoes"), (p * s / (n * n * n)).alias("taxa_de_colisao")
    )


def identities(partners: DataFrame, the_slice: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row an identity, and the rates by region."""
    found = identified_partners(partners)
    known = the_slice.select(F.col("cnpj_basico").alias("__base"), F.lit(True).alias("__in")).distinct()
    base = F.when(F.col("confianca") == I.EXACT, F.substring("cnpj_cpf_socio", 1, 8))
    marked = found.withColumn("__base", base).join(known, "__base", "left").withColumn(
        "no_recorte", F.when(F.col("__base").isNotNull(), F.coalesce("__in", F.lit(False)))
    )
    estimated = F.col("confianca") == I.ESTIMATED
    people = found.where(estimated).select(I.fiscal_region(F.col("cnpj_cpf_socio")).alias("regiao"), "nome", F.col("cnpj_cpf_socio").alias("mascara"))
    rates = collision_rates(people)
    rate = F.broadcast(rates.select(F.col("regiao").alias("__region"), "taxa_de_colisao"))  # one row for each digit
    rated = marked.withColumn("__region", F.when(estimated, I.fiscal_region(F.col("cnpj_cpf_socio")))).join(rate, "__region", "left")
    kind = F.any_value("tipo", True)
    table = rated.groupBy("identificador").agg(
        kind.alias("tipo"),
        F.min("nome_de_origem").alias("nome"),
        F.when(kind == I.COMPANY, F.min(F.substring("cnpj_cpf_socio", 1, 8))).alias("cnpj_basico"),
        F.when(kind == I.PERSON, F.min("cnpj_cpf_socio")).alias("cpf_mascarado"),
        F.when(kind == I.FOREIGNER, F.min("pais")).alias("pais"),
        F.bool_or("no_recorte").alias("no_recorte"),
        F.any_value("confianca", True).alias("confianca"),
        F.any_value("taxa_de_colisao", True).alias("taxa_de_colisao"),
        F.count("*").alias("vinculos_no_recorte"),
    )
    return table, rates


def rate_is_function_of_region(identified: DataFrame) -> DataFrame:
    """Regions with more than one rate: ``regiao, taxas``; none in sound tables."""
    return identified.groupBy("regiao").agg(F.count_distinct("taxa_de_colisao").alias("taxas")).where("taxas > 1")
