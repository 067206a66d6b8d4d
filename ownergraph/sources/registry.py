"""Bronze: raw, headerless registry extracts as all-text tables, with declared columns and nothing inferred."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ownergraph.errors import BlankDescription, CountMismatch, DuplicateCode, InsufficientSpace, MissingInput
from ownergraph.sources.sinks import put_in_place

# The tables of the source and their columns, in order.
ESTABLISHMENTS = (
    "cnpj_basico cnpj_ordem cnpj_dv identificador_matriz_filial nome_fantasia situacao_cadastral data_situacao_cadastral motivo_situacao_cadastral "
    "nome_da_cidade_no_exterior pais data_de_inicio_atividade cnae_fiscal_principal cnae_fiscal_secundaria tipo_de_logradouro logradouro numero "
    "complemento bairro cep uf municipio ddd_1 telefone_1 ddd_2 telefone_2 ddd_fax fax correio_eletronico situacao_especial data_da_situacao_especial"
).split()
COMPANIES = "cnpj_basico razao_social natureza_juridica qualificacao_do_responsavel capital_social porte ente_federativo_responsavel".split()
PARTNERS = (
    "cnpj_basico identificador_socio nome_socio_ou_razao_social cnpj_cpf_socio qualificacao_socio data_entrada_sociedade pais "
    "representante_legal nome_representante qualificacao_representante_legal faixa_etaria"
).split()
DOMAIN = ["codigo", "descricao"]
DOMAINS = ("cnaes", "motivos", "municipios", "naturezas", "paises", "qualificacoes")
TABLES = {"estabelecimentos": ESTABLISHMENTS, "empresas": COMPANIES, "socios": PARTNERS} | dict.fromkeys(DOMAINS, DOMAIN)


def text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_extract(spark: SparkSession, paths: str | list[str], columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """Semicolons, every field quoted, no header; quoted empties are null; a row of another width is an error."""
    return spark.read.schema(text_schema(columns)).csv(
        paths, sep=";", quote='"', escape='"', header=False, multiLine=True, mode="FAILFAST", encoding=encoding
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table or glob; what is not there is told by name."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            raise MissingInput(f"nothing to read at {path}; run the step before") from error
        raise


def duplicate_keys(df: DataFrame, key: str, sample: int = 5) -> DataFrame:
    """The most frequent repeated keys, at most ``sample``: ``key, n``."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), key).limit(sample)


def check_domain(df: DataFrame) -> None:
    """Codes are unique and every one has a description."""
    if repeated := [f"{r[0]} ({r[1]} times)" for r in duplicate_keys(df, "codigo").collect()]:
        raise DuplicateCode(f"repeated codes: {', '.join(repeated)}")
    blank = df.where(F.nullif(F.trim(F.coalesce("descricao", F.lit(""))), F.lit("")).isNull()).limit(5).collect()
    if blank:
        raise BlankDescription(f"codes without a description: {', '.join(str(r['codigo']) for r in blank)}")


def check_space(folder: str, needed: int) -> None:
    """A Parquet copy is taken to need no more than its text; only local folders can be asked."""
    free = shutil.disk_usage(folder).free
    if free < needed:
        raise InsufficientSpace(f"{needed} bytes are needed at {folder}, {free} are free")


def convert(source: DataFrame, target: str, domain: bool = False) -> int:
    """Write ``source`` as Parquet beside ``target``, check the copy, then put it in place; rows written.

    What is there before stays if a check fails.
    """
    spark, partial = source.sparkSession, f"{target}.partial"
    before = source.count()
    source.write.mode("overwrite").option("compression", "zstd").parquet(partial)
    written = spark.read.schema(source.schema).parquet(partial)
    after = written.count()
    if after != before:
        raise CountMismatch(f"{before} rows were read for {target}, {after} were written")
    if domain:
        check_domain(written)
    put_in_place(spark, partial, target)
    return after


def convert_table(spark: SparkSession, name: str, paths: str | list[str], folder: str, encoding: str = "UTF-8") -> int:
    """One table of the source; several extracts are read as one."""
    if name not in TABLES:
        raise MissingInput(f"no table is called {name}; there are {', '.join(TABLES)}")
    return convert(read_extract(spark, paths, TABLES[name], encoding), os.path.join(folder, f"{name}.parquet"), name in DOMAINS)


def chosen(name: str) -> list[str]:
    """``principais`` are the three large tables, ``tudo`` is all of them."""
    groups = {"principais": list(TABLES)[:3], "tudo": list(TABLES)}
    return groups.get(name, [name])


def convert_folder(spark: SparkSession, name: str, folder: str, target: str) -> int:
    """A table from all its extracts in a local folder, after a look at the space that is left for it; rows written.

    The extracts of a table are named after it, with or without a number.
    """
    stem = {"estabelecimentos": "Estabelecimentos", "empresas": "Empresas", "socios": "Socios"}.get(name, name.capitalize())
    paths = sorted(os.path.join(folder, x) for x in os.listdir(folder) if x.startswith(stem) and x.endswith(".csv"))
    if not paths:
        raise MissingInput(f"no extract of {name} in {folder}")
    os.makedirs(target, exist_ok=True)
    check_space(target, sum(map(os.path.getsize, paths)))
    rows = convert_table(spark, name, paths, target)
    by_file = {os.path.basename(r["file"]): r["n"] for r in rows_by_file(read_extract(spark, paths, TABLES[name])).collect()}  # a row an extract
    if sum(by_file.values()) != rows:
        raise CountMismatch(f"{name}: the extracts have {sum(by_file.values())} rows, the table has {rows}")
    return rows


def rows_by_file(source: DataFrame) -> DataFrame:
    """``file, n``: how much each extract brought."""
    return source.select(F.input_file_name().alias("file")).groupBy("file").agg(F.count("*").alias("n"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
