import hashlib
import os
import zipfile

import pytest

from ownergraph import errors as E
from ownergraph.operators import identities as P
from ownergraph.operators import quality as Q
from ownergraph.operators import silver as S
from ownergraph.sources import archives as A
from ownergraph.sources import registry as R
from ownergraph.streaming import windows


def write_rows(path, rows, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        for row in rows:
            f.write(";".join('"' + x.replace('"', '""') + '"' for x in row) + "\n")
    return str(path)


def establishment(**change):
    row = dict.fromkeys(R.ESTABLISHMENTS, "") | {"uf": "SP", "identificador_matriz_filial": "1", "cnpj_ordem": "0001", "cnpj_dv": "00", "situacao_cadastral": "02"}
    return tuple((row | change)[c] for c in R.ESTABLISHMENTS)


def company(base, **change):
    row = {"cnpj_basico": base, "razao_social": "EMPRESA DE TESTE LTDA", "natureza_juridica": "2062", "qualificacao_do_responsavel": "49", "capital_social": "1000,00", "porte": "01", "ente_federativo_responsavel": ""}
    return tuple((row | change)[c] for c in R.COMPANIES)


def partner(base, **change):
    row = {"cnpj_basico": base, "identificador_socio": "2", "nome_socio_ou_razao_social": "JOAO DA SILVA", "cnpj_cpf_socio": "***456789**", "qualificacao_socio": "49",
           "data_entrada_sociedade": "20150312", "pais": "", "representante_legal": "***000000**", "nome_representante": "", "qualificacao_representante_legal": "00", "faixa_etaria": "5"}
    return tuple((row | change)[c] for c in R.PARTNERS)


@pytest.fixture
def read(spark, tmp_path):
    def make(columns, rows):
        make.n += 1
        return R.read_extract(spark, write_rows(tmp_path / f"in{make.n}.csv", rows), columns)

    make.n = 0
    return make


NATURES = [("2135", "Empresário (Individual)"), ("2062", "Sociedade Empresária Limitada"), ("4120", "Produtor Rural (Pessoa Física)"), ("0000", "Natureza Jurídica não informada")]
ROLES = [("49", "Sócio-Administrador"), ("50", "Empresário"), ("59", "Produtor Rural"), ("00", "Não informada")]
COUNTRIES = [("105", "BRASIL"), ("249", "ESTADOS UNIDOS")]


def test_extract_traps(spark, tmp_path):
    rows = [("0001", 'QUADRA 39;LOTE "07"'), ("02", "a\nb"), ("003", ""), ("4", "\x8fé")]
    got = R.read_extract(spark, write_rows(tmp_path / "x.csv", rows, "latin-1"), R.DOMAIN, encoding="ISO-8859-1").collect()
    assert [tuple(r) for r in got] == [("0001", 'QUADRA 39;LOTE "07"'), ("02", "a\nb"), ("003", None), ("4", "\x8fé")]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        R.read_extract(spark, write_rows(tmp_path / "y.csv", [("1", "2", "3")]), R.DOMAIN).collect()


def test_conversion(spark, tmp_path, read):
    assert R.convert_table(spark, "naturezas", write_rows(tmp_path / "n.csv", NATURES), str(tmp_path)) == 4
    assert R.read_table(spark, f"{tmp_path}/naturezas.parquet").count() == 4
    with pytest.raises(E.DuplicateCode, match="2062"):
        R.convert(read(R.DOMAIN, [*NATURES, ("2062", "x")]), f"{tmp_path}/naturezas.parquet", domain=True)
    with pytest.raises(E.BlankDescription):
        R.check_domain(read(R.DOMAIN, [("1", " ")]))
    assert R.read_table(spark, f"{tmp_path}/naturezas.parquet").count() == 4
    with pytest.raises(E.MissingInput):
        R.read_table(spark, f"{tmp_path}/nothing.parquet")
    with pytest.raises(E.InsufficientSpace):
        R.check_space(str(tmp_path), 1 << 60)


def slice_of(read, rows):
    table, counters = S.slice_by_state(read(R.ESTABLISHMENTS, rows), "SP")
    return {r.cnpj_basico: r.situacao_cadastral for r in table.collect()}, counters.first()


def test_slice(read):
    found, c = slice_of(read, [
        establishment(cnpj_basico="08314885", cnpj_ordem="0047"), establishment(cnpj_basico="08314885", cnpj_ordem="0051", situacao_cadastral="08"),
        establishment(cnpj_basico="11111111"), establishment(cnpj_basico="22222222", identificador_matriz_filial="2"), establishment(cnpj_basico="33333333", uf="RJ"),
    ])
    assert found == {"08314885": "02", "11111111": "02"} and (c.empresas, c.repetidas) == (2, 1)
    one = lambda *rows: slice_of(read, [establishment(cnpj_basico="11111111", cnpj_ordem=o, cnpj_dv=d, situacao_cadastral=s) for o, d, s in rows])[0]["11111111"]
    assert one(("0001", "98", "08"), ("0001", "11", "04")) == "04"
    assert one(("0001", "98", "08"), ("0001", "98", "02")) == "02"
    assert one(("0047", "98", "08"), ("0051", "74", "02")) == "08"
    with pytest.raises(E.EmptySlice):
        S.slice_by_state(read(R.ESTABLISHMENTS, [establishment(cnpj_basico="1", uf="RJ")]), "SP")


def test_companies(spark, read):
    the_slice = spark.createDataFrame([("08314885",), ("11111111",)], "cnpj_basico string")
    natures, roles = read(R.DOMAIN, NATURES), read(R.DOMAIN, ROLES)
    rows = [company("08314885", razao_social="FULANO 12345678901", porte=""), company("08314885", razao_social="", capital_social=""), company("11111111", natureza_juridica="9999"), company("99999999")]
    table, counters = S.type_companies(read(R.COMPANIES, rows), the_slice, natures, roles)
    got = {r.cnpj_basico: r for r in table.collect()}
    assert set(got) == {"08314885", "11111111"} and got["08314885"].razao_social == "FULANO [NUMERO SUPRIMIDO]" and got["08314885"].porte_descricao == "Não informado"
    assert str(got["11111111"].capital_social) == "1000.00" and got["11111111"].natureza_juridica_descricao is None
    c = counters.first()
    assert (c.empresas, c.cnpj_repetidos, c.nomes_suprimidos, c.natureza_sem_descricao) == (2, 1, 1, 1)
    with pytest.raises(E.MalformedCapital):
        S.type_companies(read(R.COMPANIES, [company("08314885", capital_social="1.000"), company("11111111")]), the_slice, natures, roles)
    with pytest.raises(E.MissingCompany, match="11111111"):
        S.type_companies(read(R.COMPANIES, [company("08314885")]), the_slice, natures, roles)


def test_partners(spark, read):
    the_slice = spark.createDataFrame([("11111111",)], "cnpj_basico string")
    rows = [
        partner("11111111"), partner("11111111", data_entrada_sociedade="00210823", qualificacao_socio="77"),
        partner("11111111", identificador_socio="3", cnpj_cpf_socio="", pais="249", nome_socio_ou_razao_social="1000000000 DELTA INC.", nome_representante="MARIA", representante_legal="***111111**"),
        partner("99999999"),
    ]
    table, counters = S.type_partners(read(R.PARTNERS, rows), the_slice, read(R.DOMAIN, ROLES), read(R.DOMAIN, COUNTRIES), "2026-06")
    got = table.collect()
    c = counters.first()
    assert len(got) == 3 and (c.vinculos, c.nomes_suprimidos, c.representantes_sem_documento, c.datas_invalidas) == (3, 1, 2, 1)
    assert (c.qualificacao_socio_sem_descricao, c.pais_sem_descricao, c.pais_ausente) == (1, 0, 2)
    foreign = next(r for r in got if r.identificador_socio == "3")
    assert foreign.cnpj_cpf_socio is None and foreign.identificador_socio_descricao == "Estrangeiro" and foreign.pais_descricao == "ESTADOS UNIDOS"
    assert foreign.nome_socio_ou_razao_social == "[NUMERO SUPRIMIDO] DELTA INC."


COLUMNS = "cnpj_basico string, identificador_socio string, nome_socio_ou_razao_social string, cnpj_cpf_socio string, qualificacao_socio string, pais string"


def identities_of(spark, rows, the_slice=("11111111", "22222222")):
    made = spark.createDataFrame(rows, COLUMNS)
    return P.identities(made, spark.createDataFrame([(x,) for x in the_slice], "cnpj_basico string"))


def test_identities(spark):
    table, _ = identities_of(spark, [
        ("11111111", "2", "JOSÉ  DA SILVA", "***456789**", "49", None), ("22222222", "2", "JOSE SILVA", "***456789**", "50", None),
        ("11111111", "2", "OUTRO", "***456789**", "49", None),
        ("11111111", "1", "X", "99999999000199", "22", None), ("22222222", "1", "X SA", "99999999000280", "22", None), ("22222222", "1", "A", "11111111000191", "22", None),
        ("11111111", "3", "SMITH", None, "49", "249"), ("11111111", "3", "SMITH", None, "49", "105"),
        ("11111111", "2", None, "***111118**", "49", None), ("22222222", "2", None, "***111118**", "49", None),
    ])
    rows = table.collect()
    assert sorted(r.confianca for r in rows) == sorted(["estimada"] * 2 + ["exata"] * 2 + ["fraca"] * 2 + ["nao_fundivel"] * 2)
    assert sorted(r.vinculos_no_recorte for r in rows if r.confianca == "estimada") == [1, 2]
    companies = {r.cnpj_basico: r for r in rows if r.confianca == "exata"}
    assert companies["99999999"].no_recorte is False and companies["11111111"].no_recorte is True and companies["99999999"].taxa_de_colisao is None


def test_collision_rate_by_hand(spark):
    rows = [("11111111", "2", n, m, "49", None) for n, m in (("FULANO", "***111118**"), ("FULANO", "***222218**"), ("DELTA ECHO", "***111118**"), ("GOLF HOTEL", "***333318**"))]
    table, rates = identities_of(spark, rows)
    assert [r.taxa_de_colisao for r in table.collect()] == [0.09375] * 4
    assert rates.first().fusoes == 0.375
    _, rates = identities_of(spark, [("11111111", "2", n, m, "49", None) for n, m in (("A", "***111118**"), ("B", "***222218**"), ("A", "***333318**"), ("A", "***333313**"))])
    assert {r.regiao: r.taxa_de_colisao for r in rates.collect()}["3"] == 0.0


def sound(spark):
    the_slice = spark.createDataFrame([(x, "02", "SP") for x in ("11111111", "22222222", "33333333")], "cnpj_basico string, situacao_cadastral string, uf string")
    companies = spark.createDataFrame([(x, "LTDA", 1.0) for x in ("11111111", "22222222", "33333333")], "cnpj_basico string, razao_social string, capital_social double")
    rows = [("11111111", "2", "A", "***456789**", "49", None), ("22222222", "2", "A", "***456789**", "49", None), ("22222222", "1", "C", "33333333000191", "22", None), ("33333333", "3", "S", None, "49", "249")]
    partners = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "date'2015-01-01' AS data_entrada_sociedade")
    return {"recorte": the_slice, "empresas": companies, "socios": partners, "identidades": P.identities(partners, the_slice)[0]}


def test_quality_gate(spark):
    tables = sound(spark)
    Q.verify(tables)
    broken = {
        "contato_nao_atravessa": tables | {"empresas": tables["empresas"].selectExpr("*", "'x' AS correio_eletronico")},
        "documento_foi_suprimido": tables | {"empresas": tables["empresas"].selectExpr("cnpj_basico", "'A 11144477735' AS razao_social", "capital_social")},
        "coluna_estruturada_tem_a_forma_declarada": tables | {"socios": tables["socios"].withColumn("cnpj_cpf_socio", tables["socios"].cnpj_basico)},
        "cadeia_de_conservacao": tables | {"empresas": tables["empresas"].limit(2)},
        "integridade_referencial": tables | {"identidades": tables["identidades"].where("confianca <> 'fraca'")},
        "chave_unica": tables | {"recorte": tables["recorte"].union(tables["recorte"])},
        "sem_nulo_no_obrigatorio": tables | {"recorte": tables["recorte"].selectExpr("cnpj_basico", "CAST(NULL AS STRING) AS situacao_cadastral", "uf")},
        "faixas_plausiveis": tables | {"empresas": tables["empresas"].selectExpr("cnpj_basico", "razao_social", "-1.0 AS capital_social")},
        "contagem_minima": tables | {"socios": tables["socios"].limit(0)},
    }
    for rule, bad in broken.items():
        with pytest.raises(E.QualityError, match=rule):
            Q.verify(bad)
    assert Q.forms_reject_documents(spark).count() == 0 and Q.forms_reject_documents(spark, {"x": "^[0-9]+$"}).count() > 0
    raw = spark.createDataFrame([("FULANO 11144477735",)], "n string")
    assert Q.instrument_detects(raw, "n") and not Q.instrument_detects(tables["empresas"], "razao_social")


def test_archives(tmp_path):
    archive = tmp_path / "Socios0.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("K3241.SOCIOCSV", "\x8fé;ç".encode("latin-1"))
    out = tmp_path / "out"
    out.mkdir()
    first = A.extract_period([str(archive)], str(out))
    assert (out / "Socios0.csv").read_text("utf-8") == "\x8fé;ç" and first["Socios0.csv"]["encoding"] == "utf-8"
    assert A.extract_period([str(archive)], str(out), keep=False) == first and not archive.exists()
    for bad in ("../x", "/x", "C:\\x", "a/../../x"):
        with pytest.raises(E.UnsafeArchive):
            A.check_member(bad, str(out))
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("a", b"x" * 1000)
    with pytest.raises(E.InsufficientSpace):
        A.extract(str(archive), str(out), free=1000)


def test_periods(spark):
    assert A.periods(["/a/2026-05/", "2026-06", "x", "2026-13"]) == ["2026-05", "2026-06"]
    with pytest.raises(E.InvalidConfiguration):
        A.check_period("2026-6")
    with pytest.raises(E.IncompletePeriod, match="and 1 more"):
        A.check_files("2026-06", A.EXPECTED[6:])
    assert A.check_files("2026-06", [*A.EXPECTED, "Simples.zip"]) == list(A.EXPECTED) and len(A.EXPECTED) == 36


def test_download_resumes_and_retries(tmp_path):
    content, calls, waits = b"0123456789" * 10, [], []

    def transport(name, at, etag):
        calls.append(at)
        if len(calls) == 1:
            return 503, False, iter(())
        if len(calls) == 2:
            def broken():
                yield content[:40]
                raise ConnectionError

            return 200, False, broken()
        return 206, True, iter([content[at:]])

    got = A.download(transport, "a.zip", str(tmp_path), 100, "e", waits.append)
    assert calls == [0, 0, 40] and waits == [1.0, 2.0] and got.sha256 == hashlib.sha256(content).hexdigest()
    entry = {"size": 100, "etag": "e", "sha256": got.sha256}
    path = str(tmp_path / "a.zip")
    assert A.is_cached(path, entry, 100, "e", complete=True) and not A.is_cached(path, entry, 100, "f")
    (tmp_path / "a.zip").write_bytes(b"x" * 100)
    assert A.is_cached(path, entry, 100, "e") and not A.is_cached(path, entry, 100, "e", complete=True)
    with pytest.raises(E.ChecksumMismatch):
        A.download(lambda *a: (200, False, iter([b"x"])), "b.zip", str(tmp_path), 2, None)
    with pytest.raises(E.TransientFailure):
        A.download(lambda *a: (503, False, iter(())), "c.zip", str(tmp_path), 2, None, waits.append)
    (tmp_path / "manifest.json").write_text("{broken")
    assert A.load_manifest(str(tmp_path / "manifest.json")) == {}


def test_inventory(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert [tuple(r) for r in A.inventory(spark, str(tmp_path)).collect()] == [("x.bin", 3, hashlib.sha256(b"abc").hexdigest())]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(2):
        write_rows(source / f"{k}.csv", [(f"{k}{i}", "x") for i in range(3)])
        R_stream = windows.arriving_extracts(spark, str(source), "motivos")
        windows.append_bronze(R_stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 3 * (k + 1)
    events = tmp_path / "events"
    spark.sql("SELECT 'a' AS client, timestamp'2026-01-01 00:00:10' AS ts FROM range(5) UNION ALL SELECT 'a', timestamp'2026-01-01 00:01:10' FROM range(2) UNION ALL SELECT 'b', timestamp'2026-01-01 00:00:59'").write.parquet(str(events))
    stream = windows.request_counts(spark.readStream.schema("client string, ts timestamp").parquet(str(events)), per_window=3)
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.client, r.n, r.refused) for r in spark.table("counts").collect()) == [("a", 2, 0), ("a", 5, 2), ("b", 1, 0)]
    assert os.path.isdir(tmp_path / "cp")
