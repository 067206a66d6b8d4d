import unicodedata

import pytest
from pyspark.sql import functions as F

from ownergraph.functions import decoding as D
from ownergraph.functions import documents as N
from ownergraph.functions import identity as I


def values(spark, texts, expression, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}").select("i", expression(F.col("x")).alias("y"))
    return [r.y for r in rows.orderBy("i").collect()]


def test_cpf(spark):
    good = ["11144477735", "22255588846", "01234567890", "00123456797"]
    bad = ["11144477736", "11111111111", "00123456789", "12345678999", "12345678901", "0011144477", "abcdefghijk", "", None]
    assert values(spark, good + bad, N.cpf_valid) == [True] * 4 + [False] * 9


MARK = "[NUMERO SUPRIMIDO]"


def test_suppression(spark):
    cases = {
        "FULANO DE TAL 12345678901": f"FULANO DE TAL {MARK}",
        "BELTRANO ALFA 123.456.789-01": f"BELTRANO ALFA {MARK}",
        "BELTRANO ALFA 123.456.789.01": f"BELTRANO ALFA {MARK}",
        "BELTRANO ALFA 123 456 789 01": f"BELTRANO ALFA {MARK}",
        "FULANO DE TAL 1234567890": f"FULANO DE TAL {MARK}",
        "12345678000199 LTDA": f"{MARK} LTDA",
        "FULANO DE TAL CPF 222555888-46": f"FULANO DE TAL CPF {MARK}",
        "BELTRANO ALFA C P F 222555888 46": f"BELTRANO ALFA C P F {MARK}",
        "CONTRATO 123456789-99 LTDA": "CONTRATO 123456789-99 LTDA",
        "SICRANO BRAVO 123456797": f"SICRANO BRAVO {MARK}",
        "1000000000 DELTA INC.": f"{MARK} DELTA INC.",
        "BELTRANO ALFA CHARLIE": "BELTRANO ALFA CHARLIE",
        "": "",
        None: None,
    }
    assert values(spark, list(cases), N.suppress_documents) == list(cases.values())
    again = values(spark, [v for v in cases.values()], N.suppress_documents)
    assert again == list(cases.values())


def test_company_numbers(spark):
    bases = {"112223330001": "81", "111111110001": "91", "222222220001": "91", "333333330001": "91", "003603050001": "04", "123": None}
    assert values(spark, list(bases), N.cnpj_check_digits) == list(bases.values())
    texts = ["11.222.333/0001-81", "11222333000181", "  11222333000181 ", "1122233", "1122233300018", "112223330001811", "11222333000180", "1122233300018a", None]
    parsed = values(spark, texts, N.cnpj_parse)
    assert [p.valid for p in parsed] == [True] * 3 + [False] * 6
    assert [p.error for p in parsed[3:]] == ["shape", "shape", "shape", "verifier", "shape", "shape"]
    assert (parsed[0].basico, parsed[0].ordem, parsed[0].verificador) == ("11222333", "0001", "81")
    assert values(spark, [11222333, 360305], N.cnpj_format, "long") == ["11.222.333/0001-81", "00.360.305/0001-04"]


def plain_name(name):
    flat = unicodedata.normalize("NFKD", name or "").encode("ascii", "ignore").decode()
    return " ".join(w for w in flat.upper().split() if w not in I.PARTICLES) or None


def test_names(spark):
    names = ["MARIA DA CONCEIÇÃO", "JOSE MÜLLER", "a\tb\n c  d", "DANIEL SANTOS", "EDUARDO LIMA", "DA DE E", "", "  ", None, "João dos Santos e Silva", "Ñandú Ōsaka Žižek", "Das Das Dasa"]
    assert values(spark, names, I.normalise_name) == [plain_name(n) for n in names]


def test_keys(spark):
    assert values(spark, ["12345678"], I.company_id) == ["fbde27087752bead"]


def test_dates_and_amounts(spark):
    date = lambda c: D.guarded_date(c, D.last_day("2026-06")).cast("string")
    texts = ["20150312", "00210823", "00000000", "20261231", "2015031", "20260630", "19000101", "18991231", "", None, "20151301"]
    assert values(spark, texts, date) == ["2015-03-12", None, None, None, None, "2026-06-30", "1900-01-01", None, None, None, None]
    assert [None if v is None else str(v) for v in values(spark, ["1000,00", "0,05", "1000.00", "1,0", "", None], D.comma_decimal)] == ["1000.00", "0.05", None, None, None, None]


def test_legends(spark):
    assert values(spark, ["01", "02", " ", None, "05"], D.size_class) == ["Micro empresa", None, "Não informado", "Não informado", "Demais"]
    assert values(spark, ["1", "9", None], lambda c: D.decode(c, D.PARTNER_TYPES)) == ["Pessoa jurídica", None, None]
    assert values(spark, ["***000000**", "***456789**"], D.placeholder_to_null) == [None, "***456789**"]


def test_thousands(spark):
    assert values(spark, [3154, 19770618, 7], D.thousands, "long") == ["3.154", "19.770.618", "7"]


def test_decimal_texts_are_those_of_sql(spark):
    import duckdb

    given = [
        -0.0, -0.001, 0.005, 1.005, 2.675, 8276.845, -326.155, 0.28500000000000003, 0.49999999999999994, -999.99, 1234567.125, 123456789012345.67, 4503599627370497.5,
        2.0**45 + 0.33, 1e15, 2.0**53 + 2, 3.4e19, -4.989622584012291e30, 8e37, 7.0, None, float("nan"), float("inf"), float("-inf"),
    ]
    sql = "SELECT replace(replace(replace(format('{:,.2f}', round(?::DOUBLE, 2)), ',', '#'), '.', ','), '#', '.')"
    assert values(spark, given, D.decimal, "double") == [duckdb.execute(sql, [v]).fetchone()[0] for v in given]


@pytest.mark.parametrize(("proxies", "sent", "want"), [(1, "1.1.1.1, 2.2.2.2", "2.2.2.2"), (2, "1.1.1.1, 2.2.2.2", "1.1.1.1"), (0, "1.1.1.1", "9.9.9.9"), (1, "", "9.9.9.9"), (2, "2.2.2.2", "9.9.9.9"), (1, None, "9.9.9.9")])
def test_clients(spark, proxies, sent, want):
    assert values(spark, [sent], lambda c: D.client_of(c, F.lit("9.9.9.9"), proxies)) == [want]


def test_attributes(spark):
    rows = spark.createDataFrame([(k, c, s) for k in range(3) for c in range(4) for s in (True, False, None)], "k int, c int, s boolean")
    back = rows.withColumn("u", D.unpack_attributes(D.pack_attributes(F.col("k"), F.col("c"), F.col("s"))))
    assert back.where("u.kind <> k OR u.confidence <> c OR NOT (u.in_slice <=> s)").count() == 0
