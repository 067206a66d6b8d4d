import io
import json
import logging
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ownergraph import cli, monitoring
from ownergraph import errors as E
from ownergraph.operators import artefacts as A
from ownergraph.operators import components as C
from ownergraph.operators import graph as G
from ownergraph.operators import service as V
from ownergraph.sources import archives, registry, share, sinks


@pytest.fixture(scope="module")
def small(spark):
    """Five nodes, a triangle with a tail; every node of another kind."""
    rows = [(i, f"0000000{i}", k, f"N {i}\n\\é", c, s, r, x) for i, (k, c, s, r, x) in enumerate([
        ("pessoa_juridica", "exata", True, None, None), ("pessoa_fisica", "estimada", None, "8", 0.5), ("estrangeiro", "fraca", None, None, None),
        ("pessoa_juridica", "exata", False, None, None), ("pessoa_fisica", "estimada", None, "8", 0.5),
    ])]
    nodes = spark.createDataFrame(rows, "idx long, cnpj_basico string, tipo string, nome string, confianca string, no_recorte boolean, regiao_fiscal string, taxa_de_colisao double")
    links = spark.createDataFrame([(0, 1, "49"), (0, 2, "22"), (1, 2, None), (2, 3, "5"), (3, 4, "7")], "no_empresa long, no_socio long, qualificacao_socio string")
    exists = spark.createDataFrame([(1,), (5,), (9,)], "cnpj int")
    return nodes, links, C.canonical_components(nodes, G.adjacency(links)), exists


def test_artefacts_are_opened_as_they_were_written(spark, small, tmp_path):
    folder = f"file://{tmp_path}/a"
    rows = A.write_artefacts(*small, folder, "2026-06")
    assert rows == {"catalogo": 5, "taxas": 1, "existencia": 3, "offsets": 5, "adjacencia": 10, "componentes": 5, "nomes": 5}
    found = A.open_artefacts(spark, folder, "2026-06")
    told = {r.idx: r for r in A.look_up(small[0].select("idx"), found["catalogo"], sinks.read_names(found["nomes"]), found["taxas"]).collect()}
    for r in small[0].collect():
        assert (told[r.idx].cnpj, told[r.idx].tipo, told[r.idx].nome, told[r.idx].confianca, told[r.idx].no_recorte, told[r.idx].taxa_de_colisao) == (
            r.cnpj_basico, r.tipo, r.nome, r.confianca, r.no_recorte, r.taxa_de_colisao)
    with pytest.raises(E.IncompatibleArtefacts, match="2026-06"):
        A.open_artefacts(spark, folder, "2026-07")
    found["componentes"].where("idx < 4").write.mode("overwrite").parquet(f"{folder}/other")
    sinks.put_in_place(spark, f"{folder}/other", f"{folder}/componentes.parquet")
    with pytest.raises(E.IncompatibleArtefacts, match="componentes"):
        A.open_artefacts(spark, folder)
    with pytest.raises(E.IncompatibleArtefacts, match="has not all"):
        A.open_artefacts(spark, f"file://{tmp_path}/nothing")


def test_refusals(spark, small):
    nodes, links, _, _ = small
    with pytest.raises(E.RateMismatch):
        A.region_rates(nodes.withColumn("taxa_de_colisao", F.when(F.col("idx") == 4, 0.25).otherwise(F.col("taxa_de_colisao"))))
    with pytest.raises(E.RateMismatch):
        A.check_rates(nodes, A.region_rates(nodes).withColumn("taxa_de_colisao", F.lit(0.1)))
    names = nodes.select("idx", "nome")
    with pytest.raises(E.NameMismatch):
        sinks.check_names(names, sinks.name_blocks(names.withColumn("nome", F.when(F.col("idx") == 2, "x").otherwise(F.col("nome")))))
    with pytest.raises(E.InconsistentArtefacts, match="4"):
        A.check_twins(nodes, nodes.where("idx < 4"), "idx", "cnpj_basico")
    A.check_twins(nodes, nodes, "idx", "cnpj_basico")
    adj = G.adjacency(links)
    offsets = G.offsets(G.degrees(adj, nodes))
    with pytest.raises(E.UnorderedExistence):
        A.check_existence_order(_written(spark, [(5,), (1,)]))
    A.check_existence_order(_written(spark, [(1,), (5,)]))
    assert offsets.count() == 5


def _written(spark, rows):
    import tempfile

    path = f"file://{tempfile.mkdtemp()}/e"
    spark.createDataFrame(rows, "cnpj int").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_layout_faults(spark, small, tmp_path):
    nodes, links, _, _ = small
    adj, offsets = G.adjacency(links), G.offsets(G.degrees(G.adjacency(links), nodes))
    sinks.write_sorted(adj.select("src", "dst", "role"), f"file://{tmp_path}/adj", ["src", "dst"])
    good = spark.read.parquet(f"file://{tmp_path}/adj")
    A.check_layout(offsets, good)
    with pytest.raises(E.IncompatibleArtefacts):
        A.check_layout(offsets.withColumn("offset", F.col("offset") + (F.col("idx") == 2).cast("int")), good)
    adj.orderBy(F.desc("src")).coalesce(1).write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(E.UnorderedNeighbours):
        A.check_layout(offsets, spark.read.parquet(f"file://{tmp_path}/bad"))


def test_arrays_and_blocks(spark, tmp_path):
    rows = spark.range(0, 1000).select(F.col("id").alias("idx"), (F.col("id") * 7 % 13).alias("v")).repartition(5)
    assert sinks.write_array(rows, "idx", "v", str(tmp_path / "v.npy"), "<i4") == 1000
    assert (np.load(tmp_path / "v.npy") == np.arange(1000) * 7 % 13).all()
    back = {r.idx: r.v for r in sinks.read_array(spark, str(tmp_path / "v.npy"), "v", 64).collect()}
    assert back == {i: i * 7 % 13 for i in range(1000)}
    names = spark.createDataFrame([(i, None if i == 3 else "" if i == 4 else "a\\nb" if i == 5 else "é\n" * i) for i in range(300)], "idx long, nome string")
    blocks = sinks.name_blocks(names, 512)
    assert blocks.count() > 20
    sinks.check_names(names, blocks)
    assert sinks.read_names(sinks.name_blocks(names.limit(0))).count() == 0


def test_neighbourhood_answer(spark, small):
    nodes, links, _, _ = small
    catalogue = nodes.where("tipo = 'pessoa_juridica'").select(F.col("cnpj_basico").alias("cnpj"), "idx")
    exists = spark.createDataFrame([("00000000",), ("00000003",), ("00000077",)], "cnpj string")
    asked = spark.createDataFrame([(1, "00000000"), (2, "00000077"), (3, "99999999")], "request int, cnpj string")
    head, shown, edges = V.neighbourhood_answers(asked, catalogue, exists, nodes.withColumn("cnpj_basico", F.when(F.col("tipo") == "pessoa_juridica", F.col("idx"))), G.adjacency(links), 1, 10)
    told = {r.request: r for r in head.collect()}
    assert told.keys() == {1, 2} and not told[2].tem_vinculo and told[2].saltos == 0 and told[1].explicacao == "3 nós, até 1 salto; nada ficou fora."
    assert sorted((r.request, r.position, r.profundidade, r.rotulo) for r in shown.collect()) == [(1, 0, 0, None), (1, 1, 1, "Sócio 2"), (1, 2, 1, "Sócio 3")]
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 0, 1), (1, 0, 2), (1, 1, 2)]
    head, shown, _ = V.neighbourhood_answers(asked, catalogue, exists, nodes.withColumn("cnpj_basico", F.col("idx")), G.adjacency(links), 2, 2)
    r = head.where("request = 1").first()
    assert r.truncada and r.nivel_recusado == 2 and "ficou fora inteiro" in r.explicacao and shown.count() == 1


PROPFIND = b"""<?xml version="1.0"?><d:multistatus xmlns:d="DAV:">
<d:response><d:href>/dav/</d:href><d:propstat><d:prop><d:resourcetype><d:collection/></d:resourcetype></d:prop></d:propstat></d:response>
<d:response><d:href>/dav/2026-06/</d:href><d:propstat><d:prop><d:resourcetype><d:collection/></d:resourcetype></d:prop></d:propstat></d:response>
<d:response><d:href>/dav/2026-05/</d:href><d:propstat><d:prop><d:resourcetype><d:collection/></d:resourcetype></d:prop></d:propstat></d:response>
<d:response><d:href>/dav/2026-13/</d:href><d:propstat><d:prop><d:resourcetype><d:collection/></d:resourcetype></d:prop></d:propstat></d:response>
<d:response><d:href>/dav/2026-04</d:href><d:propstat><d:prop><d:resourcetype/><d:getcontentlength>6</d:getcontentlength><d:getetag>"x"</d:getetag></d:prop></d:propstat></d:response>
</d:multistatus>"""


class Answer(io.BytesIO):
    status = 200


def test_share(tmp_path):
    asked = []

    def opener(request):
        asked.append((request.get_method(), request.full_url, request.headers))
        if request.get_method() == "PROPFIND":
            return Answer(PROPFIND)
        answer = Answer(b"abcdef"[int(request.headers.get("Range", "bytes=0-")[6:-1]) :])
        answer.status = 206 if "Range" in request.headers else 200
        return answer

    source = share.Share("https://example.com/dav/", "tok", opener)
    assert source.periods() == ["2026-05", "2026-06"]
    assert asked[0][2]["Authorization"] == "Basic dG9rOg==" and asked[0][2]["Depth"] == "1"
    assert source.files("2026-06") == {"2026-04": (6, '"x"')}
    (tmp_path / "f.partial").write_bytes(b"abc")
    got = archives.download(source.transport("2026-06"), "f", str(tmp_path), 6, '"x"')
    assert (tmp_path / "f").read_bytes() == b"abcdef" and got.sha256 == archives.sha256_of(str(tmp_path / "f"))
    assert asked[-1][2]["Range"] == "bytes=3-" and asked[-1][2]["If-range"] == '"x"'
    manifest = archives.download_period(source.transport("2026-06"), {"f": (6, '"x"'), "g": (6, None)}, str(tmp_path))
    assert manifest["f"]["sha256"] == manifest["g"]["sha256"]


def test_space(tmp_path):
    import zipfile

    for name in ("A.zip", "B.zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(name, b"x" * 1000)
    both = [str(tmp_path / "A.zip"), str(tmp_path / "B.zip")]
    assert archives.space_needed(both, str(tmp_path), {}) == 2200
    assert archives.space_needed(both, str(tmp_path), {}, keep=False) == max(1100, 2200 - os.path.getsize(both[0]))
    (tmp_path / "A.csv").write_bytes(b"x" * 1000)
    assert archives.space_needed(both, str(tmp_path), {"A.csv": {"archive": "A.zip", "name": "A.csv"}}) == 1100
    with pytest.raises(E.InsufficientSpace):
        archives.extract_period(both, str(tmp_path), free=100)


def test_log_and_errors(tmp_path):
    run = monitoring.start_log(str(tmp_path / "log"), run_id="abc")
    log = logging.getLogger("ownergraph.test")
    log.info("done %d", 3, extra={"rows": 5})
    status, body = monitoring.answered(lambda: 1 / 0)
    lines = [json.loads(x) for x in (tmp_path / "log").read_text().splitlines()]
    assert run == "abc" and lines[0]["message"] == "done 3" and lines[0]["rows"] == 5 and lines[0]["run_id"] == "abc"
    assert status == 500 and len(body["correlacao"]) == 12 and lines[1]["correlacao"] == body["correlacao"] and "ZeroDivisionError" in lines[1]["exception"]
    assert monitoring.answered(lambda: 7) == (200, 7)

    def refuse(kind):
        raise kind("no")

    assert monitoring.answered(lambda: refuse(E.InvalidRequest))[0] == 422 and monitoring.answered(lambda: refuse(E.MissingInput))[0] == 503


def test_memory_and_stages(tmp_path):
    assert monitoring.resident_bytes() > 1 << 20 and monitoring.resident_bytes(proc=str(tmp_path)) is None
    settled = [(k, 100 << 20) for k in range(1000, 4000, 250)]
    assert monitoring.plateau(settled) and not monitoring.plateau(settled[:6]) and not monitoring.plateau([(k, k << 12) for k, _ in settled])
    done, samples = monitoring.soak(lambda k: k, iter(range(10_000)))
    assert done and samples
    stages = monitoring.Stages(0.01)
    with stages.stage("one"):
        sum(range(10**6))
    assert stages.done[0].peak_bytes >= stages.done[0].entry_bytes > 0 and "| one |" in stages.report() and stages.as_rows()[0]["name"] == "one"


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "Cnaes.csv").write_text('"1";"a"\n"2";"b"\n')
    assert registry.convert_folder(spark, "cnaes", str(tmp_path), str(tmp_path / "out")) == 2
    assert registry.convert_folder(spark, "cnaes", str(tmp_path), str(tmp_path / "out")) == 2  # put in place of the first
    with pytest.raises(E.MissingInput):
        registry.convert_folder(spark, "socios", str(tmp_path), str(tmp_path / "out"))
    assert registry.chosen("principais") == ["estabelecimentos", "empresas", "socios"] and len(registry.chosen("tudo")) == 9
    assert cli.main(["--log", str(tmp_path / "l"), "query", "nothing", "--input", str(tmp_path)]) == 1
    assert cli.resolve_period(None, ["2026-05", "2026-06"]) == "2026-06"
    with pytest.raises(E.IncompletePeriod):
        cli.resolve_period(None, [])
    assert cli.progress(1, 2, "x", terminal=False) == "x: 1 of 2" and "50%" in cli.progress(1, 2, "x", terminal=True)
