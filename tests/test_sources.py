"""File formats, landing and table storage."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from lisura.operators import checks as CH
from lisura.operators import participants as PA
from lisura.sources import api_pages as AP
from lisura.sources import auctions as AU
from lisura.sources import delimited as D
from lisura.sources import landing as LA
from lisura.sources import purchases as PU
from lisura.sources import registry as RG
from lisura.sources import releases as RL
from lisura.sources import sanctions as SA
from lisura.sources import tables as TB


def test_delimited_files(spark, tmp_path):
    assert [D.pick_separator(h) for h in ("a;b,c", "a,b", "a\tb\tc,d", "a")] == [";", ",", "\t", ";"]
    path = tmp_path / "x.csv"
    path.write_text("﻿id;nome\n001;\"a;b\"\n2;c;extra\n3\n", encoding="utf-8")
    rows = [tuple(r) for r in D.read_delimited(spark, str(path)).collect()]
    assert rows == [("001", "a;b"), ("2", "c"), ("3", None)]


def test_purchases_end_to_end_and_repeat_landing(spark, tmp_path):
    head = "idCompra;anoCompraPncp;unidadeOrgaoCodigoIbge;orgaoEntidadeEsferaId;orgaoEntidadePoderId;dataPublicacaoPncp\n"
    (tmp_path / "c.csv").write_text(head + "C1;2024;3306305.0;M;E;2024-03-01\nC2;2024;3306305;M;Legislativo;2024-03-02\nC3;2025;9999999;M;E;2025-01-01\n")
    (tmp_path / "i.csv").write_text("idCompra;idCompraItem;numeroItemCompra;codFornecedor\nC1;;1;12345678901\nC1;L2;2;44555666000172\nC2;L3;1;x\n")
    heads, lines = (D.read_delimited(spark, str(tmp_path / n)) for n in ("c.csv", "i.csv"))
    rows = PU.purchase_rows(heads, lines)
    got = {(r.record_id, r.codfornecedor, r.year) for r in rows.collect()}
    assert got == {("C1:1", "***.456.789-**", 2024), ("L2", "44555666000172", 2024)}
    root = str(tmp_path / "root")
    day = F.to_date("datapublicacaopncp")
    first = LA.land_by_year(rows, root, "federal_purchases", (2024, 2025), day)
    before = LA.read_landed(spark, root, "federal_purchases")
    again = LA.land_by_year(rows.repartition(5), root, "federal_purchases", (2024, 2025), day)
    assert [r["new"] for r in first] == [True] and [r["new"] for r in again] == [False]
    assert first[0]["snapshot_id"] == again[0]["snapshot_id"] and str(first[0]["partition_date"]) == "2024-03-01"
    after = LA.read_landed(spark, root, "federal_purchases")
    assert CH.same_content(before, after).first().unchanged and after.count() == 2
    wider = rows.withColumn("novo", F.lit("z"))
    LA.land_by_year(wider, root, "federal_purchases", (2024,), day)
    both = LA.landed_records(LA.read_landed(spark, root, "federal_purchases"))
    assert both.count() == 4 and both.where("novo is null").count() == 2
    assert LA.read_manifests(spark, root).count() == 2


def test_registry_layout(spark, tmp_path):
    (tmp_path / "e.csv").write_bytes("11222333;PAPÉIS LTDA;2062;50;1000,00;03;\n99;FORA;;;;;\n".encode("iso-8859-1"))
    (tmp_path / "s.csv").write_text("11222333;1;81;1;X;02\n99;1;1;1;Y;02\n")
    (tmp_path / "p.csv").write_text("11222333;2;JOAO;12345678901;49\n")
    read = {k: RG.read_registry(spark, k, str(tmp_path / f)) for k, f in (("empresas", "e.csv"), ("estabelecimentos", "s.csv"), ("socios", "p.csv"))}
    roots = RG.company_roots(spark.createDataFrame([("11.222.333/0001-81", "12345678901")], "fornecedor_cnpj string, nifornecedor string"))
    est, partners = RG.registry_tables(*read.values(), roots)
    assert [(r.cnpj, r.razao_social) for r in est.collect()] == [("11222333000181", "PAPÉIS LTDA")]
    assert [r.cnpj_cpf_do_socio for r in partners.collect()] == ["***.456.789-**"]


def test_pipe_tables_with_and_without_headers(spark, tmp_path):
    mark = "89550032000174|01/01/2014|31/12/2014|31/01/2015|X|4\n"
    (tmp_path / "ITEM_PROP.TXT").write_text(mark + "42|2014|CNC|J|03722885000120|1|1||||100,00|5493164,86|||C||H\n42|2014|CNC|F|12345678901|1|1||||50,00|1500,00|||C||H\n")
    (tmp_path / "PROPOSTA.TXT").write_text(mark + "42|2014|CNC|J|91549055000100|15/10/2014|D|7,5||||\n43|2014|CNC|J|91549055000100|15/10/2014|D|8,5||||\n")
    (tmp_path / "LICITACAO.TXT").write_text(mark + "NR_DOCUMENTO_VENCEDOR|NR_LICITACAO|ANO_LICITACAO|CD_TIPO_MODALIDADE\n03722885000120|42|2014|CNC\n")
    (tmp_path / "PESSOAS.TXT").write_text("ignored|x\n")
    tables = AU.read_pipe_tables(spark, str(tmp_path / "*.TXT"))
    assert {(r._table, r["count"]) for r in tables.groupBy("_table").count().collect()} == {
        ("ITEM_PROPOSTA", 2), ("PROPOSTA", 2), ("LICITACAO", 1)}
    assert {r._table for r in AU.missing_tables(tables).collect()} == {"LICITANTE", "LOTE_PROPOSTA"}
    people = {(r.licitacaoId, r.itemLote, r.participante, float(r.proposta), r.winner) for r in PA.from_state_two(tables).collect()}
    assert people == {
        ("42/2014/CNC", "1/1", "03722885000120", 5493164.86, True), ("42/2014/CNC", "1/1", "***.456.789-**", 1500.0, False),
        ("43/2014/CNC", "", "91549055000100", 8.5, False)}


def test_pipe_tables_with_quotes(spark, tmp_path):
    (tmp_path / "LOTE.TXT").write_text('42|2014|CNC|"1|a"|J|03722885000120\n43|2014|CNC|"say ""b"""|J|1\n')
    (tmp_path / "ITEM.TXT").write_text('44|2014|CNC|"two\nlines"|9|J|1\n')
    one = AU.read_pipe_tables(spark, str(tmp_path / "LOTE.TXT"))
    assert {(r.NR_LICITACAO, r.NR_LOTE) for r in one.collect()} == {("42", "1|a"), ("43", 'say "b"')}
    both = AU.read_pipe_tables(spark, str(tmp_path / "*.TXT"), multi_line=True)
    assert {(r._table, r.NR_LOTE) for r in both.collect()} == {("LOTE", "1|a"), ("LOTE", 'say "b"'), ("ITEM", "two\nlines")}


def test_separators_may_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y\n1;"two\nlines"\n')
    (tmp_path / "b.csv").write_text("x,z\n2,3\n")
    rows = D.read_delimited(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], multi_line=True)
    assert {tuple(r) for r in rows.select("x", "y", "z").collect()} == {("1", "two\nlines", None), ("2", None, "3")}


def test_state_one_slice(spark):
    cols = list(AU.STATE_ONE_COLUMNS)
    rows = [[city] + ["x"] * 20 for city in ("BAURÚ", "3506003", "Outra")]
    assert AU.state_one_rows(spark.createDataFrame(rows, cols)).count() == 2


def test_releases_and_pages(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(
        json.dumps({"ocid": "ocds-914jxj-A", "id": "1", "date": "2024", "tag": ["tender", "award"], "tender": {"id": "1", "description": "d"}, "awards": [{"id": 1}]})
        + "\n" + json.dumps({"ocid": "Z", "id": "2", "date": "2024", "tag": []}) + "\n")
    rel = RL.read_releases(spark, str(tmp_path / "r.jsonl"))
    assert {(r.ocid, r.tag, r.tender_title, r.has_tender, r.has_awards, r.schema_ok) for r in rel.collect()} == {
        ("ocds-914jxj-A", "tender,award", "d", True, True, True), ("Z", "", "", False, False, False)}
    for d in ("pages", "items", "results"):
        (tmp_path / d).mkdir()
    contract = {"numeroControlePNCP": "k", "anoCompra": 2024, "sequencialCompra": 1, "orgaoEntidade": {"cnpj": "29477000000180"}}
    (tmp_path / "pages/p1.json").write_text(json.dumps({"data": [contract, {**contract, "numeroControlePNCP": "k2", "sequencialCompra": 2}]}, indent=1))
    (tmp_path / "items/29477000000180_2024_1.json").write_text(json.dumps([{"numeroItem": 1, "temResultado": True}, {"numeroItem": 2, "temResultado": False}], indent=1))
    (tmp_path / "results/29477000000180_2024_1_1.json").write_text(json.dumps([{"sequencialResultado": 7, "niFornecedor": "9"}, {"sequencialResultado": 8}], indent=1))
    out = AP.contract_rows(*(f(spark, str(tmp_path / d)) for f, d in ((AP.read_pages, "pages"), (AP.read_items, "items"), (AP.read_results, "results"))))
    assert {r.record_id for r in out.collect()} == {"k:1:7", "k:1:8", "k:2:0", "k2:0:0"}


def test_registers_must_both_be_present(spark):
    names = ["CADASTRO", "CPF OU CNPJ DO SANCIONADO", "CÓDIGO DA SANÇÃO", "DATA INÍCIO SANÇÃO", "DATA FINAL SANÇÃO"]
    one = spark.createDataFrame([("", "44555666000172", "S", "01/01/2024", "")], names)
    none = spark.createDataFrame([], one.schema)
    rows = SA.sanction_rows(one, none)
    assert rows.first()["CADASTRO"] == "CEIS" and [r.register for r in SA.missing_registers(rows).collect()] == ["CNEP"]


def _content(listed):
    return {r["folder"]: sorted((p.name, p.read_bytes()) for p in Path(r["folder"].removeprefix("file:")).iterdir()) for r in listed}


def test_upserts_rewrite_touched_ranges_only(spark, tmp_path):
    root, keys = str(tmp_path), ["k", "j"]

    def merge(old, new):
        return new if old is None else old.join(new, keys, "left_anti").unionByName(new)

    def rows(pairs):
        return spark.createDataFrame([(f"{k:05d}", j, t) for k, j, t in pairs], "k string, j int, t string")

    assert TB.read_table(spark, root, "t") is None and TB.ranges(spark, root, "t") == []
    first = [(k, 1, "a") for k in range(1000)] + [(5, None, "a")]
    TB.upsert_table(rows(first), root, "t", keys, merge, range_rows=100)
    one = TB.ranges(spark, root, "t")
    assert len(one) > 5 and sum(r["rows"] for r in one) == 1001
    before = _content(one)
    # Two neighbouring keys, one new and one known, and one below all others.
    got = TB.upsert_table(rows([(500, 1, "b"), (500, 2, "b"), (-1, 1, "b")]), root, "t", keys, merge, range_rows=100)
    two = TB.ranges(spark, root, "t")
    same = {r["folder"] for r in one} & {r["folder"] for r in two}
    assert len(same) >= len(one) - 2 and {f: c for f, c in before.items() if f in same} == {f: c for f, c in _content(two).items() if f in same}
    want = {(f"{k:05d}", j, t) for k, j, t in first if (k, j) != (500, 1)} | {("00500", 1, "b"), ("00500", 2, "b"), ("-0001", 1, "b")}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    # A range that grows is cut; every key is found in its range again.
    got = TB.upsert_table(rows([(500, j, "c") for j in range(400)]), root, "t", keys, merge, range_rows=100)
    three = TB.ranges(spark, root, "t")
    assert len(three) > len(two) and got.count() == len(want) + 398 and max(r["rows"] for r in three) <= 200
    lows = [r["low"] for r in three]
    placed = got.withColumn("r", TB.range_of(TB.key_text(keys), lows)).groupBy("r").count().collect()
    assert {r["r"]: r["count"] for r in placed} == {i: r["rows"] for i, r in enumerate(three)}
    # Nothing to merge leaves the version; a lost job (data without a list) is not seen and can be repeated.
    TB.upsert_table(rows([]), root, "t", keys, merge)
    assert [r["version"] for r in TB.ranges(spark, root, "t")] == [3] * len(three)
    rows([(1, 1, "lost")]).write.parquet(f"{root}/t/v=4/_range=0")
    assert TB.read_table(spark, root, "t").where("t = 'lost'").isEmpty()
    wider = rows([(700, 1, "d")]).withColumn("extra", F.lit("x"))
    grown = TB.upsert_table(wider, root, "t", keys, lambda old, new: old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True))
    assert grown.where("extra = 'x'").count() == 1 and grown.count() == got.count()


def test_number_of_ranges_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(TB, "MOST_RANGES", 20, raising=False)
    root, keys = str(tmp_path), ["k"]

    def merge(old, new):
        return new if old is None else old.join(new, keys, "left_anti").unionByName(new)

    def rows(numbers, text):
        return spark.createDataFrame([(f"{k:05d}", text) for k in numbers], "k string, t string")

    TB.upsert_table(rows(range(0, 2000, 2), "a"), root, "t", keys, merge, range_rows=5)
    assert 10 <= len(TB.ranges(spark, root, "t")) <= 40
    got = TB.upsert_table(rows(range(0, 2000, 3), "b"), root, "t", keys, merge, range_rows=5)
    listed = TB.ranges(spark, root, "t")
    assert 10 <= len(listed) <= 40 and sum(r["rows"] for r in listed) == got.count()
    assert {tuple(r) for r in got.collect()} == {
        (f"{k:05d}", "a" if k % 3 else "b") for k in range(2000) if k % 2 == 0 or k % 3 == 0}
    placed = got.withColumn("r", TB.range_of(TB.key_text(keys), [r["low"] for r in listed])).groupBy("r").count().collect()
    assert {r["r"]: r["count"] for r in placed} == {i: r["rows"] for i, r in enumerate(listed)}


def test_refreshed_tables(spark, tmp_path):
    root = str(tmp_path)
    TB.write_table(spark.range(3), root, "t", ["id"])
    TB.write_table(TB.read_table(spark, root, "t").where("id > 0"), root, "t", ["id"])
    assert TB.read_table(spark, root, "t").count() == 2


def test_snapshots_are_read_by_their_list(spark, tmp_path):
    root = str(tmp_path)
    a = spark.createDataFrame([("1", "x", 2024), ("2", "y", 2025)], "record_id string, a string, year int")
    b = spark.createDataFrame([("3", "z", 2024)], "record_id string, b string, year int")
    assert LA.read_landed(spark, root, "s") is None
    LA.land_by_year(a, root, "s", (2024, 2025))
    LA.land_by_year(b, root, "s", (2024,), writer="me")
    spark.range(5).write.parquet(f"{LA.data_path(root, 's')}/year=2024/date=2024-12-31/snapshot_id=lost")
    got = LA.read_landed(spark, root, "s")
    assert {(r.record_id, r.a, r.b, r._year) for r in got.collect()} == {("1", "x", None, 2024), ("2", "y", None, 2025), ("3", None, "z", 2024)}
    assert LA.read_landed(spark, root, "s", not_by="me").count() == 2
    again = LA.land_by_year(a.unionByName(a.limit(0)), root, "s", (2024, 2025))
    assert [r["new"] for r in again] == [False, False]


def test_many_files_of_different_headers(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.csv").write_text(("id;nome\n" if i % 2 else "id,valor\n") + f"{i}{';' if i % 2 else ','}x\n" * 3)
    (tmp_path / "empty.csv").write_text("")
    rows = D.read_delimited(spark, str(tmp_path / "*.csv"))
    assert rows.columns == ["id", "valor", "nome"] and rows.count() == 18
    assert rows.where("nome = 'x'").count() == 9
