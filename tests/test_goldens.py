"""Small planted frames with exact expected results."""

import datetime as dt
import random
import re
import unicodedata
from decimal import Decimal

from pyspark.sql import functions as F

from lisura.functions import fixed
from lisura.functions import text as X
from lisura.operators import exclusions as EX
from lisura.operators import flags as FL
from lisura.operators import graph as G
from lisura.operators import normalize as N
from lisura.operators import participants as PA
from lisura.operators import screens as SC
from lisura.operators import search as SE
from lisura.operators import search_index as SI
from lisura.operators.units import match_units


def test_fold_equals_plain_version_for_every_character(spark):
    def plain(text):
        bare = "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x))
        return re.sub(r"\s+", " ", bare).strip()

    codes = [c for c in range(1, 0x110000) if not 0xAC00 <= c < 0xE000 and c not in (0xFDD0, 0xFDD1)]
    every = [f"x{chr(c)}\n{chr(c)}" for c in codes if unicodedata.category(chr(c)) != "Cn"]
    texts = [*every, "5 ㎎ e 10 ㏄, ½ dose ﬁna…™ Ação №7", "㎎" * 3000, "", "㌖ \ufdfa"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(8, "i")
    got = dict(df.select("i", F.trim(F.regexp_replace(X.unaccent("t"), X.BLANK, " "))).collect())
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != plain(t)] == []
    assert dict(df.select("i", X.fold("t")).collect())[len(every)] == "5 mg e 10 cc, 1⁄2 dose fina...tm acao no7"


def test_decimal_date_and_fold_forms(spark):
    texts = ["1.234,56", "1,234.56", "12,5", "1.5", " - ", "nan", "", "1,2,3", "abc"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.parse_decimal("t")).collect()]
    assert got == [Decimal("1234.56"), Decimal("1234.56"), Decimal("12.5"), Decimal("1.5"), *[None] * 5]
    days = ["2024-03-15", "15/03/2024", "20240315", "15/03/2024 10:20:30", "2024-03-15T23:30:00-03:00", "2024", "31/02/2024"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in days], "t string").select(X.parse_date("t")).collect()]
    d = dt.date(2024, 3, 15)
    assert got == [d, d, d, d, dt.date(2024, 3, 16), None, None]
    words = ["  São  PAULO x ", "M³ ½ ﬁm", None, "á"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in words], "t string").select(X.fold("t")).collect()]
    assert got == ["sao paulo x", "m3 1⁄2 fim", "", "a"]


def _items(spark, rows):
    names = "record_id pncp_id id_compra_item descricao catmat catser quantidade valor_unitario valor_total valor_referencia".split()
    df = spark.createDataFrame([dict(zip(names, r)) for r in rows], ", ".join(f"{n} string" for n in names))
    return df.withColumns({
        **{c: X.parse_decimal(c) for c in names[6:]}, "snapshot_id": F.lit("s"), "methodology_version": F.lit("v")})


def test_each_data_error_hits_only_its_plant(spark):
    peer = [(f"p{i}", "c1", f"i{i}", "paper", "9", None, str(i + 2), "5.00", str(5 * (i + 2)), None) for i in range(4)]
    rows = peer + [
        ("shift", "c1", "i9", "paper", "9", None, "10", "5000", "50000", None),
        ("near", "c1", "i10", "paper", "9", None, "10", "50", "500", None),
        ("miss", "c2", "i1", "pen", "8", None, "10", "5.00", "40.00", None),
        ("collapse", "c3", "i1", "service", "7", None, "1", "180", "180.0", None),
        ("zero", "c4", "i1", "lot", "6", None, "0", "5", "0", None),
        ("neg", "c5", "i1", "lot b", "5", None, "10", "-5", "-50", None),
        ("dup-a", "c6", "i1", "ream", "4", None, "4", "12", "48", None),
        ("dup-b", "c6", "i1", "ream", "4", None, "4", "12.00", "48.0", None),
        ("dup-c", "c6", "i1", "ream", "4", None, "4", "12", "48", None),
        ("cat", "c7", "i1", "scanner", "3", None, "2", "2500", "5000", "10"),
    ]
    items = _items(spark, rows)
    got = {(r.record_id, r.reason) for r in EX.detect_data_errors(items).collect()}
    assert got == {
        ("shift", "decimal_shift"), ("miss", "qty_unit_price_neq_total"), ("collapse", "qty_eq_1_collapse"),
        ("zero", "zero_or_negative"), ("neg", "zero_or_negative"), ("dup-b", "duplicate_row"), ("dup-c", "duplicate_row"),
        ("cat", "catalog_magnitude")}
    pool = {r.record_id for r in EX.comparable_items(items, EX.detect_data_errors(items)).collect()}
    assert pool == {"p0", "p1", "p2", "p3", "near", "dup-a"}


def test_age_boundaries(spark):
    award = dt.date(2024, 6, 1)
    rows = [(str(n), award - dt.timedelta(days=n), award) for n in (-1, 0, 89, 90, 364, 365)]
    out = FL.company_age(spark.createDataFrame(rows, "record_id string, opened_on date, award_date date")).collect()
    assert {(r.record_id, r.kind) for r in out} == {
        ("0", "cnpj_age"), ("89", "cnpj_age"), ("90", "cnpj_age_info"), ("364", "cnpj_age_info")}


def test_sanction_window_is_inclusive_and_first_wins(spark):
    a, b = dt.date(2024, 1, 1), dt.date(2024, 12, 31)
    cnpj = "44555666000172"
    windows = spark.createDataFrame(
        [(cnpj, a, b, "CEIS", "S1", 1), (cnpj, a, None, "CNEP", "S2", 2)],
        "cnpj string, start_on date, end_on date, register string, ref string, ordinal long")
    day = dt.timedelta(days=1)
    rows = [("before", a - day), ("first", a), ("last", b), ("after", b + day)]
    items = spark.createDataFrame([(r, cnpj, d) for r, d in rows], "record_id string, fornecedor_cnpj string, award_date date")
    got = {r.record_id: r.delta[-2:] for r in FL.sanctioned(items, windows).collect()}
    assert got == {"first": "S1", "last": "S1", "after": "S2"}


def _purchases(spark, rows):
    cols = "record_id string, id_compra string, orgao_cnpj string, catmat string, modalidade string, objeto string, valor_total decimal(18,6), award_date date"
    return spark.createDataFrame([(r[0], r[0], *r[1:-2], Decimal(r[-2]), dt.date.fromisoformat(r[-1])) for r in rows], cols)


def test_split_purchase_rules(spark):
    # 2024 limit for purchases: 59,906.02; its 90% floor: 53,915.418.
    w, p = "Dispensa", "pens"
    rows = [(f"over{i}", "A", "880111", w, p, "25000", f"2024-0{i}-10") for i in (1, 5, 9)]
    rows += [(f"clu{i}", "B", "880111", w, p, "54000", d) for i, d in enumerate(("2024-01-01", "2024-02-01", "2024-03-31"))]
    rows += [("clu-late", "B", "880111", w, p, "54000", "2024-09-01")]
    rows += [(f"big{i}", "C", "880111", w, p, v, "2024-02-02") for i, v in enumerate(("59906.02", "100"))]
    rows += [(f"open{i}", "D", "880111", "Pregão", p, "40000", "2024-02-02") for i in range(3)]
    rows += [("y1", "E", "880111", w, p, "40000", "2024-12-31"), ("y2", "E", "880111", w, p, "40000", "2025-01-01")]
    rows += [(f"work{i}", "F", "880111", w, "sobra de cabo", "40000", "2024-02-02") for i in range(2)]
    rows += [("cls1", "G", "880111", w, p, "40000", "2024-02-02"), ("cls2", "G", "654321", w, p, "40000", "2024-02-02")]
    got = {(r.record_id, r.kind) for r in FL.split_purchases(_purchases(spark, rows)).collect()}
    assert got == {*[(f"over{i}", "fracionamento") for i in (1, 5, 9)], *[(f"clu{i}", "fracionamento_cluster") for i in range(3)]}


def test_activity_rule(spark):
    rows = [
        ("hit", "M", "892011", "6412000", ""), ("primary", "M", "892011", "1061901", ""),
        ("secondary", "M", "892011", "6201501", "9999999, 4632-0/01"), ("unmapped", "M", "999911", "6412000", ""),
        ("no-activity", "M", "892011", "", ""), ("no-code", "M", "", "6412000", ""), ("service", "S", "892011", "6412000", "")]
    items = spark.createDataFrame(rows, "record_id string, material_ou_servico string, catmat string, cnae string, cnae_secundaria string")
    assert [r.record_id for r in FL.activity_mismatch(items).collect()] == ["hit"]


def test_edits_after_publication(spark):
    head = "record_id record_hash snapshot_id dataAtualizacaoPncp dataResultado valorUnitarioResultado quantidade codFornecedor nomeFornecedor descricao".split()
    base = dict(snapshot_id="s1", dataAtualizacaoPncp="2024-02-01", dataResultado="2024-03-01", valorUnitarioResultado="5.00",
                quantidade="10", codFornecedor="44555666000172", nomeFornecedor="Açaí SA", descricao="x")
    later = {**base, "snapshot_id": "s2", "dataAtualizacaoPncp": "2024-04-01"}
    rows = []
    for rid, change in (
        ("price", {"valorUnitarioResultado": "9,99"}), ("qty", {"quantidade": "20"}), ("supplier", {"codFornecedor": "99888777000166"}),
        ("text", {"descricao": "y"}), ("same", {}), ("name", {"nomeFornecedor": "ACAI  SA"}),
        ("early", {"valorUnitarioResultado": "7", "dataAtualizacaoPncp": "2024-02-20"})):
        rows.append({**base, "record_id": rid, "record_hash": rid + "1"})
        rows.append({**later, **change, "record_id": rid, "record_hash": rid + ("1" if rid == "same" else "2")})
    landed = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in head))
    out = {r.record_id: r.delta for r in FL.retroactive_edits(FL.snapshot_versions(landed)).collect()}
    assert set(out) == {"price", "qty", "supplier"}
    assert '"valor_unitario_resultado":{"after":"9.990000","before":"5.000000"}' in out["price"]


def test_screens_hit_only_their_plants(spark):
    rows = []

    def lot(tender, bids, orgao="o", planted=None):
        for who, value, won in bids:
            rows.append((tender, "SP", orgao, "k-" + tender.split("-")[0], "1", who, value, won, "tce_sp", planted or tender.split("-")[0]))

    c = [f"5{i}000000000100" for i in range(5)]
    lot("COVER-1", [(c[0], "10000", "true"), (c[1], "18000", "false")])
    lot("COVER-2", [(c[0], "11000", "true"), (c[1], "20000", "false")])
    for i in range(3):
        lot(f"ROTATION-{i}", [(c[2 + j], str([10000, 10900, 11800][(i + j) % 3]), "true" if (i + j) % 3 == 0 else "false") for j in range(3)], "ro")
    lot("VARIANCE", [(f"6{i}000000000100", str(10000 + 100 * i), "false") for i in range(4)])
    lot("SKEW", [("70000000000100", "4000", "true")] + [(f"7{i}000000000100", str(10000 + 100 * i), "false") for i in range(1, 4)])
    lot("CLEAN", [(f"8{i}000000000100", str(8000 * 2**i), "false") for i in range(4)])
    lot("CPFONLY", [("98765432100", "1000", "false")])
    rows.append(("OTHER-UF", "PR", "o", "k", "1", c[0], "1", "true", "tce_pr", "OTHER-UF"))
    names = "licitacaoId uf orgao classe itemLote participante proposta winner source plantedId".split()
    people = PA.normalize_participants(spark.createDataFrame(rows, names))
    assert {r.participante for r in people.where("licitacaoId = 'CPFONLY'").collect()} == {"***.654.321-**"}
    assert people.where("licitacaoId = 'OTHER-UF'").isEmpty()
    out = SC.detect_screens(people).collect()
    assert {(r.kind, r.subjectId) for r in out} == {
        ("bid_variance", "VARIANCE"), ("skew", "SKEW"), ("cover_bidding", "COVER"), ("winner_rotation", "ROTATION")}
    # The cluster of the skew lot is tight, but the lot as a whole is not.
    edges = G.cobid_edges(people)
    assert edges.where("licitacaoId = 'CPFONLY'").isEmpty() and edges.where("licitacaoId = 'VARIANCE'").count() == 6


def test_company_edges(spark):
    e = "cnpj_basico cnpj_ordem cnpj_dv tipo_logradouro logradouro numero cep municipio ddd1 telefone1 correio_eletronico".split()
    rows = [
        ("20202011", "1", "91", "RUA", "DAS FLORES", "100", "27215100", "1", None, None, None),
        ("20202022", "0001", "72", "RUA", "das Flôres", "100", "27215-100", "1", None, None, None),
        ("20202022", "0002", "53", "RUA", "das Flores", "100", "27215-100", "1", None, None, None),
        ("30303011", "0001", "91", None, None, None, None, None, "21", "33334444", "A@x.example"),
        ("30303022", "0001", "72", None, None, None, None, None, "21", "3333-4444", "a@X.example"),
        ("40404011", "0001", "91", None, None, None, None, None, "21", "999998888", "no mail"),
        ("40404022", "0001", "72", None, None, None, None, None, "21", "999998888", "no mail"),
    ]
    est = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in e))
    partners = spark.createDataFrame(
        [("40404011", "2", "98765432100"), ("40404022", "2", "***.654.321-**"), ("30303011", "1", "77777777000191")],
        "cnpj_basico string, identificador_de_socio string, cnpj_cpf_do_socio string")
    members = G.shared_members(est, partners)
    got = {(r.kind, r.leftCnpj, r.rightCnpj) for r in G.adjacency_edges(members).collect()}
    assert got == {
        ("shared_address", "20202011000191", "20202022000172"), ("shared_address", "20202011000191", "20202022000253"),
        ("shared_phone", "30303011000191", "30303022000172"), ("shared_email", "30303011000191", "30303022000172"),
        ("shared_qsa_partner", "40404011000191", "40404022000172")}
    assert not [r for r in members.collect() if "987" in r.evidence or "98765432100" in r.evidence]


def test_unit_table_and_prefixes(spark):
    assert len({r[0] for r in fixed.unit_rows()}) == len(fixed.unit_rows()) > 250
    packs = {
        "cx 10": ("un", 10), "cx/10": ("un", 10), "cx10": ("un", 10), "cx x 10": ("un", 10), "caixa c/10": ("un", 10),
        "caixa com 10": ("un", 10), "caixa de 10": ("un", 10), "cxa c/ 12": ("un", 12), "cx/25": ("un", 25),
        "caixa 25 pct": ("un", 25), "caixa 25,00 pct": ("un", 25), "cx 50 un": ("un", 50), "pct 12": ("un", 12),
        "pacote de 50": ("un", 50), "pcte c/20": ("un", 20), "dz 12": ("un", 12), "frasco com 10": ("un", 10),
        "ampola com 5": ("un", 5), "cartela com 4": ("un", 4), "resma 500": ("folha", 500), "resma com 500 folha": ("folha", 500),
        "frasco 20 ml": ("l", 0.02), "frasco 20,00 ml": ("l", 0.02), "ampola 1 ml": ("l", 0.001), "copo 200 ml": ("l", 0.2),
        "900 ml": ("l", 0.9), "1 l": ("l", 1), "5l": ("l", 5), "1000 g": ("kg", 1), "500 g": ("kg", 0.5), "1kg": ("kg", 1),
    }
    asked = spark.createDataFrame([(t,) for t in packs], "unidade_medida string")
    assert {r[0]: (r[1], float(r[2])) for r in match_units(asked).collect()} == packs
    want = {
        "CAIXA COM 10": ("un", "10"), "PACOTE C/ 100": ("un", "100"), "CX": ("cx", "1"), "FOOBAR": ("unknown", "1"), "Lt.": ("l", "1"),
        "M³": ("m3", "1"), "RESMA 500 FLS": ("folha", "500"), "copo 300 ml": ("l", "0.3"), "KG/SACO": ("kg", "1"),
        "caixa grande": ("cx", "1"), "un12": ("un", "1"), "CX 0": ("unknown", "1"), "Duzia x 2": ("un", "2"), "TON": ("kg", "1000"),
        "GALÕES": ("galao", "1"), "cx 10 frascos": ("un", "10"), "250g": ("kg", "0.25"),
    }
    texts = spark.createDataFrame([(t,) for t in want], "unidade_medida string")
    got = {r.unidade_medida: (r.unidade_canonica, r.fator) for r in match_units(texts).collect()}
    want = {k: (c, Decimal(f)) for k, (c, f) in want.items()}
    # "CX 0" has a zero count, but its first word is still a known unit before a blank.
    want["CX 0"] = ("cx", Decimal(1))
    assert got == want


def test_normalize_uncoded_text_and_specs(spark):
    names = ["CANETA ESFEROGRAFICA AZUL", "PAPEL SULFITE A4 75G", "DIPIRONA 500MG", "ARROZ BRANCO TIPO 1", "CANETA HIDROGRAFICA VERMELHA"]
    raw_catalog = spark.createDataFrame([(str(i + 1) * 6, n, "M", i) for i, n in enumerate(names)], "codigo string, descricao string, tipo string, seq int")
    rows = [
        ("near", "PAPEL SULFITE A4 75 GRAMAS RESMA", None, "UN", "10", "5,00"), ("near2", "PAPEL SULFITE A4 75 GRAMAS RESMA", None, "UN", "1", "5"),
        ("ambiguous", "PAPEL ARROZ TIPO 1 A4 CANETA AZUL", None, "UN", "1", "5"), ("given", "QUALQUER", "333333", "UN", "1", "5"),
        ("exact", "arroz  branco tipo 1", None, "CAIXA COM 10", "2", "50.00"), ("empty", None, None, None, None, None),
        ("spec", "DIPIRONA SODICA 500MG/ML SOL INJ 20ML", "333333", "FOOBAR", "6", "3,45")]
    raw = spark.createDataFrame(
        rows, "record_id string, descricaodetalhada string, codItemCatalogo string, unidadeMedida string, quantidade string, valorUnitarioResultado string"
    ).withColumn("materialOuServico", F.lit("M"))
    out = {r.record_id: r for r in N.normalize_items(raw, N.catalog_table(raw_catalog), snapshot=F.lit("s"), version="v").collect()}
    got = {k: (r.catmat, r.catmat_match_quality) for k, r in out.items()}
    assert got == {
        "near": ("222222", "knn"), "near2": ("222222", "knn"), "ambiguous": (None, "none"), "given": ("333333", "exact"),
        "exact": ("444444", "exact"), "empty": (None, "none"), "spec": ("333333", "exact")}
    assert (out["spec"].spec_concentracao, out["spec"].spec_dosagem, out["spec"].spec_tamanho) == ("500mg/ml", None, "20ml")
    assert out["exact"].valor_por_unidade_canonica == Decimal("5") and out["spec"].valor_por_unidade_canonica is None
    assert out["empty"].quantidade == 0 and out["empty"].unidade_canonica == "unknown"
    assert tuple(out["near"].asDict()) == N.ITEM_COLUMNS and len(N.ITEM_COLUMNS) == 49


def test_facts_reduced_before_or_after_hashing_are_equal(spark):
    from lisura.operators import entities as EN
    from lisura.plans.views import Views

    items = Views(spark, "/root/testdata/sf0.001").v_item.withColumn("record_id", F.col("line_id")).withColumn(
        "record_hash", F.concat("snapshot_id", "valor_total"))
    stamped = items.withColumn("publicado_em", F.col("award_date").cast("timestamp"))
    late, early = EN.latest_facts(EN.item_facts(stamped), "publicado_em"), EN.latest_item_facts(stamped, "publicado_em")
    assert len(early.columns) == 25 and set(late.columns) == set(early.columns)
    keys = ["item_id", "uf", "quarter", "snapshot_id", "publicado_em", "record_hash"]
    assert sorted(map(tuple, late.select(*keys).collect())) == sorted(map(tuple, early.select(*keys).collect()))


def test_latest_facts_carry_only_what_they_use(spark):
    from lisura.operators import entities as EN

    rows = [("i1", "c1", " ", "SP", "2024-Q1", "5", "s1", 1, "z"), ("i1", "c1", "SP", "RJ", "2024-Q1", "6", "s2", 2, "z"),
            ("i1", "c1", "RJ", "RJ", "2024-Q1", "7", "s3", 3, "z"), (None, " ", None, None, None, "8", None, 4, "z"), ("", "", None, "", "", "9", "s0", 5, "z")]
    items = spark.createDataFrame(rows, "record_id string, pncp_id string, uf_item string, uf string, quarter string, valor_total string, snapshot_id string, seen int, other string").withColumn(
        "valor_total", F.col("valor_total").cast("decimal(18,6)")).withColumns({c: F.lit(1).cast("decimal(18,6)") for c in ("quantidade", "valor_unitario")})
    got = EN.latest_item_facts(items, "seen")
    assert sorted(map(tuple, got.select("uf", "quarter", "pncp_id", "valor_total", "snapshot_id").collect())) == [
        ("", "", "", 9.0, "s0"), ("RJ", "2024-Q1", "c1", 7.0, "s3"), ("SP", "2024-Q1", "c1", 6.0, "s2")]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Aggregate" in x for x in plan) and not [x for x in plan if "Aggregate" in x and "other#" in x]


def test_search_by_index_equals_search(spark, tmp_path):
    rng = random.Random(3)
    words = ["parafuso", "Ação", "BOLT", "ﬁltro", "caneta", "㎎", "x"]
    rows = [(f"item_{i}", "item", str(i), " ".join(rng.choice(words) for _ in range(rng.randrange(6)))) for i in range(300)]
    rows += [("orgao_1", "orgao", "1", "Prefeitura acao"), (None, "orgao", "2", None), ("item_7", "item", "7", "rare agulha"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "id string, kind string, entityId string, text string")
    root = str(tmp_path / "index")
    SI.write_index(docs.limit(0), root)
    assert SI.index_page(spark, root, "bolt").count() == 0
    SI.write_index(docs, root, place_rows=20, part_rows=300)
    shown = ["id", "kind", "entityId", "text", "rank"]
    for q in ("bolt", "AÇÃO fil", "afuso caneta", "mg", "x", "agulha", "bolt bolt b", "zzz", "agulha bolt", "", None):
        for skip, take in ((0, 5), (37, 40), (500, 5)):
            want = sorted(map(tuple, SE.search(docs, q, skip, take).select(shown).collect()), key=str)
            assert sorted(map(tuple, SI.index_page(spark, root, q, skip, take).select(shown).collect()), key=str) == want, (q, skip)
        assert sorted(SI.index_totals(spark, root, q).collect()) == sorted(SE.search_totals(docs, q).collect())
    one = SI.index_hits(spark, root, "agulha")
    # Only the place that holds the candidate is read, of the 16 there are.
    assert one.count() == 1
    assert re.search(r"PartitionFilters: \[[^]]*place#\d+ = \d+", one._jdf.queryExecution().toString())


def test_number_of_places_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SI, "MOST_PLACES", 5, raising=False)
    rows = [(f"item_{i}", "item", str(i), f"caneta {i % 90} azul") for i in range(400)]
    docs = spark.createDataFrame(rows, "id string, kind string, entityId string, text string")
    root = str(tmp_path / "index")
    SI.write_index(docs, root, place_rows=2, part_rows=50)
    folder = SI._listed(spark, root)[-1]
    for name in ("documents", "postings"):
        assert spark.read.parquet(f"{folder}/{name}").select("place").distinct().count() <= 5, name
    for q in ("caneta", "77 azul", "9 a", "zul 1"):
        for skip, take in ((0, 5), (110, 300)):
            want = sorted(map(tuple, SE.search(docs, q, skip, take).select("id", "rank").collect()))
            assert sorted(map(tuple, SI.index_page(spark, root, q, skip, take).select("id", "rank").collect())) == want, (q, skip)
        assert sorted(SI.index_totals(spark, root, q).collect()) == sorted(SE.search_totals(docs, q).collect())


def _bids(spark, rows):
    return spark.createDataFrame(rows, "licitacaoId string, itemLote string, participante string, proposta long, winner boolean").withColumn(
        "proposta", F.col("proposta").cast("decimal(18,6)"))


def test_cover_pairs_equal_all_pairs_for_any_number_of_repeats(spark):  # with crowded lots and without
    dice = random.Random(5)
    rows = []
    for lot_no in range(60):
        crowd = dice.choice([2, 3, 5, 40])
        for c in dice.sample(range(60), crowd):
            rows.append((f"L{lot_no // 2}", str(lot_no % 2), f"{c:014d}", dice.choice([0, 100, 140, 150, 400, 900]), dice.random() < 0.2))
    rows += [(None, "1", f"{c:014d}", 100 + c, False) for c in range(5)] + rows[:20] + [("L1", "0", f"{c:014d}", None, False) for c in range(3)]
    lots = {}
    for event, item, who, price, won in rows:
        if price and event:
            old = lots.setdefault((event, item), {}).get(who, (price, won))
            lots[event, item][who] = (min(price, old[0]), won or old[1])
    for repeats in (1, 2, 4, 5):
        found = {}
        for event, bids in sorted(lots.items()):
            for a in bids:
                for b in bids:
                    if a < b:
                        high, low = (a, b) if bids[a][0] >= bids[b][0] else (b, a)
                        if bids[high][0] / bids[low][0] >= 1.5 and not bids[high][1]:
                            found.setdefault((a, b), []).append((event, high))
        wanted = {(*pair, len(seen), seen[0][1], seen[0][0]) for pair, seen in found.items()
                  if len(seen) >= repeats and len({h for _, h in seen}) == 1}
        got = SC.cover_pairs(_bids(spark, rows), repeats, block=7, crowd=5 if repeats < 5 else 100).collect()
        assert {(r.leftCnpj, r.rightCnpj, r.n, r.high, tuple(r["first"])) for r in got} == wanted and len(got) == len(wanted) > 0


def test_crowded_lots_form_no_pairs_of_companies_that_meet_elsewhere(spark):
    # 400 companies share one crowded lot; each two of them also meet in a lot of their own.
    rows = [("BIG", "1", f"{c:014d}", 100 + 100 * (c % 2), False) for c in range(400)]
    rows += [(f"S{c // 2}", "1", f"{c:014d}", 100 + 100 * (c % 2), False) for c in range(400)]
    bids = _bids(spark, rows)
    crowds = bids.withColumn("crowd", F.when(F.col("licitacaoId") == "BIG", 400).otherwise(2))
    assert SC.late_bids(crowds, 2, 100).select("licitacaoId").distinct().collect() == [("BIG",)]
    assert SC.late_bids(crowds, 2, 100).count() == 400 and SC.late_bids(crowds, 2, 400).isEmpty()
    got = SC.cover_pairs(bids, crowd=100).collect()
    assert {(r.leftCnpj, r.rightCnpj, r.n) for r in got} == {(f"{c:014d}", f"{c + 1:014d}", 2) for c in range(0, 400, 2)}
