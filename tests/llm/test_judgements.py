"""Toxicity, language, addresses, pipeline stages, and the registered queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from lisura.llm import jobs, language, stages, toxicity, url_filter

from .conftest import LONG

FOLDER = "/root/testdata/sf0.001"


def test_machine_learns_pairs():
    """Neither term alone is toxic; both together are: no additive weights can say that."""
    rng = random.Random(0)
    rows, labels = [], []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([1] * a + [2] * b + [rng.randrange(3, 9)], np.int64))
        labels.append(float(a and b))
    place = np.arange(10)
    model = toxicity.fit(rows, np.array(labels), np.ones(600), place, 10)
    def score(*terms):
        return model.score(np.array(terms, np.int64))

    assert score(1, 2, 5) > 0.5 > max(score(1, 5), score(2, 5), score(5))
    assert (model.pairs[1] * model.pairs[2]).sum() > 0.5


def test_toxicity(spark, docs_of):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(3, 60))]
        toxic = i % 4 == 0
        rows.append((i, " ".join([*words, *(["Vile!", "scumbag"][: 1 + i % 2] if toxic else [])]), toxic))
    docs = docs_of([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, LONG), (None, "vile"), (3, rows[3][1])])
    labels = spark.createDataFrame([(i, int(t)) for i, _, t in rows if i < 300] + [(950, 1), (5, None), (None, 1)], "id long, toxic int")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    model = toxicity.train(texts, labels)
    got = toxicity.score(docs, model, ["doc_id", "key"]).collect()
    assert len(got) == docs.count()
    score = {r.doc_id: r.score for r in got}
    assert all((score[i] >= 0.5) == t for i, _, t in rows)
    assert score[900] == score[901] < 0.5 and 0 <= min(score.values()) <= max(score.values()) <= 1
    assert score[None] >= 0.5
    for some, want in ((labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0), (labels.limit(0), 0.0)):
        alone = toxicity.score(docs, toxicity.train(texts, some), ["doc_id"]).agg(F.min("score"), F.max("score")).first()
        assert np.allclose(alone, want, atol=1e-9)
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_language(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "th", "ing", "and", "er"], "de": ["sch", "ung", "der", "ei", "ch"], "fr": ["eau", "que", "les", "ou", "tre"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(2)) for _ in range(n))

    taught = [(i, text(lang, 30), lang) for i, lang in enumerate(list(parts) * 30)] + [(990, None, "en"), (991, "x", None)]
    model = language.train(spark.createDataFrame(taught, "id long, text string, lang string"))
    assert model[0] == ["de", "en", "fr"]
    rows = [(i, text(lang, 20), lang, f"/{lang}", f"{lang}.example.com") for i, lang in enumerate(list(parts) * 20)]
    # Without text, the other evidence decides; without any, the most common language.
    rows += [(100, None, "fr", None, None), (101, "", None, None, "de.example.com"), (102, None, None, None, None),
             (103, text("en", 4000), None, None, None), (None, text("fr", 9), "fr", "/fr", None), (0, rows[0][1], *rows[0][2:])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "id long, text string, declared string, address string, host string, p0 double")
    got = language.identify(df, *model, ["id", "p0"]).collect()
    assert len(got) == len(rows)
    found = {r.id: r.language for r in got}
    assert all(found[i] == lang for i, _, lang, _, _ in rows if i is not None and i < 60)
    assert (found[100], found[101], found[103], found[None]) == ("fr", "de", "en", "fr")
    assert all(0 < r.probability <= 1 for r in got)
    assert language.identify(df.limit(0), *model, ["id"]).count() == 0
    none = language.train(spark.createDataFrame([], "id long, text string, lang string"))
    assert language.identify(df, *none, ["id"]).where("language is not null").count() == 0


def test_languages_beyond_the_classes_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    rng = random.Random(4)
    alphabets = {"en": "abcde", "de": "fghij", "fr": "klmno", "it": "pqrst", "other": "uvwxy", "se": "01234"}

    def text(lang):
        return " ".join("".join(rng.choices(alphabets[lang], k=4)) for _ in range(20))

    counts = {"en": 30, "de": 20, "fr": 20, "it": 10, "other": 10, "se": 1}
    taught = [(lang, text(lang)) for lang, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(taught)], "id long, text string, lang string")
    model = language.train(df)
    # Two of equal frequency: the name decides which is a class of its own.
    assert model[0] == ["de", "en", "other"]
    asked = spark.createDataFrame([(lang, text(lang), None, None, None) for lang in counts for _ in range(5)],
                                  "id string, text string, declared string, address string, host string")
    got = language.identify(asked, *model, ["id"]).collect()
    assert len(got) == 30 and all(r.language == r.by_text == (r.id if r.id in ("en", "de") else "other") for r in got)
    # As many languages as classes: each is its own.
    assert language.train(df.where("lang in ('fr', 'it', 'se')"))[0] == ["fr", "it", "se"]
    assert language.train(df.where("lang in ('en', 'it', 'other', 'se')"))[0] == ["en", "it", "other"]


def test_long_texts_are_read_whole():
    assert len(language.trigrams(LONG.encode())) == len(LONG)
    assert len(language.trigrams(b"")) == 0


def test_segmentation():
    counts = {"cheap": 50, "pills": 40, "the": 500, "rest": 30, "he": 200, "a": 300}
    total = 2000

    def split(name):
        found = {(i, n): counts[name[i : i + n]] for i in range(len(name)) for n in range(1, 25) if name[i : i + n] in counts}
        return url_filter.best_split(name, found, total)

    assert split("cheappills") == ["cheap", "pills"]
    assert split("therest") == ["the", "rest"]
    assert split("zq") == ["zq"] and split("") == []


def test_url_filter(spark):
    bad = [(i, f"http://buycheappills{i}.net/x{i}") for i in range(30)] + [(100 + i, f"https://cheappills.com/de/{i}") for i in range(40)]
    good = [(200 + i, f"http://Www.Garden.org/page/{i}?q=1#f") for i in range(40)] + [(300, "http://gardenpage.net/tea")]
    odd = [(400, None), (401, ""), (402, "no scheme"), (403, "://"), (404, "http://" + "x" * 70 + ".net/"), (405, "a://b.ORG"),
           (406, "http://org/"), (407, "http://xorg/"), (408, "x://h.com?/de/"), (409, "x://a.com/de/é#://z"), (None, "http://q.org/")]
    html = "<html><script>var cheap;</script><p>buy cheap pills garden page tea</p>" * 3
    rows = [(i, u, html, "mine") for i, u in [*bad, *good, *odd, *bad[:1]]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = url_filter.judge(pages, jobs.URL_RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].verdict == "block" for i, _ in bad)
    assert all(by[i].verdict == "allow" for i, _ in good)
    assert (by[200].host, by[200].path, by[200].rule) == ("www.garden.org", "/page/0", "org/")
    assert [(by[i].host, by[i].path) for i in range(400, 404)] == [("", "")] * 4
    assert (by[405].rule, by[406].rule, by[407].rule, by[408].rule, by[409].rule) == (None, "org/", None, None, "com/de/")
    assert by[409].path == "/de/é" and by[None].rule == "org/"
    assert by[0].host_words == ["buy", "cheap", "pills", "net"]
    twice = pages.unionByName(spark.createDataFrame([(500, "http://pills.cheappills.müller.net/", html, "mine")], pages.schema))
    assert url_filter.judge(twice, jobs.URL_RULES).where("page_id = 500").first().host_words == ["pills", "cheap", "pills", "müller", "net"]
    assert url_filter.judge(pages.limit(0), jobs.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages.where("page_id between 200 and 240"), jobs.URL_RULES).collect()} == {"allow"}


def test_longest_rule_wins(spark):
    rules = jobs.URL_RULES
    rows = [(1, "http://example.org/es/1"), (2, "http://a.example.org/en/1x"), (3, "http://example.org/en/2"), (4, "http://z.com/fr/")]
    pages = spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: ("com/fr/", "allow")}


def _ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_stages_filter(spark, docs_of):
    """Near copies leave one, contaminated rows go, everything else stays, and all columns come back."""
    text = " ".join(f"t{i}" for i in range(100))
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    rows = [(4, text), (2, text), (3, text.replace("t50", "other")), (9, "alone here"), (9, "alone here"), (7, None), (8, ""),
            (8, ""), (5, "one"), (5, "another text"), (None, "no id"), (None, text), (6, f"before {item} after")]
    docs = docs_of(rows)
    kept = stages.drop_near_copies(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert _ids(kept) == sorted([2, 9, 7, 8, 5, 5, None, 6], key=str)
    clean = stages.drop_contaminated(spark, docs, FOLDER)
    assert clean.columns == docs.columns and _ids(clean) == sorted([r[0] for r in rows if r[0] != 6], key=str)
    masked = stages.mask_secrets(spark, docs_of([(1, "password=abcdefgh12"), (2, None)]), FOLDER)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in masked.collect()) == [(1, "[secret]", 8), (2, None, None)]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name


def test_stages_pass_any_column(spark):
    """Names that need quotes, maps, nested and old dates come back as they were."""
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(1, text, "en", 1), (1, text, "en", 2), (2, text + " more", "en", 3), (3, "clean words", None, 4), (None, None, "fr", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, k int").selectExpr(
        "doc_id", "text", "lang", "'s' as source", "cast(length(text) as bigint) as n_chars", "k as `my col`", "k as `a-b`", "k as row",
        "map('x', k) as m", "date '1500-03-01' as old", "timestamp '0900-01-01 00:00:00' as older", "array(struct(k as `x y`)) as deep",
        "cast(k as decimal(30,10)) as big", "true as none", "'h' as text_hash")
    whole = {r["my col"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns, name
        for r in got.collect():
            assert r == whole[r["my col"]], name
    kept = {r["my col"] for r in stages.drop_near_copies(spark, docs, FOLDER).collect()}
    assert len(kept & {1, 2}) == 1 and kept - {1, 2} == {4, 5}


def test_toxicity_scores_equal_the_plain_sum_over_pairs(spark, docs_of):
    """The machine's score, written out pair by pair."""
    rng = np.random.default_rng(3)
    place = np.full(toxicity.BUCKETS, -1, np.int32)
    chosen = rng.choice(toxicity.BUCKETS, toxicity.BUCKETS // 2, replace=False)
    place[chosen] = np.arange(len(chosen))
    machine = toxicity.Machine(place, 0.3, rng.normal(0, 0.2, len(chosen)), rng.normal(0, 0.2, (len(chosen), toxicity.RANK)))
    rows = [(1, "you are an awful person"), (2, None), (3, ""), (4, "One two TWO three"), (None, "lost words"), (5, "é ü")]
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(rows), machine, ["doc_id"]).collect()}
    buckets = toxicity.TermHash()
    for i, t in rows:
        at = [place[b] for b in toxicity.terms_of(t.encode() if t is not None else None, buckets) if place[b] >= 0]
        z = machine.bias + sum(machine.linear[a] for a in at)
        z += sum(float(machine.pairs[a] @ machine.pairs[b]) for k, a in enumerate(at) for b in at[k + 1:])
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_pipeline_over_files(spark, tmp_path):
    """The stages, each written and read again, against the operators' own results."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / f"{k}{name}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    assert docs.select("doc_id").distinct().count() == sizes[4]
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()


def test_held_out_toxicity(spark):
    got = jobs.queries()["op3_toxicity"](spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    rows = got.join(truth, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)


@pytest.mark.parametrize("name", sorted(jobs.queries()))
def test_queries_run(spark, name):
    """Registered, and the same rows whatever the partitions."""
    fn = entry_point.queries()[name]
    assert fn(spark, FOLDER).count() > 0


def test_toxicity_sample_keeps_the_true_share(spark, monkeypatch):
    """More labels of a class than are drawn, and labels without a document: scores still average to the true share."""
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    rng = random.Random(4)
    texts = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(50)}" for _ in range(5))) for i in range(2_200)], "id long, text string")
    # 2,000 clean and 200 toxic texts without any difference; 3,000 toxic labels of absent documents.
    labels = spark.createDataFrame([(i, int(i % 11 == 0)) for i in range(2_200)] + [(10_000 + i, 1) for i in range(3_000)], "id long, toxic int")
    for known, want in ((labels.where("id < 2200"), 1 / 11), (labels, 1 / 11)):
        model = toxicity.train(texts, known)
        mean = toxicity.score(texts, model, ["id"]).agg(F.avg("score")).first()[0]
        assert abs(mean - want) < 0.05, (mean, want)


def test_toxic_terms_at_any_number_of_labels(spark):
    """Each insult in a third of the toxic texts: few labels teach it as well as ten times as many."""
    rng = random.Random(6)
    for times in (1, 10):
        rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(6)) + (" " + ["vile", "scum", "moron"][i // 6 % 3] if i % 6 == 0 else ""), int(i % 6 == 0))
                for i in range(72 * times)]
        df = spark.createDataFrame(rows, "id long, text string, toxic int")
        model = toxicity.train(df.select("id", "text"), df.select("id", "toxic"))
        asked = spark.createDataFrame([(0, "vile q"), (1, "q scum"), (2, "moron"), (3, "q r s"), (4, "")], "id long, text string")
        found = {r.id: r.score >= 0.5 for r in toxicity.score(asked, model, ["id"]).collect()}
        assert found == {0: True, 1: True, 2: True, 3: False, 4: False}, (times, found)


def test_held_out_toxic_texts_are_found(spark):
    """Recall and false alarms: the larger class alone would make accuracy 0.86."""
    for size, least in (("sf0.001", 1.0), ("sf0.01", 0.6)):
        got = jobs.queries()["op3_toxicity"](spark, f"/root/testdata/{size}").where("held_out")
        rows = got.join(spark.read.parquet(f"/root/testdata/{size}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
        toxic = [r for r in rows if r.toxic == 1]
        assert sum(r.predicted for r in toxic) >= least * len(toxic)
        assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(rows)


def test_decontamination_stage_tells_texts_of_one_id_apart(spark, docs_of, monkeypatch):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    rows = [(None, f"before {item} after"), (None, "clean without id"), (None, None), (6, f"see {item}"), (6, "clean with the same id"), (7, "x")]
    for seeds in (stages.decontamination.SMALL_SEEDS, 0):
        monkeypatch.setattr(stages.decontamination, "SMALL_SEEDS", seeds)
        clean = stages.drop_contaminated(spark, docs_of(rows), FOLDER)
        assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
