"""N-gram join, block search, decontamination: against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from lisura.llm import block_search, decontamination, ngram_join

from .conftest import LONG


def _words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def _set(text, n):
    w = _words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    """{doc_id: (set size, smallest doc_id reachable)} by comparing all pairs."""
    sets = [(d, _set(t, n)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        both = len(a & b)
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def _family(rng, size, words, edits):
    base = [f"b{rng.randrange(3000)}" for _ in range(words)]
    for _ in range(size):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(text)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(docs_of, n, percent):
    rng = random.Random(n)
    texts = [None, "", " \t\n", "one", "ONE", "two words", "a b c d", "a b c d e", "É x y z", LONG, LONG + " tail"]
    # Families on both sides of the limit, of sizes around the borders of the size bands.
    for words in (9, 16, 17, 33, 64, 70, 130, 260, 700):
        texts += _family(rng, 8, words, max(1, words // 25))
    # A hot passage that many different texts share, and chains of texts that drift apart.
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 70))) for _ in range(60)]
    chain = [f"c{i}" for i in range(200)]
    for step in range(12):
        chain[step * 7] = f"new{step}"
        texts.append(" ".join(chain))
    texts += ["same text in many rows of this table"] * 40
    rows = list(enumerate(texts, 1))
    rng.shuffle(rows)
    rows += [(5, "two ids are one"), (5, "two ids are one"), (None, "no id here at all"), (None, "one")]
    got = ngram_join.near_copies(docs_of(rows).repartition(5), n, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, n, percent)


def test_ngram_join_rounds(docs_of, monkeypatch):
    """With one pair a member allowed, hubs repeat; with none, members are compared at once."""
    rng = random.Random(3)
    rows = list(enumerate((t for _ in range(6) for t in _family(rng, 12, 120, 5)), 1))
    want = brute(rows, 4, 85)
    for pairs, stars in ((0, 3), (10**9, 1)):
        monkeypatch.setattr(ngram_join, "PAIRS", pairs)
        monkeypatch.setattr(ngram_join, "STARS", stars)
        monkeypatch.setattr(ngram_join, "TILE", 5)
        got = ngram_join.near_copies(docs_of(rows), 4, 85).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_entries_with_the_same_members_are_one(docs_of):
    """Pairs of near copies share dozens of entries each, and are listed under few."""
    rng = random.Random(11)
    rows = list(enumerate((t for _ in range(20) for t in _family(rng, 2, 150, 3)), 1))
    join = ngram_join._Join(docs_of(rows).repartition(3), 4, 85)
    listed = join.members().collect()
    assert len(listed) <= 2 * 20
    # Every class that shares an entry with another is still there, with that one.
    plain, told = {}, {}
    for r in join.rows.where("entries is not null").collect():
        for e in r["entries"]:
            plain.setdefault(e, set()).add(r["class_id"])
    for r in listed:
        told.setdefault(r["entry"], set()).add(r["class_id"])
    assert {frozenset(m) for m in plain.values() if len(m) > 1} == {frozenset(m) for m in told.values()}


@pytest.mark.parametrize("percent", [80, 85])
def test_entries_are_shared_across_band_borders(percent):
    """Sets at the limit share an entry, on both sides of a border; inside a band no set is entered twice."""
    rng = np.random.default_rng(percent)
    for n in (5, 7, 15, 16, 17, 62, 64, 70, 250, 256, 300, 1020, 1024, 1100, 4000, 4200):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        spare = rng.integers(0, 2**63, n).astype(np.uint64)
        for _ in range(20):
            changed = rng.integers(0, n * (100 - percent) // 100 + 1)
            kept = rng.permutation(a)[changed:]
            b = np.unique(np.append(kept, spare[: rng.integers(0, n * 100 // percent - n + 1)]))
            if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) and len(np.setxor1d(a, b)):
                assert set(ngram_join.entries(a, percent)) & set(ngram_join.entries(b, percent)), (n, len(b))
    for n in (20, 30, 60 * percent // 100, 70, 120, 200, 500, 800):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert len(ngram_join.entries(a, percent)) <= n * (100 - percent) // percent + 1


def test_ngram_join_empty(docs_of):
    assert ngram_join.near_copies(docs_of([])).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (6, 40, 700, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.append(a[n // 20 :], rng.integers(0, 2**63, n // 20).astype(np.uint64)))
        apart = len(np.setxor1d(a, b))
        for blocks in (4, 16, 64):
            x, y = ngram_join.parity_words(a, blocks), ngram_join.parity_words(b, blocks)
            assert np.bitwise_count(x ^ y).sum() <= apart
        wide = ngram_join.parity_words(a, 64)
        assert (np.bitwise_xor.reduce(wide.reshape(4, 16)) == ngram_join.parity_words(a, 16)).all()
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            assert set(ngram_join.entries(a, 85)) & set(ngram_join.entries(b, 85))


def test_block_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(block_search, "QUERIES", 7)
    monkeypatch.setattr(block_search, "CANDIDATES", 40)
    monkeypatch.setattr(block_search, "STRIP", 16)
    rng = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(150)]
    vectors += [(200 + i, vectors[3][1]) for i in range(5)]  # ties
    usable = list(vectors)
    vectors += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0] * 7 + [None]), (304, [float("nan")] * 8),
                (305, [float("inf")] * 8), (None, [1.0] * 8), (306, [1.0, 2.0])]
    usable.append((306, [1.0, 2.0]))
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, score string, rank int")
    got = block_search.nearest(df, df.where("vec_id % 5 = 0"), k=6).orderBy("query_id", "rank").collect()
    want = []
    for q, x in usable:
        if q % 5:
            continue
        scores = [(-(np.array(x) * np.array(y)).sum(), c) for c, y in usable if c != q and len(y) == len(x)]
        want += [(q, k, c, -s) for k, (s, c) in enumerate(sorted(scores)[:6], 1)]
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([r.score for r in got], [w[3] for w in sorted(want)], rtol=1e-14)
    assert block_search.nearest(df.limit(0), df.limit(0)).count() == 0


def _plain_nearest(rows, step, k):
    for q, x in rows:
        if q % step == 0:
            scored = sorted((-float(np.dot(np.array(x), np.array(c))), i) for i, c in rows if i != q)
            yield from ((q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1))


def test_block_search_at_extreme_magnitudes(spark):
    """Norms beyond the range of doubles, and vectors of the smallest numbers there are."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) * 10.0 ** (100 if i % 3 == 0 else -160 if i % 3 == 1 else 0) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(100 + i, [5e-324 * int(x) for x in rng.integers(1, 9, 6)]) for i in range(6)] + [(200, [1e200] * 6), (205, [1e200] * 6), (210, [-1e200] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = block_search.nearest(df, df.where("vec_id % 5 = 0"), k=7).collect()
    with np.errstate(over="ignore"):
        want = {(q, r): (i, s) for q, r, i, s in _plain_nearest(rows, 5, 7)}
    assert len(got) == len(want)
    for r in got:
        i, s = want[r["query_id"], r["rank"]]
        assert r["vec_id"] == i and (r["score"] == s or abs(r["score"] - s) <= 1e-12 * abs(s))


def test_block_search_of_long_vectors(spark):
    """4,096 dimensions of near ties: partial sums of 8-bit products exceed what float32 holds."""
    rng = np.random.default_rng(6)
    base = np.abs(rng.normal(size=4096)) + 1
    rows = [(i, (base + 1e-4 * rng.normal(size=4096)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in block_search.nearest(df, df.where("vec_id % 10 = 0"), k=10).collect()}
    assert got == {(q, r): i for q, r, i, _ in _plain_nearest(rows, 10, 10)}


def test_decontamination_tolerates_substitutions(spark, docs_of, monkeypatch):
    rng = random.Random(4)
    items = {i: [f"w{rng.randrange(500)}" for _ in range(n)] for i, n in enumerate((40, 25, 14, 12, 7, 5, 4), 1)}

    def around(words):
        fill = [f"f{rng.randrange(10**6)}" for _ in range(30)]
        return " ".join(fill[:15] + words + fill[15:])

    def changed(words, every):
        return [f"z{k}" if k % every == every - 1 else w for k, w in enumerate(words)]

    rows = [(i, around(w).upper() if i % 2 else around(w).replace(" ", ",\n")) for i, w in items.items()]
    rows += [(11, around(changed(items[1], 9))), (12, around(items[1][:16])), (13, around(items[1][:8])),
             (14, " ".join(items[3])), (15, None), (16, ""), (17, LONG), (18, around(items[1] + items[2])),
             (18, around(items[2])), (19, around(changed(items[1], 2))), (None, around(items[2])),
             (20, around(changed(items[5], 4))), (21, " ".join(items[7]))]
    bench = spark.createDataFrame(
        [(i, " ".join(w), 1) for i, w in items.items()] + [(90, None, 1), (91, "", 1)], "item_id long, text string, matched int")
    want = sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (11, 1), (12, 1), (14, 3), (18, 1), (18, 2), (20, 5), (21, 7), (None, 2)], key=str)
    found = decontamination.contaminated(docs_of(rows), bench)
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == want
    # The way for a benchmark that is too large to send.
    monkeypatch.setattr(decontamination, "SMALL_SEEDS", 0)
    found = decontamination.contaminated(docs_of(rows), bench)
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == want
    assert decontamination.contaminated(docs_of([]), bench).count() == 0
    assert decontamination.contaminated(docs_of(rows), bench.limit(0)).count() == 0


def _plain_runs(equal):
    """(matched, -aligned) of the run that matches most words."""
    best, score, peak, matched, words = (0, 0), 0, 0, 0, 0
    for e in equal:
        score, matched, words = score + (1 if e else -3), matched + e, words + 1
        if score <= 0:
            score = peak = matched = words = 0
        elif score > peak:
            peak, best = score, max(best, (matched, -words))
    return best


def _plain_overlaps(rows, items, least=13):
    """Every way of laying every item beside every document."""
    found = {}
    for doc, text in rows:
        words = re.findall(r"[a-z0-9]+", (text or "").lower())
        for item, wanted in items.items():
            n = len(wanted)
            for d in range(1 - n, len(words)):
                equal = [words[d + k] == wanted[k] for k in range(n) if 0 <= d + k < len(words)]
                got = (sum(equal), -len(equal)) if n < least else _plain_runs(equal)
                ok = got[0] >= least if n >= least else words == wanted if n < 5 else 5 * got[0] >= 4 * n
                if ok:
                    found[doc, item] = max(found.get((doc, item), (0, 0)), got)
    return {(d, i, len(items[i]), m, -a) for (d, i), (m, a) in found.items()}


@pytest.mark.parametrize("small", [True, False])
def test_decontamination_measures_whole_overlaps(spark, docs_of, monkeypatch, small):
    """Long runs to their ends; each place of short items where four fifths match, at the edges too."""
    if not small:
        monkeypatch.setattr(decontamination, "SMALL_SEEDS", 0)
    rng = random.Random(11)
    items = {n: [f"w{rng.randrange(9)}" if n < 13 else f"v{rng.randrange(900)}" for _ in range(n)] for n in (*range(1, 14), 30, 200)}
    rows = [(1, " ".join(items[200])), (2, "x " + " ".join(f"z{k}" if k % 5 == 4 else w for k, w in enumerate(items[200]))),
            (3, " ".join(items[200][:90] + ["q"] * 60 + items[200][150:])), (4, " ".join(items[30] * 3))]
    for n in range(1, 13):
        for k in range(12):
            words = list(items[n])
            for at in rng.sample(range(n), min(n, k % 4)):
                words[at] = "y"
            cut = words[k % 3 :] if k % 2 else words[: n - k % 3]
            pad = [f"w{rng.randrange(9)}" for _ in range(rng.choice((0, 0, 2, 30)))]
            rows.append((100 * n + k, " ".join(pad + cut if k % 2 == 0 else cut + pad)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {tuple(r) for r in decontamination.contaminated(docs_of(rows), bench).select(
        "doc_id", "item_id", "item_words", "matched", "aligned").collect()}
    assert got == _plain_overlaps(rows, items)
    assert {(1, 200, 200, 200, 200), (2, 200, 200, 160, 199)} <= got
