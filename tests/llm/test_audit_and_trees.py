"""SimHash index, filter audit, Merkle manifest: against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lisura.llm import filter_audit, manifest, simhash_index

from .conftest import LONG

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, code string, part int, key int, idx string, n string,"
    " `my col` map<string,int>, rank date"
)


def frame(spark, rows):
    """documents from (doc_id, text, lang), with columns that clash with the operators' own names."""
    return spark.createDataFrame(
        [(i, t, g, "s" if i is None or i % 2 else None, len(t) if t else None, "c", 1, 2, "3", "4", {"a": 1}, None) for i, t, g in rows], SCHEMA)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# SimHash


def plain_fingerprint(text):
    w = _words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(codes, limit):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(codes)), 2):
        if (codes[i] ^ codes[j]).bit_count() <= limit:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(codes))]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\r", "one", "ONE", "two words", "É x y z", LONG, LONG + " tail", "$ & |" * 50]
    for _ in range(12):
        base = [f"b{rng.randrange(400)}" for _ in range(rng.choice((40, 120, 400)))]
        for _ in range(rng.randrange(1, 14)):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(999)}"
            texts.append(" ".join(text))
    texts += texts[:20]
    rows = [(None if i % 17 == 5 else rng.randrange(10**6) - 500, t, "en") for i, t in enumerate(texts)]
    got = simhash_index.near_copies(frame(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    codes = [plain_fingerprint(t) for _, t, _ in rows]
    root, least = classes(codes, 2), {}
    for (i, _, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = [(i, f"{c:016x}", least.get(r)) for (i, _, _), c, r in zip(rows, codes, root, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len(set(root)) < len(set(codes))
    assert simhash_index.near_copies(frame(spark, [])).count() == 0


def gray_sorted(codes):
    def rank(c):
        for k in (1, 2, 4, 8, 16, 32):
            c ^= c >> k
        return c

    return np.array(sorted(set(codes), key=rank), np.uint64)


def clustered(rng, n):
    """Codes around few centres, so that many lie within few bits, and some at random."""
    centres = [rng.getrandbits(64) for _ in range(n // 40)]
    near = [rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for _ in range(n)]
    return near + [rng.getrandbits(64) for _ in range(n // 4)]


@pytest.mark.parametrize("limit", [0, 1, 2, 3])
def test_links_inside_and_between_blocks_are_exact(limit):
    rng = random.Random(limit)
    codes = gray_sorted(clustered(rng, 700))
    want = {(i, j) for i, j in combinations(range(len(codes)), 2) if int(codes[i] ^ codes[j]).bit_count() <= limit}
    tree = simhash_index.tree(codes, simhash_index.INNER)
    got = [(a, b) for i, j in simhash_index.links(tree, tree, limit, True) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert set(got) == want and len(got) == len(want)
    for cut in (1, 300, len(codes) - 5):
        x, y = (simhash_index.tree(c, simhash_index.INNER) for c in (codes[:cut], codes[cut:]))
        got = {(a, b + cut) for i, j in simhash_index.links(x, y, limit, False) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == {(a, b) for a, b in want if a < cut <= b}


def test_index_of_many_blocks_is_exact(spark):
    """Blocks of 16 and nodes of 3: several upper levels; half of the codes in one family."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    codes = clustered(rng, 500) + [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(600)]
    codes = sorted(set(codes))
    df = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "code long")
    nodes, blocks = simhash_index.build(df, block=16, fan=3)
    pairs = simhash_index.block_pairs(nodes, 2)
    edges = simhash_index.forest(pairs, blocks, 2).collect()
    assert pairs.count() < blocks.count() * (blocks.count() + 1) / 2
    root = dict(zip(codes, classes(codes, 2), strict=True))
    joined = {c: c for c in codes}

    def find(c):
        while joined[c] != c:
            c = joined[c]
        return c

    for a, b in edges:
        a, b = (int(np.int64(v).view(np.uint64)) for v in (a, b))
        assert root[a] == root[b]
        joined[find(a)] = find(b)
    assert len({find(c) for c in codes}) == len(set(root.values()))
    assert blocks.count() > 40


# Filter audit


def plain_masks(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t, w = t or "", _words(t)
        failed = (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search("[#$%&*|]", t)), t in least and (i is None or i > least[t]))
        yield lang or "", {"ABCDE"[k] for k, f in enumerate(failed) if f}, i in good, i in toxic


def plain_audit(masks):
    masks = list(masks)
    for part in {p for p, *_ in masks}:
        mine = [m[1:] for m in masks if m[0] == part]
        rows, shapley = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                out = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                fails = [m for m in mine if f in m[0]]
                shapley[f] += len(out)
                rows.append((f, part, order, step, len(left), len(out), len(fails) - len(out), sum(m[0] == {f} for m in mine),
                             sum(m[1] for m in out), sum(m[2] for m in out)))
        yield from ((*r[1:], shapley[r[0]]) for r in rows)


def test_audit_equals_plain_simulation(spark):
    rng = random.Random(3)
    many = [" ".join(f"w{rng.randrange(k)}" for _ in range(n)) for k, n in ((10**6, 120), (30, 150), (10**6, 100), (10**6, 99), (85, 105))]
    texts = [None, "", "  ", "short", "ABC DEF", "a|b", LONG, *many, many[0].upper(), many[0] + " #", many[1].title() + " %", many[2]]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "fr"])) for _ in range(160)]
    rows += [(7, many[0], "en")] * 3 + [(900, many[0], "en")] * 40  # repeated rows, one text shared by many
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, *range(50), 7, 7, 900]]
    frames = frame(spark, rows), spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(filter_audit.mask_counts(*frames))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(plain_audit(plain_masks(rows, labels)))


def test_audit_without_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.mask_counts(frame(spark, []), labels)).count() == 0
    got = filter_audit.audit(filter_audit.mask_counts(frame(spark, [(1, None, None)]), labels))
    assert got.count() == 600 and got.where(F.col("removed") > 0).count() == 120


@pytest.mark.parametrize("n", [1, 3, 5])
def test_intervals_cover_every_order_once(n):
    removed = Counter()
    for mask, step, first, after in filter_audit.intervals(n):
        for rank in range(first, after):
            removed[mask, rank] += 1
            order = list(permutations(range(n)))[rank]
            assert next(k for k, f in enumerate(order, 1) if mask >> f & 1) == step
    assert set(removed.values()) == {1} and len(removed) == (2**n - 1) * len(list(permutations(range(n))))


# Manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    def written(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha(*[written(row[c]) for c in ("doc_id", "source", "lang", "n_chars")], written(text))


def plain_tree(nodes):
    """(root, one list of (left, right) per node)"""
    paths, level, at = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level, at = [sha(*level[k : k + 8]) for k in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0], paths


def plain_manifest(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    langs = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(by_lang[g], key=lambda x: x[:3])]) for g in langs}
    root, upper = plain_tree([trees[g][0] for g in langs])
    for k, g in enumerate(langs):
        for (_, _, leaf, r), path in zip(sorted(by_lang[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            path, end = path + upper[k], leaf
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                end = plain_leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            for left, right in path:
                end = sha(left, end, right)
            yield r["doc_id"], leaf, trees[g][0], root, sha(*[a + b for a, b in path]), end


@pytest.mark.parametrize("block", [8, 64])
def test_manifest_equals_plain_trees(spark, monkeypatch, block):
    monkeypatch.setattr(manifest, "BLOCK", block)
    rng = random.Random(block)
    sizes = {"en": 600, "fr": 65, "de": 64, "": 9, None: 8, "é": 1, "zz": 2, **{f"x{k}": 1 for k in range(9)}}
    rows = [(rng.randrange(-50, 5000), rng.choice([None, "", "abc", "ABC def", "Ünï", LONG[:2000].upper()]), g) for g, n in sizes.items() for _ in range(n)]
    rows += [(None, "A", "en"), (None, "A", "en"), (12, "same", "fr"), (12, "same", "fr")]
    docs = frame(spark, rows)
    made = manifest.manifest(docs)
    got = made.select("doc_id", "leaf", "subroot", "root", manifest.proof_hash(F.col("path")), manifest.folded(F.col("tampered"), F.col("path")))
    got = sorted(map(tuple, got.collect()), key=str)
    want = sorted(plain_manifest([r.asDict() for r in docs.collect()]), key=str)
    assert got == want
    assert 0 < sum(r[3] == r[5] for r in got) < len(got)


def test_manifest_of_little(spark):
    assert manifest.manifest(frame(spark, [])).count() == 0
    one = manifest.manifest(frame(spark, [(1, "A", "en")])).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []
