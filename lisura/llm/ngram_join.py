"""Exact n-gram Jaccard join of documents by parity sketches.

A set's sketch has B words; a shingle is XORed into one word, chosen by its
hash.  Two sketches differ in at most as many words (and, in the bit sketches
below, in at most as many bits) as their sets differ in shingles, D.  So at
least B - D words are equal, and of any fixed order of (word index, word value)
the first D + 1 entries of both documents must share one.  Words of many
shingles come first: they are rare, and empty words hardly ever count.  B is
fixed for a size band (a power of four of the set size), which makes words
comparable; a document that may be the smaller partner of the next band is
entered there too.

Documents with equal sets form one class, and only classes are joined.
Classes that share an entry are candidates.  Near copies share many entries, so
entries that the same classes have are made one.  A group of near copies shares
entries with everyone, so pairs are not listed: each entry's members are
compared with the member that occurs in most shared entries (the hub) and
connected classes are merged.  This is repeated with other hubs, ``STARS`` times
at most, while more than ``PAIRS`` pairs a member are open.  Then the members of an entry that lie
in different components are compared with each other, by the Hamming distance
of their 1,024-bit sketches inside the join condition.  Pairs that pass are
held against longer sketches (two bits a shingle or more), and what is left is
verified on the whole shingle sets.  Every link between different texts is
thus either verified or implied by components.

Set elements and class ids are 64-bit hashes.

Cases: null, empty and blank text have an empty set and are linked with
nothing; a text with fewer words than a shingle is one shingle; repeated rows
and equal texts are one class; rows with a null id take part, and a component
of such rows alone has a null id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lisura.llm.common import checkpoint, share, text_batches, word_list

#: Open pairs for each member of a shared entry at most, before members are compared with each other; rounds with hubs at most.
PAIRS, STARS = 10, 2
#: One class of so many is drawn to find frequent entries: those that so many drawn classes have, so many of them at most.
SAMPLE, OFTEN, FREQUENT = 64, 50, 10_000
#: A size band ends at ``2 ** BAND`` times its beginning: wide bands have few documents near their ends, which are entered twice.
BAND = 2
#: Words of the sketch that filters pairs, 64 bits each.
FILTER_WORDS = 16
#: Members of one entry that meet in one task.
TILE = 1_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(x | 1) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD[3]
    return x ^ (x >> np.uint64(32))


class WordHash(dict):
    """64-bit hashes of words, remembered within one task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, n: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words; of all words when there are fewer."""
    words = word_list(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    mixed = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        mixed = (mixed + h[k : k + len(mixed)]) * _ODD[k % 3]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(_stir(mixed))


def parity_words(shingles: np.ndarray, blocks: int) -> np.ndarray:
    """A bit sketch: ``blocks`` words of 64 bits, each shingle flipping one bit."""
    place = (shingles >> np.uint64(6)) % np.uint64(blocks) * np.uint64(64) + (shingles & np.uint64(63))
    odd = np.bincount(place.astype(np.int64), minlength=blocks * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def xor_words(shingles: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """XOR of the shingles' hashes in each word of the sketch, and their number."""
    at = ((shingles >> np.uint64(6)) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.append(True, sorted_at[1:] != sorted_at[:-1]))
    value = np.zeros(blocks, np.uint64)
    value[sorted_at[first]] = np.bitwise_xor.reduceat(_stir(shingles)[order], first)
    return value, np.bincount(at, minlength=blocks)


def entries(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys that two sets of Jaccard similarity ``percent`` / 100 or more must share one of."""
    n = len(shingles)
    found = []
    # Sets this small can only be linked with an equal set, which is the same class.
    if n * (100 - percent) // percent == 0:
        return np.empty(0, np.int64)
    band = (n.bit_length() - 1) // BAND
    for k in (band, band + 1):
        low, high = 2 ** (BAND * k), 2 ** (BAND * (k + 1)) - 1
        if 100 * n < percent * low:  # too small for a partner in this band
            continue
        most = 2 * high * (100 - percent) // (100 + percent)
        differ = min(n * (100 - percent) // percent, (n + high) * (100 - percent) // (100 + percent))
        blocks = (5 * (most + 1) + 3) // 4
        value, count = xor_words(shingles, blocks)
        key = _stir(value + _stir(np.arange(blocks, dtype=np.uint64) * np.uint64(128) + np.uint64(k)))
        first = np.lexsort((key, -count))[: differ + 1]
        found.append(key[first])
    return np.unique(np.concatenate(found)).view(np.int64)


def text_hash(text: Column) -> Column:
    """Tells apart rows that share an id; null counts as empty text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def wide_sketch(shingles: np.ndarray) -> np.ndarray | None:
    """A sketch of two to four bits a shingle, for sets that the filter sketch is too short for."""
    size = 1 << max(0, (2 * len(shingles) - 1).bit_length() - 6)
    return parity_words(shingles, size).view(np.int64) if size > FILTER_WORDS else None


def describe(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, class_id, and once per class and task its entries and sketches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen = WordHash(), set()
        for frame in frames:
            out = []
            for text in frame["text"]:
                s = shingle_set(text, n, hashes)
                if not len(s):
                    out.append((0, None, None, None, None))
                    continue
                class_id = int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))
                if class_id in seen:
                    out.append((len(s), class_id, None, None, None))
                    continue
                seen.add(class_id)
                sketch = parity_words(s, FILTER_WORDS).view(np.int64)
                out.append((len(s), class_id, entries(s, percent), sketch, wide_sketch(s)))
            sizes, ids, keys, short, wide = zip(*out, strict=True) if out else ([], [], [], [], [])
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "text_hash": frame["text_hash"], "n_shingles": pd.array(sizes, dtype="Int64"),
                "class_id": pd.array(ids, dtype="Int64"), "entries": list(keys), "sketch": list(short), "wide": list(wide)})

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    return text_batches(
        rows, run,
        "doc_id long, text_hash long, n_shingles long, class_id long, "
        "entries array<long>, sketch array<long>, wide array<long>",
    )


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(class_id, shingles) of the classes in ``wanted`` (class_id, doc_id), from the text of one document each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for frame in frames:
            sets = [shingle_set(t, n, hashes) for t in frame["text"]]
            ids = [np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64) for s in sets]
            found = pd.array([int(i) for i in ids], dtype="Int64")
            yield pd.DataFrame({"class_id": found, "shingles": [s.view(np.int64) for s in sets], "asked": frame["class_id"]})

    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    asked = wanted.select("class_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    found = text_batches(
        texts.join(share(asked), "id").select("class_id", "text"),
        run, "class_id long, shingles array<long>, asked long"
    )
    # Another text under the same id is not the class; repeated rows leave one.
    return found.where(F.col("class_id") == F.col("asked")).drop("asked").dropDuplicates(["class_id"])


def _bound(na: Column, nb: Column, percent: int) -> Column:
    """The largest symmetric difference of a linked pair."""
    return F.floor((na + nb) * (100 - percent) / (100 + percent))


def _apart(x: Column, y: Column) -> Column:
    """Hamming distance of two long sketches; the longer is folded to the length of the shorter."""
    def fold(long: Column, short: Column) -> Column:
        size = F.size(short)
        return F.transform(short, lambda _, i: F.aggregate(
            F.sequence(F.lit(0), (F.size(long) / size).cast("int") - 1), F.lit(0).cast("long"),
            lambda total, k: total.bitwiseXOR(F.get(long, (k * size + i).cast("int")))))

    x, y = F.when(F.size(x) > F.size(y), fold(x, y)).otherwise(x), F.when(F.size(y) > F.size(x), fold(y, x)).otherwise(y)
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, n: t + n)


def _may_differ(a: str, b: str, percent: int) -> Column:
    """Sizes and filter sketches do not rule the pair out."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    apart = reduce(
        lambda x, y: x + y,
        (F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(FILTER_WORDS)),
    )
    bound = _bound(na, nb, percent)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (apart <= bound)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over the links.

    Nodes take the smallest root among their neighbours, then the root of
    their root; both halve what is left, so the loop ends after few rounds.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("to"))
    both = checkpoint(both.union(both.select("to", "node")).distinct())
    roots = checkpoint(both.groupBy("node").agg(F.least("node", F.min("to")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("to"), F.col("root").alias("seen")), "to")
        least = near.groupBy("node").agg(F.min("seen").alias("seen"))
        better = roots.join(least, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        better = checkpoint(
            better.join(jump, "root").select("node", "old", F.least("root", "next").alias("root"))
        )
        changed = better.where(F.col("root") != F.col("old")).limit(1).count()
        roots = better.select("node", "root")
        if not changed:
            return roots


class _Join:
    """The state of one join: class members of shared entries, verified links, components."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.docs, self.n, self.percent = docs, n, percent
        self.spark = docs.sparkSession
        self.rows = checkpoint(describe(docs, n, percent))
        self.classes = self.rows.where(F.col("class_id").isNotNull()).groupBy("class_id").agg(
            F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"),
            F.max("wide").alias("wide"),
        )

    def members(self) -> DataFrame:
        """(entry, class_id) of the entries that two or more classes share.

        Entries move once.  Those that a fixed share of a sample of classes
        has are shared for certain; they are few and do not move at all, so no
        task gets the members of a frequent entry.  The others are then named
        by a hash of their members: those that the same classes have become
        one, and entries that a hash confuses only share more members.
        """
        listed = self.rows.select("class_id", F.explode("entries").alias("entry"))
        drawn = listed.where(F.pmod(F.xxhash64("class_id"), F.lit(SAMPLE)) == 0)
        often = drawn.groupBy("entry").agg(F.approx_count_distinct("class_id").alias("n"), F.min("class_id").alias("low"), F.max("class_id").alias("high"))
        often = often.where((F.col("low") < F.col("high")) & (F.col("n") >= OFTEN)).orderBy(F.desc("n"), "entry").limit(FREQUENT)
        often = F.broadcast(checkpoint(often.select("entry")))
        group = W.partitionBy("entry")
        rare = listed.join(often, "entry", "left_anti").withColumns({"low": F.min("class_id").over(group), "high": F.max("class_id").over(group)})
        # A class is listed once by each task that met it.
        rare = rare.where(F.col("low") < F.col("high")).select("entry", "class_id", "low", "high").distinct()
        rare = rare.withColumns({"n": F.count(F.lit(1)).over(group), "all": F.bit_xor(F.xxhash64("class_id")).over(group)})
        rare = rare.select(F.xxhash64("low", "high", "n", "all").alias("entry"), "class_id")
        return checkpoint(rare.distinct().unionByName(listed.join(often, "entry", "left_semi").select("entry", "class_id").distinct()))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough."""
        x = self.sketched.select(F.col("class_id").alias("a"), F.col("n_shingles").alias("na"), F.col("wide").alias("xa"))
        y = self.sketched.select(F.col("class_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("wide").alias("xb"))
        near = F.col("xa").isNull() | F.col("xb").isNull() | (
            _apart(F.col("xa"), F.col("xb")) <= _bound(F.col("na"), F.col("nb"), self.percent))
        pairs = checkpoint(pairs.join(x, "a").join(y, "b").where(near).select("a", "b"))
        # Both ends' sets come from one document of each class.
        ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
        wanted = checkpoint(self.sketched.join(ends, "class_id", "left_semi").select("class_id", "doc_id"))
        sets = _sets(self.docs, wanted, self.n)
        left = sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("left"))
        right = sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("right"))
        both = F.size(F.array_intersect("left", "right")).cast("long")
        total = F.size("left").cast("long") + F.size("right") - both
        return pairs.join(left, "a").join(right, "b").where(100 * both >= self.percent * total).select("a", "b")

    def run(self) -> DataFrame | None:
        """(class_id, root) of the classes that are linked with another."""
        members = self.members()
        inside = members.select("class_id").distinct()
        sketched = self.classes.join(inside, "class_id", "left_semi").select(
            "class_id", "doc_id", "n_shingles", "wide", *[F.col("sketch")[i].alias(f"s{i}") for i in range(FILTER_WORDS)]
        )
        self.sketched = checkpoint(sketched)
        # How many neighbours a class has over all its entries: copies of one text all share with that text.
        sizes = members.groupBy("entry").agg(F.count(F.lit(1)).alias("size"))
        weight = members.join(sizes, "entry").groupBy("class_id").agg(F.sum("size").alias("weight"))
        members = checkpoint(members.join(weight, "class_id"))
        links = tested = roots = None
        for turn in range(STARS + 1):
            if roots is None:
                open_members = members.withColumn("root", F.col("class_id"))
            else:
                named = members.join(
                    roots.withColumnRenamed("node", "class_id"), "class_id", "left"
                ).withColumn("root", F.coalesce("root", "class_id"))
                split = named.groupBy("entry").agg(F.min("root").alias("low"), F.max("root").alias("high"))
                split = split.where(F.col("low") < F.col("high")).select("entry")
                open_members = named.join(split, "entry")
            open_members = checkpoint(open_members)
            n = F.count(F.lit(1))
            left = open_members.groupBy("entry").agg(n.alias("n"), (n * (n - 1) / 2).alias("pairs")).agg(
                F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).first()
            if not left["n"]:
                break
            last = turn == STARS or (turn > 0 and left["pairs"] <= PAIRS * left["n"])
            pairs = self.between(open_members) if last else self.star(open_members, turn)
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = checkpoint(pairs)
            tested = pairs if tested is None else tested.union(pairs)
            found = checkpoint(self.verify(pairs))
            links = found if links is None else links.union(found)
            roots = components(links)
            if last:
                break
        return roots

    def _sketches(self, name: str) -> DataFrame:
        return self.sketched.drop("doc_id", "wide").withColumnRenamed("class_id", name)

    def star(self, members: DataFrame, turn: int) -> DataFrame:
        """Pairs of each entry's hub with its members in other components."""
        # The hub of a later turn is the best member outside the first hub's component.
        order = F.struct("weight", "class_id")
        best = F.max_by(F.struct("class_id", "root"), order).alias("hub")
        hubs = members.groupBy("entry").agg(best)
        if turn:
            rest = members.join(hubs, "entry").where(F.col("root") != F.col("hub.root")).drop("hub")
            hubs = rest.groupBy("entry").agg(best)
        pairs = (
            members.join(hubs, "entry")
            .where((F.col("class_id") != F.col("hub.class_id")) & (F.col("root") != F.col("hub.root")))
            .select(F.least("class_id", "hub.class_id").alias("a"), F.greatest("class_id", "hub.class_id").alias("b"))
            .distinct()
        )
        x, y = self._sketches("a").alias("x"), self._sketches("b").alias("y")
        return pairs.join(x, "a").join(y, "b").where(_may_differ("x", "y", self.percent)).select("a", "b")

    def between(self, members: DataFrame) -> DataFrame:
        """All pairs of an entry's members in different components that sketches do not rule out.

        Large entries are cut into tiles of members that meet on an equality
        key; the sketches are compared inside the join condition.
        """
        sizes = members.groupBy("entry").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
        rows = members.join(sizes, "entry").join(self._sketches("class_id"), "class_id")
        at = F.pmod(F.xxhash64("class_id"), F.col("tiles")).cast("int")
        rows = rows.withColumn("at", at)
        keep = ["class_id", "root", "n_shingles", *[f"s{i}" for i in range(FILTER_WORDS)]]
        x = rows.select("entry", F.col("at").alias("i"), F.explode(F.sequence("at", F.col("tiles") - 1)).alias("j"), *keep)
        y = rows.select("entry", F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("at").alias("j"), *keep)
        x, y = x.alias("x"), y.alias("y")
        same = (F.col("x.entry") == F.col("y.entry")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
        once = (F.col("x.i") != F.col("x.j")) | (F.col("x.class_id") < F.col("y.class_id"))
        pairs = x.join(y, same & once & (F.col("x.root") != F.col("y.root")) & _may_differ("x", "y", self.percent))
        a, b = F.col("x.class_id"), F.col("y.class_id")
        return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, class_id, group_id, component_id.

    Documents are linked when the Jaccard similarity of their sets of
    ``n``-word shingles is ``percent`` / 100 or more.  ``component_id`` is the
    smallest doc_id that links reach, the document's own included.  class_id
    and group_id (one per set of shingles, and per component) are null without
    words.
    """
    join = _Join(docs, n, percent)
    roots = join.run()
    named = join.classes.select("class_id", "doc_id")
    if roots is None:
        named = named.withColumn("group_id", F.col("class_id"))
    else:
        named = named.join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
        named = named.withColumn("group_id", F.coalesce("root", "class_id"))
    least = named.groupBy("group_id").agg(F.min("doc_id").alias("component_id"))
    groups = named.select("class_id", "group_id").join(least, "group_id")
    return (
        join.rows.select("doc_id", "text_hash", "n_shingles", "class_id")
        .join(groups, "class_id", "left")
        .select(
            "doc_id", "text_hash", "n_shingles", "class_id", "group_id",
            F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
