"""Benchmark passages in documents, found by spaced seeds and verified with substitutions allowed.

A mask checks some positions of a short window of words and ignores the
others.  The hash of the checked words is a seed; documents and benchmark
items are joined on seeds, so a passage is found although words at ignored
positions were replaced.  For each hit the document is laid beside the whole
item and the runs of aligned words are measured (a match counts 1, another
word -3; a run ends where its sum is spent).  A pair is reported when a run
matches ``least`` words.  An item of fewer words is reported when four fifths
of them match, counted over the whole item.

Items of fewer than ``SHORT`` words have masks of their own length, which leave
out every choice of fifths that the rule of four fifths allows to differ; each
place where the rule holds is found, also at the edges of a document.  Items
of fewer than ``WHOLE`` words are no passage: they match a document that
consists of the same words.

DataFrame functions only.  Words are lower-cased runs of letters and digits.

Cases: null and empty texts match nothing; repeated rows give one row; a null
doc_id or item_id is reported as null; an empty table gives no rows; other
columns are ignored; a hit carries as many words as its item has.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: the word counts for the seed; 0: it is ignored.  Ten words each, seven of them checked.
MASKS = ("1101011011", "1011100111")
SPAN = 10
#: Items of fewer words have masks of their own length; of fewer words than ``WHOLE``, they are compared with whole texts.
SHORT, WHOLE = 13, 5
#: Seeds of the benchmark that are sent to every task at most, and the characters of its items; beyond it, both sides are shuffled.
SMALL_SEEDS, SMALL_CHARS = 200_000, 16_000_000


def text_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    clean = F.btrim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def _seed(words: Column, at: Column, places: list[int], name: int) -> Column:
    return F.xxhash64(F.lit(name), *[F.get(words, at + k) for k in places])


def short_masks(length: int) -> list[list[int]]:
    """Places that each mask of a short item checks: all but one choice of its fifths, as many as may differ."""
    gone = combinations(range(5), length // 5)
    return [[k for k in range(length) if k % 5 not in out] for out in gone]


def _seeds(rows: DataFrame, lengths: list[int], items: bool) -> list[DataFrame]:
    """Every (seed, at) of ``words``: one per mask and place, and those of the lengths of short items.

    ``items``: rows are items, whose own length decides; else documents, in
    which an item may begin before the first word or end after the last one,
    by as many words as may differ (absent words are not hashed).
    The frames are to be narrowed or joined before they are stacked: a row of
    each place of a long text would otherwise be held with all its words.
    """
    places = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
    n = F.size("words")
    masked = F.array(*[_seed(F.col("words"), F.col("at"), p, k) for k, p in enumerate(places)])
    every = rows.where(n >= (SHORT if items else SPAN)).withColumn("at", F.explode(F.sequence(F.lit(0), n - SPAN)))
    found = [every.withColumn("seed", F.explode(masked))]
    for length in lengths:
        over = length // 5
        fits = rows.where(n == length if items or length < WHOLE else n >= length - over)
        if items or length < WHOLE:
            runs = fits.withColumn("at", F.lit(0))
        else:
            runs = fits.withColumn("at", F.explode(F.sequence(F.lit(-over), n - length + over)))
        own = [_seed(F.col("words"), F.col("at"), p, 100 * length + k) for k, p in enumerate(short_masks(length))]
        found.append(runs.withColumn("seed", F.explode(F.array(*own))))
    return found


def _stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _best_run(flags: Column) -> Column:
    """(matched, words) of the run that matches most words, each run cut at its highest sum."""
    zero = "cast(0 as int)"
    kind = "struct<score:int,matched:int,words:int,peak:int,best_matched:int,best_words:int>"
    start = F.expr(f"cast(struct({', '.join([zero] * 6)}) as {kind})")

    def step(s: Column, hit: Column) -> Column:
        score = s["score"] + F.when(hit, F.lit(1)).otherwise(F.lit(-3))
        goes_on = score > 0
        matched = F.when(goes_on, s["matched"] + hit.cast("int")).otherwise(F.lit(0))
        length = F.when(goes_on, s["words"] + 1).otherwise(F.lit(0))
        better = (score > s["peak"]) & (matched > s["best_matched"])
        return F.struct(
            F.greatest(score, F.lit(0)).alias("score"), matched.alias("matched"), length.alias("words"),
            F.when(goes_on, F.greatest(score, s["peak"])).otherwise(F.lit(0)).alias("peak"),
            F.when(better, matched).otherwise(s["best_matched"]).alias("best_matched"),
            F.when(better, length).otherwise(s["best_words"]).alias("best_words"),
        ).cast(kind)

    return F.aggregate(flags, start, step)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13) -> DataFrame:
    """One row per (doc_id, item_id) with a verified overlap: matched and aligned words of its best run."""
    best = F.max(F.struct("matched", -F.col("aligned"))).alias("best")
    return (
        _verified(docs, benchmark, least)
        .groupBy("doc_id", "item_id", "item_words")
        .agg(best)
        .select("doc_id", "item_id", F.col("item_words").cast("long"), F.col("best.matched").cast("long").alias("matched"),
                (-F.col("best.col2")).cast("long").alias("aligned"))
    )


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, least: int = 13) -> DataFrame:
    """(doc_id, hash) of every text with a verified overlap, repeated per overlap; ``hash`` is ``text_hash``."""
    return _verified(docs, benchmark, least).select("doc_id", "hash")


def _verified(docs: DataFrame, benchmark: DataFrame, least: int) -> DataFrame:
    """Verified overlaps: doc_id, hash of the text, item_id, item_words, matched, aligned."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_words(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).distinct()
    size = items.agg(
        F.coalesce(F.sum(F.size("words") * len(MASKS)), F.lit(0)).alias("seeds"),
        F.coalesce(F.sum(F.length(F.concat_ws(" ", "words"))), F.lit(0)).alias("chars"),
        F.collect_set(F.when(F.size("words") < SHORT, F.size("words"))).alias("short"),
    ).first()
    small = size["seeds"] <= SMALL_SEEDS and size["chars"] <= SMALL_CHARS
    share = F.broadcast if small else (lambda df: df)
    keyed = items.withColumn("item", F.xxhash64("item_id", "words"))
    keys = [k.select("seed", F.col("at").alias("item_at"), "item", F.size("words").alias("item_size")) for k in _seeds(keyed, sorted(size["short"]), True)]
    keys = _stacked(keys).distinct()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("hash"),
        text_words(F.col("text")).alias("words"))
    seeds = _seeds(rows, sorted(size["short"]), False)
    if small:
        hits = _stacked([s.join(share(keys), "seed") for s in seeds])
    else:
        # Seeds travel without their text; only hits meet it again.
        narrow = _stacked([s.select("doc_id", "hash", "at", "seed") for s in seeds])
        met = narrow.join(keys, "seed").distinct().alias("m")
        own = rows.alias("r")
        same = (F.col("m.hash") == F.col("r.hash")) & F.col("m.doc_id").eqNullSafe(F.col("r.doc_id"))
        hits = own.join(met, same).select("r.doc_id", "r.hash", "r.words", "m.at", "m.item_at", "m.item", "m.item_size")
    # Only the words beside the item go on, once for each way of laying them.
    item_from, doc_from = F.greatest(F.col("item_at") - F.col("at"), F.lit(0)), F.greatest(F.col("at") - F.col("item_at"), F.lit(0))
    hits = hits.select(
        "doc_id", "hash", "item", item_from.alias("item_from"), doc_from.alias("doc_from"),
        F.slice("words", doc_from + 1, F.col("item_size") - item_from).alias("beside"),
    ).dropDuplicates(["doc_id", "hash", "item", "item_from", "doc_from", "beside"])
    named = share(keyed.select("item", "item_id", F.col("words").alias("item_words")))
    laid = hits.join(named, "item")
    part = F.slice("item_words", F.col("item_from") + 1, F.size("beside"))
    n = F.least(F.size(part), F.size("beside"))
    equal = F.zip_with(F.slice("beside", F.lit(1), n), F.slice(part, F.lit(1), n), lambda a, b: a == b)
    whole = F.size("item_words")
    judged = laid.select("doc_id", "hash", "item_id", whole.alias("item_words"), equal.alias("equal"), _best_run(equal).alias("run"))
    small_item = F.col("item_words") < least
    judged = judged.select(
        "doc_id", "hash", "item_id", "item_words",
        F.when(small_item, F.size(F.filter("equal", lambda e: e))).otherwise(F.col("run.best_matched")).alias("matched"),
        F.when(small_item, F.size("equal")).otherwise(F.col("run.best_words")).alias("aligned"),
    )
    rule = (F.col("matched") >= least) | (small_item & (5 * F.col("matched") >= 4 * F.col("item_words")))
    return judged.where(rule & ((F.col("item_words") >= WHOLE) | (F.col("matched") == F.col("item_words"))))
