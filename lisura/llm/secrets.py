"""Secrets in texts: three base kinds, and weak parts that count only together.

Base spans are reported wherever they stand.  Multipart credential linking
adds weak parts: a name (``user = ...``), a bare 40-character key and an
endpoint (``scheme://...``).  None of them is evidence alone.  An interval
join of identifiers (access ids, names), secrets (assignments, bare keys) and
endpoints finds parts within ``SCOPE`` characters of each other: a name is
reported beside a secret, a bare key beside an identifier, an endpoint beside
both.  A weak part that overlaps a base span adds nothing and is left out.

DataFrame functions only.  Spans depend on the text alone, so equal texts are
worked on once, under a 96-bit key of the text.  Positions are code points, the
end exclusive.

Cases: null and empty texts have no spans; repeated rows get equal results;
texts of any length are read whole; an empty table gives no rows; other columns
are ignored (``scan``) or kept (``masked``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lisura.llm.common import checkpoint

#: Kinds in the order of listing: pattern, group that is measured, its least and greatest length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, None),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16, None),
    "hex": (r"[0-9a-f]{32,}", 0, 32, None),
    "user": (r"""(?i)(username|user|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", 2, 3, None),
    "key": (r"[A-Za-z0-9+/]{40,}", 0, 40, 40),
    "endpoint": (r"""(?i)(https?|jdbc:[a-z0-9]+|s3|amqps?|mongodb|postgres|mysql|redis)://([^\x20\x09-\x0D"'<>]+)""", 2, 4, None),
}
BASE = ("assign", "access", "hex")
#: Only texts with one of these can have a base span or linked parts.
ANY = (
    r"(?i:password|passwd|secret|token|api_?key|user|username|login|account|client_?id)[\x22']?\x20*[:=]"
    r"|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
)
#: Characters between two parts of one credential at most.
SCOPE = 200


def text_key() -> Column:
    """Stands for the text in joins."""
    return F.struct(F.xxhash64("text").alias("a"), F.crc32(F.col("text").cast("binary")).alias("b"))


def _pieces(kind: str) -> Column:
    """For each match: characters before it since the last match, of it, and whether it counts."""
    pattern, group, least, most = KINDS[kind]
    text, p = F.col("text"), F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    whole = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.char_length(x))

    def counts(x: Column) -> Column:
        ok = F.char_length(x) >= least
        if most:
            # A bare key also has capitals, small letters and digits.
            ok = ok & (F.char_length(x) <= most) & x.rlike("[A-Z]") & x.rlike("[a-z]") & x.rlike("[0-9]")
        return ok

    ok = F.transform(F.regexp_extract_all(text, p, F.lit(group)), counts)
    order = F.lit(list(KINDS).index(kind))
    rows = F.zip_with(gaps, F.arrays_zip(whole.alias("length"), ok.alias("ok")), lambda gap, m: F.struct(
        order.alias("kind"), gap.alias("gap"), m["length"].alias("length"), m["ok"].alias("ok")))
    # The last gap has no match after it.
    return F.filter(rows, lambda r: r["length"].isNotNull())


def _spans(texts: DataFrame) -> DataFrame:
    """(key, kind, start, end) of all matches that count; ``kind`` is the place in KINDS."""
    listed = reduce(
        lambda x, y: x.unionByName(y),
        (texts.select("key", F.posexplode(_pieces(kind)).alias("at", "m")) for kind in KINDS),
    ).distinct()
    upto = W.partitionBy("key", "m.kind").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.length")).over(upto)
    placed = listed.select("key", F.col("m.kind").alias("kind"), F.col("m.ok").alias("ok"), F.col("m.length").alias("n"), end.alias("end"))
    return placed.where("ok").select("key", "kind", (F.col("end") - F.col("n")).alias("start"), "end")


def _near(parts: DataFrame, others: DataFrame, name: str, gap: int) -> DataFrame:
    """The rows of ``parts`` with one of ``others`` at most ``gap`` characters away: a join of intervals by bins."""
    wide = max(gap, 1)
    first, last = F.floor((F.col("start") - gap) / wide), F.floor((F.col("end") + gap) / wide)
    left = parts.withColumn("bin", F.explode(F.sequence(first, last)))
    own = others.select(
        "key", F.col("start").alias("from"), F.col("end").alias("to"),
        F.explode(F.sequence(F.floor(F.col("start") / wide), F.floor(F.col("end") / wide))).alias("bin"),
    )
    met = left.join(own, ["key", "bin"]).where((F.col("from") < F.col("end") + gap) & (F.col("start") < F.col("to") + gap))
    return met.select("key", "kind", "start", "end").distinct().withColumn(name, F.lit(True))


def all_spans(texts: DataFrame) -> DataFrame:
    """Base spans and linked weak parts of (key, text) rows."""
    found = checkpoint(_spans(texts))
    at = {k: i for i, k in enumerate(KINDS)}
    base = found.where(F.col("kind") < len(BASE))
    weak = found.where(F.col("kind") >= len(BASE))
    # A place counts as covered when a base span has a character of it.
    covered = _near(weak, base, "covered", 0)
    weak = weak.join(covered, ["key", "kind", "start", "end"], "left_anti")
    parts = base.unionByName(weak)
    ids = parts.where(F.col("kind").isin(at["access"], at["user"]))
    keys = parts.where(F.col("kind").isin(at["assign"], at["key"]))
    asked = weak.join(_near(weak, ids, "by_id", SCOPE), ["key", "kind", "start", "end"], "left").join(
        _near(weak, keys, "by_secret", SCOPE), ["key", "kind", "start", "end"], "left")
    by_id, by_secret = F.col("by_id").isNotNull(), F.col("by_secret").isNotNull()
    linked = asked.where(
        ((F.col("kind") == at["user"]) & by_secret)
        | ((F.col("kind") == at["key"]) & by_id)
        | ((F.col("kind") == at["endpoint"]) & by_id & by_secret)
    )
    return base.unionByName(linked.select("key", "kind", "start", "end"))


def _text_of(rows: Column) -> Column:
    """kind:start:end of sorted (start, kind, end) rows, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(rows, lambda r: F.concat_ws(
        ":", F.get(names, r["kind"]), r["start"].cast("string"), r["end"].cast("string"))))


def _is(kind: int):
    return lambda r: r["kind"] == kind


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, digest of the base spans, all spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.when(F.col("text").rlike(ANY), text_key()))
    # The texts that have something are few, and are kept: the others are done with.
    some = checkpoint(rows.where(F.col("key").isNotNull()))
    spans = all_spans(some.select("key", "text"))
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    base = F.filter("listed", lambda r: r["kind"] < len(BASE))
    per_text = spans.groupBy("key").agg(listed.alias("listed")).select(
        "key",
        *[F.size(F.filter("listed", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.col("listed")).alias("spans"),
    )
    found = some.select("doc_id", "key").join(per_text, "key", "left")
    none = rows.where(F.col("key").isNull())
    empty = F.sha2(F.lit("").cast("binary"), 256)
    zero = [F.lit(0).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.coalesce("base_sha256", empty).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    ).unionByName(none.select("doc_id", *zero, empty.alias("base_sha256"), F.lit("").alias("spans")))


def masked(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents, every reported span of ``text`` replaced by ``mark``; all columns stay."""
    own = docs.columns
    held = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = held.withColumn("key", F.when(F.col("text").rlike(ANY), text_key()))
    some = checkpoint(held.where(F.col("key").isNotNull()))
    spans = all_spans(some.select("key", "text"))
    # Spans that overlap are replaced as one.
    earlier = W.partitionBy("key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, W.currentRow)
    begins = F.coalesce(F.col("start") >= F.max("end").over(earlier), F.lit(True)).cast("int")
    merged = (
        spans.withColumn("begins", begins)
        .withColumn("group", F.sum("begins").over(upto))
        .groupBy("key", "group")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    )
    joined = some.join(merged, "key", "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("cut", lambda c: c["end"]))
    starts = F.concat(F.transform("cut", lambda c: c["start"]), F.array(F.char_length("text").cast("long")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    clean = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(kept, mark))
    changed = joined.select(*[
        clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in own
    ])
    same = held.where(F.col("key").isNull()).select(*[F.col("row")[c].alias(c) for c in own])
    return same.unionByName(changed)
