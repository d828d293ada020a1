"""Language of texts and pages by Bayesian fusion of four kinds of evidence.

1. Text: multinomial model of hashed byte trigrams for each language, over
   the whole text.  Trigrams overlap, so their evidence counts as much as
   ``EVIDENCE`` independent ones at most.
2. Declared language of the markup, 3. address (language directory, or else
   the last label of the host): how often each value goes with each language,
   by grouped sums of the text posteriors, smoothed.
4. Host: share of each language on the host, smoothed towards its domain, that
   towards the last label, and that towards all rows: grouped sums again, so a
   host of one row leans on its parents and a large one on itself.

The text model learns from about ``SAMPLE`` labelled rows of each language,
chosen by hash of the id; everything else covers all rows.  With more than
``LANGUAGES`` labelled languages, the most frequent ones are classes of their
own and all others together are one, ``OTHER``, learned and answered like a
language (and one with a language of that very name).

Cases: null and empty texts rest on the other evidence; absent values of any
evidence say nothing; without labelled rows every language is null; rows with
null ids take part; repeated rows are judged each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisura.llm.common import ascii_lower, checkpoint, text_batches

#: Hashed trigrams; labelled rows of each language (about); classes of the model, and the name of the class of all languages beyond.
BUCKETS, SAMPLE, LANGUAGES, OTHER = 1 << 15, 2_000, 64, "other"
#: Trigrams that count as independent evidence; rows that a parent's share weighs; smoothing of values.
EVIDENCE, PARENT, SMOOTH = 60.0, 8.0, 1.0


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased text between blanks."""
    raw = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    code = (raw[:-2] * 65_536 + raw[1:-1] * 256 + raw[2:]) * np.uint32(2_654_435_761)
    return (code >> np.uint32(32 - 15)).astype(np.int64)


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of each trigram in each, from rows (id, text, lang)."""
    rows = labelled.where(F.col("lang").isNotNull()).select(
        "lang", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.xxhash64("id").alias("order"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    top = {r["lang"]: r["n"] for r in counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()}
    if len(top) > LANGUAGES:
        top = dict(list(top.items())[: LANGUAGES - 1])
        rest = counts.where(~F.col("lang").isin(*top)).agg(F.sum("n").alias("n")).first()["n"]
        rows = rows.withColumn("lang", F.when(F.col("lang").isin(*top), F.col("lang")).otherwise(F.lit(OTHER)))
        top[OTHER] = top.get(OTHER, 0) + rest
    languages = sorted(top)
    # Drawn by a hash and the counts, so that no text moves before it is drawn.
    draw = F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53))
    part = F.lit(0.0)
    for lang, n in top.items():
        part = F.when(F.col("lang") == lang, min(1.0, SAMPLE / n)).otherwise(part)
    some = rows.where(draw < part)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})

    counted = text_batches(some.select("lang", "text"), run, "lang string, bucket long, n long")
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        table[languages.index(r["lang"]), r["bucket"]] += r["n"]
    return languages, np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32)


def text_posterior(rows: DataFrame, model: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` and ``fit``, the scaled log-likelihood of ``text`` in each language."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model))
    texts = rows.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    kinds = ", ".join(f"{c} {t}" for c, t in texts.dtypes if c != "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for frame in frames:
            fits = []
            for text in frame["text"]:
                total = np.zeros(table.shape[1])
                codes = trigrams(text) if text else np.empty(0, np.int64)
                for i in range(0, len(codes), 1 << 16):
                    total += np.bincount(codes[i : i + (1 << 16)], minlength=BUCKETS) @ table if len(codes) > 8_192 else table[codes[i : i + (1 << 16)]].sum(0)
                total *= min(1.0, EVIDENCE / max(len(codes), 1))
                fits.append(total - total.max() if len(total) else total)
            out = frame[keep].copy()
            out["fit"] = fits
            yield out

    return text_batches(texts, run, f"{kinds}, fit array<double>")


def _shares(scores: list[Column]) -> list[Column]:
    """Probabilities from log scores."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    total = reduce(lambda a, b: a + b, parts)
    return [p / total for p in parts]


def _sums(rows: DataFrame, keys: list[str], n: int, prefix: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(f"p{i}").alias(f"{prefix}{i}") for i in range(n)])


def _smoothed(child: str, parent: str, n: int, out: str) -> list[Column]:
    total = reduce(lambda a, b: a + b, (F.col(f"{child}{i}") for i in range(n)))
    return [((F.col(f"{child}{i}") + PARENT * F.col(f"{parent}{i}")) / (total + PARENT)).alias(f"{out}{i}") for i in range(n)]


def host_priors(rows: DataFrame, n: int) -> DataFrame:
    """(host, h0..): language shares of every host, smoothed level by level."""
    # Each level sums the level below, so rows are read once.
    hosts = checkpoint(_sums(rows.where(F.col("host").isNotNull()), ["host"], n, "p").select(
        "host", F.element_at(F.split("host", "\\."), -1).alias("suffix"),
        F.substring_index("host", ".", -2).alias("domain"), *[f"p{i}" for i in range(n)]))
    domains = _sums(hosts, ["domain", "suffix"], n, "d")
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"p{i}").alias(f"s{i}") for i in range(n)])
    total = hosts.agg(*[F.coalesce(F.sum(f"p{i}"), F.lit(0.0)).alias(f"p{i}") for i in range(n)]).first()
    everything = sum(total) + n * SMOOTH
    suffixes = suffixes.select("suffix", *[F.col(f"s{i}") for i in range(n)], *[
        F.lit((total[i] + SMOOTH) / everything).alias(f"g{i}") for i in range(n)])
    suffixes = suffixes.select("suffix", *_smoothed("s", "g", n, "sp"))
    domains = domains.join(suffixes, "suffix").select("domain", *_smoothed("d", "sp", n, "dp"))
    return hosts.join(domains, "domain").select("host", *_smoothed("p", "dp", n, "h"))


def _value_evidence(rows: DataFrame, column: str, n: int, prefix: str) -> DataFrame:
    """(value, log-probability of the value in each language), smoothed over the values seen."""
    seen = checkpoint(_sums(rows.where(F.col(column).isNotNull()), [column], n, "q"))
    total = seen.agg(F.count(F.lit(1)).alias("values"), *[F.coalesce(F.sum(f"q{i}"), F.lit(0.0)).alias(f"t{i}") for i in range(n)]).first()
    return seen.select(column, *[
        F.log((F.col(f"q{i}") + SMOOTH) / F.lit(total[f"t{i}"] + SMOOTH * (total["values"] + 1))).alias(f"{prefix}{i}") for i in range(n)])


def identify(rows: DataFrame, languages: list[str], model: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep``, language, probability, and the language by text alone.

    ``rows`` have text, declared, address and host; the last three may be null.
    """
    n = len(languages)
    if not n:
        none = F.lit(None)
        return rows.select(*keep, none.cast("string").alias("language"), none.cast("double").alias("probability"),
                           none.cast("string").alias("by_text"))
    # Kept columns go by other names on the way, so that none clashes with the columns made here.
    kept = [f"_kept_{c}" for c in keep]
    rows = rows.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], "text", "declared", "address", "host")
    own = [*kept, "declared", "address", "host"]
    read = checkpoint(text_posterior(rows, model, own))
    fits = [F.col("fit")[i] for i in range(n)]
    read = read.select(*own, *[f.alias(f"f{i}") for i, f in enumerate(fits)], *[p.alias(f"p{i}") for i, p in enumerate(_shares(fits))])
    joined = (
        read.join(_value_evidence(read, "declared", n, "m"), "declared", "left")
        .join(_value_evidence(read, "address", n, "a"), "address", "left")
        .join(host_priors(read, n), "host", "left")
    )
    zero = F.lit(0.0)
    scores = [
        F.col(f"f{i}") + F.coalesce(f"m{i}", zero) + F.coalesce(f"a{i}", zero) + F.coalesce(F.log(f"h{i}"), zero)
        for i in range(n)
    ]
    final = _shares(scores)

    def best(shares: list[Column]) -> Column:
        # The first language of equal ones.
        return reduce(lambda found, i: F.when(shares[i] >= F.greatest(*shares) if n > 1 else F.lit(True), F.lit(languages[i])).otherwise(found),
                      reversed(range(n)), F.lit(None).cast("string"))

    judged = joined.select(*kept, *[F.col(f"p{i}") for i in range(n)], *[s.alias(f"z{i}") for i, s in enumerate(final)])
    z = [F.col(f"z{i}") for i in range(n)]
    return judged.select(
        *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], best(z).alias("language"), (F.greatest(*z) if n > 1 else z[0]).alias("probability"),
        best([F.col(f"p{i}") for i in range(n)]).alias("by_text"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Visible text, declared language, address and host of raw pages."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    shown = F.regexp_replace(html, "(?i)<(?:script|style)[^<]*|<[^<>]*>", " ")
    declared = F.lower(F.regexp_extract(html, "(?i)<html[^<>]*\\slang\\s*=\\s*[\"']?([a-z]{2,3})", 1))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = ascii_lower(F.regexp_extract(url, "^[^/?#]*://([^/?#:]*)", 1))
    folder = F.lower(F.regexp_extract(url, "^[^/?#]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.regexp_extract(host, "\\.([a-z]{2,})$", 1)
    address = F.when(folder != "", F.concat(F.lit("/"), folder)).when(suffix != "", F.concat(F.lit("."), suffix))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), shown.alias("text"),
        F.nullif(declared, F.lit("")).alias("declared"), address.alias("address"), F.nullif(host, F.lit("")).alias("host"),
    )
