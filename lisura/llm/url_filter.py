"""Allow or block addresses: longest rule first, else naive Bayes over segmented names.

Words are counted in the visible text of all pages.  Every distinct name of a
host is split into words by a unigram Viterbi search; its substrings find
their counts in a join, so the word table is never sent around.  Multinomial
naive Bayes over the words of the host and the tokens of the path, hashed to
``BUCKETS``, is trained on the addresses that rules decide and judges the others.

Cases: a null address, or one without ``://``, has an empty host and path and
gets the more frequent verdict; a name longer than a host label may be
(``LABEL`` characters) is one word; without rule-decided addresses of both
kinds everything undecided is allowed; ties allow; repeated rows are judged
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisura.llm.common import ascii_lower, checkpoint

#: Hashed tokens of the classifier, longest word, longest label of a host name.
BUCKETS, WORD, LABEL = 1 << 16, 24, 63


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both empty without ``://``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return pages.withColumn("host", ascii_lower(host)).withColumn("path", path)


def rule_of(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict; null when none fits."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        own = (F.col("host") == r.host) | F.col("host").endswith("." + r.host)
        fits = own & F.col("path").startswith(r.path)
        name = F.when(fits, F.lit(r.host + r.path)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) of the words in the visible text of all pages."""
    shown = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), "(?i)<(?:script|style)[^<]*|<[^<>]*>", " ")
    listed = pages.select(F.explode(F.split(ascii_lower(shown), "[^\\p{L}]+")).alias("word"))
    return listed.where(F.length("word").between(1, WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(name: str, found: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most likely words of a name; a string without a count costs ten times more with each letter."""
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - WORD), end):
            n = found.get((start, end - start), 0)
            log = np.log(n / total) if n else np.log(10.0 / total) - (end - start) * np.log(10.0)
            options.append((best[start] + log, start))
        score, start = max(options)
        best.append(score)
        back.append(start)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct names; counts come by a join on the names' substrings."""
    counts = checkpoint(counts)
    total = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    short = names.where(F.length("name").between(1, LABEL))
    starts = short.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("name"))))
    parts = starts.withColumn(
        "size", F.explode(F.sequence(F.lit(1), F.least(F.lit(WORD), F.length("name") - F.col("at") + 1)))
    ).withColumn("word", F.substring(F.col("name"), F.col("at"), F.col("size")))
    met = parts.join(counts, "word", "left").groupBy("name").agg(
        F.collect_list(F.when(F.col("n").isNotNull(), F.struct((F.col("at") - 1).alias("at"), "size", "n"))).alias("found"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            split = [
                best_split(name, {(f["at"], f["size"]): f["n"] for f in found}, total)
                for name, found in zip(frame["name"], frame["found"], strict=True)
            ]
            yield pd.DataFrame({"name": frame["name"], "words": split})

    whole = names.where(F.length("name") > LABEL).select("name", F.array("name").alias("words"))
    return met.mapInPandas(run, "name string, words array<string>").unionByName(whole)


def host_words(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, host_words) of the distinct hosts: the words of each name, in place and as often as they stand there."""
    hosts = checkpoint(pages.select("host").where(F.col("host") != "").distinct())
    listed = hosts.select("host", F.posexplode(F.split("host", "[^\\p{L}]+")).alias("at", "name")).where(F.col("name") != "")
    split = segment(listed.select("name").distinct(), counts)
    placed = F.sort_array(F.collect_list(F.struct("at", "words")))
    return listed.join(split, "name").groupBy("host").agg(F.flatten(F.transform(placed, lambda x: x["words"])).alias("host_words"))


def path_tokens(path: Column) -> Column:
    """Letter and digit runs of a path; a number is known by its length only."""
    runs = F.regexp_extract_all(ascii_lower(path), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    return F.transform(runs, lambda t: F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(t).cast("string"))).otherwise(t))


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, words of the host, log-odds of blocking."""
    rows = with_parts(pages.select("page_id", "url"))
    name, verdict = rule_of(rules)
    split = host_words(rows, word_counts(pages))
    tokens = F.concat(
        F.transform(F.coalesce("host_words", F.array().cast("array<string>")), lambda t: F.concat(F.lit("host "), t)),
        F.transform(path_tokens(F.col("path")), lambda t: F.concat(F.lit("path "), t)),
    )
    rows = rows.withColumn("rule", name).withColumn("by_rule", verdict).join(split, "host", "left")
    buckets = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))
    rows = checkpoint(rows.withColumn("buckets", buckets).drop("url"))
    decided = rows.where(F.col("by_rule").isNotNull()).withColumn("block", (F.col("by_rule") == "block").cast("long"))
    sizes = decided.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("block"), F.count(F.lit(1)).alias("all")).first()
    counted = decided.select("block", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.sum("block").alias("block"), F.count(F.lit(1)).alias("all")).collect()
    table = np.ones((2, BUCKETS))
    for r in counted:
        table[:, r["bucket"]] += (r["all"] - r["block"], r["block"])
    odds = np.log(table[1] / table[1].sum()) - np.log(table[0] / table[0].sum())
    blocked, allowed = sizes["block"], sizes["all"] - sizes["block"]
    prior = np.log(blocked / allowed) if blocked and allowed else -np.inf
    shared = pages.sparkSession.sparkContext.broadcast(odds)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for frame in frames:
            out = frame.drop(columns=["buckets", "by_rule"])
            out["block_odds"] = [float(prior + weights[np.asarray(b, np.int64)].sum()) for b in frame["buckets"]]
            own = np.where(out["block_odds"] > 0, "block", "allow")
            out["verdict"] = frame["by_rule"].where(frame["by_rule"].notna(), own)
            yield out

    kinds = dict(rows.dtypes)
    kept = ", ".join(f"{c} {kinds[c]}" for c in rows.columns if c not in ("buckets", "by_rule"))
    return rows.mapInPandas(run, f"{kept}, block_odds double, verdict string")
