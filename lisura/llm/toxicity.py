"""Toxicity of texts by a factorization machine over hashed terms.

A text is the set of its lower-cased words and of the beginnings of longer
words (``STEMS`` characters: inflected and compound forms share them), hashed
to ``BUCKETS`` terms.  The score is a logistic of  w0 + sum w_i + sum over pairs <v_i, v_j>, so a pair of
terms can weigh more (or less) than both alone.

Training reads a sample of at most about ``SAMPLE`` labelled rows of each class,
drawn by hash of the id; row weights (labels of a class to labels drawn of it)
restore the true share of the classes.
The model's terms are those that shift the odds of the label by ``EFFECT``, so
that chance words of long texts weigh nothing, and of these the ``TERMS`` with
the highest chi-square in the sample.

Cases: null and empty text have no terms and get the score of the bias;
repeated rows are scored each; labels that are null or join no document teach
nothing; without a row of both classes every score is the share of toxic
labels (0 without labels); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lisura.llm.common import add_from_text, checkpoint, share, word_list

#: Hashed terms; the model's terms; labelled rows of each class that the machine is fitted on.
BUCKETS, TERMS, SAMPLE = 1 << 18, 4_096, 8_000
#: Least effect of a model term: log of the odds ratio, drawn to zero by so many texts of the usual share.  Neither it nor its
#: limit depends on the number of labels.
EFFECT, PRIOR = 1.5, 4.0
#: Lengths of the word beginnings that are terms too.
STEMS = (4, 5, 6, 7)
#: Rank of the pair weights, passes over the sample and steps at least, rows of a step, step size, penalty.
RANK, PASSES, STEPS, BATCH, STEP, DECAY = 4, 30, 300, 64, 0.2, 1e-3


class TermHash(dict):
    """Buckets of each word and its beginnings, remembered within one task."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        # A word without the punctuation around it is the same term.
        bare = (word.strip(b"\"'.,;:!?()[]{}<>*_-") or word).decode("utf-8", "replace")
        parts = ["=" + bare, *(bare[:n] for n in STEMS if len(bare) > n)]
        self[word] = found = tuple(xxhash.xxh3_64_intdigest(p) % BUCKETS for p in parts)
        return found


def terms_of(text: bytes | None, buckets: TermHash) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    found: set[int] = set()
    for word in set(word_list(text)):
        found.update(buckets[word])
    return np.array(sorted(found), np.int32)


def _terms(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the terms of ``text``."""

    def make() -> Callable:
        buckets = TermHash()
        return lambda text: terms_of(text, buckets)

    return add_from_text(df, keep, make, "terms", T.ArrayType(T.IntegerType()))


@dataclass
class Machine:
    """Weights of the chosen terms; ``place`` maps a bucket to its row, or -1."""

    place: np.ndarray
    bias: float
    linear: np.ndarray
    pairs: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        at = self.place[terms]
        at = at[at >= 0]
        v = self.pairs[at]
        z = self.bias + self.linear[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, place: np.ndarray, n_terms: int, seed: int = 5) -> Machine:
    """Adaptive gradient descent on the weighted logistic loss, some rows a step."""
    rng = np.random.default_rng(seed)
    # The last row of each weight stands for no term: every text has it, at zero.
    w, v = np.zeros(n_terms + 1), rng.normal(0, 0.02, (n_terms + 1, RANK))
    v[-1] = 0
    weights = weights / weights.mean()
    share = float(np.clip((labels * weights).mean(), 1e-6, 1 - 1e-6))
    b = np.log(share / (1 - share))
    gb, gw, gv = 1e-8, np.full(n_terms + 1, 1e-8), np.full((n_terms + 1, RANK), 1e-8)
    index = [np.append(p[p >= 0], n_terms) for p in (place[r] for r in rows)]
    for _ in range(max(PASSES, -(-STEPS // -(-len(index) // BATCH)))):
        order = rng.permutation(len(index))
        for first in range(0, len(order), BATCH):
            some = order[first : first + BATCH]
            sizes = [len(index[i]) for i in some]
            at = np.concatenate([index[i] for i in some])
            starts, row = np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(some)), sizes)
            va = v[at]
            total = np.add.reduceat(va, starts)
            z = b + np.add.reduceat(w[at], starts) + 0.5 * (total**2 - np.add.reduceat(va**2, starts)).sum(1)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) * weights[some]
            gb += (d**2).sum()
            b -= STEP * d.sum() / np.sqrt(gb)
            dw, dv = np.zeros_like(w), np.zeros_like(v)
            np.add.at(dw, at, d[row])
            np.add.at(dv, at, d[row, None] * (total[row] - va))
            used = np.unique(at[at < n_terms])
            dw, dv = dw[used] + DECAY * w[used], dv[used] + DECAY * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= STEP * dw / np.sqrt(gw[used])
            v[used] -= STEP * dv / np.sqrt(gv[used])
    return Machine(place, float(b), w[:-1], v[:-1])


def train(texts: DataFrame, labels: DataFrame) -> Machine:
    """The machine for texts (id, text) and labels (id, toxic)."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull()).select(
        "id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("id").alias("order"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Rows with a small hash: a bounded number, so that they are sent to the texts and not the other way.
    part = F.when(F.col("toxic") == 1, min(1.0, SAMPLE / totals.get(1, 1))).otherwise(min(1.0, SAMPLE / totals.get(0, 1)))
    drawn = F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53)) < part
    some = checkpoint(known.where(drawn))
    # Labels each drawn one stands for, counted before the join: labels that join no document say nothing of the share.
    weight = {r["toxic"]: totals[r["toxic"]] / r["n"] for r in some.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = texts.select("id", "text").join(share(some), "id")
    rows = checkpoint(_terms(rows, ["order", "toxic"]))
    found = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    yes, no = found.get(1, 0), found.get(0, 0)
    place = np.full(BUCKETS, -1, np.int32)
    if not yes or not no:
        return Machine(place, 30.0 if yes else -30.0, np.zeros(0), np.zeros((0, RANK)))
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    # Chi-square of term and label, with the usual half added to each cell.
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    c, d = yes - F.col("a") + 0.5, no - F.col("b") + 0.5
    score = (yes + no) * F.pow(a * d - b * c, F.lit(2)) / ((a + b) * (c + d) * (yes + 1.0) * (no + 1.0))
    # Odds ratio of the label with and without knowing the term, the term's own texts joined by PRIOR texts of the usual share.
    toxic, clean = F.col("a") + PRIOR * yes / (yes + no), F.col("b") + PRIOR * no / (yes + no)
    effect = F.abs(F.log(toxic / clean) - float(np.log(yes / no)))
    best = counts.where(effect >= EFFECT).select("term", score.alias("score"))
    chosen = [r["term"] for r in best.orderBy(F.desc("score"), "term").limit(TERMS).collect()]
    place[chosen] = np.arange(len(chosen))
    asked = F.array(*[F.lit(t) for t in chosen]) if chosen else F.array().cast("array<int>")
    got = rows.select("order", "toxic", F.array_intersect("terms", asked).alias("terms")).collect()
    got = sorted(got, key=lambda r: (r["order"], r["toxic"], r["terms"]))
    return fit(
        [np.array(r["terms"], np.int64) for r in got], np.array([r["toxic"] for r in got], float),
        np.array([weight[r["toxic"]] for r in got]), place, len(chosen))


def score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """``keep`` and ``score`` of every row; the model is an array of fixed size, sent to every task."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make() -> Callable:
        model, buckets = shared.value, TermHash()
        return lambda text: model.score(terms_of(text, buckets))

    return add_from_text(docs, keep, make, "score", T.DoubleType())
