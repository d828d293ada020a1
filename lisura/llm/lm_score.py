"""Log10 probabilities of whole texts under a log-bilinear model and add-one counts.

Counts: every distinct word of the training rows is counted by a grouped
aggregate.  The ``CLASSES`` most frequent tokens are classes of the neural
model, with one class for all other words and one for the end of a text.

Model: two vectors for each class.  A context of two classes predicts a vector
(the sum of their input vectors, weighted per position and dimension), and a
class scores its product with the output vector plus a bias.  Every task fits
the model in numpy on its own training texts by noise-contrastive estimation;
the results are averaged by a grouped aggregate, weighted by tokens.  The
scores split into a part for each position, so one product of two matrices
normalises all contexts at once, and a token's log-probability is three look-ups.
A word outside the classes gets the probability of their class times its
add-one share of the counts of that class.

Scoring: words among the ``FREQUENT`` most frequent find their counts in a
table of that size at most, sent to every task; all other words are joined with the
counts.  The join works on texts, under a 96-bit key, so equal texts in one
task are scored once.

Cases: null, empty and blank text are the end token alone; repeated rows get
equal scores; without a training row N and V are 0, the model has only its two
classes, untrained, and the base of each token is log10(1); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisura.llm.common import checkpoint, text_batches, word_list, words

#: Classes of the model; words whose counts are sent to every task.
CLASSES, FREQUENT = 1_024, 65_536
#: Dimensions, tokens and noise samples of a step, step size.
DIMENSIONS, BATCH, NOISE, STEP = 16, 1_024, 64, 0.1
UNKNOWN, END, START = 0, 1, 2
FIRST = 3


@dataclass
class Counts:
    """What the tasks know of the training rows: bounded in size by ``FREQUENT``."""

    frequent: dict[bytes, int]  # place of a word in the order of counts
    count: np.ndarray
    tokens: int
    types: int
    ends: int
    n_classes: int

    def class_counts(self) -> np.ndarray:
        known = self.count[: self.n_classes - FIRST]
        others = self.tokens - self.ends - known.sum()
        return np.concatenate([[others, self.ends, 0], known]).astype(float)


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def text_keys() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.crc32(text.cast("binary")).alias("k2")]


def most_frequent(counts: DataFrame) -> list:
    """At most ``FREQUENT`` rows, most frequent first.

    A sorted limit would send that many rows from every partition.  Words are
    counted per level of frequency instead (64 levels to a doubling), and only
    the levels that fit are fetched; the first that does not is filled in the
    order of a hash of the word.
    """
    level = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    place = F.shiftrightunsigned(F.xxhash64("word"), 11) / F.lit(float(1 << 53))
    wanted, held = F.lit(False), 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        room = FREQUENT - held
        if r["n"] > room:
            wanted = wanted | ((level == r["level"]) & (place < room / r["n"]))
            break
        held += r["n"]
        wanted = level >= r["level"]
    fetched = counts.where(wanted).withColumn("level", level).withColumn("place", place).collect()
    # The share of a level is drawn, so that a few words more than there is room for may come.
    fetched = sorted(fetched, key=lambda r: (-r["level"], r["place"]))[:FREQUENT]
    return sorted(fetched, key=lambda r: (-r["c"], r["word"]))


def count_words(train: DataFrame) -> tuple[DataFrame, Counts]:
    """(word, c) of all training rows, and the bounded summary."""
    listed = train.select(F.explode(words(F.col("text").cast("string"))).alias("word"))
    counts = checkpoint(listed.groupBy("word").agg(F.count(F.lit(1)).alias("c")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = train.count()
    top = most_frequent(counts)
    return counts, Counts(
        {r["word"].encode(): i for i, r in enumerate(top)}, np.array([r["c"] for r in top], np.int64),
        total["n"] + ends, total["v"] + (ends > 0), ends, FIRST + min(len(top), CLASSES - FIRST),
    )


def classes_of(places: np.ndarray, n_classes: int) -> np.ndarray:
    """Class of each word and of the end, from places in the order of counts (-1: not frequent)."""
    inside = (places >= 0) & (places < n_classes - FIRST)
    return np.append(np.where(inside, places + FIRST, UNKNOWN), END).astype(np.int64)


def contexts(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token, and the one before that."""
    padded = np.concatenate([[START, START], seq])
    return padded[1:-1], padded[:-2]


class Model:
    """Rows of ``weights``: per class input vector, output vector, bias; the last row weighs the two positions."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @staticmethod
    def start(class_counts: np.ndarray, seed: int = 11) -> Model:
        d, k = DIMENSIONS, len(class_counts)
        w = np.random.default_rng(seed).normal(0, 0.1, (k + 1, 2 * d + 1))
        share = (class_counts + 0.1) / (class_counts + 0.1).sum()
        w[:k, -1] = np.log(share)
        w[k] = 1.0
        return Model(w)

    def split(self) -> tuple[np.ndarray, ...]:
        d, w = DIMENSIONS, self.weights
        return w[:-1, :d], w[:-1, d : 2 * d], w[:-1, -1], w[-1, :d], w[-1, d : 2 * d]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores from the nearer and the farther class, and log-normalisers of all contexts.

        exp(a[i, w] + b[j, w]) summed over w is a product of two matrices.
        ``START`` is never predicted.
        """
        inp, out, bias, near, far = self.split()
        a, b = (inp * near) @ out.T, (inp * far) @ out.T + bias
        b[:, START] = -np.inf
        top_a, top_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        z = np.log(np.exp(a - top_a) @ np.exp(b - top_b).T) + top_a + top_b.T
        return a.astype(np.float32), b.astype(np.float32), z.astype(np.float32)


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add each row at its place; places may repeat."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.append(True, sorted_at[1:] != sorted_at[:-1]))
    to[sorted_at[first]] += np.add.reduceat(rows[order], first)


class Trainer:
    """Noise-contrastive estimation: tell each token from samples of the classes' own frequencies."""

    def __init__(self, model: Model, class_counts: np.ndarray, seed: int):
        # Single precision: a step is bound by memory, and its rounding is far below the noise of the samples.
        self.model = Model(model.weights.astype(np.float32))
        self.rng = np.random.default_rng(seed)
        noise = (class_counts + 0.1) / (class_counts + 0.1).sum()
        self.cumulated = np.cumsum(noise)
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.squares = np.full_like(self.model.weights, 1e-7)
        self.grad = np.zeros_like(self.model.weights)

    def step(self, seq: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        d, k = DIMENSIONS, len(self.log_noise)
        inp, out, bias, c1, c2 = self.model.split()
        x1, x2 = inp[near], inp[far]
        q = x1 * c1 + x2 * c2
        drawn = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), k - 1)
        own, samples = out[seq], out[drawn]
        # Probability that the token, or the sample, is data.
        p = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", q, own) + bias[seq] - self.log_noise[seq])))
        n = 1 / (1 + np.exp(-(q @ samples.T + (bias[drawn] - self.log_noise[drawn]))))
        up = 1 - p
        dq = up[:, None] * own - n @ samples
        grad = self.grad
        grad.fill(0)
        _add_rows(grad[:, :d], np.concatenate([near, far]), np.concatenate([dq * c1, dq * c2]))
        _add_rows(grad[:, d : 2 * d], np.concatenate([seq, drawn]), np.concatenate([up[:, None] * q, -(n.T @ q)]))
        grad[:k, -1] += np.bincount(seq, up, k) - np.bincount(drawn, n.sum(0), k)
        grad[-1, :d] = np.einsum("ij,ij->j", dq, x1)
        grad[-1, d : 2 * d] = np.einsum("ij,ij->j", dq, x2)
        # Rows that this step did not use have no gradient and stay as they are.
        used = np.flatnonzero(grad.any(axis=1))
        g = grad[used] / np.float32(len(seq))
        squares = self.squares[used] + g * g
        self.squares[used] = squares
        self.model.weights[used] += np.float32(STEP) * g / np.sqrt(squares)


def train_model(train: DataFrame, counts: Counts) -> Model:
    """Fit in every task, average over the tasks."""
    begin = Model.start(counts.class_counts())
    context = train.sparkSession.sparkContext
    shared = context.broadcast((counts, begin))
    width = begin.weights.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, model = shared.value
        places, size = _Places(known.frequent), known.n_classes
        trainer = Trainer(model, known.class_counts(), seed=3)
        waiting, held, seen = [], 0, 0

        def learn(least: int) -> None:
            nonlocal waiting, held, seen
            if held < max(least, 1):
                return
            seq = np.concatenate([s for s, _, _ in waiting])
            near, far = (np.concatenate([x[i] for x in waiting]) for i in (1, 2))
            for i in range(0, len(seq), BATCH):
                trainer.step(seq[i : i + BATCH], near[i : i + BATCH], far[i : i + BATCH])
            seen += len(seq)
            waiting, held = [], 0

        for frame in frames:
            for text in frame["text"]:
                tokens = word_list(text)
                seq = classes_of(np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens)), size)
                waiting.append((seq, *contexts(seq)))
                held += len(seq)
                learn(128 * BATCH)
        learn(1)
        if seen:
            out = pd.DataFrame(trainer.model.weights.astype(float), columns=[f"v{i}" for i in range(width)])
            out.insert(0, "row", np.arange(len(out)))
            out.insert(1, "weight", float(seen))
            yield out

    texts = train.select(F.col("text").cast("string").cast("binary").alias("text"))
    fitted = text_batches(texts, run, "row long, weight double, " + ", ".join(f"v{i} double" for i in range(width)))
    mean = fitted.groupBy("row").agg(
        *[(F.sum(F.col(f"v{i}") * F.col("weight")) / F.sum("weight")).alias(f"v{i}") for i in range(width)])
    got = mean.orderBy("row").collect()
    return Model(np.array([tuple(r)[1:] for r in got])) if got else begin


def score(docs: DataFrame, train: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    counts, known = count_words(train)
    model = train_model(train, known)
    shared = docs.sparkSession.sparkContext.broadcast((known, model.tables()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, (a, b, z) = shared.value
        places, size = _Places(own.frequent), own.n_classes
        log_count = np.log10(own.count + 1.0)
        end_log = np.log10(own.ends + 1.0)
        seen = set()
        for frame in frames:
            rows = []
            for k1, k2, text in zip(frame["k1"], frame["k2"], frame["text"], strict=True):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                tokens = word_list(text)
                place = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
                seq = classes_of(place, size)
                near, far = contexts(seq)
                classes = float((a[near, seq].astype(float) + b[far, seq] - z[near, far]).sum()) / np.log(10)
                hot = place >= 0
                logs = log_count[place[hot]]
                outside = logs[place[hot] >= size - FIRST]
                n_unknown = int((seq == UNKNOWN).sum())
                # The text's own row carries a word that no text has, so that it joins nothing.
                rows.append((k1, k2, f" {k1}", 1, len(seq), int(hot.sum()) + (own.ends > 0), logs.sum() + end_log,
                             outside.sum(), classes, n_unknown))
                rare = Counter(tokens[i] for i in np.flatnonzero(~hot))
                rows += [(k1, k2, w.decode("utf-8", "replace"), n, 0, 0, 0.0, 0.0, 0.0, 0) for w, n in rare.items()]
                if len(rows) > 100_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["k1", "k2", "word", "n", "n_tokens", "n_hot", "logs", "outside", "classes", "n_unknown"]
    texts = docs.select(*text_keys(), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    parts = text_batches(
        texts, run, "k1 long, k2 long, word string, n long, n_tokens long, n_hot long, logs double, outside double, classes double, n_unknown long"
    )
    # Words outside the sent table: their counts come from the join; 0 for words that training has not seen.
    c = F.coalesce("c", F.lit(0))
    own_row = F.col("n_tokens") > 0
    rare_log = F.when(~own_row, F.col("n") * F.log10(c + 1.0)).otherwise(F.lit(0.0))
    joined = parts.join(counts, "word", "left")
    summed = joined.groupBy("k1", "k2").agg(
        F.sum(own_row.cast("long")).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_hot") + F.when(c > 0, F.col("n")).otherwise(F.lit(0))).alias("n_known"),
        F.sum(F.col("logs") + rare_log).alias("logs"),
        F.sum(F.col("outside") + rare_log).alias("outside"),
        F.sum("classes").alias("classes"),
        F.sum("n_unknown").alias("n_unknown"),
    )
    # Tasks that met the same text have each added all of it.
    share = {name: (F.col(name) / F.col("copies")) for name in ("n_tokens", "n_known", "logs", "outside", "classes", "n_unknown")}
    base = float(np.log10(known.tokens + 1.0 * (known.types + 1)))
    class_counts = known.class_counts()
    other_types = known.types - (known.ends > 0) - (known.n_classes - FIRST)
    other = float(np.log10(class_counts[UNKNOWN] + other_types + 1.0))
    per_text = summed.select(
        "k1", "k2",
        share["n_tokens"].cast("long").alias("n_tokens"), share["n_known"].cast("long").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (share["logs"] - share["n_tokens"] * base).alias("base_score"),
        (share["classes"] + share["outside"] - share["n_unknown"] * other).alias("score"),
    )
    rows = docs.select(*keep, *text_keys())
    return rows.join(per_text, ["k1", "k2"]).drop("k1", "k2")
