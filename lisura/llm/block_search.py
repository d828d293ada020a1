"""Exact nearest neighbours by blocks of 8-bit products with error bounds.

Vectors are scaled by a power of two to a largest component near one, which
loses nothing at any magnitude, and rounded to 8 bits.  Blocks of queries meet blocks of candidates; one product of two small integer
matrices gives the inner products of a whole tile, and the rounding error of
each pair is bounded from the norms.  A pair whose upper bound is below the
``k``-th best lower bound of its query in the tile cannot be among the nearest.
The pairs that survive are computed again in double precision, and a heap per
query keeps the best ``k`` of its tiles.  The last merge is a rank limit.

Tiles are dealt out by (query block, candidate block), so no task holds more
than one block of each.  Blocks are sized by a count of the vectors.

Cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part; products that leave the range of doubles are infinite
or zero like in plain double arithmetic, a pair whose
bound is not a number is computed, and a product that is none (infinities
that cancel) counts as greatest; vectors of another length meet only their own length;
rows with a null id take no part; a query has no partner with its own id;
repeated rows are candidates once each; of different queries under one id the least
vector asks; ties go to the smaller id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of a block.
QUERIES, CANDIDATES = 4_096, 8_192
#: Candidates that are multiplied at once inside a tile.
STRIP = 1_024
#: Columns whose 8-bit products add up exactly in float32: 1,024 * 127 * 127 is below 2 ** 24.
EXACT = 1_024
#: Powers of two below which a product of two factors stays in the range of doubles; the smallest double.
PLAIN, SMALLEST = 400, 5e-324


def usable(vector: Column) -> Column:
    """A vector with only finite components, not all zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with their largest component in [0.5, 1), and the powers of two they were divided by."""
    power = np.frexp(np.abs(x).max(1))[1]
    return np.ldexp(x, -power[:, None]), power


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit rows (as float32, which is exact), their scale, the norm of the rounding, the norm of the row."""
    scale = np.abs(x).max(1) / 127.0
    q = np.rint(x / scale[:, None])
    return q.astype(np.float32), scale, np.linalg.norm(x - q * scale[:, None], axis=1), np.linalg.norm(x, axis=1)


def products(q8: np.ndarray, c8: np.ndarray) -> np.ndarray:
    """Exact products of 8-bit rows: float32 holds the sums of ``EXACT`` columns, longer ones are added as doubles."""
    total = (q8[:, :EXACT] @ c8[:, :EXACT].T).astype(float)
    for at in range(EXACT, q8.shape[1], EXACT):
        total += q8[:, at : at + EXACT] @ c8[:, at : at + EXACT].T
    return total


def unscaled(x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """``x`` times two to the sum of its row's and its column's power."""
    if max(np.abs(rows).max(), np.abs(cols).max()) < PLAIN:
        return x * np.ldexp(1.0, rows)[:, None] * np.ldexp(1.0, cols)
    return np.ldexp(x, rows[:, None] + cols)


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, candidate, score) of the best ``k`` candidates of each query in this tile."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        yield from _tile(q_ids, q, c_ids, c, k)


def _tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    near_one, q_power = scaled(q)
    q8, q_scale, q_error, q_norm = quantised(near_one)
    # (not a number, score, id below zero, serial below zero)
    heaps: list[list[tuple[bool, float, int, int]]] = [[] for _ in q_ids]
    serial = 0
    for first in range(0, len(c), STRIP):
        part, ids = c[first : first + STRIP], c_ids[first : first + STRIP]
        near_one, c_power = scaled(part)
        c8, c_scale, c_error, c_norm = quantised(near_one)
        about = products(q8, c8) * q_scale[:, None] * c_scale
        # |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|, and |q'| <= |q| + |q - q'|.
        error = q_error[:, None] * c_norm + (q_norm + q_error)[:, None] * c_error
        error += 1e-9 * (q_norm[:, None] * c_norm)
        # What plain doubles lose where products are too small for them.
        least_step = part.shape[1] * SMALLEST
        own = q_ids[:, None] == ids
        low = np.where(own, -np.inf, unscaled(about - error, q_power, c_power) - least_step)
        high = np.where(own, -np.inf, unscaled(about + error, q_power, c_power) + least_step)
        n = low.shape[1]
        if n > k:
            least = np.partition(low, n - k, axis=1)[:, n - k]
        else:
            least = np.full(len(q_ids), -np.inf)
        # What earlier strips have found is exact, and raises the bar.
        bar = np.array([h[0][1] if len(h) == k else -np.inf for h in heaps])
        row, col = np.nonzero(~(high < np.fmax(least, bar)[:, None]) & ~own)
        exact = (q[row] * part[col]).sum(1)
        for r, x, candidate in zip(row.tolist(), exact.tolist(), ids[col].tolist(), strict=True):
            # Smaller ids win ties, so they count as greater; repeated rows differ in the serial number.
            serial += 1
            entry = (x != x, x if x == x else 0.0, -candidate, -serial)
            if len(heaps[r]) < k:
                heapq.heappush(heaps[r], entry)
            elif entry > heaps[r][0]:
                heapq.heapreplace(heaps[r], entry)
    for query, heap in zip(q_ids.tolist(), heaps, strict=True):
        yield from ((query, -candidate, np.nan if odd else x) for odd, x, candidate, _ in heap)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` largest inner products of each query.

    Both frames have vec_id and embedding; queries are usually some rows of
    ``vectors``.
    """

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        return rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))

    candidates = clean(vectors)
    # Of several queries under one id, the least vector asks.
    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n_q, n_c = max(1, -(-asked.count() // QUERIES)), max(1, -(-candidates.count() // CANDIDATES))

    def blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = asked.select(
        "dim", F.pmod(F.xxhash64("id"), F.lit(n_q)).alias("i"),
        blocks(n_c).alias("j"), F.lit(True).alias("asks"), "id", "v",
    )
    right = candidates.select(
        "dim", blocks(n_q).alias("i"),
        F.pmod(F.xxhash64("id", "v"), F.lit(n_c)).alias("j"), F.lit(False).alias("asks"), "id", "v",
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        ids = frame["id"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        v = np.stack(frame["v"].to_numpy())
        found = list(tile(ids[asks], v[asks], ids[~asks], v[~asks], k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    met = left.unionByName(right).groupBy("dim", "i", "j").applyInPandas(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
