"""Near duplicates by SimHash fingerprints in a hierarchical index over Gray order.

Distinct fingerprints are sorted by Gray rank, where neighbours tend to share
most bits, and cut into blocks.  A node of the index covers consecutive blocks
and holds the bits that all fingerprints below it share and that its parent does
not hold already (a mask and a pattern).  Two nodes are held against each
other bit by bit where both are known; the differences found at their parents
are kept, so each level adds those of newly known bits only.  A pair of nodes
whose differences exceed the limit is dropped with everything below it.

The upper nodes are a table, and the pairs that are left are joined with the
children of both sides, level by level (a node has ``FAN`` children at most).
Where pairs reach blocks, a task gets the two blocks of a pair and goes on in the same way
down to fingerprints.  It returns a spanning forest of the links, one row per
linked fingerprint at most, never all pairs.  The search is exact: nothing is
cut but pairs that differ in too many bits.

Cases: null, empty and blank texts have the fingerprint zero and are linked
like any other; a text with fewer words than a shingle is one shingle; texts of
any length are counted in slices; equal fingerprints are one entry, however
many rows have it; a component of rows with null ids only has a null id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisura.llm.common import checkpoint, share, text_batches, word_list
from lisura.llm.ngram_join import components

#: Seed of the shingle hashes, words of a shingle, differing bits of a link.
SEED, SHINGLE, LIMIT = 42, 3, 2
#: Fingerprints of a block, children of an upper node, children of a node inside a block, fingerprints of a range (about).
BLOCK, FAN, INNER, RANGE = 4_096, 16, 8, 1_000_000
#: Hashes that are counted at once; node pairs that are expanded at once.
SLICE, PAIRS = 65_536, 8_192

ALL = np.uint64(2**64 - 1)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = word_list(text)
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = min(shingle, len(words))
    total, set_bits = len(words) - n + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, SLICE):
        stop = min(total, at + SLICE)
        cuts = zip(starts[at:stop].tolist(), ends[at + n - 1 : stop + n - 1].tolist(), strict=True)
        h = np.fromiter((digest(line[s:e], SEED) for s, e in cuts), np.dtype("<u8"), stop - at)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * set_bits > total).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, code) of every row; the code is the fingerprint as a signed number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = np.fromiter((fingerprint(t, shingle) for t in frame["text"]), np.uint64, len(frame))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "code": found.view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return text_batches(rows, run, "doc_id long, code long")


def gray_rank(code: Column) -> Column:
    """The place of a code in Gray order, shifted so that signed numbers order like unsigned ones."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code.bitwiseXOR(F.lit(-(2**63)))


def shared_bits(low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """AND and OR of ``width`` consecutive nodes each, the mask of bits that agree, and the pattern."""
    first = np.arange(0, len(low), width)
    low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
    mask = ~(low ^ high)
    return low, high, mask, low & mask


def tree(codes: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) per level, the codes themselves first and one node last."""
    levels, low, high = [(np.full(len(codes), ALL), codes)], codes, codes
    while len(low) > 1:
        low, high, mask, bits = shared_bits(low, high, width)
        levels.append((mask, bits))
    return levels


def _children(at: np.ndarray, count: int, deeper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Children of each node (itself where that side does not go deeper), and which of them exist."""
    if not deeper:
        return at[:, None], np.ones((len(at), 1), bool)
    child = at[:, None] * INNER + np.arange(INNER)
    return child, child < count


def links(x: list, y: list, limit: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of codes that differ in at most ``limit`` bits; for one tree with itself each pair once."""
    zero = np.zeros(1, np.int64)
    todo = [(len(x) - 1, len(y) - 1, zero, zero, np.zeros(1, np.uint64), np.zeros(1, np.uint8))]
    while todo:
        lx, ly, i, j, seen, apart = todo.pop()
        if len(i) > PAIRS:
            for s in range(0, len(i), PAIRS):
                part = slice(s, s + PAIRS)
                todo.append((lx, ly, i[part], j[part], seen[part], apart[part]))
            continue
        if not lx and not ly:
            yield i, j
            continue
        deep_x, deep_y = lx >= ly, ly >= lx
        lx, ly = lx - deep_x, ly - deep_y
        (mx, bx), (my, by) = x[lx], y[ly]
        ci, real_i = _children(i, len(bx), deep_x)
        cj, real_j = _children(j, len(by), deep_y)
        real = real_i[:, :, None] & real_j[:, None, :]
        shape = real.shape
        if same:
            real &= (ci[:, :, None] < cj[:, None, :]) if not lx and not ly else (ci[:, :, None] <= cj[:, None, :])
        real = real.ravel()
        # What is not there is masked out below; until then it stands for the last node.
        ci, cj = np.minimum(ci, len(bx) - 1), np.minimum(cj, len(by) - 1)
        ci = np.broadcast_to(ci[:, :, None], shape).reshape(-1)[real]
        cj = np.broadcast_to(cj[:, None, :], shape).reshape(-1)[real]
        was = np.broadcast_to(seen[:, None, None], shape).reshape(-1)[real]
        known = mx[ci] & my[cj]
        more = np.broadcast_to(apart[:, None, None], shape).reshape(-1)[real] + np.bitwise_count(
            (bx[ci] ^ by[cj]) & known & ~was)
        near = more <= limit
        if near.any():
            todo.append((lx, ly, ci[near], cj[near], known[near], more[near]))


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the links (i, j): each node's smallest reachable one."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (nxt := root[root]).tobytes() != root.tobytes():
            root = nxt


def _node_rows(nodes: list[tuple], start: int, task: int, fan: int) -> tuple[list[tuple], list[tuple]]:
    """Rows of the levels above ``nodes`` (id, level, low, high), and the last one without a parent.

    A row holds what its parent does not: id, parent, level, residual mask and
    pattern.  Rows of the given nodes are among them, except where there is one.
    """
    rows, next_id = [], start
    while len(nodes) > 1:
        ids = [n[0] for n in nodes]
        own_low, own_high = (np.array([n[k] for n in nodes], np.uint64) for k in (2, 3))
        own = ~(own_low ^ own_high)
        low, high, mask, _ = shared_bits(own_low, own_high, fan)
        level = [max(n[1] for n in nodes[k : k + fan]) + 1 for k in range(0, len(nodes), fan)]
        made = [(task << 24) + next_id + k for k in range(len(low))]
        next_id += len(low)
        rest = own & ~np.repeat(mask, fan)[: len(nodes)]
        for k, node in enumerate(nodes):
            rows.append((ids[k], made[k // fan], node[1], int(rest[k]), int(own_low[k] & rest[k])))
        nodes = [(made[k], level[k], int(low[k]), int(high[k])) for k in range(len(low))]
    return rows, nodes


_NODE = "node long, parent long, level int, mask long, bits long, low long, high long, codes binary"


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _frame(rows: list[tuple], last: list[tuple], blocks: dict[int, bytes]) -> pa.RecordBatch:
    """Finished rows, and roots of this task (their parent is set later; ``low`` and ``high`` are kept for that)."""
    none = [None] * len(rows)
    ids = [r[0] for r in rows] + [n[0] for n in last]
    return pa.RecordBatch.from_pydict({
        "node": pa.array(ids, pa.int64()),
        "parent": pa.array([r[1] for r in rows] + [None] * len(last), pa.int64()),
        "level": pa.array([r[2] for r in rows] + [n[1] for n in last], pa.int32()),
        "mask": pa.array(_signed([r[3] for r in rows] + [0] * len(last))),
        "bits": pa.array(_signed([r[4] for r in rows] + [0] * len(last))),
        "low": pa.array(none + _signed([n[2] for n in last]).tolist(), pa.int64()),
        "high": pa.array(none + _signed([n[3] for n in last]).tolist(), pa.int64()),
        "codes": pa.array([blocks.get(i) for i in ids], pa.binary()),
    })


def _subtree(batches: Iterator[pa.RecordBatch], block: int, fan: int) -> Iterator[pa.RecordBatch]:
    """The subtree over one range of codes in Gray order."""
    task, nodes, blocks, rest = TaskContext.get().partitionId(), [], {}, np.empty(0, np.uint64)

    def cut(codes: np.ndarray) -> None:
        node = (task << 24) + len(nodes)
        nodes.append((node, 0, int(np.bitwise_and.reduce(codes)), int(np.bitwise_or.reduce(codes))))
        blocks[node] = codes.tobytes()

    for batch in batches:
        rest = np.concatenate([rest, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
        while len(rest) >= block:
            cut(rest[:block])
            rest = rest[block:]
    if len(rest):
        cut(rest)
    if nodes:
        rows, last = _node_rows(nodes, len(nodes), task, fan)
        yield _frame(rows, last, blocks)


def _top(batches: Iterator[pa.RecordBatch], fan: int) -> Iterator[pa.RecordBatch]:
    """The levels above the roots of all ranges."""
    roots = []
    for b in batches:
        d = b.to_pydict()
        low, high = (np.array(d[c], np.int64).view(np.uint64).tolist() for c in ("low", "high"))
        roots += zip(d["node"], d["level"], low, high, strict=True)
    if roots:
        rows, last = _node_rows(sorted(roots), 0, 1 << 32, fan)
        yield _frame(rows, last, {})


def build(codes: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, parent, level, mask, bits) and blocks (node, codes) of distinct codes (column ``code``)."""
    spark = codes.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-codes.count() // RANGE))
    by_rank = codes.select("code", gray_rank(F.col("code")).alias("rank")).repartitionByRange(ranges, "rank")
    by_rank = by_rank.sortWithinPartitions("rank").select("code")
    lower = checkpoint(by_rank.mapInArrow(lambda batches: _subtree(batches, block, fan), _NODE))
    # One small row per range: a million fingerprints each.
    roots = lower.where(F.col("parent").isNull()).select("node", "level", "low", "high")
    top = checkpoint(roots.repartition(1).mapInArrow(lambda batches: _top(batches, fan), _NODE))
    names = ["node", "parent", "level", "mask", "bits"]
    nodes = lower.where(F.col("parent").isNotNull()).select(*names).unionByName(top.select(*names))
    return checkpoint(nodes), lower.where(F.col("codes").isNotNull()).select("node", "codes")


def block_pairs(nodes: DataFrame, limit: int) -> DataFrame | None:
    """(a, b) of the blocks that may hold linked fingerprints, a block with itself included; None for an empty index."""
    root = nodes.where(F.col("parent").isNull()).select("node", "level").first()
    if root is None:
        return None
    # A block stands for its own child, as ranges have subtrees of different heights.
    none = F.lit(0).cast("long")
    own = nodes.where(F.col("level") == 0).select(F.col("node").alias("parent"), "node", none.alias("mask"), none.alias("bits"))
    kids = checkpoint(nodes.where(F.col("parent").isNotNull()).select("parent", "node", "mask", "bits").unionByName(own))
    zero = {c: F.lit(0).cast("long").alias(c) for c in ("am", "ab", "bm", "bb")}
    pairs = nodes.where(F.col("parent").isNull()).select(
        F.col("node").alias("a"), F.col("node").alias("b"), *zero.values(), F.lit(0).alias("apart"))
    x = kids.select(F.col("parent").alias("a"), F.col("node").alias("x"), F.col("mask").alias("xm"), F.col("bits").alias("xb"))
    y = kids.select(F.col("parent").alias("b"), F.col("node").alias("y"), F.col("mask").alias("ym"), F.col("bits").alias("yb"))
    for _ in range(root["level"]):
        am, bm = F.col("am").bitwiseOR(F.col("xm")), F.col("bm").bitwiseOR(F.col("ym"))
        ab, bb = F.col("ab").bitwiseOR(F.col("xb")), F.col("bb").bitwiseOR(F.col("yb"))
        seen = F.col("am").bitwiseAND(F.col("bm"))
        new = am.bitwiseAND(bm).bitwiseAND(F.bitwise_not(seen))
        apart = F.col("apart") + F.bit_count(ab.bitwiseXOR(bb).bitwiseAND(new))
        once = (F.col("a") != F.col("b")) | (F.col("x") <= F.col("y"))
        pairs = checkpoint(pairs.join(x, "a").join(y, "b").where(once & (apart <= limit)).select(
            F.col("x").alias("a"), F.col("y").alias("b"), am.alias("am"), ab.alias("ab"), bm.alias("bm"), bb.alias("bb"),
            apart.alias("apart")))
    return pairs.select("a", "b")


def forest(pairs: DataFrame, blocks: DataFrame, limit: int) -> DataFrame:
    """(a, b): links that connect what the links of each pair of blocks connect."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b, left, right in zip(frame["a"], frame["b"], frame["left"], frame["right"], strict=True):
                x, same = np.frombuffer(left, np.uint64), a == b
                y = x if same else np.frombuffer(right, np.uint64)
                root, shift = np.arange(len(x) if same else len(x) + len(y)), 0 if same else len(x)
                tx = tree(x, INNER)
                for i, j in links(tx, tx if same else tree(y, INNER), limit, same):
                    root = unite(root, i, j + shift)
                codes = x if same else np.concatenate([x, y])
                linked = np.flatnonzero(root != np.arange(len(root)))
                yield pd.DataFrame({"a": codes[linked].view(np.int64), "b": codes[root[linked]].view(np.int64)})

    a = blocks.select(F.col("node").alias("a"), F.col("codes").alias("left"))
    b = blocks.select(F.col("node").alias("b"), F.col("codes").alias("right"))
    return text_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "left", "right"), run, "a long, b long")


def near_copies(docs: DataFrame, limit: int = LIMIT, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, code, fingerprint, component_id."""
    rows = checkpoint(fingerprints(docs, shingle))
    codes = checkpoint(rows.groupBy("code").agg(F.min("doc_id").alias("least")))
    nodes, blocks = build(codes)
    pairs = block_pairs(nodes, limit)
    named = codes.withColumn("root", F.col("code"))
    if pairs is not None:
        roots = components(checkpoint(forest(pairs, blocks, limit)))
        named = codes.join(roots.select(F.col("node").alias("code"), "root"), "code", "left").withColumn(
            "root", F.coalesce("root", "code"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = checkpoint(named.join(least, "root").select("code", "component_id"))
    text = F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint")
    return rows.join(share(found), "code").select("doc_id", "code", text, "component_id")
