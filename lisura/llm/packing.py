"""Sum-of-squares packing of tokenized documents into fixed windows.

Every task packs the rows of its own input partition online, holding one
array with the number of open windows of each fill level.  A document that
is longer than a window first fills whole windows; what is left goes to the
fill level whose change adds least to the sum of the squared counts.
Nothing is shuffled and a lost task repeats the same packing.

Cases: null and empty text are the end id alone; repeated rows are packed once
each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lisura.llm.common import text_batches

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
#: Fixed value: the published split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Latin letters, common punctuation and blanks.  Both libraries agree on their classes in every version.
PLAIN = re.compile("[\x00-\u017f\u2010-\u2027\u20ac]*")

_encoders: dict[str, Encoder] = {}


def byte_of_letter() -> dict[str, int]:
    """How byte-level vocabularies write bytes: visible Latin-1 as itself, the others from code point 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of whole texts, as the tokenizer file defines them.

    The ranks are read from the tokenizer file and applied by the faster of the
    two installed libraries; tests compare both.  Texts with other scripts, or
    with the string of a special token, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = byte_of_letter()
        ranks = {
            bytes(letters[c] for c in token): rank
            for token, rank in self.tokenizer.get_vocab(with_added_tokens=False).items()
            if token not in self.special
        }
        self.plain = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.plain.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class SumOfSquares:
    """Open windows by fill level; ``counts[h]`` is how many are filled to ``h``."""

    NONE = -(2**40)

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.taken = np.full(size + 1, self.NONE)  # the same counts, NONE where there is no window to take
        self.open: list[list[list]] = [[] for _ in range(size)]

    def level(self, length: int) -> int:
        """The level to fill so that the sum of squared counts ends smallest (0: a new window).

        Moving a window from level h to h + length changes the sum by
        2 * (counts[h + length] - counts[h]) + 2.  A new window adds
        2 * counts[length] + 1; one that gets full leaves the array and adds
        1 - 2 * counts[h].  Ties go to the fullest level.
        """
        top = self.size - length
        if not top:
            return 0
        best, change = 0, 2 * int(self.counts[length]) + 1
        if top > 1:
            moved = (self.counts[length + 1 : self.size] - self.taken[1:top])[::-1]
            k = int(moved.argmin())
            if 2 * int(moved[k]) + 2 <= change:
                best, change = top - 1 - k, 2 * int(moved[k]) + 2
        if self.counts[top] and 1 - 2 * int(self.counts[top]) <= change:
            best = top
        return best

    def _add(self, level: int, n: int) -> None:
        self.counts[level] += n
        self.taken[level] = self.counts[level] or self.NONE

    def put(self, piece: tuple, length: int) -> list | None:
        """Place one piece; the window is returned when that fills it."""
        at = self.level(length)
        window = self.open[at].pop() if at else []
        if at:
            self._add(at, -1)
        window.append(piece)
        if at + length == self.size:
            return window
        self.open[at + length].append(window)
        self._add(at + length, 1)
        return None

    def rest(self) -> list[list]:
        return [w for level in self.open for w in level]


def frame_of(pieces: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pd.DataFrame({n: pd.array(v, dtype="Int64") for n, v in zip(names, zip(*pieces, strict=True), strict=True)})


def pack_partition(frames: Iterator[pd.DataFrame], path: str, end_id: int, size: int, part: int) -> Iterator[pd.DataFrame]:
    """Pack the rows of one partition; sequence ids are unique through ``part``."""
    state, done, next_id = SumOfSquares(size), [], part << 33
    codes = encoder(path)

    def close(window: list) -> None:
        nonlocal next_id
        offset = 0
        for doc, start, total, ids in window:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            done.append((doc, start, len(ids), crc, total, next_id, offset))
            offset += len(ids)
        next_id += 1

    for frame in frames:
        for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
            ids = np.append(codes.ids("" if text is None else text), np.uint32(end_id))
            doc, total, start = None if pd.isna(doc) else int(doc), len(ids), 0
            while total - start >= size:
                close([(doc, start, total, ids[start : start + size])])
                start += size
            if start < total:
                full = state.put((doc, start, total, ids[start:].copy()), total - start)
                if full:
                    close(full)
        if len(done) > 5_000:
            yield frame_of(done)
            done.clear()
    # What is still open is laid end to end and cut at the window size: one padded window a task at most.
    window, filled = [], 0
    for doc, start, total, ids in (p for w in state.rest() for p in w):
        while len(ids):
            take = min(len(ids), size - filled)
            window.append((doc, start, total, ids[:take]))
            ids, start, filled = ids[take:], start + take, filled + take
            if filled == size:
                close(window)
                window, filled = [], 0
    if window:
        close(window)
    if done:
        yield frame_of(done)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 2048) -> DataFrame:
    """One row per piece of a document: where it lies and a checksum of its ids.

    ``vocabulary`` is the path of a tokenizer file that every machine has.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from pack_partition(frames, vocabulary, end_id, size, TaskContext.get().partitionId())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text_batches(rows, run, PIECES)
