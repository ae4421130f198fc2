"""Substring dedup by level-wise doubling.

Level one looks at windows of half the length: of the half windows inside each full window the one with the smallest
hash stands for it (so about a sixth of them are sent), and a full window can repeat only if its half window does.
Only such windows are extended to twice the length, at level two, and compared by a hash of 96 bits; two different
windows of n candidates share one with probability n*n / 2**97, beside that of their words (see words.py).
:func:`repeats` goes on doubling until no candidates survive.

No stage gathers the occurrences of a window. At each level the first holder of each hash is aggregated with partial
sums, and one row a hash goes back to that row: the half windows that occur once, then the windows that it is the
first to have. What a document has beside those occurs earlier. A row whose whole text an earlier row has is known from one
hash of 128 bits: all its windows occur earlier, so it sends none at level two. Rows are found again by a hash of doc_id and text, so
many rows of one doc_id, or without one, don't meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, texts
from .words import MULTIPLIER, Words, chunks, grams, least, mix

WINDOW = 20
NULL_ID = (1 << 63) - 1  #: a null doc_id comes after all others
ROW_BITS = 40  #: a row takes another's first window for its own with a probability of 2**-ROW_BITS
MULTIPLIER2 = 0xD6E8FEB86659FD93


class _Windows:
    """The windows of some texts. A window has the number of its first word; those that leave their text aren't `whole`."""

    def __init__(self, words: Words, window: int):
        self.window, self.hash = window, words.hashes()
        n = max(0, len(words) - window + 1)
        self.whole = words.left()[:n] >= window
        self.half = mix(grams(self.hash, window // 2))
        self.chosen = least(self.half, window - window // 2 + 1) if n else np.empty(0, np.uint64)  # the half window that stands for each

    def places(self) -> np.ndarray:
        """Numbers of the half windows that stand for some whole window."""
        if not self.whole.any():
            return np.empty(0, np.int64)
        width = self.window - self.window // 2 + 1
        used = np.where(self.whole, self.chosen, np.uint64(0))
        pad = np.zeros(width - 1, np.uint64)
        return np.flatnonzero((least(np.concatenate([pad, used, pad]), width, np.maximum) == self.half) & (self.half > 0))

    def candidates(self, alone: np.ndarray) -> np.ndarray:
        """Numbers of the whole windows whose half window isn't alone."""
        if not len(self.chosen):
            return np.empty(0, np.int64)
        runs = np.flatnonzero(np.append(True, self.chosen[1:] != self.chosen[:-1]))
        open_ = ~np.isin(self.chosen[runs].view(np.int64), alone)
        return np.flatnonzero(np.repeat(open_, np.diff(np.append(runs, len(self.chosen)))) & self.whole)

    def names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each of these windows."""
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        second = mix(grams(mix(self.hash), self.window, MULTIPLIER2))[at] >> np.uint64(32)
        return mix(grams(self.hash, self.window, MULTIPLIER))[at].view(np.int64), second.astype(np.uint32).view(np.int32)


def _flat(column: pa.ListArray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """(all values of the lists of these rows, which of the rows each is of); a null list is empty."""
    part = column.slice(rows.start, rows.stop - rows.start)
    values = part.flatten().to_numpy(zero_copy_only=False)
    sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return values.astype(np.int64, copy=False), np.repeat(np.arange(len(sizes)), sizes)


def _numbers(column: pa.Array, rows: slice) -> np.ndarray:
    return column.slice(rows.start, rows.stop - rows.start).to_numpy()


def _flags(column: pa.Array, rows: slice) -> np.ndarray:
    return column.slice(rows.start, rows.stop - rows.start).to_numpy(zero_copy_only=False).astype(bool)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (the order), row (ROW_BITS bits by which a row is found again, and the order of rows with the same doc), doc_id, text."""
    row = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"), 64 - ROW_BITS)
    return texts(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), row.alias("row"), "doc_id", "text")


def _with_alone(docs: DataFrame, window: int, copies: bool) -> DataFrame:
    """docs with alone (the half windows that stand for one of the row's windows and occur nowhere else) and copy (whether an earlier row has the whole text, if asked for)."""

    def level_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words in chunks(b["text"]):
                w = _Windows(words, window)
                at = w.places()
                if not len(at):
                    continue
                k, row = w.half[at].view(np.int64), _numbers(b["row"], words.rows)[words.text_of()[at]]
                order = np.argsort(k, kind="stable")
                k, row = k[order], row[order]
                first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                once = np.diff(np.append(first, len(k))) == 1
                yield pa.record_batch([pa.array(k[first]), pa.array(np.where(once, row[first], -1))], ["k", "row"])

    halves = docs.select("row", "text").mapInArrow(level_one, "k long, row long")  # row -1: more than one
    alone = halves.groupBy("k").agg(F.count("*").alias("n"), F.min("row").alias("row")).where("n = 1 AND row >= 0").select("row", "k")
    known = alone.unionByName(_copies(docs).select("row", F.lit(None).cast("long").alias("k"))) if copies else alone
    sides = known.groupBy("row").agg(F.collect_list("k").alias("alone"), F.max(F.col("k").isNull()).alias("copy"))
    return docs.join(sides, "row", "left").select("doc", "row", "doc_id", "text", "alone", F.coalesce("copy", F.lit(False)).alias("copy"))


def _copies(docs: DataFrame) -> DataFrame:
    """row, of the rows whose whole text an earlier row has."""
    name = [F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")]
    keyed = docs.select("doc", "row", *name).distinct()  # rows equal in doc_id and text are one document
    first = keyed.groupBy("a", "b").agg(F.min(F.struct("doc", "row")).alias("x"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, ["a", "b"]).where(F.struct("doc", "row") != F.col("x")).select("row")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), for each text.

    A word goes if a window of `window` words that covers it also starts earlier: in a smaller doc_id (nulls last) or before it
    in the same text. Rows that repeat a doc_id, or have none, are separate documents in the order of a hash of their texts;
    rows equal in both are one document, and get the same result. A null or empty text has no words. window is even.
    """
    if window % 2 or window < 2:
        raise ValueError("window must be even")
    with_alone = _with_alone(_keyed(docs), window, True)

    def level_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words in chunks(b["text"]):
                w = _Windows(words, window)
                at = w.candidates(_flat(b["alone"], words.rows)[0])
                at = at[~_flags(b["copy"], words.rows)[words.text_of()[at]]]
                if not len(at):
                    continue
                h, g = w.names(at)
                text = words.text_of()[at]
                doc, row = _numbers(b["doc"], words.rows)[text], _numbers(b["row"], words.rows)[text]
                order = np.lexsort((row, doc, g, h))
                h, g, doc, row = h[order], g[order], doc[order], row[order]
                first = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
                for part in np.array_split(np.flatnonzero(first), 1 + len(h) // (1 << 18)):
                    yield pa.record_batch([pa.array(x[part]) for x in (h, g, doc, row)], ["h", "g", "doc", "row"])

    # with the columns that the last step needs, so that both read one shuffle of the texts
    wide = with_alone.mapInArrow(level_two, "h long, g int, doc long, row long")
    firsts = wide.groupBy("h", "g").agg(F.min(F.struct("doc", "row")).alias("x")).groupBy("x.row").agg(F.collect_list("h").alias("firsts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words in chunks(b["text"]):
                w = _Windows(words, window)
                at = w.candidates(_flat(b["alone"], words.rows)[0])
                copy = _flags(b["copy"], words.rows)
                gone = copy[words.text_of()] & np.repeat(np.diff(words.first) >= window, np.diff(words.first))
                at = at[~copy[words.text_of()[at]]]
                if len(at):
                    salt = mix(np.arange(1, len(words.first), dtype=np.uint64)).view(np.int64)  # of each text
                    name = w.names(at)[0] ^ salt[words.text_of()[at]]
                    own, of = _flat(b["firsts"], words.rows)
                    _, first, which = np.unique(name, return_index=True, return_inverse=True)
                    again = at[(first[which] != np.arange(len(at))) | ~np.isin(name, own ^ salt[of])]  # earlier in this text, or in another
                    edges = np.bincount(again, minlength=len(words) + 1) - np.bincount(again + window, minlength=len(words) + 1)
                    gone |= np.cumsum(edges[:-1]) > 0
                sums = np.concatenate([[0], np.cumsum(gone)])
                removed = sums[words.first[1:]] - sums[words.first[:-1]]
                kept = []
                for i in range(len(removed)):
                    mine = words.text(i).split()
                    kept.append(b" ".join(compress(mine, (~gone[words.first[i] : words.first[i + 1]]).tolist()) if removed[i] else mine))
                ids = b["doc_id"].slice(words.rows.start, words.rows.stop - words.rows.start)
                yield pa.record_batch([ids, pa.array(np.diff(words.first).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = with_alone.join(firsts, "row", "left").select("doc", "row", "doc_id", "text", "alone", "copy", "firsts")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """width, hash, n: the windows that occur twice or more in docs, by width (window, twice that, four times, ...).

    Each level keeps the places whose two halves survived the level before, and ends when none is left; a place is a row and
    the number of its first word, so a level holds no more rows than the one before. Null and empty texts have no windows.
    """
    with_alone = checkpoint(_with_alone(_keyed(docs), window, False))

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words in chunks(b["text"]):
                w = _Windows(words, window)
                at = w.candidates(_flat(b["alone"], words.rows)[0])
                text = words.text_of()[at]
                yield pa.record_batch([pa.array(_numbers(b["row"], words.rows)[text]), pa.array((at - words.first[text]).astype(np.int64)), pa.array(w.names(at)[0])], ["row", "at", "h"])

    # rows equal in doc_id and text are told apart by a number of their own
    numbered = with_alone.withColumn("row", F.xxhash64("row", F.monotonically_increasing_id()))
    places = checkpoint(numbered.mapInArrow(first_level, "row long, at long, h long"))
    width, out = window, None
    while True:
        counts = places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
        found = checkpoint(counts.select(F.lit(width).alias("width"), F.col("h").alias("hash"), "n"))
        if out is not None and found.isEmpty():
            return out
        out = found if out is None else out.unionByName(found)
        if found.isEmpty():
            return out
        left = checkpoint(places.join(found.select(F.col("hash").alias("h")), "h", "left_semi"))
        second = left.select("row", (F.col("at") - width).alias("at"), F.col("h").alias("next"))
        places = checkpoint(left.join(second, ["row", "at"]).select("row", "at", F.xxhash64("h", "next").alias("h")))
        width *= 2
