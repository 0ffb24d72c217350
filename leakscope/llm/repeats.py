"""Seed-and-extend search for repeated windows of units (words or lines).

A document is a sequence of units; which runs of consecutive units are windows
is a function of the units alone (``fixed``, ``qualified``), and no window holds
another one strictly inside. A unit is *repeated* when it lies in a window
whose unit sequence also starts earlier (smaller doc_id, then print of the text, or
the same document at an earlier start). The search is exact and emits no pairs:

1. Seeds. Winnowing picks, in each window, the ``gram``-unit piece with the
   smallest hash (the leftmost of equal ones). Equal windows pick the same
   piece, so equal windows always share an anchor. The windows that picked one
   anchor are neighbours; together they are the anchor's *span*.
2. Join. Anchors meet on their hash. An anchor seen once has no repeat.
3. Extend. Occurrences whose whole spans, left and right of the anchor, are
   equal need no closer look: all but the first are repeated. Only where spans
   of one anchor differ (the ends of a match) are the windows of each distinct
   span compared one by one.
4. The repeated windows of a document are united to its maximal repeats.

Keys are two independent 64-bit hashes. Equal keys inside one Arrow batch are
reduced to their first before any shuffle, so a passage that a third of all
documents share reaches the shuffle once a batch. What is left of an anchor is dealt
over ``SALTS`` tasks: anchors are counted per key (combined before the shuffle), and
the count goes to the salts that the key has; the first of a key is found per salt,
then among the salts' firsts. A window that is compared by itself (3.) is not dealt:
its shuffle is the largest, and a second one would double it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, Hashes, Powers, fresh, mixed, prefix_sums, range_hashes, row_print, stored

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def fixed(size: int) -> Callable:
    """Windows: every run of ``size`` units."""
    if size < 1:
        raise ValueError("size >= 1 is needed")

    def run(units):
        start = np.arange(max(len(units) - size + 1, 0))
        return start, start + size
    return run


def qualified(min_units: int, min_words: int, long_words: int) -> Callable:
    """Windows: the shortest runs, from each unit on and up to each unit, that hold
    ``min_units`` units and ``min_words`` words, or ``long_words`` words in any
    number of units. They cover each longer run that does so, and nothing else.
    Every unit must hold a word."""
    if min_units < 1 or long_words < 1:
        raise ValueError("min_units >= 1 and long_words >= 1 are needed")

    def run(units):
        n = len(units)
        upto = np.concatenate([[0], np.cumsum([len(u.split()) for u in units])]).astype(np.int64)
        at = np.arange(n)
        stop = np.minimum(np.maximum(np.searchsorted(upto, upto[:-1] + min_words), at + min_units),
                          np.searchsorted(upto, upto[:-1] + long_words))
        start = np.maximum(np.minimum(np.searchsorted(upto, upto[1:] - min_words, "right"), at + 2 - min_units),
                           np.searchsorted(upto, upto[1:] - long_words, "right")) - 1
        whole, back = stop <= n, start >= 0
        both = np.unique(np.concatenate([at[whole] << 32 | stop[whole], start[back] << 32 | at[back] + 1]))
        return both >> 32, both & 0xFFFFFFFF
    return run


def leftmost_least(x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The place of the least x[start:stop] of each range, the first of equal ones."""
    width = stop - start
    if (width == width[0]).all():
        view = np.lib.stride_tricks.sliding_window_view(x, width[0])
        return (view if len(view) == len(start) else view[start]).argmin(axis=1) + start
    power = np.frexp(width)[1] - 1  # the whole part of the width's binary logarithm
    out, best = start.copy(), np.arange(len(x))
    for level in range(power.max() + 1):
        own = power == level
        left, right = best[start[own]], best[stop[own] - (1 << level)]
        out[own] = np.where(x[left] <= x[right], left, right)
        left, right = best[:max(len(best) - (1 << level), 0)], best[1 << level:]
        best = np.where(x[left] <= x[right], left, right)
    return out


class Sequences:
    """Unit hashes of a text, and from them anchors, spans and windows."""

    def __init__(self, split: Callable, windows: Callable, gram: int):
        self.split, self.cut, self.gram = split, windows, gram
        self.hashes, self.powers = Hashes(), [Powers(b) for b in BASES]

    def load(self, text: bytes) -> bool:
        """False where the text has no window."""
        units = self.split(text)
        self.start, self.stop = self.cut(units)
        if len(self.start) == 0:
            return False
        own = self.hashes.of(units)
        self.sums = [prefix_sums(own, p) for p in self.powers]
        return True

    def of_range(self, which: int, start, stop):
        sums, down = self.sums[which]
        return range_hashes(sums, down, start, stop).view(np.int64)

    def anchors(self):
        """(hash of the anchor, hash of its span, the span's start and stop) of each anchor."""
        at = np.arange(len(self.sums[0][0]) - self.gram)
        grams = self.of_range(0, at, at + self.gram)
        # Compare another scrambling than the one that is the key: minima would share high bits.
        order = mixed(grams.view(np.uint64) ^ np.uint64(BASES[1]))
        pick = leftmost_least(order, self.start, self.stop - self.gram + 1)
        new = np.concatenate([[True], pick[1:] != pick[:-1]])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(pick)]]) - 1
        start, stop = self.start[first], self.stop[last]
        offset = (pick[first] - start) << 32 | (stop - start)  # equal spans must also lie alike
        with np.errstate(over="ignore"):
            spans = mixed(self.of_range(1, start, stop).view(np.uint64) ^ mixed(offset.astype(np.uint64)))
        return grams[pick[first]], spans.view(np.int64), start, stop

    def windows(self, start, stop):
        """Both hashes, start and stop of each window inside the spans; none where a span is not of this text."""
        first = np.searchsorted(self.start, start)
        n = np.maximum(np.searchsorted(self.stop, stop, "right") - first, 0)
        at = np.unique(np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        a, b = self.start[at], self.stop[at]
        return self.of_range(0, a, b), self.of_range(1, a, b), a, b


def united(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of a union of half-open intervals."""
    if len(start) == 0:
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], np.concatenate([reach[:-1][new[1:]], reach[-1:]])


def earlier_first(key1, key2, doc, at) -> np.ndarray:
    """Mask of the rows that are the earliest of their key, ties included."""
    order = np.lexsort((at, doc, key2, key1))
    k1, k2, d, a = key1[order], key2[order], doc[order], at[order]
    new = np.ones(len(order), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(order), bool)
    out[order] = (d == d[lead]) & (a == a[lead])
    return out


SALTS = 16  # tasks over which the occurrences of one key are dealt
FOUND = "key1 long, key2 long, doc long, row long, start int, stop int"


def places(batch) -> tuple[np.ndarray, list[int]]:
    """The different (doc, row) of a batch in order, and each row's place among them."""
    own = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    known = sorted(set(own))
    place = {x: i for i, x in enumerate(known)}
    return np.array(known, np.int64).reshape(-1, 2), [place[x] for x in own]


def reduced(known, key1, key2, doc, start, stop):
    """A batch of occurrences, documents by their place in ``known``: the first of
    each key goes on, the others are united per document to repeated ranges
    [start, stop) under null keys."""
    first = earlier_first(key1, key2, doc, start)
    docs, a, b = doc[~first], start[~first], stop[~first]
    done: tuple[list, list, list] = ([], [], [])
    order = np.argsort(docs, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(docs[order])) + 1) if len(order) else []:
        s, e = united(a[at], b[at])
        for to, x in zip(done, (np.full(len(s), docs[at[0]], np.int64), s, e)):
            to.append(x)
    none = sum(map(len, done[0]))
    column = lambda x, extra, kind: pa.array(np.concatenate([x[first], *extra]), kind)
    null = pa.nulls(none, pa.int64())
    place = np.concatenate([doc[first], *done[0]]).astype(np.int64)
    return pa.RecordBatch.from_arrays([
        pa.chunked_array([pa.array(key1[first]), null]).combine_chunks(),
        pa.chunked_array([pa.array(key2[first]), null]).combine_chunks(),
        pa.array(known[place, 0]), pa.array(known[place, 1]),
        column(start, done[1], pa.int32()), column(stop, done[2], pa.int32())],
        names=["key1", "key2", "doc", "row", "start", "stop"])


def scan(split, windows, gram):
    """Partition function: (doc, row, text) -> the anchors of each batch, reduced."""
    def run(batches):
        seq = Sequences(split, windows, gram)
        for batch in batches:
            parts = []
            known, place = places(batch)
            for doc, text in zip(place, batch.column(2)):
                text = text.as_py()
                if text and seq.load(text):
                    g, s, a, b = seq.anchors()
                    parts.append((g, s, np.full(len(g), doc, np.int64), a, b))
            if parts:
                yield reduced(known, *(np.concatenate(x) for x in zip(*parts)))
    return run


def scan_windows(split, windows, gram):
    """Partition function: (doc, row, text, spans) -> the windows of the spans, reduced."""
    def run(batches):
        seq = Sequences(split, windows, gram)
        for batch in batches:
            parts = []
            known, place = places(batch)
            for doc, text, spans in zip(place, batch.column(2), batch.column(3)):
                text = text.as_py()
                if text and seq.load(text):
                    own = np.unique(spans.values.to_numpy())
                    h1, h2, a, b = seq.windows(own >> 32, own & 0xFFFFFFFF)
                    parts.append((h1, h2, np.full(len(a), doc, np.int64), a, b))
            if parts:
                yield reduced(known, *(np.concatenate(x) for x in zip(*parts)))
    return run


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc", "row"), F.lit(SALTS)))


def repeated_anchors(met: DataFrame) -> DataFrame:
    """The rows of ``met`` whose key1 occurs again, with ``differ``: do their spans differ?"""
    here = F.bit_or(F.expr("shiftleft(1, cast(salt as int))")).alias("here")
    again = (met.groupBy("key1").agg(F.count("*").alias("n"), (F.min("key2") != F.max("key2")).alias("differ"), here).where("n > 1")
             .select(F.col("key1").alias("k"), "differ",
                     F.expr(f"explode(filter(sequence(0L, {SALTS - 1}L), s -> getbit(here, cast(s as int)) = 1))").alias("s")))
    return met.join(again, (F.col("key1") == F.col("k")) & (F.col("salt") == F.col("s"))).drop("k", "s")


def with_later(rows: DataFrame) -> DataFrame:
    """``rows`` with ``later``: is it not the first of its keys? Rows without a key have groups of their own.

    Rows with a ``salt`` are compared per salt first, then the firsts of the salts.
    """
    order = ["doc", "row", "start"]
    own, alone = F.struct(*order), F.xxhash64(*order)
    not_first = lambda *by: F.first(own).over(Window.partitionBy(*by).orderBy(*order)) != own
    if "salt" not in rows.columns:
        return rows.withColumn("group", F.coalesce("key1", alone)).withColumn("later", not_first("group", "key2"))
    near = rows.withColumn("near", not_first("key1", "key2", "salt"))
    # Rows known to be later need no further comparison and are spread evenly.
    spread = near.withColumn("group", F.when(F.col("near"), alone).otherwise(F.col("key1")))
    return spread.withColumn("later", F.col("near") | not_first("group", "key2", "near"))


def repeated_ranges(docs: DataFrame, doc: str, row: str, text: str, split: Callable, windows: Callable,
                    gram: int) -> DataFrame:
    """(doc, row, ranges array<long>) per document with repeated units.

    ``doc`` and ``row`` (longs, not null; together a document) and ``text`` (string) name columns of ``docs``. A
    range is packed as start << 32 | stop, in units; ranges may overlap. Texts
    that are null, empty or without a window have none. No window may have fewer
    units than ``gram``.
    """
    found = stored(docs.select(doc, row, F.col(text).cast("binary")).mapInArrow(scan(split, windows, gram), FOUND))
    packed = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("stop").cast("long"))
    met = repeated_anchors(salted(found.where("key1 is not null")))
    judged = stored(with_later(met).where("later or differ").select("doc", "row", "start", "stop", "later"))
    spans = (judged.where("not later").groupBy(F.col("doc").alias(fresh(docs, "sdoc")), F.col("row").alias(fresh(docs, "srow")))
             .agg(F.collect_list(packed).alias(fresh(docs, "spans"))))
    # The caller's plan joins all of ``docs`` by ``doc`` and ``row`` again. Taking all columns
    # here too makes the two exchanges equal, and Spark moves the text once.
    ends = (docs.join(spans, (docs[doc] == spans[fresh(docs, "sdoc")]) & (docs[row] == spans[fresh(docs, "srow")]))
            .select(doc, row, F.col(text).cast("binary"), fresh(docs, "spans"), *[docs[c] for c in docs.columns if c not in (doc, row, text)])
            .mapInArrow(scan_windows(split, windows, gram), FOUND))
    compared = with_later(ends).where("key1 is null or later")
    ranges = (found.where("key1 is null").select("doc", "row", packed.alias("r"))
              .union(judged.where("later").select("doc", "row", packed.alias("r")))
              .union(compared.select("doc", "row", packed.alias("r"))))
    return ranges.groupBy("doc", "row").agg(F.collect_list("r").alias("ranges"))


def kept_mask(n: int, ranges) -> np.ndarray:
    """Which of ``n`` units no range covers."""
    step = np.zeros(n + 1, np.int64)
    if ranges is not None and len(ranges):
        r = np.asarray(ranges, np.int64)
        np.add.at(step, np.minimum(r >> 32, n), 1)
        np.add.at(step, np.minimum(r & 0xFFFFFFFF, n), -1)
    return np.cumsum(step)[:n] == 0


def with_ranges(docs: DataFrame, split, windows, gram, id_col="doc_id", text_col="text"):
    """``docs`` with a column of its repeated ranges; also that column's name.

    Rows with a null id come before all others. Rows that share an id, or have
    none, are documents of their own, in the order of their texts' prints; only
    those of equal texts count as copies of one document, which never repeat
    each other.
    """
    doc, row, ranges, key, rkey = (fresh(docs, x) for x in ("doc", "row", "ranges", "rdoc", "rrow"))
    keyed = docs.withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(row, row_print(text_col))
    found = repeated_ranges(keyed, doc, row, text_col, split, windows, gram).select(
        F.col("doc").alias(key), F.col("row").alias(rkey), F.col("ranges").alias(ranges))
    return keyed.join(found, (F.col(doc) == F.col(key)) & (F.col(row) == F.col(rkey)), "left").drop(key, rkey), ranges
