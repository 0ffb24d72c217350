"""SimHash near-dedup by deletion-variant signatures.

Fingerprints at most ``max_bits`` bits apart, cut into max_bits // 2 + 1
segments, have a segment where they differ in one bit at most. Each
fingerprint is indexed under every segment with one bit wildcarded; equal keys
are candidates and are verified on all 64 bits. Copies collapse to one
fingerprint first. A bucket above ``block`` members is not compared whole: its
members go on to the bits that its key leaves free, cut and wildcarded in the
same way, until the buckets are small. Buckets yield links to the smallest
fingerprint of each linked set, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.session import materialize

from .common import NO_ID, arrow_rows, connected_components, fresh, mixed, row_print

SHINGLE, MAX_BITS, SEED = 3, 2, 42
BLOCK = 2048
CHUNK = 1 << 16
CELLS = 1 << 18  # pairs of a bucket compared at once
INDEXED = 1024  # fingerprints indexed at once
TEXTS = 1000  # texts of an Arrow batch
ENTRY = "key long, path long, fp long, id long"
LINK = f"{ENTRY}, other long"


def fingerprint(text: bytes | None, shingle: int, seed: int = SEED) -> int:
    """SimHash of the word shingles, as a signed 64-bit number; 0 without words."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    count = np.zeros(64, np.int64)
    for at in range(0, len(pieces), CHUNK):
        part = pieces[at:at + CHUNK]
        h = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in part), "<u8", len(part))
        count += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(pieces), bitorder="little").view("<i8")[0])


def fingerprints_of(shingle: int, seed: int = SEED):
    """A pandas UDF: text as binary -> fingerprint as long."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")
    return F.pandas_udf(run, "long")


def segments(free: int, max_bits: int) -> list[int]:
    """Masks that cut the bits of ``free`` into max_bits // 2 + 1 parts."""
    bits = [b for b in range(64) if free >> b & 1]
    parts = min(max_bits // 2 + 1, max(1, len(bits)))
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def variants(free: int, max_bits: int) -> list[int]:
    """Masks of the bits that agree: each segment less one bit."""
    return [m & ~(1 << b) for m in segments(free, max_bits) for b in range(64) if m >> b & 1]


def free_bits(path: int, level: int, max_bits: int) -> int:
    """The bits left free by the ``level`` variants that ``path`` numbers, 64 to a level."""
    free = (1 << 64) - 1
    for step in reversed([path >> 6 * i & 63 for i in range(level)]):
        free &= ~variants(free, max_bits)[step]
    return free


def bits_left(levels: int, max_bits: int) -> int:
    """The most free bits that a member of a bucket has after so many levels."""
    free = (1 << 64) - 1
    for _ in range(levels):
        free &= ~min(variants(free, max_bits), key=int.bit_count)
    return free.bit_count()


def index(level: int, max_bits: int):
    """Partition function: (fp, id, path, key) -> a row for each deletion variant of
    the free bits. The new key is a hash of the bucket's key so far, the path and
    the bits fixed now, so members of a bucket agree in all bits fixed at any
    level; a clash of two keys only adds candidates, as links are verified on all
    bits."""
    def run(batches):
        masks: dict = {}
        for whole in batches:
            for at in range(0, len(whole), INDEXED):
                yield from indexed(whole.slice(at, INDEXED), masks)

    def indexed(batch, masks):
        fp, ident, path, before = (batch.column(i).to_numpy() for i in range(4))
        for p in np.unique(path).tolist():
            if p not in masks:
                masks[p] = np.array(variants(free_bits(p, level, max_bits), max_bits), np.uint64)
            m, own = masks[p], path == p
            to = p * 64 + np.arange(len(m))
            fixed = fp[own].view(np.uint64)[:, None] & m[None, :]
            key = mixed(mixed(fixed) ^ mixed((to + 1).astype(np.uint64) + np.uint64(level << 56))[None, :])
            if level:
                key = mixed(key ^ before[own].view(np.uint64)[:, None])
            n = len(m)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(to, own.sum())),
                 pa.array(np.repeat(fp[own], n)), pa.array(np.repeat(ident[own], n))],
                names=["key", "path", "fp", "id"])
    return run


def linked(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """For each fingerprint of a bucket, the smallest index it is linked with through the bucket."""
    n, strip = len(fp), max(1, CELLS // max(1, len(fp)))
    near = np.empty((n, n), bool)
    for at in range(0, n, strip):
        near[at:at + strip] = np.bitwise_count((fp[at:at + strip, None] ^ fp[None, :]).view(np.uint64)) <= max_bits
    label = np.arange(n, dtype=np.int32)
    while True:
        low = np.concatenate([np.where(near[at:at + strip], label[None, :], np.int32(n)).min(axis=1) for at in range(0, n, strip)])
        if (low == label).all():
            return label
        label = low


def compare(max_bits: int, block: int):
    """Partition function over rows sorted by bucket (key, path): links of small
    buckets; members of larger ones unchanged, ``other`` null."""
    def rows(key, path, fp, ident, other):
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(path), pa.array(fp), pa.array(ident),
             pa.nulls(len(fp), pa.int64()) if other is None else pa.array(other)],
            names=["key", "path", "fp", "id", "other"])

    def small(key, path, fp, ident, at, stop):
        """Links in the buckets [at, stop) of two or more members."""
        out_a, out_b = [], []
        pair = at[stop - at == 2]
        if len(pair):
            near = np.bitwise_count((fp[pair] ^ fp[pair + 1]).view(np.uint64)) <= max_bits
            out_a.append(ident[pair[near]])
            out_b.append(ident[pair[near] + 1])
        for a, z in zip(at[stop - at > 2], stop[stop - at > 2]):
            to = linked(fp[a:z], max_bits)
            far = np.flatnonzero(to != np.arange(z - a))
            out_a.append(ident[a:z][far])
            out_b.append(ident[a:z][to[far]])
        if sum(map(len, out_a)):
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            low, high = np.unique(np.stack([low, high]), axis=1)  # a pair meets in up to 64 buckets
            none = np.zeros(len(low), np.int64)
            yield rows(none, none, none, low, high)

    def run(batches):
        held, large = None, None  # rows of the last bucket so far; the key of a bucket found large
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            key, path, fp, ident = cols
            if not len(key):
                continue
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (path[1:] != path[:-1])]))
            stop = np.append(new[1:], len(key))
            over = stop - new > block
            if large is not None and (key[0], path[0]) == large:
                over[0] = True
            for a, z in zip(new[over], stop[over]):
                yield rows(key[a:z], path[a:z], fp[a:z], ident[a:z], None)
            large = (key[-1], path[-1]) if over[-1] else None
            held = None if over[-1] else [x[new[-1]:] for x in cols]
            several = ~over & (stop - new > 1)
            several[-1] = False
            yield from small(key, path, fp, ident, new[several], stop[several])
        if held is not None and len(held[0]) > 1:
            yield from small(*held, np.array([0]), np.array([len(held[0])]))
    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b) over the ids of ``distinct`` (fp, id): enough links to connect all
    that a chain of fingerprints at most ``max_bits`` apart connects."""
    zero = F.lit(0).cast("long")
    todo, level, out = distinct.select("fp", "id", zero.alias("path"), zero.alias("key")), 0, None
    # A fingerprint becomes one row per variant: a number that is not merged to a few tasks by the small size before.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # Fingerprints are distinct and a bucket's members agree in all bits but the free
        # ones, so it holds 2 ** (free bits) at most: few bits left end the descent.
        left = bits_left(level + 1, max_bits)
        compared = materialize(
            todo.repartition(tasks, "fp").mapInArrow(index(level, max_bits), ENTRY)
            .repartition("key").sortWithinPartitions("key", "path")
            .mapInArrow(compare(max_bits, max(block, 1 << left) if left <= 12 else block), LINK))
        found = compared.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
        out = found if out is None else out.union(found)
        large = compared.where("other is null")
        if large.isEmpty():
            return out.distinct()
        todo, level = large.select("fp", "id", "path", "key"), level + 1


def grouped(docs: DataFrame, shingle: int, max_bits: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """(id, print, fp, group): a row per row of ``docs``; the group is the smallest fingerprint of the row's component."""
    with arrow_rows(docs.sparkSession, TEXTS):
        marked = materialize(docs.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), row_print(text_col).alias("print"),
            fingerprints_of(shingle)(F.col(text_col).cast("binary")).alias("fp")))
    # Fingerprints stand for themselves, so that rows of one id, or of none, are linked by their texts alone.
    distinct = materialize(marked.select("fp").distinct().withColumn("id", F.col("fp")))
    groups = connected_components(links(distinct, max_bits, block)).select(
        F.col("id").alias("gfp"), F.col("component").alias("group"))
    return marked.join(groups, marked["fp"] == groups["gfp"], "left").select(
        "id", "print", "fp", F.coalesce("group", "fp").alias("group"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of ``docs``.

    Null and empty texts have the fingerprint zero and are linked like any
    other. Each row is a document of its own, also where rows share an id or
    have none. Component ids are the smallest ids reachable over links of at
    most ``max_bits`` differing bits; a null id counts as the smallest and is
    given back as null.
    """
    rows = materialize(grouped(docs, shingle, max_bits, block, id_col, text_col))
    least = rows.groupBy(F.col("group").alias("lgroup")).agg(F.min("id").alias("component"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.join(least, rows["group"] == least["lgroup"]).select(
        real("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        real("component").alias("component_id"))


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: one with its smallest id."""
    key, row, kid, krow = (fresh(docs, x) for x in ("key", "row", "kid", "krow"))
    kept = (grouped(docs, shingle, max_bits, BLOCK, id_col, text_col)
            .groupBy("group").agg(F.min(F.struct("id", "print")).alias("least"))
            .select(F.col("least.id").alias(kid), F.col("least.print").alias(krow)))
    keyed = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(row, row_print(text_col))
    return (keyed.join(kept, (keyed[key] == kept[kid]) & (keyed[row] == kept[krow]))
            .dropDuplicates([key, row]).select(*docs.columns))
