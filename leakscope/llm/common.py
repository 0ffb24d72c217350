"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leakscope.session import materialize, scratch_path

#: A word: a longest run of code points other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a missing doc_id where rows are ordered; it sorts before all ids.
NO_ID = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, so extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def row_print(text_col: str):
    """A column that tells rows of one id, or of none, apart by their texts. Rows
    of equal id and text are copies; a clash of prints matters only within an id."""
    return F.xxhash64(F.col(text_col))


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder; what is written there goes when the driver ends."""
    path = scratch_path(spark, f"llm/{uuid.uuid4().hex}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def stored(df: DataFrame, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again: it
    cuts the lineage like a checkpoint but compressed and by column. The table
    goes when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uniform(*parts):
    """Column in [0, 1): the first 52 bits of an md5 of the parts, so that
    reruns, lost tasks and other SQL engines draw the same number."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Plans run inside hand at most ``most`` rows at a time to Python, so that a
    worker holds few texts; what is set before holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Hashes(dict):
    """unit (bytes or str) -> 64-bit hash, remembered up to ``limit`` units."""

    limit = 200_000

    def __missing__(self, unit):
        if len(self) >= self.limit:
            self.clear()
        h = self[unit] = xxhash.xxh64_intdigest(unit)
        return h

    def of(self, units) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, units), np.uint64, len(units))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)])
                    for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(prefix: np.ndarray, down: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the unit ranges [start, stop) from prefix sums of hash * base**i."""
    with np.errstate(over="ignore"):
        return mixed((prefix[stop] - prefix[start]) * down[start])


def prefix_sums(hashes: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.upto(len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:len(hashes)], dtype=np.uint64)])
    return sums, down


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that ``edges`` (a long, b long) mentions;
    the component is the smallest id reachable.

    Alternates the large-star and small-star steps until the edges no longer
    change; each step is a minimum per node (combined map-side) joined back to
    the edges, so a node with very many links is split like any skewed join
    key. Rounds are cut with checkpoints; only a count and a checksum of the
    edges come to the driver.
    """
    def state(e):
        r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return r["n"], r["x"]

    now = materialize(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lower, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(lower.select("a", F.col("m").alias("b"))).distinct())
        now = materialize(small)
        found = state(now)
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def rank_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the 0-based rank in its group by ``order``.

    Rows are range-partitioned on (group, order), so a group of any size is
    spread over tasks, and cut with a checkpoint; each task's count per group
    then gives the offsets. The offset table has a row per task and group that
    meet, at most tasks + groups.
    """
    part, row, off = "__part", "__row", "__off"
    cols = [group, *order]
    placed = materialize(df.repartitionByRange(*cols).sortWithinPartitions(*cols)
                         .withColumn(row, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(row, 33))
    met = placed.groupBy(group, part).agg(F.count("*").alias("__n"), F.min(row).alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn(off, F.coalesce(before, F.lit(0)) - F.col("__first")).select(
        F.col(group).alias("__g"), F.col(part).alias("__p"), off)
    return (placed.join(met, placed[group].eqNullSafe(met["__g"]) & (placed[part] == met["__p"]))
            .withColumn(name, F.col(row) + F.col(off)).drop("__g", "__p", off, row, part))
