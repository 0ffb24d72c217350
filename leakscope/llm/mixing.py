"""Mixing sources to target weights by systematic sampling.

Within a source, documents are lined up by size; each expects
target / source size copies. One random offset shifts the running sum of
expected copies, and a copy is emitted for each integer boundary crossed. The
lining up by size makes the words taken meet the target closely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.session import materialize

from .common import WORD, fresh, rank_within, row_print, uniform

WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix-1"
PART = 10_000  # copies of one row that a task emits


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): sources by code point,
    null last, weigh ``weights`` in turn and share the total of all sizes; a
    target stops at ``most`` times its source's size and the excess is reshared
    by weight. Only sums come to the driver, one round per new set of full
    sources."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = total.withColumn("nulls", F.col("source").isNull()).withColumn("all", F.lit(0))
    ranked = rank_within(order, "all", ["nulls", "source"], "nth")
    cycle = F.array(*[F.lit(w) for w in weights])
    table = materialize(ranked.select(
        "source", "source_size", F.element_at(cycle, (F.col("nth") % len(weights)).cast("int") + 1).alias("weight")))
    level, full = None, -1
    cap = F.col("source_size") * most
    while True:
        is_full = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        s = table.agg(F.sum("source_size").alias("all"), F.count(F.when(is_full, 1)).alias("full"),
                      F.sum(F.when(is_full, cap).otherwise(0)).alias("given"),
                      F.sum(F.when(~is_full, F.col("weight"))).alias("weights")).first()
        if s["full"] == full or not s["weights"]:
            break
        full, level = s["full"], (s["all"] - s["given"]) / s["weights"]
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(level or 0)))
    return table.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row per row of ``docs``; see ``dealt``."""
    return dealt(docs, *args, **options).drop("print")


def dealt(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``mix`` and print, which tells rows of one id apart.

    Size is the number of words; null and empty texts have size 0 and no copy.
    A null source is a source of its own. Rows that tie, also repeated ones,
    are lined up by id (null last) and then in any order, which changes nothing
    in the result. If all sizes are 0 nothing is taken. At most ``most`` copies of
    a document are taken. The same rows and seed give the same result.
    """
    sized = materialize(docs.select(
        F.col(id_col).alias("doc_id"), row_print(text_col).alias("print"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    targets = source_targets(sized.select("source", "size"), weights, most)
    lined = rank_within(sized.withColumn("nulls", F.col("doc_id").isNull()), "source", ["size", "nulls", "doc_id", "print"], "nth")
    rates = targets.select(
        F.col("source").alias("tsource"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        uniform(F.lit(seed), F.col("source")).alias("offset"))
    crossed = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    copies = F.least(crossed(F.col("nth") + 1) - crossed(F.col("nth")), F.lit(most).cast("long"))
    return (lined.join(rates, F.col("source").eqNullSafe(F.col("tsource")))
            .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
            .select("doc_id", "print", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: ``docs`` with each row as often as the mix takes it,
    numbered from 1 in ``copy`` (a column of that name is replaced). Rows of equal
    id and text must be equal: the copies of all of them are dealt in turn."""
    base = docs.drop("copy")
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    key, row, n, rows, own, part = (fresh(base, x) for x in ("key", "row", "n", "rows", "own", "part"))
    copies = (dealt(base, **options).groupBy(F.col("doc_id").alias(key), F.col("print").alias(row))
              .agg(F.sum("copies").alias(n), F.count("*").alias(rows)).where(F.col(n) > 0))
    marked = base.withColumn(own, row_print(text_col))
    joined = marked.join(copies, marked[id_col].eqNullSafe(F.col(key)) & (marked[own] == F.col(row)))
    once = joined.where(F.col(rows) == 1).withColumn(part, F.lit(0).cast("long"))
    # A row that comes very often is repeated in two steps: parts of its copies are dealt to tasks first.
    often = (joined.where(F.col(rows) > 1).dropDuplicates([id_col, own])
             .withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / PART))))
             .repartition(id_col, own, part))
    return (once.union(often)
            .withColumn("copy", F.explode(F.sequence(F.col(part) * PART + 1, F.least((F.col(part) + 1) * PART, F.col(n)))))
            .select(*base.columns, "copy"))
