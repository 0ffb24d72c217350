"""Exact distributed ranks, running totals and order statistics.

No window here ever holds all rows, or one class, in one partition:

* ``bucketed_rank`` ranks rows inside ``(part, bucket)`` windows and adds the
  bucket's offset, a running sum over a table of at most ``K x parts`` rows
  that is broadcast back (its size is bounded by construction).
* ``running_totals`` does the same with sums in place of counts, over a table
  that is first reduced to one row per distinct order value.
* ``grouped_order_stats`` finds exact order statistics by narrowing a value
  range with approximate-quantile edges until it holds few enough values,
  then sorting only that range's distinct values.

The bucket expression must not decrease along the order; hash uniforms
(``floor(u * K)``) and approximate-quantile edges both satisfy that.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.session import written

DEFAULT_BUCKETS = 4096


def uniform_bucket(u: Column, k: int = DEFAULT_BUCKETS) -> Column:
    """Bucket of a uniform in [0, 1): increases with u."""
    return F.least(F.floor(u * F.lit(float(k))), F.lit(k - 1)).cast("int")


def bucketed_rank(df: DataFrame, part_cols: list[str], order_cols: list[Column | str],
                  bucket: Column, name: str = "rank") -> DataFrame:
    """1-based rank of each row within ``part_cols`` by ``order_cols``.

    ``bucket`` must be monotone in the order. ``part_cols`` must have a small,
    known number of values (classes, folds, models): the offset table holds
    at most ``buckets x parts`` rows and is broadcast.
    """
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy(*part_cols, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part_cols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part_cols, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*part_cols, "_bkt").orderBy(*order_cols)
    ranked = b.withColumn("_rn", F.row_number().over(within))
    out = ranked.join(F.broadcast(offsets), [*part_cols, "_bkt"], "inner")
    return out.withColumn(name, (F.col("_off") + F.col("_rn")).cast("bigint")).drop("_bkt", "_off", "_rn")


def quantile_edges(df: DataFrame, col: str, k: int, accuracy: int = 10000) -> list[float]:
    """Strictly increasing interior edges from ``percentile_approx`` (k-1
    probabilities). Returns a short list collected to the driver (bounded
    by k)."""
    probs = [i / k for i in range(1, k)]
    row = df.agg(F.percentile_approx(col, probs, accuracy).alias("e")).first()
    edges = row["e"] or []
    out: list[float] = []
    for e in edges:
        if e is not None and not (isinstance(e, float) and math.isnan(e)) and (not out or e > out[-1]):
            out.append(float(e))
    return out


def edge_bucket(col: Column, edges: list[float]) -> Column:
    """Number of edges strictly below the value (0..len(edges)): monotone in
    the value, computed with a balanced tree of comparisons (log2 depth)."""

    def build(lo: int, hi: int) -> Column:
        # bucket index in [lo, hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2  # split on edge[mid]: value > edges[mid] -> bucket > mid
        return F.when(col > F.lit(edges[mid]), build(mid + 1, hi)).otherwise(build(lo, mid))

    if not edges:
        return F.lit(0)
    return build(0, len(edges))


def sized_edges(df: DataFrame, col: str, per_bucket: int = 50_000, most: int = 4096) -> list[float]:
    """Edges that leave about ``per_bucket`` rows in a bucket: count and edges
    come from one aggregate, and the edges are thinned to what the count asks for."""
    probs = [i / most for i in range(1, most)]
    row = df.agg(F.count(col).alias("n"), F.percentile_approx(col, probs, 2 * most).alias("e")).first()
    step = max(1, most // min(most, max(16, (row["n"] or 0) // per_bucket)))
    out: list[float] = []
    for e in (row["e"] or [])[step - 1::step]:
        if e is not None and not (isinstance(e, float) and math.isnan(e)) and (not out or e > out[-1]):
            out.append(float(e))
    return out


def running_totals(df: DataFrame, part_cols: list[str], order_col: str, sum_cols: list[str],
                   descending: bool = False, buckets: int | None = None, edges: list[float] | None = None) -> DataFrame:
    """Cumulative sums of ``sum_cols`` along ``order_col`` (inclusive), per
    ``part_cols``. ``df`` should already be one row per (part, order value).
    Buckets come from approximate-quantile edges of the order column, as many
    as the number of rows asks for, or ``buckets``."""
    if edges is None:
        edges = quantile_edges(df, order_col, buckets) if buckets else sized_edges(df, order_col)
    bkt = edge_bucket(F.col(order_col), edges)
    if descending:
        bkt = F.lit(len(edges)) - bkt
    b = df.withColumn("_bkt", bkt)
    totals = b.groupBy(*part_cols, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy(*part_cols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part_cols, "_bkt",
                            *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                              for c in sum_cols])
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    within = (Window.partitionBy(*part_cols, "_bkt").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = b.select("*", *[F.sum(c).over(within).alias(f"_l_{c}") for c in sum_cols])
    out = local.join(F.broadcast(offsets), [*part_cols, "_bkt"], "inner")
    return out.select(
        *df.columns,
        *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"cum_{c}") for c in sum_cols],
    )


def _sql_type(long: DataFrame, c: str) -> str:
    return dict(long.dtypes)[c].upper()


def rank_probs(ranges: list, accuracy: int, most: int) -> list[float]:
    """Probabilities whose approximate quantiles lie just outside each wanted rank of
    the ranges (key, lo, hi, offset, rows, ranks), on a grid of 1 / ``accuracy`` as the
    quantiles are no finer; evenly spread ones where that takes more than ``most``."""
    out = set()
    for _, _, _, off, n, ranks in ranges:
        for r in ranks:
            at = (r - off) * accuracy / n
            out |= {math.floor(at) - 2, math.ceil(at) + 2}
    probs = sorted(p / accuracy for p in out if 0 < p < accuracy)
    return probs if 0 < len(probs) <= most else [i / most for i in range(1, most)]


def grouped_order_stats(vals: DataFrame, group_cols: list[str], wanted: dict[tuple, set[int]],
                        buckets: int = 64, max_rows: int = 1_000_000, accuracy: int = 10000,
                        sizes: dict | None = None) -> dict:
    """Exact values at 0-based ranks per group: {(group key, rank): value}.

    ``vals`` holds the group columns and a non-null double ``v``. The search
    keeps, per group, value ranges (lo, hi] with the count of values at or
    below lo and the wanted ranks inside. A range holding more than
    ``max_rows`` values is split by approximate quantiles next to its wanted
    ranks and replaced by the buckets that hold them (a pass divides it by about
    ``accuracy`` / 6, by ``buckets`` where very many ranks are wanted); a value that holds many rows becomes a range of its own. A small range is finished by sorting its distinct values
    with counts. Only per-range metadata reaches the driver, and no task
    sorts more than ``max_rows`` values of one range. ``sizes`` (rows per
    group) saves the first count pass when known.
    """
    spark = vals.sparkSession
    ungrouped = not group_cols
    if ungrouped:  # a constant key keeps every join an equi-join
        vals = vals.withColumn("_g0", F.lit(0))
        wanted = {(0,): ranks for ranks in wanted.values()}
        sizes = {(0,): n for n in sizes.values()} if sizes else None
    g = list(group_cols) or ["_g0"]
    pre = ", ".join(f"`{c}` {_sql_type(vals, c)}" for c in g) + ", "
    if sizes is None:
        sizes = {tuple(r[c] for c in g): r["n"]
                 for r in vals.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).collect()}
    # range: rid -> [key, lo, hi, offset, n_in_range, ranks]
    ranges = {i: [k, None, None, 0, sizes.get(k, 0), sorted(r for r in rs if 0 <= r < sizes.get(k, 0))]
              for i, (k, rs) in enumerate(wanted.items())}
    ranges = {i: v for i, v in ranges.items() if v[5]}
    out: dict = {}

    def restrict(sel: dict) -> DataFrame:
        rows = [(*v[0], rid, v[1], v[2]) for rid, v in sel.items()]
        tab = spark.createDataFrame(rows, pre + "_rid INT, _lo DOUBLE, _hi DOUBLE")
        return vals.join(F.broadcast(tab), g, "inner").filter(
            (F.col("_lo").isNull() | (F.col("v") > F.col("_lo")))
            & (F.col("_hi").isNull() | (F.col("v") <= F.col("_hi"))))

    while ranges:
        small = {rid: v for rid, v in ranges.items() if v[4] <= max_rows}
        large = {rid: v for rid, v in ranges.items() if v[4] > max_rows}
        nxt, rid_next = {}, max(ranges) + 1
        if large:
            rng = restrict(large)
            qs = rank_probs(list(large.values()), accuracy, buckets)
            meta = {r["_rid"]: r["e"] for r in
                    rng.groupBy("_rid").agg(F.percentile_approx("v", qs, accuracy).alias("e")).collect()}
            edges = {}
            for rid, (k, lo, hi, off, n, rs) in large.items():
                found = {float(x) for x in (meta.get(rid) or []) if x is not None}
                # A value that holds many rows may be the only edge. Cutting just below it as
                # well parts its rows from the smaller values, and a range of one value is done.
                cuts = found | {math.nextafter(x, -math.inf) for x in found}
                edges[rid] = sorted(x for x in cuts if (lo is None or x > lo) and (hi is None or x < hi))
                if not edges[rid] and hi is not None and lo == math.nextafter(hi, -math.inf):
                    del edges[rid]
                    for r in rs:
                        out[(k, r)] = hi
            if edges:
                etab = spark.createDataFrame(list(edges.items()), "_rid INT, _edges ARRAY<DOUBLE>")
                b = rng.join(F.broadcast(etab), "_rid").withColumn(
                    "_bkt", F.size(F.filter("_edges", lambda x: x < F.col("v"))))
                counts: dict = {}
                for r_ in b.groupBy("_rid", "_bkt").agg(F.count(F.lit(1)).alias("c")).collect():
                    counts.setdefault(r_["_rid"], []).append((r_["_bkt"], r_["c"]))
                for rid, e in edges.items():
                    k, lo, hi, off, n, rs = large[rid]
                    acc = off
                    for bkt, c in sorted(counts.get(rid, [])):
                        inside = [r for r in rs if acc <= r < acc + c]
                        low, high = lo if bkt == 0 else e[bkt - 1], hi if bkt == len(e) else e[bkt]
                        if inside and low is not None and high is not None and low == math.nextafter(high, -math.inf):
                            out.update({(k, r): high for r in inside})  # the range holds one value
                        elif inside:
                            nxt[rid_next] = [k, low, high, acc, c, inside]
                            rid_next += 1
                        acc += c
        if small:
            sub = restrict(small)
            dv = sub.groupBy("_rid", "v").agg(F.count(F.lit(1)).alias("c"))
            w = Window.partitionBy("_rid").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            cum = dv.withColumn("hi_", F.sum("c").over(w)).withColumn("lo_", F.col("hi_") - F.col("c") + 1)
            want = spark.createDataFrame([(rid, r - v[3] + 1, r) for rid, v in small.items() for r in v[5]],
                                         "_rid INT, _local BIGINT, _rank BIGINT")
            hits = cum.join(F.broadcast(want), "_rid").filter(
                (F.col("lo_") <= F.col("_local")) & (F.col("hi_") >= F.col("_local"))) \
                .select("_rid", "_rank", "v").collect()
            for h in hits:
                out[(small[h["_rid"]][0], h["_rank"])] = h["v"]
        ranges = nxt
    if ungrouped:
        return {((), r): v for (_, r), v in out.items()}
    return out


def _lerp(a: float, b: float, t: float) -> float:
    """numpy's linear interpolation between neighbours."""
    return a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)


def exact_order_stats(df: DataFrame, col: str, ranks: list[int], buckets: int = 64,
                      max_rows: int = 1_000_000) -> dict[int, float]:
    """Exact values at 0-based ``ranks`` of the non-null values of ``col``."""
    vals = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    got = grouped_order_stats(vals, [], {(): set(ranks)}, buckets, max_rows)
    return {r: got[((), r)] for r in ranks if ((), r) in got}


def exact_quantiles(df: DataFrame, col: str, probs: list[float], buckets: int = 64) -> tuple[int, list[float | None]]:
    """numpy-style linear-interpolation quantiles, exact. Returns (n, values)."""
    df = written(df.select(col).filter(F.col(col).isNotNull()))
    n = df.count()
    if n == 0:
        return 0, [None for _ in probs]
    pos = [((n - 1) * p, math.floor((n - 1) * p), math.ceil((n - 1) * p)) for p in probs]
    stats = exact_order_stats(df, col, sorted({x for _, lo, hi in pos for x in (lo, hi)}), buckets)
    return n, [stats[lo] if hi == lo else _lerp(stats[lo], stats[hi], h - lo) for h, lo, hi in pos]


def counted_quantiles(counts: DataFrame, group_cols: list[str], value_col: str, n_col: str, probs: list[float]) -> DataFrame:
    """(group cols, _edges): exact numpy-linear quantiles per group of values that stand
    for ``n_col`` rows each, in the order of ``probs``. Running totals over the distinct
    values say which value holds a rank; nothing is collected."""
    v = F.col(value_col)
    own = counts.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*group_cols, v.cast("double").alias("_v")).agg(F.sum(n_col).alias("_c"))
    whole = own.groupBy(*group_cols).agg(F.sum("_c").alias("_all"))
    cum = running_totals(own, group_cols, "_v", ["_c"]).join(F.broadcast(whole), group_cols)
    rank = [(F.col("_all") - 1) * F.lit(float(p)) for p in probs]
    at = lambda r: F.max(F.when((F.col("cum__c") - F.col("_c") <= r) & (r < F.col("cum__c")), F.col("_v")))
    found = cum.groupBy(*group_cols, "_all").agg(*[at(F.floor(h)).alias(f"_a{i}") for i, h in enumerate(rank)],
                                                 *[at(F.ceil(h)).alias(f"_b{i}") for i, h in enumerate(rank)])

    def between(i: int, h: Column) -> Column:
        a, b, t = F.col(f"_a{i}"), F.col(f"_b{i}"), h - F.floor(h)
        return F.when(t == 0.0, a).when(t < 0.5, a + (b - a) * t).otherwise(b - (b - a) * (1 - t))
    return found.select(*group_cols, F.array(*[between(i, h) for i, h in enumerate(rank)]).alias("_edges"))


def grouped_medians(df: DataFrame, group_cols: list[str], features: list[str], accuracy: int = 1000) -> DataFrame:
    """(group cols, feature, value): the exact numpy-linear median of each feature per
    group (a bounded number of groups), null and NaN skipped. One aggregate over the wide
    rows finds approximate quantiles on both sides of each median, a second one counts the
    values below and between them, and only those between are told apart by feature."""
    g = list(group_cols)
    spark = df.sparkSession
    ddl = "".join(f"`{c}` {_sql_type(df, c)}, " for c in g)
    wide = df.select(*g, *[F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f"_v{i}")
                           for i, f in enumerate(features)])
    near = [0.5 - 3 / accuracy, 0.5 + 3 / accuracy]
    sizes, ends = {}, {}
    for r in wide.groupBy(*g).agg(*[F.count(f"_v{i}").alias(f"n{i}") for i in range(len(features))],
                                  *[F.percentile_approx(f"_v{i}", near, accuracy).alias(f"e{i}") for i in range(len(features))]).collect():
        key = tuple(r[c] for c in g)
        for i, f in enumerate(features):
            if r[f"n{i}"]:
                sizes[*key, f], ends[*key, f] = r[f"n{i}"], r[f"e{i}"]
    keys = list(dict.fromkeys(k[:-1] for k in ends))
    if not keys:
        return spark.createDataFrame([], ddl + "feature STRING, value DOUBLE")

    def with_ends(of) -> DataFrame:
        side = lambda k, s: [ends[*k, f][s] if (*k, f) in of else None for f in features]
        edges = spark.createDataFrame([(*k, side(k, 0), side(k, 1)) for k in keys], ddl + "_lo ARRAY<DOUBLE>, _hi ARRAY<DOUBLE>")
        return wide.join(F.broadcast(edges), g)

    inside = [F.col(f"_v{i}").between(F.col("_lo")[i], F.col("_hi")[i]) for i in range(len(features))]
    got, ranks, counts, rest = {}, {}, {}, set()
    for r in with_ends(ends).groupBy(*g).agg(*[F.count_if(F.col(f"_v{i}") < F.col("_lo")[i]).alias(f"b{i}") for i in range(len(features))],
                                             *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(inside)]).collect():
        for i, f in enumerate(features):
            k = (*(r[c] for c in g), f)
            if k not in ends:
                continue
            below, n, mid = r[f"b{i}"], r[f"c{i}"], (sizes[k] - 1) / 2
            own = {math.floor(mid), math.ceil(mid)}
            if not all(below <= x < below + n for x in own):
                rest.add(k)
            elif ends[k][0] == ends[k][1]:
                got[k] = float(ends[k][0])
            else:
                ranks[k], counts[k] = {x - below for x in own}, n

    def long(df: DataFrame, cells: list) -> DataFrame:
        stacked = F.array(*[F.struct(F.lit(f).alias("feature"), c.alias("v")) for f, c in zip(features, cells)])
        return df.select(*g, F.explode(F.filter(stacked, lambda s: s["v"].isNotNull())).alias("s")).select(*g, "s.feature", "s.v")

    if ranks:
        # most rows lie between no ends and are left out before they are stacked
        close = with_ends(ranks).filter(reduce(or_, inside))
        found = grouped_order_stats(long(close, [F.when(c, F.col(f"_v{i}")) for i, c in enumerate(inside)]), [*g, "feature"],
                                    ranks, sizes=counts)
        for k, own in ranks.items():
            a, b = found[k, min(own)], found[k, max(own)]
            got[k] = float(a if a == b else _lerp(a, b, 0.5))
    if rest:
        for r in grouped_quantiles(long(wide, [F.col(f"_v{i}") for i in range(len(features))]), [*g, "feature"], "v", [0.5]).collect():
            k = (*(r[c] for c in g), r["feature"])
            if k in rest:
                got[k] = r["value"]
    return spark.createDataFrame([(*k, v) for k, v in got.items()], ddl + "feature STRING, value DOUBLE")


def grouped_quantiles(long: DataFrame, group_cols: list[str], value_col: str, probs: list[float],
                      buckets: int = 64, max_rows: int = 1_000_000) -> DataFrame:
    """Exact numpy-linear quantiles of ``value_col`` per group (a bounded
    number of groups: features x outcomes, features x folds). Returns
    (group cols, prob, value)."""
    g = list(group_cols)
    spark = long.sparkSession
    vals = long.select(*g, F.col(value_col).cast("double").alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan(F.col("v")))
    key_ddl = ", ".join(f"`{c}` {_sql_type(long, c)}" for c in g)
    out_schema = (key_ddl + ", " if g else "") + "prob DOUBLE, value DOUBLE"
    sizes = {tuple(r[c] for c in g): r["n"] for r in vals.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], out_schema)
    wanted = {k: {x for p in probs for x in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}
              for k, n in sizes.items()}
    got = grouped_order_stats(vals, g, wanted, buckets, max_rows, sizes=sizes)
    rows = []
    for k, n in sizes.items():
        for p in probs:
            h = (n - 1) * p
            lo, hi = math.floor(h), math.ceil(h)
            a, b = got[(k, lo)], got[(k, hi)]
            rows.append((*k, float(p), float(a if hi == lo else _lerp(a, b, h - lo))))
    return spark.createDataFrame(rows, out_schema)
