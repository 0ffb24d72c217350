import hashlib
import zlib

import duckdb
import pytest
from leakscope.llm import merkle
from leakscope.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F

from .helpers import DIR, edge, order

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_hash(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests):
    """All levels, by the plain definition."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        run = range(i - i % 3, min(i - i % 3 + 3, len(level)))
        out.append(([level[k] for k in run if k < i], [level[k] for k in run if k > i]))
        i //= 3
    return out


def plain(rows):
    """The query's rows, as lists of values, from rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (order(r[0]), row_hash(r)))
        trees[s] = plain_tree([row_hash(r) for r in groups[s]])
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = plain_path(trees[s], i) + plain_path(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = row_hash([*r[:4], r[4].replace("\n", "")]) if hit and r[4] is not None else row_hash(r)
            for before, after in path:
                node = h(*before, node, *after)
            out.append([r[0], row_hash(r), trees[s][-1][0], top[-1][0], h(*(x for b, a in path for x in b + a)), node, node == top[-1][0]])
    return out


def rows_of(df):
    return [tuple(r) for r in df.select(*merkle.FIELDS).collect()]


@pytest.mark.parametrize("n", [*range(1, 31), 80, 81, 82, 100])
def test_positions_are_those_of_the_append_log(n):
    levels = plain_tree([f"{i:064x}" for i in range(n)])
    log = merkle.append([d.encode() for d in levels[0]], merkle.height(n)).decode()
    assert merkle.height(n) == len(levels) - 1 and len(log) == 64 * sum(map(len, levels))
    for k, level in enumerate(levels):
        for i, d in enumerate(level):
            at = 64 * merkle.position(k, i, n)
            assert log[at:at + 64] == d
    for i in range(n):
        proof = merkle.siblings(log.encode(), i, n, len(levels) - 1)
        assert merkle.fold(levels[0][i].encode(), i, n, proof) == (levels[-1][0].encode(), b"")
        assert n == 1 or merkle.fold(b"0" * 64, i, n, proof)[0] != levels[-1][0].encode() or i == 0


def test_query_equals_the_definition_and_the_statement(spark):
    got = QUERIES["op12_merkle_manifest"](spark, DIR)
    assert got.columns == COLUMNS
    rows = sorted(map(list, got.collect()))
    assert rows == sorted(plain(rows_of(spark.read.parquet(f"{DIR}/documents.parquet"))))
    assert {r[-1] for r in rows} == {True, False}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{DIR}/documents.parquet'")
    assert sorted(map(list, con.sql(SQL["op12_merkle_manifest"]).fetchall())) == rows


def checked(df):
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
                 merkle.row_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.replace("text", F.lit("\n"), F.lit(""))]))
    out = merkle.verify(merkle.manifest(df, claim=cut))
    return [[r["doc_id"], r["leaf"], r["subroot"], r["root"], h(r["proof"]), r["folded_root"], r["verified"]] for r in out.collect()]


def by_key(rows):
    return sorted(rows, key=lambda r: (order(r[0]), r[1:]))


def test_edge_rows_nulls_repeats_and_clashing_columns(spark):
    df = edge(spark).withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).withColumn("tree", F.lit("x")).withColumn("nth", F.lit(1))
    df = df.union(df).union(df.withColumn("source", F.lit("é")).withColumn("doc_id", F.lit(None).cast("long")))
    assert by_key(checked(df)) == by_key(plain(rows_of(df)))


def test_many_rounds_in_groups_and_above_them(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BUILDER", 3)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 250, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"),
                                 F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.concat(F.lit("a\n"), F.col("id")).alias("text"))
    assert by_key(checked(df)) == by_key(plain(rows_of(df)))
    m = merkle.manifest(df)
    assert len(m.rounds) == 6 and len(m.top) == 4
    log = merkle.append_log(m.rounds, m.leaves.select("tree", "n").distinct()).where("tree = '1hot'").orderBy("position").collect()
    whole = merkle.append([bytes(r["digest"]) for r in m.leaves.where("tree = '1hot'").orderBy("nth").collect()], merkle.height(250)).decode()
    assert [r["position"] for r in log] == list(range(len(log))) and "".join(r["digest"] for r in log) == whole


def test_empty_table(spark):
    df = edge(spark).withColumn("n_chars", F.lit(1)).where(F.lit(False))
    out = merkle.verify(merkle.manifest(df))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"] and out.count() == 0
