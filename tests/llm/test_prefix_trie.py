import hashlib
import random
import zlib

import duckdb
import pytest
from leakscope.llm import prefix_trie as T
from leakscope.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F

from .helpers import DIR

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth long, a int"


def plain(rows):
    """By the definition, from rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - int(c - 100 * int(c / 100)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append((c, len(turns)))
    total = {}
    for k in sorted(members, key=len, reverse=True):
        leaves, saved, kids = total.get(k, [0, 0, 0])
        mine = [leaves or 1, saved + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0), kids]
        total[k] = mine
        if k:
            up = total.setdefault(k[:-1], [0, 0, 0])
            up[0], up[1], up[2] = up[0] + mine[0], up[1] + mine[1], up[2] + 1
    return sorted((min(members[k])[0], len(k), min(members[k[:-1]])[0] if k else None, len(members[k]), total[k][2], total[k][0], total[k][1],
                   hashlib.sha256(",".join(str(c) for c, n in sorted(members[k]) if n == len(k)).encode()).hexdigest()) for k in members)


def made(df, **options):
    return sorted(map(tuple, T.prefix_trie(df, **options).select(*COLUMNS).collect()))


def test_query_equals_the_definition_and_the_statement(spark):
    df = spark.read.parquet(f"{DIR}/conversations.parquet")
    got = QUERIES["op13_prefix_trie"](spark, DIR)
    assert got.columns == COLUMNS
    rows = sorted(map(tuple, got.collect()))
    assert rows == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{DIR}/conversations.parquet'")
    assert sorted(con.sql(SQL["op13_prefix_trie"]).fetchall()) == rows


def random_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 450), n):
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "ccc", "", None]), 5, 6))
    return rows


@pytest.mark.parametrize("seed, limit", [(1, 1), (2, 3), (3, 10), (4, 40), (5, 100_000)])
def test_shards_of_any_size_give_the_same(spark, seed, limit):
    rows = random_rows(seed)
    assert made(spark.createDataFrame(rows, SCHEMA), limit=limit) == plain([r[:4] for r in rows])


def test_copies_a_long_conversation_and_many_children(spark, monkeypatch):
    monkeypatch.setattr(T, "BAND", 16)
    monkeypatch.setattr(T, "CHUNK", 20)
    rows = [(c, t, "user", f"same {t}", 0, 0) for c in range(1000, 1080) for t in range(4)]
    rows += [(7, t, "user", f"same {t}" if t < 4 else f"turn {t % 3}", 0, 0) for t in range(150)]
    rows += [(c, 0, "user", f"first {c}", 0, 0) for c in range(2000, 2090)]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (20, 200):
        assert made(df, limit=limit) == plain([r[:4] for r in rows])


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "left out", 0, 0), (5, None, None, None, 0, 0), (5, None, None, None, 0, 0), (5, 1, "user", "x" * 200_000, 0, 0),
            (105, 2, "a", "b", 0, 0), (105, 2, "a", "b", 0, 0), (105, 2, "ab", "", 0, 0), (9_000_000_000, 1, "user", "日本語 😀", 0, 0), (100, -3, "user", "", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert made(df) == plain([r[:4] for r in rows])
    assert made(df.where(F.lit(False))) == [] and made(df.where("conv_id is null")) == []


def test_queue_spills_and_stays_in_order(monkeypatch):
    rng = random.Random(1)
    queue, out, want = T.SpillingQueue(2, held=10), [], []
    for _ in range(500):
        for _ in range(rng.randrange(4)):
            entry = (rng.randrange(-100, 100), rng.randrange(5))
            queue.push(entry)
            want.append(entry)
        if want and rng.random() < 0.3:
            assert queue.first() == min(want)
            want.remove(queue.pop())
    assert queue.spilled > 3
    while queue.first() is not None:
        out.append(queue.pop())
    assert out == sorted(want)
