import random

import xxhash
from leakscope.llm import mixing, simhash
from leakscope.llm.common import connected_components
from leakscope.llm.queries import QUERIES
from pyspark.sql import functions as F

from .helpers import DIR, edge, real, texts, words


def brute_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    pieces = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    count = [0] * 64
    for p in pieces:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(pieces))


def components(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def check(rows, got):
    low = -(1 << 63)
    prints = [(low if i is None else i, brute_fingerprint(t)) for i, t in rows]
    by_id = {}
    for i, f in prints:
        by_id.setdefault(i, set()).add(f)
    comp = components(by_id, lambda a, b: any((x ^ y).bit_count() <= 2 for x in by_id[a] for y in by_id[b]))
    back = lambda i: None if i == low else i
    want = sorted((str(back(i)), f"{f:016x}", str(back(comp[i]))) for i, f in prints)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_query_equals_brute_force(spark):
    check(texts(real(spark)), QUERIES["op2_simhash_near_dedup"](spark, DIR).collect())


def test_edge_rows(spark):
    check(texts(edge(spark)), simhash.near_duplicates(edge(spark)).collect())


def test_large_buckets_descend_and_lose_no_link(spark):
    rng = random.Random(1)
    prints = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for b in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << b
            prints.add(x)
    ids = rng.sample(range(10_000), len(prints))
    by_id = dict(zip(ids, prints))
    want = components(ids, lambda a, b: (by_id[a] ^ by_id[b]).bit_count() <= 2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f), i) for i, f in by_id.items()], "fp long, id long")
    for block in (2048, 3):
        found = simhash.links(df, block=block)
        assert all((by_id[r["a"]] ^ by_id[r["b"]]).bit_count() <= 2 or want[r["a"]] == want[r["b"]] for r in found.collect())
        got = {r["id"]: r["component"] for r in connected_components(found).collect()}
        assert {i: got.get(i, i) for i in ids} == want


def test_one_document_of_each_group_stays(spark):
    df = edge(spark)
    kept = simhash.one_per_group(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(9_000_006) == 1 and 9_000_007 not in ids and None in ids
    assert 9_000_001 in ids and 9_000_002 not in ids  # null and empty texts are one group


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * level >= most * sizes[s]]
        if not over:
            return {**full, **{s: w[s] * level for s in rest}}
        full.update({s: float(most * sizes[s]) for s in over})


def test_mixing_query(spark):
    df = real(spark)
    size = {r["doc_id"]: len(words(r["text"])) for r in df.collect()}
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    total = {}
    for i, n in size.items():
        total[source[i]] = total.get(source[i], 0) + n
    want = brute_targets(total)
    got = QUERIES["op3_mixing"](spark, DIR).collect()
    assert len(got) == len(size)
    taken = {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():  # lined up by size, a source misses by about its largest documents
        largest = max(v for i, v in size.items() if source[i] == s)
        assert abs(n - want[s]) <= 2 * largest
    assert sorted(got) == sorted(QUERIES["op3_mixing"](spark, DIR).collect())


def test_mixing_reshares_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300, "d": 0}
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())],
                               "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in mixing.mix(df).collect()}
    want = brute_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-9 for s in sizes) and abs(sum(got.values()) - 1315) < 1e-6


def test_mixing_edge_rows(spark):
    df = edge(spark)
    got = mixing.mix(df).collect()
    assert len(got) == df.count() and all(r["taken"] == 0 for r in got if not r["size"])
    out = mixing.take(df)
    assert out.columns == [c for c in df.columns if c != "copy"] + ["copy"]
    assert out.count() == sum(r["copies"] for r in got)
    assert out.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    empty = df.where(F.lit(False))
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0
    none = df.where("doc_id in (9000001, 9000002)")
    assert [r["taken"] for r in mixing.mix(none).collect()] == [0, 0]


def test_rows_without_an_id_of_their_own_keep_their_texts(spark):
    say = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(i, say(f"{c}{i}"), "s") for i in (None, 7) for c in "ab"] + [(8, say("a7"), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(texts(simhash.one_per_group(df)), key=str)
    assert kept == sorted([(i, t) for i, t, _ in rows[:4]], key=str)
    got = {r["fingerprint"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert len(got) == 4 and sorted(map(str, got.values())) == ["7", "7", "None", "None"]
    out = mixing.take(df, weights=(1,)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted([(i, t) for i, t, _ in rows], key=str)
    assert all(r["copy"] == 1 for r in out)


def test_buckets_of_unrelated_clusters_do_not_meet_and_the_descent_ends(spark, monkeypatch):
    """Many large clusters share each path: a bucket must not hold members of several, at any level."""
    import numpy as np
    rng = np.random.default_rng(3)
    centres = rng.integers(-(1 << 62), 1 << 62, 12)
    flips = np.array([0, *(1 << b for b in range(8)), *((1 << b) ^ (1 << (b + 1)) for b in range(8))], np.int64)
    fps = np.unique((centres[:, None] ^ flips[None, :]).ravel())
    levels = []
    real_index = simhash.index
    monkeypatch.setattr(simhash, "index", lambda level, bits: levels.append(level) or real_index(level, bits))
    df = spark.createDataFrame([(int(x), int(x)) for x in fps], "fp long, id long")
    found = {(r["a"], r["b"]) for r in simhash.links(df, block=4).collect()}
    assert max(levels) <= 6
    parent = {int(x): int(x) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in found:  # each to the smallest of its linked set, so not all within two bits
        parent[root(a)] = root(b)
    groups = {}
    for x in parent:
        groups.setdefault(root(x), set()).add(x)
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= 2
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (low == label).all():
            break
        label = low
    want = {}
    for x, k in zip(fps.tolist(), label):
        want.setdefault(int(k), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_of_an_empty_table(spark):
    assert simhash.near_duplicates(edge(spark).where(F.lit(False))).count() == 0


def test_a_row_that_comes_very_often_is_taken_in_parts(spark, monkeypatch):
    rows = [(7, "same words here", "a")] * 300 + [(i, f"word {i}", "a") for i in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = sorted(map(tuple, mixing.take(df).collect()))
    monkeypatch.setattr(mixing, "PART", 7)
    assert sorted(map(tuple, mixing.take(df).collect())) == whole
    dealt = {r["doc_id"]: r["n"] for r in mixing.mix(df).groupBy("doc_id").agg({"copies": "sum"}).toDF("doc_id", "n").collect()}
    copies = [r[3] for r in whole if r[0] == 7]
    assert copies == list(range(1, dealt[7] + 1)) and len(whole) == sum(dealt.values())
