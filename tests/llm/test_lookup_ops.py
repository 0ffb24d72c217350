import random

import pytest
from leakscope.llm import decontaminate, token_count
from leakscope.llm.queries import QUERIES
from pyspark.sql import functions as F

from .helpers import DIR, EDGE, edge, real, texts


def test_token_counts_query_equals_the_library(spark):
    model = token_count.load(token_count.model_path())
    want = {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in texts(real(spark))}
    got = QUERIES["op6_token_counts"](spark, DIR).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)


def test_token_counts_edge_rows(spark):
    model = token_count.load(token_count.model_path())
    odd = ["  a  b \n\n c▁▁d \r\n<s> </s> <0x0A> <unk>", "日本語 テスト　x y", " ", "\n", "x" * 5000, " " * 300 + "e",
           "a\n" * 1000, "\ta\t\tb", "▁", "\n\n\n   \n  x", "é" * 3000, "😀 😀\n😀"]
    df = edge(spark).select("doc_id", "text").union(spark.createDataFrame(enumerate(odd), "doc_id long, text string"))
    got = token_count.count_tokens(df.withColumn("n_tokens", F.lit("clash")).withColumn("__tokens", F.lit(1)))
    assert got.columns == ["doc_id", "text", "__tokens", "n_bytes", "n_tokens"]
    assert [r["n_tokens"] for r in got.collect()] == [len(model.encode(r["text"] or "")) for r in got.collect()]
    assert got.where(F.lit(False)).count() == 0
    assert token_count.count_tokens(df.where("doc_id = 9000001")).first()["n_tokens"] == 0


def test_token_counts_do_not_depend_on_the_table(spark):
    df = real(spark)
    small = token_count.count_tokens(df, table_size=10, sample_docs=5)
    full = token_count.count_tokens(df)
    assert small.select("doc_id", "n_tokens").exceptAll(full.select("doc_id", "n_tokens")).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_smith_waterman_equals_the_plain_recurrence(seed):
    import numpy as np
    rng = random.Random(seed)
    for _ in range(50):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (1 if x == y else -0.5), h[i][j + 1] - 0.5, h[i + 1][j] - 0.5)
        assert decontaminate.smith_waterman(np.array(a), np.array(b))[0] == max(map(max, h))


def plain_score(item, text):
    """Best alignment over the whole text."""
    import numpy as np
    a, b = decontaminate.words_of(item), decontaminate.words_of(text)
    number = {w: i for i, w in enumerate(dict.fromkeys(a))}
    best, _ = decontaminate.smith_waterman(np.array([number[w] for w in a]), np.array([number.get(w, -1) for w in b], int))
    return best / len(a)


def test_decontamination_query_finds_what_whole_alignment_finds(spark):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    docs = dict(texts(real(spark)))
    want = {(d, i) for d, t in docs.items() for i, x in items.items()
            if len(decontaminate.words_of(x)) >= 5 and plain_score(x, t) >= 0.7 - 1e-9}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontamination"](spark, DIR).collect()}
    assert got == want


def leaky(spark):
    rng = random.Random(2)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items, docs, want = [], [], set()
    for i in range(12):
        words = say(30) if i else ["the", "of", "and", "to", "in", "a"] * 5
        items.append((i, " ".join(words)))
        edited = list(words)
        edited[3], edited[9], edited[15] = "changed", "also", "here"
        edited[27:27] = ["put", "in"]
        del edited[22]
        for k, (copy, leaks) in enumerate((([*words], True), (edited, True), (words[:12], False))):
            doc = 100 * i + k
            docs.append((doc, " ".join(say(200) + copy + say(150)).replace(" ", ", ", 3).title()))
            if leaks and i:
                want.add((doc, i))
    return spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), want


def test_edited_copies_are_found_and_part_copies_are_not(spark):
    items, docs, want = leaky(spark)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(docs, items).collect()}
    assert {x for x in got if x[1]} == want


def test_an_item_leaked_often_keeps_its_seeds_and_a_common_phrase_is_none(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(i, f"x{i} {passage} y{i}") for i in range(300)] + [(1000 + i, "in the middle of the night") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (2, "in the middle of the " + " ".join(f"q{i}" for i in range(40)))], "item_id long, text string")
    got = decontaminate.find_contamination(df, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, 1) for i in range(300)}


def test_an_exact_copy_is_found_beside_many_edited_ones(spark):
    words = [f"w{i}" for i in range(38)]
    edited = [f"x{i}" if i % 6 == 5 else w for i, w in enumerate(words)]
    docs = [(0, "before " + " ".join(words) + " after")] + [(i, f"b{i} " + " ".join(edited) + f" a{i}") for i in range(1, 41)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontaminate.find_contamination(df, items).collect()}
    assert got == {i: pytest.approx(plain_score(" ".join(words), t)) for i, t in docs}


@pytest.mark.parametrize("kind", ["changed", "inserted", "dropped"])
def test_evenly_edited_copies_are_found_like_by_whole_alignment(spark, kind):
    items, docs = [], []
    for m in (5, 6, 10, 20, 38, 60):
        words = [f"w{m}x{i}" for i in range(m)]
        items.append((m, " ".join(words)))
        for every in range(1, 12):
            edits = {"changed": lambda i, w: ["new"], "inserted": lambda i, w: [w, "new"], "dropped": lambda i, w: []}[kind]
            copy = [x for i, w in enumerate(words) for x in (edits(i, w) if i % every == every - 1 else [w])]
            docs.append((100 * m + every, " ".join(["left"] * 50 + copy + ["right"] * 50)))
    want = {(d, m) for d, t in docs for m, x in items if plain_score(x, t) >= 0.7 - 1e-9}
    assert {m for _, m in want} == {m for m, _ in items}
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                           spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_decontamination_edge_rows(spark):
    df = edge(spark)
    items = spark.createDataFrame([(1, EDGE[0][1]), (2, EDGE[0][1].upper()), (3, None), (4, ""), (5, "one"), (None, "a null id its text three")],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(df, items).collect()}
    assert got == {(None, 1), (None, 2), (None, None)}
    left = decontaminate.without_contaminated(df, items)
    assert left.columns == df.columns and left.count() == df.count() - 1
    assert decontaminate.find_contamination(df.where(F.lit(False)), items).count() == 0
    assert decontaminate.find_contamination(df, items.where(F.lit(False))).count() == 0


def test_only_contaminated_rows_of_an_id_go(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, f"x {item} y"), (None, "clean text without an id"), (7, f"z {item}"), (7, "other clean text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(texts(decontaminate.without_contaminated(df, items)), key=str) == sorted([rows[1], rows[3]], key=str)
    assert sorted(map(str, (r["doc_id"] for r in decontaminate.find_contamination(df, items).collect()))) == ["7", "None"]
