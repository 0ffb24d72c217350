import hashlib
import random

import numpy as np
import pytest
from leakscope.llm.line_dedup import remove_repeated_lines
from leakscope.llm.queries import QUERIES
from leakscope.llm.repeats import leftmost_least
from leakscope.llm.substring_dedup import remove_repeated_substrings

from .helpers import DIR, edge, order, real, repeated, texts, words


def lines(text):
    return [x for x in (y.strip(" \t\n\r\x0b\x0c") for y in (text or "").split("\n")) if x]


def check_words(df, size, gram):
    rows = texts(df)
    want = repeated(rows, words, size)
    got = remove_repeated_substrings(df, size, gram)
    assert got.columns == [c for c in df.columns if c not in ("n_words",)] + ["kept_text", "n_words", "n_removed"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        w, gone = words(r["text"]), want[r["doc_id"], r["text"]]
        assert (r["n_words"], r["n_removed"]) == (len(w), sum(gone))
        assert r["kept_text"] == " ".join(x for x, g in zip(w, gone) if not g)


def test_substring_dedup_equals_the_definition_on_real_texts(spark):
    check_words(real(spark), 20, 4)


def test_substring_dedup_query(spark):
    df = real(spark)
    want = repeated(texts(df), words, 20)
    got = {r["doc_id"]: r for r in QUERIES["op5_substring_dedup"](spark, DIR).collect()}
    for (i, t), gone in want.items():
        kept = " ".join(x for x, g in zip(words(t), gone) if not g)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert len(got) == len(want)


def test_substring_dedup_edge_rows(spark):
    check_words(edge(spark), 4, 2)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup_on_few_different_words(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(30)]
    check_words(spark.createDataFrame(rows, "doc_id long, text string"), 6, 2)


def test_later_copies_of_a_passage_lose_it_and_the_first_keeps_it(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, f"u{i}a u{i}b {passage} u{i}c") for i in range(40)]
    got = {r["doc_id"]: r for r in remove_repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0
    assert all(got[i]["kept_text"] == f"u{i}a u{i}b u{i}c" for i in range(1, 40))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_substrings(df).count() == 0
    assert remove_repeated_lines(df).count() == 0


def repeated_runs(rows, fits, longest):
    """{(doc_id, text): [is the line in a qualifying run that starts earlier too]}
    by the plain definition, over all runs of up to ``longest`` lines."""
    seqs = {(i, t): lines(t) for i, t in rows}
    runs = {}
    for (i, t), u in seqs.items():
        for a in range(len(u)):
            for b in range(a + 1, min(len(u), a + longest) + 1):
                if fits(u[a:b]):
                    runs.setdefault(tuple(u[a:b]), []).append((order(i), a, (i, t)))
    out = {k: [False] * len(u) for k, u in seqs.items()}
    for run, found in runs.items():
        first = min(x[:2] for x in found)
        for doc, a, key in found:
            if (doc, a) > first:
                out[key][a:a + len(run)] = [True] * len(run)
    return out


def check_lines(df, min_lines, min_words, long_words=50, longest=55):
    rows = texts(df)

    def fits(run):
        n = sum(len(words(x)) for x in run)
        return n >= long_words or (len(run) >= min_lines and n >= min_words)

    want = repeated_runs(rows, fits, longest)
    out = remove_repeated_lines(df, min_lines, min_words, long_words).collect()
    assert len(out) == len(rows)
    for r in out:
        gone = want[r["doc_id"], r["text"]]
        assert (r["n_lines"], r["n_lines_removed"]) == (len(gone), sum(gone))
        kept = [x for x, g in zip(lines(r["text"]), gone) if not g]
        assert lines(r["kept_text"]) == kept
        if not any(gone):
            assert r["kept_text"] == (r["text"] or "")


def test_line_dedup_equals_the_definition(spark):
    check_lines(real(spark), 3, 10)
    check_lines(edge(spark), 2, 1)


def test_line_dedup_on_few_different_lines(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b b", "c c c", " ", "d"]) for _ in range(rng.randrange(30)))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_lines(df, 3, 4)
    check_lines(df, 3, 7, 6)
    check_lines(df, 2, 5, 1)
    check_lines(df, 30, 1, 8)


@pytest.mark.parametrize("parts", [[80], [26, 25], [55, 2], [2, 55], [3, 2, 46]])
def test_a_long_passage_goes_however_many_lines_it_has(spark, parts):
    passage = "\n".join(" ".join(f"p{n}_{i}" for i in range(m)) for n, m in enumerate(parts))
    rows = [(i, passage if i == 3 else f"u{i}a u{i}b\n{passage}\nu{i}c") for i in range(6)]
    got = {r["doc_id"]: r for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_lines_removed"] == 0
    assert all(got[i]["kept_text"] == f"u{i}a u{i}b\nu{i}c" for i in (1, 2, 4, 5))
    assert got[3]["kept_text"] == "" and got[3]["n_lines_removed"] == len(parts)


def test_a_short_line_alone_stays(spark):
    line = " ".join(f"w{i}" for i in range(49))
    rows = [(i, f"a{i}\n{line}\nb{i}") for i in range(4)]
    got = remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_lines_removed"] == 0 for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_least_of_each_range(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, 200)
    start = np.sort(rng.integers(0, 150, 120))
    stop = np.maximum.accumulate(start + rng.integers(1, 50, 120))
    want = [a + int(np.argmin(x[a:b])) for a, b in zip(start, stop)]
    assert leftmost_least(x, start, stop).tolist() == want


@pytest.mark.parametrize("ident", [None, 7])
def test_rows_without_an_id_of_their_own_are_documents_of_their_own(spark, ident):
    passage = [f"p{i}" for i in range(25)]
    own = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    # Two hold the passage at one position; the third repeats its own start.
    texts_ = [passage + own[0], passage + own[1], own[2][:25] + ["x"] + own[2][:25] + own[2][25:]]
    rows = [(ident, " ".join(t)) for t in texts_]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["text"]: r for r in remove_repeated_substrings(df).collect()}
    assert sorted(got[rows[i][1]]["n_removed"] for i in (0, 1)) == [0, 25]
    assert all(got[" ".join(passage + own[i])]["kept_text"].endswith(" ".join(own[i])) for i in (0, 1))
    assert got[rows[2][1]]["kept_text"] == " ".join(own[2][:25] + ["x"] + own[2][25:])
    by_line = spark.createDataFrame([(i, t.replace(" ", "\n")) for i, t in rows], "doc_id long, text string")
    assert sorted(r["n_lines_removed"] for r in remove_repeated_lines(by_line, 3, 3).collect()) == [0, 25, 25]


def test_one_key_over_many_tasks_keeps_its_first(spark):
    rng = random.Random(9)
    common = "the very common line"
    rows = [(i, "\n".join([f"u{i}", *(rng.choice([common, "x y z", f"own {i % 7}"]) for _ in range(8))])) for i in range(120)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    check_lines(df, 2, 5, 8)
    check_words(df, 5, 2)
