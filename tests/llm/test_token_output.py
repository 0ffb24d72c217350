import zlib

import numpy as np
import pytest
from leakscope.llm import token_output
from leakscope.llm.common import shared_folder
from leakscope.llm.queries import QUERIES
from pyspark.sql import functions as F

from .helpers import DIR, edge, order, real, texts


def library(text):
    from tokenizers import Tokenizer
    if not hasattr(library, "model"):
        library.model = Tokenizer.from_file(token_output.model_path())
    return [*library.model.encode(text or "", add_special_tokens=False).ids, 1]


def test_query_equals_the_library(spark):
    want, start = {}, 0
    for i, t in sorted(texts(real(spark))):
        ids = library(t)
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = QUERIES["op11_token_output"](spark, DIR)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want


def round_trip(spark, df):
    path = shared_folder(spark)
    token_output.write_token_files(df, path)
    return token_output.read_token_files(spark, path), path


def test_awkward_texts_and_repeated_ids(spark):
    odd = ["a\x0bb\x0cc\x1cd\x85e\xa0f", "é́ éx ÉÉ", "<|endoftext|> x<|startoftext|>y <|endof text|>", "Σας ΟΔΟΣ İI",
           "don't we'LL 'S 12²³ ½x ªº µ", "日本語テスト 😀😀 ﻿a​b", "x" * 200 + " " + "ſK", "ÀÖ×÷ÿ ß", "\x00\x01 \x7f\x80"]
    df = edge(spark).select("doc_id", "text").union(spark.createDataFrame([(7, t) for t in odd], "doc_id long, text string"))
    df = df.withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1))
    rows = round_trip(spark, df)[0].orderBy("start").collect()
    ids = [np.frombuffer(r["ids"], "<u4").tolist() for r in rows]
    assert sorted((order(r["doc_id"]), i) for r, i in zip(rows, ids)) == sorted((order(d), library(t)) for d, t in texts(df))
    assert [order(r["doc_id"]) for r in rows] == sorted(order(r["doc_id"]) for r in rows)
    assert [r["n_tokens"] for r in rows] == list(map(len, ids))
    assert [r["start"] for r in rows] == [sum(map(len, ids[:k])) for k in range(len(ids))]


def test_empty_table(spark):
    got, _ = round_trip(spark, edge(spark).where(F.lit(False)))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids"] and got.count() == 0


def test_files_are_blocks_of_whole_documents_with_the_commonest_ids_first(spark, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK", 500)
    got, path = round_trip(spark, real(spark))
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    assert len(blocks) > 20 and all(sum(b["lengths"]) == b["n_ids"] and len(b["control"]) == (b["n_ids"] + 3) // 4 for b in blocks)
    vocabulary = [r["id"] for r in spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()]
    ids, n = np.unique(np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got.collect()]), return_counts=True)
    assert vocabulary == [int(i) for _, i in sorted(zip(-n, ids))]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_code_round_trip(n, monkeypatch):
    monkeypatch.setattr(token_output, "CHUNK", 64)
    v = (np.random.default_rng(n).integers(0, 1 << 32, n) >> np.random.default_rng(n + 1).integers(0, 32, n)).astype("<u4")
    control, data = token_output.coded(v)
    assert len(control) == (n + 3) // 4 and len(data) == sum(max(1, (int(x).bit_length() + 7) // 8) for x in v)
    assert (token_output.decoded(control, data, n) == v).all()


def test_cache_of_two_generations_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE", 3)
    made = []
    kept = token_output.Kept(lambda k: made.append(k) or k.upper())
    for k in "abcdabcdabzyxa":
        assert kept[k] == k.upper() and len(kept) <= 3 and len(kept.old) <= 3
    assert kept["k" * 100] == "K" * 100 and "k" * 100 not in kept
    assert len(made) < 14
