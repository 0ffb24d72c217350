"""Token counts by a map-side two-tier lookup.

A text's token count is the sum over its pre-tokens. Tier one is a broadcast
table of the lengths of frequent pre-tokens; tier two encodes what it misses
once per worker and remembers it. No pre-token is shuffled for the counts, and
no text leaves its task.

Exactness. The model's normaliser is the identity, with white space escaped
and one leading space added, and its merges never join a space to what
precedes it nor cross a line end. That is checked against the vocabulary when
the model is loaded; so pre-tokens (spaces with the run that follows, and
single line ends) are encoded independently of each other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
TABLE_SIZE, SAMPLE_DOCS, CACHE = 30_000, 2_000, 200_000
SPACE = "▁"  # how the model writes a space
PRETOKEN = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
LONGEST = 64  # longer pre-tokens are encoded each time and not remembered


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def load(path: str):
    """The model, after a check that pre-tokens are independent."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    crossing = [p for p in pieces if re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p]
    if crossing or model.normalize("a  b\n") != f"{SPACE}a{SPACE}{SPACE}b\n":
        raise ValueError(f"pre-tokens of this model depend on each other: {crossing[:5]}")
    return model


def pretokens(text: str) -> list[str]:
    """Of a text in the model's writing: spaces escaped, one in front."""
    return PRETOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Lengths(dict):
    """pre-token -> number of tokens; misses are encoded, up to ``CACHE`` of them remembered."""

    def __init__(self, model, table: dict):
        super().__init__(table)
        self.model, self.table = model, table

    def __missing__(self, piece: str) -> int:
        n = encoded_length(self.model, piece)
        if len(piece) <= LONGEST:
            if len(self) >= len(self.table) + CACHE:
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n


def encoded_length(model, piece: str) -> int:
    """Tokens of one pre-token. The model adds a space in front itself: a piece
    that begins with one gives it up, any other is told apart by a line end,
    which never merges (its own token and the added space are two)."""
    if piece[0] == SPACE:
        return len(model.encode(piece[1:].replace(SPACE, " "))) if len(piece) > 1 else 1
    return len(model.encode("\n" + piece)) - 2


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text",
                     table_size: int = TABLE_SIZE, sample_docs: int = SAMPLE_DOCS) -> dict:
    """Lengths of the ``table_size`` most frequent pre-tokens of a sample by
    text hash of about ``sample_docs`` documents: both bound the driver's share. The table only
    saves work; counts do not depend on it."""
    n = docs.count()
    share = F.pmod(F.xxhash64(text_col), F.lit(max(1, n // sample_docs)))

    def tokens(batches):
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column(0):
                seen.update(p for p in pretokens(t.as_py() or "") if len(p) <= LONGEST)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])

    top = (docs.where(share == 0).select(text_col).mapInArrow(tokens, "piece string, n long")
           .groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table_size))
    model = load(path)
    return {r["piece"]: encoded_length(model, r["piece"]) for r in top.collect()}


def count_tokens(docs: DataFrame, path: str | None = None, text_col: str = "text", **sizes) -> DataFrame:
    """``docs`` with n_bytes (UTF-8) and n_tokens.

    Counts are those of the model's library for the whole text, without begin,
    end or added special tokens; special strings in a text are ordinary text.
    Null and empty texts have 0 bytes and 0 tokens. The model file must be at
    ``path`` on every worker. Other columns pass through; columns named like the
    results are replaced.
    """
    path = path or model_path()
    base = docs.drop("n_bytes", "n_tokens")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(base, path, text_col, **sizes))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = Lengths(load(path), table.value)
        for texts in batches:
            yield pd.Series([sum(map(lengths.__getitem__, pretokens(t))) if t else 0 for t in texts], dtype="int64")

    # Said outright: annotations are plain text in this module, and the UDF's kind is read from them.
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    count = F.pandas_udf(run, "long")
    tokens = fresh(base, "tokens")
    return (base.withColumn(tokens, count(F.col(text_col)))
            .select(*base.columns, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                    F.col(tokens).alias("n_tokens")))
