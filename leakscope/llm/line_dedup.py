"""Line dedup: winnowing over line hashes; later repeated runs are deleted.

The units are a text's lines that hold a word, stripped of white space at
both ends. A window is a shortest run that qualifies: ``min_lines`` lines with
``min_words`` words, or ``long_words`` words on any number of lines, so that one
long line suffices and short ones need neighbours. Winnowing selects the smallest
line hash of each window, so every qualifying run that occurs twice shares
a fingerprint; see ``repeats`` for join, extension and skew handling.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .repeats import kept_mask, qualified, with_ranges

MIN_LINES, MIN_WORDS, LONG_WORDS = 3, 10, 50
CUT = "kept string, n_lines long, n_removed long"


def lines_of(text: bytes) -> list[bytes]:
    return [x for x in map(bytes.strip, text.split(b"\n")) if x]


def cut_lines(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    out = []
    for t, r in zip(text, ranges):
        lines = (t or b"").split(b"\n")
        real = [i for i, x in enumerate(lines) if x.strip()]
        if r is None or len(r) == 0:
            out.append(((t or b"").decode("utf-8", "replace"), len(real), 0))
            continue
        gone = {i for i, k in zip(real, kept_mask(len(real), r)) if not k}
        out.append((b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode("utf-8", "replace"), len(real), len(gone)))
    return pd.DataFrame(out, columns=["kept", "n_lines", "n_removed"])


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS,
                          long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with kept_text, n_lines and n_lines_removed.

    A run of consecutive lines is deleted where it also starts earlier (smaller
    id, or earlier in the same document) and has at least ``min_lines`` lines and
    ``min_words`` words, or at least ``long_words`` words on any number of lines. Lines without a word are no part of a run and stay. A
    null text gives an empty kept_text; very long texts are searched whole; an empty
    table gives an empty one. Rows of equal id and text are copies
    of one document and do not repeat each other; other rows that share an id,
    or have none, are documents of their own, null ids before all others. Other columns pass through, except that columns named
    like the three results are replaced.
    """
    base = docs.drop("kept_text", "n_lines", "n_lines_removed")
    found, ranges = with_ranges(base, lines_of, qualified(min_lines, min_words, long_words), 1, id_col, text_col)
    cut = fresh(found, "cut")
    udf = F.pandas_udf(cut_lines, CUT)
    return (found.withColumn(cut, udf(F.col(text_col).cast("binary"), F.col(ranges)))
            .select(*base.columns, F.col(f"{cut}.kept").alias("kept_text"),
                    F.col(f"{cut}.n_lines").alias("n_lines"), F.col(f"{cut}.n_removed").alias("n_lines_removed")))
