"""Substring dedup: seed and extend on winnowed word anchors.

Every word covered by a window of ``size`` words that also starts earlier in
the corpus is removed; see ``repeats`` for the search and its skew handling.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .repeats import fixed, kept_mask, with_ranges

SIZE, GRAM = 20, 4
CUT = "kept string, n_words long, n_removed long"


def words_of(text: bytes) -> list[bytes]:
    return text.split()  # ASCII white space: U+0009 to U+000D and the space


def cut_words(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    out = []
    for t, r in zip(text, ranges):
        words = words_of(t or b"")
        if r is None or len(r) == 0:
            out.append((b" ".join(words).decode("utf-8", "replace"), len(words), 0))
            continue
        keep = kept_mask(len(words), r)
        kept = [w for w, k in zip(words, keep) if k]
        out.append((b" ".join(kept).decode("utf-8", "replace"), len(words), len(words) - len(kept)))
    return pd.DataFrame(out, columns=["kept", "n_words", "n_removed"])


def remove_repeated_substrings(docs: DataFrame, size: int = SIZE, gram: int = GRAM,
                               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with kept_text, n_words and n_removed.

    Words are runs of anything but space and U+0009 to U+000D, compared byte by
    byte. A null or empty text has no words and an empty kept_text. Rows of
    equal id and text are copies of one document and do not repeat each other;
    other rows that share an id, or have none, are documents of their own, null
    ids before all others. Texts shorter than ``size``
    words lose nothing; very long texts are searched whole; an empty table gives an
    empty one. Other columns pass through, except that columns named
    like the three results are replaced.
    """
    if not 1 <= gram <= size:
        raise ValueError("1 <= gram <= size is needed")
    base = docs.drop("kept_text", "n_words", "n_removed")
    found, ranges = with_ranges(base, words_of, fixed(size), gram, id_col, text_col)
    cut = fresh(found, "cut")
    udf = F.pandas_udf(cut_words, CUT)
    return (found.withColumn(cut, udf(F.col(text_col).cast("binary"), F.col(ranges)))
            .select(*base.columns, F.col(f"{cut}.kept").alias("kept_text"),
                    F.col(f"{cut}.n_words").alias("n_words"), F.col(f"{cut}.n_removed").alias("n_removed")))
