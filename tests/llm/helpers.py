import re

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, __doc long, __text string, kept string, n_words int, copy int"
LONG = "word " * 30_000 + "end"

#: doc_id and text of the awkward rows; the other columns clash with inner names.
EDGE = [(None, "a null id\nits text\nthree lines of it"), (9_000_001, None), (9_000_002, ""), (9_000_003, "  \n\t "), (9_000_004, LONG),
        (9_000_005, "one"), (9_000_006, "same words here\nand there\nand everywhere else too"),
        (9_000_006, "same words here\nand there\nand everywhere else too"),
        (9_000_007, "same words here\nand there\nand everywhere else too"), (9_000_008, "日本語 текст ελληνικά  nbsp 😀\x0b\x0cx")]


def edge(spark):
    rows = [(i, t, None if n % 3 == 0 else "en", None if n % 2 else "s1", 1, "x", "y", 2, 3) for n, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, SCHEMA)


def real(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words(text):
    return WORD.findall(text or "")


def order(doc_id):
    return float("-inf") if doc_id is None else doc_id


def repeated(rows, units, size, fits=lambda w: True):
    """{(doc_id, text): [is the unit repeated]} by the plain definition."""
    first = {}
    seqs = {(i, t): units(t) for i, t in rows}
    for (i, _), u in seqs.items():
        for s in range(len(u) - size + 1):
            w = tuple(u[s:s + size])
            at = (order(i), s)
            if fits(w) and (w not in first or at < first[w]):
                first[w] = at
    out = {}
    for (i, t), u in seqs.items():
        gone = [False] * len(u)
        for s in range(len(u) - size + 1):
            w = tuple(u[s:s + size])
            if fits(w) and first[w] < (order(i), s):
                gone[s:s + size] = [True] * size
        out[i, t] = gone
    return out
