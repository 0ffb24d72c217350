"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Items are reduced to their lower-cased words; items of equal words are one.
   Their n-grams (pairs of words) set bits in a Bloom filter of ``bloom_bits``
   bits, whatever the benchmark's size; it is the only thing broadcast.
2. One pass over the documents keeps the n-grams that pass the filter; they
   join the items' n-grams on their hash.
3. An alignment (match 1, mismatch and gap -0.5) of ``least`` of the item's m
   words' score has matches M and errors c with M - c / 2 >= least * m. The
   matches lie in c + 1 runs at most, so M - c - 1 >= (2 * least - 1) * m - 1 of
   the item's pairs are found, on diagonals at most c <= 2 * (1 - least) * m
   apart. A document with fewer of them on such diagonals can't hold the item.
   Of an item's pairs the most frequent need not be looked up: what the rest
   must still show is the bound less the number left out.
4. Around the diagonals of what is left the document's words are cut out and
   aligned to the item. The score is the alignment's share of the perfect score,
   so what is found is what aligning every item to every document finds. An
   edited word costs 1.5 at most, so copies with a similarity of s or more, that
   is with edits in a share of 1 - s of the item's words, score 1 - 1.5 (1 - s).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leakscope.session import materialize

from .common import Hashes, fresh, mixed

LEAST_WORDS, SIMILARITY = 5, 0.8
BLOOM_BITS, PROBES = 1 << 23, 4
MATCH, MISS, GAP = 1.0, -0.5, -0.5
REMEMBERED = 10_000
WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = mixed(out ^ hashes[i:len(hashes) - n + 1 + i])
    return out


def probes(grams: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bits of each n-gram, a row per probe."""
    a, b = grams & np.uint64(0xFFFFFFFF), grams >> np.uint64(32) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(PROBES)])


def rows(schema_names, *columns):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema_names)


def item_grams(n: int):
    """Partition function: (item, text) -> (item, m words, q position, gram)."""
    def run(batches):
        hashes = Hashes()
        for batch in batches:
            out = [[], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().split(" ")
                g = gram_hashes(hashes.of(words), n).view(np.int64)
                for to, x in zip(out, (np.full(len(g), item, np.int64), np.full(len(g), len(words), np.int64), np.arange(len(g)), g)):
                    to.append(x)
            if out[0]:
                yield rows(["item", "m", "q", "gram"], *map(np.concatenate, out))
    return run


def find_grams(n: int, bits: int, bloom):
    """Partition function: (doc, text) -> (doc, p position, gram) of the n-grams that pass the filter."""
    def run(batches):
        hashes = Hashes()
        have = np.unpackbits(np.frombuffer(bloom.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            out = [[], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                g = gram_hashes(hashes.of(words_of(text.as_py())), n)
                first, *more = probes(g, bits) if len(g) else [g]
                at = np.flatnonzero(have[first.astype(np.int64)])
                for i in range(len(more)):
                    at = at[have[more[i][at].astype(np.int64)]]
                if len(at):
                    for to, x in zip(out, (np.full(len(at), doc, np.int64), at, g[at].view(np.int64))):
                        to.append(x)
            if out[0]:
                yield rows(["doc", "p", "gram"], *map(np.concatenate, out))
    return run


def cut_out(batches):
    """Partition function: (doc, id, text, near [struct(item, m, d first diagonal, wide)]) -> (doc,
    id, item, start, context): the words on the diagonals, united per item where they overlap."""
    for batch in batches:
        out = [[], [], [], [], []]
        for doc, ident, text, near in zip(*(batch.column(i).to_pylist() for i in range(4))):
            words = words_of(text)
            spans: dict = {}
            for x in sorted(near, key=lambda x: (x["item"], x["d"])):
                a, z = max(0, x["d"]), min(len(words), x["d"] + x["wide"] + x["m"])
                own = spans.setdefault(x["item"], [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(z, own[-1][1])
                else:
                    own.append([a, z])
            for item, own in spans.items():
                for a, z in own:
                    for to, x in zip(out, (doc, ident, item, a, " ".join(words[a:z]))):
                        to.append(x)
        yield rows(["doc", "id", "item", "start", "context"], *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string()))


def smith_waterman(item: np.ndarray, context: np.ndarray) -> tuple[float, int]:
    """Best local alignment of two sequences of numbers: its score, and where in
    ``context`` it ends. Gaps along the context come from a running maximum."""
    step = -GAP * np.arange(len(context) + 1)
    last = np.zeros(len(context) + 1)
    best, end = 0.0, 0
    for x in item:
        row = np.zeros_like(last)
        row[1:] = np.maximum(last[:-1] + np.where(context == x, MATCH, MISS), last[1:] + GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + step) - step, 0)
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
        last = row
    return best, end


def align(batches):
    """Partition function: (doc, id, item, start, context, text of the item) -> (doc, id, item, score, stop).
    Equal contexts of an item are aligned once while they are remembered."""
    aligned: dict = {}
    for batch in batches:
        scores, stops = [], []
        for start, context, text in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
            item, there = text.split(" "), context.split(" ")
            number = {w: i for i, w in enumerate(dict.fromkeys(item))}
            numbers = np.array([number.get(w, -1) for w in there])
            met = text, numbers.tobytes()
            if met not in aligned:
                if len(aligned) >= REMEMBERED:
                    aligned.clear()
                aligned[met] = smith_waterman(np.array([number[w] for w in item]), numbers)
            best, end = aligned[met]
            scores.append(best / (MATCH * len(item)))
            stops.append(start + end)
        yield rows(["doc", "id", "item", "score", "stop"], batch.column(0), batch.column(1), batch.column(2),
                   pa.array(scores, pa.float64()), pa.array(stops, pa.int64()))


def bloom_of(grams: DataFrame, bits: int) -> bytes:
    """The filter as bytes; bits / 64 longs at most come to the driver."""
    def positions(batches):
        for batch in batches:
            at = np.unique(probes(np.unique(batch.column(0).to_numpy().view(np.uint64)), bits))
            yield rows(["slot", "bit"], (at >> np.uint64(6)).astype(np.int64),
                       np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64))

    slots = grams.select("gram").mapInArrow(positions, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bit"))
    out = np.zeros(bits // 64, np.int64)
    for r in slots.toLocalIterator():
        out[r["slot"]] = r["bit"]
    return out.tobytes()


def least_score(similarity: float) -> float:
    return 1 - (MATCH - min(MISS, GAP)) * (1 - similarity)


def seed_length(least: float, least_words: int) -> int:
    """Two words, or one where an alignment of score ``least`` need not hold a pair of the item's."""
    return 2 if math.ceil((2 * least - 1) * least_words - 1 - 1e-9) > 0 else 1


def seeds_of(grams: DataFrame, hits: DataFrame, least: float, n: int) -> DataFrame:
    """(item, m, q, g, need): the n-grams to look up, the rarest of each item, and
    how many of them an alignment of score ``least`` shows."""
    often = hits.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("item").orderBy(F.coalesce("often", F.lit(0)), "gram", "q")
    share = (2 * least - 1, 1) if n == 2 else (least, 0)
    bound = F.ceil(F.col("m") * F.lit(share[0]) - F.lit(share[1] + 1e-9))
    ranked = (grams.join(often, grams["gram"] == often["g"], "left").withColumn("nth", F.row_number().over(rarest))
              .withColumn("out", F.floor((bound - 1) / 2)).withColumn("need", bound - F.col("out")))
    return (ranked.where((F.col("often") > 0) & (F.col("nth") <= F.col("m") - (n - 1) - F.col("out")))
            .select("item", "m", "q", F.col("gram").alias("g"), "need"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY,
                       bloom_bits: int = BLOOM_BITS, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, stop): a row per document and item that it holds
    with a similarity of ``similarity`` or more by its score; ``stop`` is the word
    after the match.

    Items with equal words share their matches: each is given. Null or empty
    texts hold nothing; items under ``least_words`` words, null ones too, are found
    nowhere, as they can't be told from ordinary prose. Rows that share an id, or
    have none, are documents of their own unless their texts are equal, too; a
    null id is given back as null.
    """
    return keyed_contamination(docs, benchmark, least_words, similarity, bloom_bits, id_col, text_col, item_col, item_text_col).drop("doc")


def doc_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def keyed_contamination(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY,
                        bloom_bits: int = BLOOM_BITS, id_col: str = "doc_id", text_col: str = "text",
                        item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``find_contamination`` and doc, the ``doc_key`` of the row."""
    least = least_score(similarity)
    ngram = seed_length(least, least_words)
    norm = F.pandas_udf(normal_texts, "string")
    items = materialize(benchmark.select(F.col(item_col).alias("item_id"), norm(F.col(item_text_col)).alias("words"))
                        .where(F.size(F.split("words", " ")) >= least_words)
                        .withColumn("item", F.xxhash64("words")))
    distinct = items.groupBy("item").agg(F.min("words").alias("words"))
    grams = materialize(distinct.mapInArrow(item_grams(ngram), "item long, m long, q long, gram long"))
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(grams, bloom_bits))
    keyed = docs.select(doc_key(id_col, text_col).alias("doc"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hits = materialize(keyed.select("doc", "text").mapInArrow(find_grams(ngram, bloom_bits, bloom), "doc long, p long, gram long"))

    seeds = seeds_of(grams, hits, least, ngram)
    # The diagonals of a match lie in one of the windows of two steps each, whatever they start with.
    step = F.floor(F.col("m") * F.lit(2 * (1 - least)) + F.lit(1e-9)) + 1
    at = F.floor((F.col("p") - F.col("q")) / step)
    near = (hits.join(seeds, hits["gram"] == seeds["g"])
            .select("doc", "item", "m", "q", "need", step.alias("step"), F.explode(F.array(at - 1, at)).alias("at"))
            .groupBy("doc", "item", "at", "m", "need", "step").agg(F.countDistinct("q").alias("n")).where("n >= need")
            .groupBy(F.col("doc").alias("ndoc")).agg(F.collect_list(F.struct(
                "item", "m", (F.col("at") * F.col("step")).alias("d"), (2 * F.col("step")).alias("wide"))).alias("near")))
    contexts = (keyed.join(near, keyed["doc"] == near["ndoc"]).select("doc", "id", "text", "near")
                .mapInArrow(cut_out, "doc long, id long, item long, start long, context string"))
    texts = distinct.select(F.col("item").alias("titem"), "words")
    scored = (contexts.join(texts, contexts["item"] == texts["titem"]).select("doc", "id", "item", "start", "context", "words")
              .mapInArrow(align, "doc long, id long, item long, score double, stop long")
              .where(F.col("score") >= least - 1e-9)
              .groupBy("doc", "id", "item").agg(F.max(F.struct("score", "stop")).alias("best")))
    return scored.join(items.select("item_id", F.col("item").alias("iitem")), F.col("item") == F.col("iitem")).select(
        "doc", F.col("id").alias("doc_id"), "item_id", "best.score", "best.stop")


def normal_texts(texts):
    import pandas as pd
    return pd.Series([" ".join(words_of(t)) for t in texts], dtype=object)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         **options) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark."""
    key, bad = fresh(docs, "key"), fresh(docs, "bad")
    found = keyed_contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc").alias(bad)).distinct()
    keyed = docs.withColumn(key, doc_key(id_col, text_col))
    return keyed.join(found, keyed[key] == found[bad], "left_anti").select(*docs.columns)
