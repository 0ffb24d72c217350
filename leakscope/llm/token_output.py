"""Token ids as binary files: frequency-ranked, byte-aligned, control bytes apart.

Each id is replaced by its rank of frequency in the corpus and written in as
few whole bytes as the rank needs (1 to 4, little-endian). The lengths do not
stand between the values: two bits a value, four values a control byte, form a
stream of their own, so that a reader gets the lengths of many values by one
table lookup on the control bytes and gathers all values without a loop.

The files, under one folder:
  vocabulary/  rank, id
  blocks/      shard, block, start (within the shard), n_ids, doc_ids, lengths,
               control, data: whole documents, in order, of BLOCK ids or one document
  shards/      shard, start, n_ids: where each shard begins in the corpus
They are Parquet tables with binary columns, so Spark's commit protocol covers
lost executors and any file system that Spark knows can hold them.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_print, stored

MODEL, END = "word_bpe_49k.json", 1
BLOCK = 1 << 17  # ids
CHUNK = 1 << 18  # values coded or decoded at once, a multiple of four
CACHE = 300_000  # entries of a cache's generation
LONGEST = 64  # bytes; longer words are encoded each time and not remembered
BLOCKS = "shard int, block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary"
DOCUMENTS = "doc_id long, shard int, start long, n_tokens long, ids binary"


# --- the code: values of up to four bytes, their lengths in a stream of control bytes

#: For each control byte, the lengths of its four values.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def coded(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values. The last control byte is filled
    up with ones-byte lengths that have no data."""
    control, data = [], []
    for at in range(0, len(values), CHUNK):
        v = np.ascontiguousarray(values[at:at + CHUNK], "<u4")
        size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
        data.append(v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes())
        quads = np.pad(size - 1, (0, -len(v) % 4)).reshape(-1, 4)
        control.append((quads << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes())
    return b"".join(control), b"".join(data)


def decoded(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``coded``."""
    out, at = np.empty(n, "<u4"), 0
    lead = np.frombuffer(control, np.uint8)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    for first in range(0, n, CHUNK):
        m = min(CHUNK, n - first)
        size = LENGTHS[lead[first // 4:(first + m + 3) // 4]].reshape(-1)[:m]
        stop = at + np.cumsum(size, dtype=np.int64)
        begin = stop - size
        v = raw[begin].astype("<u4")
        for k in range(1, int(size.max(initial=1))):
            v |= np.where(size > k, raw[begin + k], 0).astype("<u4") << np.uint32(8 * k)
        out[first:first + m], at = v, int(stop[-1])
    return out


# --- encoding

class Kept(dict):
    """A cache of two generations: when the young one is full it becomes the old
    one; what is used again moves to the young one."""

    def __init__(self, make):
        super().__init__()
        self.old: dict = {}
        self.make = make

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


#: Pre-tokens among the code points below U+0100, lower-cased: endings, letters, a digit, anything else.
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\x09-\x0D\x20\x85\xa0]+")


#: What commonly ends a word, a pre-token of its own after letters.
MARKS = frozenset(".,;:!?)")
ID = attrgetter("id")


def is_latin(s: str) -> bool:
    try:
        s.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the rest for U+0100 onwards in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """Words (runs without ASCII white space) as bytes -> ids as bytes of ``kind``.

    White space separates pre-tokens and is dropped, so a text's ids are those of
    its words. Words of the code points below U+0100 are cut here, where lower
    case, normal form and classes are beyond doubt, and their pre-tokens go to the
    library's merges, each once while remembered; all other words, and those that
    may hold a special string, go to the library whole. The cutting is checked
    against the library when the model is loaded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        top = max(self.model.get_vocab(with_added_tokens=True).values())
        self.kind = "<u2" if top < 1 << 16 else "<u4"
        self.special = re.compile("|".join(re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()) or r"(?!)")
        self.letters = byte_letters()
        self.code = {2: "H", 4: "I"}[int(self.kind[-1])]
        self.merges = self.model.model.tokenize
        self.pieces = Kept(self.piece)
        self.words = Kept(self.word)
        self.latin = True
        self.latin = all(self.word(w) == self.whole(w) for w in self.probes())

    def probes(self):
        for c in map(chr, range(0x100)):
            if not c.isascii() or not c.isspace():
                yield from (f"a{c}b".encode(), f"{c}{c}1".encode(), f"é'{c}s".encode(), f"B{c}".encode())

    def whole(self, word: bytes) -> bytes:
        return array(self.code, self.model.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, map(ID, self.merges(piece))).tobytes()

    def word(self, word: bytes) -> bytes:
        s = word.decode()
        if not (word.isascii() or is_latin(s)) or not self.latin or self.special.search(s):
            return self.whole(word)
        s = s.lower()
        if s.isalpha():
            return self.pieces[s]
        if s[-1] in MARKS and s[:-1].isalpha():
            return self.pieces[s[:-1]] + self.pieces[s[-1]]
        return b"".join(map(self.pieces.__getitem__, LATIN.findall(s)))

    def text(self, text: bytes | None) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split())) if text else b""


def worker_encoder(path: str) -> Encoder:
    """The worker's encoder: made once, its caches serve all tasks of the worker."""
    kept = sys.modules.setdefault("leakscope_worker_cache", types.ModuleType("leakscope_worker_cache"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.encoder = path, Encoder(path)
    return kept.encoder


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str, end: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(id, print, row, ids), stored, and the kind of number in ids; ``end`` follows each document."""
    kind = Encoder(path).kind

    def run(batches):
        encoder = worker_encoder(path)
        stop = np.array([end], kind).tobytes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [encoder.text(t) + stop for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ids, pa.binary())], names=["id", "print", "row", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_print(text_col).alias("print"),
                       F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, "id long, print long, row long, ids binary"), compression="zstd"), kind


def counts(tokens: DataFrame, kind: str) -> DataFrame:
    """(id, n): how often each id occurs; a task sums into one array as long as the vocabulary."""
    def run(batches):
        n = np.zeros(1, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                c = np.bincount(np.frombuffer(ids, kind))
                if len(c) > len(n):
                    n, c = c, n
                n[:len(c)] += c
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n[at])], names=["id", "n"])
    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- files

def write_token_files(docs: DataFrame, path: str, model: str | None = None, end: int = END,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token ids of ``docs`` under ``path`` (see the module's text).

    A text's ids are those of the model's library without added special tokens;
    a special string in a text is what the library takes it for. Null and empty
    texts have the end id alone, and an empty table gives empty files. Documents
    stand in ascending order of their ids, a missing id first, rows of one id by a
    print of their texts; repeated rows are documents of their own. A text of any
    length is one document; its ids are coded in chunks. Other columns are not
    read. The vocabulary's table (a row per id in use) is broadcast; its size is
    that of the model's vocabulary.
    """
    spark = docs.sparkSession
    tokens, kind = encoded(docs, model or model_path(), end, id_col, text_col)
    ordered = sorted(counts(tokens, kind).collect(), key=lambda r: (-r["n"], r["id"]))
    ids = [r["id"] for r in ordered]
    spark.createDataFrame(list(enumerate(ids)), "rank long, id long").coalesce(1).write.parquet(f"{path}/vocabulary")
    ranks = np.zeros(max(ids, default=0) + 1, "<u4")
    ranks[ids] = np.arange(len(ids))
    shared = spark.sparkContext.broadcast(ranks)

    def pack(batches):
        shard, rank = TaskContext.get().partitionId(), shared.value
        block, start, size, held = 0, 0, 0, []

        def row():
            values = rank[np.frombuffer(b"".join(h[1] for h in held), kind)]
            control, data = coded(values)
            width = np.dtype(kind).itemsize
            columns = [shard, block, start, len(values), [h[0] for h in held], [len(h[1]) // width for h in held], control, data]
            types_ = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types_)],
                                              names=["shard", "block", "start", "n_ids", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for doc, ids_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((doc, ids_.as_py()))
                size += len(held[-1][1]) // np.dtype(kind).itemsize
                if size >= BLOCK:
                    yield row()
                    block, start, size = block + 1, start + size, 0
                    held.clear()
        if held:
            yield row()

    order = ["id", "print", "row"]
    (tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "ids")
     .mapInArrow(pack, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks"))
    # A row per shard, that is per task of the writing job.
    shards = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards.select("shard", F.coalesce(before, F.lit(0)).alias("start"), "n_ids").coalesce(1).write.parquet(f"{path}/shards")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files alone: ``ids`` are the ids as
    little-endian unsigned 32-bit integers, ``start`` the number of ids of all
    documents before. The vocabulary and the shards' starts (a row per id in use
    and per shard) are broadcast."""
    names = [r["id"] for r in spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()]
    shared = spark.sparkContext.broadcast(np.array(names, "<u4"))

    def unpack(batches):
        ids = shared.value
        for batch in batches:
            for r in range(len(batch)):
                shard, start, n, docs, lengths, control, data = (batch.column(i)[r].as_py() for i in range(7))
                values = ids[decoded(control, data, n)] if n else np.empty(0, "<u4")
                stop = np.cumsum(lengths)
                first = stop - lengths
                for at in range(0, len(docs), 256):
                    own = slice(at, at + 256)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[own], pa.int64()), pa.array([shard] * len(docs[own]), pa.int32()), pa.array(start + first[own]),
                         pa.array(lengths[own], pa.int64()),
                         pa.array([values[a:z].tobytes() for a, z in zip(first[own], stop[own])], pa.binary())],
                        names=["doc_id", "shard", "start", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "start", "n_ids", "doc_ids", "lengths", "control", "data")
    shards = spark.read.parquet(f"{path}/shards").select(F.col("shard").alias("__shard"), F.col("start").alias("__start"))
    read = blocks.mapInArrow(unpack, DOCUMENTS)
    return (read.join(F.broadcast(shards), read["shard"] == shards["__shard"])
            .select("doc_id", (F.col("start") + F.col("__start")).alias("start"), "n_tokens", "ids"))
