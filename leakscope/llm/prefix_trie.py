"""Conversations as a prefix trie, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. Nodes are keyed by two 64-bit
hashes of their turns and positions, combined by exclusive or: they are built
from partial results, so a conversation of any length is spread over tasks.
A node's members come from one aggregate; its smallest member and its depth
name it (two nodes of a depth share no member).

Totals over subtrees go from the leaves to the root. Nodes are sorted
externally in reverse level order; each takes the messages of its children
from a priority queue, which spills, and puts its own totals there for its
parent. The trie is cut into shards: subtrees of at most ``limit`` rows, and
above them pieces of ``limit`` levels of the chains of one smallest member.
Totals that leave a shard are summed by receiver; the pieces, whose number is
bounded by 2 * rows / limit + 1, form a small tree that is processed the same
way, and what it sends ends the pieces' nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import struct
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import rank_within, stored

BLOCK, PREFIXES = 100, 6  # conversations that share a first one; prefix lengths are below PREFIXES
BAND = 4096  # turns of a conversation that one window takes
LEAST = 1 << 14  # rows of a shard at least
HELD = 1 << 18  # messages that a queue holds in memory
CHUNK = 1 << 16  # characters
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


# --- priority queue and time-forward processing, inside a task

class SpillingQueue:
    """A priority queue of tuples of integers in ascending order. Beyond ``held``
    entries the later half goes to a sorted run in an unnamed scratch file of the
    task (as Spark's own sorts spill), read back in order and by blocks."""

    def __init__(self, width: int, held: int = HELD):
        self.heap: list = []
        self.runs: list = []  # a heap of (entry, number, iterator of the rest)
        self.record, self.held, self.spilled = struct.Struct(f"<{width}q"), held, 0

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.held:
            self.heap.sort()
            run = self.heap[self.held // 2:]
            del self.heap[self.held // 2:]
            file = tempfile.TemporaryFile()
            for at in range(0, len(run), 4096):
                file.write(b"".join(itertools.starmap(self.record.pack, run[at:at + 4096])))
            file.seek(0)
            self.spilled += 1
            self.next_of(self.entries(file), self.spilled)

    def entries(self, file):
        with file:
            while data := file.read(self.record.size * 4096):
                yield from self.record.iter_unpack(data)

    def next_of(self, run, number: int) -> None:
        entry = next(run, None)
        if entry is not None:
            heapq.heappush(self.runs, (entry, number, run))

    def first(self) -> tuple | None:
        own, run = self.heap[0] if self.heap else None, self.runs[0][0] if self.runs else None
        return run if own is None else own if run is None else min(own, run)

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            entry, number, run = heapq.heappop(self.runs)
            self.next_of(run, number)
            return entry
        return heapq.heappop(self.heap)


FORWARD = "root boolean, a long, b long, to_a long, to_b long, n_children long, n_leaves long, saved long"


def forward(batches):
    """Rows (shard_a, shard_b, a, b, to_a, to_b, root, n_children, n_leaves, saved),
    sorted by shard and by (a, b) in reverse, each shard in one task -> every node with its totals.

    (a, b) names a node and (to_a, to_b), earlier in that order, its parent. The
    numbers are the node's own and what reached it from other shards. A root's
    parent is not in its shard: it is sent nothing here.
    """
    queue, shard, out = None, None, []

    def flush():
        kinds = [pa.bool_()] + [pa.int64()] * 7
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["root", "a", "b", "to_a", "to_b", "n_children", "n_leaves", "saved"])

    for batch in batches:
        for sa, sb, a, b, to_a, to_b, root, n_children, n_leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
            if (sa, sb) != shard:
                shard, queue = (sa, sb), SpillingQueue(4, HELD)
            while (message := queue.first()) is not None and message[:2] == (-a, -b):
                _, _, leaves, tokens = queue.pop()
                n_children, n_leaves, saved = n_children + 1, n_leaves + leaves, saved + tokens
            if not root:
                queue.push((-to_a, -to_b, n_leaves, saved))
            out.append((root, a, b, to_a, to_b, n_children, n_leaves, saved))
            if len(out) >= 4096:
                yield flush()
    if out:
        yield flush()


def processed(nodes: DataFrame) -> DataFrame:
    """``forward`` over all shards of ``nodes``."""
    cols = ["shard_a", "shard_b", "a", "b", "to_a", "to_b", "root", "n_children", "n_leaves", "saved"]
    return stored(nodes.select(*cols).repartition("shard_a", "shard_b")
                  .sortWithinPartitions("shard_a", "shard_b", F.desc("a"), F.desc("b")).mapInArrow(forward, FORWARD))


def received(*sent: DataFrame) -> DataFrame:
    """(ra, rb, r_children, r_leaves, r_saved): what the roots among ``sent`` send, by receiver."""
    rows = None
    for s in sent:
        part = s.where("root and to_a is not null").select("to_a", "to_b", "n_leaves", "saved")
        rows = part if rows is None else rows.union(part)
    return rows.groupBy(F.col("to_a").alias("ra"), F.col("to_b").alias("rb")).agg(
        F.count("*").alias("r_children"), F.sum("n_leaves").alias("r_leaves"), F.sum("saved").alias("r_saved"))


def with_received(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    joined = nodes.join(messages, (nodes["a"] == messages["ra"]) & (nodes["b"] == messages["rb"]), "left")
    return joined.withColumns({c: F.col(c) + F.coalesce(r, F.lit(0)) for c, r in
                               (("n_children", "r_children"), ("n_leaves", "r_leaves"), ("saved", "r_saved"))}).drop("ra", "rb", "r_children", "r_leaves", "r_saved")


# --- conversations

def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): turns in order, from 1, their role and text as a digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    slim = stored(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text).alias("print"),
        digest.alias("digest"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row")))
    ranked = rank_within(slim, "conv_id", ["turn", "role", "print", "row"], "nth")
    return stored(ranked.select("conv_id", (F.col("nth") + 1).alias("pos"), "digest", "chars"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len) and (conv_id, depth, digest, chars, len) of the rebuilt conversations."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    given = F.crc32(F.col("conv_id").cast("string").cast("binary")) % PREFIXES
    own = own.withColumn("h", given).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
    bases = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("bid"), F.col("own").alias("has"))
    convs = own.join(bases, own["base"] == bases["bid"], "left").withColumn("given", F.least("h", F.coalesce("has", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "h", "given", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")))
    c = convs.select(F.col("conv_id").alias("cid"), "base", "h", "given", "len")
    after = turns.join(c, turns["conv_id"] == c["cid"]).where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("depth"), "digest", "chars", "len")
    # At most 2 * BLOCK conversations share a base, and they take fewer than PREFIXES of its turns each.
    heads = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < PREFIXES)).select(F.col("conv_id").alias("bid"), "pos", "digest", "chars")
    before = c.where("given > 0").join(heads, c["base"] == heads["bid"]).where("pos <= given").select(
        F.col("cid").alias("conv_id"), F.col("pos").alias("depth"), "digest", "chars", "len")
    return convs.select("conv_id", "len"), after.union(before)


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with (k1, k2), the key of the node, and (p1, p2), its parent's."""
    rows = rows.withColumn("e1", F.xxhash64("depth", "digest")).withColumn("e2", F.xxhash64("digest", "depth", F.lit(1)))
    rows = rows.withColumn("band", F.floor((F.col("depth") - 1) / BAND)).drop("digest")
    upto = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({k: F.bit_xor(e).over(upto) for k, e in (("k1", "e1"), ("k2", "e2"))})
    # Only conversations of more than one band have anything before a band: a row per band of these.
    totals = rows.where(F.col("len") > BAND).groupBy("conv_id", "band").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("tid"), F.col("band").alias("tband"),
                           *(F.coalesce(F.bit_xor(t).over(before), F.lit(0)).alias(f"o{t}") for t in ("t1", "t2")))
    joined = rows.join(totals, (rows["conv_id"] == totals["tid"]) & (rows["band"] == totals["tband"]), "left")
    out = joined.withColumns({k: F.col(k).bitwiseXOR(F.coalesce(o, F.lit(0))) for k, o in (("k1", "ot1"), ("k2", "ot2"))})
    out = out.withColumns({p: F.col(k).bitwiseXOR(F.col(e)) for p, k, e in (("p1", "k1", "e1"), ("p2", "k2", "e2"))})
    return stored(out.select("conv_id", "depth", "len", "chars", "k1", "k2", "p1", "p2"))


def ended(batches):
    """(depth, k1, k2, conv_id) sorted -> (depth, k1, k2, ends_sha256), each node's ids in one task, one after the other."""
    now, sha, out = None, None, []

    def flush():
        columns = zip(*out)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])],
                                           names=["ed", "e1", "e2", "ends_sha256"])
        out.clear()
        return batch

    for batch in batches:
        for *node, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                    if len(out) >= 4096:
                        yield flush()
                now, sha = node, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if now is not None:
        out.append((*now, sha.hexdigest()))
        yield flush()


def chunked(batches):
    """(depth, k1, k2, conv_id) sorted -> (depth, k1, k2, first, ids): neighbours of a node as comma-joined text of up to CHUNK characters."""
    now, first, ids, size, out = None, None, [], 0, []

    def flush():
        kinds = [pa.int64()] * 4 + [pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["depth", "k1", "k2", "first", "ids"])
        out.clear()
        return batch

    for batch in batches:
        for *node, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if node != now or size > CHUNK:
                if ids:
                    out.append((*now, first, ",".join(ids)))
                    if len(out) >= 1024:
                        yield flush()
                now, first, ids, size = node, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        out.append((*now, first, ",".join(ids)))
        yield flush()


def ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(ed, e1, e2, ends_sha256) of the nodes where conversations end. Ids meet as
    text chunks of sorted neighbours, so a node at which very many end costs its
    task a stream of chunks and one running hash."""
    zero = F.lit(0).cast("long")
    last = rows.where("depth = len").select("depth", "k1", "k2", "conv_id").union(
        convs.where("len = 0").select(zero, zero, zero, "conv_id"))
    order = ["depth", "k1", "k2", "conv_id"]
    chunks = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunked, "depth long, k1 long, k2 long, first long, ids string")
    return (chunks.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "first").select("depth", "k1", "k2", "ids")
            .mapInArrow(ended, "ed long, e1 long, e2 long, ends_sha256 string"))


def named(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node: its name (depth, conv_id), key, parent's name, members, own
    numbers and ``reach``, the rows at or below it."""
    below = F.sum(F.col("len") - F.col("depth") + 1).alias("reach")
    nodes = rows.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("len").alias("longest"), F.min("chars").alias("chars"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), below)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("len").alias("longest"),
                     F.sum(F.col("len") + 1).alias("reach")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", "longest", zero.alias("chars"),
        none.alias("p1"), none.alias("p2"), "reach")
    nodes = stored(nodes.union(root))
    parents = nodes.select((F.col("depth") + 1).alias("pd"), F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parents, (nodes["depth"] == parents["pd"]) & (nodes["p1"] == parents["pk1"]) & (nodes["p2"] == parents["pk2"]), "left")
    return stored(found.select("depth", "conv_id", "k1", "k2", "parent_conv_id", "n_convs", "reach",
                               (F.col("longest") == F.col("depth")).cast("long").alias("n_leaves"),
                               ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))


def totals(nodes: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """(a, b, n_children, n_leaves, saved) with totals over subtrees, (a, b) being (depth, conv_id)."""
    base = nodes.select(F.col("depth").alias("a"), F.col("conv_id").alias("b"), (F.col("depth") - 1).alias("to_a"), F.col("parent_conv_id").alias("to_b"),
                        "reach", F.lit(0).cast("long").alias("n_children"), "n_leaves", "saved")
    base = base.withColumn("to_a", F.when(F.col("to_b").isNotNull(), F.col("to_a")))
    # Subtrees: along a conversation's turns reach only falls, so its nodes above the limit come first.
    high = nodes.where((F.col("reach") > limit) & (F.col("depth") > 0)).select(F.col("depth").alias("hd"), F.col("k1").alias("h1"), F.col("k2").alias("h2"))
    marked = rows.join(high, (rows["depth"] == high["hd"]) & (rows["k1"] == high["h1"]) & (rows["k2"] == high["h2"]), "left")
    homes = (marked.where("hd is null").groupBy(F.col("conv_id").alias("home")).agg(F.min(F.struct("depth", "k1", "k2")).alias("at"))
             .select("home", F.col("at.depth").alias("top"), F.col("at.k1").alias("s1"), F.col("at.k2").alias("s2")))
    small_root = nodes.where(F.col("depth") == 0).where(F.col("reach") <= limit)
    if not small_root.isEmpty():  # the whole trie is one shard
        return processed(base.withColumns({"shard_a": F.lit(0), "shard_b": F.lit(0), "root": F.col("to_a").isNull()}))
    low = base.where(F.col("reach") <= limit)
    low = low.join(homes, low["b"] == homes["home"]).withColumns({"shard_a": F.col("s1"), "shard_b": F.col("s2"), "root": F.col("a") == F.col("top")})
    below = processed(low)
    # Pieces: a chain of one smallest member, cut every ``limit`` levels.
    band = F.floor(F.col("a") / limit)
    to_band = F.floor(F.col("to_a") / limit)
    top = base.where(F.col("reach") > limit).withColumns({
        "shard_a": band, "shard_b": F.col("b"), "root": F.col("to_a").isNull() | (F.col("to_b") != F.col("b")) | (to_band != band)})
    fed = stored(with_received(top, received(below)))
    pieces = processed(fed).where("root")
    # Across the shard roots: a piece is named by (band, smallest member), which comes after its parent's in every order of pairs.
    across = processed(pieces.select(
        F.lit(0).alias("shard_a"), F.lit(0).alias("shard_b"), band.alias("a"), "b", to_band.alias("to_a"), "to_b", F.col("to_a").isNull().alias("root"),
        F.lit(0).cast("long").alias("n_children"), "n_leaves", "saved"))
    names = pieces.select(band.alias("pa"), F.col("b").alias("pb"), F.col("to_a").alias("into"), F.col("to_b").alias("into_b"))
    sent = across.join(names, (across["a"] == names["pa"]) & (across["b"] == names["pb"])).select(
        F.lit(True).alias("root"), F.col("into").alias("to_a"), F.col("into_b").alias("to_b"), "n_leaves", "saved")
    above = processed(with_received(fed, received(sent)))
    return below.union(above)


def prefix_trie(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row per node.

    Turns are in order of ``turn``, a missing one first; ties by role, then by an
    md5 of the text; repeated rows are turns of their own. A missing role or text
    is an empty one. Rows without a conv_id belong to no conversation and count
    nowhere. Texts are hashed whole. An empty table has no node. Other columns
    are not read. ``limit`` (rows of a shard) grows with the square root of the
    rows, so that neither shards nor the tree of their roots become large.
    """
    turns = turns_of(conversations)
    convs, rows = rebuilt(turns)
    rows = keyed(rows)
    nodes = named(rows, convs)
    limit = limit or max(LEAST, int(rows.count() ** 0.5))
    total = totals(nodes, rows, limit)
    done = nodes.drop("n_leaves", "saved")
    done = done.join(total.select("a", "b", "n_children", "n_leaves", "saved"), (done["depth"] == F.col("a")) & (done["conv_id"] == F.col("b")))
    hashes = ends(rows, convs)
    done = done.join(hashes, (done["depth"] == hashes["ed"]) & (done["k1"] == hashes["e1"]) & (done["k2"] == hashes["e2"]), "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                       F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))
