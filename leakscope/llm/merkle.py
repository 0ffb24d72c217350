"""Merkle manifest of a dataset as postorder append logs.

The rows of a group (a source) in order are the leaves of a tree of fan-out
three; the groups' roots in order are the leaves of one more tree. Builders
are aligned: each takes ``3 ** LEVELS`` consecutive leaves and appends nodes to
its log in order of completion, that is in postorder. Where a node stands in a
log follows in closed form from the sizes of the subtrees before it, so a
proof addresses siblings without a search or an index. The roots of builders
are the leaves of the next round, until each group has one root; proofs are
read off top-down, each round handing the rest of the path to the one below.

No task holds more than a builder's nodes or the proofs of one builder's
leaves, whatever the size of a group.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_within, stored

FAN, LEVELS = 3, 6
BUILDER = FAN ** LEVELS
SIZE = 64  # a digest as hex text
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "tree string, block long, n long, log binary"
UNIT = "tree string, unit long, upper binary"
LEAF = "tree string, nth long, n long, digest binary"


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


# --- the shape of a tree of n leaves

def height(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def position(level: int, index: int, n: int) -> int:
    """Where node ``index`` of ``level`` stands in the postorder log of ``n`` leaves.

    The nodes complete by then are those of its level or below that end with it
    or before, and those of higher levels that end before it begins.
    """
    first = index * FAN ** level
    stop = min(first + FAN ** level, n)
    below = sum(-(-stop // FAN ** j) for j in range(level + 1))
    return below + sum(first // FAN ** j for j in range(level + 1, height(n) + 1)) - 1


def run_of(index: int, width: int) -> range:
    """The run of nodes that ``index`` is hashed with, at a level of ``width`` nodes."""
    first = index - index % FAN
    return range(first, min(first + FAN, width))


def siblings(log: bytes, index: int, n: int, levels: int) -> bytes:
    """The digests beside leaf ``index`` and its ancestors up to ``levels``, from a log of ``n`` leaves."""
    out = []
    for level in range(levels):
        for k in run_of(index, -(-n // FAN ** level)):
            if k != index:
                at = SIZE * position(level, k, n)
                out.append(log[at:at + SIZE])
        index //= FAN
    return b"".join(out)


def fold(leaf: bytes, index: int, n: int, proof: bytes) -> tuple[bytes, bytes]:
    """The root that ``leaf`` and its siblings give, and what is left of the proof."""
    node, at = leaf, 0
    while n > 1:
        run = run_of(index, n)
        before = SIZE * (index - run.start)
        stop = at + SIZE * (len(run) - 1)
        node = digest(proof[at:at + before], node, proof[at + before:stop])
        at, index, n = stop, index // FAN, -(-n // FAN)
    return node, proof[at:]


def append(leaves: list[bytes], levels: int) -> bytes:
    """The postorder log of one builder: each node right after its last child."""
    log, begun = [], [[] for _ in range(levels + 1)]

    def add(level: int, node: bytes) -> None:
        log.append(node)
        begun[level].append(node)
        if level < levels and len(begun[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        node = digest(*begun[level])
        begun[level].clear()
        add(level + 1, node)

    for leaf in leaves:
        add(0, leaf)
    for level in range(levels):
        if begun[level]:
            close(level)
    return b"".join(log)


# --- partition functions; rows come sorted

def build(batches):
    """Leaves (tree, nth, n, digest) by (tree, nth), each builder's in one task -> a log per builder."""
    at, leaves = None, []

    def segment():
        tree, block, n = at
        log = append(leaves, min(LEVELS, height(n)))
        return pa.RecordBatch.from_arrays(
            [pa.array([tree], pa.string()), pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([log], pa.binary())],
            names=["tree", "block", "n", "log"])

    for batch in batches:
        for tree, nth, n, leaf in zip(*(c.to_pylist() for c in batch.columns)):
            here = (tree, nth // BUILDER, n)
            if here != at:
                if leaves:
                    yield segment()
                at, leaves = here, []
            leaves.append(leaf)
    if leaves:
        yield segment()


def members(block: int, n: int) -> int:
    return min(BUILDER, n - block * BUILDER)


def paths(batches):
    """Logs with the rest of their root's path -> (tree, unit, upper): the path of each leaf."""
    for batch in batches:
        for tree, block, n, log, upper in zip(*(c.to_pylist() for c in batch.columns)):
            m = members(block, n)
            found = [siblings(log, i, m, min(LEVELS, height(n))) + (upper or b"") for i in range(m)]
            for k in range(0, m, 256):
                some = found[k:k + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(some), pa.string()), pa.array(range(block * BUILDER + k, block * BUILDER + k + len(some)), pa.int64()),
                     pa.array(some, pa.binary())], names=["tree", "unit", "upper"])


CHECKED = "doc_id long, tree string, nth long, proof binary, leaf string, folded string"


def check(batches):
    """A builder's log (kind 0, with the path above it) followed by the claims on its
    leaves (kind 1: doc_id, nth, the digest claimed) -> proof, true leaf and folded root of each claim."""
    log, n, m, upper, k, groups = b"", 0, 0, b"", 0, 0
    for batch in batches:
        out = []
        for tree, block, kind, nth, rows, data, above, doc, at, of in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                log, n, m, upper, k, groups = data, rows, members(block, rows), above or b"", at, of
                continue
            own = nth - block * BUILDER
            proof = siblings(log, own, m, min(LEVELS, height(n))) + upper
            subroot, rest = fold(data, nth, n, proof)
            folded, _ = fold(subroot, k, groups, rest)
            place = SIZE * position(0, own, m)
            out.append((doc, tree, nth, proof, log[place:place + SIZE].decode(), folded.decode()))
        for first in range(0, len(out), 512):
            doc, tree, nth, proof, leaf, folded = zip(*out[first:first + 512])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(tree, pa.string()), pa.array(nth, pa.int64()), pa.array(proof, pa.binary()),
                 pa.array(leaf, pa.string()), pa.array(folded, pa.string())],
                names=["doc_id", "tree", "nth", "proof", "leaf", "folded"])


def view(batches):
    """Logs of a round with the tree's size and the round's base level -> (tree,
    position, level, digest): the nodes at their places in the tree's whole log."""
    for batch in batches:
        for tree, block, n, log, whole, base in zip(*(c.to_pylist() for c in batch.columns)):
            m = members(block, n)
            for level in range(1 if base else 0, min(LEVELS, height(n)) + 1):
                nodes = range(-(-m // FAN ** level))
                first = block * BUILDER // FAN ** level
                local = [SIZE * position(level, i, m) for i in nodes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(nodes), pa.string()), pa.array([position(level + base, first + i, whole) for i in nodes], pa.int64()),
                     pa.array([level + base] * len(nodes), pa.int32()), pa.array([log[x:x + SIZE].decode() for x in local], pa.string())],
                    names=["tree", "position", "level", "digest"])


# --- the manifest

@dataclass
class Manifest:
    """``leaves`` (doc_id, tree, nth, n, digest, claim), ``rounds`` (the logs of the
    groups' trees), ``roots`` (tree, subroot, nth, n), ``top`` (the logs of the last
    tree) and ``root``. ``tree`` is "0" for a null group, else "1" and the group."""
    leaves: DataFrame
    rounds: list
    roots: DataFrame
    top: list
    root: str | None


def row_digest(fields: list):
    """Column: the digest of a row, each field as its length in bytes, a colon and its text; ``-`` where null."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
             for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts), 256)


def grow(leaves: DataFrame, most: int) -> list:
    """The rounds of logs over ``leaves`` (tree, nth, n, digest); ``most`` is the largest n."""
    rounds = []
    while True:
        block = F.floor(F.col("nth") / BUILDER).alias("block")
        segments = stored(leaves.select("tree", "nth", "n", "digest", block).repartition("tree", "block")
                          .sortWithinPartitions("tree", "nth").drop("block").mapInArrow(build, SEGMENT), compression="zstd")
        rounds.append(segments)
        if most <= BUILDER:
            return rounds
        most = -(-most // BUILDER)
        leaves = segments.where(F.col("n") > BUILDER).select(
            "tree", F.col("block").alias("nth"), F.ceil(F.col("n") / BUILDER).alias("n"), last_digest().alias("digest"))


def last_digest():
    """Column: a log's last node, its root."""
    return F.expr(f"substring(log, octet_length(log) - {SIZE - 1}, {SIZE})")


def roots_of(rounds: list) -> DataFrame:
    """(tree, subroot): a tree's root ends the log of the round in which one builder takes it all."""
    found = [r.where(F.col("n") <= BUILDER).select("tree", last_digest().alias("subroot")) for r in rounds]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def descend(rounds: list) -> DataFrame | None:
    """(tree, unit, upper): the rest of the path above each log of the first round, None if that is the only one."""
    upper = None
    for segments in reversed(rounds[1:]):
        upper = with_upper(segments, upper).select("tree", "block", "n", "log", "upper").mapInArrow(paths, UNIT)
    return upper


def with_upper(segments: DataFrame, upper: DataFrame | None) -> DataFrame:
    if upper is None:
        return segments.withColumn("upper", F.lit(None).cast("binary"))
    above = upper.select(F.col("tree").alias("utree"), "unit", "upper")
    return segments.join(above, (segments["tree"] == above["utree"]) & (segments["block"] == above["unit"]), "left").drop("utree", "unit")


def manifest(docs: DataFrame, fields=FIELDS, group_col: str = "source", id_col: str = "doc_id", claim=None) -> Manifest:
    """Builds the logs over all rows of ``docs``; ``claim`` is the column of digests to verify later, the leaves' own if not given.

    Nulls in any column have a mark of their own, unlike the empty text. A null
    group is a group and comes first, as does a missing id within its group;
    rows of one id stand by their digests, and repeated rows are leaves of their
    own. Texts are hashed whole. An empty table has no root.
    """
    keyed = F.when(F.col(group_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    own = row_digest([F.col(f) for f in fields])
    hashed = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), keyed.alias("tree"), own.cast("binary").alias("digest"),
        (own if claim is None else F.coalesce(claim, own)).cast("binary").alias("claim"), F.monotonically_increasing_id().alias("row")))
    ranked = rank_within(hashed, "tree", ["doc_id", "digest", "row"], "nth").drop("row")
    sizes = hashed.groupBy(F.col("tree").alias("stree")).agg(F.count("*").alias("n"))
    leaves = stored(ranked.join(sizes, ranked["tree"] == sizes["stree"]).drop("stree"))
    most = sizes.agg(F.max("n")).first()[0]
    if most is None:
        empty = leaves.select("tree", F.col("digest").alias("subroot"), "nth", "n")
        return Manifest(leaves, [], empty, [], None)
    rounds = grow(leaves, most)
    subroots = stored(rank_within(roots_of(rounds).withColumn("all", F.lit("")), "all", ["tree"], "nth"))
    n = subroots.count()
    roots = subroots.select("tree", "subroot", "nth", F.lit(n).cast("long").alias("n"))
    top = grow(roots.select(F.lit("").alias("tree"), "nth", "n", F.col("subroot").alias("digest")), n)
    return Manifest(leaves, rounds, roots, top, bytes(roots_of(top).first()["subroot"]).decode())


def verify(m: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified), a row per leaf:
    ``proof`` has the siblings' digests as hex text from the leaf's level up,
    ``folded_root`` is what the claimed digest gives with them."""
    texts = {c: F.col(c).cast("string") for c in ("subroot", "root", "proof")}
    if m.root is None:
        return m.leaves.select("doc_id", F.col("digest").cast("string").alias("leaf"), F.lit("").alias("subroot"), F.lit("").alias("root"),
                               F.lit("").alias("proof"), F.lit("").alias("folded_root"), F.lit(False).alias("verified"))
    first, *_ = m.top
    last = with_upper(first, descend(m.top)).select("tree", "block", "n", "log", "upper").mapInArrow(paths, UNIT).select("unit", F.col("upper").alias("last"))
    trees = stored(m.roots.join(last, m.roots["nth"] == last["unit"]).select(
        F.col("tree").alias("rtree"), "subroot", F.col("nth").alias("at"), F.col("n").alias("of"), "last"))
    logs = with_upper(m.rounds[0], descend(m.rounds))
    logs = logs.join(trees, logs["tree"] == trees["rtree"]).select(
        "tree", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("nth"), "n", F.col("log").alias("data"),
        F.concat(F.coalesce("upper", F.lit(b"")), F.col("last")).alias("above"), F.lit(None).cast("long").alias("doc"), "at", "of")
    none = F.lit(None).cast("long")
    claims = m.leaves.select("tree", F.floor(F.col("nth") / BUILDER).alias("block"), F.lit(1).alias("kind"), "nth", none.alias("n"),
                             F.col("claim").alias("data"), F.lit(None).cast("binary").alias("above"), F.col("doc_id").alias("doc"),
                             none.alias("at"), none.alias("of"))
    found = (logs.union(claims).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "nth").mapInArrow(check, CHECKED))
    joined = found.join(trees.select("rtree", "subroot"), found["tree"] == F.col("rtree")).withColumn("root", F.lit(m.root))
    return joined.withColumns(texts).select("doc_id", "leaf", "subroot", "root", "proof", F.col("folded").alias("folded_root"),
                                            (F.col("folded") == F.col("root")).alias("verified"))


def append_log(rounds: list, sizes: DataFrame) -> DataFrame:
    """(tree, position, level, digest): the whole log of each tree, from the builders'
    logs of all rounds; ``sizes`` has (tree, n)."""
    out = None
    for k, segments in enumerate(rounds):
        whole = sizes.select(F.col("tree").alias("stree"), F.col("n").alias("whole"))
        nodes = (segments.join(whole, segments["tree"] == whole["stree"])
                 .select("tree", "block", "n", "log", "whole", F.lit(k * LEVELS).alias("base"))
                 .mapInArrow(view, "tree string, position long, level int, digest string"))
        out = nodes if out is None else out.union(nodes)
    return out
