"""MinHash near-duplicate groups through a multi-index Hamming join.

Signature: 64 positions of 16 bits (b-bit MinHash).  Two documents whose word shingle
sets have similarity t differ in Binomial(64, 1 - t) positions; the signature-distance
threshold T lies 4.5 standard deviations above that mean.  Pigeonhole: with the
positions split into chunks that may hold one error each (and, when T + 1 is odd, a
last one that may hold none), every pair within distance T agrees on some chunk up to
its allowed error.  A chunk with an allowed error is indexed once per position left
out, so that agreement up to one error is equality of one key.  No pair within T is
missed.

Candidates are never expanded into pairs.  Documents with equal shingle sets first
become one class.  Classes sharing a key are chained to the smallest class of the key;
the components of those chains are clusters.  A cluster of bounded weight is one block;
larger ones are cut into blocks (see `_blocks`).  First each block is compared within
itself.  A key whose classes are then all in one component is settled.  For keys that
still hold several, a few classes of each component are dealt to blocks anew and compared,
round after round, as long as that joins components: copies of one text settle in as many
rounds as its group has digits, with no meeting of all its blocks.  Only keys that are
still open then have all their blocks meet, so that no link is missed.  A comparison reads
full shingle sets, skips pairs already joined and yields a spanning forest of confirmed
links, at most one row per document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_batches, arrow_rows, components, join_counted, partitions
from tessera.llm.textkit import mix64, shingle_set
from tessera.plans.storage import shared_table

POSITIONS = 64
#: Weight of a block in shingles, and bytes of the bit rows that a task holds at once.
BLOCK_SHINGLES = 600_000
MATRIX_BYTES = 128 << 20

_FACTORS = mix64(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def distance_threshold(percent: int) -> int:
    t = percent / 100
    return min(POSITIONS - 1, math.floor(POSITIONS * (1 - t) + 4.5 * math.sqrt(POSITIONS * t * (1 - t))))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The 64 16-bit positions of a non-empty set of hashes."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[i : i + 4096, None] * _FACTORS).min(axis=0))
    return (mix64(low) >> np.uint64(48)).astype(np.uint16)


def index_keys(distance: int) -> list[list[int]]:
    """Positions of each index key: chunks by pigeonhole, one key per allowed error."""
    chunks = np.array_split(np.arange(POSITIONS), (distance + 2) // 2)
    keys = []
    for i, chunk in enumerate(chunks):
        exact = (distance + 1) % 2 and i == len(chunks) - 1
        keys += [chunk.tolist()] if exact else [[p for p in chunk.tolist() if p != left] for left in chunk.tolist()]
    return keys


def _key_column(distance: int) -> Column:
    keys = [
        F.xxhash64(F.lit(i), *(F.col("sig")[p] for p in positions)) for i, positions in enumerate(index_keys(distance))
    ]
    return F.explode(F.array(*keys))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """docs(uid, doc_id, text, ...) with n_shingles, node (a 128-bit name of the shingle
    set, null without shingles) and sig, its signature; other columns pass as they are."""
    added = pa.schema([("n_shingles", pa.int64()), ("node", pa.binary()), ("sig", pa.list_(pa.int32()))])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, sigs = [], [], []
            for raw in batch.column(at):
                got = shingle_set((raw.as_py() or b"").lower(), k)
                sizes.append(len(got))
                names.append(hashlib.blake2b(got.tobytes(), digest_size=16).digest() if len(got) else None)
                sigs.append(signature(got).astype(np.int32) if len(got) else None)
            new = [pa.array(c, f.type) for c, f in zip((sizes, names, sigs), added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added.names])

    full = T.StructType(docs.schema.fields + T._parse_datatype_string("n_shingles long, node binary, sig array<int>").fields)
    return docs.mapInArrow(run, full)


def _blocks(keyed: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, block, cut, cluster, weight) of the keyed classes; cut: the cluster makes
    several blocks.

    A cluster of at most BLOCK_SHINGLES is one block.  In a larger one, a cell is what
    shares its smallest keyed companion: small cells are dealt to blocks by their name,
    large ones are cut by the name of the class.
    """
    cells = keyed.groupBy("node").agg(F.min("first").alias("cell"))
    roots = components(keyed.select(F.col("node").alias("u"), F.col("first").alias("v")))
    placed = (
        cells.join(roots, "node", "left").withColumn("cluster", F.coalesce("root", "node"))
        .join(weights, "node").select("node", "cell", "cluster", "weight")
    )
    placed = shared_table(placed, "cells")
    total = placed.count()
    by = lambda c: placed.groupBy(c).agg(F.sum("weight").alias(f"{c}_weight"), F.count("*").alias("n"))
    parts = lambda w: F.ceil(F.col(w) / BLOCK_SHINGLES)
    cut = F.col("cluster_weight") > BLOCK_SHINGLES
    block = (
        F.when(~cut, F.xxhash64(F.lit(0), "cluster"))
        .when(F.col("cell_weight") <= BLOCK_SHINGLES, F.xxhash64(F.lit(1), "cluster", F.pmod(F.xxhash64("cell"), parts("cluster_weight"))))
        .otherwise(F.xxhash64(F.lit(2), "cell", F.pmod(F.xxhash64("node"), parts("cell_weight"))))
    )
    weighed = join_counted(join_counted(placed, by("cluster"), "cluster", total), by("cell"), "cell", total)
    return shared_table(weighed.select("node", block.alias("block"), cut.alias("cut"), "cluster", "weight"), "blocks")


def _open(blocked: DataFrame, links: DataFrame) -> DataFrame:
    """blocked(key, node, block, cluster, weight) with `label`, the component by links, for
    the keys whose classes lie in several blocks and several components."""
    placed = blocked.join(components(links), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    placed = shared_table(placed, "labelled")
    spread = placed.groupBy("key").agg(
        F.min("label").alias("l"), F.max("label").alias("m"), F.min("block").alias("b"), F.max("block").alias("c"), F.count("*").alias("n")
    )
    still = spread.where("l <> m and b <> c").select("key", "n", F.lit(True).alias("open"))
    return shared_table(join_counted(placed, still, "key", max(1, placed.count())).drop("open"), "open")


def _sampled(left: DataFrame, turn: int) -> DataFrame:
    """(node, task, side): up to four classes of each open component, dealt to blocks of
    their cluster that are new in every turn."""
    some = left.groupBy("cluster", "label", F.pmod(F.xxhash64("node"), F.lit(4))).agg(F.min(F.struct("node", "weight")).alias("one"))
    some = some.select("cluster", "one.node", "one.weight").distinct()
    size = some.groupBy("cluster").agg(F.sum("weight").alias("size"), F.count("*").alias("n"))
    dealt = join_counted(some, size, "cluster", max(1, some.count()))
    part = F.pmod(F.xxhash64(F.lit(turn), "node"), F.ceil(F.col("size") / BLOCK_SHINGLES))
    return dealt.select("node", F.xxhash64(F.lit(turn), "cluster", part).alias("task"), F.lit(-1).alias("side"))


def _across(open_keys: DataFrame) -> DataFrame:
    """(node, task, side): pairs of blocks that share an open key, with the classes that
    have one.  One row per pair of blocks and key, none per pair of classes."""
    held = open_keys.select("key", "block").distinct()
    pairs = held.alias("x").join(held.alias("y"), F.expr("x.key = y.key and x.block < y.block"))
    named = pairs.select(F.col("x.block").alias("x"), F.col("y.block").alias("y")).distinct()
    named = named.select("x", "y", F.xxhash64("x", "y").alias("task"))
    sides = named.select(F.col("x").alias("block"), "task", F.lit(0).alias("side")).union(named.select("y", "task", F.lit(1)))
    return open_keys.select("node", "block").distinct().join(sides, "block").select("node", "task", "side")


def compare(sets: list[np.ndarray], side: np.ndarray, percent: int, limit: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, or between the sides 0 and 1.

    Sets are bit rows over the hashes that two or more of them hold, so an exact
    intersection is a popcount.  Pairs already joined are skipped.  Where the rows of all
    sets would take more than `limit` bytes, tiles of them are compared two by two.
    """
    limit = limit or MATRIX_BYTES
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    words = -(-int((count > 1).sum()) // 64)
    if not words:
        return []
    starts = np.concatenate([[0], np.cumsum(size)])

    def rows_of(a: int, b: int) -> np.ndarray:
        bits = np.zeros((b - a, words), dtype=np.uint64)
        for at, i in enumerate(order[a:b]):
            own = inverse[starts[i] : starts[i + 1]]
            row = np.zeros(64 * words, dtype=bool)
            row[column[own[count[own] > 1]]] = True
            bits[at] = np.packbits(row).view(np.uint64)
        return bits

    size, side = size[order], side[order]
    label = np.arange(len(sets))
    forest: list[tuple[int, int]] = []

    def meet(a: int, left: np.ndarray, b: int, right: np.ndarray) -> None:
        for i in range(a, a + len(left)):
            first, stop = max(b, i + 1), min(b + len(right), int(np.searchsorted(size, size[i] * 100 // percent, side="right")))
            if stop <= first:
                continue
            rest = np.arange(first, stop)
            rest = rest[(label[rest] != label[i]) & ((side[rest] != side[i]) | (side[i] < 0))]
            for at in range(0, len(rest), 512):
                part = rest[at : at + 512]
                part = part[label[part] != label[i]]
                both = np.bitwise_count(right[part - b] & left[i - a]).sum(axis=1, dtype=np.int64)
                for j in part[100 * both >= percent * (size[i] + size[part] - both)]:
                    if label[j] != label[i]:
                        forest.append((int(order[i]), int(order[j])))
                        label[label == label[j]] = label[i]

    step = max(1, limit // (16 * words)) if 8 * words * len(sets) > limit else len(sets)
    for a in range(0, len(sets), step):
        left = rows_of(a, min(len(sets), a + step))
        meet(a, left, a, left)
        for b in range(a + step, len(sets), step):
            if size[a + len(left) - 1] * 100 // percent < size[b]:
                break
            meet(a, left, b, rows_of(b, min(len(sets), b + step)))
    return forest


def _confirm(routed: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) confirmed on full sets; routed holds (task, side, node, text)."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def links(group: dict) -> Iterator[tuple]:
        nodes = list(group)
        for i, j in compare([group[n][0] for n in nodes], np.array([group[n][1] for n in nodes]), percent):
            yield nodes[i], nodes[j]

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        at, group = None, {}
        for task, side, node, raw in source:
            if task != at:
                if len(group) > 1:
                    yield from links(group)
                at, group = task, {}
            if node not in group:
                got = shingle_set((raw or b"").lower(), k)
                if hashlib.blake2b(got.tobytes(), digest_size=16).digest() == node:
                    group[node] = got, side
        if len(group) > 1:
            yield from links(group)

    names = ["task", "side", "node", "text"]

    def run(batches):
        return arrow_batches(rows(arrow_rows(batches, *names)), schema)

    dealt = routed.select(*names).repartition(partitions(routed.sparkSession), "task").sortWithinPartitions("task", "node")
    return dealt.mapInArrow(run, "u binary, v binary")


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): docs(uid, doc_id, text, ...) with what `_sets` adds, written; and
    (node, root) of every class of rows with shingles."""
    found = shared_table(_sets(docs, k), "sets")
    held = found.where("node is not null")
    classes = held.groupBy("node").agg(F.min("uid").alias("uid"), F.first("n_shingles").alias("weight"), F.first("sig").alias("sig"))
    classes = shared_table(classes, "classes")
    spread = classes.repartition(partitions(docs.sparkSession))  # a row becomes dozens of keys
    keys = spread.select("node", _key_column(distance_threshold(percent)).alias("key"))
    firsts = keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    keyed = shared_table(keys.join(firsts, "key"), "keys")
    blocks = _blocks(keyed, classes.select("node", "weight"))

    def confirmed(routed: DataFrame) -> DataFrame:
        return shared_table(_confirm(routed, k, percent), "confirmed")

    texts = found.select("uid", "text")
    each = blocks.select("node", F.col("block").alias("task"), F.lit(-1).alias("side"))
    links = confirmed(texts.join(each.join(classes.select("node", "uid"), "node"), "uid"))
    cut = blocks.where("cut").select("node", "block", "cluster", "weight")
    if not cut.isEmpty():
        blocked = shared_table(keyed.select("key", "node").join(cut, "node"), "blocked")
        own = classes.select("uid", "node").join(cut.select("node"), "node", "left_semi")
        large = shared_table(texts.join(own, "uid").drop("uid"), "large")  # so that rounds read no other text
        left, turn, before = _open(blocked, links), 0, None
        while (labels := left.select("label").distinct().count()) and (before is None or 4 * labels <= 3 * before):
            links = links.union(confirmed(_sampled(left, turn).join(large, "node")))
            left, turn, before = _open(blocked, links), turn + 1, labels
        if labels:
            links = links.union(confirmed(_across(left).join(large, "node")))
    roots = components(links)
    return found, classes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _numbered(docs: DataFrame, *carried: Column) -> DataFrame:
    """(uid, doc_id, text as bytes, carried): uid names a row once it is written."""
    own = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    return docs.select(F.monotonically_increasing_id().alias("uid"), *own, *carried)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose k-word shingle sets are similar in percent or more.

    Takes doc_id and text (further columns are ignored) and returns, per row, doc_id,
    n_shingles, component_id (the smallest doc_id reachable over links) and kept
    (doc_id = component_id).  Words are split at ASCII white space, A-Z lower-cased.

    Null or wordless texts have no shingles, link with nothing and are kept.  Texts
    shorter than k words are one shingle.  Rows with equal texts always share a group.
    Rows repeating a doc_id are rows of their own; a null doc_id counts as no identifier:
    its component is the smallest other one of its group, or null, and it is kept only
    then.  An empty table gives an empty result.
    """
    found, roots = _grouped(_numbered(docs), k, percent)
    smallest = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(roots, "node")
    least = smallest.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = roots.join(least, "root").select("node", "component_id")
    out = found.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, less near-duplicates: exactly one row of
    each group stays, that with the smallest doc_id (null ids come last).

    Rows are told apart as rows: where several repeat a doc_id, each is judged by its own
    text, and of identical rows one stays.  Rows without words all stay.
    """
    # The text stands beside the other columns of a row, once.
    others = F.struct(F.lit(True).alias("__any"), *(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    kind = docs.schema["text"].dataType
    own = [F.col("text").cast(kind).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    found, roots = _grouped(_numbered(docs, others.alias("row")), k, percent)
    held = found.where("node is not null").select("uid", "node", F.struct(F.col("doc_id").isNull(), "doc_id", "uid").alias("place"))
    best = held.groupBy("node").agg(F.min("place").alias("place")).join(roots, "node").groupBy("root").agg(F.min("place").alias("place"))
    stays = best.select(F.col("place.uid").alias("uid"))
    wordless = found.where("node is null").select(*own)
    return found.where("node is not null").join(stays, "uid", "left_semi").select(*own).unionByName(wordless)
