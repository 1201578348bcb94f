"""Threshold-scaled document fingerprints.

A fingerprint holds every shingle hash below a fixed fraction of the hash range, whatever
the length of the text, so fingerprints of very unequal documents estimate containment,
and the fingerprint of a union is the union of two.  Half of all hashes are kept, in 48
bits each: short texts keep enough to compare, and the text form is about two thirds as
long as the document.

Text form: number of shingles, a digest of the whole set, and the held hashes in ascending
order, 8 base64 characters each, joined by colons.  The digest tells equal sets of a few
shingles apart from others of which no hash is held; the union of two sets has none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batches, arrow_rows, partitions
from tessera.llm.textkit import shingle_set

_BITS = 48


@dataclass(frozen=True)
class Scale:
    words: int = 5
    one_in: int = 2

    @property
    def bound(self) -> int:
        return (1 << _BITS) // self.one_in


@dataclass(frozen=True)
class Fingerprint:
    total: int
    digest: str
    hashes: np.ndarray

    def __str__(self) -> str:
        raw = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
        return f"{self.total}:{self.digest}:{base64.b64encode(raw).decode()}"

    @staticmethod
    def parse(text: str) -> Fingerprint:
        total, digest, held = text.split(":")
        six = np.frombuffer(base64.b64decode(held), dtype=np.uint8).reshape(-1, 6)
        full = np.zeros((len(six), 8), dtype=np.uint8)
        full[:, 2:] = six
        return Fingerprint(int(total), digest, full.reshape(-1).view(">u8").astype(np.uint64))


def fingerprint(text: str, scale: Scale) -> Fingerprint:
    found = shingle_set(text.encode(), scale.words)
    hashes = np.unique(found >> np.uint64(64 - _BITS))
    digest = hashlib.blake2b(found.tobytes(), digest_size=6).hexdigest()
    return Fingerprint(len(found), digest, hashes[: np.searchsorted(hashes, np.uint64(scale.bound))])


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Estimated Jaccard similarity; 1 for equal sets, 0 where nothing is held to compare."""
    if a.digest and a.digest == b.digest and a.total == b.total:
        return 1.0
    both = len(np.intersect1d(a.hashes, b.hashes, assume_unique=True))
    return both / max(1, len(a.hashes) + len(b.hashes) - both)


def containment(a: Fingerprint, b: Fingerprint) -> float:
    """Estimated share of a's shingles that b has; 1 if a is empty or equals b."""
    if not a.total or (a.digest and a.digest == b.digest):
        return 1.0
    return len(np.intersect1d(a.hashes, b.hashes, assume_unique=True)) / max(1, len(a.hashes))


def merge(a: Fingerprint, b: Fingerprint, scale: Scale) -> Fingerprint:
    """Fingerprint of the union.  Its hashes are exact; its total is an estimate."""
    union = np.union1d(a.hashes, b.hashes)
    return Fingerprint(max(a.total, b.total, len(union) * scale.one_in), "", union)


_MISSING = -(1 << 63)


def _with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lane, halo, id_key, mark, doc_id, text): rows dealt into lanes by ranges of
    (doc_id, mark), mark being a hash of the text that parts the rows of a doc_id of very
    many; the first row of a lane also stands at the end of the lane before it (the first
    lane follows the last).  One shuffle of the texts; the driver holds a few numbers per
    lane."""
    lanes = partitions(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_MISSING)).alias("id_key"), F.xxhash64(text).alias("mark"),
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
    )
    cuts = keyed.approxQuantile("id_key", [i / lanes for i in range(1, lanes)], 0.2 / lanes) if lanes > 1 else []
    at = np.array(cuts or [0], dtype=np.float64)
    at = np.clip(at, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    ids, times = np.unique(at, return_counts=True)
    # A doc_id that is several cuts holds more rows than a lane: its rows are cut by mark.
    edges = [(int(i), -(1 << 63) + ((j + 1) << 64) // (int(n) + 1) if n > 1 else (1 << 63) - 1) for i, n in zip(ids, times, strict=True) for j in range(int(n))]
    edge_ids, edge_marks = np.array([e[0] for e in edges], dtype=np.int64), np.array([e[1] for e in edges], dtype=np.int64)

    def own_lane(of: np.ndarray, mark: np.ndarray) -> np.ndarray:
        below = np.searchsorted(edge_ids, of, side="left")
        for i in ids[times > 1]:
            rows = np.flatnonzero(of == i)
            below[rows] += np.searchsorted(edge_marks[edge_ids == i], mark[rows], side="left")
        return len(edges) - below

    lane_of = F.pandas_udf(lambda of, mark: pd.Series(own_lane(of.to_numpy(), mark.to_numpy())), "long")
    tops = {
        r["lane"]: (r["top"]["id_key"], r["top"]["mark"])
        for r in keyed.groupBy(lane_of("id_key", "mark").alias("lane")).agg(F.max(F.struct("id_key", "mark")).alias("top")).collect()
    }
    used = sorted(tops)
    heads = {tops[lane]: used[i - 1] for i, lane in enumerate(used)}

    def places(of: pd.Series, mark: pd.Series) -> pd.Series:
        own = own_lane(of.to_numpy(), mark.to_numpy()).tolist()
        rows = zip(of.tolist(), mark.tolist(), own, strict=True)
        return pd.Series([[2 * x] + ([2 * heads[i, m] + 1] if (i, m) in heads else []) for i, m, x in rows])

    dealt = keyed.withColumn("place", F.explode(F.pandas_udf(places, "array<long>")("id_key", "mark")))
    lane = F.shiftright("place", 1).cast("int")
    return dealt.select(lane.alias("lane"), (F.col("place") % 2).alias("halo"), "id_key", "mark", "doc_id", "text"), len(edges) + 1


def with_neighbour(docs: DataFrame, each, schema: pa.Schema, ddl: str) -> DataFrame:
    """each(doc_id, text, state, next_text) for every document and the one that follows
    it in descending doc_id (after the last: the first), streamed in that order; each
    returns (row, state of the next text), so that a text is worked on once."""
    dealt, lanes = _with_next(docs)
    names = ["lane", "halo", "doc_id", "text"]
    order = ["lane", "halo", F.desc("id_key"), F.desc("mark"), "text"]

    def run(batches):
        def rows() -> Iterator[tuple]:
            held, at, state, closed = None, None, None, False
            for lane, halo, doc_id, text in arrow_rows(batches, *names):
                if lane != at:
                    held, at, state, closed = None, lane, None, False
                if held is not None and not closed:
                    row, state = each(*held, state, text)
                    yield row
                held, closed = (doc_id, text), closed or bool(halo)

        return arrow_batches(rows(), schema, limit=500)

    return dealt.repartitionById(lanes, F.col("lane")).sortWithinPartitions(*order).select(*names).mapInArrow(run, ddl)


def fingerprint_edits(docs: DataFrame, scale: Scale = Scale()) -> DataFrame:  # noqa: B008
    """Fingerprints of every document and of an edited text of it.

    The edited text has its last floor(n / 3) code points replaced by the first as many
    (or all) of the next document in descending doc_id.  Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty.  Null doc_ids order last; rows repeating a doc_id follow
    each other in the order of a hash of their texts.  A lone document is its own successor.  Other columns are
    ignored, and an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def each(doc_id, text, mine, following):
        mine = mine or fingerprint(text, scale)
        theirs = fingerprint(following, scale)
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        after = fingerprint(edited, scale)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        row = doc_id, len(text), digest, str(mine), str(after), likeness(mine, after), likeness(mine, theirs)
        return row, theirs

    return with_neighbour(
        docs, each, schema,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
