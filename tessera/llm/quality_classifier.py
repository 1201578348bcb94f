"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged
per document, with a softmax over two classes, trained by numpy stochastic gradient
descent.

The score is linear in the average until the softmax, so after training each bucket
shrinks to one number, its share in the logit; a document is then scored in a few numpy
passes over its bytes, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows
from tessera.llm.textkit import mix64, window_hashes, word_hashes
from tessera.plans.storage import shared_table

#: At most so many labelled documents are learned from; the smallest hashes of doc_id win.
TRAIN_ROWS = 3000
#: And of these as many, in that order, as fit into so many bytes on the driver.
TRAIN_BYTES = 64 << 20
#: Training features lie in arrays of so many numbers: ones of that size go back to the
#: system when training ends, thousands of small ones would stay with the driver.
CHUNK = 1 << 23
FOLDS, HELD_OUT = 3, 1
_SIZES = (3, 4, 5)
_SPACES = np.array([b in (0x20, *range(0x09, 0x0E)) for b in range(256)])


@dataclass(frozen=True)
class Shape:
    bits: int = 16
    width: int = 16
    epochs: int = 6
    rate: float = 0.4
    seed: int = 7

    @property
    def buckets(self) -> int:
        """Words, word pairs and character n-grams have a table of 2^bits rows each."""
        return 3 << self.bits


def features(raw: bytes, bits: int) -> np.ndarray:
    """Bucket of every word, word pair and character n-gram of a UTF-8 text."""
    words = word_hashes(raw)
    if not len(words):
        return np.empty(0, dtype=np.int32)
    shift = np.uint64(64 - bits)
    pairs = (window_hashes(words, 2) >> shift).astype(np.int32)
    pairs[words[1:] == words[:-1]] = 0  # a word repeated at once: one pair, whatever the word
    out = [(words >> shift).astype(np.int32), pairs + (1 << bits)]
    data = np.frombuffer(b" " + raw + b" ", dtype=np.uint8)
    blank = _SPACES[data]
    codes = np.where(blank, 0x20, data).astype(np.uint64) + np.uint64(1)
    crossed = np.concatenate([[0], np.cumsum(blank)])
    for n in _SIZES:
        starts = len(data) - n + 1
        if starts <= 0:
            continue
        value = np.full(starts, n, dtype=np.uint64)
        for i in range(n):
            value = value * np.uint64(0x100000001B3) + codes[i : starts + i]
        whole = crossed[n - 1 : starts + n - 1] == crossed[1 : starts + 1]  # no blank but at the ends
        out.append((mix64(value[whole]) >> shift).astype(np.int32) + (2 << bits))
    return np.concatenate(out)


@dataclass(frozen=True)
class Classifier:
    shares: np.ndarray
    bias: float
    bits: int

    def score(self, raw: bytes) -> float:
        """Probability of class 1; a text without words gets that of the bias."""
        got = features(raw, self.bits)
        logit = self.bias + (float(self.shares[got].mean()) if len(got) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def train(texts: list[bytes], labels: list[int], shape: Shape = Shape()) -> Classifier:  # noqa: B008
    """Plain SGD, one document a step, learning rate falling to zero; repeatable.

    Classes weigh the same in total, up to a factor of three.  Without rows of both
    classes, scores are the share of class 1 (0.5 without rows).
    """
    y = np.array(labels, dtype=np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        return Classifier(np.zeros(shape.buckets, np.float32), float(np.log(share / (1 - share))), shape.bits)
    rng = np.random.default_rng(shape.seed)
    vectors = rng.uniform(-1, 1, (shape.buckets, shape.width)).astype(np.float32) / shape.width
    output = np.zeros((shape.width, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    docs, buckets, parts, end = [], np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32), 0
    for raw in texts:
        bucket, count = np.unique(features(raw, shape.bits), return_counts=True)
        start, end = end, end + len(bucket)
        if end > len(buckets):
            room = max(CHUNK, len(bucket))
            buckets, parts, start, end = np.empty(room, dtype=np.int32), np.empty(room, dtype=np.float32), 0, len(bucket)
        buckets[start:end], parts[start:end] = bucket, count / max(1, count.sum())
        docs.append((buckets[start:end], parts[start:end]))
    rare = 1 / max(min(np.mean(y == 0), np.mean(y == 1)), 1e-9)
    weight = np.where(y == (np.mean(y) < 0.5), min(3.0, rare / 2), 1.0)
    steps, at = shape.epochs * len(docs), 0
    for _ in range(shape.epochs):
        for i in rng.permutation(len(docs)):
            bucket, part = docs[i]
            rate = shape.rate * weight[i] * (1 - at / steps)
            at += 1
            hidden = part @ vectors[bucket]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            vectors[bucket] -= rate * np.outer(part * np.float32(min(len(part), 50)), back)
    return Classifier((vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]), shape.bits)


def fold(doc_id):
    """crc32 of the decimal text of doc_id, modulo FOLDS; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, limit: int, most_bytes: int = TRAIN_BYTES) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most `limit` labelled documents outside the held-out fold, in
    order of the hash of doc_id, as far as their texts take at most `most_bytes` together
    (one that does not fit is passed over).  Of rows repeating a doc_id, the smallest text
    counts.  The driver holds these texts alone."""
    usable = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(target).cast("int").alias("__y"))
    usable = usable.where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & (fold(F.col("__id")) != HELD_OUT))
    usable = usable.groupBy("__id").agg(F.min("__y").alias("__y"))
    chosen = usable.orderBy(F.xxhash64("__id"), "__id").limit(limit).collect()
    wanted = {r["__id"]: r["__y"] for r in chosen}
    if not wanted:
        return [], []
    ids = docs.sparkSession.createDataFrame([(i,) for i in wanted], "__id long")
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("__raw"))
    held = shared_table(texts.join(F.broadcast(ids), "__id").groupBy("__id").agg(F.min("__raw").alias("__raw")), "training")
    sizes = {r["__id"]: r["n"] for r in held.select("__id", F.octet_length("__raw").alias("n")).collect()}
    fits, left = [], most_bytes
    for i in wanted:
        if i in sizes and sizes[i] <= left:
            fits.append(i)
            left -= sizes[i]
    got = {r["__id"]: bytes(r["__raw"]) for r in held.where(F.col("__id").isin(fits)).collect()}
    order = sorted(fits)
    return [got[i] for i in order], [wanted[i] for i in order]


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every whole text.

    Learns labels.quality from at most train_rows labelled rows, none from the held-out
    fold; labels, lang, source and doc_id are no inputs of a score.  Null texts count as
    empty and score the bias alone.  Labels that are null or not 0/1 are ignored; where
    a doc_id has several, the smallest counts.  Without usable labels every score is
    0.5.  Rows repeating a doc_id are scored each; an empty table gives an empty result.
    """
    model = train(*training_rows(docs, labels, "quality", train_rows))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, raw in source:
            yield doc_id, model.score(raw or b"")

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scored = map_rows(picked, rows, ["doc_id", "text"], schema, "doc_id long, score double")
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, whose score is 0.5 or more.

    Null and empty texts are judged by the bias alone; rows repeating a doc_id each by
    their own text.  Without usable labels all rows stay; an empty table stays empty.
    """
    model = train(*training_rows(docs, labels, "quality", train_rows))

    at = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(at).cast(pa.binary())
            yield batch.filter(pa.array([model.score(x.as_py() or b"") >= 0.5 for x in raws], pa.bool_()))

    return docs.mapInArrow(good, docs.schema)
