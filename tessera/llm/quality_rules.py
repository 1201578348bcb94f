"""Quality rules judged by an isolation forest.

Rule statistics of a text (lengths, symbol, repetition and case shares), as they are,
place it in a space where junk lies apart; random splits isolate such points after few
cuts.  Each tree draws its rows from all labelled ones, as the method has it, and the
path-length threshold is the one that best separates the labels of all of them while it
rejects few good ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_rows
from tessera.llm.quality_classifier import HELD_OUT, fold
from tessera.llm.textkit import mix64, window_hashes, word_bounds, word_hashes
from tessera.plans.storage import shared_table

TREES, SAMPLE, SEED = 200, 256, 11
#: Labelled rows are numbered within so many parts; scores are counted in so many bins.
PARTS, BINS = 4096, 4096
#: Of good labelled rows, at most this share may fall under the threshold.
GOOD_LOSS = 0.005
#: Share of bad labelled rows in a tree's sample: kept small, as a forest isolates what is
#: rare, whatever the share of junk in the corpus.
BAD_SHARE = 0.02
_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_PUNCT = np.array([33 <= b <= 126 and not chr(b).isalnum() for b in range(256)])
_WHITE = bytes([0x20, *range(0x09, 0x0E)])


@dataclass(frozen=True)
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    #: Symbols, capitals, digits and punctuation per character in words; lines that repeat,
    #: words in repeated windows and words ending in punctuation, as shares; characters a
    #: word; distinct words against words to the power 0.85, as vocabulary grows.
    rates: tuple[float, ...]

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def _repeated(words: np.ndarray) -> int:
    """Words lying in a 3-word window that occurs twice or more."""
    windows = window_hashes(words, 3)
    if not len(windows):
        return 0
    _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    covered = np.zeros(len(words), dtype=bool)
    for i in range(3):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def count(raw: bytes) -> Counts:
    data, start, end = word_bounds(raw)
    words = word_hashes(raw)
    lead = np.concatenate([[0], np.cumsum(_LEAD[data])])
    chars = int((lead[end] - lead[start]).sum())
    lines = [line for line in raw.split(b"\n") if line.strip(_WHITE)]
    dup = len(lines) - len(set(lines))
    symbols, repeated = int(_SYMBOL[data].sum()), _repeated(words)
    n = len(words)
    per = max(1, chars)
    closed = int(_PUNCT[data[end - 1]].sum()) if n else 0
    rates = (
        symbols / per, dup / max(1, len(lines)), repeated / max(1, n), int(_UPPER[data].sum()) / per, int(_DIGIT[data].sum()) / per,
        int(_PUNCT[data].sum()) / per, chars / max(1, n), closed / max(1, n), len(np.unique(words)) / max(1, n) ** 0.85,
    )
    return Counts(n, chars, symbols, dup, repeated, rates)


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray
    child: np.ndarray  # of the two children, the first
    depth: np.ndarray  # at a leaf: its path length, with the mean of what it still holds


def _mean_path(n: int) -> float:
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> Tree:
    feature, cut, child, depth = [], [], [], []
    queue = [(points, 0)]
    at = 0
    while at < len(queue):
        here, level = queue[at]
        at += 1
        low, high = (here.min(axis=0), here.max(axis=0)) if len(here) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if level >= limit or len(here) < 2 or not len(open_):
            feature.append(-1), cut.append(0.0), child.append(0), depth.append(level + _mean_path(len(here)))
            continue
        f = int(rng.choice(open_))
        c = float(rng.uniform(low[f], high[f]))
        feature.append(f), cut.append(c), child.append(len(queue)), depth.append(0.0)
        left = here[:, f] < c
        queue += [(here[left], level + 1), (here[~left], level + 1)]
    return Tree(np.array(feature), np.array(cut), np.array(child), np.array(depth))


@dataclass(frozen=True)
class Forest:
    trees: tuple[Tree, ...]
    sample: int
    threshold: float

    def anomaly(self, points: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path) by point: near 1 for what is isolated at once."""
        total = np.zeros(len(points))
        for t in self.trees:
            at = np.zeros(len(points), dtype=np.int64)
            while (inner := t.feature[at] >= 0).any():
                f = np.where(inner, t.feature[at], 0)
                right = points[np.arange(len(points)), f] >= t.cut[at]
                at = np.where(inner, t.child[at] + right, at)
            total += t.depth[at]
        return 2.0 ** (-total / (len(self.trees) * max(_mean_path(self.sample), 1e-9)))


def draws(good: int, bad: int, rng: np.random.Generator, trees: int = TREES, sample: int = SAMPLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree, numbers of the good and of the bad rows that it is grown on."""
    few = max(1, round(BAD_SHARE * sample))
    return [(rng.choice(good, sample - few), rng.choice(bad, few)) for _ in range(trees)]


def plant(points_of: list[np.ndarray], rng: np.random.Generator, sample: int = SAMPLE) -> Forest:
    """A forest, still without a threshold, of a tree for each set of points."""
    limit = math.ceil(math.log2(max(2, sample))) + 2
    return Forest(tuple(grow(p, rng, limit) for p in points_of), sample, math.inf)


def allowed_loss(good: int) -> int:
    """How many of so many good rows may be rejected."""
    return int(GOOD_LOSS * good)


def fit(points: np.ndarray, labels: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """A forest with its threshold: the score above which rows are rejected, the best of
    those that reject at most GOOD_LOSS of the good rows.  Without rows of both classes
    nothing is rejected."""
    if len(set(labels.tolist())) < 2:
        return Forest((), sample, math.inf)
    good_rows, bad_rows = points[labels == 1], points[labels == 0]
    rng = np.random.default_rng(seed)
    drawn = draws(len(good_rows), len(bad_rows), rng, trees, sample)
    forest = plant([np.concatenate([good_rows[g], bad_rows[b]]) for g, b in drawn], rng, sample)
    score = forest.anomaly(points)
    good = np.sort(score[labels == 1])
    allowed = good[len(good) - 1 - allowed_loss(len(good))]
    bad = score[(labels == 0) & (score > allowed)]
    return replace(forest, threshold=float((allowed + bad.min()) / 2) if len(bad) else math.inf)


def fit_table(learned: DataFrame) -> Forest:
    """The forest, without its threshold, of learned(doc_id, y, rates), whatever its size:
    as `fit` draws them, with rows numbered by class in order of their hash.  The driver
    holds the rows drawn, at most TREES * SAMPLE, and the sizes of the parts."""
    rows = learned.withColumn("h", F.xxhash64("doc_id", "rates")).withColumn("part", F.shiftrightunsigned("h", 64 - int(math.log2(PARTS))).cast("int"))
    counts = np.zeros((2, PARTS), dtype=np.int64)
    for r in rows.groupBy("y", "part").count().collect():
        counts[r["y"], r["part"]] = r["count"]
    total = counts.sum(axis=1)
    if not total.all():
        return Forest((), SAMPLE, math.inf)
    rng = np.random.default_rng(SEED)
    drawn = draws(int(total[1]), int(total[0]), rng)
    wanted = []
    for y, at in ((1, 0), (0, 1)):
        numbers, ends = np.unique(np.concatenate([d[at] for d in drawn])), np.cumsum(counts[y])
        part = np.searchsorted(ends, numbers, side="right")
        wanted += zip([y] * len(numbers), part.tolist(), (numbers - ends[part] + counts[y, part] + 1).tolist(), numbers.tolist(), strict=True)
    asked = F.broadcast(learned.sparkSession.createDataFrame(wanted, "y int, part int, place int, number long"))
    place = F.row_number().over(Window.partitionBy("y", "part").orderBy("h", "doc_id", "rates"))
    got = {(r["y"], r["number"]): r["rates"] for r in rows.withColumn("place", place).join(asked, ["y", "part", "place"]).select("y", "number", "rates").collect()}
    points = [np.array([got[1, n] for n in g.tolist()] + [got[0, n] for n in b.tolist()]) for g, b in drawn]
    return plant(points, rng)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = BINS) -> float:
    """The k-th largest number (from 1) of a column of at least k, exactly: counts by bin,
    then by bin of the bin that holds it, until that holds one value alone."""
    x = F.col(column)
    low, high = df.agg(F.min(x), F.max(x)).first()
    while low < high:
        bin_ = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
        found = df.where(x.between(low, high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r["bin"]):
            if r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    anomaly and kept of every whole text.

    base_failed: fewer than 50 words, or more than half the words in repeated 3-word
    windows.  kept: not base_failed, and no anomaly above the calibrated threshold.  The
    forest draws from all labelled rows that pass the base rules, and all of these set
    the threshold; those of the classifier's held-out fold are left for measuring.  Null
    texts have no words and fail.  Labels that are null or not 0/1 are ignored; where a
    doc_id has several, the smallest counts.  Without usable labels of both kinds the
    base rules decide alone.  Rows repeating a doc_id are judged and learned from each;
    an empty table gives an empty result.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("rates", pa.list_(pa.float64()))])
    ddl = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean"

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, raw in source:
            c = count(raw or b"")
            yield doc_id, c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.base_failed, c.rates

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = map_rows(picked, rows, ["doc_id", "text"], schema, f"{ddl}, rates array<double>")
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT)).groupBy("doc_id").agg(F.min("y").alias("y"))
    points = shared_table(counted.join(usable, "doc_id", "left"), "points")
    forest = fit_table(points.where("y is not null and not base_failed").select("doc_id", "y", "rates"))
    if not forest.trees:
        return points.select("doc_id", *names, "base_failed", F.lit(0.0).alias("anomaly"), (~F.col("base_failed")).alias("kept"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = forest.anomaly(part.column("rates").flatten().to_numpy().reshape(part.num_rows, -1))
                kept = part.drop_columns(["rates"])
                yield pa.record_batch([*kept.columns, pa.array(scores, pa.float64())], names=[*kept.schema.names, "anomaly"])

    scored = shared_table(points.select("doc_id", *names, "base_failed", "y", "rates").mapInArrow(score, f"{ddl}, y int, anomaly double"), "scored")
    learned = scored.where("y is not null and not base_failed")
    good, bad = learned.where("y = 1"), learned.where("y = 0")
    allowed = kth_largest(good, "anomaly", 1 + allowed_loss(good.count()))
    above = bad.where(F.col("anomaly") > allowed).agg(F.min("anomaly")).first()[0]
    kept = ~F.col("base_failed") & (F.col("anomaly") <= F.lit(math.inf if above is None else (allowed + above) / 2))
    return scored.select("doc_id", *names, "base_failed", "anomaly", kept.alias("kept"))
