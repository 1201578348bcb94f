"""Best-fit packing of tokenised documents into fixed-length sequences.

Packing looks only at the histogram of piece lengths, which has at most `capacity`
entries whatever the corpus: one plan row says "m sequences of lengths l1, l2, ...".
The plan is made on the driver by exact-complement hashing; pieces are then ranked
within their length and read their place off the plan in parallel.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, partitions
from tessera.plans.storage import shared_table

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies, and the byte each stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """Ids of a byte-level BPE file, as the tokenizers library gives them.

    Added tokens are found in the text first, as that library does; the text between
    goes through tiktoken with the same vocabulary, several times as fast.  What
    tiktoken cannot take (very long runs of white space) goes to the library itself.
    """

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.path = path
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added
        }
        self.fast = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        names = sorted(self.added, key=len, reverse=True)
        self.find = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def ids(self, text: str) -> np.ndarray:
        if self.find is None or not any(name in text for name in self.added):
            return self._plain(text)
        parts = [
            np.array([self.added[x]], dtype=np.uint32) if i % 2 else self._plain(x)
            for i, x in enumerate(self.find.split(text))
        ]
        return np.concatenate(parts)

    def _plain(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as failed:
            if isinstance(failed, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(self.path)
            slow.encode_special_tokens = True
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def tokenized_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces.

    A document is its ids and then end_id.  One longer than capacity is cut so that all
    pieces but the first have exactly capacity ids.  Null texts count as empty.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        tokenizer = ByteTokenizer(vocabulary)
        tail = np.array([end_id], dtype="<u4")
        for doc_id, text in source:
            ids = np.concatenate([tokenizer.ids(text or "").astype("<u4"), tail])
            first = len(ids) % capacity or capacity
            ends = range(first, len(ids) + 1, capacity)
            for piece, end in enumerate(ends):
                start = max(0, end - capacity) if piece else 0
                yield doc_id, piece, start, end - start, zlib.crc32(ids[start:end])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(picked, rows, ["doc_id", "text"], schema, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Sums:
    """Index of the sums of one, two and three available lengths up to the capacity.

    A single length is its own sum.  pairs[s] holds the larger part of every pair of sum
    s, triples[s] the largest part of every triple of sum s, whose rest is a pair of the
    index.  Entries are made once; `left` tells which still are available, and how often.
    """

    def __init__(self, left: np.ndarray) -> None:
        self.left = left
        have = np.flatnonzero(left)
        have = have[have > 0]
        self.pairs: list[np.ndarray] = [have[:0]] * len(left)
        self.triples: list[np.ndarray] = [have[:0]] * len(left)
        for s in range(2, len(left)):
            big = have[(2 * have >= s) & (have < s)][::-1]
            self.pairs[s] = big[left[s - big] > 0]
        some = np.array([len(p) > 0 for p in self.pairs])
        for s in range(3, len(left)):
            big = have[(3 * have >= s) & (have < s - 1)][::-1]
            self.triples[s] = big[some[s - big]]

    def pair(self, s: int, most: int) -> tuple[int, ...]:
        """An available pair of sum s, no part above `most`."""
        big = self.pairs[s]
        ok = big[(big <= most) & (self.left[big] > 0) & (self.left[s - big] > (2 * big == s))]
        return (int(ok[0]), s - int(ok[0])) if len(ok) else ()

    def exact(self, gap: int) -> tuple[int, ...]:
        """One to three available lengths that fill the gap exactly; () if none do."""
        if self.left[gap]:
            return (gap,)
        if found := self.pair(gap, gap):
            return found
        for a in self.triples[gap].tolist():
            if self.left[a]:
                self.left[a] -= 1
                rest = self.pair(gap - a, a)
                self.left[a] += 1
                if rest:
                    return (a, *rest)
        return ()


Row = tuple[int, tuple[int, ...]]


def _take(left: np.ndarray, chosen: list[int]) -> Row:
    """Use a combination as often as there are pieces for it."""
    used = {x: chosen.count(x) for x in set(chosen)}
    times = min(int(left[x]) // n for x, n in used.items())
    for x, n in used.items():
        left[x] -= times * n
    return times, tuple(chosen)


def _exact_rows(left: np.ndarray, sums: _Sums) -> list[Row]:
    """Full sequences, from the longest length down; `left` keeps what has no complement."""
    out, capacity = [], len(left) - 1
    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1
            exact = sums.exact(capacity - length) if length < capacity else ()
            left[length] += 1
            if not exact and length < capacity:
                break
            out.append(_take(left, [length, *exact]))
    return out


def _residual_rows(left: np.ndarray, sums: _Sums) -> list[Row]:
    """The rest by best fit: the longest length that fits goes in until none does, or an
    exact complement closes the gap."""
    out, capacity = [], len(left) - 1
    for length in range(capacity, 0, -1):
        while left[length]:
            chosen, gap, before = [length], capacity - length, left.copy()
            left[length] -= 1
            while gap:
                more = sums.exact(gap) or tuple(np.flatnonzero(left[: gap + 1])[-1:].tolist())
                if not more or not more[0]:
                    break
                chosen += more
                for x in more:
                    left[x] -= 1
                gap -= sum(more)
            left[:] = before
            out.append(_take(left, chosen))
    return out


def pack_plan(counts: dict[int, int], capacity: int) -> list[Row]:
    """Rows (m, lengths): m sequences, each holding pieces of these lengths.

    First, gaps are filled by exact complements of one, two or three available lengths, as
    often as availability allows; what has none is packed by best fit.  Exact sequences
    may have used up the short pieces that the rest would need, so those of the shortest
    pieces (a growing share of them, up to all) are tried again together with the rest,
    and the smallest outcome counts.  A row stands for many sequences, so the rows follow
    the number of lengths, not of pieces.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    sums = _Sums(left)
    exact = sorted(_exact_rows(left, sums), key=lambda r: (max(r[1]), r[1]))
    rest, best, size = left.copy(), None, 0
    full = sum(m for m, _ in exact)
    for share in (0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1):
        left[:] = rest
        kept, undone = [], 0
        for m, lengths in exact:
            if undone < share * full:
                undone += m
                for x in lengths:
                    left[x] += m
            else:
                kept.append((m, lengths))
        plan = kept + _residual_rows(left, sums)
        used = sum(m for m, _ in plan)
        if best is None or used < size:
            best, size = plan, used
    return best


def _places(plan: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of equal slots."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, lengths in plan:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((taken.get(x, 0), sequence, offset))
            taken[x] = taken.get(x, 0) + times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def _ranked(pieces: DataFrame) -> DataFrame:
    """pieces with `rank`, 0, 1, ... within each length.  Lengths are salted: a length
    that holds most pieces is ranked in many groups, whose sizes give each its base."""
    salts = 4 * partitions(pieces.sparkSession)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("inner_rank", F.row_number().over(inside) - 1)
    return ranked.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("inner_rank")).drop("salt", "base", "inner_rank")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with doc_id, piece, length."""
    pieces = shared_table(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(pack_plan(counts, capacity))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, base, where = places[int(x)]
                run = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[run] + rank[at] - first[run]
                offset[at] = where[run]
            kept = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], schema=schema)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return _ranked(pieces).select(*names, "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Tokenises and packs documents: per piece doc_id, piece, start, length, ids_crc32,
    sequence_id and offset (gapless from 0 in each sequence).

    Null and empty texts are one piece holding end_id alone.  Rows repeating a doc_id
    are documents of their own; a null doc_id stays null.  Other columns are ignored,
    and an empty table gives an empty result.
    """
    return pack(tokenized_pieces(docs, vocabulary, end_id, capacity), capacity)
