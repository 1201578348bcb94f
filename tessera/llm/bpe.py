"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged
across, so a word may be cut there, its fragments encoded independently and the ids
concatenated.  Fragments and words repeat, so both are remembered in bounded caches.

The vocabulary file fixes the rest: added tokens are found first, the text between them
is normalised (NFC, lower case) and split into words, words become bytes, and the last
symbol of a word carries the end-of-word mark.  The pipeline parts read from the file
are checked, so that a file of another kind is refused rather than encoded wrongly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows
from tessera.llm.packing import byte_alphabet

#: Code points on whose classes all Unicode versions in use agree; texts with others
#: are normalised and split by the tokenizers library itself.
_SETTLED = regex.compile(r"[\u0000-՗ա-ֆא-תء-يऄ-हก-ะḀ-ỿ‐-⁞€℀-⅏←-⏿─-➿぀-ゔァ-ヺ一-龥가-힣！-～\U0001F300-\U0001F64F]*+")


class _Recent:
    """Bounded memory of a function: two generations of at most `limit` entries; what is
    used again moves to the young one, the old one goes when that is full.  Keys whose
    length (by `size`) exceeds 64 are not kept, so that the bytes held are bounded too."""

    def __init__(self, make: Callable, limit: int, size: Callable = len) -> None:
        self.make, self.limit, self.size = make, limit, size
        self.young: dict = {}
        self.old: dict = {}

    def one(self, key):
        known = self.young.get(key)
        if known is None:
            known = self.old.get(key)
            if known is None:
                known = self.make(key)
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            if self.size(key) <= 64:
                self.young[key] = known
        return known

    def all(self, keys: list) -> list:
        found = list(map(self.young.get, keys))
        if None in found:
            found = [self.one(k) if v is None else v for k, v in zip(keys, found, strict=True)]
        return found


class WordBpe:
    """Encoder and decoder of a word-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str, cache: int = 100_000) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError(f"{path}: not a word-level BPE file of the expected kind")
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.added.items()})
        ids = self.vocab
        self.merges = {
            (ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        }
        symbol = {b: c for c, b in byte_alphabet().items()}
        self.plain = [ids[symbol[b]] for b in range(256)]
        self.final = [ids[symbol[b] + self.suffix] for b in range(256)]
        self.inside = self._inside(symbol)
        self.split = regex.compile(splits[0]["pattern"]["Regex"])
        self.find_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.words = _Recent(self.word, cache)
        self.fragments = _Recent(self._fragment, cache, lambda key: len(key[0]))

    def _inside(self, symbol: dict[int, str]) -> bytearray:
        """1 for each pair of bytes (256 * first + second) inside some token."""
        back = {c: b for b, c in symbol.items()}
        out = bytearray(1 << 16)
        for token in self.vocab:
            if token in self.added:
                continue
            raw = [back[c] for c in token.removesuffix(self.suffix)]
            for a, b in zip(raw, raw[1:], strict=False):
                out[a << 8 | b] = 1
        return out

    def words_of(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if _SETTLED.fullmatch(text):
            plain = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
            return self.split.findall(plain.lower())
        back = byte_alphabet()
        parts = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(back[c] for c in part).decode("utf-8", "surrogateescape") for part, _ in parts]

    def runs(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Words between added tokens, each run with the token before it (None at first)."""
        parts = self.find_added.split(text) if any(name in text for name in self.added) else [text]
        yield self.words_of(parts[0]), None
        for token, part in zip(parts[1::2], parts[2::2], strict=True):
            yield self.words_of(part), self.added[token]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for words, special in self.runs(text):
            if special is not None:
                out.append(special)
            for ids in self.words.all(words):
                out += ids
        return out

    def shown(self, ids: tuple[int, ...]) -> tuple[str, str]:
        """Decimal ids and decoded text, both joined by spaces."""
        return " ".join(map(str, ids)), self.decode(ids)

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogateescape")
        cuts = [i for i in range(1, len(raw)) if not self.inside[raw[i - 1] << 8 | raw[i]]]
        ids: tuple[int, ...] = ()
        for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True):
            ids += self.fragments.one((raw[a:b], b == len(raw))) if len(cuts) else self._fragment((raw, True))
        return ids

    def _fragment(self, key: tuple[bytes, bool]) -> tuple[int, ...]:
        raw, last = key
        ids = [self.plain[b] for b in raw]
        if last:
            ids[-1] = self.final[raw[-1]]
        return tuple(self._merge_few(ids) if len(ids) <= 24 else self._merge_many(ids))

    def _merge_few(self, ids: list[int]) -> list[int]:
        merges, none = self.merges, (1 << 30, 0)
        found = [merges.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none or best[0] == none[0]:
                break
            at = found.index(best)
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = merges.get((ids[at - 1], ids[at]), none)
            if at < len(found):
                found[at] = merges.get((ids[at], ids[at + 1]), none)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        """As _merge_few, in n log n steps: a heap of pairs over a linked list."""
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        alive = [True] * len(ids)
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (m := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = merged, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library decodes without a decoder: tokens joined by one space."""
        return " ".join(self.names[i] for i in ids)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and
    decoded_sha256 (of the decoded text) of every document's whole text.

    Null texts count as empty: no tokens, and the digests of the empty string.  Rows
    repeating a doc_id are encoded each; other columns are ignored; an empty table gives
    an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        bpe = WordBpe(vocabulary)
        shown = _Recent(lambda word: bpe.shown(bpe.word(word)), 250_000)
        for doc_id, text in source:
            parts: list[tuple[str, str]] = []
            for word_run, special in bpe.runs(text or ""):
                if special is not None:
                    parts.append(bpe.shown((special,)))
                parts += shown.all(word_run)
            digits = " ".join([p[0] for p in parts])
            names = " ".join([p[1] for p in parts])
            n = digits.count(" ") + 1 if digits else 0
            yield doc_id, n, hashlib.sha256(digits.encode()).hexdigest(), hashlib.sha256(names.encode()).hexdigest()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(picked, rows, ["doc_id", "text"], schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the ids of every document, for use downstream."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        bpe = WordBpe(vocabulary)
        for doc_id, text in source:
            yield doc_id, bpe.encode(text or "")

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(picked, rows, ["doc_id", "text"], schema, "doc_id long, ids array<int>")
