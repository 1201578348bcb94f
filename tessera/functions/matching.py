"""Fuzzy identifier ranks, as column expressions over arrays of words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import ascii_lower, col

#: Rank of what does not match.
NONE = 1_000_000


def words_of(identifier: str) -> list[str]:
    """Words of one identifier on the driver; the twin of identifier_words."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", identifier)
    return [w.lower() for w in re.split(r"[^A-Za-z0-9]+", spaced) if w]


def identifier_words(c: Column | str) -> Column:
    """Lower-cased words: breaks at signs and where a capital follows a-z or 0-9."""
    spaced = F.regexp_replace(col(c), "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(ascii_lower(spaced), "[^a-z0-9]+"), lambda w: w != "")


def match_rank(candidate: Column | str, prefix: str) -> Column:
    """How well an identifier completes a prefix; smaller is better, NONE is no match.

    0 starts with it; 1 its joined words do; 2 + i word i does; 10 + i the words joined
    from word i do; 20 + r its words match those of the prefix in order (r: ten per word
    skipped before, one per word skipped between); 40 + position as a substring; 80 or
    100 + position as start or substring of the letters and digits alone.  A prefix of
    several words needs its first to start the candidate's first for the tail, ordered
    and substring tiers.
    """
    if not prefix:
        return F.lit(0)
    low, parts = prefix.lower(), words_of(prefix)
    name = ascii_lower(candidate)
    words = identifier_words(candidate)
    count = F.size(words)
    joined_from = lambda i: F.array_join(F.slice(words, i + 1, F.size(words)), "")
    starts = F.transform(words, lambda w, i: F.when(w.startswith(low), i))
    tails = F.transform(words, lambda w, i: F.when(joined_from(i).startswith(low), i))
    anchored = F.lit(True) if len(parts) < 2 else F.coalesce(F.try_element_at(words, F.lit(1)).startswith(parts[0]), F.lit(False))

    rank = F.when(name.startswith(low), F.lit(0))
    rank = rank.when((count > 0) & F.array_join(words, "").startswith(low), F.lit(1))
    rank = rank.when(F.array_min(starts).isNotNull(), F.array_min(starts) + 2)
    rank = rank.when(anchored & F.array_min(tails).isNotNull(), F.array_min(tails) + 10)
    if len(parts) >= 2:
        rank = rank.when(anchored & _ordered(words, parts).isNotNull(), _ordered(words, parts) + 20).when(~anchored, F.lit(NONE))
    rank = rank.when(F.instr(name, low) > 0, F.instr(name, low) + 39)
    compact = re.sub("[^a-z0-9]", "", low)
    if compact:
        letters = F.regexp_replace(name, "[^a-z0-9]", "")
        rank = rank.when(letters.startswith(compact), F.lit(80)).when(F.instr(letters, compact) > 0, F.instr(letters, compact) + 99)
    return rank.otherwise(F.lit(NONE)).cast("int")


def _ordered(words: Column, parts: list[str]) -> Column:
    """Least 10 * start + gaps over the starts from which the parts match greedily."""

    def next_match(part: str, at: Column) -> Column:
        return F.array_min(F.transform(words, lambda w, i: F.when((i > at) & w.startswith(part), i)))

    def from_start(word: Column, start: Column) -> Column:
        # Index of the last matched word (null once a part fails) and gaps so far.
        at, gaps = start, F.lit(0)
        for part in parts[1:]:
            found = next_match(part, at)
            gaps = gaps + found - at - 1
            at = found
        return F.when(word.startswith(parts[0]), start * 10 + gaps)

    return F.array_min(F.transform(words, from_start))


def score_offset(rank: Column) -> Column:
    return F.when(rank == 0, 24).when(rank == 1, 18).when(rank < 20, 10).when(rank < 40, 2).when(rank < 80, -8).otherwise(-14)


def sort_text(bucket: Column, kind: Column, label: Column | str) -> Column:
    """String sort key: both numbers padded to four digits (wider ones stay wider)."""
    return F.format_string("%04d_%04d_%s", bucket.cast("int"), kind.cast("int"), ascii_lower(label))
