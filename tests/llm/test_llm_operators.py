from __future__ import annotations

import base64
import glob
import hashlib
import json
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, fingerprints, licenses, line_dedup, minhash, packing, pii, quality_classifier, quality_rules, warc
from tessera.llm.registry import QUERIES, vocabulary
from tessera.llm.textkit import mix64, shingle_set, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, clash=False):
    """documents with the given (doc_id, text, source); clash adds columns of the names
    that operators make or use inside."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, DOCS)
    if clash:
        for c in ("node", "sig", "n_lines", "n_removed", "length", "rank", "key", "kept", "score", "spans", "lane", "__z", "name", "raw", "root", "of"):
            df = df.withColumn(c, F.lit("x"))
    return df


def prose(seed, n, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}x{r.randrange(9)}" for _ in range(n))


ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", "b"), (4, "one", None), (5, "one two", "b"), (6, prose(1, 30_000), "c"), (7, "same text here again and again", "a"),
       (7, "same text here again and again", "a"), (8, "same text here again and again", "b"), (None, "null id text with words", "c"), (None, None, None), (9, "Ünïcödé ‑ 一二三 😀 ﬁ", "d"), (10, "\x00 nul \x00", "d")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD, clash=True)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [], clash=True)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, None), (7, None, 0), (7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def all_operators(docs, labels):
    return {
        "op1": fingerprints.fingerprint_edits(docs), "op2": packing.pack_documents(docs, vocabulary("byte_bpe_50k.json")), "op3": minhash.near_duplicates(docs, 3, 85),
        "op4": quality_rules.judge_documents(docs, labels), "op5": bpe.encode_documents(docs, vocabulary("word_bpe_49k.json")), "op6": line_dedup.dedup_lines(docs),
        "op7": pii.scan_documents(docs), "op8": quality_classifier.score_documents(docs, labels), "op10": licenses.scan_licenses(docs),
    }


def test_odd_rows_have_a_result_each(odd, labels):
    for name, df in all_operators(odd, labels).items():
        rows = df.collect()
        if name == "op2":
            assert len({(r.doc_id, r.start, r.ids_crc32, r.sequence_id, r.offset) for r in rows}) == len(rows)
            assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(i for i, *_ in ODD)
        else:
            assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in ODD), name


def test_empty_tables(spark, none, labels):
    for name, df in all_operators(none, labels.limit(0)).items():
        assert df.count() == 0, name
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_no_labels(odd, labels):
    assert {r.score for r in quality_classifier.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert all(r.kept != r.base_failed for r in quality_rules.judge_documents(odd, labels.limit(0)).collect())


# --- text kit ------------------------------------------------------------------------


def test_words_and_shingles_against_plain_python():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("ab \t\n\x0b\x1c\x85é一") for _ in range(r.randrange(60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        got = word_hashes(text.encode())
        assert len(got) == len(words)
        assert len(set(got.tolist())) == len(set(words))
        want = {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else ({tuple(words)} if words else set())
        assert len(shingle_set(text.encode(), 3)) == len(want)


# --- op1 -----------------------------------------------------------------------------


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def test_fingerprints_match_brute_force(spark):
    texts = {i: prose(i, 20 + 37 * i) for i in range(40)} | {40: None, 41: "", 42: "é" * 7}
    rows = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for at, i in enumerate(order):
        own, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + following[:cut]
        assert rows[i].n_chars == len(own)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((rows[i].near_edited, edited), (rows[i].near_next, following)):
            a, b = shingles(own, 5), shingles(other, 5)
            want = len(a & b) / len(a | b) if a | b else 1.0
            # half the shingles of the union are seen: five standard errors
            assert abs(got - want) <= 5 * (want * (1 - want) / max(1, len(a | b))) ** 0.5 + 1e-9
            errors.append(abs(got - want))
    assert sum(errors) / len(errors) < 0.02
    assert len({(rows[i].fingerprint) for i in texts}) == len({texts[i] or "" for i in texts})


def test_fingerprints_keep_what_is_under_the_threshold_alone():
    scale = fingerprints.Scale()
    for n in (1, 4, 5, 6, 40, 700, 5000):
        got = fingerprints.fingerprint(prose(n, n), scale)
        full = np.unique(shingle_set(prose(n, n).encode(), 5) >> np.uint64(16))
        assert got.hashes.tolist() == [h for h in full.tolist() if h < 1 << 47]
    one, two = (fingerprints.fingerprint(t, scale) for t in ("one", "two"))
    assert fingerprints.likeness(one, one) == 1.0 and fingerprints.likeness(one, two) == 0.0
    same = fingerprints.fingerprint("", scale)
    assert fingerprints.likeness(same, fingerprints.fingerprint("  ", scale)) == 1.0 and fingerprints.likeness(same, one) == 0.0


def test_fingerprint_merge_and_containment():
    scale = fingerprints.Scale()
    a, b = prose(1, 900), prose(2, 4000)
    x, y, both = (fingerprints.fingerprint(t, scale) for t in (a, b, a + "\n" + b))
    merged = fingerprints.merge(x, y, scale)
    assert fingerprints.Fingerprint.parse(str(x)).hashes.tolist() == x.hashes.tolist()
    assert fingerprints.Fingerprint.parse(str(merged)) .total == merged.total
    assert fingerprints.likeness(merged, both) > 0.95
    assert fingerprints.containment(x, both) > 0.95 > fingerprints.containment(both, x)


def test_fingerprints_of_a_table_with_one_hot_doc_id(spark):
    rows = [(5 if i % 3 else i, prose(i, 12), "s") for i in range(240)] + [(None, prose(900 + i, 9), "s") for i in range(120)]
    got = fingerprints.fingerprint_edits(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t)) for i, t, _ in rows)
    assert len({r.edited_sha256 for r in got}) == len(rows)


# --- op2 -----------------------------------------------------------------------------


def test_packing_is_whole_exact_and_tight(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = {i: prose(i, (i * 53) % 900) for i in range(60)} | {60: None, 61: "a <|endoftext|> b", 62: prose(9, 3000)}
    rows = packing.pack_documents(frame(spark, [(i, t, "s") for i, t in texts.items()]), vocabulary("byte_bpe_50k.json")).collect()
    by_doc, by_sequence, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and all(p.length == 1024 for p in pieces[1:])
        assert len(pieces) == -(-len(ids) // 1024)
        at = 0
        for p in pieces:
            assert p.start == at
            part = ids[at : at + p.length]
            at += p.length
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_sequence) <= -(-total // 1024) + 1


@pytest.mark.parametrize("n", [1, 30, 3000])
def test_plan_uses_every_piece_once(n):
    r = np.random.default_rng(n)
    counts = Counter(r.integers(1, 65, n).tolist())
    plan = packing.pack_plan(dict(counts), 64)
    used = Counter()
    for times, lengths in plan:
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] += times
    assert used == counts
    gaps: list[int] = []  # plain best fit, longest first
    for length in sorted(counts.elements(), reverse=True):
        fits = [i for i, gap in enumerate(gaps) if gap >= length]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= length
        else:
            gaps.append(64 - length)
    assert sum(t for t, _ in plan) <= len(gaps)


# --- op3 -----------------------------------------------------------------------------


def near_copies():
    r = random.Random(8)
    rows, i = [], 0
    for g in range(25):
        base = prose(g, r.choice([4, 30, 200, 700]), 2000).split()
        for _ in range(r.choice([1, 2, 3, 30])):
            words = list(base)
            for _ in range(r.randrange(max(1, len(words) // 25) + 1)):
                words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
            rows.append((i, (" ".join(words)).upper() if r.random() < 0.1 else " ".join(words), "s"))
            i += 1
    return rows + [(i, None, "s"), (i + 1, "", "s"), (i + 2, "two words", "s"), (i + 3, "Two  words", "s")]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 600_000), (3, 85, 3000), (5, 80, 100_000)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rows = near_copies()
    sets = {i: shingles((t or "").encode().lower().decode(), k) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, rows), k, percent).collect()}
    for i in sets:
        assert got[i].n_shingles == len(sets[i])
        assert got[i].component_id == find(i) and got[i].kept == (find(i) == i)


def test_pigeonhole_keys_meet_every_pair_within_the_distance():
    distance = minhash.distance_threshold(85)
    keys = minhash.index_keys(distance)
    r = random.Random(1)
    for _ in range(500):
        wrong = set(r.sample(range(minhash.POSITIONS), distance))
        assert any(not wrong & set(key) for key in keys)


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + [(500, 500)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {j: 100 for j in range(101, 160)}


def test_components_plan_little_at_once(spark):
    """The driver's memory follows the largest plan of a round."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    runs = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = runs.executionsCount()
    common.components(edges)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = runs.executionsList()
    plans = [seen.apply(i).physicalPlanDescription() for i in range(before, seen.size())]
    scans = [len(re.findall(r"(?m)^\(\d+\) Scan parquet", plan)) for plan in plans]
    assert len(plans) > 2 and 0 < max(scans) <= 20


def test_training_leaves_the_driver_little_memory():
    """Arrays of the training features are few and large, whatever the number of texts."""
    import tracemalloc

    texts = [prose(i, 60, 500).encode() for i in range(300)]
    small, real = [], quality_classifier.features

    def counted(raw, bits):
        small.append(sum(1 for x in tracemalloc.take_snapshot().traces if 1000 < x.size < 1 << 20 and "quality_classifier" in x.traceback[0].filename) if len(small) == 299 else 0)
        return real(raw, bits)

    quality_classifier.features = counted
    tracemalloc.start()
    try:
        quality_classifier.train(texts, [i % 2 for i in range(300)])
    finally:
        tracemalloc.stop()
        quality_classifier.features = real
    assert max(small) < 30


# --- op4, op8 ------------------------------------------------------------------------


def labelled(spark):
    r = random.Random(4)
    rows, marks = [], []
    for i in range(360):
        good = i % 4 > 0
        text = prose(i, 80 + i % 60) if good else " ".join(f"w{r.randrange(400)}###" if i % 8 else f"W{r.randrange(400)}!!" for _ in range(90))
        rows.append((i, text, f"s{i % 5}"))
        marks.append((i, int(good), 0))
    return frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), dict((i, q) for i, q, _ in marks)


def test_classifier_and_rules_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    for r in quality_classifier.score_documents(docs, labels).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out:
            assert r.predicted == truth[r.doc_id]
    judged = quality_rules.judge_documents(docs, labels).collect()
    assert sum(r.kept != bool(truth[r.doc_id]) for r in judged) <= 0.03 * len(judged)
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, q in truth.items() if q}


def test_every_labelled_row_counts_for_the_threshold(spark):
    """Labels that say nothing, so that the threshold falls where rows lie close."""
    r = random.Random(8)
    docs = frame(spark, [(i, prose(i, 50 + i % 90, 30 + i % 300), "s") for i in range(9000)])
    truth = {i: int(r.random() < 0.95) for i in range(9000)}
    judged = quality_rules.judge_documents(docs, spark.createDataFrame([(i, q, 0) for i, q in truth.items()], "doc_id long, quality int, toxic int")).collect()
    learned = [x for x in judged if not x.base_failed and zlib.crc32(str(x.doc_id).encode()) % 3 != 1]
    good = sorted(x.anomaly for x in learned if truth[x.doc_id])
    allowed = good[len(good) - 1 - int(quality_rules.GOOD_LOSS * len(good))]
    threshold = (allowed + min(x.anomaly for x in learned if not truth[x.doc_id] and x.anomaly > allowed)) / 2
    assert len(judged) == 9000 and len(good) > 3000
    assert all(x.kept == (not x.base_failed and x.anomaly <= threshold) for x in judged)


def test_kth_largest_equals_a_sort(spark):
    r = random.Random(4)
    values = [r.choice([r.random(), 0.25, 0.5, 0.5 + 2**-40, r.random() * 1e-9]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 57, 200, 400):
        assert quality_rules.kth_largest(df, "x", k, 8) == sorted(values, reverse=True)[k - 1]


def test_trees_drawn_from_a_table_do_not_depend_on_its_parts(spark):
    r = random.Random(6)
    rows = [(i, int(i % 9 > 0), [r.random() for _ in range(3)]) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, y int, rates array<double>")
    one, two = quality_rules.fit_table(df), quality_rules.fit_table(df.repartition(7))
    at = np.array([p for *_, p in rows])
    assert len(one.trees) == 200 and (one.anomaly(at) == two.anomaly(at)).all()
    assert len({t.cut[0] for t in one.trees}) > 150 and not quality_rules.fit_table(df.where("y = 1")).trees


def slow_score(model, raw, bits):
    """The classifier's forward pass in plain Python: one bucket after the other."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    hashes = [int(word_hashes(w)[0]) for w in words]
    buckets = [h >> (64 - bits) for h in hashes]
    mix = lambda x: int(mix64(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])
    for a, b in zip(hashes, hashes[1:]):
        buckets.append((1 << bits) + (0 if a == b else mix(a * 0xD6E8FEB86659FD93 + b) >> (64 - bits)))
    for n in (3, 4, 5):
        data = b" " + raw + b" "
        for i in range(len(data) - n + 1):
            part = [0x20 if c in b" \t\n\x0b\x0c\r" else c for c in data[i : i + n]]
            if 0x20 not in part[1:-1]:
                value = n
                for c in part:
                    value = (value * 0x100000001B3 + c + 1) & (2**64 - 1)
                buckets.append((2 << bits) + (mix(value) >> (64 - bits)))
    logit = model.bias + (sum(float(model.shares[b]) for b in buckets) / len(buckets) if words else 0)
    return 1 / (1 + math.exp(-logit))


def test_scores_equal_a_plain_forward_pass():
    r = random.Random(21)
    texts = [(prose(i, r.randrange(1, 60)) if i % 3 else " ".join(["junk!!"] * r.randrange(1, 40))).encode() for i in range(60)]
    model = quality_classifier.train(texts, [int(i % 3 > 0) for i in range(60)])
    for raw in [*texts[:25], b"", b"  \n ", "é 一二 \t x".encode(), b"a"]:
        assert abs(model.score(raw) - slow_score(model, raw, model.bits)) < 1e-4


def test_training_falls_to_the_minimum_of_a_plain_loss():
    """On a set that a linear model separates, the loss on it must fall far below chance."""
    texts = [f"good{i % 5} fine words here {i}".encode() if i % 2 else f"bad{i % 5} poor text there {i}".encode() for i in range(200)]
    model = quality_classifier.train(texts, [i % 2 for i in range(200)])
    loss = -sum(math.log(model.score(t) if i % 2 else 1 - model.score(t)) for i, t in enumerate(texts)) / 200
    assert loss < 0.1


def plain_anomaly(forest, point):
    """Isolation score by walking each tree, with the path length of what a leaf holds."""
    mean = lambda n: 0 if n < 2 else 1 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    total = 0.0
    for t in forest.trees:
        at = 0
        while t.feature[at] >= 0:
            at = t.child[at] + (point[t.feature[at]] >= t.cut[at])
        total += t.depth[at]
    return 2 ** (-total / (len(forest.trees) * mean(forest.sample)))


def test_forest_isolates_what_lies_apart_and_keeps_its_threshold():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0, 1, (600, 4)), rng.normal(0, 1, (30, 4)) + [9, 0, 0, 0]
    points, y = np.concatenate([good, bad]), np.array([1] * 600 + [0] * 30)
    forest = quality_rules.fit(points, y)
    score = forest.anomaly(points)
    for i in (0, 5, 605, 629):
        assert abs(score[i] - plain_anomaly(forest, points[i])) < 1e-9
    assert (score[600:] > forest.threshold).mean() >= 0.9 and (score[:600] > forest.threshold).mean() <= 0.01
    depth = {1: 0, 2: 1, 3: 2 * (math.log(2) + 0.5772156649) - 4 / 3}
    for n, want in depth.items():
        assert abs(quality_rules._mean_path(n) - want) < 1e-9
    for t in forest.trees[:20]:  # every inner node parts the sample's range
        assert ((t.feature == -1) | (t.child > np.arange(len(t.feature)))).all()


def test_training_text_on_the_driver_is_bounded(spark):
    rows = [(i, "x" * 1000, "s") for i in range(40)] + [(0, "repeated id", "s")] * 30
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    texts, y = quality_classifier.training_rows(frame(spark, rows), labels, "quality", 100, 5500)
    assert sum(map(len, texts)) <= 5500 and len(texts) == len(y) >= 5
    assert len(quality_classifier.training_rows(frame(spark, rows), labels, "quality", 100)[0]) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(40))


def test_rule_counts_match_brute_force():
    r = random.Random(5)
    for _ in range(200):
        text = "".join(r.choice(["a", "bé", " ", "\n", "# ", "the cat sat ", "x|y", "\r", "\x1f"]) for _ in range(r.randrange(80)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
        got = quality_rules.count(text.encode())
        assert (got.n_words, got.word_chars, got.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (got.n_dup_lines, got.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))


# --- op5 -----------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    own = bpe.WordBpe(vocabulary("word_bpe_49k.json"), cache=50)
    r = random.Random(6)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x390, 0x3D0), 0x130, 0x3A3, 0x4E2D, 0x1F600, 0x200D, 0x212B, 0x1E6C0, 0x323B0, 0x0]] + ["the", " of", "'s", "'LL", "<|endoftext|>", "<|startoftext|>"] * 20
    texts = ["", None, "a" * 5000] + ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(400)]
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t or "") == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rows = {x.doc_id: x for x in bpe.encode_documents(frame(spark, [(i, t, "s") for i, t in enumerate(texts[:60])]), vocabulary("word_bpe_49k.json")).collect()}
    for i, t in enumerate(texts[:60]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_forced_boundaries_lie_inside_no_token():
    own = bpe.WordBpe(vocabulary("word_bpe_49k.json"))
    back = packing.byte_alphabet()
    cut = [(p >> 8, p & 255) for p in range(1 << 16) if not own.inside[p]]
    assert cut
    pairs = {bytes(p) for p in cut}
    for token in list(own.vocab)[:49406]:
        raw = bytes(back[c] for c in token.removesuffix("</w>"))
        assert not any(raw[i : i + 2] in pairs for i in range(len(raw) - 1))


# --- op6 -----------------------------------------------------------------------------


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(7)
    pool = [prose(1000 + i, r.choice([2, 4, 7])) for i in range(12)]
    rows = [(i, "\n".join(r.choice([*pool, pool[0].upper(), "  " + pool[1].replace(" ", "\t "), "", prose(i, 6)]) for _ in range(r.randrange(6))), f"s{r.randrange(5)}") for i in range(80)]
    rows += [(90, None, "s1"), (91, pool[2], None)]
    plain = lambda line: " ".join(re.sub("[ \t\r\f\x0b]+", " ", line).lower().split(" ")).strip(" ")
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            name = plain(line)
            if t is not None and name:  # blank lines are not judged
                sites[name] |= {s} - {None}
                first[name] = min(first.get(name, 10**9), i)
    got = {x.doc_id: x for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        if t is None:
            assert (got[i].text, got[i].n_lines, got[i].n_removed) == (None, 0, 0)
            continue
        seen, left = set(), []
        for line in t.split("\n"):
            name = plain(line)
            if len(sites.get(name, ())) >= line_dedup.MIN_SITES and (first[name] != i or name in seen):
                continue
            seen.add(name)
            left.append(line)
        assert got[i].text == "\n".join(left)
        assert got[i].n_removed == len(t.split("\n")) - len(left)


def test_near_threshold_lines_are_counted_exactly(spark):
    lines = [(n, -n, d, f"site{d}") for n, spread in ((1, 39), (2, 40), (3, 41), (4, 400), (5, 5)) for d in range(spread) for _ in range(2)]
    got = line_dedup.boilerplate(spark.createDataFrame(lines, "name long, check long, doc long, site string"), 40)
    assert {r.name for r in got.collect()} == {2, 3, 4}


def test_short_lines_of_many_sites_go_in_the_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(i, f"All  rights reserved.\nHome\n\t\nfew {i % 2}\n{prose(i, 9)}", f"s{i % 3}") for i in range(6)]
    got = {r.doc_id: r.text for r in cp.lines(spark, frame(spark, rows), str(tmp_path)).collect()}
    assert got == {i: t if i == 0 else "\n".join(["\t", *([f"few {i}"] if i == 1 else []), prose(i, 9)]) for i, t, _ in rows}


def test_a_null_source_is_no_site_near_the_threshold(spark):
    two, three = "shown by two sites only", "this one stands in three"
    rows = [(1, two, "a"), (2, two, "b"), (3, two, None), (4, three, "a"), (5, three, "b"), (6, three, "c"), (7, three, None)]
    got = {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 1}


# --- op7 -----------------------------------------------------------------------------


def plain_regex(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 14, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    r = random.Random(9)
    pool = ["@", ".", "a", "b", "1", "2", "55", "-", " ", "+", "(", ")", "%", "4111111111111111", "@x.y", "1.2.3", "é", "٣", "0001"]
    for _ in range(5000):
        text = "".join(r.choice(pool) for _ in range(r.randrange(25)))
        assert pii.plain_spans(text) == plain_regex(text)


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("write to john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"), ("foo(at)bar(dot)co(dot)uk", "email", "foo(at)bar(dot)co(dot)uk"),
    ("é ask joe at example dot com today", "email", "joe at example dot com"), ("jоhn.dоe@exаmple.com bye", "email", "jоhn.dоe@exаmple.com"),
    ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("host 192[.]168[.]0[.]1 up", "ip", "192[.]168[.]0[.]1"), ("ip 192 dot 168 dot 0 dot 1 ok", "ip", "192 dot 168 dot 0 dot 1"),
    ("call plus one two one two five five five zero one nine nine today", "phone", "plus one two one two five five five zero one nine nine"),
    ("joe@example dot com", "email", "joe@example dot com"), ("see john.doe at example.com today", "email", "john.doe at example.com"),
    ("tel plus 49 170 1234567 ok", "phone", "plus 49 170 1234567"), ("+one 2125550199", "phone", "+one 2125550199"), ("+49 one 7 six 1 2 three 4 5 6", "phone", "+49 one 7 six 1 2 three 4 5 6"),
    ("no four 1 one 1 1 1 1 1 1 1 1 1 1 1 1 1 end", "card", "four 1 one 1 1 1 1 1 1 1 1 1 1 1 1 1"), ("𝟒𝟏𝟏𝟏 𝟏𝟏𝟏𝟏 𝟏𝟏𝟏𝟏 𝟏𝟏𝟏𝟏", "card", "𝟒𝟏𝟏𝟏 𝟏𝟏𝟏𝟏 𝟏𝟏𝟏𝟏 𝟏𝟏𝟏𝟏"),
    ("by 𝗃𝗈𝗁𝗇@example.com.", "email", "𝗃𝗈𝗁𝗇@example.com"), ("jоhn@example.com", "email", "jоhn@example.com"), ("j\u200boe@example.com", "email", "j\u200boe@example.com"),
    ("card four five three nine one four eight eight zero three four three six four six seven.", "card", "four five three nine one four eight eight zero three four three six four six seven"),
])
def test_disguised_identifiers_map_back_to_the_source(text, kind, found):
    base, every = pii.find_spans(text)
    assert [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base] == [(kind, found)]
    assert found not in pii.mask(text)


@pytest.mark.parametrize("text", ["look at the dot on this", "one two three go", "élan de la forêt (at) last", "Посмотри на это", "nine of ten", "at home dot net worth of it", "see us at www.example.com or look at example.org", "meet at noon. dot the i"])
def test_plain_prose_is_left_alone(text):
    base, every = pii.find_spans(text)
    assert not base and (not every or text.startswith("at home"))


@pytest.mark.parametrize("n", [3, 90, 170, 700, 10_000])
def test_disguised_identifiers_of_any_length_are_found(n):
    r = random.Random(n)
    name = "".join(r.choice("abcxyz") for _ in range(n))
    for before, after in (("", ""), (prose(n, 30) + " ", " " + prose(n + 1, 30)), ("«", "» one at two dot three")):
        for found in (f"{name} [at] {name} [dot] com", f"joe at {name} dot com", f"{name}(at){name}.org", f"{name}.x at {name}.net", f"{name[:-1]}о@{name}.com", f"{name}@{name} dot com"):
            text = f"{before}{found}{after}"
            base, every = pii.find_spans(text)
            assert ("email", len(before), len(before) + len(found)) in every, found[:40]


def test_offsets_map_back_through_any_mix_of_rewriting():
    r = random.Random(13)
    noise = ["one", " ", "at", "dot", "é", "​", "（", "x", ".", "\n", "un", "[at]", ",", "ＡＢ", "7", "plus", "-"]
    for _ in range(2000):
        text = "".join(r.choice(noise) for _ in range(r.randrange(40)))
        form = pii.rewrite(text)
        if form is None:
            continue
        shown = "".join(form.parts)
        assert len(shown) == form.size
        last = 0
        for i in range(len(shown)):
            a, b = form.source(i, i + 1)
            assert last <= a < b <= len(text)
            last = a
        base, every = pii.find_spans(text)
        assert set(base) <= set(every) and all(0 <= a < b <= len(text) for _, a, b in every)


def test_rewriting_is_linear():
    for text in (" " * 300_000, "[" * 200_000, "dot " * 60_000, "one " * 60_000, "a at b." * 40_000, "\u200b" * 200_000, "at " * 60_000, "[ " * 60_000, "1 one, " * 40_000):
        start = time.time()
        pii.find_spans(text)
        assert time.time() - start < 20


def test_scan_and_mask(spark):
    rows = [(1, "a@b.co and x [at] y [dot] org", "s"), (2, None, "s"), (3, "clean", "s")]
    got = {r.doc_id: r for r in pii.scan_documents(frame(spark, rows)).collect()}
    assert got[1].spans == "email:0:6,email:11:29" and got[1].n_email == 1
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest()
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[3].spans == ""
    masked = {r.doc_id: (r.text, r.n_chars) for r in pii.mask_documents(frame(spark, rows)).collect()}
    assert masked == {1: ("<email> and <email>", 19), 2: (None, None), 3: ("clean", 5)}


# --- op9 -----------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    r = random.Random(10)
    html = [f"<html>{prose(i, 60)}</html>" for i in range(30)]
    pages = [(i, f"http://x/{i}", r.choice(html)) for i in range(120)] + [(200, None, None), (201, "http://e", ""), (None, "http://n", html[0]), (None, "http://n", "only <b>here</b>"), (7, "http://again", html[3])]
    r.shuffle(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit("x"))
    warc.write_archives(df, folder=f"file://{tmp_path}/out")
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 10**9), i)
    want = Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        to = first.get(h or "")
        to = None if to is None or to == i else to
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to] += 1
    rows = warc.read_archives(spark, f"file://{tmp_path}/out").collect()
    assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in rows) == want
    assert all(x.payload is not None for x in rows if x.record_type == "response")
    import zstandard

    files = sorted(glob.glob(f"{tmp_path}/out/archive=*.warc.zst/part-*"))
    assert files and len(files) == len(glob.glob(f"{tmp_path}/out/archive=*"))
    total = 0
    for f in files:  # frame by frame, as any reader of the format would
        raw = open(f, "rb").read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D
        opener, at = zstandard.ZstdDecompressor(dict_data=warc._loaded(raw[8 : 8 + size])), 8 + size
        while at < len(raw):
            magic, skip = struct.unpack("<II", raw[at : at + 8])
            if magic == 0x184D2A50:
                at += 8 + skip
                continue
            one = opener.decompressobj()
            record = one.decompress(raw[at:])
            at = len(raw) - len(one.unused_data)
            head, _, rest = record.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest.endswith(b"\r\n\r\n")
            total += 1
    assert total == len(pages)


def test_broken_archives_are_refused():
    import io

    record = warc.record_bytes(1, "u", b"x", "D", 1, None)
    raw = b"".join(warc.archive_frames([record]))
    assert [head["WARC-Page-Id"] for head, _ in warc.read_archive(raw)] == ["1"]
    for bad in (b"", raw[8:], raw[:20]):
        with pytest.raises(ValueError):
            list(warc.read_archive(bad))
    for cut in range(1, len(record)):
        with pytest.raises(ValueError):
            list(warc.parse_records(io.BytesIO(record[:cut])))


# --- op10 ----------------------------------------------------------------------------


def license_twin(text):
    """Paragraphs, windows and verdicts in plain Python; only the weights are shared."""
    m = licenses.trained()
    at = {g: i for i, g in enumerate(m.features)}
    found, notices, unknown = set(), 0, 0
    for part in re.split(r"\n[^a-z0-9]*\n", (text or "").lower()):
        words = re.split("[^a-z0-9.]+", re.sub(r"\.(?![0-9])", " ", part))
        own, unnamed = set(), False
        for start in range(0, max(1, len(words)), 32):
            window = range(start, min(len(words), start + 64))
            held = {at[w] for i in window if (w := words[i]) in at}
            held |= {at[p] for i in window if i + 1 < len(words) and (p := f"{words[i]} {words[i + 1]}") in at}
            z = m.bias + m.weights[sorted(held)].sum(axis=0)
            for c, name in enumerate(m.classes[:-1]):
                if z[c] >= 0 and any(len(held & set(t)) >= 0.6 * len(t) for k, t in m.templates if k == c):
                    own.add(name)
            unnamed |= z[-1] >= 0
        found |= own
        notices += bool(own)
        unknown += unnamed and not own
    return ",".join(sorted(found)), notices, unknown


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


@pytest.mark.parametrize(("text", "families", "unknown"), [
    ("Released under the MIT License.", "mit", 0), ("Licensed under CC BY-NC 4.0.", "cc-by-nc", 0), ("thwh Licensed under the Apache License, Version 2.0. ertion", "apache", 0),
    ("All rights reserved.", "proprietary", 0), ("Released under the GPL.", "gpl", 0), ("released under the LGPL", "lgpl", 0), ("released under the AGPL", "agpl", 0), ("GPL v2 or later", "gpl", 0),
    ("CC BY-SA 4.0", "cc-by-sa", 0), ("licensed under the MIT License or the Apache License, Version 2.0", "apache,mit", 0), (MIT, "mit", 0), (GPL, "gpl", 0),
    ("prose " * 900 + MIT + " prose" * 500 + " " + GPL + " more" * 90, "gpl,mit", 0), (f"{MIT}\n#\n# \n{GPL}\n\n\nplain words", "gpl,mit", 0),
    ("Licensed under the Foo License.", "", 1), ("the license plate", "", 0), ("a copyright claim", "", 0), ("no such word", "", 0), ("", "", 0), (None, "", 0),
])
def test_notices_are_found_and_prose_is_not(text, families, unknown):
    got = license_twin(text)
    assert (got[0], got[2]) == (families, unknown)


def test_every_template_is_found_alone_and_in_prose(spark):
    rows, want = [], {}
    for family, pool in licenses.TEMPLATES.items():
        for t in pool:
            for text in (t, t.upper() + ".", "\n".join(f"// {w}" for w in t.split()), f"{prose(len(rows), 90)}\n\n{t}\n\n{prose(len(rows) + 1, 40)}"):
                want[len(rows)] = family
                rows.append((len(rows), text, "s"))
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    for i, family in want.items():
        assert family in got[i].licences.split(","), rows[i]


def test_license_scan_equals_its_plain_twin(spark):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "the license plate", "", " \t", "Licensed under the Foo License.", "SPDX-License-Identifier: BSD-3-Clause", MIT, GPL, "ends.", "v. 2.0 .", prose(3, 150)]
    r = random.Random(12)
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(12))), "s") for i in range(60)] + [(61, None, "s"), (5, "CC BY 4.0", "s"), (5, "CC BY 4.0", "s"), (None, MIT, "s"), (None, GPL, "s")]
    rows.append((62, " " * 200_000 + "\n" * 100_000 + "one " * 30_000, "s"))
    got = Counter(tuple(x) for x in licenses.scan_licenses(frame(spark, rows, clash=True)).collect())
    assert got == Counter((i, *license_twin(t)) for i, t, _ in rows)


# --- registry and pipeline -----------------------------------------------------------


def test_registry_has_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def test_native_plans_have_no_python(spark, odd):
    for df in (line_dedup.dedup_lines(odd), licenses.scan_licenses(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    docs, labels, truth = labelled(spark)
    extra = [(1000 + i, "\n".join([prose(5000 + i // 4, 60), prose(6000, 12), f"mail me{i}@x.org now please {prose(i, 20)}"]), f"s{i % 4}") for i in range(16)]
    docs = docs.unionByName(frame(spark, extra))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    good = cp.quality(spark, docs, str(tmp_path))
    assert good.columns == docs.columns and {i for i, q in truth.items() if q} <= {r.doc_id for r in good.collect()}
    lined = cp.lines(spark, good, str(tmp_path))
    assert lined.columns == docs.columns and sum(prose(6000, 12) in (r.text or "") for r in lined.collect()) == 1
    kept = cp.near_duplicates(spark, docs, str(tmp_path))
    sets = {r.doc_id: shingles(r.text.lower(), 5) for r in docs.collect()}
    left = {r.doc_id for r in kept.collect()}
    for a in left:
        for b in left:
            assert a >= b or not sets[a] or 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
    masked = cp.personal_data(spark, lined, str(tmp_path))
    assert masked.columns == docs.columns and not any("@x.org" in r.text for r in masked.collect())
    rows = cp.run(spark, str(tmp_path)).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert json.dumps(names)


CLASH = [(3, "the same words in this text are here twice over", "a"), (5, "the same words in this text are here twice over", "b"), (5, "a wholly different text of its own with other words", "b"),
         (8, "and one more that stands here as two equal rows", "c"), (8, "and one more that stands here as two equal rows", "c"), (None, "and one more that stands here as two equal rows", "d"),
         (None, "no id but words of its own that nothing else has", None), (None, None, None), (9, "", "a"), (9, None, "a"), (10, " \n ", "x")]


def test_one_row_of_each_group_stays(spark, tmp_path):
    import corpus_pipeline as cp

    docs = frame(spark, CLASH, clash=True).withColumn("uid", F.lit("u")).withColumn("row", F.lit(1)).withColumn("h", F.lit(2))
    got = cp.near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = [CLASH[0], CLASH[2], CLASH[3], CLASH[6], *CLASH[7:]]
    assert Counter((r.doc_id, r.text, r.source, r.uid, r.row) for r in got.collect()) == Counter((*r, "u", 1) for r in want)


def test_pipeline_stages_keep_columns_and_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [*ODD, *CLASH]
    docs = frame(spark, odd).withColumn("n_lines", F.lit(99)).withColumn("n_removed", F.lit("own")).withColumn("key", F.lit(1)).withColumn("score", F.lit(0.1))
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString(), name
        rows = got.collect()
        assert rows and all((r.n_lines, r.n_removed, r.key, r.score) == (99, "own", 1, 0.1) for r in rows), name
        assert Counter((r.doc_id, r.source) for r in rows) <= Counter((i, s) for i, _, s in odd), name
        assert sum(r.text is None for r in rows) == sum(t is None for _, t, _ in odd), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed = cp.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in cp.near_duplicates(spark, cp.lines(spark, docs, ""), "").collect())


def test_components_say_when_rounds_do_not_suffice(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(5000)], "u long, v long")
    with pytest.raises(RuntimeError):
        common.components(chain, rounds=1)
    got = common.components(chain).agg(F.count("*"), F.max("root")).first()
    assert tuple(got) == (5000, 0)


def test_comparison_in_tiles_finds_the_same_groups():
    r = random.Random(4)
    sets = []
    for g in range(20):
        base = r.sample(range(10**6), r.randrange(1, 80))
        for _ in range(r.randrange(1, 6)):
            sets.append(np.unique(np.array([x if r.random() > 0.05 else r.randrange(10**6) for x in base], dtype=np.uint64)))
    side = np.array([r.choice([-1]) for _ in sets])

    def groups(links):
        label = list(range(len(sets)))
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return len(set(label))

    assert groups(minhash.compare(sets, side, 80)) == groups(minhash.compare(sets, side, 80, limit=256))


def test_base_columns_equal_their_sql(spark):
    import duckdb

    from tessera.llm import registry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for name, run in registry.BASE_QUERIES.items():
        got = run(spark, folder)
        found = con.execute(registry.ORACLE_SQL[name])
        assert [c[0] for c in found.description] == got.columns
        assert sorted(map(tuple, got.collect())) == sorted(found.fetchall()), name
