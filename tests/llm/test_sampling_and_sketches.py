"""Importance resampling, whitening and odd sketches against brute force, with odd rows of every kind."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vellum.llm import odd_sketch, resampling, whitening

LOWER = {i: i + 32 for i in range(65, 91)}


def resampled(rows, target, longest, buckets, least, percent, seed):
    """(doc_id, n_features, weight, score, rank) by the definition."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *features(t)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, n, fs in found:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (2, 500, 35), (3, 7, 100)])
def test_resampling_by_definition(spark, longest, buckets, percent):
    rng = random.Random(longest)
    vocabulary = ["Data", "été", "x1", "Żółć", "the", "of", "model", "日本語", "naïve", *(f"w{i}" for i in range(60))]
    sentence = lambda n: rng.choice([" ", ", ", "\x00"]).join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, sentence(rng.randint(1, 60))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, sentence(90_000)), (204, sentence(30)), (205, rows[3][1]), (None, sentence(40)), (7, sentence(40)), (7, rows[7][1])]
    target = [sentence(30) for _ in range(5)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1, "a", 2) for i, t in rows], "doc_id bigint, text string, row int, bucket string, rank int").repartition(5)
    bench = spark.createDataFrame([(1, t, 3) for t in target], "item_id int, text string, doc_id int")
    got = resampling.resample(docs, bench, longest, buckets, 20, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {d for _, d in got.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(rows, target, longest, buckets, 20, percent, 2024)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "one two three " * 10), (2, None)], "doc_id bigint, text string")
    assert resampling.resample(none, some).count() == 0
    assert resampling.resample(none, none).count() == 0
    got = sorted(tuple(r) for r in resampling.resample(some, none, percent=100).collect())
    assert got == [r for r in sorted(resampled([(1, "one two three " * 10), (2, None)], [], 1, 10_000, 20, 100, 2024))]


def test_equal_scores_are_ranked_across_ranges(spark):
    rows = [(i % 40, 5, i // 400, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_features bigint, score bigint, row bigint").repartition(7)
    got = {r["row"]: r["rank"] for r in resampling.ranked(df).collect()}
    want = {r[3]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0], r[1], r[3])), 1)}
    assert got == want


def whitened(rows, k):
    """By eigenvectors of the whole covariance matrix: components as columns, for the sign that the largest entry is positive."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in rows])
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(0)
    e, u = np.linalg.eigh(centred.T @ centred / len(fit))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(k)])
    return x, fit, e, (x - fit.mean(0)) @ u / np.sqrt(e), e / np.trace(centred.T @ centred / len(fit))


@pytest.mark.parametrize("d", [3, 16, 90])
def test_whitening_equals_eigenvectors(spark, d):
    rng = np.random.default_rng(d)
    base = rng.standard_normal((300, d)) * np.linspace(1.5, 0.5, d) + rng.standard_normal(d)
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 120
    odd = [None, [], [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [0.0] * (d - 1), [1e300] * d]
    rows = [(i, v, 1, 2) for i, v in enumerate(vectors + odd)] + [(None, vectors[5], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, x int, component int").repartition(4)
    got = whitening.whiten(df, 4).collect()
    k = min(4, d)
    x, fit, e, y, explained = whitened(vectors, k)
    n, total = len(fit), fit.sum(0)
    assert len(got) == k * (len(vectors) + 1)
    for r in got:
        i = 5 if r["vec_id"] is None else r["vec_id"]
        c = r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], total))
        assert abs(r["whitened"] - y[i, c]) < 1e-7 and abs(r["explained"] / explained[c] - 1) < 1e-9
        assert r["identity_error"] < 1e-9


def test_whitening_of_small_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [1.0, 2.0]), (3, [1.5, 3.0])], schema)).collect()
    assert {(r["vec_id"], r["component"]) for r in line} == {(1, 1), (2, 1), (3, 1)}  # nothing beside the line
    assert abs(line[0]["explained"] - 1) < 1e-12
    large = whitening.whiten(spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 1.0])], schema)).collect()
    assert {r["deviation"] is None for r in large if r["vec_id"] == 1} == {True} and {r["deviation"] for r in large if r["vec_id"] == 3} == {(2 * 256) ** 2}


def test_uncertified_components_raise():
    rng = np.random.default_rng(0)
    noisy = lambda b: rng.standard_normal(b.shape)
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(noisy, 30, 2, most=5)


def set_of(text, k=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({" ".join(words)} if words else set())


def component_of(rows):
    sets = [set_of(t) for _, t in rows]
    label = {i: i for i, _ in rows}
    for (a, x), (b, y) in itertools.combinations([(i, s) for (i, _), s in zip(rows, sets)], 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {i: new if v == old else v for i, v in label.items()}
    return sorted((i, len(s), label[i], i == label[i]) for (i, _), s in zip(rows, sets))


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    texts = [None, "", "\t", "one", "ONE", "two words", "a b c d e", "a b c d e f", "x" * 50_000, " ".join(word() for _ in range(30_000))]
    texts.append(texts[-1] + " tail")
    for size in (6, 9, 15, 40, 120, 300):
        base = [word() for _ in range(size)]
        for changes in range(0, max(3, size // 8)):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(size)] = word()
            texts += [" ".join(copy), " ".join(copy).upper()]
    return list(enumerate(texts))


def test_odd_sketches_equal_all_pairs(spark, near_rows):
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in near_rows], "doc_id bigint, text string, row int, n int, sketch int").repartition(6)
    got = odd_sketch.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == component_of(near_rows)
    assert odd_sketch.near_duplicates(docs.limit(0)).count() == 0


def test_odd_sketches_of_odd_rows(spark):
    rng = random.Random(3)
    t = " ".join(f"w{rng.randrange(900)}" for _ in range(80))
    docs = spark.createDataFrame([(5, t), (5, t + " more"), (None, t), (None, None), (2, t.upper())], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in odd_sketch.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (0, 2, False), (2, 2, True), (5, 2, False), (5, 2, False)]


def test_a_hot_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        copy = list(base)
        for _ in range(i % 16):
            copy[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = odd_sketch.near_duplicates(spark.createDataFrame(rows[::-1], "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in got.collect()) == component_of(rows)


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    for similarity in (0.8, 0.9, 0.97):
        both = round(400 * similarity)
        errors, missed = [], 0
        for _ in range(60):
            values = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            a, b = values[: both + (400 - both) // 2], np.concatenate([values[:both], values[both + (400 - both) // 2 :]])
            mins = odd_sketch.min_hashes(np.concatenate([a, b]), np.array([0, len(a)]))
            x, y = odd_sketch.sketches(mins).view(np.uint64)
            ones = int(np.bitwise_count(x ^ y).sum())
            errors.append(odd_sketch.estimate(ones) - both / 400)
            missed += ones > odd_sketch.MOST_ONES
            assert ones <= 2 * int((mins[:, 0] != mins[:, 1]).sum())
        assert missed == 0 and abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    assert 2 * 0.2 * odd_sketch.SAMPLES < odd_sketch.MOST_ONES < odd_sketch.SAMPLES
