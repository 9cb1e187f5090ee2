"""Operators 11 and 13 against plain loops: ties, copies, nulls, odd components, sizes, blocks of a few rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionloom.llm import hard_negatives, integer_vectors, pivot_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(rows, labelled):
    """The distinct rows that take part, with integer components."""
    seen = {}
    for vec_id, v, label in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 2**20 for x in v) or (labelled and label is None):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        seen[(vec_id, q, (label + 1) % 10 if labelled and vec_id % 7 == 0 else label) if labelled else (vec_id, q)] = None
    return list(seen)


def inner(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_search(rows, every, limit):
    rows, out = usable(rows, False), []
    for q in rows:
        if q[0] % every == 0:
            best = sorted((-inner(q[1], r[1]), r[0]) for r in rows if r is not q)[:limit]
            out += [(q[0], k, i, -s) for k, (s, i) in enumerate(best, 1)]
    return sorted(out)


def brute_negatives(rows, every):
    rows, out = usable(rows, True), []
    for a in rows:
        if a[0] % every:
            continue
        alike = sorted((-inner(a[1], r[1]), r[0]) for r in rows if r is not a and r[2] == a[2])[:5]
        for score, pid in sorted(set(alike)):
            p = -score
            fits = sorted((-s, r[0]) for r in rows if r[2] != a[2] and 30 * p <= 100 * (s := inner(a[1], r[1])) <= 90 * p)[:10]
            out += [(a[0], pid, k, i, p, -s) for k, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def some_rows(seed, n, d, kind):
    r = np.random.default_rng(seed)
    if kind == "clusters":
        centres = r.normal(size=(12, d))
        x = centres[r.integers(0, 12, n)] + 0.05 * r.normal(size=(n, d))
    elif kind == "ties":
        x = r.integers(-2, 3, size=(n, d)) / 256.0
    elif kind == "copies":
        x = r.normal(size=(n, d))
        x[r.random(n) < 0.4] = x[0]
    else:
        x = r.normal(size=(n, d))
    return [(int(k) - n // 2, [float(np.float32(c)) for c in v], int(r.integers(0, 4))) for k, v in enumerate(x)]


HARD = [
    (None, [0.1, 0.2], 1), (0, None, 1), (0, [0.5, None], 1), (0, [0.5, float("nan")], 1), (0, [float("inf"), 0.5], 1), (0, [3e30, 0.5], 1),
    (0, [0.5, -0.25], 1), (0, [0.5, -0.25], 1), (0, [0.5, -0.25], None), (100, [0.5, -0.3], 1), (1, [0.5], 1), (2, [], 1), (3, [0.0, 0.0], 2), (4, [0.4, -0.2, 0.9], 2), (5, [0.25, -0.1], 2),
    (6, [-0.4, 0.2], 2), (100, [0.3, 0.3], 3), (8, [0.3, -0.1], 3), (9, [0.3, -0.1], 3), (10, [0.3, -0.1], 3), (7, [0.5, -0.25], 0), (14, [0.5, -0.25], 9), (-100, [0.5, 0.1], 1),
]


@pytest.mark.parametrize("kind", ["clusters", "ties", "copies", "spread"])
def test_search_equals_brute_force(spark, kind):
    rows = some_rows(3, 900, 7, kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = pivot_search.search(df, "vec_id % 9 = 0", 4, pivots=9, sample=120, block=60, queries=30)
    assert sorted(map(tuple, got.collect())) == brute_search(rows, 9, 4)


@pytest.mark.parametrize("kind", ["clusters", "ties", "copies", "spread"])
def test_negatives_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "FIRST_READ", 3)
    rows = some_rows(5, 700, 6, kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(df, "vec_id % 25 = 0", label, block=50, part=10)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 25)


def test_hard_rows(spark):
    """Nulls anywhere, components that are no numbers or too large, sizes of all kinds, rows that repeat, ids that repeat."""
    df = spark.createDataFrame(HARD, SCHEMA).withColumn("a.b", F.lit("x")).withColumn("vector", F.lit(None).cast("string")).withColumn("score", F.lit(1))
    assert sorted(map(tuple, pivot_search.search_report(df).collect())) == brute_search(HARD, 50, 5)
    assert sorted(map(tuple, hard_negatives.negatives_report(df).collect())) == brute_negatives(HARD, 100)
    for none in (df.where("false"), df.where("embedding IS NULL"), df.where("vec_id = 3")):
        assert pivot_search.search_report(none).count() == hard_negatives.negatives_report(none).count() == 0


def test_integers_beyond_doubles(spark):
    """Sums of products that a double can't hold are added as 64-bit integers."""
    big = [(k * 50, [float(2**19 + k), float(2**19 - 3 * k), 1 / 256], 1) for k in range(5)]
    assert sorted(map(tuple, pivot_search.search(spark.createDataFrame(big, SCHEMA), "true").collect())) == brute_search(big, 50, 5)
    a, b = np.array([[2.0**27, 1.0]]), np.array([[2.0**27], [3.0]])
    assert [p.dtype for p in integer_vectors.padded(a, b)] == [np.int64] * 2 and integer_vectors.padded(b)[0].dtype == np.int64


def test_bounds_hold_and_eliminate():
    """No bound is below a true score; on rows in clusters most rows are never scored."""
    r = np.random.default_rng(2)
    x = np.floor(256 * (r.normal(size=(20, 16))[r.integers(0, 20, 2000)] + 0.03 * r.normal(size=(2000, 16))))
    d, norm = pivot_search.distances(x, x[:32])
    d = d.astype(np.float32)
    bound = pivot_search.upper_bound(norm[:50], norm, pivot_search.lower_bounds(d[:50], d, d))
    scores = x[:50] @ x.T
    assert (bound >= scores).all()
    kth = np.sort(scores, axis=1)[:, -6]
    assert (bound >= kth[:, None]).mean() < 0.2


def test_threshold_stops_early():
    """Lists are left once the threshold is below the bar, in both directions of reading."""
    r = np.random.default_rng(6)
    x = r.normal(size=(4000, 2))
    x = np.floor(256 * x).astype(np.int32)
    order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
    b = hard_negatives.Block({"vec_id": np.arange(4000).tobytes(), "own": np.arange(4000).tobytes(), "label": np.zeros(4000, np.int64).tobytes(), "width": 2, "vector": x.tobytes(), "lists": np.ascontiguousarray(order).tobytes()})
    a = b.widen(np.array([[256.0, -128.0]]))[0]
    met = []

    def done(rows, scores):
        met.extend(scores)
        return np.sort(met)[-3]

    b.read(a, done)
    assert len(met) < 1500 and sorted(met)[-3:] == sorted((x @ a).astype(int))[-3:]


def test_windows():
    least, most = hard_negatives.windows(np.array([7, 10, 0, -5]), 30, 90)
    assert least.tolist() == [3, 3, 0, -1] and most.tolist() == [6, 9, 0, -5]
