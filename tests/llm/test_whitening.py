import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def vectors(n=300, d=40, seed=3):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) / 8
    rows = [(k, (rng.normal(size=d) @ mix).astype(np.float32).tolist()) for k in range(n)]
    same = rows[7][1]
    rows += [(1000 + k, same) for k in range(250)]  # one vector with nearly half of all rows
    nudged = [c + 1e-7 if math.floor(64 * (c + 1e-7)) == math.floor(64 * c) else c for c in rows[8][1]]
    return rows + [(2000, nudged), (2000, nudged), (None, rows[9][1])]


def usable(rows):
    return [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def brute(rows, most=32):
    """The contract in numpy and exact integers: id, x -> n, deviation, explained; and the covariance."""
    rows = usable(rows)
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = ((n * x - sums) / n).astype(float)
    covariance = centred.T @ centred / n
    return rows, x, n, deviations, centred, covariance


def check(df, rows, most=32):
    rows, x, n, deviations, centred, covariance = brute(rows)
    values, _ = np.linalg.eigh(covariance)
    values = values[::-1]
    got = defaultdict(list)
    for r in df.collect():
        got[r.vec_id].append(r)
    want = Counter(i for i, _ in rows)
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    assert {i: len(g) for i, g in got.items()} == {i: c * k for i, c in want.items()}
    white = np.zeros((n, k))
    for at, (i, _) in enumerate(rows):
        for r in got[i]:
            assert r.n == n and r.deviation == deviations[at]
            assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-6)
            assert r.identity_error < 1e-8
            white[at, r.component - 1] = r.whitened
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-8
    # the whitened values are projections on eigenvectors over the root of the eigenvalue
    axes = np.linalg.lstsq(centred, white * np.sqrt(values[:k]), rcond=None)[0]
    assert np.abs(covariance @ axes - axes * values[:k]).max() < 1e-6 * values[0]


def test_whole_contract(spark):
    rows = vectors()
    for parts in (1, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("x", F.lit("x")).withColumn("weight", F.lit(None))
        check(whitening.whitened_rows(df), rows)


def test_rows_that_cannot_be_used(spark):
    rows = vectors(60, 5)
    bad = [(3000, None), (3001, [1.0, None, 0.0, 0.0, 0.0]), (3002, [math.nan] * 5), (3003, [math.inf, 0, 0, 0, 0]), (3004, [-math.inf] * 5), (3005, [3e38, 0, 0, 0, 0]), (3006, [])]
    df = spark.createDataFrame(rows + [(i, v and [None if c is None else float(c) for c in v]) for i, v in bad], SCHEMA)
    check(whitening.whitened_rows(df), rows)


def test_no_rows_one_row_and_equal_rows(spark):
    for rows in ([], [(1, [0.5, 0.25])], [(k, [0.5, 0.25]) for k in range(5)], [(1, None)], [(1, [])]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert whitening.whitened_rows(df).collect() == []


def test_dimensions_without_spread_give_no_component(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(a), 0.5, float(a)]) for k, a in enumerate(rng.normal(size=50).astype(np.float32))]
    got = whitening.whitened_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and len(got) == 50
    assert got[0].explained == pytest.approx(1.0)


def test_lengths_are_fitted_apart(spark):
    short, long = vectors(50, 3), [(i + 5000 if i is not None else 9999, v) for i, v in vectors(60, 6, seed=9)]
    df = spark.createDataFrame(short + long, SCHEMA)
    found = whitening.whitened_rows(df)
    check(found.where("coalesce(vec_id, 0) < 5000"), short)
    check(found.where("vec_id >= 5000"), long)


def test_weights_of_one_ignore_multiplicity(spark):
    rows = vectors(100, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    _, fits = whitening.whiten(df, weights="one")
    x = np.unique(np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]), axis=0)
    assert fits[6].n == len(x)
    assert np.allclose(fits[6].covariance, np.cov(x.T, bias=True))
    with pytest.raises(ValueError):
        whitening.whiten(df, weights="some")


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [0.0, 1.0])]
    got = whitening.whitened_rows(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {(r.vec_id, r.deviation is None) for r in got} == {(1, True), (2, True), (3, False)}
