import hashlib
from collections import Counter

import numpy as np
import pytest
from plans import plan
from pyspark.sql import functions as F

from gleaner.operators import sampling as sm
from gleaner.operators.joins import measured_bytes


def order(url, seed=0):
    return hashlib.md5(f"order-{seed}:{url}".encode()).hexdigest(), url


def die(url, seed=0):
    return int(hashlib.md5(f"die-{seed}:{url}".encode()).hexdigest()[:8], 16) % 6 == 0


def quota(n, size, total):
    share = np.float32(size) / np.float32(total) * np.float32(n)
    return int(np.floor(np.float64(share) + 0.5))


def brute(rows, stat, size, dice=False):
    out, total = [], sum(stat.values())
    for domain, n in stat.items():
        urls = sorted((u for d, u in rows if d == domain), key=order)
        out += [(domain, u) for u in urls if not dice or die(u)][: quota(n, size, total)]
    return sorted(out)


# one domain holds most rows, and one of its URLs a third of all
ROWS = (
    [("com", f"http://a{i}.com/") for i in range(400)]
    + [("com", "http://hot.com/")] * 300
    + [("org", f"http://b{i}.org/") for i in range(150)]
    + [("org", f"http://b{i}.org/") for i in range(50)]
    + [("de", "http://c.de/")]
    + [("skip", "http://d.skip/")] * 5
)
STAT = {"com": 700, "org": 200, "de": 1, "absent": 99}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "domain_id string, url string").repartition(5).cache()


@pytest.fixture(scope="module")
def stat(spark):
    return spark.createDataFrame(list(STAT.items()), "domain_id string, n long")


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [0, 1, 37, 500, 1000, 5000])
@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_sample_against_brute_force(rows, stat, size, max_bytes):
    assert got(sm.stratified_sample(rows, stat, size, max_bytes=max_bytes)) == brute(ROWS, STAT, size)


def test_dice_against_brute_force(rows, stat):
    assert got(sm.stratified_sample(rows, stat, 500, dice=True)) == brute(ROWS, STAT, 500, dice=True)


def test_coarse_buckets(rows, stat, monkeypatch):
    monkeypatch.setattr(sm, "LEAST_DIGITS", 1)
    assert got(sm.stratified_sample(rows, stat, 300)) == brute(ROWS, STAT, 300)


def test_many_copies_are_written_in_chunks(rows, stat, monkeypatch):
    monkeypatch.setattr(sm, "COPIES_PER_ROW", 7)
    assert got(sm.stratified_sample(rows, stat, 1000)) == brute(ROWS, STAT, 1000)


def test_sample_properties(rows, stat):
    sample = got(sm.stratified_sample(rows, stat, 100))
    quotas = {r["domain_id"]: r["quota"] for r in sm.sample_quota(stat, 100).collect()}
    for domain, n in Counter(d for d, _ in sample).items():
        assert n == min(quotas[domain], sum(d == domain for d, _ in ROWS))
    assert not Counter(sample) - Counter(ROWS)
    assert got(sm.stratified_sample(rows.repartition(3), stat, 100)) == sample
    assert got(sm.stratified_sample(rows, stat, 100, seed=1)) != sample


def test_quota_rounds_half_up_in_32_bits(spark):
    stat = spark.createDataFrame([("a", 311), ("b", 1466)], "domain_id string, n int")
    assert {r["domain_id"]: r["quota"] for r in sm.sample_quota(stat, 100).collect()} == {"a": 18, "b": 82}
    half = spark.createDataFrame([("a", 1), ("b", 1)], "domain_id string, n int")
    assert [r["quota"] for r in sm.sample_quota(half, 5).collect()] == [3, 3]


def test_repeated_domain_raises(spark):
    stat = spark.createDataFrame([("a", 1), ("a", 2)], "domain_id string, n int")
    with pytest.raises(Exception, match="occurs twice"):
        sm.sample_quota(stat, 5).collect()


def test_null_rows_are_left_out(spark, stat):
    df = spark.createDataFrame([("com", None), (None, "x"), ("com", "y")], "domain_id string, url string")
    assert got(sm.stratified_sample(df, stat, 1000)) == [("com", "y")]


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_stratum_filter(rows, stat, max_bytes):
    assert got(sm.stratum_filter(rows, stat, max_bytes)) == sorted(r for r in ROWS if r[0] in STAT)


def test_no_window_over_a_whole_domain(rows, stat):
    text = plan(sm.stratified_sample(rows, stat, 100))
    assert "windowspecdefinition(domain_id" in text
    for spec in text.split("windowspecdefinition(")[1:]:
        assert "_bucket" in spec.split("ASC")[0]
    assert "BroadcastHashJoin" in text


def test_measured_bytes(spark):
    df = spark.range(1000).select(F.lit("abcd").alias("x"))
    assert 4_000 < measured_bytes(df) < 100_000
    assert measured_bytes(df.where("false")) == 0


def test_buckets_grow_with_the_largest_domain(spark, monkeypatch):
    stat = spark.createDataFrame([("com", 10**11), ("de", None)], "domain_id string, n bigint")
    assert sm.bucket_digits(stat) == 5
    assert sm.bucket_digits(stat.where("n IS NULL")) == 3
    monkeypatch.setattr(sm, "LEAST_DIGITS", 0)
    monkeypatch.setattr(sm, "ROWS_PER_BUCKET", 1)
    rows = spark.createDataFrame(ROWS, "domain_id string, url string")
    counts = Counter(d for d, _ in ROWS)
    found = sm.stratified_sample(rows, spark.createDataFrame(list(counts.items()), "domain_id string, n bigint"), 120)
    assert sorted(map(tuple, found.collect())) == brute(ROWS, counts, 120)
