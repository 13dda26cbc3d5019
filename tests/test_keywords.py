import pytest
from plans import exchanges, plan
from pyspark.sql import functions as F

from gleaner.functions.text import keyword_count
from gleaner.operators import keywords as kw

TEXTS = [
    ("http://www.a.com/1", "Job offer: JOB, salary"),
    ("http://www.a.com/2", "aaaa banana"),
    ("http://www.b.co.uk/3", "nothing here"),
    ("http://www.b.co.uk/4", "salary"),
    ("http://localhost/5", "job salary"),
    ("mailto:x@y", "job salary"),
    ("http://www.c.org/6", None),
    ("http://www.a.com/7,x", "job offer salary"),
]
KEYS = ["job", "JOB", "salary", "aa", "", "salary", "missing"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "url string, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute(keywords, fold):
    keys = {k.lower() if fold else k for k in keywords} - {""}
    sites = {"www.a.com": "com", "www.b.co.uk": "uk", "www.c.org": "org"}
    for url, text in TEXTS:
        host = url.split("/")[2] if "//" in url else ""
        if host in sites and text:
            for k in keys:
                if text.lower().count(k):
                    yield sites[host], url, k, text.lower().count(k)


@pytest.mark.parametrize("mode", [kw.DOCUMENTED, kw.AS_CODED])
def test_matches_against_brute_force(texts, mode):
    want = sorted(brute(KEYS, mode == kw.DOCUMENTED))
    assert rows(kw.keyword_matches(texts, KEYS, mode)) == want


@pytest.mark.parametrize("least", [1, 2, 3])
def test_candidates(texts, least):
    found = sorted(brute(KEYS, True))
    urls = [u for _, u, _, _ in found]
    want = [r for r in found if urls.count(r[1]) >= least]
    assert rows(kw.vacancy_candidates(texts, KEYS, least)) == want


def test_candidates_as_coded(texts):
    assert rows(kw.vacancy_candidates(texts, ["salary"], mode=kw.AS_CODED)) == []
    assert rows(kw.vacancy_candidates(texts, ["salary", ""], mode=kw.AS_CODED)) == sorted(brute(["salary"], False))


def test_no_keywords(texts):
    assert rows(kw.keyword_matches(texts, [])) == []


def test_unknown_mode(texts):
    with pytest.raises(ValueError, match="unknown mode"):
        kw.keyword_matches(texts, KEYS, "other")


def test_concat(texts):
    got = {r["url"]: r["matches"] for r in kw.keyword_matches_concat(texts, KEYS).collect()}
    assert got["http://www.a.com/1"] == "job,2,salary,1,"
    assert "http://www.b.co.uk/3" not in got


def test_counts_do_not_overlap(spark):
    cases = [("aaaa", "aa", 2), ("banana", "ana", 1), ("abc", "", 0), ("", "a", 0), ("ééé", "é", 3), (None, "a", None)]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, k string")
    got = [r[0] for r in df.select(keyword_count(F.col("t"), F.col("k"))).collect()]
    assert got == [c[2] for c in cases]


def test_packed_keys_split_at_the_first_comma(texts):
    matches = kw.keyword_matches(texts, KEYS)
    split = kw.packed_key(matches).select(*kw.split_key(F.col("key")))
    assert rows(split) == rows(matches.select("domain_id", "url"))


def test_candidate_urls_are_ordered_and_distinct(texts):
    got = [tuple(r) for r in kw.candidate_urls(kw.keyword_matches(texts, KEYS)).collect()]
    assert got == sorted(set(got))


def test_candidate_counts_skip_nulls(spark):
    df = spark.createDataFrame(
        [("com", "a"), ("com", "a"), ("com", None), (None, "a"), ("org", "b")],
        "domain_id string, url string",
    )
    assert rows(kw.candidate_count_per_domain(df)) == [("com", 1), ("org", 1)]


def test_search_is_narrow(texts):
    for search in (kw.keyword_matches, kw.vacancy_candidates, kw.keyword_matches_concat):
        df = search(texts, KEYS)
        assert exchanges(df) == 0 and "Join" not in plan(df)
        # the scan for keywords appears once in the plan
        assert plan(df).count("Contains(") == 1


def test_distinct_counts_spread_a_frequent_domain(texts):
    text = plan(kw.candidate_count_per_domain(kw.keyword_matches(texts, KEYS)))
    assert "hashpartitioning(domain_id" in text and ", url" in text.split("hashpartitioning(domain_id")[-1]
