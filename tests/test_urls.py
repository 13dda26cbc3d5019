import pytest
from pyspark.sql import functions as F

from gleaner.functions.suffixes import SHIPPED_RULES, parse_rules
from gleaner.functions.urls import is_malformed, with_domains
from gleaner.operators import counts

OK, FAIL, NO_CODE = '{"http_result": 200}', '{"http_result": 404}', '{"a": 1}'

CASES = [
    ("http://a.b.co.uk/x", OK, "HTTP_SUCCESS", "b.co.uk", "uk"),
    ("HTTP://WWW.Example.COM:80/p", OK, "HTTP_SUCCESS", "example.com", "com"),
    ("http://a.example.com./", OK, "HTTP_SUCCESS", "example.com", "com"),
    ("http://a.example.com/", FAIL, "HTTP_FAIL", "example.com", "com"),
    ("http://a.example.com/", NO_CODE, "MISSING_HTTPCODE", "example.com", "com"),
    ("http://a.example.com/", "not json", "EXCEPTIONS", "example.com", "com"),
    ("http://a.example.com/", "[200]", "EXCEPTIONS", "example.com", "com"),
    ("http://a.example.com/", '{"http_result": 200', "EXCEPTIONS", "example.com", "com"),
    ("http://a.example.com/", '[{"http_result": 200}]', "EXCEPTIONS", "example.com", "com"),
    ("http://a.example.com/", '{"http_result": "abc"}', "EXCEPTIONS", "example.com", "com"),
    ("http://a.example.com/", '{"http_result": null}', "EXCEPTIONS", "example.com", "com"),
    ("http://a.example.com/", '{"http_result": "200"}', "HTTP_SUCCESS", "example.com", "com"),
    ("http://a.example.com/", '{"http_result": 200.0}', "HTTP_SUCCESS", "example.com", "com"),
    ("http://a.example.com/", '{"http_result": 2000}', "HTTP_FAIL", "example.com", "com"),
    ("http://a.example.com/", None, "EXCEPTIONS", "example.com", "com"),
    ("http://my_host.example.com/", OK, "INVALID_URIS", None, None),
    ("mailto:a@b", OK, "INVALID_URIS", None, None),
    ("/rel/path", OK, "INVALID_URIS", None, None),
    ("http://bad host/", OK, "EXCEPTIONS", None, None),
    ("http://ex.com/a b", OK, "EXCEPTIONS", None, None),
    ("http://1.2.3.4/x", OK, "INVALID_DOMAIN", None, None),
    ("http://[::1]/x", OK, "INVALID_DOMAIN", None, None),
    ("http://localhost/x", OK, "INVALID_DOMAIN", None, None),
    ("http://co.uk/", OK, "INVALID_DOMAIN", None, None),
    ("http://" + "a" * 64 + ".com/", OK, "INVALID_DOMAIN", None, None),
    ("http://" + "a" * 63 + ".com/", OK, "HTTP_SUCCESS", "a" * 63 + ".com", "com"),
    ("http://x.y.ck/", OK, "HTTP_SUCCESS", "x.y.ck", "ck"),
    ("http://a.www.ck/", OK, "HTTP_SUCCESS", "www.ck", "ck"),
    ("http://y.ck/", OK, "INVALID_DOMAIN", None, None),
    ("http://a.b.nosuchtld/", OK, "HTTP_SUCCESS", "b.nosuchtld", "nosuchtld"),
]


@pytest.fixture(scope="module")
def statused(spark):
    rows = [(i, url, json) for i, (url, json, *_) in enumerate(CASES)]
    df = counts.with_status(spark.createDataFrame(rows, "i int, url string, json string"))
    return {r["i"]: r for r in df.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(statused, i):
    _, _, status, site, domain = CASES[i]
    row = statused[i]
    assert (row["host_domain"], row["domain_id"]) == (site, domain)
    assert row["status"] == status


def test_statuses_add_up_and_are_observed(spark):
    from pyspark.sql import Observation

    meta = spark.createDataFrame([(u, j) for u, j, *_ in CASES], "url string, json string")
    table = {r["status"]: r["n"] for r in counts.url_status_counts(meta).collect()}
    assert sum(table.values()) == len(CASES)
    observation = Observation("statuses")
    counted = counts.count_urls_per_domain(meta, observation).collect()
    assert observation.get == {name: table.get(name, 0) for name in counts.STATUSES}
    assert sum(r["n"] for r in counted) == table["HTTP_SUCCESS"]


def test_rules_are_a_parameter(spark):
    rules = parse_rules(["// comment", "com", "my.host.com", "*.wild", "!free.wild"])
    urls = ["http://a.b.my.host.com/", "http://x.a.b.wild/", "http://x.free.wild/", "http://a.b.org/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    loose = [r["host_domain"] for r in with_domains(df, rules=rules).collect()]
    strict = [r["host_domain"] for r in with_domains(df, rules=rules, strict=True).collect()]
    assert loose == ["b.my.host.com", "a.b.wild", "free.wild", "b.org"]
    assert strict[:3] == loose[:3] and strict[3] is None


def test_shipped_rules_hold_both_kinds():
    assert "co.uk" in SHIPPED_RULES.exact[2]
    assert SHIPPED_RULES.wildcard[1] and SHIPPED_RULES.exception[2]


def test_null_and_empty_urls(spark):
    df = spark.createDataFrame([(None,), ("",), ("#f",)], "url string")
    rows = df.select(is_malformed(F.col("url")).alias("bad")).collect()
    assert [r["bad"] for r in rows] == [True, False, False]
    assert with_domains(df).where("host IS NOT NULL").count() == 0


SITES = """
com.uy com.rs=  co.rs gob.es com.ec co.ma com.mt gov.it= co.zw com.ar co.at com.au com.bo com.br com.cn com.co
co.cr com.cy com.do com.eg com.gh com.gr com.gt com.hk com.hn co.hu co.id co.il co.in co.jp co.ke co.kr com.kw
com.lb com.lk com.mx com.my com.ng com.ni co.nz com.om com.pa com.pe com.ph com.pk com.pl com.pt com.py com.qa
com.sa com.sg com.sv co.th com.tn com.tr com.tw co.tz com.ua co.ug co.uk com.ve com.vn co.za com.zm
"""


def test_sites_of_many_registries(spark):
    suffixes = [x for x in SITES.split() if not x.endswith("=")]
    assert len(suffixes) > 50
    rows = [(f"http://www.shop.{x}/p", f"shop.{x}") for x in suffixes]
    rows += [("http://a.b.any.ck/", "b.any.ck"), ("http://a.www.ck/", "www.ck"), ("http://a.b.np/", "a.b.np")]
    rows += [("http://x.shop.com.rs/", "com.rs"), ("http://www.shop.gov.it/", "shop.gov.it")]
    df = with_domains(spark.createDataFrame(rows, "url string, site string"))
    wrong = [tuple(r) for r in df.where("NOT (host_domain <=> site)").select("url", "site", "host_domain").collect()]
    assert wrong == []
