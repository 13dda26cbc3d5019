"""Rule tables, charset sniffing, statuses, pages by host and by segment."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.functions.http import with_html, with_http
from gleaner.functions.suffix_table import suffix_table, with_site
from gleaner.functions.suffixes import SHIPPED_RULES, _shipped_lines, parse_rules
from gleaner.functions.urls import site_of, with_domains
from gleaner.operators import counts, ordered, pages
from gleaner.session import new_folder
from gleaner.sinks import writers
from gleaner.sources import records as src


def lines_of(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "line string")


# ---- rules as a table ----------------------------------------------------------------


def test_table_of_the_shipped_rules_gives_the_same_sites(spark):
    hosts = [f"{a}{b}" for a in ("", "x.", "y.x.") for b in ("co.uk", "uk", "b.co.uk", "ck", "www.ck", "any.ck", "z.any.ck", "com", "unknown", "1.2.3.4", "localhost", "a.tokyo.jp", "gov.bd")]
    urls = spark.createDataFrame([(f"http://{h}/p",) for h in hosts] + [(None,), ("mailto:x",), ("http://bad host/",)], "url string")
    table = suffix_table(lines_of(spark, _shipped_lines()))
    for strict in (False, True):
        want = Counter(with_domains(urls, rules=SHIPPED_RULES, strict=strict).collect())
        got = with_domains(urls, rules=table, strict=strict)
        assert Counter(got.select(*with_domains(urls).columns).collect()) == want


def brute_site(name, rules):
    labels = name.split(".")
    tails = {".".join(labels[-k:]): k for k in range(1, len(labels) + 1)}
    exceptions = [k - 1 for t, k in tails.items() if "!" + t in rules]
    found = [k for t, k in tails.items() if t in rules] + [k + 1 for t, k in tails.items() if "*." + t in rules and k < len(labels)]
    suffix = exceptions[0] if exceptions else max(found, default=1)
    return ".".join(labels[-suffix - 1 :]) if len(labels) > suffix else None


def test_many_rules_against_brute_force(spark):
    rules = {f"r{k % 90}.s{k % 70}.t{k % 5}" for k in range(3000)} | {f"*.s{k}.t1" for k in range(40)} | {f"!x.s{k}.t1" for k in range(0, 40, 3)} | {"t0", "t3"}
    names = [f"{p}{r.removeprefix('*.').removeprefix('!')}" for r in sorted(rules)[:400] for p in ("", "a.", "b.a.")]
    table = suffix_table(lines_of(spark, rules))
    assert table.small and table.depth == 3
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("_tail1", F.lit("kept"))
    got = {r["name"]: (r.site, r["_tail1"]) for r in with_site(df, "name", "site", table).collect()}
    assert got == {n: (brute_site(n, rules), "kept") for n in names}


def test_the_plan_does_not_grow_with_the_rules(spark):
    df = spark.createDataFrame([("a.b.c",)], "name string")
    plans = [len(with_site(df, "name", "site", suffix_table(lines_of(spark, [f"x{k}.c" for k in range(n)])))._jdf.queryExecution().optimizedPlan().toString()) for n in (10, 5000)]
    assert plans[1] < 1.2 * plans[0]
    few = len(df.select(site_of("name", parse_rules(["x.c"])))._jdf.queryExecution().optimizedPlan().toString())
    assert few > 0


def test_both_spellings_of_foreign_rules(spark):
    table = suffix_table(lines_of(spark, ["公司.cn", "*.bücher.de // comment", "!ok.bücher.de", "", "// nothing", "食狮.公司.cn"]))
    names = ["a.xn--55qx5d.cn", "b.a.公司.cn", "c.b.a.xn--bcher-kva.de", "c.ok.xn--bcher-kva.de", "q.xn--85x722f.xn--55qx5d.cn"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.site for r in with_site(df, "name", "site", table).collect()]
    assert got == ["a.xn--55qx5d.cn", "a.公司.cn", "b.a.xn--bcher-kva.de", "ok.xn--bcher-kva.de", "q.xn--85x722f.xn--55qx5d.cn"]


def test_no_rules_and_long_lists(spark):
    df = spark.createDataFrame([("a.b.c",), ("c",), (None,)], "name string")
    none = suffix_table(lines_of(spark, [""]))
    assert [r.site for r in with_site(df, "name", "site", none).collect()] == ["b.c", None, None]
    assert [r.site for r in with_site(df, "name", "site", none, strict=True).collect()] == [None] * 3
    long = suffix_table(lines_of(spark, ["b.c"]), max_bytes=0)
    assert not long.small
    assert {r["name"]: r.site for r in with_site(df, "name", "site", long).collect()} == {"a.b.c": "a.b.c", "c": None, None: None}


def test_operators_take_a_table(spark):
    urls = spark.createDataFrame([("http://x.shop.example/", '{"http_result": 200}')], "url string, json string")
    table = suffix_table(lines_of(spark, ["shop.example"]))
    assert [r.host_domain for r in counts.count_urls_per_host_domain(urls, rules=table).collect()] == ["x.shop.example"]


# ---- charset -------------------------------------------------------------------------


CASES = [
    ("text/html", b"\xef\xbb\xbf<p>\xc3\xa9", "<p>é"),
    ("text/html; charset=iso-8859-1", b"\xef\xbb\xbf<p>\xc3\xa9", "<p>é"),
    ("text/html", "﻿<p>é日".encode("utf-16-le"), "<p>é日"),
    ("text/html", "﻿<p>é日".encode("utf-16-be"), "<p>é日"),
    ("text/html", b'<meta charset="utf-8"><p>\xc3\xa9', '<meta charset="utf-8"><p>é'),
    ("text/html", b"<META http-equiv=x content='text/html; charset=windows-1252'>\x80", "<META http-equiv=x content='text/html; charset=windows-1252'>€"),
    ("text/html", b"<!-- <meta charset=utf-8> --><p>\xe9", "<!-- <meta charset=utf-8> --><p>é"),
    ("text/html", b"<meta charset=utf-16><p>\xc3\xa9", "<meta charset=utf-16><p>é"),
    ("text/html", b" " * 1100 + b"<meta charset=utf-8>\xc3\xa9", " " * 1100 + "<meta charset=utf-8>Ã©"),
    ("text/html; charset=utf-8", b"<meta charset=windows-1252>\xc3\xa9", "<meta charset=windows-1252>é"),
    ("text/html", b"<meta charset=nonsense>\xe9", "<meta charset=nonsense>é"),
    ("text/html", b"\xe9", "é"),
    ("text/html", b"", ""),
]


def test_charset_of_marks_and_meta_elements(spark):
    rows = [(k, "http://x/", "text/html", bytearray(f"HTTP/1.1 200 OK\r\nContent-Type: {t}\r\n\r\n".encode() + b)) for k, (t, b, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, url string, content_type string, payload binary")
    got = {r.id: r.html for r in with_html(with_http(df), sniff=True).collect()}
    assert got == {k: html for k, (_, _, html) in enumerate(CASES)}
    plain = {r.id: r.html for r in with_html(with_http(df)).collect()}
    assert plain[0] == "ï»¿<p>Ã©" and plain[4].endswith("Ã©") and plain[9].endswith("é")


# ---- statuses ------------------------------------------------------------------------


def record_rows(spark):
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>"
    rows = [
        ("/a.arc.gz", "http://www.a.com/1", "text/html", 9, head, "OK"),
        ("/a.arc.gz", "http://www.a.com/2", "text/plain", 9, head, "TRUNCATED"),
        ("/a.arc.gz", "http://www.a.com/3", "text/html", 9, b"no head", "OK"),
        ("/a.arc.gz", "http://www.b.com/4", "text/html", 9, head, "OK"),
        ("/a.arc.gz", "mailto:x", "text/html", 9, head, "OK"),
        ("/a.arc.gz", None, None, None, None, "BAD_GZIP"),
        ("/a.arc.gz", "http://www.a.com/5", None, None, None, "OK"),
        ("/a.arc.gz", "http://www.a.com/6", "text/html", 10**8, head, "OK"),
    ]
    rows = [(p, u, t, n, d and bytearray(d), s) for p, u, t, n, d, s in rows]
    return spark.createDataFrame(rows, "arc_path string, url string, content_type string, content_length int, payload binary, status string")


def test_outcomes_of_host_lists(spark):
    records = record_rows(spark)
    got = pages.host_page_status(records, ["a.com"])
    assert got.columns == [*records.columns, "outcome"]
    want = ["OK", "NOT_HTML", "NO_HTTP", "NOT_LISTED", "INVALID_URIS", "EXCEPTIONS", "NOT_HTML", "NOT_HTML"]
    assert Counter(r.outcome for r in got.collect()) == Counter(want)
    kept = pages.pages_for_hosts(records.where("status IN ('OK', 'TRUNCATED')"), ["a.com"])
    assert {r.url for r in kept.collect()} == {r.url for r in got.where("outcome = 'OK'").collect()}
    assert Counter(r.outcome for r in pages.host_page_status(records, []).collect())["NOT_LISTED"] == 6


def test_outcomes_of_url_lists(spark):
    records = record_rows(spark)
    wanted = spark.createDataFrame([("file:///a.arc.gz", f"http://www.a.com/{k}") for k in (1, 1, 2, 3)] + [(None, None)], "arc_path string, url string")
    got = pages.listed_page_status(records, wanted)
    assert Counter(r.outcome for r in got.collect()) == {"OK": 1, "NOT_HTML": 1, "NO_HTTP": 1, "NOT_LISTED": 4, "EXCEPTIONS": 1}


# ---- layouts -------------------------------------------------------------------------


def test_a_host_list_reads_few_files(spark):
    rows = [(f"http://{h}.site{k}.com/{n}", k) for k in range(60) for h in ("www", "m") for n in range(5)]
    rows += [("http://hot.com/" + str(n), -1) for n in range(300)] + [(None, 0), ("not a url", 0)]
    df = spark.createDataFrame(rows, "url string, n int")
    folder = new_folder(spark, "ordered")
    ordered.write_by_host(df, folder, 16)
    for sites in (["site7.com"], ["site7.com", "site31.com"], ["hot.com"], ["ite7.com"], ["nowhere.org"], ["Site7.com"], []):
        got = ordered.pages_on_sites(spark, folder, sites)
        assert Counter(got.select("url", "n").collect()) == Counter(pages.on_hosts(df, sites).select("url", "n").collect())
    every = len(spark.read.parquet(f"{folder}/pages").inputFiles())
    one = ordered.pages_on_sites(spark, folder, ["site7.com"])
    assert every >= 12 and len(one.inputFiles()) <= 3
    hot = ordered.pages_on_sites(spark, folder, ["hot.com"])
    assert len(hot.inputFiles()) >= 3  # a frequent host fills several files
    listed = spark.createDataFrame([(f"site{k}.com",) for k in range(60)], "s string")
    assert ordered.files_for_sites(spark, folder, listed, max_bytes=0) is None


def test_a_list_of_archives_prunes_folders(spark):
    rows = [(f"/base/seg{s}/{k}.arc.gz", f"http://x/{s}/{k}/{n}") for s in range(6) for k in range(3) for n in range(4)]
    records = pages.by_segment(spark.createDataFrame(rows, "arc_path string, url string"))
    folder = new_folder(spark, "segments")
    records.write.partitionBy("segment").parquet(folder)
    stored = spark.read.schema(records.schema).parquet(folder)
    listed = spark.createDataFrame([("file:/base/seg2/1.arc.gz",), ("/base/seg4/0.arc.gz",), ("/base/seg9/0.arc.gz",), (None,)], "arc_path string")
    got = pages.archive_prune_by_segment(stored, listed)
    want = pages.archive_prune(records, listed)
    assert Counter(got.select("url").collect()) == Counter(want.select("url").collect()) and got.count() == 8
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    long = pages.archive_prune_by_segment(stored, listed, max_list_bytes=0)
    assert Counter(long.select("url").collect()) == Counter(want.select("url").collect())


# ---- SequenceFile modes --------------------------------------------------------------


def test_sequence_file_modes(spark):
    one, two = (spark.createDataFrame([(f"k{n}", f"v{n}")], "k string, v string") for n in (1, 2))
    path = new_folder(spark, "seq")
    read = lambda: {tuple(r) for r in src.scan_seq(spark, path).collect()}
    writers.write_seq(one, path)
    with pytest.raises(Exception, match="exists"):
        writers.write_seq(two, path)
    writers.write_seq(two, path, mode="ignore")
    assert read() == {("k1", "v1")}
    writers.write_seq(two, path, mode="overwrite")
    assert read() == {("k2", "v2")}
    old = src.scan_seq(spark, path)  # the new rows may come from the old files
    writers.write_seq(old.withColumn("value", F.lit("v3")), path, mode="overwrite")
    assert read() == {("k2", "v3")}
    with pytest.raises(ValueError):
        writers.write_seq(one, path, mode="append")
