import gzip
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from gleaner.functions.http import first_header, with_http
from gleaner.operators import pages
from gleaner.sources import archives as arc

HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: %s\r\nX-A: 1\r\n 2\r\nx-a: b\r\n\r\n"


def response(content_type: bytes, body: bytes) -> bytes:
    return HEAD % content_type + body


def member(url, payload, length=None, time="20120905120000", content_type="text/html"):
    declared = len(payload) if length is None else length
    line = f"{url} 1.2.3.4 {time} {content_type} {declared}\n"
    return gzip.compress(line.encode() + payload, mtime=0)


OPENING = gzip.compress(b"filedesc://x 0.0.0.0 20120905120000 text/plain 0\nversion", mtime=0)
GOOD = response(b"text/html; charset=utf-8", "é<p>".encode())

# name, member, status, HTML or None
MEMBERS = [
    ("utf8", member("http://a.com/utf8", GOOD), "OK", "é<p>"),
    ("latin", member("http://a.com/latin", response(b"text/html", b"\xe9")), "OK", "é"),
    ("cp1252", member("http://a.com/cp", response(b"text/html; charset=windows-1252", b"\x80")), "OK", "€"),
    ("quoted", member("http://a.com/q", response(b'text/html; charset="UTF-8"', "é".encode())), "OK", "é"),
    ("unknown", member("http://a.com/u", response(b"text/html; charset=nope", b"\xe9")), "OK", "é"),
    ("codec", member("http://a.com/k", response(b"text/html; charset=base64", b"\xe9")), "OK", "é"),
    ("escape", member("http://a.com/r", response(b"text/html; charset=unicode_escape", b"\\u41")), "OK", "\\u41"),
    ("null name", member("http://a.com/o", response(b"text/html; charset=a\x00b", b"\xe9")), "OK", "é"),
    ("broken utf8", member("http://a.com/b", response(b"text/html; charset=utf-8", b"a\xffb")), "OK", "a�b"),
    ("no head", member("http://a.com/n", b"just text"), "OK", None),
    ("no colon", member("http://a.com/c", b"HTTP/1.0 200 OK\r\nbad\r\n\r\nx"), "OK", None),
    ("no status", member("http://a.com/s", b"hello\r\nA: b\r\n\r\nx"), "OK", None),
    ("not html", member("http://a.com/t", GOOD, content_type="text/plain"), "OK", None),
    ("ftp", member("ftp://a.com/f", GOOD), "OK", None),
    ("long", member("http://a.com/l", GOOD + b"more", len(GOOD)), "OK", "é<p>"),
    ("short", member("http://a.com/h", GOOD, len(GOOD) + 9), "TRUNCATED", "é<p>"),
    ("empty body", member("http://a.com/e", response(b"text/html", b"")), "OK", ""),
    ("four fields", gzip.compress(b"http://a.com 1.2.3.4 20120905120000 5\nhello"), "BAD_HEADER", None),
    ("month 13", member("http://a.com/m", GOOD, time="20121305120000"), "BAD_HEADER", None),
    ("negative", member("http://a.com/g", GOOD, -1), "BAD_HEADER", None),
    ("huge length", member("http://a.com/g", GOOD, 99999999999), "BAD_HEADER", None),
    ("bad gzip", b"\x1f\x8b\x08 this is not deflated", "BAD_GZIP", None),
    ("after damage", member("http://a.com/z", GOOD), "OK", "é<p>"),
    ("cut off", member("http://a.com/x", GOOD)[:-4], "BAD_GZIP", None),
]


def archive() -> tuple[bytes, list[int]]:
    data, offsets = OPENING, []
    for _, content, _, _ in MEMBERS:
        offsets.append(len(data))
        data += content
    return data, offsets


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("arc")
    (path / "one.arc.gz").write_bytes(archive()[0])
    (path / "two.arc.gz").write_bytes(OPENING + member("http://b.org/1", GOOD))
    (path / "empty.arc.gz").write_bytes(OPENING)
    (path / "other.txt").write_bytes(b"no archive")
    return path


@pytest.fixture(scope="module")
def records(spark, folder):
    return arc.scan_arc(spark, str(folder), prefix=f"file:{folder}/").cache()


def test_members_and_offsets(records):
    rows = records.where("arc_path = 'one.arc.gz'").orderBy("arc_offset").collect()
    assert [r["arc_offset"] for r in rows] == archive()[1]
    assert [r["status"] for r in rows] == [status for _, _, status, _ in MEMBERS]


def test_only_archives_are_read(records):
    assert {r["arc_path"] for r in records.collect()} == {"one.arc.gz", "two.arc.gz"}


def test_html(records):
    found = pages.arc_html(arc.readable(records.where("arc_path = 'one.arc.gz'")))
    want = sorted(html for _, _, _, html in MEMBERS if html is not None)
    assert sorted(r["html"] for r in found.collect()) == want


def test_header_fields(records):
    row = records.where("url = 'http://b.org/1'").first()
    stamp = records.where("url = 'http://b.org/1'").select(F.unix_timestamp("archive_ts")).first()[0]
    assert stamp == datetime(2012, 9, 5, 12, tzinfo=UTC).timestamp()
    assert (row["ip"], row["content_type"], row["content_length"]) == ("1.2.3.4", "text/html", len(GOOD))
    assert bytes(row["payload"]) == GOOD


def test_http_headers_keep_order_and_copies(records):
    row = with_http(records.where("url = 'http://b.org/1'")).first()
    assert [tuple(h) for h in row["http_headers"]] == [
        ("Content-Type", "text/html; charset=utf-8"), ("X-A", "1 2"), ("x-a", "b")
    ]
    assert row["http_status"] == 200 and bytes(row["body"]) == "é<p>".encode()
    named = with_http(records).select(first_header(F.col("http_headers"), "X-a").alias("v"))
    assert {r["v"] for r in named.collect()} == {"1 2", "b", None} - {"b"}


def test_unparsed_status(records):
    rows = with_http(records).where("http_status = -1").collect()
    assert all(r["http_headers"] is None and r["body"] is None for r in rows)
    assert "http://a.com/n" in {r["url"] for r in rows}


def test_time_does_not_depend_on_the_session_zone(spark, folder):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = arc.scan_arc(spark, f"{folder}/two.arc.gz")
        assert df.select(F.unix_timestamp("archive_ts")).first()[0] == 1346846400
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_header_tests_leave_out_other_members(spark, folder, records):
    prefix = f"file:{folder}/"
    urls = {"http://a.com/latin", "http://b.org/1", "http://a.com/missing"}
    by_url = arc.readable(arc.scan_arc(spark, str(folder), prefix=prefix, keep=arc.lists(urls)))
    want = arc.readable(records).where(F.col("url").isin(list(urls)))
    assert sorted(by_url.collect()) == sorted(want.collect())
    by_host = arc.scan_arc(spark, str(folder), prefix=prefix, keep=arc.mentions(["B.org"]))
    assert {r["url"] for r in arc.readable(by_host).collect()} == {"http://b.org/1"}
    # damage is still reported
    assert by_host.where("status = 'BAD_GZIP'").count() == 2


def test_long_header_line_is_tested_whole():
    import random

    noise = random.Random(2).randbytes(200_000).hex()
    data = OPENING + member(f"http://a.com/{noise}end", b"x")
    kept = list(arc.inflate_members(memoryview(data), lambda line: "end 1.2.3.4" in line))
    assert [o for o, _ in kept] == [len(OPENING)]


def test_large_member_spans_feeds(spark):
    import random

    body = random.Random(1).randbytes(300_000)
    data = OPENING + member("http://a.com/1", body) + member("http://a.com/2", b"x")
    got = [(o, len(m)) for o, m in arc.inflate_members(memoryview(data))]
    assert len(got) == 3 and got[1][1] > 300_000


def test_signature_found_across_search_steps():
    gap = b"z" * ((1 << 20) - 1)
    data = gap + OPENING
    assert [o for o, m in arc.inflate_members(memoryview(data)) if m] == [len(gap)]


def test_listed_archives(spark, folder):
    prefix = f"file:{folder}/"
    wanted = spark.createDataFrame([("two.arc.gz",), ("two.arc.gz",), (None,)], "arc_path string")
    df = arc.scan_listed_arc(spark, str(folder), wanted, prefix)
    assert [(r["arc_path"], r["url"]) for r in df.collect()] == [("two.arc.gz", "http://b.org/1")]


@pytest.mark.parametrize("form", ["{}/two.arc.gz", "file:{}/two.arc.gz", "file://{}/two.arc.gz", "two.arc.gz"])
def test_paths_of_any_form(spark, folder, form):
    listed = form.format(folder)
    wanted = spark.createDataFrame([(listed, "http://b.org/1"), (listed, "http://b.org/none")], "arc_path string, url string")
    for root in (str(folder), f"file:{folder}", f"file://{folder}"):
        found = arc.scan_listed_arc(spark, root, wanted)
        assert [r["url"] for r in found.collect()] == ["http://b.org/1"]
        assert [r["url"] for r in pages.html_for_urls(arc.readable(found), wanted).collect()] == ["http://b.org/1"]
    if "/" in form:  # the records of a scan of everything, with the same list
        records = arc.readable(arc.scan_arc(spark, str(folder)))
        assert [r["url"] for r in pages.html_for_urls(records, wanted).collect()] == ["http://b.org/1"]
        assert {r["url"] for r in pages.archive_prune(records, wanted).collect()} == {"http://b.org/1"}


def test_listed_archives_that_do_not_exist(spark, folder):
    prefix = f"file:{folder}/"
    for copies in (1, 300):  # the same at any length of the list
        rows = [("two.arc.gz",)] + [(f"gone{k}.arc.gz",) for k in range(copies)]
        wanted = spark.createDataFrame(rows, "arc_path string")
        with pytest.raises(Exception, match="FileNotFoundError"):
            arc.scan_listed_arc(spark, str(folder), wanted, prefix).collect()
        df = arc.scan_listed_arc(spark, str(folder), wanted, prefix, skip_missing=True)
        found = df.select("url", "status").collect()
        assert [r["url"] for r in found if r["status"] == "OK"] == ["http://b.org/1"]
        assert sum(r["status"] == "MISSING_FILE" for r in found) == copies


def test_offsets_give_the_rows_of_a_whole_scan(spark, folder):
    whole = arc.scan_arc(spark, str(folder)).select("arc_path", "arc_offset", "url", "status", "payload")
    rows = {(r["arc_path"], r["arc_offset"]): tuple(r) for r in whole.collect() if r["status"] != "BAD_GZIP"}
    wanted = spark.createDataFrame(list(rows), "arc_path string, arc_offset bigint")
    found = arc.scan_listed_arc(spark, str(folder), wanted)
    got = found.select("arc_path", "arc_offset", "url", "status", "payload").collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows.values(), key=str)


def test_a_member_costs_its_own_bytes():
    import random

    members = [gzip.compress(random.Random(k).randbytes(20_000), mtime=0) for k in range(200)]
    data, read = b"".join(members), []

    def reader(at, size):
        read.append(len(data[at : at + size]))
        return data[at : at + size]

    offset = sum(map(len, members[:120]))
    assert arc.member_at(reader, offset) == random.Random(120).randbytes(20_000)
    assert sum(read) <= arc.READ_BYTES + 21_000 < len(data) / 40
    assert arc.member_at(reader, 3) is None and arc.member_at(reader, len(data)) is None
    assert arc.member_at(lambda at, n: data[: len(members[0]) - 5][at : at + n], 0) is None


def test_no_archives_listed(spark, folder):
    wanted = spark.createDataFrame([], "arc_path string")
    assert arc.scan_listed_arc(spark, str(folder), wanted).count() == 0


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_html_for_urls_pairs(spark, records, max_bytes):
    wanted = spark.createDataFrame(
        [("two.arc.gz", "http://b.org/1"), ("two.arc.gz", "http://a.com/utf8"), ("one.arc.gz", "http://a.com/q")],
        "arc_path string, url string",
    )
    rows = arc.readable(records)
    paired = pages.html_for_urls(rows, wanted, max_list_bytes=max_bytes)
    loose = pages.html_for_urls(rows, wanted, pairwise=False, max_list_bytes=max_bytes)
    assert {r["url"] for r in paired.collect()} == {"http://b.org/1", "http://a.com/q"}
    assert {r["url"] for r in loose.collect()} == {"http://b.org/1", "http://a.com/q", "http://a.com/utf8"}


def test_pages_for_hosts_is_exact(records):
    rows = arc.readable(records)
    assert pages.pages_for_hosts(rows, ["b.org"]).count() == 1
    assert pages.pages_for_hosts(rows, ["B.org", " b.org"]).count() == 0


def test_size_limit_is_strict(spark):
    rows = [("text/html", 10), ("text/html", 9), ("TEXT/HTML", 1), ("application/xhtml", 1)]
    df = spark.createDataFrame(rows, "content_type string, content_length int")
    kept = pages.filter_html_size(df, 10).collect()
    assert [tuple(r) for r in kept] == [("text/html", 9), ("application/xhtml", 1)]
