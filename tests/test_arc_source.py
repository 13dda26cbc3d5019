import gzip
import random

import pytest
from pyspark.sql import functions as F

from gleaner.sources import arc_source
from gleaner.sources import archives as arc

OPENING = b"filedesc://archive 0.0.0.0 20120905000000 text/plain 0\n"


def member(url, payload, header=None):
    line = header or f"{url} 10.0.0.1 20120905120000 text/html {len(payload)}"
    return gzip.compress(line.encode() + b"\n" + payload, compresslevel=6, mtime=0)


def odd_file(seed):
    """Members of all sizes, damaged ones alone and in a row, bad header lines, stored gzip data inside."""
    rng = random.Random(seed)
    parts = [gzip.compress(OPENING)]
    for k in range(60):
        size = rng.choice([0, 10, 500, 5000, 40_000])
        data = member(f"http://h{k % 5}.example.com/{k}", rng.randbytes(size))
        if k % 9 == 4 or k in (30, 31, 32):
            data = data[: len(data) // 2] if k % 2 else data[:-6]
        if k % 13 == 6:
            data = member("", rng.randbytes(800), header="no header line")
        if k % 17 == 3:  # a crawled gzip file does not look like a record
            data = member(f"http://nested/{k}", gzip.compress(rng.randbytes(2000)) * 3)
        parts.append(data)
    return b"".join(parts)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("arcs")
    for k in range(3):
        (root / f"s{k}").mkdir()
        (root / f"s{k}" / f"{k} a.arc.gz").write_bytes(odd_file(k))
    (root / "s0" / "empty.arc.gz").write_bytes(b"")
    (root / "s0" / "junk.arc.gz").write_bytes(b"\x1f\x8b\x08 not gzip" * 50)
    (root / "s0" / "other.txt").write_bytes(b"x")
    return str(root)


def rows(df):
    return sorted(map(str, df.select("arc_path", "arc_offset", "url", "status", "content_length", F.md5("payload")).collect()))


@pytest.mark.parametrize("piece", [1 << 25, 30_000, 2_000])
def test_pieces_give_the_rows_of_whole_files(spark, folder, piece):
    whole = arc.scan_arc(spark, folder, prefix=folder)
    pieces = arc_source.scan_arc_pieces(spark, folder, prefix=folder, piece_bytes=piece)
    assert rows(pieces) == rows(whole)
    assert {r.status for r in pieces.select("status").distinct().collect()} == {"OK", "BAD_GZIP", "BAD_HEADER"}
    if piece < 100_000:
        assert pieces.rdd.getNumPartitions() > 20


def test_every_cut_of_one_file(folder):
    data = odd_file(1)
    read = lambda at, n: data[at : at + n]
    whole = list(arc_source.members_between(read, len(data), 0, len(data)))
    rng = random.Random(8)
    for _ in range(25):
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(rng.randint(1, 12)))})
        got = [m for a, b in zip(cuts, cuts[1:], strict=False) for m in arc_source.members_between(read, len(data), a, b)]
        assert got == whole


def test_files_that_are_not_wanted_are_not_planned(spark, folder):
    all_pieces = arc_source.arc_members(spark, folder, prefix=folder, piece_bytes=30_000)
    one = arc_source.arc_members(spark, folder, prefix=folder, piece_bytes=30_000, files=["/s1/1 a.arc.gz"])
    assert 0 < one.rdd.getNumPartitions() < all_pieces.rdd.getNumPartitions() / 2
    assert {r.arc_path for r in one.select("arc_path").distinct().collect()} == {"/s1/1 a.arc.gz"}
    assert all_pieces.where("arc_path = '/s1/1 a.arc.gz'").count() == one.count()
    none = arc_source.arc_members(spark, folder, files=["/nowhere"])
    assert none.collect() == []


def test_members_that_are_not_wanted_stay_behind(spark, folder):
    urls = ["http://h1.example.com/1", "http://h2.example.com/2"]
    members = arc_source.arc_members(spark, folder, urls=urls, piece_bytes=30_000)
    assert {r.url for r in members.select("url").collect()} - {None} <= set(urls)
    on_host = arc_source.scan_arc_pieces(spark, folder, hosts=["H1.example"], piece_bytes=30_000)
    every = arc_source.scan_arc_pieces(spark, folder, piece_bytes=30_000)
    good = lambda df: rows(arc.readable(df).where("url LIKE '%h1.example%'"))
    assert good(on_host) == good(every) and len(good(every)) > 10
    damaged = lambda df: df.where("status = 'BAD_GZIP'").count()
    assert damaged(on_host) == damaged(every)


def test_a_task_holds_one_member(folder):
    """What is not wanted is not held, and a piece reads little beyond its end."""
    data = odd_file(2)
    asked = []

    def read(at, n):
        asked.append((at, n))
        return data[at : at + n]

    list(arc_source.members_between(read, len(data), 100_000, 130_000, lambda header: False))
    assert max(n for _, n in asked) <= arc_source.READ_AHEAD
    assert sum(1 for at, _ in asked if at < 100_000) == 0
