"""Archive files: gzip members glued together, one crawl record in each.

Python only inflates members and cuts off their first line; Spark does the rest.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.once import with_once
from gleaner.sources.records import without_prefix

GZIP_MAGIC = b"\x1f\x8b\x08"
FEED_BYTES = 1 << 14
FLUSH_BYTES = 1 << 21
READ_BYTES = 1 << 16
# an archive with places in several pieces of this size may be read by several tasks
PIECE_BYTES = 64 << 20
SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*:"

MEMBER_SCHEMA = "arc_path string, arc_offset long, header string, rest binary"
# Fixed format: address, IP, time, content type and length, one blank between them.
HEADER_LINE = r"^([^ ]*) ([^ ]*) ([0-9]{14}) ([^ ]*) ([+-]?[0-9]+) *$"

HeaderTest = Callable[[str], bool]


def inflate_members(
    data: memoryview, keep: HeaderTest | None = None
) -> Iterator[tuple[int, bytes | None]]:
    """(offset, content) per gzip member; content is None where one is damaged.

    The input is fed in slices, so the work stays linear in the file size.  After
    damage the search goes on at the next gzip signature.  Members whose first line
    fails ``keep`` are passed over without holding their content.
    """
    start, size, damaged = 0, len(data), False
    while start < size:
        inflater, position = zlib.decompressobj(31), start
        parts, tested, wanted = [], keep is None, True
        try:
            while position < size and not inflater.eof:
                piece = data[position : position + FEED_BYTES]
                inflated = inflater.decompress(piece)
                position += len(piece)
                if wanted:
                    parts.append(inflated)
                if not tested and (b"\n" in inflated or inflater.eof):
                    tested, wanted = True, keep(_cut_line(b"".join(parts))[0])
                    parts = parts if wanted else []
            complete = inflater.eof
        except zlib.error:
            complete = False
        if complete:
            if wanted:
                yield start, b"".join(parts)
            start, damaged = position - len(inflater.unused_data), False
            continue
        if not damaged:
            yield start, None
        damaged = True
        start = _next_signature(data, start + 1)


def mentions(hosts: Iterable[str]) -> HeaderTest:
    """Header test: the line holds one of the host names, in any letter case.

    Coarser than a test of the site, so that one can follow.
    """
    names = [host.lower() for host in hosts]
    return lambda line: any(name in line.lower() for name in names)


def lists(urls: Iterable[str]) -> HeaderTest:
    """Header test: the line's URL is one of these."""
    wanted = frozenset(urls)
    return lambda line: line.split(" ", 1)[0] in wanted


def _next_signature(data: memoryview, start: int) -> int:
    step = 1 << 20
    while start < len(data):
        found = bytes(data[start : start + step + len(GZIP_MAGIC) - 1]).find(GZIP_MAGIC)
        if found >= 0:
            return start + found
        start += step
    return len(data)


def _split_batches(
    batches: Iterator[pa.RecordBatch], keep: HeaderTest | None
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0)
        for row, content in enumerate(batch.column(1)):
            path, held, pending = paths[row].as_py(), 0, []
            for offset, member in inflate_members(memoryview(content.as_buffer()), keep):
                if offset == 0:
                    continue  # the file's own header record
                header, rest = (None, None) if member is None else _cut_line(member)
                pending.append((path, offset, header, rest))
                held += len(rest or b"")
                if held > FLUSH_BYTES:
                    yield _as_batch(pending)
                    held, pending = 0, []
            if pending:
                yield _as_batch(pending)


def _cut_line(member: bytes) -> tuple[str, bytes]:
    line, _, rest = member.partition(b"\n")
    return line.decode("latin-1"), rest


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.binary()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.record_batch(columns, names=["arc_path", "arc_offset", "header", "rest"])


def archive_files(
    spark: SparkSession, paths: str | list[str], name_part: str = ".arc.gz", prefix: str = ""
) -> DataFrame:
    """``arc_path, content``, one row per file.

    Files are about 100 MB and cannot be split, so the scan gives each its own task;
    ``spark.sql.files.maxPartitionBytes`` bounds how many small ones share one.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.option("pathGlobFilter", f"*{name_part}*").load(paths)
    return files.select(without_prefix(F.col("path"), prefix).alias("arc_path"), "content")


def split_members(files: DataFrame, keep: HeaderTest | None = None) -> DataFrame:
    """``header`` line and ``rest`` of each gzip member after a file's first; null if damaged.

    With ``keep`` the payloads of other members stay out of the exchange with Python.
    """
    return files.select("arc_path", "content").mapInArrow(
        lambda batches: _split_batches(batches, keep), MEMBER_SCHEMA
    )


def parse_header(df: DataFrame, line: str = "header") -> DataFrame:
    """Add the five header fields and ``header_ok`` to a header line column.

    All fields are null unless the line is sound: exactly five parts, a real
    ``yyyyMMddHHmmss`` time (taken as UTC) and a length that is not negative.
    """

    def field(i):
        return F.regexp_extract(F.col(line), HEADER_LINE, i)

    time = F.try_to_timestamp(F.concat(field(3), F.lit("+0000")), F.lit("yyyyMMddHHmmssXX"))
    sound = F.col(line).rlike(HEADER_LINE) & time.isNotNull() & (field(5).try_cast("int") >= 0)
    df = with_once(df, "header_ok", F.coalesce(sound, F.lit(False)))

    def kept(value, name):
        return F.when(F.col("header_ok"), value).alias(name)

    return df.select(
        "*",
        kept(field(1), "url"),
        kept(field(2), "ip"),
        kept(time, "archive_ts"),
        kept(field(4), "content_type"),
        kept(field(5).try_cast("int"), "content_length"),
    )


def parse_records(members: DataFrame) -> DataFrame:
    """Header fields and payload of each member; ``status`` says what was found.

    A payload longer than declared is cut at the declared length; a shorter one is
    kept and marked TRUNCATED.
    """
    df = parse_header(members)
    status = (
        F.when(F.col("arc_offset").isNull(), "MISSING_FILE")
        .when(F.col("header").isNull(), "BAD_GZIP")
        .when(~F.col("header_ok"), "BAD_HEADER")
        .when(F.octet_length("rest") < F.col("content_length"), "TRUNCATED")
        .otherwise("OK")
    )
    return df.select(
        "arc_path", "arc_offset", "url", "ip", "archive_ts", "content_type", "content_length",
        F.substring("rest", F.lit(1), F.col("content_length")).alias("payload"),
        status.alias("status"),
    )


def readable(records: DataFrame) -> DataFrame:
    """Records with a sound header."""
    return records.where(F.col("status").isin("OK", "TRUNCATED"))


def scan_arc(
    spark: SparkSession,
    paths: str | list[str],
    name_part: str = ".arc.gz",
    prefix: str = "",
    keep: HeaderTest | None = None,
) -> DataFrame:
    """All records of archive files, damaged ones included: see ``status``.

    ``keep`` (:func:`mentions`, :func:`lists`) leaves out sound members by their header line.
    """
    return parse_records(split_members(archive_files(spark, paths, name_part, prefix), keep))


def member_at(read: Callable[[int, int], bytes], offset: int) -> bytes | None:
    """The gzip member that starts at ``offset``, or None if it is damaged.

    ``read(position, size)`` is asked for no more than the member, up to ``READ_BYTES``.
    """
    inflater, parts, position = zlib.decompressobj(31), [], offset
    try:
        while not inflater.eof:
            piece = read(position, READ_BYTES)
            if not piece:
                return None
            parts.append(inflater.decompress(piece))
            position += len(piece)
    except zlib.error:
        return None
    return b"".join(parts)


def _open(path: str, root: str, prefix: str):
    """A listed file on the file system it names, or else on that of ``prefix`` or ``root``."""
    from pyarrow import fs

    if re.match(SCHEME, path):
        target = path
    elif prefix:
        target = prefix + path
    elif path.startswith("/"):
        target = (re.match(f"{SCHEME}(//[^/]*)?", root) or re.match("", "")).group() + path
    else:
        target = f"{root.rstrip('/')}/{path}"
    target = re.sub("^file:/*", "/", target)
    system, name = (fs.LocalFileSystem(), target) if target.startswith("/") else fs.FileSystem.from_uri(target)
    return system.open_input_file(name)


def _read_listed(batches, root: str, prefix: str, skip_missing: bool, keep: HeaderTest | None, has_urls: bool, has_offsets: bool):
    """Members of listed files; rows come ordered by file."""
    current, urls, offsets = None, set(), []

    def members():
        try:
            file = _open(current, root, prefix)
        except FileNotFoundError:
            if not skip_missing:
                raise
            yield (current, None, None, None)
            return
        test = keep
        if has_urls and None not in urls:
            listed = lists(urls)
            test = listed if keep is None else lambda line: listed(line) and keep(line)
        with file:
            if has_offsets and None not in offsets:
                for offset in sorted(set(offsets)):
                    member = member_at(lambda at, n: file.read_at(min(n, file.size() - at), at) if at < file.size() else b"", offset)
                    header, rest = (None, None) if member is None else _cut_line(member)
                    if header is None or test is None or test(header):
                        yield (current, offset, header, rest)
                return
            for offset, member in inflate_members(memoryview(file.read()), test):
                if offset:
                    yield (current, offset, *((None, None) if member is None else _cut_line(member)))

    def flushed():
        held, pending = 0, []
        for row in members():
            pending.append(row)
            held += len(row[3] or b"")
            if held > FLUSH_BYTES:
                yield _as_batch(pending)
                held, pending = 0, []
        if pending:
            yield _as_batch(pending)

    for batch in batches:
        for path, _, url, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != current or (has_offsets and len(offsets) > 10_000):
                if current is not None:
                    yield from flushed()
                current, urls, offsets = path, set(), []
            urls.add(url)
            offsets.append(offset)
    if current is not None:
        yield from flushed()


def scan_listed_arc(
    spark: SparkSession,
    root: str,
    wanted: DataFrame,
    prefix: str = "",
    keep: HeaderTest | None = None,
    skip_missing: bool = False,
) -> DataFrame:
    """Records of the archives named in ``wanted.arc_path``; other files are not opened.

    Only the list is shuffled: a task gets the rows of some archives and opens the files
    itself, through Arrow's file systems.  A listed path may name its file system; else it
    follows ``prefix``, or lies on the file system of ``root``, or below ``root`` if it has no
    leading slash.  If ``wanted`` has ``url``, other records stay behind while unpacking; if it has
    ``arc_offset``, only the members at these places are read.  A null in either column asks for
    the whole of the file.  A listed file that does not exist raises, or with ``skip_missing``
    gives one row with status MISSING_FILE, however long the list is.
    """
    has_urls, has_offsets = "url" in wanted.columns, "arc_offset" in wanted.columns
    rows = wanted.where("arc_path IS NOT NULL").select(
        "arc_path",
        (F.floor(F.col("arc_offset") / PIECE_BYTES) if has_offsets else F.lit(0)).cast("bigint").alias("piece"),
        (F.col("url") if has_urls else F.lit(None)).cast("string").alias("url"),
        (F.col("arc_offset") if has_offsets else F.lit(None)).cast("bigint").alias("arc_offset"),
    )
    dealt = rows.distinct().repartition("arc_path", "piece").sortWithinPartitions("arc_path", "piece", "arc_offset")
    members = dealt.mapInArrow(
        lambda batches: _read_listed(batches, root, prefix, skip_missing, keep, has_urls, has_offsets), MEMBER_SCHEMA
    )
    return parse_records(members)
