"""Archive files as a data source of Spark, split by byte ranges.

``spark.read.format("arc").load(folder)`` gives ``arc_path, arc_offset, url, header, rest`` of every
member after a file's first one.  A file is planned as pieces of ``pieceBytes``; the task of a piece finds the first
sound member at or after its start, reads on member by member, and stops at the first sound member
at or after its end, where the next piece begins.  So a task holds one member at a time, and rows are
those of a scan of whole files.  The options ``files`` leave out files before any is opened,
``urls`` and ``hosts`` leave members behind while unpacking.

These conditions are options and not pushed filters: with ``spark.sql.python.filterPushdown.enabled`` Spark 4.1
keeps what one query pushed with the loaded table, and later queries on it lose rows (tried).

Places are told by a gzip signature whose member inflates, has a true check sum and starts with a
sound header line.  A crawled archive inside an archive, stored without compression, could be taken
for such a place; then its records would come out as well.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleaner.sources.archives import FLUSH_BYTES, GZIP_MAGIC, HEADER_LINE, HeaderTest, lists, mentions, parse_records
from gleaner.sources.records import SCHEME_AND_HOST

SCHEMA = "arc_path string, arc_offset bigint, url string, header string, rest binary"
PIECE_BYTES = 32 << 20
READ_AHEAD = 1 << 20
FEED_BYTES = 1 << 14

Read = Callable[[int, int], bytes]


class _Inflated:
    """The member that starts at ``start``: sound or not, its content (if wanted) and where it ends."""

    def __init__(self, read: Read, size: int, start: int, keep: HeaderTest | None):
        inflater, position, parts = zlib.decompressobj(31), start, []
        self.sound, self.wanted, self.header = False, True, None
        line: list[bytes] = []
        try:
            while position < size and not inflater.eof:
                piece = read(position, FEED_BYTES)
                if not piece:
                    break
                position += len(piece)
                inflated = inflater.decompress(piece)
                if self.wanted:
                    parts.append(inflated)
                if self.header is None:
                    line.append(inflated)
                    if b"\n" in inflated or inflater.eof:
                        self.header = b"".join(line).partition(b"\n")[0].decode("latin-1")
                        self.wanted = keep is None or keep(self.header)
                        parts = parts if self.wanted else []
            self.sound = inflater.eof
        except zlib.error:
            pass
        self.end = position - len(inflater.unused_data)
        self.rest = b"".join(parts).partition(b"\n")[2] if self.sound and self.wanted else None

    @property
    def starts_a_piece(self) -> bool:
        return self.sound and re.match(HEADER_LINE, self.header or "") is not None


def _next_signature(read: Read, size: int, start: int) -> int:
    while start < size:
        found = read(start, READ_AHEAD)
        at = found.find(GZIP_MAGIC)
        if at >= 0:
            return start + at
        start += max(1, len(found) - len(GZIP_MAGIC) + 1)
    return size


def members_between(
    read: Read, size: int, start: int, end: int, keep: HeaderTest | None = None
) -> Iterator[tuple[int, str | None, bytes | None]]:
    """Offset, header line and rest of the members that belong to a piece; both null where one is damaged.

    ``read(position, n)`` gives up to n bytes.  The first member of the file is passed over.
    """
    position = start
    if start:
        while True:
            position = _next_signature(read, size, position)
            if position >= min(end, size):
                return
            if _Inflated(read, size, position, lambda header: False).starts_a_piece:
                break
            position += 1
    damaged = False
    while position < size:
        if position >= end and _Inflated(read, size, position, lambda header: False).starts_a_piece:
            return
        member = _Inflated(read, size, position, keep)
        if member.sound:
            if member.wanted and position:
                yield position, member.header, member.rest
            position, damaged = member.end, False
            continue
        if not damaged and position:
            yield position, None, None
        damaged = True
        position = _next_signature(read, size, position + 1)


class _Window:
    """Reads of a file through one buffer, so that short reads close together ask for it once."""

    def __init__(self, file):
        self.file, self.size, self.start, self.data = file, file.size(), 0, b""

    def __call__(self, position: int, n: int) -> bytes:
        n = min(n, self.size - position)
        if n <= 0:
            return b""
        at = position - self.start
        if at < 0 or at + n > len(self.data):
            self.start, at = position, 0
            self.data = self.file.read_at(min(max(n, READ_AHEAD), self.size - position), position)
        return self.data[at : at + n]


def _file_system(path: str):
    from pyarrow import fs

    plain = re.sub("^file:/*", "/", path)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(plain)


class Piece(InputPartition):
    def __init__(self, name: str, arc_path: str, start: int, end: int):
        self.name, self.arc_path, self.start, self.end = name, arc_path, start, end


class ArcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.name_part = options.get("namepart", ".arc.gz")
        self.prefix = options.get("prefix", "")
        self.piece_bytes = int(options.get("piecebytes", PIECE_BYTES))
        self.files, self.urls, self.hosts = (json.loads(options.get(k, "[]")) for k in ("files", "urls", "hosts"))

    def _keep(self) -> HeaderTest | None:
        tests = [lists(self.urls)] * bool(self.urls) + [mentions(self.hosts)] * bool(self.hosts)
        return (lambda header: all(test(header) for test in tests)) if tests else None

    def partitions(self):
        from pyarrow import fs

        system, root = _file_system(self.path)
        found = system.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        prefix = re.sub("^/+", "/", re.sub(SCHEME_AND_HOST, "", self.prefix))
        pieces, wanted = [], frozenset(self.files)
        for file in sorted(files, key=lambda f: f.path):
            if file.type != fs.FileType.File or self.name_part not in file.base_name:
                continue
            plain = "/" + unquote(file.path.lstrip("/"))
            arc_path = plain.removeprefix(prefix)
            if not wanted or arc_path in wanted:
                for start in range(0, max(1, file.size), self.piece_bytes):
                    pieces.append(Piece(file.path, arc_path, start, start + self.piece_bytes))
        return pieces

    def read(self, partition):
        if partition is None:
            return
        system, _ = _file_system(self.path)
        keep = self._keep()
        with system.open_input_file(partition.name) as file:
            read, held, rows = _Window(file), 0, []
            for offset, header, rest in members_between(read, read.size, partition.start, partition.end, keep):
                url = None if header is None else header.split(" ", 1)[0]
                rows.append((partition.arc_path, offset, url, header, rest))
                held += len(rest or b"")
                if held > FLUSH_BYTES:
                    yield _batch(rows)
                    held, rows = 0, []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.record_batch(columns, names=["arc_path", "arc_offset", "url", "header", "rest"])


class ArcSource(DataSource):
    @classmethod
    def name(cls):
        return "arc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArcReader(self.options)


def arc_members(
    spark: SparkSession,
    path: str,
    name_part: str = ".arc.gz",
    prefix: str = "",
    piece_bytes: int = PIECE_BYTES,
    files: Sequence[str] = (),
    urls: Sequence[str] = (),
    hosts: Sequence[str] = (),
) -> DataFrame:
    """The members of archive files below ``path``, one task a piece.

    Short lists limit the scan: to files by ``arc_path``, and, besides damaged members, to those whose header line
    has one of the ``urls`` or names one of the ``hosts``.  Long lists go to ``scan_listed_arc``.
    """
    spark.dataSource.register(ArcSource)
    options = {"namePart": name_part, "prefix": prefix, "pieceBytes": str(piece_bytes)}
    options |= {k: json.dumps(list(v)) for k, v in (("files", files), ("urls", urls), ("hosts", hosts))}
    return spark.read.format("arc").options(**options).load(path)


def scan_arc_pieces(spark: SparkSession, path: str, **limits) -> DataFrame:
    """The records of :func:`sources.archives.scan_arc`, read by as many tasks as files have pieces; arguments as in :func:`arc_members`."""
    return parse_records(arc_members(spark, path, **limits).drop("url"))
