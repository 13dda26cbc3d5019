"""HTTP responses in record payloads, cut and decoded by Spark expressions.

Only charsets the JVM functions do not cover go through a vectorised Python function.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions.once import with_once

HEADERS_TYPE = "array<struct<name:string,value:string>>"
LATIN = "ISO-8859-1"
BLANK_LINE = "\r\n\r\n"
UNPARSED = -1
# Fixed format of an HTTP head: a status line, and a colon after the name in every further
# line that does not continue the one before.
STATUS_LINE = r"^\s*HTTP/[0-9]+\.[0-9]+\s+([0-9]{1,9})(?:\s|$)"
BAD_HEADER_LINE = r"\n(?![ \t])(?::|[^:\n]*(?:\n|$))"

# Names of the charsets decoded inside the JVM.
LATIN_NAMES = ["", "ISO-8859-1", "ISO8859-1", "ISO_8859-1", "LATIN1", "L1"]
UTF8_NAMES = ["UTF-8", "UTF8"]
# Python's own text codecs, which are no charsets of web pages.
PYTHON_CODECS = {"idna", "punycode", "raw-unicode-escape", "undefined", "unicode-escape", "utf-7"}


def _latin(data: Column) -> Column:
    return F.decode(data, LATIN)


def with_http(df: DataFrame, url: str = "url", payload: str = "payload") -> DataFrame:
    """Add ``http_status``, ``http_headers`` (in order, duplicates kept) and ``body``.

    The status is -1 and the rest null where the URL is not http(s), the payload has no
    blank line, or its head is not an HTTP response.
    """
    data, as_text = F.col(payload), F.col(payload).cast("string")
    is_web = F.col(url).isNull() | F.col(url).rlike("^https?://")
    # byte-wise search: the payload is not decoded to find the end of the head
    head_bytes = F.substring_index(as_text, BLANK_LINE, 1)
    head = F.when(is_web & as_text.contains(BLANK_LINE), _latin(head_bytes.cast("binary")))
    df = with_once(df, "_head", head)
    sound = F.col("_head").rlike(STATUS_LINE) & ~F.col("_head").rlike(BAD_HEADER_LINE)
    status = F.when(sound, F.regexp_extract("_head", STATUS_LINE, 1).try_cast("int"))
    df = with_once(df, "_status", status)
    sound = F.col("_status").isNotNull()
    # the head has one byte per character
    body = F.substring(data, F.length("_head") + len(BLANK_LINE) + 1, F.octet_length(data))
    lines = F.split(F.regexp_replace("_head", r"\r?\n[ \t]+", " "), r"\r?\n")
    headers = F.transform(
        F.slice(lines, F.lit(2), F.size(lines)),
        lambda h: F.struct(
            F.trim(F.substring_index(h, ":", 1)).alias("name"),
            F.trim(F.substring(h, F.instr(h, ":") + 1, F.length(h))).alias("value"),
        ),
    )
    return df.select(
        *[c for c in df.columns if c not in ("_head", "_status")],
        F.coalesce("_status", F.lit(UNPARSED)).alias("http_status"),
        F.when(sound, headers).cast(HEADERS_TYPE).alias("http_headers"),
        F.when(sound, body).alias("body"),
    )


def first_header(headers: Column, name: str) -> Column:
    """Value of the first header of that name, in any letter case; null if there is none."""
    return F.try_element_at(
        F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(1)
    )["value"]


def charset_name(content_type: Column) -> Column:
    """Upper-case charset parameter of a Content-Type value; empty if it names none."""
    found = F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*[\"']?([^\s;\"']+)", 1)
    return F.coalesce(F.upper(found), F.lit(""))


#: Fixed values of the HTML standard: byte-order marks, and how far a page is searched for its charset.
MARKS = (("EFBBBF", "UTF-8"), ("FEFF", "UTF-16BE"), ("FFFE", "UTF-16LE"))
SEARCHED_BYTES = 1024
META_CHARSET = r"(?is)<meta[^>]{0,200}?[\s\"';/]charset\s*=\s*[\"']?\s*([^\s\"'/>;]+)"


def marked_charset(body: Column) -> Column:
    """Charset that a body's byte-order mark names; null if it has none."""
    named = F.lit(None).cast("string")
    for mark, charset in MARKS:
        here = F.substring(body, 1, len(mark) // 2) == F.unhex(F.lit(mark))
        named = F.coalesce(named, F.when(here, F.lit(charset)))
    return named


def declared_charset(body: Column) -> Column:
    """Charset that a ``meta`` element near a body's start names, in upper case; empty if there is none.

    Comments are passed over.  A page that can be searched byte by byte is not UTF-16, whatever it says: UTF-8.
    """
    start = F.regexp_replace(_latin(F.substring(body, 1, SEARCHED_BYTES)), r"(?s)<!--.*?(-->|$)", "")
    found = F.upper(F.regexp_extract(start, META_CHARSET, 1))
    return F.when(found.startswith("UTF-16"), F.lit("UTF-8")).otherwise(F.coalesce(found, F.lit("")))


@F.pandas_udf(StringType())
def _decode_other(body: pd.Series, charset: pd.Series) -> pd.Series:
    def decoded(data, name):
        if data is None:
            return None
        try:
            codec = codecs.lookup(name).name
            if codec not in PYTHON_CODECS:
                return bytes(data).decode(codec, "replace")
        except (LookupError, ValueError):
            pass
        return bytes(data).decode("latin-1")

    return pd.Series([decoded(d, n) for d, n in zip(body, charset, strict=True)], dtype=object)


def is_html_response() -> Column:
    """The record's own content type holds ``html`` and its payload is an HTTP response."""
    return F.lower("content_type").contains("html") & F.col("body").isNotNull()


def with_html(df: DataFrame, sniff: bool = False) -> DataFrame:
    """Add ``html``: the body decoded by the charset its Content-Type header names.

    With ``sniff`` a byte-order mark comes first, and is left out, and without a charset in the header the
    page's own ``meta`` element is asked.  Without a known charset a body is read as ISO-8859-1.  Null unless
    the record's own content type contains ``html`` in any letter case.
    """
    allowed = is_html_response()
    charset = charset_name(first_header(F.col("http_headers"), "Content-Type"))
    if sniff:
        df = with_once(df, "_mark", F.when(allowed, marked_charset(F.col("body"))))
        after = F.when(F.col("_mark") == "UTF-8", 4).when(F.col("_mark").isNotNull(), 3).otherwise(1)
        df = df.withColumn("body", F.substring(F.col("body"), after, F.octet_length("body")))
        named = F.when(charset == "", declared_charset(F.col("body"))).otherwise(charset)
        charset = F.coalesce(F.col("_mark"), named)
    df = with_once(df, "_charset", F.when(allowed, charset)) if sniff else df.withColumn("_charset", F.when(allowed, charset))
    is_latin, is_utf8 = F.col("_charset").isin(LATIN_NAMES), F.col("_charset").isin(UTF8_NAMES)
    # bodies of the common charsets are nulled here, so Arrow does not carry them to Python
    other = F.when(~is_latin & ~is_utf8, F.col("body"))
    df = df.withColumn("_other", _decode_other(other, F.col("_charset")))
    html = (
        F.when(is_latin, _latin(F.col("body")))
        .when(is_utf8, F.make_valid_utf8(F.col("body").cast("string")))
        .otherwise(F.col("_other"))
    )
    return df.withColumn("html", html).drop("_charset", "_other", "_mark")
