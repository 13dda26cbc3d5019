"""Pages in the order of their hosts, so that a host list reads only files that can hold it.

The key of a page is its host's labels from the last to the first (``com.example.www.``): a site and all
hosts below it are one range of keys.  Files are ranges of keys, and a small table tells each
file's least and greatest key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.suffixes import SHIPPED_RULES, SuffixRules
from gleaner.functions.urls import dns_name, url_host
from gleaner.operators.joins import measured_bytes
from gleaner.operators.pages import on_hosts
from gleaner.session import cut_lineage

KEY = "host_key"
#: Bytes of the table of files up to which a list is matched with it in the tasks.
RANGES_BYTES = 64 << 20


def host_key(name: Column) -> Column:
    """A domain name's labels from the last to the first, each with a dot behind."""
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit("."))


def write_by_host(pages: DataFrame, folder: str, num_files: int) -> None:
    """Store ``pages`` (``url`` and others) as about ``num_files`` files that are ranges of host keys.

    The URL takes part in the order, so that one host's pages may fill many files.  Pages without a host come first.
    """
    keyed = cut_lineage(pages.withColumn(KEY, F.coalesce(host_key(dns_name(url_host(F.col("url")))), F.lit(""))))
    dealt = keyed.repartitionByRange(num_files, KEY, "url").sortWithinPartitions(KEY, "url")
    dealt.write.parquet(f"{folder}/pages")
    stored = keyed.sparkSession.read.schema(keyed.schema).parquet(f"{folder}/pages")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    files = stored.groupBy(path.alias("file"))
    files.agg(F.min(KEY).alias("least"), F.max(KEY).alias("most")).write.parquet(f"{folder}/files")


def files_for_sites(spark: SparkSession, folder: str, sites: DataFrame, max_bytes: int = RANGES_BYTES) -> list[str] | None:
    """Files that can hold a page of one of ``sites``; None if there are too many files to tell."""
    files = spark.read.schema("file string, least string, most string").parquet(f"{folder}/files")
    if measured_bytes(files) > max_bytes:
        return None
    table = files.toArrow().sort_by([("least", "ascending"), ("most", "ascending")])
    least, most = (np.array(table[c].to_pylist(), dtype=object) for c in ("least", "most"))

    def matched(batches):
        seen: set[int] = set()
        for batch in batches:
            for key in batch.column(0).to_pylist():
                # keys of the site and below start with its key; "/" follows "." in the order
                first = np.searchsorted(most, key, "left")
                last = np.searchsorted(least, key[:-1] + "/", "left")
                seen.update(range(first, last))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], names=["file"])

    keys = sites.select(host_key(F.lower(F.col(f"`{sites.columns[0]}`").cast("string"))).alias("key")).dropna()
    chosen = keys.mapInArrow(matched, "file int").distinct().toArrow()["file"].to_pylist()
    return [table["file"][k].as_py() for k in sorted(chosen)]


def pages_on_sites(
    spark: SparkSession,
    folder: str,
    sites: Sequence[str] | DataFrame,
    rules: SuffixRules = SHIPPED_RULES,
    strict: bool = False,
) -> DataFrame:
    """:func:`operators.pages.on_hosts` of pages stored by :func:`write_by_host`."""
    listed = sites if isinstance(sites, DataFrame) else spark.createDataFrame([(s,) for s in sites], "site string")
    files = files_for_sites(spark, folder, listed)
    whole = spark.read.parquet(f"{folder}/pages")
    reader = spark.read.schema(whole.schema)
    rows = whole if files is None else reader.parquet(*files) if files else whole.where(F.lit(False))
    return on_hosts(rows.drop(KEY), listed, rules, strict)
