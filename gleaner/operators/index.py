"""Lookup index from URL to archive file and offset, and its join with a URL list."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.once import with_once
from gleaner.functions.suffixes import SHIPPED_RULES, SuffixRules
from gleaner.functions.urls import with_domains
from gleaner.operators.joins import BROADCAST_BYTES, join_list
from gleaner.session import cut_lineage, new_folder

# The corpus's own field names, its misspelling included.
ARCHIVE_FIELDS = (
    "archiveInfo struct<arcSourceSegmentId:string, arcFileDate:string, "
    "arcFileParition:string, arcFileOffset:string>"
)
ARCHIVE_SUFFIX = ".arc.gz"
_CORRUPT = "_corrupt"


def _json_fields(json: Column, schema: str) -> Column:
    """Struct of text fields from one parse of the JSON; ``_corrupt`` is set if it is no object."""
    return F.from_json(
        json,
        f"{schema}, {_CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT},
    )


def _is_object(json: Column, parsed: Column) -> Column:
    """True if the JSON text was an object that could be parsed."""
    return F.coalesce(
        parsed[_CORRUPT].isNull() & F.ltrim(json).startswith("{"), F.lit(False)
    )


def archive_name(segment: Column, date: Column, partition: Column) -> Column:
    """``segment/date_partition.arc.gz``."""
    return F.concat(segment, F.lit("/"), date, F.lit("_"), partition, F.lit(ARCHIVE_SUFFIX))


def arc_lookup_index(
    metadata: DataFrame, rules: SuffixRules = SHIPPED_RULES, strict: bool = False
) -> DataFrame:
    """``domain_id, url, meta_file, arc_file, arc_offset`` from ``url, json, meta_file``.

    A narrow job: each row is kept or dropped on its own.  Rows without a site or
    without any of the four archive fields are dropped; the HTTP result plays no part.
    """
    df = with_domains(metadata, rules=rules, strict=strict)
    df = with_once(df, "_j", _json_fields(F.col("json"), ARCHIVE_FIELDS))
    info = F.col("_j")["archiveInfo"]
    df = df.select(
        "domain_id",
        "url",
        "meta_file",
        archive_name(
            info["arcSourceSegmentId"], info["arcFileDate"], info["arcFileParition"]
        ).alias("arc_file"),
        F.when(_is_object(F.col("json"), F.col("_j")), info["arcFileOffset"])
        .try_cast("bigint")
        .alias("arc_offset"),
    )
    return df.dropna(subset=["domain_id", "arc_file", "arc_offset"])


#: A URL with more than one index row in so many is kept out of the buckets; there are fewer than these.
HOT_SHARE = 256


class BucketedIndex(NamedTuple):
    """Names of the tables of a lookup index: rows in buckets by URL, and the rows of very frequent URLs."""

    table: str
    hot: str
    buckets: int


def write_bucketed_index(index: DataFrame, name: str, buckets: int, folder: str = "") -> BucketedIndex:
    """Store a lookup index as tables ``name`` and ``name_hot``, bucketed and sorted by URL.

    A list joined with it is dealt to the buckets; the index itself is not shuffled again.  A bucket is one
    file.  URLs that hold more than one row in 256 would fill a bucket each: their rows lie in a
    table of their own, which is read by a broadcast of those few URLs.  ``folder`` is where the files go, by default
    the shared folder.
    """
    folder = folder or new_folder(index.sparkSession, "index")
    index = cut_lineage(index)
    by_url = cut_lineage(index.groupBy("url").agg(F.count(F.lit(1)).alias("n")))
    total = by_url.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = by_url.where(F.col("n") * HOT_SHARE > total).select("url")
    seldom = index.join(F.broadcast(often), "url", "left_anti").select(*index.columns)
    spread = seldom.repartition(buckets, "url")  # the same hash as that of the buckets: a file each
    spread.write.bucketBy(buckets, "url").sortBy("url").option("path", f"{folder}/{name}").saveAsTable(name)
    hot = index.join(F.broadcast(often), "url", "left_semi").select(*index.columns)
    hot.write.option("path", f"{folder}/{name}_hot").saveAsTable(f"{name}_hot")
    return BucketedIndex(name, f"{name}_hot", buckets)


def sample_arc_files_bucketed(spark: SparkSession, index: BucketedIndex, sample: DataFrame, base: str = "") -> DataFrame:
    """:func:`sample_arc_files` on a stored index: only the sample is shuffled, whatever its length."""
    hot = spark.table(index.hot)
    few = sample.join(F.broadcast(hot.select("url").distinct()), "url", "left_semi").select(*sample.columns)
    rest = _with_paths(spark.table(index.table), sample, lambda big, small: big.join(small.hint("merge"), "url"), base)
    # a frequent URL's rows are joined where they lie: its sample rows, counted, are a bounded list
    counted = cut_lineage(few.groupBy("domain_id", "url").agg(F.count(F.lit(1)).alias("_copies")))
    often = _with_paths(hot, counted, lambda big, small: join_list(big, small, ["url"]), base, "_copies")
    return rest.unionByName(often)


def _with_paths(index: DataFrame, sample: DataFrame, join, base: str, copies: str = "") -> DataFrame:
    chosen = sample.select(F.col("domain_id").alias("sample_domain_id"), "url", *[copies] * bool(copies))
    joined = join(index, chosen)
    if copies:
        joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))))
    return joined.select(
        "domain_id", "url", "meta_file", "arc_file", "arc_offset", "sample_domain_id",
        F.concat(F.lit(base), F.col("arc_file")).alias("arc_path"),
    )


def sample_arc_files(
    index: DataFrame, sample: DataFrame, base: str = "", max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Index rows of the sampled URLs with the full ``arc_path`` below ``base``.

    Repeated URLs multiply, and the sample's own domain is kept beside the index's.
    """
    return _with_paths(index, sample, lambda big, small: join_list(big, small, ["url"], "inner", max_bytes), base)
