"""Counting of crawl metadata: successful URLs per domain, and what became of every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.functions.once import with_once
from gleaner.functions.suffixes import SHIPPED_RULES, SuffixRules
from gleaner.functions.urls import is_malformed, with_domains

# What the status counters of such jobs are called.
HTTP_OK = 200
STATUSES = (
    "INVALID_URIS", "INVALID_DOMAIN", "MISSING_HTTPCODE", "HTTP_SUCCESS", "HTTP_FAIL", "EXCEPTIONS",
)


def http_code(value: Column) -> Column:
    """Whole number of a JSON value given as text; null if it is not a number."""
    return F.when(value.rlike(r"^-?[0-9]"), value.try_cast("decimal(20,4)").cast("bigint"))


def with_status(
    metadata: DataFrame, rules: SuffixRules = SHIPPED_RULES, strict: bool = False
) -> DataFrame:
    """Add domains and ``status`` to ``url, json`` rows.

    The tests run in this order: URL, host, domain, JSON, ``http_result``.
    """
    df = with_domains(metadata, rules=rules, strict=strict)
    json = F.when(F.col("host_domain").isNotNull(), F.col("json"))
    df = with_once(df, "_result", F.get_json_object(json, "$.http_result"))
    result = F.col("_result")
    # null for text that is no JSON object; only rows without a result are parsed again
    keys = F.json_object_keys("json")
    absent = F.coalesce(~F.array_contains(keys, "http_result"), F.lit(False))
    status = (
        F.when(
            F.col("host").isNull(),
            F.when(is_malformed(F.col("url")), "EXCEPTIONS").otherwise("INVALID_URIS"),
        )
        .when(F.col("host_domain").isNull(), "INVALID_DOMAIN")
        .when(result.isNull(), F.when(absent, "MISSING_HTTPCODE").otherwise("EXCEPTIONS"))
        .when((result == str(HTTP_OK)) | (http_code(result) == HTTP_OK), "HTTP_SUCCESS")
        .when(http_code(result).isNotNull(), "HTTP_FAIL")
        .otherwise("EXCEPTIONS")
    )
    return df.withColumn("status", status).drop("_result")


def url_status_counts(metadata: DataFrame, **domains) -> DataFrame:
    """``status, n``: every input row counted once."""
    return with_status(metadata, **domains).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def observed(df: DataFrame, observation: Observation) -> DataFrame:
    """Count the statuses of ``df`` as it runs; read them from ``observation.get`` afterwards."""
    counters = [F.count_if(F.col("status") == name).alias(name) for name in STATUSES]
    return df.observe(observation, *counters)


def http_ok(metadata: DataFrame) -> DataFrame:
    """Rows whose ``http_result`` is exactly 200."""
    return metadata.where(http_code(F.get_json_object("json", "$.http_result")) == HTTP_OK)


def valid_host(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL names a host."""
    return df.where(F.try_parse_url(F.col(url), F.lit("HOST")).isNotNull())


def _count_by(metadata: DataFrame, key: str, observation: Observation | None, domains) -> DataFrame:
    df = with_status(metadata, **domains)
    if observation is not None:
        df = observed(df, observation)
    # one frequent key is safe: counts are combined before the shuffle
    return (
        df.where(F.col("status") == "HTTP_SUCCESS")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def count_urls_per_domain(
    metadata: DataFrame, observation: Observation | None = None, **domains
) -> DataFrame:
    """``domain_id, n``: successfully fetched URLs per last label of the site."""
    return _count_by(metadata, "domain_id", observation, domains)


def count_urls_per_host_domain(
    metadata: DataFrame, observation: Observation | None = None, **domains
) -> DataFrame:
    """``host_domain, n``: the same per site."""
    return _count_by(metadata, "host_domain", observation, domains)
