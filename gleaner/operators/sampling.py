"""Stratified sampling with a quota per domain, repeatable and safe for frequent domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.once import with_once
from gleaner.operators.joins import BROADCAST_BYTES, join_list, measured_bytes
from gleaner.session import cut_lineage

DIE_SIDES = 6
# hex digits of the order key that name a bucket: at least so many, and as many as keep the
# buckets of the largest domain about this large; the sample does not depend on them
LEAST_DIGITS, ROWS_PER_BUCKET = 3, 1_000_000
COPIES_PER_ROW = 10_000


def checked_statistic(stat: DataFrame) -> DataFrame:
    """``domain_id, n`` with one row per domain; a repeated domain raises when it is read."""
    repeated = F.raise_error(
        F.concat(F.lit("domain occurs twice in the statistic: "), F.col("domain_id"))
    )
    return (
        stat.groupBy("domain_id")
        .agg(F.count(F.lit(1)).alias("_rows"), F.max("n").cast("bigint").alias("n"))
        .select("domain_id", F.when(F.col("_rows") > 1, repeated).otherwise(F.col("n")).alias("n"))
    )


def _quota(sample_size: int, total: Column, n: Column) -> Column:
    # 32-bit steps and rounding half up: the quota is defined by them
    share = (F.lit(sample_size).cast("float") / total.cast("float")).cast("float")
    return F.floor((share * n.cast("float")).cast("float").cast("double") + F.lit(0.5))


def sample_quota(stat: DataFrame, sample_size: int) -> DataFrame:
    """``domain_id, n, quota``: each domain's share of ``sample_size`` by its size.

    The total covers all domains of the statistic, also those absent from the input.
    """
    total = stat.agg(F.sum("n").alias("total")).scalar()
    return checked_statistic(stat).select(
        "domain_id", "n", _quota(sample_size, total, F.col("n")).alias("quota")
    )


def stratum_filter(
    rows: DataFrame, stat: DataFrame, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Rows whose domain is in the statistic."""
    return join_list(rows, stat, ["domain_id"], "left_semi", max_bytes)


def order_key(url: Column, seed: int) -> Column:
    """Pseudo-random but fixed place of a URL in its domain."""
    return F.md5(F.concat(F.lit(f"order-{seed}:"), url))


def accepted_by_die(url: Column, seed: int) -> Column:
    """True for about one URL in six; independent of :func:`order_key`."""
    digits = F.substring(F.md5(F.concat(F.lit(f"die-{seed}:"), url)), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") % DIE_SIDES == 0


def bucket_digits(stat: DataFrame) -> int:
    """Hex digits by the size of the largest domain."""
    return _digits_for(stat.agg(F.max("n").cast("bigint")).first()[0])


def _digits_for(largest: int | None) -> int:
    largest, digits = largest or 0, LEAST_DIGITS
    while largest > ROWS_PER_BUCKET * 16**digits:
        digits += 1
    return digits


def _open_buckets(urls: DataFrame, quotas: DataFrame) -> DataFrame:
    """``domain_id, _bucket, _room``: buckets of the order key that the quota still reaches.

    The window holds a row per bucket of a domain, a millionth of the domain's rows or 4096.
    """
    sizes = urls.groupBy("domain_id", "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = (
        Window.partitionBy("domain_id")
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        sizes.join(quotas, "domain_id")
        .withColumn("_room", F.col("quota") - F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .where("_room > 0")
        .select("domain_id", "_bucket", "_room")
    )


def _counted(urls: DataFrame, *extra: str) -> DataFrame:
    keys = ["domain_id", "_bucket", "_order", "url", *extra]
    return urls.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def stratified_sample(
    rows: DataFrame,
    stat: DataFrame,
    sample_size: int,
    seed: int = 0,
    dice: bool = False,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``domain_id, url``: per domain the first rows by order key, up to the domain's quota.

    With ``dice`` only URLs accepted by the die are eligible, which under-fills.

    No task ever holds a whole domain.  Counts per (domain, leading digits of the order
    key) tell in which bucket the quota runs out; they are stored, measured and broadcast,
    so that rows beyond the quota are dropped before any shuffle.  Of the rest, equal rows
    are counted rather than carried, and ranks are taken inside one bucket.
    """
    urls = rows.where("domain_id IS NOT NULL AND url IS NOT NULL").select("domain_id", "url")
    if dice:
        urls = urls.where(accepted_by_die(F.col("url"), seed))
    urls = with_once(urls, "_order", order_key(F.col("url"), seed))
    # the statistic is stored once; one look gives its total and its largest domain
    stat = cut_lineage(checked_statistic(stat))
    facts = stat.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    urls = urls.withColumn("_bucket", F.substring("_order", 1, _digits_for(facts["largest"])))
    quotas = stat.select("domain_id", _quota(sample_size, F.lit(facts["total"]).cast("bigint"), F.col("n")).alias("quota"))
    reached = cut_lineage(_open_buckets(urls, quotas))
    on = ["domain_id", "_bucket"]
    if measured_bytes(reached) <= max_bytes:
        chosen = _counted(urls.join(F.broadcast(reached), on), "_room")
    else:
        # counted first: a URL that fills a bucket by its copies is one row in the join
        chosen = _counted(urls).join(reached, on)
    in_bucket = (
        Window.partitionBy(*on)
        .orderBy("_order", "url")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    used = F.coalesce(F.sum("copies").over(in_bucket), F.lit(0))
    taken = (
        chosen.withColumn("take", F.least(F.col("copies"), F.col("_room") - used))
        .where("take > 0")
        .select("domain_id", "url", "take")
    )
    return repeat_rows(taken, "take")


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times; a large number is written out by several tasks."""
    columns = [c for c in df.columns if c != times]
    one, chunk = F.lit(1).cast("bigint"), F.lit(COPIES_PER_ROW).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1, chunk)
    size = F.least(F.col(times) - F.col("_start"), chunk)
    return (
        df.withColumn("_start", F.explode(starts))
        .repartition(*columns, "_start")
        .withColumn("_copy", F.explode(F.sequence(one, size)))
        .select(*columns)
    )
