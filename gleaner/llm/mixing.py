"""Mixing sources to target weights with Sainte-Lague apportionment.

A source's words are laid out as one line: its documents in a seeded order, cut into
shards, each shard cut into blocks of ``block_words`` words.  Sources get whole numbers of
blocks by highest quotients (divisors 1, 3, 5, ..), shards of a source get theirs from the
source's number in the same way, and inside a shard a seeded rule picks the blocks.  A
block taken r times gives r copies of its words.

Defined cases: a null text has no words and is never taken; a null source is a source of
its own, the last one; an empty table gives an empty result; rows that repeat are each
mixed on their own (rows alike in every column share one place in the order, and all but
their place among themselves is the same in every run).  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, only
from gleaner.operators.joins import join_list
from gleaner.session import store

MOST_REPEATS = 3
BLOCK_WORDS = 64
SHARD_WORDS = 1_000_000
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seats(df: DataFrame, group: list[str], weight: str, total: str, name: str) -> DataFrame:
    """Sainte-Lague: ``df`` with column ``name``, whole numbers that add up to ``total`` per group.

    Rounding ``weight / divisor`` at the divisor weight-sum / total is what the method
    gives for some number of seats within half the number of rows of ``total``; the few
    seats between are then given to the highest, or taken from the lowest quotients.
    Ties go to the row first in order of column ``rank``, which must be unique per group.
    A group without weight, or with a total of 0, gets none.
    """
    of = Window.partitionBy(*group)
    divisor = F.try_divide(F.sum(weight).over(of), F.col(total))
    first = (
        df.withColumn("_d", divisor)
        .withColumn(name, F.when(F.col("_d") > 0, F.floor(F.col(weight) / F.col("_d") + 0.5)).otherwise(0))
        .withColumn("_open", (F.col(total) - F.sum(name).over(of)).cast("bigint"))
    )
    # a row's share of the open seats, and two more, bounds what it can still win or lose
    share = F.try_divide(F.col(weight), F.sum(weight).over(of))
    most = F.when(
        F.col(weight) > 0, F.ceil(F.abs(F.col("_open")) * share).cast("bigint") + 2
    ).otherwise(0)
    steps = first.withColumn("_n", F.when(F.col("_open") == 0, 0).otherwise(most)).where("_n > 0")
    steps = steps.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    seat = F.when(F.col("_open") > 0, F.col(name) + F.col("_j")).otherwise(
        F.col(name) - 1 - F.col("_j")
    )
    steps = steps.withColumn("_seat", seat).where("_seat >= 0")
    quotient = F.col(weight) / (2 * F.col("_seat") + 1)
    order = F.when(F.col("_open") > 0, -quotient).otherwise(quotient)
    tie = F.when(F.col("_open") > 0, F.col("rank")).otherwise(-F.col("rank"))
    ranked = steps.withColumn("_o", order).withColumn("_t", tie).withColumn(
        "_k", F.row_number().over(Window.partitionBy(*group).orderBy("_o", "_t", "_j"))
    )
    won = ranked.where("_k <= abs(_open)").groupBy(*group, "rank").agg(F.count(F.lit(1)).alias("_w"))
    moved = F.coalesce(F.col("_w"), F.lit(0)) * F.signum(F.col("_open"))
    joined = first.join(won, [*group, "rank"], "left")
    return joined.withColumn(name, (F.col(name) + moved).cast("bigint")).drop("_d", "_open", "_w")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, rank, target`` of a table ``source, source_size``.

    Weights 1, 2, 3, 1, 2, .. by code point, null last.  The share of all words goes by
    weight; a target stops at three times its source's size and the excess is shared among
    the rest by weight.  One row per source, in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    by_cap = Window.partitionBy(F.lit(1)).orderBy("_ratio", "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .withColumn("_w", (F.col("rank") - 1) % 3 + 1)
        .withColumn("_cap", MOST_REPEATS * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(every))
    )
    rest = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weights = F.sum("_w").over(after)
    level = (
        ranked.withColumn("_rest", rest)
        .withColumn("_weights", weights)
        .withColumn("_fits", F.col("_rest") * F.col("_w") <= F.col("_cap") * F.col("_weights"))
    )
    # from the first source that the shared level does not fill, that level holds
    start = F.min(F.when(F.col("_fits"), F.struct("_ratio", "rank", "_rest", "_weights"))).over(every)
    full = F.col("_at").isNull() | (
        F.struct("_ratio", "rank") < F.struct("_at._ratio", "_at.rank")
    )
    shared = F.col("_at._rest") * F.col("_w") / F.col("_at._weights")
    target = F.when(full, F.col("_cap").cast("double")).otherwise(shared.cast("double"))
    return level.withColumn("_at", start).select("source", "source_size", "rank", target.alias("target"))


def _cum(position: Column, quota: Column, blocks: Column, block_words: int) -> Column:
    """Words taken from the start of a shard up to ``position``; block k is taken
    floor((k + 1) q / m) - floor(k q / m) times, so q of m blocks, spread evenly over the
    seeded order."""
    k = F.floor(position / block_words)
    low = F.floor(k * quota / blocks)
    high = F.floor((k + 1) * quota / blocks)
    return low * block_words + (position - k * block_words) * (high - low)


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with its words counted and its place in the seeded order; columns are ``doc_id, source, text`` and any others."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select("*", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_twin"), key.alias("_key")).drop("text")


def _with_shard(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` with the facts of its source and the shard it lies in."""
    facts = sources.withColumn("_source", F.struct("source")).drop("source")
    placed = join_list(sized.withColumn("_source", F.struct("source")), facts, ["_source"]).drop("_source")
    lead = F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint")
    return placed.withColumn("shard", lead % F.col("shards"))


def _shard_quotas(placed: DataFrame, block_words: int) -> DataFrame:
    """``rank, shard, quota, blocks``: blocks that each shard gives, and has.

    A shard gives no block more than three times.  What its share has above that goes to the
    source's other shards in the same way, by the blocks they still can give.
    """
    by_shard = placed.groupBy(F.col("rank").alias("source_rank"), "shard", "source_blocks").agg(
        F.sum("size").alias("shard_size")
    )
    shares = seats(
        by_shard.withColumn("rank", F.col("shard")), ["source_rank"], "shard_size", "source_blocks", "share"
    )
    blocks = F.ceil(F.col("shard_size") / block_words).cast("bigint")
    most = MOST_REPEATS * F.col("blocks")
    capped = shares.withColumn("blocks", blocks).withColumn("room", F.greatest(most - F.col("share"), F.lit(0)))
    of = Window.partitionBy("source_rank")
    over = F.sum(F.greatest(F.col("share") - most, F.lit(0))).over(of)
    capped = capped.withColumn("over", F.least(over, F.sum("room").over(of)))
    capped = capped.select("source_rank", "rank", "shard", "share", "blocks", "room", "over")
    more = seats(store(capped, "shares"), ["source_rank"], "room", "over", "more")
    quota = F.least("share", most) + F.col("more")
    return more.select(F.col("source_rank").alias("rank"), "shard", quota.cast("bigint").alias("quota"), "blocks")


def _laid(docs: DataFrame, block_words: int, shard_words: int, seed: int, rows: DataFrame | None = None) -> DataFrame:
    """Each row of ``docs`` (``doc_id, source, text``) with its plan; or of ``rows``, the same with more columns."""
    sized = store(_sized(docs, seed), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals)
    blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / block_words).cast("bigint")
    sources = seats(targets.withColumn("_one", F.lit(1)).withColumn("_blocks", blocks), ["_one"], "target", "_blocks", "source_blocks")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("bigint")
    sources = store(sources.select("source", "source_size", "rank", "target", "source_blocks", shards.alias("shards")), "sources")
    placed = _with_shard(sized, sources)
    quotas = store(_shard_quotas(placed, block_words), "quotas")
    laid = placed if rows is None else _with_shard(_sized(rows, seed), sources)
    within = Window.partitionBy("rank", "shard").orderBy("_key", "doc_id", "size", "_twin")
    running = laid.withColumn("start", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    full = join_list(running, quotas, ["rank", "shard"])
    taken = F.when(F.col("size") == 0, 0).otherwise(
        _cum(F.col("start") + F.col("size"), F.col("quota"), F.col("blocks"), block_words)
        - _cum(F.col("start"), F.col("quota"), F.col("blocks"), block_words)
    )
    return full.withColumn("taken", taken.cast("bigint"))


def mix_plan(
    docs: DataFrame,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, taken`` and where it lies:
    ``start`` (words of its shard before it), ``quota`` of ``blocks`` blocks of its shard.

    Shards hold about ``shard_words`` words, whatever the size of their source, and only
    documents' ids and sizes are shuffled.
    """
    laid = _laid(only(docs, "doc_id", "source", "text"), block_words, shard_words, seed)
    return laid.select("doc_id", "source", "size", "source_size", "target", "taken", "start", "quota", "blocks")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mixed documents, in ``docs``' columns: one row per copy of a document.

    Copy c holds the words of those of the document's blocks that are taken c times or
    more, with the white space that follows them; a copy of all blocks is the text as it
    is.  Documents of which nothing is taken are left out.  Documents are shuffled once, to
    their shards, in one column that no name of the plan can meet.
    """
    slim = only(docs, "doc_id", "source", "text")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(F.col("doc_id"), F.col("source"), F.col("text"), whole)
    joined = _laid(slim, block_words, shard_words, seed, rows).where("taken > 0")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    times = F.transform(
        F.sequence(first, last),
        lambda k: F.floor((k + 1) * F.col("quota") / F.col("blocks")) - F.floor(k * F.col("quota") / F.col("blocks")),
    )
    joined = joined.withColumn("_first", first).withColumn("_times", times)
    copies = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.array_max("_times"))))
    whole = F.array_min("_times") >= F.col("_copy")
    doc_text = F.col("_doc.text")
    words = F.regexp_extract_all(doc_text, F.lit(f"{WORD}[{' \\t\\n\\x0B\\f\\r'}]*"), F.lit(0))
    block = lambda i: (F.floor((F.col("start") + i) / block_words) - F.col("_first")).cast("int")
    part = F.filter(words, lambda w, i: F.get("_times", block(i)) >= F.col("_copy"))
    new = {"text": F.when(whole, doc_text).otherwise(F.array_join(part, ""))}
    mixed = copies.withColumn("_text", new["text"])
    new["text"] = F.col("_text")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(whole, F.col("_doc.n_chars")).otherwise(F.length("_text").cast(kind))
    return mixed.select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def mix_sql(block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> str:
    """The rows of ``op9`` in DuckDB, the apportionment by its definition: all quotients, the highest win."""
    return f"""
    WITH sized AS (
      SELECT doc_id, source, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS key,
        len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS size
      FROM documents),
    sources AS (
      SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
      FROM sized GROUP BY source),
    weighted AS (
      SELECT *, (rank - 1) % 3 + 1 AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM sources),
    steps AS (
      SELECT *,
        total - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
      FROM weighted),
    level AS (SELECT rest, weights FROM steps WHERE rest * w <= cap * weights ORDER BY cap / w, rank LIMIT 1),
    targets AS (
      SELECT source, source_size, rank, CASE
          WHEN (SELECT count(*) FROM level) = 0 OR cap * (SELECT weights FROM level) < (SELECT rest FROM level) * w THEN cap::DOUBLE
          ELSE (SELECT rest FROM level)::DOUBLE * w / (SELECT weights FROM level) END AS target
      FROM weighted),
    n AS (SELECT round(sum(target) / {block_words})::BIGINT AS blocks FROM targets),
    src_seats AS (
      SELECT rank, count(*) AS source_blocks FROM (
        SELECT rank, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, rank) AS k
        FROM targets, (SELECT unnest(range((SELECT blocks FROM n))) AS j) WHERE target > 0)
      WHERE k <= (SELECT blocks FROM n) GROUP BY rank),
    placed AS (
      SELECT d.*, t.source_size, t.rank, t.target, coalesce(s.source_blocks, 0) AS source_blocks,
        ('0x' || substr(key, 1, 8))::BIGINT % greatest(1, ceil(t.source_size / {shard_words})::BIGINT) AS shard
      FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN src_seats s USING (rank)),
    shards AS (
      SELECT rank, shard, source_blocks, sum(size) AS shard_size, ceil(sum(size) / {block_words})::BIGINT AS blocks
      FROM placed GROUP BY ALL),
    shares AS (
      SELECT rank, shard, blocks, coalesce(share, 0) AS share FROM shards LEFT JOIN (
        SELECT rank, shard, count(*)::BIGINT AS share FROM (
          SELECT rank, shard, source_blocks,
            row_number() OVER (PARTITION BY rank ORDER BY shard_size / (2 * j + 1) DESC, shard) AS k
          FROM (SELECT *, unnest(range(source_blocks)) AS j FROM shards WHERE shard_size > 0))
        WHERE k <= source_blocks GROUP BY rank, shard) USING (rank, shard)),
    rooms AS (
      SELECT *, greatest(3 * blocks - share, 0) AS room,
        sum(greatest(share - 3 * blocks, 0)) OVER (PARTITION BY rank) AS excess FROM shares),
    handed AS (
      SELECT rank, shard, count(*)::BIGINT AS more FROM (
        SELECT rank, shard, excess, row_number() OVER (PARTITION BY rank ORDER BY room / (2 * j + 1) DESC, shard) AS k
        FROM (SELECT *, unnest(range(excess::BIGINT)) AS j FROM rooms WHERE excess > 0) WHERE j < room)
      WHERE k <= excess GROUP BY rank, shard),
    quotas AS (
      SELECT rank, shard, blocks, least(3 * blocks, share) + coalesce(more, 0) AS quota
      FROM rooms LEFT JOIN handed USING (rank, shard)),
    laid AS (
      SELECT p.*, q.blocks, q.quota,
        sum(size) OVER (PARTITION BY p.rank, p.shard ORDER BY key, doc_id, size)::BIGINT - size AS start
      FROM placed p JOIN quotas q ON p.rank = q.rank AND p.shard = q.shard),
    cut AS (
      SELECT *, unnest(range(start // {block_words}, (start + size - 1) // {block_words} + 1)) AS k FROM laid WHERE size > 0),
    took AS (
      SELECT doc_id, sum((least(start + size, (k + 1) * {block_words}) - greatest(start, k * {block_words}))
          * ((k + 1) * quota // blocks - k * quota // blocks))::BIGINT AS taken
      FROM cut GROUP BY doc_id)
    SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
    FROM placed LEFT JOIN took USING (doc_id)"""
