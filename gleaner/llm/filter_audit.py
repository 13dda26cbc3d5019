"""Interaction of quality filters: what each removes in every order, and its fair share.

Per part of the corpus the filters play a game: a coalition's worth is the number of documents that
at least one of its filters removes.  Documents are first counted by the set of filters they
fail.  From these counts come the worths of all coalitions; the Hart and Mas-Colell potential
of a coalition is found from those of the coalitions one filter smaller,

    |S| P(S) = worth(S) + sum over f in S of P(S without f),

and a filter's Shapley value is the potential of all filters less the potential of all but it.  With
Q(S) = |S|! P(S) all numbers are whole.  What a filter removes at its place in an order is
the difference of two worths.

Texts are read once; what is shuffled of a document is its id, a hash of its text, its part and
the filters it fails.  Copies are told by 256-bit hashes; a text that fills a third of the table
is counted with partial sums, never gathered.

Defined cases: a null text is the empty one, equal to it; a null source is the part ``""``, together with the
source of that name; a null id is neither smaller nor larger than another, so that copies without an id
fail nothing and cause nothing; rows alike in id and text are copies of none of each other; a document is good or toxic if any label
of its id says so; labels of unknown documents and null labels are ignored.  An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.once import with_once
from gleaner.llm.common import only, word_array
from gleaner.operators.joins import join_list
from gleaner.session import store

FILTERS = "ABCDE"
MIN_WORDS = 50
LEAST_DISTINCT = 65  # percent of words
MOST_CAPITALS = 5  # percent of code points
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _failed_by_text(docs: DataFrame) -> DataFrame:
    """``doc_id, part, hash, failed``: the bits of the filters A to D that look at the text alone."""
    df = only(docs, "doc_id", "source", "text")
    df = df.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    df = with_once(df, "_words", word_array(F.col("text")))
    n_words = F.size("_words")
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    fails = [
        n_words < MIN_WORDS,
        100 * F.size(F.array_distinct("_words")) < LEAST_DISTINCT * n_words,
        100 * capitals.cast("bigint") > MOST_CAPITALS * F.length("text").cast("bigint"),
        F.col("text").rlike(SYMBOLS),
    ]
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))
    return df.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), bits.cast("int").alias("failed"))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, n, good, toxic``: documents by the set of filters they fail, as bits in the order of ``FILTERS``."""
    keys = ["part", "hash", "failed"]
    rows = _failed_by_text(docs).groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("c"))
    rows = store(rows, "failed")
    marks = only(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"),
    )
    # ids that are null meet no label; they stay out of the join, where they would fill one task
    known = join_list(rows.where("doc_id IS NOT NULL"), store(marks, "labels"), ["doc_id"], "left")
    lone = rows.where("doc_id IS NULL").withColumns({"good": F.lit(False), "bad": F.lit(False)})
    marked = known.unionByName(lone)
    marked = marked.withColumn("good", F.coalesce("good", F.lit(False))).withColumn("bad", F.coalesce("bad", F.lit(False)))
    # in a group of equal texts the rows of the least id are first ones; a group has one row per id
    groups = marked.groupBy(*keys, "good", "bad").agg(
        F.sum("c").alias("n"),
        F.min("doc_id").alias("least"),
        F.min_by("c", "doc_id").alias("of_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("lone"),
    )
    groups = store(groups, "groups")
    firsts = groups.groupBy("hash").agg(F.min("least").alias("first"))
    groups = groups.join(firsts, "hash")
    of_least = F.when(F.col("least") == F.col("first"), F.col("of_least")).otherwise(0)
    own = F.col("lone") + F.coalesce(of_least, F.lit(0))
    copy_bit = 1 << (len(FILTERS) - 1)
    split = groups.select(
        "part", "good", "bad",
        F.inline(F.array(
            F.struct(F.col("failed").alias("failed"), own.alias("n")),
            F.struct((F.col("failed") + copy_bit).cast("int").alias("failed"), (F.col("n") - own).alias("n")),
        )),
    )
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias("toxic" if flag == "bad" else flag)
    return split.where("n > 0").groupBy("part", "failed").agg(F.sum("n").alias("n"), of("good"), of("bad"))


def _worths(name: str, filters: int) -> Column:
    """Worth of every coalition, by its bits, from the counts of one part: an aggregate."""
    per = [F.sum(F.when(F.col("failed").bitwiseAND(F.lit(s)) != 0, F.col(name)).otherwise(0)) for s in range(1 << filters)]
    return F.array(*per).alias(name)


def potentials(worth: Column, filters: int) -> Column:
    """|S|! P(S) of every coalition S by its bits, from their worths."""
    factorials = F.lit([factorial(max(0, bin(s).count("1") - 1)) for s in range(1 << filters)]).cast("array<bigint>")

    def more(known: Column, s: Column) -> Column:
        smaller = [
            F.when(s.bitwiseAND(F.lit(1 << k)) != 0, F.get(known, s - (1 << k))).otherwise(F.lit(0).cast("bigint"))
            for k in range(filters)
        ]
        return F.array_append(known, F.get(factorials, s) * F.get(worth, s) + sum(smaller[1:], smaller[0]))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("bigint")), more)


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step, from counts by failed filters.

    ``filters`` names them, a letter each; ``counts`` has ``part, failed, n, good, toxic``.  Orders
    number the factorial of the filters', a row each step and part: few filters are meant.
    """
    m, everyone = len(filters), (1 << len(filters)) - 1
    worths = counts.groupBy("part").agg(F.sum("n").alias("all"), _worths("n", m), _worths("good", m), _worths("toxic", m))
    games = with_once(worths, "q", potentials(F.col("n"), m))
    orders = F.explode(F.lit(["".join(p) for p in permutations(filters)]))
    steps = games.select("*", orders.alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(m))).alias("step"))
    place = f"shiftleft(1, instr('{filters}', substring(filter_order, %s, 1)) - 1)"
    before = F.expr(f"aggregate(sequence(0, step - 1), 0, (a, i) -> a + if(i = 0, 0, {place % 'i'}))")
    steps = steps.withColumn("_bit", F.expr(place % "step")).withColumn("_before", before)
    after = F.col("_before") + F.col("_bit")
    gain = lambda name: F.get(name, after) - F.get(name, F.col("_before"))
    removed = gain("n")
    # m! times the Shapley value: what the filter removes, summed over all orders
    share = F.get("q", F.lit(everyone)) - m * F.get("q", F.lit(everyone) - F.col("_bit"))
    return steps.select(
        "part", "filter_order", "step",
        (F.col("all") - F.get("n", after)).alias("kept"),
        removed.alias("removed"),
        (F.get("n", F.col("_bit")) - removed).alias("redundant"),
        (F.get("n", F.lit(everyone)) - F.get("n", F.lit(everyone) - F.col("_bit"))).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(store(failure_counts(docs, labels), "counts"))


def audit_sql() -> str:
    """The same by definition: every order walked, shares summed over the orders."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    return f"""
    WITH texts AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
    flagged AS (
      SELECT doc_id, part,
        (CASE WHEN len(w) < {MIN_WORDS} THEN 'A' ELSE '' END)
        || (CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 'D' ELSE '' END)
        || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS failed
      FROM texts),
    marks AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
    counts AS (
      SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM flagged LEFT JOIN marks USING (doc_id) GROUP BY part, failed),
    steps AS (
      SELECT o AS filter_order, s::INTEGER AS step, substr(o, s::INTEGER, 1) AS f, left(o, s::INTEGER - 1) AS before
      FROM (VALUES {orders}) v(o), (SELECT unnest(range(1, {len(FILTERS) + 1})) AS s)),
    walked AS (
      SELECT part, filter_order, step, f,
        sum(CASE WHEN contains(failed, f) OR length(translate(failed, before, '')) < length(failed) THEN 0 ELSE n END)::BIGINT AS kept,
        sum(CASE WHEN contains(failed, f) AND length(translate(failed, before, '')) = length(failed) THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN contains(failed, f) AND length(translate(failed, before, '')) < length(failed) THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN failed = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN contains(failed, f) AND length(translate(failed, before, '')) = length(failed) THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN contains(failed, f) AND length(translate(failed, before, '')) = length(failed) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM counts, steps GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
      (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
    FROM walked"""
