"""Quality rules: robust multivariate outliers of text statistics, in DataFrame functions only.

Each document becomes a short vector of transformed statistics.  Per language and source a
minimum-covariance-determinant estimate is made: from coordinatewise medians and absolute
deviations, concentration steps keep the part of the group with the smallest Mahalanobis
distances and estimate centre and scatter again; a reweighting step follows.  A document
farther from its group's centre than a chi-square quantile is rejected.

Vectors are whole numbers of 1/1024, sums are decimals: the estimates do not depend on how
the rows lie.  Distances are counted in bins of a logarithmic scale, so a step is one
aggregation with partial sums, and a hot group costs no task more than its bins.

Defined cases: a null text has no words and fails the base rule; null language or source
are values of their own; groups under ``MIN_GROUP`` documents share one estimate per
language, languages under it one estimate in all, and if even that is too small the base rule
decides alone; repeated rows count as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.once import with_once
from gleaner.llm.common import SPACE_CHARS, only, word_array
from gleaner.operators.joins import join_list
from gleaner.session import store

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MOST_REPEATED = 20  # percent of words in repeated windows
WINDOW = 5
#: Part of a group that the concentration steps keep, number of steps, smallest group.
CORE = 0.75
STEPS = 4
MIN_GROUP = 60
UNIT = 1024
#: The transformed statistics and the standard deviation by which the scatter of each is widened
#: (as variances, on top of the estimate), so that a statistic which is the same in most documents
#: does not reject the first that differs.
FLOORS = {"length": 0.25, "word_length": 0.12, "symbols": 0.05, "lines": 0.10, "repeats": 0.05}
#: Upper tail of chi-square beyond which a document is rejected.  Chosen with the floors on the labels
#: of sf0.1, all of which were in view, among 243 sets of floors; looked at once on sf0.01.
TAIL = 1e-3
BINS_PER_DOUBLING = 8


def chi_square_below(x: float, dims: int) -> float:
    """P(chi-square with ``dims`` degrees of freedom <= x)."""
    if x <= 0:
        return 0.0
    half = x / 2
    odd = dims % 2
    total = math.erf(math.sqrt(half)) if odd else 1 - math.exp(-half)
    for k in range(1, (dims - 1) // 2 + odd if odd else dims // 2):
        a = k - 0.5 if odd else k
        total -= math.exp(a * math.log(half) - half - math.lgamma(a + 1))
    return total


def chi_square_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, dims) < p else (low, mid)
    return high


def _window_hashes(words: Column, window: int) -> Column:
    """A hash of each window of ``words``.  Windows are told apart by 64 bits."""
    hashes = F.transform(
        words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, window)])
    )
    return F.slice(hashes, 1, F.greatest(F.size(words) - (window - 1), F.lit(0)))


def _with_repeats(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Column ``n_repeat_words`` from ``_words``: words in windows found twice or more.

    Hashes are sorted beside their places, and only in texts that repeat one, so that any
    text takes n log n steps.
    """
    df = with_once(df, "_hashes", _window_hashes(F.col("_words"), window))
    same = F.size(F.array_distinct("_hashes")) == F.size("_hashes")
    pairs = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = with_once(df, "_sorted", F.sort_array(F.when(same, F.slice(pairs, 1, 0)).otherwise(pairs)))
    equal = lambda x, i: F.coalesce(x["h"] == F.get("_sorted", i)["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, i: equal(x, i - 1) | equal(x, i + 1))
    df = with_once(df, "_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.transform(
        "_places", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("_places", i + 1) - p, F.lit(window)))
    )
    return df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda a, x: a + x))


def text_statistics(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``doc_id, lang, source`` and the base statistics of each text, all longs; with ``whole`` the row itself as ``_doc``."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] if whole else []
    df = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"), *kept)
    df = with_once(df, "_words", word_array(F.col("text")))
    df = _with_repeats(df)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    df = with_once(df, "_lines", lines)
    longs = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.translate("text", SPACE_CHARS, "")),
        "n_symbols": F.length("text") - F.length(F.translate("text", SYMBOLS, "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.col("n_repeat_words"),
        "n_lines": F.size("_lines"),
    }
    named = [c.cast("bigint").alias(n) for n, c in longs.items()]
    return df.select("doc_id", "lang", "source", *named, *(["_doc"] if whole else []))


def base_failed() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def features() -> list[Column]:
    """Transformed statistics in whole units; short texts are drawn to the usual value."""
    words, chars = F.col("n_words"), F.col("word_chars")
    parts = {
        "length": F.log(words + 10),
        "word_length": F.log((chars + 60) / (words + 10)),
        "symbols": F.sqrt(F.col("n_symbols") / (chars + 60)),
        "lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)),
        "repeats": F.col("n_repeat_words") / (words + 20),
    }
    return [F.round(parts[name] * UNIT).cast("bigint").alias(f"x{i}") for i, name in enumerate(FLOORS)]


DIMS = len(FLOORS)
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _with_inverse(params: DataFrame) -> DataFrame:
    """Columns ``m*`` (centre) and ``w*_*`` (rows of the inverse Cholesky factor) from ``m*, s*_*``."""
    df, total = params, lambda parts: sum(parts, F.lit(0.0))
    for j in range(DIMS):  # each step takes all that its predecessors allow: plans stay short
        rest = {i: F.col(f"s{i}_{j}") - total(F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)) for i in range(j, DIMS)}
        df = df.withColumn(f"l{j}_{j}", F.sqrt(rest.pop(j)))
        df = df.withColumns({f"l{i}_{j}": r / F.col(f"l{j}_{j}") for i, r in rest.items()}) if rest else df
    df = df.withColumns({f"w{i}_{i}": 1 / F.col(f"l{i}_{i}") for i in range(DIMS)})
    for d in range(1, DIMS):
        df = df.withColumns({
            f"w{i}_{i - d}": -total(F.col(f"l{i}_{k}") * F.col(f"w{k}_{i - d}") for k in range(i - d, i)) / F.col(f"l{i}_{i}")
            for i in range(d, DIMS)
        })
    names = ["group", *[f"m{i}" for i in range(DIMS)], *[f"w{i}_{j}" for i, j in PAIRS]]
    return store(df.select(*names), "params")


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x*`` from the joined parameters."""
    off = [F.col(f"x{i}") / UNIT - F.col(f"m{i}") for i in range(DIMS)]
    rows = [sum((F.col(f"w{i}_{j}") * off[j] for j in range(i + 1)), F.lit(0.0)) for i in range(DIMS)]
    return sum((F.pow(r, 2) for r in rows), F.lit(0.0))


def _sums() -> list[Column]:
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    firsts = [exact(F.col(f"x{i}")).alias(f"t{i}") for i in range(DIMS)]
    seconds = [exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"t{i}_{j}") for i, j in PAIRS]
    return [F.count(F.lit(1)).alias("n"), *firsts, *seconds]


def _moments(sums: DataFrame, consistency: float) -> DataFrame:
    """Centre and scatter of sums, made consistent and widened by the floors."""
    n = F.col("n").cast("double")
    mean = [F.col(f"t{i}").cast("double") / n / UNIT for i in range(DIMS)]
    floors = list(FLOORS.values())
    out = []
    for i, j in PAIRS:
        second = F.col(f"t{i}_{j}").cast("double") / n / UNIT**2 - mean[i] * mean[j]
        scatter = consistency * (F.greatest(second, F.lit(0.0)) if i == j else second)
        out.append((scatter + floors[i] ** 2 if i == j else scatter).alias(f"s{i}_{j}"))
    return _with_inverse(sums.select("group", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *out))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and absolute deviations per group and statistic, from counts of equal values."""
    long = rows.select("group", F.posexplode(F.array(*[f"x{i}" for i in range(DIMS)])).alias("d", "x"))
    counts = store(long.groupBy("group", "d", "x").agg(F.count(F.lit(1)).alias("c")), "values")

    def middle(df: DataFrame, value: str, name: str) -> DataFrame:
        of = Window.partitionBy("group", "d")
        so_far = F.sum("c").over(of.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
        seen = df.withColumn("_so", so_far).withColumn("_all", F.sum("c").over(of))
        return seen.where("2 * _so >= _all").groupBy("group", "d").agg(F.min(value).alias(name))

    medians = middle(counts, "x", "m")
    away = counts.join(medians, ["group", "d"]).withColumn("a", F.abs(F.col("x") - F.col("m")))
    spread = middle(away.groupBy("group", "d", "a").agg(F.sum("c").alias("c")), "a", "mad")
    both = medians.join(spread, ["group", "d"]).groupBy("group")
    floors = list(FLOORS.values())
    at = lambda d, c: F.max(F.when(F.col("d") == d, F.col(c))) / UNIT
    scale = [(F.pow(at(i, "mad") * 1.4826, 2) + floors[i] ** 2).alias(f"s{i}_{i}") for i in range(DIMS)]
    zero = [F.lit(0.0).alias(f"s{i}_{j}") for i, j in PAIRS if i != j]
    return _with_inverse(both.agg(*[at(i, "m").alias(f"m{i}") for i in range(DIMS)], *scale, *zero))


def _groups(rows: DataFrame) -> DataFrame:
    """``lang, source`` to ``group``: their own, their language's, the common one, or null."""
    sizes = rows.where("NOT base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < MIN_GROUP
    in_lang = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))
    sizes = sizes.withColumn("_lang", in_lang)
    lone = small & (F.col("_lang") < MIN_GROUP)
    in_all = F.sum(F.when(lone, F.col("n")).otherwise(0)).over(Window.partitionBy(F.lit(1)))
    named = lambda *c: F.to_json(F.array(*c), {"ignoreNullFields": "false"})
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    group = (
        F.when(~small, named(lang, source))
        .when(~lone, named(lang))
        .when(F.col("_all") >= MIN_GROUP, F.lit("[]"))
    )
    return sizes.withColumn("_all", in_all).select(
        F.struct("lang", "source").alias("_of"), F.coalesce(group, F.lit("")).alias("group")
    )


def _judged(docs: DataFrame, tail: float, whole: bool) -> DataFrame:
    """The rows of :func:`text_statistics` with ``base_failed``, ``distance`` and ``kept``."""
    stats = text_statistics(docs, whole).withColumn("base_failed", base_failed())
    rows = store(stats.select("*", *features()), "statistics")
    groups = store(_groups(rows), "groups")
    grouped = join_list(rows.withColumn("_of", F.struct("lang", "source")), groups, ["_of"], "left").drop("_of")
    of_group = grouped.where("NOT base_failed AND group <> ''").select("group", *[f"x{i}" for i in range(DIMS)])
    params = _start(of_group)
    bins = F.floor(F.log2(F.col("_d2") + 2.0**-20) * BINS_PER_DOUBLING)
    quantile = chi_square_quantile(CORE, DIMS)
    core_factor = CORE / chi_square_below(quantile, DIMS + 2)
    for _ in range(STEPS):
        near = join_list(of_group, params, ["group"]).withColumn("_d2", _distance()).withColumn("_bin", bins)
        binned = near.groupBy("group", "_bin").agg(*_sums())
        of = Window.partitionBy("group")
        before = F.sum("n").over(of.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
        core = binned.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_all", F.sum("n").over(of))
        names = ["n", *[f"t{i}" for i in range(DIMS)], *[f"t{i}_{j}" for i, j in PAIRS]]
        core = core.where(F.col("_before") < CORE * F.col("_all")).groupBy("group")
        params = _moments(core.agg(*[F.sum(c).alias(c) for c in names]), core_factor)
    cut = chi_square_quantile(0.975, DIMS)
    near = join_list(of_group, params, ["group"]).withColumn("_d2", _distance()).where(F.col("_d2") <= cut)
    params = _moments(near.groupBy("group").agg(*_sums()), 0.975 / chi_square_below(cut, DIMS + 2))
    judged = join_list(grouped, params, ["group"], "left").withColumn("distance", _distance())
    near_enough = F.coalesce(F.col("distance") <= chi_square_quantile(1 - tail, DIMS), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & near_enough)


def quality_verdicts(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``distance`` and ``kept``.

    ``distance`` is the squared Mahalanobis distance, null where the base rule decided alone.
    """
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return _judged(docs, tail, False).select("doc_id", *longs, "base_failed", "kept", "distance")


def keep_quality(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """Documents that pass, in ``docs``' columns.

    Rows stay beside their statistics, in one column that no other name can meet, so that
    no text is shuffled: a verdict takes the row and the parameters of its group.
    """
    kept = _judged(docs, tail, True).where("kept")
    return kept.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
