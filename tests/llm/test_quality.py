from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import quality
from gleaner.llm.quality import CORE, DIMS, FLOORS, MIN_GROUP, STEPS, TAIL, UNIT


def statistics(text, words):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), len(lines)


def vector(s):
    n, chars, symbols, dup, repeated, lines = s
    parts = [
        np.log(n + 10), np.log((chars + 60) / (n + 10)), np.sqrt(symbols / (chars + 60)),
        np.sqrt(dup / (lines + 5)), repeated / (n + 20),
    ]
    return np.floor(np.array(parts) * UNIT + 0.5)


def distances(x, m, s):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)


def mcd(x):
    """The same estimate in numpy."""
    floor = np.diag(np.array(list(FLOORS.values())) ** 2)
    middle = lambda v: np.sort(v)[(len(v) - 1) // 2]
    m = np.array([middle(c) for c in x.T])
    mad = np.array([middle(np.abs(c - v)) for c, v in zip(x.T, m, strict=True)])
    x, m, mad = x / UNIT, m / UNIT, mad / UNIT
    s = np.diag((mad * 1.4826) ** 2) + floor
    factor = CORE / quality.chi_square_below(quality.chi_square_quantile(CORE, DIMS), DIMS + 2)
    for _ in range(STEPS):
        bins = np.floor(np.log2(distances(x, m, s) + 2.0**-20) * quality.BINS_PER_DOUBLING)
        counts = Counter(bins.tolist())
        below, last = 0, None
        for b in sorted(counts):
            if below < CORE * len(x):
                last = b
            below += counts[b]
        core = x[bins <= last]
        m, s = core.mean(0), factor * np.cov(core.T, bias=True) + floor
    cut = quality.chi_square_quantile(0.975, DIMS)
    core = x[distances(x, m, s) <= cut]
    factor = 0.975 / quality.chi_square_below(cut, DIMS + 2)
    return core.mean(0), factor * np.cov(core.T, bias=True) + floor


def test_chi_square():
    # fixed values: textbook quantiles
    for dims, x, p in ((5, 11.070, 0.95), (5, 12.833, 0.975), (4, 9.488, 0.95), (7, 18.475, 0.99), (1, 3.841, 0.95), (2, 5.991, 0.95)):
        assert quality.chi_square_below(x, dims) == pytest.approx(p, abs=1e-4)
        assert quality.chi_square_quantile(p, dims) == pytest.approx(x, abs=5e-3)


def test_equals_brute_force(docs, brute):
    rows = {r.doc_id: r for r in docs.collect()}
    stats = {d: statistics(r.text, brute.words) for d, r in rows.items()}
    failed = {d: s[0] < 10 or 100 * s[4] > 20 * s[0] for d, s in stats.items()}
    groups = defaultdict(list)
    for d, r in rows.items():
        if not failed[d]:
            groups[(r.lang, r.source)].append(d)
    small = defaultdict(list)
    for (lang, _), ids in list(groups.items()):
        if len(ids) < MIN_GROUP:
            small[lang] += ids
    rest = []
    pools = [ids for ids in groups.values() if len(ids) >= MIN_GROUP]
    for ids in small.values():
        if len(ids) >= MIN_GROUP:
            pools.append(ids)
        else:
            rest += ids
    if len(rest) >= MIN_GROUP:
        pools.append(rest)
    want = {}
    for ids in pools:
        x = np.array([vector(stats[d]) for d in ids])
        m, s = mcd(x)
        want.update(zip(ids, distances(x / UNIT, m, s), strict=True))
    limit = quality.chi_square_quantile(1 - TAIL, DIMS)
    got = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert pools and got.keys() == rows.keys()
    for d, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats[d][:5]
        assert r.base_failed == failed[d]
        if d in want:
            assert r.distance == pytest.approx(want[d], rel=1e-3)
            assert r.kept == (want[d] <= limit)
        else:
            assert r.kept == (not failed[d])


def test_good_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.quality_verdicts(docs).join(labels, "doc_id").where("NOT base_failed")
    got = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) == 0
    assert got[(0, False)] >= 10


def test_odd_rows(odd, odd_rows, none, brute):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality_verdicts(odd).collect())
    assert got == Counter((r[0], *statistics(r[1], brute.words)[:5]) for r in odd_rows)
    assert quality.quality_verdicts(none).collect() == []
    kept = quality.keep_quality(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {5, 6, 7, 8, 9, 10, 11} | ({12} if statistics("a\x00b " * 200, brute.words)[4] <= 40 else set())


def test_no_python_in_the_plan(docs):
    for df in (quality.quality_verdicts(docs), quality.text_statistics(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_result_does_not_depend_on_partitions(docs):
    one = {r.doc_id: r.distance for r in quality.quality_verdicts(docs.repartition(7)).collect()}
    other = {r.doc_id: r.distance for r in quality.quality_verdicts(docs.orderBy(F.desc("doc_id"))).collect()}
    assert one == other


def test_most_labelled_junk_goes_on_the_larger_table(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.quality_verdicts(docs).join(labels, "doc_id").where("NOT base_failed")
    got = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert got[(0, False)] >= 0.8 * (got[(0, False)] + got[(0, True)])
    assert got[(1, True)] >= 0.999 * (got[(1, True)] + got.get((1, False), 0))
