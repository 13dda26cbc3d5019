import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import language_mixture as lm

SCHEMA = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def model(spark, labelled):
    kept = [r for r in labelled if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    return lm.learn(spark.createDataFrame(kept, SCHEMA))


def test_held_out_accuracy(spark, labelled):
    df = spark.createDataFrame(labelled, SCHEMA)
    for name in "held_out lang_pred score languages place n".split():
        df = df.withColumn(name, F.lit("x"))
    found = lm.identify(df)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score", "languages"]
    rows = {r.doc_id: r for r in found.collect()}
    lang = {i: l for i, _, l in labelled}
    assert rows.keys() == lang.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 for r in rows.values())
    asked = [r for r in rows.values() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in asked) >= 0.99 * len(asked)
    assert sum(len(r.languages) == 1 for r in asked) >= 0.9 * len(asked)


def test_predictions_use_nothing_but_the_text(spark, labelled):
    """Neither the label nor the id of a held-out document changes anything."""
    changed = [(i, t, "xx") if zlib.crc32(str(i).encode()) % 4 == 2 else (i, t, l) for i, t, l in labelled]
    one = lm.identify(spark.createDataFrame(labelled, SCHEMA)).collect()
    other = lm.identify(spark.createDataFrame(changed, SCHEMA).repartition(5)).collect()
    assert sorted(map(str, one)) == sorted(map(str, other))


def test_mixtures_of_two_languages(spark, labelled, model):
    by = defaultdict(list)
    for i, t, l in labelled:
        if zlib.crc32(str(i).encode()) % 4 == 2 and 400 < len(t) < 4000 and "#" not in t and "|" not in t:
            by[l].append(t)
    rows, want = [], {}
    for k, (a, b) in enumerate((a, b) for a in by for b in by if a != b):
        for n, (x, y) in enumerate(zip(by[a], by[b], strict=False)):
            if n < 5:
                words_x, words_y = x.split()[:120], y.split()[:60]
                if len(words_x) == 120 and len(words_y) == 60:
                    rows.append((100 * k + n, " ".join(words_x + words_y)))
                    want[100 * k + n] = (a, b)
    found = {r.doc_id: r for r in lm.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert len(want) >= 20
    right = sum([e.lang for e in found[i].languages] == list(pair) for i, pair in want.items())
    assert right >= 0.9 * len(want)
    for i, pair in want.items():
        shares = {e.lang: e.share for e in found[i].languages}
        if set(shares) == set(pair):
            assert shares[pair[0]] == pytest.approx(2 / 3, abs=0.12)


def test_counts_and_likelihoods_against_brute_force(spark):
    rows = [(1, "Ab, ab ćd", "x"), (4, "bé-ab 12 _", "x"), (5, "dd ab", "y")]
    model = lm.learn(spark.createDataFrame(rows, SCHEMA).repartition(3))
    words = {"x": ["ab", "ab", "ćd", "bé", "ab"], "y": ["dd", "ab"]}
    assert model.languages == ["x", "y"]
    grams = {l: Counter() for l in words}
    for l, ws in words.items():
        for w in ws:
            a = b = " "
            for c in w + " ":
                for g in ((3, a, b, c), (2, "", b, c), (1, "", "", c), (4, a, b, ""), (5, "", b, "")):
                    grams[l][g] += 1
                a, b = b, c
    code = lambda c: np.array([ord(c) if c else 0], np.uint64)
    place = lambda g: int(lm._place(code(g[1]), code(g[2]), code(g[3]), g[0], model.buckets)[0])
    summed = {l: Counter() for l in words}
    for l in words:
        for g, n in grams[l].items():
            summed[l][place(g)] += n
    for k, l in enumerate(model.languages):
        assert {p: int(model.counts[p, k]) for p in np.flatnonzero(model.counts[:, k])} == dict(summed[l])
        assert model.totals[k] == sum(len(w) + 1 for w in words[l])
    got = model.likelihoods(pa.array(["ab", "zz", "d"], pa.large_string()))
    for row, w in zip(got, ["ab", "zz", "d"], strict=True):
        for k, l in enumerate(model.languages):
            total, a, b = 0.0, " ", " "
            for c in w + " ":
                n = lambda *g: summed[l][place(g)]  # noqa: B023, E731
                p = (n(1, "", "", c) + 0.5) / (model.totals[k] + 0.5 * model.buckets)
                p = (n(2, "", b, c) + lm.LEAN * p) / (n(5, "", b, "") + lm.LEAN)
                p = (n(3, a, b, c) + lm.LEAN * p) / (n(4, a, b, "") + lm.LEAN)
                total, a, b = total + np.log(min(p, 1.0)), b, c
            assert row[k] == pytest.approx(total, rel=1e-5)


def test_expectation_maximisation_against_a_plain_loop():
    rng = np.random.default_rng(4)
    doc = np.sort(rng.integers(0, 6, 200))
    logs, count = rng.normal(-20, 6, (200, 3)), rng.integers(1, 4, 200).astype(float)
    allowed = np.ones((6, 3))
    allowed[2] = [1, 0, 1]
    shares, value = lm.mixtures(logs, doc, count, 6, allowed)
    for d in range(6):
        x, c = np.exp(logs[doc == d]), count[doc == d]
        pi = allowed[d] / allowed[d].sum()
        for _ in range(2000):
            r = pi * x
            pi = ((c[:, None] * r / r.sum(1, keepdims=True)).sum(0)) / c.sum()
        assert shares[d] == pytest.approx(pi, abs=0.02)
        assert value[d] == pytest.approx((c * np.log((pi * x).sum(1))).sum(), rel=1e-3)


def test_odd_rows(spark, odd, odd_rows, none):
    found = lm.identify(odd).collect()
    learned = {l for i, t, l, _ in odd_rows if l and zlib.crc32(str(i).encode()) % 4 != 2 and any(c.isalpha() for c in t or "")}
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in odd_rows)
    texts = {r[0]: r[1] for r in odd_rows}
    for r in found:
        if any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert r.lang_pred in learned and r.languages
        else:
            assert (r.lang_pred, r.score, r.languages) == ("und", 0.0, [])
    assert lm.identify(none).collect() == []
    untaught = lm.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}
    lone = spark.createDataFrame([(None, "ab cd", "x"), (None, "", "x")], SCHEMA)
    assert sorted((r.held_out, r.lang_pred) for r in lm.identify(lone).collect()) == [(False, "und"), (False, "x")]


def test_texts_without_blanks_and_letters_of_other_scripts(spark, model):
    rows = [(1, "日本語" * 5000), (2, "½ Ⅷ 12 _ ́"), (3, "x" * 100_000)]
    found = {r.doc_id: r for r in lm.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert found[1].lang_pred in model.languages and found[2].lang_pred == "und" and found[3].lang_pred in model.languages


def test_more_languages_share_a_bounded_table(spark, monkeypatch):
    monkeypatch.setattr(lm, "MODEL_ENTRIES", 4096)
    rows = [(k, f"wort{chr(97 + k)} {chr(97 + k) * 5}", f"l{k}") for k in range(10)]
    small = lm.learn(spark.createDataFrame(rows, SCHEMA))
    assert small.counts.size <= 4096
    monkeypatch.setattr(lm, "MOST_LANGUAGES", 5)
    with pytest.raises(ValueError):
        lm.learn(spark.createDataFrame(rows, SCHEMA))


def test_words_against_a_plain_loop(odd_rows):
    import re
    import unicodedata

    texts = [r[1] for r in odd_rows] + ["Don't x1y2 É́a " + "z" * 60 + " \u00a0q", "\u0301", "a" * 24 + "b", None, "ªb Ⅷ ½"]
    words = lm.words_of(pa.array(texts))
    got = [Counter() for _ in texts]
    for d, w, c in zip(words.doc, words.word, words.count, strict=True):
        got[d][words.distinct[int(w)].as_py()] += int(c)
    assert list(words.doc) == sorted(words.doc)
    for text, counted in zip(texts, got, strict=True):
        kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()).split()
        runs = [r for r in kept if any(c.isalpha() for c in r)]
        assert counted == Counter(r[k : k + lm.PIECE] for r in runs for k in range(0, len(r), lm.PIECE))
