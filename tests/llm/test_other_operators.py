from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import decontaminate, licenses, mixing, quality, revisits


# ---- benchmark items ---------------------------------------------------------------


def leaks(rows, items, shingles):
    docs = [(d, shingles(t, 5)) for d, t in rows]
    tests = [(i, shingles(t, 5)) for i, t in items]
    return Counter(
        (d, i, len(b), len(a & b)) for d, a in docs for i, b in tests if a & b and len(a & b) >= 0.8 * len(b)
    )


def leak_rows(df):
    return Counter((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in df.collect())


def planted(spark, odd_rows):
    words = [f"w{k}" for k in range(30_000)]
    items = [(k, " ".join(words[k * 50 : k * 50 + 3 + 4 * k])) for k in range(20)]
    items += [(30, None), (31, ""), (32, "One"), (33, odd_rows[4][1][:200]), (33, odd_rows[4][1][:200])]
    docs = [(k, " ".join(words[: 40 * 3**k])) for k in range(7)]
    docs += [(10 + k, "x y z " * k + t.upper() + " q") for k, t in items if t] + [(50, "a one b"), (51, "ONE"), (52, None)]
    return docs, items


@pytest.mark.parametrize("block", [20_000, 4])
def test_leaks_in_long_documents(spark, odd_rows, brute, block):
    docs, items = planted(spark, odd_rows)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    assert leak_rows(decontaminate.find_leaks(d, i, block_items=block)) == leaks(docs, items, brute.shingles)


def test_leaks_of_odd_rows(spark, odd, odd_rows, none, brute):
    items = [(1, odd_rows[4][1][:300]), (2, None), (3, "word")]
    i = spark.createDataFrame(items, "item_id bigint, text string")
    want = leaks([r[:2] for r in odd_rows], items, brute.shingles)
    assert leak_rows(decontaminate.find_leaks(odd, i)) == want
    assert decontaminate.find_leaks(none, i).collect() == []
    assert decontaminate.find_leaks(odd, i.where("1 = 0")).collect() == []
    kept = decontaminate.drop_leaks(odd, i)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in odd_rows} - {k[0] for k in want}


# ---- mixing --------------------------------------------------------------------------


def sainte_lague(weights, total):
    seats = [0] * len(weights)
    for _ in range(total):
        best = max(range(len(weights)), key=lambda k: (weights[k] / (2 * seats[k] + 1), -k))
        seats[best] += 1
    return seats


@pytest.mark.parametrize("weights,total", [([5, 3, 1], 7), ([1, 1, 1], 4), ([10, 0, 3, 3], 9), ([7], 5), ([2, 5], 0), ([53, 24, 23], 12), ([1000, 1, 1, 1], 3)])
def test_seats_by_highest_quotients(spark, weights, total):
    rows = [(0, k + 1, w, total) for k, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "g int, rank bigint, w bigint, total bigint")
    got = {r["rank"]: r["n"] for r in mixing.seats(df, ["g"], "w", "total", "n").collect()}
    assert [got[k + 1] for k in range(len(weights))] == sainte_lague(weights, total)


def test_targets_stop_at_three_times_the_source(spark):
    rows = [("a", 1000), ("b", 1), ("c", 2), (None, 100), ("d", 0)]
    df = spark.createDataFrame(rows, "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got["b"] == 3 and got["c"] == 6 and got["d"] == 0 and got[None] == 300
    assert sum(got.values()) == pytest.approx(1103)


def test_taken_words(docs, brute):
    plan = mixing.mix_plan(docs, block_words=8).collect()
    by_source = defaultdict(lambda: [0, 0])
    for r in plan:
        assert 0 <= r.taken <= 3 * r["size"]
        by_source[r.source][0] += r.taken
        by_source[r.source][1] = r.target
    for taken, target in by_source.values():
        assert abs(taken - target) <= max(24, 0.03 * target)
    again = mixing.mix_plan(docs.repartition(5), block_words=8).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in plan)


@pytest.mark.parametrize("shard_words", [1_000_000, 500])
def test_mixed_rows_hold_the_taken_words(docs, brute, shard_words):
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(docs, 8, shard_words).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = Counter()
    mixed = mixing.mix(docs, 8, shard_words)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[r.doc_id] += len(brute.words(r.text))
        assert r.n_chars == len(r.text)
        assert set(brute.words(r.text)) <= set(brute.words(texts[r.doc_id]))
    assert got == Counter({d: n for d, n in plan.items() if n})


def test_mixing_odd_rows(odd, odd_rows, none, brute):
    plan = mixing.mix_plan(odd).collect()
    assert Counter((r.doc_id, r["size"]) for r in plan) == Counter((r[0], len(brute.words(r[1]))) for r in odd_rows)
    words = Counter()
    for r in mixing.mix(odd).collect():
        words[r.doc_id] += len(brute.words(r.text))
    taken = Counter()
    for r in plan:
        taken[r.doc_id] += r.taken
    assert words == Counter({d: n for d, n in taken.items() if n})
    assert mixing.mix_plan(none).collect() == [] and mixing.mix(none).collect() == []


def test_mixing_without_words_and_with_a_source_under_half_a_block(spark, brute):
    wordless = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " ", None)], "doc_id bigint, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mixing.mix_plan(wordless).collect()} == {(k, 0, 0.0, 0) for k in (1, 2, 3)}
    assert mixing.mix(wordless).collect() == []
    rows = [(k, "w " * 500, "big") for k in range(40)] + [(100, "one two three", "small"), (101, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    assert plan[100].taken <= 9 and plan[101].taken == 0
    assert abs(sum(r.taken for r in plan.values()) - 20_003) <= 128


def test_shares_above_three_times_a_shard_go_to_the_others(spark):
    rows = [(1, 0, 10, 64 * 4), (1, 1, 10, 64), (2, 0, 4, 64)]
    placed = spark.createDataFrame(rows, "rank bigint, shard bigint, source_blocks bigint, size bigint")
    got = {(r["rank"], r.shard): r.quota for r in mixing._shard_quotas(placed, 64).collect()}
    assert got == {(1, 0): 8, (1, 1): 2, (2, 0): 3}
    rows = [(1, 0, 9, 64 * 2 - 1), (1, 1, 9, 64 * 1), (3, 0, 14, 64 * 4), (3, 1, 14, 1)]
    placed = spark.createDataFrame(rows, "rank bigint, shard bigint, source_blocks bigint, size bigint")
    got = {(r["rank"], r.shard): r.quota for r in mixing._shard_quotas(placed, 64).collect()}
    assert got == {(1, 0): 6, (1, 1): 3, (3, 0): 12, (3, 1): 2}


def test_columns_named_like_those_of_the_plan(spark, docs):
    """Every name that the operators make, taken from the operators."""
    names = set(mixing._laid(docs, 64, 1000, 1, docs.selectExpr("doc_id", "source", "text", "struct(*) AS _doc")).columns)
    names |= {"_first", "_times", "_copy", "_text", "_source", "_of", "_bin", "_d2", "twin"}
    names |= set(quality._judged(docs, 1e-3, True).columns)
    names -= set(docs.columns)
    wide = docs.where("doc_id < 60").select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in sorted(names)])
    for made in (mixing.mix(wide), quality.keep_quality(wide)):
        assert made.columns == wide.columns
        rows = made.collect()
        assert rows
        for r in rows:
            assert all(r[n] == n + str(r.doc_id) for n in names)


# ---- licenses ----------------------------------------------------------------------


def test_licenses_come_from_the_nearest_directory(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [
        (1, "a/LICENSE", "x\n" + mit), (2, "a/b/LICENSE", gpl), (3, "a/b/c/f.txt", "nothing"), (4, "a/x/f.txt", "nothing"),
        (5, "a/b/g.txt", "head\n// " + mit.upper() + "\ntail"), (6, "z/f.txt", "released"), (7, "f.txt", None), (8, None, mit),
        (9, "ab/f.txt", "no"), (3, "a/b/c/f.txt", "nothing"), (10, "a/f.txt", ""), (11, "LICENSE", gpl),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumn("dir", F.lit("q")).withColumn("license", F.lit("q"))
    got = Counter((r.doc_id, r.own_license, r.license, r.from_dir) for r in licenses.scan_licenses(df).collect())
    assert got == Counter([
        (1, "MIT", "MIT", None), (2, "GPL-3.0", "GPL-3.0", None), (3, None, "GPL-3.0", "a/b"), (3, None, "GPL-3.0", "a/b"),
        (4, None, "MIT", "a"), (5, "MIT", "MIT", None), (6, None, None, None), (7, None, None, None), (8, "MIT", "MIT", None),
        (9, None, None, None), (10, None, "MIT", "a"), (11, "GPL-3.0", "GPL-3.0", None),
    ])
    assert licenses.scan_licenses(df.where("1 = 0")).collect() == []


def test_headers_and_license_files_as_a_whole(spark):
    """Texts wrapped over lines, names in use, and other words around."""
    wrap = lambda text, n: "\n".join(" ".join(text.split()[k : k + n]) for k in range(0, len(text.split()), n))
    full = licenses.TEXTS
    rows = [
        (1, "a/COPYING", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + wrap(full["MIT"], 11)),
        (2, "a/src/x.c", "code\n"), (3, "b/licence.md", wrap(full["BSD-3-Clause"], 7)), (4, "b/y.c", "int x;"),
        (5, "c/z.c", wrap("/* " + full["Apache-2.0"] + " */", 9) + "\n\nint main() {}\n" * 50),
        (6, "c/w.c", "int y;\n\n" + wrap(full["GPL-3.0"], 9)),  # neither a header nor a license file
        (7, "d/NOTICE-3.txt", wrap(full["GPL-3.0"], 8) + "\n\nwritten by many"), (8, "d/e/f/v.c", "x"),
        (9, "e/relicense.txt", "\n\n" + wrap(full["MIT"], 5)), (10, "e/u.c", "y"),
    ] + [(100 + k, f"t/f{k}.txt", f"the copy of this file is the {k} th and any of the files to be in use") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    got = {r.doc_id: (r.own_license, r.license, r.from_dir) for r in licenses.scan_licenses(df).collect()}
    assert {k: got[k] for k in range(1, 11)} == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", "a"), 3: ("BSD-3-Clause", "BSD-3-Clause", None), 4: (None, "BSD-3-Clause", "b"),
        5: ("Apache-2.0", "Apache-2.0", None), 6: (None, None, None), 7: ("GPL-3.0", "GPL-3.0", None), 8: (None, "GPL-3.0", "d"),
        9: (None, None, None), 10: (None, None, None),
    }
    assert all(got[100 + k] == (None, None, None) for k in range(300))


def test_anchors_lose_no_line():
    weights = licenses.Weights(1000, {"license": 40, "the": 300, "under": 50}, licenses.ALL_TEMPLATES, 0.75)
    for vector in weights.vectors.values():
        assert sum(v * v for w, v in vector.items() if w not in weights.anchors) < 0.75**2


def test_no_python_in_the_license_plan(docs):
    plan = licenses.scan_licenses(licenses.document_files(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- revisits ------------------------------------------------------------------------

SCHEMA = (
    "record_id bigint, url string, ts bigint, kind string, etag string, last_modified string,"
    " headers map<string,string>, digest string, length bigint"
)


def captures():
    rows = []
    for k in range(400):  # one URL with most rows
        url = ["http://A.example.com:80/x", "http://a.example.com/x#f", "HTTP://a.example.com/x"][k % 3] if k % 4 else f"http://b.example.com/{k % 8}?"
        if k % 5 < 2:
            rows.append((k, url, 1000 + k // 3, "response", f'"{k // 50}"' if k % 7 else None, f"t{k // 90}", {"etag": "x", "server": str(k)}, f"d{k}", k))
        else:
            tag = f'W/"{k // 50}"' if k % 3 else None
            rows.append((k, url, 1000 + k // 3, "revisit", tag, f"t{k // 90}" if k % 2 else None, {"etag": "y", "server": "n", "date": str(k)}, None, None))
    rows += [(900, None, 5, "response", None, None, None, "d", 1), (901, None, 6, "revisit", None, None, None, None, None)]
    rows += [(902, "odd url", 5, "response", None, None, None, "d", 1), (903, "odd url", 6, "revisit", None, None, None, None, None)]
    return rows + [rows[2], rows[4]]


def resolved(rows):
    def canon(url):
        import re

        m = re.match(r"([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
        if not m:
            return url
        host = m[2].lower().removesuffix(":80")
        return f"{m[1].lower()}://{host}{m[3] or '/'}{'' if (m[4] or '') == '?' else m[4] or ''}"

    out = Counter()
    for i, url, ts, kind, etag, modified, headers, _, _ in rows:
        if kind != "revisit":
            continue
        full = max(
            (r for r in rows if r[3] == "response" and url is not None and r[1] is not None and canon(r[1]) == canon(url) and r[2] < ts),
            key=lambda r: (r[2], r[0]), default=None,
        )
        if full is None:
            status = "NO_EARLIER_RESPONSE"
        elif etag is not None:
            status = "RESOLVED" if full[4] is not None and etag.removeprefix("W/") == full[4] else "VALIDATOR_MISMATCH"
        elif modified is not None:
            status = "RESOLVED" if modified == full[5] else "VALIDATOR_MISMATCH"
        else:
            status = "UNCHECKED"
        good = status in ("RESOLVED", "UNCHECKED")
        merged = dict(headers or {})
        if good:
            merged = {**(full[6] or {}), **{k: v for k, v in merged.items() if k in revisits.PERMITTED}}
        out[(i, canon(url), ts, status, full[0] if good else None, full[7] if good else None, frozenset(merged.items()))] += 1
    return out


@pytest.mark.parametrize("partitions", [1, 9])
def test_revisits(spark, partitions):
    rows = captures()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_range", F.lit("x")).withColumn("status", F.lit("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = revisits.resolve_revisits(df).collect()
        assert revisits.resolve_revisits(df.where("1 = 0")).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = Counter((r.record_id, r.url, r.ts, r.status, r.refers_to, r.digest, frozenset(r.headers.items())) for r in found)
    assert got == resolved(rows)


# ---- pipeline ------------------------------------------------------------------------


def test_pipeline_runs_its_stages(spark, sf_dir, docs, brute):
    from gleaner.session import store

    step, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = store(stage(spark, step, sf_dir), name)
        if name != "tokens":
            assert after.columns == docs.columns
            if name != "mixing":
                ids = {r.doc_id for r in step.select("doc_id").collect()}
                assert {r.doc_id for r in after.select("doc_id").collect()} <= ids
        seen.append(after.count())
        step = after
    assert seen[0] < docs.count() and seen[1] < seen[0] and seen[3] == seen[4]
    whole = corpus_pipeline.run(spark, sf_dir)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(whole) == rows(step)


def test_pipeline_of_odd_and_no_rows(spark, sf_dir, odd, none):
    for start in (odd, none):
        step = start
        for name, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, sf_dir)
            if name != "tokens":
                assert step.columns == start.columns
        got = step.collect()
        assert bool(got) == (start is odd)
