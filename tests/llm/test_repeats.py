import hashlib
import random
from collections import Counter

import numpy as np

from gleaner.llm import repeats


def expected(rows, span=400):
    texts = [(d, (t or "").encode()) for d, t in rows]
    starts = Counter(r[k : k + span] for _, r in texts for k in range(len(r) - span + 1))
    out = Counter()
    for d, r in texts:
        gone, end = bytearray(len(r)), 0
        for k in range(len(r) - span + 1):
            if starts[r[k : k + span]] > 1:
                first = max(k, end)
                end = k + span
                gone[first:end] = b"\x01" * (end - first)
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[(d, len(r), len(r) - len(kept), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def rows_of(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def planted():
    rng = random.Random(1)
    p = "".join(rng.choice("abcd efgh") for _ in range(900))
    q = "".join(rng.choice("xyzw ü") for _ in range(420))
    rows = [
        (1, "a" * 2000), (2, p[:500] + "1" + p[100:700]), (3, "zz" + p[50:460] + "k"), (4, None), (5, ""),
        (6, "é" * 250 + "b"), (7, "q" + "é" * 250), (8, q), (9, "-" + q[:-5]), (10, "ab" * 300 + "x" + "ab" * 201),
        (11, p[300:900]), (12, p[300:900]), (13, q[10:] + q[:400]), (14, "k" * 400), (15, "m" * 399),
        (16, p[:200] + q + p[200:]), (16, p), (17, "\x00" * 401),
    ]
    passage = "".join(rng.choice("lmnop qrst") for _ in range(430))
    rows += [(100 + k, f"{k} " * (5 + k % 7) + passage + f" {k}" * (3 + k % 5)) for k in range(40)]
    return rows


def test_planted_and_hot_triggers(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = expected(rows)
    assert rows_of(repeats.without_repeats(df)) == want
    assert rows_of(repeats.without_repeats(df, many=1)) == want
    assert rows_of(repeats.without_repeats(df, frequent=2)) == want
    assert rows_of(repeats.without_repeats(df, many=1, frequent=1)) == want


def test_equals_brute_force(docs, doc_rows):
    assert rows_of(repeats.without_repeats(docs)) == expected(doc_rows)


def test_odd_rows(odd, odd_rows, none):
    got = rows_of(repeats.without_repeats(odd))
    assert got == expected([r[:2] for r in odd_rows])
    assert repeats.without_repeats(none).collect() == []


def test_texts_longer_than_a_part(spark, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, text), (2, "x" + text[9_000:21_000] + "y"), (3, text[100:600] + "z" * 300)]
    want = expected(rows)
    powers = repeats._powers(30_000)
    monkeypatch.setattr(repeats, "PART_BYTES", 5_000)
    found = repeats._parse_batch([t.encode() for _, t in rows], powers, 400, 128)
    for parts, (_, t) in zip(found, rows, strict=True):
        first, last = np.concatenate(parts[0]), np.concatenate(parts[1])
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
        assert sorted(starts.tolist()) == list(range(len(t) - 399))
    assert rows_of(repeats.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))) == want


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 50, 1000, dtype=np.uint64)
    for width in (1, 7, 273, 1000):
        want = [x[k : k + width].min() for k in range(len(x) - width + 1)]
        assert repeats.sliding_min(x, width).tolist() == want


def test_suffix_ranks_are_alphabetical():
    rng = np.random.default_rng(2)
    for size, span in ((0, 400), (5, 400), (700, 3), (700, 8), (3000, 20), (3000, 400)):
        data = rng.integers(97, 99, size, dtype=np.uint8)
        data[size // 2 :] = data[: size - size // 2]  # long equal strings
        raw = data.tobytes() + b"\0" * span
        strings = [raw[k : k + span] for k in range(size)]
        inside = max(0, size - span + 1)
        got = repeats.suffix_ranks(data, span)
        order = {s: r for r, s in enumerate(sorted(set(strings[:inside])))}
        ranks = np.unique(got[:inside], return_inverse=True)[1].ravel() if inside else np.zeros(0, int)
        assert ranks.tolist() == [order[s] for s in strings[:inside]]


def test_pieces_hold_every_string_once(spark):
    rng = random.Random(3)
    rows = [(k, 10 * k, -k, lead, bytes(rng.choices(b"ab", k=400 + extra))) for k, (lead, extra) in enumerate([(272, 272), (10, 0), (130, 100), (70, 7)])]
    for width in repeats.STRINGS:
        df = spark.createDataFrame(rows, "trigger bigint, c1 bigint, c2 bigint, lead int, phrase binary")
        found = repeats._pieces(df, 400, width).collect()
        for trigger, _, _, lead, phrase in rows:
            mine = sorted((p for p in found if p.o1 == trigger), key=lambda p: p.first)
            assert all(bytes(p.phrase) == phrase[p.first : p.first + p.size] and p.lead == lead - p.first for p in mine)
            assert all(p.size - 399 <= width for p in mine)
            assert [k for p in mine for k in range(p.first, p.first + p.size - 399)] == list(range(len(phrase) - 399))
