from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from gleaner.llm import neardup
from gleaner.llm.graph import components
from gleaner.llm.words import shingle_sets


def expected(rows, shingles, percent, width):
    sets = defaultdict(list)
    for d, t in rows:
        sets[d].append(shingles(t, width))
    holders = defaultdict(set)
    for d, found in sets.items():
        for s in found:
            for x in s:
                holders[x].add(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, found in sets.items():
        for s in found:
            near = Counter(e for x in s for e in holders[x] if e < d)
            for e in near:
                for o in sets[e]:
                    if o and 100 * len(s & o) >= percent * len(s | o):
                        a, b = sorted((root(d), root(e)))
                        parent[b] = a
    return Counter((d, len(s), root(d), root(d) == d) for d, found in sets.items() for s in found)


def rows_of(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_equals_brute_force(docs, doc_rows, brute):
    assert rows_of(neardup.near_duplicates(docs, 85, 3)) == expected(doc_rows, brute.shingles, 85, 3)


def test_odd_rows(odd, odd_rows, none, brute):
    got = rows_of(neardup.near_duplicates(odd, 80, 5))
    assert got == expected([r[:2] for r in odd_rows], brute.shingles, 80, 5)
    assert neardup.near_duplicates(none).collect() == []
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, _, k in got if k}


def chain_of_copies(n, length=120):
    """Texts of which each differs a little from the next, and more from those far away."""
    words = [f"w{k}" for k in range(length)]
    out = []
    for k in range(n):
        words = list(words)
        words[(k * 7) % length] = f"x{k}"
        out.append((k, " ".join(words)))
    return out


def test_chains_and_small_blocks(spark, brute, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "EXACT_BLOCK", 2)
    rows = chain_of_copies(60)
    shared = " ".join(f"p{k}" for k in range(60))
    rows += [(1000 + k, shared + " " + " ".join(f"y{k}_{j}" for j in range(6 + k % 5))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(neardup.near_duplicates(df, 85, 3)) == expected(rows, brute.shingles, 85, 3)


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    for size, share in ((2000, 0.5), (300, 0.8), (2000, 0.9)):
        common = rng.integers(0, 2**64, int(size * share), dtype=np.uint64)
        sets = [np.unique(np.concatenate((common, rng.integers(0, 2**64, size - len(common), dtype=np.uint64)))) for _ in range(2)]
        flat, offsets = np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        matrix = neardup.registers(flat, offsets)
        n = np.diff(offsets)
        estimate, _ = neardup.could_link(matrix[:1], matrix[1:], n[:1], n[1:], 85)
        truth = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        assert abs(estimate[0, 0] - truth) < 0.17


def test_registers_keep_the_order_of_hashes():
    values = np.sort(np.random.default_rng(2).integers(0, 2**57, 5000, dtype=np.uint64))
    codes = np.array([neardup.registers(v[None], np.array([0, 1]))[0, 0] for v in values])
    assert (np.diff(codes.astype(int)) >= 0).all()
    assert (codes != neardup.EMPTY).all()


def test_bands_of_near_sets_meet():
    rng = np.random.default_rng(3)
    missed = 0
    for size in (7, 20, 60, 200, 1000):
        for _ in range(40):
            base = rng.integers(0, 2**64, size, dtype=np.uint64)
            other = base.copy()
            change = int(size * 0.15 / 1.85)  # changed shingles that leave the similarity at 0.85
            other[:change] = rng.integers(0, 2**64, change, dtype=np.uint64)
            both = [np.sort(base), np.sort(other)]
            matrix = neardup.registers(np.concatenate(both), np.array([0, size, 2 * size]))
            keys = neardup.band_keys(matrix)
            missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 200), (300, 200), (7, 7), (500, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 200: 100, 300: 100, 400: 400, 500: 400}


def test_shingles_of_sliced_batches(brute):
    texts = ["The Cat sat", None, "", "a b c d e a b c d e f", "x"]
    flat, offsets = shingle_sets(pa.array(texts), 5)
    assert np.diff(offsets).tolist() == [len(brute.shingles(t, 5)) for t in texts]


def test_large_groups_around_the_threshold(spark, brute):
    """Copies of one text with changes: nearly each pair is above or under the threshold by little."""
    import random

    rng = random.Random(3)
    rows = []
    for group, (n, changed) in enumerate(((150, 3), (120, 5), (60, 0))):
        base = [f"g{group}w{k}" for k in range(150)]
        for k in range(n):
            words = list(base)
            for at in rng.sample(range(150), rng.randint(0, 2 * changed)):
                words[at] = f"new{group}_{k}_{at}"
            rows.append((1000 * group + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for percent, width in ((85, 3), (80, 5)):
        assert rows_of(neardup.near_duplicates(df, percent, width)) == expected(rows, brute.shingles, percent, width)


def test_components_raise_when_rounds_do_not_do(spark):
    import pytest

    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a bigint, b bigint").repartition(8)
    with pytest.raises(RuntimeError):
        components(edges, rounds=1)
