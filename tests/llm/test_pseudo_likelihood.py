import time

import numpy as np

from gleaner.llm import pseudo_likelihood as pl


def small(seed=0):
    rng = np.random.default_rng(seed)
    net = pl.start(rng.integers(0, 100, pl.VOCABULARY).astype(float), seed, 4)
    net["bias"] = rng.standard_normal(4) * 0.3
    return {k: v.astype(np.float64) for k, v in net.items()}, rng


def test_gradients_are_those_of_the_log_probability():
    net, rng = small()
    context = rng.integers(0, 6, (9, len(pl.OFFSETS)))
    targets = rng.integers(0, pl.VOCABULARY, 9)
    dense, tables = pl.gradients(net, context, targets)
    full = np.zeros_like(net["tables"])
    full.reshape(-1, 4)[tables[0]] = tables[1]
    dense["tables"] = full
    mean = lambda: pl.log_probabilities(net, context, targets).mean()
    for name, grad in dense.items():
        places = np.argsort(-np.abs(grad).ravel())[:3]
        for at in places:
            flat = net[name].reshape(-1)
            kept, step = flat[at], 1e-5
            flat[at] = kept + step
            up = mean()
            flat[at] = kept - step
            down = mean()
            flat[at] = kept
            assert abs((up - down) / (2 * step) - grad.ravel()[at]) < 1e-5, name


def test_probabilities_sum_to_one():
    net, rng = small(1)
    context = np.repeat(rng.integers(0, pl.VOCABULARY + 1, (1, len(pl.OFFSETS))), pl.VOCABULARY, axis=0)
    total = np.exp(pl.log_probabilities(net, context, np.arange(pl.VOCABULARY))).sum()
    assert abs(total - 1) < 1e-9


def test_rows_of_tables_are_summed_in_little_time():
    rng = np.random.default_rng(5)
    n, width = pl.BATCH, pl.WIDTH
    context = np.minimum(rng.zipf(1.3, (n, len(pl.OFFSETS))), pl.VOCABULARY).astype(np.int64)
    d_hidden = rng.standard_normal((n, width)).astype(np.float32)
    keys = (context + np.arange(len(pl.OFFSETS)) * (pl.VOCABULARY + 1)).T.ravel()
    assert np.bincount(keys).max() > 10 * pl.OFTEN and (np.bincount(keys) == pl.OFTEN).any()
    want = np.zeros((len(pl.OFFSETS) * (pl.VOCABULARY + 1), width))
    np.add.at(want, keys, np.tile(d_hidden, (len(pl.OFFSETS), 1)))
    places, rows = pl._table_gradients(context, d_hidden)
    got = np.zeros_like(want)
    got[places] = rows
    assert len(set(places.tolist())) == len(places) == len(set(keys.tolist()))
    assert np.abs(got - want).max() < 1e-3

    def column_by_column():  # as it was done before
        by_id = np.argsort(keys.astype(np.int16), kind="stable")
        fresh = np.concatenate(([True], np.diff(keys[by_id]) != 0))
        row = np.empty(len(keys), np.int64)
        row[by_id] = np.cumsum(fresh) - 1
        columns = np.tile(d_hidden.T.astype(np.float64), (1, len(pl.OFFSETS)))
        return np.stack([np.bincount(row, c) for c in columns], axis=1).astype(np.float32)

    def least(f):
        took = []
        for _ in range(20):
            began = time.thread_time()
            f()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: pl._table_gradients(context, d_hidden)) < 0.8 * least(column_by_column)


def test_far_values_do_not_leave_the_range_of_numbers():
    for far in (0, 60, -300, 1000):
        x = np.array([[far, far + 1, far - 2], [0, 1, -2]], np.float32)
        want = np.array([0, 1, -2.0]) - np.log(np.exp([0, 1, -2.0]).sum())
        got = np.stack([pl._chosen_log_softmax(x.copy(), np.full(2, k)) for k in range(3)], axis=1)
        assert np.abs(got - want).max() < 1e-4
        assert np.abs(pl._minus_softmax(x.copy()) + np.exp(want)).max() < 1e-5


def lowered(brute, text):
    return brute.words((text or "").translate(brute.LOWER))


def slow_score(model, counts, words):
    """The score of one text, token by token."""
    vocabulary, ids, net = model[:3]
    known = dict(zip(vocabulary.tolist(), ids.tolist(), strict=True))
    prints, grouped = pl.fingerprints(words).view(np.int64).tolist(), pl.groups(words).tolist()
    mine = [known.get(t, pl.FREQUENT + g) for t, g in zip(prints, grouped, strict=True)]
    total = 0.0
    for k, target in enumerate(mine):
        h = net["bias"].astype(np.float64).copy()
        for j, off in enumerate(pl.OFFSETS):
            at = k + off
            h += net["tables"][j][mine[at] if 0 <= at < len(mine) else pl.VOCABULARY]
        h = np.tanh(h)
        for logits, choice in (
            (h @ net["class_out"] + net["class_bias"], target // pl.PER_CLASS),
            (h @ net["word_out"][target // pl.PER_CLASS] + net["word_bias"][target // pl.PER_CLASS], target % pl.PER_CLASS),
        ):
            total += logits[choice] - np.log(np.exp(logits).sum())
        if prints[k] not in known:
            same = [n for w, n in counts.items() if w not in known and counts_group[w] == grouped[k]]
            n = counts.get(prints[k], 0)
            if n:
                total += np.log((n - pl.DISCOUNT) / (sum(same) + 1))
            else:
                total += np.log((pl.DISCOUNT * len(same) + 1) / (sum(same) + 1)) - (len(words[k].encode()) + 1) * np.log(257)
    return total


counts_group = {}


def brute_counts(texts, brute):
    counts = {}
    for text in texts:
        words = lowered(brute, text)
        for w, p, g in zip(words, pl.fingerprints(words).view(np.int64).tolist(), pl.groups(words).tolist(), strict=True):
            counts[p] = counts.get(p, 0) + 1
            counts_group[p] = g
    return counts


def test_scores_equal_the_slow_way(spark, docs, doc_rows, brute):
    model = pl.train(pl.blocks(docs), rounds=1)
    new = [(10**9, "unheard zqxw the of " * 3), (10**9 + 1, "schön ß"), (10**9 + 2, " "), (10**9 + 3, None)]
    scored = docs.select("doc_id", "text").union(spark.createDataFrame(new, "doc_id bigint, text string"))
    got = {r.doc_id: r for r in pl.score(pl.blocks(scored), model).collect()}
    counts = brute_counts([t for _, t in doc_rows], brute)
    assert {r.word: r.n for r in model.counts.collect()} == counts
    for doc_id, text in [*doc_rows[:25], *new]:
        words = lowered(brute, text)
        assert got[doc_id].n_tokens == len(words)
        if len(words) < 400:
            assert abs(got[doc_id].log_likelihood - slow_score(model, counts, words)) < 1e-2 + 1e-3 * len(words)


def test_counts_joined_or_broadcast_score_alike(docs, monkeypatch):
    monkeypatch.setattr(pl, "BLOCK_BYTES", 50_000)
    blocked = pl.blocks(docs)
    model = pl.train(blocked, rounds=1)
    rows = lambda: sorted(map(tuple, pl.score(blocked, model).collect()))
    want = rows()
    assert pl._common(model.counts)[2] and len(want) == docs.count()
    for most in (500, 0):
        monkeypatch.setattr(pl, "COMMON", most)
        assert len(pl._common(model.counts)[0]) <= most and not pl._common(model.counts)[2]
        assert rows() == want


def test_blocks_hold_every_token(docs, doc_rows, brute, monkeypatch):
    monkeypatch.setattr(pl, "BLOCK_BYTES", 3000)
    rows = pl.blocks(docs).collect()
    assert len(rows) > 10 and len({r.block for r in rows}) == len(rows)
    texts, got = dict(doc_rows), {}
    for r in rows:
        tokens, at = np.frombuffer(r.tokens, np.uint16), 0
        for doc_id, n in zip(r.doc_ids, r.sizes, strict=True):
            got[doc_id] = [r.words[k] for k in tokens[at : at + n]]
            at += n
        assert np.bincount(tokens, minlength=len(r.words)).tolist() == r.times
    assert got == {d: pl.fingerprints(lowered(brute, t)).view(np.int64).tolist() for d, t in texts.items()}


def test_training_helps_on_documents_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, held = docs.where("doc_id % 5 > 0"), docs.where("doc_id % 5 = 0")
    seen, held = pl.blocks(seen), pl.blocks(held)
    total = lambda m: pl.score(held, m).agg({"log_likelihood": "sum"}).first()[0]
    before, after = total(pl.train(seen, rounds=0)), total(pl.train(seen, rounds=4))
    assert after > 0.98 * before  # log-likelihoods are negative: at least 2 % less
    again = total(pl.train(seen, rounds=4))
    assert again == after


def test_counts_cover_every_text(docs, doc_rows, brute):
    total = pl.word_counts(pl.blocks(docs)).agg({"n": "sum"}).first()[0]
    assert total == sum(len(brute.words(t)) for _, t in doc_rows)


def test_odd_rows(odd, odd_rows, none, brute):
    got = sorted((r.doc_id, r.n_tokens) for r in pl.pseudo_likelihood(odd).collect())
    assert got == sorted((r[0], len(brute.words(r[1]))) for r in odd_rows)
    scores = {r.doc_id: r for r in pl.pseudo_likelihood(odd).collect()}
    assert scores[1].log_likelihood == 0 and scores[1].mean_log_likelihood is None
    assert scores[5].log_likelihood < 0
    assert pl.pseudo_likelihood(none).collect() == []


def test_words_of_a_group_and_the_unseen_share_one():
    n = np.array([1, 1, 2, 40, 7])
    kinds, tokens = np.full(5, 5.0), np.full(5, n.sum())
    seen = np.exp(pl.within_group(n, np.full(5, 4), tokens, kinds)).sum()
    # 256 bytes and the end of the word: each length has 256^k words of 257^-(k+1)
    unseen = sum(256.0**k * np.exp(pl.within_group(np.zeros(1), np.array([k]), tokens[:1], kinds[:1])[0]) for k in range(100))
    whole = sum(256.0**k / 257.0 ** (k + 1) for k in range(100))
    assert abs(seen + unseen / whole - 1) < 1e-9
    assert pl.within_group(np.zeros(1), np.array([3]), np.zeros(1), np.zeros(1))[0] < 0  # a group without words


def test_groups_are_of_the_ending():
    got = pl.groups(["walking", "talking", "a", "", "ß", "über"])
    assert got[0] == got[1] and ((0 <= got) & (got < pl.GROUPS)).all()
    assert len(pl.groups([])) == 0


def test_gibberish_scores_below_prose(spark):
    rng = np.random.default_rng(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    junk = [(-k - 1, " ".join("".join(rng.choice(letters, rng.integers(3, 10))) for _ in range(80))) for k in range(30)]
    both = docs.union(spark.createDataFrame(junk, "doc_id bigint, text string"))
    scores = {r.doc_id: r.mean_log_likelihood for r in pl.pseudo_likelihood(both).where("n_tokens >= 50").collect()}
    prose = np.array([s for d, s in scores.items() if d >= 0])
    gibberish = np.array([scores[d] for d, _ in junk])
    assert gibberish.max() < np.quantile(prose, 0.1)
    # the same, of a model that has not seen the gibberish
    model = pl.train(pl.blocks(docs))
    unseen = [r.mean_log_likelihood for r in pl.score(pl.blocks(spark.createDataFrame(junk, "doc_id bigint, text string")), model).collect()]
    assert max(unseen) < np.quantile(prose, 0.1)


def test_every_token_is_trained_on_once(spark):
    offsets = np.array([0, 1, 1, 3, 40])
    for rounds in (1, pl.ROUNDS, 5):
        assert (sum(pl.masked(offsets, k, rounds).astype(int) for k in range(rounds)) == 1).all()
    # production rounds: the second word, at a place that a stride of 16 never came to, is learnt
    text = " ".join(f"{w} {'after' if w == 'one' else 'other'} x y z" for w in ("one", "two")) + " q" * 6
    docs = spark.createDataFrame([(k, text) for k in range(400)], "doc_id bigint, text string")
    docs = pl.blocks(docs)
    total = lambda m: pl.score(docs, m).agg({"log_likelihood": "sum"}).first()[0]
    before, after = total(pl.train(docs, rounds=0)), total(pl.train(docs))
    assert after > 0.6 * before
