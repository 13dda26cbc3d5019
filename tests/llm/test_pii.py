import hashlib
import re
from collections import Counter

import numpy as np

from gleaner.llm import pii

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base(text):
    spans, counts = [], []
    for kind, pattern in PATTERNS:
        n = 0
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1]))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append(f"{kind}:{m.start()}:{m.end()}")
            n += 1
        counts.append(n)
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest()), ",".join(spans)


HARD = [
    "a@b@c.d.e x@y.z@q.r.s .@a.b -@-.- %@%.com a@b a@.b a@b..c ü@b.de aü.x@b.de@",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 01.002.0003.255 1.2.3 12345678.1.2.3 1..2.3.4",
    "4111 1111 1111 1111-4111-1111-1111-1111 4111111111111111 0000000000000 1 2 3  4 5 41111111111111112",
    "+1 (555) 123-4567 +12 ++123456789 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +1.....2 +49-89-1234567+49 89 1234567",
    "٣@x.com 1٣.2.3.4 +٣123456789",
    "@" * 50 + "1" * 5000 + "." * 50 + "a@" * 200 + "+1(" * 100,
]


def rows_of(df):
    return Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in df.collect())


def test_base_spans_of_hard_texts():
    for text in HARD:
        spans, _ = pii.base_spans(text)
        listed = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in spans[k])
        assert listed == base(text)[1]


def test_equals_brute_force(docs, doc_rows):
    found = pii.personal_data(docs)
    assert rows_of(found) == Counter((d, *base(t)[0]) for d, t in doc_rows)
    texts = dict(doc_rows)
    for r in found.collect():
        assert r.spans.startswith(base(texts[r.doc_id])[1])


def test_odd_rows(odd, odd_rows, none):
    assert rows_of(pii.personal_data(odd)) == Counter((r[0], *base(r[1])[0]) for r in odd_rows)
    assert pii.personal_data(none).collect() == []


def test_adds_secrets_and_leaves_prose_alone(spark):
    keys = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(60)]
    rows = [(k, f'und so weiter token = "{key}" heron') for k, key in enumerate(keys)]
    rows += [(100 + k, f"see http://x.org/a/{key}/b for more") for k, key in enumerate(keys[:20])]
    rows += [(200, "a-very-long-word-with-dashes-2024 and plain prose without anything")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[k] == f"secret:{rows[k][1].index(keys[k])}:{rows[k][1].index(keys[k]) + 40}" for k in range(60))
    assert got[200] == ""


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    right = [0.9, 0.8, 0.85, 0.7, 0.75]
    ballots = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) * 2 for r in right], axis=1)
    unique, where, counts = np.unique(ballots, axis=0, return_inverse=True, return_counts=True)
    posterior, table, prior = pii.reliabilities(unique.astype(int), counts.astype(float))
    assert abs(prior - 0.3) < 0.03
    assert np.abs(table[1][:, 2] - right).max() < 0.04
    guess = posterior[where.ravel()] > 0.5
    majority = (ballots > 0).sum(1) >= 3
    assert (guess == truth).mean() > (majority == truth).mean()
    x = np.column_stack((unique - 1.0, np.ones(len(unique))))
    p = 1 / (1 + np.exp(-x @ pii.fit_classifier(x, posterior, counts.astype(float))))
    assert ((p > 0.5)[where.ravel()] == truth).mean() > 0.93


def planted(rng, n, first):
    """Texts, each with a span, and whether it is a secret: cues of no list, and things that look alike."""
    made = []
    words = "river stone garden window market letter summer silver bridge forest".split()
    for k in range(n):
        key = hashlib.sha1(f"{first}{k}".encode()).hexdigest()
        mixed = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 36))
        name = "-".join(rng.choice(words, 4)) + f"-{rng.integers(100)}"
        prose = " ".join(rng.choice(words, 30))
        for found, text in ((key, f"kennung: {key} ok"), (mixed, f"set the token = '{mixed}' now"), (None, f"see /wiki/{name}/ there"), (None, f"page {name} here")):
            made.append((first + len(made), f"{prose} {text} {prose}", found))
    return made


def test_held_out_secrets(spark):
    rng = np.random.default_rng(7)
    seen, held = planted(rng, 60, 0), planted(rng, 40, 10_000)
    frame = lambda rows: spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(held), model=pii.learn(frame(seen))).collect()}
    want = {d: f"secret:{t.index(v)}:{t.index(v) + len(v)}" if v else "" for d, t, v in held}
    caught = np.mean([got[d] == s for d, s in want.items() if s])
    false = np.mean([got[d] != "" for d, s in want.items() if not s])
    assert caught >= 0.95 and false <= 0.02, (caught, false)


def test_language_counts_every_text(spark):
    rows = [(1, "Stone stone, zebra"), (2, None), (3, "stone"), (4, "")]
    corpus = pii.language(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert corpus.known_share("stone-zebra") == 10 / 11 and corpus.known_share("9x") == 0
    assert corpus.surprise("stone") < corpus.surprise("q7x9z")
    assert pii._pairs(["ab", "b"], np.array([3, 2]))[[32 * 256 + 97, 97 * 256 + 98, 32 * 256 + 98, 98 * 256 + 32]].tolist() == [3, 3, 2, 0]
