"""Personal data: exact base patterns, and further spans by weakly supervised labelers.

The base kinds (email, ip, card, phone) are patterns with checks.  Further candidates, long keys
(``secret``), long numbers that are no card or phone (``number``) and addresses without a full domain
(``handle``), are voted on by labelers: a pattern, the layout of its characters, how far its letters
are from those of the corpus, a gazetteer of the corpus's own frequent words, the words before, and
what stands around.  Expectation-maximisation over the counts of vote patterns in the whole corpus
estimates how far each labeler can be trusted.  The posteriors then train the final span classifier, a
logistic regression that does not see the votes: it sees the span's characters and the words and
marks around it, by which it can overrule a labeler and learn words that no list names.  Spans it is
sure of are added.

Pairs of neighbouring bytes and frequent words are counted over all texts, vote patterns over all
candidates; each is a table of bounded size that partial aggregation makes.  Only the regression
is fitted on a sample: the ``FIT_ROWS`` candidates of a kind that come first by a hash.

Defined cases: a null or empty text has no spans; repeated rows each have theirs; an empty table
gives no rows; extra columns are ignored.  Spans are code points, the end exclusive.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import only, slices
from gleaner.llm.words import encoded_words, fingerprints
from gleaner.session import store

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("handle", "number", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does: one that starts inside fails or is longer.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KEY = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}")
#: Words that speak for a kind when they stand before, and known openings.
CUES = {
    "handle": ("mail", "contact", "write", "reply"),
    "number": ("card", "visa", "account", "phone", "tel", "call", "iban", "ssn"),
    "secret": ("token", "key", "secret", "password", "passwd", "api", "auth", "bearer"),
}
OPENINGS = {
    "handle": ("info", "admin", "support", "sales", "contact"),
    "number": ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65"),
    "secret": ("sk-", "pk-", "ghp_", "gho_", "AKIA", "xox", "eyJ"),
}
LABELERS = ("pattern", "layout", "surprise", "gazetteer", "context", "around")
SHAPES = 4
#: Words of the gazetteer, the most frequent of the corpus, and the least letters of one.
GAZETTEER, LETTERS = 50_000, 3
#: Bits a character beyond the corpus's own mean that speak for a made-up string, or against it.
STRANGE, USUAL = 1.5, 0.5
#: Candidates of a kind on which the final classifier is fitted.
FIT_ROWS = 20_000
#: The final classifier must give a span this probability.
SURE = 0.9
EM_ROUNDS, FIT_ROUNDS = 50, 30
#: Places of neighbouring words, each hashed into one of so many values.
HASHED = 64
MARKS = (" \t\r\n", "\"'`", "=", ":", "/\\\\", ".,;!?", "()[]{}<>", "@#&%+-_")
#: Number of values of each feature of a span; every feature takes one.
SIZES = {
    "length": 8, "digits": 5, "upper": 4, "lower": 4, "marks": 4, "distinct": 4, "changes": 4, "surprise": 8, "known": 4,
    "before": len(MARKS) + 2, "after": len(MARKS) + 2, "word": HASHED + 1, "word_before": HASHED + 1, "next_word": HASHED + 1,
}
STARTS = dict(zip(SIZES, np.cumsum([0, *SIZES.values()])[:-1].tolist(), strict=True))
WIDTH = sum(SIZES.values()) + 1  # and a constant


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """``(start, end, is_full)`` of addresses from left to right; those without a full domain too."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end(), True
            end = found.end()
        elif start < at:
            stop = at + 1
            while stop < len(text) and text[stop] in LOCAL:
                stop += 1
            if stop - at > 2:
                yield start, stop, False
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Spans of the base kinds, and candidates of the further kinds."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    more: list[tuple[str, int, int]] = []
    for start, end, full in emails(text):
        if full:
            spans["email"].append((start, end))
        else:
            more.append(("handle", start, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans["card"].append(m.span())
        elif 9 <= len(digits) <= 19:
            more.append(("number", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            spans["phone"].append(m.span())
    for m in KEY.finditer(text):
        if any("0" <= c <= "9" for c in m.group()):
            more.append(("secret", *m.span()))
    return spans, [c for c in more if not any(_overlaps(found, c) for found in spans.values())]


def _overlaps(spans: list[tuple[int, int]], case: tuple[str, int, int]) -> bool:
    """Whether one of ordered spans, of which none overlap, overlaps the case."""
    last = bisect.bisect_left(spans, (case[2], 0)) - 1
    return last >= 0 and spans[last][1] > case[1]


class Language(NamedTuple):
    """What the corpus's words look like: bits of each byte after another, their mean, and
    sorted fingerprints of the frequent words."""

    bits: np.ndarray
    mean: float
    known: np.ndarray

    def surprise(self, value: str) -> float:
        """Mean bits a character beyond those of the corpus."""
        raw = np.frombuffer(b" " + value.lower().encode(), np.uint8).astype(np.int64)
        return float(self.bits[raw[:-1] * 256 + raw[1:]].mean()) - self.mean

    def known_share(self, value: str) -> float:
        """Share of the value's characters that lie in frequent words."""
        words = re.findall(f"[a-z]{{{LETTERS},}}", value.lower())
        if not words or not len(self.known):
            return 0.0
        prints = fingerprints(words)
        at = np.minimum(np.searchsorted(self.known, prints), len(self.known) - 1)
        return sum(len(w) for w, k in zip(words, self.known[at] == prints, strict=True) if k) / len(value)


def _pairs(words: list[str], times: np.ndarray) -> np.ndarray:
    """Counts of each two bytes in a row in words, a space before each."""
    raw = b"".join(b" " + w.encode() for w in words)
    data = np.frombuffer(raw, np.uint8).astype(np.int64)
    owner = np.cumsum(data == 32) - 1
    codes = data[:-1] * 256 + data[1:]
    inside = owner[:-1] == owner[1:]
    return np.bincount(codes[inside], weights=times[owner[1:][inside]], minlength=1 << 16)


def language(docs: DataFrame, gazetteer: int = GAZETTEER) -> Language:
    """Byte pairs (``pair``) and words of letters (``word``) counted over all texts."""

    def rows(kind: str, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for begin in range(0, len(keys), 100_000):
            cut = slice(begin, begin + 100_000)
            part = [pa.array([kind] * len(keys[cut])), pa.array(keys[cut]), pa.array(counts[cut].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(part, names=["kind", "key", "n"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(1 << 16), {}
        for part in slices(batches, "text"):
            words, indices, _ = encoded_words(part.column(0))
            times = np.bincount(indices, minlength=len(words))
            for begin in range(0, len(words), 100_000):
                cut = slice(begin, begin + 100_000)
                pairs += _pairs(words[cut], times[cut])
            for word, n in zip(words, times.tolist(), strict=True):
                plain = word.strip(".,;:!?\"'()")
                if n and len(plain) >= LETTERS and plain.isascii() and plain.isalpha():
                    counts[plain] = counts.get(plain, 0) + n
            if len(counts) > 500_000:  # handed on, so that memory is bounded
                yield from rows("word", fingerprints(list(counts)).view(np.int64), np.array(list(counts.values())))
                counts = {}
        if counts:
            yield from rows("word", fingerprints(list(counts)).view(np.int64), np.array(list(counts.values())))
        seen = np.flatnonzero(pairs)
        yield from rows("pair", seen, pairs[seen])

    counted = only(docs, "text").mapInArrow(run, "kind string, key bigint, n bigint").groupBy("kind", "key")
    counted = store(counted.agg(F.sum("n").alias("n")), "language")
    pairs = np.zeros(1 << 16)
    for r in counted.where("kind = 'pair'").collect():  # 65,536 at most
        pairs[r["key"]] = r["n"]
    square = pairs.reshape(256, 256)
    single = (square.sum(0) + 1) / (pairs.sum() + 256)
    share = (square + 4 * single) / (square.sum(1, keepdims=True) + 4)
    bits = -np.log2(share).ravel()
    top = counted.where("kind = 'word'").orderBy(F.desc("n"), "key").limit(gazetteer).collect()
    known = np.sort(np.array([r["key"] for r in top], np.int64).view(np.uint64))
    return Language(bits, float(bits @ pairs / max(pairs.sum(), 1)), known)


def votes(text: str, kind: str, start: int, end: int, corpus: Language) -> tuple[list[int], int]:
    """Each labeler's vote (0 against, 1 none, 2 for) and the shape of the span."""
    value = text[start:end]
    before = text[max(0, start - 24) : start].lower()
    after = text[end : end + 2]
    digits = sum("0" <= c <= "9" for c in value)
    surprise, gazetteer = 1, 1
    if kind == "secret":
        hexlike = all(c in "0123456789abcdefABCDEF" for c in value)
        mixed = any(c.islower() for c in value) and any(c.isupper() for c in value)
        pattern = 2 if (hexlike and len(value) >= 32) or (mixed and digits > 2) else 0
        layout = 2 if 0.2 <= digits / len(value) <= 0.85 else 0
        beyond, known = corpus.surprise(value), corpus.known_share(value)
        surprise = 2 if beyond > STRANGE else 0 if beyond < USUAL else 1
        gazetteer = 0 if known >= 0.4 else 1
        around = 0 if before.endswith(("/", "=/", "www.")) or after.startswith("/") else 2 if before.endswith(('"', "'", "=", ":")) else 1
    elif kind == "number":
        clean = value.replace(" ", "").replace("-", "")
        pattern = 0 if len(clean) >= 13 else 1
        layout = 2 if re.fullmatch(r"[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}|[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}", value) else 0
        around = 0 if before.endswith((".", "/", "_", "=")) or after.startswith((".", "/")) else 1
    else:
        pattern = 2 if re.fullmatch(r"[A-Za-z][A-Za-z0-9._-]+@[A-Za-z0-9-]+", value) else 0
        layout = 0 if value.count("@") > 1 or value.endswith(("-", "%", "+")) else 1
        around = 0 if before.endswith(("/", "@")) or after.startswith(("(", "@")) else 1
    if value.startswith(OPENINGS[kind]):
        gazetteer = 2
    context = 2 if any(cue in before for cue in CUES[kind]) else 1 if kind == "secret" else 0
    return [pattern, layout, surprise, gazetteer, context, around], min(SHAPES - 1, (end - start) // 16)


def _mark(c: str) -> int:
    """The class of a neighbouring character: none, a mark of ``MARKS``, or another."""
    if not c:
        return 0
    return next((k for k, marks in enumerate(MARKS, 1) if c in marks), len(MARKS) + 1)


def _bucket(words: list[str], at: int) -> int:
    import xxhash

    try:
        return 1 + xxhash.xxh32_intdigest(words[at]) % HASHED
    except IndexError:
        return 0


def features(text: str, start: int, end: int, corpus: Language) -> list[int]:
    """Places of the values that a span's features take in a row of ``WIDTH`` zeros and ones."""
    value, n = text[start:end], end - start
    classes = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
    share = [classes.count(k) / n for k in range(4)]
    left = re.findall(r"[^\W\d_]{2,}", text[max(0, start - 48) : start].lower())
    right = re.findall(r"[^\W\d_]{2,}", text[end : end + 24].lower())
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n
    values = {
        "length": min(7, n // 8),
        "digits": int(share[0] * 4.999),
        "upper": int(share[1] * 3.999),
        "lower": int(share[2] * 3.999),
        "marks": min(3, int(share[3] * 20)),
        "distinct": int(len(set(value)) / n * 3.999),
        "changes": min(3, int(changes * 6)),
        "surprise": int(np.clip(corpus.surprise(value) + 3, 0, 7)),
        "known": int(corpus.known_share(value) * 3.999),
        "before": _mark(text[start - 1 : start] if start else ""),
        "after": _mark(text[end : end + 1]),
        "word": _bucket(left, -1),
        "word_before": _bucket(left, -2),
        "next_word": _bucket(right, 0),
    }
    return [STARTS[name] + v for name, v in values.items()] + [WIDTH - 1]


def _code(ballot: list[int], shape: int) -> int:
    code = shape
    for v in ballot:
        code = code * 3 + v
    return code


def _ballot(code: int) -> tuple[list[int], int]:
    out = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1], code


def reliabilities(ballots: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS):
    """Posterior of each ballot, P(vote | class) per labeler, and the prior, by EM."""
    n_labelers = ballots.shape[1]
    table = np.empty((2, n_labelers, 3))
    table[0], table[1] = [0.55, 0.3, 0.15], [0.15, 0.3, 0.55]
    prior, posterior = 0.5, None
    for _ in range(rounds):
        logs = np.array([
            np.log(p) + sum(np.log(table[c, k, ballots[:, k]]) for k in range(n_labelers))
            for c, p in ((0, 1 - prior), (1, prior))
        ])
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        for c, weight in ((0, counts * (1 - posterior)), (1, counts * posterior)):
            for k in range(n_labelers):
                tally = np.bincount(ballots[:, k], weights=weight, minlength=3)
                # a few votes as at the start keep a class without members from vanishing
                start = np.array([0.55, 0.3, 0.15] if c == 0 else [0.15, 0.3, 0.55]) * 10
                table[c, k] = (tally + start) / (tally + start).sum()
        prior = float(np.clip((counts @ posterior + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6))
    return posterior, table, prior


def _design(listed: list[list[int]]) -> np.ndarray:
    """A row of zeros and ones for each list of places."""
    x = np.zeros((len(listed), WIDTH))
    for row, places in zip(x, listed, strict=True):
        row[places] = 1
    return x


def fit_classifier(x: np.ndarray, posterior: np.ndarray, counts: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps, with a small ridge."""
    weight = counts / max(counts.sum(), 1)
    beta, ridge = np.zeros(x.shape[1]), 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (posterior - p)) - ridge * beta
        curve = (x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(beta))
        beta = beta + np.linalg.solve(curve, slope)
    return beta


def _found(docs: DataFrame, corpus: Language) -> DataFrame:
    """Per row: base spans as text and counts, candidates with codes of their votes and features."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(corpus))

    def run(batches):
        words = Language(*shared.value)
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                spans, more = base_spans(text or "")
                listed = [f"{k}:{a}:{b}" for k in BASE_KINDS for a, b in spans[k]]
                cases = [
                    {"kind": k, "start": a, "end": b, "code": _code(*votes(text, k, a, b, words)), "features": features(text, a, b, words)}
                    for k, a, b in more
                ]
                rows.append((doc_id, *[len(spans[k]) for k in BASE_KINDS], ",".join(listed), cases))
            columns = list(zip(*rows, strict=True))
            case = pa.struct([
                ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("code", pa.int32()), ("features", pa.list_(pa.int32()))
            ])
            kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(case)]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "cases"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    counts = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint"
    case = "struct<kind: string, start: bigint, end: bigint, code: int, features: array<int>>"
    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id bigint, {counts}, base string, cases array<{case}>")


class Model(NamedTuple):
    """The corpus's language and, for each further kind that has candidates, the classifier's weights."""

    corpus: Language
    weights: dict[str, np.ndarray]


def _fitted(found: DataFrame, fit_rows: int) -> dict[str, np.ndarray]:
    """Weights by kind: reliabilities from all candidates, the regression from ``fit_rows`` of a kind."""
    cases = found.select("doc_id", F.explode("cases").alias("c"))
    counted = cases.groupBy("c.kind", "c.code").agg(F.count(F.lit(1)).alias("n")).collect()  # a bounded number of codes
    weights = {}
    for kind in MORE_KINDS:
        table = sorted((r["code"], r["n"]) for r in counted if r["kind"] == kind)
        if not table:
            continue
        ballots = np.array([_ballot(c)[0] for c, _ in table])
        posterior, _, _ = reliabilities(ballots, np.array([n for _, n in table], dtype=float))
        of_code = {c: p for (c, _), p in zip(table, posterior, strict=True)}
        some = cases.where(F.col("c.kind") == kind).orderBy(F.xxhash64("doc_id", "c.start", "c.features"), "doc_id", "c").limit(fit_rows)
        rows = some.select("c.code", "c.features").collect()
        soft = np.array([of_code[r["code"]] for r in rows])
        weights[kind] = fit_classifier(_design([list(r["features"]) for r in rows]), soft, np.ones(len(rows)))
    return weights


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Everything learnt from ``docs``, to be applied to them or to other documents."""
    corpus = language(docs)
    return Model(corpus, _fitted(store(_found(docs, corpus), "candidates"), fit_rows))


def personal_data(docs: DataFrame, sure: float = SURE, model: Model | None = None) -> DataFrame:
    """Per row ``doc_id``, counts of the base kinds, ``base_sha256``, ``spans``, ``n_added`` and ``n_spans``.

    Without a ``model`` it is learnt from ``docs``.
    """
    corpus = model.corpus if model else language(docs)
    found = store(_found(docs, corpus), "spans")
    weights = model.weights if model else _fitted(found, FIT_ROWS)
    least = float(np.log(sure / (1 - sure)))
    added = F.slice("cases", 1, 0)
    if weights:
        table = {k: F.array(*[F.lit(float(x)) for x in w]) for k, w in weights.items()}

        def good(c):
            of_kind = None
            for kind, values in table.items():
                is_kind = c["kind"] == kind
                of_kind = F.when(is_kind, values) if of_kind is None else of_kind.when(is_kind, values)
            logit = F.aggregate(c["features"], F.lit(0.0), lambda total, f: total + F.get(of_kind, f))
            return F.coalesce(logit >= least, F.lit(False))

        added = F.filter("cases", good)
    added = F.array_sort(F.transform(added, lambda c: F.struct(c["kind"], c["start"], c["end"])))
    found = found.withColumn("added", added)
    texts = F.transform("added", lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string")))
    base = F.when(F.col("base") != "", F.array("base")).otherwise(F.slice(F.array("base"), 1, 0))
    n_added = F.size("added").cast("bigint")
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2("base", 256).alias("base_sha256"),
        F.array_join(F.concat(base, texts), ",").alias("spans"),
        n_added.alias("n_added"),
        (F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + n_added).alias("n_spans"),
    )
