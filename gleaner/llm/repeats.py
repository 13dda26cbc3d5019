"""Repeated byte strings: prefix-free parsing of texts, and suffix arrays of the dictionary.

Every byte covered by a ``SPAN``-byte string that also starts anywhere else goes.  A rolling hash
of ``GRAM`` bytes runs over each text.  The least hash among the grams of a ``SPAN``-byte string
is its trigger; equal strings have equal triggers at equal places.  Triggers cut a text into
phrases: a phrase is the bytes of all strings that one trigger answers for.  The parse of the
corpus, which phrase starts where, is small; triggers that come once drop out by counting it.
Phrases of the rest form the dictionary, each distinct one once, dealt out by trigger.

In a task the suffixes of the dictionary are ordered alphabetically by prefix doubling up to
``SPAN`` bytes: a rank for each place by 8 bytes, from it one by 16, and so on.  Suffixes of one rank
start equal strings.  The parse, ordered by phrase, gives each phrase its number of occurrences
and combines both: strings of a phrase that comes twice are repeated, strings of one that comes once
are if their rank is shared; joining by phrase carries this to every place in the corpus.

A trigger with very many distinct phrases (the edge of a passage that a large part of all
documents share) gets longer: its phrases are cut into pieces of fewer strings, and the bytes that all
strings of a piece have in common become the new trigger.  The pieces are then parsed into a
dictionary of their own, and so on, down to pieces of one string.

Defined cases: a null text is empty; texts shorter than ``SPAN`` bytes keep everything; repeated
rows are occurrences of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import only, slices
from gleaner.llm.words import mix64
from gleaner.operators.joins import join_list
from gleaner.session import store

SPAN, GRAM = 400, 128
BASE = 0x9E3779B97F4A7C15
#: Bytes of text worked on at once; a longer text is worked in overlapping parts.
PART_BYTES = 1 << 19
#: Bytes of distinct phrases that a task orders at once, whole triggers at a time; phrases of
#: which a task remembers that it has handed on the bytes.
HELD_BYTES, REMEMBERED = 1 << 20, 200_000
#: Distinct phrases of one trigger beyond which the trigger gets longer, and strings of the
#: pieces that its phrases are then cut into, one step after another.
MANY = 4_000
STRINGS = (64, 8, 1)
#: Places beyond which a phrase is looked up in a list of such phrases, not joined by a shuffle that
#: would bring all of them to one task.
FREQUENT = 10_000
PHRASE = ["trigger", "c1", "c2"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def rolling(data: np.ndarray, width: int, powers) -> np.ndarray:
    """A 64-bit hash of each ``width``-byte string of ``data``."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0][: len(data)], out=sums[1:])
    return mix64((sums[width:] - sums[:n]) * powers[1][:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` values in a row."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    square = padded.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def triggers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers, span: int, gram: int):
    """``text, first, last, trigger, hash`` per phrase of the texts ``data[starts[k] : ends[k]]``.

    ``first`` to ``last`` are the starts of the strings the trigger answers for.
    """
    width = span - gram + 1
    hashes = rolling(data, gram, powers)
    if len(hashes) < width:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    low = np.uint64(24)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min((hashes >> low) << low | place, width)
    owner = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    count = np.maximum(ends - starts - span + 1, 0)
    text = np.repeat(np.arange(len(starts)), count)
    begin = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + starts[text]
    owned = owner[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (owned[1:] != owned[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(begin)])) - 1 if len(at) else at
    return text[at], begin[at], begin[last], owned[at], hashes[owned[at]]


def _parse_batch(texts: list[bytes], powers, span: int, gram: int):
    """Per text: lists of first, last, trigger (places in the text) and hash."""
    found = [[[], [], [], []] for _ in texts]
    pieces, used = [], 0
    for k, raw in enumerate(texts):
        step = PART_BYTES
        for base in range(0, max(1, len(raw) - span + 1), step):
            piece = raw[base : base + step + span - 1]
            if pieces and used + len(piece) > PART_BYTES + span:
                _flush(pieces, found, powers, span, gram)
                pieces, used = [], 0
            pieces.append((k, base, piece))
            used += len(piece)
    _flush(pieces, found, powers, span, gram)
    return found


def _flush(pieces, found, powers, span, gram):
    if not pieces:
        return
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    ends = np.cumsum([len(p) for _, _, p in pieces])
    starts = ends - [len(p) for _, _, p in pieces]
    text, first, last, at, hashes = triggers(data, starts, ends, powers, span, gram)
    cuts = np.searchsorted(text, np.arange(len(pieces) + 1))
    for j, (k, base, _) in enumerate(pieces):
        part = slice(cuts[j], cuts[j + 1])
        shift = base - starts[j]
        for out, values in zip(found[k], (first + shift, last + shift, at + shift), strict=False):
            out.append(values[part])
        found[k][3].append(hashes[part].view(np.int64))


def _lists(columns: list[list[np.ndarray]], kind) -> pa.ListArray:
    joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    offsets = np.concatenate(([0], np.cumsum([len(c) for c in joined])))
    values = np.concatenate(joined) if joined else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(kind))


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and two hashes of the text that stand for it."""
    text = F.coalesce("text", F.lit(""))
    second = F.xxhash64(F.lit("b"), text, F.length(text))
    return only(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), second.alias("t2"))


def parse(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``t1, t2`` and the phrases of each text as lists ``first, last, at, hash``."""

    def run(batches):
        powers = _powers(PART_BYTES + 2 * span)
        for part in slices(batches, "text", 2 << 20):
            texts = [t.encode() for t in part.column(1).to_pylist()]
            found = _parse_batch(texts, powers, span, gram)
            lists = [_lists([f[i] for f in found], pa.int64() if i == 3 else pa.int32()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [part.column(2), part.column(3), part.column(0), *lists],
                names=["t1", "t2", "doc_id", "first", "last", "at", "hash"],
            )

    lists = "first array<int>, last array<int>, at array<int>, hash array<bigint>"
    long_enough = docs.where(F.octet_length("text") >= span)
    return long_enough.mapInArrow(run, f"t1 bigint, t2 bigint, doc_id bigint, {lists}")


def _digest(phrase: bytes, lead: int) -> tuple[int, int]:
    import xxhash

    digest = xxhash.xxh3_128_intdigest(phrase, seed=lead)
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


#: A place of a phrase: what holds it, where it starts there, its trigger, digest and length, the
#: trigger's place in it; and its bytes, once a task and phrase.
PLACE = "o1 bigint, o2 bigint, o3 bigint, first int, trigger bigint, c1 bigint, c2 bigint, size int, lead int, phrase binary"
PLACE_KINDS = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]


def _places(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(PLACE_KINDS)
    names = [c.split()[0] for c in PLACE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, PLACE_KINDS, strict=True)], names=names)


def _phrases(texts: DataFrame, span: int) -> DataFrame:
    """Places of the phrases of ``t1, t2, text, marks``, held by texts."""

    def run(batches):
        seen: set[tuple] = set()
        for part in slices(batches, "text", 2 << 20):
            rows = []
            for t1, t2, text, marks in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                for m in marks:
                    first, last, lead = m["first"], m["last"], m["at"] - m["first"]
                    phrase = raw[first : last + span]
                    known = (m["hash"], *_digest(phrase, lead))
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    rows.append((t1, t2, 0, first, *known, len(phrase), lead, None if known in seen else phrase))
                    seen.add(known)
            yield _places(rows)

    return texts.select("t1", "t2", "text", "marks").mapInArrow(run, PLACE)


def _pieces(phrases: DataFrame, span: int, strings: int) -> DataFrame:
    """Places of pieces of at most ``strings`` strings, held by the distinct ``phrases``."""

    def cut(trigger: int, c1: int, c2: int, lead: int, phrase: bytes):
        import xxhash

        start, count = 0, len(phrase) - span + 1
        while start < count:
            block = (lead - start) // strings  # strings lie in it by their distance from the trigger
            end = min(count, lead - block * strings + 1)
            piece = phrase[start : end - 1 + span]
            common = phrase[lead - block * strings : lead - (block + 1) * strings + 1 + span]
            longer = xxhash.xxh3_64_intdigest(b"%d %d " % (trigger, block) + common) - (1 << 63)
            yield trigger, c1, c2, start, longer, *_digest(piece, lead - start), len(piece), lead - start, piece
            start = end

    def run(batches):
        for part in slices(batches, "phrase", 1 << 20):
            yield _places([p for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for p in cut(*row)])

    return phrases.select(*PHRASE, "lead", "phrase").mapInArrow(run, PLACE)


def suffix_ranks(data: np.ndarray, span: int) -> np.ndarray:
    """Alphabetical rank of each place of ``data`` by the ``span`` bytes from there; equal strings
    have equal ranks.  Beyond the end come zeros."""
    size = len(data)

    def ranked(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ordered = keys[order]
        ranks = np.empty(size, np.int64)
        ranks[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        return ranks

    def with_later(ranks: np.ndarray, step: int) -> np.ndarray:
        later = np.zeros(size, np.int64)
        later[: max(size - step, 0)] = ranks[step:] + 1
        return ranked(ranks * (size + 1) + later)

    if not size:
        return np.zeros(0, np.int64)
    width = min(8, span)
    padded = np.concatenate((data, np.zeros(width, np.uint8))).astype(np.uint64)
    keys = np.zeros(size, np.uint64)
    for k in range(width):
        keys = keys << np.uint64(8) | padded[k : k + size]
    ranks = ranked(keys)
    while 2 * width <= span:
        ranks = with_later(ranks, width)
        width *= 2
    return with_later(ranks, span - width) if width < span else ranks


class _Dictionary:
    """Distinct phrases of one or more triggers in a task."""

    def __init__(self, span: int):
        self.span, self.phrases, self.bytes = span, {}, 0

    def add(self, key: tuple, phrase: bytes) -> None:
        if key not in self.phrases:
            self.phrases[key] = phrase
            self.bytes += len(phrase)

    def repeats(self):
        """Phrases and the runs of bytes in them that strings of other phrases cover."""
        keys = list(self.phrases)
        if not keys:
            return
        data = np.frombuffer(b"".join(self.phrases.values()), np.uint8)
        sizes = np.array([len(self.phrases[k]) for k in keys])
        base = np.cumsum(sizes) - sizes
        counts = sizes - self.span + 1
        owner = np.repeat(np.arange(len(keys)), counts)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + base[owner]
        ranks = suffix_ranks(data, self.span)[begin]
        twice = np.bincount(ranks)[ranks] > 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], np.where(twice, owner + 1, 0), [0]))))
        found: dict[tuple, list] = {}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if twice[a]:
                k = owner[a]
                run = {"start": int(begin[a] - base[k]), "end": int(begin[b - 1] - base[k]) + self.span}
                found.setdefault(keys[k], []).append(run)
        yield from found.items()


RUNS = "array<struct<start: int, end: int>>"


def _ordered(dictionary: DataFrame, span: int) -> DataFrame:
    """``trigger, c1, c2, runs`` of phrases that share strings, each trigger's in one task."""

    def run(batches):
        held, current = _Dictionary(span), None

        def flushed():
            found = [(*key, runs) for key, runs in held.repeats()]
            columns = list(zip(*found, strict=True)) or [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*PHRASE, "runs"])

        for part in slices(batches, "phrase", 2 << 20):
            for *key, phrase in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if key[0] != current and held.bytes > HELD_BYTES:
                    yield flushed()
                    held = _Dictionary(span)
                current = key[0]
                held.add(tuple(key), phrase)
        yield flushed()

    dealt = dictionary.select(*PHRASE, "phrase").repartition("trigger").sortWithinPartitions("trigger")
    return dealt.mapInArrow(run, f"trigger bigint, c1 bigint, c2 bigint, runs {RUNS}")


def _with_whole(parse: DataFrame, weights: DataFrame, known: DataFrame, frequent: int) -> DataFrame:
    """Places with the ``runs`` of their phrase; those of frequent phrases are covered whole."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("end"))).alias("runs")
    often = store(weights.where(F.col("n") > frequent).select(*PHRASE), "frequent")
    if often.isEmpty():
        return parse.join(known, PHRASE).select("o1", "o2", "o3", "first", "runs")
    others = join_list(parse, often, PHRASE, "left_anti").join(known.where(F.col("n") <= frequent), PHRASE)
    always = join_list(parse, often, PHRASE, "left_semi").select("o1", "o2", "o3", "first", whole)
    return others.select("o1", "o2", "o3", "first", "runs").unionByName(always)


def _resolve(
    places: DataFrame, span: int, many: int, strings: tuple[int, ...] = STRINGS, frequent: int = FREQUENT
) -> DataFrame:
    """``o1, o2, o3, start, end``: covered runs of bytes in what holds the stored ``places``."""
    parse = places.drop("phrase", "lead")
    weights = store(parse.groupBy(*PHRASE).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")), "weights")
    shared = store(weights.groupBy("trigger").agg(F.count(F.lit(1)).alias("phrases")).where("phrases > 1"), "shared")
    dictionary = places.where("phrase IS NOT NULL").select(*PHRASE, "lead", "phrase")
    longer = shared.where(F.col("phrases") > many) if strings else shared.where("1 = 0")
    plain = shared.where(F.col("phrases") <= many) if strings else shared
    runs = _ordered(join_list(dictionary, plain.select("trigger"), ["trigger"], "left_semi"), span)
    if not longer.isEmpty():
        hot = join_list(dictionary, longer.select("trigger"), ["trigger"], "left_semi").dropDuplicates(PHRASE)
        pieces = store(_pieces(hot, span, strings[0]), "pieces")
        of_pieces = _resolve(pieces, span, many, strings[1:], frequent).groupBy(*[F.col(o).alias(k) for o, k in zip(("o1", "o2", "o3"), PHRASE, strict=True)])
        runs = runs.unionByName(of_pieces.agg(F.collect_list(F.struct("start", "end")).alias("runs")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("end")))
    known = weights.join(runs, PHRASE, "left").where("n > 1 OR runs IS NOT NULL")
    known = known.select(*PHRASE, "n", F.when(F.col("n") > 1, whole).otherwise(F.col("runs")).alias("runs"))
    found = _with_whole(parse, weights, known, frequent).withColumn("run", F.explode("runs"))
    return found.select("o1", "o2", "o3", *[(F.col("first") + F.col(f"run.{c}")).alias(c) for c in ("start", "end")])


def covered(docs: DataFrame, span: int = SPAN, gram: int = GRAM, many: int = MANY, frequent: int = FREQUENT) -> DataFrame:
    """``t1, t2, copies, runs`` of texts of which something is removed; ``runs`` may overlap.

    Texts that come more than once go whole; one of them stands for all in the search.
    """
    keyed = _keyed(docs)
    parsed = store(parse(keyed, span, gram), "parse")
    texts = parsed.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"))
    texts = store(texts, "texts")
    first = texts.select("t1", "t2", F.struct("doc_id").alias("_first"))
    mark = F.arrays_zip("first", "last", "at", "hash")
    marks = parsed.withColumn("_first", F.struct("doc_id")).join(first, ["t1", "t2", "_first"], "left_semi")
    marks = marks.select("t1", "t2", "doc_id", F.explode(mark).alias("mark"))
    often = marks.groupBy(F.col("mark.hash").alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    often = store(often.where("n > 1"), "often")
    kept = marks.withColumn("hash", F.col("mark.hash")).join(often.select("hash"), "hash")
    listed = kept.groupBy("t1", "t2", "doc_id").agg(F.collect_list("mark").alias("marks"))
    at = F.struct("t1", "t2", "doc_id").alias("_at")
    listed = listed.select(at, "marks").hint("shuffle_hash")
    candidates = keyed.where(F.octet_length("text") >= span).select(at, "t1", "t2", "text").join(listed, "_at")
    runs = _resolve(store(_phrases(candidates, span), "phrases"), span, many, frequent=frequent)
    runs = runs.withColumnsRenamed({"o1": "t1", "o2": "t2"})
    runs = runs.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    every = texts.join(runs, ["t1", "t2"], "left").where("copies > 1 OR runs IS NOT NULL")
    return every.select("t1", "t2", "copies", "runs")


def _merged(runs) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((r["start"], r["end"]) for r in runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, many: int = MANY, frequent: int = FREQUENT) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that stay)."""
    found = store(covered(docs, span, gram, many, frequent), "covered")
    at = F.struct("t1", "t2").alias("_at")
    joined = join_list(_keyed(docs).select("doc_id", "text", at), found.select(at, "copies", "runs"), ["_at"], "left")

    def run(batches):
        for part in slices(batches, "text"):
            rows = []
            for doc_id, text, copies, runs in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                spans = [(0, len(raw))] if (copies or 0) > 1 else _merged(runs or ())
                kept, at = [], 0
                for start, end in spans:
                    kept.append(raw[at:start])
                    at = end
                rest = b"".join([*kept, raw[at:]])
                rows.append((doc_id, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return joined.select("doc_id", "text", "copies", "runs").mapInArrow(run, schema)
