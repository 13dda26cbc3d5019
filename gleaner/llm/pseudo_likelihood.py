"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, scores documents.

Each token is predicted from the ``REACH`` tokens on either side: a table per relative
position, summed and squashed, then a softmax over classes of ids and one over the ids of the class.
The ``FREQUENT`` most frequent words of the corpus have an id each; every other word is predicted as one
of ``GROUPS`` groups by its ending, and then as the word it is by its count within the group.  The
counts are those of all words of the corpus, so they grow with it.  The score of a document is the sum of
the log-probabilities of its tokens.  Of the count of each word ``DISCOUNT`` is set aside for words that the corpus
does not hold; these share it by their length, each byte as likely as any other.

Texts are taken apart once, into stored blocks of about a megabyte: the distinct words of the block, and which of them
each token is.  All later passes read these.  Training masks every token of every
document once, a part of them each round: a task runs through its part of the corpus from the round's
parameters, and the changes are averaged by tokens, in two levels of sums, before the next round.  Only
parameters, whose number is fixed, reach the driver, and the counts of up to ``COMMON`` words, the most frequent of all,
which go to every task; the counts of all others are joined to the words of each block by a shuffle.

Defined cases: a null or empty text has no tokens, a score of 0 and no mean; a token outside
the text is a mark of its own; repeated rows train and score as often as they come; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import only, slices
from gleaner.llm.words import encoded_words, fingerprints
from gleaner.session import store

CLASSES, PER_CLASS = 32, 64
VOCABULARY = CLASSES * PER_CLASS
GROUP_CLASSES = 16  # by the last byte of a word; within one by the last three
FREQUENT, GROUPS = (CLASSES - GROUP_CLASSES) * PER_CLASS, GROUP_CLASSES * PER_CLASS
DISCOUNT = 0.5
COMMON = 4_000_000  # so many counts at most are broadcast, 12 bytes each; those of rarer words are joined
WIDTH, REACH = 32, 3
ROUNDS, BATCH, RATE, SEED = 3, 2048, 0.1, 11
BLOCKS = 8
BLOCK_BYTES = 1 << 20
CHUNK = 1 << 12
HELD_WORDS = 1 << 20  # words of several blocks whose counts a task sums before it hands them on
OFTEN = 12  # rows of the tables that come more often in a batch are summed one by one
OFFSETS = [k for k in range(-REACH, REACH + 1) if k]


def shapes(width: int = WIDTH) -> dict[str, tuple[int, ...]]:
    return {
        "tables": (len(OFFSETS), VOCABULARY + 1, width),
        "bias": (width,),
        "class_out": (width, CLASSES),
        "class_bias": (CLASSES,),
        "word_out": (CLASSES, width, PER_CLASS),
        "word_bias": (CLASSES, PER_CLASS),
    }


def start(counts: np.ndarray, seed: int = SEED, width: int = WIDTH) -> dict[str, np.ndarray]:
    """Small random tables, and biases at the frequencies of the words."""
    rng = np.random.default_rng(seed)
    net = {k: (rng.standard_normal(s) * 0.05).astype(np.float32) for k, s in shapes(width).items()}
    share = (counts + 1.0).reshape(CLASSES, PER_CLASS)
    net["bias"][:] = 0
    net["class_bias"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
    net["word_bias"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return net


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in shapes(len(net["bias"]))])


def unflat(vector: np.ndarray, width: int = WIDTH) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(width).items():
        size = int(np.prod(shape))
        out[name] = vector[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of rows in place, and the sum of each; rows are shifted by their greatest value only where a value
    could leave the range of numbers."""
    shift = None
    if x.size and not -50 < x.min() <= x.max() < 50:
        shift = x.max(axis=1, keepdims=True)
        x -= shift
    np.exp(x, out=x)
    sums = x @ np.ones(x.shape[1], x.dtype)
    return sums, np.zeros(1) if shift is None else shift[:, 0].astype(np.float64)


def _chosen_log_softmax(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log-probability of the chosen value of each row; ``x`` is overwritten."""
    found = x[np.arange(len(x)), chosen].astype(np.float64)
    sums, shift = _exp(x)
    return found - shift - np.log(sums, dtype=np.float64)


def _minus_softmax(x: np.ndarray, share: float = 1.0) -> np.ndarray:
    """Minus the softmax of rows in place, times ``share``."""
    x *= (-share / _exp(x)[0])[:, None]
    return x


def _hidden(net, context: np.ndarray) -> np.ndarray:
    hidden = net["tables"][0].take(context[:, 0], axis=0)
    for k in range(1, len(OFFSETS)):
        hidden += net["tables"][k].take(context[:, k], axis=0)
    hidden += net["bias"]
    return np.tanh(hidden, out=hidden)


def _by_class(targets: np.ndarray):
    """Rows ordered by class, with the class and slice of each run."""
    klass = (targets // PER_CLASS).astype(np.int16)  # 16 bits: a radix sort
    order = np.argsort(klass, kind="stable")
    cuts = np.searchsorted(klass[order], np.arange(CLASSES + 1))
    return order, [(c, slice(cuts[c], cuts[c + 1])) for c in range(CLASSES) if cuts[c] < cuts[c + 1]]


def _in_class(net, hidden: np.ndarray, runs) -> np.ndarray:
    """For rows ordered by class: the logits of the ids of each row's class."""
    out = np.empty((len(hidden), PER_CLASS), hidden.dtype)
    for c, run in runs:
        np.matmul(hidden[run], net["word_out"][c], out=out[run])
    out += net["word_bias"].take([c for c, _ in runs], axis=0).repeat([run.stop - run.start for _, run in runs], axis=0)
    return out


def log_probabilities(net, context: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Log-probability of each target; a row of ``context`` holds the ids at ``OFFSETS``."""
    order, runs = _by_class(targets)
    context, targets = context.take(order, axis=0), targets.take(order)
    hidden = _hidden(net, context)
    out = np.empty(len(targets))
    classes = hidden @ net["class_out"]
    classes += net["class_bias"]
    out[order] = _chosen_log_softmax(classes, targets // PER_CLASS) + _chosen_log_softmax(_in_class(net, hidden, runs), targets % PER_CLASS)
    return out


def _table_gradients(context: np.ndarray, d_hidden: np.ndarray):
    """Sums of ``d_hidden`` by the rows of all tables in a row that ``context`` names; these rows, frequent ones first."""
    n = len(context)
    # all positions in one sort, 16 bits: a radix sort
    keys = (context.T.astype(np.int16) + np.arange(len(OFFSETS), dtype=np.int16)[:, None] * np.int16(VOCABULARY + 1)).ravel()
    by_id = np.argsort(keys, kind="stable")
    ids, source = keys.take(by_id), np.tile(np.arange(n), len(OFFSETS)).take(by_id)
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    times = np.diff(np.append(starts, len(ids)))
    ranked = np.argsort(-np.minimum(times, OFTEN + 1).astype(np.int8), kind="stable")
    starts, times = starts[ranked], times[ranked]
    out = np.empty((len(starts), d_hidden.shape[1]), d_hidden.dtype)
    # those that come often are summed run by run; of the others the first of all, then the second of all, and so on
    often, *more = np.searchsorted(-np.minimum(times, OFTEN + 1), -np.arange(OFTEN, 0, -1))
    if often:
        ends = np.cumsum(times[:often])
        begins = ends - times[:often]
        at = np.repeat(starts[:often] - begins, times[:often]) + np.arange(ends[-1])
        np.add.reduceat(d_hidden.take(source[at], axis=0), begins, axis=0, out=out[:often])
    out[often:] = d_hidden.take(source[starts[often:]], axis=0)
    for k, upto in enumerate(reversed(more), 1):
        out[often:upto] += d_hidden.take(source[starts[often:upto] + k], axis=0)
    return ids[starts].astype(np.int64), out


def gradients(net, context: np.ndarray, targets: np.ndarray):
    """Gradients of the mean log-probability; those of the tables as (places, rows) of all tables in a row."""
    n = len(targets)
    order, runs = _by_class(targets)
    context, targets = context.take(order, axis=0), targets.take(order)
    hidden = _hidden(net, context)
    d_class = hidden @ net["class_out"]
    d_class += net["class_bias"]
    d_class = _minus_softmax(d_class, 1 / n)
    rows = np.arange(n)
    d_class[rows, targets // PER_CLASS] += 1 / n
    d_word = _minus_softmax(_in_class(net, hidden, runs), 1 / n)
    d_word[rows, targets % PER_CLASS] += 1 / n
    ones = np.ones(n, d_word.dtype)
    out = {"class_out": hidden.T @ d_class, "class_bias": ones @ d_class}
    out["word_out"] = np.zeros_like(net["word_out"])
    out["word_bias"] = np.zeros_like(net["word_bias"])
    d_hidden = np.empty_like(hidden)
    for c, run in runs:
        np.matmul(d_word[run], net["word_out"][c].T, out=d_hidden[run])
        np.matmul(hidden[run].T, d_word[run], out=out["word_out"][c])
        np.matmul(ones[run], d_word[run], out=out["word_bias"][c])
    d_hidden += d_class @ net["class_out"].T
    hidden *= hidden
    hidden *= d_hidden
    d_hidden -= hidden
    out["bias"] = ones @ d_hidden
    return out, _table_gradients(context, d_hidden)


class Trainer:
    """Ascent with a rate per parameter (Adagrad) over batches of masked tokens."""

    def __init__(self, net, rate: float = RATE):
        self.net, self.rate = {k: v.copy() for k, v in net.items()}, rate
        self.seen = {k: np.full(v.shape, 1e-4, np.float32) for k, v in net.items()}
        self.tokens = 0

    def step(self, context: np.ndarray, targets: np.ndarray) -> None:
        dense, (places, g) = gradients(self.net, context, targets)
        for name, d in dense.items():
            now = d * d
            self.seen[name] += now
            np.sqrt(self.seen[name], out=now)
            np.divide(d, now, out=now)
            now *= self.rate
            self.net[name] += now
        width = len(self.net["bias"])
        seen, tables = self.seen["tables"].reshape(-1, width), self.net["tables"].reshape(-1, width)
        now = seen.take(places, axis=0)
        now += g * g
        seen[places] = now
        np.sqrt(now, out=now)
        np.divide(g, now, out=now)
        now *= self.rate
        now += tables.take(places, axis=0)
        tables[places] = now
        self.tokens += len(targets)


def endings(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The group of each word, by its last bytes, and its length in bytes."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    array = pa.array(words, pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(words) + 1)
    data = np.frombuffer(array.buffers()[2] or b"\0", np.uint8)
    ends, sizes = offsets[1:], np.diff(offsets)
    last = [np.where(sizes >= k, data[np.clip(ends - k, 0, len(data) - 1)], 0).astype(np.int64) for k in (1, 2, 3)]
    return last[0] * 7 % GROUP_CLASSES * PER_CLASS + (last[0] * 31 + last[1] * 17 + last[2]) % PER_CLASS, sizes


def groups(words: list[str]) -> np.ndarray:
    return endings(words)[0]


BLOCK_SCHEMA = (
    "block bigint, doc_ids array<bigint>, sizes array<int>, tokens binary, "
    "words array<bigint>, times array<int>, groups binary, bytes binary"
)


def _lists(values: np.ndarray, kind) -> pa.Array:
    """A list array with one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def blocks(docs: DataFrame) -> DataFrame:
    """Texts as stored blocks: the size of each document, which of the block's ``words`` (64-bit fingerprints, sorted) each token
    is, and how often each word comes, its group and its length."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for part in slices(batches, "text", BLOCK_BYTES):
            distinct, indices, offsets = encoded_words(part.column(1))
            times = np.bincount(indices, minlength=len(distinct))
            used = np.flatnonzero(times)
            words = distinct if len(used) == len(distinct) else [distinct[k] for k in used.tolist()]
            prints = fingerprints(words).view(np.int64)
            grouped, lengths = endings(words)
            order = np.argsort(prints)  # sorted words are looked up in sorted lists several times as fast
            kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
            place = np.zeros(len(distinct), kind)
            place[used[order]] = np.arange(len(words))
            tokens = place[indices] if len(indices) else np.zeros(0, kind)
            doc_ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0).cast(pa.int64()))
            columns = [
                pa.array([number]), doc_ids, _lists(np.diff(offsets), pa.int32()), pa.array([tokens.tobytes()], pa.binary()),
                _lists(prints[order], pa.int64()), _lists(times[used[order]], pa.int32()),
                *[pa.array([x[order].astype(kind).tobytes()], pa.binary()) for x, kind in ((grouped, np.uint16), (lengths, np.int32))],
            ]
            names = ["block", "doc_ids", "sizes", "tokens", "words", "times", "groups", "bytes"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            number += 1

    return store(only(docs, "doc_id", "text").mapInArrow(run, BLOCK_SCHEMA), "blocks")


def _unpacked(batch: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
    """Lists of a block as arrays; its tokens by their width, groups and bytes as ``blocks`` packs them."""
    out = []
    for name in names:
        cell = batch.column(batch.schema.get_field_index(name))[row]
        if name == "tokens":
            raw, n = cell.as_py(), batch.column(batch.schema.get_field_index("sizes"))[row].values.to_numpy().sum()
            out.append(np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.int64))
        elif name in ("groups", "bytes"):
            out.append(np.frombuffer(cell.as_py(), np.uint16 if name == "groups" else np.int32))
        else:
            out.append(cell.values.to_numpy(zero_copy_only=False))
    return out


class Model(NamedTuple):
    """Sorted fingerprints of the frequent words and their ids; the network; the counts of all words
    (``word, grp, n``); and how many tokens and different words each group has."""

    vocabulary: np.ndarray
    ids: np.ndarray
    net: dict[str, np.ndarray]
    counts: DataFrame
    tokens: np.ndarray
    kinds: np.ndarray


def word_ids(prints: np.ndarray, grouped: np.ndarray, vocabulary: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ids of words: of its own for a frequent one, else that of the group."""
    rest = FREQUENT + grouped.astype(np.int64)
    if not len(vocabulary):
        return rest
    at = np.minimum(np.searchsorted(vocabulary, prints), len(vocabulary) - 1)
    return np.where(vocabulary[at] == prints, ids[at], rest)


def token_ids(of_word: np.ndarray, tokens: np.ndarray, offsets: np.ndarray):
    """Ids of all texts' tokens with ``REACH`` outside marks around each text; places of the
    tokens in them."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    places = np.arange(len(tokens)) + REACH * (2 * text + 1)
    padded = np.full(len(tokens) + 2 * REACH * (len(offsets) - 1), VOCABULARY, np.int64)
    if len(tokens):
        padded[places] = of_word[tokens]
    return padded, places


def contexts(padded: np.ndarray, places: np.ndarray) -> np.ndarray:
    return padded[places[:, None] + np.array(OFFSETS)]


def word_counts(blocked: DataFrame) -> DataFrame:
    """``word`` (a 64-bit fingerprint), its group and ``n`` over all blocks."""

    def summed(held) -> pa.RecordBatch:
        words, first, place = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        n = np.bincount(place, np.concatenate([h[2] for h in held]), len(words)).astype(np.int64)
        grouped = np.concatenate([h[1] for h in held])[first]
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(grouped, pa.int32()), pa.array(n)], names=["word", "grp", "n"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                held.append([x.copy() for x in _unpacked(batch, row, "words", "groups", "times")])
                size += len(held[-1][0])
                if size >= HELD_WORDS:
                    yield summed(held)
                    held, size = [], 0
        if size:
            yield summed(held)

    pairs = blocked.select("words", "groups", "times").mapInArrow(run, "word bigint, grp int, n bigint")
    return pairs.groupBy("word").agg(F.max("grp").alias("grp"), F.sum("n").alias("n"))


def _vocabulary(counts: DataFrame):
    """Sorted fingerprints of the most frequent words, their ids by rank, and counts by id; the
    tokens and different words of each group outside them."""
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    tokens, kinds = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in counts.groupBy("grp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        tokens[r["grp"]], kinds[r["grp"]] = r["n"], r["kinds"]
    for r in top:
        tokens[r["grp"]] -= r["n"]
        kinds[r["grp"]] -= 1
    by_id = np.zeros(VOCABULARY)
    by_id[: len(top)] = [r["n"] for r in top]
    by_id[FREQUENT:] = tokens
    words = np.array([r["word"] for r in top], dtype=np.int64)
    order = np.argsort(words)
    return words[order], order.astype(np.int64), by_id, tokens, kinds


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the vectors ``v`` and weights ``w`` of each of ``keys``, one vector in memory."""

    def run(batches):
        current, weight, total = None, 0.0, 0.0
        for batch in batches:
            for group, block, w, v in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (group, block) != current:
                    if current is not None:
                        yield _row(current, weight, total)
                    current, weight, total = (group, block), 0.0, 0.0
                weight += w
                total = total + np.frombuffer(v, np.float32).astype(np.float64)
        if current is not None:
            yield _row(current, weight, total)

    def _row(at, weight, total):
        columns = [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([weight]), pa.array([total.astype(np.float32).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "block", "w", "v"])

    dealt = rows.repartition(*keys).sortWithinPartitions("part", "block", "task")
    return dealt.select("part", "block", "w", "v").mapInArrow(run, "part bigint, block bigint, w double, v binary")


def masked(offsets: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """Which tokens round ``number`` trains on: over all rounds each token once."""
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
    return within % rounds == number


def train(blocked: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Counts all words of the blocks and trains the network on all their tokens."""
    spark = blocked.sparkSession
    counts = store(word_counts(blocked), "words")
    vocabulary, ids, by_id, tokens, kinds = _vocabulary(counts)
    net = start(by_id, seed)
    for number in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, ids, flat(net)))

        def learn(batches, shared=shared, number=number):
            from pyspark import TaskContext

            known, numbers, vector = shared.value
            trainer = Trainer(unflat(vector))
            left = [np.zeros((0, len(OFFSETS)), np.int64)], [np.zeros(0, np.int64)]
            for batch in batches:
                for row in range(batch.num_rows):
                    sizes, mine, prints, grouped = _unpacked(batch, row, "sizes", "tokens", "words", "groups")
                    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
                    padded, places = token_ids(word_ids(prints, grouped, known, numbers), mine, offsets)
                    chosen = places[masked(offsets, number, rounds)]
                    # what is left of a block goes into the next one's first batch
                    around, targets = np.concatenate((*left[0], contexts(padded, chosen))), np.concatenate((*left[1], padded[chosen]))
                    whole = len(targets) // BATCH * BATCH
                    for begin in range(0, whole, BATCH):
                        trainer.step(around[begin : begin + BATCH], targets[begin : begin + BATCH])
                    left = [around[whole:].copy()], [targets[whole:].copy()]
            if len(left[1][0]):
                trainer.step(left[0][0], left[1][0])
            if trainer.tokens:
                change = ((flat(trainer.net) - vector) * np.float32(trainer.tokens)).astype(np.float32)
                task = TaskContext.get().partitionId()
                for block, values in enumerate(np.array_split(change, BLOCKS)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([task]), pa.array([task % 16]), pa.array([block]), pa.array([float(trainer.tokens)]), pa.array([values.tobytes()], pa.binary())],
                        names=["task", "part", "block", "w", "v"],
                    )

        schema = "task bigint, part bigint, block bigint, w double, v binary"
        changes = blocked.select("sizes", "tokens", "words", "groups").mapInArrow(learn, schema)
        first = _summed(changes, ["part", "block"]).withColumn("task", F.col("part")).withColumn("part", F.lit(0).cast("bigint"))
        last = _summed(first, ["block"]).collect()
        if last:
            change = np.concatenate([np.frombuffer(r["v"], np.float32) / r["w"] for r in sorted(last, key=lambda r: r["block"])])
            net = unflat(flat(net) + change)
        shared.unpersist()
    return Model(vocabulary, ids, net, counts, tokens, kinds)


def within_group(n: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Log-probability of words in their group: ``n`` is the word's count, ``tokens`` and ``kinds`` are the group's."""
    spare = np.log(DISCOUNT * kinds + 1) - (lengths + 1) * np.log(257.0)
    return np.where(n > 0, np.log(np.maximum(n - DISCOUNT, DISCOUNT)), spare) - np.log(tokens + 1)


def _looked_up(prints: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of words by a sorted list, 0 for those not in it."""
    if not len(words):
        return np.zeros(len(prints), np.int64)
    at = np.minimum(np.searchsorted(words, prints), len(words) - 1)
    return np.where(words[at] == prints, counts[at], 0).astype(np.int64)


def _common(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sorted fingerprints and counts of the words above a count, ``COMMON`` at most; whether these are all."""
    size = F.floor(F.log2("n") * 8)  # steps of a logarithmic scale: their number is bounded
    steps = counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("size")).collect()
    least, total = None, 0
    for step in steps:
        if total + step["words"] > COMMON:
            break
        least, total = step["size"], total + step["words"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), not steps
    rows = counts.where(size >= least).select("word", "n").toArrow()
    words, n = rows.column("word").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(words)
    kind = np.uint32 if n.max() < 1 << 32 else np.int64
    return words[order], n[order].astype(kind), least == steps[-1]["size"]


def _rare_words(blocked: DataFrame, shared) -> DataFrame:
    """``block, word``: the words of each block that are not among the broadcast ones."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        common, n_common = shared.value[-2:]
        for batch in batches:
            for row in range(batch.num_rows):
                (prints,) = _unpacked(batch, row, "words")
                rare = prints[_looked_up(prints, common, n_common) == 0]
                block = np.full(len(rare), batch.column(0)[row].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(rare)], names=["block", "word"])

    return blocked.select("block", "words").mapInArrow(run, "block bigint, word bigint")


SCORES = "doc_id bigint, n_tokens bigint, log_likelihood double, mean_log_likelihood double"


def _scores(batch: pa.RecordBatch, row: int, trained, shared, found: np.ndarray, n_found: np.ndarray) -> pa.RecordBatch:
    """Scores of the documents of a block; ``found`` are its words that are not broadcast."""
    known, numbers, _, tokens, kinds, common, n_common = shared
    sizes, mine, prints, grouped, lengths = _unpacked(batch, row, "sizes", "tokens", "words", "groups", "bytes")
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    of_word = word_ids(prints, grouped, known, numbers)
    n = np.maximum(_looked_up(prints, common, n_common), _looked_up(prints, found, n_found))
    inside = np.where(of_word >= FREQUENT, within_group(n, lengths, tokens[grouped], kinds[grouped]), 0.0)
    padded, places = token_ids(of_word, mine, offsets)
    logs = np.zeros(len(places) + 1)
    for begin in range(0, len(places), CHUNK):
        some = places[begin : begin + CHUNK]
        logs[begin : begin + len(some)] = log_probabilities(trained, contexts(padded, some), padded[some])
    logs[:-1] += inside[mine]
    sums = np.where(sizes > 0, np.add.reduceat(logs, offsets[:-1]), 0.0)
    mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
    doc_ids = batch.column(batch.schema.get_field_index("doc_ids"))[row].values
    columns = [doc_ids, pa.array(sizes.astype(np.int64)), pa.array(sums), mean]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])


def score(blocked: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood`` of each document of the blocks.

    Where the counts of all words fit the broadcast, nothing is shuffled; else those of rarer words are joined to
    their blocks by (block, word).
    """
    vocabulary, ids, net, counts, tokens, kinds = model
    common, n_common, whole = _common(counts)
    values = (vocabulary, ids, flat(net), tokens, kinds, common, n_common)
    shared = blocked.sparkSession.sparkContext.broadcast(values)
    mine = blocked.select("block", "doc_ids", "sizes", "tokens", "words", "groups", "bytes")

    def alone(batches) -> Iterator[pa.RecordBatch]:
        trained, none = unflat(shared.value[2]), np.zeros(0, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                yield _scores(batch, row, trained, shared.value, none, none)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        trained = unflat(shared.value[2])
        found, n_found = right.column("word").to_numpy(), right.column("n").to_numpy()
        order = np.argsort(found)
        parts = [
            _scores(batch, row, trained, shared.value, found[order], n_found[order])
            for batch in left.to_batches()
            for row in range(batch.num_rows)
        ]
        return pa.Table.from_batches(parts)

    if whole:
        return mine.mapInArrow(alone, SCORES)
    counted = _rare_words(blocked, shared).join(counts.select("word", "n"), "word").select("block", "word", "n")
    return mine.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(joined, SCORES)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` and score them."""
    blocked = blocks(docs)
    return score(blocked, train(blocked))
