"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimates, exact checks.

A document's set of word shingles is hashed once.  The leading bits of a hash choose one of
``REGISTERS`` registers; a register keeps the least hash as its number of leading zeros and
``MANTISSA`` bits after them.  Documents with the same set are one class from here on.  Bands
of registers (an empty register borrows from a full one, in an order fixed per place) bring classes
together; the Jaccard similarity estimated from the registers, corrected for chance collisions,
drops most pairs that do not belong together; the rest is verified on full sets.

No bucket's pairs are written out.  First each member is checked against the least one of its
bucket.  Only buckets whose members are then in several components are looked at again, in rounds with
a row a member: a pivot is chosen, the member nearest to the usual registers of its bucket (a sample
of members tells which values are usual), and all members of other components are checked against it.
Copies of one text are close to that text, so few rounds tie nearly all of a group together.  Buckets that
still hold several components are cut into blocks, whose registers are compared inside tasks; what may
reach the threshold across components is compared on full sets, and a block gives no more links than
tie its components together.  Nothing is capped: blocks cover every pair across components.

Defined cases: null, empty and wordless texts have an empty set, are linked with nothing and
kept; rows with one id are one document; rows without an id are linked with nothing; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import kept_in_worker, only, slices
from gleaner.llm.graph import components
from gleaner.llm.words import mix64, shingle_sets
from gleaner.operators.joins import join_list
from gleaner.session import store

REGISTERS = 128
MANTISSA = 10
BANDS, ROWS = 40, 6
EMPTY = 0xFFFF
#: Fixed value: chance collisions a register, times 2 ** MANTISSA (Yu and Weber, 2017).
COLLISION = 0.169919487159739
#: Estimates this many standard errors under the threshold are still verified.
ERRORS = 4.5
#: Members of a block that are compared with each other by registers; members and shingles of those compared on full sets.
BLOCK, EXACT_BLOCK, EXACT_SHINGLES = 512, 128, 1 << 20
#: Text that a task takes apart at once; its words and shingles take some fifteen times that in memory.
TEXT_BYTES = 2 << 20
#: Members of a bucket (about) that choose its pivot; a further round follows one that took so large a part of
#: the members out of buckets with several components.  Blocks see to what rounds leave.
PIVOT_SAMPLE, PIVOT_GAIN = 64, 0.1


def registers(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Matrix of compressed registers of sets of spread 64-bit fingerprints, sorted per set."""
    bits = int(np.log2(REGISTERS))
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    slot = (shingles >> np.uint64(64 - bits)).astype(np.int64)
    place = owner * REGISTERS + slot
    first = np.ones(len(place), dtype=bool)
    first[1:] = place[1:] != place[:-1]
    rest = shingles[first] << np.uint64(bits)
    # leading zeros, then the bits after the first one; no 64-bit float rounds a 52-bit part up
    top = (rest >> np.uint64(12)).astype(np.float64)
    exponent = np.where(top > 0, np.frexp(top)[1], 0)
    zeros = 52 - exponent
    shifted = rest << (np.minimum(zeros + 1, 63)).astype(np.uint64)
    mantissa = shifted >> np.uint64(64 - MANTISSA)
    out = np.full(len(sizes) * REGISTERS, EMPTY, dtype=np.uint16)
    out[place[first]] = ((52 - zeros).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out.reshape(len(sizes), REGISTERS)


def _places() -> tuple[np.ndarray, np.ndarray]:
    """Registers of each band's rows, and for each the order in which it borrows."""
    rng = np.random.default_rng(20170)
    count = BANDS * ROWS
    picks = np.concatenate([rng.permutation(REGISTERS) for _ in range(-(-count // REGISTERS))])[:count]
    return picks, np.stack([rng.permutation(REGISTERS) for _ in range(count)])


def band_keys(matrix: np.ndarray) -> np.ndarray:
    """A 64-bit key per set and band."""
    picks, borrow = kept_in_worker("hyperminhash places", _places)
    at = np.tile(picks, (len(matrix), 1))
    rows, cols = np.nonzero(np.take_along_axis(matrix, at, 1) == EMPTY)
    for k in range(REGISTERS):
        if not len(rows):
            break
        at[rows, cols] = borrow[cols, k]
        still = matrix[rows, borrow[cols, k]] == EMPTY
        rows, cols = rows[still], cols[still]
    value = (at.astype(np.uint64) << np.uint64(16)) | np.take_along_axis(matrix, at, 1).astype(np.uint64)
    value = value.reshape(len(matrix), BANDS, ROWS)
    key = np.tile(mix64(np.arange(BANDS, dtype=np.uint64)), (len(matrix), 1))
    for r in range(ROWS):
        key = mix64(key * np.uint64(31) + value[:, :, r])
    return key


def could_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int):
    """Estimates for each row of ``a`` with each of ``b``, and whether a pair may reach the threshold."""
    full_a, full_b = a != EMPTY, b != EMPTY
    same = np.zeros((len(a), len(b)), np.int32)
    both = np.zeros_like(same)
    for r in range(REGISTERS):
        one = full_a[:, r, None] & full_b[None, :, r]
        both += one
        same += one & (a[:, r, None] == b[None, :, r])
    either = full_a.sum(1)[:, None] + full_b.sum(1)[None, :] - both
    estimate = (same - COLLISION * both / 2**MANTISSA) / np.maximum(either, 1)
    goal = percent / 100
    error = np.sqrt(goal * (1 - goal) / np.maximum(either, 1))
    sizes = 100 * np.minimum(n_a[:, None], n_b[None, :]) >= percent * np.maximum(n_a[:, None], n_b[None, :])
    return estimate, sizes & (estimate >= goal - ERRORS * error - 1e-9)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, sketch``: ``d1, d2`` tell sets apart."""

    def run(batches):
        for part in slices(batches, most=TEXT_BYTES):
            shingles, offsets = shingle_sets(part.column(1), width)
            sizes = np.diff(offsets)
            digests = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                mixed = np.concatenate((mix64(shingles ^ np.uint64(salt)), [np.uint64(0)]))
                sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)))
                digests.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
            matrix = registers(shingles, offsets)
            sketch = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(2 * REGISTERS), len(sizes), [None, pa.py_buffer(np.ascontiguousarray(matrix))]
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes.astype(np.int64)), *map(pa.array, digests), sketch.cast(pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "sketch"],
            )

    schema = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sketch binary"
    return only(docs, "doc_id", "text").mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint16).reshape(-1, REGISTERS)


def _bands(classes: DataFrame) -> DataFrame:
    """``rep, n, keys``: a class, its number of shingles and its bands."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                keys = band_keys(_matrix(part.column(1))).view(np.int64)
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS)
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["rep", "n", "keys"])

    columns = classes.select("rep", "sketch", "n_shingles")
    return columns.mapInArrow(run, "rep bigint, n bigint, keys array<bigint>")


def _row_estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of each row of ``a`` with the same row of ``b``, and the registers it rests on."""
    full_a, full_b = a != EMPTY, b != EMPTY
    both = (full_a & full_b).sum(1)
    either = np.maximum((full_a | full_b).sum(1), 1)
    same = (full_a & full_b & (a == b)).sum(1)
    return (same - COLLISION * both / 2**MANTISSA) / either, either


def _reaching(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of ``a, b, n_a, s_a, n_b, s_b`` whose estimate may reach the threshold."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                estimate, either = _row_estimates(_matrix(part.column(3)), _matrix(part.column(5)))
                n_a, n_b = part.column(2).to_numpy(), part.column(4).to_numpy()
                goal = percent / 100
                error = np.sqrt(goal * (1 - goal) / either)
                ok = (estimate >= goal - ERRORS * error - 1e-9) & (
                    100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
                )
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return rows.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a bigint, b bigint")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of classes whose estimate may reach the threshold."""
    side = lambda x: classes.select(
        F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")
    )
    return _reaching(pairs.join(side("a"), "a").join(side("b"), "b"), percent)


def _usual(samples: DataFrame) -> DataFrame:
    """``key, usual``: per bucket the most frequent value of each register in a list ``sketches`` of members."""

    def run(batches):
        for batch in batches:
            made = []
            for sketches in batch.column(1):
                matrix = np.sort(_matrix(sketches.values), axis=0)
                # the longest run of equal values in each sorted column; an empty register is a value as well
                best, length = matrix[0].copy(), np.ones(REGISTERS, np.int64)
                run_length = np.ones(REGISTERS, np.int64)
                for k in range(1, len(matrix)):
                    run_length = np.where(matrix[k] == matrix[k - 1], run_length + 1, 1)
                    longer = run_length > length
                    best[longer], length[longer] = matrix[k][longer], run_length[longer]
                made.append(best.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "usual"])

    return samples.select("key", "sketches").mapInArrow(run, "key bigint, usual binary")


def _with_core(members: DataFrame) -> DataFrame:
    """``key, core, most, size`` of buckets with several components: the label of the largest, its members and all."""
    counts = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    core = counts.groupBy("key").agg(
        F.max_by("label", F.struct("c", "label")).alias("core"), F.max("c").alias("most"), F.sum("c").alias("size")
    )
    return core.where("most < size")


def _pivot_pairs(members: DataFrame, percent: int, anywhere: bool) -> DataFrame:
    """Pairs ``a, b`` of a bucket's pivot with its members of other components, if they may reach the threshold.

    ``members (key, rep, label, n_shingles, sketch)``.  The pivot is sought ``anywhere`` in the bucket, or among
    the members outside its largest component.
    """
    core = store(_with_core(members), "cores")
    rows = members.join(core, "key")
    able = rows if anywhere else rows.where("label <> core")
    number = F.col("size") if anywhere else F.col("size") - F.col("most")
    # a hash picks about as many members of every bucket, and all of a small one
    samples = able.where(F.pmod(F.xxhash64("rep", "key"), number) < PIVOT_SAMPLE)
    usual = _usual(samples.groupBy("key").agg(F.collect_list("sketch").alias("sketches")))

    def nearness(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                estimate, _ = _row_estimates(_matrix(part.column(2)), _matrix(part.column(3)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(estimate)], names=["key", "rep", "near"])

    near = able.join(usual, "key").select("key", "rep", "sketch", "usual").mapInArrow(nearness, "key bigint, rep bigint, near double")
    pivots = near.groupBy("key").agg(F.max_by("rep", F.struct("near", "rep")).alias("a"))
    facts = members.select("key", F.col("rep").alias("a"), F.col("label").alias("l_a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    pivots = store(pivots.join(facts, ["key", "a"]), "pivots")
    others = rows.select("key", F.col("rep").alias("b"), "label", F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    found = _reaching(others.join(pivots, "key").where("label <> l_a"), percent)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Those of ``pairs (a, b)`` with 100 * shared >= percent * all shingles, on full sets.

    Texts are taken to their pairs.  The partners of one ``a`` are dealt over as many tasks as
    a shuffle has, with the text of ``a`` once in each that has some.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = join_list(only(docs, "doc_id", "text"), store(ids, "ids"), ["doc_id"], "left_semi")
    texts = store(texts, "texts")
    fan = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(fan)))
    other = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", F.lit(1).alias("role"), "b", "text")
    hubs = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a")
    rows = other.unionByName(hubs.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("b"), "text"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def check(batches):
        hub, sets = None, []
        for part in slices(batches, "text", TEXT_BYTES):
            shingles, offsets = shingle_sets(part.column(4), width)
            hubs, parts = part.column(0).to_pylist(), part.column(1).to_pylist()
            roles, members = part.column(2).to_pylist(), part.column(3).to_pylist()
            links = []
            for k, at in enumerate(zip(hubs, parts, strict=True)):
                mine = shingles[offsets[k] : offsets[k + 1]]
                if roles[k] == 0:
                    if at != hub:
                        hub, sets = at, []
                    sets.append(mine)
                    continue
                for other in sets if at == hub else []:
                    shared = np.intersect1d(mine, other, assume_unique=True).size
                    if shared and 100 * shared >= percent * (len(mine) + len(other) - shared):
                        links.append((at[0], members[k]))
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"]
            )

    return rows.mapInArrow(check, "a bigint, b bigint")


def _blocks(members: DataFrame) -> DataFrame:
    """Blocks of the buckets that hold several components: a list ``m`` of members each.

    ``members (key, rep, label, ..)``.  Those outside their bucket's largest component (``out``) are
    cut into blocks, all members too, and each block of the former meets each of the latter:
    every pair across components is seen, and no task gets more than two blocks at once.
    """
    core = _with_core(members).select(
        "key", "core", F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("outs"),
        F.ceil(F.col("size") / BLOCK).cast("int").alias("ins"),
    )
    rows = members.join(core, "key")
    many = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = lambda n: F.pmod(F.hash("rep"), F.col(n))
    outer = F.transform(many("ins"), lambda j: F.struct(dealt("outs").alias("i"), j.alias("j"), F.lit(True).alias("out")))
    inner = F.transform(many("outs"), lambda i: F.struct(i.alias("i"), dealt("ins").alias("j"), F.lit(False).alias("out")))
    outer = F.when(F.col("label") != F.col("core"), outer).otherwise(F.slice(outer, 1, 0))
    rows = rows.withColumn("_at", F.explode(F.concat(outer, inner)))
    kept = [c for c in members.columns if c != "key"]
    both = rows.select("key", "_at.i", "_at.j", F.struct(F.col("_at.out").alias("out"), *kept).alias("m"))
    return both.groupBy("key", "i", "j").agg(F.collect_list("m").alias("m"))


class _Side(NamedTuple):
    """Members of one side of a block, as columns."""

    out: bool
    rep: np.ndarray
    label: np.ndarray
    n: np.ndarray
    sketches: np.ndarray

    def take(self, rows: np.ndarray) -> _Side:
        return _Side(self.out, *(column[rows] for column in self[1:]))


def _sides(members: pa.StructArray) -> tuple[_Side, _Side]:
    """Members outside their bucket's largest component, and all members, of a block."""
    out = members.field("out").to_numpy(zero_copy_only=False)
    columns = [members.field(c).to_numpy() for c in ("rep", "label", "n_shingles")]
    every = _Side(True, *columns, _matrix(members.field("sketch")))
    return every.take(out), every.take(~out)._replace(out=False)


def _linkable(outs: _Side, ins: _Side, percent: int, key: int) -> np.ndarray:
    """Which pairs across components may link.

    Pairs that an earlier band than the bucket's brings together too are left to that.
    """
    _, ok = could_link(outs.sketches, ins.sketches, outs.n, ins.n, percent)
    ok &= outs.label[:, None] != ins.label[None, :]
    if ok.any():
        keys_a, keys_b = band_keys(outs.sketches).view(np.int64), band_keys(ins.sketches).view(np.int64)
        for k in range(np.flatnonzero(keys_a[0] == key)[0]):
            ok &= keys_a[:, k, None] != keys_b[None, :, k]
    return ok


def _cut(side: _Side) -> np.ndarray:
    """A number of a small block for each member: blocks of so many members and shingles at most, or of one member."""
    numbers, number, count, shingles = [], 0, 0, 0
    for n in side.n.tolist():
        count, shingles = count + 1, shingles + n
        if count > 1 and (count > EXACT_BLOCK or shingles > EXACT_SHINGLES):
            number, count, shingles = number + 1, 1, n
        numbers.append(number)
    return np.array(numbers, np.int32)


def _members_in_question(members: DataFrame, percent: int) -> DataFrame:
    """``block, out, rep, label``: members of small blocks that have a pair which may link."""

    def parts(name, outs, ins, ok):
        of_out, of_in = _cut(outs), _cut(ins)
        for x in range(of_out[-1] + 1):
            for y in range(of_in[-1] + 1):
                rows, columns = np.flatnonzero(of_out == x), np.flatnonzero(of_in == y)
                part = ok[np.ix_(rows, columns)]
                for side, kept in ((outs, rows[part.any(1)]), (ins, columns[part.any(0)])):
                    if len(kept):
                        blocks = pa.array([f"{name}:{x}:{y}"] * len(kept))
                        flags = pa.array([side.out] * len(kept))
                        made = [blocks, flags, pa.array(side.rep[kept]), pa.array(side.label[kept])]
                        yield pa.RecordBatch.from_arrays(made, names=["block", "out", "rep", "label"])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                key, i, j = (batch.column(k)[row].as_py() for k in range(3))
                outs, ins = _sides(batch.column(3)[row].values)
                if not len(outs.rep) or not len(ins.rep):
                    continue
                ok = _linkable(outs, ins, percent, key)
                if ok.any():
                    a, b = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
                    yield from parts(f"{key}:{i}:{j}", outs.take(a), ins.take(b), ok[np.ix_(a, b)])

    return _blocks(members).mapInArrow(run, "block string, out boolean, rep bigint, label bigint")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Number of common elements of each set of ``a`` with each of ``b``."""
    flat, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for start in range(0, len(flat), columns):
        lo, hi = np.searchsorted(place, (start, start + columns))
        marks = np.zeros((len(a) + len(b), columns), np.float32)
        marks[owner[lo:hi], place[lo:hi] - start] = 1
        out += marks[: len(a)] @ marks[len(a) :].T
    return out.astype(np.int64)


def _exact(questions: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Links ``a, b`` of blocks on full sets: as many as tie each block's components together."""

    def sets(batches):
        for part in slices(batches, most=TEXT_BYTES):
            flat, offsets = shingle_sets(part.column(1), width)
            raw = [flat[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["rep", "set"])

    ids = store(questions.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    texts = join_list(only(docs, "doc_id", "text"), ids, ["doc_id"], "left_semi")
    full = store(texts.mapInArrow(sets, "rep bigint, set binary"), "sets")
    rows = questions.join(full, "rep").groupBy("block")
    blocks = rows.agg(F.collect_list(F.struct("out", "rep", "label", "set")).alias("m")).select("m")

    def links_of(members: pa.StructArray):
        out = members.field("out").to_numpy(zero_copy_only=False)
        reps, labels = members.field("rep").to_numpy(), members.field("label").to_numpy()
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in members.field("set")]
        outs, ins = np.flatnonzero(out), np.flatnonzero(~out)
        if not len(outs) or not len(ins):
            return
        a, b = ([sets[k] for k in side] for side in (outs, ins))
        shared = shared_counts(a, b)
        n_a, n_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
        linked = 100 * shared >= percent * (n_a[:, None] + n_b[None, :] - shared)
        top = {x: x for x in labels.tolist()}

        def root(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for x, y in zip(*np.nonzero(linked & (shared > 0)), strict=True):
            one, other = root(int(labels[outs[x]])), root(int(labels[ins[y]]))
            if one != other:
                top[max(one, other)] = min(one, other)
                yield reps[outs[x]], reps[ins[y]]

    def run(batches):
        for batch in batches:
            links = [pair for row in range(batch.num_rows) for pair in links_of(batch.column(0)[row].values)]
            columns = list(zip(*links, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return blocks.mapInArrow(run, "a bigint, b bigint")


def _labelled(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    found = labels.select(F.col("node").alias(column), F.col("component").alias("_c"))
    return df.join(found, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs``.

    Documents are linked if they share ``percent`` of their ``width``-word shingles or more;
    ``component_id`` is the least id reachable over links, and ``kept`` says it is the row's own.
    """
    rows = store(sketches(docs, width), "sketches")
    real = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "d1", "d2"]
    classes = real.groupBy(*same).agg(F.min(F.struct("doc_id", "sketch")).alias("one"), F.count(F.lit(1)).alias("copies"))
    classes = store(classes.select(*same, "copies", F.col("one.doc_id").alias("rep"), F.col("one.sketch").alias("sketch")), "classes")
    bands = store(_bands(classes), "bands")
    entries = bands.select("rep", "n", F.explode("keys").alias("key"))
    one = F.struct("rep", "n")
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(one).alias("least"), F.max(one).alias("most"))
    buckets = store(buckets.where("size > 1"), "buckets")
    crowded = store(entries.join(buckets.where("size > 2").select("key", "least"), "key"), "crowded")
    stars = crowded.select("least", one.alias("most"))
    near = 100 * F.least("least.n", "most.n") >= percent * F.greatest("least.n", "most.n")
    pairs = stars.unionByName(buckets.where("size = 2").select("least", "most")).where("least.rep < most.rep").where(near)
    pairs = store(pairs.select(F.col("least.rep").alias("a"), F.col("most.rep").alias("b")).distinct(), "pairs")
    likely = store(_likely(pairs, classes, percent), "likely")
    edges = store(verified(likely, docs, percent, width), "links")
    # documents of one set are linked without a look
    several = classes.where("copies > 1").select(*same, "rep")
    twins = real.join(several, same).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    twins = store(twins, "twins")
    # a first look at who belongs together: the least partner
    hub = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    mixed = _mixed(_labelled(crowded.select("key", "rep"), hub, "rep", "label"))
    mixed = store(mixed.join(classes.select("rep", "n_shingles", "sketch"), "rep"), "mixed")
    edges, looked, left, anywhere = edges.unionByName(twins), likely, mixed.count(), True
    while True:
        found = store(_pivot_pairs(mixed, percent, anywhere).join(looked, ["a", "b"], "left_anti"), "pairs")
        edges, looked = edges.unionByName(store(verified(found, docs, percent, width), "links")), looked.unionByName(found)
        labels = store(components(edges), "labels")
        mixed = store(_mixed(_labelled(mixed.drop("label"), labels, "rep", "label")), "mixed")
        before, left, anywhere = left, mixed.count(), False
        if left >= (1 - PIVOT_GAIN) * before:
            break

    questions = store(_members_in_question(mixed, percent), "questions")
    if not questions.isEmpty():
        rest = store(_exact(questions, docs, percent, width), "links")
        labels = store(components(edges.unionByName(rest)), "labels")

    ids = _labelled(rows, labels, "doc_id", "component_id")
    return ids.select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _mixed(entries: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component."""
    ends = entries.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return entries.join(ends.where("lo <> hi").select("key"), "key")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """One document of each group, in ``docs``' columns; of rows with one id that are kept, all."""
    gone = near_duplicates(docs, percent, width).where("NOT kept").select("doc_id").distinct()
    return join_list(docs, store(gone, "gone"), ["doc_id"], "left_anti")
