"""Whitening of embeddings by a covariance that counts each distinct vector by its multiplicity.

Entries become whole numbers, x = floor(64 c) + 1000000.  Identical x-vectors are grouped, and
a group enters the fit once, weighted by its number of rows (``weights="counts"``) or by one
(``weights="one"``).  Sums are exact.  The covariance is a weighted product of centred
vectors, made by partial products in the tasks; its eigenvectors whiten each distinct vector
once, and the result is joined back to the rows.

What goes through the driver is one matrix of dims x dims.  Vectors that hold more than one
row in 256 (fewer than 256 of them, whatever the table) are joined by broadcast, all others by a shuffle on
the vector, so that a vector that fills a third of the table does not fill a task.

Defined cases: rows whose vector is null, or holds a null, a NaN, an infinity or an entry of which 64 c
is 2**52 or more, are left out.  Vectors of different lengths are fitted apart, each length as a list of its own.  A
component whose eigenvalue is no more than a rounding error of the largest one is left out,
so equal vectors, a single one and empty ones give no rows.  Null and repeated ids are kept: each row gets
its own result.  A ``deviation`` beyond a long is null.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import only
from gleaner.session import store

SCALE, OFFSET = 64, 1_000_000
MOST_ENTRY = 2.0**52
MOST_COMPONENTS = 32
#: A vector with more than one row in so many is joined by broadcast; there are fewer than these.
HEAVY = 256
#: Entries of vectors that one matrix product takes at a time.
CHUNK_ENTRIES = 1 << 20


class Fit(NamedTuple):
    """The fit of the vectors of one length."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    axes: np.ndarray  # a column each component, unit length, by falling eigenvalue

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, with the whole part of the mean taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly; None beyond a long."""
        about = float(self.n) * self.n * (self.centred(x) ** 2).sum(axis=1)
        if self.n < 2**31 and (about < 2.0**62).all():
            whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
            rest = np.array([s % self.n for s in self.sums], dtype=np.int64)
            return ((self.n * (x - whole) - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 2**63 else None for v in exact]


def whole_vectors(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``id, x`` of the rows that can be used."""
    rows = only(embeddings, id_column, column).toDF("id", "vector")
    usable = F.col("vector").isNotNull() & F.forall(
        F.col("vector"),
        lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < MOST_ENTRY, F.lit(False)) & ~F.isnan(c),
    )
    x = F.transform("vector", lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)
    return rows.where(usable).select("id", x.cast("array<bigint>").alias("x"))


def _matrices(batch: pa.RecordBatch, column: str, weight: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, vectors and weights of a batch's rows, those of one length together, in bounded parts."""
    lists, weights = batch.column(column), batch.column(weight).to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        step = max(1, CHUNK_ENTRIES // int(d))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, flat[starts[part][:, None] + np.arange(d)], weights[part]


def _scatter(vectors: DataFrame, column: str, centred: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Weighted sums of products of centred vectors, per length: a row a task, added up by Spark."""

    def run(batches):
        sums = {}
        for batch in batches:
            for _, x, w in _matrices(batch, column, "weight"):
                c = centred(x)
                d = x.shape[1]
                sums[d] = sums.get(d, 0) + (c * w[:, None]).T @ c
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], names=["d", "s"]
            )

    parts = vectors.select(column, "weight").mapInArrow(run, "d int, s array<double>")
    entries = parts.select("d", F.posexplode("s").alias("k", "v")).groupBy("d", "k").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    table = entries.toArrow()
    for d in np.unique(table["d"].to_numpy()):
        mine = table.filter(pa.compute.equal(table["d"], int(d)))
        matrix = np.zeros(d * d)
        matrix[mine["k"].to_numpy()] = mine["v"].to_numpy()
        out[int(d)] = (matrix.reshape(d, d) + matrix.reshape(d, d).T) / 2
    return out


def fit(distinct: DataFrame) -> dict[int, Fit]:
    """The fit of each length of the weighted vectors ``x, weight``."""
    each = distinct.where("size(x) > 0").select(F.size("x").alias("d"), "weight", F.posexplode("x").alias("k", "v"))
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = each.groupBy("d", "k").agg(exact(F.col("weight")).alias("n"), exact(F.col("weight").cast("decimal(19,0)") * F.col("v").cast("decimal(19,0)")).alias("s"))
    totals: dict[int, tuple[int, dict[int, int]]] = {}
    for r in sums.collect():
        totals.setdefault(r["d"], (int(r["n"]), {}))[1][r["k"]] = int(r["s"])
    empty = np.zeros((0, 0))
    fits = {d: Fit(n, [s[k] for k in range(d)], empty, empty, empty) for d, (n, s) in totals.items()}
    for d, scatter in _scatter(distinct, "x", lambda x: fits[x.shape[1]].centred(x)).items():
        covariance = scatter / fits[d].n
        values, axes = np.linalg.eigh(covariance)
        values, axes = values[::-1], axes[:, ::-1]
        # of the two signs the one whose largest entry is positive
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(d)])
        fits[d] = fits[d]._replace(covariance=covariance, eigenvalues=values, axes=axes)
    return fits


def _whitened(distinct: DataFrame, fits: dict[int, Fit], components: int) -> DataFrame:
    """``x, weight, deviation, whitened`` of each distinct vector."""
    usable = {
        d: min(components, int((f.eigenvalues > d * np.finfo(float).eps * f.eigenvalues[0]).sum())) if f.eigenvalues[0] > 0 else 0
        for d, f in fits.items()
    }

    def run(batches):
        for batch in batches:
            deviations = [None] * batch.num_rows
            made = [[]] * batch.num_rows
            for rows, x, _ in _matrices(batch, "x", "weight"):
                of = fits[x.shape[1]]
                k = usable[x.shape[1]]
                w = of.centred(x) @ of.axes[:, :k] / np.sqrt(of.eigenvalues[:k])
                for row, deviation, values in zip(rows, of.deviations(x), w.tolist(), strict=True):
                    deviations[row], made[row] = deviation, values
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("weight"), pa.array(deviations, pa.int64()), pa.array(made, pa.list_(pa.float64()))],
                names=["x", "weight", "deviation", "whitened"],
            )

    schema = "x array<bigint>, weight bigint, deviation bigint, whitened array<double>"
    return distinct.select("x", "weight").mapInArrow(run, schema)


def _identity_errors(whitened: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Per length the largest absolute entry of the whitened vectors' covariance less the identity."""
    each = whitened.select(F.size("x").alias("d"), "weight", F.posexplode("whitened").alias("k", "v"))
    means: dict[int, dict[int, float]] = {}
    for r in each.groupBy("d", "k").agg(F.sum(F.col("weight") * F.col("v")).alias("s")).collect():
        means.setdefault(r["d"], {})[r["k"]] = r["s"] / fits[r["d"]].n
    errors = {}
    for d, mean in means.items():
        of = np.array([mean[k] for k in range(len(mean))])
        mine = whitened.where(F.size("x") == d)
        scatter = next(iter(_scatter(mine, "whitened", lambda x, of=of: x - of).values()))
        errors[d] = float(np.abs(scatter / fits[d].n - np.eye(len(of))).max())
    return errors


def whiten(
    embeddings: DataFrame,
    id_column: str = "vec_id",
    column: str = "embedding",
    components: int = MOST_COMPONENTS,
    weights: str = "counts",
) -> tuple[DataFrame, dict[int, Fit]]:
    """A row per usable vector, and the fit of each length.

    The rows: the id, ``x``, ``deviation``, ``whitened`` (an array, a value each component), and of its
    length's fit ``n``, ``explained`` (an array) and ``identity_error``.
    """
    if weights not in ("counts", "one"):
        raise ValueError(f"unknown weights {weights!r}")
    rows = store(whole_vectors(embeddings, id_column, column), "vectors")
    groups = store(rows.groupBy("x").agg(F.count(F.lit(1)).alias("rows")), "distinct")
    weight = F.col("rows") if weights == "counts" else F.lit(1).cast("bigint")
    distinct = groups.select("x", weight.alias("weight"))
    fits = fit(distinct)
    whitened = store(_whitened(distinct, fits, components), "whitened")
    errors = _identity_errors(whitened, fits)
    n_rows = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    heavy = groups.where(F.col("rows") * HEAVY > n_rows).select("x")
    of_heavy = whitened.join(F.broadcast(heavy), "x", "left_semi")
    often = rows.join(F.broadcast(of_heavy), "x")
    seldom = rows.join(F.broadcast(heavy), "x", "left_anti").join(whitened.hint("merge"), "x")
    joined = often.unionByName(seldom)
    facts = F.lit(None).cast("struct<n: bigint, explained: array<double>, identity_error: double>")
    for d, f in fits.items():
        if d not in errors:
            continue
        explained = (f.eigenvalues[:components] / np.trace(f.covariance)).tolist()
        mine = F.struct(
            F.lit(f.n).cast("bigint").alias("n"), F.lit(explained).cast("array<double>").alias("explained"), F.lit(errors[d]).cast("double").alias("identity_error")
        )
        facts = F.when(F.size("x") == d, mine).otherwise(facts)
    joined = joined.withColumn("_fit", facts)
    return joined.select(F.col("id").alias(id_column), "x", "deviation", "whitened", "_fit.n", "_fit.explained", "_fit.identity_error"), fits


def whitened_rows(embeddings: DataFrame, components: int = MOST_COMPONENTS) -> DataFrame:
    """A row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    rows, _ = whiten(embeddings, components=components)
    each = rows.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("k")).alias("explained"), "identity_error",
    )
