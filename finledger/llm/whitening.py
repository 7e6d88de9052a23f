"""Embedding whitening by weighted multiplicity covariance.

Vectors become vectors of whole numbers, ``floor(scale * c) + shift``. Equal ones are grouped, and from
there on every distinct vector is handled once with its count (or with one) as its weight:

1. counts of the distinct vectors (one shuffle with map-side combining: a vector that a third of all
   rows share is one row for each task before the shuffle);
2. exact sums ``S`` for each dimension, in whole numbers;
3. a weighted GEMM of the centred vectors in each task, whose d x d matrices are added;
4. the eigenvectors of that one matrix, on the driver;
5. every distinct vector is projected once, and the result is joined back to the rows by a 128-bit
   hash of the vector (AQE splits the rows of a hot vector over tasks).

What reaches the driver: d sums, d x d covariances, and the covariance of the whitened components,
whatever the number of rows.

Defined cases: a row whose vector is null or holds a null, NaN or infinite entry is left out. Vectors of several lengths share no
covariance: those of the most frequent length (of equals: the longest) stay, the others are left out. An entry
beyond +-2^62 / scale counts as that bound. Repeated rows are returned each; a null id is an id like any other. A component
without variance (eigenvalue at most d * 2^-52 of the largest) has null for ``whitened`` and takes no part in ``identity_error``; with no variance at all
``explained`` and ``identity_error`` are null. A ``deviation`` beyond the range of a long is null. An empty table, or one without a usable vector,
gives an empty result. Other columns pass through, whatever their names; added names that are taken get leading underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finledger.llm._common import free_name, seal, written

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
_MOST = float(1 << 62)
_BLOCK = 4096             # vectors in one multiplication
ADDED = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def whole_numbers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """The vector of whole numbers; null for a null vector or one with a null, NaN or infinite entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    x = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(_MOST)), F.lit(-_MOST))) + shift)
    return F.when(~bad, x)


def _key(x: str) -> list[Column]:
    """128 bits of hash of a vector."""
    return [F.xxhash64(x).alias("_k1"), F.xxhash64(F.lit(1), x).alias("_k2")]


@dataclass
class Whitening:
    """n vectors with sums S; the components with an eigenvalue, by falling eigenvalue, as columns of ``axes``."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    usable: list[bool] = field(default_factory=list)

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean is taken off exactly."""
        whole, rest = _mean(self.sums, self.n)
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Components of the centred vectors; NaN for one without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = self.centred(x) @ self.axes / np.sqrt(np.maximum(self.values, 0.0))
        out[:, ~np.array(self.usable, dtype=bool)] = np.nan
        return out

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 over the dimensions, exact."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = [s % self.n for s in self.sums]
        near = x - whole
        most = int(np.abs(near).max(initial=0)) * self.n + self.n
        if most * most * self.dims < 1 << 63:
            z = near * self.n - np.array(rest, dtype=np.int64)
            return (z * z).sum(axis=1).tolist()
        return [sum((int(a) * self.n - r) ** 2 for a, r in zip(row, rest)) for row in near]


def _mean(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole and fractional part of S/n."""
    return np.array([s // n for s in sums], dtype=np.int64), np.array([(s % n) / n for s in sums])


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def distinct_vectors(df: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(x, m): every distinct vector of whole numbers of the most frequent length with its count, as a written table."""
    x = df.select(whole_numbers(F.col(f"`{vector}`"), scale, shift).alias("x")).where("x IS NOT NULL")
    found = written(x.groupBy("x").agg(F.count(F.lit(1)).alias("m")), "whitening-distinct")
    length = found.groupBy(F.size("x").alias("d")).agg(F.sum("m").alias("rows")).where("d > 0")
    best = length.orderBy(F.col("rows").desc(), F.col("d").desc()).first()
    return found.where(F.size("x") == (best["d"] if best else -1))


def _sums(found: DataFrame, dims: int) -> list[int]:
    """S for each dimension: whole-number sums of each task, added as decimals."""

    def run(batches: Iterator) -> Iterator:
        from decimal import Decimal

        import pyarrow as pa

        total = [0] * dims
        for b in batches:
            x, m = _matrix(b.column(0), dims), b.column(1).to_numpy()
            if int(np.abs(x).max(initial=0)) * int(m.sum()) < 1 << 62:
                part = (m @ x).tolist()
            else:
                part = [sum(int(a) * int(w) for a, w in zip(column, m)) for column in x.T]
            total = [t + p for t, p in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "s"])

    by = found.select("x", "m").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    got = {r["i"]: int(r["s"]) for r in by.collect()}  # one row for each dimension
    return [got[i] for i in range(dims)]


def _covariance(found: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Sum of m (x - S/n)(x - S/n)^T over n: a GEMM for each block of vectors, one matrix for each task, added row by row in the order of the tasks."""
    dims = len(sums)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        whole, rest = _mean(sums, n)
        total = np.zeros((dims, dims))
        for b in batches:
            for at in range(0, b.num_rows, _BLOCK):
                part = b.slice(at, _BLOCK)
                y = (_matrix(part.column(0), dims) - whole).astype(np.float64) - rest
                total += (y * part.column(1).to_numpy()[:, None]).T @ y
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["task", "i", "row"])

    def add(table):
        import pyarrow as pa

        t = table.sort_by("task")
        row = _matrix(t.column("row").combine_chunks(), dims).sum(axis=0)
        return pa.table({"i": t.column("i").slice(0, 1), "row": pa.array([row], pa.list_(pa.float64()))})

    parts = found.select("x", "m").mapInArrow(run, "task int, i int, row array<double>")
    rows = parts.groupBy("i").applyInArrow(add, "i int, row array<double>").collect()  # d rows of d numbers
    v = np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])]) / n
    return (v + v.T) / 2


def fit(found: DataFrame, components: int = COMPONENTS, weighted: bool = True) -> Whitening | None:
    """Principal axes of the distinct vectors of :func:`distinct_vectors`, weighted by their counts (or each by one); None without a vector."""
    if not weighted:
        found = found.withColumn("m", F.lit(1).cast("long"))
    head = found.agg(F.sum("m").alias("n"), F.max(F.size("x")).alias("d")).first()
    if not head["n"]:
        return None
    n, dims = head["n"], head["d"]
    sums = _sums(found, dims)
    values, vectors = np.linalg.eigh(_covariance(found, n, sums))
    order = np.argsort(-values, kind="stable")
    trace, least = float(values.sum()), max(0.0, float(values.max())) * dims * 2.0 ** -52
    take = order[:min(components, dims)]
    return Whitening(n, sums, vectors[:, take], values[take], trace, [bool(v > least) for v in values[take]])


def whiten_distinct(found: DataFrame, model: Whitening) -> DataFrame:
    """(_k1, _k2, _m, _deviation, _parts): each distinct vector projected once, as a written table."""
    dims = model.dims

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, _BLOCK):
                part = b.slice(at, _BLOCK)
                x = _matrix(part.column(3), dims)
                deviation = [v if v < 1 << 63 else None for v in model.deviations(x)]
                parts = model.whitened(x)
                shape = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts.shape[1]), pa.array(parts.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(deviation, pa.int64()), shape], ["_k1", "_k2", "_m", "_deviation", "_parts"])

    keyed = found.select(*_key("x"), F.col("m").alias("_m"), "x")
    return written(keyed.mapInArrow(run, "_k1 bigint, _k2 bigint, _m bigint, _deviation bigint, _parts array<double>"), "whitening-parts")


def identity_error(parts: DataFrame, model: Whitening, weighted: bool = True) -> float | None:
    """Largest absolute entry of the covariance of the whitened components minus the identity, measured on all vectors of the fit."""
    used = [i for i, ok in enumerate(model.usable) if ok]
    if not used:
        return None
    m = F.col("_m") if weighted else F.lit(1)
    part = {i: F.get("_parts", F.lit(i)) for i in used}
    mean = parts.agg(*[(F.sum(m * part[i]) / model.n).alias(f"a{i}") for i in used]).first()
    centred = {i: part[i] - F.lit(mean[f"a{i}"]) for i in used}
    cells = parts.agg(*[(F.sum(m * centred[i] * centred[j]) / model.n).alias(f"v{i}_{j}") for i in used for j in used if i <= j]).first()
    return max(abs(cells[f"v{i}_{j}"] - (i == j)) for i in used for j in used if i <= j)


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, weighted: bool = True,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Every usable row, without its vector, once for each component: component (from 1), n, deviation, whitened, explained, identity_error."""
    found = distinct_vectors(df, vector, scale, shift)
    model = fit(found, components, weighted)
    d = seal(df, _text=vector)
    d = d.withColumn("_x", whole_numbers(F.col("_text"), scale, shift)).drop("_text")
    if model is None:
        none = [F.lit(None).cast(t).alias(a) for a, t in zip(ADDED, ["int", "long", "long", "double", "double", "double"])]
        return _with_others(d.where("false").select("_row", *none), df, vector)
    parts = whiten_distinct(found, model)
    error = identity_error(parts, model, weighted)
    rows = d.where(F.size("_x") == model.dims).select("_row", *_key("_x"))
    rows = rows.join(parts.select(F.col("_k1").alias("_p1"), F.col("_k2").alias("_p2"), "_deviation", "_parts"),
                     (F.col("_k1") == F.col("_p1")) & (F.col("_k2") == F.col("_p2")))
    share = F.lit([float(max(v, 0.0) / model.trace) for v in model.values]) if model.trace > 0 else F.array().cast("array<double>")
    rows = rows.select("_row", "_deviation", F.posexplode("_parts").alias("_i", "whitened"))
    rows = rows.select(
        "_row", (F.col("_i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("_deviation").alias("deviation"),
        "whitened", F.get(share, F.col("_i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
    return _with_others(rows, df, vector)


def _with_others(rows: DataFrame, df: DataFrame, vector: str) -> DataFrame:
    """The columns of the input but the vector, and the added ones."""
    others = [c for c in df.columns if c != vector]
    cols = [F.col(f"_row.c{i}").alias(c) for i, c in enumerate(df.columns) if c != vector]
    return rows.select(*cols, *[F.col(a).alias(free_name(a, others)) for a in ADDED])
