"""Whitening of vectors by the covariance of their distinct forms.

Vectors become whole numbers (``floor(scale * c)``), and equal ones are grouped before anything else: each distinct vector is
summed, centred, multiplied and whitened once, with one or its number of copies as weight, and the result is joined back to
the rows. Tasks send on one row of a matrix at a time, so what meets anywhere is bounded by the length of the vectors. The
model (means, eigenvectors) goes to the driver and with the tasks; its size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens.session import materialize, small_batches

COMPONENTS, SCALE = 4, 256
#: Numbers in the covariances of all lengths together, at the most.
MAX_NUMBERS = 1 << 26
#: Keys whose rows are told apart by number when results go back to rows, at the most, and rows that need no such care.
HOT_KEYS, COLD_ROWS = 100_000, 10_000
#: Partial matrices that meet in one task at a time.
FAN_IN = 256
_LONG = 2 ** 63


@dataclass
class Model:
    """Weight ``n`` and sums of the fit list, eigenvectors (rows) by falling eigenvalue, and the trace of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.sums, self.n)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)^2; None beyond 64 bits."""
        top = self.n * max(int(np.abs(x.astype(float)).max(initial=0)) + 1, 1) + max(map(abs, self.sums), default=0)
        if top * top * max(len(self.sums), 1) < _LONG:
            parts = self.n * x - np.array(self.sums, np.int64)
            return (parts * parts).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < _LONG else None for v in exact]


def _centred(x: np.ndarray, sums: Sequence[int], n: int) -> np.ndarray:
    """x - S / n, with the whole part of the mean taken off before numbers become doubles."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - rest


def distinct(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """(rows with their vectors' keys, distinct vectors with keys and numbers of copies), both stored."""
    entry = F.col("v")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = (df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(entry.isNotNull() & finite)
            .select("id", F.transform(entry, lambda c: F.floor(c * scale).cast("long")).alias("x")))
    keys = [F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(scale), "x", F.size("x")).alias("h2")]
    keyed = materialize(rows.select("id", *keys), "vector_keys")
    groups = rows.groupBy("x").agg(F.count("*").alias("copies")).select("x", F.size("x").alias("dim"), "copies", *keys)
    return keyed, materialize(groups, "distinct_vectors")


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, vectors, copies) of each length in a batch of (x, dim, copies)."""
    dims, copies = batch.column("dim").to_numpy(), batch.column("copies").to_numpy()
    flat, ends = batch.column("x").flatten().to_numpy(), np.cumsum(dims)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), flat[(ends[at] - d)[:, None] + np.arange(d)], copies[at]


def _exact_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    if (int(np.abs(x.astype(float)).max(initial=0)) + 1) * int(weight.sum()) < _LONG:
        return (x * weight[:, None]).sum(axis=0).tolist()
    return [sum(w * v for w, v in zip(weight.tolist(), column)) for column in x.T.tolist()]


def fit(groups: DataFrame, components: int = COMPONENTS, by_count: bool = False) -> dict[int, Model]:
    """A model for each length of vectors; ``by_count`` weighs a distinct vector by its copies, else each counts once."""
    fitted = groups.where("dim > 0").select("x", "dim", "copies" if by_count else F.lit(1).cast("long").alias("copies"))
    sizes = {r["dim"]: int(r["n"]) for r in fitted.groupBy("dim").agg(F.sum("copies").alias("n")).where("dim > 0").limit(MAX_NUMBERS).collect()}
    if sum(d * d for d in sizes) > MAX_NUMBERS:
        raise ValueError(f"covariances of {len(sizes)} lengths of vectors need more than {MAX_NUMBERS} numbers")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            for d, x, weight in _matrices(batch):
                total[d] = [a + b for a, b in zip(total.get(d, [0] * d), _exact_sums(x, weight))]
        for d, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()),
                                              pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["dim", "at", "s"])

    summed = fitted.mapInArrow(add_up, "dim int, at int, s decimal(38,0)").groupBy("dim", "at").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    sums: dict[int, list[int]] = {d: [0] * d for d in sizes}
    for r in summed.collect():
        sums[r["dim"]][r["at"]] = int(r["s"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x, weight in _matrices(batch):
                c = _centred(x, sums[d], sizes[d])
                total[d] = total.get(d, 0) + (c * weight[:, None]).T @ c
        for d, matrix in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([TaskContext.get().partitionId()] * d, pa.int32()),
                 pa.array([row.tobytes() for row in matrix], pa.binary())], names=["dim", "at", "part", "row"])

    def merged(group: pa.Table) -> pa.Table:
        order = group.sort_by("part")
        total = sum(np.frombuffer(b.as_buffer(), float) for b in order["row"])
        return pa.table({"dim": order["dim"][:1], "at": order["at"][:1], "part": order["part"][:1], "row": pa.array([total.tobytes()], pa.binary())})

    parts, schema = fitted.mapInArrow(products, "dim int, at int, part int, row binary"), "dim int, at int, part int, row binary"
    parts = parts.groupBy("dim", "at", F.expr(f"part div {FAN_IN}")).applyInArrow(lambda key, t: merged(t), schema)
    covariance = {d: np.zeros((d, d)) for d in sizes}
    for r in parts.groupBy("dim", "at").applyInArrow(lambda key, t: merged(t), schema).collect():
        covariance[r["dim"]][r["at"]] = np.frombuffer(r["row"], float) / sizes[r["dim"]]
    out = {}
    for d, matrix in covariance.items():
        values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
        top = np.argsort(-values, kind="stable")[:components]
        chosen = vectors[:, top].T
        chosen = chosen * np.where(chosen[np.arange(len(top)), np.abs(chosen).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        out[d] = Model(sizes[d], sums[d], chosen, values[top], float(np.trace(matrix)))
    return out


def _whitened(groups: DataFrame, models: dict[int, Model]) -> DataFrame:
    """(h1, h2, copies, dim, deviation, z): each distinct vector, whitened once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d, x, copies in _matrices(batch):
                m, at = models[d], pa.array(np.flatnonzero(dims == d))
                with np.errstate(divide="ignore", invalid="ignore"):
                    z = m.centred(x) @ m.vectors.T / np.sqrt(np.where(m.usable, m.values, np.nan))
                shown = [[v if ok else None for v, ok in zip(row, m.usable)] for row in z.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h1").take(at), batch.column("h2").take(at), pa.array(copies), pa.array([d] * len(x), pa.int32()),
                     pa.array(m.deviations(x), pa.int64()), pa.array(shown, pa.list_(pa.float64()))],
                    names=["h1", "h2", "copies", "dim", "deviation", "z"])

    return groups.where("dim > 0").select("x", "dim", "copies", "h1", "h2").mapInArrow(
        run, "h1 long, h2 long, copies long, dim int, deviation long, z array<double>")


def identity_errors(whitened: DataFrame, models: dict[int, Model], by_count: bool = False) -> dict[int, float | None]:
    """For each length the largest absolute entry of the whitened vectors' covariance minus the identity."""
    most = max((len(m.values) for m in models.values()), default=0)
    w = F.col("copies") if by_count else F.lit(1)
    z = [F.get("z", F.lit(i)) for i in range(most)]
    means = {r["dim"]: r for r in whitened.groupBy("dim").agg(
        *[(F.sum(w * c) / F.sum(w)).alias(f"m{i}") for i, c in enumerate(z)], F.sum(w).alias("n")).collect()}
    if not means:
        return {}
    mean = [F.element_at(F.create_map(*[F.lit(v) for d, r in means.items() for v in (d, float(r[f"m{i}"] or 0))]), F.col("dim")) for i in range(most)]
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    found = whitened.groupBy("dim").agg(*[F.sum(w * (z[i] - mean[i]) * (z[j] - mean[j])).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in found:
        errors = [abs(r[f"c{i}_{j}"] / means[r["dim"]]["n"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None]
        out[r["dim"]] = max(errors, default=None)
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
           by_count: bool = False) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row and leading component.

    Rows whose vector is null or holds a null or non-finite entry are left out. Vectors of different lengths are fitted apart,
    each length with its own ``n``; a vector without entries has no component. A component without variance (one distinct
    vector, say) has a null ``whitened``, and ``explained`` is null where nothing varies. ``deviation`` is null beyond 64 bits;
    entries beyond 64 bits become the nearest long. Repeated rows and ids each get their own results. An empty table gives an
    empty one. Other columns are left out, so their names cannot clash. Vectors count as equal when 128 bits of hashes agree
    on the way back to rows; grouping is exact.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows, groups = distinct(df, id_col, vector_col, scale)
    models = fit(groups, components, by_count)
    done = materialize(_whitened(groups, models), "whitened")
    errors = identity_errors(done, models, by_count)
    facts = [(d, i + 1, m.n, float(e) / m.trace if m.trace > 0 else None, errors.get(d)) for d, m in models.items() for i, e in enumerate(m.values)]
    facts = spark.createDataFrame(facts, "dim int, component int, n long, explained double, identity_error double")
    # A vector with many copies meets its rows in several tasks; the threshold keeps the list of such vectors within HOT_KEYS.
    some = max(COLD_ROWS, -(-(done.agg(F.sum("copies")).first()[0] or 0) // HOT_KEYS))
    times = F.ceil(F.col("copies") / some).cast("int")
    hot = done.where(F.col("copies") > some).select("h1", "h2", times.alias("times"))
    salted = rows.join(F.broadcast(hot), ["h1", "h2"], "left").select(
        "id", "h1", "h2", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.coalesce("times", F.lit(1))).cast("int").alias("salt"))
    copies = done.withColumn("salt", F.explode(F.sequence(F.lit(0), times - 1)))
    back = salted.join(copies, ["h1", "h2", "salt"]).select("id", "dim", "deviation", F.posexplode("z").alias("at", "whitened"))
    return (back.withColumn("component", F.col("at") + 1).join(F.broadcast(facts), ["dim", "component"])
            .select(F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error"))
