"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers (entry c to floor(64 c) + 1000000), and the distinct ones are the fit list. A block of vectors
is driven to the leading eigenvectors of the fit list's covariance V: every product of V and the block is one distributed
pass that sums the centred rows' parts; a Chebyshev polynomial of V, by its three-term recurrence, damps what lies below the
block's least Ritz value; QR and a Rayleigh-Ritz step follow, until the residuals of the components certify them (or stop
falling, at the limit of double precision). Only blocks of dimensions x block width, added up by tasks first where there are
many, reach the driver.

Defined cases: a row is left out if its vector is null, empty, holds a null or a non-finite entry, or has another length
than most vectors of the table (ties: the greater length); entries beyond a long's range take its end; null vec_ids and
repeated rows are kept; components with no variance (under 1e-12 of the first) are not returned, so a table of one distinct
vector or none gives no rows; ``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.common import materialize, table

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Vectors of the block beyond the components asked for; the wider, the greater the gap and the fewer passes.
GUARD = 16
DEGREE = 8
MOST_ROUNDS = 60
#: Residual, over the greatest eigenvalue, at which a component is certified.
CERTIFIED = 1e-13
LEAST_VARIANCE = 1e-12
FIT_ROWS_A_TASK = 100_000
#: Partial sums that the driver adds up itself; more are added up by tasks.
DIRECT_SUMS = 64


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that remain, x as packed little-endian longs."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    clean = rows.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & good)
    sizes = clean.groupBy(F.size("v").alias("d")).count().groupBy().agg(F.max(F.struct("count", "d")).alias("most")).select("most.d").first()
    d = sizes.d or 0

    def packed(batches):
        for batch in batches:
            c = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                low = np.floor(c * SCALE)
            x = np.clip(low, -(2.0**62), 2.0**62).astype("<i8") + SHIFT
            at = pa.array(np.arange(batch.num_rows + 1) * 8 * d, pa.int32())
            made = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, at.buffers()[1], pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), made], ["vec_id", "x"])

    kind = clean.schema["vec_id"].dataType.simpleString()
    return clean.where(F.size("v") == d).mapInArrow(packed, f"vec_id {kind}, x binary")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The longs of a batch, a row for each vector."""
    column = batch.column("x")
    if not len(column):
        return np.zeros((0, 1), np.int64)
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, "<i8").reshape(len(column), -1)


class FitList:
    """The distinct vectors, written once, and the sums over them that a pass gives."""

    def __init__(self, vectors: DataFrame):
        distinct = vectors.select("x").distinct()
        counted = materialize(distinct, "fit-list")
        self.n = counted.count()
        tasks = max(1, -(-self.n // FIT_ROWS_A_TASK))
        few = tasks < counted.rdd.getNumPartitions()
        self.rows = counted.coalesce(tasks) if few else counted
        self.parts = min(tasks, counted.rdd.getNumPartitions())
        self.totals: list[int] = []
        if self.n:
            self.totals = self._column_sums()
            self.mean = np.array([s // self.n + (s % self.n) / self.n for s in self.totals])

    def _column_sums(self) -> list[int]:
        """Exact sums: halves of the numbers are added apart, so none overflows."""

        def sums(batches):
            high, low = 0, 0
            for batch in batches:
                x = _matrix(batch)
                if len(x):
                    high, low = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
            if not np.isscalar(high):
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([high, low]).astype("<i8").tobytes()], pa.binary())], ["part"])

        d = None
        total: list[int] = []
        for r in self._few(self.rows.mapInArrow(sums, "part binary"), np.int64).collect():
            both = [int(v) for v in np.frombuffer(r.part, "<i8")]
            d = len(both) // 2
            total = total or [0] * d
            total = [t + (h << 32) + lo for t, h, lo in zip(total, both[:d], both[d:], strict=True)]
        return total

    def _few(self, parts: DataFrame, kind) -> DataFrame:
        if self.parts <= DIRECT_SUMS:
            return parts

        def added(batches):
            total = None
            for batch in batches:
                for part in batch.column("part"):
                    own = np.frombuffer(part.as_buffer(), kind)
                    total = own.copy() if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        return parts.repartition(int(self.parts**0.5)).mapInArrow(added, "part binary")

    def summed(self, f) -> np.ndarray:
        """The sum over all rows of ``f`` of the centred rows (a matrix), flat."""
        mean, whole = self.mean, np.round(self.mean).astype(np.int64)

        def sums(batches):
            total = None
            for batch in batches:
                x = _matrix(batch)
                for a in range(0, len(x), 8192):  # the whole part is taken off exactly, the rest in doubles
                    own = f((x[a : a + 8192] - whole).astype(float) - (mean - whole))
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, float).tobytes()], pa.binary())], ["part"])

        return sum(np.frombuffer(r.part) for r in self._few(self.rows.mapInArrow(sums, "part binary"), np.float64).collect())

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q."""
        return self.summed(lambda c: c.T @ (c @ q)).reshape(q.shape) / self.n


class Whitening:
    """The leading components of a fit list: ``values`` falling, ``vectors`` as columns, ``trace`` of V."""

    def __init__(self, fit: FitList, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE):
        self.fit, self.values, self.vectors, self.trace, self.rounds = fit, np.zeros(0), np.zeros((0, 0)), 0.0, 0
        d = len(fit.totals)
        if fit.n < 2:
            return
        self.trace = float(fit.summed(lambda c: np.array([(c * c).sum()]))[0]) / fit.n
        if self.trace <= 0:
            return
        width = min(d, components + guard)
        asked = min(d, components)
        q, _ = np.linalg.qr(np.random.default_rng(13).normal(size=(d, width)))
        vq = fit.times(q)
        best = np.inf
        for self.rounds in range(1, MOST_ROUNDS + 1):
            # Rayleigh-Ritz in the block
            small = q.T @ vq
            e, w = np.linalg.eigh((small + small.T) / 2)
            e, w = e[::-1], w[:, ::-1]
            q, vq = q @ w, vq @ w
            wrong = np.abs(np.linalg.norm(vq - q * e, axis=0)[:asked]).max() / e[0]
            stalled = wrong > best / 2 and wrong < 1e-11
            best = min(best, wrong)
            if wrong <= CERTIFIED or stalled or width == d and self.rounds > 1:
                break
            # a Chebyshev polynomial that is at most one on [0, least Ritz value], and grows fast above
            if width < d and e[-1] > 0:
                half = e[-1] / 2
                scale = e[0] / half - 1
                sigma = first = 1 / scale
                before, now = q, (vq - half * q) * (sigma / half)
                for _ in range(degree - 1):
                    after = 1 / (2 / first - sigma)
                    before, now = now, (2 * after / half) * (fit.times(now) - half * now) - sigma * after * before
                    sigma = after
                q, _ = np.linalg.qr(now)
            else:
                q, _ = np.linalg.qr(q)
            vq = fit.times(q)
        kept = e[:asked] > LEAST_VARIANCE * e[0]
        self.values, self.vectors = e[:asked][kept], q[:, :asked][:, kept]
        self.residual = wrong

    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def identity_error(self) -> float:
        """The largest absolute entry of the whitened fit list's covariance minus the identity, centred before multiplying."""
        p, n = self.projection(), self.fit.n
        mean = self.fit.summed(lambda c: (c @ p).sum(0)) / n
        gram = self.fit.summed(lambda c: (c @ p - mean).T @ (c @ p - mean)).reshape(p.shape[1], -1) / n
        return float(np.abs(gram - np.eye(len(gram))).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each remaining row and component."""
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = materialize(whole_vectors(rows, id_col, vector_col), "whole-vectors")
    fit = FitList(vectors)
    made = Whitening(fit, components)
    k = len(made.values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    n, totals, mean, p = fit.n, fit.totals, fit.mean, made.projection()
    explained, error, whole = made.values / made.trace, made.identity_error(), np.round(fit.mean).astype(np.int64)
    rest = [s - n * int(w) for s, w in zip(totals, whole, strict=True)]  # S less n times the whole part

    def deviations(x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2."""
        near = x - whole
        if n * (float(np.abs(near).max()) + 1) < 2.0**30 / len(totals) ** 0.5:  # squares and their sum fit a long
            return ((near * n - np.array(rest)) ** 2).sum(1).tolist()
        exact = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in near.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def whitened(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                own = batch.slice(a, 4096)
                x = _matrix(own)
                rows_ = len(x)
                w = ((x - whole).astype(float) - (mean - whole)) @ p
                repeat = np.repeat(np.arange(rows_), k)
                made_ = [own.column("vec_id").take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * k, n)), pa.array(deviations(x), pa.int64()).take(pa.array(repeat)), pa.array(w.ravel()), pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * k, error))]
                yield pa.RecordBatch.from_arrays(made_, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(whitened, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
