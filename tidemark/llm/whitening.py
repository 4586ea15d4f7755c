"""Embedding whitening: leading components of the covariance by block Jacobi-Davidson, whose products with the covariance are sums over the distributed vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A vector's entry c becomes floor(_SCALE * c) + _SHIFT.
_SCALE, _SHIFT = 1024, 100_000
#: Partial sums are added by tasks of this number before the driver adds theirs.
_BRANCHES = 32
_OUTER, _INNER = 60, 6
Product = Callable[[np.ndarray], np.ndarray]


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): x holds floor(1024 * c) + 100000 of every entry as 64-bit integers, in bytes. Rows whose vector is null or holds a null or a number that is not finite are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).cast(pa.list_(pa.float64()))
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, values)))])
            fine = (bad[ends[1:]] == bad[ends[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore"):
                x = (np.floor(_SCALE * values)).astype(np.int64) + _SHIFT
            kept = np.flatnonzero(fine)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), pa.array([x[ends[k] : ends[k + 1]].tobytes() for k in kept], pa.binary())], ["vec_id", "x"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(work, f"vec_id {kind}, x binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, d)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for part in b.column(0).to_pylist():
            v = np.frombuffer(part, float)
            total = v.copy() if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])


def _sum(x: DataFrame, work: Callable[[Iterator[np.ndarray]], np.ndarray], d: int) -> np.ndarray:
    """work() of each task's centred blocks, added up: one array for each task, then for each branch, then on the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = work(_matrix(b.column(0), d) for b in batches if b.num_rows)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()])], ["part"])

    parts = x.select("x").mapInArrow(part, "part binary")
    if x.rdd.getNumPartitions() > _BRANCHES:
        parts = parts.repartition(_BRANCHES).mapInArrow(_added, "part binary")
    return sum(np.frombuffer(r.part, float) for r in parts.collect())


def covariance_product(x: DataFrame, n: int, sums: np.ndarray) -> Product:
    """U -> V U without V: every task centres its vectors, (n x - S) / n, and adds up their outer effect on the columns of U."""
    d = len(sums)

    def product(u: np.ndarray) -> np.ndarray:
        def work(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
            total = None
            for block in blocks:
                centred = (n * block - sums) / n
                one = centred.T @ (centred @ u)
                total = one if total is None else total + one
            return total

        return np.asarray(_sum(x, work, d)).reshape(u.shape) / n

    return product


def _minres(product: Product, right: np.ndarray, shifts: np.ndarray, project: Product, steps: int, goal: float) -> np.ndarray:
    """Approximate solutions t of P (V - shift) P t = right, a column each, all columns advancing with one product a step (Paige and Saunders' recurrences)."""
    k = right.shape[1]
    out = np.zeros_like(right)
    v_old, v = np.zeros_like(right), right.copy()
    beta = np.linalg.norm(v, axis=0)
    first = beta.copy()
    live = beta > 0
    v[:, live] /= beta[live]
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    c_old, c, s_old, s = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    eta, beta = beta.copy(), np.zeros(k)
    for _ in range(steps):
        if not live.any():
            break
        y = project(product(v) - v * shifts) - v_old * beta
        alpha = np.sum(v * y, axis=0)
        y -= v * alpha
        new = np.linalg.norm(y, axis=0)
        r1 = c * alpha - c_old * s * beta
        r2 = s * alpha + c_old * c * beta
        r3 = s_old * beta
        size = np.hypot(r1, new)
        turn = live & (size > 0)
        div = np.where(turn, size, 1.0)
        c_old, s_old = c, s
        c, s = np.where(turn, r1 / div, 1.0), np.where(turn, new / div, 0.0)
        w_new = (v - w_old * r3 - w * r2) / div
        out += np.where(turn, c * eta * w_new, 0.0)
        eta = np.where(turn, -s * eta, eta)
        w_old, w = w, w_new
        live = turn & (np.abs(eta) > goal * first) & (new > 1e-14 * np.abs(shifts))
        v_old, v, beta = v, np.where(live, y / np.where(new > 0, new, 1.0), 0.0), new
    return out


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """new's columns made orthonormal and orthogonal to basis, twice over; columns that depend on others go."""
    kept: list[np.ndarray] = []
    for col in new.T:
        size = np.linalg.norm(col)
        if not size:
            continue
        col = col / size
        for _ in range(3):
            col = col - basis @ (basis.T @ col)
            for q in kept:
                col = col - q * (q @ col)
            left = np.linalg.norm(col)
            if left < 1e-10:
                break
            col = col / left
        else:
            kept.append(col)
    return np.array(kept).T.reshape(len(new), -1)


def leading_components(product: Product, d: int, want: int, seed: int = 7, outer: int = _OUTER, inner: int = _INNER) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the symmetric d x d operator `product`, the `want` largest (d at most).

    Block Jacobi-Davidson. A search space is kept with its products; Rayleigh-Ritz inside it gives candidates. A
    candidate whose residual is down at rounding level is locked; for the others the correction equation, projected
    clear of locked vectors and candidates, is solved by a few steps of MINRES, all at once, and the corrections widen
    the space. A space that fills up is restarted from its best candidates.
    """
    want = min(want, d)
    rng = np.random.default_rng(seed)
    space = np.linalg.qr(rng.standard_normal((d, min(d, want + 2))))[0]
    image = product(space)
    most = min(d, max(8 * want, 24))
    values, vectors = np.zeros(want), np.zeros((d, want))
    history: list[float] = []
    for step in range(outer):
        inside = space.T @ image
        values_all, turn = np.linalg.eigh((inside + inside.T) / 2)
        order = np.argsort(-values_all)
        ritz, turn = values_all[order], turn[:, order]
        values, vectors = ritz[:want], space @ turn[:, :want]
        residual = image @ turn[:, :want] - vectors * values
        sizes = np.linalg.norm(residual, axis=0)
        scale = max(float(np.abs(ritz[0])), np.finfo(float).tiny)
        # locked: at rounding level of the largest eigenvalue
        locked = sizes <= 16 * np.finfo(float).eps * scale
        history.append(float(sizes.max()))
        # rounding in the products themselves may end a little above it: then further steps change nothing
        stalled = history[-1] <= 1e-12 * scale and len(history) > 3 and history[-1] > 0.5 * min(history[-4:-1])
        if locked.all() or stalled or space.shape[1] == d:
            break
        if space.shape[1] + want > most and space.shape[1] > want + 4:
            keep = turn[:, : min(want + 4, turn.shape[1])]
            space, image = space @ keep, image @ keep
        open_ = np.flatnonzero(~locked)
        near = vectors

        def project(y: np.ndarray, near=near) -> np.ndarray:
            return y - near @ (near.T @ y)

        goal = max(1e-3 * 0.1**step, 1e-8)
        correction = _minres(product, project(-residual[:, open_]), values[open_], project, inner, goal)
        new = _orthonormal(np.concatenate([correction, residual[:, open_]], axis=1)[:, : len(open_)], space)
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((d, 1)), space)
            if not new.shape[1]:
                break
        space, image = np.concatenate([space, new], axis=1), np.concatenate([image, product(new)], axis=1)
    for j in range(want):  # the sign is free: the largest entry is made positive
        if vectors[np.argmax(np.abs(vectors[:, j])), j] < 0:
            vectors[:, j] = -vectors[:, j]
    return values, vectors


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows with a null vector, a null entry or one that is not finite are left out. All vectors left are the fit list and
    are whitened, repeated ones each; ids of any type, null too, are handed on. Vectors must be of one length: where
    there are several, the most frequent one counts (of equally frequent ones the longest) and the rest is left out.
    Components without variance (an eigenvalue at rounding level, as with fewer vectors than components) have no rows, so
    an empty table, a single vector or equal vectors give none. A deviation beyond a 64-bit integer is null.

    Vectors are packed once into a table; every product with the covariance is a pass over it, and only sums of a
    vector's size times the number of columns leave the tasks.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    out = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    packed = materialize(integer_vectors(rows, id_col, vector_col), "whiten")
    lengths = packed.groupBy(F.octet_length("x").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).first()
    if lengths is None or not lengths.bytes:
        return rows.sparkSession.createDataFrame([], out)
    d, n = lengths.bytes // 8, lengths["count"]
    x = packed.filter(F.octet_length("x") == lengths.bytes)

    def totals(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for block in blocks:
            one = block.sum(axis=0)
            total = one if total is None else total + one
        # two halves, so that doubles hold the sums exactly
        return None if total is None else np.concatenate([total >> 26, total & ((1 << 26) - 1)]).astype(float)

    halves = np.asarray(_sum(x, totals, d))
    sums = np.array([int(h) * (1 << 26) + int(l) for h, l in zip(halves[:d], halves[d:], strict=True)], object)
    if max(abs(int(s)) for s in sums) >= 1 << 62:
        raise OverflowError("sums of entries beyond 64-bit integers")
    sums = sums.astype(np.int64)
    product = covariance_product(x, n, sums)

    def variance(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        found = [(((n * b - sums) / n) ** 2).sum() for b in blocks]
        return np.array([math.fsum(found)]) if found else None

    trace = float(_sum(x, variance, d)[0]) / n
    values, vectors = leading_components(product, d, components)
    real = values > 1e-12 * max(trace, np.finfo(float).tiny)
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return rows.sparkSession.createDataFrame([], out)
    scaled = vectors / np.sqrt(values)
    k = len(values)

    def squares(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for block in blocks:
            y = ((n * block - sums) / n) @ scaled
            one = np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])
            total = one if total is None else total + one
        return total

    moments = np.asarray(_sum(x, squares, d)) / n
    mean = moments[k * k :]
    error = float(np.abs(moments[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    explained = values / trace
    names = [f.split(" ")[0] for f in out.split(", ")]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                if not part.num_rows:
                    continue
                gap = n * _matrix(part.column(1), d) - sums
                y = (gap / n) @ scaled
                if float(np.abs(gap).max()) ** 2 * d < 2**62:
                    deviation = (gap * gap).sum(axis=1).tolist()
                else:
                    deviation = [s if s < 1 << 63 else None for s in (sum(int(g) ** 2 for g in row) for row in gap)]
                m = part.num_rows
                again = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(again),
                        pa.array(y.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ], names,
                )

    return x.select("vec_id", "x").mapInArrow(rows_of, out)
