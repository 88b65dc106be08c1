"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

Vectors become whole numbers, ``floor(scale * c) + offset``. The covariance V is that of the *fit list*:
each distinct vector once, with divisor n. V is never formed. A product V B with a block of a few columns is
one pass over the stored fit list: tasks centre their vectors, multiply, and add up a small block each.

* A search space of orthonormal columns is kept with its products. Rayleigh-Ritz in it gives the leading
  pairs and their residuals.
* For the pairs that have not converged, the correction equation ``(1 - UU')(V - e)(1 - UU') t = -r``, U being
  all leading vectors, is solved to ``INNER`` steps by MINRES, for all of them at once: a step is one pass.
  The corrections widen the space; at ``SPACE`` times the wanted columns it is cut back to its leading ones.
* The largest pairs whose residuals are below ``TOLERANCE`` of the largest eigenvalue, a few units of double
  precision, are locked: the space goes on without them. When all are locked, or the space is whole, a last
  Rayleigh-Ritz on the locked ones sets the order.

Centring takes whole parts off before any rounding, so large offsets cost no digits. Columns, at most a few
dozen of the vectors' length, are all that reaches the driver.

Defined results: a row whose vector is missing or empty, or has a missing or non-finite component, gives no
rows; nor does one whose vector is not as long as most are (the shorter of two lengths equally common), or has
a component of more than 2^40 in whole numbers. Zero vectors take part. Repeated rows and rows without id are
transformed, each by itself. Components whose eigenvalue is below ``RANK`` of the largest are not given, so a
table of equal vectors, or of one, gives no rows, as does an empty one. ``deviation`` is missing where it does
not fit a long. Only the id and the vector are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.storage import staged
from tabloom.llm.batches import _quoted

COMPONENTS, SCALE, OFFSET = 16, 64.0, 1_000_000
TOLERANCE, RANK = 2e-14, 1e-13
INNER, SPACE, MOST_ROUNDS = 6, 4, 200
LARGEST = 1 << 40
#: Vectors of a stored batch of the fit list.
PACK = 4096


def whole(rows: DataFrame, *, key: str, embedding: str, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x): usable vectors as bytes of whole numbers. Stored."""
    v = F.col(_quoted(embedding))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale + offset) < float(LARGEST))
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, fine), F.lit(False))
    source = rows.where(usable).select(F.col(_quoted(key)).alias("id"), v.cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            x = (np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False)) + offset).astype(np.int64)
            ends = 8 * np.cumsum(batch.column(1).value_lengths().to_numpy())
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], names=["id", "x"])

    kind = source.schema["id"].dataType.simpleString()
    return staged(source.mapInArrow(run, f"id {kind}, x binary"), "whole")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


@dataclass
class FitList:
    """The distinct vectors, packed, with their number and the sum of each dimension."""

    packed: DataFrame
    dim: int
    n: int
    sums: list[int]

    @classmethod
    def of(cls, vectors: DataFrame) -> FitList | None:
        lengths = vectors.groupBy(F.octet_length("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
        if lengths is None:
            return None
        dim = lengths["size"] // 8
        distinct = vectors.where(F.octet_length("x") == lengths["size"]).select("x").distinct()

        def pack(batches):
            for batch in batches:
                for at in range(0, len(batch), PACK):
                    x = batch.column(0).slice(at, PACK).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([b"".join(x)], pa.binary())], names=["n", "x"])

        packed = staged(distinct.mapInArrow(pack, "n long, x binary"), "fit-list")
        # Tasks as many as keep the cores busy: each adds up all it reads before anything moves.
        packed = packed.coalesce(4 * packed.sparkSession.sparkContext.defaultParallelism)

        def total(batches):
            out = [0] * dim
            for batch in batches:
                for raw in batch.column(1).to_pylist():
                    out = [a + int(b) for a, b in zip(out, np.frombuffer(raw, np.int64).reshape(-1, dim).sum(axis=0))]
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(out, pa.int64())], names=["i", "s"])

        sums = {r.i: int(r.s) for r in packed.mapInArrow(total, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
        return cls(packed, dim, packed.agg(F.sum("n")).first()[0], [sums[i] for i in range(dim)])

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and fraction of the mean: taking the first off a whole number rounds nothing."""
        return np.array([s // self.n for s in self.sums]), np.array([(s % self.n) / self.n for s in self.sums])

    def reduced(self, fn, size: int) -> np.ndarray:
        """The sum over the fit list of ``fn(centred vectors)``, an array of ``size`` numbers."""
        dim, (low, rest) = self.dim, self.centre()

        def run(batches):
            out = np.zeros(size)
            for batch in batches:
                for raw in batch.column(1).to_pylist():
                    out += fn((np.frombuffer(raw, np.int64).reshape(-1, dim) - low) - rest).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(out)], names=["i", "v"])

        sums = self.packed.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        out = np.zeros(size)
        for r in sums.collect():
            out[r.i] = r.v
        return out

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of columns."""
        return self.reduced(lambda c: c.T @ (c @ block), block.size).reshape(block.shape) / self.n

    def trace(self) -> float:
        return float(self.reduced(lambda c: np.array([(c**2).sum()]), 1)[0]) / self.n


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns of the block made orthonormal, also to ``against``; those that add nothing are left out."""
    out = against
    for column in block.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            column = column - out @ (out.T @ column)
        left = np.linalg.norm(column)
        if size > 0 and left > 1e-10 * size:
            column = column / left
            column = column - out @ (out.T @ column)
            out = np.concatenate([out, (column / np.linalg.norm(column))[:, None]], axis=1)
    return out[:, against.shape[1] :]


def minres(apply, b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of a symmetric equation for every column of ``b``, all columns step by step."""
    ratio = lambda a, d: np.divide(a, d, out=np.zeros_like(a), where=np.abs(d) > 1e-300)
    beta = np.linalg.norm(b, axis=0)
    least = 1e-15 * beta
    v, before = ratio(b, np.broadcast_to(beta, b.shape)), np.zeros_like(b)
    x, w, w_before = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    cos, cos_before, sin, sin_before = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    rest, last = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        y = apply(v)
        alpha = (v * y).sum(axis=0)
        y = y - alpha * v - last * before
        beta = np.linalg.norm(y, axis=0)
        # The new column of the tridiagonal matrix, turned by the two rotations before.
        top, middle = sin_before * last, cos_before * last
        middle, low = cos * middle + sin * alpha, -sin * middle + cos * alpha
        size = np.hypot(low, beta)
        cos_new, sin_new = ratio(low, size), ratio(beta, size)
        w_new = ratio(v - middle * w - top * w_before, np.broadcast_to(size, v.shape))
        x = x + cos_new * rest * w_new
        rest = -sin_new * rest
        cos_before, sin_before, cos, sin = cos, sin, cos_new, sin_new
        w_before, w = w, w_new
        before, v, last = v, ratio(y, np.broadcast_to(beta, y.shape)), beta
        if (np.abs(rest) <= least).all():
            break
    return x


def leading(product, dim: int, wanted: int = COMPONENTS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, of the symmetric ``product``, and their unit vectors."""
    wanted = min(wanted, dim)
    some = min(dim, wanted + 4)
    locked, locked_product, values = np.zeros((dim, 0)), np.zeros((dim, 0)), []
    space = orthonormal(np.random.default_rng(dim).normal(size=(dim, some)), locked)
    mapped = product(space)
    for _ in range(MOST_ROUNDS):
        small = space.T @ mapped
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, mapped = space @ turn, mapped @ turn
        missing = wanted - len(values)
        count = min(missing, space.shape[1])
        u, e = space[:, :count], theta[:count]
        residual = mapped[:, :count] - u * e
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        scale = max(abs(e[0]) if len(e) else 0.0, *(abs(v) for v in values[:1]), 1e-300)
        done = size <= tolerance * scale
        whole_space = space.shape[1] + locked.shape[1] >= dim
        ready = count if whole_space else (count if done.all() else int(np.argmin(done)))
        locked = np.concatenate([locked, u[:, :ready]], axis=1)
        locked_product = np.concatenate([locked_product, mapped[:, :ready]], axis=1)
        values += e[:ready].tolist()
        if len(values) >= wanted:
            break
        u, e, residual = u[:, ready:], e[ready:], residual[:, ready:]
        space, mapped = space[:, ready:], mapped[:, ready:]
        if space.shape[1] + u.shape[1] > SPACE * wanted:
            space, mapped = space[:, :some], mapped[:, :some]
        frame = np.concatenate([locked, u], axis=1)
        aside = lambda t: t - frame @ (frame.T @ t)
        open_ = ~done[ready:]
        shift = e[open_]
        correction = minres(lambda t: aside(product(aside(t)) - aside(t) * shift), -aside(residual[:, open_]), INNER)
        wider = orthonormal(aside(correction), np.concatenate([locked, space], axis=1))
        if not wider.shape[1]:
            wider = orthonormal(np.random.default_rng(dim + len(values)).normal(size=(dim, 1)), np.concatenate([locked, space], axis=1))
        space, mapped = np.concatenate([space, wider], axis=1), np.concatenate([mapped, product(wider)], axis=1)
    else:
        raise ArithmeticError(f"{wanted - len(values)} of {wanted} eigenpairs did not converge in {MOST_ROUNDS} rounds")
    small = locked.T @ locked_product
    theta, turn = np.linalg.eigh((small + small.T) / 2)
    vectors = locked @ turn[:, ::-1]
    vectors /= np.linalg.norm(vectors, axis=0)
    return theta[::-1], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


@dataclass
class Whitening:
    """Components of a fit list: eigenvalues, unit vectors, and how far whitened vectors are from uncorrelated."""

    fit: FitList
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @classmethod
    def of(cls, fit: FitList, components: int = COMPONENTS) -> Whitening:
        values, vectors = leading(fit.product, fit.dim, components)
        keep = values > RANK * max(values[0], 1e-300)
        values, vectors = values[keep], vectors[:, keep]
        scaled, k = vectors / np.sqrt(values), len(values)

        def moments(c: np.ndarray) -> np.ndarray:
            z = c @ scaled
            return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

        error = 0.0
        if k:
            found = fit.reduced(moments, k + k * k) / fit.n
            error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
        return cls(fit, values, vectors, fit.trace(), error)

    def transform(self, vectors: DataFrame, key: str) -> DataFrame:
        """For each vector and component: the whitened value beside what holds of all."""
        n, dim, k = self.fit.n, self.fit.dim, len(self.values)
        low, rest = self.fit.centre()
        remainder = np.array([s % n for s in self.fit.sums], object)
        scaled, explained, error = self.vectors / np.sqrt(self.values), self.values / (self.trace or 1.0), self.identity_error

        def deviations(x: np.ndarray) -> list[int | None]:
            apart = x - low
            if n * (int(np.abs(apart).max()) + 1) < (1 << 31) // (int(dim**0.5) + 1):
                return ((n * apart - remainder.astype(np.int64)) ** 2).sum(axis=1).tolist()
            exact = ((apart.astype(object) * n - remainder) ** 2).sum(axis=1)
            return [v if v < 1 << 63 else None for v in exact]

        def run(batches):
            for batch in batches:
                x = _matrix(batch.column(1), dim)
                take = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(take)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(take), n)),
                        pa.array(deviations(x), pa.int64()).take(pa.array(take)),
                        pa.array((((x - low) - rest) @ scaled).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(take), error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        kind = vectors.schema["id"].dataType.simpleString()
        schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        if not k:
            return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", key)
        same = vectors.where(F.octet_length("x") == 8 * dim)
        return same.mapInArrow(run, schema).withColumnRenamed("id", key)


def whiten(rows: DataFrame, *, key: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on all distinct vectors of the table and transform all its rows."""
    vectors = whole(rows, key=key, embedding=embedding)
    fit = FitList.of(vectors)
    if fit is None:
        kind = vectors.schema["id"].dataType.simpleString()
        schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], schema)
    return Whitening.of(fit, components).transform(vectors, key)
