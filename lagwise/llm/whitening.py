"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never formed. A block of some more vectors than wanted
components is multiplied by V in passes over the data: each task adds up ``X' (X Q)`` of its
centred rows, and only blocks of dimension x width meet. A Chebyshev polynomial, by its
three-term recurrence, damps the part of the spectrum below the block and lets the wanted
part grow; QR and a Rayleigh-Ritz step turn the block to its best approximations. Pairs
whose residual is at the level of rounding are locked, and the iteration ends when all
wanted pairs are. The lower end of the spectrum, which the polynomial needs, comes from a
Lanczos vector that rides along in the same passes.

Entries become whole numbers, ``floor(64 * c) + 1000000``, so sums and mean are exact, and
each row is centred as ``(n * x - S) / n`` without cancellation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import acosh, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import settle

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
CLIP = 2**52  # entries beyond are cut off there; doubles hold whole numbers up to it
SEED = 11
TOLERANCE = 1e-13  # residual of a pair over its eigenvalue
DEGREE = 12
GROWTH = 1e8  # most that a filter may blow up one wanted direction over the others
PATIENCE = 60  # passes, before the block is widened
DIRECT = 16  # partial sums that the driver adds up itself
ROWS = "vec_id, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """Mean (as ``total / n``), components as columns, their variances, and the trace."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only, all of the commonest length
    (of the longer one in a tie)."""
    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    fine = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(~bad)
    top = fine.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return fine.where(F.size(vector) == (top["d"] if top else 0))


def whole_numbers(df: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """Stored rows (vec_id, x): the usable vectors as 64-bit whole numbers end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            d = int(values.value_lengths()[0].as_py()) if len(values) else 1
            c = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(SCALE * c), -CLIP, CLIP).astype("<i8") + SHIFT
            off = np.arange(0, 8 * d * len(values) + 1, 8 * d, dtype=np.int64) if len(values) else np.zeros(1, np.int64)
            rows = pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(off), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), rows.cast(pa.binary())], names=["vec_id", "x"])

    some = usable(df, vector).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    kind = some.schema["vec_id"].dataType.simpleString()
    return settle(some.mapInArrow(run, f"vec_id {kind}, x binary"), "vectors")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """The x of a batch as a matrix."""
    column = batch.column(batch.schema.get_field_index("x"))
    if not len(column):
        return np.zeros((0, 0), dtype=np.int64)
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype="<i8")
    return flat.reshape(len(column), -1)


def summed(vectors: DataFrame, local: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: str, tasks: int) -> np.ndarray:
    """The sum over all rows of ``local`` of each batch; a table of tasks is added up on
    executors first, in about its square root of lots, if it is long."""

    def add(parts: Iterator[np.ndarray]) -> bytes:
        out = np.zeros(shape, dtype=kind)
        for part in parts:
            out += part
        return out.tobytes()

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"part": [add(local(_rows(b)) for b in batches if b.num_rows)]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (np.frombuffer(p, dtype=kind).reshape(shape) for b in batches for p in b.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"part": [add(parts)]})

    sums = vectors.select("x").mapInArrow(batchwise, "part binary")
    if tasks > DIRECT:
        sums = sums.repartition(max(8, isqrt(tasks))).mapInArrow(merged, "part binary")
    out = np.zeros(shape, dtype=kind)
    for row in sums.collect():
        out += np.frombuffer(row["part"], dtype=kind).reshape(shape)
    return out


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``n * x - S``, exact: 64-bit where that holds them, else Python's whole numbers."""
    most = n * max(int(np.abs(x).max(initial=0)), 1) + max((abs(s) for s in total), default=0)
    if most < 2**63:
        return n * x - np.array(total, dtype=np.int64)
    return n * x.astype(object) - np.array(total, dtype=object)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return deviations(x, n, total).astype(np.float64) / n


class Covariance:
    """Multiplies blocks by the covariance; each product is one pass over the vectors."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors
        parts = vectors.select(F.spark_partition_id().alias("p"))
        spread = parts.agg(F.count("*").alias("n"), F.count_distinct("p").alias("tasks")).first()
        self.n, self.tasks = spread["n"], spread["tasks"]
        first = vectors.select("x").first()
        self.d = len(first["x"]) // 8 if first else 0
        self.passes = 0
        # High and low halves of the entries are added up apart, so that no sum leaves 64 bits.
        halves = summed(vectors, lambda x: np.stack([(x >> 26).sum(axis=0), (x & (2**26 - 1)).sum(axis=0)]), (2, self.d), "<i8", self.tasks)
        self.total = [(int(a) << 26) + int(b) for a, b in halves.T]

    def trace(self) -> float:
        n, total = self.n, self.total
        squares = summed(self.vectors, lambda x: (centred(x, n, total) ** 2).sum(axis=0), (self.d,), "<f8", self.tasks)
        return float(squares.sum() / n)

    def times(self, block: np.ndarray) -> np.ndarray:
        n, total = self.n, self.total
        self.passes += 1

        def local(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, total)
            return c.T @ (c @ block)

        return summed(self.vectors, local, block.shape, "<f8", self.tasks) / n

    def spread(self, block: np.ndarray) -> np.ndarray:
        """Covariance of the rows projected on ``block``, centred once more."""
        n, total, k = self.n, self.total, block.shape[1]

        def local(x: np.ndarray) -> np.ndarray:
            w = centred(x, n, total) @ block
            return np.concatenate([w.T @ w, w.sum(axis=0, keepdims=True)])

        sums = summed(self.vectors, local, (k + 1, k), "<f8", self.tasks) / n
        return sums[:k] - np.outer(sums[k], sums[k])


class Floor:
    """A Lanczos vector that bounds the lower end of the spectrum, one step per pass."""

    def __init__(self, d: int, rng: np.random.Generator):
        q = rng.standard_normal(d)
        self.basis, self.alpha, self.beta = [q / np.linalg.norm(q)], [], []

    @property
    def vector(self) -> np.ndarray:
        return self.basis[-1]

    def step(self, image: np.ndarray) -> None:
        if len(self.alpha) == len(self.basis):
            return
        self.alpha.append(float(self.vector @ image))
        q = np.array(self.basis)
        for _ in range(2):
            image = image - q.T @ (q @ image)
        self.beta.append(float(np.linalg.norm(image)))
        if len(self.basis) < len(image) and self.beta[-1] > 1e-10 * max(map(abs, self.alpha)):
            self.basis.append(image / self.beta[-1])

    def bound(self) -> float:
        if len(self.alpha) < 3:
            return 0.0
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - self.beta[-1])


def ritz(q: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values (falling), vectors, their images and residuals of the block ``q``."""
    small = q.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q, image = q @ turn, image @ turn
    return values, q, image, np.linalg.norm(image - q * values, axis=0)


def leading(cov: Covariance, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors, certified by their residuals.

    The block has half as many vectors more than are wanted, eight at least. A spectrum with
    more near-equal values than that around the last wanted one would converge slowly: each
    ``PATIENCE`` passes without an end, the block doubles, up to all dimensions, where one
    Rayleigh-Ritz step is exact.
    """
    d, rng = cov.d, np.random.default_rng(seed)
    k, width = min(k, d), min(d, k + max(8, k // 2))
    floor = Floor(d, rng)
    locked, q = np.zeros((d, 0)), np.linalg.qr(rng.standard_normal((d, width)))[0]
    since, scale = 0, 0.0

    def times(block: np.ndarray) -> np.ndarray:
        out = cov.times(np.column_stack([block, floor.vector]))
        floor.step(out[:, -1])
        return out[:, :-1]

    while True:
        values, q, image, residual = ritz(q, times(q))
        scale = max(scale, float(values[0]))
        limit = np.maximum(TOLERANCE * values, 64 * np.finfo(float).eps * scale)
        missing = k - locked.shape[1]
        good = residual <= limit
        if good[:missing].all() or locked.shape[1] + q.shape[1] >= d:
            break
        # Pairs lock from the top, so that none is taken before a larger one.
        done = int(np.argmin(good)) if not good.all() else missing - 1
        locked, q, values, image = np.column_stack([locked, q[:, :done]]), q[:, done:], values[done:], image[:, done:]
        if cov.passes - since > PATIENCE:
            since = cov.passes
            more = rng.standard_normal((d, min(d - locked.shape[1], 2 * q.shape[1]) - q.shape[1]))
            q = np.linalg.qr(np.column_stack([locked, q, more]))[0][:, locked.shape[1] :]
            continue
        low, cut = floor.bound(), max(float(values[-1]), 1e-9 * scale)
        low = min(low, 0.9 * cut)
        centre, half = (cut + low) / 2, (cut - low) / 2
        far = max((values[0] - centre) / half, 1 + 1e-9)
        degree = int(min(DEGREE, max(2, np.log(2 * GROWTH) / acosh(far))))
        # Scaled recurrence: the largest wanted value stays near one.
        sigma = first = 1 / far
        before, now = q, (image - centre * q) * (sigma / half)
        for _ in range(degree - 1):
            following = 1 / (2 / first - sigma)
            before, now = now, 2 * (following / half) * (times(now) - centre * now) - sigma * following * before
            sigma = following
        for _ in range(2):
            now = now - locked @ (locked.T @ now)
            now = np.linalg.qr(now)[0]
        q = now
    # One more Rayleigh-Ritz step over all kept vectors.
    q = np.linalg.qr(np.column_stack([locked, q]))[0]
    values, q, image, residual = ritz(q, cov.times(q))
    limit = 10 * np.maximum(TOLERANCE * values[:k], 64 * np.finfo(float).eps * max(values[0], 0))
    if not (residual[:k] <= limit).all():
        raise ArithmeticError("components are not certified: residuals above rounding")
    return values[:k], q[:, :k]


def fit_whitening(vectors: DataFrame, k: int = COMPONENTS) -> Whitening:
    """Fits on a stored table of ``whole_numbers``. Components of no variance are left out."""
    cov = Covariance(vectors)
    if not cov.n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
    trace = cov.trace()
    values, found = leading(cov, k) if trace > 0 else (np.zeros(0), np.zeros((cov.d, 0)))
    real = values > 64 * cov.d * np.finfo(float).eps * values.max(initial=0)
    values, found = values[real], found[:, real]
    error = 0.0
    if len(values):
        error = float(np.abs(cov.spread(found / np.sqrt(values)) - np.eye(len(values))).max())
    return Whitening(cov.n, cov.total, found, values, trace, error, cov.passes)


def project(vectors: DataFrame, fit: Whitening) -> DataFrame:
    """A row per vector and component. ``deviation`` is null where 64 bits cannot hold it."""
    n, total, k = fit.n, fit.total, len(fit.values)
    turn, explained, error = fit.components / np.sqrt(fit.values), fit.explained if k else np.zeros(0), fit.identity_error

    def distance(away: np.ndarray) -> list:
        if away.dtype != object and int(np.abs(away).max(initial=0)) ** 2 * away.shape[1] < 2**63:
            return (away * away).sum(axis=1).tolist()
        sums = (away.astype(object) ** 2).sum(axis=1)
        return [s if s < 2**63 else None for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            away = deviations(_rows(batch), n, total)
            white = (away.astype(np.float64) / n) @ turn
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)), pa.array(distance(away), pa.int64()).take(each), pa.array(white.ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=[f.split()[0] for f in ROWS.split(", ")],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "x").mapInArrow(run, ROWS.replace("vec_id", f"vec_id {kind}", 1))


def whiten(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error).

    Vectors that are null or empty, hold null or non-finite entries, or have another length
    than most are left out, of the fit too. Repeated rows and null ids are rows like others. Fewer
    dimensions than components give as many rows per vector as there are dimensions with
    any variance; a single vector, or equal ones, have none and give no rows. Each vector is
    stored once, in 8 bytes a dimension; other columns are not read.
    """
    vectors = whole_numbers(df, vector, vec_id)
    return project(vectors, fit_whitening(vectors, components))
