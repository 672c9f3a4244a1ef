"""Packing tokenised documents into fixed windows by non-negative least squares.

A document's ids are cut into full windows and one rest. Rests are counted by length in
units of ``GRID`` tokens. Combinations of up to three lengths that fill a window exactly are
enumerated; non-negative least squares finds how often to repeat each so that the histogram
is met; the counts are rounded down to what is there, what is left is solved again, and the
rest packed greedily, largest first, again by length and count. The driver only ever sees the histogram, whose
size is set by the window and not by the data.

Each piece then finds its sequence by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.bytewise import slices
from lagwise.llm.common import ranked, settle
from lagwise.llm.tokens import WordCache

WINDOW = 4096
GRID = 4
END = 2
SEED = 23
SOLVES = 6  # times that what is left is solved again
TOGETHER = 8 << 20  # bytes of text that are told apart at once
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, text: str = "text") -> DataFrame:
    """Pieces of every document's ids, the end id included: full windows and one rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache.shared(tokenizer)
        end = np.array([END], dtype="<u4")
        for batch in batches:
            out: list[tuple] = []
            for a, b in slices(batch.column(1), TOGETHER):
                flat, off = cache.ids_of(batch.column(1).slice(a, b - a))
                bounds = off.tolist()
                for doc, first, last in zip(batch.column(0).slice(a, b - a).to_pylist(), bounds, bounds[1:]):
                    ids = np.concatenate([flat[first:last], end])
                    for at in range(0, len(ids), window):
                        part = ids[at : at + window]
                        out.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, PIECES)


def combinations(units: int, present: np.ndarray) -> np.ndarray:
    """All (i, j, k) with i >= j >= k >= 0 that sum to ``units``, of present lengths only."""
    have = np.flatnonzero(present)
    have = have[have > 0]
    ok = np.zeros(units + 1, dtype=bool)
    ok[have] = True
    ok[0] = True
    found = []
    for i in have[have >= -(-units // 3)]:
        j = np.arange(-(-(units - i) // 2), min(i, units - i) + 1)
        k = units - i - j
        fits = ok[j] & ok[k]
        found.append(np.stack([np.full(fits.sum(), i), j[fits], k[fits]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def nnls(combos: np.ndarray, histogram: np.ndarray, tolerance: float = 1e-3, most: int = 3000) -> np.ndarray:
    """Repeat counts >= 0 that meet the histogram in least squares: projected gradient steps
    with momentum, until 25 steps change no usage by more than ``tolerance`` of all pieces or
    ``most`` steps are done (a coarser solution is still a valid plan). The matrix is held as
    the three lengths of each column."""
    n, size = len(combos), len(histogram)
    x = np.zeros(n)
    if not n:
        return x
    flat = combos.ravel()
    target = histogram.astype(np.float64)
    target[0] = 0

    def usage(v):
        u = np.bincount(flat, np.repeat(v, 3), size)
        u[0] = 0
        return u

    probe = np.ones(n)
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = usage(probe)[combos].sum(axis=1)
        norm = np.linalg.norm(probe)
        probe /= norm
    look, momentum = x, 1.0
    last = usage(x)
    for step in range(most):
        if step % 25 == 24:
            used = usage(x)
            if np.abs(used - last).sum() <= tolerance * target.sum():
                break
            last = used
        residual = usage(look) - target
        residual[0] = 0
        new = np.maximum(look - residual[combos].sum(axis=1) / (1.05 * norm), 0)
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / faster * (new - x)
        x, momentum = new, faster
    return x


def plan(histogram: np.ndarray, units: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences; every counted piece is in exactly one.

    Least squares may promise a length to more combinations than there are pieces; counts are
    rounded down and taken while pieces last, and what is left is solved again while that
    fills a good part of it. Should the greedy step alone need fewer sequences, its plan is
    taken.
    """
    solved = _Taken(histogram)
    solved.take((units,), int(solved.left[units]))
    for _ in range(SOLVES):
        before = int(solved.left.sum())
        combos = combinations(units, solved.left > 0)
        repeats = np.floor(nnls(combos, solved.left) + 1e-6).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] <= 0:
                break
            solved.take(tuple(int(v) for v in combos[i] if v), int(repeats[i]))
        if before - int(solved.left.sum()) < before // 8:
            break
    plain = _Taken(histogram)
    return min((_greedy(t, units) for t in (solved, plain)), key=lambda rows: sum(n for _, n in rows))


class _Taken:
    """Sequences so far, and pieces that are left by length."""

    def __init__(self, histogram: np.ndarray):
        self.left, self.rows = histogram.astype(np.int64).copy(), []

    def take(self, lengths: tuple[int, ...], most: int) -> None:
        used, times = np.unique(lengths, return_counts=True)
        n = min(most, int((self.left[used] // times).min()))
        if n > 0:
            self.left[used] -= n * times
            self.rows.append((lengths, n))


def _greedy(taken: _Taken, units: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs what is left, largest first, each time as often as it can be repeated."""
    while taken.left[1:].any():
        lengths, room, free = [], units, taken.left.copy()
        while True:
            fits = np.flatnonzero(free[1 : room + 1]) + 1
            if not len(fits):
                break
            lengths.append(int(fits[-1]))
            free[fits[-1]] -= 1
            room -= int(fits[-1])
        taken.take(tuple(lengths), int(taken.left.max()))
    return taken.rows


def places(sequences: list[tuple[tuple[int, ...], int]], units: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence) per use of a length."""
    rank, at, out = np.zeros(units + 1, dtype=np.int64), 0, []
    for lengths, n in sequences:
        for length in dict.fromkeys(lengths):
            times = lengths.count(length)
            out.append((length, int(rank[length]), int(rank[length]) + times * n, times, at))
            rank[length] += times * n
        at += n
    return out


def pack(found: DataFrame, window: int = WINDOW, grid: int = GRID, seed: int = SEED) -> DataFrame:
    """Sequence and offset for a stored table of pieces."""
    spark = found.sparkSession
    units = window // grid
    sized = found.withColumn("_u", F.ceil(F.col("length") / grid).cast("int"))
    counts = sized.groupBy("_u").agg(F.count("*").alias("_n")).collect()  # at most ``units`` rows
    histogram = np.zeros(units + 1, dtype=np.int64)
    for r in counts:
        histogram[r["_u"]] = r["_n"]
    schema = "_u int, _a long, _b long, _times long, _base long"
    table = spark.createDataFrame(places(plan(histogram, units), units), schema)
    sizes = spark.createDataFrame([(r["_u"], r["_n"]) for r in counts], "_u int, _n long")
    # ``sizes`` has a row per length in use; ``table`` a row per use of a length in a
    # combination: at most 3 * units^2 / 12 of them and the greedy rest, whatever the data.
    rows = sized.join(F.broadcast(sizes), "_u")
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32")]
    at = ranked(rows, ["_u"], "_n", order, seed, "_rank")
    placed = at.join(F.broadcast(table), "_u").where("_rank >= _a and _rank < _b").withColumn(
        "sequence_id", F.col("_base") + F.floor((F.col("_rank") - F.col("_a")) / F.col("_times"))
    )
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order, "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, grid: int = GRID, text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    A null or empty text is one piece of one id, the end id. Repeated rows are documents of
    their own; their pieces are alike but for the place. Columns other than doc_id and the
    text are not read; no rows give no rows. ``window`` is a multiple of ``grid``.
    """
    if window % grid:
        raise ValueError("the window must be a multiple of the grid")
    return pack(settle(pieces(docs, tokenizer, window, text), "pieces"), window, grid)
