"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is cut into segments; its embedding holds each segment's number of set bits.
The Manhattan distance of two embeddings is never more than the Hamming distance of the
fingerprints, so pairs within ``distance`` bits are within that Manhattan distance. The
grid for the range join: the coordinates are dealt to ``groups`` groups; a distance of d
leaves all but d groups untouched, so two such points share a grid cell, the exact
coordinates in ``groups - d`` groups, for at least one choice of groups. Points meet by
cell; pairs with too large a Manhattan distance go, the others are verified bit by bit.

Fingerprints are made distinct first, so copies cost nothing. Pairs in a cell are not
listed: a cell yields a spanning forest of its verified links, which has fewer links than
fingerprints and the same connected components. A cell of more than ``BLOCK`` fingerprints
is worked on as pairs of blocks by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import components, settle

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENT = 2
GROUPS = 6
BLOCK = 4096


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the lower-cased words' shingles; 0 for a text without words."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) <= k:
        return h64(b" ".join(words), seed)
    parts = [words[j:] for j in range(k)]
    join = b" ".join
    hashes = np.array([h64(join(s), seed) for s in zip(*parts)], dtype="<u8")
    total = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 14):
        some = hashes[a : a + (1 << 14)]
        total += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; null texts have none of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).cast(pa.large_binary())
            made = np.fromiter((fingerprint(x.as_py() or b"", k, seed) for x in data), dtype=np.uint64, count=len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    ids = docs.select(F.col("doc_id").cast("long"), text)
    return ids.mapInArrow(run, "doc_id long, fp long")


def embed(fp: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Bit counts of each segment, a row per fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), 8), axis=1, bitorder="little")
    return bits.reshape(len(fp), BITS // segment, segment).sum(axis=2, dtype=np.uint8)


def grid_cells(fp: np.ndarray, segment: int = SEGMENT, groups: int = GROUPS, distance: int = DISTANCE) -> np.ndarray:
    """A cell number per choice of groups (rows) and fingerprint (columns).

    The number is a hash of the choice and the coordinates; cells that meet by chance only
    cost a comparison.
    """
    points = embed(fp, segment).astype(np.uint64)
    owner = np.arange(points.shape[1]) * groups // points.shape[1]
    base = np.uint64(segment + 1)
    codes = np.zeros((groups, len(fp)), dtype=np.uint64)
    for j in range(points.shape[1]):
        codes[owner[j]] = codes[owner[j]] * base + points[:, j]
    cells = []
    for number, chosen in enumerate(combinations(range(groups), groups - distance)):
        h = np.full(len(fp), (number + 1) * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
        for g in chosen:
            h = (h ^ codes[g]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        cells.append(h)
    return np.stack(cells)


def _cell_rows(batches: Iterator[pa.RecordBatch], segment: int, groups: int, distance: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        cells = grid_cells(fp, segment, groups, distance)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells.ravel().view(np.int64)), pa.array(np.tile(fp, len(cells)).view(np.int64))], names=["cell", "fp"]
        )


def close(a: np.ndarray, b: np.ndarray, distance: int = DISTANCE, segment: int = SEGMENT) -> np.ndarray:
    """Which pairs are within ``distance`` bits; the Manhattan bound is looked at first."""
    apart = np.abs(embed(a, segment).view(np.int8) - embed(b, segment).view(np.int8))
    near = np.flatnonzero(apart.sum(axis=1, dtype=np.int64) <= distance)
    out = np.zeros(len(a), dtype=bool)
    out[near] = np.bitwise_count(a[near] ^ b[near]) <= distance
    return out


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Spanning forest over links of ``n`` nodes that come in blocks."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for left, right in links:
        # Links inside one tree are of no use; most go here without a loop.
        tops = np.array([root(i) for i in range(n)])
        useful = tops[left] != tops[right]
        for i, j in zip(left[useful].tolist(), right[useful].tolist()):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _linked_pairs(x: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within the distance, a few rows at a time."""
    step = max(1, (1 << 19) // len(x))
    total = np.bitwise_count(x).astype(np.int16)
    for a in range(0, len(x), step):
        # The bit count as a whole is the coarsest Manhattan bound; then the embedding's.
        i, j = np.nonzero(np.abs(total[a : a + step, None] - total[None, :]) <= distance)
        i += a
        i, j = i[i < j], j[i < j]
        good = close(x[i], x[j], distance)
        yield i[good], j[good]


def _link_cells(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links inside each (cell, x, y); rows come sorted by these, and a run may span batches."""
    held = np.zeros((4, 0), dtype=np.int64)
    for batch in batches:
        t = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
        t = np.concatenate([held, t], axis=1)
        begin = _run_starts(t)
        held = t[:, begin[-1] :] if len(begin) else t
        if len(begin) > 1:
            yield _links_of(t[3, : begin[-1]], begin[:-1], distance)
    if held.shape[1]:
        yield _links_of(held[3], _run_starts(held), distance)


def _run_starts(t: np.ndarray) -> np.ndarray:
    if not t.shape[1]:
        return np.zeros(0, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero((t[:3, 1:] != t[:3, :-1]).any(axis=0)) + 1])


def _links_of(signed: np.ndarray, begin: np.ndarray, distance: int) -> pa.RecordBatch:
    size = np.diff(np.concatenate([begin, [len(signed)]]))
    fp = signed.view(np.uint64)
    left, right = [], []
    # Most cells hold two or three fingerprints; those go at once.
    for d in (1, 2):
        i = np.concatenate([begin[size == n] + k for n in (2, 3) for k in range(n - d)])
        i = i[close(fp[i], fp[i + d], distance)]
        left.append(signed[i])
        right.append(signed[i + d])
    for b, n in zip(begin[size > 3], size[size > 3]):
        x = fp[b : b + n]
        tree = np.array(_forest(n, _linked_pairs(x, distance)), dtype=np.int64).reshape(-1, 2)
        left.append(signed[b + tree[:, 0]])
        right.append(signed[b + tree[:, 1]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def fingerprint_links(points: DataFrame, distance: int = DISTANCE, segment: int = SEGMENT, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """(a, b) links between distinct fingerprints of a stored table ``points`` (fp).

    The links connect whatever Hamming distances up to ``distance`` connect, and each is
    within that distance. Cells with more than ``block`` fingerprints are dealt to pairs of
    blocks, so that a task compares two blocks at most.
    """
    if not 0 < distance < groups:
        raise ValueError("the distance must be less than the number of groups")
    cells = settle(points.mapInArrow(lambda it: _cell_rows(it, segment, groups, distance), "cell long, fp long"), "cells")
    shared = cells.groupBy("cell").agg(F.count("*").alias("_n")).where("_n > 1")
    met = cells.join(shared, "cell").withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    own = F.pmod(F.hash("fp", F.lit(5)), F.col("_blocks"))
    dealt = met.withColumn("_own", own).select(
        "cell",
        "fp",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least("_own", o).alias("x"), F.greatest("_own", o).alias("y")))).alias("_p"),
    ).select("cell", F.col("_p.x").cast("long").alias("x"), F.col("_p.y").cast("long").alias("y"), "fp")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = dealt.repartition(parts, "cell", "x", "y").sortWithinPartitions("cell", "x", "y", "fp")
    return sorted_rows.mapInArrow(lambda it: _link_cells(it, distance), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``distance``
    differing bits. Texts without words, null ones too, have fingerprint zero and are linked
    like any other. A null doc_id is never the smallest unless its component has no other.
    Repeated rows share their component. Other columns are not read; no rows give no rows.
    """
    prints = settle(fingerprints(docs, text), "fingerprints")
    points = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    links = fingerprint_links(points.select("fp"), distance)
    joined = components(links)
    named = points.join(joined.select(F.col("node").alias("fp"), F.col("component").alias("_c")), "fp", "left").withColumn(
        "_c", F.coalesce("_c", "fp")
    )
    least = named.groupBy("_c").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "_c").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The document of each component with the smallest doc_id; all columns of ``docs``.

    Rows that repeat a doc_id are one document and stay together; exact de-duplication
    leaves one of them.
    """
    stay = near_duplicates(docs, text).groupBy("component_id").agg(F.count("*").alias("_n")).select(F.col("component_id").alias("_stay"))
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stay"]), "left_semi")
