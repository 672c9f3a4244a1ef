"""Substring de-duplication by relative Lempel-Ziv parsing over distributed reference blocks.

The reference is the corpus itself, indexed window by window: a window of ``WINDOW`` words
is dealt by its hash to one of many blocks, which keeps the first place, by (doc_id, start),
of each window dealt to it. Every document is looked up against every block that its windows
lead to. Where a window starts earlier elsewhere, the block answers with that place, and the
document is parsed greedily: a factor goes on while the next window's earlier place is the
next word of the same document, so factors are copies of ``WINDOW`` words or more. A window
that straddles two factors has been looked up like any other, so nothing is lost where a
factor ends. Words inside factors are removed.

Data moved: about ten bytes a window, once, and the texts, once, to meet the answers. Both
are dealt by hashes into parts of ``PART`` bytes of text. Windows that repeat inside a batch
of documents are settled there and travel as runs, so a passage that a third of all
documents share is one entry per batch, and no block holds more of it than there are
batches. A batch is cut into at most ``ROUTES`` rows: with more blocks than that, each row
leads to a range of blocks and is cut again at the next level, so the number of rows grows
with the input times the number of levels, not with its square. Two windows count as equal if 64 bits of one hash and their block, taken from
another, agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.bytewise import gram_hashes, inside_text, texts_of, word_hashes, words_of

WINDOW = 20
PART = 8 << 20
ROUTES = 256  # most rows of the index that a batch of documents is cut into at a time
PRIME, FACTOR = 2**31 - 1, 1_103_515_245
NO_ID = np.iinfo(np.int64).max  # a null doc_id comes after all others
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, kept_text string"


def encode(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers as compressed bytes; the first is stored as differences."""
    n = len(columns[0])
    first = np.diff(columns[0], prepend=0) if n else columns[0]
    data = b"".join(np.ascontiguousarray(c, dtype="<i8").view(np.uint8).reshape(n, 8).T.tobytes() for c in [first, *columns[1:]])
    return len(columns).to_bytes(4, "little") + n.to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def decode(data: bytes) -> list[np.ndarray]:
    k, n = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:12], "little")
    raw = pa.decompress(data[12:], decompressed_size=8 * k * n, codec="zstd", asbytes=True) if n else b""
    flat = np.frombuffer(raw, dtype=np.uint8).reshape(k, 8, n)
    columns = [np.ascontiguousarray(c.T).view("<i8").reshape(n) for c in flat]
    return [np.cumsum(columns[0]), *columns[1:]]


def earliest(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, later, of): entries that are the first place of their key, those that are not,
    and for each of the latter the first one. Entries at one place count once."""
    by = np.argsort(key, kind="stable")
    k = key[by]
    same = np.zeros(len(k), dtype=bool)
    same[1:] = k[1:] == k[:-1]
    grouped = same.copy()
    grouped[:-1] |= same[1:]
    alone, some = by[~grouped], by[grouped]
    some = some[np.lexsort((start[some], doc[some], key[some]))]
    if not len(some):
        return alone, some, some
    head = np.ones(len(some), dtype=bool)
    head[1:] = key[some][1:] != key[some][:-1]
    first = some[np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))]
    later = (doc[some] != doc[first]) | (start[some] != start[first])
    return np.concatenate([alone, some[head]]), some[later], first[later]


def factors(doc: np.ndarray, start: np.ndarray, n: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray) -> list[np.ndarray]:
    """The greedy parse: runs of windows whose earlier places run on, joined into factors."""
    by = np.lexsort((start, doc))
    doc, start, n, ref_doc, ref_start = (c[by] for c in (doc, start, n, ref_doc, ref_start))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (
        (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])
        | (ref_doc[1:] != ref_doc[:-1]) | (ref_start[1:] != ref_start[:-1] + n[:-1])
    )
    at = np.flatnonzero(new)
    length = np.add.reduceat(n, at) if len(at) else n
    return [doc[at], start[at], length, ref_doc[at], ref_start[at]]


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def _batched(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Ids and texts of up to ``limit`` bytes of text; a longer text comes alone."""
    held, size = [], 0
    for batch in batches:
        text = batch.column(1).cast(pa.large_binary())
        lengths = np.diff(texts_of(text).off)
        a = 0
        while a < len(lengths):
            b = a + max(int(not held), int(np.searchsorted(np.cumsum(lengths[a:]), limit - size, side="right")))
            if b > a:
                held.append((batch.column(0).slice(a, b - a), text.slice(a, b - a)))
                size += int(lengths[a:b].sum())
            if b < len(lengths) or size >= limit:
                yield np.concatenate([_ids(i) for i, _ in held]), pa.concat_arrays([t for _, t in held])
                held, size = [], 0
            a = b
    if held:
        yield np.concatenate([_ids(i) for i, _ in held]), pa.concat_arrays([t for _, t in held])


def _windows(ids: np.ndarray, text: pa.Array, window: int):
    """Hash, block hash, doc and start of all windows of a batch."""
    t = texts_of(text)
    w = words_of(t)
    own = np.flatnonzero(inside_text(w.off, w.n, window))
    h = word_hashes(t, w)
    a, b = gram_hashes(h, window)[own], gram_hashes(h, window, salt=1)[own]
    of = w.text[own]
    return a.view(np.int64), b, ids[of], own - w.off[of]


def _dealt(ids: np.ndarray, parts: int) -> np.ndarray:
    """Part of each identifier; ``_dealt_column`` says the same in SQL."""
    return (ids % PRIME * FACTOR + 12345) % PRIME % parts


def _dealt_column(ids: Column, parts: int) -> Column:
    return ((F.pmod(ids, F.lit(PRIME)) * FACTOR + 12345) % PRIME % F.lit(parts)).cast("int")


def spans(blocks: int, routes: int = ROUTES) -> list[int]:
    """Blocks that a route of each level leads to; the last level's routes are blocks."""
    out = [1]
    while blocks > out[-1] * routes:
        out.append(out[-1] * routes)
    return out[::-1]


def _routed(block, places, keys, known, blocks: int, span: int) -> pa.RecordBatch | None:
    """A row per route that has entries. Entries that another level will deal carry their block."""
    route, lot = block // span, _dealt(known[0], blocks) // span
    by = np.lexsort((places[1], places[0], block, route))
    ends = np.flatnonzero(np.diff(route[by], append=-1)) + 1 if len(by) else np.zeros(0, np.int64)
    mine = {int(route[by[a]]): by[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())}
    passing = {int(r): np.flatnonzero(lot == r) for r in np.unique(lot)}
    rows = []
    for r in sorted({*mine, *passing}):
        some, through = mine.get(r, by[:0]), passing.get(r, by[:0])
        columns = [places[0][some], places[1][some]] + ([block[some]] if span > 1 else [])
        rows.append((r, encode(columns), keys[some].tobytes(), encode([c[through] for c in known])))
    if not rows:
        return None
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["block", "places", "keys", "known"])


def _index_rows(batches, blocks: int, span: int, window: int, limit: int) -> Iterator[pa.RecordBatch]:
    for ids, text in _batched(batches, limit):
        key, other, doc, start = _windows(ids, text, window)
        first, later, of = earliest(key, doc, start)
        block = (other[first] % np.uint64(blocks)).astype(np.int64)
        # Answers found here only pass through a block; any block will do.
        known = factors(doc[later], start[later], np.ones(len(later), dtype=np.int64), doc[of], start[of])
        made = _routed(block, [doc[first], start[first]], key[first], known, blocks, span)
        if made is not None:
            yield made


def _reroute(batches, blocks: int, span: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The next level: entries of several batches, dealt to the routes below."""
    held, size = [], 0

    def flush():
        places = [np.concatenate(c) for c in zip(*(h[0] for h in held))]
        known = [np.concatenate(c) for c in zip(*(h[2] for h in held))]
        return _routed(places[2], places[:2], np.concatenate([h[1] for h in held]), known, blocks, span)

    for batch in batches:
        for places, keys, known in zip(*(batch.column(n).to_pylist() for n in ("places", "keys", "known"))):
            held.append((decode(places), np.frombuffer(keys, dtype=np.int64), decode(known)))
            size += len(keys)
            if size >= limit:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _parts_of(columns: list[np.ndarray], parts: int) -> pa.Table:
    """Answers dealt to the part of their document."""
    part = _dealt(columns[0], parts)
    by = np.lexsort((columns[1], columns[0], part))
    edge = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
    filled = np.flatnonzero(edge[1:] > edge[:-1]).tolist()
    rows = [(i, encode([c[by[edge[i] : edge[i + 1]]] for c in columns])) for i in filled]
    found = list(zip(*rows)) or [[], []]
    return pa.table({"part": pa.array(found[0], pa.int32()), "answers": pa.array(found[1], pa.binary())})


def _answer(table: pa.Table, parts: int) -> pa.Table:
    """A block's answers: the earlier place of every window that has one."""
    places = [decode(x.as_py()) for x in table.column("places")]
    doc, start = (np.concatenate(c) for c in zip(*places))
    key = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("keys")])
    _, later, of = earliest(key, doc, start)
    found = [doc[later], start[later], np.ones(len(later), dtype=np.int64), doc[of], start[of]]
    passing = [decode(x.as_py()) for x in table.column("known")]
    return _parts_of([np.concatenate(c) for c in zip(found, *passing)], parts)


def _cut(docs: pa.Table, answers: pa.Table, window: int, with_text: bool) -> pa.Table:
    """Removes the factors of the documents of one part."""
    found = [np.concatenate(c) for c in zip(*(decode(x.as_py()) for x in answers.column("answers")))] if len(answers) else None
    parsed = factors(*found) if found else [np.zeros(0, dtype=np.int64)] * 5
    ids = _ids(docs.column("doc_id").combine_chunks()) if len(docs) else np.zeros(0, np.int64)
    lo, hi = np.searchsorted(parsed[0], ids, side="left"), np.searchsorted(parsed[0], ids, side="right")
    out = []
    for i, (doc, text) in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("text"))):
        words = (text.cast(pa.large_binary()).as_py() or b"").split()
        n, kept = len(words), words
        if lo[i] < hi[i]:
            step = np.zeros(n + 1, dtype=np.int64)
            begin = np.minimum(parsed[1][lo[i] : hi[i]], n)
            np.add.at(step, begin, 1)
            np.add.at(step, np.minimum(begin + parsed[2][lo[i] : hi[i]] + window - 1, n), -1)
            kept = [words[j] for j in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
        text_out = b" ".join(kept)
        out.append((doc, n, n - len(kept), hashlib.sha256(text_out).hexdigest(), int(hi[i] - lo[i]), text_out.decode("utf-8", "replace")))
    fields = OUT.split(", ")[: 6 if with_text else 5]
    columns = list(zip(*out)) or [[]] * 6
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.table({f.split()[0]: pa.array(c, kinds[f.split()[1]]) for f, c in zip(fields, columns)})


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, part: int = PART, text: str = "text", with_text: bool = True, routes: int = ROUTES
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_factors[, kept_text]) per row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a
    smaller doc_id, or further up in the same document. Null doc_ids come last and count as
    one. Null and empty texts have no words; the digest is that of nothing. Rows that repeat
    a doc_id are one document: equal rows do not repeat each other. Other columns are not
    read; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # As many blocks and parts as the volume asks for.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // part))
    schema = "block int, places binary, keys binary, known binary"
    first, *below = spans(n, routes)
    index = rows.mapInArrow(lambda it: _index_rows(it, n, first, window, part), schema)
    for span in below:
        # Many tasks share a route, so that none holds all of it.
        salted = index.repartition(n, "block", F.xxhash64("keys"))
        index = salted.mapInArrow(lambda it, span=span: _reroute(it, n, span, part), schema)
    answers = (
        index.repartition(n, "block").groupBy("block").applyInArrow(lambda t: _answer(t, n), "part int, answers binary")
    )
    dealt = rows.withColumn("part", _dealt_column(F.coalesce("doc_id", F.lit(int(NO_ID))), n))
    out = OUT if with_text else OUT.rpartition(",")[0]
    return dealt.repartition(n, "part").groupBy("part").cogroup(answers.repartition(n, "part").groupBy("part")).applyInArrow(
        lambda left, right: _cut(left, right, window, with_text), out
    )
