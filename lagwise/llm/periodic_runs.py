"""Maximal periodic runs of words, and texts with each run collapsed to one period.

A run of exponent ``e`` with period ``q`` matches itself, ``q`` words on, over at least
``(e - 1) * q`` words. So for every period the positions of a grid of that width are enough:
over all periods they are a harmonic sum, n log n pairs. A pair whose words agree is
extended to both sides, by longest common extensions over a difference cover
(``cover``), and is a run if the stretch is long enough. A stretch found for a multiple of
its period has the same borders, so the smallest period of equal stretches is kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.bytewise import slices
from lagwise.llm.cover import COVER, CoverExtensions

LEAST = 6
EXPONENT = 4
PAIRS = 1 << 20  # grid pairs at a time
TOGETHER = 1 << 20  # bytes of text at a time; a longer text comes alone
RUN = "struct<start:long,length:long,period:long>"

Alter = Callable[[object, int], np.ndarray | None]


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Coded texts end to end, each between values of its own, and where each begins."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    out = -1 - np.arange(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    for a, t in zip(begin.tolist(), texts):
        out[a : a + len(t)] = t
    return out, begin


def grid(sizes: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period, width) of the grid pairs (place, place + period) of all texts."""
    periods = sizes // exponent
    text = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    width = np.maximum(1, np.maximum(least - q, (exponent - 1) * q))
    pairs = np.maximum(0, (sizes[text] - q - 1) // width + 1)
    upto = np.cumsum(pairs)
    a = 0
    while a < len(q):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        n = pairs[a:b]
        which = np.repeat(np.arange(a, b), n)
        nth = np.arange(len(which)) - np.repeat(upto[a:b] - n - done, n)
        yield text[which], nth * width[which], q[which], width[which]
        a = b


def _close(words: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """Equal words from i and j on in one direction, up to ``COVER``."""
    out = np.zeros(len(i), dtype=np.int64)
    live = np.arange(len(i))
    for t in range(COVER):
        live = live[words[i[live] + step * t] == words[j[live] + step * t]]
        out[live] = t + 1
        if not len(live):
            break
    return out


def find_runs(texts: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) of all runs in texts of whole numbers >= 0, sorted."""
    words, begin = joined(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    found = [np.zeros((0, 4), dtype=np.int64)]
    cover: tuple = ((), None)
    for text, place, q, width in grid(sizes, least, exponent):
        at = begin[text] + place
        same = words[at] == words[at + q]
        text, at, q, width = text[same], at[same], q[same], width[same]
        # Few pairs go on for long; for most, the nearest words decide.
        ahead, back = _close(words, at, at + q, 1), _close(words, at - 1, at + q - 1, -1)
        far = np.flatnonzero((ahead == COVER) | (back == COVER))
        if len(far):
            some = np.unique(text[far])
            if cover[0] != tuple(some):
                sub, first = joined([texts[k] for k in some])
                cover = tuple(some), (sub, first, CoverExtensions(sub), CoverExtensions(sub[::-1]))
            sub, first, forward, backward = cover[1]
            x = at[far] - begin[text[far]] + first[np.searchsorted(some, text[far])]
            y = x + q[far]
            ahead[far] = forward.common(x, y)
            back[far] = backward.common(len(sub) - x, len(sub) - y)
        run = ahead + back >= width
        start = at[run] - back[run] - begin[text[run]]
        found = [_distinct(np.concatenate([*found, np.stack([text[run], start, ahead[run] + back[run] + q[run], q[run]], axis=1)]))]
    return found[0]


def _distinct(runs: np.ndarray) -> np.ndarray:
    """One row per stretch, of the smallest period, by text, start and period."""
    by = np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))
    runs = runs[by]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay when each run (start, length, period) keeps its first period."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:n]) == 0


def _run_column(runs: np.ndarray, n: int) -> pa.Array:
    off = np.searchsorted(runs[:, 0], np.arange(n + 1)).astype(np.int32)
    fields = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(off), fields)


def periodic_runs(
    docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT, alter: Alter | None = None
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed_text), a row per row of ``docs``.

    ``runs`` holds every maximal run of at least ``least`` words and ``exponent`` periods,
    by start, then period; ``collapsed_text`` the words outside the runs' repeats, joined by
    one space. Null and empty texts have no words, no runs and an empty text. Rows are
    independent: repeated ones get equal results. ``alter`` (doc_id, number of words) may
    say which words to take in whose place before anything else. Other columns are not
    read; no rows give no rows. Memory follows the longest text, about 300 bytes a word of
    it; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), TOGETHER):
                yield _collapsed(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), least, exponent, alter)

    rows = docs.select("doc_id", F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed_text string")


def _collapsed(ids: pa.Array, texts: pa.Array, least: int, exponent: int, alter: Alter | None) -> pa.RecordBatch:
    code: dict[bytes, int] = defaultdict(count().__next__)
    words, coded = [], []
    for doc, data in zip(ids.to_pylist(), texts.cast(pa.large_binary()).to_pylist()):
        w = (data or b"").split()
        c = np.fromiter(map(code.__getitem__, w), dtype=np.int64, count=len(w))
        taken = alter(doc, len(w)) if alter else None
        if taken is not None:
            w, c = [w[k] for k in taken.tolist()], c[taken]
        words.append(w)
        coded.append(c)
    runs = find_runs(coded, least, exponent)
    edge = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
    out = []
    for k, w in enumerate(words):
        mine = runs[edge[k] : edge[k + 1], 1:]
        if len(mine):
            w = [w[p] for p in np.flatnonzero(kept_words(len(w), mine)).tolist()]
        out.append(b" ".join(w))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(c) for c in coded], pa.int64()), _run_column(runs, len(words)), pa.array(out, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed_text"],
    )


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each document and digests of all its runs and of what is left."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.s").alias("start"), (-F.col("_best.n")).alias("length"),
        F.col("_best.p").alias("period"), F.floor(F.lit(-1000) * F.col("_best.n") / F.col("_best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
