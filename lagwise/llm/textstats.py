"""Measurements of texts, whole texts at a time and vectorised over a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lagwise.llm.bytewise import gram_hashes, inside_text, mix, per_group, slices, texts_of, word_hashes, words_of

SYMBOLS = "#*$%&|<>"
# Name and meaning of each measurement, in the order of the struct's fields.
MEASURES = {
    "n_words": "words",
    "word_chars": "code points in words",
    "n_symbols": f"characters among {SYMBOLS}",
    "n_dup_lines": "lines with a word that equal an earlier line",
    "n_repeat_words": "words in 3-word windows found twice or more",
    "n_lines": "lines with a word",
    "n_upper": "characters A to Z",
    "n_exclaim": "exclamation marks",
    "n_digits": "characters 0 to 9",
    "n_ends": "full stops, exclamation and question marks",
    "n_punct": "other ASCII punctuation",
    "n_upper_words": "words with two or more of A-Z and none of a-z",
    "n_long_words": "words over 24 bytes",
    "n_distinct": "distinct words",
    "n_rare_bytes": "control characters other than white space",
    "n_first_lower": "words that start with a-z",
}
SCHEMA = "struct<" + ", ".join(f"{n}: bigint" for n in MEASURES) + ">"


def _table(chars) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[c if isinstance(c, int) else ord(c) for c in chars]] = True
    return t


_SYMBOL, _UPPER, _LOWER, _DIGIT = (
    _table(SYMBOLS), _table(range(65, 91)), _table(range(97, 123)), _table("0123456789"),
)
_END = _table(".!?")
_PUNCT = _table([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in SYMBOLS + ".!?"])
_CONTROL = _table([*range(0, 9), *range(14, 32), 127])


def _measure(column: pa.Array) -> list[np.ndarray]:
    t = texts_of(column)
    w = words_of(t)
    raw, text = t.raw, w.text
    h = word_hashes(t, w)
    counts = np.diff(w.off)
    inside = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=inside[1:])
    chars = inside[w.start + w.length] - inside[w.start]

    grams = gram_hashes(h, 3)
    own = inside_text(w.off, w.n, 3)
    at = np.flatnonzero(own)
    key = mix(grams[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    twice = at[_repeated(key)]
    covered = np.zeros(w.n, dtype=bool)
    for j in range(3):
        covered[twice + j] = True

    word_key = mix(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.sort(word_key)
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = order[1:] != order[:-1]
    # Distinct words per text: first occurrences, found through a stable sort.
    by = np.argsort(word_key, kind="stable")
    is_first = np.zeros(w.n, dtype=bool)
    is_first[by[fresh]] = True

    def in_words(flags):
        upto = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(flags, out=upto[1:])
        return upto[w.start + w.length] - upto[w.start]

    upper, lower = _UPPER[raw], _LOWER[raw]
    shouted = (in_words(upper) >= 2) & (in_words(lower) == 0)
    lines = np.zeros(t.n, dtype=np.int64)
    again = np.zeros(t.n, dtype=np.int64)
    data = raw.tobytes()
    for i in range(t.n):
        found = [x for x in data[t.off[i] : t.off[i + 1]].split(b"\n") if x.strip()]
        lines[i] = len(found)
        again[i] = len(found) - len(set(found))
    return [
        counts,
        per_group(chars, w.off),
        t.sums(_SYMBOL[raw]),
        again,
        per_group(covered, w.off),
        lines,
        t.sums(upper),
        t.sums(raw == ord("!")),
        t.sums(_DIGIT[raw]),
        t.sums(_END[raw]),
        t.sums(_PUNCT[raw]),
        per_group(shouted, w.off),
        per_group(w.length > 24, w.off),
        per_group(is_first, w.off),
        t.sums(_CONTROL[raw]),
        per_group(lower[w.start], w.off) if w.n else np.zeros(t.n, dtype=np.int64),
    ]


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which entries occur more than once."""
    if not len(key):
        return np.zeros(0, dtype=bool)
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    out = np.zeros(len(key), dtype=bool)
    out[by[1:][same]] = True
    out[by[:-1][same]] = True
    return out


def measure_array(column: pa.Array) -> pa.StructArray:
    """All measurements of each text as a struct array; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    parts = [_measure(column.slice(a, b - a)) for a, b in slices(column)]
    made = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64) for _ in MEASURES]
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in made], names=list(MEASURES))


def measured(text: Column) -> Column:
    """Struct column of the measurements of a text column; other columns stay in the JVM."""

    @F.arrow_udf(SCHEMA)
    def run(column: pa.Array) -> pa.Array:
        return measure_array(column)

    return run(text)
