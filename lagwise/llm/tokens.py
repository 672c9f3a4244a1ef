"""Token ids by a public tokenizer, word by word through a bounded cache."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 400_000
LONG_WORD = 256  # code points; longer words are not kept
TOGETHER = 1 << 12  # code points of new words that are encoded in one call
STOPS = ".,;:!?"
# Words of these letters are one pre-token each, whatever their case, and composed already.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{1,64}")


def _byte_signs() -> dict[int, str]:
    """The letters above as the signs that byte-level models write for their UTF-8 bytes:
    bytes of visible Latin-1 characters stand for themselves, the others count on from 256."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    sign = {b: chr(b) for b in seen}
    sign |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in sign)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


BYTE_SIGNS = _byte_signs()


@dataclass
class Found:
    """Ids end to end, and first place and number of each word's ids."""

    ids: np.ndarray
    begin: np.ndarray
    size: np.ndarray


class WordCache:
    """Ids of a text as those of its words between ASCII white space.

    That is exact for tokenizers whose normaliser and pre-tokenizer drop white space and
    never look across it. Encoded words are kept, about twice ``CACHE_WORDS`` of them: a
    full generation replaces the one before it. New words are encoded many at a time, with
    a space between, and told apart by where each token starts. Control strings in texts
    are plain text. ASCII words are lower-cased first, as the tokenizer does, and stops that
    follow a letter or digit are looked up apart, as its pre-tokenizer cuts there. Words of
    Latin letters go to the model's merges directly.
    """

    _shared: dict[str, WordCache] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> WordCache:
        """One cache per worker process, kept from task to task."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def ids(self, text: bytes, end: int | None = None) -> np.ndarray:
        """Ids of a text, with ``end`` after them if it is given."""
        flat, _ = self.ids_of(pa.array([text], pa.large_binary()).cast(pa.large_string()))
        return flat if end is None else np.append(flat, np.array([end], dtype="<u4"))

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin and end.

        Nothing is done once per word: words are told apart by Arrow, looked up once per
        distinct word, and the ids gathered with numpy.
        """
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        core, closing = _parted(words.dictionary)
        n = [self._looked_up(part) for part in (core, closing)]
        # Ids of distinct words: those of the core, then those of the closing stops.
        both = np.stack([n[0].size, n[1].size], axis=1).ravel()
        source = np.stack([n[0].begin, n[1].begin + len(n[0].ids)], axis=1).ravel()
        pool = np.concatenate([n[0].ids, n[1].ids])
        known = pool[_spread(source, both)]
        size = n[0].size + n[1].size
        begin = np.cumsum(size) - size
        index = words.indices.to_numpy(zero_copy_only=False)
        per_word = size[index]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        flat = known[_spread(begin[index], per_word)]
        off = np.asarray(split.offsets)
        return flat, ends[off - off[0]]

    def _looked_up(self, words: pa.Array) -> Found:
        """Ids of each of ``words``, which may repeat."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.known.get, distinct))
        missing = [w for w, ids in zip(distinct, found) if ids is None]
        if missing:
            new = self._learn(missing)
            found = [new[w] if ids is None else ids for w, ids in zip(distinct, found)]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        begin = np.cumsum(size) - size
        index = coded.indices.to_numpy(zero_copy_only=False)
        return Found(np.frombuffer(b"".join(found), dtype="<u4"), begin[index], size[index])

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that the young generation lacks; it takes them in."""
        found = {w: self.old.get(w) for w in words}
        rest = []
        for w in [w for w, ids in found.items() if ids is None]:
            if LATIN.fullmatch(w):
                found[w] = array("I", [t.id for t in self.merges.tokenize(w.lower().translate(BYTE_SIGNS))]).tobytes()
            else:
                rest.append(w)
        for some in _lots(rest):
            found.update(zip(some, self._encode(some)))
        if len(self.known) + len(found) > CACHE_WORDS:
            self.known, self.old = {"": b""}, self.known
        self.known.update((w, ids) for w, ids in found.items() if len(w) <= LONG_WORD)
        return found

    def _encode(self, words: list[str]) -> list[bytes]:
        made = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(made.ids, dtype="<u4").tobytes()
        if len(words) == 1:
            return [ids]
        ends = np.cumsum([len(w) + 1 for w in words])
        edge = 4 * np.searchsorted(np.array([a for a, _ in made.offsets], dtype=np.int64), ends)
        return [ids[a:b] for a, b in zip([0, *edge[:-1].tolist()], edge.tolist())]


def _lots(words: list[str]) -> Iterator[list[str]]:
    lot, size = [], 0
    for w in words:
        if lot and size + len(w) > TOGETHER:
            yield lot
            lot, size = [], 0
        lot.append(w)
        size += len(w) + 1
    if lot:
        yield lot


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each entry, ``size`` of them, end to end."""
    upto = np.cumsum(size)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(begin - upto + size, size)


def _parted(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word as a core and the stops that close it, if a stop follows a letter or digit
    and the word is ASCII; other words are all core."""
    words = words.cast(pa.large_string())
    plain = pc.string_is_ascii(words)
    words = pc.if_else(plain, pc.ascii_lower(words), words)
    core = pc.ascii_rtrim(words, characters=STOPS)
    cut = pc.and_(plain, pc.match_substring_regex(core, "[a-z0-9]$"))
    core = pc.if_else(cut, core, words)
    whole, kept = (np.asarray(pc.binary_length(a)) for a in (words, core))
    off = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words)]
    size = whole - kept
    raw = np.frombuffer(words.buffers()[2], dtype=np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = raw[_spread(off + kept, size)]
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    closing = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(bounds), pa.py_buffer(data.tobytes())])
    return core, closing
