"""Token counts that follow edits, by a segment tree of pre-token segments per document.

A text is cut into segments at safe places: between a character that is not white space and
a white-space one, where no pre-token of the byte-level pattern can reach across and no
look-ahead sees past. So a text's tokens are those of its segments. A binary tree in heap
order keeps the sums of characters and of tokens below each node; it is stored with the
document. An edit finds its segments by walking down the character sums, joins them with the
neighbours whose borders it has made unsafe, encodes that region again, and adds the change
to the nodes above. Nothing else is encoded.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import settle, unwrapped, whole
from lagwise.operators.sequence import with_positions
from lagwise.session import scratch_path

SEGMENT = 256
TREE = "struct<segments: int, chars: array<bigint>, tokens: array<bigint>>"
EDITS = "array<struct<start: bigint, length: bigint, insert: string>>"
RESULT = "struct<n_tokens: bigint, text: string, tree: " + TREE + ", reencoded_chars: bigint, n_edits: bigint>"
_CUT = re.compile(r"(?<=\S)[ \t\n\r]")


class Encoder:
    _shared: dict[tuple[str, str], Encoder] = {}

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def shared(cls, path: str, pattern: str) -> Encoder:
        if (path, pattern) not in cls._shared:
            cls._shared[path, pattern] = cls(path, pattern)
        return cls._shared[path, pattern]

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0


def split(text: str, size: int = SEGMENT) -> list[str]:
    """Segments of about ``size`` characters; a stretch without a safe place stays whole."""
    out, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + size)
        end = cut.start() if cut else len(text)
        out.append(text[at:end])
        at = end
    return out


def safe(left: str, right: str) -> bool:
    """Whether no pre-token reaches across the border of two texts that are not empty."""
    return not left[-1].isspace() and right[0] in " \t\n\r"


class SegmentTree:
    """Segments of one text under a heap of sums; leaf ``i`` is node ``width + i``."""

    def __init__(self, segments: list[str], counts: list[int], sums: tuple[list[int], list[int]] | None = None):
        self.segments = segments
        self.width = 1 << max(0, (len(segments) - 1).bit_length())
        self.reencoded = 0
        if sums:
            self.chars, self.tokens = sums
            return
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (s, n) in enumerate(zip(segments, counts)):
            self.chars[self.width + i], self.tokens[self.width + i] = len(s), n
        for node in range(self.width - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @classmethod
    def build(cls, text: str, count, size: int = SEGMENT) -> SegmentTree:
        segments = split(text, size)
        return cls(segments, [count(s) for s in segments])

    @classmethod
    def load(cls, text: str, chars: list[int], tokens: list[int], n: int) -> SegmentTree:
        width, at, segments = len(chars) // 2, 0, []
        for i in range(n):
            segments.append(text[at : at + chars[width + i]])
            at += chars[width + i]
        return cls(segments, [], (chars, tokens))

    @property
    def text(self) -> str:
        return "".join(self.segments)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` (or ends there), and the place in it."""
        node = 1
        while node < self.width:
            node *= 2
            if at > self.chars[node] or (at == self.chars[node] and self.chars[node + 1]):
                at -= self.chars[node]
                node += 1
        return node - self.width, at

    def _set(self, leaf: int, segment: str, tokens: int) -> None:
        node = self.width + leaf
        more_chars, more_tokens = len(segment) - self.chars[node], tokens - self.tokens[node]
        self.segments[leaf] = segment
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, start: int, length: int, insert: str, count, size: int = SEGMENT) -> None:
        """Replaces ``length`` characters from ``start``; both are cut to the text."""
        if not self.segments:
            self.__init__([""], [0])
        start = min(max(start, 0), self.chars[1])
        length = min(max(length, 0), self.chars[1] - start)
        first, place = self.find(start)
        last, end = self.find(start + length)
        if last < first:
            first, place = last, end
        body = self.segments[first][:place] + insert + self.segments[last][end:]
        # Neighbours join in while the border to them is not safe.
        while (before := self._beside(first, -1)) is not None and not (body and safe(self.segments[before], body)):
            body, first = self.segments[before] + body, before
        while (after := self._beside(last, 1)) is not None and not (body and safe(body, self.segments[after])):
            body, last = body + self.segments[after], after
        self.reencoded += len(body)
        if len(body) > 4 * size:
            parts = split(body, size)
            counts = [self.tokens[self.width + i] for i in range(len(self.segments))]
            new = [count(p) for p in parts]
            done = self.reencoded
            self.__init__(self.segments[:first] + parts + self.segments[last + 1 :], counts[:first] + new + counts[last + 1 :])
            self.reencoded = done
            return
        for leaf in range(first + 1, last + 1):
            self._set(leaf, "", 0)
        self._set(first, body, count(body))

    def _beside(self, leaf: int, step: int) -> int | None:
        """The next leaf on that side that is not empty."""
        leaf += step
        while 0 <= leaf < len(self.segments):
            if self.segments[leaf]:
                return leaf
            leaf += step
        return None


def with_trees(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text", out: str = "tree") -> DataFrame:
    """``docs`` with each text's tree: its segments' count and the two heaps of sums.

    A null text counts as an empty one, whose tree has no segments and sums of 0.
    """

    @F.arrow_udf(TREE)
    def build(column: pa.Array) -> pa.Array:
        count = Encoder.shared(tokenizer, pattern).count
        made = [SegmentTree.build(t or "", count) for t in column.to_pylist()]
        return pa.array([{"segments": len(t.segments), "chars": t.chars, "tokens": t.tokens} for t in made], _tree_type())

    return docs.withColumn(out, build(F.col(text)))


def _tree_type() -> pa.DataType:
    return pa.struct([("segments", pa.int32()), ("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])


def edited(text: Column, tree: Column, edits: Column, tokenizer: str, pattern: str, with_text: bool = True) -> Column:
    """Struct column of the count, text and tree after the edits, applied one after another.

    ``edits`` is an array of (start, length, insert) in characters of the text as it then
    is. Null edits, arrays and inserts do nothing or insert nothing; places outside the text
    are cut to it.
    """

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array, trees: pa.Array, changes: pa.Array) -> pa.Array:
        count = Encoder.shared(tokenizer, pattern).count
        out = []
        for t, kept, each in zip(texts.to_pylist(), trees.to_pylist(), changes.to_pylist()):
            tree = SegmentTree.load(t or "", kept["chars"], kept["tokens"], kept["segments"])
            done = [e for e in each or [] if e is not None]
            for e in done:
                tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "", count)
            out.append(
                {
                    "n_tokens": tree.total,
                    "text": tree.text if with_text else None,
                    "tree": {"segments": len(tree.segments), "chars": tree.chars, "tokens": tree.tokens} if with_text else None,
                    "reencoded_chars": tree.reencoded,
                    "n_edits": len(done),
                }
            )
        kind = pa.struct(
            [("n_tokens", pa.int64()), ("text", pa.string()), ("tree", _tree_type()), ("reencoded_chars", pa.int64()), ("n_edits", pa.int64())]
        )
        return pa.array(out, kind)

    return run(text, tree, edits)


def apply_edits(indexed: DataFrame, edits: DataFrame, tokenizer: str, pattern: str, per_round: int = 1000) -> DataFrame:
    """``indexed`` (doc_id, text, tree) after a table of edits (doc_id, seq, start, length, insert).

    Edits of a document go in order of ``seq``. They are taken in rounds of at most
    ``per_round`` a document, so a document that holds most of all edits never has them in
    one row, and no task orders more of them than others. Documents without edits are not
    rewritten, and those with few leave after their last round. Edits of unknown documents,
    and of a null doc_id, do nothing; ``indexed`` is read twice.
    """
    spark = indexed.sparkSession
    known = edits.where("doc_id is not null and seq is not null")
    placed = with_positions(known, ["doc_id"], ["seq", "start", "length", "insert"], out="_at")
    numbered = settle(placed.withColumn("_round", F.floor(F.col("_at") / per_round)), "edits")
    ends = settle(numbered.groupBy(F.col("doc_id").alias("_id")).agg(F.max("_round").alias("_end")), "ends")
    last = ends.agg(F.max("_end")).first()[0]
    if last is None:
        return indexed
    rest = indexed.join(ends, indexed["doc_id"] == ends["_id"], "left_anti")
    active, done = settle(whole(indexed).join(ends, F.col("_row.doc_id") == F.col("_id")), "active"), scratch_path(spark, "edited")
    for i in range(int(last) + 1):
        some = numbered.where(F.col("_round") == i).groupBy(F.col("doc_id").alias("_id")).agg(
            F.array_sort(F.collect_list(F.struct("seq", "start", "length", "insert"))).alias("_e")
        )
        change = F.transform("_e", lambda e: F.struct(e["start"].cast("long").alias("start"), e["length"].cast("long").alias("length"), e["insert"].alias("insert")))
        new = active.join(some, "_id").withColumn("_new", edited(F.col("_row.text"), F.col("_row.tree"), change.cast(EDITS), tokenizer, pattern))
        row = F.col("_row").withField("text", F.col("_new.text")).withField("tree", F.col("_new.tree"))
        made = settle(new.select("_id", "_end", row.alias("_row")), "edited")
        unwrapped(made.where(F.col("_end") == i)).write.mode("append").parquet(done)
        active = made.where(F.col("_end") > i)
    return rest.unionByName(spark.read.parquet(done))


def sample_edits(n_chars: Column, doc_id: Column, times: int = 3) -> Column:
    """Edits that depend on the document: a replacement, an insertion and a deletion in turn."""
    made = []
    for i in range(times):
        h = F.xxhash64(doc_id, F.lit(i))
        made.append(
            F.struct(
                F.pmod(h, n_chars + 1).alias("start"),
                (F.pmod(F.shiftright(h, 7), F.lit(60)) * F.lit(int(i % 3 != 1))).alias("length"),
                F.lit(("an edited phrase", " word ", "")[i % 3]).alias("insert"),
            )
        )
    return F.array(*made).cast(EDITS)


def count_edited(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """Counts of every text before and after its edits, and how much was encoded for them."""
    n_chars = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    rows = with_trees(docs.select("doc_id", "text", sample_edits(n_chars, F.col("doc_id")).alias("edits")), tokenizer, pattern)
    after = rows.withColumn("_after", edited(F.col("text"), F.col("tree"), F.col("edits"), tokenizer, pattern, with_text=False))
    return after.select(
        "doc_id",
        F.get("tree.tokens", F.lit(1)).alias("n_tokens"),
        F.col("_after.n_tokens").alias("n_tokens_edited"),
        F.col("_after.n_edits").alias("n_edits"),
        F.col("tree.segments").cast("long").alias("n_segments"),
        F.col("_after.reencoded_chars").alias("reencoded_chars"),
    )
