"""Contiguous shards of near-equal bytes, from global prefix sums of sizes.

Rows are ranged by their order, each range's bytes and rows are totalled, and the totals'
running sums give every range its first byte and first row. Inside a range a window adds up
what lies before each row. The byte at the middle of a row decides its shard: shard ``k``
takes the rows whose middle lies in the ``k``-th of equal stretches of all bytes, so each
shard's bytes miss the target by at most half a row at either end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import settle

PART_ROWS = 500_000  # rows of a range, beyond the session's number of shuffle partitions


def measured(docs: DataFrame, text: str = "text") -> list[Column]:
    """UTF-8 bytes of the text plus one, and its unsigned CRC-32; null counts as empty."""
    data = F.coalesce(docs[text], F.lit(""))
    return [(F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32")]


def cut(rows: DataFrame, shards: int, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` with ``shard`` and ``slot``, for a stored table with a ``size`` > 0.

    Null values come last in the order. Rows alike in all of it are told apart by where they
    are stored, so they are spread over ranges like others. Sizes times twice the number of
    shards must stay below 2^63. The totals of ranges (one row per ``PART_ROWS`` rows) and
    the first rows of shards are all that reaches the driver.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    parted = [c for name in order for c in (F.col(name).isNull(), F.col(name))]
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate([*parted, F.xxhash64(F.monotonically_increasing_id())])))
    keyed = rows.select(*keep, F.col("size").alias("_size"), key.alias("_key"))
    ranged = settle(keyed.repartitionByRange(parts, "_key").withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")).collect()
    starts, total, count = [], 0, 0
    for r in sorted(totals, key=lambda r: r["_part"]):
        starts.append((r["_part"], total, count))
        total, count = total + r["bytes"], count + r["n"]
    # One row per range.
    starts = F.broadcast(spark.createDataFrame(starts, "_part int, _byte long, _row long"))
    by = Window.partitionBy("_part").orderBy("_key")
    before = F.coalesce(F.sum("_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def located(table: DataFrame) -> DataFrame:
        inside = table.withColumn("_before", before).withColumn("_nth", F.row_number().over(by) - 1).join(starts, "_part")
        shard = F.expr(f"cast((2 * (_byte + _before) + _size) * {shards}L div {2 * max(total, 1)}L as int)")
        return inside.select(*[c for c in keep if c in table.columns], shard.alias("shard"), (F.col("_row") + F.col("_nth")).alias("_at"))

    heads = located(ranged.select("_part", "_key", "_size")).groupBy("shard").agg(F.min("_at").alias("_head")).collect()
    # At most one row per shard.
    heads = F.broadcast(spark.createDataFrame([(r["shard"], r["_head"]) for r in heads], "shard int, _head long"))
    return located(ranged).join(heads, "shard").select(*keep, "shard", (F.col("_at") - F.col("_head")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row per row of ``docs``.

    The order is doc_id, then size and checksum; a null doc_id comes last. A null text is
    empty, of size 1. Equal rows are rows of their own; texts that are equal are not kept
    together, as bytes decide. A text larger than a shard's target leaves other shards empty.
    ``grown_shard`` is null: another number of shards moves all borders. Other columns are
    not read; no rows give no rows. Texts are read once and not shuffled.
    """
    rows = settle(docs.select(F.col("doc_id"), *measured(docs, text)), "sized")
    out = cut(rows, shards, ["doc_id", "size", "text_crc32"], ["doc_id", "size", "text_crc32"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, files: int = 64, text: str = "text") -> None:
    """Writes whole rows to ``path``, a folder per shard, each in the order of its slots.

    The rows are shuffled to their range, to their place and to one of ``files`` ranges of
    output. Columns named like a working column are safe, as the rows travel as one struct.
    """
    named = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), *measured(docs, text))
    out = cut(settle(named, "sized"), shards, ["_id", "size", "text_crc32"], ["_doc"])
    ordered = out.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    if "shard" in docs.columns or "slot" in docs.columns:
        ordered = ordered.select("_doc", "shard", "slot")
    else:
        ordered = ordered.select("_doc.*", "shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
