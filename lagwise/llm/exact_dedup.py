"""Exact de-duplication by a tree-merge of digest runs, with SQL functions only.

Every input partition yields a run: its distinct digests, each with the identifier that
would stay and a row count. Runs are then merged in rounds. In a round the runs whose
numbers agree but for their last digit (to the base ``fan_in``) become one run, so that
after ``log(runs)`` rounds a single run is left: their entries are exchanged by digest, each
task sorts its stretch of the merged run, and of equal neighbours the identifier that would
stay is retained. A merge takes ``fan_in`` runs at once; ``fan_in=2`` gives plain binomial
rounds.

A digest is verified at every level: entries merge only if the SHA-256, an independent
64-bit hash and the length of the text all agree.

Skew: a text that makes up a third of the table is one entry of each run after the first,
map-side, step, so at most ``fan_in`` of its entries meet in a merge. When rows get their
verdicts, digests of many rows are joined apart, without moving their rows. Only (digest,
hash, length, identifier, count) is shuffled, never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import ascii_lower, settle, unwrapped, whole, whole_order

KEY = ["text_sha256", "_check", "_length"]
FAN_IN = 16
RUNS = 4096
HOT_ROWS, HOT_LIST = 100_000, 10_000


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest columns, run) per row; a null text counts as an empty one."""
    norm = F.coalesce(ascii_lower(F.col(text)), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), norm.alias("_norm"))
        .select(
            "doc_id",
            F.sha2("_norm", 256).alias("text_sha256"),
            F.xxhash64("_norm").alias("_check"),
            F.octet_length("_norm").cast("long").alias("_length"),
            F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("_run"),
        )
    )


def _first(keep: str, of: str) -> Column:
    return F.col(of).desc_nulls_last() if keep == "largest" else F.col(of).asc_nulls_last()


def tree_merge(rows: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN, runs: int = RUNS) -> DataFrame:
    """One row per digest: the identifier that stays and the number of rows."""
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    run = rows.groupBy(*KEY, "_run").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    while runs > 1:
        runs = -(-runs // fan_in)
        number = F.floor(F.col("_run") / fan_in).cast("int") if runs > 1 else F.lit(0)
        equal = Window.partitionBy("_run", *KEY)
        merged = run.withColumn("_run", number).withColumns(
            {"_nth": F.row_number().over(equal.orderBy(_first(keep, "keep_id"))), "_all": F.sum("group_size").over(equal)}
        )
        run = merged.where("_nth = 1").select(*KEY, "_run", "keep_id", F.col("_all").alias("group_size"))
    return run.drop("_run")


def with_groups(rows: DataFrame, merged: DataFrame, hot: int = HOT_ROWS, listed: int = HOT_LIST) -> DataFrame:
    """Rows with the entry of their digest; both are stored tables.

    Digests of more rows than ``hot``, or than a ``listed``-th of the table, are at most
    ``listed``: they are broadcast, so that their rows stay where they are. The others meet
    their entries by shuffle.
    """
    least = max(hot, rows.count() // listed)
    often = F.broadcast(merged.where(F.col("group_size") > least))
    rest = rows.join(often.select(*KEY), KEY, "left_anti").join(merged.where(F.col("group_size") <= least), KEY)
    return rows.join(often, KEY).unionByName(rest)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    keep: str = "smallest",
    fan_in: int = FAN_IN,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal if they are identical after lower-casing A-Z. Null and empty texts are
    one group. ``keep`` says whether the smallest or the largest id of a group stays; a
    null id stays only if its group has no other. Repeated rows each count and share their
    fate. Other columns, whatever their names, are not read. No rows give no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    rows = settle(digests(docs, id_col, text), "digests")
    merged = settle(tree_merge(rows, keep, fan_in), "merged")
    return with_groups(rows, merged).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns, repeated rows once. Of rows that share
    the identifier that stays, the first in the order of all columns does.

    Only the identifiers that stay are joined back. Rows are spread by identifier and
    digest, so a hot text costs its copies one probe each.
    """
    names = ["doc_id", "text_sha256"]
    stay = exact_dedup(docs, id_col, text, keep).where("kept").select(*names).distinct()
    stay = stay.select(F.xxhash64(*names).alias("_k"), *(F.col(n).alias(f"_{n}") for n in names))
    digest = F.sha2(F.coalesce(ascii_lower(F.col(f"_row.`{text}`")), F.lit("")), 256)
    keyed = whole(docs).withColumn("_id", F.col(f"_row.`{id_col}`")).withColumn("_digest", digest)
    keyed = keyed.withColumn("_k", F.xxhash64("_id", "_digest"))
    same = (keyed["_k"] == stay["_k"]) & keyed["_id"].eqNullSafe(stay["_doc_id"]) & (keyed["_digest"] == stay["_text_sha256"])
    place = F.row_number().over(Window.partitionBy("_k", "_id", "_digest").orderBy(*whole_order(docs)))
    return unwrapped(keyed.join(stay, same, "left_semi").withColumn("_place", place).where("_place = 1"))
