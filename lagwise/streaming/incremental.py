"""Keeping a feature table up to date: append past the high-water mark, repair late rows,
and the same step driven by a stream of arriving files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from lagwise.session import settle
from lagwise.sources.store import Store, Table
from lagwise.sources.tables import SEASON, latest_date, read_table, table_exists, write_table
from lagwise.streaming.stages import Stage, bring_in


def newer_than(df: DataFrame, mark, date: str = "game_date") -> DataFrame:
    """Rows dated after the mark; all rows if there is no mark."""
    return df if mark is None else df.where(F.col(date).cast("date") > F.lit(mark))


def refresh(
    spark: SparkSession,
    source: DataFrame,
    target: str,
    compute: Callable[[DataFrame], DataFrame],
    row_key: Sequence[str],
    group_keys: Sequence[str] | None = None,
    date: str = "game_date",
    rebuild: bool = False,
) -> str:
    """Bring the table at ``target`` up to ``compute(source)``; returns what was done.

    * ``rebuilt``: no table yet, or ``rebuild``.
    * ``appended``: new rows all lie after the mark. ``compute`` sees the full history and
      only rows after the mark are written, so windows do not restart at the mark.
    * ``repaired``: some rows are new and dated at or before the mark, or have no date, or
      differ from what was processed before. Later rows of the same groups change too, so
      the seasons from the first such row on are rewritten; undated rows come before all
      others, so they rewrite every season.
    * ``unchanged``.

    What has been processed is known from a table of row keys and row hashes next to the
    target, not from the target itself, as ``compute`` may drop rows. It is written after the
    target: a call that broke off in between is repaired by the next one.

    Give ``group_keys`` if ``compute`` works on each group alone: then an append reads the
    history of the groups that have new rows, and not the rest.
    """
    seen_path = target.rstrip("/") + "__seen"
    keys = list(row_key)
    day = F.col(date).cast("date")
    now = source.select(*keys, F.xxhash64(*sorted(source.columns)).alias("_hash"), day.alias("_day"))
    fresh_start = rebuild or not table_exists(spark, target) or not table_exists(spark, seen_path)
    stored_mark = None if fresh_start else latest_date(read_table(spark, target), date)
    if stored_mark is None:
        write_table(compute(source), target, "overwrite", date)
        now.withColumn("_step", F.lit(0)).write.mode("overwrite").parquet(seen_path)
        return "rebuilt"
    mark = F.lit(stored_mark)
    log = spark.read.parquet(seen_path)
    step = log.agg(F.max("_step")).first()[0] + 1
    seen = log.groupBy(*keys).agg(F.max_by(F.struct("_hash", F.col("_day").alias("_old_day")), "_step").alias("_seen"))
    same = [F.col(f"n.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in keys]
    changed = (
        now.alias("n")
        .join(seen.alias("s"), same, "left")
        .where("s._seen is null or s._seen._hash <> n._hash")
        .select("n.*", F.col("s._seen").isNotNull().alias("_corrected"), F.col("s._seen._old_day").alias("_old_day"))
    )
    undated = F.col("_day").isNull() | (F.col("_corrected") & F.col("_old_day").isNull())
    state = changed.agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("_corrected") | undated | (F.col("_day") <= mark), 1)).alias("late"),
        F.min(F.least("_day", "_old_day")).alias("first"),
        F.count(F.when(undated, 1)).alias("undated"),
    ).first()
    if state.n == 0:
        return "unchanged"
    # Kept as rows, since the source may be read again later with other rows.
    note = settle(changed.select(*keys, "_hash", "_day", F.lit(step).alias("_step")), "seen")
    if state.late == 0:
        history = source
        if group_keys:
            touched = newer_than(source, stored_mark, date).select(*group_keys).distinct()
            history = source.join(touched, list(group_keys), "left_semi")
        write_table(newer_than(compute(history), stored_mark, date), target, "append", date)
        done = "appended"
    else:
        fresh = compute(source).withColumn(SEASON, F.year(date))
        if not state.undated:
            fresh = fresh.where(F.col(SEASON) >= state.first.year)
        # Whole season partitions are replaced, earlier ones stay as they are.
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SEASON).parquet(target)
        done = "repaired"
    note.write.mode("append").parquet(seen_path)
    return done


def stream_refresh(
    spark: SparkSession,
    arrivals: str,
    schema: T.StructType | str,
    store: Store,
    raw: Table,
    stages: Sequence[Stage],
    checkpoint: str,
    deleted: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Process every file that has arrived, then stop; run it again for the next files.

    Raw rows are kept in the store by season and bucket. A batch is compared with the buckets
    that its rows fall into, and the stages recompute the groups that it changes; what else
    history holds is not read. Rows whose column ``deleted`` is true take their key out. Raw
    rows and derived tables become visible together. A batch that is delivered twice after a
    failure finds its rows stored and changes nothing.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows, gone = batch, None
        if deleted:
            flag = F.coalesce(F.col(deleted), F.lit(False))
            rows, gone = batch.where(~flag).drop(deleted), {raw.name: batch.where(flag).drop(deleted)}
        bring_in(store, [raw], stages, {raw.name: rows}, gone)

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(arrivals)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
