"""Ordered per-key processing that keeps every task bounded when one key is hot.

``Window.partitionBy(key)`` puts all rows of a key into one task. That is the plan
we want for ordinary keys. A key holding a large share of the table is cut into
blocks of consecutive rows instead:

* every hot row gets its exact position inside the key, from counts per order
  bucket plus a rank inside the bucket, so no task sorts the whole key;
* a block is ``max_rows`` consecutive positions; rows within reach of a frame are
  copied into the neighbouring block, so frames of bounded length stay exact;
* a value that depends on the whole past (the last non-NULL one) is computed per
  block, then carried over the few block summaries of the key.

No row is dropped, capped or sampled; without hot keys the layout is the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.session import is_plain_scan, settle

MAX_ROWS_PER_TASK = 1_000_000
# Hot-key lists and bucket tables up to this many rows are broadcast; larger ones are
# joined by shuffle. Lookup tables must be this small in bytes, too.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
# A whole table is ranked in so many ranges at most, while they have fewer than
# MAX_ROWS_PER_TASK rows: a range costs a task and a file, whatever it holds.
MAX_RANGES = 1_000

BLOCK, CORE, POS, SPREAD = "_block", "_core", "_pos", "_spread"
_SPREAD_PARTS = 1 << 20
_LEAD, _TIE, _SUB = "_lead", "_tie", "_sub"


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    # Plain IS NOT NULL conditions reach the Parquet filter; dropna does not.
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_ROWS_PER_TASK) -> DataFrame | None:
    """Keys with more than ``max_rows`` rows, or ``None`` if there are none.

    Counts over the key columns only, combined before the shuffle.
    There can be at most ``rows / max_rows`` such keys.
    """
    keys = list(keys)
    rows = drop_null_keys(df.select(*keys), keys)
    if len(keys) > 1:
        # A hot pair needs a hot first part, and counting that moves far fewer groups.
        suspects = _keys_above(rows, keys[:1], max_rows)
        if suspects is None:
            return None
        rows = rows.join(suspects, keys[:1], "left_semi")
    return _keys_above(rows, keys, max_rows)


def key_counts(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """Keys with more than ``max_rows`` rows, and their ``count``; at most ``rows / max_rows``."""
    named = ["`" + k.replace("`", "``") + "`" for k in keys]
    rows = df.select(*named)
    for k in named:
        rows = rows.where(F.col(k).isNotNull())
    return _in_hand(rows.groupBy(*named).count().where(F.col("count") > max_rows))


def _keys_above(rows: DataFrame, keys: list[str], max_rows: int) -> DataFrame | None:
    hot = _in_hand(rows.groupBy(*keys).count().where(F.col("count") > max_rows).select(*keys))
    return None if hot.isEmpty() else hot


def _in_hand(table: DataFrame) -> DataFrame:
    """A summary table computed once and broadcast if it has few rows, else left as it is."""
    head = table.limit(BROADCAST_ROWS + 1).collect()
    if len(head) > BROADCAST_ROWS:
        return table
    return F.broadcast(table.sparkSession.createDataFrame(head, table.schema))


@dataclass(frozen=True)
class KeySizes:
    """Hot keys found by one look at a table, to be shared by several operators on it."""

    hot: DataFrame | None
    max_rows: int


def measure(df: DataFrame, keys: Sequence[str], max_rows: int | KeySizes | None = MAX_ROWS_PER_TASK) -> KeySizes | None:
    """Look for hot keys now; ``None`` (no check wanted) and earlier results pass through."""
    if max_rows is None or isinstance(max_rows, KeySizes):
        return max_rows
    return KeySizes(hot_keys(df, keys, max_rows), max_rows)


def _order_buckets(df: DataFrame, order: Sequence[str]) -> tuple[Column, Column]:
    """Coarse order bucket and an integer that refines the order inside the bucket."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    first = F.col(order[0])
    kind = kinds[order[0]]
    no_tie = F.lit(0).cast("long")
    if isinstance(kind, T.DateType):
        lead = F.unix_date(first).cast("long")
        integral = len(order) > 1 and isinstance(kinds[order[1]], T.IntegralType)
        tie = F.col(order[1]).cast("long") if integral else no_tie
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        lead = F.unix_date(first.cast("date")).cast("long")
        tie = (F.hour(first) * 3600 + F.minute(first) * 60 + F.second(first)).cast("long")
    elif isinstance(kind, T.IntegralType):
        lead = F.floor(first / F.lit(65536)).cast("long")
        tie = F.pmod(first.cast("long"), F.lit(65536).cast("long"))
    elif isinstance(kind, T.BooleanType):
        lead, tie = first.cast("long"), no_tie
    elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        value = first.cast("double")
        whole = F.floor(value)  # saturates for very large values, which keeps the order
        lead = F.when(F.isnan(value), F.lit(2**62)).otherwise(F.greatest(whole, F.lit(-(2**61))))
        inside = F.when(F.isnan(value) | (F.abs(value) >= 2.0**52), 0.0).otherwise(value - whole)
        tie = F.floor(inside * F.lit(2.0**30)).cast("long")
    elif isinstance(kind, T.StringType):
        lead = F.substring(first, 1, 10)
        rest = F.hex(F.encode(F.substring(first, 11, 6), "utf-8"))
        tie = F.conv(F.rpad(F.substring(rest, 1, 12), 12, "0"), 16, 10).cast("long")
        return F.coalesce(lead, F.lit("")), F.coalesce(tie, no_tie)
    else:
        raise ValueError(f"cannot split a hot key ordered by {order[0]} ({kind.simpleString()})")
    lowest = F.lit(-(2**62)).cast("long")
    return F.coalesce(lead, lowest), F.coalesce(tie, no_tie)


def ranged_positions(df: DataFrame, order: Sequence[str], max_rows: int = MAX_ROWS_PER_TASK, out: str = POS) -> DataFrame:
    """Exact 0-based position of each row in the whole table.

    Rows are ranged over partitions of at most about ``max_rows`` rows (more where that would
    take over ``MAX_RANGES`` ranges of fewer than ``MAX_ROWS_PER_TASK`` rows), so only the ranges'
    row counts (one each) are put in order, on the driver, and each range is ranked in a task
    of its own. The ranged table is stored, as its borders are drawn from a sample and must
    not move between two readings. A NULL in the order comes first.
    """
    spark = df.sparkSession
    df = df if is_plain_scan(df) else settle(df, "rows")
    n = df.count()
    wanted = min(-(-n // max_rows), max(MAX_RANGES, -(-n // MAX_ROWS_PER_TASK)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)
    ranged = settle(df.repartitionByRange(parts, *order).withColumn(_SUB, F.spark_partition_id()), "ranged")
    starts, total = [], 0
    for r in sorted(ranged.groupBy(_SUB).count().collect(), key=lambda r: r[_SUB]):
        starts.append((r[_SUB], total))
        total += r["count"]
    before = F.broadcast(spark.createDataFrame(starts, f"{_SUB} int, _start long"))
    inside = F.row_number().over(Window.partitionBy(_SUB).orderBy(*order))
    return ranged.withColumn(out, inside).join(before, _SUB).withColumn(out, F.col("_start") + F.col(out) - 1).drop(_SUB, "_start")


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    max_rows: int = MAX_ROWS_PER_TASK,
    out: str = POS,
) -> DataFrame:
    """Exact 0-based position of each row inside its key, with bounded tasks.

    ``keys`` may be empty, which ranks the whole table without a global sort: see
    ``ranged_positions``. ``order`` must be unique inside a key.
    """
    keys, order = list(keys), list(order)
    if not keys:
        return ranged_positions(df, order, max_rows, out)
    lead, tie = _order_buckets(df, order)
    rows = df.withColumns({_LEAD: lead, _TIE: tie})
    bucket = keys + [_LEAD]
    spans = rows.groupBy(*bucket).agg(
        F.count("*").alias("_n"), F.min(_TIE).alias("_min"), F.max(_TIE).alias("_max")
    )
    parts = F.ceil(F.col("_n") * 2 / F.lit(max_rows))
    spans = _in_hand(
        spans.select(
            *bucket,
            "_min",
            F.ceil((F.col("_max") - F.col("_min") + 1) / parts).cast("long").alias("_width"),
        )
    )
    sub = F.expr(f"({_TIE} - _min) div _width")
    span = [*bucket, "_min", "_width"]
    while True:
        counts = _in_hand(rows.select(*bucket, _TIE).join(spans, bucket).groupBy(*span, sub.alias(_SUB)).count())
        # Where the refining values cluster, equal parts are uneven: cut those finer.
        uneven = (F.col("_most") > max_rows) & (F.col("_width") > 1)
        most = counts.groupBy(*span).agg(F.max("count").alias("_most"))
        if most.where(uneven).isEmpty():
            break
        finer = F.greatest(F.lit(1), F.floor(F.col("_width") * max_rows / (F.col("_most") * 2)))
        spans = _in_hand(
            most.select(*bucket, "_min", F.when(uneven, finer).otherwise(F.col("_width")).cast("long").alias("_width"))
        )
    # One row per (key, bucket, sub bucket): small next to the data.
    running = Window.partitionBy(*keys).orderBy(_LEAD, _SUB).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("count").over(running), F.lit(0))).drop("count")
    table = starts.groupBy(*span).agg(F.map_from_entries(F.collect_list(F.struct(_SUB, "_start"))).alias("_starts"))
    located = rows.join(_in_hand(table), bucket).withColumn(_SUB, sub)
    group = bucket + [_SUB]
    # Explicit: a shuffle join would leave rows placed by bucket, not by sub bucket.
    located = located.withColumn("_start", F.col("_starts")[F.col(_SUB)]).drop("_starts").repartition(*group)
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return located.withColumn(out, F.col("_start") + inside - 1).drop(
        _LEAD, _TIE, _SUB, "_start", "_min", "_width"
    )


@dataclass(frozen=True)
class Layout:
    """Rows arranged for windows; ``split`` tells whether hot keys were cut into blocks."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool
    has_null_keys: bool = False

    @property
    def partition(self) -> list[str]:
        extra = [BLOCK] * self.split + [SPREAD] * self.has_null_keys
        return [*self.keys, *extra]

    def known_sql(self, value: str) -> str:
        """SQL text of ``value`` where the key is known, else NULL."""
        return f"case when {SPREAD} = 0 then {value} end" if self.has_null_keys else value

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def core(self, value: Column) -> Column:
        """``value`` on the block's own rows, NULL on rows copied from a neighbour."""
        return F.when(F.col(CORE), value) if self.split else value

    def finish(self, df: DataFrame) -> DataFrame:
        done = df.where(F.col(CORE)).drop(BLOCK, CORE, POS) if self.split else df
        return done.drop(SPREAD)


def lay_out(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int = 0,
    after: int = 0,
    max_rows: int | KeySizes | None = MAX_ROWS_PER_TASK,
    keep_null_keys: bool = False,
) -> Layout:
    """Arrange ``df`` for frames reaching ``before`` rows back and ``after`` rows ahead.

    ``max_rows=None`` skips the hot-key check, ``KeySizes`` reuses an earlier one. Rows with a NULL key belong to no group:
    they are dropped, or with ``keep_null_keys`` kept and spread over many tasks.
    """
    keys, order = tuple(keys), tuple(order)
    if keep_null_keys:
        unknown = F.lit(False)
        for k in keys:
            unknown = unknown | F.col(k).isNull()
        spread = F.pmod(F.xxhash64(*order), F.lit(_SPREAD_PARTS)) + 1
        df = df.withColumn(SPREAD, F.when(unknown, spread).otherwise(0))
    else:
        df = drop_null_keys(df, keys)
    sizes = measure(df, keys, max_rows)
    if sizes is None or sizes.hot is None:
        return Layout(df, keys, order, False, keep_null_keys)
    hot, max_rows = sizes.hot, sizes.max_rows
    # Cutting reads the rows several times; a long plan is not repeated for each.
    if not is_plain_scan(df):
        df = settle(df, "rows")
    size = max(max_rows, before, after)
    cold_rows = df.join(hot, list(keys), "left_anti").withColumns(
        {BLOCK: F.lit(-1).cast("long"), CORE: F.lit(True), POS: F.lit(None).cast("long")}
    )
    placed = with_positions(df.join(hot, list(keys), "left_semi"), keys, order, max_rows)
    own = F.expr(f"{POS} div {size}")
    offset = F.pmod(F.col(POS), F.lit(size))
    targets = F.array_compact(
        F.array(
            own,
            F.when(offset >= size - before, own + 1),
            F.when((offset < after) & (own > 0), own - 1),
        )
    )
    hot_rows = (
        placed.withColumn("_own", own)
        .withColumn(BLOCK, F.explode(targets))
        .withColumn(CORE, F.col(BLOCK) == F.col("_own"))
        .drop("_own")
    )
    return Layout(cold_rows.unionByName(hot_rows), keys, order, True, keep_null_keys)


def last_before(
    layout: Layout, df: DataFrame, columns: Mapping[str, str], order: Sequence[str] | None = None
) -> DataFrame:
    """Last non-NULL value over all earlier rows of the key, however far back.

    ``columns`` maps an output name to its source. ``df`` is ``layout.df``, perhaps with
    columns added. ``order`` names columns that sort like the layout's order, for rows
    that are already sorted by them.
    """
    w = Window.partitionBy(*layout.partition).orderBy(*order) if order else layout.window()
    frame = w.rowsBetween(Window.unboundedPreceding, -1)
    local = {
        out: F.last(layout.core(F.col(source)), ignorenulls=True).over(frame)
        for out, source in columns.items()
    }
    if not layout.split:
        return df.withColumns(local)

    # One summary per block of a hot key, carried over the blocks before each block. The
    # block condition passes below the windows, so ordinary keys are not computed twice.
    keys = list(layout.keys)
    past = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    summaries = (
        df.where(F.col(BLOCK) >= 0)
        .where(CORE)
        .groupBy(*keys, BLOCK)
        .agg(
            *[
                F.max_by(source, F.when(F.col(source).isNotNull(), F.col(POS))).alias(out)
                for out, source in columns.items()
            ]
        )
    )
    carries = summaries.select(
        *keys,
        BLOCK,
        *[F.last(out, ignorenulls=True).over(past).alias(f"_carry_{out}") for out in columns],
    )
    joined = df.withColumns(local).join(carries, keys + [BLOCK], "left")
    return joined.withColumns(
        {out: F.coalesce(F.col(out), F.col(f"_carry_{out}")) for out in columns}
    ).drop(*[f"_carry_{out}" for out in columns])
