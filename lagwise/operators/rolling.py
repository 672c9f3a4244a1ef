"""Lagged rolling statistics: every value uses rows strictly before the current one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.operators.sequence import (
    MAX_ROWS_PER_TASK,
    KeySizes,
    Layout,
    drop_null_keys,
    last_before,
    lay_out,
    measure,
)
from lagwise.session import settle

# Half-lives per weight segment: weights stay within 2**64 and whatever lies more than
# one full segment back is below double precision.
SEGMENT_HALFLIVES = 64
# Bundles that make more columns than this are rolled as rows of one value each.
WIDE_OUTPUTS = 100
# A long frame is put together from at most so many shorter ones.
MOST_PARTS = 8
_ROW_ID, _AT, _VALUE, _VALUES, _STATS = "_row_id", "_at", "_value", "_values", "_stats"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)
    ]


def rolling_bundle(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str] | None = None,
    windows: Sequence[int] = (3, 5, 10, 20, 50),
    halflife: float | None = None,
    prefix: str = "",
    max_rows: int | KeySizes | None = MAX_ROWS_PER_TASK,
    keep_null_keys: bool = False,
) -> DataFrame:
    """Add mean, sample deviation and momentum over the last k rows, and an
    exponentially weighted mean when ``halflife`` is given.

    Output names are ``{prefix}{col}_mean_{k}``, ``_std_{k}``, ``_momentum_{k}``,
    ``_ewm_{h}`` and ``_momentum_ewm_{h}``. Momentum is the previous value minus the
    statistic. ``order`` must be unique inside a key. Rows with a NULL key are dropped, or
    kept with NULL statistics if ``keep_null_keys`` is set.
    """
    bundle = Bundle(tuple(keys), tuple(order), values, tuple(windows), halflife, prefix, max_rows, keep_null_keys)
    return rolling_bundles(df, [bundle])


@dataclass(frozen=True)
class Bundle:
    """The arguments of one ``rolling_bundle``."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    values: Sequence[str] | None = None
    windows: tuple[int, ...] = (3, 5, 10, 20, 50)
    halflife: float | None = None
    prefix: str = ""
    max_rows: int | KeySizes | None = MAX_ROWS_PER_TASK
    keep_null_keys: bool = False

    def columns(self, df: DataFrame) -> list[str]:
        values = self.values
        if values is None:
            values = numeric_columns(df, exclude=[*self.keys, "game_pk"])
        values = [c for c in dict.fromkeys(values) if c in df.columns and c not in {*self.keys, "game_pk"}]
        text = set(values) - set(numeric_columns(df))
        if text:
            raise ValueError(f"columns {sorted(text)} are not numeric; convert them first (clean.as_numbers)")
        return values

    @property
    def segment(self) -> int:
        return int(SEGMENT_HALFLIVES * self.halflife) if self.halflife else 0

    def lay_out(self, df: DataFrame, order: Sequence[str]) -> Layout:
        before = max([1, self.segment, *self.windows])
        return lay_out(df, self.keys, order, before=before, max_rows=self.max_rows, keep_null_keys=self.keep_null_keys)

    def outputs(self, column: str) -> list[str]:
        """The new columns of ``column``, in the order of ``_STATISTICS`` per window."""
        names = [f"{self.prefix}{column}_{stat}_{k}" for k in self.windows for stat in _STATISTICS]
        return names + ([f"{self.prefix}{column}_{stat}_{int(self.halflife)}" for stat in _SMOOTHED] if self.halflife else [])


_STATISTICS, _SMOOTHED = ("mean", "std", "momentum"), ("ewm", "momentum_ewm")


def rolling_bundles(df: DataFrame, bundles: Sequence[Bundle]) -> DataFrame:
    """Several bundles over the columns that ``df`` has, each as by ``rolling_bundle``.

    Wide bundles are worked out together: their windows run over rows of one value, and the
    wide row is put together once, at the end.
    """
    chosen = [(b, b.columns(df)) for b in bundles]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for b, values in chosen:
        df = _nan_to_null(df, values)
        if not b.keep_null_keys:
            df = drop_null_keys(df, b.keys)
    wide = [
        (b, v) for b, v in chosen
        if sum(len(b.outputs(c)) for c in v) > WIDE_OUTPUTS and not any(isinstance(kinds[c], T.DecimalType) for c in v)
    ]
    if len(wide) < len(chosen):
        for b, values in chosen:
            df = _by_value(df, [(b, values)]) if (b, values) in wide else _by_column(b.lay_out(df, b.order), b, values)
        return df
    return _by_value(df, wide) if wide else df


def _by_value(df: DataFrame, bundles: Sequence[tuple[Bundle, list[str]]]) -> DataFrame:
    """Windows over rows of (row, column number, value).

    A task that sorts or buffers a group then holds narrow rows, whatever the number of
    columns; the plan and its generated code are those of one column; and the groups of a key
    with few values are many more. The rows are stored with a number, by which the
    statistics find back to them.
    """
    base = settle(df.withColumn(_ROW_ID, F.monotonically_increasing_id()), "numbered")
    cells, picked, n = None, [], 0
    for bundle, values in bundles:
        order = [*bundle.order, _ROW_ID]
        needed = list(map(_name, dict.fromkeys([*bundle.keys, *order])))
        listed = ", ".join(f"cast({_name(c)} as double)" for c in values)
        layout = bundle.lay_out(base.selectExpr(*needed, f"array({listed}) as {_VALUES}"), order)
        rest = [_name(c) for c in layout.df.columns if c != _VALUES]
        one = layout.df.selectExpr(*rest, f"posexplode({_VALUES}) as ({_AT}, {_VALUE})")
        plain = Bundle((*bundle.keys, _AT), tuple(order), (_VALUE,), bundle.windows, bundle.halflife)
        tall = Layout(one, plain.keys, plain.order, layout.split, layout.has_null_keys)
        tall = replace(tall, df=_window_stats(tall, plain))
        done = _by_column(tall, replace(plain, windows=()), [_VALUE])
        part = done.selectExpr(_ROW_ID, f"{_AT} + {n} as {_AT}", f"array({', '.join(map(_name, plain.outputs(_VALUE)))}) as {_STATS}")
        cells = part if cells is None else cells.unionByName(part)
        # In the order of a bundle by columns: windows outermost, the smoothed columns last.
        names = {c: bundle.outputs(c) for c in values}
        runs = [range(i, i + 3) for i in range(0, 3 * len(bundle.windows), 3)]
        if bundle.halflife:
            runs.append(range(3 * len(bundle.windows), 3 * len(bundle.windows) + 2))
        picked += [f"{_STATS}[{n + at}][{i}] as {_name(names[c][i])}" for run in runs for at, c in enumerate(values) for i in run]
        n += len(values)
    # Each row has all its cells, so that a cell's place in the list is its number.
    whole = f"over (partition by {_ROW_ID} order by {_AT} rows between unbounded preceding and unbounded following)"
    packed = cells.selectExpr(_ROW_ID, _AT, f"collect_list({_STATS}) {whole} as {_STATS}").where(f"{_AT} = 0").drop(_AT)
    kept = [_name(c) for c in df.columns]
    # The planner takes a list for a few bytes and would broadcast it.
    return base.join(packed.hint("merge"), _ROW_ID).selectExpr(*kept, *picked)


def _window_stats(layout: Layout, bundle: Bundle) -> DataFrame:
    """``layout.df`` with mean, deviation and momentum of ``_VALUE`` per window.

    A window that is a multiple of a smaller one is put together from that one's counts, sums
    and squares at earlier rows, so that long frames are not gone through for each row.
    """
    parts, levels = {}, {}
    for k in sorted(set(map(int, bundle.windows))):
        parts[k] = max((j for j in levels if k % j == 0 and k // j <= MOST_PARTS), default=None)
        levels[k] = levels[parts[k]] + 1 if parts[k] else 0
    over = f"over (partition by {', '.join(map(_name, layout.partition))} order by {', '.join(map(_name, bundle.order))}"
    df = layout.df.selectExpr("*", f"lag({_VALUE}) {over}) as _last")
    for level in range(max(levels.values(), default=-1) + 1):
        looked, made = [], []
        for k in (k for k in levels if levels[k] == level):
            if not level:
                frame = f"{over} rows between {k} preceding and 1 preceding)"
                looked += [f"count({_VALUE}) {frame} as _n{k}", f"sum({_VALUE}) {frame} as _sum{k}", f"var_samp({_VALUE}) {frame} as _var{k}"]
                made.append(f"coalesce(_var{k} * (_n{k} - 1), 0D) as _sq{k}")
                continue
            j = parts[k]
            back = {d: "" if not d else f"_{k}_{d}" for d in range(0, k, j)}
            looked += [f"lag({c}{j}, {d}) {over}) as {c}{j}{b}" for d, b in back.items() if d for c in ("_n", "_sum", "_sq")]
            n, total = (" + ".join(f"coalesce({c}{j}{b}, {zero})" for b in back.values()) for c, zero in (("_n", "0L"), ("_sum", "0D")))
            mean = f"(({total}) / nullif({n}, 0L))"
            squares = " + ".join(f"coalesce(_sq{j}{b} + _n{j}{b} * pow(_sum{j}{b} / nullif(_n{j}{b}, 0L) - {mean}, 2D), 0D)" for b in back.values())
            made += [f"{n} as _n{k}", f"case when {n} > 0 then {total} end as _sum{k}", f"{squares} as _sq{k}"]
        df = df.selectExpr("*", *looked).selectExpr("*", *made)
    stats = []
    for k, names in zip(bundle.windows, zip(*[iter(bundle.outputs(_VALUE))] * 3)):
        mean = f"_sum{k} / nullif(_n{k}, 0L)"
        deviation = f"case when _n{k} > 1 then sqrt(_sq{k} / nullif(_n{k} - 1, 0L)) end"
        stats += [f"{layout.known_sql(e)} as {_name(name)}" for e, name in zip((mean, deviation, f"_last - {mean}"), names)]
    return df.selectExpr(*map(_name, layout.df.columns), *stats)


def _by_column(layout: Layout, bundle: Bundle, values: Sequence[str]) -> DataFrame:
    """Windows over the rows as they are, with expressions for each column."""
    order, windows, halflife, prefix, segment = bundle.order, bundle.windows, bundle.halflife, bundle.prefix, bundle.segment
    # SQL text: hundreds of expressions are parsed in one call each, and all frames share
    # one partitioning and order, so they need one exchange and one sort.
    part = ", ".join(map(_name, layout.partition))
    over = f"over (partition by {part} order by {', '.join(map(_name, order))}"
    keep = list(map(_name, layout.df.columns))
    stats = [f"lag({_name(c)}) {over}) as {_name('_lag_' + c)}" for c in values]
    names = list(keep)
    for k in windows:
        frame = f"{over} rows between {int(k)} preceding and 1 preceding)"
        for c in values:
            mean, std, momentum = (f"{prefix}{c}_{stat}_{k}" for stat in ("mean", "std", "momentum"))
            stats.append(f"{layout.known_sql(f'avg({_name(c)}) {frame}')} as {_name(mean)}")
            stats.append(f"{layout.known_sql(f'stddev_samp({_name(c)}) {frame}')} as {_name(std)}")
            names += [_name(mean), _name(std), f"{_name('_lag_' + c)} - {_name(mean)} as {_name(momentum)}"]
    if not halflife:
        return layout.finish(layout.df.selectExpr(*keep, *stats).selectExpr(*names))

    # Exponential weights grow with the position inside a segment; the current segment
    # and the one before it hold all weight that matters.
    h, tag = float(halflife), int(halflife)
    numbered = layout.df.selectExpr(*keep, *stats, f"row_number() {over}) - 1 as _row").selectExpr(
        *names,
        *[_name("_lag_" + c) for c in values],
        "_row",
        f"_row div {segment} as _segment",
        f"pow(2D, pmod(_row, {segment}) / {h}D) as _weight",
    )
    inside = f"over (partition by {part}, _segment order by _row rows unbounded preceding)"
    previous = f"over (partition by {part} order by _segment range between 1 preceding and 1 preceding)"
    fade = repr(2.0 ** (-segment / h)) + "D"

    # One step per window, in an order where the first sort serves all three.
    indexed = {c: str(at) for at, c in enumerate(values)}
    here = numbered.selectExpr(
        "*",
        *[f"sum({_name(c)} * _weight) {inside} as _s{at}" for c, at in indexed.items()],
        *[f"sum(case when {_name(c)} is not null then _weight end) {inside} as _w{at}" for c, at in indexed.items()],
    )
    # What a segment adds up to is found at its last row; the weight sum only grows.
    both = here.selectExpr(
        "*",
        *[f"max_by(_s{at}, _row) {previous} as _ps{at}" for at in indexed.values()],
        *[f"max(_w{at}) {previous} as _pw{at}" for at in indexed.values()],
    )

    def level(kind: str, at: str) -> str:
        return f"(_{kind}{at} + coalesce(_p{kind}{at} * {fade}, 0D))"

    # Defined on rows that have a value; a NULL row leaves the average unchanged.
    smoothed = both.selectExpr(
        *[_name(c) for c in numbered.columns],
        *[
            layout.known_sql(f"case when {_name(c)} is not null then {level('s', at)} / {level('w', at)} end")
            + f" as {_name('_ewm_' + c)}"
            for c, at in indexed.items()
        ],
    )
    outputs = {f"{prefix}{c}_ewm_{tag}": f"_ewm_{c}" for c in values}
    done = last_before(layout, smoothed, outputs, order=["_segment", "_row"])
    hidden = {"_row", "_segment", "_weight", *outputs.values(), *[f"_lag_{c}" for c in values], *outputs}
    visible = [_name(c) for c in done.columns if c not in hidden]
    ewm = []
    for c in values:
        mean = f"{prefix}{c}_ewm_{tag}"
        momentum = _name(f"{prefix}{c}_momentum_ewm_{tag}")
        ewm += [_name(mean), f"{_name('_lag_' + c)} - {_name(mean)} as {momentum}"]
    return layout.finish(done.selectExpr(*visible, *ewm))


def _nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN would poison averages and sorts above all numbers; a missing value is NULL."""
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and f.name in set(columns)
    }
    if not floats:
        return df
    return df.selectExpr(
        *[
            f"nanvl({_name(c)}, cast(null as double)) as {_name(c)}" if c in floats else _name(c)
            for c in df.columns
        ]
    )


def rest_days(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "rest_days",
    max_rows: int | KeySizes | None = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Whole days since the key's previous row; ``order[0]`` is the date."""
    layout = lay_out(df, keys, order, before=1, max_rows=max_rows)
    day = F.col(order[0])
    gap = F.datediff(day, F.lag(day).over(layout.window())).cast("long")
    return layout.finish(layout.df.withColumn(out, gap))


def shifted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str],
    offset: int = 1,
    max_rows: int | KeySizes | None = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Value ``offset`` rows back (or ahead if negative); ``columns`` maps output to source."""
    back, ahead = max(offset, 0), max(-offset, 0)
    layout = lay_out(df, keys, order, before=back, after=ahead, max_rows=max_rows)
    w = layout.window()
    return layout.finish(
        layout.df.withColumns({out: F.lag(src, offset).over(w) for out, src in columns.items()})
    )


def sum_last_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, tuple[str, int]],
    max_rows: int | KeySizes | None = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Sum over the previous n rows; ``columns`` maps output to ``(source, n)``."""
    reach = max(n for _, n in columns.values())
    layout = lay_out(df, keys, order, before=reach, max_rows=max_rows)
    w = layout.window()
    sums = {out: F.sum(src).over(w.rowsBetween(-n, -1)) for out, (src, n) in columns.items()}
    return layout.finish(layout.df.withColumns(sums))


def sum_last_days(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    columns: Mapping[str, tuple[str, int]],
    max_rows: int | KeySizes | None = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Sum over rows dated in ``[d - n, d)``; ``columns`` maps output to ``(source, n)``.

    All rows of a key on one day share the value, so with a hot key the rows are first
    summed per day and the frame runs over days. A row without a date gets NULL and is in
    no other row's sum.
    """
    keys = list(keys)
    df = drop_null_keys(df, keys)
    day = F.unix_date(F.col(date).cast("date"))

    def frame(n: int, over_day: Column):
        return Window.partitionBy(*keys).orderBy(over_day).rangeBetween(-n, -1)

    sizes = measure(df, keys, max_rows)
    if sizes is None or sizes.hot is None:
        return df.withColumns(
            {out: F.when(day.isNotNull(), F.sum(src).over(frame(n, day))) for out, (src, n) in columns.items()}
        )
    kinds = {out: df.agg(F.sum(src).alias("s")).schema["s"].dataType for out, (src, _) in columns.items()}
    dated = df.withColumn("_day", day)
    sources = list(dict.fromkeys(src for src, _ in columns.values()))
    daily = dated.where("_day is not null").groupBy(*keys, "_day").agg(*[F.sum(s).alias(s) for s in sources])
    rolled = daily.select(
        *keys,
        "_day",
        # A sum of sums would be a wider decimal than the plain sum.
        *[F.sum(src).over(frame(n, F.col("_day"))).cast(kinds[out]).alias(out) for out, (src, n) in columns.items()],
    )
    return dated.join(rolled, keys + ["_day"], "left").drop("_day")


def season_day(df: DataFrame, date: str, out: str = "days_into_season") -> DataFrame:
    """Days since the first row of the calendar year.

    One opening date per year, so the joined side has at most one row per year.
    """
    openings = df.groupBy(F.year(date).alias("_year")).agg(F.min(F.col(date).cast("date")).alias("_opening"))
    dated = df.withColumn("_year", F.year(date))
    return (
        dated.join(F.broadcast(openings), "_year", "left")
        .withColumn(out, F.datediff(F.col(date), F.col("_opening")).cast("long"))
        .drop("_year", "_opening")
    )
