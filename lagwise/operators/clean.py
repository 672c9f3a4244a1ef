"""Row and column cleaning: filters, casts, quarantine, splits, column selection."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.functions.scalars import is_true, to_number


def regular_season(df: DataFrame) -> DataFrame:
    """Regular-season rows, if the table says which they are."""
    return df.where(F.col("game_type") == "R") if "game_type" in df.columns else df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with NULL in an essential column."""
    return df.dropna(subset=list(columns))


def as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast to double; unreadable values become NULL. Absent columns are skipped."""
    return df.withColumns({c: to_number(c) for c in columns if c in df.columns})


def with_constants(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in constants.items()})


def existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Projection limited to the columns that exist."""
    present = set(df.columns)
    return df.select(*[c for c in columns if c in present])


def quarantine(df: DataFrame, reasons: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into accepted rows and rejected rows with the first matching ``reason``."""
    reason = F.coalesce(*[F.when(is_true(c), F.lit(name)) for name, c in reasons.items()])
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def calendar(spark, start: str, end: str, skip_years: Sequence[int] = (2020,)) -> DataFrame:
    """Days from start to end without skipped years and without the off-season
    (from November 5, and before March 7)."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )
    return days.where(in_season("day", skip_years))


def in_season(date: str, skip_years: Sequence[int] = (2020,)) -> Column:
    code = F.month(date) * 100 + F.dayofmonth(date)
    return (code >= 307) & (code < 1105) & ~F.year(date).isin(list(skip_years))


def prefixed(df: DataFrame, prefix: str, except_for: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in set(except_for) else F.col(c).alias(prefix + c) for c in df.columns])


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop columns whose name matches a regular expression."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


_WINDOW_NAME = re.compile(r"_(?:mean|std|momentum|ewm|momentum_ewm)_(\d+)$")
_ROLLED_NAME = re.compile(r"_(?:mean|std|momentum)_(\d+)$")


def drop_stale_windows(df: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Drop rolling columns made with a window size no longer configured."""
    keep = {str(w) for w in windows}
    stale = [c for c in df.columns if (m := _ROLLED_NAME.search(c)) and m.group(1) not in keep]
    return df.drop(*stale)


def leakage_guard(
    df: DataFrame,
    target: str,
    allowed: Sequence[str],
    identifiers: Sequence[str] = (),
) -> DataFrame:
    """Keep rolling columns, whitelisted numbers, the target, identifiers and non-numbers."""
    allowed_set = {*allowed, *identifiers, target}
    return df.select(
        *[c for c in df.columns if _WINDOW_NAME.search(c) or c in allowed_set or not is_numeric(df, c)]
    )


def candidate_features(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are neither excluded nor the target."""
    out = {*exclude, target}
    return [c for c in df.columns if c not in out and is_numeric(df, c)]


def categorical_columns(df: DataFrame, features: Sequence[str], target: str, exclude: Sequence[str] = ()) -> list[str]:
    """Text columns that are neither chosen numeric features, excluded, nor the target."""
    out = {*features, *exclude, target}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in out]


def fill_categories(df: DataFrame, columns: Sequence[str], value: str = "NA") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(value)) for c in columns})


def split_by_year(
    df: DataFrame,
    date: str,
    train_years: Sequence[int],
    test_years: Sequence[int],
    holdout_year: int | None = None,
) -> tuple[DataFrame, ...]:
    """Train and test rows by year; the hold-out year, if given, is in neither."""
    year = F.year(date)
    out = is_true(year == holdout_year) if holdout_year is not None else F.lit(False)
    train = df.where(year.isin(list(train_years)) & ~out)
    test = df.where(year.isin(list(test_years)) & ~out)
    return (train, test) if holdout_year is None else (train, test, df.where(out))
