"""Table sources and sinks: Parquet tables by season, CSV and JSON files, lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.functions.scalars import to_id
from lagwise.operators.clean import existing
from lagwise.operators.joins import dedup, latest_value, stack_sides

SEASON = "season"


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether Parquet files lie at ``path``, wherever Spark can read."""
    try:
        spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    year: int | None = None,
    date: str = "game_date",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Scan a Parquet table.

    A year is selected by the season partition if there is one, else by a date range,
    which reaches the Parquet filter (``year(date) = y`` would not). Columns that do not
    exist are left out of the projection.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if year is not None:
        if SEASON in df.columns:
            df = df.where(F.col(SEASON) == year)
        else:
            kind = df.schema[date].dataType
            first, end = F.lit(f"{year}-01-01").cast(kind), F.lit(f"{year + 1}-01-01").cast(kind)
            df = df.where((F.col(date) >= first) & (F.col(date) < end))
    return existing(df, columns) if columns is not None else df


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    date: str | None = "game_date",
    unique: Sequence[str] | None = None,
) -> None:
    """Replace or append a Parquet table, partitioned by season if it has a date.

    ``unique`` removes repeated keys among the rows written.
    """
    if unique:
        df = dedup(df, unique)
    if date and date in df.columns:
        df = df.withColumn(SEASON, F.year(date))
        df.write.mode(mode).partitionBy(SEASON).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents, one per file, as ``(path, body)``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def latest_date(df: DataFrame, date: str = "game_date"):
    """High-water mark: the latest stored date, ``None`` for an empty table."""
    return df.agg(F.max(F.col(date).cast("date"))).first()[0]


def date_span(df: DataFrame, date: str = "game_date") -> DataFrame:
    """Earliest and latest date and row count, as one row."""
    day = F.col(date).cast("date")
    return df.agg(F.min(day).alias("earliest"), F.max(day).alias("latest"), F.count("*").alias("n_rows"))


def existing_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).dropna().distinct()


def id_lookup(df: DataFrame, id_column: str, names: dict[str, str], required: Sequence[str] = ()) -> DataFrame:
    """Lookup table with a readable integer id; rows with a bad id are dropped.

    ``names`` maps output columns to source columns.
    """
    rows = df.select(*[F.col(src).alias(out) for out, src in names.items()])
    return rows.withColumn(id_column, to_id(id_column)).dropna(subset=[id_column, *required])


def names_from_schedule(schedule: DataFrame, date: str = "game_date") -> DataFrame:
    """Pitcher id to name from schedule rows, home and away stacked; the last name wins."""
    sides = {
        "away": {"pitcher_id": "away_probable_pitcher_id", "name": "away_probable_pitcher_name"},
        "home": {"pitcher_id": "home_probable_pitcher_id", "name": "home_probable_pitcher_name"},
    }
    stacked = stack_sides(schedule, [date, "game_pk"], sides)
    named = stacked.where((F.col("pitcher_id") != 0) & (F.col("name") != ""))
    return latest_value(named, "pitcher_id", "name", [date, "game_pk", "side"])
