from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


PLACES = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the games of an entity, with a plain date."""
    return table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))


# Means of short fractions often end exactly half-way between two rounded values, where the
# last bit of a double decides; a fixed shift, far below the last place, settles those alike.
SHIFT = 1e-9


def tidy(df: DataFrame, places: int = PLACES, shift: float = 0.0) -> DataFrame:
    """Comparable output: rounded doubles, long integers, dates as text."""
    out = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            e = f"round(cast({c} as double) + {shift!r}D, {places}) + 0D"
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            e = f"cast({c} as bigint)"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            e = f"cast(cast({c} as date) as string)"
        else:
            e = c
        out.append(f"{e} as {c}")
    return df.selectExpr(*out)


def r(expr: str, name: str, places: int = PLACES, shift: float = 0.0) -> str:
    """SQL text of a rounded double column."""
    return f"round(cast({expr} as double) + {shift!r}::double, {places}) + 0.0 as {name}"


def i(expr: str, name: str) -> str:
    return f"cast({expr} as bigint) as {name}"


def d(expr: str, name: str) -> str:
    return f"strftime(cast({expr} as date), '%Y-%m-%d') as {name}"
