"""Choosing model inputs: candidates, importance pruning, saved importances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.functions.scalars import group_by_name
from lagwise.operators.clean import candidate_features
from lagwise.plans import baseball as B

SEED = 3
# Categories that a model tells apart by name, and labels for all others together.
KEPT, BUCKETS, RARE = 1000, 256, "~"


def assembly(numeric: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """Stages that fill missing numbers, index categories and build ``features``.

    Spark trees take no missing values, so numbers are filled with the mean of the
    training rows; categories keep unseen values in a bucket of their own.
    """
    filled = [f"_in_{c}" for c in numeric]
    indexed = [f"_ix_{c}" for c in categorical]
    stages = []
    if numeric:
        stages.append(Imputer(inputCols=list(numeric), outputCols=filled))
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=filled + indexed, outputCol="features"))
    return stages


def frequent_values(df: DataFrame, columns: Sequence[str], keep: int = KEPT) -> dict[str, list[str]]:
    """The ``keep`` most frequent values of each text column; of equally frequent ones the
    smaller. Counting is distributed and combines before the shuffle; only these values come
    to the driver."""
    found = {}
    for c in columns:
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(keep)
        found[c] = sorted(r[c] for r in top.collect())
    return found


def fold_values(df: DataFrame, kept: Mapping[str, Sequence[str]], buckets: int = BUCKETS) -> DataFrame:
    """Values that are not kept become one of ``buckets`` labels, by a hash of the value, so
    a column has at most ``keep + buckets`` of them whatever the table holds."""

    def label(c: str, values: Sequence[str]) -> Column:
        bucket = F.conv(F.substring(F.md5(F.col(c).cast("binary")), 1, 8), 16, 10).cast("long") % buckets
        rare = F.concat(F.lit(RARE), bucket.cast("string"))
        return F.when(F.col(c).isin(list(values)), F.col(c)).when(F.col(c).isNotNull(), rare)

    return df.withColumns({c: label(c, values) for c, values in kept.items()})


def as_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    chosen = set(columns)
    return df.selectExpr(*[f"cast(`{c}` as double) as `{c}`" if c in chosen else f"`{c}`" for c in df.columns])


def never_missing_everywhere(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one value; nothing can be learned from the others."""
    if not columns:
        return []
    row = df.agg(*[F.count(c) for c in columns]).first()
    return [c for c, n in zip(columns, row) if n]


def importance_table(spark, names: Sequence[str], importances: Sequence[float]) -> DataFrame:
    """``(feature, importance, group)`` with the largest first; one row per feature."""
    rows = [(n, float(v)) for n, v in zip(names, importances)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    group = group_by_name("feature", B.FEATURE_NAME_GROUPS, B.FEATURE_PREFIX_GROUPS, B.DEFAULT_FEATURE_GROUP)
    return table.withColumn("group", group).orderBy(F.desc("importance"), "feature")


def forest_importances(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    trees: int = 50,
    params: Mapping[str, object] | None = None,
) -> dict[str, float]:
    features = never_missing_everywhere(df, features)
    if not features:
        return {}
    forest = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, seed=SEED, **(params or {}))
    rows = as_doubles(df.select(*features, target), [*features, target]).dropna(subset=[target])
    fitted = Pipeline(stages=[*assembly(features), forest]).fit(rows)
    return dict(zip(features, fitted.stages[-1].featureImportances.toArray().tolist()))


def select_features(
    df: DataFrame,
    target: str = B.TARGET,
    exclude: Sequence[str] = (),
    prune: bool = False,
    threshold: float = 0.01,
    trees: int = 50,
    params: Mapping[str, object] | None = None,
) -> tuple[list[str], dict[str, float]]:
    """Numeric columns that may be inputs; with ``prune`` those whose importance is at
    least ``threshold`` times the largest one. Returns the names and the importances."""
    names = candidate_features(df, target, [*B.IDENTIFIERS, *exclude])
    if not prune or not names:
        return names, {}
    importances = forest_importances(df, names, target, trees, params)
    top = max(importances.values(), default=0.0)
    return [n for n in names if n in importances and importances[n] >= threshold * top], importances


def keep_important(features: Sequence[str], saved: DataFrame | None) -> list[str]:
    """Features with a saved importance above zero; all of them if nothing was saved."""
    if saved is None:
        return list(features)
    known = {r.feature for r in saved.where("importance > 0").select("feature").collect()}
    return [f for f in features if f in known]
