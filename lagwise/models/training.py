"""Count-model training and evaluation on Spark ML."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.models.features import (
    as_doubles,
    assembly,
    BUCKETS,
    fold_values,
    frequent_values,
    importance_table,
    KEPT,
    never_missing_everywhere,
    SEED,
)
from lagwise.operators.clean import fill_categories, split_by_year
from lagwise.operators.folds import time_folds
from lagwise.operators.sequence import MAX_ROWS_PER_TASK, with_positions
from lagwise.plans import baseball as B
from lagwise.session import settle

PATIENCE = 50
# Features whose swapped values travel together when permutations are scored.
SWAP_BATCH = 16
DEFAULTS = {
    # Slow steps of shallow trees, each on most of the rows.
    "boosted": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 4, "subsamplingRate": 0.8},
    "poisson": {"regParam": 0.01, "maxIter": 50},
    "forest": {"numTrees": 100, "maxDepth": 6},
}
# name -> (kind, lower, upper), kind one of int, float, log
SEARCH_SPACE = {
    # A step per decade around the default; depth up to what a few thousand rows support.
    "boosted": {
        "stepSize": ("log", 0.01, 0.2),
        "maxDepth": ("int", 2, 6),
        "minInstancesPerNode": ("int", 1, 50),
        "subsamplingRate": ("float", 0.5, 1.0),
    },
    "poisson": {"regParam": ("log", 1e-4, 10.0)},
    "forest": {"maxDepth": ("int", 4, 12), "minInstancesPerNode": ("int", 1, 50)},
}


def metrics(predicted: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE and the share of rounded predictions within 1, as one row."""
    error = f"(`{prediction}` - `{target}`)"
    near = f"case when abs(bround(`{prediction}`, 0) - `{target}`) <= 1 then 1 else 0 end"
    return predicted.where(F.col(target).isNotNull()).selectExpr(
        f"sqrt(avg({error} * {error})) as rmse", f"avg(abs({error})) as mae", f"avg({near}) as within_1"
    )


def _regressor(kind: str, target: str, params: Mapping[str, object], bins: int):
    common = {"featuresCol": "features", "labelCol": target}
    chosen = {**DEFAULTS[kind], **params}
    if kind == "boosted":
        return GBTRegressor(**common, seed=SEED, maxBins=bins, **chosen)
    if kind == "forest":
        return RandomForestRegressor(**common, seed=SEED, maxBins=bins, **chosen)
    if kind == "poisson":
        return GeneralizedLinearRegression(**common, family="poisson", link="log", **chosen)
    raise ValueError(f"unknown model kind {kind!r}")


def best_round(errors: Sequence[float], patience: int, least: float = 1e-9) -> tuple[int, bool]:
    """The round (from 1) with the lowest error before ``patience`` rounds in a row brought
    no relative gain of ``least``, and whether that point was reached."""
    best, at = math.inf, 0
    for number, error in enumerate(errors, 1):
        if error < best * (1 - least) or at == 0:
            best, at = error, number
        elif number - at >= patience:
            return at, True
    return at, False


def _boost(make, rows: DataFrame, ahead: DataFrame, limit: int, patience: int):
    """Boosting cut at its best round on ``ahead``.

    A boosted model of fewer rounds is a prefix of one of more, so rounds are doubled until
    patience runs out; no more than about twice the rounds needed are trained in vain.
    """
    rounds = min(limit, 2 * patience)
    while True:
        fitted = make(rounds).fit(rows)
        best, out_of_patience = best_round(fitted.evaluateEachIteration(ahead, "squared"), patience)
        if out_of_patience or rounds >= limit:
            return fitted if best == rounds else make(best).fit(rows)
        rounds = min(limit, 2 * rounds)


_SAVED = "features array<string>, categorical array<string>, target string, kept map<string,array<string>>, buckets int"


@dataclass
class Trained:
    model: PipelineModel
    features: list[str]
    categorical: list[str]
    target: str
    kept: dict[str, list[str]] = field(default_factory=dict)
    buckets: int = BUCKETS

    def predict(self, df: DataFrame) -> DataFrame:
        named = fold_values(fill_categories(df, self.categorical), self.kept, self.buckets) if self.kept else df
        return self.model.transform(as_doubles(named, [*self.features, self.target]))

    def evaluate(self, df: DataFrame) -> DataFrame:
        return metrics(self.predict(df), self.target)

    def importances(self, spark) -> DataFrame:
        last = self.model.stages[-1]
        if hasattr(last, "featureImportances"):
            weights = last.featureImportances.toArray().tolist()
        else:
            weights = [abs(v) for v in last.coefficients.toArray().tolist()]
        return importance_table(spark, [*self.features, *self.categorical], weights)

    def save(self, path: str) -> None:
        """The fitted stages, and a row of what else is needed to use them."""
        self.model.write().overwrite().save(f"{path}/stages")
        row = [(self.features, self.categorical, self.target, self.kept, self.buckets)]
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(row, _SAVED).coalesce(1).write.mode("overwrite").json(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Trained:
        row = spark.read.schema(_SAVED).json(f"{path}/columns").first()
        kept = {c: list(values) for c, values in (row.kept or {}).items()}
        return Trained(PipelineModel.load(f"{path}/stages"), list(row.features), list(row.categorical), row.target, kept, row.buckets)


def train(
    train_df: DataFrame,
    features: Sequence[str],
    target: str = B.TARGET,
    kind: str = "boosted",
    eval_df: DataFrame | None = None,
    categorical: Sequence[str] = (),
    params: Mapping[str, object] | None = None,
    patience: int = PATIENCE,
    keep: int = KEPT,
    buckets: int = BUCKETS,
) -> Trained:
    """Fit on ``train_df``. With ``eval_df`` a boosted model ends at the round with the lowest
    error on it, looking ``patience`` rounds ahead. Missing categories become their own value;
    of more than ``keep`` values the rare ones share ``buckets`` labels."""
    features = never_missing_everywhere(train_df, features)
    columns = [*features, *categorical, target]

    def tidy(df: DataFrame) -> DataFrame:
        return as_doubles(fill_categories(df.select(*columns), categorical), [*features, target]).dropna(subset=[target])

    rows, kept = tidy(train_df), {}
    bins = 32
    if categorical:
        kept = frequent_values(rows, categorical, keep)
        rows = fold_values(rows, kept, buckets)
        counts = rows.agg(*[F.count_distinct(c) for c in categorical]).first()
        bins = max(bins, max(counts) + 2)
    # Fill values and category indexes come from the training rows alone.
    prepared = Pipeline(stages=assembly(features, categorical)).fit(rows)
    ready = prepared.transform(rows)
    ahead = prepared.transform(fold_values(tidy(eval_df), kept, buckets)) if kind == "boosted" and eval_df is not None else None
    if ahead is not None and not ahead.isEmpty():
        chosen = {**DEFAULTS[kind], **(params or {})}
        fitted = _boost(
            lambda n: _regressor(kind, target, {**chosen, "maxIter": n}, bins), ready, ahead, chosen["maxIter"], patience
        )
    elif kind == "poisson":
        # Up to maxIter passes over the rows, which the model does not keep itself, as trees do.
        held = ready.select("features", F.col(f"`{target}`")).persist()
        try:
            fitted = _regressor(kind, target, params or {}, bins).fit(held)
        finally:
            held.unpersist()
    else:
        fitted = _regressor(kind, target, params or {}, bins).fit(ready)
    return Trained(PipelineModel(stages=[*prepared.stages, fitted]), features, list(categorical), target, kept, buckets)


def _fold_scores(folded: DataFrame, features, target, n_splits, kind, params) -> list[float]:
    scores = []
    for k in range(1, n_splits + 1):
        past, ahead = folded.where(F.col("fold") < k), folded.where(F.col("fold") == k)
        fitted = train(past, features, target, kind, ahead, params=params)
        scores.append(fitted.evaluate(ahead).first().rmse)
    return scores


def _folded(df: DataFrame, features, order, target, n_splits) -> DataFrame:
    """Folds of the model's columns, worked out once and stored for all fits.

    Ranked rows lie in the order of time, a fold in a few files; dealt out anew, every file
    has its share of each fold, so that all tasks of a fit have rows.
    """
    needed = dict.fromkeys([*order, *features, target])
    folded = settle(time_folds(df.select(*needed), order, n_splits).select(*features, target, "fold"), "ranked")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(folded.repartition(max(parts, -(-folded.count() // MAX_ROWS_PER_TASK))), "folds")


def cross_validate(
    df: DataFrame,
    features: Sequence[str],
    order: Sequence[str],
    target: str = B.TARGET,
    n_splits: int = 5,
    kind: str = "boosted",
    params: Mapping[str, object] | None = None,
) -> list[float]:
    """RMSE of each expanding-window fold: trained on earlier rows, scored on the next ones."""
    return _fold_scores(_folded(df, features, order, target, n_splits), features, target, n_splits, kind, params)


def evaluate_holdout(
    df: DataFrame,
    features: Sequence[str],
    holdout_year: int,
    target: str = B.TARGET,
    date: str = "game_date",
    train_years: Sequence[int] = B.TRAIN_YEARS,
    test_years: Sequence[int] = B.TEST_YEARS,
    kind: str = "boosted",
    params: Mapping[str, object] | None = None,
) -> tuple[Trained, DataFrame]:
    """Train without the hold-out year; metrics for the test years and the hold-out year."""
    past, test, held = split_by_year(df, date, train_years, test_years, holdout_year)
    fitted = train(past, features, target, kind, test, params=params)
    scored = [
        fitted.evaluate(rows).withColumn("part", F.lit(name)) for name, rows in (("test", test), ("holdout", held))
    ]
    return fitted, scored[0].unionByName(scored[1])


def _draw(rng: random.Random, kind: str, low: float, high: float):
    if kind == "int":
        return rng.randint(int(low), int(high))
    if kind == "log":
        return math.exp(rng.uniform(math.log(low), math.log(high)))
    return rng.uniform(low, high)


def random_search(
    df: DataFrame,
    features: Sequence[str],
    order: Sequence[str],
    target: str = B.TARGET,
    n_trials: int = 50,
    n_splits: int = 5,
    kind: str = "boosted",
    space: Mapping[str, tuple[str, float, float]] | None = None,
    fixed: Mapping[str, object] | None = None,
    seed: int = SEED,
) -> tuple[dict[str, object], DataFrame]:
    """Best parameters by mean fold RMSE, and the table of trials (best first).

    Folds do not depend on the parameters and are made once; a draw that comes up again is
    not fitted again.
    """
    rng = random.Random(seed)
    space = space or SEARCH_SPACE[kind]
    folded = _folded(df, features, order, target, n_splits)
    trials, known = [], {}
    for number in range(n_trials):
        drawn = {name: _draw(rng, *spec) for name, spec in space.items()}
        text = json.dumps(drawn, sort_keys=True)
        if text not in known:
            scores = _fold_scores(folded, features, target, n_splits, kind, {**(fixed or {}), **drawn})
            known[text] = sum(scores) / len(scores)
        trials.append((number, known[text], text))
    table = df.sparkSession.createDataFrame(trials, "trial int, rmse double, params string").orderBy("rmse", "trial")
    best = min(trials, key=lambda t: t[1])
    return json.loads(best[2]), table


def permutation_importance(
    fitted: Trained, df: DataFrame, order: Sequence[str], offset_share: float = 0.6180339887
) -> DataFrame:
    """Rise in RMSE when one feature takes the values of other rows; only rises are kept.

    Every row meets one partner row through a fixed permutation of the row positions. The
    positions are stored once; features are scored in batches, a row once per feature of the
    batch, so that neither the width nor the number of rows grows with all features.
    """
    features, target = fitted.features, fitted.target
    placed = with_positions(df.select(*dict.fromkeys([*order, *features, *fitted.categorical, target])).dropna(subset=[target]), [], order)
    rows = settle(as_doubles(placed, [*features, target]), "placed")
    n = rows.count()
    if n == 0:
        return importance_table(df.sparkSession, [], [])
    step = max(1, int(n * offset_share))
    while math.gcd(step, n) != 1:
        step += 1
    partner = f"cast(pmod(cast(_pos as decimal(38, 0)) * {step} + {step // 3}, {n}) as bigint) as _pos"

    def rmse(scored: DataFrame, by: Sequence[str] = ()):
        error = F.pow(F.col("prediction") - F.col(target), 2)
        return fitted.predict(scored).groupBy(*by).agg(F.sqrt(F.avg(error)).alias("rmse")).collect()

    base = rmse(rows)[0].rmse
    gains = []
    for a in range(0, len(features), SWAP_BATCH):
        batch = features[a : a + SWAP_BATCH]
        moved = rows.selectExpr(partner, *[f"`{c}` as `_other_{c}`" for c in batch])
        which = F.explode(F.sequence(F.lit(0), F.lit(len(batch) - 1))).alias("_feature")
        swapped = [f"case when _feature = {k} then `_other_{c}` else `{c}` end as `{c}`" for k, c in enumerate(batch)]
        kept = [f"`{c}`" for c in (*features[:a], *features[a + SWAP_BATCH :], *fitted.categorical, target)]
        scored = rows.join(moved, "_pos").select("*", which).selectExpr(*swapped, *kept, "_feature")
        found = {r._feature: r.rmse for r in rmse(scored, ["_feature"])}  # one row per feature
        gains += [found[k] - base for k in range(len(batch))]
    return importance_table(df.sparkSession, features, gains).where("importance > 0")
