"""Feature selection, training and evaluation on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from lagwise.models import features as MF
from lagwise.models import training as MT
from lagwise.sources.tables import read_csv, write_csv


@pytest.fixture(scope="module")
def matrix(spark):
    x = F.col("id")
    return spark.range(240).select(
        x.alias("game_pk"),
        F.date_add(F.lit("2023-01-01").cast("date"), (x * 4).cast("int")).alias("game_date"),
        (x % 7).alias("pitcher_id"),
        F.when(x % 10 != 0, (x % 5).cast("double")).alias("x1_mean_3"),
        (x * 37 % 11).cast("double").alias("x2_mean_3"),
        F.lit(None).cast("double").alias("empty_mean_3"),
        F.when(x % 4 == 0, F.lit("BOS")).when(x % 4 == 1, F.lit("NYY")).alias("home_team"),
        ((x % 5) * 2 + F.when(x % 4 == 0, 3).otherwise(0)).cast("long").alias("strikeouts"),
    ).cache()


def test_selection_and_pruning(spark, matrix, tmp_path):
    names, _ = MF.select_features(matrix)
    assert names == ["x1_mean_3", "x2_mean_3", "empty_mean_3"]
    kept, found = MF.select_features(matrix, prune=True, threshold=0.5, trees=5)
    assert kept == ["x1_mean_3"] and set(found) == {"x1_mean_3", "x2_mean_3"}
    write_csv(spark.createDataFrame([("x1_mean_3", 0.7), ("x2_mean_3", 0.0)], "feature string, importance double"), str(tmp_path / "i"))
    saved = read_csv(spark, str(tmp_path / "i"), "feature string, importance double")
    assert MF.keep_important(names, saved) == ["x1_mean_3"]
    assert MF.keep_important(names, None) == names


def test_metrics_round_half_to_even(spark):
    df = spark.createDataFrame([(2.5, 3), (4.5, 2), (1.0, 1), (9.0, None)], "prediction double, y int")
    row = MT.metrics(df, "y").first()
    assert row.rmse == pytest.approx(math.sqrt((0.25 + 6.25) / 3))
    assert row.mae == pytest.approx(1.0) and row.within_1 == pytest.approx(2 / 3)


@pytest.mark.parametrize("kind, params", [("boosted", {"maxIter": 5}), ("poisson", {}), ("forest", {"numTrees": 5})])
def test_models_train_save_and_score(matrix, tmp_path, kind, params):
    past, ahead = matrix.where("game_pk < 180"), matrix.where("game_pk >= 180")
    fitted = MT.train(past, ["x1_mean_3", "x2_mean_3", "empty_mean_3"], kind=kind, eval_df=ahead, categorical=["home_team"], params=params)
    row = fitted.evaluate(ahead).first()
    assert fitted.features == ["x1_mean_3", "x2_mean_3"]
    assert 0 < row.rmse < 4 and row.mae <= row.rmse and 0 <= row.within_1 <= 1
    top = fitted.importances(matrix.sparkSession).first()
    assert top.feature in ("x1_mean_3", "home_team")
    fitted.save(str(tmp_path / kind))
    again = MT.Trained.load(matrix.sparkSession, str(tmp_path / kind))
    assert (again.features, again.categorical, again.target) == (fitted.features, fitted.categorical, fitted.target)
    assert again.evaluate(ahead).first() == row


def test_cross_validation_search_and_holdout(matrix):
    order = ["game_date", "game_pk"]
    names = ["x1_mean_3", "x2_mean_3"]
    scores = MT.cross_validate(matrix, names, order, n_splits=2, kind="poisson")
    assert len(scores) == 2 and all(s > 0 for s in scores)
    best, trials = MT.random_search(matrix, names, order, n_trials=2, n_splits=2, kind="poisson")
    first = trials.first()
    assert set(best) == {"regParam"} and trials.count() == 2 and first.rmse == trials.agg(F.min("rmse")).first()[0]
    _, scored = MT.evaluate_holdout(matrix, names, 2024, train_years=(2023, 2024), test_years=(2024, 2025), kind="poisson")
    assert {r.part for r in scored.collect()} == {"test", "holdout"}


def test_permutation_importance_finds_the_used_feature(matrix):
    fitted = MT.train(matrix, ["x1_mean_3", "x2_mean_3"], kind="forest", params={"numTrees": 5})
    got = MT.permutation_importance(fitted, matrix, ["game_date", "game_pk"]).collect()
    assert got[0].feature == "x1_mean_3" and all(r.importance > 0 for r in got)


def test_held_out_rows_do_not_fill_in(matrix):
    past = matrix.where("game_pk < 180")
    ahead = matrix.where("game_pk >= 180").withColumn("x1_mean_3", F.lit(1000.0))
    fitted = MT.train(past, ["x1_mean_3"], eval_df=ahead, params={"maxIter": 2})
    mean = past.agg(F.avg("x1_mean_3")).first()[0]
    assert fitted.model.stages[0].surrogateDF.first()[0] == pytest.approx(mean)


def test_best_round_looks_ahead_by_patience():
    assert MT.best_round([5, 4, 3, 3.5, 3.4, 2], 2) == (3, True)
    assert MT.best_round([5, 4, 3, 3.5, 3.4, 2], 3) == (6, False)
    assert MT.best_round([2.0, 2.0 - 1e-12, 2.0], 2) == (1, True)
    assert MT.best_round([1.0], 5) == (1, False)


def test_boosting_is_cut_at_its_best_round(matrix):
    past, ahead = matrix.where("game_pk < 180"), matrix.where("game_pk >= 180")
    params = {"maxIter": 12, "stepSize": 0.9, "maxDepth": 5}
    cut = MT.train(past, ["x1_mean_3", "x2_mean_3"], eval_df=ahead, params=params, patience=3)
    rounds = cut.model.stages[-1].getNumTrees
    scores = [
        MT.train(past, ["x1_mean_3", "x2_mean_3"], params={**params, "maxIter": n}).evaluate(ahead).first().rmse
        for n in (rounds, rounds + 1)
    ]
    assert 1 <= rounds <= 12 and cut.evaluate(ahead).first().rmse == pytest.approx(scores[0])
    assert rounds == 12 or scores[0] <= scores[1] + 1e-9


def test_search_makes_folds_once_and_fits_a_draw_once(matrix, monkeypatch):
    made, fitted = [], []
    folds, train = MT.time_folds, MT.train
    monkeypatch.setattr(MT, "time_folds", lambda *a, **k: made.append(1) or folds(*a, **k))
    monkeypatch.setattr(MT, "train", lambda *a, **k: fitted.append(1) or train(*a, **k))
    MT.random_search(
        matrix, ["x1_mean_3"], ["game_date", "game_pk"], n_trials=6, n_splits=2, kind="forest",
        space={"maxDepth": ("int", 1, 2)}, fixed={"numTrees": 1},
    )
    assert len(made) == 1 and len(fitted) <= 4
