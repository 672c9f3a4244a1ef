"""Feature tables and matrix: no leaks, rows kept, plans of the intended shape."""

import pytest
from pyspark.sql import functions as F

from lagwise.operators import rolling
from lagwise.plans import baseball as B
from lagwise.plans import features, matrix
from lagwise.plans import pitch_log as P
from lagwise.session import settle
from workload.common import orders
from workload.pitches import box_scores, injuries, lineups, pitch_log, players

SF_DIR = "/root/testdata/sf0.001"
SMALL = {"windows": (3,), "halflife": 7}


@pytest.fixture(scope="module")
def base(spark):
    log = pitch_log(spark, SF_DIR)
    starters = settle(P.pitcher_games(log.drop("leverage_index")), "starters")
    batters = settle(P.batter_games(log, P.starters(log)), "batters")
    teams = P.team_batting(batters, starters)
    matchups = settle(features.matchup_details(starters, teams, box_scores(spark, SF_DIR)), "matchups")
    return starters, batters, matchups


def content(df):
    names = [f"round({c}, 9) as {c}" if t == "double" else c for c, t in df.dtypes]
    return df.selectExpr(*sorted(names))


def test_later_games_change_nothing_before_them(spark, base):
    starters, _, _ = base
    cut = starters.agg(F.percentile_approx("game_date", 0.6)).first()[0]
    extra = (injuries(spark, SF_DIR), players(spark, SF_DIR))
    whole = features.pitcher_features(starters, *extra, values=["strikeouts", "fip"], **SMALL)
    early = features.pitcher_features(starters.where(F.col("game_date") <= cut), *extra, values=["strikeouts", "fip"], **SMALL)
    kept = whole.where(F.col("game_date") <= cut)
    assert early.count() > 0
    assert content(kept).exceptAll(content(early)).isEmpty() and content(early).exceptAll(content(kept)).isEmpty()


def test_rows_without_the_key_stay(base):
    _, _, matchups = base
    df = features.contextual_features(matchups, **SMALL)
    assert df.count() == matchups.count()
    unknown = df.where("hp_umpire is null")
    assert unknown.count() > 0 and unknown.where("ump_strikeouts_mean_3 is not null").isEmpty()


def test_hot_keys_give_the_same_context(base):
    _, _, matchups = base
    whole = features.contextual_features(matchups, max_rows=None, **SMALL)
    cut = features.contextual_features(matchups, max_rows=2, **SMALL)
    assert content(whole).exceptAll(content(cut)).isEmpty() and whole.count() == cut.count()


def test_matrix(spark, base):
    starters, batters, matchups = base
    made = {
        "pitcher": features.pitcher_features(starters, values=["strikeouts", "fip"], **SMALL),
        "context": features.contextual_features(matchups, **SMALL),
        "opponent": features.opponent_features(matchups, batters, starters, **SMALL),
        "history": features.pair_history(batters, starters, **SMALL),
    }
    pitcher, context, opponent, history = (settle(df, name) for name, df in made.items())
    df = matrix.build_matrix(
        pitcher, [opponent, context], lineups(spark, SF_DIR), history, unique=True, windows=(3,), train_years=(2022, 2023)
    )
    df = settle(df, "matrix")
    names = set(df.columns)
    assert df.count() == starters.count()
    assert {"game_pk", "pitcher_id", "strikeouts", "fip_mean_3", "fip_ewm_7", "opp_batter_batter_so_rate_mean_3"} <= names
    # raw numbers of the same game and list columns are gone; identifiers are not encoded
    assert not {"pitches", "fip", "bat_ops", "away_pitcher_ids", "away_starting_pitcher_id"} & names
    assert "weather_enc" in names and "opponent_team_enc" not in names and "pitching_team_enc" not in names
    fitted = df.where("year(game_date) in (2022, 2023)").groupBy("weather").agg(F.avg("strikeouts").alias("m"))
    off = df.join(fitted, "weather").where("abs(weather_enc - m) > 1e-9")
    assert off.isEmpty()


def test_catchers_come_from_the_lineup_if_it_says(spark, base):
    starters, _, _ = base
    log = pitch_log(spark, SF_DIR)
    inferred = P.first_catchers(log)
    metrics = P.catcher_games(log)
    listed = lineups(spark, SF_DIR).join(inferred, ["game_pk", "team"], "left")
    a = features.catcher_features(listed, metrics, starters, **SMALL)
    b = features.catcher_features(lineups(spark, SF_DIR), metrics, starters, inferred, **SMALL)
    assert content(a).exceptAll(content(b)).isEmpty() and a.count() == b.count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bundle_plan_has_one_exchange_and_a_narrow_scan(spark):
    df = orders(spark, SF_DIR)
    one = plan_of(rolling.rolling_bundle(df, ["o_custkey"], ["day", "o_orderkey"], ["o_totalprice"], halflife=7).select(
        "o_orderkey", "o_totalprice_mean_50", "o_totalprice_ewm_7"))
    assert one.count("Exchange") == 1 and one.count("Sort [") == 2
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderdate" in one
    assert "PushedFilters: [IsNotNull(o_custkey)]" in one


def test_context_plan_has_one_exchange_per_bundle(base):
    _, _, matchups = base
    plan = plan_of(features.contextual_features(matchups, **SMALL))
    assert plan.count("Exchange hashpartitioning") == 3
    assert plan.count("BroadcastHashJoin") == 2


def test_team_hand_columns_are_not_left_raw(base):
    starters, batters, matchups = base
    df = features.opponent_features(matchups, batters, starters, **SMALL)
    assert not set(B.TEAM_HAND_ROLLING) & set(df.columns)
    assert "team_hand_team_k_rate_mean_3" in df.columns and df.count() == matchups.count()
