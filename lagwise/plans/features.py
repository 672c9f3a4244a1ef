"""Feature tables: one lazy plan each, leak-free against the current game."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.functions import aggregates as A
from lagwise.functions import scalars as X
from lagwise.operators.aggregates import pivot_first
from lagwise.operators.clean import as_numbers
from lagwise.operators.intervals import stint_state
from lagwise.operators.joins import coalescing_join, fill_from, lookup_join, shared_keys
from lagwise.operators.rolling import (
    Bundle,
    numeric_columns,
    rest_days,
    rolling_bundle,
    rolling_bundles,
    season_day,
    sum_last_days,
    sum_last_rows,
)
from lagwise.operators.sequence import MAX_ROWS_PER_TASK, measure
from lagwise.plans import baseball as B
from lagwise.plans.pitch_log import by_hand


def _bundle(df, keys, order, values, prefix, windows, halflife, max_rows):
    return rolling_bundle(
        df,
        keys,
        order,
        values,
        windows=windows,
        halflife=halflife,
        prefix=prefix,
        max_rows=max_rows,
        keep_null_keys=True,
    )


def _part(keys, values, prefix, windows, halflife, sizes) -> Bundle:
    return Bundle(tuple(keys), tuple(BY_GAME), values, tuple(windows), halflife, prefix, sizes, keep_null_keys=True)


def matchup_stats(starters: DataFrame, team_bat: DataFrame) -> DataFrame:
    """Starter rows with the batting of the team they faced."""
    keys = shared_keys(
        team_bat, ["game_pk", "pitcher_id", "opponent_team"], ["game_pk", "pitching_team", "opponent_team"]
    )
    return coalescing_join(starters, team_bat, keys, "left")


def matchup_details(starters: DataFrame, team_bat: DataFrame, boxscores: DataFrame) -> DataFrame:
    """Starters, opposing batting and the box score; ``game_date`` is filled from the box score."""
    for side in ("away", "home"):
        if f"{side}_pitcher_ids" in boxscores.columns:
            boxscores = boxscores.withColumn(
                f"{side}_starting_pitcher_id", X.first_of_json_list(f"{side}_pitcher_ids")
            )
    return coalescing_join(matchup_stats(starters, team_bat), boxscores, ["game_pk"], "left")


def injury_columns(df: DataFrame, injuries: DataFrame | None) -> DataFrame:
    if injuries is None:
        return df.withColumns(
            {"on_il": F.lit(0).cast("long"), "days_since_il": F.lit(None).cast("long")}
        )
    return stint_state(df, injuries, "pitcher_id", "game_date", "player_id")


def age_column(df: DataFrame, players: DataFrame | None) -> DataFrame:
    if players is None or "birth_date" not in players.columns:
        return df.withColumn("pitcher_age", F.lit(None).cast("double"))
    births = players.groupBy(F.col("player_id").alias("pitcher_id")).agg(F.min("birth_date").alias("_birth"))
    aged = lookup_join(df, births, ["pitcher_id"])
    return aged.withColumn("pitcher_age", X.age_years("game_date", F.col("_birth").cast("date"))).drop("_birth")


def pitcher_features(
    games: DataFrame,
    injuries: DataFrame | None = None,
    players: DataFrame | None = None,
    values: Sequence[str] = tuple(B.PITCHER_ROLLING),
    windows: Sequence[int] = B.ROLLING_WINDOWS,
    halflife: float | None = B.EWM_HALFLIFE,
    max_rows: int | None = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Calendar, workload, injury, age and rolling columns per starter game."""
    # Joins below keep the rows as they are, so one look at the keys serves all windows.
    max_rows = measure(games, ["pitcher_id"], max_rows)
    df = games.withColumn("game_date", F.col("game_date").cast("date"))
    df = season_day(df, "game_date")
    df = df.withColumn("month_bucket", X.month_bucket("game_date"))
    df = rest_days(df, ["pitcher_id"], ["game_date", "game_pk"], max_rows=max_rows)
    df = sum_last_days(
        df,
        ["pitcher_id"],
        "game_date",
        {"pitches_last_7d": ("pitches", 7), "season_ip_last_30d": ("innings_pitched", 30)},
        max_rows=max_rows,
    )
    df = age_column(injury_columns(df, injuries), players)
    return _bundle(df, ["pitcher_id"], ["game_date", "game_pk"], values, "", windows, halflife, max_rows)


def workload_features(
    games: DataFrame, injuries: DataFrame | None = None, max_rows: int | None = MAX_ROWS_PER_TASK
) -> DataFrame:
    """Sums over the previous 7 and 30 appearances (rows, not days) and injury columns."""
    df = games.withColumn("game_date", F.col("game_date").cast("date"))
    df = sum_last_rows(
        df,
        ["pitcher_id"],
        ["game_date", "game_pk"],
        {"pitches_last_7_games": ("pitches", 7), "ip_last_30_games": ("innings_pitched", 30)},
        max_rows=max_rows,
    )
    return injury_columns(df, injuries)


def hand_rates(batters: DataFrame, starters: DataFrame) -> DataFrame:
    """Team strikeout rate and OPS per (game, team, hand of the starter faced)."""
    hands = starters.select("game_pk", "pitcher_id", "pitcher_hand")
    return (
        batters.join(hands, ["game_pk", "pitcher_id"])
        .groupBy("game_pk", "opponent_team", "pitcher_hand")
        .agg(
            F.expr(A.ratio("sum(strikeouts)", "sum(plate_appearances)")).alias("team_k_rate"),
            F.expr(A.ratio_of_sums("ops", "plate_appearances")).alias("team_ops"),
        )
    )


def opponent_rows(matchups: DataFrame, batters: DataFrame, starters: DataFrame) -> DataFrame:
    """Matchups with the opponent's rates against the starter's hand: a function of the game."""
    rates = hand_rates(batters, starters)
    by_side = pivot_first(
        rates, ["game_pk", "opponent_team"], "pitcher_hand", {"L": "L", "R": "R"}, {"team_ops": "team_ops_vs_{}HP"}
    )
    df = as_numbers(matchups, ["temp", "elevation", "humidity"])
    df = df.withColumn("game_date", F.col("game_date").cast("date"))
    df = coalescing_join(df, rates.drop("team_ops"), ["game_pk", "opponent_team", "pitcher_hand"])
    df = coalescing_join(df, by_side, ["game_pk", "opponent_team"])
    sides = {"bat_ops": "bat_ops", "bat_strikeout_rate": "bat_k_rate"}
    return by_hand(df, {s: o for s, o in sides.items() if s in df.columns})


BY_GAME = ["game_date", "game_pk", "pitcher_id"]
PAIR, HAND = ["pitcher_id", "opponent_team"], ["opponent_team", "pitcher_hand"]


def opponent_features(
    matchups: DataFrame,
    batters: DataFrame,
    starters: DataFrame,
    windows: Sequence[int] = B.ROLLING_WINDOWS,
    halflife: float | None = B.EWM_HALFLIFE,
    max_rows: int | None = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Rolling columns per (pitcher, opponent) and per (opponent, hand)."""
    df = opponent_rows(matchups, batters, starters)
    pair_sizes, side_sizes = measure(matchups, PAIR, max_rows), measure(matchups, HAND, max_rows)
    hand_values = [c for c in B.TEAM_HAND_ROLLING if c in df.columns]
    parts = [(PAIR, B.CONTEXT_ROLLING, "opp_", pair_sizes), (HAND, hand_values, "team_hand_", side_sizes)]
    df = rolling_bundles(df, [_part(keys, values, prefix, windows, halflife, sizes) for keys, values, prefix, sizes in parts])
    return df.drop(*hand_values)


def with_surroundings(matchups: DataFrame) -> DataFrame:
    """Weather numbers, weekday, travel distance and park factor."""
    df = matchups.withColumn("game_date", F.col("game_date").cast("date"))
    df = as_numbers(df, ["temp", "elevation", "humidity"])
    if "wind" in df.columns:
        df = df.withColumn("wind_speed", X.first_number("wind"))
    df = df.withColumn("day_of_week", X.day_of_week("game_date"))
    parks = B.ballparks(df.sparkSession)
    home = parks.select(
        F.col("team").alias("home_team"),
        "stadium",
        "park_factor",
        F.col("latitude").alias("_home_lat"),
        F.col("longitude").alias("_home_lon"),
    )
    away = parks.select(
        F.col("team").alias("_away"), F.col("latitude").alias("_away_lat"), F.col("longitude").alias("_away_lon")
    )
    visitor = F.col("opponent_team") if "opponent_team" in df.columns else F.lit(None).cast("string")
    if "pitching_team" in df.columns:
        # A missing team differs from the home team, so the pitcher's team is the visitor.
        visitor = F.when(
            F.col("pitching_team").eqNullSafe(F.col("home_team")), visitor
        ).otherwise(F.col("pitching_team"))
    df = df.withColumn("_away", visitor)
    df = df.join(F.broadcast(home), "home_team", "left").join(F.broadcast(away), "_away", "left")
    distance = X.haversine_miles(F.col("_away_lat"), F.col("_away_lon"), F.col("_home_lat"), F.col("_home_lon"))
    return df.withColumn("travel_distance", distance).drop("_away", "_home_lat", "_home_lon", "_away_lat", "_away_lon")


SURROUNDING_KEYS = (("hp_umpire", "ump_"), ("weather", "wx_"), ("home_team", "venue_"))


def contextual_features(
    matchups: DataFrame,
    windows: Sequence[int] = B.ROLLING_WINDOWS,
    halflife: float | None = B.EWM_HALFLIFE,
    max_rows: int | None = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Surroundings and rolling columns per umpire, weather and venue.

    These keys have few values, so each holds many rows: they are the hot keys that
    ``lay_out`` cuts into blocks. A row without the key (say, no umpire known) keeps NULL
    rolling columns of that bundle.
    """
    df = with_surroundings(matchups)
    present = [(key, prefix, measure(matchups, [key], max_rows)) for key, prefix in SURROUNDING_KEYS if key in df.columns]
    return rolling_bundles(
        df, [_part([key], B.CONTEXT_ROLLING, prefix, windows, halflife, sizes) for key, prefix, sizes in present]
    )


def pair_history(
    batters: DataFrame,
    starters: DataFrame | None = None,
    windows: Sequence[int] = B.ROLLING_WINDOWS,
    halflife: float | None = B.EWM_HALFLIFE,
) -> DataFrame:
    """Rolling history of each (pitcher, batter) pair, one row per pair and day.

    A pair has at most as many rows as there are days, so no pair can be hot.
    """
    df = batters
    if "game_date" not in df.columns:
        df = fill_from(df, starters, ["game_pk"], "game_date")
    df = df.withColumn("game_date", F.col("game_date").cast("date"))
    keys = ["pitcher_id", "batter_id"]
    cells = [
        F.min("game_pk").alias("game_pk"),
        F.sum("plate_appearances").alias("plate_appearances"),
        F.sum("strikeouts").alias("strikeouts"),
        F.avg("ops").alias("ops"),
    ]
    cells += [F.sum(c).alias(c) for c in ("swings", "whiffs") if c in df.columns]
    daily = df.dropna(subset=[*keys, "game_date"]).groupBy(*keys, "game_date").agg(*cells)
    whiffs = (
        X.ratio("whiffs", "swings") if {"swings", "whiffs"} <= set(df.columns) else F.lit(None).cast("double")
    )
    daily = daily.withColumns(
        {
            "batter_so_rate": X.ratio("strikeouts", "plate_appearances"),
            "batter_whiff_rate": whiffs,
            "batter_ops": F.col("ops"),
        }
    )
    return _bundle(
        daily,
        keys,
        ["game_date", "game_pk"],
        ["batter_so_rate", "batter_ops", "batter_whiff_rate"],
        "",
        windows,
        halflife,
        None,
    )


def lineup_values(lineups: DataFrame) -> list[str]:
    ids = {"game_pk", "pitcher_id", "batter_id", "batting_order", "catcher_id"}
    return [c for c in numeric_columns(lineups) if c not in ids]


def lineup_games(lineups: DataFrame, starters: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    """The mean of each lineup's values per (game, pitcher) that met it."""
    values = lineup_values(lineups) if values is None else values
    faced = starters.select(
        "game_pk", "pitcher_id", F.col("game_date").cast("date").alias("game_date"), F.col("opponent_team").alias("_team")
    )
    if "pitcher_id" in lineups.columns:
        joined = lineups.drop("game_date").join(faced.drop("_team"), ["game_pk", "pitcher_id"])
    else:
        team = "team" if "team" in lineups.columns else "opponent_team"
        joined = lineups.drop("game_date").withColumnRenamed(team, "_team").join(faced, ["game_pk", "_team"])
    return joined.groupBy("game_pk", "pitcher_id", "game_date").agg(*[F.avg(c).alias(c) for c in values])


def lineup_trends(
    lineups: DataFrame,
    starters: DataFrame,
    values: Sequence[str] | None = None,
    windows: Sequence[int] = B.ROLLING_WINDOWS,
    halflife: float | None = B.EWM_HALFLIFE,
    max_rows: int | None = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Rolling lineup strength met by each pitcher.

    Lineups have a row per batter; they are averaged to one row per (game, pitcher)
    first, so that the previous row is the previous game.
    """
    values = lineup_values(lineups) if values is None else values
    games = lineup_games(lineups, starters, values)
    sizes = measure(starters, ["pitcher_id"], max_rows)
    return _bundle(games, ["pitcher_id"], ["game_date", "game_pk"], values, "lineup_", windows, halflife, sizes)


def slot_trends(
    lineups: DataFrame,
    values: Sequence[str],
    windows: Sequence[int] = B.ROLLING_WINDOWS,
    halflife: float | None = B.EWM_HALFLIFE,
    slots: Sequence[int] = tuple(range(1, 10)),
    max_rows: int | None = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Rolling columns per (team, batting slot), spread to ``slot{n}_...`` columns, plus the
    mean projected strikeout share of the lineup if it is given."""
    df = lineups.withColumn("game_date", F.col("game_date").cast("date"))
    keys = ["game_pk", "opponent_team", "game_date"]
    rolled = _bundle(
        df, ["opponent_team", "batting_order"], ["game_date", "game_pk"], values, "lineup_", windows, halflife, max_rows
    )
    made = [c for c in rolled.columns if c.startswith("lineup_")]
    wide = pivot_first(
        rolled, keys, "batting_order", {n: n for n in slots}, {c: "slot{}_" + c for c in made}
    )
    if "projected_k_pct" in df.columns:
        means = df.groupBy(*keys).agg(F.avg("projected_k_pct").alias("projected_lineup_k_pct"))
        wide = wide.join(means, keys, "left")
    return wide


def catcher_rows(
    lineups: DataFrame, metrics: DataFrame, starters: DataFrame, inferred: DataFrame | None = None
) -> DataFrame:
    """Framing metrics of the catcher each starter works with: a function of the game.

    The catcher comes from the lineup, or from ``inferred`` (game, team, catcher) if the
    lineup does not say. One row per (game, catcher, pitcher) is kept.
    """
    if "catcher_id" in lineups.columns:
        known = lineups.select("game_pk", "team", "catcher_id").distinct()
    else:
        known = lineups.select("game_pk", "team").distinct().join(inferred, ["game_pk", "team"], "left")
    dated = starters.select(
        "game_pk", F.col("pitching_team").alias("team"), "pitcher_id", F.col("game_date").cast("date").alias("game_date")
    )
    return coalescing_join(
        known.join(dated, ["game_pk", "team"], "left"),
        metrics.withColumn("game_date", F.col("game_date").cast("date")),
        ["game_pk", "catcher_id"],
    ).distinct()


def catcher_features(
    lineups: DataFrame,
    metrics: DataFrame,
    starters: DataFrame,
    inferred: DataFrame | None = None,
    windows: Sequence[int] = B.ROLLING_WINDOWS,
    halflife: float | None = B.EWM_HALFLIFE,
    max_rows: int | None = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Rolling framing columns of the catcher each starter works with."""
    joined = catcher_rows(lineups, metrics, starters, inferred)
    values = [c for c in numeric_columns(metrics) if c not in ("game_pk", "catcher_id")]
    sizes = measure(joined, ["catcher_id"], max_rows)
    return _bundle(
        joined, ["catcher_id"], ["game_date", "game_pk", "pitcher_id"], values, "catcher_", windows, halflife, sizes
    )
