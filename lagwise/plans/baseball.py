"""Preset for pitch logs: constants and column lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: they must equal the definitions of the metrics -----------------

FASTBALL_TYPES = ["FF", "FA", "FT", "SI", "F4", "F2", "FC", "FS", "SF", "FO"]
BREAKING_TYPES = ["SL", "CU", "KC", "SV", "SC"]
OFFSPEED_TYPES = ["CH", "FO", "KN", "EP"]
PITCH_CLASSES = {
    "slider": ["SL"],
    "curve": ["CU", "KC", "SV", "SC"],
    "changeup": ["CH"],
    "cutter": ["FC"],
    "sinker": ["SI", "FT"],
    "splitter": ["FS", "SF"],
}
STRIKEOUTS = ["strikeout", "strikeout_double_play"]
WALKS = ["walk", "intent_walk"]
HITS = ["single", "double", "triple", "home_run"]
NOT_AT_BATS = ["walk", "intent_walk", "hit_by_pitch", "catcher_interf", "sac_fly", "sac_bunt"]

PITCH_KEYS = ["game_pk", "pitcher", "inning", "batter", "pitch_number"]
PITCHER_COLUMNS = [
    "game_pk", "game_date", "pitcher", "batter", "p_throws", "home_team", "away_team",
    "inning_topbot", "at_bat_number", "pitch_number", "pitch_type", "description", "zone",
    "plate_x", "plate_z", "events", "release_speed", "release_spin_rate", "pfx_x", "pfx_z",
    "release_extension", "release_pos_z", "launch_speed", "launch_angle", "inning", "type",
    "strikes", "balls", "home_score", "away_score", "on_1b", "on_2b", "on_3b", "woba_value",
    "woba_denom",
]
BATTER_COLUMNS = [
    "game_pk", "game_date", "batter", "pitcher", "stand", "inning_topbot", "home_team",
    "away_team", "at_bat_number", "pitch_number", "description", "events", "balls", "strikes",
    "leverage_index", "inning", "home_score", "away_score", "on_1b", "on_2b", "on_3b",
    "woba_value", "woba_denom",
]

# team, ballpark, latitude, longitude, park factor
BALLPARKS = [
    ("ARI", "Chase Field", 33.4455, -112.0667, 99),
    ("ATL", "Truist Park", 33.8908, -84.4671, 101),
    ("BAL", "Oriole Park at Camden Yards", 39.2839, -76.6217, 97),
    ("BOS", "Fenway Park", 42.3467, -71.0972, 104),
    ("CHC", "Wrigley Field", 41.9484, -87.6553, 100),
    ("CWS", "Guaranteed Rate Field", 41.8309, -87.6339, 102),
    ("CIN", "Great American Ball Park", 39.0968, -84.5076, 103),
    ("CLE", "Progressive Field", 41.4954, -81.6850, 98),
    ("COL", "Coors Field", 39.7561, -104.9942, 115),
    ("DET", "Comerica Park", 42.3390, -83.0485, 99),
    ("HOU", "Minute Maid Park", 29.7571, -95.3557, 101),
    ("KC", "Kauffman Stadium", 39.0514, -94.4803, 98),
    ("LAA", "Angel Stadium", 33.8003, -117.8827, 99),
    ("LAD", "Dodger Stadium", 34.0739, -118.2390, 100),
    ("MIA", "loanDepot Park", 25.7781, -80.2197, 96),
    ("MIL", "American Family Field", 43.0283, -87.9717, 101),
    ("MIN", "Target Field", 44.9817, -93.2772, 99),
    ("NYM", "Citi Field", 40.7571, -73.8458, 98),
    ("NYY", "Yankee Stadium", 40.8296, -73.9262, 103),
    ("OAK", "Oakland Coliseum", 37.7534, -122.2005, 95),
    ("PHI", "Citizens Bank Park", 39.9057, -75.1664, 103),
    ("PIT", "PNC Park", 40.4469, -80.0057, 97),
    ("SD", "Petco Park", 32.7076, -117.1571, 96),
    ("SF", "Oracle Park", 37.7786, -122.3893, 95),
    ("SEA", "T-Mobile Park", 47.5914, -122.3325, 97),
    ("STL", "Busch Stadium", 38.6226, -90.1928, 98),
    ("TB", "Tropicana Field", 27.7683, -82.6534, 97),
    ("TEX", "Globe Life Field", 32.7510, -97.0828, 100),
    ("TOR", "Rogers Centre", 43.6414, -79.3894, 102),
    ("WSH", "Nationals Park", 38.8731, -77.0074, 100),
]

ROLLING_WINDOWS = (3, 5, 10, 20, 50)
EWM_HALFLIFE = 7
PITCHER_ROLLING = [
    "strikeouts", "pitches", "fip", "csw_pct", "swinging_strike_rate", "first_pitch_strike_rate",
    "fastball_pct", "fastball_whiff_rate", "two_strike_k_rate", "high_leverage_k_rate",
    "woba_runners_on", "slider_pct", "curve_pct", "changeup_pct", "cutter_pct", "sinker_pct",
    "splitter_pct", "zone_pct", "chase_rate", "slider_whiff_rate", "curve_whiff_rate",
    "changeup_whiff_rate", "cutter_whiff_rate", "sinker_whiff_rate", "splitter_whiff_rate",
    "avg_release_speed", "max_release_speed", "avg_spin_rate", "release_height",
    "hard_hit_rate", "offspeed_to_fastball_ratio", "fastball_then_breaking_rate",
    "unique_pitch_types", "batter_so_rate", "batter_ops", "batter_whiff_rate",
]
CONTEXT_ROLLING = [
    "strikeouts", "pitches", "temp", "wind_speed", "elevation", "humidity", "park_factor",
    "team_k_rate", "bat_whiff_rate", "bat_avg", "bat_obp", "bat_slugging", "bat_ops",
    "bat_woba", "team_ops_vs_LHP", "team_ops_vs_RHP", "bat_ops_vs_LHP", "bat_ops_vs_RHP",
    "bat_k_rate_vs_LHP", "bat_k_rate_vs_RHP",
]
TEAM_HAND_ROLLING = [
    "team_k_rate", "bat_ops_vs_LHP", "bat_ops_vs_RHP", "bat_k_rate_vs_LHP", "bat_k_rate_vs_RHP",
]
ALLOWED_BASE_NUMERIC = [
    "temp", "wind_speed", "elevation", "rest_days", "pitches_last_7d", "season_ip_last_30d",
    "on_il", "days_since_il", "pitcher_age", "humidity", "park_factor", "team_k_rate",
    "day_of_week", "travel_distance", "days_into_season",
]
IDENTIFIERS = ["game_pk", "game_date", "pitcher_id", "pitching_team", "opponent_team"]
NEVER_ENCODED = [
    "away_pitcher_ids", "home_pitcher_ids", "away_starting_pitcher_id",
    "home_starting_pitcher_id", "scraped_timestamp",
]
TRAIN_YEARS = (2016, 2017, 2018, 2019, 2021, 2022, 2023)
TEST_YEARS = (2024, 2025)
TARGET = "strikeouts"

FEATURE_PREFIX_GROUPS = {
    "opp_": "Opponent",
    "team_": "Opponent",
    "team_hand_": "Opponent",
    "lineup_": "Opponent",
    "slot": "Opponent",
    "opp_batter_": "Opponent",
    "opp_lineup_": "Opponent",
    "batter_": "Opponent",
    "wx_": "Context",
    "venue_": "Context",
    "ump_": "Context",
    "catcher_": "Context",
    "temp": "Context",
    "wind_speed": "Context",
    "humidity": "Context",
    "elevation": "Context",
    "park_factor": "Context",
    "day_of_week": "Context",
    "travel_distance": "Context",
    "pitches_last_": "Context",
    "rest_days": "Context",
    "on_il": "Context",
    "days_since_il": "Context",
    "fastball_": "Pitch_Quality",
    "slider_": "Pitch_Quality",
    "curve_": "Pitch_Quality",
    "changeup_": "Pitch_Quality",
    "cutter_": "Pitch_Quality",
    "sinker_": "Pitch_Quality",
    "splitter_": "Pitch_Quality",
    "pfx_": "Pitch_Quality",
    "release_": "Pitch_Quality",
    "plate_": "Pitch_Quality",
    "spin": "Pitch_Quality",
    "whiff": "Pitch_Quality",
    "csw": "Pitch_Quality",
    "zone_": "Pitch_Quality",
    "chase_": "Pitch_Quality",
    "fastball_then_": "Pitch_Quality",
    "offspeed_to_": "Pitch_Quality",
    "unique_pitch_types": "Pitch_Quality",
}
FEATURE_NAME_GROUPS = {
    "pitches_last_7d": "Context",
    "rest_days": "Context",
    "on_il": "Context",
    "days_since_il": "Context",
    "day_of_week": "Context",
    "travel_distance": "Context",
    "days_into_season": "Context",
    "month_bucket": "Context",
}
DEFAULT_FEATURE_GROUP = "Performance"

# --- end of fixed values -----------------------------------------------------------


def ballparks(spark: SparkSession) -> DataFrame:
    """Thirty rows: always safe to broadcast."""
    return spark.createDataFrame(
        BALLPARKS, "team string, stadium string, latitude double, longitude double, park_factor long"
    )
