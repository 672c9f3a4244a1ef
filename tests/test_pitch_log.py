"""Pitch-log metrics on a game worked out by hand, and with groups cut into blocks."""

import pytest
from pyspark.sql import functions as F

from lagwise.plans import features
from lagwise.plans import pitch_log as P
from workload.pitches import pitch_log

COLUMNS = (
    "game_pk long, game_date date, pitcher long, batter long, p_throws string, stand string, home_team string,"
    " away_team string, inning_topbot string, at_bat_number int, pitch_number int, inning int, pitch_type string,"
    " description string, events string, type string, zone int, release_speed double, launch_speed double,"
    " launch_angle double, strikes int, balls int, home_score int, away_score int, on_1b long, on_2b long,"
    " on_3b long, woba_value double, woba_denom double, fielder_2 long"
)


def pitch(ab, pn, kind, text, event, call, **more):
    row = dict(
        game_pk=1, pitcher=10, batter=100 + ab, p_throws="L", stand="R", home_team="BOS", away_team="NYY", inning_topbot="Top",
        at_bat_number=ab, pitch_number=pn, inning=1 if ab < 3 else 7, pitch_type=kind, description=text, events=event, type=call,
        zone=5, release_speed=90.0 + pn, strikes=2, balls=1, home_score=1, away_score=1,
    )
    return {**row, **more}


GAME = [
    pitch(1, 1, "FF", "called_strike", None, "S"),
    pitch(1, 2, "SL", "swinging_strike", None, "S", zone=12),
    pitch(1, 3, "FF", "swinging_strike_blocked", "strikeout", "S", zone=None),
    pitch(2, 1, "CU", "ball", None, "B", zone=13, on_1b=7),
    pitch(2, 2, "FO", "hit_into_play", "single", "X", launch_speed=99.0, launch_angle=28.0, woba_value=0.9, woba_denom=1.0),
    pitch(3, 1, None, None, None, "X", launch_speed=None, strikes=1, balls=2),
    pitch(3, 2, "CH", "foul_tip", "walk", "B", strikes=1, balls=3, woba_value=0.7, woba_denom=1.0),
]


@pytest.fixture(scope="module")
def game(spark):
    names = [c.split()[0] for c in COLUMNS.split(",")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in GAME], COLUMNS)
    return df.withColumn("game_date", F.lit("2024-04-01").cast("date"))


@pytest.mark.parametrize("max_rows", [None, 2])
def test_pitcher_metrics_by_hand(game, max_rows):
    r = P.pitcher_games(game, min_pitches=None, max_rows=max_rows).first().asDict()
    want = {
        "pitching_team": "BOS", "opponent_team": "NYY", "pitcher_hand": "L", "pitches": 7, "innings_pitched": 2,
        "batters_faced": 3, "strikeouts": 1, "swinging_strike_rate": 2 / 7, "first_pitch_strike_rate": 1 / 3,
        "csw_pct": 4 / 7, "fastball_pct": 2 / 7, "offspeed_to_fastball_ratio": 1 / 2,
        # FF then SL, FF then CU; the last pitch has no next one
        "fastball_then_breaking_rate": 2 / 6, "unique_pitch_types": 5, "zone_pct": 4 / 7,
        # out of zone (also without a zone): two swinging strikes and a ball
        "chase_rate": 2 / 3, "hard_hit_rate": 1 / 2, "barrel_rate": 1 / 2, "avg_launch_speed": 99.0,
        "slider_pct": 1 / 7, "slider_whiff_rate": 1.0, "cutter_whiff_rate": None, "fastball_whiff_rate": 1 / 2,
        "two_strike_k_rate": 1 / 2, "high_leverage_k_rate": 0.0, "woba_runners_on": 0.9,
        "fip": (13 * 0 + 3 * 1 - 2 * 1) / 2,
    }
    for name, value in want.items():
        assert r[name] == (pytest.approx(value) if isinstance(value, float) else value), name


def test_optional_columns(game):
    r = P.pitcher_games(game.drop("zone").withColumns({"plate_x": F.lit(0.0), "plate_z": F.lit(2.0)}), None).first()
    assert r.zone_pct == 1.0 and r.chase_rate is None
    bare = P.pitcher_games(game.drop("zone", "on_1b", "home_score", "strikes", "launch_angle"), None).first()
    assert bare.zone_pct is None and bare.woba_runners_on is None and bare.high_leverage_k_rate is None
    assert bare.two_strike_k_rate is None and bare.barrel_rate is None
    barrel = P.pitcher_games(game.withColumn("barrel", F.col("launch_speed").isNotNull().cast("int")), None).first()
    assert barrel.barrel_rate == 0.5


def test_starter_rule(game):
    assert P.starters(game).count() == 0
    assert [tuple(r) for r in P.starters(game, 6, 3).collect()] == [(1, 10)]
    assert P.pitcher_games(game, 6, 3).count() == 1


def test_batters_teams_and_catchers(game):
    b = {r.batter_id: r for r in P.batter_games(game).collect()}
    assert (b[101].plate_appearances, b[101].at_bats, b[101].strikeouts, b[101].whiffs) == (1, 1, 1, 2)
    assert b[102].slugging == 1.0 and b[102].ops == 2.0 and b[102].woba == 0.9
    assert b[103].at_bats == 0 and b[103].obp == 1.0 and b[103].avg is None and b[103].ops is None
    assert b[103].strikeout_rate_ahead == 0.0 and b[103].strikeout_rate_behind is None
    team = P.team_games(P.batter_games(game)).first()
    assert (team.bat_plate_appearances, team.bat_at_bats, team.bat_hits) == (3, 2, 1)
    assert team.bat_obp == pytest.approx(2 / 3) and team.bat_L_ops is None and team.bat_L_plate_appearances == 0
    assert team.bat_woba == pytest.approx((0.9 + 0.7) / 2)
    caught = game.withColumn("fielder_2", F.when(F.col("at_bat_number") < 3, 55))
    c = P.catcher_games(caught).first()
    assert c.catcher_id == 55 and c.framing_runs == 1 and c.called_strike_rate == pytest.approx(1 / 3)
    assert [tuple(r) for r in P.first_catchers(caught).collect()] == [(1, "BOS", 55)]


def test_blocks_give_the_same_tables(spark):
    log = pitch_log(spark, "/root/testdata/sf0.001")
    for build in (
        lambda n: P.pitcher_games(log.drop("leverage_index"), max_rows=n),
        lambda n: P.batter_games(log, max_rows=n),
    ):
        whole, cut = build(None), build(3)
        assert whole.count() == cut.count() > 0
        names = [f"round({c}, 9)" if t == "double" else c for c, t in whole.dtypes]
        assert whole.selectExpr(*names).exceptAll(cut.selectExpr(*names)).count() == 0


def test_workload_goldens(spark):
    games = spark.sql(
        "select * from values (1L, 1, date'2024-04-01', 80, 5), (2L, 1, date'2024-04-06', 85, 6), (3L, 1, date'2024-04-11', 90, 7)"
        " t(game_pk, pitcher_id, game_date, pitches, innings_pitched)"
    )
    got = features.workload_features(games).orderBy("game_pk").collect()
    assert [r.pitches_last_7_games for r in got] == [None, 80, 165]
    assert [r.ip_last_30_games for r in got] == [None, 5, 11]
    assert [r.on_il for r in got] == [0, 0, 0]
