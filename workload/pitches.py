"""A pitch log derived from ``events`` and the game tables built from it.

Eighty consecutive events make a game of twenty at-bats, ten for each side. The text is
plain SQL both engines read, so the SQL side starts from the same log.
"""

from __future__ import annotations

from workload.common import table

K = "cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') as bigint)"
TEAMS = "'ARI,BOS,COL,LAD,NYY,SEA,TEX,TOR,CHC,MIA,XXX'"
TYPES = "'FF,SL,CH,SI,CU,FC,FS,FO,KC,FT,FF,SL,KN,FA'"
TEXTS = "'swinging_strike,called_strike,ball,foul,foul_tip,hit_into_play,swinging_strike_blocked,missed_Swing,ball'"
ENDS = (
    "'strikeout,single,double,walk,home_run,field_out,strikeout_double_play,hit_by_pitch,triple,"
    "sac_fly,intent_walk,strikeout,field_out,strikeout,single,catcher_interf'"
)

PITCH_LOG = f"""
    with e as (
      select event_id, {K} as k, event_id % 80 as i, cast((event_id - event_id % 80) / 80 as bigint) as game from events),
    g as (
      select *, i % 4 + 1 as pitch_number, cast((i - i % 4) / 4 as bigint) as ab,
        game % 6 as home_no, 6 + game % 5 as away_no, cast((game - game % 6) / 6 as bigint) % 2 as turn from e),
    h as (
      select *, case when ab % 2 = 0 then home_no else away_no end as field_no,
        case when ab % 2 = 0 then away_no else home_no end as bat_no,
        cast((ab - ab % 2) / 2 as bigint) + 1 as inning from g)
    select 1000 + game as game_pk,
      cast('2022-04-01' as date) + cast((game * 7) % 1000 as int) as game_date,
      100 + field_no * 2 + turn
        + case when (game % 5 = 0 and inning >= 9) or (game % 7 = 0 and inning >= 8) then 1000 else 0 end as pitcher,
      5000 + bat_no * 9 + (inning - 1) % 9 as batter,
      case when (field_no + turn) % 3 = 1 then 'L' else 'R' end as p_throws,
      case when (bat_no + inning) % 3 = 0 then 'L' else 'R' end as stand,
      split_part({TEAMS}, ',', cast(home_no + 1 as int)) as home_team,
      split_part({TEAMS}, ',', cast(away_no + 1 as int)) as away_team,
      case when ab % 2 = 0 then 'Top' else 'Bot' end as inning_topbot,
      ab + 1 as at_bat_number, pitch_number, inning,
      case when k % 29 <> 0 then split_part({TYPES}, ',', cast(k % 14 + 1 as int)) end as pitch_type,
      case when event_id % 41 <> 0 then split_part({TEXTS}, ',', cast((k * 3 + event_id) % 9 + 1 as int)) end as description,
      case when pitch_number = 4 and k % 23 <> 0 then split_part({ENDS}, ',', cast((k + event_id) % 16 + 1 as int)) end as events,
      case (k + event_id) % 3 when 0 then 'S' when 1 then 'B' else 'X' end as type,
      case when k % 17 <> 0 then k % 14 + 1 end as zone,
      cast(k as double) / 41 - 1 as plate_x, cast((k * 7) % 50 as double) / 13 as plate_z,
      case when k % 19 <> 0 then 80 + 3 * sqrt(cast(k % 17 as double) + 0.3e0) end as release_speed,
      2000 + 10 * sqrt(cast(k * 7 as double) + 0.1e0) as release_spin_rate,
      cast(k as double) / 50 - 1 as pfx_x, cast((k * 3) % 40 as double) / 21 as pfx_z,
      6 + cast(k % 10 as double) / 7 as release_extension, 5 + sqrt(cast(k % 9 as double) + 0.2e0) as release_pos_z,
      case when k % 13 <> 0 then 70 + cast(k % 40 as double) end as launch_speed,
      case when k % 11 <> 0 then cast((k * 3) % 61 as double) - 20 end as launch_angle,
      (event_id + k) % 3 as strikes, k % 4 as balls, k % 5 as home_score, (k + event_id) % 4 as away_score,
      case when k % 3 = 0 then 9000 + k end as on_1b, case when k % 7 = 0 then 9100 + k end as on_2b,
      case when k % 31 = 0 then 9200 + k end as on_3b,
      case when pitch_number = 4 then sqrt(cast(k % 5 as double) + 0.3e0) end as woba_value,
      case when pitch_number = 4 then case when k % 6 = 0 then 0e0 else 1e0 end end as woba_denom,
      case when event_id % 37 <> 0 then 800 + field_no end as fielder_2,
      cast(k % 30 as double) / 10 as leverage_index,
      'R' as game_type
    from h"""

# One row per game, from the same events.
BOX_SCORES = f"""
    select game_pk, min(game_date) as game_date, min(home_team) as home_team, min(away_team) as away_team,
      case when game_pk % 9 <> 0 then split_part('Sunny,Clear,Cloudy,Dome', ',', cast(game_pk % 4 + 1 as int)) end as weather,
      case when game_pk % 13 = 0 then 'calm' else cast(game_pk % 25 as varchar(9)) || ' mph, Out' end as wind,
      case when game_pk % 11 = 0 then 'n/a' else cast(50 + game_pk % 45 as varchar(9)) end as temp,
      cast(game_pk % 1000 as double) as elevation, cast(30 + game_pk % 60 as double) as humidity,
      case when game_pk % 10 <> 0 then 'Ump ' || cast(game_pk % 8 as varchar(9)) end as hp_umpire,
      '[' || cast(min(case when inning_topbot = 'Bot' and inning = 1 then pitcher end) as varchar(9)) || ', 7]' as away_pitcher_ids,
      case when game_pk % 12 = 0 then '[]' else
        '[' || cast(min(case when inning_topbot = 'Top' and inning = 1 then pitcher end) as varchar(9)) || ']' end as home_pitcher_ids
    from pitches group by game_pk"""


def pitch_log(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(PITCH_LOG)


def box_scores(spark, sf_dir):
    pitch_log(spark, sf_dir).createOrReplaceTempView("pitches")
    return spark.sql(BOX_SCORES)


# One row per starting batter and game.
LINEUPS = """
    select game_pk, case when inning_topbot = 'Top' then away_team else home_team end as team, batter as batter_id,
      min((inning - 1) % 9 + 1) as batting_order, min(cast(batter % 13 as double) / 17) as lineup_avg_ops,
      min(cast((batter + game_pk) % 11 as double) / 31) as projected_k_pct
    from pitches group by 1, 2, 3"""
INJURIES = """
    select 100 + user_id % 24 as player_id, cast(ts as date) as start_date,
      case when event_id % 3 <> 0 then cast(ts as date) + cast(event_id % 40 as int) end as end_date
    from events where event_type = 'error' and event_id % 5 = 0"""
PLAYERS = """
    select 100 + c_custkey as player_id, cast('1985-01-01' as date) + cast((c_custkey * 37) % 5000 as int) as birth_date
    from customer"""


def lineups(spark, sf_dir):
    pitch_log(spark, sf_dir).createOrReplaceTempView("pitches")
    return spark.sql(LINEUPS)


def injuries(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(INJURIES)


def players(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(PLAYERS)
