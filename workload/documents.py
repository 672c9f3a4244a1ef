"""JSON documents built by Spark from the given tables, then flattened by the library.

The SQL side takes the same values straight from the tables, without any JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.operators import intervals, nested
from lagwise.sources import tables as S
from workload.common import d, i, orders, r, table, tidy
from workload.games import CHAIN
from workload.pitches import LINEUPS, box_scores, lineups, pitch_log


def _struct(**fields):
    return F.struct(*[F.expr(e).alias(n) if isinstance(e, str) else e.alias(n) for n, e in fields.items()])


def _feeds(spark, sf_dir):
    games = box_scores(spark, sf_dir)

    def team(side):
        league = "case when game_pk % 16 = 0 then 160 when game_pk % 2 = 0 then 103 else 104 end"
        name = f"case when game_pk % 17 = 0 then '' else {side}_team end"
        return _struct(abbreviation=name, league=_struct(id=league))

    officials = F.expr(
        "array(named_struct('officialType', 'First Base', 'official', named_struct('fullName', 'U1')),"
        " named_struct('officialType', 'Home Plate', 'official', named_struct('fullName', hp_umpire)),"
        " named_struct('officialType', 'Third Base', 'official', named_struct('fullName', 'early')),"
        " named_struct('officialType', case when game_pk % 2 = 0 then 'Second Base' end, 'official', named_struct('fullName', 'U2')),"
        " named_struct('officialType', 'Third Base', 'official', named_struct('fullName', concat('U', cast(game_pk % 7 as string)))))"
    )
    game = _struct(
        calendarEventID="case when game_pk % 3 = 0 then concat('14-1-', cast(game_date as string)) else concat('id-', cast(game_date as string), '-x') end",
        gameNumber="1",
        doubleHeader="'N'",
        gameDate="concat(cast(game_date as string), 'T17:10:00Z')",
    )
    data = _struct(
        game=game,
        teams=F.struct(team("away").alias("away"), team("home").alias("home")),
        venue=_struct(location=_struct(elevation="elevation")),
        weather=_struct(condition="weather", wind="wind", temp="temp"),
        datetime=_struct(
            dayNight="case when game_pk % 2 = 0 then 'day' else 'night' end",
            firstPitch="case when game_pk % 4 = 0 then 'TBD' else concat(cast(game_date as string), 'T17:10:00Z') end",
        ),
        status=_struct(abstractGameState="case when game_pk % 10 = 3 then 'Live' when game_pk % 10 = 4 then 'Game Over' else 'Final' end"),
    )
    pitchers = F.struct(
        _struct(pitchers=F.from_json("away_pitcher_ids", "array<bigint>")).alias("away"),
        _struct(pitchers=F.from_json("home_pitcher_ids", "array<bigint>")).alias("home"),
    )
    live = _struct(boxscore=_struct(officials=officials, teams=pitchers))
    return games.select("game_pk", F.to_json(_struct(gameData=data, liveData=live)).alias("body"))


def game_feed(spark, sf_dir):
    return tidy(nested.game_feed_rows(_feeds(spark, sf_dir))[0])


def game_feed_rejects(spark, sf_dir):
    return tidy(nested.game_feed_rows(_feeds(spark, sf_dir))[1])


def lineup_documents(spark, sf_dir):
    """Players by side as a JSON map, with substitutes and a catcher, back to lineup rows."""
    rows = lineups(spark, sf_dir)
    sides = pitch_log(spark, sf_dir).groupBy("game_pk").agg(F.min("home_team").alias("home_team"))
    player = F.expr(
        "named_struct('person', named_struct('id', batter_id), 'battingOrder', cast(batting_order * 100 + case when batter_id % 6 = 0 then 1 else 0 end as string),"
        " 'batSide', named_struct('code', case when batter_id % 2 = 0 then 'L' else 'R' end),"
        " 'position', named_struct('abbreviation', case when batting_order = 7 then 'C' else 'OF' end))"
    )
    players = (
        rows.join(sides, "game_pk")
        .withColumn("side", F.expr("case when team = home_team then 'home' else 'away' end"))
        .groupBy("game_pk", "side", "team")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("ID"), F.col("batter_id").cast("string")), player))).alias("players"))
        .withColumn("doc", F.expr("named_struct('team', named_struct('abbreviation', team), 'players', players)"))
    )
    teams = players.groupBy("game_pk").agg(
        F.max(F.when(F.col("side") == "home", F.to_json("doc"))).alias("home"),
        F.max(F.when(F.col("side") == "away", F.to_json("doc"))).alias("away"),
    )
    body = F.concat(F.lit('{"teams":{"home":'), "home", F.lit(',"away":'), "away", F.lit("}}"))
    return tidy(nested.lineup_rows(teams.select("game_pk", body.alias("body"))))


def _schedules(spark, sf_dir):
    """Schedule documents with up to eight games of a day: orders as games."""
    game = F.expr(
        "named_struct('gamePk', o_orderkey, 'teams', named_struct("
        "'away', named_struct('team', named_struct('id', 1 + o_orderkey % 30, 'abbreviation', 'AAA'),"
        "  'probablePitcher', case when o_orderkey % 7 <> 0 then named_struct('id', 1 + o_custkey, 'fullName', concat('P', o_custkey)) end),"
        "'home', named_struct('team', named_struct('id', 1 + o_orderkey % 29, 'abbreviation', 'HHH'),"
        "  'probablePitcher', named_struct('id', 1 + o_custkey % 50, 'fullName', case when o_orderkey % 11 <> 0 then concat('Q', o_orderkey) end))))"
    )
    # Keys are unique, so a document holds at most eight games.
    parts = orders(spark, sf_dir).groupBy("day", F.expr("o_orderkey div 8").alias("part"))
    days = parts.agg(F.collect_list(game).alias("games"))
    return days.select(F.col("day").alias("game_date"), F.to_json(_struct(dates=F.array(F.struct("games")))).alias("body"))


def schedule_pitchers(spark, sf_dir):
    return tidy(nested.probable_pitchers(_schedules(spark, sf_dir)))


def schedule_games(spark, sf_dir):
    return tidy(nested.game_ids(_schedules(spark, sf_dir)))


def schedule_names(spark, sf_dir):
    """Pitcher id to the last name seen, home and away stacked."""
    return tidy(S.names_from_schedule(nested.probable_pitchers(_schedules(spark, sf_dir))))


def transaction_stints(spark, sf_dir):
    """Transaction documents (up to 16 transactions of a day) to stints."""
    deal = F.expr(
        "named_struct('playerId', user_id, 'transactionDate', cast(to_date(ts) as string), 'description',"
        " case event_type when 'signup' then 'Placed RHP on the 15-day Injured List' when 'error' then 'Reinstated from the injured list'"
        " when 'click' then 'Signed to the injured list' else 'Optioned' end)"
    )
    parts = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.expr("event_id div 16").alias("part"))
    days = parts.agg(F.collect_list(deal).alias("transactions"))
    docs = days.select(F.to_json(F.struct("transactions")).alias("body"))
    # One action per player and day, so that the order inside a day is settled.
    daily = nested.injury_events(docs).groupBy("player_id", "date").agg(F.min("action").alias("action"))
    return tidy(intervals.stints_from_events(daily, ["player_id"], ["date"], "action"))


def odds_lines(spark, sf_dir):
    """Lines as events: one bookmaker, two markets, two outcomes each."""
    outcome = (
        "named_struct('name', concat('Player ', l_suppkey, {suffix}), 'price', {price},"
        " 'point', nullif(l_linenumber, 3) + 0.5D, 'line', 9.5D)"
    )
    by_flag = "case l_returnflag when 'R' then ' Over 5.5' when 'A' then ' Under 5.5' else '' end"
    outcomes = f"array({outcome.format(suffix=by_flag, price='l_quantity')}, {outcome.format(suffix=repr(' Under 7'), price='l_tax')})"
    book = (
        "array(named_struct('title', 'Book', 'last_update', l_linestatus, 'markets', array("
        f"named_struct('key', 'player_strikeouts', 'outcomes', {outcomes}), named_struct('key', 'other', 'outcomes', {outcomes}))))"
    )
    event = F.expr(f"array(named_struct('id', cast(l_orderkey as string), 'commence_time', 't', 'bookmakers', {book}))")
    docs = table(spark, sf_dir, "lineitem").select(F.to_json(event).alias("body"))
    return tidy(nested.odds_rows(docs).drop("inserted_at"))


_QUERY_FUNCTIONS = [
    game_feed, game_feed_rejects, lineup_documents, schedule_pitchers, schedule_games, schedule_names, transaction_stints, odds_lines,
]
QUERIES = {f.__name__: f for f in _QUERY_FUNCTIONS}

_OK = "game_pk % 10 <> 3 and game_pk % 16 <> 0 and game_pk % 17 <> 0"
_PROBABLE = "select * from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 and o_orderkey <> 0"
ORACLE = {
    "game_feed": f"""{CHAIN} select {i('game_pk', 'game_pk')}, {d('game_date', 'game_date')}, away_team, home_team, {i('1', 'game_number')}, 'N' as double_header,
        replace(away_pitcher_ids, ' ', '') as away_pitcher_ids, home_pitcher_ids, hp_umpire, 'U1' as "1b_umpire",
        case when game_pk % 2 = 0 then 'U2' end as "2b_umpire", 'U' || game_pk % 7 as "3b_umpire", weather,
        {r('try_cast(temp as double)', 'temp')}, wind, {r('elevation', 'elevation')}, case when game_pk % 2 = 0 then 'day' else 'night' end as "dayNight",
        case when game_pk % 4 = 0 then 'TBD' else '05:10 PM' end as first_pitch from box where {_OK}""",
    "game_feed_rejects": f"""{CHAIN} select {i('game_pk', 'game_pk')}, case when game_pk % 10 = 3 then 'not final' when game_pk % 16 = 0 then 'other league'
        else 'missing team or date' end as reason from box where not ({_OK})""",
    "lineup_documents": f"""{CHAIN}, l as ({LINEUPS}), s as (select * from l where batter_id % 6 <> 0)
        select {i('game_pk', 'game_pk')}, team, {i('batter_id', 'batter_id')}, {i('batting_order * 100', 'batting_order')},
        case when batter_id % 2 = 0 then 'L' else 'R' end as stand,
        {i('max(case when batting_order = 7 then batter_id end) over (partition by game_pk, team)', 'catcher_id')} from s""",
    "schedule_pitchers": f"""select {d('o_orderdate', 'game_date')}, o_orderkey as game_pk, 'HHH' as home_team_abbr, 'AAA' as away_team_abbr,
        'Q' || o_orderkey as home_probable_pitcher_name, 1 + o_custkey % 50 as home_probable_pitcher_id,
        'P' || o_custkey as away_probable_pitcher_name, 1 + o_custkey as away_probable_pitcher_id from ({_PROBABLE})""",
    "schedule_games": "select o_orderkey as game_pk from orders where o_orderkey <> 0",
    "schedule_names": f"""with s as (select 1 + o_custkey % 50 as pitcher_id, 'Q' || o_orderkey as name, o_orderdate, o_orderkey, 'home' as side from ({_PROBABLE})
        union all select 1 + o_custkey, 'P' || o_custkey, o_orderdate, o_orderkey, 'away' from ({_PROBABLE}))
        select pitcher_id, name from s qualify row_number() over (partition by pitcher_id order by o_orderdate desc, o_orderkey desc, side desc) = 1""",
    "transaction_stints": f"""with m as (select user_id, cast(ts as date) as day, min(case event_type when 'signup' then 'start' else 'end' end) as action
          from events where event_type in ('signup', 'error') and user_id <> 0 group by 1, 2),
        p as (select *, lead(action) over w as nxt, lead(day) over w as nxt_day from m window w as (partition by user_id order by day))
        select user_id as player_id, {d('day', 'start_date')}, {d('nxt_day', 'end_date')} from p where action = 'start' and (nxt is null or nxt = 'end')""",
    "odds_lines": " union all ".join(
        f"""select l_orderkey::varchar as event_id, 't' as commence_time, 'Book' as bookmaker, 'Player ' || l_suppkey as player,
        {r('coalesce(nullif(l_linenumber, 3) + 0.5, 9.5)', 'line')}, {side} as side, {r(price, 'odds')}, l_linestatus as last_update from lineitem"""
        for side, price in (("case l_returnflag when 'R' then 'over' when 'A' then 'under' else 'unknown' end", "l_quantity"), ("'under'", "l_tax"))
    ),
}
