"""Feature tables and the training matrix over the derived game tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.operators import aggregates as G
from lagwise.plans import baseball as B
from lagwise.plans import features, matrix
from lagwise.plans import pitch_log as P
from lagwise.session import settle
from workload import common
from workload.common import PLACES, SHIFT, i
from workload.games import CHAIN
from workload.games import rounded as rounded_as
from workload.pitches import INJURIES, LINEUPS, PLAYERS, box_scores, injuries, lineups, pitch_log, players

WINDOWS = B.ROLLING_WINDOWS
HALFLIFE = B.EWM_HALFLIFE
OPTIONS = {"windows": WINDOWS, "halflife": HALFLIFE}
IDS = ["game_pk", "pitcher_id"]


def tidy(df, places=PLACES):
    return common.tidy(df, places, SHIFT)


def r(expr: str, name: str, places: int = PLACES) -> str:
    return common.r(expr, name, places, SHIFT)


def rounded(doubles, longs=(), dates=(), plain=()) -> str:
    return rounded_as(doubles, longs, dates, plain, SHIFT)


class Games:
    """Base tables of one run; each is written once and then read by the feature plans."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.log = pitch_log(spark, sf_dir)

    def starters(self):
        if not hasattr(self, "_starters"):
            games = P.pitcher_games(self.log.drop("leverage_index"))
            self._starters = settle(games, "starters")
        return self._starters

    def batters(self):
        if not hasattr(self, "_batters"):
            pairs = self.starters().select("game_pk", F.col("pitcher_id").alias("pitcher"))
            self._batters = settle(P.batter_games(self.log, pairs), "batters")
        return self._batters

    def matchups(self):
        if not hasattr(self, "_matchups"):
            teams = P.team_batting(self.batters(), self.starters())
            details = features.matchup_details(self.starters(), teams, box_scores(self.spark, self.sf_dir))
            self._matchups = settle(details, "matchups")
        return self._matchups

    def lineups(self):
        return lineups(self.spark, self.sf_dir)


def _features_of(games: Games, values, **options):
    return features.pitcher_features(
        games.starters(),
        injuries(games.spark, games.sf_dir),
        players(games.spark, games.sf_dir),
        values=values,
        **{**OPTIONS, **options},
    )


FULL_VALUES = [c for c in B.PITCHER_ROLLING if not c.startswith("batter_")]
PITCHER_VALUES = FULL_VALUES
CALENDAR = ["days_into_season", "rest_days", "pitches_last_7d", "season_ip_last_30d", "on_il", "days_since_il"]


def _names(values, prefix="", windows=WINDOWS, halflife=HALFLIFE):
    out = [f"{prefix}{c}_{s}_{k}" for k in windows for c in values for s in ("mean", "std", "momentum")]
    return out + [f"{prefix}{c}_{s}_{halflife}" for c in values for s in ("ewm", "momentum_ewm")]


def pitcher_features(spark, sf_dir):
    df = _features_of(Games(spark, sf_dir), PITCHER_VALUES)
    return tidy(df.select(*IDS, "game_date", "month_bucket", *CALENDAR, "pitcher_age", *_names(PITCHER_VALUES)))


def pitcher_features_full(spark, sf_dir):
    """All configured columns and windows in one plan."""
    df = _features_of(Games(spark, sf_dir), B.PITCHER_ROLLING, windows=B.ROLLING_WINDOWS)
    return tidy(df.select(*IDS, *_names(FULL_VALUES, "", B.ROLLING_WINDOWS)))


def workload_features(spark, sf_dir):
    df = features.workload_features(Games(spark, sf_dir).starters(), injuries(spark, sf_dir))
    return tidy(df.select(*IDS, "pitches_last_7_games", "ip_last_30_games", "on_il", "days_since_il"))


# A rolled column needs its source: surroundings come with the context, rates with the opponent.
OPPONENT_VALUES = [c for c in B.CONTEXT_ROLLING if c not in ("wind_speed", "park_factor")]
TEAM_HAND_VALUES = B.TEAM_HAND_ROLLING


def opponent_features(spark, sf_dir):
    g = Games(spark, sf_dir)
    df = features.opponent_features(g.matchups(), g.batters(), g.starters(), **OPTIONS)
    return tidy(df.select(*IDS, *_names(OPPONENT_VALUES, "opp_"), *_names(TEAM_HAND_VALUES, "team_hand_")))


CONTEXT_VALUES = [c for c in B.CONTEXT_ROLLING if not c.startswith("team_")]
SURROUNDINGS = ["temp", "wind_speed", "elevation", "day_of_week", "park_factor"]


def contextual_features(spark, sf_dir):
    df = features.contextual_features(Games(spark, sf_dir).matchups(), **OPTIONS)
    rolled = [n for p in ("ump_", "wx_", "venue_") for n in _names(CONTEXT_VALUES, p)]
    return tidy(df.select(*IDS, "stadium", *SURROUNDINGS, "travel_distance", *rolled))


PAIR_VALUES = ["batter_so_rate", "batter_ops", "batter_whiff_rate"]


def pair_history(spark, sf_dir):
    g = Games(spark, sf_dir)
    return tidy(features.pair_history(g.batters(), g.starters(), **OPTIONS))


LINEUP_VALUES = ["lineup_avg_ops", "projected_k_pct"]


def lineup_trends(spark, sf_dir):
    g = Games(spark, sf_dir)
    return tidy(features.lineup_trends(g.lineups(), g.starters(), LINEUP_VALUES, **OPTIONS))


def _slot_rows(g: Games):
    dates = g.log.groupBy("game_pk").agg(F.min("game_date").alias("game_date"))
    return g.lineups().withColumnRenamed("team", "opponent_team").join(dates, "game_pk")


def slot_trends(spark, sf_dir):
    return tidy(features.slot_trends(_slot_rows(Games(spark, sf_dir)), LINEUP_VALUES, **OPTIONS))


def catcher_features(spark, sf_dir):
    g = Games(spark, sf_dir)
    return tidy(
        features.catcher_features(
            g.lineups(), P.catcher_games(g.log), g.starters(), P.first_catchers(g.log), **OPTIONS
        )
    )


def unique_starters(spark, sf_dir):
    """The check that a game has one starter per team: raises on a duplicate."""
    starters = Games(spark, sf_dir).starters()
    G.require_unique(starters, ["game_pk", "pitching_team"])
    return tidy(starters.groupBy("pitching_team").agg(F.count("*").alias("n_games")))


NARROW = (3, 10)
NARROW_VALUES = ["strikeouts", "fip", "splitter_whiff_rate"]


def _matrix(spark, sf_dir):
    g = Games(spark, sf_dir)
    pitchers = _features_of(g, NARROW_VALUES, windows=NARROW)
    context = features.contextual_features(g.matchups(), windows=(3,), halflife=None)
    kept = [c for c in context.columns if c.endswith("_3") or c in (*IDS, *SURROUNDINGS, "weather", "home_team")]
    history = features.pair_history(g.batters(), g.starters(), windows=(3,), halflife=None)
    joined = matrix.join_features(pitchers, [context.select(*kept)])
    opposing = matrix.opposing_batter_history(
        g.lineups(), g.starters(), history.select(*IDS, "batter_id", "game_date", "batter_so_rate_mean_3")
    )
    joined = matrix.coalescing_join(joined, opposing, IDS, "left")
    return settle(joined, "joined")


def feature_matrix(spark, sf_dir):
    """Guarded, winsorized, log-transformed and encoded matrix."""
    df = matrix.finish_matrix(_matrix(spark, sf_dir), windows=NARROW)
    return tidy(df.select(*MATRIX_COLUMNS), 5)


def feature_matrix_full(spark, sf_dir):
    """Every column of the matrix from all five feature tables, as (game, pitcher, name, value)."""
    g = Games(spark, sf_dir)
    opponent = features.opponent_features(g.matchups(), g.batters(), g.starters())
    context = features.contextual_features(g.matchups())
    faced = features.lineup_trends(g.lineups(), g.starters(), LINEUP_VALUES)
    catchers = features.catcher_features(g.lineups(), P.catcher_games(g.log), g.starters(), P.first_catchers(g.log))
    history = settle(features.pair_history(g.batters(), g.starters()), "history")
    sides = [settle(df, "side") for df in (opponent, context, faced, catchers)]
    pitchers = settle(_features_of(g, B.PITCHER_ROLLING), "pitchers")
    joined = settle(matrix.join_matrix(pitchers, sides, g.lineups(), history, unique=True), "joined")
    df = matrix.finish_matrix(joined)
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "date")}
    names = [c for c in df.columns if c not in (*IDS, "strikeouts") and c not in texts]
    return tidy(long_form(df, IDS, names))


def long_form(df, ids, names):
    """A row per id and column that has a value. The names are joined on by number, so that
    the plan holds each column once; the list is made by a compiled step of its own."""
    values = ", ".join(f"cast(`{c}` as double)" for c in names)
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "_at int, name string")  # a row per column
    lists = df.selectExpr(*ids, f"array({values}) as _values")
    cells = lists.selectExpr(*ids, "posexplode(_values) as (_at, value)").where("value is not null")
    return cells.join(F.broadcast(listed), "_at").select(*ids, "name", "value")


MATRIX_DOUBLES = [
    "strikeouts_mean_3", "fip_std_10", "ump_strikeouts_mean_3", "venue_strikeouts_mean_3", "pitcher_age",
    "opp_batter_batter_so_rate_mean_3", "log_days_into_season", "days_into_season", "temp", "weather_enc", "home_team_enc", "month_bucket_enc",
    "pitcher_hand_enc",
]
MATRIX_COLUMNS = ["game_pk", "pitcher_id", "opponent_team", "weather", "strikeouts", *MATRIX_DOUBLES]

_QUERY_FUNCTIONS = [
    pitcher_features, pitcher_features_full, workload_features, opponent_features, contextual_features,
    pair_history, lineup_trends, slot_trends, catcher_features, unique_starters, feature_matrix, feature_matrix_full,
]
QUERIES = {f.__name__: f for f in _QUERY_FUNCTIONS}


# --- the same in SQL ---------------------------------------------------------------

def bundle(source: str, keys: str, order: str, values, prefix="", windows=WINDOWS, halflife=HALFLIFE) -> str:
    """Source rows plus the rolled columns; a row with a NULL key has NULL in them."""
    known = " and ".join(f"{k.strip()} is not null" for k in keys.split(","))
    w = f"over (partition by {keys} order by {order}"
    past = f"{w} rows between unbounded preceding and 1 preceding)"
    cells = []
    for c in values:
        for k in windows:
            frame = f"{w} rows between {k} preceding and 1 preceding)"
            cells += [
                f"case when {known} then avg({c}) {frame} end as {prefix}{c}_mean_{k}",
                f"case when {known} then stddev_samp({c}) {frame} end as {prefix}{c}_std_{k}",
                f"case when {known} then lag({c}) {w}) - avg({c}) {frame} end as {prefix}{c}_momentum_{k}",
            ]
        if halflife:
            e = f"(sum({c} * wt) {past} / sum(case when {c} is not null then wt end) {past})"
            cells += [
                f"case when {known} then {e} end as {prefix}{c}_ewm_{halflife}",
                f"case when {known} then lag({c}) {w}) - {e} end as {prefix}{c}_momentum_ewm_{halflife}",
            ]
    h = halflife or 1
    return f"""select * exclude (wt), {', '.join(cells)} from
      (select *, pow(2.0::double, row_number() {w}) / {h}.0::double) as wt from ({source}))"""


_IL = """cast(case when exists (select 1 from injuries s where s.player_id = g.pitcher_id and s.start_date <= g.game_date
      and (s.end_date is null or g.game_date < s.end_date)) then 1 else 0 end as bigint) as on_il,
    date_diff('day', (select max(s.end_date) from injuries s where s.player_id = g.pitcher_id and s.end_date <= g.game_date), g.game_date) as days_since_il"""


def _days(c: str, n: int) -> str:
    return f"sum({c}) over (partition by pitcher_id order by game_date range between interval {n} days preceding and interval 1 day preceding)"


PITCHERS = f"""select g.*, date_diff('day', min(game_date) over (partition by year(game_date)), game_date) as days_into_season,
    case when month(game_date) <= 4 then 'early' when month(game_date) <= 8 then 'mid' else 'late' end as month_bucket,
    date_diff('day', lag(game_date) over (partition by pitcher_id order by game_date, game_pk), game_date) as rest_days,
    {_days('pitches', 7)} as pitches_last_7d, {_days('innings_pitched', 30)} as season_ip_last_30d, {_IL},
    date_diff('day', birth_date, game_date) / 365.25::double as pitcher_age
    from pitcher_games g left join players on player_id = pitcher_id"""
SIDES = """select game_pk, opponent_team, max(team_ops) filter (pitcher_hand = 'L') as team_ops_vs_LHP,
    max(team_ops) filter (pitcher_hand = 'R') as team_ops_vs_RHP from hand_rates group by 1, 2"""
OPPONENTS = """select m.* replace (try_cast(temp as double) as temp), h.team_k_rate, s.team_ops_vs_LHP, s.team_ops_vs_RHP from matchups m
    left join hand_rates h using (game_pk, opponent_team, pitcher_hand) left join sides s using (game_pk, opponent_team)"""
_PARK_ROWS = ", ".join(f"('{t}', '{p}', {a}::double, {o}::double, {f}::bigint)" for t, p, a, o, f in B.BALLPARKS)
CONTEXT = """select m.* replace (try_cast(temp as double) as temp),
    try_cast(nullif(regexp_extract(wind, '([0-9]+)', 1), '') as double) as wind_speed, isodow(game_date) - 1 as day_of_week,
    h.stadium, h.factor as park_factor,
    2 * 3958.8::double * asin(sqrt(pow(sin((radians(h.lat) - radians(a.lat)) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(h.lat)) * pow(sin((radians(h.lon) - radians(a.lon)) / 2), 2))) as travel_distance
    from matchups m left join parks h on h.team = home_team
    left join parks a on a.team = case when pitching_team is distinct from home_team then pitching_team else opponent_team end"""
PAIRS = """select pitcher_id, batter_id, game_date, min(game_pk) as game_pk, sum(plate_appearances)::bigint as plate_appearances,
    sum(strikeouts)::bigint as strikeouts, avg(ops) as ops, sum(swings)::bigint as swings, sum(whiffs)::bigint as whiffs,
    sum(strikeouts)::double / nullif(sum(plate_appearances), 0)::double as batter_so_rate,
    sum(whiffs)::double / nullif(sum(swings), 0)::double as batter_whiff_rate, avg(ops) as batter_ops
    from batter_games join (select game_pk, min(game_date) as game_date from pitcher_games group by 1) using (game_pk) group by 1, 2, 3"""
FACED = """select game_pk, pitcher_id, game_date, avg(lineup_avg_ops) as lineup_avg_ops, avg(projected_k_pct) as projected_k_pct
    from lineups l join pitcher_games p using (game_pk) where l.team = p.opponent_team group by 1, 2, 3"""
CATCHERS = """select k.game_pk, k.team, k.catcher_id, p.pitcher_id, coalesce(p.game_date, c.game_date) as game_date, c.called_strike_rate, c.framing_runs
    from (select distinct l.game_pk, l.team, f.catcher_id from lineups l left join first_catchers f using (game_pk, team)) k
    left join pitcher_games p on p.game_pk = k.game_pk and p.pitching_team = k.team
    left join catcher_games c on c.game_pk = k.game_pk and c.catcher_id = k.catcher_id"""
_FULL = f"""{CHAIN}, lineups as ({LINEUPS}), injuries as ({INJURIES}), players as ({PLAYERS}),
    parks(team, stadium, lat, lon, factor) as (values {_PARK_ROWS}), sides as ({SIDES}),
    pitchers as ({PITCHERS}), opponents as ({OPPONENTS}), context as ({CONTEXT}), pairs as ({PAIRS}), faced as ({FACED}),
    first_catchers as (select game_pk, team, arg_min(fielder_2, at_bat_number * 100 + pitch_number) filter (fielder_2 is not null) as catcher_id
      from (select *, case inning_topbot when 'Top' then home_team else away_team end as team from pitches where inning = 1) group by 1, 2),
    catcher_games as (select game_pk, fielder_2 as catcher_id, game_date, avg(case when description = 'called_strike' then 1 else 0 end)
        filter (not coalesce(contains(lower(description), 'swing'), false)) as called_strike_rate,
      count(*) filter (description = 'called_strike') as framing_runs from pitches where fielder_2 is not null group by all),
    catchers as ({CATCHERS})"""
_BY_GAME = "game_date, game_pk, pitcher_id"
_CONTEXT_BUNDLES = bundle(
    bundle(bundle("select * from context", "hp_umpire", _BY_GAME, CONTEXT_VALUES, "ump_"), "weather", _BY_GAME, CONTEXT_VALUES, "wx_"),
    "home_team", _BY_GAME, CONTEXT_VALUES, "venue_",
)
_SLOTS = f"""slots as ({bundle("select l.*, l.team as opponent_team, d.game_date from lineups l join (select game_pk, min(game_date) as game_date from pitches group by 1) d using (game_pk)",
    "opponent_team, batting_order", "game_date, game_pk", LINEUP_VALUES, "lineup_")})"""
_SLOT_NAMES = ["lineup_avg_ops", *_names(LINEUP_VALUES, "lineup_")]

_MATRIX_SQL = f"""{_FULL}, rolled as ({bundle('select * from pitchers', 'pitcher_id', 'game_date, game_pk', NARROW_VALUES, '', NARROW)}),
    surround as ({bundle(bundle('select * from context', 'hp_umpire', _BY_GAME, ['strikeouts'], 'ump_', (3,), None), 'home_team', _BY_GAME, ['strikeouts'], 'venue_', (3,), None)}),
    hist as ({bundle('select * from pairs', 'pitcher_id, batter_id', 'game_date, game_pk', ['batter_so_rate'], '', (3,), None)}),
    opp as (select l.game_pk, p.pitcher_id, avg(h.batter_so_rate_mean_3) as opp_rate from lineups l
      join pitcher_games p on p.game_pk = l.game_pk and p.opponent_team = l.team
      left join hist h on h.game_pk = l.game_pk and h.pitcher_id = p.pitcher_id and h.batter_id = l.batter_id group by 1, 2),
    joined as (select r.game_pk, r.pitcher_id, r.opponent_team, s.weather, r.strikeouts, r.game_date, s.home_team, r.month_bucket, r.pitcher_hand,
        r.strikeouts_mean_3, r.fip_std_10, s.ump_strikeouts_mean_3, s.venue_strikeouts_mean_3, r.pitcher_age, opp_rate,
        r.days_into_season::double as days_into_season, s.temp, year(r.game_date) in {B.TRAIN_YEARS} as train
      from rolled r left join surround s using (game_pk, pitcher_id) left join opp using (game_pk, pitcher_id)),
    q as (select {', '.join(f"quantile_cont({c}, 0.01) as {c}_lo, quantile_cont({c}, 0.99) as {c}_hi" for c in ('strikeouts_mean_3', 'fip_std_10', 'ump_strikeouts_mean_3', 'venue_strikeouts_mean_3', 'pitcher_age', 'opp_rate', 'days_into_season', 'temp'))}
      from joined where train),
    weather_m as (select weather, avg(strikeouts) as e from joined where train group by 1),
    home_m as (select home_team, avg(strikeouts) as e from joined where train group by 1),
    month_m as (select month_bucket, avg(strikeouts) as e from joined where train group by 1),
    hand_m as (select pitcher_hand, avg(strikeouts) as e from joined where train group by 1)"""

# The whole matrix, a row per cell.
_PAIR_ALL = [*_names(PAIR_VALUES)]
_ROLLED = {
    "a": _names(FULL_VALUES),
    "o": [*_names(OPPONENT_VALUES, "opp_"), *_names(TEAM_HAND_VALUES, "team_hand_")],
    "c": [n for p in ("ump_", "wx_", "venue_") for n in _names(CONTEXT_VALUES, p)],
    "l": _names(LINEUP_VALUES, "lineup_"),
    "k": _names(["called_strike_rate", "framing_runs"], "catcher_"),
}
_PLAIN = {
    "a": [*CALENDAR, "pitcher_age"],
    "c": ["temp", "wind_speed", "elevation", "humidity", "park_factor", "day_of_week", "travel_distance"],
}
_TEXT = {"a": ["month_bucket", "pitcher_hand"], "c": ["weather", "wind", "hp_umpire", "home_team", "away_team", "stadium"], "k": ["team"]}


def _cells_of(names: dict) -> str:
    return ", ".join(f"cast({t}.{c} as double) as {c}" for t, cs in names.items() for c in cs)


WIDE_NAMES = _WIDE_NAMES = [c for names in (_ROLLED, _PLAIN) for cs in names.values() for c in cs] + [f"opp_batter_{c}" for c in _PAIR_ALL]
_TEXT_NAMES = [c for cs in _TEXT.values() for c in cs]
_FULL_MATRIX_SQL = f"""{_FULL},
    a as materialized ({bundle('select * from pitchers', 'pitcher_id', 'game_date, game_pk', FULL_VALUES)}),
    o as materialized ({bundle(bundle('select * from opponents', 'pitcher_id, opponent_team', _BY_GAME, OPPONENT_VALUES, 'opp_'), 'opponent_team, pitcher_hand', _BY_GAME, TEAM_HAND_VALUES, 'team_hand_')}),
    c as materialized ({_CONTEXT_BUNDLES}),
    l as materialized ({bundle('select * from faced', 'pitcher_id', 'game_date, game_pk', LINEUP_VALUES, 'lineup_')}),
    k as materialized ({bundle('select * from catchers', 'catcher_id', _BY_GAME, ['called_strike_rate', 'framing_runs'], 'catcher_')}),
    h as materialized ({bundle('select * from pairs', 'pitcher_id, batter_id', 'game_date, game_pk', PAIR_VALUES)}),
    met as (select l.game_pk, p.pitcher_id, {', '.join(f'avg(h.{c}) as opp_batter_{c}' for c in _PAIR_ALL)} from lineups l
      join pitcher_games p on p.game_pk = l.game_pk and p.opponent_team = l.team
      left join h on h.game_pk = l.game_pk and h.pitcher_id = p.pitcher_id and h.batter_id = l.batter_id group by 1, 2),
    wide as materialized (select a.game_pk, a.pitcher_id, a.strikeouts, year(a.game_date) in {B.TRAIN_YEARS} as train,
        {_cells_of(_ROLLED)}, {_cells_of(_PLAIN)}, {', '.join(f'met.opp_batter_{c}' for c in _PAIR_ALL)}, {', '.join(f'{t}.{c}' for t, cs in _TEXT.items() for c in cs)}
      from a left join o using (game_pk, pitcher_id) left join c using (game_pk, pitcher_id) left join l using (game_pk, pitcher_id)
      left join k using (game_pk, pitcher_id) left join met using (game_pk, pitcher_id)),
    cells as materialized (unpivot (select game_pk, pitcher_id, train, {', '.join(_WIDE_NAMES)} from wide) on {', '.join(_WIDE_NAMES)} into name name value value),
    bounds as (select name, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi, count(*) as n, min(value) as least, max(value) as most
      from cells where train group by name),
    clipped as (select game_pk, pitcher_id, name, least(greatest(value, lo), hi) as value from cells left join bounds using (name)),
    logged as (select name from bounds where n = (select count(*) from wide where train) and greatest(least, lo) >= 0 and least(most, hi) > 1),
    words as materialized (unpivot (select game_pk, pitcher_id, strikeouts, train, {', '.join(_TEXT_NAMES)} from wide) on {', '.join(_TEXT_NAMES)} into name name value word),
    means as (select name, word, avg(strikeouts) as value from words where train group by name, word)"""

CELLS_SQL = f"""{_FULL_MATRIX_SQL} select {i('game_pk', 'game_pk')}, {i('pitcher_id', 'pitcher_id')}, name, {r('value', 'value')} from cells"""


def _clip(c: str) -> str:
    return f"(case when j.{c} is not null then least(greatest(j.{c}, {c}_lo), {c}_hi) end)"


ORACLE = {
    "pitcher_features": f"""{_FULL}, x as ({bundle('select * from pitchers', 'pitcher_id', 'game_date, game_pk', PITCHER_VALUES)})
        select {rounded(['pitcher_age', *_names(PITCHER_VALUES)], [*IDS, *CALENDAR], ['game_date'], ['month_bucket'])} from x""",
    "pitcher_features_full": f"""{_FULL}, x as ({bundle('select * from pitchers', 'pitcher_id', 'game_date, game_pk', FULL_VALUES, '', B.ROLLING_WINDOWS)})
        select {rounded(_names(FULL_VALUES, '', B.ROLLING_WINDOWS), IDS)} from x""",
    "workload_features": f"""{_FULL} select {rounded([], IDS)}, on_il, days_since_il,
        {i('sum(pitches) over (partition by pitcher_id order by game_date, game_pk rows between 7 preceding and 1 preceding)', 'pitches_last_7_games')},
        {i('sum(innings_pitched) over (partition by pitcher_id order by game_date, game_pk rows between 30 preceding and 1 preceding)', 'ip_last_30_games')}
        from pitchers""",
    "opponent_features": f"""{_FULL}, x as ({bundle(bundle('select * from opponents', 'pitcher_id, opponent_team', _BY_GAME, OPPONENT_VALUES, 'opp_'), 'opponent_team, pitcher_hand', _BY_GAME, TEAM_HAND_VALUES, 'team_hand_')})
        select {rounded([*_names(OPPONENT_VALUES, 'opp_'), *_names(TEAM_HAND_VALUES, 'team_hand_')], IDS)} from x""",
    "contextual_features": f"""{_FULL}, x as ({_CONTEXT_BUNDLES})
        select {rounded(['temp', 'wind_speed', 'elevation', 'travel_distance', *[n for p in ('ump_', 'wx_', 'venue_') for n in _names(CONTEXT_VALUES, p)]],
        [*IDS, 'day_of_week', 'park_factor'], [], ['stadium'])} from x""",
    "pair_history": f"""{_FULL}, x as ({bundle('select * from pairs', 'pitcher_id, batter_id', 'game_date, game_pk', PAIR_VALUES)})
        select {rounded(['ops', *PAIR_VALUES, *_names(PAIR_VALUES)], [*IDS, 'batter_id', 'plate_appearances', 'strikeouts', 'swings', 'whiffs'], ['game_date'])} from x""",
    "lineup_trends": f"""{_FULL}, x as ({bundle('select * from faced', 'pitcher_id', 'game_date, game_pk', LINEUP_VALUES, 'lineup_')})
        select {rounded([*LINEUP_VALUES, *_names(LINEUP_VALUES, 'lineup_')], IDS, ['game_date'])} from x""",
    "slot_trends": f"""{_FULL}, {_SLOTS} select {rounded([], ['game_pk'], ['game_date'])}, opponent_team,
        {', '.join(r(f'max({c}) filter (batting_order = {n})', f'slot{n}_{c}') for n in range(1, 10) for c in _SLOT_NAMES)},
        {r('avg(projected_k_pct)', 'projected_lineup_k_pct')} from slots group by game_pk, opponent_team, game_date""",
    "catcher_features": f"""{_FULL}, x as ({bundle('select * from catchers', 'catcher_id', _BY_GAME, ['called_strike_rate', 'framing_runs'], 'catcher_')})
        select {rounded(['called_strike_rate', *_names(['called_strike_rate', 'framing_runs'], 'catcher_')], [*IDS, 'catcher_id', 'framing_runs'], ['game_date'], ['team'])} from x""",
    "feature_matrix_full": f"""{_FULL_MATRIX_SQL} select game_pk, pitcher_id, name, {r('value', 'value')} from (
          select * from clipped union all select game_pk, pitcher_id, 'log_' || name, ln(1 + value) from clipped semi join logged using (name)
          union all select game_pk, pitcher_id, name || '_enc', means.value from words join means using (name, word))""",
    "unique_starters": f"{CHAIN} select pitching_team, {i('count(*)', 'n_games')} from pitcher_games group by 1",
    "feature_matrix": f"""{_MATRIX_SQL} select {i('j.game_pk', 'game_pk')}, {i('j.pitcher_id', 'pitcher_id')}, j.opponent_team, j.weather, {i('j.strikeouts', 'strikeouts')},
        {', '.join(r(_clip(c), n, 5) for c, n in (('strikeouts_mean_3', 'strikeouts_mean_3'), ('fip_std_10', 'fip_std_10'), ('ump_strikeouts_mean_3', 'ump_strikeouts_mean_3'),
          ('venue_strikeouts_mean_3', 'venue_strikeouts_mean_3'), ('pitcher_age', 'pitcher_age'), ('opp_rate', 'opp_batter_batter_so_rate_mean_3'), ('days_into_season', 'days_into_season'), ('temp', 'temp')))},
        {r(f"ln(1 + {_clip('days_into_season')})", 'log_days_into_season', 5)},
        {r('weather_m.e', 'weather_enc', 5)}, {r('home_m.e', 'home_team_enc', 5)}, {r('month_m.e', 'month_bucket_enc', 5)}, {r('hand_m.e', 'pitcher_hand_enc', 5)}
        from joined j cross join q left join weather_m using (weather) left join home_m using (home_team)
        left join month_m using (month_bucket) left join hand_m using (pitcher_hand)""",
}
