"""Pitch log to game level: starters, batters against starters, teams, catchers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.functions import aggregates as A
from lagwise.operators.clean import existing
from lagwise.operators.joins import only_listed
from lagwise.operators.sequence import MAX_ROWS_PER_TASK, KeySizes, lay_out, measure
from lagwise.plans import baseball as B

STARTER_PITCHES = 30
STARTER_INNING = 3

_STRIKEOUT = A.one_of("events", B.STRIKEOUTS)
_FIELDING = "case when inning_topbot = 'Top' then home_team else away_team end"
_BATTING = "case when inning_topbot = 'Top' then away_team else home_team end"


def _aggregates(metrics: Mapping[str, str]) -> list[Column]:
    return [F.expr(e).alias(n) for n, e in metrics.items()]


def _starter_rule(min_pitches: int, min_inning: int) -> str:
    return f"min(inning) = 1 and count(*) > {int(min_pitches)} and max(inning) > {int(min_inning)}"


def starters(
    pitches: DataFrame, min_pitches: int = STARTER_PITCHES, min_inning: int = STARTER_INNING
) -> DataFrame:
    """(game, pitcher) pairs that began in inning 1, threw more than ``min_pitches``
    pitches and went past ``min_inning`` innings."""
    return (
        pitches.groupBy("game_pk", "pitcher")
        .agg(F.expr(_starter_rule(min_pitches, min_inning)).alias("_keep"))
        .where("_keep")
        .select("game_pk", "pitcher")
    )


def _ordered(df: DataFrame, keys: list[str], max_rows: int | KeySizes | None) -> DataFrame:
    """Rows with marks for the first row of the group and the last pitch of an at-bat,
    the next pitch type, and whether the at-bat had a runner on base."""
    layout = lay_out(df, keys, ["at_bat_number", "pitch_number"], before=1, after=1, max_rows=max_rows)
    over = f"over (partition by {', '.join(layout.partition)} order by at_bat_number, pitch_number)"
    marks = [f"lag(at_bat_number) {over} is null as _first", f"lead(at_bat_number) {over} as _next_at_bat"]
    if "pitch_type" in df.columns:
        marks.append(f"lead(pitch_type) {over} as _next_type")
    runners = None
    if {"on_1b", "on_2b", "on_3b", "woba_value", "woba_denom"} <= set(df.columns):
        runners = "max(on_1b is not null or on_2b is not null or on_3b is not null)"
    if runners and not layout.split:
        marks.append(f"{runners} over (partition by {', '.join(keys)}, at_bat_number) as _runners")
    rows = layout.df.selectExpr("*", *marks).selectExpr(
        "*",
        "_next_at_bat is not null as _has_next",
        "_next_at_bat is null or _next_at_bat != at_bat_number as _last",
    )
    if runners and layout.split:
        # A block may cut an at-bat, so ask the at-bat itself.
        at_bats = layout.finish(layout.df).groupBy(*keys, "at_bat_number").agg(F.expr(runners).alias("_runners"))
        rows = rows.join(at_bats, [*keys, "at_bat_number"], "left")
    return layout.finish(rows)


def _first(value: str) -> str:
    return f"max(case when _first then {value} end)"


def _situations(columns: Iterable[str]) -> dict[str, str]:
    """Strikeout shares in two-strike and high-leverage at-bats, wOBA with runners on."""
    present = set(columns)
    if "leverage_index" in present:
        tense = "leverage_index >= 1.5D"
    elif {"home_score", "away_score", "inning"} <= present:
        tense = "inning >= 7 and abs(home_score - away_score) <= 1"
    else:
        tense = None
    return {
        "two_strike_k_rate": A.share_within(_STRIKEOUT, "_last and strikes = 2") if "strikes" in present else A.missing(),
        "high_leverage_k_rate": A.share_within(_STRIKEOUT, f"_last and {tense}") if tense else A.missing(),
        "woba_runners_on": A.ratio(
            "sum(case when _runners then woba_value end)", "sum(case when _runners then woba_denom end)"
        )
        if "_runners" in present
        else A.missing(),
    }


def pitcher_games(
    pitches: DataFrame,
    min_pitches: int | None = STARTER_PITCHES,
    min_inning: int = STARTER_INNING,
    max_rows: int | None = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """One row per (game, starting pitcher) with its pitch metrics.

    The starter rule is a condition on the same aggregate, so the log is read once.
    ``min_pitches=None`` keeps every pitcher.
    """
    optional = [c for c in ("barrel", "leverage_index") if c in pitches.columns]
    source = existing(pitches, [*B.PITCHER_COLUMNS, *optional])
    rows = _ordered(source, ["game_pk", "pitcher"], max_rows)
    present = set(source.columns)
    swinging = "contains(description, 'swinging_strike')"
    fastball_only = A.one_of("pitch_type", [t for t in B.FASTBALL_TYPES if t not in B.OFFSPEED_TYPES])
    offspeed_only = A.one_of("pitch_type", [t for t in B.OFFSPEED_TYPES if t not in B.FASTBALL_TYPES])
    if "zone" in present:
        in_zone = "coalesce(zone between 1 and 9, false)"
    elif {"plate_x", "plate_z"} <= present:
        in_zone = "coalesce(plate_x between -0.83D and 0.83D and plate_z between 1.5D and 3.5D, false)"
    else:
        in_zone = None

    def mean(c: str) -> str:
        return f"avg({c})" if c in present else A.missing()

    def in_play(aggregate: str, c: str) -> str:
        return f"{aggregate}(case when type = 'X' then {c} end)" if c in present else A.missing()

    if "barrel" in present:
        barrel = in_play("avg", "barrel")
    elif {"launch_speed", "launch_angle"} <= present:
        barrel = A.share_within("launch_angle between 26 and 30 and launch_speed >= 98", "type = 'X'")
    else:
        barrel = A.missing()
    walked = A.one_of("events", [*B.WALKS, "hit_by_pitch"])
    metrics = {
        "game_date": _first("game_date"),
        "pitcher_hand": _first("p_throws"),
        "pitching_team": _first(_FIELDING),
        "opponent_team": _first(_BATTING),
        "pitches": "count(*)",
        "strikeouts": f"count_if({_STRIKEOUT})",
        "swinging_strike_rate": A.share(swinging),
        "first_pitch_strike_rate": A.share_within("type = 'S'", "pitch_number = 1"),
        "csw_pct": A.share(f"{swinging} or description in ('called_strike', 'foul_tip')"),
        "fastball_pct": A.share(fastball_only),
        "offspeed_to_fastball_ratio": A.ratio(f"count_if({offspeed_only})", f"count_if({fastball_only})"),
        "fastball_then_breaking_rate": A.share_within(
            f"{A.one_of('pitch_type', B.FASTBALL_TYPES)} and {A.one_of('_next_type', B.BREAKING_TYPES)}", "_has_next"
        ),
        "avg_release_speed": mean("release_speed"),
        "max_release_speed": "max(release_speed)",
        "avg_spin_rate": mean("release_spin_rate"),
        "zone_pct": A.share(in_zone) if in_zone else A.missing(),
        "chase_rate": A.share_within("contains(lower(description), 'swing')", f"not {in_zone}") if in_zone else A.missing(),
        "avg_launch_speed": in_play("avg", "launch_speed"),
        "max_launch_speed": in_play("max", "launch_speed"),
        "avg_launch_angle": in_play("avg", "launch_angle"),
        "max_launch_angle": in_play("max", "launch_angle"),
        "hard_hit_rate": A.share_within("launch_speed >= 95", "type = 'X'") if "launch_speed" in present else A.missing(),
        "barrel_rate": barrel,
        "pfx_x": mean("pfx_x"),
        "pfx_z": mean("pfx_z"),
        "release_extension": mean("release_extension"),
        "release_height": mean("release_pos_z"),
        "plate_x": mean("plate_x"),
        "plate_z": mean("plate_z"),
        "_fip_runs": f"13 * count_if(events = 'home_run') + 3 * count_if({walked}) - 2 * count_if({_STRIKEOUT})",
    }
    for name, types in B.PITCH_CLASSES.items():
        metrics[f"{name}_pct"] = A.share(A.one_of("pitch_type", types))
        metrics[f"{name}_whiff_rate"] = A.share_within(swinging, A.one_of("pitch_type", types))
    metrics["fastball_whiff_rate"] = A.share_within(swinging, fastball_only)
    metrics |= _situations(rows.columns)
    keys = ["game_pk", "pitcher"]
    games = rows.groupBy(*keys).agg(*_aggregates(metrics))
    # Distinct counts multiply the rows they are taken over, so they run on narrow rows of
    # their own. Both sides are placed by the same keys.
    distinct = {
        "innings_pitched": "count(distinct inning)",
        "batters_faced": "count(distinct batter)",
        "unique_pitch_types": "count(distinct pitch_type)",
    }
    rule = {} if min_pitches is None else {"_keep": _starter_rule(min_pitches, min_inning)}
    counts = source.dropna(subset=keys).groupBy(*keys).agg(*_aggregates({**distinct, **rule}))
    joined = games.join(counts.where("_keep") if rule else counts, keys)
    leading = ["pitcher_hand", "pitching_team", "opponent_team", "pitches", *distinct]
    rest = [n for n in metrics if n not in ("game_date", "_fip_runs", *leading)]
    return joined.selectExpr(
        "game_pk", "game_date", "pitcher as pitcher_id", *leading, *rest,
        f"{A.ratio('_fip_runs', 'innings_pitched')} as fip",
    )


def _obp(p: str = "") -> str:
    return A.ratio(f"({p}hits + {p}walks + {p}hbp)", f"{p}plate_appearances")


def _slugging(p: str = "") -> str:
    return A.ratio(f"({p}singles + 2 * {p}doubles + 3 * {p}triples + 4 * {p}home_runs)", f"{p}at_bats")


def batter_games(
    pitches: DataFrame,
    starter_pairs: DataFrame | None = None,
    max_rows: int | None = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """One row per (game, batter, starting pitcher)."""
    source = existing(pitches, B.BATTER_COLUMNS)
    keys = ["game_pk", "pitcher", "batter"]
    sizes = measure(source, keys, max_rows)
    if starter_pairs is not None:
        source = only_listed(source, starter_pairs, ["game_pk", "pitcher"])
    rows = _ordered(source, keys, sizes)

    def ends(*events: str) -> str:
        return f"count_if(_last and {A.one_of('events', events)})"

    has_woba = {"woba_value", "woba_denom"} <= set(rows.columns)
    counted = rows.groupBy(*keys).agg(
        *_aggregates(
            {
                "stand": _first("stand"),
                "pitching_team": _first(_FIELDING),
                "opponent_team": _first(_BATTING),
                "plate_appearances": "count_if(_last)",
                "at_bats": f"count_if(_last and not {A.one_of('events', B.NOT_AT_BATS)})",
                "pitches": "count(*)",
                "swings": "count_if(contains(lower(description), 'swing'))",
                "whiffs": "count_if(contains(lower(description), 'swinging_strike'))",
                "called_strike_rate": A.share("description = 'called_strike'"),
                "strikeouts": f"count_if(_last and {_STRIKEOUT})",
                "strikeout_rate_behind": A.share_within(_STRIKEOUT, "_last and strikes > balls"),
                "strikeout_rate_ahead": A.share_within(_STRIKEOUT, "_last and balls > strikes"),
                "hits": ends(*B.HITS),
                "singles": ends("single"),
                "doubles": ends("double"),
                "triples": ends("triple"),
                "home_runs": ends("home_run"),
                "walks": ends(*B.WALKS),
                "hbp": ends("hit_by_pitch"),
                **_situations(rows.columns),
                "woba": A.ratio("sum(woba_value)", "sum(woba_denom)") if has_woba else A.missing(),
            }
        )
    )
    return counted.selectExpr(
        "game_pk", "batter as batter_id", "pitcher as pitcher_id", "stand", "pitching_team", "opponent_team",
        "plate_appearances", "at_bats", "pitches", "swings", "whiffs",
        f"{A.ratio('whiffs', 'swings')} as whiff_rate", "called_strike_rate", "strikeouts",
        f"{A.ratio('strikeouts', 'plate_appearances')} as strikeout_rate",
        "strikeout_rate_behind", "strikeout_rate_ahead", "hits", "singles", "doubles", "triples", "home_runs",
        "walks", "hbp", "two_strike_k_rate", "high_leverage_k_rate", "woba_runners_on",
        f"{A.ratio('hits', 'at_bats')} as avg", f"{_obp()} as obp", f"{_slugging()} as slugging",
        f"{_obp()} + {_slugging()} as ops", "woba",
    )


def team_games(batters: DataFrame) -> DataFrame:
    """Batters rolled up to one row per (game, pitching team, opponent team)."""
    keys = ["game_pk", "pitching_team", "opponent_team"]
    sums = [
        "plate_appearances", "at_bats", "pitches", "swings", "whiffs", "strikeouts", "hits",
        "singles", "doubles", "triples", "home_runs", "walks", "hbp",
    ]
    cells = {f"bat_{c}": A.total(c) for c in sums}
    for hand in ("L", "R"):
        for c in sums:
            if c not in ("pitches", "swings", "whiffs"):
                cells[f"bat_{hand}_{c}"] = A.total(f"case when stand = '{hand}' then {c} end")
    cells["_called"] = A.total("coalesce(called_strike_rate, 0D) * pitches")
    weighted = {
        "bat_strikeout_rate_behind": "strikeout_rate_behind",
        "bat_strikeout_rate_ahead": "strikeout_rate_ahead",
        "bat_woba": "woba",
    }
    cells |= {out: A.weighted_mean(v, "plate_appearances") for out, v in weighted.items()}
    summed = batters.dropna(subset=keys).groupBy(*keys).agg(*_aggregates(cells))
    hands = []
    for p in ("bat_L_", "bat_R_"):
        hands += [
            f"{p}plate_appearances",
            f"{A.ratio(p + 'strikeouts', p + 'plate_appearances')} as {p}strikeout_rate",
            f"{_obp(p)} + {_slugging(p)} as {p}ops",
        ]
    return summed.selectExpr(
        *keys,
        *[f"bat_{c}" for c in sums],
        f"{A.ratio('bat_whiffs', 'bat_swings')} as bat_whiff_rate",
        f"{A.ratio('_called', 'bat_pitches')} as bat_called_strike_rate",
        f"{A.ratio('bat_strikeouts', 'bat_plate_appearances')} as bat_strikeout_rate",
        *weighted,
        f"{A.ratio('bat_hits', 'bat_at_bats')} as bat_avg",
        f"{_obp('bat_')} as bat_obp",
        f"{_slugging('bat_')} as bat_slugging",
        f"{_obp('bat_')} + {_slugging('bat_')} as bat_ops",
        *hands,
    )


def by_hand(df: DataFrame, columns: Mapping[str, str], hand: str = "pitcher_hand") -> DataFrame:
    """``{out}_vs_LHP`` and ``{out}_vs_RHP``: the value for that hand, NULL for the other."""
    return df.withColumns(
        {
            f"{out}_vs_{side}HP": F.expr(f"case when {hand} = '{side}' then {source} end")
            for source, out in columns.items()
            for side in ("L", "R")
        }
    )


def team_batting(batters: DataFrame, starter_games: DataFrame) -> DataFrame:
    """Team rows with the hand of the starter they faced and values by hand.

    Joined on game and pitching team: on the game alone every team row would meet both
    starters of the game.
    """
    hands = starter_games.groupBy("game_pk", "pitching_team").agg(F.min("pitcher_hand").alias("pitcher_hand"))
    joined = team_games(batters).join(hands, ["game_pk", "pitching_team"], "left")
    return by_hand(joined, {"bat_ops": "bat_ops", "bat_strikeout_rate": "bat_k_rate"})


def catcher_games(pitches: DataFrame) -> DataFrame:
    """Called-strike rate on taken pitches and called strikes, per (game, catcher, date)."""
    taken = "not coalesce(contains(lower(description), 'swing'), false)"
    called = "description = 'called_strike'"
    return (
        pitches.dropna(subset=["game_pk", "fielder_2", "game_date"])
        .groupBy("game_pk", "game_date", F.col("fielder_2").alias("catcher_id"))
        .agg(
            *_aggregates(
                {"called_strike_rate": A.share_within(called, taken), "framing_runs": f"count_if({called})"}
            )
        )
    )


def first_catchers(pitches: DataFrame) -> DataFrame:
    """Catcher of each fielding team at its first pitch of inning 1."""
    order = f"struct({', '.join(c for c in ('at_bat_number', 'pitch_number') if c in pitches.columns)})"
    return (
        pitches.where("inning = 1")
        .groupBy("game_pk", F.expr(_FIELDING).alias("team"))
        .agg(F.expr(A.first_by("fielder_2", order)).alias("catcher_id"))
    )
