"""Game-level tables from the pitch log."""

from __future__ import annotations

from lagwise.plans import baseball as B
from lagwise.plans import features, pitch_log as P
from workload.common import d, i, r, tidy
from workload.pitches import BOX_SCORES, PITCH_LOG, box_scores, pitch_log


def _pitches(spark, sf_dir):
    return pitch_log(spark, sf_dir).drop("leverage_index")


def starter_pairs(spark, sf_dir):
    return tidy(P.starters(_pitches(spark, sf_dir)))


def pitcher_games(spark, sf_dir):
    return tidy(P.pitcher_games(_pitches(spark, sf_dir)))


def _batters(spark, sf_dir):
    log = pitch_log(spark, sf_dir)
    return P.batter_games(log, P.starters(log))


def batter_games(spark, sf_dir):
    return tidy(_batters(spark, sf_dir))


def team_batting(spark, sf_dir):
    return tidy(P.team_batting(_batters(spark, sf_dir), P.pitcher_games(_pitches(spark, sf_dir))))


def catcher_games(spark, sf_dir):
    return tidy(P.catcher_games(_pitches(spark, sf_dir)))


def first_catchers(spark, sf_dir):
    return tidy(P.first_catchers(_pitches(spark, sf_dir)))


def _matchups(spark, sf_dir):
    starters = P.pitcher_games(_pitches(spark, sf_dir))
    teams = P.team_batting(_batters(spark, sf_dir), starters)
    return features.matchup_details(starters, teams, box_scores(spark, sf_dir))


def matchup_details(spark, sf_dir):
    return tidy(_matchups(spark, sf_dir))


def hand_rates(spark, sf_dir):
    return tidy(features.hand_rates(_batters(spark, sf_dir), P.pitcher_games(_pitches(spark, sf_dir))))


QUERIES = {
    "starter_pairs": starter_pairs,
    "pitcher_games": pitcher_games,
    "batter_games": batter_games,
    "team_batting": team_batting,
    "catcher_games": catcher_games,
    "first_catchers": first_catchers,
    "matchup_details": matchup_details,
    "hand_rates": hand_rates,
}


# --- the same in SQL ---------------------------------------------------------------

def _in(column: str, values) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


def _share(condition: str, mask: str | None = None) -> str:
    hit = f"case when {condition} then 1 else 0 end"
    return f"avg({hit})" if mask is None else f"avg(case when {mask} then {hit} end)"


def _div(a: str, b: str) -> str:
    return f"cast({a} as double) / nullif(cast({b} as double), 0)"


_K = _in("events", B.STRIKEOUTS)
_SWING = "contains(description, 'swinging_strike')"
_FB_ONLY = _in("pitch_type", [t for t in B.FASTBALL_TYPES if t not in B.OFFSPEED_TYPES])
_OFF_ONLY = _in("pitch_type", [t for t in B.OFFSPEED_TYPES if t not in B.FASTBALL_TYPES])
_IN_ZONE = "coalesce(zone between 1 and 9, false)"
_CLOSE = "inning >= 7 and abs(home_score - away_score) <= 1"

LOG = f"pitches as ({PITCH_LOG}), box as ({BOX_SCORES})"
STARTERS = """starters as (select game_pk, pitcher from pitches group by all
    having min(inning) = 1 and count(*) > 30 and max(inning) > 3)"""


def _marked(keys: str) -> str:
    order = "order by at_bat_number, pitch_number"
    return f"""select *, row_number() over (partition by {keys} {order}) = 1 as is_first,
        lead(at_bat_number) over (partition by {keys} {order}) as next_ab,
        lead(pitch_type) over (partition by {keys} {order}) as next_type,
        row_number() over (partition by {keys}, at_bat_number order by pitch_number desc) = 1 as is_last,
        bool_or(on_1b is not null or on_2b is not null or on_3b is not null)
          over (partition by {keys}, at_bat_number) as runners from pitches semi join starters using (game_pk, pitcher)"""


def _pitcher_metrics() -> dict[str, str]:
    metrics = {
        "swinging_strike_rate": _share(_SWING),
        "first_pitch_strike_rate": _share("type = 'S'", "pitch_number = 1"),
        "csw_pct": _share(f"{_SWING} or description in ('called_strike', 'foul_tip')"),
        "fastball_pct": _share(_FB_ONLY),
        "offspeed_to_fastball_ratio": _div(f"count(*) filter ({_OFF_ONLY})", f"count(*) filter ({_FB_ONLY})"),
        "fastball_then_breaking_rate": _share(
            f"{_in('pitch_type', B.FASTBALL_TYPES)} and {_in('next_type', B.BREAKING_TYPES)}", "next_ab is not null"
        ),
        "avg_release_speed": "avg(release_speed)",
        "max_release_speed": "max(release_speed)",
        "avg_spin_rate": "avg(release_spin_rate)",
        "zone_pct": _share(_IN_ZONE),
        "chase_rate": _share("contains(lower(description), 'swing')", f"not {_IN_ZONE}"),
        "avg_launch_speed": "avg(launch_speed) filter (type = 'X')",
        "max_launch_speed": "max(launch_speed) filter (type = 'X')",
        "avg_launch_angle": "avg(launch_angle) filter (type = 'X')",
        "max_launch_angle": "max(launch_angle) filter (type = 'X')",
        "hard_hit_rate": _share("launch_speed >= 95", "type = 'X'"),
        "barrel_rate": _share("launch_angle between 26 and 30 and launch_speed >= 98", "type = 'X'"),
        "pfx_x": "avg(pfx_x)",
        "pfx_z": "avg(pfx_z)",
        "release_extension": "avg(release_extension)",
        "release_height": "avg(release_pos_z)",
        "plate_x": "avg(plate_x)",
        "plate_z": "avg(plate_z)",
        "fip": _div(
            f"(13 * count(*) filter (events = 'home_run') + 3 * count(*) filter ({_in('events', [*B.WALKS, 'hit_by_pitch'])})"
            f" - 2 * count(*) filter ({_K}))",
            "count(distinct inning)",
        ),
        "fastball_whiff_rate": _share(_SWING, _FB_ONLY),
        "two_strike_k_rate": _share(_K, "is_last and strikes = 2"),
        "high_leverage_k_rate": _share(_K, f"is_last and {_CLOSE}"),
        "woba_runners_on": _div("sum(woba_value) filter (runners)", "sum(woba_denom) filter (runners)"),
    }
    for name, types in B.PITCH_CLASSES.items():
        metrics[f"{name}_pct"] = _share(_in("pitch_type", types))
        metrics[f"{name}_whiff_rate"] = _share(_SWING, _in("pitch_type", types))
    return metrics


PITCHER_GAMES = f"""select game_pk, pitcher as pitcher_id,
    max(game_date) filter (is_first) as game_date, max(p_throws) filter (is_first) as pitcher_hand,
    max(case inning_topbot when 'Top' then home_team else away_team end) filter (is_first) as pitching_team,
    max(case inning_topbot when 'Top' then away_team else home_team end) filter (is_first) as opponent_team,
    count(*) as pitches, count(distinct inning) as innings_pitched, count(distinct batter) as batters_faced,
    count(*) filter ({_K}) as strikeouts, count(distinct pitch_type) as unique_pitch_types,
    {', '.join(f'{e} as {n}' for n, e in _pitcher_metrics().items())}
    from ({_marked('game_pk, pitcher')}) group by game_pk, pitcher"""

_BATTER_COUNTS = {
    "plate_appearances": "is_last",
    "at_bats": f"is_last and not coalesce({_in('events', B.NOT_AT_BATS)}, false)",
    "pitches": "true",
    "swings": "contains(lower(description), 'swing')",
    "whiffs": "contains(lower(description), 'swinging_strike')",
    "strikeouts": f"is_last and {_K}",
    "hits": f"is_last and {_in('events', B.HITS)}",
    "singles": "is_last and events = 'single'",
    "doubles": "is_last and events = 'double'",
    "triples": "is_last and events = 'triple'",
    "home_runs": "is_last and events = 'home_run'",
    "walks": f"is_last and {_in('events', B.WALKS)}",
    "hbp": "is_last and events = 'hit_by_pitch'",
}
_BATTER_RATES = {
    "called_strike_rate": _share("description = 'called_strike'"),
    "strikeout_rate_behind": _share(_K, "is_last and strikes > balls"),
    "strikeout_rate_ahead": _share(_K, "is_last and balls > strikes"),
    "two_strike_k_rate": _share(_K, "is_last and strikes = 2"),
    "high_leverage_k_rate": _share(_K, "is_last and leverage_index >= 1.5"),
    "woba_runners_on": _div("sum(woba_value) filter (runners)", "sum(woba_denom) filter (runners)"),
    "woba": _div("sum(woba_value)", "sum(woba_denom)"),
}


def _line(prefix: str = "") -> dict[str, str]:
    p = prefix
    return {
        "obp": _div(f"({p}hits + {p}walks + {p}hbp)", f"{p}plate_appearances"),
        "slugging": _div(f"({p}singles + 2 * {p}doubles + 3 * {p}triples + 4 * {p}home_runs)", f"{p}at_bats"),
    }


_DERIVED = {
    "whiff_rate": _div("whiffs", "swings"),
    "strikeout_rate": _div("strikeouts", "plate_appearances"),
    "avg": _div("hits", "at_bats"),
    **_line(),
    "ops": f"{_line()['obp']} + {_line()['slugging']}",
}
BATTER_GAMES = f"""select *, {', '.join(f'{e} as {n}' for n, e in _DERIVED.items())} from (
    select game_pk, batter as batter_id, pitcher as pitcher_id, max(stand) filter (is_first) as stand,
    max(case inning_topbot when 'Top' then home_team else away_team end) filter (is_first) as pitching_team,
    max(case inning_topbot when 'Top' then away_team else home_team end) filter (is_first) as opponent_team,
    {', '.join(f'count(*) filter ({c}) as {n}' for n, c in _BATTER_COUNTS.items())},
    {', '.join(f'{e} as {n}' for n, e in _BATTER_RATES.items())}
    from ({_marked('game_pk, pitcher, batter')}) group by game_pk, pitcher, batter)"""

_TEAM_SUMS = list(_BATTER_COUNTS)
_SPLITS = [c for c in _TEAM_SUMS if c not in ("pitches", "swings", "whiffs")]


def _weighted(v: str, w: str = "plate_appearances") -> str:
    return f"sum({v} * {w}) filter ({v} is not null) / nullif(sum({w}) filter ({v} is not null), 0)"


def _team_rates(source: str, prefix: str, short: bool) -> dict[str, str]:
    line = _line(source)
    rates = {
        f"{prefix}strikeout_rate": _div(f"{source}strikeouts", f"{source}plate_appearances"),
        f"{prefix}ops": f"{line['obp']} + {line['slugging']}",
    }
    if short:
        rates[f"{prefix}plate_appearances"] = f"{source}plate_appearances"
    else:
        rates[f"{prefix}obp"], rates[f"{prefix}slugging"] = line["obp"], line["slugging"]
    return rates


_TEAM_DERIVED = {
    "bat_whiff_rate": _div("s_whiffs", "s_swings"),
    "bat_called_strike_rate": _div("called", "s_pitches"),
    "bat_avg": _div("s_hits", "s_at_bats"),
    **_team_rates("s_", "bat_", False),
    **_team_rates("l_", "bat_L_", True),
    **_team_rates("r_", "bat_R_", True),
}
TEAM_BATTING = f"""select t.game_pk, t.pitching_team, t.opponent_team, h.pitcher_hand,
    {', '.join(f's_{c} as bat_{c}' for c in _TEAM_SUMS)}, bat_strikeout_rate_behind, bat_strikeout_rate_ahead, bat_woba,
    {', '.join(f'{e} as {n}' for n, e in _TEAM_DERIVED.items())},
    {', '.join(f"case when pitcher_hand = '{s}' then {_TEAM_DERIVED[c]} end as {o}_vs_{s}HP"
      for c, o in (('bat_ops', 'bat_ops'), ('bat_strikeout_rate', 'bat_k_rate')) for s in 'LR')}
    from (select game_pk, pitching_team, opponent_team,
      {', '.join(f'sum({c}) as s_{c}' for c in _TEAM_SUMS)},
      {', '.join(f"coalesce(sum({c}) filter (stand = '{s.upper()}'), 0) as {s}_{c}" for c in _SPLITS for s in 'lr')},
      sum(coalesce(called_strike_rate, 0) * pitches) as called,
      {_weighted('strikeout_rate_behind')} as bat_strikeout_rate_behind,
      {_weighted('strikeout_rate_ahead')} as bat_strikeout_rate_ahead, {_weighted('woba')} as bat_woba
      from batter_games group by all) t
    left join (select game_pk, pitching_team, min(pitcher_hand) as pitcher_hand from pitcher_games group by all) h
      using (game_pk, pitching_team)"""

MATCHUPS = """select p.*, t.* exclude (game_pk, pitching_team, opponent_team, pitcher_hand),
    b.* exclude (game_pk, game_date),
    try_cast(json_extract_string(away_pitcher_ids, '$[0]') as bigint) as away_starting_pitcher_id,
    try_cast(json_extract_string(home_pitcher_ids, '$[0]') as bigint) as home_starting_pitcher_id
    from pitcher_games p left join team_batting t using (game_pk, pitching_team, opponent_team)
    left join box b using (game_pk)"""
HAND_RATES = f"""select game_pk, b.opponent_team, pitcher_hand,
    {_div('sum(b.strikeouts)', 'sum(b.plate_appearances)')} as team_k_rate,
    {_div('sum(b.ops * b.plate_appearances)', 'sum(b.plate_appearances)')} as team_ops
    from batter_games b join pitcher_games p using (game_pk, pitcher_id) group by all"""

# Every table of the chain; unused ones are not computed.
CHAIN = f"""with {LOG}, {STARTERS}, pitcher_games as ({PITCHER_GAMES}), batter_games as ({BATTER_GAMES}),
    team_batting as ({TEAM_BATTING}), matchups as ({MATCHUPS}), hand_rates as ({HAND_RATES})"""


def rounded(doubles, longs=(), dates=(), plain=(), shift: float = 0.0) -> str:
    return ", ".join([r(c, c, shift=shift) for c in doubles] + [i(c, c) for c in longs] + [d(c, c) for c in dates] + list(plain))


_TEAM_DOUBLES = [c for c in _TEAM_DERIVED if not c.endswith("plate_appearances")] + [
    "bat_strikeout_rate_behind", "bat_strikeout_rate_ahead", "bat_woba",
    "bat_ops_vs_LHP", "bat_ops_vs_RHP", "bat_k_rate_vs_LHP", "bat_k_rate_vs_RHP",
]
ORACLE = {
    "starter_pairs": f"{CHAIN} select {rounded([], ['game_pk', 'pitcher'])} from starters",
    "pitcher_games": f"{CHAIN} select {rounded(_pitcher_metrics(), ['game_pk', 'pitcher_id', 'pitches', 'innings_pitched', 'batters_faced', 'strikeouts', 'unique_pitch_types'], ['game_date'], ['pitcher_hand', 'pitching_team', 'opponent_team'])} from pitcher_games",
    "batter_games": f"{CHAIN} select {rounded([*_BATTER_RATES, *_DERIVED], ['game_pk', 'batter_id', 'pitcher_id', *_BATTER_COUNTS], [], ['stand', 'pitching_team', 'opponent_team'])} from batter_games",
    "team_batting": f"{CHAIN} select {rounded(_TEAM_DOUBLES, ['game_pk', *[f'bat_{c}' for c in _TEAM_SUMS], 'bat_L_plate_appearances', 'bat_R_plate_appearances'], [], ['pitching_team', 'opponent_team', 'pitcher_hand'])} from team_batting",
    "catcher_games": f"""{CHAIN} select {i('game_pk', 'game_pk')}, {d('game_date', 'game_date')}, {i('fielder_2', 'catcher_id')},
        {r(_share("description = 'called_strike'", "not coalesce(contains(lower(description), 'swing'), false)"), 'called_strike_rate')},
        {i("count(*) filter (description = 'called_strike')", 'framing_runs')}
        from pitches where fielder_2 is not null group by game_pk, game_date, fielder_2""",
    "first_catchers": f"""{CHAIN} select {i('game_pk', 'game_pk')}, team,
        {i('arg_min(fielder_2, at_bat_number * 100 + pitch_number) filter (fielder_2 is not null)', 'catcher_id')}
        from (select *, case inning_topbot when 'Top' then home_team else away_team end as team from pitches where inning = 1)
        group by game_pk, team""",
    # Joins take ``_x`` for a suffix of theirs, so two columns lose it.
    "matchup_details": f"""{CHAIN} select {r('plate_x', 'plate')}, {r('pfx_x', 'pfx')},
        {rounded([*(c for c in _pitcher_metrics() if c not in ('plate_x', 'pfx_x')), *_TEAM_DOUBLES, 'elevation', 'humidity'],
        ['game_pk', 'pitcher_id', 'pitches', 'innings_pitched', 'batters_faced', 'strikeouts', 'unique_pitch_types', *[f'bat_{c}' for c in _TEAM_SUMS],
        'bat_L_plate_appearances', 'bat_R_plate_appearances', 'away_starting_pitcher_id', 'home_starting_pitcher_id'], ['game_date'],
        ['pitcher_hand', 'pitching_team', 'opponent_team', 'away_team', 'home_team', 'weather', 'temp', 'wind', 'hp_umpire', 'away_pitcher_ids', 'home_pitcher_ids'])} from matchups""",
    "hand_rates": f"{CHAIN} select {rounded(['team_k_rate', 'team_ops'], ['game_pk'], [], ['opponent_team', 'pitcher_hand'])} from hand_rates",
}
