"""Flattening of nested JSON documents: typed ``from_json``, then explodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.functions import scalars as X

# Shapes of the documents, states of a finished game, league ids,
# umpire positions and the betting market.
_TEAM = "struct<id:bigint,abbreviation:string,league:struct<id:bigint>>"
GAME_FEED = (
    "struct<gameData:struct<"
    "game:struct<calendarEventID:string,gameNumber:int,doubleHeader:string,gameDate:string>,"
    f"teams:struct<away:{_TEAM},home:{_TEAM}>,"
    "venue:struct<location:struct<elevation:double>>,"
    "weather:struct<condition:string,wind:string,temp:string>,"
    "datetime:struct<dayNight:string,firstPitch:string,time:string>,"
    "status:struct<abstractGameState:string>>,"
    "liveData:struct<boxscore:struct<"
    "officials:array<struct<officialType:string,official:struct<fullName:string>>>,"
    "teams:struct<away:struct<pitchers:array<bigint>>,home:struct<pitchers:array<bigint>>>>>>"
)
FINAL_STATES = ["Final", "Game Over"]
LEAGUE_IDS = [103, 104]
UMPIRES = {
    "hp_umpire": "Home Plate",
    "1b_umpire": "First Base",
    "2b_umpire": "Second Base",
    "3b_umpire": "Third Base",
}
_PLAYER = (
    "struct<person:struct<id:bigint>,battingOrder:string,batSide:struct<code:string>,"
    "position:struct<abbreviation:string,code:string>,gamePosition:string>"
)
_SIDE = f"struct<team:struct<abbreviation:string>,players:map<string,{_PLAYER}>>"
BOXSCORE = f"struct<teams:struct<home:{_SIDE},away:{_SIDE}>>"
_PROBABLE = "struct<team:struct<id:bigint,abbreviation:string>,probablePitcher:struct<id:bigint,fullName:string>>"
SCHEDULE = (
    "struct<dates:array<struct<games:array<struct<gamePk:bigint,"
    f"teams:struct<away:{_PROBABLE},home:{_PROBABLE}>>>>>>"
)
TRANSACTIONS = "struct<transactions:array<struct<playerId:bigint,transactionDate:string,description:string>>>"
ODDS = (
    "array<struct<id:string,commence_time:string,bookmakers:array<struct<title:string,last_update:string,"
    "markets:array<struct<key:string,outcomes:array<struct<name:string,price:double,point:double,line:double>>>>>>>>"
)
STRIKEOUT_MARKET = "player_strikeouts"


def _parsed(body: str, schema: str) -> Column:
    return F.from_json(F.col(body), schema)


def game_feed_rows(df: DataFrame, game: str = "game_pk", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """One row per finished game between the two leagues, and the rejected documents.

    Returns ``(games, rejected)``; ``rejected`` has the id and a ``reason``.
    """
    doc = df.select(F.col(game), _parsed(body, GAME_FEED).alias("d"))
    data, box = "d.gameData", "d.liveData.boxscore"

    def umpire(position: str) -> Column:
        # The last official of a position wins.
        named = F.filter(F.col(f"{box}.officials"), lambda o: o["officialType"] == position)
        return F.get(F.reverse(named), F.lit(0))["official"]["fullName"]

    def pitchers(side: str) -> Column:
        return F.to_json(F.coalesce(F.col(f"{box}.teams.{side}.pitchers"), F.array().cast("array<bigint>")))

    pitch = F.nullif(
        F.coalesce(F.nullif(F.col(f"{data}.datetime.firstPitch"), F.lit("")), F.col(f"{data}.datetime.time")),
        F.lit(""),
    )
    rows = doc.select(
        game,
        F.col(f"{data}.status.abstractGameState").isin(FINAL_STATES).alias("_final"),
        (
            F.col(f"{data}.teams.away.league.id").isin(LEAGUE_IDS)
            & F.col(f"{data}.teams.home.league.id").isin(LEAGUE_IDS)
        ).alias("_league"),
        X.date_from_dashed_id(f"{data}.game.calendarEventID", f"{data}.game.gameDate").alias("game_date"),
        F.nullif(F.col(f"{data}.teams.away.abbreviation"), F.lit("")).alias("away_team"),
        F.nullif(F.col(f"{data}.teams.home.abbreviation"), F.lit("")).alias("home_team"),
        F.col(f"{data}.game.gameNumber").alias("game_number"),
        F.col(f"{data}.game.doubleHeader").alias("double_header"),
        pitchers("away").alias("away_pitcher_ids"),
        pitchers("home").alias("home_pitcher_ids"),
        *[umpire(position).alias(name) for name, position in UMPIRES.items()],
        F.col(f"{data}.weather.condition").alias("weather"),
        X.to_number(f"{data}.weather.temp").alias("temp"),
        F.col(f"{data}.weather.wind").alias("wind"),
        F.col(f"{data}.venue.location.elevation").alias("elevation"),
        F.col(f"{data}.datetime.dayNight").alias("dayNight"),
        X.clock_time(pitch).alias("first_pitch"),
    )
    reason = (
        F.when(~X.is_true(F.col("_final")), "not final")
        .when(~X.is_true(F.col("_league")), "other league")
        .when(
            F.col("away_team").isNull() | F.col("home_team").isNull() | F.col("game_date").isNull(),
            "missing team or date",
        )
    )
    marked = rows.withColumn("reason", reason)
    games = marked.where(F.col("reason").isNull()).drop("_final", "_league", "reason")
    return games, marked.where(F.col("reason").isNotNull()).select(game, "reason")


def lineup_rows(
    df: DataFrame, game: str = "game_pk", body: str = "body", max_order: int | None = None
) -> DataFrame:
    """One row per starting batter, with the catcher of the team on every row.

    Slots are coded 100, 200 ... 900 and substitutes 101, 102 ...; starters are the
    round hundreds. ``max_order`` keeps orders up to a limit instead.
    """
    doc = df.select(F.col(game), _parsed(body, BOXSCORE).alias("d"))
    sides = F.array(F.col("d.teams.home"), F.col("d.teams.away"))

    def starter(p: Column) -> Column:
        order = p["battingOrder"].try_cast("int")
        return X.is_true(order <= max_order if max_order is not None else (order % 100 == 0) & (order > 0))

    def catches(p: Column) -> Column:
        position = F.coalesce(p["position"]["abbreviation"], p["position"]["code"], p["gamePosition"])
        return X.is_true(position.isin("C", "2"))

    # The catcher is found inside the player array: no window and no join.
    teams = doc.select(game, F.explode(sides).alias("s")).select(
        game,
        F.col("s.team.abbreviation").alias("team"),
        F.filter(F.map_values("s.players"), starter).alias("players"),
    )
    caught = teams.withColumn(
        "catcher_id", F.get(F.reverse(F.filter("players", catches)), F.lit(0))["person"]["id"]
    )
    return caught.select(game, "team", "catcher_id", F.explode("players").alias("p")).select(
        game,
        "team",
        F.col("p.person.id").alias("batter_id"),
        F.col("p.battingOrder").try_cast("int").alias("batting_order"),
        F.col("p.batSide.code").alias("stand"),
        "catcher_id",
    )


def probable_pitchers(df: DataFrame, date: str = "game_date", body: str = "body") -> DataFrame:
    """Probable pitchers of the first date in each schedule; games lacking one are skipped."""
    doc = df.select(F.col(date).alias("game_date"), _parsed(body, SCHEDULE).alias("d"))
    games = doc.select("game_date", F.explode(F.get("d.dates", F.lit(0))["games"]).alias("g"))
    rows = games.select(
        "game_date",
        F.col("g.gamePk").alias("game_pk"),
        F.col("g.teams.home.team.abbreviation").alias("home_team_abbr"),
        F.col("g.teams.away.team.abbreviation").alias("away_team_abbr"),
        F.col("g.teams.home.probablePitcher.fullName").alias("home_probable_pitcher_name"),
        F.col("g.teams.home.probablePitcher.id").alias("home_probable_pitcher_id"),
        F.col("g.teams.away.probablePitcher.fullName").alias("away_probable_pitcher_name"),
        F.col("g.teams.away.probablePitcher.id").alias("away_probable_pitcher_id"),
        F.col("g.teams.home.team.id").alias("_home"),
        F.col("g.teams.away.team.id").alias("_away"),
    )
    # A missing, zero or empty value counts as absent.
    ids = ["game_pk", "_home", "_away", "home_probable_pitcher_id", "away_probable_pitcher_id"]
    names = ["home_probable_pitcher_name", "away_probable_pitcher_name"]
    complete = F.lit(True)
    for c in ids:
        complete = complete & X.is_true(F.col(c) != 0)
    for c in names:
        complete = complete & X.is_true(F.col(c) != "")
    return rows.where(complete).drop("_home", "_away")


def game_ids(df: DataFrame, body: str = "body") -> DataFrame:
    """Distinct game ids over all dates of the schedules."""
    doc = df.select(F.explode(_parsed(body, SCHEDULE)["dates"]).alias("day"))
    games = doc.select(F.explode("day.games").alias("g")).select(F.col("g.gamePk").alias("game_pk"))
    return games.where(F.col("game_pk") != 0).distinct()


def injury_events(df: DataFrame, body: str = "body") -> DataFrame:
    """Injured-list transactions as ``(player_id, date, action)``."""
    doc = df.select(F.explode(_parsed(body, TRANSACTIONS)["transactions"]).alias("t"))
    rows = doc.select(
        F.col("t.playerId").alias("player_id"),
        F.col("t.transactionDate").try_cast("date").alias("date"),
        X.stint_action("t.description").alias("action"),
    )
    return rows.where((F.col("player_id") != 0) & F.col("date").isNotNull() & F.col("action").isNotNull())


def odds_rows(df: DataFrame, body: str = "body", market: str = STRIKEOUT_MARKET) -> DataFrame:
    """Events x bookmakers x markets x outcomes, one row per outcome of one market."""
    events = df.select(F.explode(_parsed(body, ODDS)).alias("e"))
    books = events.select("e.id", "e.commence_time", F.explode("e.bookmakers").alias("b"))
    markets = books.select("id", "commence_time", "b.title", "b.last_update", F.explode("b.markets").alias("m"))
    outcomes = markets.where(F.col("m.key") == market).select(
        "id", "commence_time", "title", "last_update", F.explode("m.outcomes").alias("o")
    )
    name = F.coalesce(F.col("o.name"), F.lit(""))
    return outcomes.select(
        F.col("id").alias("event_id"),
        "commence_time",
        F.col("title").alias("bookmaker"),
        X.bet_player(name).alias("player"),
        F.coalesce(F.nullif(F.col("o.point"), F.lit(0.0)), F.col("o.line")).alias("line"),
        X.bet_side(name).alias("side"),
        F.col("o.price").alias("odds"),
        "last_update",
        F.current_timestamp().alias("inserted_at"),
    )
