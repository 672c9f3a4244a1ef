"""Column functions. All are native expressions; none calls Python per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_MILES = 3958.8


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_true(condition: Column) -> Column:
    """Condition with NULL read as false, so that it can be negated safely."""
    return F.coalesce(condition, F.lit(False))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double, NULL for a zero or NULL denominator."""
    return _col(numerator).cast("double") / F.nullif(_col(denominator).cast("double"), F.lit(0.0))


def to_number(c: Column | str) -> Column:
    """Number from text; unreadable text is NULL."""
    return _col(c).cast("string").try_cast("double")


def to_id(c: Column | str) -> Column:
    return F.floor(to_number(c)).cast("long")


def first_number(c: Column | str) -> Column:
    """First run of digits in free text, as double."""
    return F.nullif(F.regexp_extract(_col(c), r"(\d+)", 1), F.lit("")).try_cast("double")


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; NULL when a coordinate is missing."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    across = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2
    )
    return F.lit(2 * EARTH_RADIUS_MILES) * F.asin(F.sqrt(across))


def month_bucket(date: Column | str) -> Column:
    month = F.month(_col(date))
    return F.when(month <= 4, "early").when(month <= 8, "mid").when(month <= 12, "late")


def day_of_week(date: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(_col(date)).cast("long")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier)).cast("long")


def age_years(date: Column | str, birth_date: Column | str) -> Column:
    return days_between(date, birth_date) / F.lit(365.25)


def clip(c: Column | str, lower: Column, upper: Column) -> Column:
    """Clip to bounds; NULL stays NULL, and a NULL bound does not clip."""
    value = _col(c)
    return F.when(value.isNotNull(), F.least(F.greatest(value, lower), upper))


def first_of_json_list(c: Column | str) -> Column:
    """First element of a JSON list of ids, NULL for bad text or an empty list."""
    return F.get_json_object(_col(c), "$[0]").try_cast("long")


def clock_time(c: Column | str) -> Column:
    """Timestamp text as ``hh:mm AM``; text that is no timestamp is kept as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(_col(c)), "hh:mm a"), _col(c))


def date_from_dashed_id(c: Column | str, fallback: Column | str) -> Column:
    """Date held by the last three dashed parts of an id; the fallback's date if they are not digits."""
    found = F.nullif(F.regexp_extract(_col(c), r"(?:^|-)(\d+-\d+-\d+)$", 1), F.lit(""))
    return F.coalesce(found.try_cast("date"), F.substring(_col(fallback), 1, 10).try_cast("date"))


def player_id_from_link(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), r"/player/[^/]+-(\d+)", 1), F.lit("")).try_cast("long")


def bet_side(name: Column | str) -> Column:
    n = _col(name)
    return F.when(n.contains(" Over "), "over").when(n.contains(" Under "), "under").otherwise("unknown")


def bet_player(name: Column | str) -> Column:
    n = _col(name)
    player = (
        F.when(n.contains(" Over "), F.substring_index(n, " Over ", 1))
        .when(n.contains(" Under "), F.substring_index(n, " Under ", 1))
        .otherwise(n)
    )
    return F.trim(player)


def stint_action(description: Column | str) -> Column:
    """``start`` / ``end`` for an injured-list transaction, NULL for any other text."""
    text = F.lower(_col(description))
    return F.when(
        text.contains("injured list"),
        F.when(text.contains("placed") | text.contains("transferred"), "start").when(
            text.contains("reinstated") | text.contains("activated"), "end"
        ),
    )


def round_half_even(c: Column | str) -> Column:
    return F.bround(_col(c), 0)


def pair_key(*columns: Column | str) -> Column:
    return F.concat_ws("_", *[_col(c).cast("string") for c in columns])


def group_by_name(
    name: Column | str,
    exact: Mapping[str, str],
    prefixes: Mapping[str, str],
    default: str,
) -> Column:
    """Group of a feature name: exact match, then the first matching prefix, then the default."""
    n = _col(name)
    result = F.lit(default)
    rules = [(n == k, g) for k, g in exact.items()] + [(n.startswith(p), g) for p, g in prefixes.items()]
    for condition, group in reversed(rules):
        result = F.when(condition, group).otherwise(result)
    return result
