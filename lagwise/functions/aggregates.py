"""Aggregate expressions with the missing-value rules of the feature definitions.

Arguments and results are SQL text: a metric is then one parsed expression, and a
hundred of them are quick to build.
"""

from __future__ import annotations

from collections.abc import Iterable


def one_of(column: str, values: Iterable[str]) -> str:
    """Membership that is false, not NULL, for a missing value."""
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"coalesce({column} in ({listed}), false)"


def ratio(numerator: str, denominator: str) -> str:
    """Quotient as double, NULL for a zero or NULL denominator."""
    return f"cast({numerator} as double) / nullif(cast({denominator} as double), 0D)"


def total(value: str) -> str:
    """Sum, 0 when there is nothing to add."""
    return f"coalesce(sum({value}), 0)"


def _flag(condition: str) -> str:
    return f"case when {condition} then 1 else 0 end"


def share(condition: str) -> str:
    """Share of rows where the condition holds; NULL counts as false."""
    return f"avg({_flag(condition)})"


def share_within(condition: str, mask: str) -> str:
    """Share among the rows of ``mask``; NULL if the mask is empty."""
    return f"avg(case when {mask} then {_flag(condition)} end)"


def weighted_mean(value: str, weight: str) -> str:
    """Weighted mean over rows where both value and weight are present."""
    return ratio(f"sum({value} * {weight})", f"sum(case when {value} is not null then {weight} end)")


def ratio_of_sums(value: str, weight: str) -> str:
    """``sum(v * w) / sum(w)``: rows without a value still count in the denominator."""
    return ratio(f"sum({value} * {weight})", f"sum({weight})")


def first_by(value: str, order: str) -> str:
    """First non-NULL value under an order."""
    return f"min_by({value}, case when {value} is not null then {order} end)"


def missing() -> str:
    return "cast(null as double)"
