"""Joins that leave one column per name."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.operators.sequence import BROADCAST_BYTES, BROADCAST_ROWS, MAX_ROWS_PER_TASK, key_counts

_SUFFIXES = re.compile(r"(?:_x|_y)+$")


def _suffixed(columns: Iterable[str]) -> dict[str, list[str]]:
    """Columns by their name without suffixes, the plain one first."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(_SUFFIXES.sub("", c), []).append(c)
    return {base: sorted(found, key=lambda c: c != base) for base, found in groups.items()}


def merge_suffixed(df: DataFrame) -> DataFrame:
    """Fold ``name``, ``name_x``, ``name_y``, ``name_x_y`` ... into ``name``, first non-NULL wins."""
    groups = _suffixed(df.columns)
    if list(groups) == df.columns:
        return df
    return df.selectExpr(*[f"coalesce({', '.join(map(_name, columns))}) as {_name(base)}" for base, columns in groups.items()])


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def coalescing_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    right_on: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join; a non-key column on both sides becomes ``coalesce(left, right)``.

    With ``right_on`` the keys have different names and the right ones are kept too.
    """
    left, right = merge_suffixed(left), merge_suffixed(right)
    on = list(on)
    right_keys = list(right_on or on)
    l, r = left.alias("l"), right.alias("r")
    condition = [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in zip(on, right_keys)]
    same_keys = right_on is None
    right_columns = [c for c in right.columns if not (same_keys and c in on)]
    full = how in ("right", "outer", "full", "fullouter", "full_outer", "right_outer")
    picked = []
    for c in map(_name, left.columns):
        both = c.strip("`") in right_columns or (same_keys and c.strip("`") in on and full)
        picked.append(f"coalesce(l.{c}, r.{c}) as {c}" if both else f"l.{c}")
    picked += [f"r.{_name(c)}" for c in right_columns if c not in left.columns]
    return l.join(r, condition, how).selectExpr(*picked)


def packed_join(groups: Sequence[Sequence[DataFrame]], on: Sequence[str]) -> DataFrame:
    """Left joins of many wide tables on the same keys.

    Inside a group a column is taken from the first table that has it; the groups are then
    joined as by ``coalescing_join``. A table goes through the joins as one column, so that
    wide rows are put together once and not by every join.
    """
    on, rows, sources = list(on), None, {}
    keys = list(map(_name, on))
    for g, tables in enumerate(groups):
        side, found = None, {}
        for t, table in enumerate(tables):
            packed = f"_packed_{g}_{t}"
            own = [c for c in table.columns if c not in found and c not in on]
            found |= {c: f"{packed}.{_name(c)}" for c in own}
            part = table.selectExpr(*keys, *([f"struct({', '.join(map(_name, own))}) as {packed}"] if own else []))
            side = part if side is None else side.join(part, on, "left")
        for base, columns in _suffixed(found).items():
            sources.setdefault(base, []).extend(found[c] for c in columns)
        rows = side if rows is None else rows.join(side, on, "left")
    picked = [f"coalesce({', '.join(s)}) as {_name(c)}" if len(s) > 1 else f"{s[0]} as {_name(c)}" for c, s in sources.items()]
    return rows.selectExpr(*keys, *picked)


def shared_keys(df: DataFrame, preferred: Sequence[str], fallback: Sequence[str]) -> list[str]:
    """Join keys chosen from the schema: ``preferred`` if all exist, else ``fallback``."""
    return list(preferred if set(preferred) <= set(df.columns) else fallback)


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = None) -> DataFrame:
    """One row per key: the first under ``order``, by default the order of all columns.

    The whole row is kept by a minimum over a struct, which combines before the
    shuffle, so a key repeated very often does not gather in one task.
    """
    names = df.columns
    if not order:
        return df.groupBy(*keys).agg(F.min(F.struct(*names)).alias("_row")).select("_row.*")
    rank = [c if isinstance(c, Column) else F.col(c) for c in order]
    key = F.struct(*[r.alias(f"k{i}") for i, r in enumerate(rank)])
    row = F.struct(*names)
    kept = df.groupBy(*keys).agg(F.min_by(row, key).alias("_row"))
    return kept.select("_row.*")


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last whole row of each key under ``order``, combined before the shuffle."""
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return kept.select("_row.*")


def not_yet_processed(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``existing``."""
    return df.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def only_listed(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``listed``."""
    return df.join(listed.select(*keys).distinct(), list(keys), "left_semi")


def fits_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most so many rows, of so many bytes as text in all."""
    if rows <= 0:
        return False
    seen = table.limit(rows + 1).agg(
        F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*table.columns)))).alias("b")
    ).first()
    return seen.n <= rows and (seen.b or 0) <= size


_MISSES = 1024


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Join a lookup table; broadcast only after checking that it is small.

    A larger table is joined by shuffle. Rows that lack a key find nothing whatever happens,
    so they are spread over many tasks by a hash of the row. A key with more than ``max_rows``
    rows, found by one counted pass over the keys, is dealt to parts of that size, and its rows
    of the table are copied to each part.
    """
    on = list(on)
    if fits_broadcast(table, broadcast_rows):
        return df.join(F.broadcast(table), on, how)
    if how != "left":
        return df.join(table, on, how)
    lacking = F.lit(False)
    for k in on:
        lacking = lacking | F.col(f"l.{_name(k)}").isNull()
    told = [F.col(f"l.{_name(f.name)}") for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    hot = key_counts(df, on, max_rows).select(
        *[F.col(_name(k)).alias(f"_hot{i}") for i, k in enumerate(on)], F.ceil(F.col("count") / max_rows).cast("int").alias("_parts")
    )

    def with_parts(rows: DataFrame, side: str) -> DataFrame:
        same = F.lit(True)
        for i, k in enumerate(on):
            same = same & (F.col(f"{side}.{_name(k)}") == F.col(f"_hot{i}"))
        return rows.alias(side).join(hot, same, "left")

    spread = F.when(lacking, F.pmod(F.xxhash64(*told), F.lit(_MISSES)) + 1).otherwise(F.pmod(F.xxhash64(*told), F.coalesce("_parts", F.lit(1))))
    left = with_parts(df, "l").select("l.*", spread.cast("int").alias("_spread_l")).alias("l")
    # Generated, not a literal: that would be folded into the condition, and rows placed by key alone.
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    right = with_parts(table, "r").select("r.*", copies.alias("_spread_r")).alias("r")
    same = F.col("l._spread_l") == F.col("r._spread_r")
    for k in on:
        same = same & (F.col(f"l.{_name(k)}") == F.col(f"r.{_name(k)}"))
    # Keys first, as in a join on names.
    rest = [c for c in df.columns if c not in on]
    picked = [F.col(f"l.{_name(c)}") for c in [*on, *rest]] + [F.col(f"r.{_name(c)}") for c in table.columns if c not in on]
    return left.join(right, same, "left").select(*picked)


def fill_from(
    df: DataFrame, source: DataFrame, keys: Sequence[str], column: str
) -> DataFrame:
    """Add ``column`` from ``source`` if it is missing, else fill its NULLs.

    The source is reduced to one row per key first, so rows are never multiplied.
    """
    values = source.groupBy(*keys).agg(F.min(column).alias("_fill"))
    joined = df.join(values, list(keys), "left")
    filled = F.coalesce(F.col(column), F.col("_fill")) if column in df.columns else F.col("_fill")
    return joined.withColumn(column, filled).drop("_fill")


def union_rows(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; a column missing in one is NULL there."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def stack_sides(df: DataFrame, keep: Sequence[str], sides: dict[str, dict[str, str]], label: str = "side") -> DataFrame:
    """Turn column groups (home, away) into rows; ``sides`` maps label -> {output: source}."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias(label), *[F.col(src).alias(out) for out, src in columns.items()])
            for name, columns in sides.items()
        ]
    )
    return df.select(*keep, F.inline(rows))


def latest_value(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """One row per key with the value of the last row that has one."""
    present = df.dropna(subset=[key, value])
    return present.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
