"""Expanding-window folds over time order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.operators.sequence import MAX_ROWS_PER_TASK, with_positions


def time_folds(
    df: DataFrame,
    order: Sequence[str],
    n_splits: int = 5,
    out: str = "fold",
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Fold id by time: fold 0 only trains, fold i is validated on folds before it.

    The last ``n_splits`` folds have ``n // (n_splits + 1)`` rows each. The rank comes
    from counts per order bucket, so nothing is sorted in one task.
    """
    ranked = with_positions(df, [], order, max_rows, out="_rank")
    n = df.count()
    size = n // (n_splits + 1)
    if size == 0:
        raise ValueError(f"{n} rows are too few for {n_splits} splits")
    first = n - n_splits * size
    fold = F.when(F.col("_rank") < first, 0).otherwise(F.expr(f"(_rank - {first}) div {size}") + 1)
    return ranked.withColumn(out, fold.cast("long")).drop("_rank")
