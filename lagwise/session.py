"""Session helpers: settings this library relies on, and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

# Everything here is a runtime SQL setting, so it can be applied to a session the
# cluster has already started.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split by the adaptive plan, even where that costs a shuffle more.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for name, value in SQL_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lagwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.extraJavaOptions", "-Xss16m")
        # Wide window plans compile many small classes; the call-site record of every
        # Python column costs a round trip each.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return apply_settings(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a scratch folder only in local mode.

    Elsewhere a folder that machines do not share would lose data, so an unset one is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not shared:
        if not (context.master or "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="lagwise-checkpoint-")
    context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table written between two steps."""
    return f"{ensure_checkpoint_dir(spark)}/lagwise-{name}-{uuid.uuid4().hex}"


# Paths of the tables that are settled inside ``passing``, innermost last.
_scopes: list[list[str]] = []


# Tables with more columns than this are stored without dictionaries: writers keep one per
# column and task, and computed numbers hardly repeat.
DICTIONARY_COLUMNS = 200


def writer(df: DataFrame) -> DataFrameWriter:
    """The writer of a scratch or store table of any width."""
    return df.write if len(df.columns) <= DICTIONARY_COLUMNS else df.write.option("parquet.enable.dictionary", "false")


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` once and read it back, so that later passes do not repeat its work.

    The table is columnar: a pass that needs only the keys reads only the keys.
    """
    path = scratch_path(df.sparkSession, name)
    writer(df).parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Empties scratch tables that nothing reads any more."""
    for path in paths:
        spark.createDataFrame([], "x int").write.mode("overwrite").parquet(path)


def passing(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """Stores what ``make`` returns and empties the scratch tables made on the way."""
    made: list[str] = []
    _scopes.append(made)
    try:
        path = scratch_path(spark, name)
        make().write.parquet(path)
    finally:
        _scopes.pop()
        release(spark, made)
    return spark.read.parquet(path), path


def is_plain_scan(df: DataFrame) -> bool:
    """Whether reading ``df`` again costs no more than reading its columns again."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = [line.strip(" :+-").split(" ")[0].split("[")[0] for line in plan.toString().splitlines() if line.strip()]
    return all(n in ("Project", "Filter", "Relation", "LogicalRDD", "LocalRelation", "Range") for n in nodes)
