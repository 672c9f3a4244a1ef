"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagwise.session import apply_settings, ensure_checkpoint_dir, settle

__all__ = ["ascii_lower", "components", "positions", "prepare", "ranked", "read", "settle", "unwrapped", "whole", "whole_order", "word_count", "WORD"]

# A word is a run of code points outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bounds on what a Python worker holds of the input at once.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # Compiled batches of a few long texts are common; growing a page for each is not.
    "spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings that the operators rely on."""
    apply_settings(spark)
    for name, value in ARROW_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole(df: DataFrame) -> DataFrame:
    """All columns as one struct ``_row``, so that no name of theirs clashes with a working column."""
    return df.select(F.struct("*").alias("_row"))


def unwrapped(df: DataFrame) -> DataFrame:
    """The columns that ``whole`` has put away, and nothing else."""
    return df.select("_row.*")


def whole_order(df: DataFrame) -> list[Column]:
    """Columns that put rows of ``whole(df)`` in an order, whatever their types: rows that
    differ in any column have places of their own."""
    out = []
    for f in df.schema.fields:
        c = F.col("_row").getField(f.name)
        plain = not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))
        out.append(c if plain else F.to_json(F.struct(c.alias("c"))))
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def positions(df: DataFrame, order: Sequence[Column], out: str) -> tuple[DataFrame, int]:
    """Every row with its 0-based place in the whole order, and the number of rows.

    Rows are ranged over partitions, which are numbered one by one; only the partitions'
    row counts come to the driver. The ranged table is written first, as its borders are
    drawn from a sample and must not move between two readings.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    before = spark.createDataFrame(starts, "_part int, _before long")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    placed = ranged.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + rank - 1)
    return placed.drop("_part", "_before"), total


def ranked(
    rows: DataFrame, keys: Sequence[str], n: str, order: Sequence[Column], seed: int, out: str, where: Column | None = None
) -> DataFrame:
    """Exact 0-based rank ``out`` of each row in its group, by a seeded hash of ``order``.

    ``n`` is a column with the group's row count; keys are not null. A group is dealt into
    sub-groups of some hundreds of rows, or of a 100,000th of the table if that is more;
    their counts give each its first rank. So no task orders a large group, and the table of
    sub-groups stays small. Rows that do not fulfil ``where`` get null. ``rows`` is read
    more than once and should be a stored table.
    """
    chunk = max(256, rows.count() // 100_000)
    sub = [*keys, "_sub"]
    tagged = rows.withColumn("_sub", F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(1) + F.floor(F.col(n) / chunk)))
    wanted = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    some = tagged.where(wanted)
    counts = some.groupBy(*sub).agg(F.count("*").alias("_c"))
    earlier = Window.partitionBy(*keys).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*sub, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(*sub).orderBy(F.xxhash64(F.lit(seed + 1), *order), *order))
    placed = some.withColumn("_in", within).join(first, sub).withColumn(out, F.col("_first") + F.col("_in") - 1)
    placed = placed.drop("_sub", "_first", "_in")
    if where is None:
        return placed
    return placed.unionByName(tagged.where(~wanted).drop("_sub").withColumn(out, F.lit(None).cast("long")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: one row (node, component) per node that has a link.

    ``component`` is the smallest node of the component. Alternating large-star and
    small-star steps over the link table; each step is written to the checkpoint folder,
    which cuts the lineage, and the loop ends when a round changes nothing. Rows with a
    null end and loops are left out. Nothing but counts reaches the driver.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    edges = settle(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    ensure_checkpoint_dir(edges.sparkSession)
    state = _state(edges)
    while state[0]:
        edges = settle(_small_star(_large_star(edges)), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("u", "v").cast("long")).alias("s")
    ).first()
    return (row.n, row.x, row.s)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its least neighbour (itself included) to its larger neighbours."""
    ways = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u")
    out = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))
    )
    return out.distinct()
