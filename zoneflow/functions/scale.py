"""Plan helpers that keep operators bounded as tables grow."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Upper bounds for a broadcast side; beyond either one the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

_SALTS = 64
_POSITION_BITS = 33  # layout of monotonically_increasing_id: partition number above, row position below


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a table (one aggregate over its text columns) against the broadcast bounds."""
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in df.dtypes if kind == "string"]
    width = sum(texts, F.lit(16 * len(df.columns))).cast("bigint")
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return size["n"] <= max_rows and size["bytes"] <= max_bytes


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rnk") -> DataFrame:
    """First `k` rows of each group under a total order, with their rank.

    Shares of a group are ranked first, so that no task sees the whole of a hot one; the last ranking sees the `k` first rows
    of each share.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS)))
    first = F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))
    df = salted.withColumn("__first", first).where(F.col("__first") <= k).drop("__salt", "__first")
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, ranked).where(F.col(rank) <= k)


def sequential_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Number rows 0, 1, 2, ... in the order of a unique key. Only the keys are sorted; the index is then joined back.

    The keys are sorted by range into many partitions, fixed by a checkpoint, and numbered inside each partition on top of
    the row counts of the partitions before it.
    """
    keys = df.select(key)
    ensure_checkpoint_dir(df.sparkSession)
    placed = keys.orderBy(key).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", _POSITION_BITS)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row per partition
        placed.groupBy(part.alias("__part")).count()
        .select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    )
    position = F.col("__at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    index = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").select(
        key, (F.col("__offset") + position).alias(name)
    )
    return df.join(index, key)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or one below the warehouse where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/zoneflow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
