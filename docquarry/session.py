"""Session settings and the shared folder for staged tables and stream checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot keys: AQE splits an oversized join partition, and an oversized partition before a write.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "docquarry", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; ``settings`` add to them or replace them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


PARTITION_BYTES = 256 * 1024 * 1024


def settings_for(input_bytes: int) -> dict[str, str]:
    """Partition settings for an input of this size, to pass to ``build_session``.

    Shuffles start from partitions of about 256 MB and AQE joins the small ones, so only the upper end
    has to be right: 200, the default, would make partitions of 500 GB out of 100 TB.
    """
    partitions = max(200, -(-input_bytes // PARTITION_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
    }


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for ``name`` in the folder all executors share.

    That is the session's ``spark.checkpoint.dir``. Where it is unset a session on one machine uses the
    warehouse; one on a cluster is refused, since each machine might write to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/docquarry/{name}-{uuid.uuid4().hex}"


def running_number(rows: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """The rows with ``column``, their number from 1 within their group, in the order given; nulls make groups too.

    The rows are dealt out by range of group and order and written, so that every later read sees the
    same cut; they are numbered within their range, and the sizes of the group's parts in earlier
    ranges are added. So a group may hold most of the rows, even at one moment: rows that are equal in
    all of ``order`` are told apart by an id that the write fixes.
    """
    path = shared_path(rows.sparkSession, "ranges")
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*group, *order, "_tie")
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    written = rows.sparkSession.read.schema(ranged.schema).parquet(path)
    within = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order, "_tie"))
    sizes = written.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    numbered = written.withColumn("_within", within).join(before, same)
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_within")).cast("bigint").alias(column))
