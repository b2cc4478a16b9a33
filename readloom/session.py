"""Session set-up and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(
    app_name: str = "readloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the settings the operators are planned for.

    Adaptive execution does three jobs here: it coalesces small shuffle
    partitions, splits skewed join partitions, and turns a shuffled join into a
    broadcast one when the measured side turns out small.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    A session without the setting uses a folder beside its warehouse, which all
    executors reach as well.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    return current or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/readloom-scratch"


def scratch_path(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/readloom-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`scratch_path` named, once nothing reads it any more."""
    if "/readloom-" not in path:
        raise ValueError(f"not a scratch table: {path}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read on from there.

    The table outlives lost executors, so a long loop goes on from its last
    round and not from its input. Unlike a checkpointed DataFrame, a table read
    back does not inherit the constraints of the plan that made it; over many
    rounds these grow until planning takes longer than running. A caller that
    names the ``path`` can drop the table later.
    """
    path = path or scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
