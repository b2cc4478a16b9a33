"""A table laid out by one key, for many steps that join, group and run windows on it.

Rows of one bucket of the key lie in one file, so a step that needs a key's rows together
reads them so and shuffles nothing for it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from readloom.operators.ordered import choose_width
from readloom.session import cut_lineage, scratch_path

BUCKET_ROWS = 4_000_000
#: Spark's own bound on buckets, unless a session raises it.
MAX_BUCKETS = 100_000


def clustered(df: DataFrame, key: str, order: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """``df`` as a written table that is bucketed by ``key`` and sorted by ``order`` in each bucket.

    The number of buckets grows with the rows, unless it is given. Two tables that meet in a join need the same one. Rows with a
    null key share a bucket. If a key has too many rows for one task, the table is written without buckets: then the
    steps shuffle, sums are folded before that, and wide keys are cut. The catalog entry lasts for the
    session, the files until their folder is deleted.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    if choose_width(df, [key]) is not None:
        return cut_lineage(df, path)
    if buckets is None:
        fitting = -(-df.count() // BUCKET_ROWS)
        buckets = min(MAX_BUCKETS, max(fitting, spark.sparkContext.defaultParallelism))
    name = f"readloom_{uuid.uuid4().hex}"
    # rows are dealt by the hash that buckets use, so each bucket is one file
    writer = df.repartition(buckets, key).write.option("path", path).bucketBy(buckets, key)
    writer.sortBy(*(order or (key,))).saveAsTable(name)
    return spark.table(name)
