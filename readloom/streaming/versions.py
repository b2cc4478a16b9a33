"""Tables with one folder per micro-batch, and keyed tables whose folders merge as batches pass.

A replayed micro-batch overwrites its own folders and reads only older ones, so a
restart after any failure gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Runs of one length that are merged into a longer one.
FAN_IN = 8


def version_path(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch={batch_id}"


def write_version(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(version_path(root, batch_id))


def read_version(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(version_path(root, batch_id))


def read_all_versions(spark: SparkSession, root: str) -> DataFrame:
    """Rows of every micro-batch of an append-only sink."""
    return spark.read.parquet(root).drop("batch")


def live_runs(n_batches: int, fan_in: int = FAN_IN) -> list[tuple[int, int]]:
    """(first, last) batch of each run after ``n_batches``: their number's digits to the base ``fan_in``."""
    length = 1
    while length * fan_in <= n_batches:
        length *= fan_in
    runs, first = [], 0
    while first < n_batches:
        while first + length > n_batches:
            length //= fan_in
        runs.append((first, first + length - 1))
        first += length
    return runs


class MergedTable:
    """A keyed table that micro-batches add to; ``fold`` brings rows of one key down to one.

    Each batch writes its own rows as a run. Whenever ``fan_in`` runs of one length are there, the
    batch that completes them writes them as one run, its own rows included. Which runs are in force follows from the
    number of batches alone, so a reader opens at most (fan_in - 1) folders per power of fan_in, a row
    is written once per power, and no list of folders has to be kept in step with them. Runs that were merged are
    deleted when the next ``fan_in`` batches are done, which leaves readers that time to finish.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        fold: Callable[[DataFrame], DataFrame],
        fan_in: int = FAN_IN,
    ) -> None:
        self.spark, self.root, self.fold, self.fan_in = spark, root.rstrip("/"), fold, fan_in

    def _path(self, run: tuple[int, int]) -> str:
        return f"{self.root}/run-{run[0]}-{run[1]}"

    def _folders(self) -> tuple[object, list[tuple[int, int]]]:
        """The file system, and the runs that are written whole."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        system = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in system.listStatus(place)] if system.exists(place) else []
        runs = [tuple(int(x) for x in name.split("-")[1:]) for name in names if name.startswith("run-")]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return system, [r for r in runs if system.exists(path(f"{self._path(r)}/_SUCCESS"))]

    def read(self, n_batches: int | None = None) -> DataFrame | None:
        """Rows of the runs in force, not folded over runs; None before the first batch."""
        if n_batches is None:
            n_batches = max((last + 1 for _, last in self._folders()[1]), default=0)
        paths = [self._path(run) for run in live_runs(n_batches, self.fan_in)]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Write the batch's rows, merged with the runs that they complete."""
        run = live_runs(batch_id + 1, self.fan_in)[-1]
        older = [self._path(r) for r in live_runs(batch_id, self.fan_in) if r[0] >= run[0]]
        merged = rows.unionByName(self.spark.read.schema(rows.schema).parquet(*older)) if older else rows
        self.fold(merged).write.mode("overwrite").parquet(self._path(run))
        if batch_id % self.fan_in == self.fan_in - 1:
            self._drop_merged(batch_id)

    def _drop_merged(self, batch_id: int) -> None:
        """Delete runs inside runs that were in force ``fan_in`` batches ago."""
        kept = live_runs(batch_id + 1 - self.fan_in, self.fan_in)
        system, runs = self._folders()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for run in runs:
            if any(k[0] <= run[0] and run[1] <= k[1] and k != run for k in kept):
                system.delete(path(self._path(run)), True)


def start_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Run ``handle`` on each micro-batch; once=True stops when the input is used up."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
