import os
import random

import pytest
from pyspark.sql import functions as F

from readloom.operators.select import longest_n
from readloom.operators.sketch import SketchOptions, screen
from readloom.operators.status import attribute_failures, fold_status, log_events
from readloom.plans.catalog import all_queries
from readloom.streaming.reads import stream_longest, stream_screen
from readloom.streaming.status import running_status, status_so_far, stream_failures, stream_status
from readloom.streaming.versions import MergedTable, live_runs, read_all_versions, read_version
from tests.conftest import rows


class Feed:
    """Rows that arrive in parts; each part is one file and one micro-batch."""

    def __init__(self, spark, root, data, schema, n_parts):
        self.spark, self.schema, self.folder = spark, schema, f"{root}/in"
        size = -(-len(data) // n_parts)
        self.parts = [data[i : i + size] for i in range(0, len(data), size)]

    def add(self, *numbers):
        for i in numbers:
            part = self.spark.createDataFrame(self.parts[i], self.schema)
            part.coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
        return source.parquet(self.folder)

    def all(self):
        return self.spark.read.schema(self.schema).parquet(self.folder)


LOG = "file string, line_no bigint, line string"
READS = "id bigint, seq string, len bigint"


@pytest.fixture
def log(spark, tmp_path):
    rng = random.Random(8)
    data = []
    for i in range(120):
        ids = f"{rng.randint(1, 40)} {rng.randint(1, 40)}"
        line = rng.choice([f"Starting job(s) {ids}: x", f"Finished job(s) {ids}: x", f"Failed job(s) {ids}: x", "slurmstepd: error: *** x", "noise"])
        data.append((rng.choice(["f1", "f1", "f2", "f3"]), i, line))
    return Feed(spark, tmp_path, data, LOG, 4)


@pytest.fixture
def reads(spark, tmp_path):
    rng = random.Random(9)
    data = [(i, "".join(rng.choices("ACGT", k=rng.randint(5, 60)))) for i in range(60)]
    return Feed(spark, tmp_path, [(i, s, len(s)) for i, s in data], READS, 3)


def test_failures_equal_batch_and_restart_adds_nothing(spark, log, tmp_path):
    dirs = [f"{tmp_path}/{d}" for d in ("hits", "state", "cp")]
    log.add(0, 1)
    stream_failures(log.stream(), *dirs).awaitTermination()
    log.add(2, 3)
    for _ in range(2):
        stream_failures(log.stream(), *dirs).awaitTermination()
        assert rows(read_all_versions(spark, dirs[0])) == rows(attribute_failures(log.all()))


def test_status_with_failures_equals_batch_over_a_restart(spark, log, tmp_path):
    dirs = [f"{tmp_path}/{d}" for d in ("ranks", "state", "cp")]
    requested = spark.range(50).withColumnRenamed("id", "rowid")
    for part in ((0, 1), (2, 3)):
        log.add(*part)
        stream_status(log.stream(), *dirs).awaitTermination()
        assert rows(status_so_far(spark, requested, dirs[0])) == rows(fold_status(requested, log.all()))


def test_running_status_equals_events(spark, log):
    log.add(0, 1, 2, 3)
    query = running_status(log.stream()).writeStream.outputMode("complete").format("memory").queryName("seen")
    query.trigger(availableNow=True).start().awaitTermination()
    best = log_events(log.all()).groupBy("rowid").agg(F.max("rank").alias("rank"))
    names = {1: "RUNNING", 2: "FAILED", 3: "COMPLETED"}
    assert dict(rows(spark.table("seen"))) == {r.rowid: names[r.rank] for r in best.collect()}


def test_longest_equals_batch(spark, reads, tmp_path):
    reads.add(0, 1, 2)
    query = stream_longest(reads.stream(), 7, f"{tmp_path}/top", f"{tmp_path}/cp")
    query.awaitTermination()
    newest = read_version(spark, f"{tmp_path}/top", query.lastProgress["batchId"])
    assert rows(newest) == rows(longest_n(reads.all(), 7))


def test_screen_equals_batch(spark, reads, tmp_path):
    reads.add(0, 1, 2)
    options = SketchOptions(k=5, n=20)
    refs = reads.all().filter("id % 9 = 0").select("id", "seq")
    sinks = [f"{tmp_path}/{d}" for d in ("bad", "good")]
    stream_screen(reads.stream(), refs, 0.2, *sinks, f"{tmp_path}/cp", options).awaitTermination()
    batch = screen(reads.all(), refs, 0.2, options)
    for sink, wanted in zip(sinks, ("is_contaminant", "not is_contaminant")):
        assert rows(read_all_versions(spark, sink), "id", "reference_id", "ji") == rows(batch.filter(wanted), "id", "reference_id", "ji")


def _maximum(df):
    return df.groupBy("k").agg(F.max("v").alias("v"))


def test_runs_in_force_cover_every_batch_once():
    for fan_in in (2, 3, 8):
        for n in range(300):
            runs = live_runs(n, fan_in)
            assert [b for first, last in runs for b in range(first, last + 1)] == list(range(n))
            powers = 1
            while fan_in**powers <= max(n, 1):
                powers += 1
            assert len(runs) <= (fan_in - 1) * powers


def test_merged_table_over_batches_replays_and_a_torn_write(spark, tmp_path):
    rng = random.Random(4)
    root, n_batches = f"{tmp_path}/t", 30
    best, written = {}, []
    for batch_id in range(n_batches):
        data = [(rng.randint(0, 20), rng.randint(0, 1000)) for _ in range(5)]
        batch = spark.createDataFrame(data, "k int, v int")
        # a new object each time, as after a restart; some batches run twice
        for _ in range(1 + (batch_id % 4 == 3)):
            MergedTable(spark, root, _maximum, 3).add(batch, batch_id)
        for k, v in data:
            best[k] = max(v, best.get(k, 0))
        table = MergedTable(spark, root, _maximum, 3)
        if batch_id % 5 == 0 or batch_id == n_batches - 1:
            assert dict(_maximum(table.read()).collect()) == best
        written.append(len(table._folders()[1]))
    assert max(written) <= 2 * 3 * 4
    # a run that was begun but not finished is not read
    (tmp_path / "t" / f"run-{n_batches}-{n_batches}").mkdir()
    assert dict(_maximum(MergedTable(spark, root, _maximum, 3).read()).collect()) == best


def test_state_follows_the_files_of_a_batch(spark, tmp_path):
    """Old files cost nothing: what a batch writes are its own files' starts."""
    data = [(f"f{i}", i, f"Starting job(s) {i}: x") for i in range(12)]
    data += [("f3", 100, "slurmstepd: error: *** x"), ("f3", 101, "noise"), ("g", 102, "slurmstepd: error: *** x")]
    log = Feed(spark, tmp_path, data, LOG, 5)
    dirs = [f"{tmp_path}/{d}" for d in ("hits", "state", "cp")]
    log.add(0, 1, 2, 3, 4)
    stream_failures(log.stream(), *dirs).awaitTermination()
    assert rows(read_all_versions(spark, dirs[0])) == [(3, "f3", 100)]
    sizes = {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "state").glob("run-*")}
    assert sizes == {"run-0-0": 3, "run-1-1": 3, "run-2-2": 3, "run-3-3": 3, "run-4-4": 0}


def test_status_before_any_line(spark, tmp_path):
    got = status_so_far(spark, spark.range(2).withColumnRenamed("id", "rowid"), f"{tmp_path}/none")
    assert rows(got) == [(0, "RESERVED"), (1, "RESERVED")]


@pytest.fixture
def folders(spark, sf_dir, tmp_path):
    """The test tables with the documents as a folder of three files."""
    for name in ("benchmark", "events"):
        os.symlink(f"{sf_dir}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("streamed, batch", [("streamed_longest", "longest_n"), ("streamed_screen", "screen")])
def test_table_in_several_files(spark, folders, streamed, batch):
    got = all_queries()[streamed](spark, folders)
    assert got.count() > 0 and rows(got) == rows(all_queries()[batch](spark, folders), *got.columns)
