import datetime

import pytest
from pyspark.sql import functions as F

from readloom import schemas
from readloom.operators import blocks as B
from readloom.operators import completeness as C
from readloom.operators import ordered
from readloom.operators import status as S
from readloom.operators import telemetry as T
from readloom.operators.runs import compress_runs, consecutive_runs
from tests.conftest import rows

N = 500


@pytest.fixture(scope="module")
def block_ids(spark):
    return spark.range(1, N + 1).withColumnRenamed("id", "block_id")


@pytest.fixture(scope="module")
def plan(block_ids):
    return B.block_pairs(block_ids).persist()


def with_status(plan, status):
    return plan.withColumn("status", status)


def test_pairs(plan):
    expected, rowid = [], 0
    for i in range(1, N + 1):
        rowid += 1
        expected.append((rowid, i, i, 1))
    for i in range(1, N + 1):
        for j in range(i + 1, N + 1):
            rowid += 1
            expected.append((rowid, i, j, i + 1))
    got = sorted((r.rowid, r.block_id1, r.block_id2, r.priority) for r in plan.collect())
    assert len(got) == 125_250 and got == expected


def test_completed_blocks(plan, block_ids):
    done = with_status(plan, F.when(F.col("rowid") <= 1700, schemas.COMPLETED).otherwise(schemas.NOTSTARTED))
    assert rows(B.completed_keys(done, block_ids)) == [(1,), (2,)]


def test_selection(plan):
    work = with_status(
        plan,
        F.when(F.col("rowid") <= 100, schemas.COMPLETED).when(F.col("rowid") <= 200, schemas.RUNNING).otherwise(schemas.NOTSTARTED),
    )
    assert B.select_work(work, limit=5).count() == 5
    assert [r.rowid for r in B.select_work(work, (schemas.COMPLETED,), 5).collect()] == [1, 2, 3, 4, 5]
    assert B.select_work(work, (schemas.NOTSTARTED,)).count() == 125_250 - 200
    assert B.select_work(work).count() == 125_250
    summary = S.status_summary(work).first()
    assert (summary.total, summary.completed, summary.running, summary.notstarted) == (125_250, 100, 100, 125_050)


@pytest.mark.parametrize("width", [None, 1000, ordered.AUTO])
def test_chunks(plan, width):
    sized = B.chunk_within_key(plan, 16, width=width).groupBy("block_id1", "priority", "batch").count()
    assert sized.filter("priority = 1 and count = 1").count() == N
    first = [r["count"] for r in sized.filter("priority = 2").orderBy("batch").collect()]
    assert first == [16] * 31 + [3]


def test_blocks_by_bases(spark):
    lengths = [5, 3, 9, 0, 1, 20, 4]
    reads = spark.createDataFrame(list(enumerate(lengths)), "id bigint, len bigint").repartition(3)
    expected, start = [], 0
    for i, n in enumerate(lengths):
        expected.append((i, n, start // 10 + 1))
        start += n
    for width in (2, 1 << 16):
        assert rows(B.assign_blocks(reads, 10, width=width)) == expected


def test_blocks_by_bases_of_text_ids(spark):
    lengths = {f"r{i}": 3 + i % 7 for i in range(60)}
    before, expected = 0, {}
    for name in sorted(lengths):
        expected[name] = before // 20 + 1
        before += lengths[name]
    reads = spark.createDataFrame(list(lengths.items()), "id string, len bigint").repartition(5)
    assert dict(rows(B.assign_blocks(reads, 20), "id", "block")) == expected


def test_fixed_batches(spark):
    ids = spark.createDataFrame([(i * 3,) for i in range(45)], "block_id bigint")
    got = rows(B.fixed_batches(ids, 20, "block_id", cap=41, width=8))
    assert got == sorted([(i * 3, i // 20) for i in range(41)], key=repr)


@pytest.fixture(scope="module")
def log(spark):
    lines = [
        ("f1", 1, "[t] Starting job(s) 1 2: 5 vs 6 7"),
        ("f1", 2, "[t] Finished job(s) 1 2: 5 vs 6 7"),
        ("f1", 3, "[t] Starting job(s) 3: 5 vs 6"),
        ("f1", 4, "slurmstepd: error: *** JOB 1 CANCELLED ***"),
        ("f1", 5, "[t] Starting job(s) 4: 5 vs 6"),
        ("f2", 1, "slurmstepd: error: *** before any start"),
        ("f2", 2, "[t] Starting job(s) 5 6: 5 vs 6"),
        ("f2", 3, "[t] Failed job(s) 5 6: 5 vs 6"),
        ("f2", 4, "[t] Finished job(s) 6: 5 vs 6"),
        ("f2", 5, "text slurmstepd: error: *** not at the start"),
    ]
    return spark.createDataFrame(lines, "file string, line_no bigint, line string").repartition(3)


def test_fold(spark, log):
    requested = spark.createDataFrame([(i,) for i in range(1, 9)], "rowid bigint")
    got = dict(rows(S.fold_status(requested, log)))
    assert got == {1: "COMPLETED", 2: "COMPLETED", 3: "FAILED", 4: "RUNNING", 5: "FAILED", 6: "COMPLETED", 7: "RESERVED", 8: "RESERVED"}
    only = dict(rows(S.fold_status(requested.limit(0), log)))
    assert only == {}


@pytest.mark.parametrize("width", [None, 1, 2, ordered.AUTO])
def test_failures(log, width):
    assert rows(S.attribute_failures(log, width=width)) == [(3, "f1", 4)]


def test_tokens(spark, log):
    named = log.withColumn("file", F.concat(F.lit("array_ab12_"), F.substring("file", 2, 1), F.lit("_88_1.log")))
    tokens = spark.createDataFrame([("ab12_1",), (None,), ("zz",)], "token string")
    assert rows(S.with_known_token(named, tokens).select("file").distinct()) == [("array_ab12_1_88_1.log",)]


def test_active_and_lookup(spark):
    data = [(1, "RUNNING", "a", "7"), (2, "RESERVED", "a", None), (3, "PENDING", "b", None), (4, "COMPLETED", "c", "9")]
    work = spark.createDataFrame(data, "rowid bigint, status string, reservation_token string, jobid string")
    assert S.active_tokens(work).first()[0] == 2
    ids = spark.createDataFrame([(4,), (4,), (9,)], "rowid bigint")
    assert rows(S.lookup_by_ids(work, ids)) == [(4, "9")]


def test_project_summary(spark, block_ids, plan):
    project = spark.createDataFrame([("p", 30)], "name string, coverage int")
    got = S.project_summary(project, block_ids, with_status(plan, F.lit("RUNNING"))).first()
    assert (got.name, got.coverage, got.blocks, got.total, got.running) == ("p", 30, N, 125_250, 125_250)


@pytest.fixture(scope="module")
def inventory(spark):
    at = datetime.datetime
    files = [
        ("/d/p.1.las", 10, at(2020, 1, 1)),
        ("/d/p.2.las", 0, at(2020, 1, 1)),
        ("/d/p.30.las", 5, at(2020, 1, 1, 11, 58)),
        ("/d/.p.1.q.a2", 5, at(2020, 1, 1)),
        ("/d/.p.1.q.d2", 5, at(2020, 1, 1)),
        ("/d/.p.2.q.a2", 0, at(2020, 1, 1)),
        ("/d/p.4.q30_trim.las", 5, at(2020, 1, 1)),
    ]
    return spark.createDataFrame(files, "path string, size bigint, mtime timestamp_ntz")


def noon():
    return F.lit("2020-01-01 12:00:00").cast("timestamp_ntz")


def test_stages(spark, inventory):
    ids = spark.createDataFrame([(1,), (2,), (30,)], "block_id bigint")
    done = spark.createDataFrame([(2,)], "block_id bigint")
    stages = {"merged": r"^p\.([0-9]+)\.las$", "quality": r"^\.p\.([0-9]+)\.q\.a2$"}
    matrix = C.stage_matrix(ids, done, inventory, stages, noon())
    assert rows(matrix) == [(1, False, True, True), (2, True, False, False), (30, False, False, False)]
    assert rows(C.stage_totals(matrix)) == [(1, 1, 1)]
    assert rows(C.quiescent_files(inventory, stages["merged"], noon())) == [(1,)]
    assert rows(C.missing_artifacts(ids, inventory, "p", ("q",))) == [(2, "q", "a2"), (2, "q", "d2"), (30, "q", "a2"), (30, "q", "d2")]


def test_sets_and_keys(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (3,)], "block_id bigint")
    right = spark.createDataFrame([(2,), (2,)], "block_id bigint")
    assert rows(C.remaining(left, right)) == [(1,), (3,)]
    assert rows(C.in_both(left, right)) == [(2,)]
    work = spark.createDataFrame([(1, 1, True), (1, 1, False), (1, 9, False)], "block_id1 bigint, block_id2 bigint, use_masking boolean")
    assert dict(rows(C.key_checks(work, left))) == {
        "duplicate_pairs": 1, "duplicate_blocks": 1, "dangling_block_id1": 0, "dangling_block_id2": 1,
        "blocks": 4, "work_items": 3, "masked_items": 1,
    }


@pytest.mark.parametrize("values, text", [([1], "1"), (range(1, 202), "1-201"), ([5, 1, 2, 3, 3], "1-3,5"), ([-2, -1, 4], "-2--1,4")])
def test_runs(spark, values, text):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for width in (2, ordered.AUTO):
        assert rows(compress_runs(df, "v", width=width)) == [(0, text)]


def test_run_segments(spark):
    df = spark.createDataFrame([("k", v) for v in (1, 2, 4, 6, 8, 9)], "k string, v bigint")
    assert rows(compress_runs(df, "v", ["k"], 2)) == [("k", 0, "1-2,4"), ("k", 1, "6,8-9")]
    assert rows(consecutive_runs(df, "v", ["k"])) == [("k", 1, 2), ("k", 4, 4), ("k", 6, 6), ("k", 8, 9)]


def test_telemetry(spark):
    acct = [
        ("5_1.batch", "77.batch", "n1", "c", "1M", "2M", "00:01", "DONE"),
        ("5_1.batch", "77.batch", "n1", "c", "1M", "2M", "00:02", "DONE"),
        ("5_2.batch", "78.batch", "n1", "c", "1M", "2M", "00:01", "DONE"),
        ("5_3.batch", "79.batch", "n1", "c", "1M", "2M", "00:01", "DONE"),
        ("5_3", "79", "n1", "c", "1M", "2M", "00:01", "DONE"),
        ("53.batch", "80.batch", "n1", "c", "1M", "2M", "00:01", "DONE"),
    ]
    accounting = spark.createDataFrame(acct, schemas.ACCOUNTING)
    records = T.latest_records(T.batch_records(accounting))
    assert rows(records, "job_raw", "array_id", "task_id", "elapsed") == [("77", "5", "1", "00:02"), ("78", "5", "2", "00:01"), ("79", "5", "3", "00:01")]
    assert rows(T.malformed_batch_records(accounting), "job_task", "job_raw") == [("53.batch", "80")]
    sample = [("c", "n1", "77", "t", 1, 1.0, 1.0, 0.0, [1.0, 2.0]), ("c", "n1", "78", "t", 1, 1.0, 1.0, 0.0, [3.0]), ("x", "n1", "79", "t", 1, 1.0, 1.0, 0.0, [])]
    samples = spark.createDataFrame(sample, schemas.SAMPLE)
    attached = T.attach_samples(records, samples)
    assert rows(attached, "job_raw", "jobid") == [("77", "5_1"), ("78", "5_2")]
    assert rows(T.missing_telemetry(records, samples), "job_raw") == [("79",)]
    assert rows(T.core_width_check(attached)) == [("78", 1, 1)]
    assert rows(T.widen_cores(attached), "job_raw", "core1", "core2") == [("77", 1.0, 2.0), ("78", 3.0, None)]


def test_a_line_may_name_very_many_ids(spark):
    ids = " ".join(str(i) for i in range(100_000))
    lines = spark.createDataFrame([(f"Starting job(s) {ids} and more",)], "line string")
    assert S.log_events(lines).distinct().count() == 100_000


def test_a_day_comes_after_23_hours(spark):
    rows_ = [("j", "23:00:00", "early"), ("j", "1-00:00:00", "late"), ("k", None, "only")]
    got = T.latest_records(spark.createDataFrame(rows_, "job_raw string, elapsed string, state string"))
    assert sorted(tuple(r) for r in got.collect()) == [("j", "1-00:00:00", "late"), ("k", None, "only")]


def test_a_project_name_is_no_pattern(spark):
    blocks = spark.createDataFrame([(1,), (2,)], "block_id long")
    for name, other in (("a.b(c", "axb(c"), ("p\\Eq", "pEq")):
        files = spark.createDataFrame([(f"/d/.{name}.1.q.a2", 5), (f"/d/.{other}.2.q.a2", 5)], "path string, size long")
        got = C.missing_artifacts(blocks, files, name, ("q",), ("a2",)).collect()
        assert [tuple(r) for r in got] == [(2, "q", "a2")]
