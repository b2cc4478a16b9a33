import random
import re

import pytest

from readloom import schemas
from readloom.operators import ordered
from readloom.operators import overlaps as O
from readloom.sources.clustered import clustered
from tests.conftest import rows

BUCKETS = 5


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    data = []
    for _ in range(500):
        a, ab, n, bb = rng.choice([0, 0, 0, 1, 2, 3, 4, 9]), rng.randint(0, 1500), rng.randint(50, 600), rng.randint(0, 1500)
        data.append((a, rng.randint(0, 3), rng.choice("+-"), ab, ab + n, bb, bb + n, 2200, 2200, rng.randint(0, n // 2), a))
    overlap = spark.createDataFrame(data, schemas.OVERLAP).repartition(3)
    trim = spark.createDataFrame([(a, "trim", 20 * a, 1500 + 20 * a) for a in range(10)], schemas.TRACK)
    return overlap, trim, clustered(overlap, "a", ("a", "ab"), BUCKETS), clustered(trim, "read_id", buckets=BUCKETS)


STEPS = {
    "stitch": lambda o, t: O.stitch(o, 40, width=None),
    "repeat_track": lambda o, t: O.repeat_track(o, 3),
    "quality_trim": lambda o, t: O.quality_trim(o, threshold=20),
    "remove_gaps": lambda o, t: O.remove_gaps(o, t, 10),
}


@pytest.mark.parametrize("step", STEPS)
def test_steps_on_the_key_shuffle_nothing(spark, tables, step):
    overlap, trim, laid_overlap, laid_trim = tables
    bar = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # joins of tables too large to broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, laid = STEPS[step](overlap, trim), STEPS[step](laid_overlap, laid_trim)
        exchange = lambda df: re.findall(r"Exchange [^\n]*", df._jdf.queryExecution().executedPlan().toString())
        assert exchange(plain) and not exchange(laid)
        assert rows(laid) == rows(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bar)


def test_one_file_per_bucket_and_nothing_lost(spark, tables):
    overlap, _, laid, _ = tables
    assert rows(laid) == rows(overlap)
    assert len(laid.inputFiles()) <= BUCKETS


def test_a_hot_key_is_not_put_into_one_bucket(spark, tables, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 100)
    overlap = tables[0]
    laid = clustered(overlap, "a")
    assert rows(laid) == rows(overlap)
    assert "Bucketed: true" not in laid._jdf.queryExecution().executedPlan().toString()


def test_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (None, 3)], "k bigint, v int")
    assert rows(clustered(df, "k")) == rows(df)
    assert clustered(df.limit(0), "k").collect() == []
