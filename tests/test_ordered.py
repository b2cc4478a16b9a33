import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import ordered
from readloom.operators.ordered import Running, choose_width, with_preceding, with_rank, with_running_sum
from tests.conftest import rows


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    out = []
    for key in range(4):
        # key 0 holds far more rows than the others
        for pos in sorted(rng.sample(range(-300, 300), 250 if key == 0 else 12)):
            out.append((key, pos, rng.randint(-5, 9), rng.choice([None, rng.randint(0, 99)])))
    rng.shuffle(out)
    return spark.createDataFrame(out, "k int, pos bigint, v bigint, mark bigint").repartition(5)


def folds():
    return [
        Running("s", "sum", F.col("v")),
        Running("m", "max", F.col("v")),
        Running("l", "last", F.col("mark")),
        Running("prev", "last", F.struct("pos", "v")),
    ]


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 16])
def test_chunked_equals_plain(data, width):
    plain = with_preceding(data, folds(), ["k"], ["pos"], None)
    assert rows(with_preceding(data, folds(), ["k"], ["pos"], width)) == rows(plain)


def test_without_keys(data):
    distinct = data.select("pos").distinct()
    ranked = with_rank(distinct, "r", [], ["pos"], 16)
    expected = [(p, i + 1) for i, p in enumerate(sorted(r.pos for r in distinct.collect()))]
    assert sorted((r.pos, r.r) for r in ranked.collect()) == expected


def test_running_sum_is_inclusive(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "id bigint, n bigint")
    got = rows(with_running_sum(df, "c", F.col("n"), [], ["id"], 3), "id", "c")
    assert got == [(i, sum(range(i + 1))) for i in range(10)]


def test_second_scan_shares_the_shuffle(data):
    chunked = data.withColumn(ordered.CHUNK, ordered.chunk_of("pos", 16))
    once = with_preceding(chunked, folds()[:1], ["k"], ["pos"])
    twice = with_preceding(once, folds()[1:2], ["k"], ["pos"])
    plain = with_preceding(data, folds()[:2], ["k"], ["pos"], None)
    assert rows(twice, "k", "pos", "s", "m") == rows(plain, "k", "pos", "s", "m")


def test_width_is_chosen_by_the_largest_key(data, monkeypatch):
    assert choose_width(data, ["k"]) is None
    monkeypatch.setattr(ordered, "TASK_ROWS", 100)
    assert choose_width(data, ["k"]) == ordered.DEFAULT_WIDTH
    assert choose_width(data, ["k"], 5) == 5


def test_empty(spark, data):
    none = data.limit(0)
    assert choose_width(none, ["k"]) is None
    assert rows(with_preceding(none, folds(), ["k"], ["pos"], 8)) == []
