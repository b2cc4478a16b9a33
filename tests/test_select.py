import random

import pytest

from readloom.operators import select
from readloom.operators.select import longest_n, longest_to_coverage
from tests.conftest import rows


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([0, 1, 5, 5, 5, 9, 40])) for i in range(200)]
    return spark.createDataFrame(data, "id bigint, len bigint").repartition(6).persist()


def longest_first(reads):
    return sorted(((r.len, r.id) for r in reads.collect()), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("n", [0, 1, 7, 60, 199, 200, 500])
@pytest.mark.parametrize("top_rows", [0, 10_000])
def test_longest_n(reads, n, top_rows, monkeypatch):
    monkeypatch.setattr(select, "TOP_ROWS", top_rows)
    got = [(r.len, r.id) for r in longest_n(reads, n).collect()]
    expected = longest_first(reads)[:n]
    assert sorted(got) == sorted(expected)
    assert [g[0] for g in got] == sorted(g[0] for g in got)


@pytest.mark.parametrize("target", [0, 1, 40, 41, 500, 1000, 1400, 1480, 2000, 10**9, 10**25])
def test_coverage(reads, target):
    expected, total = [], 0
    for length, i in longest_first(reads):
        expected.append((i, length))
        total += length
        if total >= target:
            break
    assert rows(longest_to_coverage(reads, target, 1)) == sorted(expected, key=repr)


def test_coverage_of_empty_reads(spark):
    zeros = spark.createDataFrame([(1, 0), (2, 0)], "id bigint, len bigint")
    assert rows(longest_to_coverage(zeros, 0, 1)) == [(1, 0)]
    assert rows(longest_to_coverage(zeros, 1, 1)) == [(1, 0), (2, 0)]
    assert rows(longest_to_coverage(zeros.limit(0), 5, 1)) == []



@pytest.mark.parametrize("top_rows", [0, 10_000])
def test_text_ids(spark, reads, top_rows, monkeypatch):
    monkeypatch.setattr(select, "TOP_ROWS", top_rows)
    named = reads.selectExpr("concat('read/', id) AS id", "len")
    order = sorted(((r.len, r.id) for r in named.collect()), key=lambda x: (-x[0], x[1]))
    assert sorted((r.len, r.id) for r in longest_n(named, 60).collect()) == sorted(order[:60])
    got = longest_to_coverage(named, 500, 1).collect()
    assert sorted((r.len, r.id) for r in got) == sorted(order[: len(got)])
    assert sum(r.len for r in got) >= 500 > sum(r.len for r in got) - min(r.len for r in got)
