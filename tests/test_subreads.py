import random

import pytest

from readloom.functions.headers import parse_headers
from readloom.operators import subreads as ss
from tests.conftest import rows

HEADERS = [
    ">smrt_1/1/0_100", ">smrt_1/1/120_200", ">smrt_1/2/0_100",
    ">smrt_1/2/50_200", ">smrt_2/1/50_200", ">smrt_2/1/150_300",
]


@pytest.fixture(scope="module")
def six(spark):
    lines = spark.createDataFrame([(h,) for h in reversed(HEADERS)], "line string")
    return parse_headers(lines).drop("line")


def test_six_headers(six):
    assert rows(ss.well_summary(six)) == [(3, 2)]
    assert rows(ss.reads_per_well_histogram(six)) == [(2, 3)]
    assert rows(ss.gap_histogram(six)) == [(0, 3)]
    assert rows(ss.gap_histogram(six, mode="reference")) == [(0, 2)]


@pytest.mark.parametrize(
    "a, b, distance, overlap", [((0, 100), (50, 150), 0, True), ((0, 100), (101, 150), 1, False), ((0, 100), (100, 150), 0, True)]
)
def test_pair(spark, a, b, distance, overlap):
    df = spark.createDataFrame([("m", 1, *a), ("m", 1, *b)], "cell string, hole bigint, qs bigint, qe bigint")
    for mode in ("reference", "strict"):
        assert rows(ss.adjacent_pairs(df, mode), "distance", "overlaps", "pairs") == [(distance, overlap, 1)]


def test_other_wells_are_no_neighbours(spark):
    data = [("m1", 1, 0, 100), ("m1", 2, 50, 150), ("m2", 1, 50, 150)]
    df = spark.createDataFrame(data, "cell string, hole bigint, qs bigint, qe bigint")
    assert rows(ss.adjacent_pairs(df)) == []
    assert rows(ss.well_summary(df)) == [(0, 0)]
    assert rows(ss.well_summary(df.limit(0))) == [(0, 0)]
    assert rows(ss.reads_per_well_histogram(df.limit(0))) == []


@pytest.mark.parametrize("width", [None, 10, 200])
def test_crowded_well_and_copies(spark, width):
    rng = random.Random(2)
    data = [("hot", 1, s, s + rng.randint(0, 30)) for s in rng.choices(range(2000), k=300)] + [("hot", 1, 77, 80)] * 50
    data += [("m", h, s, s + 10) for h in range(20) for s in rng.choices(range(400), k=3)]
    df = spark.createDataFrame(data, "cell string, hole bigint, qs bigint, qe bigint").repartition(7)
    wells = {}
    for cell, hole, qs, qe in data:
        wells.setdefault((cell, hole), []).append((qs, qe))
    bins, overlapping = {}, 0
    for spans in wells.values():
        spans.sort()
        pairs = list(zip(spans, spans[1:]))
        overlapping += any(a[1] >= b[0] for a, b in pairs)
        for a, b in pairs:
            start = max(0, b[0] - a[1]) // 25 * 25
            bins[start] = bins.get(start, 0) + 1
    assert {r.bin_start: r.n_pairs for r in ss.gap_histogram(df, 25, width=width).collect()} == bins
    assert rows(ss.well_summary(df, width=width)) == [(len(wells), overlapping)]
