import pytest

from readloom.functions.headers import parse_headers, rejected_headers
from tests.conftest import rows


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "line string")


def test_valid(spark):
    assert rows(parse_headers(lines(spark, ">smrt1/1234/0_123452")), "cell", "hole", "qs", "qe") == [("smrt1", 1234, 0, 123452)]


def test_text_after_the_match_is_allowed(spark):
    assert parse_headers(lines(spark, ">m/1/2_3 RQ=0.8", ">m/1/2_3/x")).count() == 2


@pytest.mark.parametrize(
    "line",
    [
        ">smrt1_hole1234/0-12345",
        ">smrt1_hole1234/0_12345",
        ">smrt1_hole//1234/0_12345",
        ">m/99999999999999999999/0_1",
        ">",
    ],
)
def test_invalid(spark, line):
    df = lines(spark, line)
    assert parse_headers(df).count() == 0
    assert rows(rejected_headers(df)) == [(line,)]


def test_sequence_lines_are_neither(spark):
    df = lines(spark, "ACGT")
    assert parse_headers(df).count() == rejected_headers(df).count() == 0
