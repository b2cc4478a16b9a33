"""Read headers of the form ``>cell/hole/start_end``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the header layout. Digits are ASCII; text after the match is allowed.
HEADER_PATTERN = r"^>([^/]+)/([0-9]+)/([0-9]+)_([0-9]+)"


def header_fields(line: Column) -> list[Column]:
    """cell, hole, qs, qe; a number beyond 64 bits becomes null."""
    def number(group: int) -> Column:
        return F.regexp_extract(line, HEADER_PATTERN, group).try_cast("bigint")

    return [
        F.regexp_extract(line, HEADER_PATTERN, 1).alias("cell"),
        number(2).alias("hole"),
        number(3).alias("qs"),
        number(4).alias("qe"),
    ]


def is_header(line: Column) -> Column:
    """True for a line that parses, numbers included."""
    _, hole, qs, qe = header_fields(line)
    return line.rlike(HEADER_PATTERN) & hole.isNotNull() & qs.isNotNull() & qe.isNotNull()


def parse_headers(df: DataFrame, line: str = "line") -> DataFrame:
    """Rows with a valid header, plus cell, hole, qs, qe."""
    trimmed = F.trim(F.col(line))
    return df.filter(is_header(trimmed)).select("*", *header_fields(trimmed))


def rejected_headers(df: DataFrame, line: str = "line") -> DataFrame:
    """Header rows that do not parse."""
    trimmed = F.trim(F.col(line))
    return df.filter(F.startswith(F.col(line), F.lit(">")) & ~F.coalesce(is_header(trimmed), F.lit(False)))
