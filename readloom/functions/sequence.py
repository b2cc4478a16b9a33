"""Per-sequence measures as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T", "N")


def seq_length(seq: Column) -> Column:
    """Bytes in the sequence."""
    return F.octet_length(seq).cast("bigint")


def base_count(seq: Column, base: str) -> Column:
    return (F.octet_length(seq) - F.octet_length(F.replace(seq, F.lit(base), F.lit("")))).cast("bigint")


def base_counts(seq: Column, fold_case: bool = False) -> list[Column]:
    """na, nc, ng, nt, nn. Counts upper case only, unless case is folded first."""
    text = F.upper(seq) if fold_case else seq
    return [base_count(text, base).alias(f"n{base.lower()}") for base in BASES]


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def dna_only(text: Column) -> Column:
    """Keep nucleotide letters, in upper case."""
    return F.upper(F.regexp_replace(text, "[^ACGTNacgtn]+", ""))
