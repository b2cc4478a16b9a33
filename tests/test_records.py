import gzip
import random

import pytest
from pyspark.sql import functions as F

from readloom.operators.index import measure_records
from readloom.operators import sketch
from readloom.operators.sketch import SketchOptions, minhash_sketch, sketch_pieces
from readloom.sources import fasta, records
from tests.conftest import rows

OPTIONS = SketchOptions(k=5, n=12)


@pytest.fixture(autouse=True)
def few_tasks(monkeypatch):
    monkeypatch.setattr(records, "MAX_TASKS", 4)


def fasta_text(rng, n, break_line="\n", letters="ACGT", most=200):
    """Random records with lines of random width, blank lines, equal names and records without letters."""
    whole, text = [], ""
    for i in range(n):
        seq = "".join(rng.choices(letters, k=rng.choice([0, 1, 3, rng.randint(0, most), most])))
        name = f"r{i % 5} >x{'y' * rng.randint(0, 60)}"
        width = rng.choice([1, 7, 60, most + 1])
        lines = [seq[j : j + width] for j in range(0, len(seq), width)]
        if rng.random() < 0.2:
            lines.append("")
        whole.append((len(text.encode()), name, seq))
        text += break_line.join([f">{name}", *lines, ""])
    return whole, text.removesuffix(break_line) if rng.random() < 0.5 else text


def joined(pieces):
    """{(record start, id): letters}, where pieces must follow one another."""
    found = {}
    for p in sorted(pieces, key=lambda p: (p.record_start, p.piece)):
        seq, n = found.get((p.record_start, p.id), ("", 0))
        assert p.offset == len(seq) and p.piece == n
        found[p.record_start, p.id] = (seq + p.seq, n + 1)
    return {key: seq for key, (seq, _) in found.items()}


@pytest.mark.parametrize("case", range(6))
def test_pieces_over_any_ranges(spark, tmp_path, case):
    rng = random.Random(case)
    break_line, alphabet = ("\n", "ACGT") if case % 3 else ("\r\n", "ACGé€😀>")
    whole, text = fasta_text(rng, 25, break_line, alphabet)
    path = tmp_path / "x.fa"
    path.write_bytes(text.encode())
    expected = {(start, name): seq for start, name, seq in whole}
    # '>' at the front of a line of letters begins a record, so such texts are read without brute force
    if alphabet != "ACGT":
        expected = {}
        for record in ("\n" + text.replace("\r", "")).split("\n>")[1:]:
            name, _, body = record.partition("\n")
            expected.setdefault(name, []).append(body.replace("\n", ""))
    for range_bytes, letters, overlap in ((16, 5, 4), (37, 1000, 3), (250, 1, 0), (1 << 20, 64, 9)):
        found = joined(records.read_record_pieces(spark, str(path), letters, overlap, range_bytes).collect())
        if alphabet == "ACGT":
            assert found == expected
        else:
            names = {}
            for (_, name), seq in sorted(found.items()):
                names.setdefault(name, []).append(seq)
            assert names == expected


def test_following_letters(spark, tmp_path):
    rng = random.Random(11)
    whole, text = fasta_text(rng, 30)
    (tmp_path / "x.fa").write_text(text)
    by_start = {start: seq for start, _, seq in whole}
    for range_bytes, overlap in ((16, 6), (64, 30), (999, 4)):
        for p in records.read_record_pieces(spark, str(tmp_path), 9, overlap, range_bytes).collect():
            end = p.offset + len(p.seq)
            assert p.following == by_start[p.record_start][end : end + overlap]


def test_measures_and_sketches_equal_whole_records(spark, tmp_path):
    rng = random.Random(5)
    text = "".join(f">{i}\n{''.join(rng.choices('ACGTN', k=rng.choice([0, 4, 5, 900, 4000])))}\n" for i in range(20))
    (tmp_path / "a.fa").write_text(text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as file:
        file.write(text.replace(">", ">z"))
    (tmp_path / "empty.fa").write_text("")
    reads = fasta.read_fasta(spark, str(tmp_path))
    pieces = records.read_record_pieces(spark, str(tmp_path), 50, OPTIONS.k - 1, 300)
    assert rows(sketch_pieces(pieces, OPTIONS), "id", "h") == rows(minhash_sketch(reads, OPTIONS))
    counts = [F.octet_length("seq").alias("len"), *[F.regexp_count("seq", F.lit(b)).alias(f"n{b}") for b in "ACGTN"]]
    assert rows(measure_records(pieces).drop("source_file", "record_start")) == rows(reads.select("id", *counts))


def test_letters_before_the_first_header_and_long_headers(spark, tmp_path, monkeypatch):
    (tmp_path / "x.fa").write_text("ACGT\nAC\n>a\nGG\n")
    for range_bytes in (16, 1000):
        pieces = records.read_record_pieces(spark, str(tmp_path / "x.fa"), range_bytes=range_bytes)
        assert rows(pieces, "id", "record_start", "offset", "seq") == [("a", 8, 0, "GG"), (None, None, 0, "ACGTAC")]
    (tmp_path / "y.fa").write_text(">" + "x" * (records.HEADER_BYTES + 9) + "\nAC\n")
    with pytest.raises(Exception, match="header line is longer"):
        records.read_record_pieces(spark, str(tmp_path / "y.fa"), range_bytes=1000).collect()


def test_lines_longer_than_a_header_may_be(tmp_path):
    """Ranges deep in one line, whose begin is out of sight, are sequence."""
    rng = random.Random(2)
    seq = "".join(rng.choices("ACGT", k=4 * records.HEADER_BYTES))
    path = tmp_path / "x.fa"
    path.write_text(f">a\n{seq}\n>b\nAC\n")
    size, step, text = path.stat().st_size, 50_001, {}
    for start in range(0, size, step):
        with open(path, "rb") as file:
            for p in records.Scan(file, start, min(size, start + step), 7_000, 0).pieces():
                text.setdefault(p.id, []).append(p.text)
    assert "".join(text["a"] + text[None]) == seq and text["b"] == ["AC"]


def test_no_text_is_shuffled(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a\nACGT\n")
    plan = records.read_record_pieces(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    last = plan.index("MapInArrow")
    assert "Exchange" in plan[last:] and "Exchange" not in plan[:last].replace("AdaptiveSparkPlan", "")


def test_short_pieces_are_hashed_together(spark, tmp_path, monkeypatch):
    """A record in pieces of 100 letters is a few texts, and its sketch that of the whole."""
    rng = random.Random(5)
    seqs = {"a": 3 * sketch.PIECE, "b": 250, "c": 0, "d": 7}
    text = "".join(f">{name}\n" + "".join(rng.choices("ACGT", k=n)) + "\n" for name, n in seqs.items())
    (tmp_path / "x.fa").write_text(text)
    reads = fasta.read_fasta(spark, str(tmp_path / "x.fa"))
    expected = rows(minhash_sketch(reads, OPTIONS))
    for range_bytes in (1 << 30, 90_000):
        pieces = records.read_record_pieces(spark, str(tmp_path / "x.fa"), 100, OPTIONS.k - 1, range_bytes)
        texts = pieces.select("id", "source_file", "record_start", "offset", "seq", "following").mapInArrow(
            sketch._joined, "id string, source_file string, record_start bigint, offset bigint, seq string, following string"
        )
        n = texts.groupBy("id").agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("most")).filter("id = 'a'").first()
        assert n["n"] <= 8 and n["most"] <= sketch.PIECE
        for stretch in (sketch.MERGED_LETTERS, 1_000):
            monkeypatch.setattr(sketch, "MERGED_LETTERS", stretch)
            assert rows(sketch_pieces(pieces, OPTIONS), "id", "h") == expected
