import gzip
import random

import pytest
from pyspark.sql import functions as F

from readloom.functions.headers import parse_headers
from readloom.operators.index import INDEX_COLUMNS, build_index, index_fasta, record_offsets
from readloom.operators.status import fold_status
from readloom.sources import fasta, listing, tables
from tests.conftest import rows


def write(path, text, opener=open):
    with opener(path, "wb") as f:
        f.write(text.encode())
    return str(path)


@pytest.mark.parametrize(
    "text",
    [
        ">a x\nACGT\nACG\n>b\nTT\n",
        ">a x\nACGT\nACG\n>b\nTT",
        ">a x\r\nACGT\r\nACG\r\n>b\r\nTT\r\n",
        ">a x\nACGTACG\n\n>b\n\nTT\n\n",
    ],
)
def test_records(spark, tmp_path, text):
    path = write(tmp_path / "x.fa", text)
    assert rows(fasta.read_fasta(spark, path), "id", "seq") == [("a x", "ACGTACG"), ("b", "TT")]


def test_gzip_empty_and_several_paths(spark, tmp_path):
    paths = [
        write(tmp_path / "a.fa.gz", ">a\nAC\n", gzip.open),
        write(tmp_path / "b.fa", ">b\nGT\n>empty\n"),
        write(tmp_path / "c.fa", ""),
    ]
    assert rows(fasta.read_fasta(spark, paths), "id", "seq") == [("a", "AC"), ("b", "GT"), ("empty", "")]


def test_headers_of_a_fasta_and_of_a_list(spark, tmp_path):
    path = write(tmp_path / "x.txt", ">m/1/0_4 \nACGT\n>m/1/6_9\nAAA\n>bad\n")
    parsed = parse_headers(fasta.read_headers(spark, path))
    assert rows(parsed, "qs", "qe") == [(0, 4), (6, 9)]


def test_wrapping(spark, tmp_path):
    reads = spark.createDataFrame([("a", "A" * 140), ("b", "C" * 141), ("c", "")], "id string, seq string")
    fasta.write_fasta(reads.coalesce(1), str(tmp_path / "o"), width=70)
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("*.txt"))
    assert text == ">a\n" + ("A" * 70 + "\n") * 2 + ">b\n" + ("C" * 70 + "\n") * 2 + "C\n>c\n\n"
    assert rows(fasta.read_fasta(spark, str(tmp_path / "o")), "id", "seq") == rows(reads)


def test_offsets_over_many_splits(spark, tmp_path):
    rng = random.Random(3)
    whole = [(f"r{i}", "".join(rng.choices("ACGTN", k=rng.randint(1, 400)))) for i in range(800)]
    expected, at, text = {}, 0, ""
    for name, seq in whole:
        expected[name] = at
        record = f">{name}\n{seq[:50]}\n{seq[50:]}\n" if len(seq) > 50 else f">{name}\n{seq}\n"
        text, at = text + record, at + len(record)
    path = write(tmp_path / "x.fa", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert fasta.read_fasta(spark, path, key=True).select("split_start").distinct().count() > 1
        found = fasta.read_fasta_offsets(spark, path)
        assert {r.id: r.offset for r in found.collect()} == expected
        assert {r.id: r.seq for r in found.collect()} == dict(whole)
        index = build_index(found).collect()
        assert rows(index_fasta(spark, path), *INDEX_COLUMNS) == sorted(map(tuple, index), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.len, r.offset) for r in index] == sorted((len(s), expected[n]) for n, s in whole)
    by_id = dict(whole)
    assert all((r.na, r.nc, r.ng, r.nt, r.nn) == tuple(by_id[r.id].count(b) for b in "ACGTN") for r in index)


def test_offsets_of_written_reads(spark, tmp_path):
    reads = spark.createDataFrame([(i, "ACGT" * i) for i in range(1, 120)], "id bigint, seq string")
    fasta.write_fasta(reads.coalesce(1).sortWithinPartitions("id"), str(tmp_path / "o"))
    [part] = (tmp_path / "o").glob("*.txt")
    on_disk = {int(r.id): r.offset for r in fasta.read_fasta_offsets(spark, str(part)).collect()}
    for width in (8, 1 << 16):
        assert {r.id: r.offset for r in record_offsets(reads, width=width).collect()} == on_disk


def test_alignments(spark, tmp_path):
    (tmp_path / "d").mkdir()
    fields = ["r1", "4", "*", "0", "0", "*", "*", "0", "0", "ACGT", "!!!!"]
    write(tmp_path / "d" / "x.sam", "@HD\tVN:1.6\n" + "\t".join(fields) + "\tRG:Z:1\n")
    write(tmp_path / "y.sam", "\t".join(["r2", *fields[1:]]) + "\n")
    write(tmp_path / "z.txt", "not\tan alignment")
    assert rows(tables.read_alignments(spark, str(tmp_path))) == [("r1", "ACGT"), ("r2", "ACGT")]


def test_accounting_and_telemetry(spark, tmp_path):
    path = write(tmp_path / "acct.tsv", "5_1.batch\t77.batch\tn1\tc1\t1M\t2M\t00:01\tCOMPLETED\n")
    assert rows(tables.read_accounting(spark, path))[0][:2] == ("5_1.batch", "77.batch")
    (tmp_path / "c1" / "stats" / "n1").mkdir(parents=True)
    write(tmp_path / "c1" / "stats" / "n1" / "77", "LOCALTIME TIME LIMIT USED SWAP CORES\n10:00 100 128.0 1.5 0.0 90 80.5\n")
    got = tables.read_telemetry(spark, str(tmp_path / "c1")).collect()
    assert [tuple(r) for r in got] == [("c1", "n1", "77", "10:00", 100, 128.0, 1.5, 0.0, [90.0, 80.5])]


def test_inventory_reads_no_content(spark, tmp_path):
    write(tmp_path / "a.las", "12345")
    write(tmp_path / "b.las", "")
    write(tmp_path / "c.txt", "x")
    listing = tables.file_inventory(spark, str(tmp_path), "*.las", empty=False)
    assert rows(listing.select(F.substring_index("path", "/", -1), "size")) == [("a.las", 5)]
    assert "content:binary" not in listing._jdf.queryExecution().executedPlan().toString()


def test_inventory_with_empty_and_hidden_files(spark, tmp_path):
    (tmp_path / "d 1" / "deep").mkdir(parents=True)
    (tmp_path / "none").mkdir()
    sizes = {"a.las": 5, ".b.las": 0, "c.txt": 1, "d 1/e.las": 0, "d 1/deep/f.las": 3}
    for name, size in sizes.items():
        write(tmp_path / name, "x" * size)
    for directory in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        listing = tables.file_inventory(spark, directory)
        assert rows(listing.select("path", "size")) == sorted((f"file:{tmp_path}/{n}", s) for n, s in sizes.items())
    listing = tables.file_inventory(spark, str(tmp_path), "*.las")
    assert rows(listing.select(F.substring_index("path", "/", -1), "size")) == [(".b.las", 0), ("a.las", 5), ("e.las", 0), ("f.las", 3)]
    assert listing.rdd.getNumPartitions() == 3  # the top and two folders
    # times and names agree with Spark's own listing
    own = tables.file_inventory(spark, str(tmp_path), empty=False)
    assert own.exceptAll(tables.file_inventory(spark, str(tmp_path))).count() == 0
    with pytest.raises(Exception, match="missing"):
        tables.file_inventory(spark, str(tmp_path / "missing")).count()


def test_listing_in_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "BATCH", 2)
    (tmp_path / "d").mkdir()
    for i in range(7):
        write(tmp_path / "d" / f"{i}.txt", "")
    reader = listing.ListingReader(str(tmp_path), "*")
    batches = [b.num_rows for part in reader.partitions() for b in reader.read(part)]
    assert batches == [2, 2, 2, 1]


def test_tsv(spark, tmp_path):
    tables.write_tsv(spark.createDataFrame([(1, "x")], "a int, b string").coalesce(1), str(tmp_path / "t"))
    assert [p.read_text() for p in (tmp_path / "t").glob("*.csv")] == ["a\tb\n1\tx\n"]


def test_status_from_split_log_files(spark, tmp_path):
    filler = "noise\n" * 3000
    log = f"Starting job(s) 1 2: x\n{filler}slurmstepd: error: *** gone\nStarting job(s) 3: x\n{filler}Finished job(s) 3: x\n"
    write(tmp_path / "array_ab_1_9_1.log", log)
    requested = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "rowid bigint")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = tables.read_task_logs(spark, str(tmp_path))
        assert lines.select("split_start").distinct().count() > 3
        got = rows(fold_status(requested, lines, "split_row", "split_start"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(1, "FAILED"), (2, "FAILED"), (3, "COMPLETED"), (4, "RESERVED")]
