"""FASTA records in pieces, for records longer than a row can be.

A file is cut into byte ranges, which are rows of a table. A first pass over them says what each
range begins and ends with; a window over these narrow rows tells every range which record
it starts inside of and how much of it lies before; a second pass then gives finished pieces. No
sequence is shuffled, and no task holds more than a few blocks and pieces. Files are read twice.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator, Sequence
from dataclasses import astuple, dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.ordered import Running, choose_width, with_preceding
from readloom.sources.listing import opened

RANGE_BYTES = 128 << 20
PIECE_LETTERS = 1 << 20
BLOCK = 1 << 20
#: Longest header line; a longer one raises.
HEADER_BYTES = 1 << 16
#: Letters, and pieces, in one batch.
BATCH_LETTERS = 8 << 20
BATCH_PIECES = 10_000
MAX_TASKS = 20_000

RANGE = "source_file string, split bigint, start bigint, stop bigint"
SUMMARY = (
    f"{RANGE}, lead_letters bigint, lead_pieces bigint, last_start bigint, last_id string, "
    "tail_letters bigint, tail_pieces bigint"
)
PIECES = "id string, source_file string, record_start bigint, piece bigint, offset bigint, seq string, following string"


@dataclass
class Piece:
    """Part of a record as its range sees it; ``start`` is None if the record begins before the range."""

    start: int | None
    id: str | None
    number: int
    offset: int
    text: str
    following: str


class Scan:
    """Pieces of the letters in bytes [start, stop) of a file; stop=None reads to the end.

    A header line belongs to the range that its first byte lies in, a letter of several bytes likewise.
    """

    def __init__(self, file: Any, start: int, stop: int | None, letters: int, overlap: int) -> None:
        self.file, self.start, self.stop = file, start, stop
        self.letters, self.overlap = letters, overlap
        self.line_start = True
        self._begin(None, None)

    def _begin(self, record: int | None, name: str | None) -> None:
        self.record, self.name, self.number, self.offset = record, name, 0, 0
        self.held = ""
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def pieces(self) -> Iterator[Piece]:
        at, data, i = self._settle()
        while self.stop is None or at + i < self.stop:
            if i >= len(data):
                at, data, i = at + len(data), self.file.read(BLOCK), i - len(data)
                if not data:
                    break
            last = len(data) if self.stop is None else min(len(data), self.stop - at)
            if self.line_start and data[i : i + 1] == b">":
                yield from self._finish("")
                data, end = self._line(data, i)
                self._begin(at + i, data[i + 1 : end].removesuffix(b"\r").decode("utf-8", "replace"))
                i = min(end + 1, len(data))
                continue
            end = data.find(b"\n>", i, last)
            part = data[i : last if end < 0 else end + 1]
            self.line_start = part.endswith(b"\n")
            self.held += self.decoder.decode(part.translate(None, b"\r\n"))
            i += len(part)
            yield from self._cut()
        yield from self._finish(self._behind(data[i:]) if self.stop is not None else "")

    def _settle(self) -> tuple[int, bytes, int]:
        """Place and bytes read first, and where in them this range's own begin."""
        if self.start == 0:
            return 0, b"", 0
        back = max(0, self.start - HEADER_BYTES)
        self.file.seek(back)
        before = self.file.read(self.start - back)
        newline = before.rfind(b"\n")
        self.line_start = newline == len(before) - 1
        if self.line_start:
            return self.start, b"", 0
        # a line whose begin is not in sight is longer than any header, so it is sequence
        in_sight = newline >= 0 or back == 0
        if in_sight and before[newline + 1 : newline + 2] == b">":
            data, end = self._line(b"", 0)
            self.line_start = True
            return self.start, data, min(end + 1, len(data))
        data = self.file.read(BLOCK)
        return self.start, data, _continued(data)

    def _line(self, data: bytes, i: int) -> tuple[bytes, int]:
        """``data`` read on until the line at ``i`` ends in it, and that end."""
        while (end := data.find(b"\n", i)) < 0:
            more = self.file.read(4096) if len(data) - i <= HEADER_BYTES else b""
            if not more:
                end = len(data)
                break
            data += more
        if end - i > HEADER_BYTES:
            raise ValueError(f"a header line is longer than {HEADER_BYTES} bytes")
        return data, end

    def _cut(self) -> Iterator[Piece]:
        """Whole pieces of what is held, while the letters that follow them are held as well."""
        at = 0
        while len(self.held) - at > self.letters + self.overlap:
            end = at + self.letters
            yield self._piece(self.held[at:end], self.held[end : end + self.overlap])
            at = end
        self.held = self.held[at:]

    def _finish(self, behind: str) -> Iterator[Piece]:
        """The rest of the record; ``behind`` are letters of it that lie after the range."""
        whole = self.held + self.decoder.decode(b"", True)
        at = 0
        while at < len(whole) or (self.record is not None and self.number == 0):
            end = min(len(whole), at + self.letters)
            yield self._piece(whole[at:end], (whole[end : end + self.overlap] + behind)[: self.overlap])
            at = end

    def _piece(self, text: str, following: str) -> Piece:
        made = Piece(self.record, self.name, self.number, self.offset, text, following)
        self.number += 1
        self.offset += len(text)
        return made

    def _behind(self, data: bytes) -> str:
        """Finish a letter that the range's end cuts, and read the letters after it; ``data`` is read already."""
        data = data if len(data) >= 4 else data + self.file.read(4096)
        if not self.line_start:
            n = _continued(data)
            self.held += self.decoder.decode(data[:n])
            data = data[n:]
        text = b""
        line_start = self.line_start
        while data and len(text) < 4 * self.overlap:
            if line_start and data.startswith(b">"):
                break
            if data.endswith(b"\n"):
                data += self.file.read(4096)
            end = data.find(b"\n>")
            text += (data if end < 0 else data[:end]).translate(None, b"\r\n")
            if end >= 0:
                break
            line_start, data = data.endswith(b"\n"), self.file.read(4096)
        return text.decode("utf-8", "replace")[: self.overlap]


def _continued(data: bytes) -> int:
    """How many bytes at the front belong to a letter that began before them."""
    n = 0
    while n < min(3, len(data)) and data[n] & 0xC0 == 0x80:
        n += 1
    return n


def _scan(row: dict[str, Any], letters: int, overlap: int) -> Iterator[Piece]:
    system, path, _ = opened(row["source_file"])
    # a compressed file is one range, read as a stream
    whole = row["stop"] is None
    with system.open_input_stream(path) if whole else system.open_input_file(path) as file:
        yield from Scan(file, row["start"], row["stop"], letters, overlap).pieces()


def _summary(row: dict[str, Any], letters: int) -> tuple[Any, ...]:
    lead = tail = (0, 0)
    last: tuple[int | None, str | None] = (None, None)
    for piece in _scan(row, letters, 0):
        done = (piece.offset + len(piece.text), piece.number + 1)
        if piece.start is None:
            lead = done
        else:
            last, tail = (piece.start, piece.id), done
    return (row["source_file"], row["split"], row["start"], row["stop"], *lead, *last, *tail)


Batches = Iterator[pa.RecordBatch]


def _summarise(letters: int) -> Callable[[Batches], Batches]:
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), *[pa.int64()] * 2]
    names = [field.split()[0] for field in SUMMARY.split(", ")]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                values = zip(_summary(row, letters), kinds, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], names)

    return run


def _finished(letters: int, overlap: int) -> Callable[[Batches], Batches]:
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 3, pa.string(), pa.string()]
    names = [field.split()[0] for field in PIECES.split(", ")]

    def packed(rows: list[tuple[Any, ...]]) -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), kinds, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                for piece in _scan(row, letters, overlap):
                    start, name, number, offset, text, following = astuple(piece)
                    if start is None:
                        start, name = row["from_start"], row["from_id"]
                        number, offset = number + row["from_piece"], offset + row["from_offset"]
                    rows.append((name, row["source_file"], start, number, offset, text, following))
                    held += len(text)
                    if held >= BATCH_LETTERS or len(rows) >= BATCH_PIECES:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    return run


def file_ranges(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(source_file, split, start, stop): byte ranges of plain files; a gzip file is one range without a stop."""
    if range_bytes < 16:
        raise ValueError("a range has 16 bytes or more")
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    zipped = F.endswith("path", F.lit(".gz"))
    step = F.lit(range_bytes).cast("bigint")
    starts = F.when(zipped, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, step))
    return (
        files.filter("length > 0")
        .select(F.col("path").alias("source_file"), "length", zipped.alias("_zipped"), F.posexplode(starts).alias("split", "start"))
        .select(
            "source_file",
            F.col("split").cast("bigint").alias("split"),
            "start",
            F.when(~F.col("_zipped"), F.least(F.col("start") + step, "length")).alias("stop"),
        )
    )


def read_record_pieces(
    spark: SparkSession,
    paths: str | Sequence[str],
    letters: int = PIECE_LETTERS,
    overlap: int = 0,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """(id, source_file, record_start, piece, offset, seq, following): every record in pieces of at most ``letters``.

    (source_file, record_start) names a record, so equal ids stay apart; record_start is the byte
    place of its header. Pieces count from 0, ``offset`` is the number of the record's letters before one, and
    ``following`` has up to ``overlap`` letters that come after it, so runs of letters across a border can be
    seen. Pieces end at the borders of ranges too, so they may be short, and a record whose header ends a range
    begins with an empty piece. A record without letters is one empty piece. Letters before a
    file's first header have a null id and record_start. Empty files give no rows.
    """
    ranges = file_ranges(spark, paths, range_bytes)
    tasks = max(1, min(ranges.count(), MAX_TASKS))
    seen = ranges.repartition(tasks, "source_file", "split").mapInArrow(_summarise(letters), SUMMARY)
    width = choose_width(ranges, ["source_file"])
    grown = [
        Running("_letters", "sum", F.col("lead_letters") + F.col("tail_letters")),
        Running("_pieces", "sum", F.col("lead_pieces") + F.col("tail_pieces")),
    ]
    counted = with_preceding(seen, grown, ["source_file"], ["split"], width)
    # the last record that begins in a range, and the counts up to its begin
    begun = F.struct(
        F.col("last_start").alias("start"),
        F.col("last_id").alias("id"),
        (F.col("_letters") + F.col("lead_letters")).alias("letters"),
        (F.col("_pieces") + F.col("lead_pieces")).alias("pieces"),
    )
    marked = counted.withColumn("_begun", F.when(F.col("last_start").isNotNull(), begun))
    carried = with_preceding(marked, [Running("_from", "last", F.col("_begun"))], ["source_file"], ["split"], width)
    zero = F.lit(0).cast("bigint")
    planned = carried.select(
        *(field.split()[0] for field in RANGE.split(", ")),
        F.col("_from.start").alias("from_start"),
        F.col("_from.id").alias("from_id"),
        (F.col("_pieces") - F.coalesce("_from.pieces", zero)).alias("from_piece"),
        (F.col("_letters") - F.coalesce("_from.letters", zero)).alias("from_offset"),
    )
    return planned.repartition(tasks, "source_file", "split").mapInArrow(_finished(letters, overlap), PIECES)
