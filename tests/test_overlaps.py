import random

import pytest
from pyspark.sql import functions as F

from readloom import schemas
from readloom.operators import overlaps as O
from readloom.operators import seeds, sketch
from readloom.operators.intervals import longest_interval, merge_intervals
from readloom.operators import ordered
from tests.conftest import rows


def table(spark, data):
    return spark.createDataFrame(data, schemas.OVERLAP).repartition(3)


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(11)
    data = []
    for _ in range(400):
        a, b = rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([0, 1, 2])
        ab, n, bb = rng.randint(0, 1500), rng.randint(50, 600), rng.randint(0, 1500)
        data.append((a, b, rng.choice("+-"), ab, ab + n, bb, bb + n, 2200, 2200, rng.randint(0, n // 2), a))
    return table(spark, data + data[:30])


def brute_stitch(spans, gap):
    """Spans (ab, ae, bb, be) with their diffs, stitched: diagonals first, then places."""
    bands, chains = [], []
    ranges = {s: sorted((s[0] - s[2], s[1] - s[3])) for s in spans}
    for span in sorted(spans, key=lambda s: ranges[s]):
        if not bands or ranges[span][0] - max(ranges[s][1] for s in bands[-1]) > gap:
            bands.append([])
        bands[-1].append(span)
    for band in bands:
        band.sort()
        for i, span in enumerate(band):
            if not i or span[0] - max(s[1] for s in band[:i]) > gap or span[2] - max(s[3] for s in band[:i]) > gap:
                chains.append([])
            chains[-1].append(span)
    return [(min(s[0] for s in c), max(s[1] for s in c), min(s[2] for s in c), max(s[3] for s in c), sum(spans[s] for s in c)) for c in chains]


@pytest.mark.parametrize("width", [None, 100, ordered.AUTO])
@pytest.mark.parametrize("gap", [0, 40])
def test_stitch(many, gap, width):
    groups = {}
    for r in many.collect():
        spans = groups.setdefault((r.a, r.b, r.strand), {})
        span = (r.ab, r.ae, r.bb, r.be)
        spans[span] = spans.get(span, 0) + r.diffs
    expected = [(*key, *row) for key, spans in groups.items() for row in brute_stitch(spans, gap)]
    got = rows(O.stitch(many, gap, width), "a", "b", "strand", "ab", "ae", "bb", "be", "diffs")
    assert got == sorted(expected, key=repr)


@pytest.mark.parametrize("width", [None, 64])
def test_stitch_nested_and_interleaved(spark, width):
    def span(a, ab, ae, shift):
        return (a, 9, "+", ab, ae, ab + shift, ae + shift, 5000, 5000, 1, 1)

    nested = [span(1, 0, 1000, 50), span(1, 100, 200, 50), span(1, 1010, 1100, 50)]
    interleaved = [span(2, i * 100, i * 100 + 90, 900 * (i % 2)) for i in range(10)]
    # b drifts by 60 over the first overlap; the next one goes on where it ends
    drifting = [(3, 9, "+", 0, 1000, 0, 1060, 5000, 5000, 1, 1), span(3, 1010, 1100, 60)]
    got = rows(O.stitch(spark.createDataFrame(nested + interleaved + drifting, schemas.OVERLAP), 110, width), "a", "ab", "ae", "bb", "diffs")
    assert got == [(1, 0, 1100, 50, 3), (2, 0, 890, 0, 5), (2, 100, 990, 1000, 5), (3, 0, 1100, 0, 2)]


@pytest.mark.parametrize("width", [None, 50])
def test_covered_bases(spark, many, width):
    rng = random.Random(5)
    track = [(r, "x", b, b + rng.randint(1, 90)) for r in (0, 1) for b in (rng.randint(0, 2000) for _ in range(40))]
    inside = {(r, x) for r, _, b, e in track for x in range(b, e)}
    spans = many.select(F.col("a").alias("read_id"), "ab", "ae")
    got = rows(O.covered_bases(spans, spark.createDataFrame(track, schemas.TRACK), width))
    expected = {(r.a, r.ab, r.ae, sum((r.a, x) in inside for x in range(r.ab, r.ae))) for r in many.collect()}
    assert got == sorted(expected, key=repr)


def test_stitch_keeps_distant_places_apart(spark):
    far = [(1, 2, "+", 0, 100, 10_000, 10_100, 300, 20_000, 1, 1), (1, 2, "+", 110, 200, 50, 140, 300, 20_000, 1, 1)]
    near = [(3, 4, "+", 0, 100, 10_000, 10_100, 300, 20_000, 1, 1), (3, 4, "+", 110, 200, 10_120, 10_200, 300, 20_000, 1, 1)]
    got = rows(O.stitch(spark.createDataFrame(far + near, schemas.OVERLAP), 40), "a", "ab", "ae", "bb", "be")
    assert got == [(1, 0, 100, 10_000, 10_100), (1, 110, 200, 50, 140), (3, 0, 200, 10_000, 10_200)]


def test_repeats(many):
    expected = []
    for read in (0, 1, 2, 3):
        spans = [(r.ab, r.ae) for r in many.filter(F.col("a") == read).collect()]
        on, start = False, None
        for x in range(2300):
            depth = sum(s <= x < e for s, e in spans)
            if not on and depth >= 20:
                on, start = True, x
            elif on and depth < 17:
                expected.append((read, "repeats", start, x))
                on = False
    assert expected
    assert rows(O.repeat_track(many, 10)) == sorted(expected, key=repr)


@pytest.mark.parametrize("bounded", [False, True])
def test_quality_trim(spark, many, bounded):
    previous = spark.createDataFrame([(r, "trim", 310, 1450) for r in range(4)], schemas.TRACK)
    expected = []
    for read in range(4):
        overlaps = [r for r in many.filter(F.col("a") == read).collect()]
        best, run = None, None
        for s in range(24):
            over = [r for r in overlaps if r.ab <= s * 100 and r.ae >= s * 100 + 100]
            good = over and 100 * sum(r.diffs for r in over) <= 26 * sum(r.ae - r.ab for r in over)
            if bounded and not 4 <= s < 14:
                good = False
            if good:
                run = [s, s + 1] if run is None else [run[0], s + 1]
                if run[1] - run[0] >= 2 and (best is None or run[1] - run[0] > best[1] - best[0]):
                    best = list(run)
            else:
                run = None
        if best:
            expected.append((read, "trim", best[0] * 100, best[1] * 100))
    assert expected
    got = O.quality_trim(many, threshold=26, min_segments=2, previous=previous if bounded else None)
    assert rows(got) == sorted(expected, key=repr)


def test_tracks(spark):
    one = spark.createDataFrame([(1, "x", 0, 10), (1, "x", 10, 15), (2, "x", 3, 4)], schemas.TRACK)
    two = spark.createDataFrame([(1, "x", 0, 10), (1, "x", 20, 30), (1, "x", 25, 27)], schemas.TRACK)
    assert rows(O.track_combine(one, two)) == [(1, "combined_repeats", 0, 15), (1, "combined_repeats", 20, 30), (2, "combined_repeats", 3, 4)]
    assert O.track_merge([one, two]).count() == 5
    assert rows(O.track_duplicates([one, two])) == [(1, "x", 0, 10, 2)]
    assert rows(longest_interval(merge_intervals(two, ["read_id"]), ["read_id"])) == [(1, 0, 10)]
    assert rows(merge_intervals(two, ["read_id"], 10)) == [(1, 0, 30)]


def test_gaps(spark):
    data = [(1, b, "+", ab, ae, 0, ae - ab, 1000, 1000, 0, 1) for b, ab, ae in [(2, 0, 100), (3, 150, 300), (4, 310, 400), (5, 600, 700)]]
    trim = spark.createDataFrame([(1, "trim", 50, 650)], schemas.TRACK)
    assert [r.b for r in O.remove_gaps(table(spark, data), trim, 20).orderBy("b").collect()] == [3, 4]
    assert O.remove_gaps(table(spark, data), trim, 500).count() == 4
    assert O.remove_gaps(table(spark, data), trim.filter("read_id = 9"), 500).count() == 0


def test_filter(spark):
    def row(b, ab, ae, bb, be, strand="+"):
        return (1, b, strand, ab, ae, bb, be, 3000, 3000, 0, 1)

    data = [
        row(2, 1900, 3000, 0, 1100),  # a's end on b's start
        row(3, 1900, 3000, 500, 1600),  # dangles on the left
        row(4, 2100, 3000, 0, 900),  # short
        row(5, 0, 1100, 1900, 3000),  # mostly repeat
        row(6, 1850, 3000, 0, 1150, "-"),
    ]
    trim = spark.createDataFrame([(i, "trim", 0, 3000) for i in range(1, 7)], schemas.TRACK)
    repeats = spark.createDataFrame([(1, "repeats", 0, 500), (1, "repeats", 400, 900)], schemas.TRACK)
    assert [r.b for r in O.filter_overlaps(table(spark, data), trim, repeats).orderBy("b").collect()] == [2, 6]
    tight = trim.withColumn("e", F.when(F.col("read_id") == 1, 2950).otherwise(F.col("e")))
    kept = O.filter_overlaps(table(spark, data), tight, repeats).orderBy("b").select("b", "ae", "be").collect()
    assert [tuple(r) for r in kept] == [(2, 2950, 1050), (6, 2950, 1100)]


def test_checks_and_stats(spark):
    data = [(1, 2, "+", 0, 10, 0, 10, 20, 20, 1, 7), (1, 2, "+", 5, 5, 0, 10, 20, 20, 1, 7), (1, 9, "+", 0, 30, 0, 30, 20, 40, 2, 8), (2, 1, "+", 0, 4, 0, 4, 20, 20, 0, 9)]
    reads = spark.createDataFrame([(1,), (2,)], "read_id bigint")
    assert rows(O.check_overlaps(table(spark, data), reads)) == [(7, 1, 0, 0), (8, 0, 1, 1)]
    assert rows(O.overlap_stats(table(spark, data)))[0] == (7, 2, 1, 10, 0, 10, 5.0, 2)


def test_trim_reads(spark):
    reads = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACGT"), (3, "AAAA")], "read_id bigint, seq string")
    trim = spark.createDataFrame([(1, "trim", 2, 7), (2, "trim", 0, 3), (3, "trim", 0, 4)], schemas.TRACK)
    assert rows(O.trim_reads(reads, trim, 4)) == [(1, "GTACG", 5), (3, "AAAA", 4)]
    track = spark.createDataFrame([(1, "r", 0, 4), (1, "r", 0, 2), (3, "r", 1, 2)], schemas.TRACK)
    assert rows(O.shift_track(track, trim, 4)) == [(1, "r", 0, 2), (3, "r", 1, 2)]


@pytest.mark.parametrize("identity", [False, True])
@pytest.mark.parametrize("hot", [False, True])
def test_candidate_pairs(spark, identity, hot, monkeypatch):
    rng = random.Random(9)
    genome = "".join(rng.choices("ACGT", k=900))
    reads = {i: genome[s : s + 150] for i, s in enumerate(rng.choices(range(750), k=25))}
    reads[25] = "A" * 300
    reads[26] = "ACGTT" * 20
    masks = {3: [(10, 60), (50, 80)]}
    if hot:  # every k-mer seen more than three times counts as very frequent
        monkeypatch.setattr(ordered, "TASK_ROWS", 3)
        monkeypatch.setattr(seeds, "HOT_KMER", 5)
    else:  # every read is taken apart in pieces
        monkeypatch.setattr(sketch, "PIECE", 40)
    k, max_freq, band = 9, 8, 16
    places = {}
    for i, seq in reads.items():
        for p in range(len(seq) - k + 1):
            if not any(p < e and p + k > b for b, e in masks.get(i, [])):
                places.setdefault(seq[p : p + k], []).append((i, p))
    counts = {}
    for at in places.values():
        if len(at) <= max_freq:
            for x in at:
                for y in at:
                    if x[0] < y[0] or (identity and x[0] == y[0] and x[1] < y[1]):
                        key = (x[0], y[0], (x[1] - y[1]) // band)
                        counts[key] = counts.get(key, 0) + 1
    expected = [(*key, n) for key, n in counts.items() if n >= 3]
    df = spark.createDataFrame(list(reads.items()), "read_id bigint, seq string")
    track = spark.createDataFrame([(i, "mask", b, e) for i, spans in masks.items() for b, e in spans], schemas.TRACK)
    got = seeds.candidate_pairs(df, k, max_freq, 3, band, identity, track)
    assert rows(got) == sorted(expected, key=repr)


@pytest.mark.parametrize("k", [9, 30])
def test_seeds_of_other_letters_and_text_ids(spark, k):
    """k-mers with letters beyond ACGTN, or too long to be numbers, are compared as text; no list is made per place."""
    rng = random.Random(k)
    core = "".join(rng.choices("ACGTacgt\u00e9", k=80))
    reads = {f"r{i}": "".join(rng.choices("ACGTN", k=10 * i)) + core[i : 80 - i] + "ACGTT" * i for i in range(6)}
    places = {}
    for i, seq in reads.items():
        for p in range(len(seq) - k + 1):
            places.setdefault(seq[p : p + k], []).append((i, p))
    counts = {}
    for at in places.values():
        for x in at if len(at) <= 8 else []:
            for y in at:
                if x[0] < y[0]:
                    key = (x[0], y[0], (x[1] - y[1]) // 16)
                    counts[key] = counts.get(key, 0) + 1
    df = spark.createDataFrame(list(reads.items()), "read_id string, seq string")
    got = seeds.candidate_pairs(df, k, 8, 3, 16)
    assert counts and rows(got) == sorted(((*key, n) for key, n in counts.items() if n >= 3), key=repr)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_masked_seeds_are_numbers(spark):
    """Seeds that touch a mask are left out; the others are numbers to the base 5 with their places."""
    seq, masks = "ACGTNACGTA", [(3, 4), (9, 9)]
    df = spark.createDataFrame([(1, seq), (2, None), (3, "AC")], "read_id bigint, seq string")
    track = spark.createDataFrame([(1, "mask", b, e) for b, e in masks], schemas.TRACK)
    number = lambda p: sum("ACGTN".index(c) * 5 ** (2 - i) for i, c in enumerate(seq[p : p + 3]))
    got = seeds.seed_positions(df, 3, track)
    assert rows(got, "read_id", "pos", "code", "text") == [(1, p, number(p), "") for p in (0, 4, 5, 6, 7)]


def test_missing_blocks(spark):
    there = {("x", i) for i in range(0, 70_000, 3)} | {("y", 5), ("y", 32_768), ("y", 32_769)}
    parts = spark.createDataFrame([*there, *list(there)[:50], ("x", None), ("z", 1)], "kind string, block_id long")
    wanted = [1, 2, 3, 5, 6, 32_767, 32_768, 32_769, 69_999, 70_000, 5, None]
    got = rows(O.missing_blocks(parts, spark.createDataFrame([(i,) for i in wanted], "block_id long"), ["x", "y", "w"]))
    assert got == sorted(((k, i) for k in "xyw" for i in set(wanted) - {None} if (k, i) not in there), key=repr)
