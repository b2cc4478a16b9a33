import hashlib
import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import sketch
from readloom.operators.sketch import SketchOptions, best_match, clean, contaminants, minhash_sketch, screen
from tests.conftest import rows

MD5 = SketchOptions(k=4, n=10, hash_name="md5")


def brute(text, k=4, n=10, canonical=False):
    kmers = {text[i : i + k] for i in range(len(text) - k + 1)}
    if canonical:
        kmers = {min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))) for x in kmers}
    return sorted(hashlib.md5(x.encode()).hexdigest() for x in kmers)[:n]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    data = [(i, "".join(rng.choices("ACGT", k=rng.randint(0, 120)))) for i in range(40)] + [(40, "éà\nüöñ çß"), (41, "ACG")]
    return spark.createDataFrame(data, "id bigint, seq string")


@pytest.mark.parametrize("piece", [1 << 16, 7])
@pytest.mark.parametrize("canonical", [False, True])
def test_sketch(texts, piece, canonical, monkeypatch):
    monkeypatch.setattr(sketch, "PIECE", piece)
    options = SketchOptions(k=4, n=10, canonical=canonical, hash_name="md5")
    got = {r.id: r.s for r in texts.select("id", options.of(F.col("seq")).alias("s")).collect()}
    assert got == {r.id: brute(r.seq, canonical=canonical) for r in texts.collect()}


def test_native_hash_keeps_the_n_smallest(texts):
    wide = {r.id: r.s for r in texts.select("id", SketchOptions(4, 1000).of(F.col("seq")).alias("s")).collect()}
    narrow = {r.id: r.s for r in texts.select("id", SketchOptions(4, 10).of(F.col("seq")).alias("s")).collect()}
    assert narrow == {i: s[:10] for i, s in wide.items()}
    assert minhash_sketch(texts, SketchOptions(4, 10)).count() == sum(map(len, narrow.values()))


@pytest.mark.parametrize("shared", [0, 64])
@pytest.mark.parametrize("limit", [0, 2_000_000])
def test_best_match(texts, limit, shared, monkeypatch):
    monkeypatch.setattr(sketch, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(sketch, "MOST_SHARED", shared)
    refs = texts.filter("id % 3 = 0").withColumn("id", F.col("id") + 100)
    refs = refs.unionByName(refs.withColumn("id", F.col("id") + 1000))  # every reference twice
    known = {r.id: set(brute(r.seq)) for r in refs.collect()}
    expected = []
    for r in texts.collect():
        mine, best = set(brute(r.seq)), (0.0, None, 0, 0)
        for ref in sorted(known):
            hits = len(mine & known[ref])
            if hits and hits / len(mine | known[ref]) > best[0]:
                best = (hits / len(mine | known[ref]), ref, hits, len(known[ref]))
        expected.append((r.id, best[1], best[2], len(mine), best[3], best[0]))
    assert rows(best_match(texts, refs, MD5)) == sorted(expected, key=repr)


def test_near_equal_sketches_make_few_pairs(spark):
    # 300 targets and 200 references of a hundred hashes, which share most of them
    rng = random.Random(8)
    common = list(range(90))
    alike = [common + rng.sample(range(100, 140), 6) + [1000 + 4 * i + x for x in range(4)] for i in range(200)]
    alike[77] = alike[55][:]  # two references match alike
    mine = [common + rng.sample(range(100, 140), 6) + [9000 + 4 * i + x for x in range(4)] for i in range(300)]
    mine[5], mine[6], mine[7] = alike[199][:], alike[77][:], [5_000_000]
    refs = spark.createDataFrame([(i, len(s), h) for i, s in enumerate(alike) for h in s], "reference_id bigint, bsize int, h bigint")
    targets = spark.createDataFrame(list(enumerate(mine)), "target_id bigint, _sketch array<bigint>")
    expected = []
    for i, s in enumerate(mine):
        hits = [len(set(s) & set(r)) for r in alike]
        best = max(range(200), key=lambda r: (hits[r] / (200 - hits[r]), -r))
        expected.append((i, best if hits[best] else None, hits[best], 100 if i != 7 else 1, 100 if hits[best] else 0, hits[best] / (200 - hits[best])))
    assert rows(sketch._match_by_index(targets, refs)) == sorted(expected, key=repr)
    assert rows(sketch._match_by_hash(targets, refs)) == sorted(expected, key=repr)
    distinct = targets.select(F.col("target_id").alias("_key"), "_sketch")
    _, others = sketch.search_index(distinct, refs)
    joined = distinct.select(F.explode("_sketch").alias("h")).join(refs, "h").count()
    assert others.count() * 100 < joined


@pytest.mark.parametrize("limit", [0, 500_000])
def test_screen(spark, limit, monkeypatch):
    monkeypatch.setattr(sketch, "MATCH_ROWS", limit)
    targets = spark.createDataFrame([(1, "ACGTACGGTT"), (2, "TTTTTTTTTT"), (3, "AC")], "id bigint, seq string")
    refs = spark.createDataFrame([(7, "ACGTACGGTT")], "id bigint, seq string")
    screened = screen(targets, refs, 0.5, MD5)
    assert rows(contaminants(screened), "id", "reference_id", "ji", "seq") == [(1, 7, 1.0, "ACGTACGGTT")]
    assert rows(clean(screened), "id", "ji") == [(2, 0.0), (3, 0.0)]
    # The cutoff is strict, and below zero everything is a contaminant.
    assert contaminants(screen(targets, refs, 1.0, MD5)).count() == 0
    assert clean(screen(targets, refs, -1, MD5)).count() == 0
