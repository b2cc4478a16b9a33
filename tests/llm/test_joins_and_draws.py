"""Collocations, the Jaccard join and resampling against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from readloom.llm import bits, collocations, grams, importance, jaccard
from tests.llm.test_llm import CLASHING, EDGE, SCHEMA, ids


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*row, *CLASHING) for row in EDGE], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11


def brute_collocations(rows, least, top):
    words, runs = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            own = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(own)
            runs.update((lang or "und", tuple(own[i : i + n])) for n in range(1, 5) for i in range(len(own) - n + 1))
    many = {k: a for k, a in runs.items() if a >= least}
    out = defaultdict(list)
    for (lang, p), a in many.items():
        if len(p) < 2:
            continue
        if any(x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for (x, q), b in many.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (many[lang, p[:k]] + many[lang, p[k:]]), k, many[lang, p[:k]], many[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((x, i + 1, p.decode(), -a, l, r, words[x], -s) for x, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top]))


def prose(dice, n):
    vocabulary = ["New", "york", "the", "of", "é", "漢字", "a", "b", "c's", "\x01x"]
    sentence = lambda: "".join(dice.choice(vocabulary) + dice.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(dice.randrange(40)))
    return [(dice.choice(["en", "en", "de", None]), dice.choice([None, "", " \t"]) if dice.random() < 0.1 else sentence()) for _ in range(n)]


def answers(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("mask", [grams.ALL, 0xF])
def test_collocations_whatever_collides(spark, mask):
    rows = prose(random.Random(3), 300)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    assert answers(collocations.collocations(docs, least=6, top=20, mask=mask)) == brute_collocations(rows, 6, 20)


def test_collocations_in_small_blocks_and_parts(spark, monkeypatch):
    rows = prose(random.Random(4), 200) + [("en", "new york the of " * 60), ("en", "a b. " * 90)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    expected = brute_collocations(rows, 6, 5)
    assert b"".join(collocations._pieces(b"ab. " * 9)) == b"ab. " * 9
    for name, value in (("BLOCK", 64), ("HELD", 10), ("RANKED", 9)):
        monkeypatch.setattr(collocations, name, value)
    assert [p for p in collocations._pieces(b"x" * 70 + b"," + b"ab. " * 30)] == [b"x" * 70 + b",", b"ab. " * 15 + b"ab.", b" ab." * 14 + b" "]
    assert answers(collocations.collocations(docs, least=6, top=5)) == expected


def test_collocation_scores_do_not_overflow(spark):
    big = 4 * 10**18
    frequent = spark.createDataFrame([("en", 1, "x", big, 1), ("en", 1, "y", big, 1), ("en", 2, "x y", big, 1)], "lang string, words int, phrase string, n long, doc_id long")
    assert [r.score for r in collocations.scored(frequent.where("n > 0").selectExpr("lang", "words", "phrase", "n", "doc_id")).collect()] == [1_000_000]


def test_collocations_edges(spark, edge):
    got = collocations.collocations(edge.unionByName(edge), least=4)
    assert {(r.lang, r.phrase, r.a) for r in got.collect()} == {(x, p, a) for x, _, p, a, *_ in brute_collocations([(r[2], r[1]) for r in EDGE] * 2, 4, 2000)}
    passage = collocations.collocations(edge, least=2).where("phrase = 'shared0 shared1 shared2 shared3'").first()
    assert (passage.lang, passage.a, passage.doc_id) == ("de", 2, 9)
    assert collocations.collocations(edge.where("false")).collect() == []


# 12


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()


def brute_components(rows):
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                root[top(i)] = top(j)
    name = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        name[top(i)].append(doc_id)
    return sorted(((d, len(sets[i]), min((x for x in name[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def copies(dice):
    words = [f"w{i}" for i in range(500)]
    out = []
    for size in (3, 10, 12, 25, 60, 200, 400):
        base = dice.choices(words, k=size)
        for _ in range(14):
            other = list(base)
            for _ in range(dice.choice([0, 1, 1, 2, 3])):
                other[dice.randrange(len(other)) :][:1] = dice.choice([[], [dice.choice(words)], [dice.choice(words), "new"]])
            if dice.random() < 0.3:
                del other[: dice.randrange(1 + size // 20)]
            out.append(" ".join(other))
    dice.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("block", "seed"), [(1024, 1), (3, 2)])
def test_jaccard_components(spark, block, seed):
    rows = [*copies(random.Random(seed)), (900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (None, "one two"), (None, "no id"), (905, "no id either"), (905, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in jaccard.similar(docs, block=block).collect()), key=repr)
    assert got == brute_components(rows)


def test_jaccard_of_a_chain_without_a_hub(spark):
    # each text is like the next one only, so that no hub settles the crowd
    words = [f"c{i}" for i in range(140)]
    rows = [(i, " ".join(words[i : i + 100])) for i in range(0, 40, 2)] + [(100 + i, f"{' '.join(words[:12])} own{i} more{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.similar(docs, block=4).collect()), key=repr) == brute_components(rows)


def test_jaccard_filters_lose_no_pair():
    dice = np.random.default_rng(5)
    order = dice.integers(0, 9, jaccard.SLOTS).astype(np.uint32)
    for _ in range(300):
        a = np.unique(dice.integers(0, 1 << 63, int(dice.integers(1, 80)), np.uint64))
        b = np.unique(np.concatenate((a[dice.random(len(a)) > 0.05], dice.integers(0, 1 << 63, int(dice.integers(0, 4)), np.uint64))))
        common = len(np.intersect1d(a, b))
        if 100 * common < 90 * (len(a) + len(b) - common):
            continue
        met = []
        for x in (a, b):
            by, n = jaccard._prefix(x, order, 90)
            ranges = np.bincount((x >> np.uint64(60)).astype(int), minlength=16)
            met.append(({int(t): i for i, t in enumerate(x[by[:n]])}, ranges))
        (x, after), (y, following) = met
        first = min((t for t in x if t in y), key=x.get)
        assert jaccard.may_link(np.array([len(a)]), np.array([x[first]]), after[None], np.array([len(b)]), np.array([y[first]]), following[None], 90)[0]


def test_jaccard_hashes_texts_in_little_memory():
    words = [f"w{i}" for i in range(5000)]
    dice = random.Random(6)
    texts = [" ".join(dice.choices(words, k=300)).encode() for _ in range(2000)]
    grams._powers.cache_clear()
    tracemalloc.start()
    try:
        assert sum(1 for found in jaccard.shingle_sets(texts) if len(found)) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()
        grams._powers.cache_clear()


def test_jaccard_ranges_tell_large_sets_apart_and_lose_no_pair():
    dice = np.random.default_rng(8)
    draw = lambda n: np.unique(dice.integers(0, 1 << 64, n, np.uint64))
    pairs = [(draw(3000), draw(3000)) for _ in range(20)]
    for n in (1, 30, 500, 511, 2047, 2100, 300_000):
        # one end is close to a number of shingles at which the ranges double
        whole = draw(n)
        pairs += [(whole, whole[dice.random(len(whole)) > 0.04]) for _ in range(5)]
    # nearly all hashes in one range, so that counts are cut at 255
    pairs += [(x := np.arange(2060, dtype=np.uint64), x[40:]), (x, x)]
    sizes = [np.array([len(p[i]) for p in pairs]) for i in (0, 1)]
    got = jaccard.ranges_allow(sizes[0], [jaccard.ranges_of(a) for a, _ in pairs], sizes[1], [jaccard.ranges_of(b) for _, b in pairs], 90)
    common = np.array([len(np.intersect1d(a, b)) for a, b in pairs])
    assert got[100 * common >= 90 * (sizes[0] + sizes[1] - common)].all()
    assert not got[:20].any()


def test_jaccard_keeps_shingles_of_similar_sizes_only(spark):
    sizes = {1: [10, 1000], 2: [100, 95], 3: [10, 100, 1000], 4: [10, 1000, 950], 5: [7], 6: [40, 40, 40]}
    rows = [(token, (i, 100 * token + i), n, 0) for token, some in sizes.items() for i, n in enumerate(some)]
    entries = spark.createDataFrame(rows, "_token long, _node struct<high: long, low: long>, _n long, _pos long")
    assert sorted((r["_token"], r["_many"]) for r in jaccard._shared(entries, 90).collect()) == [(2, False)] * 2 + [(4, True)] * 3 + [(6, True)] * 3


def test_jaccard_edges(spark, edge):
    got = jaccard.similar(edge)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_components([r[:2] for r in EDGE])
    assert jaccard.similar(edge.where("false")).collect() == []


def test_bits_say_yes_to_their_own(spark):
    values = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 3000)
    table = bits.bits_of(spark.createDataFrame([(int(v),) for v in values], "v long"), "v", 3000)
    assert table.has(values.view(np.uint64)).all()
    assert table.has(np.random.default_rng(2).integers(0, 1 << 63, 3000, np.uint64)).mean() < 0.05


# 13


def brute_draw(rows, target, percent=5):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    held = lambda t: Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for w in [words(t)] for k in (1, 2, 3) for i in range(len(w) - k + 1))
    docs = [held(t) for _, t in rows]
    s, t = sum(docs, Counter()), sum((held(x) for x in target), Counter())
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in s}
    out = []
    for (doc_id, text), features in zip(rows, docs, strict=True):
        weight = sum(gain[b] * c for b, c in features.items())
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, sum(features.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= 20])
    out.sort(key=lambda r: (not r[4], -r[3], r[0] is None, r[0]))
    drawn = percent * sum(r[4] for r in out) // 100
    return sorted(((*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(out)), key=repr)


@pytest.mark.parametrize("head", [1 << 16, 4])
def test_resampling_whatever_the_head(spark, monkeypatch, head):
    dice = random.Random(7)
    vocabulary = [*"abcdefgh", "Über", "漢字", "x" * 40, "42", "é"]
    text = lambda n: "".join(dice.choice(vocabulary) + dice.choice([" ", "-", "\n", "\x01 "]) for _ in range(n))
    rows = [(i, text(dice.randrange(60))) for i in range(150)] + [(7, "a b c " * 10)] * 40 + [(None, "a b c " * 9)] * 3 + [(200, None), (201, ""), (202, "?!")]
    target = [text(30) for _ in range(5)] + ["Über Über x", None, ""]
    monkeypatch.setattr(importance, "HEAD", head)
    monkeypatch.setattr(importance, "PAIRS", 2 * head)
    monkeypatch.setattr(importance, "CHUNK", 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    passages = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, passages, percent=40)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_draw(rows, target, 40)


def test_resampling_edges(spark, edge):
    target = spark.createDataFrame([(t,) for _, t, *_ in EDGE[:6]], "text string")
    got = sorted((tuple(r) for r in importance.resample(edge, target, percent=60).collect()), key=repr)
    assert got == brute_draw([r[:2] for r in EDGE], [t for _, t, *_ in EDGE[:6]], 60)
    assert len(got) == len(ids(edge.collect()))
    assert importance.resample(edge.where("false"), target).collect() == []
    assert all(r.weight == sum(map(int, [r.weight])) for r in importance.resample(edge, target.where("false")).collect())


def test_crc_states_are_those_of_the_bytes():
    dice = random.Random(1)
    vocabulary = [bytes(dice.choices(b"abcdefgh0", k=dice.randint(1, 5))) for _ in range(60)] + [b"x" * 40, "é漢".encode()]
    docs = [b" ".join(dice.choices(vocabulary, k=dice.randint(0, 9))) for _ in range(200)]
    head = importance.Head(vocabulary[:30] + vocabulary[60:], [(a, b) for a in vocabulary[:20] for b in vocabulary[:20]])
    buckets, owners = importance.features(grams.Block(docs, importance._KIND), head)
    got = defaultdict(list)
    for bucket, owner in zip(buckets.tolist(), owners.tolist(), strict=True):
        got[owner].append(bucket)
    for i, d in enumerate(docs):
        d = d.split()
        assert sorted(got[i]) == sorted(zlib.crc32(b" ".join(d[j : j + k])) % 10_000 for k in (1, 2, 3) for j in range(len(d) - k + 1))


def test_words_of_a_block_are_compared_by_their_bytes(monkeypatch):
    texts = [b"one two  one\tthree", b"", b"a-very-long-word-of-many-bytes a-very-long-word-of-many-bytez two", b"x"]
    block = grams.Block(texts, collocations._KIND)
    block.words = block.words & np.uint64(1)
    codes, words = block.distinct()
    assert [words[i] for i in codes.tolist()] == b" ".join(texts).split() and len(set(words)) == len(words)
