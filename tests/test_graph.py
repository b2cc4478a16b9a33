import random

import pytest
from pyspark.sql import functions as F

from readloom import schemas
from readloom.operators import graph as G
from tests.conftest import rows


TURNED = {"+": "-", "-": "+"}


def oriented(spark, data):
    """Edges between reads in orientations, each with its mirror."""
    mirrors = [(b, TURNED[t], a, TURNED[s], n) for a, s, b, t, n in data]
    return spark.createDataFrame(data + mirrors, schemas.EDGE)


def edges(spark, pairs):
    return oriented(spark, [(a, "+", b, "+", 5) for a, b in pairs])


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    pairs += [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2001 + i) for i in range(100)]
    pairs += [(3000 + i, 9999) for i in range(100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    expected = {n: find(n) for n in list(parent)}
    assert dict(rows(G.connected_components(edges(spark, pairs)))) == expected


def toured(spark, pairs, circular=True):
    graph = edges(spark, pairs).withColumn("component", F.lit(0).cast("bigint"))
    paths = {}
    for r in G.tour(graph, circular).orderBy("path_id", "pos").collect():
        paths.setdefault(r.path_id, []).append(r.read_id)
        assert len(paths[r.path_id]) == r.pos + 1
        assert (r.overhang is None) == (r.pos == 0)
    return paths


def test_chain_branch_and_cycles(spark):
    chain = [(i, i - 1) for i in range(50, 1, -1)]
    branch = [(100, 101), (101, 102), (101, 103), (103, 104), (105, 104), (104, 106)]
    cycles = [(200, 201), (201, 202), (202, 200), (301, 300), (300, 301)]
    expected = {50: list(range(50, 0, -1)), 100: [100, 101], 102: [102], 103: [103], 105: [105], 104: [104, 106]}
    assert toured(spark, chain + branch + cycles, circular=False) == expected
    assert toured(spark, chain + branch + cycles) == {**expected, 200: [200, 201, 202], 300: [300, 301]}


def test_strands_follow_the_path(spark):
    data = [(1, "+", 2, "-", 3), (2, "-", 3, "-", 3), (3, "-", 4, "+", 3)]
    graph = oriented(spark, data).withColumn("component", F.lit(1).cast("bigint"))
    assert [(r.read_id, r.strand) for r in G.tour(graph).orderBy("pos").collect()] == [(1, "+"), (2, "-"), (3, "-"), (4, "+")]


def test_one_of_two_mirrored_cycles(spark):
    data = [(3, "+", 1, "-", 3), (1, "-", 2, "+", 4), (2, "+", 3, "+", 5)]
    graph = oriented(spark, data).withColumn("component", F.lit(1).cast("bigint"))
    assert [(r.read_id, r.strand) for r in G.tour(graph).orderBy("pos").collect()] == [(1, "+"), (3, "-"), (2, "-")]


def layout(spark, spans, back=()):
    """Overlaps of all pairs of intervals on a line; the reads in ``back`` lie there turned round."""
    data = []
    for a, (s1, e1) in spans.items():
        for b, (s2, e2) in spans.items():
            lo, hi = max(s1, s2), min(e1, e2)
            if a < b and hi > lo:
                strand = "+" if (a in back) == (b in back) else "-"
                place = (e1 - hi, e1 - lo, e2 - hi, e2 - lo) if a in back else (lo - s1, hi - s1, lo - s2, hi - s2)
                data.append((a, b, strand, *place, e1 - s1, e2 - s2, 0, 1))
    return spark.createDataFrame(data, schemas.OVERLAP)


def test_graph_of_a_layout(spark):
    spans = {1: (0, 100), 2: (60, 160), 3: (70, 90), 4: (120, 220), 5: (210, 300), 6: (120, 220)}
    overlap = layout(spark, spans)
    assert rows(G.contained_reads(overlap)) == [(3,), (6,)]
    got = rows(G.overlap_graph(overlap, dead_end_edges=0).filter("src_strand = '+'"), "component", "src", "dst", "overhang")
    assert got == [(1, 1, 2, 60), (1, 2, 4, 60), (1, 4, 5, 80)]
    mirrors = rows(G.overlap_graph(overlap, dead_end_edges=0).filter("src_strand = '-'"), "src", "dst", "dst_strand", "overhang")
    assert mirrors == [(2, 1, "-", 60), (4, 2, "-", 60), (5, 4, "-", 90)]


def test_tips(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (2, 9), (8, 3)]
    kept = rows(G.drop_tips(edges(spark, pairs)), "src", "dst")
    assert (2, 9) not in kept and (8, 3) not in kept and (2, 3) in kept
    with pytest.raises(ValueError):
        G.overlap_graph(layout(spark, {1: (0, 9), 2: (5, 14)}), dead_end_edges=-1)


def brute_dead_ends(pairs, most):
    """Pairs of nodes that are no part of a dead end of up to ``most`` edges."""
    pairs = set(pairs)
    after, before = {}, {}
    for u, v in pairs:
        after.setdefault(u, set()).add(v)
        before.setdefault(v, set()).add(u)

    def ends(after, before):
        for leaf in set(before) - set(after):
            chain, node = [], leaf
            while len(before.get(node, ())) == 1 and len(chain) < most:
                (back,) = before[node]
                chain.append((back, node))
                if len(after[back]) > 1:
                    yield from chain
                    break
                if back[0] == node[0]:
                    break
                node = back

    gone = set(ends(after, before)) | {(u, v) for v, u in ends(before, after)}
    return sorted(pairs - gone)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4, 9])
def test_dead_ends_of_any_length(spark, most):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 30)] + [(5, 100), (100, 101), (101, 102), (12, 110), (110, 111), (200, 201), (201, 20)]
    pairs += [(300 + i, 301 + i) for i in range(8)] + [(15, 300)]
    data = [(a, "+", b, "+", 5) for a, b in pairs]
    data += [(400 + rng.randrange(60), rng.choice("+-"), 400 + rng.randrange(60), rng.choice("+-"), 5) for _ in range(45)]
    both = oriented(spark, data).distinct()
    nodes = {((r.src, r.src_strand), (r.dst, r.dst_strand)) for r in both.collect()}
    got = [((r.src, r.src_strand), (r.dst, r.dst_strand)) for r in G.drop_dead_ends(both, most).collect()]
    assert sorted(got) == brute_dead_ends(nodes, most)


@pytest.mark.parametrize("segment, back", [(1 << 26, ()), (100, ()), (1 << 26, (1, 2, 5, 8)), (100, (0, 3, 4, 9))])
def test_sequences_rebuild_the_line(spark, segment, back):
    rng = random.Random(6)
    genome = "".join(rng.choices("ACGT", k=500))
    spans = {i: (i * 40, i * 40 + 100) for i in range(10)}
    nearest = layout(spark, spans, back).filter("b = a + 1")
    turned = lambda seq: seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([(i, turned(genome[s:e]) if i in back else genome[s:e]) for i, (s, e) in spans.items()], "read_id bigint, seq string")
    paths = G.path_sequences(G.tour(G.overlap_graph(nearest)), reads, segment).orderBy("segment").collect()
    line = genome[: 9 * 40 + 100]
    assert "".join(p.seq for p in paths) in (line, turned(line))
    assert sum(p.n_reads for p in paths) == 10
    assert len(paths) == (1 if segment > 500 else 5)


def test_reverse_reads_are_turned(spark):
    reads = spark.createDataFrame([(1, "AACC"), (2, "GTTGG")], "read_id bigint, seq string")
    data = [(1, 1, 0, 1, "+", None), (1, 1, 1, 2, "-", 2)]
    path = spark.createDataFrame(data, schemas.PATH)
    assert [r.seq for r in G.path_sequences(path, reads).collect()] == ["AACC" + "AC"]


def test_a_missing_read_is_an_error(spark):
    path = spark.createDataFrame([(1, 1, 0, 7, "+", 0), (1, 1, 1, 8, "+", 2)], schemas.PATH)
    reads = spark.createDataFrame([(7, "ACGT"), (8, "CGTAA")], "read_id bigint, seq string")
    assert [r.seq for r in G.path_sequences(path, reads).collect()] == ["ACGTAA"]
    with pytest.raises(Exception, match="no sequence for read 8"):
        G.path_sequences(path, reads.filter("read_id = 7")).collect()


def test_parallel_edges_are_one_neighbour(spark):
    graph = oriented(spark, [(1, "+", 2, "+", 5), (1, "+", 2, "+", 6)])
    assert G.drop_tips(graph).count() == 4


def test_text_ids_on_both_strands(spark):
    overlap = layout(spark, {1: (0, 100), 2: (60, 160), 3: (120, 220)}, back=(2,)).filter("b = a + 1")
    named = overlap.withColumns({c: F.concat(F.lit("r"), F.col(c).cast("string")) for c in ("a", "b")})
    path = G.tour(G.overlap_graph(named)).orderBy("pos").collect()
    assert [(r.path_id, r.read_id, r.strand) for r in path] == [("r1", "r1", "+"), ("r1", "r2", "-"), ("r1", "r3", "+")]
