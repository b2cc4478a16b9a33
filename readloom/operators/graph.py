"""Overlap graph: edges, components, unbranched paths, and their sequences.

Reads lie on either strand, so a node is a read in one of its two orientations. Every
overlap says an edge and its mirror, which leads back between the turned reads; every
path has a mirror as well, and one of the two is kept.

The rules here are this library's own. Loops run a logarithmic number of rounds
on DataFrames; each round is written to the shared folder, and only a yes/no
answer or a count ever comes back to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.sequence import reverse_complement
from readloom.operators.ordered import choose_width, with_running_sum
from readloom.session import cut_lineage, drop_table, scratch_path

MAX_ROUNDS = 64
SEGMENT_BASES = 1 << 26


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join of two tables that grow with the graph, by sorting.

    A file of ids is many times smaller than its rows in memory, so Spark would send a table that
    it takes for small through the driver.
    """
    return left.hint("merge").join(right, on, how)


# --- components ---------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the lowest node id reachable, direction ignored.

    Every node points at its lowest neighbour, pointers are followed to their
    roots, and the graph is contracted to the roots. At least half of the nodes
    that still have an edge vanish in two rounds, so MAX_ROUNDS settle 2^32 nodes
    for certain; more rounds than that raise an error. The tables of a round are
    dropped once the next one's are written.
    """
    spark = edges.sparkSession
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")),
                                          F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("_e"))
    path = scratch_path(spark)
    links = cut_lineage(both.select("_e.u", "_e.v").distinct(), path)
    labels, spent = None, [path]
    for _ in range(MAX_ROUNDS):
        parents = links.groupBy("u").agg(F.least("u", F.min("v")).alias("p")).withColumnRenamed("u", "node")
        roots, path = _follow(parents)
        kept = [path]
        if labels is None:
            labels = roots.withColumnRenamed("p", "component")
        else:
            moved = roots.select(F.col("node").alias("component"), F.col("p").alias("_to"))
            labels = _met(labels, moved, "component", "left").select(
                "node", F.coalesce("_to", "component").alias("component")
            )
        of_u = roots.select(F.col("node").alias("u"), F.col("p").alias("_ru"))
        of_v = roots.select(F.col("node").alias("v"), F.col("p").alias("_rv"))
        path = scratch_path(spark)
        links = cut_lineage(
            _met(_met(links, of_u, "u"), of_v, "v")
            .filter(F.col("_ru") != F.col("_rv"))
            .select(F.col("_ru").alias("u"), F.col("_rv").alias("v"))
            .distinct(),
            path,
        )
        if links.isEmpty():
            return labels
        spent += kept
        kept = [path, scratch_path(spark)]
        labels = cut_lineage(labels, kept[1])
        for table in spent:
            drop_table(spark, table)
        spent = kept
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")


def _follow(parents: DataFrame) -> tuple[DataFrame, str]:
    """(node, p) with p the root of each node's tree, and the table's path; roots point at themselves.

    A node that knows its root is settled and is not joined again.
    """
    spark = parents.sparkSession
    path = scratch_path(spark)
    current = cut_lineage(parents.withColumn("done", F.col("node") == F.col("p")), path)
    for _ in range(MAX_ROUNDS):
        if current.filter(~F.col("done")).isEmpty():
            return current.select("node", "p"), path
        old, path = path, scratch_path(spark)
        current = cut_lineage(_jump(_jump(current)), path)
        drop_table(spark, old)
    raise RuntimeError(f"pointers not settled after {MAX_ROUNDS} rounds")


def _jump(pointers: DataFrame) -> DataFrame:
    above = pointers.select(F.col("node").alias("p"), F.col("p").alias("_pp"), F.col("done").alias("_done"))
    moved = _met(pointers.filter(~F.col("done")), above, "p")
    return pointers.filter("done").unionByName(moved.select("node", F.col("_pp").alias("p"), F.col("_done").alias("done")))


# --- edges --------------------------------------------------------------------


def contained_reads(overlap: DataFrame) -> DataFrame:
    """(read_id): reads an overlap covers end to end; of two equal reads, the higher id."""
    whole_a = (F.col("ab") <= 0) & (F.col("ae") >= F.col("a_len"))
    whole_b = (F.col("bb") <= 0) & (F.col("be") >= F.col("b_len"))
    lost = (
        F.when(whole_a & whole_b, F.greatest("a", "b"))
        .when(whole_b, F.col("b"))
        .when(whole_a, F.col("a"))
    )
    return overlap.filter(F.col("a") != F.col("b")).select(lost.alias("read_id")).filter(F.col("read_id").isNotNull()).distinct()


def _turned(strand: Column) -> Column:
    return F.when(strand == "+", "-").otherwise("+")


def dovetail_edges(overlap: DataFrame) -> DataFrame:
    """(src, src_strand, dst, dst_strand, overhang): end-to-start overlaps between reads that are not contained.

    bb and be count along b as the overlap turns it. Each edge comes with its mirror.
    overhang: bases dst adds past the end of src. Of several overlaps that say
    the same edge, the one with the least overhang stays.
    """
    lost = contained_reads(overlap).withColumnRenamed("read_id", "_lost")
    kept = (
        overlap.filter(F.col("a") != F.col("b"))
        .hint("merge").join(lost, F.col("a") == F.col("_lost"), "left_anti")
        .hint("merge").join(lost, F.col("b") == F.col("_lost"), "left_anti")
    )
    a_then_b = (F.col("ae") >= F.col("a_len")) & (F.col("bb") <= 0)
    b_then_a = (F.col("ab") <= 0) & (F.col("be") >= F.col("b_len"))
    plus, minus, same, other = F.lit("+"), F.lit("-"), F.col("strand"), _turned(F.col("strand"))

    def edge(src: str, src_strand: Column, dst: str, dst_strand: Column, overhang: Column) -> Column:
        return F.struct(
            F.col(src).alias("src"), src_strand.alias("src_strand"),
            F.col(dst).alias("dst"), dst_strand.alias("dst_strand"), overhang.alias("overhang"),
        )

    forward = F.array(edge("a", plus, "b", same, F.col("b_len") - F.col("be")), edge("b", other, "a", minus, F.col("ab")))
    backward = F.array(edge("b", same, "a", plus, F.col("a_len") - F.col("ae")), edge("a", minus, "b", other, F.col("bb")))
    said = kept.select(F.explode(F.when(a_then_b, forward).when(b_then_a, backward)).alias("_e")).select("_e.*")
    return said.groupBy("src", "src_strand", "dst", "dst_strand").agg(F.min("overhang").alias("overhang"))


def _with_nodes(edges: DataFrame) -> DataFrame:
    """``edges`` with the nodes _u and _v they lead from and to."""
    return edges.withColumns({
        node: F.struct(F.col(end).alias("read"), F.col(f"{end}_strand").alias("strand"))
        for node, end in (("_u", "src"), ("_v", "dst"))
    })


def _degrees(linked: DataFrame) -> DataFrame:
    """(node, n_out, n_in) of every node with an edge; parallel edges lead to one neighbour."""
    ends = F.array(
        F.struct(F.col("_u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("_v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")),
    )
    per_end = linked.select("_u", "_v").distinct().select(F.explode(ends).alias("_e")).select("_e.*")
    return per_end.groupBy("node").agg(F.sum("out").alias("n_out"), F.sum("in").alias("n_in"))


def drop_tips(edges: DataFrame) -> DataFrame:
    """Edges without single-edge dead ends: leaves hanging off a node that goes on elsewhere."""
    linked = _with_nodes(edges)
    degrees = _degrees(linked)

    def of(end: str) -> DataFrame:
        return degrees.select(
            F.col("node").alias(end), F.col("n_out").alias(f"{end}_out"), F.col("n_in").alias(f"{end}_in")
        )

    rows = _met(_met(linked, of("_u"), "_u"), of("_v"), "_v")
    leads_nowhere = (F.col("_v_out") == 0) & (F.col("_v_in") == 1) & (F.col("_u_out") > 1)
    comes_from_nowhere = (F.col("_u_in") == 0) & (F.col("_u_out") == 1) & (F.col("_v_in") > 1)
    return rows.filter(~(leads_nowhere | comes_from_nowhere)).select(*edges.columns)


def drop_dead_ends(edges: DataFrame, most: int) -> DataFrame:
    """Edges without dead ends of up to ``most`` edges.

    A dead end is an unbranched chain from a fork to a node where nothing goes on, or
    its mirror, from a node that nothing leads to into a node that others lead to as well.
    Forks are those of the graph given, so short ends of one fork go together. Nodes learn
    the head of their chain by doubling, in as many rounds as ``most`` has binary digits;
    longer chains are not followed to their ends.
    """
    if most < 0:
        raise ValueError("a number of edges is not negative")
    if most < 2:
        return drop_tips(edges) if most else edges
    spark = edges.sparkSession
    linked = _with_nodes(edges)
    pairs = linked.select("_u", "_v").distinct()
    links, degrees = cut_lineage(unbranched_links(edges)), cut_lineage(_degrees(linked))
    path = scratch_path(spark)
    current = cut_lineage(_one_step_back(links, degrees.select("node")), path)
    for _ in range((most - 1).bit_length()):
        old, path = path, scratch_path(spark)
        current = cut_lineage(_double(current), path)
        drop_table(spark, old)
    near = current.filter(F.col("done") & (F.col("steps") < most)).select("node", "anchor")
    last = _met(near, links.select(F.col("_u").alias("node")), "node", "left_anti")
    of = lambda end: degrees.select(F.col("node").alias(end), F.col("n_out").alias(f"{end}_out"), F.col("n_in").alias(f"{end}_in"))
    # chains of few enough edges with the degrees at both ends
    chains = _met(last.withColumnRenamed("node", "_v"), of("_v"), "_v").withColumnRenamed("_v", "_end")
    chains = _met(chains.withColumnRenamed("anchor", "_u"), of("_u"), "_u").withColumnRenamed("_u", "_head")
    ends = _met(_met(pairs, of("_u"), "_u"), of("_v"), "_v")
    leads_nowhere = chains.filter("_v_out = 0 AND _u_in = 1").select(F.col("_head").alias("_v"), "_head")
    from_nowhere = chains.filter("_u_in = 0 AND _v_out = 1").select(F.col("_end").alias("_u"), "_head")
    outer = _met(ends.filter("_u_out > 1"), leads_nowhere, "_v").select("_u", "_v", "_head").unionByName(
        _met(ends.filter("_v_in > 1"), from_nowhere, "_u").select("_u", "_v", "_head")
    )
    outer = cut_lineage(outer)
    inner = _met(near, outer.select(F.col("_head").alias("anchor")).distinct(), "anchor").select(F.col("node").alias("_v"))
    gone = outer.select("_u", "_v").unionByName(_met(links, inner, "_v").select("_u", "_v")).distinct()
    return _met(linked, gone, ["_u", "_v"], "left_anti").select(*edges.columns)


def overlap_graph(overlap: DataFrame, dead_end_edges: int = 1) -> DataFrame:
    """(component, src, src_strand, dst, dst_strand, overhang): the graph's edges, split by component.

    Contained reads are left out, and dead ends of up to ``dead_end_edges`` edges removed
    once. a_len and b_len are lengths after trimming.
    """
    edges = dovetail_edges(overlap)
    if dead_end_edges > 1:
        edges = cut_lineage(edges)
    edges = cut_lineage(drop_dead_ends(edges, dead_end_edges))
    labels = connected_components(edges).withColumnRenamed("node", "src")
    return _met(edges, labels, "src").select("component", *edges.columns)


# --- paths --------------------------------------------------------------------


def unbranched_links(edges: DataFrame) -> DataFrame:
    """(_u, _v, overhang): edges that leave a node no other edge leaves and enter one no other enters.

    Edges from a read to itself are no links.
    """
    pairs = _with_nodes(edges).groupBy("_u", "_v").agg(F.min("overhang").alias("overhang"))
    degrees = _degrees(pairs)
    single_out = degrees.filter("n_out = 1").select(F.col("node").alias("_u"))
    single_in = degrees.filter("n_in = 1").select(F.col("node").alias("_v"))
    between = pairs.filter(F.col("_u.read") != F.col("_v.read"))
    return _met(_met(between, single_out, "_u", "left_semi"), single_in, "_v", "left_semi")


def tour(edges: DataFrame, circular: bool = True) -> DataFrame:
    """(component, path_id, pos, read_id, strand, overhang): maximal unbranched chains.

    ``edges`` hold each edge and its mirror. Of a chain and its mirror, the one that
    starts on the forward strand is kept; if both or neither do, the one with the lower
    first read. path_id is the first read of the path, ``strand`` the orientation a read
    is walked in, and ``overhang`` what it adds to the one before (null at pos 0). Pure
    cycles start at their lowest read, forward, when ``circular``, and are left out
    otherwise. Every read with an edge is on one path.
    """
    links = cut_lineage(unbranched_links(edges))
    nodes = _with_nodes(edges).select(F.explode(F.array("_u", "_v")).alias("node")).distinct()
    placed = _rank_chains(links, nodes)
    cyclic = placed.filter(~F.col("done"))
    # The mirror of a chain starts at the turned node of its end; every node asks its own turned one.
    mirror = placed.filter("done").select(
        F.struct(F.col("node.read").alias("read"), _turned(F.col("node.strand")).alias("strand")).alias("node"),
        F.col("anchor").alias("_other"),
    )
    ranked = lambda head: F.struct(F.col(f"{head}.strand"), F.col(f"{head}.read"))
    chains = _met(placed.filter("done"), mirror, "node").filter(ranked("anchor") < ranked("_other")).drop("_other", "low")
    if circular and not cyclic.isEmpty():
        members = cyclic.filter("low.strand = '+'").select(F.col("node").alias("_v"), F.col("low").alias("_low"))
        opened = cut_lineage(_met(links, members, "_v").filter(F.col("_v") != F.col("_low")).drop("_low"))
        ends = opened.select(F.explode(F.array("_u", "_v")).alias("node")).distinct()
        chains = chains.unionByName(_rank_chains(opened, ends).drop("low"))
    entered = links.select(F.col("_v").alias("node"), "overhang")
    component = edges.select(F.explode(F.array("src", "dst")).alias("read_id"), "component").distinct()
    walked = _met(chains, entered, "node", "left").select(
        F.col("anchor.read").alias("path_id"),
        F.col("steps").alias("pos"),
        F.col("node.read").alias("read_id"),
        F.col("node.strand").alias("strand"),
        F.when(F.col("steps") > 0, F.col("overhang")).alias("overhang"),
    )
    return _met(walked, component, "read_id").select("component", "path_id", "pos", "read_id", "strand", "overhang")


def _rank_chains(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, anchor, steps, done, low): each node's chain head and distance from it.

    Pointer doubling: a node knows the node 2^i steps back, so i doublings settle
    all nodes within 2^i of their head. Nodes of cycles never settle; they learn
    the lowest node of their cycle. Only unsettled nodes are joined, and their
    anchors are all different, so no key is hot.
    """
    spark = links.sparkSession
    path = scratch_path(spark)
    current = cut_lineage(_one_step_back(links, nodes), path)
    state = _unsettled(current)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            return current
        old, path = path, scratch_path(spark)
        current = cut_lineage(_double(_double(current)), path)
        drop_table(spark, old)
        following = _unsettled(current)
        # Chains settle nodes in every round, and cycles lower some node's lowest
        # until all know it; so a round that changes neither was the last.
        if following == state:
            return current
        state = following
    raise RuntimeError(f"chains not settled after {MAX_ROUNDS} rounds")


def _one_step_back(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where the doubling starts: a node's anchor is the one before it; a head is its own, 0 steps away."""
    back = links.select(F.col("_v").alias("node"), F.col("_u").alias("_back"))
    return _met(nodes, back, "node", "left").select(
        "node",
        F.coalesce("_back", "node").alias("anchor"),
        F.when(F.col("_back").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("steps"),
        F.col("_back").isNull().alias("done"),
        F.least("node", F.coalesce("_back", "node")).alias("low"),
    )


def _unsettled(current: DataFrame) -> tuple:
    """How many nodes are not settled, and a sum over the lowest nodes they know."""
    inner = ~F.col("done")
    low = F.sum(F.when(inner, F.xxhash64("node", "low")).cast("decimal(38,0)"))
    return tuple(current.select(F.count_if(inner), low).first())


def _double(current: DataFrame) -> DataFrame:
    at = current.select(
        F.col("node").alias("anchor"), F.col("anchor").alias("_anchor"), F.col("steps").alias("_steps"),
        F.col("done").alias("_done"), F.col("low").alias("_low"),
    )
    moved = _met(current.filter(~F.col("done")), at, "anchor").select(
        "node",
        F.col("_anchor").alias("anchor"),
        (F.col("steps") + F.col("_steps")).alias("steps"),
        F.col("_done").alias("done"),
        F.least("low", "_low").alias("low"),
    )
    return current.filter("done").unionByName(moved)


def path_pieces(path: DataFrame, reads: DataFrame) -> DataFrame:
    """``path`` with ``piece``: what each read adds, and ``offset``: where on the path.

    The first read adds itself, later ones their overhang; reads on the other
    strand are reverse complemented first. ``reads`` holds trimmed sequences; a path
    that names a read without one is an error, as is an overhang beyond its read.
    """
    named = F.col("read_id").cast("string")
    turned = F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    added = F.when(F.col("pos") == 0, turned).otherwise(
        F.substring(turned, F.length("seq") - F.col("overhang") + 1, F.col("overhang"))
    )
    added = (
        F.when(F.col("seq").isNull(), F.raise_error(F.concat(F.lit("no sequence for read "), named)))
        .when((F.col("pos") > 0) & (F.col("overhang") > F.length("seq")), F.raise_error(F.concat(F.lit("overhang beyond read "), named)))
        .otherwise(added)
    )
    pieces = _met(path, reads.select("read_id", "seq"), "read_id", "left").select(*path.columns, added.alias("piece"))
    keys = ["component", "path_id"]
    sized = with_running_sum(
        pieces, "_end", F.length("piece").cast("bigint"), keys, ["pos"], choose_width(path, keys)
    )
    return sized.withColumn("offset", F.col("_end") - F.length("piece")).drop("_end")


def path_sequences(path: DataFrame, reads: DataFrame, segment_bases: int = SEGMENT_BASES) -> DataFrame:
    """(component, path_id, segment, n_reads, seq): the sequence of each path.

    A path longer than ``segment_bases`` comes as several segments whose
    sequences in order are the whole; a segment is the pieces starting in its
    stretch, so no group outgrows a row.
    """
    pieces = path_pieces(path, reads)
    in_order = F.sort_array(F.collect_list(F.struct("pos", "piece")))
    return (
        pieces.withColumn("segment", F.expr(f"offset div {int(segment_bases)}"))
        .groupBy("component", "path_id", "segment")
        .agg(
            F.count(F.lit(1)).alias("n_reads"),
            F.array_join(F.transform(in_order, lambda p: p["piece"]), "").alias("seq"),
        )
    )
