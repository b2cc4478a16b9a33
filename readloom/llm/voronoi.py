"""Exact top-k inner products by a Voronoi kNN join.

Largest inner products become nearest neighbours in one more dimension: a data vector
s gets the coordinate sqrt(M - |s|^2), M the largest squared norm, a query gets 0; then
the squared distance is |q|^2 + M - 2 q.s, and the order of distances is the order of
products. Pivots cut both sides into Voronoi cells. From a summary of the cells (each
pivot's distances to its nearest members) follows, for every query, a distance within
which enough data lie; from a summary of the query groups (largest such distance, and
the range of distances to each pivot) follows which data vectors a group can need, by
the triangle inequality. Only those are sent to it. Groups that need much the same data
are joined, so that these are copied once per block of queries and not once per group; a
bounded sample of the data decides on that, and no result depends on it. Joined groups
are solved in bounded blocks of queries against bounded chunks of data, in whole
numbers, and the blocks' best are merged.

Equal vectors are folded: per vector only the k + 1 smallest ids can be needed. An id may
have several vectors. A list from which any one id can be struck and k entries stay
needs at most k entries of each id, and 2 k in all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import batches, cut_lineage

K = 20
K_PLUS = K + 1
SCALE = 64
PIVOTS = 32
#: Data vectors by which groups that need the same data are found.
SAMPLE = 2_048
#: Most queries and data vectors in a block, on average.
QUERY_BLOCK, DATA_CHUNK = 16_384, 16_384
_SLICE, _TILE = 2_048, 1_024
_SLACK = 1e-6


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """_id and _vec, whole numbers floor(SCALE * x), all of one length.

    Vectors that are null, hold a null or a non-finite component, or have no id take no
    part. Shorter vectors are filled up with zeros, which leaves products as they are.
    """
    parts = F.col("_parts")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("_id"), F.col(f"`{embedding}`").cast("array<double>").alias("_parts"))
    rows = rows.where(F.col("_id").isNotNull() & parts.isNotNull() & F.forall(parts, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    width = rows.agg(F.max(F.size("_parts"))).first()[0] or 0
    whole = F.transform(parts, lambda x: F.floor(x * float(SCALE)))
    return rows.select("_id", F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("_parts"))).alias("_vec"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _distances(points: np.ndarray, pivots: np.ndarray, top: float, lift: bool) -> np.ndarray:
    """From points (data if ``lift``, else queries) to pivots, in one more dimension."""
    norm = (points * points).sum(1)
    high = np.sqrt(np.maximum(top - norm, 0)) if lift else np.zeros(len(points))
    of_pivot = (pivots * pivots).sum(1)
    pivot_high = np.sqrt(np.maximum(top - of_pivot, 0))
    square = norm[:, None] + of_pivot[None, :] - 2 * points @ pivots.T + (high[:, None] - pivot_high[None, :]) ** 2
    return np.sqrt(np.maximum(square, 0))


def _place(*keys: np.ndarray) -> np.ndarray:
    """Place of each entry among the entries before it with equal ``keys``; equal ones lie together."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    start = np.flatnonzero(fresh)
    return np.arange(len(fresh)) - np.repeat(start, np.diff(np.append(start, len(fresh))))


def best_of(queries: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and product of each query's best, ties to the smaller id; exact.

    Whatever one id is struck from a query's list, its first ``k`` are the best that are left.
    """
    order = np.argsort(ids, kind="stable")
    data, ids = data[order], ids[order]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    kind = np.float64 if bound < 2**53 else np.int64
    queries, data = queries.astype(kind), data.astype(kind)
    copies = int(_place(ids).max(initial=0)) + 1
    full = k + min(k, copies)
    row, name, score = (np.zeros(0, np.int64) for _ in range(3))
    least = np.full(len(queries), np.iinfo(np.int64).min)
    for at in range(0, len(data), _TILE):
        product = (queries @ data[at : at + _TILE].T).astype(np.int64)
        # later ids lose ties, so only a larger product can enter a full list
        r, c = np.nonzero((product > least[:, None]) | (least[:, None] == np.iinfo(np.int64).min))
        if not len(r):
            continue
        row, name, score = np.concatenate((row, r)), np.concatenate((name, ids[at + c])), np.concatenate((score, product[r, c]))
        if copies > k:
            sort = np.lexsort((-score, name, row))
            sort = sort[_place(row[sort], name[sort]) < k]
            row, name, score = row[sort], name[sort], score[sort]
        sort = np.lexsort((name, -score, row))
        row, name, score = row[sort], name[sort], score[sort]
        place = _place(row)
        least[row[place == full - 1]] = score[place == full - 1]
        keep = place < full
        row, name, score = row[keep], name[keep], score[keep]
    return row, name, score


def _solve(_: tuple, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
    found = []
    if len(queries) and len(data):
        copies = data["_ids"].map(len).to_numpy()
        matrix, ids = np.stack(data["_vec"].to_numpy())[np.repeat(np.arange(len(data)), copies)], np.concatenate(data["_ids"].to_numpy())
        for at in range(0, len(queries), _SLICE):
            some = queries.iloc[at : at + _SLICE]
            row, name, score = best_of(np.stack(some["_vec"].to_numpy()), matrix, ids, K)
            found.append(pd.DataFrame({"_rep": some["_rep"].to_numpy()[row], "_id": name, "_score": score}))
    return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("_rep", "_id", "_score")})


def joined_groups(needs: np.ndarray, sizes: list[int], query_block: int) -> list[list[int]]:
    """Groups joined as long as that saves copies of data and products.

    ``needs`` has a row per sampled data vector and a column per group. Data that a joined
    group needs are copied once per block, and meet all its queries.
    """
    def cost(need: np.ndarray, queries: int) -> float:
        return float(need.sum()) * (-(-queries // query_block) + queries / query_block)

    joined: list[tuple[np.ndarray, int, list[int]]] = []
    for group in sorted(range(len(sizes)), key=lambda g: -sizes[g]):
        need, n = needs[:, group], sizes[group]
        gains = [cost(other, m) + cost(need, n) - cost(other | need, m + n) for other, m, _ in joined]
        best = int(np.argmax(gains)) if gains else -1
        if best >= 0 and gains[best] > 0:
            other, m, members = joined[best]
            joined[best] = (other | need, m + n, [*members, group])
        else:
            joined.append((need, n, [group]))
    return [members for _, _, members in joined]


def top_k(vectors: DataFrame, every: int = 20, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, data_chunk: int = DATA_CHUNK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the K largest products of each vector whose id is divisible by ``every``.

    Rows with another id are candidates; ties go to the smaller id. Rows that repeat an id count
    as one per different vector: each is a query of its own, and a candidate of its own.
    Vectors and ids that are null, and vectors with null or non-finite components, take no
    part. Fewer candidates give fewer rows; an empty table none. Other columns, whatever
    their names, are not read. Products must fit 64 bits.
    """
    rows = quantised(vectors, vec_id, embedding)
    ranked = rows.distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("_vec").orderBy("_id"))).where(F.col("_rank") <= K_PLUS)
    data = cut_lineage(ranked.groupBy("_vec").agg(F.array_sort(F.collect_list("_id")).alias("_ids")).withColumn("_rep", F.monotonically_increasing_id()))
    asked = cut_lineage(rows.where(F.col("_id") % every == 0).distinct().join(data.select("_vec", "_rep"), "_vec").select(F.col("_id").alias("query_id"), "_rep"))
    facts = data.agg(F.count("*").alias("n"), F.max(F.aggregate("_vec", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).first()
    drawn = data.orderBy(F.xxhash64("_vec"), "_vec").limit(max(pivots, SAMPLE)).select("_vec").collect()  # SAMPLE rows
    if not facts.n:
        return asked.select("query_id", F.lit(0).alias("rank"), F.col("_rep").alias("vec_id"), F.col("_rep").alias("score"))
    sample, top = np.array([r[0] for r in drawn], np.float64).reshape(len(drawn), -1), float(facts.top)
    points = sample[:pivots]

    def to_cells():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            far = _distances(_matrix(batch.column(1)), points, top, True)
            cell = far.argmin(1)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], ["_first", "_cell", "_far"])

        return step

    # of the vectors whose smallest id is the same one counts, so that striking an id costs one at most
    cells = batches(data.select(F.array_min("_ids").alias("_first"), "_vec"), to_cells, "_first long, _cell int, _far double")
    cells = cells.groupBy("_first").agg(F.min(F.struct("_far", "_cell")).alias("_least")).select("_least.*")
    nearest = cells.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_far"))).where(F.col("_rank") <= K_PLUS).collect()  # K_PLUS per pivot
    near = [np.array(sorted(r._far for r in nearest if r._cell == j)) for j in range(len(points))]

    def to_groups():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            far = _distances(_matrix(batch.column(1)), points, top, False)
            reach = np.sort(np.concatenate([far[:, j : j + 1] + near[j][None, :] for j in range(len(points)) if len(near[j])], axis=1), axis=1)
            # with fewer data than that, all are needed
            enough = reach[:, K_PLUS - 1] if reach.shape[1] >= K_PLUS else np.full(len(far), np.inf)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(far.argmin(1).astype(np.int32)), pa.array(enough), pa.FixedSizeListArray.from_arrays(pa.array(far.reshape(-1)), len(points)).cast(pa.list_(pa.float64()))], ["_rep", "_vec", "_group", "_enough", "_far"]
            )

        return step

    questions = data.join(asked.select("_rep").distinct(), "_rep", "left_semi").select("_rep", "_vec")
    grouped = cut_lineage(batches(questions, to_groups, "_rep long, _vec array<long>, _group int, _enough double, _far array<double>"))
    ranges = [f(F.element_at("_far", j + 1)).alias(f"{n}{j}") for j in range(len(points)) for n, f in (("low", F.min), ("high", F.max))]
    groups = grouped.groupBy("_group").agg(F.count("*").alias("n"), F.max("_enough").alias("enough"), *ranges).collect()  # one row per pivot
    chunks = -(-facts.n // data_chunk)
    bounds = [(g.enough, np.array([g[f"low{j}"] for j in range(len(points))]), np.array([g[f"high{j}"] for j in range(len(points))])) for g in groups]

    def needs(far: np.ndarray) -> np.ndarray:
        """Whether a data vector (row) may be among the best of a query of a group (column)."""
        out = np.ones((len(far), len(bounds)), bool)
        for at, (enough, low, high) in enumerate(bounds):
            if np.isfinite(enough):
                out[:, at] = np.maximum(low[None, :] - far, far - high[None, :]).max(1) <= enough + _SLACK * (1 + enough)
        return out

    joined = joined_groups(needs(_distances(sample, points, top, True)), [g.n for g in groups], query_block)
    blocks = [-(-sum(groups[at].n for at in members) // query_block) for members in joined]

    def to_askers():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            need = needs(_distances(_matrix(batch.column(1)), points, top, True))
            target, row = np.nonzero(np.array([need[:, members].any(1) for members in joined]).reshape(len(joined), len(need)))
            at = pa.array(row)
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(target.astype(np.int32))], ["_rep", "_vec", "_ids", "_group"])

        return step

    def looked_up(pairs: list[tuple[int, int]]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in pairs or [(0, 1)] for x in pair]), F.col("_group"))

    n_blocks = looked_up(list(enumerate(blocks)))
    grouped = grouped.withColumn("_group", looked_up([(groups[at]._group, to) for to, members in enumerate(joined) for at in members]))
    sent = batches(data.select("_rep", "_vec", "_ids"), to_askers, "_rep long, _vec array<long>, _ids array<long>, _group int")
    sent = sent.withColumn("_chunk", F.pmod(F.xxhash64("_rep"), F.lit(chunks))).withColumn("_block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    asking = grouped.select("_rep", "_vec", "_group", F.pmod(F.xxhash64("_rep"), n_blocks).cast("int").alias("_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("_chunk"))
    keys = ["_group", "_block", "_chunk"]
    solved = asking.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(_solve, "_rep long, _id long, _score long")
    # K of each id, then 2 K: whatever id is struck, K are left
    of_id, best = Window.partitionBy("_rep", "_id").orderBy(F.desc("_score")), Window.partitionBy("_rep").orderBy(F.desc("_score"), "_id")
    merged = solved.repartition("_rep").withColumn("_rank", F.row_number().over(of_id)).where(F.col("_rank") <= K)
    merged = cut_lineage(merged.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= 2 * K).drop("_rank"))
    answers = asked.join(merged, "_rep").where("query_id <> _id")
    own = Window.partitionBy("query_id", "_rep").orderBy(F.desc("_score"), "_id")
    return answers.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= K).select("query_id", "rank", F.col("_id").alias("vec_id"), F.col("_score").alias("score"))
