"""Connected components of a link table by alternating stars.

Each round joins every node to the smallest node it can see; large stars hang the
larger neighbours of a node on its smallest one, small stars the smaller ones. The
rounds grow with the logarithm of the longest path. Minima are partial aggregates,
and the joins are plain ones, whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import cut_lineage, drop_table, scratch_path


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component), for every node in ``links`` (a, b); a = b is left out."""
    spark = links.sparkSession

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def smallest(df: DataFrame) -> tuple[DataFrame, str]:
        # written, so that the join with it is one of two plain shuffles
        path = scratch_path(spark)
        return cut_lineage(df.groupBy("u").agg(F.min("v").alias("m")), path), path

    path = scratch_path(spark)
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), path)
    before = mark(edges)
    while before[0]:
        spent = [path]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, used = smallest(both)
        spent.append(used)
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        spent.append(scratch_path(spark))
        large = cut_lineage(hung, spent[-1])
        least, used = smallest(large)
        spent.append(used)
        low = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        path = scratch_path(spark)
        edges = cut_lineage(low.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), path)
        now = mark(edges)
        for table in spent:
            drop_table(spark, table)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
