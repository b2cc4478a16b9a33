"""Tab-separated sources and sinks, text alignments, and file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import schemas
from readloom.sources import listing


def spread(table: DataFrame, key: str) -> DataFrame:
    """A table of too few files for the session's cores, over all of them.

    Only where the scan has fewer partitions than there are cores, so a large
    table is never shuffled for this.
    """
    if table.isStreaming:
        return table
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


def write_tsv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", header).csv(path)


def read_alignments(spark: SparkSession, directory: str, pattern: str = "*.sam") -> DataFrame:
    """(id, seq): column 1 and 10 of every text alignment under a directory."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(directory)
    )
    fields = F.split("value", "\t")
    return (
        lines.filter(~F.startswith("value", F.lit("@")) & (F.length("value") > 0))
        .select(fields.alias("_f"))
        .filter(F.size("_f") >= 10)
        .select(F.col("_f")[0].alias("id"), F.col("_f")[9].alias("seq"))
    )


def concat_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """One read set from several."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def read_accounting(spark: SparkSession, path: str) -> DataFrame:
    """Headerless accounting rows: eight tab-separated text fields."""
    return spark.read.schema(schemas.ACCOUNTING).option("sep", "\t").csv(path)


# Fixed value: telemetry files lie at .../<cluster>/.../<node>/<job id>.
SAMPLE_PATH = r"/([^/]+)/(?:[^/]+/)?([^/]+)/([0-9]+)$"


def read_telemetry(spark: SparkSession, directory: str, path_pattern: str = SAMPLE_PATH) -> DataFrame:
    """Samples with their cluster, node and job: groups 1 to 3 of the file path.

    Fields: time, raw time, memory limit, memory used, swap used, then one
    number per core. The title line is told by its raw time not being a number.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .text(directory)
        .select(F.col("_metadata.file_path").alias("_path"), F.split(F.trim("value"), r"\s+").alias("_f"))
    )
    samples = lines.filter(F.get("_f", F.lit(1)).try_cast("bigint").isNotNull() & (F.size("_f") >= 5))
    return samples.select(
        F.regexp_extract("_path", path_pattern, 1).alias("cluster"),
        F.regexp_extract("_path", path_pattern, 2).alias("node"),
        F.regexp_extract("_path", path_pattern, 3).alias("job_raw"),
        F.col("_f")[0].alias("localtime"),
        F.col("_f")[1].cast("bigint").alias("raw_time"),
        F.col("_f")[2].cast("double").alias("mem_limit_gb"),
        F.col("_f")[3].cast("double").alias("mem_used_gb"),
        F.col("_f")[4].cast("double").alias("swap_used_gb"),
        F.transform(F.slice("_f", 6, F.size("_f")), lambda x: x.cast("double")).alias("cores"),
    )


def file_inventory(spark: SparkSession, directory: str, pattern: str = "*", empty: bool = True) -> DataFrame:
    """(path, size, mtime) of every file below a directory; contents are never read.

    Empty files come with size 0, and hidden ones are listed too. The directory must be one that
    every executor can list under the same name. With ``empty=False`` Spark's own
    listing is used, for file systems only Spark can open: without empty or hidden files.
    """
    if empty:
        spark.dataSource.register(listing.FolderListing)
        return spark.read.format(listing.FORMAT).option("pattern", pattern).load(directory)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(directory)
    )
    return files.select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
    )


def read_task_logs(spark: SparkSession, directory: str) -> DataFrame:
    """(file, split_start, split_row, line): log lines with their place in the file.

    (split_start, split_row) is file order; split_start cuts a large log into
    chunks, so no operator needs the whole file in one task.
    """
    return spark.read.option("recursiveFileLookup", True).text(directory).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("split_row"),
        F.col("value").alias("line"),
    )
