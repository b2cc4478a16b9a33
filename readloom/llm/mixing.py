"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent between 0 (all
sources alike) and 1 (as they are). The exponent is bisected, 64 ways a step, until
the weights' entropy meets a target or no source repeats more often than a limit;
a step is one aggregate over the source table, of which only 65 numbers reach the
driver.

The weights become a token quota per source. Each source's rows lie in blocks, by a
hash of their ids and texts; an epoch is a permutation of the blocks (another one each epoch),
and the last epoch stops where the quota is met. A row's place in its source's
stream also gives its place in the output, so every stretch of the output holds the
sources at their weights.

DataFrame functions only. Blocks have about ``block_rows`` rows at every size, so a
source with most of the rows is many blocks, never one task, whatever its ids: rows
equal in id and text, where more than a block of them exist, are dealt out by a row
number that is written once with the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import cut_lineage, packed
from readloom.llm.exact_dedup import normalised

BLOCK_ROWS = 1_000
#: Tokens in a block of the output.
OUTPUT_BLOCK = 1 << 20
WAYS, STEPS = 64, 5
SEED = 11


def word_tokens(text: Column) -> Column:
    """Words of a text, and one for its end; null counts as empty."""
    flat = F.trim(normalised(text))
    return F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + F.when(flat == "", 1).otherwise(2).cast("long")


def _source_key(source: Column) -> Column:
    """A key that is never null: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def fit_exponent(sources: DataFrame, entropy: float | None = None, repeat: float | None = None) -> float:
    """The exponent that meets the given conditions on a table with ``_tokens`` per source.

    ``entropy``: share of the largest possible entropy to reach (0 to 1). ``repeat``:
    how often the most repeated source may be read for each reading of the least
    repeated; alone, it asks for the flattest weights within the limit. With both, the
    repeat limit wins where they conflict. Neither, no source, or equal sources: 1.
    """
    facts = sources.agg(F.count("*").alias("n"), F.sum("_tokens").alias("total"), F.max("_tokens").alias("most"), F.min("_tokens").alias("least")).first()
    if not facts.n or facts.n == 1 or facts.most == facts.least:
        return 1.0
    share = F.col("_tokens") / F.lit(float(facts.total))

    def entropies(at: list[float]) -> list[float]:
        power = [F.pow(share, F.lit(a)) for a in at]
        sums = [x for p in power for x in (F.sum(p), F.sum(p * F.log(p)))]
        got = sources.agg(*sums).first()
        return [math.log(got[2 * i]) - got[2 * i + 1] / got[2 * i] for i in range(len(at))]

    def narrowed(holds) -> float:
        """Largest exponent for which ``holds``, true at 0 and false at 1."""
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            at = [low + (high - low) * i / WAYS for i in range(WAYS + 1)]
            met = holds(at)
            last = max((i for i in range(WAYS + 1) if met[i]), default=0)
            low, high = at[last], at[min(last + 1, WAYS)]
            if low == high:
                break
        return low

    exponent = 1.0 if repeat is None else 0.0
    if entropy is not None:
        exponent = narrowed(lambda at: [h >= entropy * math.log(facts.n) for h in entropies(at)])
    if repeat is not None:
        # repeats of a source, against the largest one: (most / tokens) ** (1 - exponent); smallest exponent within the limit
        spread = facts.most / facts.least
        if spread ** (1 - exponent) > repeat:
            exponent = 1 - narrowed(lambda at: [spread**a <= repeat for a in at])
    return exponent


def quotas(docs: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """_source, _tokens, _weight, _quota of a table with _source and _tokens per source.

    Without a budget, the quotas are the least ones at these weights that read every
    row at least once.
    """
    facts = docs.agg(F.sum("_tokens").alias("total"), F.max("_tokens").alias("most")).first()
    total = float(facts.total or 1)
    powers = docs.withColumn("_power", F.pow(F.col("_tokens") / F.lit(total), F.lit(exponent)))
    norm = powers.agg(F.sum("_power").alias("s"), F.max(F.col("_tokens") / F.col("_power")).alias("need")).first()
    each = float(norm.need or 1.0) if budget is None else budget / float(norm.s or 1.0)
    return powers.select("_source", "_tokens", (F.col("_power") / F.lit(float(norm.s or 1.0))).alias("_weight"), F.ceil(F.round(F.col("_power") * F.lit(each), 3)).alias("_quota"))


def _dealt(docs: DataFrame, text: str, doc_id: str, source: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """_row, _source, _tokens, _key, _bin of every row; _source, _bin, _tokens of every block."""
    content = F.col(f"`{text}`").cast("string")
    rows = docs.select(packed(docs).alias("_row"), _source_key(F.col(f"`{source}`")).alias("_source"), word_tokens(content).alias("_tokens"), F.xxhash64(F.col(f"`{doc_id}`").cast("string"), content, F.lit(SEED)).alias("_key"))
    bins = max(1, -(-docs.count() // block_rows))
    in_blocks = lambda df: df.withColumn("_bin", F.pmod("_key", F.lit(bins)))
    sizes = lambda df: cut_lineage(in_blocks(df.select("_source", "_tokens", "_key")).groupBy("_source", "_bin").agg(F.sum("_tokens").alias("_tokens"), F.count("*").alias("_n")))
    blocks = sizes(rows)
    if blocks.where(F.col("_n") > 2 * block_rows).head(1):
        hot = cut_lineage(rows.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows))
        if hot.head(1):
            numbered = cut_lineage(rows.withColumn("_no", F.monotonically_increasing_id()))
            own = F.when(F.col("_n").isNull(), F.col("_key")).otherwise(F.xxhash64("_key", "_no"))
            rows = numbered.join(hot, "_key", "left").select("_row", "_source", "_tokens", own.alias("_key"))
            blocks = sizes(rows)
    return in_blocks(rows), blocks.drop("_n")


def mix(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    entropy: float | None = None,
    repeat: float | None = 2.0,
    budget: float | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """_row (all columns of ``docs``), _source, _tokens, _epoch, _start (tokens before it in its
    source's stream), _quota, _block and _place (its place in the output).

    A row comes once per epoch it is read in; rows beyond the quota do not come. Null
    sources are one source; null ids, repeated rows and empty texts are rows like any
    other. The row that crosses the quota is the last one of its source.
    """
    rows, blocks = _dealt(docs, text, doc_id, source, block_rows)
    sources = cut_lineage(blocks.groupBy("_source").agg(F.sum("_tokens").alias("_tokens")))
    wanted = quotas(sources, fit_exponent(sources, entropy, repeat), budget)
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_quota") / F.col("_all")) - 1, F.lit(0).cast("long"))))
    read = blocks.join(wanted.withColumnRenamed("_tokens", "_all"), "_source").select("_source", "_bin", "_tokens", "_all", "_quota", epochs.alias("_epoch"))
    order = Window.partitionBy("_source", "_epoch").orderBy(F.xxhash64("_bin", "_epoch", F.lit(SEED)), "_bin").rowsBetween(Window.unboundedPreceding, -1)
    read = read.select("_source", "_bin", "_epoch", "_quota", (F.col("_epoch") * F.col("_all") + F.coalesce(F.sum("_tokens").over(order), F.lit(0))).alias("_before"))
    read = cut_lineage(read.where("_before < _quota"))
    total = wanted.agg(F.sum("_quota")).first()[0] or 1
    inside = Window.partitionBy("_source", "_bin").orderBy("_key", "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("_tokens").over(inside), F.lit(0)))
    out = placed.join(read, ["_source", "_bin"]).withColumn("_start", F.col("_before") + F.col("_inside")).where("_start < _quota")
    middle = F.least((F.col("_start") + F.col("_tokens") / 2) / F.col("_quota"), F.lit(1.0))
    last = F.lit(max(0, -(-int(total) // OUTPUT_BLOCK) - 1))
    return out.select(
        "_row", "_source", "_tokens", "_epoch", "_start", "_quota", F.least(F.floor(middle * (last + 1)), last).alias("_block"), F.xxhash64("_key", "_epoch", F.lit(SEED + 1)).alias("_place")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, epoch, n_tokens, start, quota, block, place: one row per reading of a row."""
    return mix(docs.select("doc_id", "text", "source"), **options).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"), F.col("_start").alias("start"), F.col("_quota").alias("quota"), F.col("_block").alias("block"), F.col("_place").alias("place")
    )


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, once per reading, with their columns only."""
    out = mix(docs, **options)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
