"""Secret scans: fixed patterns, and character Markov models.

Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples: what the fixed patterns find
in a bounded sample of rows is random, the other words there are ordinary. Any
long run of token characters outside the patterns' spans is compared under both, and
is reported if the log-likelihood ratio favours the random model clearly.

DataFrame functions only. Every row and its whole text is scanned; positions come from
the text between the matches, summed up per text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import bounded_sample_of_rows

#: The kinds in the order they are listed, their patterns, and the least
#: length of a finding. For assign the length is that of group 2. A pattern whose run
#: cannot start anew inside a failing match asks for the length itself.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_RUN = "[A-Za-z0-9+/_=-]"
#: Least length of a run that the models judge, and of a word that teaches the ordinary model;
#: such a word is shorter than a run, so no run that is itself in doubt teaches it.
RUN_LENGTH, WORD_LENGTH = 20, 6
LONG_RUN = rf"(?<!{_RUN}){_RUN}{{{RUN_LENGTH},}}"
WORD = rf"(?<!{_RUN}){_RUN}{{{WORD_LENGTH},{RUN_LENGTH - 1}}}(?!{_RUN})"
MAX_ROWS = 20_000
#: Added to every transition of either model.
SMOOTH = 0.5
#: Least log-likelihood ratio, whole and per transition.
MIN_TOTAL, MIN_MEAN = 8.0, 0.9
_STATES = len(ALPHABET) + 1


def _pairs(token: Column) -> Column:
    """Numbers of the transitions between neighbouring characters; 0 stands for a character outside the alphabet."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * _STATES + b)


def _hits(text: Column, kind: int, pattern: str) -> Column:
    """Matches of a pattern as structs kind, nth, gap (characters since the last match), size, hit, body."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern == ASSIGN else hits
    made = F.transform(
        F.arrays_zip(between.alias("between"), hits.alias("hits"), bodies.alias("bodies")),
        lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(m["between"]).cast("long").alias("gap"), F.length(m["hits"]).cast("long").alias("size"), m["hits"].alias("hit"), m["bodies"].alias("body")),
    )
    # the text after the last match has no match of its own
    return F.when(text.rlike(pattern), F.slice(made, 1, F.size(hits)))


def _found(docs: DataFrame, kinds: list[tuple[int, str]]) -> DataFrame:
    """_id, _hash (of the text), kind, start, end, body of every match; positions in code points."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    nothing = "array<struct<kind:int,nth:int,gap:bigint,size:bigint,hit:string,body:string>>"
    hits = F.concat(*[F.coalesce(_hits(F.col("_text"), k, p), F.array().cast(nothing)) for k, p in kinds])
    # rows that repeat an id and a text share their findings
    hits = rows.select("_id", "_hash", F.explode(hits).alias("_m")).select("_id", "_hash", "_m.*").dropDuplicates(["_id", "_hash", "kind", "nth"])
    upto = Window.partitionBy("_id", "_hash", "kind").orderBy("nth")
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    return placed.select("_id", "_hash", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "body").where((F.col("kind") != 0) | (F.length("body") >= ASSIGN_LENGTH))


BASE = [(0, ASSIGN), (1, ACCESS), (2, HEX)]


def _apart(found: DataFrame) -> DataFrame:
    """The rows of the fixed kinds, and those others that touch none of them."""
    base = F.col("kind") < 3
    # both frames only grow, so a text with many findings takes linear time
    whole = Window.partitionBy("_id", "_hash")
    before = F.max(F.when(base, F.col("end"))).over(whole.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(whole.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    marked = found.withColumns({"_before": before, "_after": after})
    clash = (F.coalesce("_before", F.lit(-1)) > F.col("start")) | (F.coalesce("_after", F.lit(1 << 62)) < F.col("end"))
    return marked.where(base | ~clash).drop("_before", "_after")


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> list[float]:
    """Log-likelihood ratio of each transition, random over ordinary, as one flat table.

    A string teaches each of its transitions once, so that no long one drowns the others.
    Without samples both models are uniform and every ratio is 0.
    """
    sample = bounded_sample_of_rows(docs.select("doc_id", "text"), max_rows)
    known = _apart(_found(sample, [*BASE, (3, WORD)]))
    counts = known.select((F.col("kind") < 3).alias("random"), F.explode(F.array_distinct(_pairs(F.col("body")))).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n")).collect()
    ratio = [0.0] * (_STATES * _STATES)
    for random in (True, False):
        n = [SMOOTH] * (_STATES * _STATES)
        for r in counts:
            if r.random == random:
                n[r.pair] += r.n
        for a in range(_STATES):
            row = sum(n[a * _STATES : (a + 1) * _STATES])
            for b in range(_STATES):
                ratio[a * _STATES + b] += (1 if random else -1) * math.log(n[a * _STATES + b] / row)
    return ratio


def ratio_of(token: Column, ratio: list[float]) -> Column:
    """Whole log-likelihood ratio of a token."""
    table = F.array(*[F.lit(x) for x in ratio])
    return F.aggregate(_pairs(token), F.lit(0.0), lambda total, pair: total + F.element_at(table, pair + 1))


def scan(docs: DataFrame, ratio: list[float]) -> DataFrame:
    """_id, _hash, kind, start, end of all findings: the fixed kinds, and runs the models find random."""
    found = _apart(_found(docs, [*BASE, (3, LONG_RUN)]))
    steps = F.length("body") - 1
    total = F.when(F.col("kind") == 3, ratio_of(F.col("body"), ratio))
    judged = found.withColumn("_ratio", total)
    return judged.where((F.col("kind") < 3) | ((F.col("_ratio") >= MIN_TOTAL) & (F.col("_ratio") >= MIN_MEAN * steps))).drop("_ratio", "body")


def secrets(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov: one row per row of ``docs``.

    Null texts are empty and have no span; base_sha256 is then that of an empty string.
    Repeated rows are repeated; null ids are matched by their texts.
    """
    found = scan(docs, train(docs, max_rows))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    spans = found.groupBy("_id", "_hash").agg(
        *[F.sum((F.col("kind") == i).cast("long")).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("span")))).alias("_spans"),
    )
    joined = lambda keep: F.array_join(F.transform(F.filter("_spans", keep), lambda s: s["span"]), ",")
    spans = spans.withColumns({"_base": joined(lambda s: s["kind"] < 3), "spans": joined(lambda s: F.lit(True))}).drop("_spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("_text_hash"))
    out = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_markov", F.lit(0).cast("long")).alias("n_markov"),
    )
