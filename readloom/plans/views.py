"""The data model's tables, derived from the test tables.

Every view covers its whole source table. ``oracle.py`` has the same views in
SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import schemas
from readloom.functions.sequence import dna_only, seq_length
from readloom.operators.blocks import block_pairs
from readloom.sources.tables import spread


class Tables:
    """Test tables and views of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # Reads: one per document, nucleotide letters of its text.

    def documents(self) -> DataFrame:
        """Documents over all cores: their text is worked on long before any shuffle."""
        return spread(self.table("documents").select("doc_id", "text"), "doc_id")

    def reads(self) -> DataFrame:
        return self.documents().select(F.col("doc_id").alias("id"), dna_only(F.col("text")).alias("seq"))

    def read_lengths(self) -> DataFrame:
        return self.reads().select("id", seq_length(F.col("seq")).alias("len"))

    def targets(self) -> DataFrame:
        return self.documents().select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))

    def references(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("seq"))

    # Subreads: an event opens an interval at its second, of its value in minutes.

    def subreads(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("cell"),
            F.col("user_id").alias("hole"),
            _second("ts").alias("qs"),
            (_second("ts") + F.floor("value") * 60).cast("bigint").alias("qe"),
        )

    def header_lines(self) -> DataFrame:
        """Headers as text; those of error events have a hyphen where an underscore belongs."""
        joint = F.when(F.col("cell") == "error", F.lit("-")).otherwise(F.lit("_"))
        line = F.concat(
            F.lit(">"), "cell", F.lit("/"), F.col("hole").cast("string"), F.lit("/"),
            F.col("qs").cast("string"), joint, F.col("qe").cast("string"), F.lit(" extra"),
        )
        return self.subreads().select(line.alias("line"))

    # Accounting and samples: customers are jobs, their events are samples.

    def accounting(self) -> DataFrame:
        key = F.col("c_custkey").cast("string")
        stepped = F.col("c_mktsegment") == "MACHINERY"
        suffix = F.when(stepped, F.lit(".extern")).otherwise(F.lit(".batch"))
        joint = F.when(F.col("c_acctbal") < 0, F.lit("-")).otherwise(F.lit("_"))
        return self.table("customer").select(
            F.concat(F.col("c_nationkey").cast("string"), joint, key, suffix).alias("job_task"),
            F.concat(key, suffix).alias("job_raw"),
            _node("c_custkey").alias("node"),
            F.lit("main").alias("cluster"),
            F.concat(F.col("c_nationkey").cast("string"), F.lit("M")).alias("disk_read"),
            F.concat(F.length("c_name").cast("string"), F.lit("M")).alias("disk_write"),
            F.concat(F.lit("00:"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(":00")).alias("elapsed"),
            F.lit("COMPLETED").alias("state"),
        )

    def repeated_jobs(self) -> DataFrame:
        """A record per order; a customer's orders are records of one job, in the order of their ids."""
        return self.table("orders").select(
            F.col("o_custkey").cast("string").alias("job_raw"), F.col("o_orderstatus").alias("state"),
            F.col("o_orderkey").alias("place"),
        )

    def samples(self) -> DataFrame:
        value = F.col("value")
        two = F.array(value, value * 2)
        four = F.array(value, value * 2, value * 4, value * 8)
        return self.table("events").select(
            F.lit("main").alias("cluster"),
            _node("user_id").alias("node"),
            F.col("user_id").cast("string").alias("job_raw"),
            F.col("event_type").alias("localtime"),
            _second("ts").alias("raw_time"),
            F.lit(128.0).alias("mem_limit_gb"),
            value.alias("mem_used_gb"),
            F.lit(0.0).alias("swap_used_gb"),
            F.when(F.col("event_type") == "error", two).otherwise(four).alias("cores"),
        )

    # Work: a pairwise plan whose first items are the orders, one each, which give the status.

    def blocks(self) -> DataFrame:
        """The fewest blocks with a pair for every order, so the plan grows with them and uses all."""
        n_orders = F.count(F.lit(1))
        n = F.ceil((F.sqrt(n_orders * 8 + 1) - 1) / 2).cast("bigint")
        counted = self.table("orders").agg(n.alias("n"))
        return counted.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("block_id"))

    def work(self) -> DataFrame:
        """The plan half way: the first four rounds of pairs are complete.

        Spark takes the plan, rows made from one row, for a tiny table; the join is not left to that.
        """
        plan = block_pairs(self.blocks())
        n = self.blocks().select(F.count(F.lit(1))).scalar()
        orders = self.table("orders").select(
            (F.col("o_orderkey") + 1).alias("rowid"), "o_orderstatus", "o_custkey", "o_orderpriority"
        )
        later = (
            F.when(F.col("o_orderstatus") == "F", F.lit(schemas.FAILED))
            .when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), F.lit(schemas.RUNNING))
            .when(F.col("o_orderstatus") == "P", F.lit(schemas.RESERVED))
            .otherwise(F.lit(schemas.NOTSTARTED))
        )
        status = F.when(F.col("rowid") <= n * 4, F.lit(schemas.COMPLETED)).otherwise(later)
        token = F.concat(F.md5(F.col("o_custkey").cast("string")), F.lit("_1"))
        started = F.col("status") != schemas.NOTSTARTED
        return (
            plan.hint("merge").join(orders, "rowid")
            .withColumn("status", status)
            .select(
                "rowid", "block_id1", "block_id2", "priority", "status", "use_masking",
                F.when(started, F.concat(F.col("o_custkey").cast("string"), F.lit("_"), F.col("rowid").cast("string"))).alias("jobid"),
                F.when(started, token).alias("reservation_token"),
            )
        )

    def project(self) -> DataFrame:
        """One row: a project that began with the first order and was prepared with the last."""
        return self.table("orders").agg(
            F.lit("proj").alias("name"), F.min("o_orderdate").alias("started_on"), F.max("o_orderdate").alias("prepared_on")
        )

    # Task logs: one per user, a line per event, naming two rows.

    def log_lines(self) -> DataFrame:
        row = F.expr("event_id div 10")
        ids = F.concat_ws(" ", row.cast("string"), (row + 1).cast("string"))
        kind = F.col("event_type")
        text = (
            F.when(kind == "signup", F.concat(F.lit("[t] Starting job(s) "), ids, F.lit(": 1 vs 2 3")))
            .when(kind == "purchase", F.concat(F.lit("[t] Finished job(s) "), ids, F.lit(": 1 vs 2 3")))
            .when(kind == "click", F.concat(F.lit("[t] Failed job(s) "), ids, F.lit(": 1 vs 2 3")))
            .when(kind == "error", F.lit("slurmstepd: error: *** STEP CANCELLED ***"))
            .otherwise(F.lit("some other output"))
        )
        user = F.col("user_id").cast("string")
        name = F.concat(F.lit("array_"), F.md5(user), F.lit("_1_"), user, F.lit("_1.log"))
        return self.table("events").select(name.alias("file"), F.col("event_id").alias("line_no"), text.alias("line"))

    def requested(self) -> DataFrame:
        """Work rows asked about: one per ten events."""
        return self.table("events").select(F.expr("event_id div 10").alias("rowid")).distinct()

    # Files of block stages: an order is a file, written at its date.

    def inventory(self) -> DataFrame:
        block = (F.col("o_orderkey") + 1).cast("string")
        name = (
            F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("proj."), block, F.lit(".las")))
            .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit(".proj."), block, F.lit(".q.a2")))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit(".proj."), block, F.lit(".q.d2")))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit(".proj."), block, F.lit(".trim.a2")))
            .otherwise(F.concat(F.lit("proj."), block, F.lit(".stats.txt")))
        )
        size = F.when(F.col("o_orderstatus") == "P", F.lit(0)).otherwise(F.floor("o_totalprice"))
        return self.table("orders").select(
            F.concat(F.lit("file:/data/"), name).alias("path"),
            size.cast("bigint").alias("size"),
            F.col("o_orderdate").alias("mtime"),
        )

    def file_blocks(self) -> DataFrame:
        return self.table("orders").select((F.col("o_orderkey") + 1).alias("block_id"))

    # Overlaps: a line item is an overlap of its part with its line number's part.

    def overlap(self) -> DataFrame:
        item = self.table("lineitem").select(
            F.col("l_partkey").alias("a"),
            F.col("l_linenumber").cast("bigint").alias("b"),
            F.when(F.col("l_returnflag") == "R", F.lit("-")).otherwise(F.lit("+")).alias("strand"),
            F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("bigint").alias("ab"),
            (F.col("l_quantity").cast("bigint") * 40).alias("_len"),
            F.round(F.col("l_discount") * 100).cast("bigint").alias("_pct"),
            "l_suppkey",
        )
        return item.select(
            "a", "b", "strand",
            "ab", (F.col("ab") + F.col("_len")).alias("ae"),
            (F.col("ab") + F.col("b") * 5).alias("bb"), (F.col("ab") + F.col("b") * 5 + F.col("_len")).alias("be"),
            F.lit(4400).cast("bigint").alias("a_len"), F.lit(4400).cast("bigint").alias("b_len"),
            F.expr("_len * _pct * 4 div 100").alias("diffs"),
            F.col("l_suppkey").alias("block"),
        )

    def shifted_overlap(self) -> DataFrame:
        """Overlaps on up to three diagonals a pair: chains that interleave, and overlaps inside others."""
        shift = F.col("diffs") % 3 * 700
        return self.overlap().withColumns({"bb": F.col("bb") + shift, "be": F.col("be") + shift, "block": F.lit(1).cast("bigint")})

    def parts(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("read_id"))

    def part_trim(self) -> DataFrame:
        """A trim per part, by its size."""
        return self.table("part").select(
            F.col("p_partkey").alias("read_id"), F.lit("trim").alias("kind"),
            (F.col("p_size") * 10).cast("bigint").alias("b"),
            (4400 - F.col("p_size") * 5).cast("bigint").alias("e"),
        )

    def document_mask(self) -> DataFrame:
        """A mask per document: the first fifth of its sequence."""
        return self.read_lengths().select(
            F.col("id").alias("read_id"), F.lit("mask").alias("kind"), F.lit(0).cast("bigint").alias("b"), F.expr("len div 5").alias("e")
        )

    def document_trim(self) -> DataFrame:
        """A trim per document: a tenth off the front of its sequence, a twentieth off the end."""
        return self.read_lengths().select(
            F.col("id").alias("read_id"), F.lit("trim").alias("kind"),
            F.expr("len div 10").alias("b"), F.expr("len - len div 20").alias("e"),
        )

    # A read layout: an order lies on its customer's time line, as long as its price in days.

    def layout(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("line"),
            F.col("o_orderkey").alias("read_id"),
            F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("bigint").alias("b"),
            (F.floor(F.col("o_totalprice") / 500) + 30).cast("bigint").alias("len"),
        )

    def layout_reads(self) -> DataFrame:
        letters = F.translate(F.md5(F.col("read_id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
        return self.layout().select("read_id", F.substring(F.repeat(letters, 40), F.lit(1), F.col("len")).alias("seq"))

    def layout_overlap(self) -> DataFrame:
        """All overlaps of two orders on their customer's line; odd orders lie there turned round.

        An order is named in each stretch of the line it touches, and meets the
        orders that start there, so a pair meets once. Spark's estimate of a table's
        size does not see that rows are named several times, so the join is not left to it.
        """
        stretch = lambda day: F.floor(day / 64)
        start, end = F.col("b"), F.col("b") + F.col("len")
        place = F.struct("b", "read_id", "len", (F.col("read_id") % 2 == 1).alias("back"))
        left = self.layout().select("line", F.explode(F.sequence(stretch(start), stretch(end - 1))).alias("_at"), place.alias("x"))
        right = self.layout().select("line", stretch(start).alias("_at"), place.alias("y"))
        x_end, y_end = F.col("x.b") + F.col("x.len"), F.col("y.b") + F.col("y.len")
        later = F.struct("y.b", "y.read_id") > F.struct("x.b", "x.read_id")
        met = left.hint("merge").join(right, ["line", "_at"]).filter(later & (F.col("y.b") < x_end))
        end = F.least(x_end, y_end)
        back = lambda turned, straight: F.when(F.col("x.back"), turned).otherwise(straight)
        zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
        return met.select(
            F.col("x.read_id").alias("a"), F.col("y.read_id").alias("b"),
            F.when(F.col("x.back") == F.col("y.back"), "+").otherwise("-").alias("strand"),
            back(x_end - end, F.col("y.b") - F.col("x.b")).alias("ab"),
            back(x_end - F.col("y.b"), end - F.col("x.b")).alias("ae"),
            back(y_end - end, zero).alias("bb"),
            back(F.col("y.len"), end - F.col("y.b")).alias("be"),
            F.col("x.len").alias("a_len"), F.col("y.len").alias("b_len"), zero.alias("diffs"), one.alias("block"),
        )


def _second(ts: str) -> Column:
    """Whole seconds since 2024-01-01."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})")


def _node(key: str) -> Column:
    return F.concat(F.lit("n"), F.substring(F.col(key).cast("string"), -1, 1))
