"""The registered queries in SQL, for checking results with another engine.

Written from the definitions, in the plain form one would use on small data: a
window over everything here is fine where the Spark side avoids it.
"""

from __future__ import annotations

from readloom.plans.catalog import (
    AS_OF,
    BLOCK_BASES,
    COVERAGE,
    CUTOFF,
    GENOME_SIZE,
    LONGEST,
    SKETCH,
)

# Views, each after those it uses.
VIEWS: dict[str, str] = {
    "reads": """SELECT doc_id AS id, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents""",
    # Whole words scrambled in a list, then folded; the tail word is scrambled but only xor-ed in.
    "words": """
        SELECT id, strlen(seq) AS n, list_transform(range(0, (strlen(seq) + 3) // 4), lambda i: CAST(
            greatest(0, ord(seq[4 * i + 1])) + greatest(0, ord(seq[4 * i + 2])) * 256 + greatest(0, ord(seq[4 * i + 3])) * 65536 + CAST(greatest(0, ord(seq[4 * i + 4])) AS BIGINT) * 16777216 AS UBIGINT)) AS word
        FROM reads""",
    "scrambled": """
        SELECT id, n, list_transform(word, lambda w: (((((w * 3432918353) & 4294967295) << 15) | (((w * 3432918353) & 4294967295) >> 17)) & 4294967295)
            * 461845907 & 4294967295) AS k FROM words""",
    "folded": """
        SELECT id, n, CASE WHEN n % 4 > 0 THEN xor(h, k[-1]) ELSE h END AS h FROM (SELECT *, list_reduce(
            list_prepend(CAST(314159265 AS UBIGINT), k[:n // 4]),
            lambda s, x: (((xor(s, x) << 13) | (xor(s, x) >> 19)) & 4294967295) * 5 + 3864292196 & 4294967295) AS h FROM scrambled)""",
    "hashes": """
        SELECT id, CAST(xor(h, h >> 16) AS BIGINT) AS hash FROM (SELECT id, xor(h, h >> 13) * 3266489909 & 4294967295 AS h FROM (
            SELECT id, xor(h, h >> 16) * 2246822507 & 4294967295 AS h FROM (SELECT id, xor(h, CAST(n AS UBIGINT)) AS h FROM folded)))""",
    "offsets": """
        SELECT id, strlen(seq) AS len, CAST(coalesce(sum(strlen(CAST(id AS VARCHAR)) + strlen(seq) + 3)
            OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM reads""",
    "targets": "SELECT doc_id AS id, text AS seq FROM documents",
    "refs": "SELECT item_id AS id, text AS seq FROM benchmark",
    "subreads": """
        SELECT event_type AS cell, user_id AS hole, s AS qs, s + CAST(floor(value) AS BIGINT) * 60 AS qe
        FROM (SELECT *, datediff('microsecond', TIMESTAMP '2024-01-01', ts) // 1000000 AS s FROM events)""",
    "header_lines": """
        SELECT '>' || cell || '/' || hole || '/' || qs || CASE WHEN cell = 'error' THEN '-' ELSE '_' END || qe || ' extra' AS line
        FROM subreads""",
    "pairs": """
        SELECT cell, hole, a_start, a_end, qs AS b_start, qe AS b_end, count(*) AS pairs
        FROM (SELECT *, lag(qs) OVER w AS a_start, lag(qe) OVER w AS a_end FROM subreads
              WINDOW w AS (PARTITION BY cell, hole ORDER BY qs, qe))
        WHERE a_start IS NOT NULL GROUP BY ALL""",
    "gaps": """
        SELECT *, CASE WHEN a_start < b_start THEN greatest(0, b_start - a_end)
                       ELSE greatest(0, a_start - b_end) END AS distance FROM pairs""",
    "target_sketch": f"""
        SELECT id, h FROM (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY h) AS r FROM (
            SELECT DISTINCT id, md5(substr(seq, unnest(range(1, length(seq) - {SKETCH.k} + 2)), {SKETCH.k})) AS h FROM targets))
        WHERE r <= {SKETCH.n}""",
    "ref_sketch": f"""
        SELECT id, h FROM (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY h) AS r FROM (
            SELECT DISTINCT id, md5(substr(seq, unnest(range(1, length(seq) - {SKETCH.k} + 2)), {SKETCH.k})) AS h FROM refs))
        WHERE r <= {SKETCH.n}""",
    "match": """
        SELECT t.id AS target_id, m.ref AS reference_id, coalesce(m.hits, 0) AS hits,
               coalesce(ts.n, 0) AS asize, coalesce(m.bsize, 0) AS bsize, coalesce(m.ji, 0.0) AS ji
        FROM targets t LEFT JOIN (SELECT id, count(*) AS n FROM target_sketch GROUP BY id) ts ON ts.id = t.id
        LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY target ORDER BY ji DESC, ref) AS r FROM (
                SELECT x.target, x.ref, x.hits, b.n AS bsize, CAST(x.hits AS DOUBLE) / (a.n + b.n - x.hits) AS ji
                FROM (SELECT ts.id AS target, rs.id AS ref, count(*) AS hits
                      FROM target_sketch ts JOIN ref_sketch rs ON ts.h = rs.h GROUP BY ALL) x
                JOIN (SELECT id, count(*) AS n FROM target_sketch GROUP BY id) a ON a.id = x.target
                JOIN (SELECT id, count(*) AS n FROM ref_sketch GROUP BY id) b ON b.id = x.ref)
        ) m ON m.target = t.id AND m.r = 1""",
    "accounting": """
        SELECT c_nationkey || CASE WHEN c_acctbal < 0 THEN '-' ELSE '_' END || c_custkey || sfx AS job_task,
               c_custkey || sfx AS job_raw, 'n' || right(CAST(c_custkey AS VARCHAR), 1) AS node, 'main' AS cluster,
               c_nationkey || 'M' AS disk_read, length(c_name) || 'M' AS disk_write,
               '00:' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || ':00' AS elapsed, 'COMPLETED' AS state
        FROM (SELECT *, CASE WHEN c_mktsegment = 'MACHINERY' THEN '.extern' ELSE '.batch' END AS sfx FROM customer)""",
    "records": """
        SELECT regexp_replace(job_raw, '\\.batch$', '') AS job_raw, split_part(regexp_replace(job_task, '\\.batch$', ''), '_', 1) AS array_id,
               split_part(regexp_replace(job_task, '\\.batch$', ''), '_', 2) AS task_id, node, cluster, disk_read, disk_write, elapsed, state
        FROM accounting WHERE job_raw LIKE '%.batch' AND len(string_split(job_task, '_')) = 2""",
    "samples": """
        SELECT 'main' AS cluster, 'n' || right(CAST(user_id AS VARCHAR), 1) AS node, CAST(user_id AS VARCHAR) AS job_raw,
               event_type AS localtime, datediff('microsecond', TIMESTAMP '2024-01-01', ts) // 1000000 AS raw_time, value AS mem_used_gb,
               CASE WHEN event_type = 'error' THEN [value, value * 2] ELSE [value, value * 2, value * 4, value * 8] END AS cores
        FROM events""",
    "attached": """
        SELECT r.job_raw, array_id || '_' || task_id AS jobid, r.node, s.localtime, raw_time, elapsed, mem_used_gb, cores
        FROM samples s JOIN records r ON s.cluster = r.cluster AND s.node = r.node AND s.job_raw = r.job_raw""",
    "blocks": """
        SELECT unnest(range(1, CAST(ceil((sqrt(n * 8 + 1) - 1) / 2) AS BIGINT) + 1)) AS block_id FROM (SELECT count(*) AS n FROM orders)""",
    "plan": """
        SELECT row_number() OVER (ORDER BY x.block_id <> y.block_id, x.block_id, y.block_id) AS rowid,
               x.block_id AS block_id1, y.block_id AS block_id2,
               CASE WHEN x.block_id = y.block_id THEN 1 ELSE x.block_id + 1 END AS priority, true AS use_masking
        FROM blocks x JOIN blocks y ON x.block_id <= y.block_id""",
    "work": """
        SELECT rowid, block_id1, block_id2, priority, status, use_masking,
               CASE WHEN status <> 'NOTSTARTED' THEN o_custkey || '_' || rowid END AS jobid,
               CASE WHEN status <> 'NOTSTARTED' THEN md5(CAST(o_custkey AS VARCHAR)) || '_1' END AS reservation_token
        FROM (SELECT p.*, o.o_custkey, CASE WHEN p.rowid <= 4 * (SELECT count(*) FROM blocks) THEN 'COMPLETED'
                     WHEN o_orderstatus = 'F' THEN 'FAILED'
                     WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'RUNNING'
                     WHEN o_orderstatus = 'P' THEN 'RESERVED' ELSE 'NOTSTARTED' END AS status
              FROM plan p JOIN orders o ON p.rowid = o.o_orderkey + 1)""",
    "completed": """
        SELECT block_id FROM (SELECT block_id1 AS block_id FROM work WHERE status = 'COMPLETED'
              UNION ALL SELECT block_id2 FROM work WHERE status = 'COMPLETED' AND block_id1 <> block_id2)
        GROUP BY block_id HAVING count(*) = (SELECT count(*) FROM blocks)""",
    "log_events": """
        SELECT event_id AS line_no, 'array_' || md5(CAST(user_id AS VARCHAR)) || '_1_' || user_id || '_1.log' AS file,
               md5(CAST(user_id AS VARCHAR)) || '_1' AS token, event_type AS kind, event_id // 10 AS id1, event_id // 10 + 1 AS id2 FROM events""",
    "requested": "SELECT DISTINCT event_id // 10 AS rowid FROM events",
    "hits": """
        SELECT unnest([s, s + 1]) AS rowid, file, line_no FROM (
            SELECT *, last_value(CASE WHEN kind = 'signup' THEN id1 END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS s FROM log_events)
        WHERE kind = 'error' AND s IS NOT NULL""",
    "said": """
        SELECT unnest([id1, id2]) AS rowid, token, CASE kind WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS rank
        FROM log_events WHERE kind IN ('signup', 'click', 'purchase')
        UNION ALL SELECT h.rowid, e.token, 2 FROM hits h JOIN log_events e ON h.line_no = e.line_no""",
    "inventory": """
        SELECT o_orderkey + 1 AS block_id, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size,
               o_orderdate AS mtime, CASE o_orderpriority WHEN '1-URGENT' THEN 'merged' WHEN '2-HIGH' THEN 'q.a2' WHEN '3-MEDIUM' THEN 'q.d2'
               WHEN '4-NOT SPECIFIED' THEN 'trim.a2' ELSE 'stats' END AS kind FROM orders""",
    "settled": f"""SELECT block_id, kind FROM inventory WHERE size > 0 AND mtime < TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTES""",
    "matrix": """
        SELECT o_orderkey + 1 AS block_id, c.block_id IS NOT NULL AS aligned, coalesce(s.kind = 'merged', false) AS merged,
               coalesce(s.kind = 'q.a2', false) AS quality_annotated, coalesce(s.kind = 'trim.a2', false) AS trim_annotated,
               coalesce(s.kind = 'stats', false) AS stats
        FROM orders LEFT JOIN completed c ON c.block_id = o_orderkey + 1 LEFT JOIN settled s ON s.block_id = o_orderkey + 1""",
    "overlap": """
        SELECT a, b, strand, ab, ab + n AS ae, ab + b * 5 AS bb, ab + b * 5 + n AS be, 4400 AS a_len, 4400 AS b_len,
               n * pct * 4 // 100 AS diffs, block
        FROM (SELECT l_partkey AS a, CAST(l_linenumber AS BIGINT) AS b, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
                     datediff('day', DATE '1995-01-01', l_shipdate) AS ab, CAST(l_quantity AS BIGINT) * 40 AS n,
                     CAST(round(l_discount * 100) AS BIGINT) AS pct, l_suppkey AS block FROM lineitem)""",
    "part_trim": """
        SELECT p_partkey AS read_id, 'trim' AS kind, CAST(p_size * 10 AS BIGINT) AS b, CAST(4400 - p_size * 5 AS BIGINT) AS e FROM part""",
    "depth": """
        SELECT read_id, pos AS b, lead(pos) OVER w AS e, sum(d) OVER w AS depth
        FROM (SELECT read_id, pos, sum(d) AS d FROM (SELECT a AS read_id, ab AS pos, 1 AS d FROM overlap
              UNION ALL SELECT a, ae, -1 FROM overlap) GROUP BY ALL) WINDOW w AS (PARTITION BY read_id ORDER BY pos)""",
    "repeats": """
        SELECT read_id, 'repeats' AS kind, min(b) AS b, max(e) AS e FROM (
            SELECT *, sum(CASE WHEN on_ = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY b) AS region FROM (
                SELECT *, lag(on_, 1, 0) OVER (PARTITION BY read_id ORDER BY b) AS was FROM (
                    SELECT *, coalesce(last_value(CASE WHEN depth >= 10.0 THEN 1 WHEN depth < 8.5 THEN 0 END IGNORE NULLS)
                                       OVER (PARTITION BY read_id ORDER BY b), 0) AS on_ FROM depth WHERE e IS NOT NULL)))
        WHERE on_ = 1 GROUP BY read_id, region""",
    "segments": """
        SELECT a AS read_id, s, sum(diffs) AS diffs, sum(ae - ab) AS bases
        FROM (SELECT *, unnest(range((ab + 99) // 100, ae // 100)) AS s FROM overlap) GROUP BY ALL""",
    "spans": """
        SELECT *, row_number() OVER (PARTITION BY a, b, strand ORDER BY lo, hi, ab, ae, bb, be) AS i
        FROM (SELECT *, least(ab - bb, ae - be) AS lo, greatest(ab - bb, ae - be) AS hi
              FROM (SELECT a, b, strand, a_len, b_len, block, ab, ae, bb, be, sum(diffs) AS diffs FROM overlap GROUP BY ALL))""",
    # Row by row, with the farthest end of all rows so far.
    "bands": """
        SELECT a, b, strand, i, hi, 1 AS band FROM spans WHERE i = 1
        UNION ALL SELECT s.a, s.b, s.strand, s.i, greatest(w.hi, s.hi), CASE WHEN s.lo - w.hi > {gap} THEN w.band + 1 ELSE w.band END
        FROM bands w JOIN spans s ON s.a = w.a AND s.b = w.b AND s.strand = w.strand AND s.i = w.i + 1""",
    "placed": """
        SELECT s.*, band, row_number() OVER (PARTITION BY s.a, s.b, s.strand, band ORDER BY ab, ae, bb, be) AS j
        FROM spans s JOIN bands USING (a, b, strand, i)""",
    "chained": """
        SELECT a, b, strand, band, j, ae, be, 1 AS chain FROM placed WHERE j = 1
        UNION ALL SELECT p.a, p.b, p.strand, p.band, p.j, greatest(w.ae, p.ae), greatest(w.be, p.be),
            CASE WHEN p.ab - w.ae > {gap} OR p.bb - w.be > {gap} THEN w.chain + 1 ELSE w.chain END
        FROM chained w JOIN placed p ON p.a = w.a AND p.b = w.b AND p.strand = w.strand AND p.band = w.band AND p.j = w.j + 1""",
    "stitched": """
        SELECT p.a, p.b, p.strand, min(ab) AS ab, max(p.ae) AS ae, min(bb) AS bb, max(p.be) AS be, a_len, b_len, CAST(sum(diffs) AS BIGINT) AS diffs
        FROM placed p JOIN chained c USING (a, b, strand, band, j) GROUP BY p.a, p.b, p.strand, a_len, b_len, band, chain""",
    "clipped": """
        SELECT a, b, strand, ab + head AS ab, ae - tail AS ae, bb + head AS bb, be - tail AS be, a_len, b_len, diffs, tab, tae, tbb, tbe
        FROM (SELECT *, greatest(0, tab - ab, tbb - bb) AS head, greatest(0, ae - tae, be - tbe) AS tail FROM (
            SELECT s.*, x.b AS tab, x.e AS tae, CASE WHEN strand = '+' THEN y.b ELSE b_len - y.e END AS tbb,
                   CASE WHEN strand = '+' THEN y.e ELSE b_len - y.b END AS tbe
            FROM stitched s JOIN part_trim x ON s.a = x.read_id JOIN part_trim y ON s.b = y.read_id))
        WHERE ab + head < ae - tail AND bb + head < be - tail""",
    "layout": """
        SELECT o_custkey AS line, o_orderkey AS read_id, datediff('day', DATE '1995-01-01', o_orderdate) AS b,
               CAST(floor(o_totalprice / 500) AS BIGINT) + 30 AS len FROM orders""",
    "layout_reads": """
        SELECT read_id, substr(repeat(translate(md5(CAST(read_id AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 40), 1, len) AS seq FROM layout""",
    "layout_overlap": """
        SELECT x.read_id AS a, y.read_id AS b, CASE WHEN x.read_id % 2 = y.read_id % 2 THEN '+' ELSE '-' END AS strand,
               CASE WHEN x.read_id % 2 = 1 THEN x.b + x.len - least(x.b + x.len, y.b + y.len) ELSE y.b - x.b END AS ab,
               CASE WHEN x.read_id % 2 = 1 THEN x.b + x.len - y.b ELSE least(x.b + x.len, y.b + y.len) - x.b END AS ae,
               CASE WHEN x.read_id % 2 = 1 THEN y.b + y.len - least(x.b + x.len, y.b + y.len) ELSE 0 END AS bb,
               CASE WHEN x.read_id % 2 = 1 THEN y.len ELSE least(x.b + x.len, y.b + y.len) - y.b END AS be,
               x.len AS a_len, y.len AS b_len, CAST(0 AS BIGINT) AS diffs, CAST(1 AS BIGINT) AS block
        FROM layout x JOIN layout y ON x.line = y.line AND y.b < x.b + x.len AND (y.b > x.b OR (y.b = x.b AND y.read_id > x.read_id))""",
    "contained": """
        SELECT DISTINCT read_id FROM (SELECT CASE
            WHEN ab <= 0 AND ae >= a_len AND bb <= 0 AND be >= b_len THEN greatest(a, b)
            WHEN bb <= 0 AND be >= b_len THEN b WHEN ab <= 0 AND ae >= a_len THEN a END AS read_id FROM layout_overlap WHERE a <> b)
        WHERE read_id IS NOT NULL""",
    "ends": """
        SELECT *, ae >= a_len AND bb <= 0 AS a_first, CASE strand WHEN '+' THEN '-' ELSE '+' END AS other
        FROM layout_overlap WHERE a <> b AND ((ae >= a_len AND bb <= 0) OR (ab <= 0 AND be >= b_len))
          AND a NOT IN (SELECT read_id FROM contained) AND b NOT IN (SELECT read_id FROM contained)""",
    "dovetails": """
        SELECT *, src || src_strand AS u, dst || dst_strand AS v FROM (SELECT src, src_strand, dst, dst_strand, min(overhang) AS overhang FROM (
            SELECT a AS src, '+' AS src_strand, b AS dst, strand AS dst_strand, b_len - be AS overhang FROM ends WHERE a_first
            UNION ALL SELECT b, other, a, '-', ab FROM ends WHERE a_first
            UNION ALL SELECT b, strand, a, '+', a_len - ae FROM ends WHERE NOT a_first
            UNION ALL SELECT a, '-', b, other, bb FROM ends WHERE NOT a_first) GROUP BY ALL)""",
    "edges": """
        SELECT d.* FROM (SELECT *, count(*) OVER (PARTITION BY u) AS so, count(*) OVER (PARTITION BY v) AS di FROM dovetails) d
        LEFT JOIN (SELECT v AS n, count(*) AS si FROM dovetails GROUP BY v) i ON i.n = d.u
        LEFT JOIN (SELECT u AS n, count(*) AS dou FROM dovetails GROUP BY u) o ON o.n = d.v
        WHERE NOT (dou IS NULL AND di = 1 AND so > 1) AND NOT (si IS NULL AND so = 1 AND di > 1)""",
}

STITCHED = ["overlap", "spans", "bands", "placed", "chained", "stitched"]
SHIFTED = f"""
    SELECT * REPLACE (bb + diffs % 3 * 700 AS bb, be + diffs % 3 * 700 AS be, CAST(1 AS BIGINT) AS block) FROM ({VIEWS['overlap']})"""
GRAPH = ["layout", "layout_overlap", "contained", "ends", "dovetails", "edges"]

# Dead ends of up to three edges, followed from where they end.
VIEWS |= {
    "degree": """
        SELECT n, count(DISTINCT v) AS o, count(DISTINCT u) AS i
        FROM (SELECT u AS n, v, NULL AS u FROM dovetails UNION ALL SELECT v, NULL, u FROM dovetails) GROUP BY n""",
    "link": """
        SELECT DISTINCT d.u, d.v FROM dovetails d JOIN degree x ON x.n = d.u JOIN degree y ON y.n = d.v WHERE x.o = 1 AND y.i = 1 AND src <> dst""",
    "sinking": """
        SELECT n AS leaf, n, 1 AS m FROM degree WHERE o = 0
        UNION ALL SELECT leaf, l.u, m + 1 FROM sinking s JOIN link l ON l.v = s.n WHERE m < 3""",
    "rising": """
        SELECT n AS leaf, n, 1 AS m FROM degree WHERE i = 0
        UNION ALL SELECT leaf, l.v, m + 1 FROM rising s JOIN link l ON l.u = s.n WHERE m < 3""",
    "fork": """
        SELECT leaf, d.u, d.v FROM sinking s JOIN degree x ON x.n = s.n AND x.i = 1 JOIN dovetails d ON d.v = s.n JOIN degree y ON y.n = d.u AND y.o > 1
        WHERE s.n NOT IN (SELECT v FROM link)
        UNION SELECT leaf, d.u, d.v FROM rising s JOIN degree x ON x.n = s.n AND x.o = 1 JOIN dovetails d ON d.u = s.n JOIN degree y ON y.n = d.v AND y.i > 1
        WHERE s.n NOT IN (SELECT u FROM link)""",
    "gone": """
        SELECT u, v FROM fork
        UNION SELECT l.u, l.v FROM fork f JOIN sinking s USING (leaf) JOIN link l ON l.u = s.n
        UNION SELECT l.u, l.v FROM fork f JOIN rising s USING (leaf) JOIN link l ON l.v = s.n""",
}
TIPS = ["degree", "link", "sinking", "rising", "fork", "gone"]

# Reachability and chains need recursion; they are appended to the graph views.
COMPONENT = """
    reach(node, other) AS (SELECT src, src FROM edges UNION SELECT dst, dst FROM edges
        UNION SELECT r.node, e.v FROM reach r JOIN (SELECT src AS u, dst AS v FROM edges UNION ALL SELECT dst, src FROM edges) e ON r.other = e.u),
    component AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""
CHAINS = """
    nodes AS (SELECT src AS r, src_strand AS s, u AS n FROM edges UNION SELECT dst, dst_strand, v FROM edges),
    links AS (SELECT u, v, dst, dst_strand, overhang FROM (SELECT *, count(*) OVER (PARTITION BY u) AS lo, count(*) OVER (PARTITION BY v) AS li FROM edges)
              WHERE lo = 1 AND li = 1),
    walk(head, head_strand, n, read_id, strand, pos, overhang) AS (
        SELECT r, s, n, r, s, 0, CAST(NULL AS BIGINT) FROM nodes WHERE n NOT IN (SELECT v FROM links)
        UNION ALL SELECT c.head, c.head_strand, l.v, l.dst, l.dst_strand, c.pos + 1, l.overhang FROM walk c JOIN links l ON c.n = l.u),
    tails AS (SELECT head, head_strand, arg_max(read_id, pos) AS last, CASE arg_max(strand, pos) WHEN '+' THEN '-' ELSE '+' END AS last_strand FROM walk GROUP BY ALL),
    chain AS (SELECT w.head AS path_id, read_id, strand, pos, overhang FROM walk w JOIN tails t ON w.head = t.head AND w.head_strand = t.head_strand
              WHERE t.head_strand < last_strand OR (t.head_strand = last_strand AND t.head < last))"""


def _with(views: list[str], body: str, extra: str = "", **params: object) -> str:
    named = []
    for v in views:
        text = (params.get("instead") or {}).get(v, VIEWS[v])
        if v in ("bands", "chained"):
            text = text.format(gap=params["gap"])
        named.append(f"{v} AS ({text})")
    if extra:
        named.append(extra)
    return f"WITH RECURSIVE {', '.join(named)} {body}"


def _runs(source: str) -> str:
    """Unions of the intervals (read_id, b, e) in a view."""
    return f"""
        SELECT read_id, min(b) AS b, max(e) AS e FROM (
            SELECT *, sum(CASE WHEN r IS NULL OR b > r THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS g
            FROM (SELECT *, max(e) OVER (PARTITION BY read_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ({source})))
        GROUP BY read_id, g"""


def _good_runs(threshold: int) -> str:
    return f"""SELECT read_id, min(s) AS b, max(s) + 1 AS e FROM (
        SELECT *, s - row_number() OVER (PARTITION BY read_id ORDER BY s) AS g FROM segments WHERE diffs * 100 <= bases * {threshold})
        GROUP BY read_id, g"""


def _best_run(runs: str) -> str:
    return f"""
        SELECT read_id, 'trim' AS kind, b * 100 AS b, e * 100 AS e FROM (
            SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY e - b DESC, b) AS r FROM ({runs}) WHERE e - b >= 5) WHERE r = 1"""


_WORK = ["blocks", "plan", "work"]
_LOGS = ["log_events", "requested", "hits", "said"]
_FOLDED = """
    SELECT q.rowid, CASE coalesce(max(s.rank), 0) WHEN 0 THEN 'RESERVED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'FAILED' ELSE 'COMPLETED' END AS status
    FROM requested q LEFT JOIN {said} s ON q.rowid = s.rowid GROUP BY q.rowid"""
_MATCH = ["targets", "refs", "target_sketch", "ref_sketch", "match"]
_SCREENED = f"""
    SELECT t.id, m.reference_id, m.ji > {CUTOFF} AS is_contaminant, md5(t.seq) AS seq_md5 FROM targets t JOIN match m ON t.id = m.target_id"""
_TRACKED = ["overlap", "depth", "repeats"]
_FAILED_HITS = "SELECT rowid, file, line_no FROM hits"
_LONGEST = f"SELECT id, strlen(seq) AS len FROM reads ORDER BY strlen(seq) DESC, id LIMIT {LONGEST}"


def all_sql() -> dict[str, str]:
    headers = "SELECT cell, hole, qs, qe FROM subreads WHERE cell <> 'error'"
    q: dict[str, str] = {}
    q["fasta_round_trip"] = _with(["reads"], "SELECT id, strlen(seq) AS len, md5(seq) AS seq_md5 FROM reads")
    q["fasta_headers"] = _with(["subreads"], headers)
    q["alignments_to_reads"] = _with(["reads"], "SELECT id, md5(seq) AS seq_md5 FROM reads")
    q["concat_sources"] = _with(["targets", "refs"], "SELECT id, md5(seq) AS seq_md5 FROM (SELECT * FROM targets UNION ALL SELECT * FROM refs)")
    q["accounting_round_trip"] = _with(["accounting"], "SELECT * FROM accounting")
    q["telemetry_files"] = _with(["samples"], "SELECT cluster, node, job_raw, localtime, raw_time, mem_used_gb, len(cores) AS n_cores FROM samples")
    q["task_log_files"] = _with(_LOGS, _FOLDED.format(said="said"))
    q["empty_files"] = """
        SELECT folder, CAST(1 AS BIGINT) AS n_empty, CAST(coalesce(sum(strlen(CAST(o_orderkey AS VARCHAR)) + 1), 0) AS BIGINT) AS n_bytes
        FROM (VALUES ('F'), ('O'), ('P')) AS s(folder) LEFT JOIN orders ON o_orderstatus = folder GROUP BY folder"""
    q["file_inventory"] = _with(["reads"], "SELECT CAST(sum(strlen(CAST(id AS VARCHAR)) + strlen(seq) + 3) AS BIGINT) AS n_bytes FROM reads")

    q["parsed_headers"] = q["fasta_headers"]
    q["header_rejects"] = _with(["subreads", "header_lines"], "SELECT line FROM header_lines WHERE NOT regexp_matches(line, '^>[^/]+/[0-9]+/[0-9]+_[0-9]+')")
    q["sequence_lengths"] = _with(["targets"], "SELECT id, strlen(seq) AS n_bytes, length(seq) AS n_chars FROM targets")
    counts = ", ".join(f"length(regexp_replace(seq, '[^{b}]', '', 'g')) AS n{b.lower()}" for b in "ACGTN")
    q["base_composition"] = _with(["reads"], f"SELECT id, {counts} FROM reads")
    hashed = ["reads", "words", "scrambled", "folded", "hashes"]
    q["sequence_hash"] = _with(hashed, "SELECT id, hash FROM hashes")
    q["record_offsets"] = _with(["reads", "offsets"], "SELECT * FROM offsets")
    q["read_index"] = _with([*hashed, "offsets"], f"""
        SELECT r.id, len, {counts}, "offset", hash FROM reads r JOIN offsets o ON r.id = o.id JOIN hashes h ON r.id = h.id""")
    q["fasta_index"] = _with(hashed, f"SELECT CAST(r.id AS VARCHAR) AS id, strlen(seq) AS len, {counts}, hash FROM reads r JOIN hashes h ON r.id = h.id")
    q["long_records"] = _with(["reads"], f"SELECT CAST(id AS VARCHAR) AS id, strlen(seq) AS len, {counts}, md5(seq) AS seq_md5 FROM reads")
    q["long_record_sketch"] = _with(["reads", "targets", "target_sketch"], "SELECT id, h FROM target_sketch", instead={
        "targets": "SELECT CAST(id AS VARCHAR) AS id, seq FROM reads"})
    q["fasta_offsets"] = _with(["reads"], """
        SELECT count(*) AS n_records, CAST(sum(strlen(CAST(id AS VARCHAR)) + strlen(seq) + 3) AS BIGINT) AS n_bytes,
               CAST(sum(strlen(seq)) AS BIGINT) AS n_bases, CAST(0 AS BIGINT) AS n_files_with_gaps FROM reads""")
    named = "(SELECT CAST(id AS VARCHAR) AS id, strlen(seq) AS len FROM reads)"
    q["fasta_longest_to_coverage"] = _with(["reads"], f"""
        SELECT id, len FROM (SELECT *, sum(len) OVER w AS cum, row_number() OVER w AS r FROM {named}
            WINDOW w AS (ORDER BY len DESC, id ROWS UNBOUNDED PRECEDING)) WHERE cum - len < {GENOME_SIZE * COVERAGE} OR r = 1""")
    q["fasta_blocks"] = _with(["reads"], f"""
        SELECT id, len, CAST((sum(len) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) - len) // {BLOCK_BASES} + 1 AS BIGINT) AS block FROM {named}""")
    q["fasta_screen"] = _with(["reads", *_MATCH], f"SELECT target_id AS id, reference_id, hits, ji > {CUTOFF} AS is_contaminant FROM match", instead={
        "targets": "SELECT CAST(id AS VARCHAR) AS id, seq FROM reads",
        "refs": "SELECT 'ref' || item_id AS id, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM benchmark"})
    q["longest_n"] = _with(["reads"], _LONGEST)
    q["longest_to_coverage"] = _with(["reads"], f"""
        SELECT id, len FROM (SELECT *, sum(len) OVER w AS cum, row_number() OVER w AS r FROM (SELECT id, strlen(seq) AS len FROM reads)
            WINDOW w AS (ORDER BY len DESC, id ROWS UNBOUNDED PRECEDING)) WHERE cum - len < {GENOME_SIZE * COVERAGE} OR r = 1""")

    q["interval_distance"] = _with(["subreads", "pairs", "gaps"], "SELECT cell, hole, a_start, a_end, b_start, b_end, distance, pairs FROM gaps")
    q["interval_overlaps"] = _with(["subreads", "pairs"], "SELECT *, a_start <= b_end AND b_start <= a_end AS overlaps FROM pairs")
    q["reads_per_well_histogram"] = _with(["subreads"], """
        SELECT n_reads, count(*) AS n_wells FROM (SELECT count(*) AS n_reads FROM subreads GROUP BY cell, hole) GROUP BY n_reads""")
    q["well_summary"] = _with(["subreads", "pairs"], """
        SELECT count(*) AS n_multiple, count(*) FILTER (ov) AS n_overlapping
        FROM (SELECT bool_or(a_end >= b_start OR b_end <= a_start) AS ov FROM pairs GROUP BY cell, hole)""")
    binned = "SELECT distance // 3600 * 3600 AS bin_start, CAST(sum(pairs) AS BIGINT) AS n_pairs FROM gaps {where} GROUP BY ALL"
    q["gap_histogram"] = _with(["subreads", "pairs", "gaps"], binned.format(where=""))
    last = "WHERE (cell, hole) <> (SELECT (cell, hole) FROM subreads ORDER BY cell DESC, hole DESC LIMIT 1)"
    q["gap_histogram_without_last_well"] = _with(["subreads", "pairs", "gaps"], binned.format(where=last))

    q["minhash_sketch"] = _with(["targets", "target_sketch"], "SELECT id, h FROM target_sketch")
    q["best_match"] = _with(_MATCH, "SELECT * FROM match")
    q["match_stats"] = q["best_match"]
    q["screen"] = _with(_MATCH, _SCREENED)
    q["contaminant_records"] = _with(_MATCH, f"SELECT id || ' || ' || reference_id AS name, seq_md5 FROM ({_SCREENED}) WHERE is_contaminant")

    q["batch_records"] = _with(["accounting", "records"], "SELECT * FROM records")
    q["malformed_batch_records"] = _with(["accounting"], """
        SELECT job_task, regexp_replace(job_raw, '\\.batch$', '') AS job_raw FROM accounting
        WHERE job_raw LIKE '%.batch' AND len(string_split(job_task, '_')) <> 2""")
    attached = ["accounting", "records", "samples", "attached"]
    q["latest_records"] = """
        SELECT CAST(o_custkey AS VARCHAR) AS job_raw, arg_max(o_orderstatus, o_orderkey) AS state, max(o_orderkey) AS place FROM orders GROUP BY o_custkey"""
    q["attach_samples"] = _with(attached, "SELECT * EXCLUDE (cores), len(cores) AS n_cores FROM attached")
    q["missing_telemetry"] = _with(attached, "SELECT job_raw, array_id, task_id FROM records WHERE job_raw NOT IN (SELECT job_raw FROM samples)")
    q["core_width_check"] = _with(attached, """
        SELECT job_raw, len(cores) AS n_cores, count(*) AS n_samples FROM attached
        WHERE len(cores) <> (SELECT len(cores) FROM attached ORDER BY CAST(job_raw AS BIGINT), len(cores) LIMIT 1) GROUP BY ALL""")
    cores = ", ".join(f"cores[{i}] AS core{i}" for i in range(1, 5))
    q["widen_cores"] = _with(attached, f"SELECT job_raw, raw_time, {cores} FROM attached")

    q["assign_blocks"] = _with(["reads"], f"""
        SELECT id, len, CAST((sum(len) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) - len) // {BLOCK_BASES} + 1 AS BIGINT) AS block
        FROM (SELECT id, strlen(seq) AS len FROM reads)""")
    q["block_pairs"] = _with(["blocks", "plan"], "SELECT * FROM plan")
    q["completed_keys"] = _with([*_WORK, "completed"], "SELECT * FROM completed")
    q["select_work"] = _with(_WORK, "SELECT rowid, priority, status FROM work WHERE status IN ('NOTSTARTED', 'FAILED') ORDER BY priority, rowid LIMIT 50")
    q["chunk_within_key"] = _with(_WORK, """
        SELECT rowid, block_id1, priority, (row_number() OVER (PARTITION BY block_id1, priority ORDER BY rowid) - 1) // 16 AS batch
        FROM work WHERE status = 'NOTSTARTED'""")
    q["fixed_batches"] = _with(["inventory", "settled"], """
        SELECT block_id, (row_number() OVER (ORDER BY block_id) - 1) // 20 AS batch FROM settled WHERE kind = 'merged'""")
    q["fold_status"] = q["task_log_files"]
    q["fold_status_of_known_tokens"] = _with([*_WORK, *_LOGS], _FOLDED.format(
        said="(SELECT * FROM said WHERE token IN (SELECT reservation_token FROM work))"))
    q["attribute_failures"] = _with(_LOGS[:3], _FAILED_HITS)
    shown = ["RUNNING", "COMPLETED", "PENDING", "RESERVED", "CANCELLED", "FAILED", "NOTSTARTED"]
    per_status = ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in shown)
    q["status_summary"] = _with(_WORK, f"SELECT count(*) AS total, {per_status} FROM work")
    q["project_summary"] = _with(_WORK, f"""
        SELECT 'proj' AS name, (SELECT min(o_orderdate) FROM orders) AS started_on, (SELECT max(o_orderdate) FROM orders) AS prepared_on,
               (SELECT count(*) FROM blocks) AS blocks, count(*) AS total, {per_status} FROM work""")
    q["active_tokens"] = _with(_WORK, """
        SELECT count(DISTINCT reservation_token) AS n_active FROM work
        WHERE status IN ('RUNNING', 'RESERVED', 'PENDING', 'COMPLETING', 'CONFIGURING')""")
    q["lookup_by_ids"] = _with([*_WORK, "requested"], """
        SELECT rowid, jobid, reservation_token, block_id1, block_id2 FROM work WHERE rowid IN (SELECT rowid FROM requested)""")
    staged = [*_WORK, "completed", "inventory", "settled", "matrix"]
    q["stage_matrix"] = _with(staged, "SELECT * FROM matrix")
    stages = ["aligned", "merged", "quality_annotated", "trim_annotated", "stats"]
    q["stage_totals"] = _with(staged, "SELECT " + ", ".join(f"count(*) FILTER ({s}) AS {s}" for s in stages) + " FROM matrix")
    q["quiescent_files"] = _with(["inventory", "settled"], "SELECT block_id FROM settled WHERE kind = 'merged'")
    q["missing_artifacts"] = _with(["inventory"], """
        SELECT block_id, track, ext FROM (SELECT o_orderkey + 1 AS block_id, track, ext FROM orders,
            (VALUES ('q', 'a2'), ('q', 'd2'), ('trim', 'a2'), ('trim', 'd2')) k(track, ext)) r
        WHERE NOT EXISTS (SELECT 1 FROM inventory i WHERE i.block_id = r.block_id AND i.kind = r.track || '.' || r.ext AND i.size > 0)""")
    q["remaining_blocks"] = _with(["inventory", "settled"], "SELECT o_orderkey + 1 AS block_id FROM orders EXCEPT SELECT block_id FROM settled")
    q["blocks_in_both"] = _with(["inventory", "settled", "requested"], "SELECT block_id FROM settled INTERSECT SELECT rowid FROM requested")
    q["key_checks"] = _with([*_WORK, "requested", ], """
        , known AS (SELECT block_id FROM blocks UNION ALL SELECT rowid FROM requested)
        SELECT 'duplicate_pairs' AS "check", count(*) AS n FROM (SELECT 1 FROM work GROUP BY block_id1, block_id2 HAVING count(*) > 1)
        UNION ALL SELECT 'duplicate_blocks', count(*) FROM (SELECT 1 FROM known GROUP BY block_id HAVING count(*) > 1)
        UNION ALL SELECT 'dangling_block_id1', count(*) FROM work WHERE block_id1 NOT IN (SELECT block_id FROM known)
        UNION ALL SELECT 'dangling_block_id2', count(*) FROM work WHERE block_id2 NOT IN (SELECT block_id FROM known)
        UNION ALL SELECT 'blocks', count(*) FROM known UNION ALL SELECT 'work_items', count(*) FROM work
        UNION ALL SELECT 'masked_items', count(*) FROM work WHERE use_masking""")
    q["compress_runs"] = _with(_WORK, """
        SELECT status, (r - 1) // 500 AS segment, string_agg(CASE WHEN f = l THEN CAST(f AS VARCHAR) ELSE f || '-' || l END, ',' ORDER BY f) AS runs
        FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY f) AS r FROM (
            SELECT status, min(rowid) AS f, max(rowid) AS l FROM (
                SELECT status, rowid, rowid - row_number() OVER (PARTITION BY status ORDER BY rowid) AS g FROM work) GROUP BY status, g))
        GROUP BY status, segment""")

    q["candidate_pairs"] = _with(["reads"], """
        , km AS (SELECT id, i - 1 AS pos, substr(seq, i, 14) AS kmer FROM (SELECT id, seq, unnest(range(1, length(seq) - 12)) AS i FROM reads)),
        ok AS (SELECT kmer FROM km GROUP BY kmer HAVING count(*) BETWEEN 2 AND 20),
        kept AS (SELECT km.* FROM km JOIN ok ON km.kmer = ok.kmer)
        SELECT x.id AS a, y.id AS b, CAST(floor((x.pos - y.pos) / 64.0) AS BIGINT) AS diagonal, count(*) AS shared
        FROM kept x JOIN kept y ON x.kmer = y.kmer AND x.id < y.id GROUP BY ALL HAVING count(*) >= 2""")
    q["candidate_pairs_masked"] = _with(["reads"], """
        , km AS (SELECT * FROM (SELECT id, n, i - 1 AS pos, substr(seq, i, 14) AS kmer FROM (
            SELECT id, seq, length(seq) AS n, unnest(range(1, length(seq) - 12)) AS i FROM reads)) WHERE pos >= n // 5),
        ok AS (SELECT kmer FROM km GROUP BY kmer HAVING count(*) BETWEEN 2 AND 20),
        kept AS (SELECT km.* FROM km JOIN ok ON km.kmer = ok.kmer)
        SELECT x.id AS a, y.id AS b, CAST(floor((x.pos - y.pos) / 64.0) AS BIGINT) AS diagonal, count(*) AS shared
        FROM kept x JOIN kept y ON x.kmer = y.kmer AND (x.id < y.id OR (x.id = y.id AND x.pos < y.pos)) GROUP BY ALL HAVING count(*) >= 2""")
    q["stitch"] = _with(STITCHED, "SELECT *, CAST(1 AS BIGINT) AS block FROM stitched", gap=40)
    q["stitch_interleaved"] = _with(STITCHED, "SELECT *, CAST(1 AS BIGINT) AS block FROM stitched", gap=40, instead={"overlap": SHIFTED})
    q["repeat_track"] = _with(_TRACKED, "SELECT * FROM repeats")
    q["quality_trim"] = _with(["overlap", "segments"], _best_run(_good_runs(20)))
    q["quality_trim_update"] = _with(["overlap", "part_trim", "segments"], _best_run(f"""
        SELECT g.read_id, greatest(g.b, (p.b + 99) // 100) AS b, least(g.e, p.e // 100) AS e
        FROM ({_good_runs(22)}) g JOIN part_trim p ON g.read_id = p.read_id"""))
    q["track_merge"] = _with([*_TRACKED, "part_trim"], "SELECT * FROM repeats UNION SELECT * FROM part_trim")
    q["track_duplicates"] = _with(["part_trim"], "SELECT *, CAST(2 AS BIGINT) AS n FROM part_trim")
    q["track_missing_blocks"] = _with([*_TRACKED, "part_trim"], """
        , known AS (SELECT 'trim' AS kind, read_id // 10 + 1 AS block_id FROM part_trim WHERE (read_id // 10 + 1) % 7 <> 3
                    UNION SELECT 'repeats', read_id // 10 + 1 FROM repeats)
        SELECT kind, block_id FROM (SELECT DISTINCT p_partkey // 10 + 1 AS block_id FROM part), (VALUES ('trim'), ('repeats')) AS k(kind)
        EXCEPT SELECT kind, block_id FROM known""")
    q["track_combine"] = _with(_TRACKED, "SELECT read_id, 'combined_repeats' AS kind, b, e FROM (" + _runs("""
        SELECT a AS read_id, ab AS b, ab + diffs AS e FROM overlap WHERE diffs > 0 UNION ALL SELECT read_id, b, e FROM repeats""") + ")")
    q["remove_gaps"] = _with(["overlap", "part_trim"], """
        , cut AS (SELECT * FROM (SELECT o.*, greatest(o.ab, p.b) AS cb, least(o.ae, p.e) AS ce FROM overlap o JOIN part_trim p ON o.a = p.read_id) WHERE ce > cb),
        islands AS (SELECT a, min(cb) AS b, max(ce) AS e FROM (
            SELECT *, sum(CASE WHEN r IS NULL OR cb > r + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY a ORDER BY cb, ce ROWS UNBOUNDED PRECEDING) AS g
            FROM (SELECT a, cb, ce, max(ce) OVER (PARTITION BY a ORDER BY cb, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM cut)) GROUP BY a, g),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY e - b DESC, b) AS r FROM islands) WHERE r = 1)
        SELECT cut.* EXCLUDE (cb, ce) FROM cut JOIN best ON cut.a = best.a AND cb >= best.b AND ce <= best.e""")
    filtered = """
        , cand AS (SELECT row_number() OVER () AS k, * FROM clipped WHERE ae - ab >= 1000
                   AND least(ab - tab, bb - tbb) <= 1000 AND least(tae - ae, tbe - be) <= 1000),
        masked AS (SELECT k, sum(greatest(0, least(c.ae, r.e) - greatest(c.ab, r.b))) AS n FROM cand c JOIN repeats r ON c.a = r.read_id GROUP BY k)
        SELECT a, b, strand, ab, ae, bb, be, a_len, b_len, diffs, CAST(1 AS BIGINT) AS block
        FROM cand LEFT JOIN masked ON cand.k = masked.k WHERE ae - ab - coalesce(masked.n, 0) >= 300"""
    views = [*_TRACKED, "part_trim", *STITCHED[1:], "clipped"]
    q["clustered_repeat_track"], q["clustered_remove_gaps"] = q["repeat_track"], q["remove_gaps"]
    q["filter_overlaps"] = _with(views, filtered, gap=100)
    # only the stitched overlaps are shifted; repeats are those of the overlaps as they are
    shifted = VIEWS["spans"].replace("FROM overlap ", f"FROM ({SHIFTED}) ")
    q["filter_overlaps_interleaved"] = _with(views, filtered, gap=100, instead={"spans": shifted})
    q["covered_bases"] = _with(_TRACKED, """
        , s AS (SELECT DISTINCT a AS read_id, ab, ae FROM overlap)
        SELECT read_id, ab, ae, CAST(coalesce(sum(greatest(0, least(ae, e) - greatest(ab, b))) FILTER (e IS NOT NULL), 0) AS BIGINT) AS n
        FROM s LEFT JOIN repeats USING (read_id) GROUP BY ALL""")
    q["merge_overlaps"] = _with(["overlap", "layout", "layout_overlap"], "SELECT * FROM overlap UNION ALL SELECT * FROM layout_overlap")
    q["check_overlaps"] = _with(["overlap", "requested"], """
        , known AS (SELECT p_partkey AS read_id FROM part UNION SELECT rowid FROM requested)
        SELECT * FROM (SELECT block, count(*) FILTER (ab >= ae OR bb >= be) AS bad_order,
            count(*) FILTER (ab < 0 OR bb < 0 OR ae > a_len OR be > b_len) AS out_of_bounds,
            count(*) FILTER (a NOT IN (SELECT read_id FROM known) OR b NOT IN (SELECT read_id FROM known)) AS missing_reads FROM overlap GROUP BY block)
        WHERE bad_order + out_of_bounds + missing_reads > 0""")
    q["overlap_stats"] = _with(["overlap"], """
        SELECT block, count(*) AS n_overlaps, count(DISTINCT a) AS n_reads, CAST(sum(ae - ab) AS BIGINT) AS sum_len, min(ae - ab) AS min_len,
               max(ae - ab) AS max_len, CAST(sum(ae - ab) AS DOUBLE) / count(*) AS mean_len, CAST(sum(diffs) AS BIGINT) AS diffs FROM overlap GROUP BY block""")
    q["trim_reads"] = _with(["reads"], """
        SELECT id AS read_id, e - b AS len, md5(substr(seq, b + 1, e - b)) AS seq_md5
        FROM (SELECT *, n // 10 AS b, n - n // 20 AS e FROM (SELECT *, length(seq) AS n FROM reads)) WHERE e - b >= 200""")
    q["shift_track"] = _with([*_TRACKED, "part_trim"], """
        SELECT r.read_id, r.kind, greatest(r.b, p.b) - p.b AS b, least(r.e, p.e) - p.b AS e
        FROM repeats r JOIN part_trim p ON r.read_id = p.read_id WHERE p.e - p.b >= 3000 AND least(r.e, p.e) > greatest(r.b, p.b)""")

    q["contained_reads"] = _with(GRAPH[:3], "SELECT * FROM contained")
    q["overlap_graph"] = _with(GRAPH, "SELECT component, src, src_strand, dst, dst_strand, overhang FROM edges JOIN component ON src = node", COMPONENT)
    toured = """SELECT component, path_id, pos, read_id, strand, overhang FROM chain JOIN component ON node = path_id"""
    q["overlap_graph_dead_ends"] = _with(
        [*GRAPH[:-1], *TIPS, "edges"], "SELECT component, src, src_strand, dst, dst_strand, overhang FROM edges JOIN component ON src = node", COMPONENT,
        instead={"edges": "SELECT * FROM dovetails d WHERE NOT EXISTS (FROM gone g WHERE g.u = d.u AND g.v = d.v)"})
    q["tour"] = _with(GRAPH, toured, f"{COMPONENT}, {CHAINS}")
    q["path_sequences"] = _with([*GRAPH, "layout_reads"], f"""
        SELECT component, path_id, off // 500 AS segment, count(*) AS n_reads, string_agg(piece, '' ORDER BY pos) AS seq FROM (
            SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY path_id ORDER BY pos) AS BIGINT) - length(piece) AS off FROM (
                SELECT t.*, CASE WHEN pos = 0 THEN turned ELSE right(turned, overhang) END AS piece FROM ({toured}) t JOIN (
                    SELECT *, reverse(translate(seq, 'ACGT', 'TGCA')) AS back FROM layout_reads) r ON t.read_id = r.read_id, LATERAL (SELECT CASE t.strand WHEN '-' THEN back ELSE seq END AS turned)))
        GROUP BY ALL""", f"{COMPONENT}, {CHAINS}")

    q["streamed_status"] = q["fold_status"]
    q["streamed_failures"] = q["attribute_failures"]
    q["streamed_longest"] = q["longest_n"]
    q["streamed_screen"] = q["screen"]
    return q
