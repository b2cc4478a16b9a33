"""Column layouts of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

SUBREAD = _struct(cell=_S, hole=_L, qs=_L, qe=_L)

INDEX = _struct(id=_S, len=_L, na=_L, nc=_L, ng=_L, nt=_L, nn=_L, offset=_L, hash=_L)

ACCOUNTING = _struct(
    job_task=_S, job_raw=_S, node=_S, cluster=_S,
    disk_read=_S, disk_write=_S, elapsed=_S, state=_S,
)

SAMPLE = _struct(
    cluster=_S, node=_S, job_raw=_S, localtime=_S, raw_time=_L,
    mem_limit_gb=_D, mem_used_gb=_D, swap_used_gb=_D, cores=T.ArrayType(_D),
)

WORK = _struct(
    rowid=_L, block_id1=_L, block_id2=_L, priority=_L, status=_S,
    use_masking=T.BooleanType(), jobid=_S, reservation_token=_S,
)

OVERLAP = _struct(
    a=_L, b=_L, strand=_S, ab=_L, ae=_L, bb=_L, be=_L,
    a_len=_L, b_len=_L, diffs=_L, block=_L,
)

TRACK = _struct(read_id=_L, kind=_S, b=_L, e=_L)

EDGE = _struct(src=_L, src_strand=_S, dst=_L, dst_strand=_S, overhang=_L)

PATH = _struct(component=_L, path_id=_L, pos=_L, read_id=_L, strand=_S, overhang=_L)

# Status names of a work item.
PENDING = "PENDING"
RUNNING = "RUNNING"
COMPLETED = "COMPLETED"
COMPLETING = "COMPLETING"
CONFIGURING = "CONFIGURING"
FAILED = "FAILED"
NOTSTARTED = "NOTSTARTED"
RESERVED = "RESERVED"
TIMEOUT = "TIMEOUT"
CANCELLED = "CANCELLED"
STATUSES = (
    PENDING, RUNNING, COMPLETED, COMPLETING, CONFIGURING,
    FAILED, NOTSTARTED, RESERVED, TIMEOUT, CANCELLED,
)
