"""Context-switch sessions: scheduling counters between a BEGIN and an END marker of a CPU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.functions import formats as fmt
from bootloom.operators.events import ctx_switch_info_events, ctx_switch_marker_events
from bootloom.operators.lineage import settle
from bootloom.operators.ordering import BOOT, ORDER, carry

_PLACE = [*BOOT, "segment", *ORDER]
_PER_CPU = [*BOOT, "cpu"]
SESSION = [*BOOT, "cpu", "start_token", "end_token"]
INFO = ["task_pid", "task_tgid", "nice", "comm", "utime", "stime", "rtime", "bg_utime", "bg_stime", "bg_rtime",
        "s_run", "s_int", "s_unint", "s_oth", "log_idx", "rx", "tx"]


def session_bounds(lines: DataFrame) -> DataFrame:
    """One row per closed session: the places of its two markers, ``start`` and ``end``.

    A BEGIN inside an open session is ignored, as is an END outside one; a
    session without END is left out.
    """
    markers = settle(ctx_switch_marker_events(lines).select(*_PLACE, "cpu", "marker"))
    after = carry(markers, before={"_last": F.col("marker")}, keys=_PER_CPU)
    begins = (F.col("marker") == "BEGIN") & ~F.col("_last").eqNullSafe("BEGIN")
    ends = (F.col("marker") == "END") & F.col("_last").eqNullSafe("BEGIN")
    # What is left alternates between BEGIN and END.
    effective = after.where(begins | ends).drop("_last")
    paired = carry(effective, before={"start": F.struct("segment", *ORDER)}, keys=_PER_CPU)
    return paired.where("marker = 'END'").select(*BOOT, "cpu", "start", F.struct("segment", *ORDER).alias("end"))


def ctx_switch_sessions(lines: DataFrame) -> DataFrame:
    """Markers and counters of closed sessions, each with ``start_token`` and ``end_token``.

    Counters outside a session are left out.  The two marker rows of a session
    are there too (``marker`` is BEGIN or END), so empty sessions can be seen.
    """
    bounds = settle(session_bounds(lines))
    infos = ctx_switch_info_events(lines).select(*_PLACE, "cpu", *INFO)
    session = F.struct(F.col("start.logcat_token").alias("start"), F.col("end.logcat_token").alias("end"))

    def marks(which: str) -> DataFrame:
        place = [F.col(f"{which}.{c}").alias(c) for c in ("segment", *ORDER)]
        name = "BEGIN" if which == "start" else "END"
        return bounds.select(*BOOT, *place, "cpu", F.lit(name).alias("marker"), session.alias("_session"))

    rows = marks("start").unionByName(marks("end")).unionByName(infos, allowMissingColumns=True)
    # A session's own END still belongs to it; what follows up to the next BEGIN does not.
    placed = carry(
        rows,
        at={"_here": F.when(F.col("marker") == "BEGIN", F.col("_session"))},
        before={"_ended": F.when(F.col("marker") == "END", F.col("_session"))},
        keys=_PER_CPU,
    )
    inside = F.col("_here").isNotNull() & ~F.col("_here").eqNullSafe(F.col("_ended"))
    return placed.where(inside).select(
        *_PLACE,
        "cpu",
        "marker",
        *INFO,
        F.col("_here.start").alias("start_token"),
        F.col("_here.end").alias("end_token"),
    )


def session_metrics(sessions: DataFrame) -> DataFrame:
    """Per session: number of counter rows, ``total_time`` and the three busyness shares."""
    busy = ~F.col("comm").contains(fmt.IDLE_TASK_WORD)

    def time(value: Column, when: Column | None = None) -> Column:
        return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0))

    total = time(F.col("rtime"))

    def share(of: Column) -> Column:
        return F.coalesce(F.try_divide(of.cast("double"), total.cast("double")), F.lit(0.0))

    return sessions.groupBy(*SESSION).agg(
        F.count("comm").alias("infos"),
        total.alias("total_time"),
        share(time(F.col("rtime"), busy)).alias("busyness"),
        share(time(F.col("rtime") - F.col("bg_rtime"), busy)).alias("fg_busyness"),
        share(time(F.col("bg_rtime"), busy)).alias("bg_busyness"),
    )


def ctx_total_time(sessions: DataFrame) -> DataFrame:
    """``total_time``: the run time of all processes of a session."""
    return session_metrics(sessions).select(*SESSION, "total_time")


def ctx_busyness(sessions: DataFrame) -> DataFrame:
    """``busyness``: share of run time outside the idle task, 0 for a session without run time."""
    return session_metrics(sessions).select(*SESSION, "busyness")


def ctx_fg_busyness(sessions: DataFrame) -> DataFrame:
    """``fg_busyness``: as :func:`ctx_busyness`, without background run time."""
    return session_metrics(sessions).select(*SESSION, "fg_busyness")


def ctx_bg_busyness(sessions: DataFrame) -> DataFrame:
    """``bg_busyness``: as :func:`ctx_busyness`, background run time only."""
    return session_metrics(sessions).select(*SESSION, "bg_busyness")
