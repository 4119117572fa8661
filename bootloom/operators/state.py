"""State of the phone as of each line: charging, foreground, suspend, CPUs, day.

The trackers add columns to the lines they are given and keep every line;
:func:`track` runs several in one pass.  Their transitions come as tables with one row
per change instead of callbacks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.functions import formats as fmt
from bootloom.operators.events import healthd_events, power_events, proc_foreground_events
from bootloom.operators.lineage import settle
from bootloom.operators.machines import Machine
from bootloom.operators.ordering import BOOT, ORDER, as_of, carry
from bootloom.operators.predicates import is_power_event

UNKNOWN = "UNKNOWN"
_PLACE = [*BOOT, "segment", *ORDER]


@dataclass(frozen=True)
class Tracker:
    """A state set by events of its own: column ``name``, as ``changes`` finds it in lines.

    Each event sets its state whatever the one before is; for states that depend
    on the one before there is :class:`bootloom.operators.machines.Machine`.
    """

    name: str
    changes: Callable[[DataFrame], DataFrame]
    initial: str | int = UNKNOWN


def track(lines: DataFrame, *trackers: Tracker | Machine) -> DataFrame:
    """Add the state of each tracker or machine as of each line, all in one ordered pass."""
    found = [t.changes(lines).select(*_PLACE, t.name) for t in trackers]
    events = settle(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found))
    tracked = as_of(lines, events, {t.name: F.col(t.name) for t in trackers})
    return tracked.withColumns({t.name: F.coalesce(t.name, F.lit(t.initial)) for t in trackers})


def charging(empty_means_charging: bool = True) -> Tracker:
    """``charging_state``: UNKNOWN, CHARGING or UNPLUGGED.

    An empty charger field means CHARGING by default.  The discharge chunks read
    the field the other way round, which ``empty_means_charging=False`` gives.
    """
    empty, letters = ("CHARGING", "UNPLUGGED") if empty_means_charging else ("UNPLUGGED", "CHARGING")

    def changes(lines: DataFrame) -> DataFrame:
        state = F.when(F.col("chg") == "", empty).otherwise(letters)
        return healthd_events(lines).withColumn("charging_state", state)

    return Tracker("charging_state", changes)


def suspending() -> Tracker:
    """``suspend_state``: UNKNOWN, SUSPENDED or AWAKE."""

    def changes(lines: DataFrame) -> DataFrame:
        state = F.when(F.col("power") == "entry", "SUSPENDED").otherwise("AWAKE")
        return power_events(lines.where(is_power_event())).withColumn("suspend_state", state)

    return Tracker("suspend_state", changes)


def fronting() -> Tracker:
    """``active_pid``: pid of the latest foreground event, 0 before the first; no delay."""
    return Tracker("active_pid", lambda lines: proc_foreground_events(lines).withColumn("active_pid", F.col("fg_pid")), 0)


def charging_state(lines: DataFrame, empty_means_charging: bool = True) -> DataFrame:
    """Add ``charging_state``, see :func:`charging`."""
    return track(lines, charging(empty_means_charging))


def charging_transitions(lines: DataFrame, empty_means_charging: bool = True) -> DataFrame:
    """Battery reports with ``old_state`` and ``new_state`` (which may be equal)."""
    reports = charging(empty_means_charging).changes(lines).withColumnRenamed("charging_state", "new_state")
    tracked = carry(reports, before={"old_state": F.col("new_state")})
    return tracked.withColumn("old_state", F.coalesce("old_state", F.lit(UNKNOWN)))


def is_charging_event() -> Column:
    """Line that carries the charging tracker's own event."""
    return F.col("line").contains("healthd:")


def suspend_state(lines: DataFrame) -> DataFrame:
    """Add ``suspend_state``, see :func:`suspending`."""
    return track(lines, suspending())


def suspend_transitions(lines: DataFrame) -> DataFrame:
    """Suspend entries and exits with ``old_state``, ``new_state`` and ``anomaly``.

    ``anomaly`` is ``entry while suspended``, ``exit while not suspended`` or NULL.
    """
    events = power_events(lines.where(is_power_event()))
    new = F.when(F.col("power") == "entry", "SUSPENDED").otherwise("AWAKE")
    tracked = carry(events.withColumn("new_state", new), before={"old_state": F.col("new_state")})
    old = F.coalesce("old_state", F.lit(UNKNOWN))
    return tracked.withColumns(
        {
            "old_state": old,
            "anomaly": F.when((F.col("power") == "entry") & (old == "SUSPENDED"), "entry while suspended").when(
                (F.col("power") == "exit") & (old != "SUSPENDED"), "exit while not suspended"
            ),
        }
    )


def suspend_intervals(lines: DataFrame) -> DataFrame:
    """Each suspend exit that follows an entry: ``entry_us``, ``exit_us`` and ``suspended_us``."""
    events = power_events(lines.where(is_power_event()))
    entered = F.struct(F.when(F.col("power") == "entry", F.col("trace_us")).alias("us"))
    paired = carry(events, before={"_entry": entered})
    return paired.where("power = 'exit' and _entry.us is not null").select(
        *BOOT,
        F.col("_entry.us").alias("entry_us"),
        F.col("trace_us").alias("exit_us"),
        (F.col("trace_us") - F.col("_entry.us")).alias("suspended_us"),
    )


def is_fgbg_event() -> Column:
    """Line that carries the foreground tracker's own event."""
    return F.col("line").contains(fmt.FOREGROUND + ":")


def _fronts(events: DataFrame) -> DataFrame:
    """Places of foreground events with ``event``: whether a process is in front, and the place once more."""
    front = (F.col("fg_pid") != 0).alias("front")
    return events.select(*_PLACE, F.struct(front, *ORDER).alias("event"))


def _marks(places: DataFrame, fronts: DataFrame, delay_seconds: float) -> DataFrame:
    """Places that set the state, with ``mark``: those of processes in front, and where a delay has run out.

    One pass over all lines' places: each gets the latest event, and in the same
    partitions the first line of a segment at which that event's delay is over
    is taken.  Of these few rows the first for each event counts.
    """
    timed = as_of(places.select(*_PLACE), fronts, {"_event": F.col("event")})
    late = ~F.col("_event.front") & (F.col("trace_us") - F.col("_event.trace_us") > int(delay_seconds * 1_000_000))
    firsts = timed.where(late).groupBy("segment", *BOOT, "_event").agg(F.min(F.struct(*ORDER)).alias("_at"))
    over = firsts.groupBy(*BOOT, "_event").agg(F.min(F.struct("_at", "segment")).alias("_first"))
    back = over.select(*BOOT, "_first.segment", "_first._at.*", F.lit("BACKGROUND").alias("mark"))
    fore = fronts.where("event.front").select(*_PLACE, F.lit("FOREGROUND").alias("mark"))
    return settle(fore.unionByName(back))


def _with_old(marked: DataFrame) -> DataFrame:
    tracked = carry(marked.withColumnRenamed("mark", "new_state"), before={"old_state": F.col("new_state")})
    return tracked.withColumn("old_state", F.coalesce("old_state", F.lit(UNKNOWN)))


def fgbg_state(lines: DataFrame, delay_seconds: float = 1.0) -> DataFrame:
    """Add ``fgbg_state`` (UNKNOWN, FOREGROUND, BACKGROUND).

    A foreground process sets FOREGROUND at once.  Its absence sets BACKGROUND
    with the first line more than ``delay_seconds`` later, of whatever kind, so
    all lines of the boot are needed.
    """
    marks = _marks(lines, settle(_fronts(proc_foreground_events(lines))), delay_seconds)
    tracked = as_of(lines, marks, {"fgbg_state": F.col("mark")})
    return tracked.select(*lines.columns, F.coalesce("fgbg_state", F.lit(UNKNOWN)).alias("fgbg_state"))


def fgbg_transitions(lines: DataFrame, delay_seconds: float = 1.0) -> DataFrame:
    """Lines that set the state, with ``old_state`` and ``new_state`` (which may be equal).

    Only places of lines are scanned in order; the few lines at which a delay has
    run out are looked up afterwards.
    """
    events = settle(proc_foreground_events(lines).select(*lines.columns, "fg_pid"))
    marks = _marks(lines, _fronts(events), delay_seconds)
    back = marks.where("mark = 'BACKGROUND'").drop("mark")
    # Equal lines have one place: a delay runs out at the first of them.
    found = lines.join(back, _PLACE, "left_semi").dropDuplicates(_PLACE).withColumn("mark", F.lit("BACKGROUND"))
    fore = events.where("fg_pid <> 0").drop("fg_pid").withColumn("mark", F.lit("FOREGROUND"))
    return _with_old(settle(fore.unionByName(found.select(*fore.columns)))).select(*lines.columns, "old_state", "new_state")


def fgbg_changes(lines: DataFrame, delay_seconds: float = 1.0) -> DataFrame:
    """The places of :func:`fgbg_transitions` with their states; no text of other lines than events is read or moved."""
    return fgbg_changes_of(lines, proc_foreground_events(lines), delay_seconds)


def fgbg_changes_of(places: DataFrame, events: DataFrame, delay_seconds: float = 1.0) -> DataFrame:
    """:func:`fgbg_changes` from the places of lines and their foreground events (``fg_pid``)."""
    changes = _with_old(_marks(places, settle(_fronts(events)), delay_seconds))
    return changes.select(*[c for c in places.columns if c in _PLACE], "old_state", "new_state")


def active_pid(lines: DataFrame) -> DataFrame:
    """Add ``active_pid``, see :func:`fronting`."""
    return track(lines, fronting())


def active_use(lines: DataFrame) -> DataFrame:
    """Lines written while a foreground process is known."""
    return active_pid(lines).where(F.col("active_pid") != 0)


def cpu_state(events: DataFrame, before: bool = False) -> DataFrame:
    """Add the tracked ``cpu_state`` and ``cpu_freq`` of the event's CPU to CPU events.

    ``events`` comes from :func:`bootloom.operators.events.cpu_events`.  The
    state is UNKNOWN, OFFLINE or ONLINE, and the frequency 0 until one is seen;
    it is kept while the CPU is offline.  ``before`` gives the state that the
    event finds instead of the one it leaves.
    """
    clean = F.col("error") == 0
    state = (
        F.when(F.col("freq").isNotNull(), "ONLINE")
        .when(clean & (F.col("word") == "online"), "ONLINE")
        .when(clean & (F.col("word") == "offline"), "OFFLINE")
    )
    wanted = {"cpu_state": state, "cpu_freq": F.col("freq")}
    tracked = carry(events, keys=[*BOOT, "cpu"], **({"before": wanted} if before else {"at": wanted}))
    return tracked.withColumns(
        {"cpu_state": F.coalesce("cpu_state", F.lit(UNKNOWN)), "cpu_freq": F.coalesce("cpu_freq", F.lit(0))}
    )


def day_boundaries(lines: DataFrame) -> DataFrame:
    """Lines whose day of the year differs from that of the line before, with ``old_day`` and ``new_day``.

    Places and days are scanned in order; the text of the few boundaries is
    looked up afterwards.
    """
    days = lines.select(*_PLACE, F.dayofyear("datetime").alias("new_day"))
    bounds = settle(carry(days, before={"old_day": F.col("new_day")}).where(F.col("old_day") != F.col("new_day")))
    # Equal lines have one place and one day: the first of them is the boundary.
    found = lines.join(bounds, _PLACE).dropDuplicates(_PLACE)
    return found.select(*lines.columns, "old_day", "new_day")
