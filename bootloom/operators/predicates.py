"""Predicates over log lines: cheap word tests, and states to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.functions import formats as fmt


def _has(word: str, column: str = "line") -> Column:
    return F.col(column).contains(word)


def is_frequency_line(colon: bool = False) -> Column:
    """Kernel trace of a frequency change or hotplug; ``colon`` asks for the tag's colon as well."""
    end = ":" if colon else ""
    return _has(fmt.TRACE_SOURCE) & (_has(fmt.CPU_FREQUENCY + end) | _has(fmt.HOTPLUG + end))


def is_online_cpus_line() -> Column:
    """Kernel trace of the number of online CPUs."""
    return _has(fmt.TRACE_SOURCE) & _has(fmt.ONLINE_CPUS)


def is_thermal_line(trace_only: bool = False) -> Column:
    """Line that speaks of a temperature sample; ``trace_only`` asks for the kernel trace."""
    return (_has(fmt.TRACE_SOURCE) & _has(fmt.THERMAL)) if trace_only else _has(fmt.THERMAL)


def is_pvs_line() -> Column:
    """Line that speaks of the silicon bin."""
    return _has(fmt.PVS_WORD)


def is_healthd_text() -> Column:
    """Printk payload with a battery report and its charger field."""
    return (F.col("tag") == fmt.PRINTK_SOURCE) & _has("healthd", "payload") & _has("chg", "payload")


def is_power_event() -> Column:
    """Printk line of suspend entry or exit."""
    return _has(fmt.PRINTK_SOURCE) & (_has(fmt.SUSPEND_ENTRY_WORD) | _has(fmt.SUSPEND_EXIT_WORD))


def in_state(tracked: DataFrame, column: str, *states: str) -> DataFrame:
    """Keep the lines in one of the states; none given keeps no line."""
    return tracked.where(F.col(column).isin(*states) if states else F.lit(False))


def exclusive(tracked: DataFrame, is_event: Column) -> DataFrame:
    """Keep only the lines that carry the tracker's own event."""
    return tracked.where(is_event)
