"""Typed events from the payloads of log lines.

Every function takes parsed lines and returns one row per event of its kind.
The word test on the whole line comes first, so the patterns run on few lines
and, over raw text, the test reaches below the line parsing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.functions import formats as fmt
from bootloom.functions.text import capture, field, fields, int_or_error, int_or_zero, log_time, with_fields
from bootloom.operators.predicates import is_healthd_text, is_pvs_line

TRACE_COLUMNS = ["thread", "trace_cpu", "flags", "trace_timestamp", "trace_tag", "text"]


def parse_trace(lines: DataFrame) -> DataFrame:
    """Lines whose payload has a kernel-trace header, with the header's fields."""
    return capture(lines, "_t", F.col("payload"), fmt.TRACE_HEADER, 6).select(
        *lines.columns,
        field("_t", 1).alias("thread"),
        field("_t", 2).try_cast("int").alias("trace_cpu"),
        field("_t", 3).alias("flags"),
        field("_t", 4).try_cast("double").alias("trace_timestamp"),
        field("_t", 5).alias("trace_tag"),
        field("_t", 6).alias("text"),
    )


def _trace_events(
    lines: DataFrame, tag: str, pattern: str, count: int, columns: dict[str, Column], needed: list[str]
) -> DataFrame:
    tagged = parse_trace(lines.where(F.col("line").contains(tag))).where(F.col("trace_tag") == tag)
    found = capture(tagged, "_p", F.col("text"), pattern, count)
    typed = found.select(*tagged.columns, *[value.alias(name) for name, value in columns.items()])
    return typed.dropna(subset=needed) if needed else typed


def _numbers(names: list[str], parse: Callable[..., Column], base0: bool, first: int = 1) -> dict[str, Column]:
    return {name: parse(field("_p", first + i), 32, base0) for i, name in enumerate(names)}


def hotplug_events(lines: DataFrame, base0: bool = False) -> DataFrame:
    """``cpu``, ``state`` (a word such as online or offline) and ``error`` of CPU hotplug events."""
    columns = {
        "cpu": int_or_error(field("_p", 1), 32, base0),
        "state": field("_p", 2),
        "error": int_or_error(field("_p", 3), 32, base0),
    }
    return _trace_events(lines, fmt.HOTPLUG, fmt.HOTPLUG_TEXT, 3, columns, ["cpu", "error"])


def thermal_events(lines: DataFrame, base0: bool = False) -> DataFrame:
    """``sensor_id`` and ``temp`` of temperature samples."""
    columns = _numbers(["sensor_id", "temp"], int_or_error, base0)
    return _trace_events(lines, fmt.THERMAL, fmt.THERMAL_TEXT, 2, columns, list(columns))


def cpu_frequency_events(lines: DataFrame, base0: bool = False) -> DataFrame:
    """``freq`` (kHz) and ``cpu`` of frequency changes."""
    columns = _numbers(["freq", "cpu"], int_or_error, base0)
    return _trace_events(lines, fmt.CPU_FREQUENCY, fmt.CPU_FREQUENCY_TEXT, 2, columns, list(columns))


def num_online_cpus_events(lines: DataFrame, base0: bool = False) -> DataFrame:
    """``num_online_cpus`` samples."""
    columns = _numbers(["num_online_cpus"], int_or_error, base0)
    return _trace_events(lines, fmt.ONLINE_CPUS, fmt.ONLINE_CPUS_TEXT, 1, columns, list(columns))


def proc_foreground_events(lines: DataFrame, base0: bool = False) -> DataFrame:
    """``fg_pid``, ``fg_tgid`` and ``comm`` of foreground changes; pid 0 means no foreground process."""
    columns = _numbers(["fg_pid", "fg_tgid"], int_or_error, base0) | {"comm": field("_p", 3)}
    return _trace_events(lines, fmt.FOREGROUND, fmt.FOREGROUND_TEXT, 3, columns, ["fg_pid", "fg_tgid"])


def ctx_switch_marker_events(lines: DataFrame, base0: bool = False) -> DataFrame:
    """``marker`` (BEGIN, END), ``cpu``, ``count`` and ``log_idx``; a number out of range is 0."""
    columns = {
        "marker": field("_p", 1),
        "cpu": int_or_zero(field("_p", 2), 32, base0),
        "count": int_or_zero(field("_p", 3), 32, base0),
        "log_idx": int_or_zero(field("_p", 4), 64, base0),
    }
    return _trace_events(lines, fmt.CTX_MARKER, fmt.CTX_MARKER_TEXT, 4, columns, [])


CTX_INFO_COUNTERS = [
    "utime", "stime", "rtime", "bg_utime", "bg_stime", "bg_rtime",
    "s_run", "s_int", "s_unint", "s_oth", "log_idx", "rx", "tx",
]


def ctx_switch_info_events(lines: DataFrame, base0: bool = False) -> DataFrame:
    """Scheduling counters of one process; a number missing or out of range is 0."""
    columns = _numbers(["cpu", "task_pid", "task_tgid", "nice"], int_or_zero, base0) | {"comm": field("_p", 5)}
    columns |= {name: int_or_zero(field("_p", 6 + i), 64, base0) for i, name in enumerate(CTX_INFO_COUNTERS)}
    return _trace_events(lines, fmt.CTX_INFO, fmt.CTX_INFO_TEXT, 18, columns, [])


TRACE_EVENTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    fmt.HOTPLUG: hotplug_events,
    fmt.THERMAL: thermal_events,
    fmt.CPU_FREQUENCY: cpu_frequency_events,
    fmt.ONLINE_CPUS: num_online_cpus_events,
    fmt.FOREGROUND: proc_foreground_events,
    fmt.CTX_MARKER: ctx_switch_marker_events,
    fmt.CTX_INFO: ctx_switch_info_events,
}


def trace_events(lines: DataFrame, tag: str, base0: bool = False) -> DataFrame:
    """The events of one trace tag; a tag without a typed payload has none."""
    if tag in TRACE_EVENTS:
        return TRACE_EVENTS[tag](lines, base0)
    return parse_trace(lines.where(F.lit(False)))


# Numbers each trace text must hold within 32 bits, by position.
_STRICT = {
    fmt.HOTPLUG: (fmt.HOTPLUG_TEXT, (1, 3)),
    fmt.THERMAL: (fmt.THERMAL_TEXT, (1, 2)),
    fmt.CPU_FREQUENCY: (fmt.CPU_FREQUENCY_TEXT, (1, 2)),
    fmt.ONLINE_CPUS: (fmt.ONLINE_CPUS_TEXT, (1,)),
    fmt.FOREGROUND: (fmt.FOREGROUND_TEXT, (1, 2)),
    fmt.CTX_MARKER: (fmt.CTX_MARKER_TEXT, ()),
    fmt.CTX_INFO: (fmt.CTX_INFO_TEXT, ()),
}


def recognised_trace(lines: DataFrame, base0: bool = False) -> DataFrame:
    """Lines that hold a valid event of any of the seven trace tags, with the header's fields."""
    trace = parse_trace(lines)
    valid = F.lit(False)
    for tag, (pattern, strict) in _STRICT.items():
        fits = F.col("text").rlike(f"(?d:{pattern})")
        for n in strict:
            fits = fits & int_or_error(F.regexp_extract("text", f"(?d:{pattern})", n), 32, base0).isNotNull()
        valid = F.when(F.col("trace_tag") == tag, fits).otherwise(valid)
    return trace.where(valid)


def msm_thermal_events(lines: DataFrame, base0: bool = False) -> DataFrame:
    """``state`` (OFFLINE, ONLINE), ``cpu`` and ``temp`` of the thermal driver's hotplug messages."""
    hits = capture(
        lines.where(F.col("line").contains("msm_thermal")), "_p", F.col("payload"), fmt.MSM_THERMAL_TEXT, 3
    )
    return hits.select(
        *lines.columns,
        F.when(field("_p", 1) == "Set Offline:", "OFFLINE").otherwise("ONLINE").alias("state"),
        int_or_error(field("_p", 2), 32, base0).alias("cpu"),
        int_or_error(field("_p", 3), 32, base0).alias("temp"),
    ).dropna(subset=["cpu", "temp"])


def power_events(lines: DataFrame) -> DataFrame:
    """``power`` (entry, exit) of suspend and ``power_time``, the kernel's own clock reading."""
    hits = capture(lines.where(F.col("line").contains("PM: suspend")), "_p", F.col("payload"), fmt.POWER_TEXT, 2)
    return hits.select(
        *lines.columns, field("_p", 1).alias("power"), log_time(field("_p", 2)).alias("power_time")
    ).dropna(subset=["power_time"])


def healthd_events(lines: DataFrame, base0: bool = False) -> DataFrame:
    """Battery reports: ``timestamp, l, v, t, h, st, c`` and ``chg`` (charger letters or empty)."""
    hits = capture(lines.where(F.col("line").contains("healthd:")), "_p", F.col("payload"), fmt.HEALTHD_TEXT, 8)
    return hits.select(
        *lines.columns,
        field("_p", 1).try_cast("double").alias("timestamp"),
        int_or_error(field("_p", 2), 32, base0).alias("l"),
        int_or_error(field("_p", 3), 32, base0).alias("v"),
        field("_p", 4).try_cast("double").alias("t"),
        int_or_error(field("_p", 5), 32, base0).alias("h"),
        int_or_error(field("_p", 6), 32, base0).alias("st"),
        int_or_error(field("_p", 7), 32, base0).alias("c"),
        field("_p", 8).alias("chg"),
    ).dropna(subset=["timestamp", "l", "v", "t", "h", "st", "c"])


def pvs_events(lines: DataFrame, base0: bool = False) -> DataFrame:
    """``timestamp`` and ``pvs_bin`` (silicon bin) by the full message pattern."""
    hits = capture(lines.where(is_pvs_line()), "_p", F.col("payload"), fmt.PVS_TEXT, 2)
    return hits.select(
        *lines.columns,
        field("_p", 1).try_cast("double").alias("timestamp"),
        int_or_error(field("_p", 2), 32, base0).alias("pvs_bin"),
    ).dropna(subset=["timestamp", "pvs_bin"])


def pvs_last_digit(lines: DataFrame) -> DataFrame:
    """``pvs_bin`` as the last character of every line that speaks of the silicon bin."""
    return (
        lines.where(is_pvs_line())
        .withColumn("pvs_bin", F.expr("right(payload, 1)").try_cast("int"))
        .dropna(subset=["pvs_bin"])
    )


def cpu_events(lines: DataFrame, base0: bool = False) -> DataFrame:
    """Frequency changes and hotplug events in one table, read in one pass.

    ``cpu``; ``freq`` for frequency changes, else NULL; ``word`` and ``error``
    for hotplug events, else NULL.
    """
    words = F.col("line").contains(fmt.CPU_FREQUENCY) | F.col("line").contains(fmt.HOTPLUG)
    trace = parse_trace(lines.where(words)).where(F.col("trace_tag").isin(fmt.CPU_FREQUENCY, fmt.HOTPLUG))
    # Fields 1 and 2 are the frequency's, 3 to 5 the hotplug's.
    is_freq = F.col("trace_tag") == fmt.CPU_FREQUENCY
    either = F.when(is_freq, fields(F.col("text"), (fmt.CPU_FREQUENCY_TEXT, [1, 2, 0, 0, 0]))).otherwise(
        fields(F.col("text"), (fmt.HOTPLUG_TEXT, [0, 0, 1, 2, 3]))
    )
    found = with_fields(trace, "_p", either)
    typed = found.select(
        *trace.columns,
        int_or_error(F.when(is_freq, field("_p", 2)).otherwise(field("_p", 3)), 32, base0).alias("cpu"),
        F.when(is_freq, int_or_error(field("_p", 1), 32, base0)).alias("freq"),
        F.when(~is_freq, field("_p", 4)).alias("word"),
        F.when(~is_freq, int_or_error(field("_p", 5), 32, base0)).alias("error"),
    )
    return typed.where("cpu is not null and (freq is not null or error is not null)")


def battery_reports(lines: DataFrame, base0: bool = False) -> DataFrame:
    """The battery reports that the discharge chunks are cut by."""
    return healthd_events(lines.where(is_healthd_text()), base0)
