"""Fleet-wide distributions: from parsed lines to a small result table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.functions import formats as fmt
from bootloom.operators.events import (
    TRACE_EVENTS,
    cpu_events,
    num_online_cpus_events,
    proc_foreground_events,
    pvs_last_digit,
    recognised_trace,
    thermal_events,
)
from bootloom.operators.lineage import settle
from bootloom.operators.ordering import BOOT, ORDER, carry
from bootloom.operators.predicates import is_frequency_line, is_online_cpus_line, is_thermal_line
from bootloom.operators.spans import freq_combinations, freq_spans, ncpu_spans


def _narrow(events: DataFrame, *columns: str) -> DataFrame:
    return settle(events.select(*BOOT, "segment", *ORDER, *columns))


def freq_time_total(lines: DataFrame, close_on_offline: bool = False) -> DataFrame:
    """``freq`` and the time spent in it over all CPUs, boots and devices."""
    events = _narrow(cpu_events(lines.where(is_frequency_line(colon=True))), "cpu", "freq", "word", "error")
    spans = freq_spans(events, close_on_offline)
    totals = spans.groupBy("freq").agg(F.sum("duration_us").alias("total_us"))
    return totals.withColumn("seconds", F.col("total_us") / 1_000_000)


def _boot_extent(recognised: DataFrame) -> DataFrame:
    """``boot_us``: time from the first to the last of the given lines of each boot."""
    place = F.struct(*ORDER)
    return recognised.groupBy(*BOOT).agg(
        (F.max_by("trace_us", place) - F.min_by("trace_us", place)).alias("boot_us")
    )


def _shares(spans: DataFrame, key: str, extent: DataFrame) -> DataFrame:
    times = spans.groupBy(*BOOT, key).agg(F.sum("duration_us").alias("duration_us"))
    return times.join(extent, BOOT).select(
        key,
        *BOOT,
        "duration_us",
        F.try_divide(F.col("duration_us").cast("double"), F.col("boot_us").cast("double")).alias("share"),
    )


def _extent_of(events: DataFrame, wanted: DataFrame, tags: list[str]) -> DataFrame:
    """Extent of the boots over ``events``, which are all valid ones of ``tags``, and valid events of other tags.

    Only lines that name another tag are read for the latter: hardly any, as
    ``wanted`` has the lines with the words of ``tags``.
    """
    named = reduce(or_, [F.col("line").contains(tag) for tag in TRACE_EVENTS if tag not in tags])
    others = recognised_trace(wanted.where(named)).where(~F.col("trace_tag").isin(tags))
    places = [*BOOT, *ORDER]
    return _boot_extent(events.select(*places).unionByName(others.select(*places)))


def freq_combination_share(lines: DataFrame, cpus: int = 4) -> DataFrame:
    """Share of each boot's time in each combination of the online CPUs' frequencies.

    One row per boot and combination; a boot of no duration has NULL shares.
    """
    wanted = lines.where(is_frequency_line())
    events = _narrow(cpu_events(wanted), "cpu", "freq", "word", "error")
    sound = events.where(F.coalesce("error", F.lit(0)) == 0)
    extent = _extent_of(sound, wanted, [fmt.CPU_FREQUENCY, fmt.HOTPLUG])
    return _shares(freq_combinations(events, cpus), "freq_key", extent)


def ncpu_share(lines: DataFrame) -> DataFrame:
    """Share of each boot's time with each number of online CPUs, one row per boot and number."""
    wanted = lines.where(is_online_cpus_line())
    events = _narrow(num_online_cpus_events(wanted), "num_online_cpus")
    extent = _extent_of(events, wanted, [fmt.ONLINE_CPUS])
    return _shares(ncpu_spans(events), "num_online_cpus", extent)


def temp_histogram(lines: DataFrame) -> DataFrame:
    """Number of temperature samples per ``temp``, all sensors, while a process is in the foreground."""
    fronts = _narrow(proc_foreground_events(lines), "fg_pid")
    samples = _narrow(thermal_events(lines.where(is_thermal_line(trace_only=True))), "temp")
    both = fronts.unionByName(samples, allowMissingColumns=True)
    known = carry(both, at={"active_pid": F.col("fg_pid")})
    return known.where("temp is not null and active_pid <> 0").groupBy("temp").agg(F.count("*").alias("samples"))


def pvs_by_device(lines: DataFrame) -> DataFrame:
    """Silicon bin of each device, by its first boot and line that tells it."""
    found = pvs_last_digit(lines)
    return found.groupBy("device_id").agg(F.min_by("pvs_bin", F.struct("boot_id", *ORDER)).alias("pvs_bin"))


def thermal_line_counts(lines: DataFrame) -> DataFrame:
    """Number of lines with a temperature sample per device."""
    return thermal_events(lines).groupBy("device_id").agg(F.count("*").alias("lines"))


def bounded_lists(df: DataFrame, keys: list[str], value: Column, name: str, limit: int = 100_000) -> DataFrame:
    """The values of each key as sorted lists of about ``limit`` at most, numbered by ``part``.

    A key with n values has ceil(n / limit) rows, whatever other keys have, and a
    hash of the value says which row it is in; so no list is collected whole into
    one task, and a key's rows depend on its own values only.
    """
    valued = df.select(*keys, value.alias(name), F.xxhash64(*df.columns).alias("_h"))
    parts = valued.groupBy(*keys).agg(F.ceil(F.count("*") / limit).alias("_parts"))
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    spread = F.pmod("_h", "_parts").cast("int")
    joined = valued.alias("v").join(parts.alias("p"), same)
    return (
        joined.select(*[F.col(f"v.{k}").alias(k) for k in keys], spread.alias("part"), name)
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(name)).alias(name))
    )


def share_lists(shares: DataFrame, key: str, limit: int = 100_000) -> DataFrame:
    """Per key the list of shares over all boots, for export."""
    return bounded_lists(shares, [key], F.col("share"), "shares", limit)
