"""Time spent in a state between consecutive events, in whole microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bootloom.operators.lineage import settle
from bootloom.operators.ordering import BOOT, ORDER, carry


def freq_spans(events: DataFrame, close_on_offline: bool = False) -> DataFrame:
    """``freq`` and ``duration_us`` of each span that a CPU event closes.

    A span runs from a frequency change to the next change of the same CPU, and
    to each offline word between them.  Offline does not end the span by
    default, so the time up to the next change counts again;
    ``close_on_offline`` ends it there.  ``events`` comes from
    :func:`bootloom.operators.events.cpu_events`.
    """
    offline = F.col("word").eqNullSafe("offline")
    sets = F.col("freq").isNotNull() | (offline if close_on_offline else F.lit(False))
    opened = F.when(sets, F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), F.col("trace_us")))
    relevant = events.where(F.col("freq").isNotNull() | offline)
    spans = carry(relevant, before={"_open": opened}, keys=[*BOOT, "cpu"]).where("_open.freq <> 0")
    return spans.select(
        *BOOT,
        "cpu",
        "logcat_token",
        F.col("_open.freq").alias("freq"),
        (F.col("trace_us") - F.col("_open.trace_us")).alias("duration_us"),
    )


def ncpu_spans(events: DataFrame) -> DataFrame:
    """``num_online_cpus`` and ``duration_us`` between consecutive samples of a boot."""
    sample = F.struct("num_online_cpus", "trace_us")
    spans = carry(events, before={"_last": sample}).where("_last is not null")
    return spans.select(
        *BOOT,
        "logcat_token",
        F.col("_last.num_online_cpus").alias("num_online_cpus"),
        (F.col("trace_us") - F.col("_last.trace_us")).alias("duration_us"),
    )


def freq_combinations(events: DataFrame, cpus: int = 4) -> DataFrame:
    """``freq_key`` and ``duration_us`` between CPU events at which the state of all CPUs is known.

    The key joins the frequencies of the online CPUs, sorted as text, with
    ``-``.  Time before the state is complete goes to the first complete state.
    Hotplug events with an error do not count, nor do CPUs from ``cpus`` on.
    """
    counted = events.where((F.coalesce("error", F.lit(0)) == 0) & F.col("cpu").between(0, cpus - 1))
    wanted = {"_seen": F.col("trace_us")}
    for n in range(cpus):
        here = F.col("cpu") == n
        wanted[f"_word{n}"] = F.when(here & F.col("word").isin("online", "offline"), F.col("word"))
        wanted[f"_freq{n}"] = F.when(here, F.coalesce("freq", F.when(F.col("word") == "offline", -1)))
    found = carry(counted, before=wanted)

    online = {
        n: F.coalesce(f"_word{n}", F.when(F.col(f"_freq{n}").isNotNull(), "online")) for n in range(cpus)
    }
    full = F.lit(True)
    for n in range(cpus):
        known = (online[n] == "offline") | ((online[n] == "online") & (F.coalesce(f"_freq{n}", F.lit(-1)) != -1))
        full = full & F.coalesce(known, F.lit(False))
    freqs = F.array(*[F.when(online[n] == "online", F.col(f"_freq{n}").cast("string")) for n in range(cpus)])
    keyed = settle(
        found.select(
            *BOOT,
            "segment",
            *ORDER,
            "_seen",
            full.alias("_full"),
            F.array_join(F.array_sort(F.array_compact(freqs)), "-").alias("freq_key"),
        )
    )
    started = F.when(F.col("_full") | F.col("_seen").isNull(), F.col("trace_us"))
    return (
        carry(keyed, before={"_start": started})
        .where("_full")
        .select(*BOOT, "logcat_token", "freq_key", (F.col("trace_us") - F.col("_start")).alias("duration_us"))
    )
