"""Phone-log lines rendered from the ``events`` table of the test data.

The checks and the benchmark need log text at any scale; this adapter derives
one line from every event, so the amount of text grows with the table.  The
layout is described in ``FIXTURES.md``, section 4.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bootloom.functions.text import epoch_micros
from bootloom.operators.lineage import shared_dir
from bootloom.operators.loglines import parse_loglines
from bootloom.sources.logs import packed, unpacked

_NUMBERS = {
    "k": "event_id",
    "u": "user_id",
    "v": "cast(round(value) as bigint)",
    "j": "event_id div 12",
    "t": "(us - 1704067200000000) div 3600",
}

_DERIVED = {
    "tt": "concat(cast(t div 1000000 as string), '.', lpad(cast(t % 1000000 as string), 6, '0'))",
    "boot": "concat('00000000-0000-4000-8000-', lpad(cast(u % 24 as string), 12, '0'))",
    "dev": "lpad(cast(u % 8 as string), 40, '0')",
    "dt": (
        "concat('2024-01-', lpad(cast(1 + (k div 400) % 28 as string), 2, '0'), ' 00:',"
        " lpad(cast((k div 60) % 60 as string), 2, '0'), ':', lpad(cast(k % 60 as string), 2, '0'),"
        " '.', cast(100000 + k % 800000 as string))"
    ),
}

_TEXT = """
case k % 12
  when 0 then concat('sched_cpu_hotplug: cpu ', j % 4, ' ', if(v % 3 = 0, 'offline', 'online'),
                     ' error=', if(v % 10 = 9, -1, 0))
  when 1 then concat('thermal_temp: sensor_id=', u % 6, ' temp=', 30 + v % 50)
  when 2 then concat('cpu_frequency: state=', 300000 * (1 + v % 5), ' cpu_id=', j % 4)
  when 3 then concat('cpu_frequency: state=', 300000 * (1 + v % 7), ' cpu_id=', (j + 1) % 4)
  when 4 then concat('phonelab_num_online_cpus: num_online_cpus=', 1 + v % 4)
  when 5 then concat('phonelab_proc_foreground: pid=', if(v % 2 = 0, 0, 100 + v),
                     ' tgid=', 100 + v, ' comm=app', v % 5)
  when 6 then concat('phonelab_periodic_ctx_switch_marker: ', if(v % 2 = 0, 'BEGIN', 'END'),
                     ' cpu=', (v % 3) % 2, ' count=', j, ' log_idx=', k)
  when 9 then concat('<6>[   ', tt, '] healthd: battery l=', 95 - (k div 700) % 40, ' v=', 3900 + v,
                     ' t=', 25 + v % 15, '.5 h=2 st=3 c=-', v, ' chg=', if(v % 13 = 0, 'u', ''))
  when 10 then case j % 3
    when 0 then concat('<6>[', tt, '] PM: suspend ', if(v % 2 = 0, 'entry', 'exit'), ' ', dt, ' UTC')
    when 1 then concat('<6>[', tt, '] msm_thermal: ', if(v % 2 = 0, 'Set Offline:', 'Allow Online'),
                       ' CPU', v % 4, ' Temp: ', 60 + v % 30)
    else concat('<6>[', tt, '] acpuclk-8974 qcom,acpuclk.30: ACPU PVS: ', u % 7) end
  when 11 then if(j % 3 = 0, 'unknown_tag: a=1', concat('cpu_frequency: state=300000 cpu_id=', j % 4))
  else concat('phonelab_periodic_ctx_switch_info: cpu=', v % 2, ' pid=', v, ' tgid=', v, ' nice=0 comm=',
              if(v % 4 = 0, 'swapper/0', 'kworker/0:1'), ' utime=0 stime=0 rtime=', 1000 + v,
              ' bg_utime=0 bg_stime=0 bg_rtime=', v, ' s_run=0 s_int=2 s_unint=0 s_oth=0 log_idx=', k,
              if(k % 12 = 8, ' rx=1 tx=2', ''))
end
"""

_LINE = """
case
  when k % 12 = 11 and j % 3 = 2 then 'dummy line'
  when k % 12 = 11 and j % 3 = 1 then
    concat(boot, ' ', dt, ' ', k, ' [', tt, ']   201   202 D Kernel-Trace:      ', payload)
  else concat_ws('  ', dev, t, concat(t, '.0'), boot, k, tt, dt, '201', '202', 'D',
                 if(k % 12 in (9, 10), 'KernelPrintk', 'Kernel-Trace'), payload)
end
"""


def telemetry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no``, ``file_device`` and ``line``, one row per event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    if events.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        # A small table is one split: spread the work over the cores.
        events = events.repartition(spark.sparkContext.defaultParallelism)
    events = events.withColumn("us", epoch_micros(F.col("ts")))
    numbers = events.selectExpr(*[f"{e} as {n}" for n, e in _NUMBERS.items()])
    parts = numbers.selectExpr("*", *[f"{e} as {n}" for n, e in _DERIVED.items()])
    traced = "if(k % 12 in (9, 10), body, concat('kworker/0:1-1 [00', u % 4, '] ...1 ', tt, ': ', body))"
    return (
        parts.selectExpr("*", f"{_TEXT} as body")
        .selectExpr("*", f"{traced} as payload")
        .selectExpr("k as line_no", "dev as file_device", f"{_LINE} as line")
    )


_stored: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table in the shared folder, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered lines as a table of text."""
    return _once(spark, sf_dir, "text", lambda: telemetry_lines(spark, sf_dir))


def parsed_lines(spark: SparkSession, sf_dir: str, segment_tokens: int = 4096) -> DataFrame:
    """The rendered lines, parsed from their text with every use."""
    text = stored_lines(spark, sf_dir).drop("line_no")
    return parse_loglines(text, "line", F.col("file_device"), segment_tokens=segment_tokens).drop("file_device")


def telemetry_loglines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered lines as a table of parsed lines, as the stitch run leaves them."""
    return unpacked(_once(spark, sf_dir, "lines", lambda: packed(parsed_lines(spark, sf_dir))))
