"""Golden lines of both layouts and of every payload."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from bootloom.functions import text
from bootloom.operators import events, predicates
from bootloom.operators.loglines import line_filter, parse_loglines, rejected_lines
from tests.phone import BOOT, DEVICE, device_line

RAW = (
    "0c0ffee0-1234-4abc-8def-00000000beef 2017-02-03 04:05:06.070809101 4242 [77.000123]   31   32 W"
    " Kernel-Trace:      helper/7:a-55 [007] d..1 76.999999: phonelab_num_online_cpus: num_online_cpus=3"
)


def parsed(spark, *lines, **options):
    return parse_loglines(spark.createDataFrame([(line,) for line in lines], "value string"), **options)


def trace(spark, *texts, header="helper/3:b-77  [003] d..2 812.000345: "):
    return parsed(spark, *[device_line(n + 1, 1_000_000, "Kernel-Trace", header + t) for n, t in enumerate(texts)])


def printk(spark, *texts):
    return parsed(spark, *[device_line(n + 1, 1_000_000, "KernelPrintk", t) for n, t in enumerate(texts)])


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("logcat_token").select(*columns).collect()]


def test_logcat_layout(spark):
    (row,) = parsed(spark, RAW, device=F.lit("from-path")).collect()
    assert row.device_id == "from-path"
    assert row.boot_id == "0c0ffee0-1234-4abc-8def-00000000beef"
    assert row.datetime == datetime.datetime(2017, 2, 3, 4, 5, 6, 70809)
    assert row.datetime_nanos == 70809101
    assert (row.logcat_token, row.trace_time, row.trace_us) == (4242, 77.000123, 77000123)
    assert (row.pid, row.tid, row.level, row.tag) == (31, 32, "W", "Kernel-Trace")
    assert row.payload.startswith("helper/7:a-55 [007] d..1 76.999999: ")
    assert row.line == RAW


def test_device_layout(spark):
    (row,) = parsed(spark, device_line(7, 5000250000, "Kernel-Trace", "a  b"), device=F.lit("other")).collect()
    assert (row.device_id, row.boot_id, row.logcat_token) == (DEVICE, BOOT, 7)
    assert (row.trace_time, row.trace_us, row.payload) == (5000.25, 5000250000, "a  b")


def test_junk_before_the_layout_is_skipped(spark):
    (row,) = parsed(spark, "## " + device_line(7, 5, "T", "x")).collect()
    assert row.device_id == DEVICE and row.line.startswith("## ")


def test_dots_stop_at_newline_only(spark):
    (row,) = parsed(spark, device_line(7, 5, "T", "a b\rc")).collect()
    assert row.payload == "a b\rc"


def test_rejects(spark):
    good = device_line(7, 5, "T", "x")
    bad = ["no log line", "", device_line(10**20, 5, "T", "x"), good.replace("2016-01-01", "2016-13-01")]
    raw = spark.createDataFrame([(line,) for line in [good, *bad, None]], "value string")
    assert [r.line for r in parse_loglines(raw).collect()] == [good]
    assert sorted(r.value or "" for r in rejected_lines(raw).collect()) == sorted([*bad, ""])


def test_leading_zeros(spark):
    stamped = [device_line(7, 5, "T", "x").replace(".123456", f".{digits}") for digits in ("059837", "012345", "12345")]
    plain = parsed(spark, *stamped).select("datetime_nanos")
    assert sorted(r[0] for r in plain.collect()) == [12345, 12345, 59837]
    octal = parsed(spark, *stamped, base0=True).select("datetime_nanos")
    assert sorted(r[0] for r in octal.collect()) == [5349, 12345]
    assert rejected_lines(spark.createDataFrame([(s,) for s in stamped], "value string"), base0=True).count() == 1


@pytest.mark.parametrize(
    ("value", "bits", "base0", "strict", "lenient"),
    [
        ("65536", 32, False, 65536, 65536),
        ("4294967296", 32, False, None, 0),
        ("4294967296", 64, False, 4294967296, 4294967296),
        ("-7", 32, False, -7, -7),
        ("010", 32, False, 10, 10),
        ("010", 32, True, 8, 8),
        ("-010", 32, True, -8, -8),
        ("08", 32, True, None, 0),
        ("0", 32, True, 0, 0),
        ("99999999999", 32, True, None, 0),
    ],
)
def test_int_parse(spark, value, bits, base0, strict, lenient):
    column = F.lit(value)
    row = spark.range(1).select(
        text.int_or_error(column, bits, base0).alias("strict"), text.int_or_zero(column, bits, base0).alias("lenient")
    )
    assert tuple(row.first()) == (strict, lenient)


def test_trace_header(spark):
    lines = trace(spark, "thermal_temp: sensor_id=5 temp=32")
    want = ("helper/3:b-77", 3, "d..2", 812.000345, "thermal_temp", "sensor_id=5 temp=32")
    assert rows(events.parse_trace(lines), *events.TRACE_COLUMNS) == [want]


@pytest.mark.parametrize("header", ["helper/3:b-77  [0x3] d..2 812.000345: ", "helper/3:b-77  [003] 812.000345: "])
def test_bad_trace_headers(spark, header):
    assert events.thermal_events(trace(spark, "thermal_temp: sensor_id=5 temp=32", header=header)).count() == 0


def test_unknown_trace_tags(spark):
    lines = trace(spark, "thermal_tempo: sensor_id=5 temp=32", "thermal_temp: sensor_id=5 temp=32")
    assert rows(events.recognised_trace(lines), "logcat_token") == [(2,)]
    assert rows(events.trace_events(lines, "thermal_temp"), "logcat_token") == [(2,)]
    assert events.trace_events(lines, "no_such_tag").count() == 0


def test_hotplug(spark):
    good = ["sched_cpu_hotplug: cpu 1 online error=0", "sched_cpu_hotplug: cpu 2 offline error=-1"]
    bad = [
        "sched_cpu_hotplug: cpu one online error=0",
        "sched_cpu_hotplug: cpu 70000000000 online error=0",
        "sched_cpu_hotplug: cpu 1 online error=-70000000000",
    ]
    lines = trace(spark, *good, *bad)
    assert rows(events.hotplug_events(lines), "cpu", "state", "error") == [(1, "online", 0), (2, "offline", -1)]
    assert events.recognised_trace(lines).count() == 2
    assert rows(events.cpu_events(lines), "cpu", "freq", "word", "error") == [
        (1, None, "online", 0),
        (2, None, "offline", -1),
    ]


def test_thermal(spark):
    bad = ["thermal_temp: sensor_id=70000000001 temp=32", "thermal_temp: sensor_id=5 temp=70000000002"]
    lines = trace(spark, "thermal_temp: sensor_id=5 temp=32", *bad)
    assert rows(events.thermal_events(lines), "sensor_id", "temp") == [(5, 32)]


def test_cpu_frequency(spark):
    bad = ["cpu_frequency: state=70000000003 cpu_id=0", "cpu_frequency: state=960000 cpu_id=70000000004"]
    lines = trace(spark, "cpu_frequency: state=960000 cpu_id=0", *bad)
    assert rows(events.cpu_frequency_events(lines), "freq", "cpu") == [(960000, 0)]
    assert rows(events.cpu_events(lines), "freq", "cpu") == [(960000, 0)]


def test_online_cpus(spark):
    name = "phonelab_num_online_cpus: num_online_cpus="
    lines = trace(spark, name + "2", name + "70000000005")
    assert rows(events.num_online_cpus_events(lines), "num_online_cpus") == [(2,)]


def test_foreground(spark):
    name = "phonelab_proc_foreground: "
    lines = trace(
        spark,
        name + "pid=417 tgid=417 comm=app.home",
        name + "pid=70000000006 tgid=417 comm=x",
        name + "pid=417 tgid=70000000007 comm=x",
    )
    assert rows(events.proc_foreground_events(lines), "fg_pid", "fg_tgid", "comm") == [(417, 417, "app.home")]


COUNTERS = (
    "phonelab_periodic_ctx_switch_info: cpu=1 pid=88 tgid=87 nice=0 comm=two words utime=1 stime=0 rtime=2500"
    " bg_utime=0 bg_stime=4 bg_rtime=0 s_run=0 s_int=2 s_unint=0 s_oth=0 log_idx=61"
)


def test_counters(spark):
    lines = trace(spark, COUNTERS + " rx=7 tx=8", COUNTERS, COUNTERS.replace("rtime=2500", "rtime=" + "9" * 30))
    columns = ["cpu", "task_pid", "task_tgid", "nice", "comm", "utime", "rtime", "bg_stime", "s_int", "log_idx", "rx", "tx"]
    head = (1, 88, 87, 0, "two words", 1)
    assert rows(events.ctx_switch_info_events(lines), *columns) == [
        (*head, 2500, 4, 2, 61, 7, 8),
        (*head, 2500, 4, 2, 61, 0, 0),
        (*head, 0, 4, 2, 61, 0, 0),
    ]


def test_markers(spark):
    name = "phonelab_periodic_ctx_switch_marker: "
    lines = trace(
        spark,
        name + "BEGIN cpu=1 count=12 log_idx=34",
        name + "END cpu=1 count=12 log_idx=34",
        name + "BEGINS cpu=1 count=12 log_idx=34",
        name + "BEGIN cpu=-1 count=12 log_idx=34",
        name + "BEGIN cpu=1 count=-12 log_idx=34",
        name + "BEGIN cpu=11111111111 count=3 log_idx=" + "9" * 25,
    )
    assert rows(events.ctx_switch_marker_events(lines), "marker", "cpu", "count", "log_idx") == [
        ("BEGIN", 1, 12, 34),
        ("END", 1, 12, 34),
        ("BEGIN", 0, 3, 0),
    ]


def test_msm_thermal(spark):
    lines = printk(
        spark,
        "<6>[   3.250000] msm_thermal: Allow Online CPU3 Temp: 66",
        "<6>[   3.250000] msm_thermal: Set Offline: CPU2 Temp: 80",
        "<6>[   3.250000] msm_thermal: Something CPU2 Temp: 80",
    )
    assert rows(events.msm_thermal_events(lines), "state", "cpu", "temp") == [("ONLINE", 3, 66), ("OFFLINE", 2, 80)]


def test_power(spark):
    lines = printk(
        spark,
        "<6>[41.5] PM: suspend exit 2017-05-06 07:08:09.101112131 UTC",
        "<6>[42.5] PM: suspend entry 2017-05-06 07:08:09.141516171 UTC",
        "<6>[42.5] PM: suspend of devices complete after 3 msecs",
    )
    at = datetime.datetime(2017, 5, 6, 7, 8, 9)
    assert rows(events.power_events(lines), "power", "power_time") == [
        ("exit", at.replace(microsecond=101112)),
        ("entry", at.replace(microsecond=141516)),
    ]
    assert lines.where(predicates.is_power_event()).count() == 2


def test_healthd(spark):
    report = "<6>[  12.500000] healthd: battery l=87 v=4100 t=30.5 h=2 st=3 c=-345 chg="
    lines = printk(spark, report + "u", report, "<6>[ 1.0] healthd: battery none chg=")
    columns = ["timestamp", "l", "v", "t", "h", "st", "c", "chg"]
    head = (12.5, 87, 4100, 30.5, 2, 3, -345)
    assert rows(events.healthd_events(lines), *columns) == [(*head, "u"), (*head, "")]
    assert lines.where(predicates.is_healthd_text()).count() == 3


def test_silicon_bin(spark):
    lines = printk(
        spark,
        "<6>[ 1.500000] acpuclk-8974 qcom,acpuclk.30: ACPU PVS: 12",
        "<6>[ 1.500000] acpuclk-8974 qcom,acpuclk.30: ACPU PVS: ?",
    )
    assert rows(events.pvs_events(lines), "timestamp", "pvs_bin") == [(1.5, 12)]
    assert rows(events.pvs_last_digit(lines), "pvs_bin") == [(2,)]


def test_predicates_and_states(spark):
    lines = trace(spark, "cpu_frequency: state=1 cpu_id=0", "x: cpu_frequency", "thermal_temp: x", "other: 1")
    assert rows(lines.where(predicates.is_frequency_line()), "logcat_token") == [(1,), (2,)]
    assert rows(lines.where(predicates.is_frequency_line(colon=True)), "logcat_token") == [(1,)]
    assert rows(lines.where(predicates.is_thermal_line()), "logcat_token") == [(3,)]
    both = line_filter(lines, F.col("logcat_token") > 1, F.col("logcat_token") < 4)
    assert rows(both, "logcat_token") == [(2,), (3,)]
    assert predicates.in_state(lines, "level", "D").count() == 4
    assert predicates.in_state(lines, "level").count() == 0


@pytest.mark.parametrize("unit", ["x", "7", " ", "ab 12 ", "a1-"])
def test_long_junk_is_rejected_quickly(spark, unit):
    junk = unit * (1_000_000 // len(unit))
    raw = spark.createDataFrame([(junk,), (f"{junk} {BOOT} {junk}",)], "value string")
    start = time.time()
    assert parse_loglines(raw).count() == 0
    assert events.parse_trace(raw.select(F.col("value").alias("payload"), F.col("value").alias("line"))).count() == 0
    assert time.time() - start < 20


def test_separators_in_the_text(spark):
    """A line of separators is no log line, and a separator inside a field stays in it."""
    fake = "".join(f"\x1f{x}" for x in ("d", BOOT, 1, "1.5", "2016-01-02 03:04:05.000006", 1, 2, "I", "T", "p"))
    good = device_line(5, 1_000, "Tag", "a\x1fb\x1f")
    got = parse_loglines(spark.createDataFrame([(fake,), (good,)], "value string")).collect()
    assert [(r.logcat_token, r.tag, r.payload) for r in got] == [(5, "Tag", "a\x1fb\x1f")]
    rejected = rejected_lines(spark.createDataFrame([(fake,), (good,)], "value string"))
    assert [r.value for r in rejected.collect()] == [fake]
    header = spark.createDataFrame([("k\x1fw-1 [001] d..3 12.5: my_tag: x\x1fy",)], "payload string")
    (row,) = events.parse_trace(header).collect()
    assert (row.thread, row.trace_cpu, row.flags, row.trace_tag, row.text) == ("k\x1fw-1", 1, "d..3", "my_tag", "x\x1fy")
