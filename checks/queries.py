"""One query per operator, over log lines derived from the whole ``events`` table.

Times come as whole microseconds and shares rounded to nine digits, so that
results can be compared by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bootloom.functions import formats as fmt
from bootloom.functions import text
from bootloom.operators import chunks as ck
from bootloom.operators import events as ev
from bootloom.operators import loglines as lg
from bootloom.operators import machines, ordering, periods, quality, sessions, spans, state
from bootloom.operators import predicates as pr
from bootloom.operators.lineage import settle, shared_dir
from bootloom.plans import distributions as di
from bootloom.plans.stitch import chunk_devices, stitch
from bootloom.sources import logs, writers
from bootloom.sources.telemetry import parsed_lines, stored_lines, telemetry_loglines
from bootloom.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ID = ["device_id", "boot_id"]
AT = [*ID, "logcat_token"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def us(column: str) -> Column:
    return text.epoch_micros(F.col(column)).alias(f"{column}_us")


def nine(column: str) -> Column:
    return F.round(column, 9).alias(column)


# Parsers


@query
def parse_loglines(spark, sf):
    return parsed_lines(spark, sf).select(
        *AT, us("datetime"), "datetime_nanos", "trace_us", "pid", "tid", "level", "tag", "payload"
    )


@query
def line_round_trip(spark, sf):
    return parsed_lines(spark, sf).select("logcat_token", "line")


@query
def rejected_lines(spark, sf):
    return lg.rejected_lines(stored_lines(spark, sf), "line").select("line_no", "line")


@query
def parse_trace(spark, sf):
    trace = ev.parse_trace(telemetry_loglines(spark, sf))
    return trace.select(*AT, "thread", "trace_cpu", "flags", nine("trace_timestamp"), "trace_tag", "text")


@query
def trace_dispatch(spark, sf):
    return ev.recognised_trace(telemetry_loglines(spark, sf)).groupBy("trace_tag").agg(F.count("*").alias("events"))


@query
def int_parse(spark, sf):
    number = (F.col("event_id") * 1_000_003).cast("string")
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id",
        text.int_or_error(number).alias("strict32"),
        text.int_or_zero(number).alias("zero32"),
        text.int_or_error(number, 64).alias("strict64"),
    )


def made(*columns: str | Callable[[], Column]) -> list[str | Column]:
    """Columns by name, or by a function that is called once a session is there."""
    return [c if isinstance(c, str) else c() for c in columns]


def events_query(name: str, parse: Callable[[DataFrame], DataFrame], *columns) -> None:
    QUERIES[name] = lambda spark, sf: parse(telemetry_loglines(spark, sf)).select(*AT, *made(*columns))


events_query("hotplug_events", ev.hotplug_events, "cpu", "state", "error")
events_query("thermal_events", ev.thermal_events, "sensor_id", "temp")
events_query("cpu_frequency_events", ev.cpu_frequency_events, "freq", "cpu")
events_query("num_online_cpus_events", ev.num_online_cpus_events, "num_online_cpus")
events_query("proc_foreground_events", ev.proc_foreground_events, "fg_pid", "fg_tgid", "comm")
events_query("ctx_switch_marker_events", ev.ctx_switch_marker_events, "marker", "cpu", "count", "log_idx")
events_query(
    "ctx_switch_info_events", ev.ctx_switch_info_events, "cpu", "task_pid", "task_tgid", "nice", "comm",
    *ev.CTX_INFO_COUNTERS,
)
events_query("msm_thermal_events", ev.msm_thermal_events, "state", "cpu", "temp")
events_query("power_events", ev.power_events, "power", lambda: us("power_time"))
events_query("healthd_events", ev.healthd_events, lambda: nine("timestamp"), "l", "v", "t", "h", "st", "c", "chg")
events_query("pvs_events", ev.pvs_events, lambda: nine("timestamp"), "pvs_bin")
events_query("pvs_last_digit", ev.pvs_last_digit, "pvs_bin")
events_query("cpu_events", ev.cpu_events, "cpu", "freq", "word", "error")


# Predicates


def predicate_query(name: str, predicate: Callable[[], Column]) -> None:
    QUERIES[name] = lambda spark, sf: telemetry_loglines(spark, sf).where(predicate()).select(*AT)


predicate_query("freq_prefilter", pr.is_frequency_line)
predicate_query("freq_prefilter_colon", lambda: pr.is_frequency_line(colon=True))
predicate_query("ncpu_prefilter", pr.is_online_cpus_line)
predicate_query("thermal_prefilter", pr.is_thermal_line)
predicate_query("pvs_prefilter", pr.is_pvs_line)
predicate_query("healthd_predicate", pr.is_healthd_text)
predicate_query("power_predicate", pr.is_power_event)


@query
def line_filter(spark, sf):
    lines = telemetry_loglines(spark, sf)
    return lg.line_filter(lines, F.col("line").contains(fmt.TRACE_SOURCE), F.col("line").contains("cpu_id=0")).select(*AT)


# States


@query
def charging_state(spark, sf):
    tracked = state.charging_state(telemetry_loglines(spark, sf))
    return tracked.select(*AT, "charging_state", state.is_charging_event().alias("is_charging_event"))


@query
def charging_transitions(spark, sf):
    return state.charging_transitions(telemetry_loglines(spark, sf)).select(*AT, "old_state", "new_state")


@query
def in_state(spark, sf):
    return pr.in_state(state.charging_state(telemetry_loglines(spark, sf)), "charging_state", "UNPLUGGED").select(*AT)


@query
def exclusive(spark, sf):
    return pr.exclusive(state.suspend_state(telemetry_loglines(spark, sf)), pr.is_power_event()).select(
        *AT, "suspend_state"
    )


@query
def apply_all(spark, sf):
    trackers = [state.charging(), state.suspending(), state.fronting()]
    tracked = state.track(telemetry_loglines(spark, sf), *trackers)
    return tracked.groupBy("charging_state", "suspend_state", (F.col("active_pid") != 0).alias("active")).agg(
        F.count("*").alias("lines")
    )


@query
def suspend_state(spark, sf):
    return state.suspend_state(telemetry_loglines(spark, sf)).select(*AT, "suspend_state")


@query
def suspend_transitions(spark, sf):
    return state.suspend_transitions(telemetry_loglines(spark, sf)).select(*AT, "old_state", "new_state", "anomaly")


@query
def suspend_intervals(spark, sf):
    return state.suspend_intervals(telemetry_loglines(spark, sf))


@query
def fgbg_state(spark, sf):
    return state.fgbg_state(telemetry_loglines(spark, sf)).select(*AT, "fgbg_state")


@query
def fgbg_transitions(spark, sf):
    return state.fgbg_transitions(telemetry_loglines(spark, sf)).select(*AT, "old_state", "new_state")


@query
def active_pid(spark, sf):
    return state.active_pid(telemetry_loglines(spark, sf)).select(*AT, "active_pid")


@query
def active_use(spark, sf):
    return state.active_use(telemetry_loglines(spark, sf)).select(*AT)


@query
def cpu_state(spark, sf):
    return state.cpu_state(ev.cpu_events(telemetry_loglines(spark, sf))).select(*AT, "cpu", "cpu_state", "cpu_freq")


@query
def cpu_state_before(spark, sf):
    tracked = state.cpu_state(ev.cpu_events(telemetry_loglines(spark, sf)), before=True)
    return tracked.select(*AT, "cpu", "cpu_state", "cpu_freq")


@query
def day_boundaries(spark, sf):
    return state.day_boundaries(telemetry_loglines(spark, sf)).select(*AT, "old_day", "new_day")


@query
def period_boundaries(spark, sf):
    lines = telemetry_loglines(spark, sf)
    return periods.period_boundaries(lines, timedelta(hours=5, minutes=7)).select(*AT, "old_start", "new_start")


@query
def custom_tracker(spark, sf):
    """A machine that a user wrote: each odd temperature is a step up, each even one a step down, between three states."""
    lines = telemetry_loglines(spark, sf)
    steps = ["cool", "warm", "hot"]
    leads = {(a, "up"): b for a, b in zip(steps, steps[1:])} | {(b, "down"): a for a, b in zip(steps, steps[1:])}
    event = F.when(F.col("temp") % 2 == 1, "up").otherwise("down")
    heat = machines.Machine("heat", lambda df: ev.thermal_events(df).withColumn("event", event), tuple(steps), leads)
    return state.track(lines, heat, state.suspending()).select(*AT, "heat", "suspend_state")


# Spans, sessions, distributions


@query
def freq_spans(spark, sf):
    return spans.freq_spans(ev.cpu_events(telemetry_loglines(spark, sf)))


@query
def freq_spans_closed(spark, sf):
    return spans.freq_spans(ev.cpu_events(telemetry_loglines(spark, sf)), close_on_offline=True)


@query
def ncpu_spans(spark, sf):
    return spans.ncpu_spans(ev.num_online_cpus_events(telemetry_loglines(spark, sf)))


@query
def freq_combinations(spark, sf):
    return spans.freq_combinations(ev.cpu_events(telemetry_loglines(spark, sf)))


@query
def freq_time_total(spark, sf):
    return di.freq_time_total(telemetry_loglines(spark, sf)).select("freq", "total_us")


@query
def freq_combination_share(spark, sf):
    return di.freq_combination_share(telemetry_loglines(spark, sf)).select(
        "freq_key", *ID, "duration_us", nine("share")
    )


@query
def ncpu_share(spark, sf):
    return di.ncpu_share(telemetry_loglines(spark, sf)).select("num_online_cpus", *ID, "duration_us", nine("share"))


@query
def ncpu_share_lists(spark, sf):
    lists = di.share_lists(di.ncpu_share(telemetry_loglines(spark, sf)), "num_online_cpus")
    text_of = F.array_join(F.transform("shares", lambda x: F.round(x * 1_000_000).cast("bigint").cast("string")), ",")
    return lists.select("num_online_cpus", "part", text_of.alias("millionths"))


@query
def temp_histogram(spark, sf):
    return di.temp_histogram(telemetry_loglines(spark, sf))


@query
def pvs_by_device(spark, sf):
    return di.pvs_by_device(telemetry_loglines(spark, sf))


@query
def thermal_line_counts(spark, sf):
    return di.thermal_line_counts(telemetry_loglines(spark, sf))


@query
def extract_thermal_lines(spark, sf):
    path = scratch(spark, "thermal")
    writers.write_thermal_lines(telemetry_loglines(spark, sf), path)
    back = spark.read.text(path, recursiveFileLookup=True)
    return back.select(logs.device_of_path(F.input_file_name()).alias("device_id"), F.col("value").alias("line"))


@query
def ctx_switch_sessions(spark, sf):
    members = sessions.ctx_switch_sessions(telemetry_loglines(spark, sf))
    return members.select(*AT, "cpu", "marker", "rtime", "comm", "start_token", "end_token")


def session_query(name: str, metric: Callable[[DataFrame], DataFrame], column) -> None:
    QUERIES[name] = lambda spark, sf: metric(
        sessions.ctx_switch_sessions(telemetry_loglines(spark, sf))
    ).select(*sessions.SESSION, *made(column))


session_query("ctx_total_time", sessions.ctx_total_time, "total_time")
session_query("ctx_busyness", sessions.ctx_busyness, lambda: nine("busyness"))
session_query("ctx_fg_busyness", sessions.ctx_fg_busyness, lambda: nine("fg_busyness"))
session_query("ctx_bg_busyness", sessions.ctx_bg_busyness, lambda: nine("bg_busyness"))


# Chunks


@query
def discharge_chunks(spark, sf):
    return ck.discharge_chunks(telemetry_loglines(spark, sf)).select(
        *ck.CHUNK,
        F.col("start.l").alias("start_level"),
        F.col("end.l").alias("end_level"),
        F.col("start.t").alias("start_temp"),
        F.col("end.t").alias("end_temp"),
    )


@query
def chunk_lines(spark, sf):
    lines = telemetry_loglines(spark, sf)
    return ck.chunk_lines(lines, ck.discharge_chunks(lines)).select(*ck.CHUNK, "logcat_token")


@query
def chunk_cpu_state(spark, sf):
    lines = telemetry_loglines(spark, sf)
    return ck.chunk_cpu_state(lines, ck.discharge_chunks(lines))


@query
def chunk_fgbg_state(spark, sf):
    lines = telemetry_loglines(spark, sf)
    return ck.chunk_fgbg_state(lines, ck.discharge_chunks(lines))


@query
def no_suspend_chunks(spark, sf):
    lines = telemetry_loglines(spark, sf)
    chunks = ck.discharge_chunks(lines)
    return ck.no_suspend_chunks(chunks, ck.chunk_lines(lines, chunks), fmt.SUSPEND_EXIT_WORD).select(*ck.CHUNK)


@query
def gapless_chunks(spark, sf):
    # Hardly a token has its neighbour in the same boot here, so the lines are
    # numbered anew, with a gap after every fiftieth.
    lines = ordering.with_seq(telemetry_loglines(spark, sf))
    dense = lines.withColumn("logcat_token", F.expr("seq + seq div 50")).drop("seq")
    chunks = ck.discharge_chunks(dense)
    return ck.gapless_chunks(chunks, ck.chunk_lines(dense, chunks)).select(*ck.CHUNK)


@query
def chunk_filter(spark, sf):
    chunks = ck.discharge_chunks(telemetry_loglines(spark, sf))
    return ck.chunk_filter(chunks, F.col("start.l") >= 90, F.col("end.t") > F.col("start.t")).select(*ck.CHUNK)


@query
def chunk_counts(spark, sf):
    chunks = ck.discharge_chunks(telemetry_loglines(spark, sf))
    return ck.chunk_counts(chunks, ck.chunk_filter(chunks, F.col("start.l") >= 90))


@query
def chunk_counts_by_device(spark, sf):
    chunks = ck.discharge_chunks(telemetry_loglines(spark, sf))
    return ck.chunk_counts(chunks, ck.chunk_filter(chunks, F.col("end.t") > F.col("start.t")), keys=["device_id"])


@query
def chunk_meta(spark, sf):
    path = scratch(spark, "meta")
    lines = telemetry_loglines(spark, sf)
    writers.write_chunk_meta(ck.discharge_chunks(lines), logs.boot_ids(lines), path)
    return spark.read.schema("device_id string, boot_id string, chunks bigint").json(path)


@query
def read_chunks(spark, sf):
    lines = telemetry_loglines(spark, sf)
    path = scratch(spark, "chunks")
    chunks = ck.discharge_chunks(lines)
    writers.write_chunks(chunks, ck.chunk_lines(lines, chunks), path)
    headers, members = logs.read_chunks(spark, path)
    counted = members.groupBy(*ID, "start_token").agg(F.count("*").alias("lines"))
    return headers.join(counted, [*ID, "start_token"], "left").select(
        *ck.CHUNK, F.coalesce("lines", F.lit(0)).alias("lines")
    )


# Order, sources, sinks, sets


@query
def stitch_sort(spark, sf):
    return ordering.with_seq(telemetry_loglines(spark, sf)).select(*AT, "seq")


@query
def token_order_violations(spark, sf):
    # Each device's lines in a file of their own, with neighbours swapped.
    swapped = F.col("line_no") + 1 - 2 * (F.col("line_no") % 2)
    placed = stored_lines(spark, sf).select(
        "line", "file_device", F.col("file_device").alias("file_name"), F.lit(0).alias("block_start"),
        swapped.alias("line_no"),
    )
    lines = lg.parse_loglines(placed, "line", F.col("file_device"))
    return quality.token_order_violations(lines, segment_lines=4096).select(*AT, "previous_token")


def raw_dir(spark: SparkSession, sf: str) -> str:
    """The rendered lines as gzip text files, in a directory per device."""
    path = scratch(spark, "raw")
    lines = stored_lines(spark, sf).select("file_device", "line")
    lines.write.partitionBy("file_device").option("compression", "gzip").text(path)
    return path


@query
def read_raw_logs(spark, sf):
    raw = logs.read_raw_logs(spark, raw_dir(spark, sf), "*.txt.gz,*.out.gz")
    return raw.groupBy("file_device").agg(
        F.count("*").alias("lines"), F.sum(F.length("value")).alias("characters")
    )


@query
def read_boot(spark, sf):
    path = scratch(spark, "store")
    writers.write_stitched(telemetry_loglines(spark, sf), path)
    store = logs.read_store(spark, path)
    boot = "00000000-0000-4000-8000-" + "13".rjust(12, "0")
    return logs.read_boot(store, "5".rjust(40, "0"), boot, pr.is_frequency_line()).select(*AT, "payload")


@query
def write_stitched(spark, sf):
    path = scratch(spark, "store")
    writers.write_stitched(telemetry_loglines(spark, sf), path, lines_per_file=1000)
    return ordering.with_seq(logs.read_store(spark, path)).select(*AT, "seq", "line")


@query
def stitch_manifest(spark, sf):
    store, manifest = scratch(spark, "store"), scratch(spark, "manifest")
    stitch(spark, raw_dir(spark, sf), store, manifest, "*.txt.gz")
    read = logs.read_manifest(spark, manifest, "*.json", multi_line=False)
    return read.where("bootids is not null").select("device_id", F.explode("bootids").alias("boot_id"))


@query
def boot_ids(spark, sf):
    return logs.boot_ids(telemetry_loglines(spark, sf))


def device_rows(spark: SparkSession, sf: str) -> DataFrame:
    return logs.list_devices(stored_lines(spark, sf).select(F.col("file_device").alias("device_id")))


@query
def list_devices(spark, sf):
    return logs.list_devices(logs.list_files(spark, raw_dir(spark, sf), "*.txt.gz"))


@query
def filter_devices(spark, sf):
    wanted = " ".join(n.rjust(40, "0") for n in ("1", "3", "9"))
    return logs.filter_devices(telemetry_loglines(spark, sf), wanted).groupBy("device_id").agg(
        F.count("*").alias("lines")
    )


def known_devices(spark: SparkSession, sf: str) -> DataFrame:
    """Devices with a silicon bin above 2."""
    return di.pvs_by_device(telemetry_loglines(spark, sf)).where("pvs_bin > 2").select("device_id")


@query
def device_intersection(spark, sf):
    return logs.device_intersection(device_rows(spark, sf), known_devices(spark, sf))


def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of the known devices."""
    lines = logs.filter_devices(telemetry_loglines(spark, sf), known_devices(spark, sf))
    files = lines.select("device_id", F.concat("device_id", F.lit("/0.out.gz")).alias("file_name")).distinct()
    return writers.manifest(logs.boot_ids(lines), files)


@query
def read_manifest(spark, sf):
    path = scratch(spark, "manifest")
    writers.write_json(manifest_rows(spark, sf), path)
    read = logs.read_manifest(spark, path, "*.json", multi_line=False)
    return read.select("device_id", F.size("bootids").alias("boots"), F.size("files").alias("files"), "is_valid")


@query
def device_boots(spark, sf):
    return logs.device_boots(device_rows(spark, sf), manifest_rows(spark, sf))


@query
def skipped_devices(spark, sf):
    return logs.skipped_devices(device_rows(spark, sf), manifest_rows(spark, sf))


@query
def pending_devices(spark, sf):
    return logs.pending_devices(device_rows(spark, sf), known_devices(spark, sf))


def upload_files(spark: SparkSession, sf: str) -> DataFrame:
    """Each line with the name of its upload: one per device and 400 lines."""
    name = F.concat("file_device", F.lit("/"), F.expr("line_no div 400").cast("string"), F.lit(".out.gz"))
    return stored_lines(spark, sf).select("line", name.alias("file_name"))


def having(rows: DataFrame, word: str) -> DataFrame:
    return rows.where(F.col("line").contains(word))


@query
def new_files(spark, sf):
    files = upload_files(spark, sf)
    return logs.new_files(files.select("file_name").distinct(), having(files, "chg=u").select("file_name").distinct())


@query
def merged_files(spark, sf):
    files = upload_files(spark, sf)
    return logs.merged_files(having(files, "chg=u"), having(files, fmt.SUSPEND_EXIT_WORD))


@query
def merged_bootids(spark, sf):
    lines = telemetry_loglines(spark, sf)
    return logs.merged_bootids(having(lines, "chg=u"), having(lines, "PVS: 6"))


# Stores that grow in several runs


def grown_store(spark: SparkSession, sf: str) -> DataFrame:
    """The upload stitched in runs of a few files, and once more with nothing left to do; hot segments cut."""
    raw, store, manifest = raw_dir(spark, sf), scratch(spark, "store"), scratch(spark, "manifest")
    for _ in range(2):
        stitch(spark, raw, store, manifest, "*.txt.gz", files_per_run=24, segment_tokens=4096)
    return ordering.split_hot_segments(logs.read_store(spark, store), limit=100)


@query
def stitch_incremental(spark, sf):
    return ordering.with_seq(grown_store(spark, sf)).select(*AT, "seq", "line")


@query
def charging_incremental(spark, sf):
    tracked = state.charging_state(grown_store(spark, sf))
    return tracked.select(*AT, "charging_state", state.is_charging_event().alias("is_charging_event"))


@query
def deviceless_lines(spark, sf):
    path = scratch(spark, "store")
    lines = lg.parse_loglines(stored_lines(spark, sf).select("line"), "line", segment_tokens=4096)
    writers.write_stitched(lines, path)
    return ordering.with_seq(logs.read_store(spark, path)).select(*AT, "seq")


def chunk_store(spark: SparkSession, sf: str) -> str:
    """Chunks of some devices, then of all: the second run leaves the first one's devices alone."""
    path, lines = scratch(spark, "chunks"), telemetry_loglines(spark, sf)
    chunk_devices(lines.where(F.col("device_id").endswith("3")), path)
    chunk_devices(lines, path)
    return path


@query
def chunk_devices_cpu(spark, sf):
    return logs.read_chunk_states(spark, chunk_store(spark, sf))[0]


@query
def chunk_devices_fgbg(spark, sf):
    return logs.read_chunk_states(spark, chunk_store(spark, sf))[1]


@query
def chunk_devices_reload(spark, sf):
    """All devices, then two of them anew: one from the same lines, one without battery reports, so without chunks."""
    path, lines = scratch(spark, "chunks"), telemetry_loglines(spark, sf)
    chunk_devices(lines, path)
    device = F.col("device_id")
    again = lines.where(device.endswith("3") & ~F.col("line").contains("healthd") | device.endswith("5"))
    chunk_devices(again, path, reload=True)
    headers, members = logs.read_chunks(spark, path)
    cpus, fgbg = logs.read_chunk_states(spark, path)
    counted = members.groupBy(*ID, "start_token").agg(F.count("*").alias("lines"))
    known = cpus.groupBy(*ID, "start_token").agg(F.count("*").alias("cpus"))
    found = headers.join(fgbg.drop("end_token"), [*ID, "start_token"], "full")
    for table in (counted, known):
        found = found.join(table, [*ID, "start_token"], "full")
    return found.select(*ID, "start_token", "end_token", F.coalesce("lines", F.lit(0).cast("bigint")).alias("lines"), "cpus", "fgbg_state")


@query
def chunk_dumps(spark, sf):
    """Chunks as JSON dumps in parts of at most about ten lines, read back."""
    path, lines = scratch(spark, "dumps"), telemetry_loglines(spark, sf)
    chunks = settle(ck.discharge_chunks(lines))
    states = ck.chunk_cpu_state(lines, chunks), ck.chunk_fgbg_state(lines, chunks)
    writers.write_chunk_dumps(writers.chunk_dumps(chunks, ck.chunk_lines(lines, chunks), *states, limit=10), path)
    return logs.read_chunk_dumps(spark, path).groupBy(*ID, "start_token", "end_token").agg(
        F.sum(F.size("Data")).alias("lines"),
        F.max(F.col("Start.L") - F.col("End.L")).alias("drop"),
        F.max("StartFgBgState").alias("fgbg"),
        F.max(F.size("StartCpuState")).alias("cpus"),
    )


@query
def chunk_devices_counts(spark, sf):
    return logs.read_chunk_counts(spark, chunk_store(spark, sf))


# Result files


def through_json(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    writers.write_json(df, path)
    return df.sparkSession.read.schema(df.schema).json(path)


@query
def freq_totals_file(spark, sf):
    return through_json(di.freq_time_total(telemetry_loglines(spark, sf)), "totals").select("freq", "total_us")


@query
def ncpu_lists_file(spark, sf):
    lists = di.share_lists(di.ncpu_share(telemetry_loglines(spark, sf)), "num_online_cpus")
    text_of = F.array_join(F.transform("shares", lambda x: F.round(x * 1_000_000).cast("bigint").cast("string")), ",")
    return through_json(lists, "lists").select("num_online_cpus", "part", text_of.alias("millionths"))


@query
def combination_lists_file(spark, sf):
    lists = di.share_lists(di.freq_combination_share(telemetry_loglines(spark, sf)).where("share is not null"), "freq_key")
    text_of = F.array_join(F.transform("shares", lambda x: F.round(x * 1_000_000).cast("bigint").cast("string")), ",")
    return through_json(lists, "lists").select("freq_key", "part", text_of.alias("millionths"))


@query
def temp_histogram_file(spark, sf):
    return through_json(di.temp_histogram(telemetry_loglines(spark, sf)), "temps")


@query
def pvs_file(spark, sf):
    return through_json(di.pvs_by_device(telemetry_loglines(spark, sf)), "pvs")


@query
def in_state_suspended(spark, sf):
    return pr.in_state(state.suspend_state(telemetry_loglines(spark, sf)), "suspend_state", "SUSPENDED").select(*AT)


@query
def in_state_foreground(spark, sf):
    return pr.in_state(state.fgbg_state(telemetry_loglines(spark, sf)), "fgbg_state", "FOREGROUND").select(*AT)


# Streams, run to the end of what is there


def line_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The upload in more than one batch."""
    return live.stream_loglines(spark, raw_dir(spark, sf), "*.txt.gz", files_per_batch=32, segment_tokens=4096)


@query
def ingest_stream(spark, sf):
    store = scratch(spark, "store")
    live.ingest_stream(line_stream(spark, sf), store, scratch(spark, "offsets")).awaitTermination()
    return live.read_ingested(spark, store).select(*AT, "trace_us", "tag")


@query
def daily_counts(spark, sf):
    out = scratch(spark, "counts")
    live.count_stream(line_stream(spark, sf), out, scratch(spark, "offsets")).awaitTermination()
    return live.read_counts(spark, out)


@query
def fgbg_stream(spark, sf):
    out = scratch(spark, "changes")
    run = live.fgbg_stream(line_stream(spark, sf), out, scratch(spark, "state"), scratch(spark, "offsets"))
    run.awaitTermination()
    return live.read_transitions(spark, out).select(*AT, "old_state", "new_state")


@query
def fgbg_stream_late(spark, sf):
    """Half of the upload first; the other half, whose lines stand between those, in a later run."""
    raw, run = raw_dir(spark, sf), [scratch(spark, name) for name in ("changes", "state", "offsets")]
    for pattern in ("part-????[13579]-*.txt.gz", "*.txt.gz"):
        lines = live.stream_loglines(spark, raw, pattern, segment_tokens=256)
        live.fgbg_stream(lines, *run, buckets=8).awaitTermination()
    return live.read_transitions(spark, run[0]).select(*AT, "old_state", "new_state")


@query
def closed_daily_counts(spark, sf):
    """One batch for each file; closed and open counts and late lines together are all lines."""
    out = scratch(spark, "counts")
    lines = live.stream_loglines(spark, raw_dir(spark, sf), "*.txt.gz", files_per_batch=16, segment_tokens=4096)
    live.closed_count_stream(lines, out, scratch(spark, "offsets"), lateness=timedelta(hours=6)).awaitTermination()
    closed, still_open, late = live.read_closed_counts(spark, out)
    missed = late.groupBy("device_id", "start_us").agg(F.count("*").alias("lines"))
    every = closed.unionByName(still_open).unionByName(missed)
    return every.groupBy("device_id", "start_us").agg(F.sum("lines").alias("lines"))
