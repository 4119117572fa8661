"""Shapes of the physical plans that matter at scale."""

import io
import re
from contextlib import redirect_stdout

import pytest

from bootloom.operators import chunks, events, ordering, spans, state
from bootloom.operators.lineage import settle
from bootloom.plans import distributions
from bootloom.sources import logs, writers
from checks.queries import QUERIES
from bootloom.operators.loglines import parse_loglines
from tests.phone import BOOT, DEVICE, line_of, random_boot

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "lines")
    text = spark.createDataFrame([(line_of(r),) for r in random_boot(1, 300)], "value string")
    writers.write_stitched(parse_loglines(text, segment_tokens=64), path)
    return logs.read_store(spark, path)


def test_one_run_of_the_line_pattern(spark):
    raw = spark.createDataFrame([("x",)], "value string")
    plan = plan_of(parse_loglines(raw).where("tag = 'T'").select("boot_id", "pid"))
    assert sum("regexp_replace" in line for line in plan.splitlines()) == 1


def test_word_tests_reach_below_the_parsing(spark):
    raw = spark.createDataFrame([("x",)], "value string")
    plan = plan_of(events.thermal_events(parse_loglines(raw))).split("\n\n")
    first = next(part for part in plan if "Filter" in part and "Condition" in part)
    assert "thermal_temp" in first and "regexp" not in first.lower()


def test_boot_directories_are_pruned_and_columns_read_as_needed(store):
    plan = plan_of(logs.read_boot(store, DEVICE, BOOT).select("logcat_token"))
    assert re.search(r"PartitionFilters: \[.*device_id.*boot_id", plan)
    assert re.search(r"ReadSchema: struct<logcat_token:bigint>", plan)


def test_scans_exchange_by_segment(store):
    plan = plan_of(ordering.with_seq(store).select("seq"))
    sides = re.findall(r"Arguments: hashpartitioning\((.*?), \d+\)", plan)
    wide = [s for s in sides if "segment" in s]
    assert wide and all("device_id" in s and "boot_id" in s for s in sides)
    # The large side is exchanged once and sorted once.
    assert plan.split("\n\n")[0].count("ShuffledHashJoin") == 1


@pytest.mark.parametrize(
    "make",
    [
        lambda s: state.charging_state(s),
        lambda s: state.suspend_state(s),
        lambda s: state.fgbg_transitions(s),
        lambda s: state.cpu_state(events.cpu_events(s)),
        lambda s: spans.freq_spans(events.cpu_events(s)),
        lambda s: spans.freq_combinations(events.cpu_events(s)),
        lambda s: distributions.freq_time_total(s),
        lambda s: distributions.temp_histogram(s),
    ],
)
def test_no_python_no_nested_loops_no_broadcast_of_segments(store, make):
    plan = plan_of(make(store))
    for word in ("Python", "NestedLoop", "Cartesian", "BroadcastHashJoin", "SinglePartition"):
        assert word not in plan, word


def test_every_query_reads_the_tables(spark):
    assert len(QUERIES) > 70
    for name in ("parse_loglines", "freq_spans", "boot_ids"):
        assert "parquet" in plan_of(QUERIES[name](spark, SF)).lower()


def test_chunk_lines_leave_other_text_where_it_is(spark, tmp_path):
    """With few chunks no line moves; with many, only lines of segments that a chunk reaches into."""
    text = [(line_of(r),) for r in random_boot(5, 400)]
    lines = settle(parse_loglines(spark.createDataFrame(text, "value string"), segment_tokens=40))
    found = settle(chunks.discharge_chunks(lines))
    few, many = chunks.chunk_lines(lines, found), chunks.chunk_lines(lines, found, broadcast_limit=0)
    assert "hashpartitioning" not in plan_of(few) and "Window" not in plan_of(few)
    assert "LeftSemi" in plan_of(many)
    keys = ["logcat_token", "start_token", "end_token"]
    assert sorted(few.select(*keys).collect()) == sorted(many.select(*keys).collect()) != []


def test_foreground_scans_move_places_only(spark):
    text = [(line_of(r),) for r in random_boot(5, 50)]
    lines = settle(parse_loglines(spark.createDataFrame(text, "value string"), segment_tokens=40))
    fronts = settle(state._fronts(events.proc_foreground_events(lines)))
    timed = ordering.as_of(lines.select(*state._PLACE), fronts, {"_event": fronts.event})
    assert "payload" not in plan_of(timed) and "Window" in plan_of(timed)
