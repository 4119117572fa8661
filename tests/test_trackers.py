"""Every ordered operator against a plain loop, over random boots cut into many small segments."""

import random
import re
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from bootloom.operators import chunks, events, machines, ordering, periods, sessions, spans, state
from bootloom.operators.loglines import parse_loglines
from bootloom.plans import distributions
from tests import models
from tests.phone import line_of, random_boot

BOOTS = [f"00000000-0000-4000-8000-{n:012d}" for n in range(6)]


@pytest.fixture(scope="module")
def boots():
    # The last boot holds most of the rows.
    return {b: random_boot(n, 1500 if n == 5 else 200, b) for n, b in enumerate(BOOTS)}


@pytest.fixture(scope="module")
def lines(spark, boots):
    text = [(line_of(r),) for records in boots.values() for r in records]
    return parse_loglines(spark.createDataFrame(text, "value string").repartition(5), segment_tokens=40).cache()


def expected(boots, model):
    return Counter((b, *row) for b, records in boots.items() for row in model(records))


def found(df, *columns):
    return Counter(tuple(r) for r in df.select("boot_id", *columns).collect())


def test_all_lines_parse_in_order(lines, boots):
    got = found(ordering.with_seq(lines), "seq", "logcat_token")
    assert got == expected(boots, lambda rs: [(n, r.token) for n, r in enumerate(rs, 1)])


def test_charging(lines, boots):
    got = state.charging_state(lines)
    assert found(got, "logcat_token", "charging_state") == expected(boots, models.charging)
    flipped = state.charging_state(lines, empty_means_charging=False).where("charging_state = 'UNPLUGGED'")
    assert flipped.count() == got.where("charging_state = 'CHARGING'").count()


def test_suspend(lines, boots):
    assert found(state.suspend_state(lines), "logcat_token", "suspend_state") == expected(boots, models.suspend)


def test_suspend_anomalies(lines, boots):
    def anomalies(records):
        current = "UNKNOWN"
        for r in records:
            if r.kind == "power":
                entry = r.values["power"] == "entry"
                note = "entry while suspended" if entry and current == "SUSPENDED" else None
                note = "exit while not suspended" if not entry and current != "SUSPENDED" else note
                yield r.token, current, note
                current = "SUSPENDED" if entry else "AWAKE"

    got = found(state.suspend_transitions(lines), "logcat_token", "old_state", "anomaly")
    assert got == expected(boots, anomalies)


def test_foreground(lines, boots):
    assert found(state.fgbg_state(lines), "logcat_token", "fgbg_state") == expected(boots, lambda r: models.fgbg(r)[0])
    got = found(state.fgbg_transitions(lines), "logcat_token", "old_state", "new_state")
    assert got == expected(boots, lambda r: models.fgbg(r)[1])


def test_cpu_state(lines, boots):
    cpu = events.cpu_events(lines)
    after = found(state.cpu_state(cpu), "logcat_token", "cpu", "cpu_state", "cpu_freq")
    assert after == expected(boots, lambda r: [row[:4] for row in models.cpu_states(r)])
    before = found(state.cpu_state(cpu, before=True), "logcat_token", "cpu", "cpu_state", "cpu_freq")
    assert before == expected(boots, lambda r: [(*row[:2], *row[4:]) for row in models.cpu_states(r)])


def test_days(lines, boots):
    got = found(state.day_boundaries(lines), "logcat_token", "old_day", "new_day")
    assert got == expected(boots, models.day_changes)


def test_frequency_spans(lines, boots):
    got = found(spans.freq_spans(events.cpu_events(lines)), "logcat_token", "cpu", "freq", "duration_us")
    assert got == expected(boots, models.freq_spans)


def test_combinations(lines, boots):
    got = found(spans.freq_combinations(events.cpu_events(lines)), "logcat_token", "freq_key", "duration_us")
    assert got == expected(boots, models.combinations)


def test_online_cpus(lines, boots):
    got = spans.ncpu_spans(events.num_online_cpus_events(lines))
    assert found(got, "logcat_token", "num_online_cpus", "duration_us") == expected(boots, models.ncpu_spans)


def test_sessions(lines, boots):
    def rows(records):
        for cpu, start, end, infos, total, busy, background in models.sessions(records):
            share = [0.0, 0.0, 0.0] if not total else [busy / total, (busy - background) / total, background / total]
            yield cpu, start, end, infos, total, *share

    got = sessions.session_metrics(sessions.ctx_switch_sessions(lines))
    columns = ["cpu", "start_token", "end_token", "infos", "total_time", "busyness", "fg_busyness", "bg_busyness"]
    assert found(got, *columns) == expected(boots, rows)


def test_histogram(lines, boots):
    want = Counter()
    for records in boots.values():
        want.update(models.histogram(records))
    assert {r.temp: r.samples for r in distributions.temp_histogram(lines).collect()} == dict(want)


def test_shares(lines, boots):
    def rows(records):
        times, total = Counter(), 0
        events_ = [r for r in records if r.kind in ("freq", "hotplug") and not r.values.get("error", 0)]
        total = events_[-1].trace_us - events_[0].trace_us
        for _, key, us in models.combinations(records):
            times[key] += us
        return [(key, us, round(us / total, 9)) for key, us in times.items()]

    got = distributions.freq_combination_share(lines).withColumn("share", F.round("share", 9))
    assert found(got, "freq_key", "duration_us", "share") == expected(boots, rows)


def test_chunks(lines, boots):
    got = chunks.discharge_chunks(lines)
    want = expected(boots, lambda r: [c[:2] for c in models.chunks(r)])
    assert want and found(got, "start_token", "end_token") == want
    # Folding few reports at a time gives the same.
    assert found(chunks.discharge_chunks(lines, limit=3), "start_token", "end_token") == want
    members = found(chunks.chunk_lines(lines, got), "start_token", "end_token", "logcat_token")
    assert members == expected(boots, lambda r: [(s, e, t) for s, e, data in models.chunks(r) for t in data])


def test_chunk_start_states(lines, boots):
    cut = chunks.discharge_chunks(lines)

    def foreground(records):
        states = dict(models.fgbg(records)[0])
        return [(s, e, states[s]) for s, e, _ in models.chunks(records)]

    def cpus(records):
        tracked = models.cpu_states(records)
        for s, e, _ in models.chunks(records):
            last = {cpu: (cpu, st, fr) for token, cpu, st, fr, *_ in tracked if token <= s}
            yield from ((s, e, *row) for row in last.values())

    columns = ["start_token", "end_token"]
    assert found(chunks.chunk_fgbg_state(lines, cut), *columns, "fgbg_state") == expected(boots, foreground)
    got = found(chunks.chunk_cpu_state(lines, cut), *columns, "cpu", "cpu_state", "cpu_freq")
    assert got == expected(boots, cpus)


def test_chunk_filters(lines, boots):
    cut = chunks.discharge_chunks(lines)
    members = chunks.chunk_lines(lines, cut)

    def gapless(records):
        return [(s, e) for s, e, data in models.chunks(records) if [s, *data, e] == list(range(s, e + 1))]

    assert found(chunks.gapless_chunks(cut, members), "start_token", "end_token") == expected(boots, gapless)

    def no_exit(records):
        exits = {r.token for r in records if r.kind == "power" and r.values["power"] == "exit"}
        return [(s, e) for s, e, data in models.chunks(records) if not exits & set(data)]

    kept = chunks.no_suspend_chunks(cut, members, "PM: suspend exit")
    assert found(kept, "start_token", "end_token") == expected(boots, no_exit)
    counts = found(chunks.chunk_counts(cut, kept), "chunks", "kept")
    want = Counter(
        (b, len(models.chunks(r)), len(no_exit(r))) for b, r in boots.items() if models.chunks(r)
    )
    assert counts == want


def test_segment_size_does_not_matter(spark, boots):
    """One huge segment and one token per segment give the same as the trial's segments."""
    text = spark.createDataFrame([(line_of(r),) for r in boots[BOOTS[5]]], "value string")
    want = Counter(models.fgbg(boots[BOOTS[5]])[1])
    for size in (1, 1 << 40):
        got = state.fgbg_transitions(parse_loglines(text, segment_tokens=size))
        assert Counter(tuple(r) for r in got.select("logcat_token", "old_state", "new_state").collect()) == want


def loop(machine, rows):
    """(place, state) after each event, one after another."""
    now = machine.initial
    for place, event in rows:
        now = machine.leads.get((now, event), now)
        yield place, now


CHARGING = machines.Machine(
    "charging_state",
    lambda df: events.healthd_events(df).withColumn("event", F.when(F.col("chg") == "", "on").otherwise("off")),
    ("UNKNOWN", "CHARGING", "UNPLUGGED"),
    {(s, e): t for s in ("UNKNOWN", "CHARGING", "UNPLUGGED") for e, t in (("on", "CHARGING"), ("off", "UNPLUGGED"))},
)
SUSPEND = machines.Machine(
    "suspend_state",
    lambda df: events.power_events(df).withColumnRenamed("power", "event"),
    ("UNKNOWN", "SUSPENDED", "AWAKE"),
    {(s, e): t for s in ("UNKNOWN", "SUSPENDED", "AWAKE") for e, t in (("entry", "SUSPENDED"), ("exit", "AWAKE"))},
)


def test_present_trackers_as_machines(lines):
    """Both in one pass, and beside a tracker of the other kind."""
    got = state.track(lines, CHARGING, SUSPEND, state.fronting())
    want = state.track(lines, state.charging(), state.suspending(), state.fronting())
    names = ["logcat_token", "charging_state", "suspend_state", "active_pid"]
    assert found(got, *names) == found(want, *names)


def debounce_events(df):
    """A process comes to the front or goes; and each line more than a second after the latest of these."""
    fronts = events.proc_foreground_events(df)
    timed = ordering.as_of(df, fronts, {"since": F.col("trace_us")})
    own = fronts.withColumn("event", F.when(F.col("fg_pid") != 0, "front").otherwise("gone"))
    late = timed.where(F.col("trace_us") - F.col("since") > 1_000_000).withColumn("event", F.lit("late"))
    return own.select(*df.columns, "event").unionByName(late.select(*df.columns, "event"))


def test_debounce_as_a_machine(lines):
    """Six states, three of them waiting: what follows a late line depends on the state it finds."""
    shown = ("UNKNOWN", "FOREGROUND", "BACKGROUND")
    leads = {(f"{s}{w}", "front"): "FOREGROUND" for s in shown for w in ("", "?")}
    leads |= {(f"{s}{w}", "gone"): f"{s}?" for s in shown for w in ("", "?")}
    leads |= {(f"{s}?", "late"): "BACKGROUND" for s in shown}
    machine = machines.Machine("shown", debounce_events, tuple(f"{s}{w}" for s in shown for w in ("", "?")), leads)
    got = state.track(lines, machine).withColumn("shown", F.rtrim(F.col("shown"), F.lit("?")))
    assert found(got, "logcat_token", "shown") == found(state.fgbg_state(lines), "logcat_token", "fgbg_state")


def test_machine_over_stretches_of_stretches(lines, boots):
    """A lock of five digits, over trees of several widths."""
    states = tuple("abcde")
    leads = {(s, "turn"): states[(n * 2 + 1) % 5] for n, s in enumerate(states)} | {("e", "push"): "a", ("c", "push"): "c"}

    def turns(df):
        kinds = F.when(F.col("line").contains("healthd"), "turn").when(F.col("line").contains("other_tag"), "push")
        return df.withColumn("event", F.coalesce(kinds, F.lit("nothing")))

    machine = machines.Machine("lock", turns, states, leads)
    name = {"health": "turn", "noise": "push"}

    def model(records):
        now = "a"
        for r in records:
            if r.kind in name:
                after = leads.get((now, name[r.kind]), now)
                yield r.token, now, after
                now = after

    for width in (2, 7, 256):
        got = machines.machine_events(lines, machine, width)
        assert found(got, "logcat_token", "old_state", "new_state") == expected(boots, lambda rs: list(model(rs)))
    assert machines.machine_events(lines.limit(0), machine).collect() == []
    tracked = state.track(lines.where("not line like '%healthd%' and not line like '%other_tag%'"), machine)
    assert {r.lock for r in tracked.select("lock").distinct().collect()} == {"a"}


def test_machines_are_bounded():
    with pytest.raises(ValueError, match="states"):
        machines.Machine("x", lambda df: df, tuple(map(str, range(65))), {})
    with pytest.raises(ValueError, match="not among"):
        machines.Machine("x", lambda df: df, ("a",), {("a", "e"): "b"})


@pytest.mark.parametrize("seconds", [1, 7, 86_400, 3 * 86_400 + 5, 7 * 86_400])
def test_periods(spark, boots, seconds):
    """Days as the records have them, and seconds that run back now and then."""
    rng, text, want = random.Random(seconds), [], Counter()
    for b, records in boots.items():
        at, start = 1_451_606_400 + rng.randrange(1000), None
        for r in records:
            at += rng.choice([0, 0, 1, 2, 3, 40, -20, 9_000, 90_000] if seconds > 100 else [0, 0, 0, 1, 1, 2, -3, 15])
            stamp = datetime.fromtimestamp(at, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.000000")
            text.append((re.sub(r"2016-\d\d-\d\d 10:00:00\.123456", stamp, line_of(r), count=1),))
            us = at * 1_000_000
            if start is None:
                start = us
            elif us >= start + seconds * 1_000_000:
                want[(b, r.token, start, us)] += 1
                start = us
    lines = parse_loglines(spark.createDataFrame(text, "value string").repartition(4), segment_tokens=40)
    got = periods.period_boundaries(lines, timedelta(seconds=seconds))
    assert want and found(got, "logcat_token", "old_start", "new_start") == want


def test_periods_of_nothing(lines):
    assert periods.period_boundaries(lines.limit(0), timedelta(hours=1)).collect() == []
    assert periods.period_boundaries(lines, timedelta(days=400)).collect() == []
    with pytest.raises(ValueError, match="longer"):
        periods.period_boundaries(lines, timedelta(0))


def test_chunks_over_narrow_folds(spark, lines, boots):
    """Small arrays and a narrow tree give what large ones give; so do very many reports and segments."""
    def bounds(limit, width):
        got = chunks.chunk_boundaries(lines, limit, width)
        return Counter((r.boot_id, r["at"].logcat_token, r.closes) for r in got.select("boot_id", "at", "closes").collect())

    assert bounds(4, 2) == bounds(3, 5) == bounds(512, 256) and sum(bounds(4, 2).values()) > 20


@pytest.mark.parametrize("reports", [5_000, 20_000])
def test_very_many_boundaries(spark, reports):
    """Down from 100 and up again by a charger, each report a boundary, in many segments."""
    device, boot = "a" * 40, BOOTS[0]
    level = "100 - id % 100"
    stamp = "'2016-01-01 10:00:00.123456 203 204 D KernelPrintk <6>[1.0] healthd: battery'"
    text = f"concat('{device} 1 1.0 {boot} ', id, ' ', id, '.000000 ', {stamp}, ' l=', {level}, ' v=4000 t=30.5 h=2 st=3 c=-100 chg=', if(id % 100 = 0, 'u', ''))"
    many = parse_loglines(spark.range(reports).selectExpr(f"{text} as value"), segment_tokens=2)
    found = chunks.discharge_chunks(many)
    assert found.count() == reports // 100 * 98
