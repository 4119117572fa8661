"""Scans and segments on awkward orders: shared tokens, copies of lines, one hot boot."""

from collections import Counter

from pyspark.sql import functions as F

from bootloom.operators import chunks, ordering, sessions, state
from bootloom.operators.loglines import parse_loglines
from tests import models
from tests.phone import BOOT, device_line, line_of, random_boot


def raw_of(spark, records):
    """The records as read from a file: with their places, in no particular order."""
    rows = [(line_of(r), "f", 0, n) for n, r in enumerate(records)]
    return spark.createDataFrame(rows, "value string, file_name string, block_start int, line_no int").repartition(7)


def test_shared_tokens_and_copies(spark):
    records = random_boot(3, 800, ties=True)
    lines = parse_loglines(raw_of(spark, records), segment_tokens=25).cache()
    assert len({r.token for r in records}) < len(records)

    def found(df, *columns):
        return Counter(tuple(r) for r in df.select(*columns).collect())

    assert found(state.fgbg_transitions(lines), "logcat_token", "old_state", "new_state") == Counter(
        models.fgbg(records)[1]
    )
    cut = chunks.discharge_chunks(lines)
    members = found(chunks.chunk_lines(lines, cut), "start_token", "end_token", "logcat_token")
    assert members == Counter((s, e, t) for s, e, data in models.chunks(records) for t in data)
    got = found(
        sessions.session_metrics(sessions.ctx_switch_sessions(lines)),
        "cpu", "start_token", "end_token", "infos", "total_time",
    )
    assert got == Counter(row[:5] for row in models.sessions(records))


def test_hot_token_is_split_and_order_is_kept(spark):
    # A third of all lines shares one token, and most of those are copies of one line.
    text = [device_line(t, 1_000 * t, "T", f"x {t}") for t in range(2000)]
    text += [device_line(50, 50_000, "T", "copy")] * 700 + [device_line(50, 50_000 + n, "T", "hot") for n in range(300)]
    rows = [(line, "f", 0, n) for n, line in enumerate(text)]
    raw = spark.createDataFrame(rows, "value string, file_name string, block_start int, line_no int")
    lines = parse_loglines(raw, segment_tokens=100)
    split = ordering.split_hot_segments(lines, limit=200)
    sizes = [r["count"] for r in split.groupBy("segment").count().collect()]
    assert max(sizes) <= 400 and sum(sizes) == len(text)
    # The 1,100 rows of the hot segment make few parts, although it has a hundred tokens and many times.
    assert split.where("logcat_token < 100").select("segment").distinct().count() <= 1100 / 200 + 1
    span = split.groupBy("segment").agg(F.min("logcat_token").alias("low"), F.max("logcat_token").alias("high"))
    tokens = [(r.low, r.high) for r in span.orderBy("segment").collect()]
    assert all(a[1] <= b[0] for a, b in zip(tokens, tokens[1:]))

    def numbered(df):
        return sorted((r.seq, r.logcat_token, r.trace_us) for r in ordering.with_seq(df).collect())

    assert numbered(split) == numbered(lines)
    assert [n for n, *_ in numbered(split)] == list(range(1, len(text) + 1))


def test_split_leaves_small_segments_alone(spark):
    lines = parse_loglines(raw_of(spark, random_boot(1, 100)), segment_tokens=10)
    assert ordering.split_hot_segments(lines, limit=1000) is lines


def test_running_sum_before_and_at(spark):
    lines = parse_loglines(raw_of(spark, random_boot(8, 300)), segment_tokens=11)
    got = ordering.running_sum(lines, at={"at": F.lit(2)}, before={"before": F.lit(1)})
    rows = sorted((r.logcat_token, r.at, r.before) for r in got.collect())
    assert [(a, b) for _, a, b in rows] == [(2 * n + 2, n) for n in range(300)]


def test_carry_backward(spark):
    records = random_boot(9, 300)
    lines = parse_loglines(raw_of(spark, records), segment_tokens=9)
    power = F.when(F.col("line").contains("PM: suspend"), F.col("logcat_token"))
    got = ordering.carry(lines, at={"next": power}, before={"later": power}, backward=True)
    tokens = [r.token for r in records if r.kind == "power"]
    for row in got.collect():
        assert row.boot_id == BOOT
        assert row.next == min((t for t in tokens if t >= row.logcat_token), default=None)
        assert row.later == min((t for t in tokens if t > row.logcat_token), default=None)
