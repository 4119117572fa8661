"""Streams run to the end of what is there, and compared with the batch form."""

import gzip
import os
import random
from datetime import timedelta

import pytest

from pyspark.sql import functions as F

from bootloom.operators.loglines import parse_loglines
from bootloom.operators.state import fgbg_transitions
from bootloom.sources import commits
from bootloom.streaming import live
from tests.phone import DEVICE, device_line, line_of, random_boot


def put(path, name, lines):
    path.mkdir(exist_ok=True)
    (path / name).write_bytes(gzip.compress("".join(line + "\n" for line in lines).encode()))


def changes(df):
    return sorted(tuple(r) for r in df.select("logcat_token", "old_state", "new_state").collect())


def test_ingest_takes_each_file_once(spark, tmp_path):
    records = random_boot(1, 60)
    raw, store, offsets = tmp_path / "raw", str(tmp_path / "store"), str(tmp_path / "offsets")
    for part in range(3):
        put(raw, f"{part}.out.gz", [line_of(r) for r in records[part * 20 : part * 20 + 20]])
        live.ingest_stream(live.stream_loglines(spark, str(raw)), store, offsets).awaitTermination()
        assert live.read_ingested(spark, store).count() == part * 20 + 20


def test_foreground_whatever_the_batches(spark, tmp_path):
    """Files come late and out of order, and tokens of files interleave."""
    records = random_boot(5, 300)
    raw = tmp_path / "raw"
    run = [str(tmp_path / name) for name in ("out", "state", "offsets")]
    for part in (3, 0, 4, 1, 2):
        put(raw, f"{part}.out.gz", [line_of(r) for r in records[part::5]])
        lines = live.stream_loglines(spark, str(raw), segment_tokens=20)
        live.fgbg_stream(lines, *run).awaitTermination()
    batch = parse_loglines(spark.createDataFrame([(line_of(r),) for r in records], "value string"))
    want = changes(fgbg_transitions(batch))
    assert want and changes(live.read_transitions(spark, run[0])) == want


def test_late_lines_count_for_their_day(spark, tmp_path):
    raw = tmp_path / "raw"
    run = [str(tmp_path / name) for name in ("out", "offsets")]
    for n, rows in enumerate([[(t, 1) for t in range(5)], [(9, 3)], [(10, 1), (11, 9)]]):
        put(raw, f"{n}.out.gz", [device_line(t, t, "T", "x", day=day) for t, day in rows])
        live.count_stream(live.stream_loglines(spark, str(raw)), *run).awaitTermination()
    days = live.read_counts(spark, run[0]).orderBy("start_us").collect()
    first, day = 1451606400000000, 86_400_000_000
    assert [(r.device_id, r.start_us, r.lines) for r in days] == [
        (DEVICE, first, 6),
        (DEVICE, first + 2 * day, 1),
        (DEVICE, first + 8 * day, 1),
    ]


def test_daily_counts_of_a_table(spark):
    lines = parse_loglines(
        spark.createDataFrame([(device_line(t, t, "T", "x", day=1 + t % 2),) for t in range(6)], "value string")
    )
    assert sorted(r.lines for r in live.daily_counts(lines).collect()) == [3, 3]
    assert live.daily_counts(lines, "30 days").agg(F.sum("lines")).first()[0] == 6


def front(token, trace_us, pid):
    return device_line(token, trace_us, "Kernel-Trace", f"kworker/0:1-1 [000] ...1 1.0: phonelab_proc_foreground: pid={pid} tgid={pid} comm=a")


def stream_of(spark, raw, run, patterns="*.out.gz", **options):
    lines = live.stream_loglines(spark, str(raw), patterns, files_per_batch=1, segment_tokens=20)
    live.fgbg_stream(lines, *run, **options).awaitTermination()


def test_a_late_event_takes_a_transition_back(spark, tmp_path):
    raw, run = tmp_path / "raw", [str(tmp_path / name) for name in ("out", "state", "offsets")]
    put(raw, "0.out.gz", [front(1, 1_000_000, 0), device_line(30, 2_500_000, "T", "x")])
    stream_of(spark, raw, run)
    assert changes(live.read_transitions(spark, run[0])) == [(30, "UNKNOWN", "BACKGROUND")]
    put(raw, "1.out.gz", [front(25, 2_000_000, 0)])
    stream_of(spark, raw, run)
    assert changes(live.read_transitions(spark, run[0])) == []
    taken_back = commits.read_last(spark, run[0], live._CHANGES).where("change = -1").collect()
    assert [(r.logcat_token, r.new_state) for r in taken_back] == [(30, "BACKGROUND")]
    put(raw, "2.out.gz", [device_line(61, 3_000_001, "T", "y"), front(40, 2_600_000, 7), front(62, 3_100_000, 0)])
    stream_of(spark, raw, run)
    assert changes(live.read_transitions(spark, run[0])) == [(40, "UNKNOWN", "FOREGROUND")]


def test_foreground_for_random_orders_of_files(spark, tmp_path):
    """Twenty boots, each in four pieces of neighbouring or mixed lines that come in an order of its own."""
    raw, run = tmp_path / "raw", [str(tmp_path / name) for name in ("out", "state", "offsets")]
    files, records = [[], [], [], []], []
    for n in range(20):
        own = random_boot(50 + n, 70, boot=f"00000000-0000-4000-8000-{n:012d}")
        pieces = [own[k::4] for k in range(4)] if n % 2 else [own[k * 18 : k * 18 + 18] for k in range(4)]
        random.Random(n).shuffle(pieces)
        records += own
        for file, piece in zip(files, pieces):
            file += piece
    for n, own in enumerate(files):
        put(raw, f"{n}.out.gz", [line_of(r) for r in own])
        stream_of(spark, raw, run, buckets=4, fanout=2)
    batch = parse_loglines(spark.createDataFrame([(line_of(r),) for r in records], "value string"))

    def by_boot(df):
        return sorted(tuple(r) for r in df.select("boot_id", "logcat_token", "old_state", "new_state").collect())

    want = by_boot(fgbg_transitions(batch))
    assert len(want) > 60 and by_boot(live.read_transitions(spark, run[0])) == want


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    records = random_boot(8, 80)
    run = [str(tmp_path / name) for name in ("out", "state")]
    lines = [parse_loglines(spark.createDataFrame([(line_of(r),) for r in part], "value string"), segment_tokens=20)
             for part in (records[::2], records[1::2])]
    for batch in (0, 1, 1, 0):
        live._fgbg_batch(lines[batch % 2], batch, *run, delay_seconds=1.0, buckets=4, fanout=8)
    whole = parse_loglines(spark.createDataFrame([(line_of(r),) for r in records], "value string"))
    assert changes(live.read_transitions(spark, run[0])) == changes(fgbg_transitions(whole))
    store = str(tmp_path / "store")
    for batch in (0, 1, 1, 0):
        live._ingest_batch(lines[batch % 2], batch, store, buckets=4, segment_tokens=20, fanout=8)
    assert live.read_ingested(spark, store).count() == 80


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    boots = [f"00000000-0000-4000-8000-{n:012d}" for n in range(12)]
    records = [r for n, b in enumerate(boots) for r in random_boot(n, 20, boot=b)]
    lines = parse_loglines(spark.createDataFrame([(line_of(r),) for r in records], "value string"), segment_tokens=20)
    run = [str(tmp_path / name) for name in ("out", "state")]
    live._fgbg_batch(lines, 0, *run, delay_seconds=1.0, buckets=32, fanout=8)
    one = lines.where(F.col("boot_id") == boots[3]).limit(1)
    touched = one.select(live._bucket(32).alias("bucket"), *live.BOOT, F.col("segment").alias("since"))
    numbers = [r.bucket for r in touched.collect()]
    places, events = live.touched_places(spark, run[1], touched, numbers)
    for df in (places, events):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"PartitionFilters: [isnotnull(bucket" in plan or f"= {numbers[0]})" in plan
    assert {r.boot_id for r in places.collect()} == {boots[3]}
    scanned = {int(f.split("bucket=")[1].split("/")[0]) for f in commits.read_last(spark, run[1], live._NARROW).inputFiles()}
    assert len(scanned) > 3


def test_many_batches_make_few_files(spark, tmp_path):
    raw, store, offsets = tmp_path / "raw", str(tmp_path / "store"), str(tmp_path / "offsets")
    records = random_boot(3, 150)
    for n in range(50):
        put(raw, f"{n:02}.out.gz", [line_of(r) for r in records[n * 3 : n * 3 + 3]])
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    lines = live.stream_loglines(spark, str(raw), files_per_batch=1, segment_tokens=40)
    live.ingest_stream(lines, store, offsets, buckets=2, fanout=4).awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    version = commits.last_version(spark, store)
    got = live.read_ingested(spark, store)
    assert len(version.folders) <= 3 * 3 and version.notes["batch"] == 49
    assert len(got.inputFiles()) <= 40 and got.count() == 150
    boot = live.read_ingested(spark, store, records[0].device, records[0].boot)
    assert sorted(r.logcat_token for r in boot.collect()) == sorted(r.token for r in records)
    commits.drop_unused(spark, store)
    assert live.read_ingested(spark, store).count() == 150
    assert len([n for n in os.listdir(store) if n.startswith("data-")]) == len(version.folders)


def test_of_two_writers_one_begins_again(spark, tmp_path):
    path = str(tmp_path / "table")
    before = commits.last_version(spark, path)
    commits.commit(spark, path, before, [{"name": "data-a"}])
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, before, [{"name": "data-b"}])
    assert commits.last_version(spark, path).names == ["data-a"]


def test_closed_days_do_not_change(spark, tmp_path):
    """Counts and late lines are all lines, for several orders of arrival, and each closed day is written once."""
    for seed in range(2):
        rng = random.Random(seed)
        days = [rng.randrange(1, 9) for _ in range(24)]
        path = str(tmp_path / f"counts{seed}")
        seen = {}
        for batch, at in enumerate(range(0, 24, 4)):
            text = [(device_line(at + k, at + k, "T", "x", day=day),) for k, day in enumerate(days[at : at + 4])]
            lines = parse_loglines(spark.createDataFrame(text, "value string"))
            for _ in range(1 + batch % 2):
                live._count_batch(lines, batch, path, "1 day", timedelta(days=2), fanout=2)
            closed, still_open, late = live.read_closed_counts(spark, path)
            now = {r.start_us: r.lines for r in closed.collect()}
            assert now.items() >= seen.items() and closed.count() == len(now)
            assert not set(now) & {r.start_us for r in still_open.collect()}
            seen = now
            total = sum(now.values()) + sum(r.lines for r in still_open.collect()) + late.count()
            assert total == at + 4
        newest, late_days = -1, 0
        for at in range(0, 24, 4):
            late_days += sum(d + 1 <= newest - 2 + 1e-9 for d in days[at : at + 4])
            newest = max(newest, *[d + 10 / 24 for d in days[at : at + 4]])
        assert late.count() == late_days and len(commits.last_version(spark, path).folders) <= 12
