"""Files in, files out: raw logs, stores, manifests, chunk dumps, and the stitch run."""

import gzip
import json
import os
import re
import shutil
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from bootloom.operators import chunks, ordering, quality, state
from bootloom.operators.lineage import settle, settled_within, shared_dir
from bootloom.operators.loglines import parse_loglines
from bootloom.plans import distributions
from bootloom.plans import stitch as stitching
from bootloom.plans.stitch import chunk_devices, stitch
from bootloom.sources import commits, logs, writers
from tests import models
from tests.phone import BOOT, device_line, line_of, random_boot

DEVICES = ["a" * 40, "b" * 40]


def write_gz(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wb") as out:
        out.write("".join(line + "\n" for line in lines).encode())


@pytest.fixture
def upload(tmp_path):
    """Two devices, three files each, lines of a file in order."""
    records = {}
    for n, device in enumerate(DEVICES):
        boot = BOOT[:-1] + str(n)
        records[device] = random_boot(n + 20, 300, boot)
        for part in range(3):
            lines = [line_of(r).replace("a" * 40, device) for r in records[device][part * 100 : part * 100 + 100]]
            write_gz(tmp_path / "raw" / device / f"{part}.out.gz", lines)
    write_gz(tmp_path / "raw" / "not-a-device" / "0.other.gz", ["skip me"])
    return tmp_path, records


def test_raw_logs(spark, upload):
    path, _ = upload
    raw = logs.read_raw_logs(spark, str(path / "raw"))
    assert {r.file_device: r["count"] for r in raw.groupBy("file_device").count().collect()} == dict.fromkeys(DEVICES, 300)
    both = logs.read_raw_logs(spark, str(path / "raw"), "*.out.gz, *.other.gz")
    assert both.count() == 601 and both.where("file_device is null").count() == 1
    first = raw.where(F.col("file_name").endswith(f"{DEVICES[0]}/1.out.gz")).orderBy("line_no").first()
    assert f"  {upload[1][DEVICES[0]][100].token} " in first.value


def test_carriage_returns(spark, tmp_path):
    (tmp_path / "x.out.gz").write_bytes(gzip.compress(b"one\rstill one\r\ntwo\n"))
    assert [r.value for r in logs.read_raw_logs(spark, str(tmp_path)).collect()] == ["one\rstill one", "two"]


def test_devices(spark, upload):
    path, _ = upload
    devices = logs.list_devices(logs.list_files(spark, str(path / "raw"), "*.gz"))
    assert sorted(r.device_id for r in devices.collect()) == DEVICES
    for wanted in (DEVICES[1] + "  " + "c" * 40, [DEVICES[1]], devices.where(F.col("device_id") == DEVICES[1])):
        assert [r.device_id for r in logs.filter_devices(devices, wanted).collect()] == [DEVICES[1]]
    assert logs.filter_devices(devices, "").count() == logs.filter_devices(devices, None).count() == 2


def test_token_order(spark, tmp_path):
    tokens = [[1, 2, 2, 5], [4, 6, 7], [7, 3]]
    for n, part in enumerate(tokens):
        write_gz(tmp_path / DEVICES[0] / f"{n}.out.gz", [device_line(t, 1_000_000 + t, "T", "x") for t in part])
    raw = logs.read_raw_logs(spark, str(tmp_path))
    lines = parse_loglines(raw, device=F.col("file_device"))
    for size in (1, 2, 1000):
        loose = quality.token_order_violations(lines, segment_lines=size)
        assert sorted((r.previous_token, r.logcat_token) for r in loose.collect()) == [(5, 4), (7, 3)]
        strict = quality.token_order_violations(lines, strict=True, segment_lines=size)
        assert sorted((r.previous_token, r.logcat_token) for r in strict.collect()) == [(2, 2), (5, 4), (7, 3), (7, 7)]


def test_stitch_keeps_every_line_in_order(spark, upload):
    path, records = upload
    store, manifest = str(path / "store"), str(path / "manifest")
    stitch(spark, str(path / "raw"), store, manifest, segment_tokens=50)
    lines = logs.read_store(spark, store)
    for device in DEVICES:
        boot = logs.read_boot(lines, device, records[device][0].boot)
        got = [r.logcat_token for r in ordering.with_seq(boot).orderBy("seq").collect()]
        assert got == [r.token for r in records[device]]
    read = logs.read_manifest(spark, manifest, "*.json", multi_line=False).collect()
    assert {r.device_id: (r.bootids, len(r.files)) for r in read} == {d: ([records[d][0].boot], 3) for d in DEVICES}

    # The places of lines in their files are kept, and so can be checked.
    assert quality.token_order_violations(lines.drop("segment"), strict=True).count() == 0

    # A second run takes the new file only.
    extra = [device_line(10_000_000, 1, "T", "late", records[DEVICES[0]][0].boot)]
    write_gz(path / "raw" / DEVICES[0] / "9.out.gz", extra)
    stitch(spark, str(path / "raw"), store, manifest, segment_tokens=50)
    assert logs.read_store(spark, store).count() == 601

    # A file that is no longer listed stays in the manifest, and a third run finds nothing to do.
    stitch(spark, str(path / "raw"), store, manifest, "[0-2].out.gz", segment_tokens=50)
    stitch(spark, str(path / "raw"), store, manifest, segment_tokens=50)
    assert logs.read_store(spark, store).count() == 601 and logs.stitched_files(spark, manifest).count() == 7

    # A run that failed before its manifest was written is done again, without duplicates.
    newest = max((path / "manifest").glob("run=*"), key=lambda p: p.stat().st_mtime_ns).name
    shutil.copytree(path / "store", path / "store2")
    shutil.copytree(path / "manifest", path / "manifest2", ignore=shutil.ignore_patterns(newest))
    write_gz(path / "raw" / DEVICES[0] / "8.out.gz", [device_line(11, 1, "T", "x", records[DEVICES[0]][0].boot)])
    stitch(spark, str(path / "raw"), str(path / "store2"), str(path / "manifest2"), segment_tokens=50)
    assert logs.read_store(spark, str(path / "store2")).count() == 602


def test_order_does_not_depend_on_runs(spark, tmp_path):
    """One run with a hot token, others without, tokens that overlap: as if stitched at once."""
    parts = [range(0, 40), range(30, 60), range(10, 20)]
    for n, tokens in enumerate(parts):
        own = [device_line(t, 1_000 * t + n, "T", f"x {t} {n}") for t in tokens]
        if n == 1:
            own += [device_line(35, 35_000, "T", f"hot {k}") for k in range(200)]
        write_gz(tmp_path / "raw" / DEVICES[0] / f"{n}.out.gz", own)
    raw = str(tmp_path / "raw")
    stitch(spark, raw, str(tmp_path / "a"), str(tmp_path / "am"), segment_tokens=8)
    stitch(spark, raw, str(tmp_path / "b"), str(tmp_path / "bm"), segment_tokens=8, files_per_run=1)

    def numbered(path):
        lines = ordering.split_hot_segments(logs.read_store(spark, str(path)), limit=20)
        return sorted((r.seq, r.line) for r in ordering.with_seq(lines).collect())

    whole = numbered(tmp_path / "a")
    assert whole == numbered(tmp_path / "b") and [s for s, _ in whole] == list(range(1, 281))
    tokens = [int(re.search(r"x (\d+)|hot", line)[1] or 35) for _, line in whole]
    assert tokens == sorted(tokens)


def test_lines_of_an_unknown_device_stay(spark, tmp_path):
    text = [(f"{BOOT} 2016-01-02 03:04:05.000006 {t} [{t}.5] 1 2 I Tag: x {t}",) for t in range(6)]
    lines = parse_loglines(spark.createDataFrame(text, "value string"))
    writers.write_stitched(lines, str(tmp_path / "s"))
    back = logs.read_store(spark, str(tmp_path / "s"))
    assert {r.device_id for r in back.collect()} == {""}
    assert sorted(r.seq for r in ordering.with_seq(back).collect()) == [1, 2, 3, 4, 5, 6]
    assert state.charging_state(back).count() == 6


def test_files_are_sorted_and_rotated(spark, upload):
    path, records = upload
    lines = parse_loglines(logs.read_raw_logs(spark, str(path / "raw")), segment_tokens=1 << 40)
    writers.write_stitched(lines, str(path / "store"), lines_per_file=100)
    stored = logs.read_store(spark, str(path / "store")).select("*", F.col("_metadata.file_path").alias("file"))
    tokens = {}
    for row in stored.withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect():
        tokens.setdefault(row.file, []).append(row.logcat_token)
    assert all(t == sorted(t) and len(t) <= 100 for t in tokens.values()) and len(tokens) >= 6
    writers.export_lines(lines, str(path / "text"))
    back = spark.read.text(str(path / "text"), recursiveFileLookup=True)
    assert Counter(r.value for r in back.collect()) == Counter(r.line for r in lines.select("line").collect())


def test_manifests(spark, tmp_path):
    right, wrong, broken = (tmp_path / (c * 40) / "info.json" for c in "abc")
    for file, content in [
        (right, json.dumps({"bootids": ["b1", "b2", "b3"]}, indent=4)),
        (wrong, json.dumps({"other": "words"})),
        (broken, "{"),
    ]:
        file.parent.mkdir()
        file.write_text(content)
    got = {r.device_id: (r.bootids, r.is_valid) for r in logs.read_manifest(spark, str(tmp_path)).collect()}
    assert got == {"a" * 40: (["b1", "b2", "b3"], True), "b" * 40: (None, False), "c" * 40: (None, False)}

    devices = spark.createDataFrame([(c * 40,) for c in "abd"], "device_id string")
    manifest = logs.read_manifest(spark, str(tmp_path))
    boots = logs.device_boots(devices, manifest).collect()
    assert sorted((r.device_id[0], r.boot_id or "") for r in boots) == [
        ("a", "b1"), ("a", "b2"), ("a", "b3"), ("b", ""), ("d", ""),
    ]
    assert sorted(r.device_id[0] for r in logs.skipped_devices(devices, manifest).collect()) == ["b", "d"]


def test_sets(spark):
    def table(*names):
        return spark.createDataFrame([(n,) for n in names], "file_name string")

    def names(df):
        return sorted(r.file_name for r in df.collect())

    assert names(logs.new_files(table("a", "b", "c"), table("b"))) == ["a", "c"]
    assert names(logs.merged_files(table("a", "b"), table("b", "c"))) == ["a", "b", "c"]
    boots = spark.createDataFrame([("d", "x"), ("d", "y")], "device_id string, boot_id string")
    assert logs.merged_bootids(boots, boots.where("boot_id = 'x'")).count() == 2
    devices = spark.createDataFrame([("d",), ("e",)], "device_id string")
    assert [r.device_id for r in logs.pending_devices(devices, boots).collect()] == ["e"]
    assert logs.pending_devices(devices, boots, reload=True).count() == 2
    assert [r.device_id for r in logs.device_intersection(devices, boots).collect()] == ["d"]


def test_chunk_store(spark, upload):
    path, records = upload
    lines = parse_loglines(logs.read_raw_logs(spark, str(path / "raw")), segment_tokens=50)
    chunk_devices(lines, str(path / "tbc"))
    headers, members = logs.read_chunks(spark, str(path / "tbc"))
    want = [(r[0].boot, s, e, len(data)) for r in records.values() for s, e, data in models.chunks(r)]
    assert sorted((r.boot_id, r.start_token, r.end_token) for r in headers.collect()) == sorted(w[:3] for w in want)
    assert members.count() == sum(w[3] for w in want)
    done = logs.done_devices(spark, str(path / "tbc"))
    todo = spark.createDataFrame([(d,) for d in [*DEVICES, "c" * 40]], "device_id string")
    assert [r.device_id for r in logs.pending_devices(todo, done).collect()] == ["c" * 40]
    cpus, fgbg = logs.read_chunk_states(spark, str(path / "tbc"))
    assert cpus.count() > 0 and fgbg.count() == headers.count()

    # What is done is left alone, also by a run over other devices; a reload replaces it.
    before = sorted(map(tuple, headers.select("device_id", "boot_id", "start_token").collect()))
    chunk_devices(lines.where(F.col("device_id") == DEVICES[0]), str(path / "tbc"))
    chunk_devices(lines.limit(0), str(path / "tbc"))
    chunk_devices(lines.where(F.col("device_id") == DEVICES[1]), str(path / "tbc"), reload=True)
    again = logs.read_chunks(spark, str(path / "tbc"))[0]
    assert sorted(map(tuple, again.select("device_id", "boot_id", "start_token").collect())) == before


def test_done_devices_are_left_out_without_a_shuffle(spark, upload, monkeypatch):
    """With no device done, and with some: joined by device, the lines of one device would meet in one task."""
    path, _ = upload
    lines = settle(parse_loglines(logs.read_raw_logs(spark, str(path / "raw")), segment_tokens=50))
    plans, find = [], stitching.discharge_chunks

    def seen(rest):
        plans.append(rest._jdf.queryExecution().executedPlan().toString())
        return find(rest)

    monkeypatch.setattr(stitching, "discharge_chunks", seen)
    for some in (lines.where(F.col("device_id") == DEVICES[0]), lines):
        chunk_devices(some, str(path / "spread"))
    assert len(plans) == 2 and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans), plans
    assert {r.device_id for r in logs.read_chunk_counts(spark, str(path / "spread")).collect()} == set(DEVICES)


def chunk_rows(spark, path):
    tables = [*logs.read_chunks(spark, path), *logs.read_chunk_states(spark, path)]
    return [sorted((r.device_id, r.boot_id, r.start_token) for r in t.collect()) for t in tables]


def test_a_reload_replaces_also_by_nothing(spark, upload):
    path, records = upload
    lines = parse_loglines(logs.read_raw_logs(spark, str(path / "raw")), segment_tokens=50)
    store = str(path / "again")
    chunk_devices(lines, store)
    before = chunk_rows(spark, store)
    device = before[0][0][0]
    assert all(device in {d for d, _, _ in rows} for rows in before)
    quiet = lines.where((F.col("device_id") == device) & ~F.col("line").contains("healthd"))
    chunk_devices(quiet, store, reload=True)
    want = [[row for row in rows if row[0] != device] for rows in before]
    assert chunk_rows(spark, store) == want
    counts = {(r.device_id, r.boot_id): r.chunks for r in logs.read_chunk_counts(spark, store).collect()}
    assert {n for (d, _), n in counts.items() if d == device} == {0} and sum(counts.values()) == len(want[0])
    assert sorted(r.device_id for r in logs.done_devices(spark, store).collect()) == sorted(DEVICES)
    writers.merge_generations(spark, store)
    commits.drop_unused(spark, store)
    assert chunk_rows(spark, store) == want and len(commits.last_version(spark, store).folders) == 1
    chunk_devices(lines, store, reload=True)
    assert chunk_rows(spark, store) == before


def test_a_reload_that_fails_half_way_changes_nothing(spark, upload, monkeypatch):
    path, records = upload
    lines = parse_loglines(logs.read_raw_logs(spark, str(path / "raw")), segment_tokens=50)
    store = str(path / "failing")
    chunk_devices(lines, store)
    before = chunk_rows(spark, store)
    written, write = [], writers.by_device
    for after in (1, 3):

        def stops(df, place, *args, **options):
            if len(written) == after:
                raise OSError("the run ends here")
            written.append(place)
            write(df, place, *args, **options)

        monkeypatch.setattr(writers, "by_device", stops)
        with pytest.raises(OSError, match="ends here"):
            chunk_devices(lines.where(~F.col("line").contains("healthd")), store, reload=True)
        written.clear()
        assert chunk_rows(spark, store) == before
    monkeypatch.setattr(writers, "by_device", write)
    commits.drop_unused(spark, store)
    assert chunk_rows(spark, store) == before


def test_settled_tables_go_with_their_scope(spark):
    root = shared_dir(spark).removeprefix("file:")

    def tables():
        return {name for name in os.listdir(root) if name.startswith("settled-")}

    before = tables()
    with settled_within(spark):
        with settled_within(spark) as inner:
            settle(spark.range(3))
            kept = settle(spark.range(5))
            inner.keep(kept)
        assert len(tables() - before) == 1 and kept.count() == 5
    assert tables() == before


def test_chunk_dumps(spark, tmp_path):
    def report(token, level):
        line = {"Line": "l", "BootId": BOOT, "LogcatToken": token, "TraceTime": 1.5, "Datetime": "2016-01-01T00:00:00Z"}
        return {"Logline": line, "Timestamp": 1.5, "L": level, "V": 4000, "T": 30.5, "H": 2, "St": 3, "C": -1, "Chg": ""}

    dump = {
        "Start": report(5, 90), "End": report(9, 89), "StartFgBgState": 2, "Data": [{"LogcatToken": 6}, {"LogcatToken": 7}],
        "StartCpuState": {"0": {"Cpu": 0, "CpuState": 1, "Frequency": 300000}},
    }
    write_gz(tmp_path / DEVICES[0] / "analysis" / "temp_battery" / "00000000.gz", [json.dumps(dump, indent=4)])
    (row,) = logs.read_chunk_dumps(spark, str(tmp_path)).collect()
    assert (row.device_id, row.boot_id, row.start_token, row.end_token) == (DEVICES[0], BOOT, 5, 9)
    assert [d.LogcatToken for d in row.Data] == [6, 7] and row.StartCpuState["0"].Frequency == 300000


def test_chunk_dumps_share_files(spark, tmp_path):
    """Many dumps of a device are in few files, with single ones beside them, and none is lost."""
    line = {"Logline": {"BootId": BOOT, "LogcatToken": 1}}
    (tmp_path / DEVICES[1]).mkdir()
    write_gz(tmp_path / DEVICES[1] / "00000000.gz", [json.dumps({"Start": line, "End": line}, indent=4)])
    report = "named_struct('Logline', named_struct('BootId', boot_id, 'LogcatToken', {}))"
    dumps = spark.range(300).selectExpr(
        f"'{DEVICES[0]}' as device_id", f"'{BOOT}' as boot_id", "id div 2 as start_token", "id div 2 + 1 as end_token",
        "cast(id % 2 as int) as part",
    )
    dumps = dumps.selectExpr(
        "*", f"{report.format('start_token')} as Start", f"{report.format('end_token')} as End",
        "array(named_struct('LogcatToken', start_token, 'Line', 'a\nb')) as Data",
    )
    writers.write_chunk_dumps(dumps, str(tmp_path / "dumps"))
    files = [f for _, _, names in os.walk(tmp_path / "dumps") for f in names if f.endswith(".gz")]
    assert len(files) <= 2
    got = logs.read_chunk_dumps(spark, str(tmp_path)).collect()
    assert Counter((r.device_id, r.boot_id, r.start_token, r.end_token) for r in got) == Counter(
        [(DEVICES[0], BOOT, n // 2, n // 2 + 1) for n in range(300)] + [(DEVICES[1], BOOT, 1, 1)]
    )
    assert {d.Line for r in got for d in r.Data or []} == {"a\nb"}


def test_thermal_lines(spark, upload):
    path, records = upload
    lines = parse_loglines(logs.read_raw_logs(spark, str(path / "raw")))
    writers.write_thermal_lines(lines, str(path / "temps"))
    back = spark.read.text(str(path / "temps"), recursiveFileLookup=True)
    want = Counter(line_of(r).replace("a" * 40, d) for d, rs in records.items() for r in rs if r.kind == "temp")
    assert Counter(r.value for r in back.collect()) == want
    counts = {r.device_id: r.lines for r in distributions.thermal_line_counts(lines).collect()}
    assert counts == {d: sum(r.kind == "temp" for r in rs) for d, rs in records.items()}


def test_lists_are_whole_and_bounded(spark):
    df = spark.range(1000).selectExpr("if(id < 700, 'hot', 'cold') as k", "id / 4 as share")
    whole = distributions.share_lists(df, "k").collect()
    assert {r.k: len(r.shares) for r in whole} == {"hot": 700, "cold": 300} and {r.part for r in whole} == {0}
    parts = distributions.share_lists(df, "k", limit=100).collect()
    assert sum(len(r.shares) for r in parts) == 1000 and max(len(r.shares) for r in parts) < 160
    assert sorted(x for r in parts for x in r.shares) == [n / 4 for n in range(1000)]
    # A key's rows do not depend on other keys.
    assert {r.k: sum(p.k == r.k for p in parts) for r in parts} == {"hot": 7, "cold": 3}
    alone = distributions.share_lists(df.where("k = 'cold'"), "k", limit=100).collect()
    assert sorted(map(str, alone)) == sorted(str(r) for r in parts if r.k == "cold")


def test_manifest_parts_are_all_valid(spark, tmp_path):
    boots = spark.createDataFrame([("d", "x")], "device_id string, boot_id string")
    files = spark.createDataFrame([("d", f"f{n}") for n in range(30)], "device_id string, file_name string")
    writers.write_json(writers.manifest(boots, files, limit=10), str(tmp_path / "m"))
    read = logs.read_manifest(spark, str(tmp_path / "m"), "*.json", multi_line=False).collect()
    assert len(read) == 3 and all(r.is_valid for r in read)
    assert sorted(f for r in read for f in r.files) == sorted(f"f{n}" for n in range(30))


def test_shared_dir_is_the_session_s():
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": "/shared"}.get(key, default))
    )
    assert shared_dir(session) == "/shared"


def test_chunks_of_nothing(spark):
    empty = parse_loglines(spark.createDataFrame([], "value string"))
    assert chunks.discharge_chunks(empty).count() == 0
