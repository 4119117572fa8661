"""The same work on files as they arrive."""

from __future__ import annotations

from datetime import timedelta
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from bootloom.operators.events import proc_foreground_events
from bootloom.operators.lineage import settle, settled_within
from bootloom.operators.loglines import parse_loglines
from bootloom.operators.ordering import BOOT, ORDER, SEGMENT_TOKENS, split_hot_segments
from bootloom.operators.state import fgbg_changes_of, is_fgbg_event
from bootloom.sources.commits import FANOUT, commit, last_version, merge_small, new_folder, read_last
from bootloom.sources.logs import RAW_PATTERN, STORE_SCHEMA, device_of_path, name_glob, packed, unpacked, without_return


_MICROSECOND = timedelta(microseconds=1)


def stream_loglines(
    spark: SparkSession,
    path: str,
    patterns: str = RAW_PATTERN,
    files_per_batch: int = 10_000,
    segment_tokens: int = SEGMENT_TOKENS,
) -> DataFrame:
    """Parsed lines of the files below ``path``, each file once; ``file_name`` tells where from."""
    text = (
        spark.readStream.option("pathGlobFilter", name_glob(patterns))
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .text(path, lineSep="\n")
        .select(
            without_return(F.col("value")).alias("value"),
            F.col("_metadata.file_path").alias("file_name"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
    )
    return parse_loglines(text, "value", device_of_path(F.col("file_name")), segment_tokens=segment_tokens)


STORE_BUCKETS = 16


def ingest_stream(
    lines: DataFrame,
    store_path: str,
    checkpoint: str,
    buckets: int = STORE_BUCKETS,
    segment_tokens: int = SEGMENT_TOKENS,
    fanout: int = FANOUT,
) -> StreamingQuery:
    """Append the lines that have arrived to the store and stop; files seen before are not read again.

    A batch is one data folder, cut by ``buckets`` of boots and sorted by boot and
    order inside; a segment that is too large for one task is written by several.
    It counts from the version that names it on, so a batch that is run again
    adds nothing twice.  Folders of finished batches are merged, ``fanout`` of a
    size into one, so that their number stays small.  Read with :func:`read_ingested`.
    """
    step = partial(_ingest_batch, path=store_path, buckets=buckets, segment_tokens=segment_tokens, fanout=fanout)
    return _to_the_end(lines.writeStream.foreachBatch(step), checkpoint)


def _write_bucketed(lines: DataFrame, path: str) -> None:
    """Stored lines by bucket, sorted by boot and order; ``_spread`` says what is written together."""
    spread = "_spread" if "_spread" in lines.columns else "segment"
    placed = lines.repartition("bucket", spread, *BOOT).sortWithinPartitions("bucket", *BOOT, "segment", *ORDER)
    placed.drop("_spread").write.partitionBy("bucket").parquet(path)


def _ingest_batch(lines: DataFrame, batch: int, path: str, buckets: int, segment_tokens: int, fanout: int) -> None:
    spark = lines.sparkSession
    version = last_version(spark, path)
    if version.notes.get("batch", -1) < batch:
        with settled_within(spark):
            arrived = settle(packed(lines).withColumn("bucket", _bucket(buckets)))
            folder = {"name": new_folder(), "level": 0}
            _write_bucketed(split_hot_segments(arrived, 4 * segment_tokens, into="_spread"), f"{path}/{folder['name']}")
        commit(spark, path, version, [*version.folders, folder], {"batch": batch, "buckets": buckets})
    merge_small(spark, path, _INGESTED, _write_bucketed, fanout)


def read_ingested(spark: SparkSession, path: str, device_id: str | None = None, boot_id: str | None = None) -> DataFrame:
    """Parsed lines that :func:`ingest_stream` has stored; of one boot, if both ids are given, from its bucket only."""
    stored = read_last(spark, path, _INGESTED)
    if device_id is not None and boot_id is not None:
        own = spark.range(1).select(F.lit(device_id).alias("device_id"), F.lit(boot_id).alias("boot_id"))
        (bucket,) = own.select(_bucket(last_version(spark, path).notes["buckets"])).first()
        stored = stored.where((F.col("bucket") == bucket) & (F.col("device_id") == device_id) & (F.col("boot_id") == boot_id))
    return unpacked(stored.drop("bucket"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*BOOT), F.lit(buckets)).cast("int")


def daily_counts(lines: DataFrame, length: str = "1 day", lateness: str | None = None) -> DataFrame:
    """``lines`` per device and day (``start_us``); on a stream, ``lateness`` leaves out lines that come later."""
    timed = lines.withColumn("_time", F.concat(F.col("datetime").cast("string"), F.lit("Z")).cast("timestamp"))
    if lines.isStreaming and lateness:
        timed = timed.withWatermark("_time", lateness)
    counted = timed.groupBy(F.window("_time", length), "device_id").agg(F.count("*").alias("lines"))
    return counted.select("device_id", F.unix_micros("window.start").alias("start_us"), "lines")


def count_stream(lines: DataFrame, out_path: str, checkpoint: str, length: str = "1 day") -> StreamingQuery:
    """Counts of arriving lines as ``out_path/batch=n``; :func:`read_counts` adds them up.

    A line counts for its day however late its upload comes, and no state is
    kept.  A batch that is run again replaces its own counts.
    """

    def step(batch_lines: DataFrame, batch: int) -> None:
        daily_counts(batch_lines, length).write.mode("overwrite").parquet(f"{out_path}/batch={batch}")

    return _to_the_end(lines.writeStream.foreachBatch(step), checkpoint)


def read_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """``lines`` per device and day over all batches."""
    counts = spark.read.schema("device_id string, start_us bigint, lines bigint").parquet(out_path)
    return counts.groupBy("device_id", "start_us").agg(F.sum("lines").alias("lines"))


_COUNTS = "device_id string, start_us bigint, lines bigint"
_LATE = "device_id string, boot_id string, segment bigint, logcat_token bigint, trace_us bigint, line_id bigint, start_us bigint"


def closed_count_stream(
    lines: DataFrame, path: str, checkpoint: str, length: str = "1 day", lateness: timedelta = timedelta(days=1), fanout: int = FANOUT
) -> StreamingQuery:
    """Counts that do not change any more: a day's count is written once, when lines have come that are ``lateness`` after it.

    The watermark is the latest time of any line so far less ``lateness``.  A batch
    adds its lines to the counts of open days; a line whose day is closed goes to
    a table of late lines instead of being lost.  Then the days that end at or
    before the new watermark are closed.  Open counts, closed counts, late lines
    and the watermark change together with one version, so a batch that is run
    again adds nothing twice.  Read with :func:`read_closed_counts`.
    """
    step = partial(_count_batch, path=path, length=length, lateness=lateness, fanout=fanout)
    return _to_the_end(lines.writeStream.foreachBatch(step), checkpoint)


def _count_batch(lines: DataFrame, batch: int, path: str, length: str, lateness: timedelta, fanout: int) -> None:
    spark = lines.sparkSession
    version = last_version(spark, path)
    if version.notes.get("batch", -1) < batch:
        mark = version.notes.get("watermark_us")
        with settled_within(spark):
            time = F.concat(F.col("datetime").cast("string"), F.lit("Z")).cast("timestamp")
            windows = lines.where("datetime is not null").withColumn("_time", time).withColumn("_window", F.window("_time", length))
            us = {c: F.unix_micros(f"_window.{k}") for c, k in (("start_us", "start"), ("end_us", "end"))}
            arrived = settle(windows.select(*_PLACE, F.unix_micros("_time").alias("us"), *[e.alias(c) for c, e in us.items()]))
            latest = arrived.agg(F.max("us")).first()[0]
            after = max((m for m in (mark, None if latest is None else latest - lateness // _MICROSECOND) if m is not None), default=None)
            is_late = F.lit(False) if mark is None else F.col("end_us") <= mark
            counted = arrived.where(~is_late).groupBy("device_id", "start_us", "end_us").agg(F.count("*").alias("lines"))
            known = read_last(spark, path, f"{_COUNTS}, end_us bigint", "open").unionByName(counted)
            known = settle(known.groupBy("device_id", "start_us", "end_us").agg(F.sum("lines").alias("lines")))
            is_closed = F.lit(False) if after is None else F.col("end_us") <= after
            new = {
                "open": known.where(~is_closed),
                "closed": known.where(is_closed).drop("end_us"),
                "late": arrived.where(is_late).select(*_PLACE, "start_us"),
            }
            folders = [f for f in version.folders if f["kind"] != "open"]
            for kind, rows in new.items():
                folders.append({"name": new_folder(), "level": 0, "kind": kind})
                rows.write.parquet(f"{path}/{folders[-1]['name']}")
        commit(spark, path, version, folders, {"batch": batch, "watermark_us": after})
    for kind, schema in (("closed", _COUNTS), ("late", _LATE)):
        merge_small(spark, path, schema, lambda rows, place: rows.write.parquet(place), fanout, kind)


def read_closed_counts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Closed counts, counts that may still grow, and the late lines of closed days."""
    return read_last(spark, path, _COUNTS, "closed"), read_last(spark, path, _COUNTS, "open"), read_last(spark, path, _LATE, "late")


def _to_the_end(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_PLACES = "device_id string, boot_id string, segment bigint, logcat_token bigint, trace_us bigint, line_id bigint"
_PLACE = [*BOOT, "segment", *ORDER]
_NARROW = f"{_PLACES}, line string, payload string, bucket int"
_CHANGES = f"{_PLACES}, old_state string, new_state string, change bigint, bucket int"
_INGESTED = f"{STORE_SCHEMA}, bucket int"
#: Boots are dealt to so many buckets, and a batch reads those of its boots only.
BUCKETS = 64


def fgbg_stream(
    lines: DataFrame,
    out_path: str,
    state_path: str,
    checkpoint: str,
    delay_seconds: float = 1.0,
    buckets: int = BUCKETS,
    fanout: int = FANOUT,
) -> StreamingQuery:
    """Foreground transitions of all lines that have arrived; stops at the end of what is there.

    The result is that of :func:`bootloom.operators.state.fgbg_transitions` over
    all lines so far, whatever batches brought them and in whatever order.  A
    late line may undo a transition, so ``out_path`` is a list of changes: rows with
    ``change`` 1 add a transition, rows with -1 take one back.

    Below ``state_path`` is a narrow table of all lines' places, with the text of
    foreground events only.  A batch adds its own, and then works on the boots
    that it touched, each from the first segment that got a line on: of what is
    before, the latest event and transition say all that matters.  Both tables
    are cut into buckets of boots, and only those of touched boots are read.  A
    batch that is run again adds nothing twice; folders of finished batches are
    merged.  Read with :func:`read_transitions`.
    """
    step = partial(
        _fgbg_batch, out_path=out_path, state_path=state_path, delay_seconds=delay_seconds, buckets=buckets, fanout=fanout
    )
    return _to_the_end(lines.writeStream.foreachBatch(step), checkpoint)


def _add_batch(df: DataFrame, batch: int, path: str) -> None:
    """Add the rows as a folder of the table, once."""
    spark = df.sparkSession
    version = last_version(spark, path)
    if version.notes.get("batch", -1) < batch:
        folder = {"name": new_folder(), "level": 0}
        _write_boots(df, f"{path}/{folder['name']}")
        commit(spark, path, version, [*version.folders, folder], {"batch": batch})


def _write_boots(df: DataFrame, path: str) -> None:
    placed = df.repartition("bucket", "segment", *BOOT).sortWithinPartitions("bucket", *BOOT, "segment", *ORDER)
    placed.write.partitionBy("bucket").parquet(path)


def _fgbg_batch(
    lines: DataFrame, batch: int, out_path: str, state_path: str, delay_seconds: float, buckets: int, fanout: int
) -> None:
    spark = lines.sparkSession
    text = [F.when(is_fgbg_event(), F.col(c)).alias(c) for c in ("line", "payload")]
    with settled_within(spark):
        own = settle(lines.select(*_PLACE, *text, _bucket(buckets).alias("bucket")))
        _add_batch(own, batch, state_path)
        if last_version(spark, out_path).notes.get("batch", -1) < batch:
            _add_batch(_fgbg_news(own, state_path, out_path, delay_seconds, buckets), batch, out_path)
    merge_small(spark, state_path, _NARROW, _write_boots, fanout)
    merge_small(spark, out_path, _CHANGES, _write_boots_net, fanout)


def touched_places(
    spark: SparkSession, state_path: str, touched: DataFrame, numbers: list[int]
) -> tuple[DataFrame, DataFrame]:
    """The places of the touched boots from their first touched segment ``since`` on, and all their foreground events.

    ``touched`` has ``bucket``, boot and ``since``, ``numbers`` are its buckets; no
    other bucket is scanned.
    """
    known = read_last(spark, state_path, _NARROW).where(F.col("bucket").isin(numbers))
    boots = touched.drop("bucket")
    places = known.select("bucket", *_PLACE).join(boots, BOOT).where("segment >= since").select(*_PLACE)
    events = proc_foreground_events(known.where("line is not null").join(boots, BOOT))
    return places, events.select(*_PLACE, "fg_pid", "since")


def _fgbg_news(own: DataFrame, state_path: str, out_path: str, delay_seconds: float, buckets: int) -> DataFrame:
    """The changes that a batch makes to the transitions written so far."""
    spark = own.sparkSession
    states = ["old_state", "new_state"]
    added = F.lit(1).cast("bigint").alias("change")
    if not last_version(spark, out_path).folders:
        # Nothing is before the first batch.
        first = fgbg_changes_of(own, proc_foreground_events(own), delay_seconds)
        return _net(first.select(_bucket(buckets).alias("bucket"), *_PLACE, *states, added))
    touched = settle(own.groupBy("bucket", *BOOT).agg(F.min("segment").alias("since")))
    # A bounded number, whatever a batch brings.
    numbers = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
    places, events = touched_places(spark, state_path, touched, numbers)
    events = settle(events)
    written = _net(read_last(spark, out_path, _CHANGES).where(F.col("bucket").isin(numbers)))
    written = settle(written.join(touched.drop("bucket"), BOOT))

    # Of what is before: the latest transition, the event that it follows from, and the latest event.
    place = F.struct(*ORDER, "segment")
    before = written.where("segment < since").groupBy(*BOOT).agg(F.max(place).alias("_last"))
    earlier = events.where("segment < since").join(before, BOOT, "left")
    event = F.struct(*ORDER, "segment", "fg_pid")
    kept = earlier.groupBy(*BOOT).agg(
        F.max(event).alias("_event"), F.max(F.when(place <= F.col("_last"), event)).alias("_cause"), F.first("_last").alias("_last")
    )
    kept = settle(kept)
    old_events = kept.select(*BOOT, F.explode(F.array_distinct(F.array("_event", "_cause"))).alias("_e")).where("_e is not null")
    old_events = old_events.select(*BOOT, "_e.*")
    old_places = old_events.select(*_PLACE).unionByName(kept.where("_last is not null").select(*BOOT, "_last.*"))
    found = fgbg_changes_of(
        places.unionByName(old_places.distinct()),
        events.where("segment >= since").select(*_PLACE, "fg_pid").unionByName(old_events),
        delay_seconds,
    )
    new = found.join(touched, BOOT).where("segment >= since").select("bucket", *_PLACE, *states, added)
    old = written.where("segment >= since").select("bucket", *_PLACE, *states, (-F.col("change")).alias("change"))
    return _net(new.unionByName(old))


def _net(changes: DataFrame) -> DataFrame:
    """Rows that are taken back go with those that they take back."""
    columns = ["bucket", *_PLACE, "old_state", "new_state"]
    return changes.groupBy(*columns).agg(F.sum("change").alias("change")).where("change <> 0")


def _write_boots_net(changes: DataFrame, path: str) -> None:
    _write_boots(_net(changes), path)


def read_transitions(spark: SparkSession, out_path: str) -> DataFrame:
    """The transitions that hold, from what :func:`fgbg_stream` has written."""
    held = _net(read_last(spark, out_path, _CHANGES))
    # Equal lines are transitions each.
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), "change")).alias("_")
    return held.select(*_PLACE, "old_state", "new_state", each).drop("_")
