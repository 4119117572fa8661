"""From raw uploads to a sorted store, and from the store to discharge chunks."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bootloom.operators.chunks import chunk_cpu_state, chunk_fgbg_state, chunk_lines, discharge_chunks
from bootloom.operators.lineage import settle, settled_within
from bootloom.operators.loglines import parse_loglines
from bootloom.operators.ordering import SEGMENT_TOKENS, split_hot_segments
from bootloom.plans.sizing import GZIP_RATIO, partitions_over
from bootloom.sources.logs import (
    RAW_PATTERN,
    boot_ids,
    done_devices,
    list_files,
    new_files,
    read_raw_logs,
    stitched_files,
)
from bootloom.sources.writers import write_chunks, write_manifest, write_stitched

# A gzip file above this many bytes is spread over many tasks after reading.
LARGE_FILE = 512 << 20


def stitch(
    spark: SparkSession,
    raw_path: str,
    store_path: str,
    manifest_path: str,
    patterns: str = RAW_PATTERN,
    processed: DataFrame | None = None,
    files_per_run: int = 10_000,
    segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Add the raw files that have not been stitched to the store, and to the manifest.

    The files that are in the manifest, and those in ``processed`` if given, are
    left out.  Files are taken in runs of ``files_per_run``, so the list held by
    the driver stays small.  Each run is parsed once, into a table in the shared
    folder, from which it is sorted.  A run has a folder of its own in the store,
    named by its files, and its own part of the manifest, which is written last:
    a run that failed half-way is written anew, over what it left.

    Stored segments are ranges of tokens, the same in every run.
    """
    _drop_unfinished(spark, store_path, manifest_path)
    files = list_files(spark, raw_path, patterns)
    known = [stitched_files(spark, manifest_path), *([processed.select("file_name")] if processed is not None else [])]
    todo = new_files(files, reduce(DataFrame.union, known)).orderBy("file_name")
    for run in batched(todo.select("file_name", "device_id", "length").toLocalIterator(), files_per_run):
        raw = read_raw_logs(spark, [f.file_name for f in run], patterns)
        partitions = partitions_over(GZIP_RATIO * sum(f.length for f in run), spark.sparkContext.defaultParallelism)
        if max(f.length for f in run) > LARGE_FILE:
            # One task must unzip it, but others can share its parsing.
            raw = raw.repartition(partitions, "file_name", "block_start", "line_no")
        with settled_within(spark):
            lines = settle(parse_loglines(raw, "value", F.col("file_device"), segment_tokens=segment_tokens))
            spread = split_hot_segments(lines, 4 * segment_tokens, into="_spread")
            name = hashlib.sha256("\n".join(f.file_name for f in run).encode()).hexdigest()[:16]
            write_stitched(spread, f"{store_path}/run={name}", mode="overwrite", partitions=partitions)
            taken = spark.createDataFrame([(f.file_name, f.device_id) for f in run], "file_name string, device_id string")
            write_manifest(boot_ids(lines), taken, f"{manifest_path}/run={name}")


def _drop_unfinished(spark: SparkSession, store_path: str, manifest_path: str) -> None:
    """Remove the runs of a store that are not in its manifest: they failed before they were whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store, conf = path(store_path), spark.sparkContext._jsc.hadoopConfiguration()
    system = store.getFileSystem(conf)
    for found in system.globStatus(path(store, "run=*")) or []:
        name = found.getPath().getName()
        part = path(path(manifest_path, name), "_SUCCESS")
        if not part.getFileSystem(conf).exists(part):
            system.delete(found.getPath(), True)


def _without(lines: DataFrame, devices: DataFrame, broadcast_limit: int = 100_000) -> DataFrame:
    """The lines of other devices; up to ``broadcast_limit`` devices go to the lines, which stay where they are.

    A join by device would bring all lines of a device to one task, with every
    scan, even where there is no device to leave out.
    """
    found = devices.limit(broadcast_limit + 1).count()
    if not found:
        return lines
    return lines.join(F.broadcast(devices) if found <= broadcast_limit else devices, "device_id", "left_anti")


def chunk_devices(lines: DataFrame, path: str, reload: bool = False) -> None:
    """Cut the boots of ``lines`` into discharge chunks and write them with their start states and counts.

    Devices that are in the chunk store at ``path`` are left as they are; with
    ``reload`` all devices of ``lines`` are done anew, and what the store has of
    them is replaced, also by nothing.  The store changes at one moment, when all
    tables are there.
    """
    if not reload:
        lines = _without(lines, done_devices(lines.sparkSession, path))
    with settled_within(lines.sparkSession):
        chunks = settle(discharge_chunks(lines))
        members, boots = chunk_lines(lines, chunks), settle(boot_ids(lines))
        if boots.isEmpty():
            return
        write_chunks(chunks, members, path, chunk_cpu_state(lines, chunks), chunk_fgbg_state(lines, chunks), boots)
