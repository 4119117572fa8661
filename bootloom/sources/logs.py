"""Reading logs, stores, manifests and chunk dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bootloom.functions.formats import DEVICE_DIR
from bootloom.sources.commits import last_version

RAW_PATTERN = "*.out.gz"

STORE_SCHEMA = (
    "line string, device_id string, boot_id string, datetime timestamp_ntz, datetime_nanos bigint,"
    " logcat_token bigint, trace_us bigint, pid int, tid int, trace_time double, level string,"
    " tag string, payload string, line_id bigint, segment bigint, payload_chars int,"
    " file_name string, block_start bigint, line_no bigint"
)

STORE_COLUMNS = [c.strip().split(" ")[0] for c in STORE_SCHEMA.split(",")]

_CHUNK = "device_id string, boot_id string, start_token bigint, end_token bigint"
_REPORT = (
    "struct<logcat_token: bigint, trace_us: bigint, line_id: bigint, segment: bigint, timestamp: double,"
    " l: int, v: int, t: double, h: int, st: int, c: int, chg: string>"
)


def name_glob(patterns: str) -> str:
    """Comma-separated name patterns as one."""
    names = [p.strip() for p in patterns.split(",") if p.strip()]
    return names[0] if len(names) == 1 else "{" + ",".join(names) + "}"


def without_return(line: Column) -> Column:
    """A line without the carriage return before its end."""
    return F.when(line.endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(line)


def device_of_path(path: Column) -> Column:
    """The device directory in a path; NULL without one."""
    return F.nullif(F.regexp_extract(path, DEVICE_DIR, 1), F.lit(""))


def read_raw_logs(spark: SparkSession, path: str | list[str], patterns: str = RAW_PATTERN) -> DataFrame:
    """Lines of all files below ``path`` whose names fit one of the comma-separated ``patterns``.

    Columns: ``value``, ``file_device`` (from the path) and the position of the
    line: ``file_name``, ``block_start`` and ``line_no``, which grow with the
    line's place in its file.  A gzip file is read by one task; everything after
    the parsing is spread over (boot, segment).
    """
    text = spark.read.text(path, lineSep="\n", pathGlobFilter=name_glob(patterns), recursiveFileLookup=True)
    in_task = (1 << 33) - 1
    return text.select(
        without_return(F.col("value")).alias("value"),
        device_of_path(F.col("_metadata.file_path")).alias("file_device"),
        F.col("_metadata.file_path").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(in_task)).alias("line_no"),
    )


def list_files(spark: SparkSession, path: str, patterns: str = RAW_PATTERN) -> DataFrame:
    """``file_name``, ``device_id`` and ``length`` of the files below ``path``; contents are not read."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", name_glob(patterns))
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return listed.select(F.col("path").alias("file_name"), device_of_path(F.col("path")).alias("device_id"), "length")


def list_devices(files: DataFrame) -> DataFrame:
    """The devices that own a directory: names of 40 hex digits."""
    return files.select("device_id").where("device_id is not null").distinct()


def filter_devices(df: DataFrame, wanted: str | list[str] | DataFrame | None) -> DataFrame:
    """Keep the rows of the wanted devices: a table, a list, or names between blanks; none means all."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select("device_id"), "device_id", "left_semi")
    names = wanted.split() if isinstance(wanted, str) else list(wanted or [])
    return df.where(F.col("device_id").isin(names)) if names else df


def device_intersection(devices: DataFrame, wanted: DataFrame) -> DataFrame:
    """Devices that are in both tables."""
    return devices.select("device_id").intersect(wanted.select("device_id"))


def packed(lines: DataFrame) -> DataFrame:
    """Parsed lines for storing: a payload that ends its line is kept as a length only."""
    return lines.withColumns(
        {
            "payload_chars": F.length("payload"),
            "payload": F.when(~F.col("line").endswith(F.col("payload")), F.col("payload")),
        }
    )


def unpacked(stored: DataFrame) -> DataFrame:
    """Parsed lines from what :func:`packed` stored.

    A directory cannot be named by an empty device, which lines of an unknown
    device have; it comes back from the directory that stands for none.
    """
    payload = F.coalesce("payload", F.expr("right(line, payload_chars)"))
    device = F.coalesce("device_id", F.lit(""))
    return stored.withColumns({"payload": payload, "device_id": device}).drop("payload_chars")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines written by :func:`bootloom.sources.writers.write_stitched`.

    The place of a line in its raw file is NULL where it was not known.  A store
    that was stitched in several runs is read as a whole.
    """
    return unpacked(spark.read.schema(STORE_SCHEMA).parquet(path).select(*STORE_COLUMNS))


def read_boot(store: DataFrame, device_id: str, boot_id: str, *predicates: Column) -> DataFrame:
    """The lines of one boot that satisfy every predicate; other boots' directories are not read."""
    lines = store.where((F.col("device_id") == device_id) & (F.col("boot_id") == boot_id))
    for predicate in predicates:
        lines = lines.where(predicate)
    return lines


def read_manifest(
    spark: SparkSession, path: str, patterns: str = "info.json", multi_line: bool = True
) -> DataFrame:
    """Manifests below ``path``: ``device_id``, ``bootids``, ``files`` and ``is_valid``.

    A file that is not a JSON object with a list of boot ids is not valid and
    has no boot ids.
    """
    strings = T.ArrayType(T.StringType())
    schema = T.StructType(
        [
            T.StructField("device_id", T.StringType()),
            T.StructField("bootids", strings),
            T.StructField("files", strings),
            T.StructField("_corrupt", T.StringType()),
        ]
    )
    read = spark.read.schema(schema).json(
        path,
        multiLine=multi_line,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord="_corrupt",
        pathGlobFilter=name_glob(patterns),
        recursiveFileLookup=True,
    )
    valid = F.col("bootids").isNotNull()
    return read.select(
        F.coalesce("device_id", device_of_path(F.col("_metadata.file_path"))).alias("device_id"),
        "bootids",
        "files",
        valid.alias("is_valid"),
    )


def device_boots(devices: DataFrame, manifest: DataFrame) -> DataFrame:
    """``device_id`` and ``boot_id`` of every device; a device without manifest has one row without boot."""
    boots = manifest.select("device_id", F.explode("bootids").alias("boot_id"))
    return devices.select("device_id").join(boots, "device_id", "left")


def skipped_devices(devices: DataFrame, manifest: DataFrame) -> DataFrame:
    """Devices that have no valid manifest."""
    return devices.select("device_id").join(manifest.where("bootids is not null"), "device_id", "left_anti")


def pending_devices(devices: DataFrame, done: DataFrame, reload: bool = False) -> DataFrame:
    """Devices that are not in ``done`` yet; all of them with ``reload``."""
    todo = devices.select("device_id")
    return todo if reload else todo.join(done.select("device_id"), "device_id", "left_anti")


#: Names of the files that say that a device's chunks have been counted, where there is one for each device.
META_PATTERN = "meta.json"


def done_devices(spark: SparkSession, path: str, patterns: str = META_PATTERN) -> DataFrame:
    """Devices whose chunks have been counted; none if there is no such folder.

    They are the devices of the chunk store at ``path``, and those that have a
    file of their own that says so somewhere below it.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "device_id string")
    found = list_files(spark, path, patterns).select("device_id").where("device_id is not null")
    return found.unionByName(live_devices(spark, path).select("device_id")).distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def stitched_files(spark: SparkSession, manifest_path: str) -> DataFrame:
    """``file_name`` of the files in the manifest of a store; none if there is no manifest yet."""
    if not _exists(spark, manifest_path):
        return spark.createDataFrame([], "file_name string")
    manifest = read_manifest(spark, manifest_path, "*.json", multi_line=False)
    return manifest.select(F.explode("files").alias("file_name")).distinct()


def new_files(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files that have not been processed."""
    return files.join(processed.select("file_name"), "file_name", "left_anti")


def merged_files(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files processed before or now, each once."""
    return files.select("file_name").union(processed.select("file_name")).distinct()


def merged_bootids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Boots known before or now, each once."""
    columns = ["device_id", "boot_id"]
    return old.select(*columns).union(new.select(*columns)).distinct()


def boot_ids(lines: DataFrame) -> DataFrame:
    """The boots that occur in lines."""
    return lines.select("device_id", "boot_id").distinct()


#: The tables of a chunk store, and how they are kept.
CHUNK_TABLES = {
    "chunks": (f"{_CHUNK}, start {_REPORT}, end {_REPORT}", "parquet"),
    "lines": (f"{STORE_SCHEMA}, start_token bigint, end_token bigint", "parquet"),
    "cpu_state": (f"{_CHUNK}, cpu int, cpu_state string, cpu_freq int", "parquet"),
    "fgbg_state": (f"{_CHUNK}, fgbg_state string", "parquet"),
    "meta": ("device_id string, boot_id string, chunks bigint", "json"),
}


def _generations(spark: SparkSession, path: str, table: str, schema: str, kind: str = "parquet") -> DataFrame | None:
    """One table of all generations, with ``_generation``; None if no generation has it."""
    columns = [f.name for f in T.StructType.fromDDL(schema).fields]
    rows = None
    for folder in last_version(spark, path).folders:
        place = f"{path}/{folder['name']}/{table}"
        if _exists(spark, place):
            # The schema is stated: device names may look like numbers.
            read = spark.read.schema(schema).format(kind).load(place)
            read = read.withColumn("device_id", F.coalesce("device_id", F.lit(""))).select(*columns)
            read = read.withColumn("_generation", F.lit(folder["generation"]).cast("bigint"))
            rows = read if rows is None else rows.unionByName(read)
    return rows


def live_devices(spark: SparkSession, path: str) -> DataFrame:
    """The devices of a chunk store, each with the generation that counts for it, the last one."""
    devices = _generations(spark, path, "devices", "device_id string")
    if devices is None:
        return spark.createDataFrame([], "device_id string, _generation bigint")
    return devices.groupBy("device_id").agg(F.max("_generation").alias("_generation"))


def read_generations(spark: SparkSession, path: str, table: str, schema: str, kind: str = "parquet") -> DataFrame | None:
    """The rows of a table that count: of each device those of its last generation; None if there is no such table."""
    rows = _generations(spark, path, table, schema, kind)
    if rows is None or len(last_version(spark, path).folders) == 1:
        return None if rows is None else rows.drop("_generation")
    return rows.join(live_devices(spark, path), ["device_id", "_generation"], "left_semi").drop("_generation").select(
        *[f.name for f in T.StructType.fromDDL(schema).fields]
    )


def _chunk_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    schema, kind = CHUNK_TABLES[table]
    rows = read_generations(spark, path, table, schema, kind)
    return spark.createDataFrame([], schema) if rows is None else rows


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunk headers and chunk lines written by :func:`bootloom.sources.writers.write_chunks`."""
    return _chunk_table(spark, path, "chunks"), unpacked(_chunk_table(spark, path, "lines"))


def read_chunk_states(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The state of each CPU, and of the foreground, at the start of each chunk."""
    return _chunk_table(spark, path, "cpu_state"), _chunk_table(spark, path, "fgbg_state")


def read_chunk_counts(spark: SparkSession, path: str) -> DataFrame:
    """How many chunks each boot of a chunk store has."""
    return _chunk_table(spark, path, "meta")


# Names of the fields in chunk dumps.
_LOGLINE_JSON = (
    "struct<Line: string, BootId: string, Datetime: string, DatetimeNanos: bigint, LogcatToken: bigint,"
    " TraceTime: double, Pid: int, Tid: int, Level: string, Tag: string, Payload: string>"
)
_HEALTHD_JSON = (
    f"struct<Logline: {_LOGLINE_JSON}, Timestamp: double, L: int, V: int, T: double, H: int, St: int,"
    " C: int, Chg: string>"
)
_CHUNK_JSON = (
    f"Start {_HEALTHD_JSON}, End {_HEALTHD_JSON}, StartFgBgState int, Data array<{_LOGLINE_JSON}>,"
    " StartCpuState map<string, struct<Cpu: int, CpuState: int, Frequency: int>>"
)


def read_chunk_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Chunk dumps with the device from the path.

    Files named ``*.json.gz`` have one JSON object per line, as
    :func:`bootloom.sources.writers.write_chunk_dumps` leaves them; any other
    ``*.gz`` is one indented JSON object.
    """

    def read(pattern: str, multi_line: bool) -> DataFrame:
        return spark.read.schema(_CHUNK_JSON).json(
            path, multiLine=multi_line, pathGlobFilter=pattern, recursiveFileLookup=True, primitivesAsString=False
        )

    def told(dumps: DataFrame) -> DataFrame:
        return dumps.select(
            device_of_path(F.col("_metadata.file_path")).alias("device_id"),
            F.col("Start.Logline.BootId").alias("boot_id"),
            F.col("Start.Logline.LogcatToken").alias("start_token"),
            F.col("End.Logline.LogcatToken").alias("end_token"),
            *[F.col(c) for c in ("Start", "End", "StartFgBgState", "StartCpuState", "Data")],
        )

    single = read("*.gz", True).where(~F.col("_metadata.file_name").endswith(".json.gz"))
    return told(read("*.json.gz", False)).unionByName(told(single))
