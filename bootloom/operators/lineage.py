"""Intermediate tables on storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A session without that setting gets a folder of its own if it runs inside one
    process (``local[...]``), where any folder is shared.  On a cluster a folder
    of one machine would lose rows without a word, so there it is an error.
    """
    named = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"set {SHARED_DIR} to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="bootloom-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir()


class Settled:
    """The settled tables of a scope."""

    def __init__(self) -> None:
        self.paths: set[str] = set()
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> None:
        """Leave the tables that ``df`` reads to the scope around this one, or to the caller."""
        self.kept |= {folder for folder in self.paths if any(folder.rsplit("/", 1)[1] in file for file in df.inputFiles())}


_scope: ContextVar[Settled | None] = ContextVar("settled", default=None)


@contextmanager
def settled_within(spark: SparkSession) -> Iterator[Settled]:
    """Remove the tables settled inside, at the end, but for those that are kept.

    ``with settled_within(spark): operator(df).write.parquet(path)`` leaves the
    result and nothing else.  A frame that has not been written must be used, or
    its tables kept, before the end.
    """
    outer, own = _scope.get(), Settled()
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)
        if outer is not None:
            outer.paths |= own.kept
        _delete(spark, own.paths - own.kept)


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to a table in the shared folder, and read from there.

    Ordered scans read their input twice, and stacked ones more often.  Settling
    the narrow table of events between them means that the text is parsed once
    and that a lost executor costs no more than one stage.  If the driver finds
    no file of what the executors wrote, that is an error, not an empty table.
    """
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    if (scope := _scope.get()) is not None:
        scope.paths.add(path)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    if not written.inputFiles():
        raise OSError(f"{path} has no files: is {SHARED_DIR} shared by driver and executors?")
    return written


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Have the files of each query's shuffles removed when the query ends.

    Else they stay until the driver happens to collect its garbage, and the
    shuffles of all tables that an operator settles add up on disk.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_settled(df: DataFrame) -> None:
    """Remove the files of settled tables that ``df`` was read from; call it when no more plan needs them."""
    _delete(df.sparkSession, {f for f in (file.rsplit("/", 1)[0] for file in df.inputFiles()) if "/settled-" in f})


def _delete(spark: SparkSession, folders: set[str]) -> None:
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
