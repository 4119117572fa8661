"""Boundaries of periods of any length, each counted from the line that began it."""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bootloom.functions.text import epoch_micros
from bootloom.operators.lineage import settle
from bootloom.operators.ordering import BOOT, ORDER, carry, running_sum

_KEY = [*BOOT, "nth"]
#: Lines are looked up by stretches of so many microseconds: a minute, of which a phone writes a bounded number of lines.
BUCKET_US = 60_000_000


def _records(lines: DataFrame) -> DataFrame:
    """The places of lines that are later than all lines before them, numbered along each boot, with their time ``us``."""
    places = lines.select(*BOOT, "segment", *ORDER, epoch_micros(F.col("datetime")).alias("us")).where("us is not null")
    inside = Window.partitionBy("segment", *BOOT).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    local = places.withColumn("_most", F.max("us").over(inside)).where("_most is null or us > _most").drop("_most")
    local = settle(local)
    # The latest time of the segments before.
    most = local.groupBy("segment", *BOOT).agg(F.max("us").alias("_top"))
    earlier = Window.partitionBy(*BOOT).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    entry = most.withColumn("_most", F.max("_top").over(earlier)).drop("_top")
    later = local.join(entry.hint("shuffle_hash"), ["segment", *BOOT]).where("_most is null or us > _most").drop("_most")
    return settle(running_sum(settle(later), before={"nth": F.lit(1)}))


def _next(records: DataFrame, period: int) -> DataFrame:
    """(boot, ``nth``, ``after``) of each record: the first record at least a period later, if there is one.

    Records are sorted by time, so it is found among those of the time bucket that
    the sum falls into, or it is the first of the next bucket that has any.
    """
    bucket = F.expr(f"us div {BUCKET_US}")
    targets = records.select(*BOOT, bucket.alias("bucket"), "us", F.lit(0).alias("asks"), F.col("nth").alias("target"))
    due = F.col("us") + period
    asked = records.select(
        *BOOT, F.expr(f"(us + {period}) div {BUCKET_US}").alias("bucket"), due.alias("us"), F.lit(1).alias("asks"), "nth"
    )
    both = targets.unionByName(asked, allowMissingColumns=True)
    # From a question's place backwards in time order: the nearest target at or after it.  Targets come last at one time,
    # so that a question at that time finds them.
    onward = Window.partitionBy(*BOOT, "bucket").orderBy(F.col("us"), F.col("asks").desc())
    found = both.withColumn("after", F.first("target", True).over(onward.rowsBetween(0, Window.unboundedFollowing)))
    firsts = records.groupBy(*BOOT, bucket.alias("bucket")).agg(F.min("nth").alias("first"))
    asked_buckets = asked.select(*BOOT, "bucket").distinct().join(firsts, [*BOOT, "bucket"], "full")
    following = Window.partitionBy(*BOOT).orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    nexts = asked_buckets.withColumn("_beyond", F.first("first", True).over(following)).select(*BOOT, "bucket", "_beyond")
    answered = found.where("asks = 1").join(nexts, [*BOOT, "bucket"])
    return answered.select(*_KEY, F.coalesce("after", "_beyond").alias("after")).where("after is not null")


def period_boundaries(lines: DataFrame, period: timedelta) -> DataFrame:
    """Lines that end a period and begin the next: ``old_start`` and ``new_start`` are their times in microseconds.

    The first line of a boot begins a period.  The first later line, in the
    order of the boot, that is at least ``period`` after the period's beginning
    ends it, and begins another one; so periods begin where there are lines, and
    not at fixed times.  Lines without a time are passed over.  Times may go
    back: a boundary is later than all lines before it, as each one in between
    is less than a period after the beginning.

    So only such lines are looked at.  Each one's successor is known at once from
    the lines of the minute that its time and the period fall into.  Those that
    follow from the first line are found by doubling: successors of successors,
    in log rounds of the number of periods that fit into a boot.
    """
    width = period // timedelta(microseconds=1)
    if width <= 0:
        raise ValueError("a period is longer than nothing")
    records = _records(lines)
    jump = settle(_next(records, width))
    reached = records.where("nth = 0").select(*_KEY)
    spans = records.groupBy(*BOOT).agg((F.max("us") - F.min("us")).alias("span"))
    longest = (spans.agg(F.max("span")).first()[0] or 0) // width
    for _ in range(math.ceil(math.log2(longest + 1)) if longest else 0):
        reached = settle(reached.unionByName(reached.join(jump, _KEY).select(*BOOT, F.col("after").alias("nth"))))
        onward = jump.select(*BOOT, F.col("nth").alias("after"), F.col("after").alias("_beyond"))
        jump = settle(jump.join(onward, [*BOOT, "after"]).select(*_KEY, F.col("_beyond").alias("after")))
    begun = records.join(reached, _KEY, "left_semi").withColumnRenamed("us", "new_start").drop("nth")
    bounds = settle(carry(begun, before={"old_start": F.col("new_start")}).where("old_start is not null"))
    place = [*BOOT, "segment", *ORDER]
    # Equal lines have one place: the first of them is the boundary.
    return lines.join(bounds, place).dropDuplicates(place).select(*lines.columns, "old_start", "new_start")
