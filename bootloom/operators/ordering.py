"""Order of lines inside a boot, and ordered scans that never need a boot in one task.

A boot is read in the order of :data:`ORDER`.  It is cut into *segments*, ranges
of that order, and every ordered operator works in two levels: a window inside
each segment, and a window over one summary row per segment that says what the
earlier segments carry in.  The big exchange is on (boot, segment), so one boot
may hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOOT = ["device_id", "boot_id"]
ORDER = ["logcat_token", "trace_us", "line_id"]
SEGMENT_TOKENS = 1 << 20


def with_order(df: DataFrame, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Add ``line_id`` (tie-break of equal tokens and times) and ``segment`` (range of tokens).

    Where the file position of a line is known it is part of the tie-break, so
    that copies of a line have an order too.
    """
    position = [c for c in ("file_name", "block_start", "line_no") if c in df.columns]
    return df.withColumns(
        {
            "line_id": F.xxhash64("line", *position),
            "segment": F.expr(f"logcat_token div {int(segment_tokens)}"),
        }
    )


def split_hot_segments(
    lines: DataFrame, limit: int = 4 * SEGMENT_TOKENS, broadcast_limit: int = 10_000, into: str = "segment"
) -> DataFrame:
    """Cut segments of more than ``limit`` rows along the order, into parts of at most about twice that.

    Needed where many lines share a token.  A hot segment is counted by token, a
    hot token by time, and equal times by ranges of the tie-break, until a piece
    has ``limit`` rows or its rows are equal; then consecutive pieces are put
    together up to ``limit`` rows, so a segment of n rows has no more than
    n / limit + 1 parts.  Runs one counting job per level, on the key columns
    only, and stops at the first level that finds no hot piece.

    The numbers depend on all rows given, so they serve the plan that made them
    and are not for storing: stored segments are ranges of the token alone, which
    mean the same in every run.  ``into`` names the column that gets the numbers.
    """
    levels = [
        F.col("logcat_token"),
        F.col("trace_us"),
        F.shiftright("line_id", 56).cast("bigint"),
        F.shiftright("line_id", 40).cast("bigint"),
        F.col("line_id"),
    ]
    part = ["segment", *BOOT, "_cut"]
    cut = lines.withColumn("_cut", F.expr("cast(array() as array<bigint>)"))
    was_cut = False
    for level in levels:
        hot = cut.groupBy(*part).count().where(F.col("count") > limit).select(*part, F.lit(True).alias("_hot"))
        marked = _join_few(cut, hot, part, broadcast_limit)
        if marked is None:
            break
        was_cut = True
        finer = F.when(F.col("_hot"), F.concat("_cut", F.array(level))).otherwise(F.col("_cut"))
        cut = marked.withColumn("_cut", finer).select(*lines.columns, "_cut")
    if not was_cut:
        return lines if into == "segment" else lines.withColumn(into, F.col("segment"))
    # Number the parts of each cut segment in order, in a range of their own.
    earlier = Window.partitionBy("segment", *BOOT).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut.where(F.size("_cut") > 0).groupBy(*part).count()
    before = F.coalesce(F.sum("count").over(earlier), F.lit(0))
    pieces = pieces.select(*part, F.floor(before / limit).alias("_nth"))
    room = pieces.agg(F.max("_nth")).first()[0] + 1
    numbered = _join_few(cut, pieces, part, broadcast_limit)
    number = F.col("segment") * room + F.coalesce("_nth", F.lit(0))
    return numbered.withColumn(into, number).select(*dict.fromkeys([*lines.columns, into]))


def _join_few(lines: DataFrame, few: DataFrame, keys: list[str], broadcast_limit: int) -> DataFrame | None:
    """Left join with a table that is usually small, broadcast only if it is; None if it is empty."""
    found = few.limit(broadcast_limit + 1).count()
    if not found:
        return None
    return lines.join(F.broadcast(few) if found <= broadcast_limit else few, keys, "left")


def _placed(order: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def carry(
    df: DataFrame,
    *,
    at: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    keys: list[str] = BOOT,
    order: list[str] = ORDER,
    backward: bool = False,
) -> DataFrame:
    """Add the last non-null value of each expression along the order.

    ``at`` counts the row itself, ``before`` only earlier rows.  With
    ``backward`` the order is read from its end, so it is the *next* value.
    Rows without a key or segment have no place in the order and are left out;
    parsed and stored lines always have both (an unknown device is ``''``).
    """
    at, before = at or {}, before or {}
    # The filter is the one that the join below implies for its other side: stated
    # here, both sides scan alike and may share an exchange.
    tagged = _with_block(df, keys).select("*", *[e.alias(f"_new_{n}") for n, e in (at | before).items()])
    local = _inside(tagged, df.columns, list(at), list(before), keys, order, backward)
    tails = _tails(tagged, [*at, *before], keys, order, backward)
    return _with_entry(local, _entry(tails, tails, [*at, *before], keys, backward), df.columns, [*at, *before], keys)


def as_of(
    lines: DataFrame,
    events: DataFrame,
    values: dict[str, Column],
    *,
    keys: list[str] = BOOT,
    order: list[str] = ORDER,
) -> DataFrame:
    """Add to each line the last non-null value among the events at or before it.

    For events that are few among the lines: they go in as rows before the lines
    at their place, and the summaries of the segments are made from them alone.
    """
    block = ["segment", *keys]
    names = list(values)
    marks = _with_block(events, keys).select(
        *block, *order, F.lit(0).alias("_step"), *[e.alias(f"_new_{n}") for n, e in values.items()]
    )
    rows = _with_block(lines, keys).withColumn("_step", F.lit(1))
    steps = [*order, "_step"]
    local = _inside(rows.unionByName(marks, allowMissingColumns=True), [*lines.columns, "_step"], names, [], keys, steps)
    segments = rows.select(*block).distinct()
    entry = _entry(_tails(marks, names, keys, order), segments, names, keys)
    return _with_entry(local.where("_step = 1"), entry, lines.columns, names, keys)


def _with_block(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=[*keys, "segment"])


def _inside(
    tagged: DataFrame,
    columns: list[str],
    at: list[str],
    before: list[str],
    keys: list[str],
    order: list[str],
    backward: bool = False,
) -> DataFrame:
    """``_own_`` columns: the values as far as the row's own segment knows them."""
    start = Window.unboundedPreceding
    inside = Window.partitionBy("segment", *keys).orderBy(*_placed(order, backward))
    frames = {n: inside.rowsBetween(start, Window.currentRow) for n in at}
    frames |= {n: inside.rowsBetween(start, -1) for n in before}
    return tagged.select(*columns, *[F.last(f"_new_{n}", True).over(w).alias(f"_own_{n}") for n, w in frames.items()])


def _tails(tagged: DataFrame, names: list[str], keys: list[str], order: list[str], backward: bool = False) -> DataFrame:
    """The last value of each segment."""
    end_of = F.min_by if backward else F.max_by
    return tagged.groupBy("segment", *keys).agg(
        *[
            end_of(f"_new_{n}", F.when(F.col(f"_new_{n}").isNotNull(), F.struct(*order))).alias(f"_new_{n}")
            for n in names
        ]
    )


def _entry(
    tails: DataFrame, segments: DataFrame, names: list[str], keys: list[str], backward: bool = False
) -> DataFrame:
    """``_in_`` columns: for each segment the last value of those before it."""
    block = ["segment", *keys]
    by_segment = _placed(["segment"], backward)
    start = Window.unboundedPreceding
    if segments is tails:
        earlier = Window.partitionBy(*keys).orderBy(*by_segment).rowsBetween(start, -1)
        asked, found = tails, F.lit(True)
    else:
        # Each segment asks from before its own tail.
        ask = segments.select(*block, F.lit(0).alias("_tail"))
        asked = ask.unionByName(tails.withColumn("_tail", F.lit(1)), allowMissingColumns=True)
        earlier = Window.partitionBy(*keys).orderBy(*by_segment, "_tail").rowsBetween(start, -1)
        found = F.col("_tail") == 0
    known = [F.last(f"_new_{n}", True).over(earlier).alias(f"_in_{n}") for n in names]
    return asked.select("*", *known).where(found).select(*block, *[f"_in_{n}" for n in names])


def _with_entry(
    local: DataFrame, entry: DataFrame, columns: list[str], names: list[str], keys: list[str]
) -> DataFrame:
    # One small row per segment on the build side: a hash join keeps the window's sort.
    joined = local.join(entry.hint("shuffle_hash"), ["segment", *keys], "left")
    return joined.select(*columns, *[F.coalesce(f"_own_{n}", f"_in_{n}").alias(n) for n in names])


def running_sum(
    df: DataFrame,
    *,
    at: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    keys: list[str] = BOOT,
    order: list[str] = ORDER,
) -> DataFrame:
    """Add running sums along the order; ``at`` counts the row itself, ``before`` only earlier rows."""
    at, before = at or {}, before or {}
    block = ["segment", *keys]
    start = Window.unboundedPreceding
    inside = Window.partitionBy(*block).orderBy(*order)
    frames = {n: inside.rowsBetween(start, Window.currentRow) for n in at}
    frames |= {n: inside.rowsBetween(start, -1) for n in before}
    tagged = df.select("*", *[e.cast("bigint").alias(f"_new_{n}") for n, e in (at | before).items()])

    local = tagged.select(
        *df.columns, *[F.sum(f"_new_{n}").over(w).alias(f"_own_{n}") for n, w in frames.items()]
    )
    sums = tagged.groupBy(*block).agg(*[F.sum(f"_new_{n}").alias(f"_new_{n}") for n in frames])
    earlier = Window.partitionBy(*keys).orderBy("segment").rowsBetween(start, -1)
    entry = sums.select(*block, *[F.sum(f"_new_{n}").over(earlier).alias(f"_in_{n}") for n in frames])
    zero = F.lit(0).cast("bigint")
    return local.join(entry.hint("shuffle_hash"), block, "left").select(
        *df.columns,
        *[(F.coalesce(f"_own_{n}", zero) + F.coalesce(f"_in_{n}", zero)).alias(n) for n in frames],
    )


def with_seq(lines: DataFrame) -> DataFrame:
    """Number the lines of each boot from 1 in order (``seq``)."""
    return running_sum(lines, at={"seq": F.lit(1)})
