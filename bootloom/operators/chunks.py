"""Discharge chunks: the lines between two consecutive one-percent drops of the battery level.

A boot's battery reports drive a small state machine:

* *waiting* with a level ``x``: a report on charge (or the first report of the
  boot) sets ``x``; the first report off charge below ``x`` opens a chunk;
* *open* at level ``x``: the next report at ``x - 1`` closes the chunk and opens
  another one there; a report at ``x`` belongs to the chunk, any other is
  ignored; a report on charge drops the open chunk.

The machine is sequential, but what a whole segment does to its state is small:
for each level it may be entered with, the level it leaves with.  So each
stretch of reports is reduced to that table, the tables are composed as a tree,
and every stretch then runs on its own from the state it is entered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bootloom.functions import formats as fmt
from bootloom.functions.text import fields
from bootloom.operators.events import battery_reports, cpu_events
from bootloom.operators.folds import WIDTH, entered
from bootloom.operators.lineage import settle
from bootloom.operators.ordering import BOOT, ORDER, as_of, carry, split_hot_segments
from bootloom.operators.predicates import is_healthd_text
from bootloom.operators.state import UNKNOWN, fgbg_changes

CHUNK = [*BOOT, "start_token", "end_token"]
REPORT = ["timestamp", "l", "v", "t", "h", "st", "c", "chg"]
_BLOCK = ["segment", *BOOT]

#: Battery reports that are folded in one array.
REPORTS = 512

# A report as it is kept in the arrays: its place first, so that arrays sort in order.
_PLACE = [*ORDER, "segment"]

# What the reports of a segment after its last report on charge do, read from the end:
# exits: level entered with -> level left with, where they differ;
# lows: the reports that could end waiting (each lower than all before it), and the level left with.
_EFFECT = """
aggregate(
  reverse(reports),
  cast(named_struct('exits', map(), 'lows', array(), 'charged', false, 'level', 0) as
    struct<exits: map<int,int>, lows: array<struct<l: int, leave: int>>, charged: boolean, level: int>),
  (e, r) -> case
    when e.charged then e
    when r.chg <> '' then named_struct('exits', e.exits, 'lows', e.lows, 'charged', true, 'level', r.l)
    else named_struct(
      'exits', map_concat(map_filter(e.exits, (k, x) -> k <> r.l + 1),
                          map(r.l + 1, coalesce(try_element_at(e.exits, r.l), r.l))),
      'lows', concat(array(named_struct('l', r.l, 'leave', coalesce(try_element_at(e.exits, r.l), r.l))),
                     filter(e.lows, y -> y.l < r.l)),
      'charged', false, 'level', 0)
  end,
  e -> named_struct('exits', map_entries(e.exits), 'lows', e.lows, 'charged', e.charged, 'level', e.level))
"""

# Two effects one after the other. A state that the first leaves open goes on as the second has it; the second may end
# waiting with what is lower than all that the first could have ended it with.
_COMPOSED = """
if({g}.charged, {g}, named_struct(
  'exits', concat(
    transform({f}.exits, x -> named_struct('key', x.key,
      'value', coalesce(get(filter({g}.exits, y -> y.key = x.value), 0).value, x.value))),
    filter({g}.exits, y -> not exists({f}.exits, x -> x.key = y.key))),
  'lows', concat(
    transform({f}.lows, x -> named_struct('l', x.l,
      'leave', coalesce(get(filter({g}.exits, y -> y.key = x.leave), 0).value, x.leave))),
    filter({g}.lows, y -> size({f}.lows) = 0 or y.l < element_at({f}.lows, -1).l)),
  'charged', {f}.charged,
  'level', {f}.level))
"""

# The state that an effect leaves: a report on charge has set its level, and then comes what is after it.
_LEFT = """
transform(array(if({f}.charged, named_struct('waiting', true, 'x', {f}.level), {s})), s -> named_struct(
  'waiting', s.waiting and not exists({f}.lows, y -> y.l < s.x),
  'x', coalesce(
    if(s.waiting,
       get(filter({f}.lows, y -> y.l < s.x), 0).leave,
       get(filter({f}.exits, y -> y.key = s.x), 0).value),
    s.x)))[0]
"""

# The chunk boundaries of a segment, from the state it is entered with.
_RUN = """
aggregate(
  reports,
  named_struct('waiting', waiting, 'x', x, 'bounds', slice(transform(reports, r -> struct(r as at, false as closes)), 1, 0)),
  (s, r) -> case
    when r.chg <> '' then named_struct('waiting', true, 'x', r.l, 'bounds', s.bounds)
    when s.waiting and r.l < s.x then
      named_struct('waiting', false, 'x', r.l, 'bounds', concat(s.bounds, array(struct(r as at, false as closes))))
    when not s.waiting and r.l = s.x - 1 then
      named_struct('waiting', false, 'x', r.l, 'bounds', concat(s.bounds, array(struct(r as at, true as closes))))
    else s end,
  s -> s.bounds)
"""


def chunk_boundaries(lines: DataFrame, limit: int = REPORTS, width: int = WIDTH) -> DataFrame:
    """Reports that open a chunk: ``at`` (the report) and ``closes`` (it ends the chunk before it as well).

    Reports are folded in arrays of at most about twice ``limit``: a segment with
    more, whatever made it so, is cut along the order first.  What these blocks do
    is folded as a tree, so neither many reports nor many segments meet in one array.
    """
    reports = settle(battery_reports(lines).select(*BOOT, *_PLACE, *REPORT))
    cut = split_hot_segments(reports, limit, into="_fold")
    blocks = cut.groupBy(F.col("_fold").alias("segment"), *BOOT).agg(
        F.array_sort(F.collect_list(F.struct(*_PLACE, *REPORT))).alias("reports")
    )
    in_order = Window.partitionBy(*BOOT).orderBy("segment")
    blocks = settle(blocks.withColumn("nth", (F.row_number().over(in_order) - 1).cast("bigint")))
    effects = settle(blocks.select(*BOOT, "nth", F.expr(_EFFECT).alias("effect")))
    # A boot is entered waiting, with the level of its first report.
    begun = F.struct(F.lit(True).alias("waiting"), F.col("reports")[0]["l"].alias("x"))
    states = entered(
        effects,
        blocks.where("nth = 0").select(*BOOT, begun.alias("enter")),
        compose=lambda f, g: _COMPOSED.format(f=f, g=g),
        apply=lambda state, f: _LEFT.format(s=state, f=f),
        width=width,
    )
    runs = blocks.join(states, [*BOOT, "nth"]).select(*_BLOCK, "reports", "enter.waiting", "enter.x")
    return runs.select(*_BLOCK, F.inline(F.expr(_RUN)))


def discharge_chunks(lines: DataFrame, limit: int = REPORTS) -> DataFrame:
    """One row per closed chunk: ``start`` and ``end`` reports, and their tokens."""
    bounds = settle(chunk_boundaries(lines, limit).select(*BOOT, "at", "closes", "at.*"))
    paired = carry(bounds.select(*BOOT, *_PLACE, "at", "closes"), before={"start": F.col("at")})
    return paired.where("closes").select(
        *BOOT,
        F.col("start.logcat_token").alias("start_token"),
        F.col("at.logcat_token").alias("end_token"),
        "start",
        F.col("at").alias("end"),
    )


def _place_of(report: str) -> Column:
    return F.struct(*[F.col(f"{report}.{c}") for c in ORDER])


def _reach(chunks: DataFrame) -> DataFrame:
    """For each segment that a chunk reaches into, the chunks that do: where they begin and end, and their level."""
    chunk = F.struct(
        _place_of("start").alias("start"), _place_of("end").alias("end"), "start_token", "end_token", F.col("start.l").alias("level")
    )
    segments = F.explode(F.sequence(F.col("start.segment"), F.col("end.segment"))).alias("segment")
    return chunks.select(*BOOT, segments, chunk.alias("_chunk")).groupBy(*_BLOCK).agg(
        F.array_sort(F.collect_list("_chunk")).alias("_chunks")
    )


def chunk_lines(lines: DataFrame, chunks: DataFrame, broadcast_limit: int = 100_000) -> DataFrame:
    """The lines of each chunk, between its reports, with ``start_token`` and ``end_token``.

    Chunks of a boot do not overlap, so it takes no ordered scan: each segment
    gets the chunks that reach into it, and a line looks for the one it is in.
    Up to ``broadcast_limit`` chunks go to the lines, which then stay where they
    are; with more, only lines of segments that a chunk reaches into are moved.
    """
    reach = settle(_reach(chunks))
    few = reach.agg(F.sum(F.size("_chunks"))).first()[0] or 0
    # The keys alone tell most lines outside chunks; the few words per chunk come in after that.
    if few <= broadcast_limit:
        near = lines.join(F.broadcast(reach), _BLOCK)
    else:
        near = lines.join(reach.select(*_BLOCK), _BLOCK, "left_semi").join(reach, _BLOCK)
    place = F.struct(*ORDER)
    # No two chunks hold a place, so no line is repeated; generated code compares faster than a function over the array.
    tried = near.select(*lines.columns, F.explode("_chunks").alias("_chunk"))
    found = tried.where((F.col("_chunk.start") < place) & (place < F.col("_chunk.end")))
    # A report belongs to the chunk if it is off charge and at its level; one run of its pattern tells both.
    report = F.get(fields(F.col("payload"), (fmt.HEALTHD_TEXT, [2, 8])), F.lit(0))
    told = F.filter(F.array(F.when(is_healthd_text(), report)), lambda r: F.get(r, F.lit(1)) == "")
    level = F.get(F.transform(told, lambda r: F.get(r, F.lit(0)).try_cast("int")), F.lit(0))
    return found.where(~is_healthd_text() | (level == F.col("_chunk.level"))).select(
        *lines.columns, F.col("_chunk.start_token").alias("start_token"), F.col("_chunk.end_token").alias("end_token")
    )


def chunk_cpu_state(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """State and frequency of each CPU seen so far at the start of each chunk, one row per CPU."""
    events = settle(cpu_events(lines).select(*BOOT, *_PLACE, "cpu", "freq", "word", "error"))
    starts = chunks.select(*CHUNK, *[F.col(f"start.{c}") for c in _PLACE])
    probes = starts.join(events.select(*BOOT, "cpu").distinct(), BOOT)
    both = events.withColumn("_after", F.lit(0)).unionByName(
        probes.withColumn("_after", F.lit(1)), allowMissingColumns=True
    )
    clean = F.col("error") == 0
    state = (
        F.when(F.col("freq").isNotNull() | (clean & (F.col("word") == "online")), "ONLINE")
        .when(clean & (F.col("word") == "offline"), "OFFLINE")
    )
    event = F.when(F.col("_after") == 0, True)
    tracked = carry(
        both,
        at={"cpu_state": state, "cpu_freq": F.col("freq"), "_seen": event},
        keys=[*BOOT, "cpu"],
        order=[*ORDER, "_after"],
    )
    return tracked.where("_after = 1 and _seen").select(
        *CHUNK,
        "cpu",
        F.coalesce("cpu_state", F.lit(UNKNOWN)).alias("cpu_state"),
        F.coalesce("cpu_freq", F.lit(0)).alias("cpu_freq"),
    )


def chunk_fgbg_state(lines: DataFrame, chunks: DataFrame, delay_seconds: float = 1.0) -> DataFrame:
    """The foreground state at the start of each chunk, from the places where the state is set."""
    starts = chunks.select(*CHUNK, *[F.col(f"start.{c}") for c in _PLACE])
    set_at = settle(fgbg_changes(lines, delay_seconds).select(*BOOT, *_PLACE, "new_state"))
    known = as_of(starts, set_at, {"fgbg_state": F.col("new_state")})
    return known.select(*CHUNK, F.coalesce("fgbg_state", F.lit(UNKNOWN)).alias("fgbg_state"))


def chunk_filter(chunks: DataFrame, *predicates: Column) -> DataFrame:
    """Keep chunks that satisfy every predicate over their columns."""
    for predicate in predicates:
        chunks = chunks.where(predicate)
    return chunks


def no_suspend_chunks(chunks: DataFrame, members: DataFrame, word: str = fmt.SUSPEND_DONE_WORD) -> DataFrame:
    """Drop chunks with a line that reports a completed suspend; ``members`` are their lines."""
    suspended = members.where(F.col("line").contains(word)).select(*CHUNK).distinct()
    return chunks.join(suspended, CHUNK, "left_anti")


def gapless_chunks(chunks: DataFrame, members: DataFrame) -> DataFrame:
    """Keep chunks whose lines carry every token between the two reports, each once."""
    # One row per token first: that count is spread over all tokens of a chunk.
    tokens = members.groupBy(*CHUNK, "logcat_token").count()
    spread = tokens.groupBy(*CHUNK).agg(
        F.count("*").alias("_tokens"),
        F.max("count").alias("_copies"),
        F.min("logcat_token").alias("_low"),
        F.max("logcat_token").alias("_high"),
    )
    joined = chunks.join(spread, CHUNK, "left")
    between = F.col("end_token") - F.col("start_token") - 1
    whole = (
        (F.col("_copies") == 1)
        & (F.col("_tokens") == between)
        & (F.col("_low") == F.col("start_token") + 1)
        & (F.col("_high") == F.col("end_token") - 1)
    )
    return joined.where(F.coalesce(whole, between == 0)).select(*chunks.columns)


def chunk_counts(chunks: DataFrame, kept: DataFrame | None = None, keys: list[str] = BOOT) -> DataFrame:
    """``chunks`` per boot, or per other keys, and ``kept`` after a filter."""
    kept = chunks if kept is None else kept
    flags = chunks.select(*keys, F.lit(0).alias("_kept")).unionByName(kept.select(*keys, F.lit(1).alias("_kept")))
    return flags.groupBy(*keys).agg(F.sum(1 - F.col("_kept")).alias("chunks"), F.sum("_kept").alias("kept"))
