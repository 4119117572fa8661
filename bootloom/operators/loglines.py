"""Log lines: text in, typed lines out."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.functions import formats as fmt
from bootloom.functions.text import field, fields, int_or_error, keep, log_time, micros, with_fields
from bootloom.operators.ordering import SEGMENT_TOKENS, with_order


def parse_loglines(
    raw: DataFrame,
    line: str = "value",
    device: Column | None = None,
    base0: bool = False,
    segment_tokens: int = SEGMENT_TOKENS,
) -> DataFrame:
    """Typed lines from text in either layout; see :func:`rejected_lines` for the rest.

    ``device`` names the device of lines that do not carry one (the plain logcat
    layout), usually taken from the path.  ``base0`` reads integers with a
    leading zero as octal and drops lines where that fails.  Other columns of
    ``raw``, such as file positions, are kept.

    Filters on ``line`` placed after this call reach below the parsing.
    """
    device = F.lit(None).cast("string") if device is None else device
    text = raw.withColumn("_device", device).withColumnRenamed(line, "line")
    kept = [c for c in text.columns if c not in ("line", "_device")]
    typed = _split(text, "line").select(
        *kept,
        "line",
        F.coalesce(F.nullif(field("_f", 1), F.lit("")), F.col("_device"), F.lit("")).alias("device_id"),
        field("_f", 2).alias("boot_id"),
        *[value.alias(name) for name, value in _values(base0).items()],
        field("_f", 4).try_cast("double").alias("trace_time"),
        field("_f", 8).alias("level"),
        field("_f", 9).alias("tag"),
        field("_f", 10).alias("payload"),
    )
    whole = reduce(and_, [F.col(name).isNotNull() for name in _values(base0)])
    return with_order(keep(typed, whole), segment_tokens)


def rejected_lines(raw: DataFrame, line: str = "value", base0: bool = False) -> DataFrame:
    """The lines that :func:`parse_loglines` leaves out: no layout fits, or a value is out of range."""
    text = F.col(line)
    shaped = text.rlike(f"(?d:{fmt.DEVICE_LAYOUT})") | text.rlike(f"(?d:{fmt.LOGCAT_LAYOUT})")
    out_of_range = reduce(or_, [value.isNull() for value in _values(base0).values()])
    bad_values = _split(raw, line).where(out_of_range).select(*raw.columns)
    return raw.where(text.isNull() | ~shaped).unionByName(bad_values)


def _split(df: DataFrame, line: str) -> DataFrame:
    """Fields of either layout as ``_f``, the device layout being tried first.

    Order: device, boot, token, trace seconds, time, pid, tid, level, tag, payload.
    """
    layouts = (fmt.DEVICE_LAYOUT, list(range(1, 11))), (fmt.LOGCAT_LAYOUT, [0, 1, 3, 4, 2, 5, 6, 7, 8, 9])
    return with_fields(df, "_f", fields(F.col(line), *layouts))


def _values(base0: bool) -> dict[str, Column]:
    """The typed columns without which a line is rejected."""
    return {
        "datetime": log_time(field("_f", 5)),
        "datetime_nanos": int_or_error(F.substring(field("_f", 5), 21, 1 << 20), 64, base0),
        "logcat_token": int_or_error(field("_f", 3), 64, base0),
        "trace_us": micros(field("_f", 4).try_cast("double")),
        "pid": int_or_error(field("_f", 6), 32, base0),
        "tid": int_or_error(field("_f", 7), 32, base0),
    }


def line_filter(lines: DataFrame, *predicates: Column) -> DataFrame:
    """Keep lines that satisfy every predicate."""
    for predicate in predicates:
        lines = lines.where(predicate)
    return lines
