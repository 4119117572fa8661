"""Column helpers that turn log text into typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def rewrite(text: Column, pattern: str, groups: list[int]) -> Column:
    """``text`` rewritten to the numbered groups of its first match, each after a separator.

    Group 0 stands for an empty field.  Text without a match, or rewritten
    before, is left as it is.  ``.`` stops at ``\\n`` only.
    """
    marks = "".join(SEPARATOR + (f"${n}" if n else "") for n in groups)
    return F.regexp_replace(text, rf"^(?!{SEPARATOR})(?s:.*?)(?d:{pattern})(?s:.*)\z", marks)


def fields(text: Column, *layouts: tuple[str, list[int]]) -> Column:
    """The numbered groups of the first layout (pattern, groups) that ``text`` matches: an array of one or no array.

    All groups come out of one run of a pattern, between separators.  A text that
    has a separator of its own could be taken for one that was rewritten, or have
    its fields shifted; such a text, which no writer of these logs makes, is read
    group by group instead.
    """
    rewritten = text
    for pattern, groups in layouts:
        rewritten = rewrite(rewritten, pattern, groups)
    count = len(layouts[0][1])
    parts = F.array(F.split(rewritten, SEPARATOR, count + 1))
    matched = F.filter(parts, lambda p: (F.size(p) == count + 1) & (F.get(p, F.lit(0)) == ""))
    one_run = F.transform(matched, lambda p: F.slice(p, 2, count))
    by_group = F.array().cast("array<array<string>>")
    for pattern, groups in reversed(layouts):
        own = F.array(*[F.regexp_extract(text, f"(?d:{pattern})", n) if n else F.lit("") for n in groups])
        by_group = F.when(text.rlike(f"(?d:{pattern})"), F.array(own)).otherwise(by_group)
    return F.when(text.contains(SEPARATOR), by_group).otherwise(one_run)


def with_fields(df: DataFrame, name: str, found: Column) -> DataFrame:
    """Keep the rows for which :func:`fields` found something, and add it as ARRAY<STRING> ``name``.

    The fields come out of an ``explode`` of no or one element, not of a filter
    on a column: a filter would be pushed below the projection and run the
    pattern a second time.
    """
    return df.select("*", F.explode(found).alias(name))


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that satisfy a condition over computed columns, each computed once.

    As in :func:`with_fields`: a filter here would be pushed below the
    projection and compute the columns again.
    """
    return df.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("_kept")).select(*df.columns)


def capture(df: DataFrame, name: str, text: Column, pattern: str, count: int) -> DataFrame:
    """Keep the rows whose ``text`` matches; add the groups of the first match as ``name``.

    One run of the pattern per row, however many groups are read
    (``regexp_extract`` needs one per group).  A group that took no part in the
    match is ``''``.
    """
    return with_fields(df, name, fields(text, (pattern, list(range(1, count + 1)))))


def field(name: str, n: int) -> Column:
    """Field ``n`` (from 1) of a column made by :func:`capture` or :func:`with_fields`."""
    return F.get(F.col(name), F.lit(n - 1))


def int_or_error(text: Column, bits: int = 32, base0: bool = False) -> Column:
    """Strict integer parse: NULL when the text does not fit in ``bits`` bits.

    With ``base0`` a leading zero means octal, so ``010`` is 8 and ``08`` is
    NULL; by default digits are decimal.
    """
    target = {32: "int", 64: "bigint"}[bits]
    plain = text.try_cast(target)
    if not base0:
        return plain
    digits = F.regexp_replace(text, "^-", "")
    octal = F.conv(digits, 8, 10).try_cast("bigint") * F.when(text.startswith("-"), -1).otherwise(1)
    return (
        F.when(~text.rlike("^-?0[0-9]+$"), plain)
        .when(digits.rlike("^0[0-7]+$"), octal.cast("string").try_cast(target))
    )


def int_or_zero(text: Column, bits: int = 32, base0: bool = False) -> Column:
    """Integer parse that gives 0 where :func:`int_or_error` gives NULL."""
    return F.coalesce(int_or_error(text, bits, base0), F.lit(0))


def micros(seconds: Column) -> Column:
    """DOUBLE seconds to whole microseconds, so that sums do not depend on row order."""
    return F.rint(seconds * 1_000_000).try_cast("bigint")


def log_time(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS.ffffff…`` to TIMESTAMP_NTZ; digits past the microsecond are cut off."""
    return F.substring(text, 1, 26).try_cast("timestamp_ntz")


def epoch_micros(time: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session time zone is."""
    return F.unix_micros(F.concat(time.cast("string"), F.lit("Z")).cast("timestamp"))
