"""Folds along a boot's order as a tree, for state that depends on all that was before.

What a stretch of rows does to a state is an *effect*, and effects of stretches
that follow each other compose to one.  They are composed :data:`WIDTH` at a time,
then so many of these, and so on; the states that stretches are entered with
come back down the same tree.  So a boot of n rows takes log n rounds, and no
task sees more than one stretch of one level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bootloom.operators.lineage import settle
from bootloom.operators.ordering import BOOT

#: Rows, or stretches, that are folded in one array.
WIDTH = 256


def _stretches(rows: DataFrame, compose: Callable[[str, str], str], width: int) -> DataFrame:
    """Stretches of ``width`` rows: the effects of their rows in order, and the effect of all."""
    members = F.array_sort(F.collect_list(F.struct((F.col("nth") % width).alias("at"), "effect")))
    grouped = rows.groupBy(*BOOT, F.expr(f"nth div {width}").alias("nth")).agg(members.alias("_members"))
    whole = f"aggregate(slice(_members, 2, {width}), _members[0].effect, (done, m) -> {compose('done', 'm.effect')})"
    return settle(grouped.withColumn("effect", F.expr(whole)))


def entered(
    rows: DataFrame,
    first: DataFrame,
    compose: Callable[[str, str], str],
    apply: Callable[[str, str], str],
    width: int = WIDTH,
) -> DataFrame:
    """(boot, ``nth``, ``enter``): the state that each row is entered with.

    ``rows`` have ``nth``, their place in the boot from 0, and ``effect``; ``first`` has
    the state ``enter`` that each boot begins with.  ``compose(f, g)`` is the effect of
    f and then g, ``apply(state, f)`` the state after f; both get and give SQL.
    """
    longest = rows.groupBy(*BOOT).count().agg(F.max("count")).first()[0] or 0
    levels, above = [], rows
    while longest > 1 or not levels:
        levels.append(_stretches(above, compose, width))
        above = levels[-1].select(*BOOT, "nth", "effect")
        longest = -(-longest // width)
    found = first.select(*BOOT, F.lit(0).cast("bigint").alias("nth"), "enter")
    for level, stretches in reversed(list(enumerate(levels))):
        states = f"""aggregate(_members, struct(enter as now, slice(array(enter), 1, 0) as met),
          (s, m) -> struct({apply("s.now", "m.effect")} as now, concat(s.met, array(s.now)) as met), s -> s.met)"""
        opened = stretches.join(found, [*BOOT, "nth"]).select(*BOOT, "nth", F.posexplode(F.expr(states)).alias("_at", "enter"))
        found = opened.select(*BOOT, (F.col("nth") * width + F.col("_at")).alias("nth"), "enter")
        if level:
            found = settle(found)
    return found
