"""State machines that a user writes down, run along the order of a boot.

A machine has a few states, classes of events, and a table that says where each
class leads from each state.  It is sequential, but what a stretch of events
does is small: a map from the state it is entered with to the state it leaves.
Such maps compose, so they are folded as a tree (see
:mod:`bootloom.operators.folds`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.operators.folds import WIDTH, entered
from bootloom.operators.lineage import settle
from bootloom.operators.ordering import BOOT, ORDER, running_sum

#: States that a machine may have: a map of each stretch holds them all.
MOST_STATES = 64
_PLACE = [*BOOT, "segment", *ORDER]


@dataclass(frozen=True)
class Machine:
    """A state that events of its own lead on: column ``name`` after each line, see :func:`bootloom.operators.state.track`.

    ``events`` finds the events in lines and adds ``event``, the name of their
    class.  ``leads`` has the next state by (state, class); an event whose class
    it does not have for a state leaves that state as it is.
    """

    name: str
    events: Callable[[DataFrame], DataFrame]
    states: tuple[str, ...]
    leads: dict[tuple[str, str], str] = field(hash=False)

    def __post_init__(self) -> None:
        if not 0 < len(self.states) <= MOST_STATES or len(set(self.states)) < len(self.states):
            raise ValueError(f"a machine has one to {MOST_STATES} states, each once")
        unknown = {s for (state, _), after in self.leads.items() for s in (state, after)} - set(self.states)
        if unknown:
            raise ValueError(f"not among the states: {sorted(unknown)}")

    @property
    def initial(self) -> str:
        return self.states[0]

    @property
    def classes(self) -> list[str]:
        return sorted({event for _, event in self.leads})

    def moves(self, event: str) -> list[int]:
        """Number of the next state by number of the state."""
        number = {s: i for i, s in enumerate(self.states)}
        return [number[self.leads.get((s, event), s)] for s in self.states]

    def changes(self, lines: DataFrame) -> DataFrame:
        """The events with the state they lead to, as the trackers give them."""
        return machine_events(lines, self).withColumnRenamed("new_state", self.name)


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _state_name(machine: Machine, number: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in machine.states]), number)


def machine_events(lines: DataFrame, machine: Machine, width: int = WIDTH) -> DataFrame:
    """The machine's events with ``old_state`` and ``new_state``, which may be equal; places and no text."""
    known = machine.events(lines).where(F.col("event").isin(machine.classes)).select(*_PLACE, "event")
    move = F.lit(None)
    for event in machine.classes:
        move = F.when(F.col("event") == event, _numbers(machine.moves(event))).otherwise(move)
    numbered = running_sum(settle(known), before={"nth": F.lit(1)})
    events = settle(numbered.withColumn("effect", move.cast("array<int>")))
    begun = events.select(*BOOT).distinct().withColumn("enter", F.lit(0))
    states = entered(
        events.select(*BOOT, "nth", "effect"),
        begun,
        compose=lambda f, g: f"transform({f}, s -> get({g}, s))",
        apply=lambda state, f: f"get({f}, {state})",
        width=width,
    )
    return events.join(states, [*BOOT, "nth"]).select(
        *_PLACE,
        "event",
        _state_name(machine, F.col("enter")).alias("old_state"),
        _state_name(machine, F.get("effect", F.col("enter"))).alias("new_state"),
    )
