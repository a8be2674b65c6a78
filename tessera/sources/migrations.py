"""Stored tables of earlier layouts, brought to the present one step by step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.symbols import last_wins
from tessera.schemas import TABLES, conform, schema
from tessera.sources.sinks import Warehouse
from tessera.sources.versions import Versions


@dataclass(frozen=True)
class Step:
    """From one version of the layout to the next. Applied to its table, or, as `derived`, that folder goes and is made anew.

    A step changes nothing when it is applied twice: after a stop between a table's swap and the version it is.
    """

    version: int
    what: str
    table: str
    change: Callable[[DataFrame], DataFrame] | None = None
    derived: str | None = None


def _with(df: DataFrame, **columns) -> DataFrame:
    """df with columns that it lacks, and their nulls filled."""
    for name, value in columns.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def _strings():
    return F.array().cast("array<string>")


def _notes_by_target(notes: DataFrame) -> DataFrame:
    notes = _with(notes, seq=F.lit(0).cast("bigint"))
    return last_wins(notes, ["scope", "target"], [F.col("updated_at"), F.col("seq")])


STEPS = [
    Step(2, "behaviour of symbols", "code_index", lambda t: _with(t, raises=_strings(), mutates=_strings(), error_strings=_strings())),
    Step(3, "state of pages", "pages", lambda t: _with(t, status=F.lit("complete"))),
    Step(4, "index in segments, made from pages by the next build", "pages", derived="index"),
    Step(5, "whether a job changed anything", "jobs", lambda t: _with(t, changes_made=F.lit(True))),
    Step(6, "one note for each target", "notes", _notes_by_target),
]
CURRENT = STEPS[-1].version


def stored_version(store: Warehouse) -> int:
    """The version of a warehouse's layout: 1 if it has tables but names none, the current one if it is empty."""
    number, entries = Versions(store.spark, f"{store.base}/_schema").read()
    return entries["version"] if number else 1 if store.exists(store.live) else CURRENT


def migrate(store: Warehouse, steps: list[Step] = STEPS) -> list[int]:
    """Apply the steps that a warehouse lacks, in order, and return their versions. A table that isn't there is passed over.

    Every table that a step changes is written aside and swapped in, and the version follows: a stop leaves the warehouse
    at a version whose tables are whole. A layout newer than this code knows is refused.
    """
    versions = Versions(store.spark, f"{store.base}/_schema")
    at = stored_version(store)
    if at > max(s.version for s in steps):
        raise RuntimeError(f"the warehouse has layout {at}, this code knows {max(s.version for s in steps)}")
    done = []
    for step in sorted(steps, key=lambda s: s.version):
        if step.version <= at:
            continue
        if step.derived is not None:
            store.remove(f"{store.base}/{step.derived}")
        elif store.exists(f"{store.live}/{step.table}"):
            changed = step.change(store.read(step.table))
            store.write(conform(changed, step.table) if step.table in TABLES and set(schema(step.table).names) >= set(changed.columns) else changed, step.table)
        number = versions.read()[0]
        versions.commit(number, {"version": step.version, "what": step.what})
        done.append(step.version)
    if not done and not versions.read()[0]:
        versions.commit(0, {"version": at, "what": "first"})
    return done
