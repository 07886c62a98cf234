"""Extractors as a graph: each reads native tables and tables that others make, and gives samples, tables or both.

What an extractor gives is written before the next one reads it, so a table made once (the words of a transcript, say)
serves all that read it, and one that fails takes with it those that need it and no other. Extractors that read
``channels``, the values that all others made, run in a second phase.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import grid as G
from gridloom.operators import typed
from gridloom.schemas import MODALITIES
from gridloom.shared import staged


CHANNELS = "channels"


@dataclass
class Made:
    """Samples for the grid, tables for other extractors, and stimuli on which the extractor failed (stim_id, error).

    Samples may be a function of the tables as written, so that what both come from is made once.
    """

    samples: DataFrame | Callable[[dict[str, DataFrame]], DataFrame] | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    failed: DataFrame | None = None


@dataclass(frozen=True)
class Node:
    """``make`` gets stimuli, bins and the tables it reads, by name, cut to the stimuli of its modalities."""

    name: str
    reads: tuple[str, ...]
    make: Callable[[DataFrame, DataFrame, dict[str, DataFrame]], Made]
    gives: tuple[str, ...] = ()
    modalities: tuple[str, ...] = MODALITIES
    group: str = "core"


@dataclass
class Run:
    """What a run gave: its channels, the tables that extractors made, what failed by stimulus, and how each extractor fared."""

    values: DataFrame
    tables: dict[str, DataFrame]
    failed: DataFrame
    status: dict[str, str]


def in_order(nodes: list[Node]) -> list[Node]:
    """Each after those whose tables it reads, else in the order given; a circle or two makers of one table are errors."""
    maker: dict[str, Node] = {}
    for node in nodes:
        for table in node.gives:
            if table in maker:
                raise ValueError(f"{node.name} and {maker[table].name} both make {table}")
            maker[table] = node
    named = {n.name: n for n in nodes}
    if len(named) < len(nodes):
        raise ValueError("two extractors have one name")
    order = TopologicalSorter({n.name: [maker[t].name for t in n.reads if t in maker] for n in nodes})
    return [named[name] for name in order.static_order()]


def run(nodes: list[Node], stimuli: DataFrame, native: dict[str, DataFrame], template: DataFrame, rate: float = 1.0) -> Run:
    """Run the extractors over stimuli (stim_id, modality, duration_sec) and put their samples on the grid as the template says.

    The status of an extractor is ok, absent (a native table is not there), failed with its error, or skipped with the
    extractor it needs. Native tables have a stim_id, or are vocabularies without one.
    """
    stimuli = staged(stimuli.select("stim_id", "modality", "duration_sec"), "stimuli")  # read by every step, and often a sum over their texts
    late = [n for n in nodes if CHANNELS in n.reads]
    paths = [r[0] for r in template.select("path").collect()]  # a short list
    first = _phase([n for n in nodes if n not in late], stimuli, native, rate, paths)
    values = typed.channels(first.samples, template, stimuli, rate)
    if not late:
        return Run(values, first.made, first.failed, first.status)
    held = staged(values, CHANNELS)
    second = _phase(late, stimuli, {**native, **first.made, CHANNELS: held}, rate, paths)
    again = second.samples.select("path").distinct()  # channels, of which there are a few
    others = template.join(again, "path", "left_semi")
    whole = held.join(again, "path", "left_anti").unionByName(typed.channels(second.samples, others, stimuli, rate))
    return Run(whole, {**first.made, **second.made}, first.failed.unionByName(second.failed), first.status | second.status)


@dataclass
class _Phase:
    samples: DataFrame
    made: dict[str, DataFrame]
    failed: DataFrame
    status: dict[str, str]


def _phase(nodes: list[Node], stimuli: DataFrame, native: dict[str, DataFrame], rate: float, paths: list[str]) -> _Phase:
    """Samples of channels that are not among ``paths`` are not made."""
    tables, status, parts, failed = dict(native), {}, [], []
    maker = {t: n.name for n in nodes for t in n.gives}
    bins = G.time_grid(stimuli, rate)
    for node in in_order(nodes):
        missing = [t for t in node.reads if t not in tables]
        if missing:
            need = sorted({maker[t] for t in missing if t in maker})
            status[node.name] = f"skipped: needs {', '.join(need)}" if need else f"absent: {', '.join(missing)}"
            continue
        taken = stimuli.where(F.col("modality").isin(*node.modalities))
        given = {t: tables[t].join(taken.select("stim_id"), "stim_id", "left_semi") if "stim_id" in tables[t].columns else tables[t] for t in node.reads}
        try:
            made = node.make(taken, bins.join(taken.select("stim_id"), "stim_id", "left_semi"), given)
            found = {name: staged(made.tables[name], name) for name in node.gives}
            rows = made.samples(found) if callable(made.samples) else made.samples
            samples = staged(rows.select(*typed.COLUMNS).where(F.col("path").isin(paths)), node.name) if rows is not None else None
            broken = staged(made.failed, f"{node.name}-failed") if made.failed is not None else None
        except Exception as problem:  # one extractor's failure must not end the others' work
            status[node.name] = f"failed: {type(problem).__name__}: {str(problem).strip().splitlines()[-1][:200] if str(problem).strip() else ""}"
            continue
        status[node.name] = "ok"
        tables |= found
        parts += [samples] if samples is not None else []
        failed += [broken] if broken is not None else []
    spark = stimuli.sparkSession
    kind = stimuli.schema["stim_id"].dataType.simpleString()
    samples = typed.together(*parts) if parts else spark.createDataFrame([], f"stim_id {kind}, path string, " + ", ".join(f"{c} {k}" for c, k in typed.FIELDS.items()))
    errors = typed.together(*failed) if failed else spark.createDataFrame([], f"stim_id {kind}, error string")
    return _Phase(samples, {t: tables[t] for t in maker if t in tables}, errors, status)
