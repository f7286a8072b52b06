"""Formats as nullable structs: toggles are exclusive-or between layers, direct formatting wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The run properties that toggle.
TOGGLES = ("bold", "italic", "caps", "small_caps", "strike", "outline", "shadow", "emboss", "imprint", "vanish", "bold_cs", "italic_cs")


def toggle(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a != b)


def merge(base: Column, over: Column, fields: list[str]) -> Column:
    """Two layers of different kinds: toggles by exclusive-or, the rest by the upper one where it says anything."""
    return F.struct(*[(toggle(base[f], over[f]) if f in TOGGLES else F.coalesce(over[f], base[f])).alias(f) for f in fields])


def apply(base: Column, over: Column, fields: list[str]) -> Column:
    """Layers of one kind, or direct formatting: the upper one wins."""
    return F.struct(*[F.coalesce(over[f], base[f]).alias(f) for f in fields])


def resolved(defaults: Column, table: Column, paragraph: Column, character: Column, direct: Column, fields: list[str]) -> Column:
    return apply(reduce(lambda a, b: merge(a, b, fields), (table, paragraph, character), defaults), direct, fields)


def coalesce_runs(runs: Column) -> Column:
    """Neighbouring runs of equal format joined, empty ones dropped; runs are (start, length, format)."""
    kept = F.filter(runs, lambda r: r["length"] > 0)

    def step(s: Column, r: Column) -> Column:
        last = F.get(s, F.size(s) - 1)
        same = (F.size(s) > 0) & last["format"].eqNullSafe(r["format"])
        wider = F.struct(last["start"].alias("start"), (last["length"] + r["length"]).alias("length"), last["format"].alias("format"))
        return F.when(same, F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(s, F.array(r)))

    return F.aggregate(kept, F.slice(kept, 1, 0), step)
