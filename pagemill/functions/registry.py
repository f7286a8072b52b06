"""Functions of single values under names that SQL can call."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from pagemill.functions.formula import evaluate_formula
from pagemill.functions.pictures import date_format_of, numeric_picture
from pagemill.operators.numbering import number_text

#: What Spark's own functions can't be put together to in SQL, with the type of its result.
FUNCTIONS: dict[str, tuple[str, Callable]] = {
    "formula_value": ("double", lambda formula: None if formula is None else evaluate_formula(formula)),
    "numeric_picture": ("string", lambda value, picture: None if value is None or picture is None else numeric_picture(float(value), picture)),
    "date_format_of": ("string", lambda picture: None if picture is None else date_format_of(picture)),
    "list_number": ("string", lambda n, kind: None if n is None else number_text(int(n), kind or "decimal")),
}


def register(spark: SparkSession, prefix: str = "pm_", more: dict[str, tuple[str, Callable]] | None = None, only: Iterable[str] | None = None) -> list[str]:
    """Makes the functions, and more of the user's own, functions of the session under prefix and their names; returns those names."""
    known = FUNCTIONS | (more or {})
    chosen = known if only is None else {n: known[n] for n in only}
    for name, (kind, f) in chosen.items():
        spark.udf.register(prefix + name, f, kind)
    return sorted(prefix + n for n in chosen)
