"""Table cells in long form: (table keys, row_no, cell_no, grid_span, text, ...), rows and columns from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.text import to_number


def with_grid(cells: DataFrame, by: list[str]) -> DataFrame:
    """Adds grid_col: where each cell starts, from the spans before it in its row."""
    row = Window.partitionBy(*by, "row_no").orderBy("cell_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    span = F.coalesce(F.col("grid_span"), F.lit(1))
    return cells.withColumn("grid_col", (F.sum(span).over(row) - span + 1).cast("int"))


def range_values(grid: DataFrame, first: tuple[int | None, int | None], last: tuple[int | None, int | None]) -> DataFrame:
    """Numeric cells of a range of (row, column) corners; None leaves that side open. A spanning cell counts once, by its start or any column it covers."""
    (r1, c1), (r2, c2) = first, last
    end = F.col("grid_col") + F.coalesce(F.col("grid_span"), F.lit(1)) - 1
    keep = F.lit(True)
    for low, high, a, b in ((r1, r2, F.col("row_no"), F.col("row_no")), (c1, c2, F.col("grid_col"), end)):
        if low is not None:
            keep &= b >= low
        if high is not None:
            keep &= a <= high
    return grid.where(keep).withColumn("value", to_number("text")).where("value is not null")


AGGREGATES = {
    "SUM": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "AVERAGE": F.avg,
    "COUNT": F.count,
    "MIN": F.min,
    "MAX": F.max,
    "PRODUCT": lambda v: F.coalesce(F.product(v), F.lit(1.0)),
}


def aggregate_range(grid: DataFrame, by: list[str], kind: str, first, last) -> DataFrame:
    return range_values(grid, first, last).groupBy(*by).agg(AGGREGATES[kind]("value").alias("value"))


def directional(grid: DataFrame, by: list[str], kind: str, direction: str) -> DataFrame:
    """For every cell the aggregate of the numbers in one direction from it, up to the first cell without one.

    A blank cell right beside counts as 0 and doesn't stop the walk. direction: ABOVE, BELOW, LEFT or RIGHT. Running aggregates
    start anew at every stop, so each cell is read once and what lies beyond a stop never enters a value, not even to be taken off.
    """
    across = direction in ("LEFT", "RIGHT")
    line, place = ("row_no", "grid_col") if across else ("grid_col", "row_no")
    order = F.col(place).asc() if direction in ("ABOVE", "LEFT") else F.col(place).desc()
    w = Window.partitionBy(*by, line).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = grid.withColumns({"__v": to_number("text"), "__blank": F.coalesce(F.trim("text"), F.lit("")) == ""})
    # A stretch is a stop and the numbers after it; what a cell aggregates is its neighbour's stretch so far, or the one before a forgiven blank.
    n = n.withColumn("__g", F.count(F.when(F.col("__v").isNull(), F.lit(1))).over(upto))
    stretch = Window.partitionBy(*by, line, "__g").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = {"SUM": F.sum, "COUNT": F.count, "AVERAGE": lambda v: F.struct(F.sum(v).over(stretch).alias("s"), F.count(v).over(stretch).alias("c")), "MIN": F.min, "MAX": F.max, "PRODUCT": F.product}[kind]("__v")
    n = n.withColumn("__so_far", so_far if kind == "AVERAGE" else so_far.over(stretch))
    forgiven = F.coalesce(F.lag("__blank").over(w), F.lit(False))
    got = F.when(forgiven, F.lag("__so_far", 2).over(w)).otherwise(F.lag("__so_far").over(w))
    n = n.withColumns({"__got": got, "__forgiven": forgiven})
    got, zero = F.col("__got"), F.when(F.col("__forgiven"), F.lit(0.0))
    value = {
        "SUM": lambda: F.coalesce(got, F.lit(0.0)),
        "COUNT": lambda: (F.coalesce(got, F.lit(0)) + F.col("__forgiven").cast("int")).cast("double"),
        "AVERAGE": lambda: F.coalesce(got["s"], zero) / F.nullif(F.coalesce(got["c"], F.lit(0)) + F.col("__forgiven").cast("int"), F.lit(0)),
        "MIN": lambda: F.least(got, zero),
        "MAX": lambda: F.greatest(got, zero),
        "PRODUCT": lambda: F.coalesce(zero, got, F.lit(1.0)),
    }[kind]()
    return n.withColumn("value", value).select(*grid.columns, "value")


def table_text(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells by tab, rows by line feed."""
    items = F.array_sort(F.collect_list(F.struct("cell_no", F.coalesce("text", F.lit("")).alias("t"))))
    rows = cells.groupBy(*by, "row_no").agg(F.array_join(F.transform(items, lambda x: x["t"]), "\t").alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("row_no", "line")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def band_index(index: Column, offset: Column | int = 0, size: Column | int = 1) -> Column:
    off = offset if isinstance(offset, Column) else F.lit(offset)
    return F.floor(F.greatest(F.lit(0), index - off) / F.greatest(F.lit(1), size if isinstance(size, Column) else F.lit(size))).cast("int")


def regions(row: Column, rows: Column, column: Column, columns: Column, *, first_row=True, last_row=False, first_column=True, last_column=False, h_band=True, v_band=False, row_band=1, column_band=1) -> Column:
    """The conditional regions of a cell (places from 0), in the order in which their formats apply."""
    on = lambda flag, c: F.lit(bool(flag)) & c
    top, bottom, left, right = on(first_row, row == 0), on(last_row, row == rows - 1), on(first_column, column == 0), on(last_column, column == columns - 1)
    odd = lambda i, skip, size: band_index(i, int(bool(skip)), size) % 2 == 0
    inside_h, inside_v = on(h_band, ~top & ~bottom), on(v_band, ~left & ~right)
    named = [
        (inside_v & odd(column, first_column, column_band), "band1Vert"),
        (inside_v & ~odd(column, first_column, column_band), "band2Vert"),
        (inside_h & odd(row, first_row, row_band), "band1Horz"),
        (inside_h & ~odd(row, first_row, row_band), "band2Horz"),
        (left, "firstCol"),
        (right, "lastCol"),
        (top, "firstRow"),
        (bottom, "lastRow"),
        (top & left, "nwCell"),
        (top & right, "neCell"),
        (bottom & left, "swCell"),
        (bottom & right, "seCell"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in named]))


def insert_column(cells: DataFrame, by: list[str], at: int, text: str = "") -> DataFrame:
    """A new cell before the at-th of each row (from 1), at its end if the row is shorter."""
    keys = [*by, "row_no"]
    rows = cells.groupBy(*keys).agg(F.max("cell_no").alias("__n"))
    new = rows.select(*keys, F.least(F.lit(at), F.col("__n") + 1).alias("cell_no"), F.lit(1).alias("grid_span"), F.lit(text).alias("text"))
    moved = cells.select(*keys, (F.col("cell_no") + F.when(F.col("cell_no") >= at, 1).otherwise(0)).alias("cell_no"), "grid_span", "text")
    return moved.unionByName(new)


def remove_column(cells: DataFrame, by: list[str], at: int) -> DataFrame:
    keys = [*by, "row_no"]
    return cells.where(F.col("cell_no") != at).select(*keys, (F.col("cell_no") - F.when(F.col("cell_no") > at, 1).otherwise(0)).alias("cell_no"), "grid_span", "text")


def merge_cells(cells: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """Cells of a rectangle (rows and cells from 1) become one: the first of each row spans the others, later rows continue it."""
    (r1, r2), (c1, c2) = rows, columns
    inside = F.col("row_no").between(r1, r2) & F.col("cell_no").between(c1, c2)
    kept = cells.where(~inside | (F.col("cell_no") == c1))
    inside_row = F.col("row_no").between(r1, r2)
    v = F.when(F.col("row_no") == r1, "restart").otherwise("continue") if r2 > r1 else F.lit(None).cast("string")
    return kept.withColumns({"grid_span": F.when(inside, F.lit(c2 - c1 + 1)).otherwise(F.col("grid_span")), "v_merge": F.when(inside, v), "cell_no": F.when(inside_row & (F.col("cell_no") > c2), F.col("cell_no") - (c2 - c1)).otherwise(F.col("cell_no"))})
