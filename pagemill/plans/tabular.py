"""Queries that see orders as tables: ranges, directions, grids, regions, list counters."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.operators import numbering, tables
from pagemill.plans.catalog import query, table

KEY = ["l_orderkey"]
CELLS = """c AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS row_no, l_quantity AS q FROM lineitem),
v AS (SELECT *, CASE WHEN row_no % 4 = 2 THEN '' WHEN row_no % 4 = 3 AND q > 40 THEN 'n/a' ELSE q::BIGINT::VARCHAR END AS text FROM c),
w AS (SELECT *, try_cast(nullif(text, '') AS DOUBLE) AS x FROM v)"""


def _cells(spark, d):
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    c = table(spark, d, "lineitem").select("l_orderkey", row.alias("row_no"), F.lit(1).alias("cell_no"), F.lit(1).alias("grid_span"), F.col("l_quantity").alias("q"))
    text = F.when(F.col("row_no") % 4 == 2, "").when((F.col("row_no") % 4 == 3) & (F.col("q") > 40), "n/a").otherwise(F.col("q").cast("bigint").cast("string"))
    return tables.with_grid(c.withColumn("text", text).drop("q"), KEY)


def _walk(sign: str, order: str, kind: str) -> str:
    value = {"SUM": "coalesce(list_sum(xs), 0)", "COUNT": "len(xs)::DOUBLE", "MAX": "list_max(xs)"}[kind]
    return f"""WITH {CELLS}, p AS (SELECT a.l_orderkey, a.row_no, list(b.text ORDER BY b.row_no {order}) FILTER (WHERE b.row_no IS NOT NULL) AS ts FROM w a LEFT JOIN w b ON a.l_orderkey = b.l_orderkey AND b.row_no {sign} a.row_no GROUP BY 1, 2),
s AS (SELECT *, list_position(list_transform(ts, lambda t, i: (t = '' AND i > 1) OR t = 'n/a'), true) AS stop FROM p),
k AS (SELECT l_orderkey, row_no, list_transform(CASE WHEN stop IS NULL OR stop = 0 THEN coalesce(ts, []) ELSE ts[1:stop - 1] END, lambda t: CASE WHEN t = '' THEN 0.0 ELSE t::DOUBLE END) AS xs FROM s)
SELECT l_orderkey, row_no, ({value})::DOUBLE AS value FROM k"""


def _direction(spark, d, kind, direction):
    return tables.directional(_cells(spark, d), KEY, kind, direction).select("l_orderkey", "row_no", "value")


@query(_walk("<", "DESC", "SUM"))
def sum_above(spark, d):
    return _direction(spark, d, "SUM", "ABOVE")


@query(_walk("<", "DESC", "COUNT"))
def count_above(spark, d):
    return _direction(spark, d, "COUNT", "ABOVE")


@query(_walk(">", "ASC", "MAX"))
def max_below(spark, d):
    return _direction(spark, d, "MAX", "BELOW")


@query(f"WITH {CELLS} SELECT l_orderkey, sum(x) AS value FROM w WHERE row_no BETWEEN 1 AND 3 AND x IS NOT NULL GROUP BY 1")
def range_rect(spark, d):
    return tables.aggregate_range(_cells(spark, d), KEY, "SUM", (1, 1), (3, 1))


@query("SELECT l_orderkey, row_no, cell_no, (sum(span) OVER (PARTITION BY l_orderkey, row_no ORDER BY cell_no) - span + 1)::INT AS grid_col FROM (SELECT l_orderkey, 1 AS row_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS cell_no, (1 + l_partkey % 3)::INT AS span FROM lineitem)")
def grid_column(spark, d):
    cell = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    cells = table(spark, d, "lineitem").select("l_orderkey", F.lit(1).alias("row_no"), cell.alias("cell_no"), (1 + F.col("l_partkey") % 3).cast("int").alias("grid_span"))
    return tables.with_grid(cells, KEY).select("l_orderkey", "row_no", "cell_no", "grid_col")


@query("SELECT l_orderkey, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY l_orderkey")
def min_max_column(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), tables.AGGREGATES["MIN"]("l_quantity").alias("low"), tables.AGGREGATES["MAX"]("l_quantity").alias("high"))


@query("""SELECT l_orderkey, r, greatest(0, r - 1)::INT AS band, CASE WHEN n = 1 THEN ['firstCol', 'firstRow', 'lastRow', 'nwCell', 'swCell'] WHEN r = 0 THEN ['firstCol', 'firstRow', 'nwCell'] WHEN r = n - 1 THEN ['firstCol', 'lastRow', 'swCell'] WHEN (r - 1) % 2 = 0 THEN ['band1Horz', 'firstCol'] ELSE ['band2Horz', 'firstCol'] END AS regions
FROM (SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)""")
def table_regions(spark, d):
    w = Window.partitionBy("l_orderkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.select("l_orderkey", "r", tables.band_index(F.col("r"), 1).alias("band"), tables.regions(F.col("r"), F.col("n"), F.lit(0), F.lit(2), last_row=True).alias("regions"))


@query("SELECT l_orderkey, string_agg(l_partkey || chr(9) || l_suppkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM lineitem GROUP BY 1")
def table_texts(spark, d):
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    r = table(spark, d, "lineitem").withColumn("row_no", row)
    cells = r.select("l_orderkey", "row_no", F.posexplode(F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))).alias("cell_no", "text"))
    return tables.table_text(cells, KEY)


@query("""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
i AS (SELECT doc_id, 0 AS level, n, 0 AS k FROM o UNION ALL SELECT o.doc_id, 1, o.n, l.k FROM o JOIN (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) l ON l.l_orderkey = o.o_orderkey)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k)::INT AS ord, CASE WHEN level = 0 THEN n || '.' ELSE n || '.' || k END AS label FROM i""")
def list_counters_2level(spark, d):
    items = _list_items(spark, d)
    levels = spark.createDataFrame([(1, 0, 1, "decimal", "%1.", None, False), (1, 1, 1, "decimal", "%1.%2", None, False)], LEVELS)
    return numbering.list_labels(items, levels).select("doc_id", "ord", "label")


LEVELS = "num_id int, level int, start int, format string, text string, restart_after int, legal boolean"


def _list_items(spark, d):
    """Customers as documents: their orders are items of level 0, and each order's lines of level 1."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    both = o.withColumn("at", F.lit(None).cast(lines.schema["at"].dataType)).unionByName(o.join(lines, "o_orderkey").select("doc_id", "o_orderkey", "at"))
    order = Window.partitionBy("doc_id").orderBy("o_orderkey", F.col("at").asc_nulls_first())
    return both.select("doc_id", F.row_number().over(order).alias("ord"), F.lit(1).alias("num_id"), F.col("at").isNotNull().cast("int").alias("level"))


@query("""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
i AS (SELECT doc_id, 0 AS level, n, 0 AS k FROM o UNION ALL SELECT o.doc_id, 1, o.n, l.k FROM o JOIN (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) l ON l.l_orderkey = o.o_orderkey)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k)::INT AS ord, CASE WHEN level = 1 THEN '(' || (k + doc_id % 5) || ')' WHEN doc_id % 2 = 0 THEN n || ')' ELSE 'No. ' || (n + 9) END AS label FROM i""")
def list_counters_by_document(spark, d):
    """Number 1 means another list in every document, and instances start where their overrides say."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    even = F.col("doc_id") % 2 == 0
    own = customers.select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.lit(1).alias("start"), F.when(even, "%1)").otherwise("No. %1").alias("text"), F.when(~even, F.lit(10)).alias("start_override")),
        F.struct(F.lit(1).alias("level"), (1 + F.col("doc_id") % 5).cast("int").alias("start"), F.lit("(%2)").alias("text"), F.lit(None).cast("int").alias("start_override")),
    )).alias("x")).select("doc_id", "x.*")
    levels = own.withColumns({"num_id": F.lit(1), "format": F.lit("decimal"), "restart_after": F.lit(None).cast("int"), "legal": F.lit(False)})
    return numbering.list_labels(_list_items(spark, d), levels).select("doc_id", "ord", "label")


# Tenths beside a value that swallows them: what lies beyond a stop must not enter a sum.
DECIMALS = """c AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS row_no, l_discount AS q FROM lineitem),
v AS (SELECT *, CASE row_no % 4 WHEN 1 THEN '10000000000000000' WHEN 2 THEN 'n/a' ELSE q::VARCHAR END AS text FROM c)"""


@query(f"""WITH {DECIMALS},
p AS (SELECT l_orderkey, row_no, lag(q, 1) OVER o AS one, lag(q, 2) OVER o AS two FROM v WINDOW o AS (PARTITION BY l_orderkey ORDER BY row_no))
SELECT l_orderkey, row_no, round(CASE WHEN row_no % 4 = 3 OR row_no = 1 THEN 0 WHEN row_no % 4 = 0 THEN one WHEN row_no % 4 = 1 THEN one + two WHEN row_no = 2 THEN 1e16 ELSE 1e16 + one * 0 END, 4)::DOUBLE AS value FROM p""")
def sum_above_decimals(spark, d):
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    c = table(spark, d, "lineitem").select("l_orderkey", row.alias("row_no"), F.lit(1).alias("cell_no"), F.lit(1).alias("grid_span"), F.col("l_discount").alias("q"))
    text = F.when(F.col("row_no") % 4 == 1, "10000000000000000").when(F.col("row_no") % 4 == 2, "n/a").otherwise(F.col("q").cast("string"))
    value = tables.directional(tables.with_grid(c.withColumn("text", text).drop("q"), KEY), KEY, "SUM", "ABOVE")
    return value.select("l_orderkey", "row_no", F.round("value", 4).alias("value"))
