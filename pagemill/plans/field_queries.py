"""Queries over events, parts and orders: fields, sequences, formats, formulas."""

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.formula import compile_formula
from pagemill.operators import budget, fields
from pagemill.plans.catalog import query, table

ROMAN_SQL = "list_aggregate(list_transform([1000,900,500,400,100,90,50,40,10,9,5,4,1], lambda v, i: repeat(['M','CM','D','CD','C','XC','L','XL','X','IX','V','IV','I'][i], ((CASE i WHEN 1 THEN p_size WHEN 2 THEN p_size % 1000 WHEN 3 THEN p_size % 900 WHEN 4 THEN p_size % 500 WHEN 5 THEN p_size % 400 WHEN 6 THEN p_size % 100 WHEN 7 THEN p_size % 100 % 90 WHEN 8 THEN p_size % 100 % 90 % 50 WHEN 9 THEN p_size % 100 % 90 % 50 % 40 WHEN 10 THEN p_size % 100 % 90 % 50 % 40 % 10 WHEN 11 THEN p_size % 100 % 90 % 50 % 40 % 10 % 9 WHEN 12 THEN p_size % 100 % 90 % 50 % 40 % 10 % 9 % 5 ELSE p_size % 100 % 90 % 50 % 40 % 10 % 9 % 5 % 4 END) // v)::INT)), 'string_agg', '')"


@query(f"SELECT p_partkey, {ROMAN_SQL} AS roman, repeat(chr(65 + (p_size - 1) % 26), 1 + (p_size - 1) // 26) AS alphabetic, p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal, upper(to_hex(p_size)) AS hex, p_size::VARCHAR AS arabic FROM part")
def number_formats(spark, d):
    n = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", T.roman(n).alias("roman"), T.alphabetic(n).alias("alphabetic"), T.ordinal(n).alias("ordinal"), T.hexadecimal(n).alias("hex"), T.arabic(n).alias("arabic"))


@query("SELECT p_partkey, upper(p_name) AS upper, lower(p_name) AS lower, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS caps, upper(p_name[1]) || lower(p_name[2:]) AS first_cap FROM part")
def letter_cases(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("upper"), F.lower("p_name").alias("lower"), T.caps(F.lower("p_name")).alias("caps"), T.first_cap("p_name").alias("first_cap"))


FORMULAS = {
    "arith": ("= q * 2 + 3 - 4 / 2", "q * 2 + 3 - 4 / 2"),
    "power": ("= -q ^ 2", "pow(-q, 2)"),
    "percent": ("= q * 50%", "q * 0.5"),
    "mod": ("= MOD(q, 7)", "q % 7"),
    "by_zero": ("= q / (q - q)", "NULL::DOUBLE"),
    "trunc": ("= INT(q / 3 - 5)", "trunc(q / 3 - 5) + 0"),
    "sign": ("= SIGN(q - 25)", "sign(q - 25)::DOUBLE"),
    "branch": ("= IF(q > 25; q; 0 - q)", "CASE WHEN q > 25 THEN q ELSE 0 - q END"),
    "compare": ("= q >= 25", "(q >= 25)::INT::DOUBLE"),
    "logic": ("= OR(AND(q > 10, q < 20), NOT(q < 40))", "((q > 10 AND q < 20) OR NOT q < 40)::INT::DOUBLE"),
    "lists": ("= SUM(q, 1, 2) + MAX(q, 25) - MIN(q, 5) + COUNT(q, 1)", "(q + 3) + greatest(q, 25) - least(q, 5) + 2"),
    "defined": ("= DEFINED(q / 0) + DEFINED(q)", "1.0::DOUBLE"),
    "leftover": ("= 1 < 2 < 3", "NULL::DOUBLE"),
    "rounded": ("= ROUND(q, -1)", "floor(q / 10 + 0.5) * 10"),
}


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"({sql})::DOUBLE AS {k}" for k, (_, sql) in FORMULAS.items()) + " FROM (SELECT *, l_quantity AS q FROM lineitem)")
def formulas(spark, d):
    q = {"q": F.col("l_quantity")}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[compile_formula(f, q).alias(k) for k, (f, _) in FORMULAS.items()])


SEQ = """WITH e AS (SELECT *, CASE WHEN event_id % 50 = 7 THEN 10 END AS reset_to, event_id % 7 = 3 AS repeats FROM events),
g AS (SELECT *, count(reset_to) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM e)
SELECT event_id, (coalesce(first_value(reset_to) OVER w, 0) + sum(CASE WHEN reset_to IS NULL AND NOT repeats THEN 1 ELSE 0 END) OVER w)::BIGINT AS seq FROM g WINDOW w AS (PARTITION BY user_id, event_type, g ORDER BY event_id)"""


@query(SEQ)
def seq_numbering(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.upper("event_type").alias("seq_name"), F.when(F.col("event_id") % 50 == 7, 10).alias("reset_to"), (F.col("event_id") % 7 == 3).alias("repeats"))
    return fields.sequence_numbers(e, ["user_id"], ["event_id"]).select("event_id", F.col("seq").cast("long").alias("seq"))


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS heading FROM events")
def styleref_nearest(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", fields.nearest_styled(e, ["user_id"], ["event_id"], F.col("event_type") == "purchase", F.col("event_id")).alias("heading"))


@query("SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS by_number, CASE WHEN upper(event_type) = 'CLICK' THEN 'yes' ELSE 'no' END AS by_text FROM events")
def if_field(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", fields.if_field(F.col("value").cast("string"), ">", F.lit("50"), F.lit("high"), F.lit("low")).alias("by_number"), fields.if_field(F.col("event_type"), "=", F.lit("CLICK"), F.lit("yes"), F.lit("no")).alias("by_text"))


@query("SELECT e.event_id, f.event_id AS target FROM events e LEFT JOIN (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL) f ON f.user_id = e.user_id AND f.event_type = 'view'")
def doc_ref_lookup(spark, d):
    e = table(spark, d, "events")
    marks = e.select(F.col("user_id").alias("doc_id"), F.upper("event_type").alias("name"), F.col("event_id").alias("ord"), F.lit(0).alias("start"), F.col("event_id").cast("string").alias("text"), F.length(F.col("event_id").cast("string")).alias("length"))
    refs = e.select("event_id", F.col("user_id").alias("doc_id"), F.lit("View").alias("name"))
    return fields.bookmark_text(refs, marks).select("event_id", F.col("result").cast("long").alias("target"))


@query("SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M') AS shown FROM events")
def date_pictures(spark, d):
    from pagemill.functions.pictures import date_picture

    return table(spark, d, "events").select("event_id", date_picture(F.col("ts"), "dd.MM.yyyy HH:mm").alias("shown"))


@query("SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events QUALIFY n = 1")
def first_by_user(spark, d):
    return budget.first_wins(table(spark, d, "events"), ["user_id"], ["ts"]).select("user_id", "ts", F.lit(1).cast("long").alias("n"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ROLLUP (event_type, date_trunc('day', ts))")
def rollup_events(spark, d):
    return table(spark, d, "events").rollup("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, (o_orderpriority || '|' || o_orderstatus) AS line FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("line"))
