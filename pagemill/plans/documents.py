"""Queries over documents and conversations: search, edits, Markdown, revisions, budgets."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import text as T
from pagemill.operators import budget, merge, revisions, search, templates
from pagemill.plans.catalog import query, table

LINES = "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS text FROM documents"


@query(r"SELECT lang, count(*) AS docs, sum(len(regexp_extract_all(text, '(?i)\bthe\b')))::BIGINT AS matches FROM documents GROUP BY lang")
def find_word_by_lang(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(search.count_matches(F.col("text"), "the", whole_word=True)).alias("matches"))


@query("""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?s)(.*?)(tion[a-z]+)', 1) AS gaps, regexp_extract_all(text, '(?s)(.*?)(tion[a-z]+)', 2) AS found FROM documents WHERE regexp_matches(text, 'tion[a-z]+')),
k AS (SELECT doc_id, gaps, found, unnest(range(1, len(found) + 1)) AS i FROM m)
SELECT doc_id, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0))::INT AS start, length(found[i])::INT AS length, found[i] AS value FROM k""")
def find_regex_matches(spark, d):
    return search.find(table(spark, d, "documents").select("doc_id", "text"), "tion[a-z]+", regex=True, match_case=True)


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?i)\bis\b'))::INT AS n FROM documents")
def find_whole_word_ci(spark, d):
    return table(spark, d, "documents").select("doc_id", search.count_matches(F.col("text"), "is", whole_word=True).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '([a-z]+) ([a-z]+)'))::INT AS n_replaced, md5(regexp_replace(text, '([a-z]+) ([a-z]+)', '\\2 \\1', 'g')) AS digest FROM documents")
def replace_swap_groups(spark, d):
    out = search.replace(table(spark, d, "documents").select("doc_id", "text"), "([a-z]+) ([a-z]+)", "$2 $1", regex=True, match_case=True)
    return out.select("doc_id", "n_replaced", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(replace(text, 'the', '$1\\')) AS digest FROM documents")
def replace_literal(spark, d):
    out = search.replace(table(spark, d, "documents").select("doc_id", "text"), "the", "$1\\", match_case=True)
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, ord::INT AS ord, text FROM ({LINES})")
def paragraph_split(spark, d):
    return search.paragraphs(table(spark, d, "documents"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def text_rejoin(spark, d):
    return search.joined_text(search.paragraphs(table(spark, d, "documents")), ["doc_id"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\t\n\f\r ]+', ' ', 'g'), '^ ', '')) AS digest FROM documents")
def ws_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.collapse_space("text").cast("binary")).alias("digest"))


@query(rf"""SELECT doc_id, ord::INT AS ord, md5(regexp_replace(regexp_replace(regexp_replace(text, '([\\`*_\[\]<>|~])', '\\\1', 'g'), '(?m)^( {{0,3}})(#{{1,6}}(?:\s|$)|[-+](?:\s|$)|=+\s*$|-{{3,}}\s*$)', '\1\\\2', 'g'), '(?m)^( {{0,3}}\d{{1,9}})([.)](?:\s|$))', '\1\\\2', 'g')) AS digest FROM ({LINES})""")
def md_escape(spark, d):
    return search.paragraphs(table(spark, d, "documents")).select("doc_id", "ord", F.md5(T.markdown_escape("text").cast("binary")).alias("digest"))


@query(rf"""SELECT doc_id, ord::INT AS ord, length(regexp_extract(text, '^ {{0,3}}(#{{1,6}})(?:[ \t]|$)', 1))::INT AS level, regexp_matches(text, '^ {{0,3}}(?:(?:-[ \t]*){{3,}}|(?:\*[ \t]*){{3,}}|(?:_[ \t]*){{3,}})$') AS rule, regexp_extract(text, '^( *)([-+*]|\d{{1,9}}[.)])[ \t]', 2) AS mark FROM ({LINES})""")
def line_kinds(spark, d):
    return search.paragraphs(table(spark, d, "documents")).select("doc_id", "ord", F.coalesce(T.heading_level("text"), F.lit(0)).alias("level"), T.thematic_break("text").alias("rule"), F.regexp_extract("text", r"^( *)([-+*]|\d{1,9}[.)])[ \t]", 2).alias("mark"))


@query(r"SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '[%#$&]+'), lambda x: length(x))), 0)::INT AS longest, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1)::INT AS fence FROM documents")
def fence_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", T.longest_run("text", "[%#$&]").alias("longest"), T.fence_length("text").alias("fence"))


@query("""SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: CASE c WHEN '&' THEN '&amp;' WHEN '<' THEN '&lt;' WHEN '>' THEN '&gt;' WHEN '"' THEN '&quot;' WHEN chr(39) THEN '&#39;' ELSE CASE WHEN unicode(c) BETWEEN 160 AND 255 THEN '&#' || unicode(c) || ';' ELSE c END END), '')) AS digest FROM documents""")
def html_escaped(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.html_escape("text").cast("binary")).alias("digest"))


@query(r"SELECT source, count(*) AS docs, regexp_replace('bookmark' || lower(regexp_replace('My ' || source || ' (mark)!', '[^A-Za-z0-9]+', '-', 'g')), '-+$', '') AS slug FROM documents GROUP BY source")
def anchor_slugs(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs")).withColumn("slug", T.anchor_slug(F.concat(F.lit("My "), F.col("source"), F.lit(" (mark)!"))))


@query("SELECT doc_id, 'text_characters' AS limit_name, 5000::BIGINT AS \"limit\", length(text)::BIGINT AS observed FROM documents WHERE length(text) > 5000 UNION ALL SELECT doc_id, 'lines', 40, len(string_split(text, chr(10))) FROM documents WHERE len(string_split(text, chr(10))) > 40")
def budget_rejects(spark, d):
    return budget.text_rejects(table(spark, d, "documents"), {"text_characters": 5000, "lines": 40})


@query("SELECT doc_id, 'media_bytes' AS limit_name, 9000::BIGINT AS \"limit\", octet_length(encode(text))::BIGINT AS observed FROM documents WHERE octet_length(encode(text)) > 9000 UNION ALL SELECT source_no, 'total_media_bytes', 60000, min(total)::BIGINT FROM (SELECT (doc_id % 20)::BIGINT AS source_no, sum(octet_length(encode(text))) OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS total FROM documents) WHERE total > 60000 GROUP BY source_no")
def media_budget(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    single = budget.rejects(docs, {"media_bytes": F.col("size")}, {"media_bytes": 9000})
    groups = docs.select((F.col("doc_id") % 20).alias("g"), F.col("doc_id").alias("ord"), "size")
    total = budget.media_rejects(groups, {"media_bytes": 1 << 40, "total_media_bytes": 60000}, "g").withColumnRenamed("g", "doc_id")
    return single.unionByName(total)


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def diagnostics_dedupe(spark, d):
    rows = table(spark, d, "documents").select(F.lit(1).alias("batch"), F.col("source").alias("kind"), F.col("lang").alias("subject"), F.col("doc_id").alias("ord"))
    return budget.distinct_diagnostics(rows, "batch").select(F.col("kind").alias("source"), F.col("subject").alias("lang"), F.col("ord").alias("doc_id"))


@query("SELECT sha256(text) AS digest, count(*) AS uses, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def media_dedupe(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("uses"), F.min("doc_id").alias("first_doc"))


@query("SELECT label, doc_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY ord) AS n FROM (SELECT lower(regexp_extract(text, '^[ ]*([^ \\t\\r\\f]*)', 1)) AS label, doc_id, ord::INT AS ord FROM (" + LINES + "))) WHERE n = 1")
def first_wins_defs(spark, d):
    """The first line of each document that begins with a word, for every word; lines without one count as the empty word."""
    lines = search.paragraphs(table(spark, d, "documents"))
    return budget.first_wins(lines.withColumn("label", T.label(F.regexp_extract("text", r"^[ ]*([^ \t\r\f]*)", 1))), ["doc_id", "label"], ["ord"]).select("label", "doc_id", "ord")


SEGMENTS = """WITH s AS (SELECT conv_id AS doc_id, turn AS para, CASE turn % 4 WHEN 1 THEN 'ins' WHEN 2 THEN 'del' END AS kind, text, CASE turn % 3 WHEN 1 THEN 'ins' WHEN 2 THEN 'del' END AS mark FROM conversations),
i AS (SELECT *, coalesce(sum(CASE WHEN mark = '{gone}' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM s)
SELECT doc_id, min(para) AS para, string_agg(CASE WHEN kind = '{gone}' THEN '' ELSE text END, '' ORDER BY para) AS text FROM i GROUP BY doc_id, island"""


def _revised(spark, d, accept):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para"), "text")
    segments = rows.select("doc_id", "para", F.lit(0).alias("seg"), F.when(F.col("para") % 4 == 1, "ins").when(F.col("para") % 4 == 2, "del").alias("kind"), "text")
    marks = rows.select("doc_id", "para", F.when(F.col("para") % 3 == 1, "ins").when(F.col("para") % 3 == 2, "del").alias("mark"))
    return revisions.resolve(segments, marks, accept)


@query(SEGMENTS.format(gone="del"))
def accept_changes(spark, d):
    return _revised(spark, d, True)


@query(SEGMENTS.format(gone="ins"))
def reject_changes(spark, d):
    return _revised(spark, d, False)


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 1")
def row_revisions(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, "del").alias("rev"))
    return revisions.resolve_rows(rows, ["conv_id"]).select("conv_id", "turn")


@query("SELECT conv_id, turn + CASE WHEN part = 2 THEN m + 1 ELSE 0 END AS ord, text FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) CROSS JOIN (SELECT unnest([1, 2]) AS part)")
def append_documents(spark, d):
    blocks = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), "text")
    return merge.append_blocks(blocks, blocks, "conv_id")


@query("SELECT id, side FROM (SELECT 'S' || s_suppkey AS id, 'target' AS side FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 's' || s_suppkey, 'source' FROM supplier WHERE s_suppkey % 2 = 1)")
def style_target_wins(spark, d):
    s = table(spark, d, "supplier")
    target = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit("target").alias("side"))
    return merge.target_wins(target, s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("source").alias("side")), "id")


@query("SELECT n_regionkey, n_nationkey::BIGINT AS old_id, (max(n_nationkey) OVER (PARTITION BY n_regionkey) + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::BIGINT AS new_id FROM nation")
def id_remap(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").cast("long").alias("id"))
    return merge.fresh_ids(n, n, ["n_regionkey"], "id").select("n_regionkey", "old_id", "new_id")


@query("SELECT doc_id, count(*) FILTER (WHERE kind = 'ins') AS insertions FROM (SELECT doc_id, 'ins' AS kind FROM documents WHERE doc_id % 10 = 0) GROUP BY doc_id")
def compare_appended_paragraph(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    more = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("\nA closing paragraph."))).otherwise(F.col("text")))
    out = merge.compare(search.paragraphs(docs), search.paragraphs(more))
    return out.where("kind = 'ins'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("insertions"))


FILLED = "'Invoice ' || o_orderkey || ' for ' || c_name || ' {{Nobody}} {{x'"


@query(f"SELECT o_orderkey AS model_id, {FILLED} AS text, ['Nobody'] AS unresolved FROM orders JOIN customer ON o_custkey = c_custkey")
def template_fill(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    values = F.create_map(F.lit("Number"), F.col("o_orderkey").cast("string"), F.lit("Customer"), F.col("c_name"))
    text = F.lit("Invoice {{Number}} for {{ Customer }} {{Nobody}} {{x")
    return o.select(F.col("o_orderkey").alias("model_id"), templates.filled(text, values).alias("text"), templates.unresolved(text, values).alias("unresolved"))


@query("""SELECT model_id, string_agg(line, chr(10) ORDER BY ord, item_no) AS text FROM (
SELECT o_orderkey AS model_id, 0 AS ord, 0 AS item_no, 'Order ' || o_orderkey AS line FROM orders
UNION ALL SELECT l_orderkey, 1, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), 'part ' || l_partkey || ' of ' || l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT o_orderkey, 2, 0, 'Thanks' FROM orders WHERE o_orderstatus <> 'F') GROUP BY model_id""")
def template_rows(spark, d):
    orders = table(spark, d, "orders")
    lines = [(0, "Order {{Number}}", None, None), (1, "part {{Lines.Part}} of {{Number}}", "Lines", None), (2, "Thanks", None, "Open")]
    template = spark.createDataFrame(lines, "ord int, text string, collection string, condition string")
    bindings = orders.select(F.col("o_orderkey").alias("model_id"), F.lit("Number").alias("name"), F.col("o_orderkey").cast("string").alias("value"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("model_id"), F.lit("Lines").alias("collection"), n.alias("item_no"), F.create_map(F.lit("Part"), F.col("l_partkey").cast("string")).alias("values"))
    conditions = orders.select(F.col("o_orderkey").alias("model_id"), F.lit("Open").alias("condition"), (F.col("o_orderstatus") != "F").alias("value"))
    return templates.render(template, orders.select(F.col("o_orderkey").alias("model_id")), bindings, conditions, items).select("model_id", "text")


@query("SELECT doc_id, source FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality = 1, true)")
def template_condition(spark, d):
    regions = table(spark, d, "documents").select("doc_id", F.lit("good").alias("condition"), "source")
    known = table(spark, d, "labels").select("doc_id", F.lit("good").alias("condition"), (F.col("quality") == 1).alias("value"))
    return templates.keep_regions(regions, known, ["doc_id"]).select("doc_id", "source")
