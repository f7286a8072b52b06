import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.operators import budget, editing, field_update, fields, merge, numbering, references, revisions, search, styles, tables, templates
from pagemill.operators.numbering import cardinal, number_text, ordinal_words


def test_search_and_replace(spark):
    rows = spark.createDataFrame([(1, "body", "Über über, uber. $1"), (2, "header", "über")], "id int, story string, text string")
    found = search.find(rows, "über", whole_word=True).orderBy("id", "start").collect()
    assert [(r.id, r.start, r.value) for r in found] == [(1, 0, "Über"), (1, 5, "über"), (2, 0, "über")]
    assert search.find(rows, "über", secondary_stories=False).count() == 2
    assert search.find(rows, "$1").count() == 1
    out = search.replace(rows, r"(\w)ber", "$1-", regex=True).where("id = 1").first()
    assert (out.text, out.n_replaced) == ("Ü- ü-, u-. $1", 3)
    with pytest.raises(ValueError):
        search.find(rows, "")


def test_highlight_and_splice(spark):
    rows = spark.sql("SELECT 'abcdef' AS text, array(named_struct('start', 0, 'length', 6, 'format', named_struct('bold', true, 'highlight', cast(null as string)))) AS runs")
    out = search.highlight(rows, "cd").first()
    assert [(r.start, r.length, r.format.highlight) for r in out.runs] == [(0, 2, None), (2, 2, "yellow"), (4, 2, None)] and out.n_highlighted == 1
    assert spark.range(1).select(search.splice(F.lit("abc"), F.lit(1), F.lit(99), F.lit("X"))).first()[0] == "aX"


def grid(spark, rows):
    cells = [(1, r, c, span, text) for r, row in enumerate(rows, 1) for c, (span, text) in enumerate(row, 1)]
    return tables.with_grid(spark.createDataFrame(cells, "t int, row_no int, cell_no int, grid_span int, text string"), ["t"])


def walked(spark, rows, kind, direction, at):
    return tables.directional(grid(spark, rows), ["t"], kind, direction).where(f"row_no = {at[0]} and cell_no = {at[1]}").first().value


def test_table_formulas(spark):
    column = [[(1, "10")], [(1, "20")], [(1, "12.5")], [(1, "=")]]
    assert walked(spark, column, "SUM", "ABOVE", (4, 1)) == 42.5
    assert walked(spark, [[(2, "10"), (1, "5"), (1, "=")]], "SUM", "LEFT", (1, 3)) == 15
    blank = [[(1, "3")], [(1, "4")], [(1, "")], [(1, "=")]]
    assert walked(spark, blank, "COUNT", "ABOVE", (4, 1)) == 3 and walked(spark, blank, "MIN", "ABOVE", (4, 1)) == 0
    assert walked(spark, [[(1, "3")], [(1, "x")], [(1, "")], [(1, "=")]], "SUM", "ABOVE", (4, 1)) == 0
    assert walked(spark, column, "PRODUCT", "BELOW", (1, 1)) == 250
    swallowed = [[(1, "10000000000000000")], [(1, "n/a")], [(1, "0.1")], [(1, "0.2")], [(1, "=")]]
    assert abs(walked(spark, swallowed, "SUM", "ABOVE", (5, 1)) - 0.3) < 1e-12 and abs(walked(spark, swallowed, "AVERAGE", "ABOVE", (5, 1)) - 0.15) < 1e-12
    assert walked(spark, [[(1, "-3")], [(1, "4")], [(1, "")], [(1, "=")]], "MAX", "ABOVE", (4, 1)) == 4 and walked(spark, blank, "PRODUCT", "ABOVE", (4, 1)) == 0
    assert walked(spark, blank, "MAX", "ABOVE", (1, 1)) is None and walked(spark, blank, "PRODUCT", "ABOVE", (1, 1)) == 1
    spans = grid(spark, [[(2, "100"), (1, "7")]])
    assert [r.grid_col for r in spans.orderBy("cell_no").collect()] == [1, 3]
    assert tables.aggregate_range(spans, ["t"], "SUM", (1, 1), (1, 3)).first().value == 107
    assert tables.range_values(spans, (None, 2), (None, 2)).count() == 1


def test_table_edits(spark):
    g = grid(spark, [[(1, "a"), (1, "b")], [(1, "c"), (1, "d")]]).select("t", "row_no", "cell_no", "grid_span", "text")
    assert tables.table_text(tables.insert_column(g, ["t"], 2, "x"), ["t"]).first().text == "a\tx\tb\nc\tx\td"
    assert tables.table_text(tables.remove_column(g, ["t"], 1), ["t"]).first().text == "b\nd"
    merged = tables.merge_cells(g, (1, 2), (1, 2)).orderBy("row_no").collect()
    assert [(r.grid_span, r.v_merge) for r in merged] == [(2, "restart"), (2, "continue")]


def test_instructions():
    got = fields.parse_instruction(r'IF "a b" = "c\"d" \* MERGEFORMAT \# 0.00 \h')
    assert got["name"] == "IF" and got["args"] == ["a b", "=", 'c"d'] and got["switches"] == [{"name": "*", "arg": "MERGEFORMAT"}, {"name": "#", "arg": "0.00"}, {"name": "h", "arg": None}]
    assert fields.parse_instruction(" =SUM(ABOVE) ")["args"] == ["SUM(ABOVE)"] and fields.parse_instruction("  ") is None
    assert fields.field_spans([(0, "begin"), (2, "begin"), (4, "separate"), (5, "end"), (7, "separate"), (9, "end"), (10, "begin")]) == [(0, 7, 9), (2, 4, 5)]


def test_instructions_as_expressions(spark):
    texts = [r'IF "a b" = "c\"d" \* MERGEFORMAT \# 0.00 \h', " =SUM(ABOVE) ", "  ", "", None, r'= 1 + 2 \# "0.0 x"', r"date \@ 'x' \* Upper", r'SEQ a \r 3 \n', r'"quoted name" \r', 'QUOTE "a', r"\x y", r'REF b \h \* "first cap" z', r'QUOTE ""', r"SET \foo bar", "SEQ\n\tx"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(fields.instruction(F.col("t"))).collect()]
    for t, r in zip(texts, got, strict=True):
        want = fields.parse_instruction(t) or {"name": None, "args": None, "switches": None}
        assert r.asDict(recursive=True) == want, t


def test_properties(spark):
    f = spark.createDataFrame([(1, "TITLE", []), (1, "DOCPROPERTY", ["Client"]), (1, "DOCVARIABLE", ["V"]), (1, "QUOTE", ["q"]), (1, "PAGE", [])], "doc_id int, name string, args array<string>")
    p = spark.createDataFrame([(1, "title", "T"), (1, "client", "C")], "doc_id int, property string, value string")
    v = spark.createDataFrame([(1, "v", "W")], "doc_id int, name string, value string")
    got = {r.name: (r.result, r.dirty) for r in fields.evaluate_properties(f, p, v).collect()}
    assert got == {"TITLE": ("T", False), "DOCPROPERTY": ("C", False), "DOCVARIABLE": ("W", False), "QUOTE": ("q", False), "PAGE": (None, True)}


def test_numbering(spark):
    assert [number_text(4, k) for k in ("decimalZero", "lowerRoman", "upperLetter", "ordinal", "none", "decimalEnclosedCircle")] == ["04", "iv", "D", "4th", "", "④"]
    assert (cardinal(1234), ordinal_words(21), ordinal_words(30), ordinal_words(100)) == ("one thousand two hundred thirty-four", "twenty-first", "thirtieth", "one hundredth")
    levels = spark.createDataFrame([(1, 0, 1, "upperRoman", "%1.", None, False), (1, 1, 5, "decimal", "%1.%2", None, True), (1, 2, 1, "lowerLetter", "%3)", 0, False), (2, 0, 1, "bullet", "-", None, False)], "num_id int, level int, start int, format string, text string, restart_after int, legal boolean")
    order = [(1, 0), (1, 1), (1, 2), (1, 1), (1, 0), (1, 1), (1, 2), (2, 0), (0, 0)]
    items = spark.createDataFrame([(9, k, n, lv) for k, (n, lv) in enumerate(order)], "doc_id long, ord int, num_id int, level int")
    got = [r.label for r in numbering.list_labels(items, levels).orderBy("ord").collect()]
    assert got == ["I.", "1.5", "a)", "1.6", "II.", "2.5", "b)", "-"]


def test_numbering_of_documents(spark):
    """Two documents that define number 1 differently, one with an override, and a third without a definition."""
    levels = spark.createDataFrame([(1, 1, 0, 1, "decimal", "%1.", None, False, None), (2, 1, 0, 1, "upperRoman", "%1)", None, False, 4), (None, 2, 0, 1, "lowerLetter", "%1", None, False, None)], "doc_id long, num_id int, level int, start int, format string, text string, restart_after int, legal boolean, start_override int")
    items = spark.createDataFrame([(d, k, n, 0) for d in (1, 2, 3) for k, n in enumerate((1, 1, 2))], "doc_id long, ord int, num_id int, level int")
    got = {(r.doc_id, r.ord): r.label for r in numbering.list_labels(items, levels).collect()}
    assert [got[d, k] for d in (1, 2, 3) for k in range(3)] == ["1.", "2.", "a", "IV)", "V)", "a", "1.", "2.", "a"]


def test_templates(spark):
    values = F.create_map(F.lit("Name"), F.lit("{{x}}"))
    row = spark.range(1).select(templates.filled(F.lit("a {{Name}}{{ Lines.Name }} {{no}} {{"), values), templates.unresolved(F.lit("{{b}}{{a}}{{Name}}"), values)).first()
    assert list(row) == ["a {{x}}{{x}} {{no}} {{", ["a", "b"]]
    schema = spark.sql("SELECT 'a' AS s, true AS b, cast('x' AS binary) AS p, array(named_struct('q', 1)) AS r, 1 AS n").schema
    assert templates.binder(schema) == {"s": "text", "b": "condition", "p": "picture", "r": "rows", "n": "text"}


def test_revisions(spark):
    segments = spark.createDataFrame([(1, 0, 0, None, "a "), (1, 0, 1, "del", "old"), (1, 0, 2, "ins", "new"), (1, 1, 0, None, "b"), (1, 2, 0, "ins", "c")], "doc_id int, para int, seg int, kind string, text string")
    marks = spark.createDataFrame([(1, 0, "del"), (1, 1, None), (1, 2, "ins")], "doc_id int, para int, mark string")
    accepted = [r.text for r in revisions.resolve(segments, marks).orderBy("para").collect()]
    rejected = [r.text for r in revisions.resolve(segments, marks, False).orderBy("para").collect()]
    assert accepted == ["a newb", "c"] and rejected == ["a old", "b", ""]
    assert revisions.resolved_count(segments, marks).first().n == 5 and revisions.has_revisions(segments, marks).first().has_revisions
    assert revisions.record("abcd", 1, 2, "X") == [(None, "a"), ("del", "bc"), ("ins", "X"), (None, "d")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_edit_script(a, b):
    script = merge.edit_script(a, b)
    assert [x for k, x in script if k != "ins"] == a and [x for k, x in script if k != "del"] == b
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert sum(k == "same" for k, _ in script) == best[-1][-1]


def test_compare(spark):
    a = spark.createDataFrame([(1, 0, "one two three"), (1, 1, "stays"), (2, 0, "same")], "doc_id int, ord int, text string")
    b = spark.createDataFrame([(1, 0, "one 2 three"), (1, 1, "stays"), (1, 2, "new"), (2, 0, "same")], "doc_id int, ord int, text string")
    out = merge.compare(a, b)
    segments = out.where("kind is null or kind not like 'mark%'")
    marks = out.groupBy("doc_id", "para").agg(F.max(F.regexp_extract("kind", "mark-(.*)", 1)).alias("m")).select("doc_id", "para", F.nullif("m", F.lit("")).alias("mark"))
    text = lambda accept: {r.doc_id: r.text for r in search.joined_text(revisions.resolve(segments, marks, accept), ["doc_id"], order="para").collect()}
    assert text(True) == {1: "one 2 three\nstays\nnew", 2: "same"}
    assert {k: v.rstrip("\n") for k, v in text(False).items()} == {1: "one two three\nstays", 2: "same"}


def test_merging(spark):
    style = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None), ("e", "d")], "id string, based_on string")
    assert {r.style: r.chain for r in merge.based_on_chains(style).collect()} == {"a": ["a", "b", "c"], "b": ["b", "c", "a"], "c": ["c", "a", "b"], "d": ["d"], "e": ["e", "d"]}
    long = spark.createDataFrame([(d, f"s{k}", f"s{k + 1}") for d in (1, 2) for k in range(60 * d)], "doc_id int, id string, based_on string")
    got = {(r.doc_id, r.style): r.chain for r in merge.based_on_chains(long, ["doc_id"]).collect()}
    assert got[1, "s0"] == [f"s{k}" for k in range(60)] and got[2, "s100"] == [f"s{k}" for k in range(100, 120)]


def test_budgets(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "abc")], "doc_id int, text string")
    assert [(r.doc_id, r.limit_name, r.observed) for r in budget.text_rejects(docs, {"lines": 1, "text_characters": 3}).collect()] == [(1, "lines", 2)]
    with pytest.raises(ValueError):
        budget.validated({"lines": 0})
    with pytest.raises(budget.BudgetExceeded) as e:
        budget.ensure("lines", 3, {"lines": 2})
    assert (e.value.name, e.value.limit, e.value.observed) == ("lines", 2, 3)


def test_styles(spark):
    layers = "named_struct('bold', {}, 'size', {})"
    rows = spark.sql("SELECT " + ", ".join(f"{layers.format(b, s)} AS {n}" for n, b, s in (("d", "cast(null as boolean)", "10"), ("t", "true", "cast(null as int)"), ("p", "true", "12"), ("c", "cast(null as boolean)", "cast(null as int)"), ("x", "cast(null as boolean)", "14"))))
    out = rows.select(styles.resolved(F.col("d"), F.col("t"), F.col("p"), F.col("c"), F.col("x"), ["bold", "size"]).alias("r")).first().r
    assert (out.bold, out.size) == (False, 14)
    runs = spark.sql("SELECT array(named_struct('start', 0, 'length', 2, 'format', 'a'), named_struct('start', 2, 'length', 0, 'format', 'b'), named_struct('start', 2, 'length', 3, 'format', 'a')) AS r").select(styles.coalesce_runs(F.col("r"))).first()[0]
    assert [(r.start, r.length) for r in runs] == [(0, 5)]


def paragraph(spark):
    return spark.sql("""SELECT 1 AS doc_id, 0 AS para_id, 'abcdef' AS text, array(named_struct('start', 0, 'length', 3, 'format', 'x'), named_struct('start', 3, 'length', 3, 'format', 'y')) AS runs,
    array(named_struct('offset', 2, 'what', 'o')) AS objects, array(named_struct('offset', 1, 'kind', 'bookmark_start'), named_struct('offset', 3, 'kind', 'bookmark_end')) AS marks,
    array(named_struct('start', 2, 'length', 2, 'kind', 'link', 'id', 5)) AS ranges""")


def shape(r):
    return r.text, [tuple(x) for x in r.runs], [tuple(x) for x in r.objects], [tuple(x)[:2] for x in r.marks], [(x.start, x.length) for x in r.ranges]


def test_splices_move_what_is_anchored(spark):
    p = paragraph(spark)
    same = shape(p.first())
    assert shape(editing.spliced(p, 3, 0, "").first()) == same
    # Replacing a range as a whole leaves it over the replacement, in the format of its start.
    assert shape(editing.spliced(p, 2, 2, "XYZ").first()) == ("abXYZef", [(0, 5, "x"), (5, 2, "y")], [], [(1, "bookmark_start"), (5, "bookmark_end")], [(2, 3)])
    assert shape(editing.insert_text(p, 2, "--").first()) == ("ab--cdef", [(0, 5, "x"), (5, 3, "y")], [(4, "o")], [(1, "bookmark_start"), (5, "bookmark_end")], [(2, 4)])
    assert shape(editing.insert_text(p, 4, "-").first())[-1] == [(2, 2)] and shape(editing.insert_text(p, 0, "-", F.lit("z")).first())[1] == [(0, 1, "z"), (1, 3, "x"), (4, 3, "y")]
    assert shape(editing.remove_text(p, 1, 99).first()) == ("a", [(0, 1, "x")], [], [(1, "bookmark_start"), (1, "bookmark_end")], [(1, 0)])
    assert shape(editing.append_text(p, "\t").first())[:2] == ("abcdef\t", [(0, 3, "x"), (3, 4, "y")])
    got = editing.insert_object(p, 2, F.struct(F.lit(0).alias("offset"), F.lit("new").alias("what"))).first()
    assert got.text == "ab\ufffccdef" and [tuple(o) for o in got.objects] == [(2, "new"), (3, "o")]
    assert [tuple(r) for r in editing.apply_format(p, 2, 2, lambda f: F.upper(f)).first().runs] == [(0, 2, "x"), (2, 1, "X"), (3, 1, "Y"), (4, 2, "y")]
    assert editing.remove_where(p, "marks", lambda m: m["kind"] == "bookmark_end").first().marks[0].offset == 1
    empty = editing.spliced(spark.sql("SELECT cast(null as string) AS text, cast(null as array<struct<start:int,length:int,format:string>>) AS runs"), 5, 5, "new").first()
    assert empty.text == "new" and [tuple(r) for r in empty.runs] == [(0, 3, None)]


def test_splices_keep_runs_over_the_text(spark):
    """Every splice of the paragraph, two of them in turn."""
    edits = spark.createDataFrame([(s, c, n) for s in range(-1, 8) for c in range(8) for n in ("", "x", "yz")], "s int, c int, n string")
    p = paragraph(spark).crossJoin(edits)
    for r in editing.spliced(editing.spliced(p, F.col("s"), F.col("c"), F.col("n")), F.col("c"), 2, "w").collect():
        s = max(r.s, 0)
        want = "abcdef"[: min(s, 6)] + r.n + "abcdef"[min(s, 6) + r.c :]
        want = want[: r.c] + "w" + want[r.c + 2 :]
        at = 0
        for run in r.runs:
            assert run.start == at and run.length > 0
            at += run.length
        assert r.text == want and at == len(want)


def test_comments_and_notes(spark):
    paras = spark.createDataFrame([(1, 0, "abcdef", [(1, 4, "link", 9)]), (1, 1, "other", [])], "doc_id int, para_id int, text string, ranges array<struct<start:int,length:int,kind:string,id:int>>")
    comments = spark.createDataFrame([(1, 3, None, "A", "old")], "doc_id int, id int, parent_id int, author string, text string")
    added = spark.createDataFrame([(1, 0, 1, 2, "B", "first"), (1, 0, 2, 4, "C", "second")], "doc_id int, para_id int, start int, length int, author string, text string")
    out, rows = editing.add_comments(paras, comments, added)
    got = {r.para_id: r for r in out.collect()}
    assert got[1].text == "other" and got[0].text == "abc\ufffcdef\ufffc"
    assert [tuple(r) for r in got[0].ranges] == [(1, 5, "link", 9), (1, 2, "comment", 4), (2, 5, "comment", 5)]
    rows = editing.add_replies(rows, spark.createDataFrame([(1, 4, "D", "reply"), (1, 77, "D", "to nothing")], "doc_id int, parent_id int, author string, text string"))
    assert sorted((r.id, r.parent_id, r.text) for r in rows.collect()) == [(3, None, "old"), (4, None, "first"), (5, None, "second"), (6, 4, "reply")]
    notes = spark.createDataFrame([], "doc_id int, kind string, id int, type string, text string")
    notes = editing.add_notes(notes, spark.createDataFrame([(1, "footnote", "a"), (1, "footnote", "b")], "doc_id int, kind string, text string"))
    assert sorted((r.id, r.type) for r in notes.collect()) == [(-1, "separator"), (0, "continuationSeparator"), (1, "normal"), (2, "normal")]
    assert editing.add_notes(notes, spark.createDataFrame([(1, "footnote", "c")], "doc_id int, kind string, text string")).where("type = 'normal'").count() == 3


def test_structure_edits(spark):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate("abc")], "doc_id int, ord int, text string")
    texts = lambda df: "".join(r.text for r in df.orderBy("ord").collect())
    assert texts(editing.insert_after(rows, spark.createDataFrame([(1, 0, "x"), (1, -1, "y")], rows.schema), ["doc_id"])) == "yaxbc"
    assert texts(editing.removed_rows(rows, F.col("text") == "b", ["doc_id"])) == "ac" and texts(editing.cloned(rows, F.col("text") == "b", ["doc_id"])) == "abbc"
    table = editing.add_row(editing.new_table(spark, 1, [["a", "b"]]), ["table_id"], ["c", "d", "e"])
    assert tables.table_text(table, ["table_id"]).first().text == "a\tb\nc\td\te"
    m = F.create_map(F.lit("Client"), F.lit("X"))
    row = spark.range(1).select(editing.with_property(m, "client", "Y").alias("a"), editing.with_property(m, "n", "1").alias("b"), editing.property_of(m, "CLIENT").alias("c"), editing.without_property(m, "client").alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ({"Client": "Y"}, {"Client": "X", "n": "1"}, "X", {})
    assert editing.list_definition(spark, 7, "outline").where("level = 2").first().text == "%1.%2.%3"
    assert fields.parse_instruction(editing.field_instruction("toc", 'a "b"', h=None, general="Upper")) == {"name": "TOC", "args": ['a "b"'], "switches": [{"name": "h", "arg": None}, {"name": "*", "arg": "Upper"}]}


def test_field_update(spark):
    texts = ["Title", "Fig ?, Fig ?? and ? on ?", "sum ?, is ?, see ?"]
    paras = spark.createDataFrame([(1, k, t, "Heading 1" if k == 0 else None) for k, t in enumerate(texts)], "doc_id long, ord long, text string, style string")
    rows = [(1, 0, "SEQ fig", 1, 4, 1), (1, 1, "SEQ fig \\* ROMAN", 1, 11, 2), (1, 2, 'STYLEREF "heading 1" \\* Upper', 1, 18, 1), (1, 3, 'CREATEDATE \\@ "dd.MM.yyyy"', 1, 23, 1)]
    rows += [(1, 4, '= 2 * first + 1 \\# "0.0"', 2, 4, 1), (1, 5, 'IF 3 > 2 "yes, it is" no', 2, 10, 1), (1, 6, "REF Second", 2, 17, 1), (1, 7, "PAGE", 2, 0, 3)]
    f = spark.createDataFrame(rows, "doc_id long, ord long, instruction string, para long, result_start int, result_length int")
    marks = spark.createDataFrame([(1, "first", 1, 4, 1), (1, "second", 1, 7, 6)], "doc_id long, name string, para long, start int, length int")
    props = spark.createDataFrame([(1, "createdate", "2026-01-02 03:04:05")], "doc_id long, property string, value string")
    out, done = field_update.update(paras, f, properties=props, bookmarks=marks)
    got = [r.text for r in out.orderBy("ord").collect()]
    assert got == ["Title", "Fig 1, Fig II and TITLE on 02.01.2026", "sum 3.0, is yes, it is, see Fig II"]
    done = {r.ord: r for r in done.collect()}
    assert done[7].dirty and done[7].result is None and not any(done[k].dirty for k in range(7))
    for k in range(7):
        r = done[k]
        assert got[r.para][r.result_start : r.result_start + r.result_length] == r.result
    stats = {r.property: r.value for r in field_update.document_statistics(out).collect()}
    assert stats["numlines"] == "3" and stats["numwords"] == str(sum(len(t.split()) for t in got))


def test_references(spark):
    refs = spark.createDataFrame([(1, 5, "footnote", 2), (1, 9, "endnote", 1), (1, 3, "endnote", 1), (1, 12, "footnote", 1), (2, 0, "footnote", 2)], "doc_id int, pos int, kind string, id int")
    got = {(r.doc_id, r.pos): (r.number, r.name) for r in references.note_numbers(refs).collect()}
    assert got == {(1, 3): (1, "en-1"), (1, 9): (1, "en-1"), (1, 5): (2, "fn-2"), (1, 12): (3, "fn-1"), (2, 0): (1, "fn-2")}
    marks = references.anchors(spark.createDataFrame([(1, "A b", 0), (1, "a-B!", 1), (1, "c", 2)], "doc_id int, name string, ord int"))
    assert [r.anchor for r in marks.orderBy("ord").collect()] == ["bookmarka-b", "bookmarka-b-1", "bookmarkc"]
    links = spark.createDataFrame([(1, "#a B"), (1, "zz")], "doc_id int, target string")
    assert {r.target: r.anchor for r in references.link_targets(links, marks).collect()} == {"#a B": "bookmarka-b", "zz": None}
    ref = spark.createDataFrame([(1, 0, "r1", "#d1"), (1, 1, "r2", "#d1"), (1, 2, "r3", "#d3")], "page_id int, ord int, ref_id string, href string")
    own = spark.createDataFrame([(1, 5, "d1", "#r1"), (1, 6, "d3", "#r9")], "page_id int, ord int, def_id string, backlink string")
    assert [(r.ref_id, r.def_id) for r in references.note_pairs(ref, own).collect()] == [("r1", "d1")]
    styles = spark.createDataFrame([("b", "table"), ("z", "paragraph"), ("a", "paragraph"), ("c", "other")], "id string, type string")
    assert [r.id for r in references.ordered_styles(styles).orderBy("ord").collect()] == ["a", "z", "b", "c"]
    blocks = spark.createDataFrame([(1, 0, "paragraph", "x"), (1, 1, "section", ""), (1, 2, "object", "y")], "doc_id int, ord int, kind string, text string")
    kept, notes = references.left_behind(blocks, F.col("kind") == "object", F.col("kind"))
    assert kept.count() == 2 and notes.first().subject == "object"
    out = references.appended(kept, kept, start_on_new_page=True, keep_sections=False).orderBy("ord").collect()
    assert [(r.ord, r.kind) for r in out] == [(0, "paragraph"), (1, "section"), (2, "page_break"), (3, "paragraph")]
