import math

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.formula import cell_reference, compile_formula, evaluate_formula
from pagemill.functions.pictures import date_format_of, numeric_picture

FORMULAS = [
    ("1/3", 1 / 3), ("2+3*4", 14), ("(2+3)*4", 20), ("-2^2", 4), ("10>3", 1), ("10<3", 0), ("3<>3", 0), ("ABS(-7)", 7), ("INT(7.9)", 7), ("INT(-7.9)", -7),
    ("SIGN(-3)", -1), ("ROUND(3.14159,2)", 3.14), ("ROUND(1234,-2)", 1200), ("ROUND(2.5,0)", 3), ("ROUND(1.005,2)", 1.01), ("MAX(1,7,3)", 7), ("MIN(1,7,3)", 1), ("COUNT(1,7,3)", 3),
    ("SUM(1,7,3)", 11), ("SUM()", 0), ("PRODUCT(2,3,4)", 24), ("AVERAGE(2,4,6)", 4), ("AVERAGE()", None), ("AND(1,0)", 0), ("OR(1,0)", 1), ("NOT(0)", 1), ("TRUE", 1), ("FALSE", 0),
    ("DEFINED(1+1)", 1), ("DEFINED(NoSuchName)", 0), ("MOD(21,5)", 1), ("MOD(21,-5)", 1), ("MOD(-21,5)", -1), ("MOD(-21,-5)", -1), ("MOD(1,0)", None),
    ("1/0", None), ("1<2<3", None), ("1/50%", 2), ("50%%", 0.005), ('"1,250"+1', 1251), ("IF(1>2;3;4)", 4), ("2 +", None), ("Nope", None), ("x*2", 6),
]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_formulas(spark):
    row = spark.range(1).select(*[compile_formula(f, {"x": F.lit(3.0)}).alias(f"c{k}") for k, (f, _) in enumerate(FORMULAS)]).first()
    for (f, want), got in zip(FORMULAS, row, strict=True):
        assert got == want or (want is not None and math.isclose(got, want)), f
        plain = evaluate_formula(f, {"x": 3.0})
        assert plain == want or (want is not None and math.isclose(plain, want)), f


def test_cell_reference():
    assert cell_reference("B3") == (3, 2) and cell_reference("aa10") == (10, 27) and cell_reference("3B") is None


@pytest.mark.parametrize(
    ("value", "picture", "want"),
    [(9, "00.00", "09.00"), (15, "$###", "$ 15"), (222492, "x##", "492"), (95.4, "$###.00", "$ 95.40"), (2456800, "$#,###,###", "$2,456,800"), (-10, "-##", "-10"), (10, "+##", "+10"), (33, "##%", "33%"), (1 / 8, "0.00x", "0.125"), (-5, "0;(0)", "(5)"), (0, "0;(0);'none'", "none"), (-5, "0", "-5")],
)
def test_numeric_pictures(value, picture, want):
    assert numeric_picture(float(value), picture) == want


def test_date_pictures(spark):
    assert date_format_of("dddd, d MMMM yyyy 'at' h:mm AM/PM") == "EEEE, d MMMM yyyy 'at' h:mm a"
    assert one(spark, F.date_format(F.lit("2026-01-02 03:04:05").cast("timestamp"), date_format_of("dd.MM.yyyy HH:mm"))) == "02.01.2026 03:04"


def test_numbers_as_text(spark):
    n = F.lit(14.0)
    row = spark.range(1).select(T.roman(n), F.lower(T.roman(n)), T.alphabetic(n), T.ordinal(n), T.arabic(n), T.hexadecimal(n), T.alphabetic(F.lit(28.0)), T.ordinal(F.lit(111)), T.roman(F.lit(40000)), T.number_text(F.lit(1 / 3)), T.number_text(F.lit(14.00000000001)), T.arabic(F.lit(2.5))).first()
    assert list(row) == ["XIV", "xiv", "N", "14th", "14", "E", "BB", "111th", "40000", "0.3333333333", "14", "2"]


def test_letter_cases(spark):
    s = F.lit("mary smith")
    row = spark.range(1).select(F.upper(s), T.caps(s), T.first_cap(F.lit("mARY Smith")), T.caps(F.lit("o'neil-mc X")), T.general_switch("Caps", s), T.general_switch("none", s)).first()
    assert list(row) == ["MARY SMITH", "Mary Smith", "Mary smith", "O'Neil-Mc X", "Mary Smith", "mary smith"]


@pytest.mark.parametrize(("value", "want"), [*[(v, True) for v in ("1", "true", "on", "True", " true ", "\n1")], *[(v, False) for v in ("0", "false", "off", "False", "\t off\r\n")], *[(v, None) for v in (None, "", "yes", "2")]])
def test_on_off(spark, value, want):
    assert one(spark, T.on_off(F.lit(value).cast("string"))) is want


def test_strings(spark):
    cases = [
        (T.collapse_space(F.lit("\n a\t\t b  c ")), "a b  c "), (T.line_feeds(F.lit("a\r\nb\rc")), "a\nb\nc"), (T.html_escape(F.lit("<é&'\"")), "&lt;&#233;&amp;&#39;&quot;"),
        (T.markdown_escape(F.lit("# a *b*\n1. c")), "\\# a \\*b\\*\n1\\. c"), (T.code_span(F.lit("a``b`")), "``` a``b` ```"), (T.link_destination(F.lit("a b")), "<a b>"), (T.link_destination(F.lit("a\nb")), None),
        (T.anchor_slug(F.lit("My Mark (2)!")), "bookmarkmy-mark-2"), (T.without_front_matter(F.lit("---\nx: 1\n---\nbody")), "body"), (T.without_front_matter(F.lit("---\nx: 1\nbody")), "---\nx: 1\nbody"),
        (T.heading_text(F.lit("## Two ##")), "Two"), (T.heading_level(F.lit("####### x")), None), (T.to_number(F.lit("1,250.5")), 1250.5), (T.to_number(F.lit("1,25")), None),
        (T.unsafe_link(F.lit(" JavaScript:x")), True), (T.fence_mark(F.lit("~~~~ py")), "~~~~"), (T.pipe_cells(F.lit("| a\\|b | c |")), ["a|b", "c"]), (T.to_twips(F.lit(2.54), "cm"), 1440), (T.utf16_offset(F.lit("a😀b"), F.lit(2)), 3),
    ]
    for column, want in cases:
        assert one(spark, column) == want, want
    item = one(spark, T.list_marker(F.lit("  3) [x] do it")))
    assert (item.indent, item.mark, item.task, item.text) == (2, "3)", "x", "do it")


def test_packed_date(spark):
    bits = 34 | 12 << 6 | 25 << 11 | 12 << 16 | 99 << 20
    assert str(one(spark, T.packed_date(F.lit(bits)))) == "1999-12-25 12:34:00" and one(spark, T.packed_date(F.lit(0))) is None


def test_colours(spark):
    import colorsys

    from pagemill.functions import values

    def by_hand(rgb, tint, shade):
        h, light, s = colorsys.rgb_to_hls(*((rgb >> k & 255) / 255 for k in (16, 8, 0)))
        light = light * shade / 255 if shade else light * tint / 255 + 1 - tint / 255
        return sum(math.floor(255 * x + 0.5) << k for x, k in zip(colorsys.hls_to_rgb(h, light, s), (16, 8, 0), strict=True))

    rows = [(c, t, s) for c in (0x4472C4, 0x000000, 0xFFFFFF, 0x808080, 0xED7D31, 0x0000FF) for t, s in ((51, 0), (153, 0), (0, 191), (255, 0), (0, 128))]
    df = spark.createDataFrame(rows, "c int, t int, s int").withColumns({"scheme": F.create_map(F.lit("accent1"), F.col("c")), "mapping": F.create_map(F.lit("text1"), F.lit("accent1"))})
    for r in df.select("*", values.theme_colour(F.lit("text1"), F.col("t"), F.col("s"), F.col("scheme"), F.col("mapping")).alias("got")).collect():
        want = by_hand(r.c, r.t, r.s)
        assert all(abs((r.got >> k & 255) - (want >> k & 255)) <= 1 for k in (16, 8, 0)), r
    assert one(spark, values.theme_colour(F.lit("none"), F.lit(0), F.lit(0), F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("b"), F.lit("a")))) is None


def test_property_texts(spark):
    from pagemill.functions.values import property_text

    rows = [("real", "2.50", "2.5"), ("real", "3.0", "3"), ("integer", "7", "7"), ("boolean", "TRUE", "true"), ("date", "2026-01-02 03:04:05", "2026-01-02T03:04:05Z"), ("empty", "x", ""), ("text", "a", "a"), ("integer", None, "")]
    got = spark.createDataFrame(rows, "k string, v string, want string").select("want", property_text(F.col("k"), F.col("v")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_hyphenation(spark):
    from pagemill.functions.values import Hyphenator, hyphenate

    # The worked example of the published method.
    patterns = ["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n"]
    assert Hyphenator(patterns).hyphenated("Hyphenation", "-") == "Hy-phen-ation"
    assert one(spark, hyphenate(F.lit("hyphenation table, 12"), patterns, ["ta-ble"], mark="-")) == "hy-phen-ation ta-ble, 12"
    assert Hyphenator([]).hyphenated("word") == "word"


def test_registry(spark):
    from pagemill.functions import registry

    names = registry.register(spark, "t_", {"twice": ("int", lambda n: 2 * n)})
    assert names == ["t_date_format_of", "t_formula_value", "t_list_number", "t_numeric_picture", "t_twice"]
    row = spark.sql("SELECT t_formula_value('= 2 * (1 + 3)') AS a, t_numeric_picture(2456800, '$#,###,###') AS b, t_list_number(4, 'upperRoman') AS c, t_twice(3) AS d, t_formula_value(NULL) AS e").first()
    assert tuple(row) == (8.0, "$2,456,800", "IV", 6, None)
