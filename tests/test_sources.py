import io
import struct
import zipfile
import zlib

import pytest

from pagemill.sources import docx, html, markdown, package, rtf

TREES = [
    ("<p>1<b>2<i>3</b>4</i>5", '| <html>\n|   <head>\n|   <body>\n|     <p>\n|       "1"\n|       <b>\n|         "2"\n|         <i>\n|           "3"\n|       <i>\n|         "4"\n|       "5"'),
    ("<!DOCTYPE html><title>a&amp;b</title>x", '| <!DOCTYPE html>\n| <html>\n|   <head>\n|     <title>\n|       "a&b"\n|   <body>\n|     "x"'),
    ("<b>1<p>2</b>3", '| <html>\n|   <head>\n|   <body>\n|     <b>\n|       "1"\n|     <p>\n|       <b>\n|         "2"\n|       "3"'),
    ("<table>x<tr><td>a", '| <html>\n|   <head>\n|   <body>\n|     "x"\n|     <table>\n|       <tbody>\n|         <tr>\n|           <td>\n|             "a"'),
    ("<ul><li>a<li>b</ul>c", '| <html>\n|   <head>\n|   <body>\n|     <ul>\n|       <li>\n|         "a"\n|       <li>\n|         "b"\n|     "c"'),
    ("<p>a<div>b</p>c", '| <html>\n|   <head>\n|   <body>\n|     <p>\n|       "a"\n|     <div>\n|       "b"\n|       <p>\n|       "c"'),
    ('<script>"</p>"</script><a href="?a&copy=1">x</a>', '| <html>\n|   <head>\n|     <script>\n|       ""</p>""\n|   <body>\n|     <a>\n|       href="?a&copy=1"\n|       "x"'),
]


@pytest.mark.parametrize(("source", "want"), TREES)
def test_html_trees(source, want):
    assert html.tree(html.parse(source)) == want


def test_html_blocks(spark):
    source = '<h1>Head <em>ing</em></h1><ol><li>a<li>b</ol><script>"</p>"</script><p>see <a href="u">it</a><br>z<a href="javascript:x">bad</a><blockquote>q</blockquote><table><tr><td colspan=2>1<td>2<tr><td>3</table><pre> a\n b</pre>'
    blocks, notes = html.page_blocks(source)
    assert [(b["kind"], b["text"]) for b in blocks] == [("heading", "Head ing"), ("item", "a"), ("item", "b"), ("paragraph", "see it\nzbad"), ("paragraph", "q"), ("table", "1\t\t2\n3"), ("code", " a\n b")]
    assert notes == [("dropped", "script"), ("unsafe-link", "javascript:x")]
    df = spark.createDataFrame([(1, source), (2, None)], "page_id int, html string")
    assert html.blocks(df).where("page_id = 1").count() == 7 and html.nodes(df).where("name = 'a'").count() == 2 and html.diagnostics(df).count() == 2


def test_html_parts():
    assert html.css_declarations("color: red !important; COLOR: blue; a: url(x;y) /* z */") == {"color": "red", "a": "url(x;y)"}
    assert html.decode(b"\xef\xbb\xbfx") == "x" and html.sniff_encoding(b'<meta charset="latin1">') == "windows-1252"
    assert [html.quirks(d) for d in (None, "html", 'html PUBLIC "-//W3C//DTD HTML 3.2 Final//EN"', 'html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN"')] == ["quirks", "none", "quirks", "limited"]


def test_markdown_blocks():
    text = "---\na: 1\n---\n# Head #\n\nPara\nline\n\nSet\n===\n\n- a\n- [x] b\n  - c\n\n1. one\n\n> q1\nq2\n\n```py\ncode\n```\n\n| a | b |\n|---|:-:|\n| 1 | 2\\|3 |\n\n***\n\n[r]: http://u 't'\n[R]: http://v\n[^n]: note\n\n    indented"
    found = markdown.parse_blocks(text)
    assert [(r["kind"], r["text"]) for r in found.rows] == [("heading", "Head"), ("paragraph", "Para\nline"), ("heading", "Set"), ("paragraph", "a"), ("paragraph", "b"), ("paragraph", "c"), ("paragraph", "one"), ("paragraph", "q1\nq2"), ("code", "code"), ("table", "a\tb\n1\t2|3"), ("rule", ""), ("code", "indented")]
    assert found.links == {"r": ("http://u", "t")} and found.notes == {"n": "note"} and found.rows[4]["task"] == "x"


@pytest.mark.parametrize(
    ("source", "plain", "spans"),
    [
        ("**a *b* c**", "a b c", [(0, 5, "strong"), (2, 1, "emphasis")]), ("***a***", "a", [(0, 1, "emphasis"), (0, 1, "strong")]), ("a_b_c", "a_b_c", []), ("`` ` ``", "`", [(0, 1, "code")]), ("[l*i*](u)", "li", [(0, 2, "link"), (1, 1, "emphasis")]),
        ("~~x~~ \\*y\\* &amp;", "x *y* &", [(0, 1, "strike")]), ("![alt](p)", "alt", [(0, 3, "image")]), ("[no]", "[no]", []), ("<http://a.b>", "http://a.b", [(0, 10, "link")]),
    ],
)
def test_markdown_inline(source, plain, spans):
    got, found = markdown.parse_inline(source)
    assert got == plain and sorted((a, n, k) for a, n, k, _ in found) == sorted(spans)


def test_markdown_round_trip(spark):
    df = spark.createDataFrame([(1, "# A\n\npara *x*\n\n- a\n- b\n\n```\ncode\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n")], "doc_id int, text string")
    blocks = markdown.blocks(df)
    assert markdown.to_markdown(blocks).first().text == "# A\n\npara *x*\n\n- a\n- b\n\n```\ncode\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    assert markdown.to_html(blocks).first().html == "<h1>A</h1>\n<p>para <em>x</em></p>\n<ul>\n<li>a\n</li>\n<li>b\n</li>\n</ul>\n<pre><code>code</code></pre>\n<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"


def test_markdown_of_spans(spark):
    """Emphasis, code, links, images, notes and lists survive the way there and back."""
    text = "A **b *c* d** and `x_y` [li*nk*](http://u/a) ![alt](p.png) ~~no~~ 1\\*2 [^n].\n\n1. one\n    - inner **x**\n2. two\n\n> said\n\n[^n]: The *note*.\n"
    blocks = markdown.blocks(spark.createDataFrame([(1, text), (2, "[x](javascript:alert(1)) & < b\n"), (3, None)], "doc_id int, text string"))
    back = {r.doc_id: r.text for r in markdown.to_markdown(blocks).collect()}
    again = markdown.blocks(spark.createDataFrame([(1, back[1])], "doc_id int, text string"))
    assert [tuple(r)[1:] for r in again.orderBy("ord").collect()] == [tuple(r)[1:] for r in blocks.where("doc_id = 1").orderBy("ord").collect()], back[1]
    page = {r.doc_id: r.html for r in markdown.to_html(blocks).collect()}
    assert '<strong>b <em>c</em> d</strong> and <code>x_y</code> <a href="http://u/a">li<em>nk</em></a> <img src="p.png" alt="alt"> <s>no</s> 1*2 <sup><a href="#fn-n" id="ref-n">' in page[1]
    assert "<ol>\n<li>one\n<ul>\n<li>inner <strong>x</strong>" in page[1] and page[1].count("<li>") == page[1].count("</li>") == 3 and page[1].count("<ul>") == page[1].count("</ul>") == 1
    assert '<p id="fn-n">The <em>note</em>.' in page[1] and page[2] == "<p>x &amp; &lt; b</p>"


BODY = """<w:p><w:pPr><w:pStyle w:val="Heading1"/><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr><w:rPr><w:del/></w:rPr></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Bold</w:t></w:r><w:ins w:author="A"><w:r><w:t> in</w:t></w:r></w:ins><w:del><w:r><w:delText> out</w:delText></w:r></w:del></w:p>
<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> =1+1 </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>2</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>
<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"""


def test_docx(spark):
    files = spark.createDataFrame([("a", bytearray(docx.package(BODY))), ("bad", bytearray(b"nope"))], "path string, content binary")
    blocks = docx.read(files).orderBy("path", "ord").collect()
    assert [(b.style, b.num_id, b.level, b.mark, b.text, b.visible) for b in blocks[:2]] == [("Heading1", 3, 1, "del", "Bold in out", "Bold in"), (None, None, None, None, " =1+1 2", "2")]
    assert blocks[-1].path == "bad" and blocks[-1].error
    assert [(c.row_no, c.cell_no, c.grid_span, c.text) for c in docx.read(files, "cells").where("error is null").orderBy("cell_no").collect()] == [(1, 1, 2, "a"), (1, 2, 1, "")]
    assert [(f.instruction, f.result) for f in docx.read(files, "fields").where("error is null").collect()] == [("=1+1", "2")]
    assert docx.read(files, "runs").where("kind = 'ins'").first().author == "A"
    assert {p.part for p in docx.read(files, "parts").where("error is null").collect()} == {"/[Content_Types].xml", "/_rels/.rels", "/word/document.xml"}
    assert docx.read(files, "relationships").where("error is null").first().target == "/word/document.xml"
    with pytest.raises(Exception, match="BadZipFile"):
        docx.read(files, mode="FAILFAST").count()


def test_docx_budget(spark):
    files = spark.createDataFrame([("a", bytearray(docx.package(BODY)))], "path string, content binary")
    assert "xml_depth" in docx.read(files, limits={"xml_depth": 2}).first().error


def test_rtf():
    got = rtf.parse(rb"{\rtf1\ansi{\fonttbl{\f0\fcharset204 X;}}{\*\unknown x}a \b bold\b0  \u8364?\'e9\par {\f0\'e0}\line z\{}")
    assert [t for t, _ in got] == ["a bold €é", "а", "z{"] and got[0][1] == [(2, 4, "bold")]
    texts = ["plain", "tab\there {x} \\", "é€😀", ""]
    assert [t for t, _ in rtf.parse(rtf.write(texts))][:4] == texts
    with pytest.raises(rtf.RtfError):
        rtf.parse(b"nope")


def test_package_parts():
    assert package.resolve_path("/word/document.xml", "media/a%20b.png") == "/word/media/a b.png" and package.resolve_path("/word/document.xml", "../x.xml") == "/x.xml" and package.resolve_path("/word/d.xml", "/../../x") == "/x"
    assert package.safe_media_path("a/b.png") and not any(map(package.safe_media_path, ("../a", "/a", "c:a", "")))
    types = package.ContentTypes(b'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="XML" ContentType="d"/><Override PartName="/A.xml" ContentType="o"/></Types>')
    assert types.of("/a.XML") == "o" and types.of("/b.xml") == "d" and types.of("/c.bin") is None
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 3, 4)
    assert package.image_header(png) == ("png", 3, 4) and package.image_header(b"x") is None
    assert package.lock_file(b"12345678" + zlib.compress(b"<x/>")) == b"<x/>"
    assert package.protection_hash("a", b"s", 2) != package.protection_hash("b", b"s", 2)
    assert package.vba_decompress(bytes([1, 0x19, 0xB0, 0x00]) + b"abcdefgh\x00ijklmnop\x00qrstuv.") == b"abcdefghijklmnopqrstuv."
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.xml", "<!DOCTYPE x><x/>")
    with pytest.raises(ValueError, match="document type"):
        package.Package(raw.getvalue()).xml("/a.xml")


def test_vba_copy_tokens():
    raw = bytes([1, 0x2F, 0xB0, 0x00, 0x23, 0x61, 0x61, 0x61, 0x62, 0x63, 0x64, 0x65, 0x82, 0x66, 0x00, 0x70, 0x61, 0x67, 0x68, 0x69, 0x6A, 0x01, 0x38, 0x08, 0x61, 0x6B, 0x6C, 0x00, 0x30, 0x6D, 0x6E, 0x6F, 0x70, 0x06, 0x71, 0x02, 0x70, 0x04, 0x10, 0x72, 0x73, 0x74, 0x75, 0x76, 0x10, 0x77, 0x78, 0x79, 0x7A, 0x00, 0x3C])
    assert package.vba_decompress(raw) == b"#aaabcdefaaaaghijaaaaaklaaamnopqaaaaaaaaaaaarstuvwxyzaaa"


def test_page_notes():
    page = """<p>One<sup><a id="r1" href="#d1">1</a></sup> and <a href="#d2" id="r2"><sup>2</sup></a> and <sup><a id="r3" href="#d3">3</a></sup><sup><a id="r9" href="#d1">1</a></sup></p>
    <ol><li id="d1">First  <b>note</b>. <a href="#r1">back</a></li><li id="d2">Second<a href="#r2">x</a></li><li id="d3">no way back</li></ol><a href="#d1">plain</a>"""
    assert html.page_notes(page) == [(1, "r1", "d1", "First note."), (2, "r2", "d2", "Second")]
    assert html.page_notes("") == [] and html.page_notes("<sup><a href='#x'>1</a></sup>") == []


def test_files_and_fragments(spark):
    files = spark.createDataFrame([("a", bytearray("\ufeff<p>\u00e9".encode())), ("b", bytearray(b"<meta charset=latin1><p>\xe9")), ("c", None)], "path string, content binary")
    assert {r.path: r.text for r in html.blocks(html.decoded(files), "path").collect()} == {"a": "\u00e9", "b": "\u00e9"}
    assert {r.file: r.text for r in markdown.blocks(markdown.decoded(files.where("path = 'a'")), "file").collect()} == {"a": "<p>\u00e9"}
    rows = html.fragments(spark.createDataFrame([(1, "x <b>y</b><li>z")], "doc_id int, html string")).orderBy("ord").collect()
    assert [(r.kind, r.text) for r in rows] == [("paragraph", "x y"), ("item", "z")]
    assert html.notes(spark.createDataFrame([(1, '<sup><a id="r" href="#d">1</a></sup><p id="d">n <a href="#r">b</a>')], "page_id int, html string")).first().text == "n"


def test_html_closed_references():
    source = "<p title='&amp &lt;'>&amp;&amp &ampx; &copy; &#39;&#39 &nope;</p>"
    p = next(n for n in html.parse(source, closed=True).walk() if n.name == "p")
    assert (p.content(), p.attrs["title"]) == ("&&amp &ampx; \u00a9 '&#39 &nope;", "&amp <")
    assert next(n for n in html.parse(source).walk() if n.name == "p").content() == "&& &x; \u00a9 '' &nope;"
