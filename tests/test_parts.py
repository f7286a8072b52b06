import base64
import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from pagemill.sources import doc, docx, package, parts


def packed(data: bytes) -> bytes:
    """A macro container of literal bytes."""
    out = b"\x01"
    for i in range(0, len(data), 3000):
        tokens = b"".join(b"\0" + data[j : min(j + 8, i + 3000)] for j in range(i, min(i + 3000, len(data)), 8))
        out += struct.pack("<H", 0xB000 | (len(tokens) - 1)) + tokens
    return out


def zipped(files: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_compound_files():
    streams = {"a": b"x", "Folder/b": b"y" * 5000, "Folder/Deep/c": bytes(range(256)) * 15, "empty": b"", "long name": b"z" * 70_000, **{f"s{k}": bytes([k]) * k for k in range(40)}}
    raw = parts.compound_bytes(streams)
    file = package.CompoundFile(raw)
    assert {n: file.read(n) for n in file.streams} == streams and raw == parts.compound_bytes(streams)


def project(code: str, page: int = 1252) -> bytes:
    record = lambda kind, data: struct.pack("<HI", kind, len(data)) + data
    directory = record(0x0003, struct.pack("<H", page)) + struct.pack("<HIIH", 0x0009, 4, 1, 2)
    directory += record(0x0019, b"Module1") + record(0x001A, b"Stream1") + record(0x0031, struct.pack("<I", 3)) + record(0x0021, b"") + record(0x002B, b"")
    directory += record(0x0019, b"ThisDocument") + record(0x001A, b"ThisDocument") + record(0x0031, struct.pack("<I", 0)) + record(0x0022, b"") + record(0x002B, b"")
    return parts.compound_bytes({"VBA/dir": packed(directory), "VBA/Stream1": b"xyz" + packed(code.encode(f"cp{page}")), "VBA/ThisDocument": packed(b"")})


def test_macros(spark):
    code = "Sub A()\r\n    MsgBox \"h\u00e9\"\r\nEnd Sub\r\n" * 100
    want = [("Module1", "standard", "Stream1", code), ("ThisDocument", "class", "ThisDocument", "")]
    assert list(parts.macros(project(code))) == want
    files = spark.createDataFrame([("a", bytearray(zipped({"[Content_Types].xml": "<Types/>", "word/vbaProject.bin": project(code)}))), ("none", bytearray(zipped({"x.xml": "<x/>"}))), ("bad", bytearray(b"nope")), ("null", None)], "path string, content binary")
    rows = parts.read(files, "macros").collect()
    assert sorted((r.path, r.module, r.error is None) for r in rows) == [("a", "Module1", True), ("a", "ThisDocument", True), ("bad", None, False), ("null", None, False)]
    assert parts.macro_listing(want).startswith("' Module1\nSub A()")
    with pytest.raises(Exception, match="compound"):
        parts.read(files, "macros", mode="FAILFAST").count()


def test_charts(spark):
    xml = parts.chart_xml([("S & 1", ["a", "b<"], [1.5, None]), ("S2", ["a"], [2.0])], "lineChart", "Title")
    points = [("", "line", "Title", 0, "S & 1", 0, "a", 1.5, None), ("", "line", "Title", 0, "S & 1", 1, "b<", None, None), ("", "line", "Title", 1, "S2", 0, "a", 2.0, None)]
    assert list(parts.chart_points(xml)) == points
    changed = parts.with_chart_data(xml, [(["x"], [9.0]), (["y", "z"], [1.0, 2.0])])
    assert [(p[4], p[6], p[7]) for p in parts.chart_points(changed)] == [("S & 1", "x", 9.0), ("S2", "y", 1.0), ("S2", "z", 2.0)]
    with pytest.raises(ValueError, match="2 series"):
        parts.with_chart_data(xml, [])
    files = spark.createDataFrame([(1, bytearray(zipped({"word/charts/chart1.xml": xml})))], "path int, content binary")
    assert [tuple(r)[2:] for r in parts.read(files, "charts").orderBy("series_no", "i").collect()] == [(*p[1:], None) for p in points]


def test_property_sets():
    values = {2: (30, struct.pack("<I", 4) + b"T\xe9x\0"), 14: (3, struct.pack("<i", -7)), 12: (64, struct.pack("<Q", 133_000_000_000_000_000)), 5: (11, struct.pack("<H", 0xFFFF)), 9: (5, struct.pack("<d", 2.5)), 7: (31, struct.pack("<I", 3) + "aé\0".encode("utf-16-le")), 3: (0, b""), 8: (9999, b"")}
    values[1] = (2, struct.pack("<H", 1252))
    head, body, at = b"", b"", 8 + 8 * len(values)
    for i, (kind, data) in values.items():
        item = struct.pack("<HH", kind, 0) + data
        item += b"\0" * (-len(item) % 4)
        head, body = head + struct.pack("<II", i, at + len(body)), body + item
    raw = struct.pack("<HHI16sI", 0xFFFE, 0, 0, b"", 1) + parts.SUMMARY_ID + struct.pack("<I", 48) + struct.pack("<II", 8 + len(head) + len(body), len(values)) + head + body
    got = {p: (k, v) for _, _, p, k, v in parts.property_set(raw)}
    assert got == {"title": ("text", "Téx"), "numpages": ("integer", "-7"), "createdate": ("date", "2022-06-18 04:26:40"), "keywords": ("boolean", "true"), "revision": ("real", "2.5"), "template": ("text", "aé"), "subject": ("empty", "")}
    assert len(list(parts.summary(parts.compound_bytes({"\x05SummaryInformation": raw})))) == 7
    with pytest.raises(ValueError):
        list(parts.property_set(b"x" * 40))


def test_embedded_signed_and_extended():
    native = struct.pack("<IH", 0, 2) + b"a.txt\0C:\\a.txt\0" + struct.pack("<HHI", 0, 3, 4) + b"tmp\0" + struct.pack("<I", 5) + b"hello"
    body = b"<x/>"
    digest = base64.b64encode(hashlib.sha256(body).digest()).decode()
    signature = f'<Signature xmlns="{parts.DS[1:-1]}"><SignedInfo/><Object><Manifest>' + "".join(f'<Reference URI="{u}?ContentType=a"><DigestMethod Algorithm="http://x#sha256"/><DigestValue>{d}</DigestValue></Reference>' for u, d in (("/word/a.xml", digest), ("/word/b.xml", digest), ("/word/gone.xml", digest))) + f"</Manifest><SigningTime>2026</SigningTime></Object><KeyInfo><X509Certificate>{base64.b64encode(b'cert').decode()}</X509Certificate></KeyInfo></Signature>"
    extension = '<we:webextension xmlns:we="urn:we" id="{1}"><we:reference id="wa1" version="1.0" store="en" storeType="OMEX"/><we:properties><we:property name="n" value="v"/></we:properties></we:webextension>'
    document = '<w:document xmlns:w="urn:w" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><o:OLEObject ProgID="Package" r:id="r1"/></w:document>'
    rels = f'<Relationships xmlns="{package.REL[1:-1]}"><Relationship Id="r1" Type="t" Target="embeddings/o.bin"/></Relationships>'
    raw = zipped({"word/document.xml": document, "word/_rels/document.xml.rels": rels, "word/embeddings/o.bin": parts.compound_bytes({"\x01Ole10Native": native}), "word/embeddings/s.xlsx": b"sheet", "word/a.xml": body, "word/b.xml": b"<y/>", "_xmlsignatures/sig1.xml": signature, "word/webextensions/webextension1.xml": extension, "word/media/i.png": b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 3, 4)})
    assert list(parts.embedded(raw)) == [("/word/embeddings/o.bin", "Package", "a.txt", 5, hashlib.sha256(b"hello").hexdigest()), ("/word/embeddings/s.xlsx", None, "s.xlsx", 5, hashlib.sha256(b"sheet").hexdigest())]
    assert [(r[1], r[4], r[5], r[6]) for r in parts.signatures(raw)] == [(p, same, "2026", hashlib.sha256(b"cert").hexdigest()) for p, same in (("/word/a.xml", True), ("/word/b.xml", False), ("/word/gone.xml", False))]
    assert list(parts.web_extensions(raw)) == [("/word/webextensions/webextension1.xml", "{1}", "1.0", "en", "OMEX", "n", "v")]
    assert [r[1:4] for r in parts.images(raw)] == [("png", 3, 4)]
    manifest = '<OfficeApp xmlns="urn:o" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:type="TaskPaneApp"><Id>7</Id><Version>1.2</Version><ProviderName>P</ProviderName><DefaultLocale>en-US</DefaultLocale><DisplayName DefaultValue="N"/><DefaultSettings><SourceLocation DefaultValue="https://s"/></DefaultSettings></OfficeApp>'
    assert list(parts.add_in(manifest.encode())) == [("7", "1.2", "P", "en-US", "N", "TaskPaneApp", "https://s")]
    lock = b"12345678" + zlib.compress(b'<l:locks xmlns:l="u"><l:user name="A">text</l:user></l:locks>')
    assert list(parts.lock_fields(lock)) == [("/locks/user", "name", "A"), ("/locks/user", None, "text")]


def test_legacy_documents(spark):
    texts = ["first", "", "tab\tand\nline", "é€😀 after"]
    assert [(r[1], r[2], r[3]) for r in doc.blocks(doc.write(texts))] == [("body", "paragraph", t) for t in texts]
    assert doc.visible("a\x13 PAGE \x14 5\x15 b\x01") == "a 5 b"
    files = spark.createDataFrame([("a", bytearray(doc.write(["x"]))), ("bad", bytearray(parts.compound_bytes({"x": b"y"})))], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in doc.read(files).collect()}
    assert got["a"] == ("x", None) and "no document stream" in got["bad"][1]


def test_docx_writing(spark):
    url = "http://u/?a=1&b"
    rows = [(1, 0, "paragraph", "Title \"1\"", "plain bold link end", [(6, 4, True, False, None), (11, 4, False, True, url)], None, None), (1, 1, "paragraph", None, "item", None, 5, 1), (1, 2, "table", None, "a\tb\nc\td", None, None, None), (2, 0, "paragraph", None, None, None, None, None)]
    blocks = spark.createDataFrame(rows, "doc_id int, ord int, kind string, style string, text string, runs array<struct<start:int,length:int,bold:boolean,italic:boolean,url:string>>, num_id int, level int")
    levels = spark.createDataFrame([(5, 0, 1, "decimal", "%1.", None, False), (5, 1, 3, "lowerLetter", "%2)", 0, True)], "num_id int, level int, start int, format string, text string, restart_after int, legal boolean")
    files = docx.write(blocks, levels=levels).cache()
    read = lambda what: [tuple(r)[:-1] for r in docx.read(files.where("doc_id = 1"), what, "doc_id").where("error is null").collect()]
    assert [(r[4], r[5], r[7], r[8], r[9], r[11]) for r in read("runs") if r[2] == 0] == [(0, 6, None, None, None, "plain "), (6, 4, True, None, None, "bold"), (10, 1, None, None, None, " "), (11, 4, None, True, url, "link"), (15, 4, None, None, None, " end")]
    got = read("blocks")
    assert (got[0][4], got[1][5], got[1][6]) == ('Title "1"', 5, 1) and [r[7] for r in read("cells")] == ["a", "b", "c", "d"]
    assert read("levels") == [(1, 5, 0, 1, "decimal", "%1.", None, False), (1, 5, 1, 3, "lowerLetter", "%2)", 0, True)] and 'Title "1"' in [r[1] for r in read("styles")]
    raw = bytes(files.where("doc_id = 1").first().content)
    kept = package.Package(docx.with_parts(raw, {"/word/extra.bin": b"x", "/word/styles.xml": None, "/word/document.xml": b"<a/>"}))
    old = package.Package(raw)
    assert kept.read("/word/extra.bin") == b"x" and kept.read("/word/styles.xml") is None and kept.read("/word/document.xml") == b"<a/>" and kept.read("/word/numbering.xml") == old.read("/word/numbering.xml")
