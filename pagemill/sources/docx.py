"""WordprocessingML packages to rows and back.

``read`` turns a ``binaryFile`` DataFrame (path, content) into block rows, one pass for each file; ``rows_of`` says which: blocks,
runs, cells, styles, levels, properties, notes, comments, relationships, parts. A file that can't be read becomes a diagnostic
row (kind, subject), never a failed job, unless mode is FAILFAST.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.package import Package
from pagemill.sources.rows import map_rows

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
UNDERSTOOD = {"wps", "wpg", "wp14", "w14", "w15", "wp", "w"}
OBJECT = "\ufffc"

SCHEMAS = {
    "blocks": "story string, ord int, kind string, style string, num_id int, level int, mark string, text string, visible string, table_no int",
    "runs": "story string, ord int, run_no int, start int, length int, kind string, bold boolean, italic boolean, url string, author string, text string",
    "cells": "table_no int, row_no int, cell_no int, grid_span int, v_merge string, rev string, text string",
    "styles": "id string, name string, type string, based_on string, bold boolean, italic boolean",
    "levels": "num_id int, level int, start int, format string, text string, restart_after int, legal boolean",
    "properties": "property string, value string",
    "notes": "is_endnote boolean, id int, text string",
    "comments": "id int, author string, date string, text string",
    "relationships": "source string, id string, type string, target string, external boolean",
    "parts": "part string, content_type string, size long, content binary",
    "fields": "story string, ord int, seq int, instruction string, result string",
}


def val(e: ET.Element | None, name: str, attr: str = "val") -> str | None:
    c = None if e is None else e.find(W + name)
    return None if c is None else c.get(W + attr)


def on(e: ET.Element | None, name: str) -> bool | None:
    c = None if e is None else e.find(W + name)
    if c is None:
        return None
    v = (c.get(W + "val") or "true").strip().lower()
    return True if v in ("1", "true", "on") else False if v in ("0", "false", "off") else None


def whole(text: str | None, default: int | None = None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return default


def chosen(e: ET.Element) -> Iterator[ET.Element]:
    """The children of the first understood choice, else of the fallback."""
    for c in e.findall(MC + "Choice"):
        if all(x in UNDERSTOOD for x in (c.get("Requires") or "?").split()):
            yield from c
            return
    f = e.find(MC + "Fallback")
    if f is not None:
        yield from f


def math_text(e: ET.Element) -> str:
    """An equation in one line."""
    name, part = e.tag.removeprefix(M), lambda k: "".join(math_text(c) for c in e.findall(M + k))
    wrap = lambda s: s if len(s) < 2 or s.isalnum() else f"({s})"
    if name == "t":
        return e.text or ""
    if name == "f":
        return f"{wrap(part('num'))}/{wrap(part('den'))}"
    if name == "rad":
        return f"√{wrap(part('e'))}" if not part("deg") else f"√[{part('deg')}]{wrap(part('e'))}"
    if name == "sSup":
        return f"{part('e')}^{wrap(part('sup'))}"
    if name == "sSub":
        return f"{part('e')}_{wrap(part('sub'))}"
    if name == "sSubSup":
        return f"{part('e')}_{wrap(part('sub'))}^{wrap(part('sup'))}"
    if name == "nary":
        sign = e.find(f"{M}naryPr/{M}chr")
        return f"{'∫' if sign is None else sign.get(M + 'val')}_{wrap(part('sub'))}^{wrap(part('sup'))} {part('e')}"
    if name == "d":
        return "(" + ",".join(math_text(c) for c in e.findall(M + "e")) + ")"
    if name == "m":
        return "[" + ";".join(",".join(math_text(c) for c in r.findall(M + "e")) for r in e.findall(M + "mr")) + "]"
    return "".join(math_text(c) for c in e if not c.tag.endswith("Pr"))


class Paragraph:
    def __init__(self, e: ET.Element, links: dict[str, tuple[str, str, bool]]):
        self.text, self.runs, self.fields, self.links = "", [], [], links
        pr = e.find(W + "pPr")
        self.style = val(pr, "pStyle")
        num = None if pr is None else pr.find(W + "numPr")
        self.num_id, self.level = whole(val(num, "numId")), whole(val(num, "ilvl"), 0 if num is not None else None)
        marks = None if pr is None else pr.find(W + "rPr")
        self.mark = None if marks is None else "ins" if marks.find(W + "ins") is not None else "del" if marks.find(W + "del") is not None else None
        self.stack: list[list] = []
        self.walk(e, None, None, None)
        self.visible = "".join(t for _, _, kind, _, _, _, _, t in self.runs if kind in (None, "ins", "to")).replace(OBJECT, "")

    def put(self, text: str, kind, bold=None, italic=None, url=None, author=None) -> None:
        if text:
            self.runs.append((len(self.text), len(text), kind, bold, italic, url, author, text))
            self.text += text

    def walk(self, e: ET.Element, kind, url, author) -> None:
        for c in e:
            tag = c.tag
            if tag == W + "r":
                self.run(c, kind, url, author)
            elif tag in (W + "ins", W + "del", W + "moveFrom", W + "moveTo"):
                self.walk(c, {"ins": "ins", "del": "del", "moveFrom": "from", "moveTo": "to"}[tag.removeprefix(W)], url, c.get(W + "author"))
            elif tag == W + "hyperlink":
                self.walk(c, kind, self.links.get(c.get(R + "id") or "", ("", "#" + (c.get(W + "anchor") or ""), True))[1], author)
            elif tag == W + "fldSimple":
                begin = len(self.text)
                self.walk(c, kind, url, author)
                self.fields.append((begin, c.get(W + "instr") or "", self.text[begin:]))
            elif tag == MC + "AlternateContent":
                holder = ET.Element("x")
                holder.extend(list(chosen(c)))
                self.walk(holder, kind, url, author)
            elif tag in (M + "oMath", M + "oMathPara"):
                self.put(math_text(c), kind, url=url, author=author)
            elif tag in (W + "sdt", W + "sdtContent", W + "smartTag", W + "customXml"):
                self.walk(c, kind, url, author)

    def run(self, e: ET.Element, kind, url, author) -> None:
        pr = e.find(W + "rPr")
        bold, italic = on(pr, "b"), on(pr, "i")
        hidden = "hidden" if on(pr, "vanish") and kind is None else kind
        for c in e:
            name = c.tag.removeprefix(W)
            if name == "t":
                instruction = self.stack and self.stack[-1][2] is None
                self.put(c.text or "", "field" if instruction else hidden, bold, italic, url, author)
            elif name == "delText":
                self.put(c.text or "", "del", bold, italic, url, author)
            elif name == "instrText":
                if self.stack:
                    self.stack[-1][1] += c.text or ""
                self.put(c.text or "", "field", bold, italic, url, author)
            elif name == "tab":
                self.put("\t", hidden, bold, italic, url, author)
            elif name in ("br", "cr"):
                self.put("\n", hidden, bold, italic, url, author)
            elif name == "noBreakHyphen":
                self.put("\u2011", hidden, bold, italic, url, author)
            elif name in ("drawing", "pict", "object", "footnoteReference", "endnoteReference", "commentReference", "sym"):
                self.put(OBJECT, hidden, bold, italic, url, author)
            elif name == "fldChar":
                what = c.get(W + "fldCharType")
                if what == "begin":
                    self.stack.append([len(self.text), "", None])
                elif what == "separate" and self.stack:
                    self.stack[-1][2] = len(self.text)
                elif what == "end" and self.stack:
                    begin, instruction, result = self.stack.pop()
                    self.fields.append((begin, instruction, "" if result is None else self.text[result:]))


class Reader:
    def __init__(self, content: bytes, limits: dict | None = None):
        self.package = Package(content, limits)
        root = self.package.relationships()
        self.main = next((t for k, t, _ in root.values() if k.endswith("/officeDocument")), "/word/document.xml")
        self.links = self.package.relationships(self.main)
        if self.package.read(self.main) is None:
            raise ValueError("no main document part")
        self.out: dict[str, list] = {k: [] for k in SCHEMAS}
        self.tables = 0

    def part(self, kind: str) -> str | None:
        return next((t for k, t, external in self.links.values() if k == DOC + kind and not external), None)

    def container(self, e: ET.Element, story: str, state: list[int], table: int | None) -> list[str]:
        texts = []
        for c in e:
            if c.tag == W + "p":
                p = Paragraph(c, self.links)
                k = state[0]
                state[0] += 1
                self.out["blocks"].append((story, k, "paragraph", p.style, p.num_id, p.level, p.mark, p.text, p.visible, table))
                self.out["runs"] += [(story, k, i, *r[:7], r[7]) for i, r in enumerate(p.runs)]
                self.out["fields"] += [(story, k, i, f[1].strip(), f[2]) for i, f in enumerate(sorted(p.fields, key=lambda f: f[0]))]
                texts.append(p.visible)
            elif c.tag == W + "tbl":
                texts.append(self.table(c, story, state))
            elif c.tag in (W + "sdt", W + "sdtContent", W + "customXml", W + "ins", W + "moveTo"):
                texts += self.container(c, story, state, table)
            elif c.tag == MC + "AlternateContent":
                holder = ET.Element("x")
                holder.extend(list(chosen(c)))
                texts += self.container(holder, story, state, table)
            elif c.tag not in (W + "sectPr", W + "sdtPr", W + "sdtEndPr", W + "bookmarkStart", W + "bookmarkEnd", W + "tcPr") and c.tag.startswith(W) and table is None:
                self.out["blocks"].append((story, state[0], "raw", None, None, None, None, "", "", None))
                state[0] += 1
        return texts

    def table(self, e: ET.Element, story: str, state: list[int]) -> str:
        self.tables += 1
        number, lines = self.tables, []
        for r, row in enumerate(e.findall(W + "tr"), 1):
            pr = row.find(W + "trPr")
            rev = None if pr is None else "ins" if pr.find(W + "ins") is not None else "del" if pr.find(W + "del") is not None else None
            line = []
            for k, cell in enumerate(row.findall(W + "tc"), 1):
                tc = cell.find(W + "tcPr")
                merge = None if tc is None or tc.find(W + "vMerge") is None else val(tc, "vMerge") or "continue"
                text = "\n".join(self.container(cell, story, state, number))
                line.append(text)
                self.out["cells"].append((number, r, k, whole(val(tc, "gridSpan"), 1), merge, rev, text))
            lines.append("\t".join(line))
        return "\n".join(lines)

    def read(self, wanted: str) -> list[tuple]:
        package, out = self.package, self.out
        if wanted in ("blocks", "runs", "cells", "fields"):
            body = package.xml(self.main).find(W + "body")
            if body is not None:
                self.container(body, "body", [0], None)
            for kind, story in (("header", "header"), ("footer", "footer")):
                for k, t, external in sorted(self.links.values(), key=lambda x: x[1]):
                    if k == DOC + kind and not external and (root := package.xml(t)) is not None:
                        self.container(root, f"{story}:{t}", [0], None)
        elif wanted == "styles" and (t := self.part("styles")):
            for s in package.xml(t).findall(W + "style"):
                pr = s.find(W + "rPr")
                out["styles"].append((s.get(W + "styleId"), val(s, "name"), s.get(W + "type"), val(s, "basedOn"), on(pr, "b"), on(pr, "i")))
        elif wanted == "levels" and (t := self.part("numbering")):
            root = package.xml(t)
            abstract = {}
            for a in root.findall(W + "abstractNum"):
                abstract.setdefault(a.get(W + "abstractNumId"), a)
            for n in root.findall(W + "num"):
                base = abstract.get(val(n, "abstractNumId"))
                over = {whole(o.get(W + "ilvl")): o for o in n.findall(W + "lvlOverride")}
                levels = {} if base is None else {whole(x.get(W + "ilvl")): x for x in base.findall(W + "lvl")}
                for k in sorted({*levels, *over}):
                    own = over[k].find(W + "lvl") if k in over else None
                    x = own if own is not None else levels.get(k)
                    if x is None:
                        continue
                    start = whole(val(over.get(k), "startOverride"), whole(val(x, "start"), 1))
                    out["levels"].append((whole(n.get(W + "numId")), k, start, val(x, "numFmt") or "decimal", val(x, "lvlText") or "", whole(val(x, "lvlRestart")), bool(on(x, "isLgl"))))
        elif wanted == "properties":
            for kind, t, external in package.relationships().values():
                if external or not kind.endswith(("/core-properties", "/extended-properties", "/custom-properties")):
                    continue
                for e in package.xml(t):
                    name = e.get("name") or e.tag.rpartition("}")[2]
                    out["properties"].append((name, "".join(e.itertext()).strip()))
        elif wanted == "notes":
            for kind, end in (("footnotes", False), ("endnotes", True)):
                if t := self.part(kind):
                    for n in package.xml(t):
                        if n.get(W + "type") in (None, "normal"):
                            out["notes"].append((end, whole(n.get(W + "id")), "\n".join(Paragraph(p, self.links).visible for p in n.findall(W + "p"))))
        elif wanted == "comments" and (t := self.part("comments")):
            for n in package.xml(t).findall(W + "comment"):
                out["comments"].append((whole(n.get(W + "id")), n.get(W + "author"), n.get(W + "date"), "\n".join(Paragraph(p, self.links).visible for p in n.findall(W + "p"))))
        elif wanted == "relationships":
            for source in ["", *sorted(package.names)]:
                if source.endswith(".rels"):
                    continue
                out["relationships"] += [(source, k, *v) for k, v in package.relationships(source).items()]
        elif wanted == "parts":
            for n in sorted(package.names):
                data = package.read(n)
                out["parts"].append((n, package.types.of(n) if package.types else None, len(data), data))
        return out[wanted]


def read(files: DataFrame, rows_of: str = "blocks", id_col: str = "path", limits: dict | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """The rows of every file in files (id, content), with the id before them; unreadable files have error set."""
    schema = SCHEMAS[rows_of]
    width = len(schema.split(","))

    def rows(doc, content: bytes | None) -> list[tuple]:
        try:
            return [(doc, *r, None) for r in Reader(content or b"", limits).read(rows_of)]
        except Exception as e:
            if mode == "FAILFAST":
                raise
            return [(doc, *[None] * width, f"{type(e).__name__}: {e}")]

    return map_rows(files, [id_col, "content"], rows, f"{id_col} {files.schema[id_col].dataType.simpleString()}, {schema}, error string")


def document_text(blocks: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, text): the body's visible paragraphs by line feed."""
    from pagemill.operators.search import joined_text

    return joined_text(blocks.where("story = 'body' and error is null"), [id_col], "visible")


DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.{}+xml"
RELATIONSHIPS = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Characters that XML can't hold.
FORBIDDEN = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff\ud800-\udfff]")
BREAKS = re.compile(r"([\t\n])")


def text_xml(text: str) -> str:
    """A run's text elements; tabs and line feeds are elements of their own."""
    out = FORBIDDEN.sub("", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    if "\t" not in out and "\n" not in out:
        return f'<w:t xml:space="preserve">{out}</w:t>' if out else ""
    return "".join("<w:tab/>" if t == "\t" else "<w:br/>" if t == "\n" else f'<w:t xml:space="preserve">{t}</w:t>' for t in BREAKS.split(out) if t)


def run_xml(text: str, bold: bool | None = None, italic: bool | None = None) -> str:
    pr = ("<w:b/>" if bold else "") + ("<w:i/>" if italic else "")
    return f"<w:r>{f'<w:rPr>{pr}</w:rPr>' if pr else ''}{text_xml(text)}</w:r>"


def attribute(text: str) -> str:
    return escape(FORBIDDEN.sub("", text), {'"': "&quot;"})


def paragraph_xml(text: str, style: str | None = None, bold: bool = False, runs: list[dict] | None = None, num_id: int | None = None, level: int | None = None, links: dict[str, str] | None = None) -> str:
    """A paragraph; runs (start, length, bold, italic, url) cover the text in order, what they leave out is plain. links: url -> relationship."""
    pr = f'<w:pStyle w:val="{attribute(style)}"/>' if style else ""
    if num_id:
        pr += f'<w:numPr><w:ilvl w:val="{level or 0}"/><w:numId w:val="{num_id}"/></w:numPr>'
    out, at = [], 0
    for r in runs or ():
        start, end = max(at, r["start"]), max(at, r["start"] + r["length"])
        if start > at:
            out.append(run_xml(text[at:start], bold))
        if end > start:
            one = run_xml(text[start:end], r["bold"] or bold, r["italic"])
            out.append(f'<w:hyperlink r:id="{links[r["url"]]}">{one}</w:hyperlink>' if links and r["url"] in links else one)
        at = end
    if at < len(text) or not out:
        out.append(run_xml(text[at:], bold))
    return f"<w:p>{f'<w:pPr>{pr}</w:pPr>' if pr else ''}{''.join(out)}</w:p>"


def table_xml(rows: list[list[str]]) -> str:
    body = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph_xml(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    return f"<w:tbl>{body}</w:tbl>"


def styles_xml(styles: list[str]) -> str:
    body = "".join(f'<w:style w:type="paragraph" w:styleId="{attribute(s)}"><w:name w:val="{attribute(s)}"/><w:basedOn w:val="Normal"/></w:style>' for s in styles if s != "Normal")
    return f'{DECLARATION}<w:styles xmlns:w="{W[1:-1]}"><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>{body}</w:styles>'


def numbering_xml(levels: dict[int, list[dict]]) -> str:
    """num_id -> its levels (level, start, format, text, restart_after, legal), each list with a definition of its own."""
    one = lambda v: f'<w:lvl w:ilvl="{v["level"]}"><w:start w:val="{v["start"]}"/><w:numFmt w:val="{attribute(v["format"])}"/>' + (f'<w:lvlRestart w:val="{v["restart_after"]}"/>' if v["restart_after"] is not None else "") + ("<w:isLgl/>" if v["legal"] else "") + f'<w:lvlText w:val="{attribute(v["text"])}"/></w:lvl>'
    abstract = "".join(f'<w:abstractNum w:abstractNumId="{n}">{"".join(map(one, sorted(vs, key=lambda v: v["level"])))}</w:abstractNum>' for n, vs in sorted(levels.items()))
    return f'{DECLARATION}<w:numbering xmlns:w="{W[1:-1]}">{abstract}{"".join(f"""<w:num w:numId="{n}"><w:abstractNumId w:val="{n}"/></w:num>""" for n in sorted(levels))}</w:numbering>'


def package(body: str, styles: list[str] | None = None, levels: dict[int, list[dict]] | None = None, links: dict[str, str] | None = None) -> bytes:
    """A package with that body, the styles and lists it names and the targets of its links; the same bytes for the same input."""
    parts = {"word/document.xml": f'{DECLARATION}<w:document xmlns:w="{W[1:-1]}" xmlns:r="{R[1:-1]}"><w:body>{body}<w:sectPr/></w:body></w:document>'}
    kinds, own = {"document": "document.main"}, []
    for name, kind, xml in (("styles", "styles", styles and styles_xml(styles)), ("numbering", "numbering", levels and numbering_xml(levels))):
        if xml:
            parts[f"word/{name}.xml"], kinds[name] = xml, kind
            own.append(f'<Relationship Id="{name}" Type="{DOC}{name}" Target="{name}.xml"/>')
    own += [f'<Relationship Id="{i}" Type="{DOC}hyperlink" Target="{attribute(u)}" TargetMode="External"/>' for u, i in (links or {}).items()]
    types = "".join(f'<Override PartName="/word/{n}.xml" ContentType="{TYPE.format(k)}"/>' for n, k in kinds.items())
    files = {
        "[Content_Types].xml": f'{DECLARATION}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        "_rels/.rels": f'{DECLARATION}<Relationships xmlns="{RELATIONSHIPS}"><Relationship Id="rId1" Type="{DOC}officeDocument" Target="word/document.xml"/></Relationships>',
    }
    if own:
        files["word/_rels/document.xml.rels"] = f'{DECLARATION}<Relationships xmlns="{RELATIONSHIPS}">{"".join(own)}</Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, data in (files | parts).items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED, 1)
    return out.getvalue()


def with_parts(content: bytes, changed: dict[str, bytes | None]) -> bytes:
    """A package with some parts changed, added or (null) taken out; the bytes of all others are copied as they are."""
    out, left = io.BytesIO(), dict(changed)
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            name = "/" + info.filename.lstrip("/")
            data = left.pop(name) if name in left else old.read(info)
            if data is not None:
                new.writestr(zipfile.ZipInfo(info.filename, info.date_time), data, info.compress_type)
        for name, data in left.items():
            if data is not None:
                new.writestr(zipfile.ZipInfo(name.lstrip("/"), (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def document_package(blocks: list[dict], levels: dict[int, list[dict]] | None = None) -> bytes:
    """blocks: kind, style, text, and maybe runs, num_id and level. List numbers without levels given are decimal."""
    urls = dict.fromkeys(r["url"] for b in blocks for r in b.get("runs") or () if r["url"])
    links = {u: f"link{k}" for k, u in enumerate(urls, 1)}
    styles = list(dict.fromkeys(b["style"] for b in blocks if b["kind"] != "table" and b["style"]))
    numbers = dict.fromkeys(b["num_id"] for b in blocks if b.get("num_id"))
    known = {n: (levels or {}).get(n) or [{"level": k, "start": 1, "format": "decimal", "text": f"%{k + 1}.", "restart_after": None, "legal": False} for k in range(9)] for n in numbers}
    body = "".join(table_xml([r.split("\t") for r in (b["text"] or "").split("\n")]) if b["kind"] == "table" else paragraph_xml(b["text"] or "", b["style"], False, b.get("runs"), b.get("num_id"), b.get("level"), links) for b in blocks)
    return package(body, styles, known, links)


def write(blocks: DataFrame, id_col: str = "doc_id", levels: DataFrame | None = None) -> DataFrame:
    """(id, content): a package for each document of block rows (id, ord, kind, style, text), with the styles they name.

    Optional columns: runs (start, length, bold, italic, url) and num_id, level for lists, whose definitions are levels (num_id,
    level, start, format, text, restart_after, legal), the same for all documents and few. Tables are lines of tabs.
    """
    own = [c for c in ("runs", "num_id", "level") if c in blocks.columns]
    one = F.struct("ord", F.when(F.col("kind") == "table", "table").otherwise("paragraph").alias("kind"), F.col("style").cast("string").alias("style"), "text", *own)
    docs = blocks.groupBy(id_col).agg(F.array_sort(F.collect_list(one), lambda a, b: a["ord"] - b["ord"]).alias("blocks"))
    known: dict[int, list[dict]] = {}
    for r in levels.collect() if levels is not None else ():
        known.setdefault(r["num_id"], []).append(r.asDict())
    return map_rows(docs, [id_col, "blocks"], lambda doc, bs: [(doc, document_package(bs, known))], f"{id_col} {blocks.schema[id_col].dataType.simpleString()}, content binary", 64)
