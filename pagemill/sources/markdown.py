"""Markdown (CommonMark with tables, strikethrough, tasks and footnotes) to block rows, and back."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.sources.rows import map_rows

BLOCKS = "ord int, kind string, level int, style string, text string, list_no int, marker string, task string, path array<int>"
FRONT = re.compile(r"\A---[ \t]*\n(?:.*?\n)??(?:---|\.\.\.)[ \t]*(?:\n|\Z)", re.S)
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|$)")
TASK = re.compile(r"\[([ xX])\][ \t]+")
QUOTE = re.compile(r" {0,3}> ?")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>\n]*)>|(\S+))(?:[ \t]+(?:\"([^\"]*)\"|'([^']*)'|\(([^()]*)\)))?[ \t]*$")
FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
HTML_START = re.compile(r" {0,3}<(?:!--|\?|![A-Z]|/?(?:address|article|aside|blockquote|body|center|details|dialog|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|p|pre|script|section|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul)(?=[\s/>]|$))", re.I)


def label(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip()).casefold()


def cells(line: str) -> list[str]:
    body = re.sub(r"^\||(?<!\\)\|$", "", line.strip())
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", body)]


class Blocks:
    """One pass over lines; containers recurse with their prefix removed."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.links: dict[str, tuple[str, str]] = {}
        self.notes: dict[str, str] = {}
        self.lists = 0

    def add(self, kind: str, text: str = "", level: int | None = None, style: str | None = None, path: tuple = (), **more) -> None:
        self.rows.append({"ord": len(self.rows), "kind": kind, "level": level, "style": style, "text": text, "list_no": None, "marker": None, "task": None, "path": list(path)} | more)

    def parse(self, lines: list[str], path: tuple = (), first: dict | None = None) -> None:
        i, n, para = 0, len(lines), []
        held = first or {}

        def flush() -> None:
            nonlocal para, held
            while para and (m := DEFINITION.match(para[0])):
                self.links.setdefault(label(m[1]), (m[2] if m[2] is not None else m[3], m[4] or m[5] or m[6] or ""))
                para.pop(0)
            if para:
                text = re.sub(r"(?: {2,}|\\)\n", "\n", "\n".join(x.strip() if k else x.lstrip() for k, x in enumerate(para))).rstrip()
                self.add("paragraph", text, path=path, **held)
                held = {}
            para = []

        while i < n:
            line = lines[i].expandtabs(4) if "\t" in lines[i][: len(lines[i]) - len(lines[i].lstrip())] else lines[i]
            if not line.strip():
                flush()
                i += 1
            elif para and (m := SETEXT.match(line)):
                text, para = "\n".join(x.strip() for x in para), []
                self.add("heading", text, 1 if m[1][0] == "=" else 2, path=path, **held)
                held, i = {}, i + 1
            elif line.startswith("    ") and not para:
                code = []
                while i < n and (lines[i].startswith("    ") or not lines[i].strip()):
                    code.append(lines[i][4:])
                    i += 1
                while code and not code[-1].strip():
                    code.pop()
                self.add("code", "\n".join(code), path=path, **held)
                held = {}
            elif m := ATX.match(line):
                flush()
                self.add("heading", (m[2] or "").strip().rstrip("#").rstrip() if set(m[2] or "") == {"#"} else (m[2] or ""), len(m[1]), path=path, **held)
                held, i = {}, i + 1
            elif m := FENCE.match(line):
                flush()
                indent, mark, code, i = len(line) - len(line.lstrip()), m[1], [], i + 1
                close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
                while i < n and not close.match(lines[i]):
                    code.append(re.sub(rf"^ {{0,{indent}}}", "", lines[i]))
                    i += 1
                self.add("code", "\n".join(code), style=m[2].split(" ")[0] or None, path=path, **held)
                held, i = {}, i + 1
            elif RULE.match(line):
                flush()
                self.add("rule", path=path)
                i += 1
            elif QUOTE.match(line):
                flush()
                inner = []
                while i < n and lines[i].strip() and (QUOTE.match(lines[i]) or (inner and inner[-1].strip() and not ITEM.match(lines[i]) and not ATX.match(lines[i]) and not FENCE.match(lines[i]) and not RULE.match(lines[i]))):
                    inner.append(QUOTE.sub("", lines[i], count=1))
                    i += 1
                self.parse(inner, (*path, -1))
            elif (m := ITEM.match(line)) and not (para and (m[4] is None or (m[2][0].isdigit() and m[2][:-1] != "1"))):
                flush()
                i = self.list(lines, i, path)
            elif m := FOOTNOTE.match(line):
                flush()
                body, i = [m[2]], i + 1
                while i < n and lines[i].startswith("    "):
                    body.append(lines[i].strip())
                    i += 1
                self.notes.setdefault(label(m[1]), "\n".join(body).strip())
            elif i + 1 < n and "|" in line and DELIMITER.match(lines[i + 1]) and len(cells(line)) == len(cells(lines[i + 1])) and not para:
                width = len(cells(line))
                aligned = [("center" if c.startswith(":") and c.endswith(":") else "right" if c.endswith(":") else "left" if c.startswith(":") else "") for c in cells(lines[i + 1])]
                rows, i = [cells(line)], i + 2
                while i < n and lines[i].strip() and "|" in lines[i]:
                    rows.append((cells(lines[i]) + [""] * width)[:width])
                    i += 1
                self.add("table", "\n".join("\t".join(r) for r in rows), width, ",".join(aligned), path=path)
            elif HTML_START.match(line) and not para:
                raw = []
                while i < n and lines[i].strip():
                    raw.append(lines[i])
                    i += 1
                self.add("html", "\n".join(raw), path=path)
            else:
                para.append(line)
                i += 1
        flush()

    def list(self, lines: list[str], i: int, path: tuple) -> int:
        self.lists += 1
        number, kind, item = self.lists, None, 0
        while i < len(lines) and (m := ITEM.match(lines[i])) and not RULE.match(lines[i]):
            mark = m[2][-1] if m[2][0].isdigit() else m[2]
            if kind not in (None, mark):
                break
            kind, item = mark, item + 1
            gap = len(m[3] or " ")
            indent = len(m[1]) + len(m[2]) + (1 if gap > 4 or m[4] is None else gap)
            body, i = [(" " * (gap - 1) if gap > 4 else "") + (m[4] or "")], i + 1
            while i < len(lines):
                line = lines[i]
                if not line.strip():
                    if i + 1 < len(lines) and lines[i + 1].startswith(" " * indent) and lines[i + 1].strip():
                        body.append("")
                        i += 1
                        continue
                    break
                if line.startswith(" " * indent):
                    body.append(line[indent:])
                elif body[-1].strip() and not ITEM.match(line) and not ATX.match(line) and not FENCE.match(line) and not RULE.match(line) and not QUOTE.match(line):
                    body.append(line)
                else:
                    break
                i += 1
            more = {"list_no": number, "marker": m[2], "task": None}
            if t := TASK.match(body[0]):
                more["task"], body[0] = t[1].lower(), body[0][t.end() :]
            before = len(self.rows)
            self.parse(body, (*path, item), more)
            if len(self.rows) == before:
                self.add("paragraph", "", path=(*path, item), **more)
            while i < len(lines) and not lines[i].strip() and i + 1 < len(lines) and ITEM.match(lines[i + 1]):
                i += 1
        return i


def parse_blocks(text: str) -> Blocks:
    out = Blocks()
    out.parse(FRONT.sub("", text.replace("\r\n", "\n").replace("\r", "\n"), count=1).split("\n"))
    return out


PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
SPECIAL = re.compile(r"\\.|`+|\*+|_+|~~?|!?\[|\]|<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+|/?[A-Za-z][^<>]*|!--.*?--)>|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|\w+);", re.S)
TARGET = re.compile(r"\([ \t\n]*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:[ \t\n]+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)))?[ \t\n]*\)", re.S)


def parse_inline(text: str, links: dict[str, tuple[str, str]] | None = None) -> tuple[str, list[tuple[int, int, str, str | None]]]:
    """Plain text, and spans (start, length, kind, url) of strong, emphasis, strike, code, link, image and note."""
    links, nodes, stack, brackets, at = links or {}, [], [], [], 0

    def put(s: str) -> None:
        if s:
            nodes.append(["text", s])

    spans_open: list[tuple[int, int, str, str | None]] = []
    while m := SPECIAL.search(text, at):
        put(text[at : m.start()])
        token, at = m[0], m.end()
        if token[0] == "\\":
            put(token[1] if token[1] in PUNCTUATION else "\n" if token[1] == "\n" else token)
        elif token[0] == "`":
            close = re.compile(rf"(?<!`){token}(?!`)").search(text, at)
            if close:
                code = text[at : close.start()].replace("\n", " ")
                nodes.append(["code", code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code])
                at = close.end()
            else:
                put(token)
        elif token[0] in "*_~":
            before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
            left = not after.isspace() and (after not in PUNCTUATION or before.isspace() or before in PUNCTUATION)
            right = not before.isspace() and (before not in PUNCTUATION or after.isspace() or after in PUNCTUATION)
            opens, closes = (left and (not right or before in PUNCTUATION), right and (not left or after in PUNCTUATION)) if token[0] == "_" else (left, right)
            nodes.append(["run", token[0], len(token), opens, closes, len(token)])
            stack.append(len(nodes) - 1)
        elif token in ("[", "!["):
            nodes.append(["open", token])
            brackets.append(len(nodes) - 1)
        elif token == "]":
            start = brackets.pop() if brackets else None
            if start is None:
                put("]")
                continue
            inner = "".join(x[1] if x[0] in ("text", "code") else x[1] * x[2] if x[0] == "run" else "" for x in nodes[start + 1 :])
            kind, url = ("image" if nodes[start][1] == "![" else "link"), None
            if inner.startswith("^") and nodes[start][1] == "[":
                kind, url = "note", label(inner[1:])
                nodes[start + 1 :] = [["text", inner[1:]]]
            elif (t := TARGET.match(text, at)) is not None:
                url, at = html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", t[1] if t[1] is not None else t[2])), t.end()
            else:
                r = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(text, at)
                key = label(r[1] if r and r[1] else inner)
                if key in links:
                    url, at = links[key][0], r.end() if r else at
            if url is None:
                nodes[start] = ["text", nodes[start][1]]
                put("]")
            else:
                nodes[start] = ["begin", kind, url]
                nodes.append(["end", kind])
                if kind == "link":
                    for b in brackets:
                        if nodes[b][0] == "open" and nodes[b][1] == "[":
                            nodes[b] = ["text", "["]
                    brackets = [b for b in brackets if nodes[b][0] == "open"]
        elif token[0] == "<":
            inner = token[1:-1]
            if re.match(r"[A-Za-z][A-Za-z0-9+.-]{1,31}:", inner) or "@" in inner and "/" not in inner and " " not in inner:
                nodes += [["begin", "link", inner if ":" in inner else "mailto:" + inner], ["text", inner], ["end", "link"]]
            else:
                nodes.append(["raw", token])
        else:
            put(html.unescape(token))
    put(text[at:])
    for b in brackets:
        nodes[b] = ["text", nodes[b][1]]
    # Delimiter runs: each closer looks back for the nearest opener of its kind.
    pairs: list[tuple[int, int, str]] = []
    for c in stack:
        closer = nodes[c]
        while closer[0] == "run" and closer[4] and closer[2]:
            for o in reversed([k for k in stack if k < c]):
                opener = nodes[o]
                if opener[1] != closer[1] or not opener[3] or not opener[2]:
                    continue
                if (opener[4] or closer[3]) and (opener[5] + closer[5]) % 3 == 0 and (opener[5] % 3 or closer[5] % 3) and closer[1] != "~":
                    continue
                if closer[1] == "~" and opener[2] != closer[2]:
                    continue
                size = closer[2] if closer[1] == "~" else 2 if opener[2] >= 2 and closer[2] >= 2 else 1
                pairs.append((o, c, "strike" if closer[1] == "~" else "strong" if size == 2 else "emphasis"))
                opener[2] -= size
                closer[2] -= size
                for k in stack:
                    if o < k < c:
                        nodes[k][3] = nodes[k][4] = False
                break
            else:
                break
    out, open_at, spans = "", [], spans_open
    where: dict[int, tuple[int, int]] = {}
    for k, x in enumerate(nodes):
        begin = len(out)
        if x[0] == "text":
            out += x[1]
        elif x[0] == "code":
            out += x[1]
            spans.append((begin, len(x[1]), "code", None))
        elif x[0] == "run":
            out += x[1] * x[2]
        elif x[0] == "begin":
            open_at.append((begin, x[1], x[2]))
        elif x[0] == "end" and open_at:
            s, kind, url = open_at.pop()
            spans.append((s, begin - s, kind, url))
        where[k] = (begin, len(out))
    spans += [(where[o][1], where[c][0] - where[o][1], kind, None) for o, c, kind in pairs]
    return out, sorted(spans)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """BLOCKS of every document, with plain text and (start, length, kind, url) spans in inline; footnotes come last, as kind note, their label in style."""
    names = [c.split(" ")[0] for c in BLOCKS.split(", ")]
    if id_col in names:
        raise ValueError(f"block rows have a column {id_col} of their own")

    def rows(doc, text: str | None) -> Iterator[tuple]:
        found = parse_blocks(text or "")
        for r in found.rows:
            plain, spans = (r["text"], []) if r["kind"] in ("code", "html", "rule", "table") else parse_inline(r["text"], found.links)
            yield (doc, *((r | {"text": plain}).get(c) for c in names), [dict(zip(("start", "length", "kind", "url"), s, strict=True)) for s in spans])
        for k, (name, body) in enumerate(found.notes.items(), len(found.rows)):
            plain, spans = parse_inline(body, found.links)
            made = {"ord": k, "kind": "note", "style": name, "text": plain, "path": []}
            yield (doc, *(made.get(c) for c in names), [dict(zip(("start", "length", "kind", "url"), s, strict=True)) for s in spans])

    return map_rows(docs, [id_col, text_col], rows, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {BLOCKS}, inline array<struct<start:int,length:int,kind:string,url:string>>")


def decoded(files: DataFrame, id_col: str = "path") -> DataFrame:
    """(file, text) of files (id, content) in UTF-8, without a byte order mark; bytes that aren't UTF-8 become U+FFFD.

    file is the id: block rows have a column path of their own.
    """
    return map_rows(files, [id_col, "content"], lambda i, raw: [(i, None if raw is None else raw.decode("utf-8", "replace").removeprefix("\ufeff"))], f"file {files.schema[id_col].dataType.simpleString()}, text string", 64)


def inline(text: Column, spans: Column, begin, end, plain, code) -> Column:
    """text with what begin and end give for each span (start, length, kind, url) around it; stretches go through plain, or code inside code spans.

    Of spans that begin together the longest comes first, of those that end together the one that began last.
    """
    spans = F.filter(spans, lambda s: s["length"] > 0)
    last = lambda s: s["start"] + s["length"]
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.length(text)), F.transform(spans, lambda s: s["start"]), F.transform(spans, last))))

    def piece(at: Column, k: Column) -> Column:
        closing = F.array_sort(F.transform(F.filter(spans, lambda s: last(s) == at), lambda s: F.struct((-s["start"]).alias("a"), s["length"].alias("b"), s["kind"].alias("kind"), s["url"].alias("url"))))
        opening = F.array_sort(F.transform(F.filter(spans, lambda s: s["start"] == at), lambda s: F.struct((-s["length"]).alias("a"), s["kind"].alias("kind"), s["url"].alias("url"))))
        body = F.substring(text, at + 1, F.coalesce(F.get(cuts, k + 1), at) - at)
        inside = F.exists(spans, lambda s: (s["kind"] == "code") & (s["start"] <= at) & (at < last(s)))
        return F.concat(F.array_join(F.transform(closing, end), ""), F.array_join(F.transform(opening, begin), ""), F.when(inside, code(body)).otherwise(plain(body)))

    return F.when(F.size(spans) > 0, F.array_join(F.transform(cuts, piece), "")).otherwise(plain(text))


def _spans(rows: DataFrame) -> Column:
    kind = "array<struct<start:int,length:int,kind:string,url:string>>"
    return F.coalesce(F.col("inline").cast(kind), F.array().cast(kind)) if "inline" in rows.columns else F.array().cast(kind)


def _safe(url: Column) -> Column:
    from pagemill.functions.text import unsafe_link

    return ~F.coalesce(unsafe_link(url), F.lit(True))


MARKS = {"strong": "**", "emphasis": "*", "strike": "~~"}


def inline_markdown(text: Column, spans: Column) -> Column:
    """Emphasis, code, links, images and note references; links that aren't safe keep their text alone."""
    from pagemill.functions.text import code_span, link_destination, markdown_escape

    def around(s: Column, before: bool) -> Column:
        out = F.lit("")
        for kind, mark in MARKS.items():
            out = F.when(s["kind"] == kind, mark).otherwise(out)
        address = F.concat(F.lit("]("), F.coalesce(link_destination(s["url"]), F.lit("")), F.lit(")"))
        out = F.when((s["kind"] == "link") & _safe(s["url"]), F.lit("[") if before else address).otherwise(out)
        out = F.when(s["kind"] == "image", F.lit("![") if before else address).otherwise(out)
        return F.when(s["kind"] == "note", "[^" if before else "]").otherwise(out)

    return inline(text, spans, lambda s: around(s, True), lambda s: around(s, False), markdown_escape, code_span)


def inline_html(text: Column, spans: Column) -> Column:
    from pagemill.functions.text import html_escape

    tags = {"strong": "strong", "emphasis": "em", "strike": "s", "code": "code"}

    def around(s: Column, before: bool) -> Column:
        out = F.lit("")
        for kind, tag in tags.items():
            out = F.when(s["kind"] == kind, f"<{tag}>" if before else f"</{tag}>").otherwise(out)
        url = html_escape(F.coalesce(s["url"], F.lit("")))
        out = F.when((s["kind"] == "link") & _safe(s["url"]), F.concat(F.lit('<a href="'), url, F.lit('">')) if before else F.lit("</a>")).otherwise(out)
        out = F.when((s["kind"] == "image") & _safe(s["url"]), F.concat(F.lit('<img src="'), url, F.lit('" alt="')) if before else F.lit('">')).otherwise(out)
        return F.when(s["kind"] == "note", F.concat(F.lit('<sup><a href="#fn-'), url, F.lit('" id="ref-'), url, F.lit('">')) if before else F.lit("</a></sup>")).otherwise(out)

    return inline(text, spans, lambda s: around(s, True), lambda s: around(s, False), html_escape, html_escape)


def to_markdown(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, text): Markdown of block rows, in order; line feeds alone, one at the end. Spans in inline, if there, become marks."""
    from pagemill.functions.text import fence_length

    text = inline_markdown(F.col("text"), _spans(rows))
    fence = F.repeat(F.lit("`"), fence_length("text"))
    marker = F.concat(F.repeat(F.lit("    "), F.greatest(F.lit(0), F.size("path") - 1)), F.when(F.col("marker").rlike(r"^\d"), F.concat(F.regexp_extract("marker", r"^(\d+)", 1), F.lit(". "))).otherwise("- "), F.when(F.col("task") == "x", "[x] ").when(F.col("task") == " ", "[ ] ").otherwise(""))
    head = F.split(F.col("text"), "\n")
    table_rows = F.transform(head, lambda r: F.concat(F.lit("| "), F.replace(F.replace(r, F.lit("|"), F.lit("\\|")), F.lit("\t"), F.lit(" | ")), F.lit(" |")))
    line = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), text))
        .when(F.col("kind") == "code", F.concat(fence, F.coalesce("style", F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n"), fence))
        .when(F.col("kind") == "rule", "---")
        .when(F.col("kind") == "html", F.col("text"))
        .when(F.col("kind") == "note", F.concat(F.lit("[^"), F.col("style"), F.lit("]: "), F.regexp_replace(text, "\n", "\n    ")))
        .when(F.col("kind") == "table", F.concat_ws("\n", F.slice(table_rows, 1, 1), F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("level"))), F.slice(table_rows, 2, 1 << 20)))
        .when(F.col("marker").isNotNull(), F.concat(marker, text))
        .when(F.array_contains("path", -1), F.concat(F.lit("> "), F.regexp_replace(text, "\n", "\n> ")))
        .otherwise(text)
    )
    # Neighbouring items of a list, and of lists inside it, stand on neighbouring lines.
    part = F.struct("ord", F.coalesce("list_no", F.lit(0)).alias("l"), F.size("path").alias("d"), line.alias("t"))
    ordered = F.array_sort(F.collect_list(part))
    near = lambda s, x: (x["l"] > 0) & (s["l"] > 0) & ((x["l"] == s["l"]) | (x["d"] > s["d"]) | ((x["d"] < s["d"]) & (x["l"] < s["l"])))
    step = lambda s, x: F.struct(x["l"].alias("l"), x["d"].alias("d"), F.concat(s["t"], F.when(s["t"] == "", "").when(near(s, x), "\n").otherwise("\n\n"), x["t"]).alias("t"))
    whole = F.aggregate(ordered, F.struct(F.lit(0).alias("l"), F.lit(0).alias("d"), F.lit("").alias("t")), step, lambda s: F.concat(F.rtrim(s["t"]), F.lit("\n")))
    return rows.groupBy(by).agg(whole.alias("text"))


def to_html(rows: DataFrame, by: str = "doc_id", full_page: bool = False) -> DataFrame:
    """(by, html): an element for each block row, in order; items in lists, nested by their paths; notes in a section at the end."""
    from pagemill.functions.text import html_escape

    text = inline_html(F.col("text"), _spans(rows))
    tag = lambda name, inner: F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))
    level, label_ = F.col("level").cast("string"), html_escape(F.coalesce("style", F.lit("")))
    cell_rows = lambda cell, rows_: F.array_join(F.transform(rows_, lambda r: F.concat(F.lit(f"<tr><{cell}>"), F.replace(html_escape(r), F.lit("\t"), F.lit(f"</{cell}><{cell}>")), F.lit(f"</{cell}></tr>"))), "")
    lines = F.split("text", "\n")
    line = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">")))
        .when(F.col("kind") == "code", F.concat(F.lit("<pre><code>"), html_escape("text"), F.lit("</code></pre>")))
        .when(F.col("kind") == "rule", "<hr>")
        .when(F.col("kind") == "note", F.concat(F.lit('<p id="fn-'), label_, F.lit('">'), text, F.lit(' <a href="#ref-'), label_, F.lit('">&#8617;</a></p>')))
        .when(F.col("kind") == "table", F.concat(F.lit("<table>"), cell_rows("th", F.slice(lines, 1, 1)), cell_rows("td", F.slice(lines, 2, 1 << 20)), F.lit("</table>")))
        .when(F.col("marker").isNotNull(), F.concat(F.when(F.col("task") == "x", '<input type="checkbox" checked disabled> ').when(F.col("task") == " ", '<input type="checkbox" disabled> ').otherwise(""), text))
        .when(F.array_contains("path", -1), tag("blockquote", tag("p", text)))
        .otherwise(tag("p", text))
    )
    depth = F.when(F.col("marker").isNotNull(), F.size(F.filter("path", lambda x: x > 0))).otherwise(F.size(F.filter(F.coalesce("path", F.array().cast("array<int>")), lambda x: x > 0)))
    name = F.when(F.col("marker").rlike(r"^\d"), "ol").otherwise("ul")
    part = F.struct("ord", F.col("marker").isNotNull().alias("item"), depth.alias("depth"), F.concat(name, F.lit(" "), F.coalesce("list_no", F.lit(0)).cast("string")).alias("list"), line.alias("t"))
    tag_of = lambda x: F.substring_index(x, " ", 1)
    closed = lambda open_, keep: F.array_join(F.transform(F.reverse(F.slice(open_, keep + 1, 1 << 20)), lambda x: F.concat(F.lit("</li>\n</"), tag_of(x), F.lit(">"))), "\n")

    def step(s: Column, x: Column) -> Column:
        # An item keeps its list's open elements down to its depth; other rows those of the item that they belong to.
        n, d = F.size(s["open"]), F.greatest(x["depth"], F.lit(0))
        same = x["item"] & (n >= d) & (F.get(s["open"], d - 1) == x["list"])
        keep = F.when(x["item"] & ~same, F.least(n, d - 1)).otherwise(F.least(n, d))
        fresh = F.when(x["item"] & ~same, F.transform(F.sequence(F.lit(1), d - keep), lambda _: x["list"])).otherwise(F.slice(s["open"], 1, 0))
        opened = F.array_join(F.transform(fresh, lambda y: F.concat(F.lit("<"), tag_of(y), F.lit(">\n<li>"))), "\n")
        parts = F.array(s["t"], closed(s["open"], keep), F.when(same, "</li>\n<li>").otherwise(""), opened)
        before = F.array_join(F.filter(parts, lambda p: p != ""), "\n")
        glue = F.when(x["item"] | (before == ""), "").otherwise("\n")
        return F.struct(F.concat(F.slice(s["open"], F.lit(1), keep), fresh).alias("open"), F.concat(before, glue, x["t"]).alias("t"))

    ordered = F.array_sort(F.collect_list(part))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("t"))
    body = F.aggregate(ordered, start, step, lambda s: F.array_join(F.filter(F.array(s["t"], closed(s["open"], F.lit(0))), lambda p: p != ""), "\n"))
    page = F.concat(F.lit("<!DOCTYPE html>\n<html><body>\n"), body, F.lit("\n</body></html>")) if full_page else body
    return rows.groupBy(by).agg(page.alias("html"))
