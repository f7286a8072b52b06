"""RTF to paragraphs and back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.rows import map_rows

TOKEN = re.compile(rb"\\bin(\d+) ?|\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")
#: Destinations that hold no body text, characters of control words, and code pages of font charsets.
SKIPPED = set("fonttbl colortbl stylesheet info pict object header headerl headerr headerf footer footerl footerr footerf footnote themedata datastore listtable listoverridetable rsidtbl generator xmlnstbl latentstyles nonshppict fldinst bkmkstart bkmkend annotation atnid atnauthor".split())
CHARACTERS = {"par": "\n", "line": "\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "emspace": "\u2003", "enspace": "\u2002"}
SYMBOLS = {b"~": "\u00a0", b"_": "\u2011", b"-": "", b"\\": "\\", b"{": "{", b"}": "}", b"\n": "\n", b"\r": "\n"}
CHARSETS = {0: "cp1252", 77: "mac_roman", 128: "cp932", 129: "cp949", 134: "gbk", 136: "big5", 161: "cp1253", 162: "cp1254", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250"}


class RtfError(ValueError):
    pass


def parse(raw: bytes) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans of bold and italic) for each paragraph."""
    if not raw.lstrip().startswith(b"{\\rtf"):
        raise RtfError("not RTF")
    fonts: dict[int, str] = {}
    page, font_no = "cp1252", None
    state = {"skip": False, "uc": 1, "b": False, "i": False, "f": None, "dest": None}
    stack: list[dict] = []
    out: list[tuple[str, list]] = []
    text, spans, drop, star, held = "", [], 0, False, b""

    def put(s: str) -> None:
        nonlocal text, spans
        for k, line in enumerate(s.split("\n")):
            if k:
                out.append((text, spans))
                text, spans = "", []
            if line:
                for kind, name in (("b", "bold"), ("i", "italic")):
                    if state[kind]:
                        if spans and spans[-1][2] == name and spans[-1][0] + spans[-1][1] == len(text):
                            spans[-1] = (spans[-1][0], spans[-1][1] + len(line), name)
                        else:
                            spans.append((len(text), len(line), name))
                text += line

    def flush() -> None:
        nonlocal held
        if held:
            put(held.decode(fonts.get(state["f"], page), "replace"))
            held = b""

    at = 0
    while at < len(raw):
        m = TOKEN.match(raw, at)
        if not m:
            at += 1
            continue
        at = m.end()
        size, word, number, hexed, symbol, brace, plain = m.groups()
        if hexed is None:
            flush()
        if size is not None:
            at += int(size)
        elif brace == b"{":
            stack.append(dict(state))
            star = False
        elif brace == b"}":
            if not stack:
                raise RtfError("a group isn't open")
            state = stack.pop()
        elif symbol is not None:
            if symbol == b"*":
                star = True
            elif not state["skip"]:
                put(SYMBOLS.get(symbol, ""))
        elif word is not None:
            name, n = word.decode(), None if number is None else int(number)
            if name == "ansicpg" and n:
                page = f"cp{n}"
            elif name == "uc":
                state["uc"] = max(0, n if n is not None else 1)
            elif name == "fonttbl":
                state["skip"], state["dest"] = True, "fonttbl"
            elif state["dest"] == "fonttbl":
                if name == "f":
                    font_no = n
                elif name == "fcharset" and n in CHARSETS:
                    fonts[font_no] = CHARSETS[n]
            elif name in SKIPPED or (star and name not in ("shppict",)):
                state["skip"] = True
            elif state["skip"]:
                pass
            elif name == "u" and n is not None:
                code = n & 0xFFFF
                put(chr(code))
                drop = state["uc"]
            elif name in CHARACTERS:
                put(CHARACTERS[name])
            elif name in ("b", "i"):
                state[name] = n != 0
            elif name == "plain":
                state["b"] = state["i"] = False
            elif name == "f":
                state["f"] = n
            star = False
        elif hexed is not None and not state["skip"]:
            if drop:
                drop -= 1
            else:
                held += bytes([int(hexed, 16)])
        elif plain is not None and not state["skip"]:
            s = plain.decode(fonts.get(state["f"], page), "replace")
            cut = min(drop, len(s))
            drop -= cut
            put(s[cut:])
    flush()
    if text or not out:
        out.append((text, spans))
    return [(t.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), s) for t, s in out]


def write(paragraphs: list[str]) -> bytes:
    """ASCII RTF of paragraphs; the same bytes for the same texts."""

    def one(m: re.Match) -> str:
        c = m[0]
        if c in "\\{}":
            return "\\" + c
        if c == "\t":
            return "\\tab "
        if c == "\n":
            return "\\line "
        units = c.encode("utf-16-le", "surrogatepass")
        return "".join(f"\\u{int.from_bytes(units[k : k + 2], 'little', signed=True)}?" for k in range(0, len(units), 2))

    return ("{\\rtf1\\ansi\\ansicpg1252\\uc1\\deff0{\\fonttbl{\\f0 Calibri;}}\n" + "".join("\\pard " + re.sub(r"[\\{}\t\n]|[^ -~]", one, p) + "\\par\n" for p in paragraphs) + "}").encode("ascii")


def read(files: DataFrame, id_col: str = "path", mode: str = "PERMISSIVE") -> DataFrame:
    """(id, ord, text, spans, error) of every file."""

    def rows(doc, raw: bytes | None) -> list[tuple]:
        try:
            return [(doc, k, t, [dict(zip(("start", "length", "kind"), s, strict=True)) for s in spans], None) for k, (t, spans) in enumerate(parse(raw or b""))]
        except RtfError as e:
            if mode == "FAILFAST":
                raise
            return [(doc, None, None, None, str(e))]

    return map_rows(files, [id_col, "content"], rows, f"{id_col} {files.schema[id_col].dataType.simpleString()}, ord int, text string, spans array<struct<start:int,length:int,kind:string>>, error string")


def write_documents(paragraphs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content) of paragraph rows (id, ord, text)."""
    docs = paragraphs.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: p["text"]).alias("ps"))
    return map_rows(docs, [id_col, "ps"], lambda doc, ps: [(doc, write([p or "" for p in ps]))], f"{id_col} {paragraphs.schema[id_col].dataType.simpleString()}, content binary", 64)
