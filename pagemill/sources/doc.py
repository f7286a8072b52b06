"""The legacy binary text format: text and paragraphs of a compound file through its piece table."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from pagemill.sources.package import CompoundFile
from pagemill.sources.rows import map_rows

BLOCKS = "ord int, story string, kind string, text string"
#: Stories in the order in which their lengths stand in the file's header.
STORIES = ("body", "footnotes", "headers", "macros", "comments", "endnotes", "textboxes", "header_textboxes")


def stories(content: bytes) -> dict[str, str]:
    """The characters of each story. Positions count 16-bit units."""
    file = CompoundFile(content)
    if "WordDocument" not in file.streams:
        raise ValueError("no document stream")
    main = file.read("WordDocument")
    if len(main) < 0x1AA or struct.unpack_from("<H", main)[0] != 0xA5EC:
        raise ValueError("not a document stream")
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & 0x0100:
        raise ValueError("the document is encrypted")
    table = file.read("1Table" if flags & 0x0200 else "0Table")
    counts = dict(zip(STORIES, struct.unpack_from("<8i", main, 0x4C), strict=True))
    at, size = struct.unpack_from("<II", main, 0x1A2)
    clx, at, out = table[at : at + size], 0, []
    while at < len(clx) and clx[at] == 1:
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if at >= len(clx) or clx[at] != 2:
        raise ValueError("no piece table")
    pieces = clx[at + 5 : at + 5 + struct.unpack_from("<I", clx, at + 1)[0]]
    n = (len(pieces) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", pieces)
    for k in range(n):
        place = struct.unpack_from("<I", pieces, 4 * (n + 1) + 8 * k + 2)[0]
        length = ends[k + 1] - ends[k]
        if place & 0x40000000:
            start = (place & 0x3FFFFFFF) // 2
            out.append(main[start : start + length].decode("cp1252", "replace").encode("utf-16-le"))
        else:
            out.append(main[place : place + 2 * length])
    raw, at, found = b"".join(out), 0, {}
    for story in STORIES:
        size = 2 * max(0, counts[story])
        found[story], at = raw[at : at + size].decode("utf-16-le", "replace"), at + size
    return found


def visible(text: str) -> str:
    """Text without field instructions and the marks of fields and objects."""
    out, depth, hidden = [], 0, []
    for c in text:
        if c == "\x13":
            depth += 1
            hidden.append(True)
        elif c == "\x14" and hidden:
            hidden[-1] = False
        elif c == "\x15" and hidden:
            hidden.pop()
        elif not any(hidden) and c not in "\x01\x02\x05\x08":
            out.append({"\x0b": "\n", "\x0c": "\n", "\x1e": "‑", "\x1f": "­"}.get(c, c))
    return "".join(out)


def blocks(content: bytes) -> list[tuple]:
    """BLOCKS: paragraphs and table cells (each ends a row of its own) of every story that has text."""
    out = []
    for story, part in stories(content).items():
        shown, start = visible(part), 0
        for i, c in enumerate(shown):
            if c in "\r\x07":
                out.append((len(out), story, "cell" if c == "\x07" else "paragraph", shown[start:i]))
                start = i + 1
        if shown[start:]:
            out.append((len(out), story, "paragraph", shown[start:]))
    return out


def read(files: DataFrame, id_col: str = "path", mode: str = "PERMISSIVE") -> DataFrame:
    """(id, BLOCKS, error) of every file (id, content)."""

    def rows(doc, content: bytes | None) -> list[tuple]:
        try:
            return [(doc, *r, None) for r in blocks(content or b"")]
        except Exception as e:
            if mode == "FAILFAST":
                raise
            return [(doc, None, None, None, None, f"{type(e).__name__}: {e}")]

    return map_rows(files, [id_col, "content"], rows, f"{id_col} {files.schema[id_col].dataType.simpleString()}, {BLOCKS}, error string")


def write(paragraphs: list[str]) -> bytes:
    """A file with these paragraphs as its body, in one piece of 16-bit characters: text alone, without styles."""
    from pagemill.sources.parts import compound_bytes

    text = "".join(p.replace("\n", "\x0b") + "\r" for p in paragraphs)
    raw = text.encode("utf-16-le")
    length = len(raw) // 2
    start = 0x400
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, length) + struct.pack("<HIH", 0, start, 0)
    main = bytearray(start)
    struct.pack_into("<HHHHHH", main, 0, 0xA5EC, 0xC1, 0, 0x409, 0, 0x1200)
    struct.pack_into("<i", main, 0x4C, length)
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    return compound_bytes({"WordDocument": bytes(main) + raw, "1Table": clx.ljust(4096, b"\0")})


def write_documents(paragraphs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content) of paragraph rows (id, ord, text)."""
    from pyspark.sql import functions as F

    docs = paragraphs.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: p["text"]).alias("ps"))
    return map_rows(docs, [id_col, "ps"], lambda doc, ps: [(doc, write([p or "" for p in ps]))], f"{id_col} {paragraphs.schema[id_col].dataType.simpleString()}, content binary", 64)
