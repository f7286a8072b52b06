"""Zip packages of parts: content types, relationships, paths, budgets; and small binary readers."""

from __future__ import annotations

import hashlib
import io
import posixpath
import struct
import zipfile
import zlib
from urllib.parse import unquote
from xml.etree import ElementTree as ET

from pagemill.operators.budget import ensure, validated

CT = "{http://schemas.openxmlformats.org/package/2006/content-types}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def resolve_path(source: str, target: str) -> str:
    """The absolute part path of a relationship's target, percent-decoded; never above the root."""
    base = posixpath.dirname(source) if not target.startswith("/") else "/"
    return "/" + posixpath.normpath(posixpath.join("/", base, unquote(target.split("#")[0]))).lstrip("/")


def safe_media_path(path: str) -> bool:
    """Whether a media path is relative, portable and stays in its folder."""
    parts = path.replace("\\", "/").split("/")
    return bool(path) and not path.startswith(("/", "\\")) and ":" not in path and ".." not in parts and "" not in parts and not any(ord(c) < 32 for c in path)


class ContentTypes:
    """Overrides by part, then defaults by extension; neither minds case."""

    def __init__(self, xml: bytes):
        root = ET.fromstring(xml)
        self.defaults = {e.get("Extension", "").lower(): e.get("ContentType", "") for e in root.iter(CT + "Default")}
        self.overrides = {e.get("PartName", "").lower(): e.get("ContentType", "") for e in root.iter(CT + "Override")}

    def of(self, part: str) -> str | None:
        return self.overrides.get(part.lower()) or self.defaults.get(part.rsplit(".", 1)[-1].lower())


class Package:
    def __init__(self, content: bytes, limits: dict[str, int] | None = None):
        self.limits = validated(limits)
        ensure("input_bytes", len(content), self.limits)
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        infos = [i for i in self.zip.infolist() if not i.is_dir()]
        ensure("parts", len(infos), self.limits)
        ensure("inflated_bytes", sum(i.file_size for i in infos), self.limits)
        self.names = {"/" + i.filename.lstrip("/"): i for i in infos}
        self.lower = {n.lower(): n for n in self.names}
        self.types = ContentTypes(self.read("/[Content_Types].xml")) if "/[content_types].xml" in self.lower else None

    def read(self, part: str) -> bytes | None:
        name = self.lower.get(part.lower())
        if name is None:
            return None
        info = self.names[name]
        ensure("part_bytes", info.file_size, self.limits)
        with self.zip.open(info) as f:
            data = f.read(self.limits["part_bytes"] + 1)  # a header may lie about the size
        ensure("part_bytes", len(data), self.limits)
        return data

    def xml(self, part: str) -> ET.Element | None:
        data = self.read(part)
        if data is None:
            return None
        if b"<!DOCTYPE" in data[:4096]:
            raise ValueError(f"{part} declares a document type")
        # Level by level: nodes and depth without an event for each node. A part's size bounds its tree.
        root = ET.fromstring(data)
        level, nodes, depth = [root], 0, 0
        while level:
            nodes, depth = nodes + len(level), depth + 1
            ensure("xml_depth", depth, self.limits)
            ensure("xml_nodes", nodes, self.limits)
            level = [c for e in level for c in e]
        return root

    def relationships(self, part: str = "") -> dict[str, tuple[str, str, bool]]:
        """id -> (type, target, external) of a part, or of the package."""
        folder, name = posixpath.split(part or "/")
        root = self.xml(f"{folder.rstrip('/')}/_rels/{name}.rels")
        out = {}
        for e in [] if root is None else root.iter(REL + "Relationship"):
            external = e.get("TargetMode") == "External"
            target = e.get("Target", "")
            out[e.get("Id", "")] = (e.get("Type", ""), target if external else resolve_path(part or "/", target), external)
        return out


def image_header(raw: bytes) -> tuple[str, int, int] | None:
    """(type, width, height) of PNG, GIF, BMP and JPEG."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return ("png", *struct.unpack(">II", raw[16:24]))
    if raw[:6] in (b"GIF87a", b"GIF89a"):
        return ("gif", *struct.unpack("<HH", raw[6:10]))
    if raw[:2] == b"BM" and len(raw) >= 26:
        w, h = struct.unpack("<ii", raw[18:26])
        return "bmp", w, abs(h)
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            kind, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + size
    return None


class CompoundFile:
    """Streams of a compound file by path."""

    MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    END = 0xFFFFFFFE

    def __init__(self, raw: bytes):
        if raw[:8] != self.MAGIC:
            raise ValueError("not a compound file")
        self.raw = raw
        shift, mini = struct.unpack_from("<HH", raw, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini
        n_fat, first_dir, _, self.cutoff, first_mini, _, first_dif, n_dif = struct.unpack_from("<IIIIIIII", raw, 44)
        difat = list(struct.unpack_from("<109I", raw, 76))
        seen = set()
        while first_dif < self.END - 3 and first_dif not in seen and n_dif:
            seen.add(first_dif)
            block = struct.unpack(f"<{self.size // 4}I", self.sector(first_dif))
            difat += block[:-1]
            first_dif = block[-1]
        self.fat = [x for s in difat[:n_fat] if s < self.END - 3 for x in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        directory = self.chain(first_dir)
        self.entries = []
        for at in range(0, len(directory) - 127, 128):
            e = directory[at : at + 128]
            n = struct.unpack_from("<H", e, 64)[0]
            left, right, child = struct.unpack_from("<III", e, 68)
            start, size = struct.unpack_from("<IQ", e, 116)
            self.entries.append((e[: max(0, n - 2)].decode("utf-16-le", "replace"), e[66], left, right, child, start, size & 0xFFFFFFFF if shift == 9 else size))
        root = self.entries[0]
        self.mini = self.chain(root[5])[: root[6]] if root[6] else b""
        table = self.chain(first_mini) if first_mini < self.END - 3 else b""
        self.mini_fat = struct.unpack(f"<{len(table) // 4}I", table)
        self.streams: dict[str, tuple] = {}
        self.visit(root[4], "", set())

    def sector(self, k: int) -> bytes:
        return self.raw[(k + 1) * self.size : (k + 2) * self.size].ljust(self.size, b"\0")

    def chain(self, k: int) -> bytes:
        out, seen = [], set()
        while k < len(self.fat) and k not in seen:
            seen.add(k)
            out.append(self.sector(k))
            k = self.fat[k]
        return b"".join(out)

    def visit(self, k: int, path: str, seen: set) -> None:
        if k >= len(self.entries) or k in seen:
            return
        seen.add(k)
        name, kind, left, right, child, *_ = self.entries[k]
        self.visit(left, path, seen)
        if kind == 2:
            self.streams[path + name] = self.entries[k]
        elif kind == 1:
            self.visit(child, path + name + "/", seen)
        self.visit(right, path, seen)

    def read(self, path: str) -> bytes:
        *_, start, size = self.streams[path]
        if size >= self.cutoff:
            return self.chain(start)[:size]
        out, seen = [], set()
        while start < len(self.mini_fat) and start not in seen:
            seen.add(start)
            out.append(self.mini[start * self.mini_size : (start + 1) * self.mini_size])
            start = self.mini_fat[start]
        return b"".join(out)[:size]


def vba_decompress(raw: bytes) -> bytes:
    """A compressed container of macro source: chunks of 4096 bytes with copy tokens."""
    if not raw or raw[0] != 1:
        raise ValueError("not a compressed container")
    out, at = bytearray(), 1
    while at + 2 <= len(raw):
        head = struct.unpack_from("<H", raw, at)[0]
        end, at, begin = min(len(raw), at + (head & 0xFFF) + 3), at + 2, len(out)
        if not head & 0x8000:
            out += raw[at : at + 4096]
            at = end
            continue
        while at < end:
            flags, at = raw[at], at + 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(raw[at])
                    at += 1
                else:
                    token, at = struct.unpack_from("<H", raw, at)[0], at + 2
                    bits = max(4, (len(out) - begin - 1).bit_length())
                    length, back = (token & (0xFFFF >> bits)) + 3, (token >> (16 - bits)) + 1
                    for _ in range(length):
                        out.append(out[-back])
    return bytes(out)


def lock_file(raw: bytes) -> bytes:
    """The XML of a co-authoring lock file: deflated after 8 bytes of signature."""
    body = raw[8:]
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        try:
            return zlib.decompress(body, bits)
        except zlib.error:
            continue
    raise ValueError("not a lock file")


def protection_hash(password: str, salt: bytes, spins: int = 100_000) -> bytes:
    """SHA-512 of salt and password, then of hash and counter, spins times."""
    h = hashlib.sha512(salt + password.encode("utf-16-le")).digest()
    for i in range(spins):
        h = hashlib.sha512(h + struct.pack("<I", i)).digest()
    return h
