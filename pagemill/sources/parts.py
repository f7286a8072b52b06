"""What else packages and compound files hold: charts, macros, properties, embedded files, signatures, extensions, add-ins, locks.

Every reader takes bytes and returns rows; ``read`` runs one over a DataFrame of files (id, content) and gives a file that can't be
read a row with error alone. Compound files can be written, too.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from pagemill.sources.package import CompoundFile, Package, image_header, lock_file, vba_decompress
from pagemill.sources.rows import map_rows

C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
DS = "{http://www.w3.org/2000/09/xmldsig#}"
#: The elements of a plot area that are charts, and what they are called here.
CHARTS = {"barChart": "bar", "bar3DChart": "bar", "lineChart": "line", "line3DChart": "line", "pieChart": "pie", "pie3DChart": "pie", "doughnutChart": "doughnut", "areaChart": "area", "area3DChart": "area", "scatterChart": "scatter", "bubbleChart": "bubble", "radarChart": "radar", "stockChart": "stock", "surfaceChart": "surface", "surface3DChart": "surface", "ofPieChart": "pie"}
POINTS = "chart string, kind string, title string, series_no int, series string, i int, category string, value double, bubble double"


def _points(e: ET.Element | None) -> list[str]:
    """Texts of a cache's points in the order of their numbers."""
    found = [] if e is None else [(int(p.get("idx", k)), p.findtext(C + "v") or "") for k, p in enumerate(e.iter(C + "pt"))]
    return [t for _, t in sorted(found)]


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def chart_points(xml: bytes, name: str = "") -> Iterator[tuple]:
    """POINTS of a chart part: a row for each point of each series, numbers that can't be read are null."""
    root = ET.fromstring(xml)
    chart = root.find(C + "chart")
    plot = None if chart is None else chart.find(C + "plotArea")
    title = None if chart is None else chart.find(C + "title")
    heading = None if title is None else "".join(t.text or "" for t in title.iter(A + "t")) or None
    number = 0
    for group in [] if plot is None else plot:
        kind = CHARTS.get(group.tag.removeprefix(C))
        for series in group.findall(C + "ser") if kind else ():
            tx = series.find(C + "tx")
            label = None if tx is None else next((v.text for v in tx.iter(C + "v")), None)
            section = lambda *names: next((x for n in names if (x := series.find(C + n)) is not None), None)  # noqa: B023, E731
            categories, values, sizes = _points(section("cat", "xVal")), _points(section("val", "yVal")), _points(section("bubbleSize"))
            for i in range(max(len(categories), len(values))):
                at = lambda xs: xs[i] if i < len(xs) else None  # noqa: B023, E731
                yield name, kind, heading, number, label, i, at(categories), _number(at(values) or ""), _number(at(sizes) or "")
            number += 1


def chart_xml(series: list[tuple[str, list[str], list[float | None]]], kind: str = "barChart", title: str | None = None) -> bytes:
    """A chart part with the cached points of (name, categories, values)."""
    cache = lambda outer, inner, xs: f"<c:{outer}><c:{inner}><c:ptCount val=\"{len(xs)}\"/>" + "".join(f'<c:pt idx="{i}"><c:v>{escape(str(x))}</c:v></c:pt>' for i, x in enumerate(xs) if x is not None) + f"</c:{inner}></c:{outer}>"
    body = "".join(f'<c:ser><c:idx val="{k}"/><c:order val="{k}"/><c:tx><c:v>{escape(name)}</c:v></c:tx>{cache("cat", "strLit", cats)}{cache("val", "numLit", [None if v is None else repr(v) for v in values])}</c:ser>' for k, (name, cats, values) in enumerate(series))
    head = f"<c:title><c:tx><c:rich><a:p><a:r><a:t>{escape(title)}</a:t></a:r></a:p></c:rich></c:tx></c:title>" if title else ""
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><c:chartSpace xmlns:c="{C[1:-1]}" xmlns:a="{A[1:-1]}"><c:chart>{head}<c:plotArea><c:{kind}>{body}</c:{kind}></c:plotArea></c:chart></c:chartSpace>'.encode()


def with_chart_data(xml: bytes, series: list[tuple[list[str], list[float | None]]]) -> bytes:
    """A chart part with other points in the caches of its series, as many as it has; all else stays."""
    root = ET.fromstring(xml)
    own = list(root.iter(C + "ser"))
    if len(own) != len(series):
        raise ValueError(f"the chart has {len(own)} series, not {len(series)}")
    for e, (categories, values) in zip(own, series, strict=True):
        for names, xs in ((("cat", "xVal"), categories), (("val", "yVal"), values)):
            section = next((x for n in names if (x := e.find(C + n)) is not None), None)
            cache = None if section is None else next((p for p in section.iter() if p.find(C + "ptCount") is not None or p.find(C + "pt") is not None), None)
            if cache is None:
                continue
            for p in cache.findall(C + "pt"):
                cache.remove(p)
            count = cache.find(C + "ptCount")
            if count is not None:
                count.set("val", str(len(xs)))
            for i, x in enumerate(xs):
                if x is not None:
                    ET.SubElement(ET.SubElement(cache, C + "pt", {"idx": str(i)}), C + "v").text = x if isinstance(x, str) else repr(x)
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def charts(content: bytes) -> Iterator[tuple]:
    """POINTS of every chart part of a package."""
    p = Package(content)
    for name in sorted(p.names):
        if "/charts/chart" in name and name.endswith(".xml"):
            yield from chart_points(p.read(name), name)


MACROS = "module string, kind string, stream string, code string"
KINDS = {0x21: "standard", 0x22: "class"}


def macros(content: bytes) -> Iterator[tuple]:
    """MACROS of a macro project (a compound file), or of the one in a package, in the order of its directory."""
    if content[:2] == b"PK":
        p = Package(content)
        part = next((n for n in sorted(p.names) if n.endswith("vbaProject.bin")), None)
        if part is None:
            return
        content = p.read(part)
    file = CompoundFile(content)
    root = next((s.removesuffix("dir") for s in file.streams if s.lower().endswith("vba/dir")), None)
    if root is None:
        raise ValueError("no macro directory")
    raw, at, page, own = vba_decompress(file.read(root + "dir")), 0, "cp1252", {}
    while at + 6 <= len(raw):
        kind, size = struct.unpack_from("<HI", raw, at)
        if kind == 0x0009:  # its size leaves out the last two bytes
            size = 6
        data, at = raw[at + 6 : at + 6 + size], at + 6 + size
        if kind == 0x0003:
            page = f"cp{struct.unpack('<H', data)[0]}"
            page = {"cp65001": "utf-8", "cp10000": "mac-roman"}.get(page, page)
        elif kind == 0x0019:
            own = {"module": data.decode(page, "replace"), "kind": "standard", "stream": None, "offset": 0}
        elif kind == 0x001A and own:
            own["stream"] = data.decode(page, "replace")
        elif kind == 0x0031 and own:
            own["offset"] = struct.unpack("<I", data)[0]
        elif kind in KINDS and own:
            own["kind"] = KINDS[kind]
        elif kind == 0x002B and own:
            stream = own["stream"] or own["module"]
            code = vba_decompress(file.read(root + stream)[own["offset"] :]).decode(page, "replace") if root + stream in file.streams else None
            yield own["module"], own["kind"], stream, code
            own = {}


def macro_listing(rows: list[tuple]) -> str:
    """All modules' source, each under its name."""
    return "\n".join(f"' {module}\n{code or ''}" for module, _, _, code in rows)


PROPERTIES = "set_no int, id int, property string, kind string, value string"
#: Names of the properties of the summary information set.
SUMMARY = {2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "comments", 7: "template", 8: "lastsavedby", 9: "revision", 10: "edittime", 11: "lastprinted", 12: "createdate", 13: "savedate", 14: "numpages", 15: "numwords", 16: "numchars", 18: "application", 19: "security"}
SUMMARY_ID = bytes.fromhex("e0859ff2f94f6810ab9108002b27b3d9")


def property_set(raw: bytes) -> Iterator[tuple]:
    """PROPERTIES of a property-set stream, typed: integer, real, boolean, date (UTC), text or empty; other types are left out."""
    if len(raw) < 28 or struct.unpack_from("<H", raw)[0] != 0xFFFE:
        raise ValueError("not a property set")
    for n in range(min(struct.unpack_from("<I", raw, 24)[0], 16)):
        format_id, start = raw[28 + 20 * n : 44 + 20 * n], struct.unpack_from("<I", raw, 44 + 20 * n)[0]
        count = struct.unpack_from("<I", raw, start + 4)[0]
        places = [struct.unpack_from("<II", raw, start + 8 + 8 * k) for k in range(min(count, (len(raw) - start - 8) // 8))]
        own = {i: start + at for i, at in places}
        page = struct.unpack_from("<H", raw, own[1] + 4)[0] if 1 in own else 1252
        encoding = {65001: "utf-8", 1200: "utf-16-le"}.get(page, f"cp{page}")
        for i, at in sorted(own.items()):
            if i < 2 or at + 4 > len(raw):
                continue
            kind, found = struct.unpack_from("<H", raw, at)[0], None
            if kind in (2, 3, 18, 19, 20, 21):
                found = ("integer", str(struct.unpack_from({2: "<h", 3: "<i", 18: "<H", 19: "<I", 20: "<q", 21: "<Q"}[kind], raw, at + 4)[0]))
            elif kind in (4, 5):
                found = ("real", repr(struct.unpack_from("<f" if kind == 4 else "<d", raw, at + 4)[0]))
            elif kind == 11:
                found = ("boolean", "true" if struct.unpack_from("<H", raw, at + 4)[0] else "false")
            elif kind in (30, 31):
                size = struct.unpack_from("<I", raw, at + 4)[0]
                text = raw[at + 8 : at + 8 + size * (2 if kind == 31 else 1)].decode("utf-16-le" if kind == 31 else encoding, "replace")
                found = ("text", text.split("\0")[0])
            elif kind == 64:
                ticks = struct.unpack_from("<Q", raw, at + 4)[0]
                when = datetime(1601, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=ticks // 10) if ticks < 1 << 61 else None
                found = ("date", when.strftime("%Y-%m-%d %H:%M:%S")) if when else None
            elif kind == 0:
                found = ("empty", "")
            if found:
                yield n, i, SUMMARY.get(i) if format_id == SUMMARY_ID else None, *found


def summary(content: bytes) -> Iterator[tuple]:
    """PROPERTIES of a compound file's summary information."""
    file = CompoundFile(content)
    for name in ("\x05SummaryInformation", "\x05DocumentSummaryInformation"):
        if name in file.streams:
            yield from property_set(file.read(name))


EMBEDDED = "part string, program string, name string, size long, sha256 string"


def embedded(content: bytes) -> Iterator[tuple]:
    """EMBEDDED files of a package: program ids where the document names them, the stored name and bytes of packaged ones."""
    p = Package(content)
    programs = {}
    for source in list(p.names):
        if source.endswith("document.xml"):
            links, root = p.relationships(source), p.xml(source)
            for e in root.iter("{urn:schemas-microsoft-com:office:office}OLEObject"):
                link = links.get(e.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", ""))
                if link:
                    programs[link[1]] = e.get("ProgID")
    for name in sorted(p.names):
        if "/embeddings/" not in name:
            continue
        data, label = p.read(name), name.rpartition("/")[2]
        if data[:8] == CompoundFile.MAGIC:
            streams = CompoundFile(data)
            native = next((s for s in streams.streams if s.endswith("\x01Ole10Native")), None)
            if native:
                label, data = ole_native(streams.read(native))
        yield name, programs.get(name), label, len(data), hashlib.sha256(data).hexdigest()


def ole_native(raw: bytes) -> tuple[str, bytes]:
    """(name, bytes) of a packaged file: a size, a mark, three texts that end in a zero, then the size again and the bytes."""
    at = 6
    name, _, rest = raw[at:].partition(b"\0")
    source, _, rest = rest.partition(b"\0")
    rest = rest[4:]
    size = struct.unpack_from("<I", rest)[0]
    rest = rest[4 + size :]
    n = struct.unpack_from("<I", rest)[0]
    return name.decode("cp1252", "replace"), rest[4 : 4 + n]


SIGNATURES = "part string, signed_part string, algorithm string, digest string, matches boolean, time string, signer string"


def signatures(content: bytes) -> Iterator[tuple]:
    """SIGNATURES of a package: a row for each part that a signature covers, whether the part's bytes still have the digest (null for
    parts that are transformed before, or hashed by what isn't known here), the stated time, and the certificate's SHA-256.

    Digests tell whether covered parts are unchanged; the signature value and the certificate's chain are not verified.
    """
    p = Package(content)
    for name in sorted(p.names):
        if "/_xmlsignatures/" not in name or not name.endswith(".xml"):
            continue
        root = p.xml(name)
        time = next((e.text for e in root.iter() if e.tag.endswith("}SigningTime") or e.tag.endswith("}Value")), None)
        certificate = next((e.text for e in root.iter(DS + "X509Certificate")), None)
        signer = None if certificate is None else hashlib.sha256(base64.b64decode("".join(certificate.split()))).hexdigest()
        for ref in root.iter(DS + "Reference"):
            part = (ref.get("URI") or "").split("?")[0]
            if not part.startswith("/"):
                continue
            method = ref.find(DS + "DigestMethod")
            algorithm = "" if method is None else method.get("Algorithm", "").rsplit("#", 1)[-1].lower()
            want, data = ref.findtext(DS + "DigestValue"), p.read(part)
            plain = ref.find(DS + "Transforms") is None
            same = None
            if data is None:
                same = False
            elif plain and algorithm in ("sha1", "sha256", "sha384", "sha512"):
                same = base64.b64encode(hashlib.new(algorithm, data).digest()).decode() == "".join((want or "").split())
            yield name, part, algorithm, want, same, time, signer


EXTENSIONS = "part string, id string, version string, store string, store_type string, name string, value string"


def web_extensions(content: bytes) -> Iterator[tuple]:
    """EXTENSIONS of a package: a row for each property of each web extension, or one without."""
    p = Package(content)
    for name in sorted(p.names):
        if "/webextension" not in name.lower() or not name.endswith(".xml"):
            continue
        root = p.xml(name)
        local = lambda e, n: [x for x in e.iter() if x.tag.rpartition("}")[2] == n]
        if root.tag.rpartition("}")[2] != "webextension":
            continue
        ref = next(iter(local(root, "reference")), None)
        head = (name, root.get("id"), *(None if ref is None else ref.get(k) for k in ("version", "store", "storeType")))
        rows = [(x.get("name"), x.get("value")) for x in local(root, "property")]
        for pair in rows or [(None, None)]:
            yield *head, *pair


ADD_INS = "id string, version string, provider string, locale string, name string, kind string, source string"


def add_in(content: bytes) -> Iterator[tuple]:
    """ADD_INS: the one row of an add-in's manifest."""
    root = ET.fromstring(content)
    local = {}
    for e in root:
        local.setdefault(e.tag.rpartition("}")[2], e)
    text = lambda n: None if n not in local else (local[n].text or "").strip() or local[n].get("DefaultValue")
    kind = next((v for k, v in root.attrib.items() if k.endswith("}type")), None)
    source = next((e.get("DefaultValue") for e in root.iter() if e.tag.rpartition("}")[2] == "SourceLocation"), None)
    yield text("Id"), text("Version"), text("ProviderName"), text("DefaultLocale"), text("DisplayName"), kind, source


LOCKS = "path string, name string, value string"


def lock_fields(content: bytes) -> Iterator[tuple]:
    """LOCKS: every attribute and text of a co-authoring lock file's XML, under its element's path."""

    def walk(e: ET.Element, path: str) -> Iterator[tuple]:
        here = f"{path}/{e.tag.rpartition('}')[2]}"
        for k, v in e.attrib.items():
            yield here, k.rpartition("}")[2], v
        if (e.text or "").strip():
            yield here, None, e.text.strip()
        for c in e:
            yield from walk(c, here)

    yield from walk(ET.fromstring(lock_file(content)), "")


IMAGES = "part string, kind string, width int, height int, size long, sha256 string"


def images(content: bytes) -> Iterator[tuple]:
    """IMAGES of a package's media folder; equal bytes have equal digests."""
    p = Package(content)
    for name in sorted(p.names):
        if "/media/" in name:
            data = p.read(name)
            yield name, *(image_header(data) or (None, None, None)), len(data), hashlib.sha256(data).hexdigest()


READERS = {"charts": (charts, POINTS), "macros": (macros, MACROS), "summary": (summary, PROPERTIES), "embedded": (embedded, EMBEDDED), "signatures": (signatures, SIGNATURES), "web_extensions": (web_extensions, EXTENSIONS), "add_in": (add_in, ADD_INS), "lock": (lock_fields, LOCKS), "images": (images, IMAGES)}


def read(files: DataFrame, what: str, id_col: str = "path", mode: str = "PERMISSIVE") -> DataFrame:
    """(id, rows of what, error) of every file; what is one of READERS."""
    reader, schema = READERS[what]
    width = len(schema.split(","))

    def rows(doc, content: bytes | None) -> list[tuple]:
        try:
            return [(doc, *r, None) for r in reader(content or b"")]
        except Exception as e:
            if mode == "FAILFAST":
                raise
            return [(doc, *[None] * width, f"{type(e).__name__}: {e}")]

    return map_rows(files, [id_col, "content"], rows, f"{id_col} {files.schema[id_col].dataType.simpleString()}, {schema}, error string")


def compound_bytes(streams: dict[str, bytes]) -> bytes:
    """A compound file (version 3) with streams by path; the same bytes for the same streams.

    Streams below 4096 bytes share the root's stream in pieces of 64 bytes. Siblings form a chain in the order of the format.
    """
    size, mini, cutoff, end, free = 512, 64, 4096, 0xFFFFFFFE, 0xFFFFFFFF
    nodes: list[dict] = [{"name": "Root Entry", "kind": 5, "children": {}}]

    def node(name: str, parent: int, kind: int, data: bytes = b"") -> int:
        own = nodes[parent]["children"]
        if name not in own:
            nodes.append({"name": name, "kind": kind, "children": {}, "data": data})
            own[name] = len(nodes) - 1
        return own[name]

    for path in sorted(streams):
        *folders, last = path.split("/")
        at = 0
        for f in folders:
            at = node(f, at, 1)
        node(last, at, 2, streams[path])
    fat: list[int] = []
    sectors: list[bytes] = []

    def store(data: bytes) -> int:
        n = -(-len(data) // size)
        if not n:
            return end
        first = len(sectors)
        sectors.extend(data[k * size : (k + 1) * size].ljust(size, b"\0") for k in range(n))
        fat.extend([*range(first + 1, first + n), end])
        return first

    small, small_fat = b"", []
    for x in nodes:
        if x["kind"] != 2:
            continue
        data = x["data"]
        if len(data) >= cutoff:
            x["start"] = store(data)
        elif data:
            first, n = len(small_fat), -(-len(data) // mini)
            small += data.ljust(n * mini, b"\0")
            small_fat += [*range(first + 1, first + n), end]
            x["start"] = first
        else:
            x["start"] = end
    nodes[0]["start"], nodes[0]["data"] = store(small), small
    entries = []
    links = [[free, free, free] for _ in nodes]
    for k, x in enumerate(nodes):
        order = sorted(x["children"].items(), key=lambda c: (len(c[0].encode("utf-16-le")), c[0].upper()))
        if order:
            links[k][2] = order[0][1]
        for (_, a), (_, b) in zip(order, order[1:], strict=False):
            links[a][1] = b
    for k, x in enumerate(nodes):
        name = x["name"].encode("utf-16-le") + b"\0\0"
        if len(name) > 64:
            raise ValueError("a name has more than 31 characters")
        body = x.get("data", b"") if x["kind"] in (2, 5) else b""
        entries.append(name.ljust(64, b"\0") + struct.pack("<HBBIII16sIQQIQ", len(name), x["kind"], 1, *links[k], b"", 0, 0, 0, x.get("start", 0) if x["kind"] != 1 else 0, len(body)))
    while len(entries) % 4:
        entries.append(b"\0" * 64 + struct.pack("<HBBIII16sIQQIQ", 0, 0, 0, free, free, free, b"", 0, 0, 0, 0, 0))
    directory = store(b"".join(entries))
    table = b"".join(struct.pack("<I", x) for x in small_fat)
    n_mini = -(-len(table) // size)
    mini_at = store(table.ljust(n_mini * size, b"\xff")) if table else end
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat:
        n_fat += 1
    if n_fat > 109:
        raise ValueError("the streams take more than this writer's table holds")
    at = list(range(len(sectors), len(sectors) + n_fat))
    fat += [0xFFFFFFFD] * n_fat
    fat += [free] * (n_fat * 128 - len(fat))
    raw = b"".join(struct.pack("<I", x) for x in fat)
    head = CompoundFile.MAGIC + b"\0" * 16 + struct.pack("<HHHHH6sIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, b"", 0, n_fat, directory, 0, cutoff, mini_at, n_mini, end, 0)
    return head + b"".join(struct.pack("<I", x) for x in [*at, *[free] * (109 - n_fat)]) + b"".join(sectors) + raw
