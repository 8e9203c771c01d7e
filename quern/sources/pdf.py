"""PDF files as pages of glyphs: a small reader for plain documents, and the place to plug in a full one.

The reader knows indirect objects, Flate streams, object streams, the page tree, simple fonts with widths and
ToUnicode maps, text operators and rectangles. What it doesn't know raises, and the document fails with the message.
A glyph table made by any other tool is as good an input: ``pages`` of operators.pages is the contract.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, is_pdf
from ..operators.pages import GLYPHS, RECTS

#: How far from the end the mark of a file's end is looked for.
SCAN_BACK = 1 << 20
_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]+\s*)*(<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+)", re.S)


@dataclass
class ParsedPage:
    glyphs: list[dict] = field(default_factory=list)
    rects: list[dict] = field(default_factory=list)


@dataclass
class ParsedPdf:
    title: str
    pages: list[ParsedPage]


@dataclass(frozen=True)
class Ref:
    number: int


class Name(str):
    pass


def trim_trailing_junk(data: bytes) -> bytes:
    """Without what follows the last end mark; whole if there is none within the last megabyte."""
    at = data.rfind(b"%%EOF", max(0, len(data) - SCAN_BACK))
    return data if at < 0 else data[: at + 5]


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def one(m: re.Match) -> bytes:
        e = m[1]
        return bytes([int(e, 8) & 255]) if e[:1].isdigit() else b"" if e in b"\r\n" else plain.get(e, e)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def _values(data: bytes, at: int = 0) -> Iterator[object]:
    """Objects of a byte string in order; operators are plain strings; numbers followed by ``R`` become a Ref."""
    stack: list[list] = [[]]
    while m := _TOKEN.match(data, at):
        at, t = m.end(), m[1]
        if t in (b"<<", b"["):
            stack.append([])
        elif t in (b">>", b"]"):
            items = stack.pop()
            stack[-1].append(dict(zip(items[::2], items[1::2], strict=False)) if t == b">>" else items)
        elif t == b"R" and len(stack[-1]) >= 2:
            number = stack[-1][-2]
            del stack[-1][-2:]
            stack[-1].append(Ref(int(number)))
        elif t[:1] in b"(<":
            stack[-1].append(_string(t))
        elif t[:1] == b"/":
            stack[-1].append(Name(t[1:].decode("latin-1")))
        elif re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", t):
            stack[-1].append(float(t) if b"." in t else int(t))
        else:
            stack[-1].append(t.decode("latin-1"))
        if len(stack) == 1 and len(stack[0]) > 2:
            yield stack[0].pop(0)
    yield from stack[0]


class Pdf:
    def __init__(self, data: bytes) -> None:
        data = trim_trailing_junk(data)
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s", data):
            raise ValueError("encrypted PDF files aren't read")
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S):
            head, mark, rest = m[2].partition(b"stream")
            stream = rest.removeprefix(b"\r").removeprefix(b"\n").rpartition(b"endstream")[0] if mark else None
            self.objects[int(m[1])] = (next(_values(head), None), stream)
        for value, _ in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._unpack(value)
        trailers = [v for m in re.finditer(rb"trailer\s*(<<.*?>>)\s*(?:startxref|xref|$)", data, re.S) for v in _values(m[1])]
        self.trailer = {k: v for t in [*trailers, *(o for o, _ in self.objects.values() if isinstance(o, dict) and o.get("Type") == "XRef")] if isinstance(t, dict) for k, v in t.items()}

    def _unpack(self, head: dict) -> None:
        body = self._decoded(head, next(s for v, s in self.objects.values() if v is head))
        first = int(self.get(head["First"]))
        numbers = [int(x) for x in body[:first].split()]
        for number, at in zip(numbers[::2], numbers[1::2], strict=True):
            self.objects.setdefault(number, (next(_values(body, first + at), None), None))

    def get(self, value: object) -> object:
        while isinstance(value, Ref):
            value = self.objects.get(value.number, (None, None))[0]
        return value

    def _decoded(self, head: dict, stream: bytes) -> bytes:
        filters = self.get(head.get("Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if name != "FlateDecode":
                raise ValueError(f"filter {name} isn't read")
            stream = zlib.decompressobj().decompress(stream)
        return stream

    def stream(self, value: object) -> bytes:
        if isinstance(value, list):
            return b"\n".join(self.stream(v) for v in value)
        if isinstance(value, Ref):
            head, stream = self.objects.get(value.number, (None, None))
            if stream is not None:
                return self._decoded(head, stream)
            return self.stream(head) if isinstance(head, list) else b""
        return b""

    def page_dicts(self) -> list[dict]:
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict):
            root = next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
        found: list[dict] = []

        def walk(node: object, inherited: dict, depth: int) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > 64:
                return
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, own, depth + 1)
            else:
                found.append(own | node)

        walk(root.get("Pages"), {}, 0)
        return found

    def title(self) -> str:
        info = self.get(self.trailer.get("Info"))
        raw = self.get(info.get("Title")) if isinstance(info, dict) else None
        if not isinstance(raw, bytes):
            return ""
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


@dataclass
class Font:
    name: str
    wide: bool
    widths: dict[int, float]
    default: float
    unicode: dict[int, str]

    def codes(self, raw: bytes) -> list[int]:
        return [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if self.wide else list(raw)

    def text(self, code: int) -> str:
        return self.unicode.get(code, "�" if self.wide else bytes([code]).decode("cp1252", "replace"))


def _to_unicode(data: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            start = text(c)
            for k in range(int(b, 16) - int(a, 16) + 1):
                out[int(a, 16) + k] = start[:-1] + chr(ord(start[-1]) + k)
    return out


def _font(pdf: Pdf, value: object) -> Font:
    d = pdf.get(value) or {}
    name = re.sub(r"^[A-Z]{6}\+", "", str(pdf.get(d.get("BaseFont")) or "")) or "Font"
    unicode = _to_unicode(pdf.stream(d["ToUnicode"])) if "ToUnicode" in d else {}
    if d.get("Subtype") == "Type0":
        inner = pdf.get((pdf.get(d.get("DescendantFonts")) or [{}])[0]) or {}
        widths, items = {}, [pdf.get(x) for x in (pdf.get(inner.get("W")) or [])]
        while items:
            first, second = items.pop(0), items.pop(0)
            if isinstance(second, list):
                widths |= {int(first) + k: float(w) for k, w in enumerate(second)}
            else:
                widths |= dict.fromkeys(range(int(first), int(second) + 1), float(items.pop(0)))
        return Font(name, True, widths, float(pdf.get(inner.get("DW")) or 1000), unicode)
    first = int(pdf.get(d.get("FirstChar")) or 0)
    widths = {first + k: float(pdf.get(w)) for k, w in enumerate(pdf.get(d.get("Widths")) or [])}
    return Font(name, False, widths, 500.0, unicode)


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def read_page(pdf: Pdf, page: dict) -> ParsedPage:
    """Glyphs and rectangles that the page's own content draws."""
    out, fonts = ParsedPage(), {}
    resources = pdf.get(page.get("Resources")) or {}
    for key, value in (pdf.get(resources.get("Font")) or {}).items():
        fonts[key] = _font(pdf, value)
    ctm, saved = _UNIT, []
    tm = lm = _UNIT
    font, size, leading, chars, words, scale, rise = Font("Font", False, {}, 500.0, {}), 0.0, 0.0, 0.0, 0.0, 1.0, 0.0
    args: list = []

    def show(raw: bytes) -> None:
        nonlocal tm
        for code in font.codes(raw):
            width = font.widths.get(code, font.default) / 1000
            at = _times((size * scale, 0, 0, size, 0, rise), _times(tm, ctm))
            out.glyphs.append({"font": font.name, "font_size": abs(at[3]) or abs(at[1]), "x": at[4], "y": at[5], "w": width * at[0], "s": font.text(code)})
            step = (width * size + chars + (words if code == 32 and not font.wide else 0)) * scale
            tm = _times((1, 0, 0, 1, step, 0), tm)

    def line(x: float, y: float) -> None:
        nonlocal tm, lm
        tm = lm = _times((1, 0, 0, 1, x, y), lm)

    for value in _values(pdf.stream(page.get("Contents"))):
        if not isinstance(value, str) or isinstance(value, Name):
            args.append(value)
            continue
        op, a = value, args
        args = []
        if op == "q":
            saved.append(ctm)
        elif op == "Q":
            ctm = saved.pop() if saved else ctm
        elif op == "cm":
            ctm = _times(tuple(a[-6:]), ctm)
        elif op == "BT":
            tm = lm = _UNIT
        elif op == "Tf":
            font, size = fonts.get(a[0], font), float(a[1])
        elif op in ("Td", "TD"):
            leading = -a[1] if op == "TD" else leading
            line(a[0], a[1])
        elif op == "Tm":
            tm = lm = tuple(map(float, a[-6:]))
        elif op == "T*":
            line(0, -leading)
        elif op in ("TL", "Tc", "Tw", "Tz", "Ts"):
            if op == "TL":
                leading = a[0]
            elif op == "Tc":
                chars = a[0]
            elif op == "Tw":
                words = a[0]
            elif op == "Tz":
                scale = a[0] / 100
            else:
                rise = a[0]
        elif op in ("Tj", "'", '"'):
            if op != "Tj":
                line(0, -leading)
            if op == '"':
                words, chars = a[0], a[1]
            show(a[-1])
        elif op == "TJ":
            for item in a[-1]:
                if isinstance(item, bytes):
                    show(item)
                else:
                    tm = _times((1, 0, 0, 1, -item / 1000 * size * scale, 0), tm)
        elif op == "re":
            x, y, w, h = a[-4:]
            (x0, y0), (x1, y1) = ((_times((1, 0, 0, 1, px, py), ctm)[4:]) for px, py in ((x, y), (x + w, y + h)))
            out.rects.append({"x0": min(x0, x1), "y0": min(y0, y1), "x1": max(x0, x1), "y1": max(y0, y1)})
    return out


def parse_pdf(data: bytes) -> ParsedPdf:
    pdf = Pdf(data)
    return ParsedPdf(pdf.title(), [read_page(pdf, p) for p in pdf.page_dicts()])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, content, size_bytes, content_hash, modified) of the .pdf files at ``path``."""
    files = spark.read.format("binaryFile").load(path)
    named = files.withColumn("filename", F.regexp_extract("path", r"([^/]*)$", 1)).where(is_pdf(F.col("filename")))
    return named.select("path", "filename", "content", F.col("length").alias("size_bytes"), content_hash(F.col("content")).alias("content_hash"), F.col("modificationTime").alias("modified"))


def parse_files(files: DataFrame, *, parser: Callable[[bytes], ParsedPdf] = parse_pdf, id_col: str = "document_id") -> DataFrame:
    """(document_id, page, glyphs, rects, title, error) of ``files`` (document_id, content); a file that can't be read is
    one row of page 0 with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, content in zip(pdf[id_col], pdf["content"], strict=True):
                try:
                    parsed = parser(bytes(content))
                    rows += [[key, n, p.glyphs, p.rects, parsed.title, None] for n, p in enumerate(parsed.pages, 1)]
                except Exception as error:
                    rows.append([key, 0, [], [], "", f"{type(error).__name__}: {error}"[:500]])
            yield pd.DataFrame(rows, columns=["document_id", "page", "glyphs", "rects", "title", "error"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, "content").mapInPandas(run, f"document_id {kind}, page int, glyphs {GLYPHS}, rects {RECTS}, title string, error string")
