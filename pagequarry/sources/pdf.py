"""Text of PDF files: objects, page tree, text operators and ToUnicode maps, by the standard library alone.

Read are plain and Flate streams, object streams, and strings of fonts with a ToUnicode map or of one byte a
character (Latin). Encrypted files and files without a page tree are an error; a page that can't be read is
skipped. The first PAGES pages count.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = 50
#: Bytes that one stream may unpack to.
STREAM_CAP = 64 << 20

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_TOKEN = re.compile(
    rb"""\s+|%[^\r\n]*|(?P<string>\()|(?P<open><<|\[)|(?P<close>>>|\])|<(?P<hex>[0-9A-Fa-f\s]*)>|/(?P<name>[^\s()<>\[\]{}/%]*)"""
    rb"""|(?P<ref>\d+\s+\d+\s+R\b)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<word>[^\s()<>\[\]{}/%]+)|."""
)
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}


class Ref(int):
    """The number of an object that stands elsewhere."""


class Word(bytes):
    """A bare word: an operator, true, false or null."""


class Name(str):
    """A name, without its slash."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets, that begins at `at`, and where it ends."""
    out, depth = bytearray(), 1
    for m in re.compile(rb"\\([0-7]{1,3}|\r\n|.)|[()]|[^\\()]+", re.S).finditer(data, at):
        part = m[0]
        if part == b"(":
            depth += 1
        elif part == b")":
            depth -= 1
            if not depth:
                return bytes(out), m.end()
        elif m[1]:
            part = bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPE.get(m[1][:1], m[1])
        out += part
    return bytes(out), len(data)


def tokens(data: bytes, at: int = 0):
    """Values of a run of PDF syntax: numbers, bytes, names, references, words, lists and dicts; and where each ends."""
    stack: list[list] = []
    while m := _TOKEN.match(data, at):
        at = m.end()
        kind = m.lastgroup
        if kind is None:
            continue
        if kind == "open":
            stack.append([m[0]])
            continue
        if kind == "close":
            if not stack:
                continue
            opened, *items = stack.pop()
            value = items if opened == b"[" else {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}
        elif kind == "string":
            value, at = _string(data, at)
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", m["hex"])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "name":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m["name"]).decode("latin-1"))
        elif kind == "ref":
            value = Ref(m[0].split()[0])
        elif kind == "number":
            value = float(m[0])
        else:
            value = Word(m[0])
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


class File:
    """The objects of a file by number; of a number the last one in the file counts."""

    def __init__(self, data: bytes):
        self.data = data
        self.places = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}
        self.packed: dict[int, tuple[bytes, int]] = {}
        for n in list(self.places):
            value, _ = self._at(n)
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._unpack(n, value)

    def _at(self, n: int):
        if n in self.packed:
            return next(tokens(*self.packed[n]), (None, 0))[0], -1
        if n not in self.places:
            return None, -1
        return next(tokens(self.data, self.places[n]), (None, -1))

    def _unpack(self, n: int, about: dict) -> None:
        body = self.stream(n)
        first = int(self.get(about.get("First")) or 0)
        numbers = [int(v) for v, _ in tokens(body[:first]) if isinstance(v, float)]
        for number, place in zip(numbers[::2], numbers[1::2]):
            if number not in self.places:
                self.packed[number] = body, first + place

    def get(self, value):
        """A value, looked up where it stands elsewhere."""
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            value = self._at(value)[0]
        return None

    def stream(self, n: int) -> bytes:
        about, end = self._at(n)
        if end < 0 or not isinstance(about, dict) or not (m := re.compile(rb"\s*stream\r?\n?").match(self.data, end)):
            return b""
        size = self.get(about.get("Length"))
        stop = m.end() + int(size) if isinstance(size, float) and self.data[m.end() + int(size) :].lstrip()[:9] == b"endstream" else self.data.find(b"endstream", m.end())
        body = self.data[m.end() : stop if stop >= 0 else None]
        filters = self.get(about.get("Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if name not in ("FlateDecode", "Fl"):
                raise ValueError(f"The stream's filter {name} is unknown.")
            body = zlib.decompressobj().decompress(body, STREAM_CAP)
        return body

    def pages(self):
        """The page dictionaries, in order, with what they inherit."""
        roots = [self._at(n)[0] for n in (*self.places, *self.packed)]
        catalogue = next((r for r in roots if isinstance(r, dict) and r.get("Type") == "Catalog"), None)
        if not catalogue or re.search(rb"trailer[^%]*?/Encrypt\b", self.data):
            raise ValueError("The file is encrypted or has no pages.")
        seen: set[int] = set()
        ahead = [(catalogue.get("Pages"), {})]
        while ahead:
            at, above = ahead.pop()
            if isinstance(at, Ref):
                if at in seen:
                    continue
                seen.add(at)
            node = self.get(at)
            if not isinstance(node, dict):
                continue
            node = {**above, **node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                ahead += [(k, {"Resources": node.get("Resources")}) for k in reversed(kids)]
            else:
                yield node

    def page_text(self, page: dict) -> str:
        contents = page.get("Contents")
        contents = contents if isinstance(contents, Ref) and not isinstance(self.get(contents), list) else self.get(contents)
        body = b"\n".join(self.stream(r) for r in (contents if isinstance(contents, list) else [contents]) if isinstance(r, Ref))
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        maps = {name: self._unicode(font) for name, font in fonts.items()}
        out, operands, font = [], [], None
        for value, _ in tokens(body):
            if not isinstance(value, Word):
                operands.append(value)
                continue
            if value == b"Tf" and len(operands) > 1:
                font = maps.get(operands[-2])
            elif value in (b"Tj", b"'", b'"') and operands and isinstance(operands[-1], bytes):
                out += ([] if value == b"Tj" else ["\n"]) + [_shown(operands[-1], font)]
            elif value == b"TJ" and operands and isinstance(operands[-1], list):
                out += [_shown(x, font) if isinstance(x, bytes) else " " if isinstance(x, float) and x < -200 else "" for x in operands[-1]]
            elif value in (b"Td", b"TD") and len(operands) > 1:
                out.append("\n" if operands[-1] else " ")
            elif value in (b"T*", b"Tm", b"ET"):
                out.append("\n")
            operands = []
        return "".join(out)

    def _unicode(self, font) -> dict[bytes, str] | None:
        """What each code of a font stands for, if it says so."""
        at = (self.get(font) or {}).get("ToUnicode")
        if not isinstance(at, Ref):
            return None
        out, operands = {}, []
        for value, _ in tokens(self.stream(at)):
            if not isinstance(value, Word):
                operands.append(value)
                continue
            if value == b"endbfchar":
                out |= {a: b.decode("utf-16-be", "replace") for a, b in zip(operands[::2], operands[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif value == b"endbfrange":
                for low, high, to in zip(operands[::3], operands[1::3], operands[2::3]):
                    for i in range(min(int.from_bytes(high) - int.from_bytes(low) + 1, 1 << 16)):
                        code = (int.from_bytes(low) + i).to_bytes(len(low))
                        if isinstance(to, list):
                            out |= {code: to[i].decode("utf-16-be", "replace")} if i < len(to) else {}
                        else:
                            out[code] = (int.from_bytes(to) + i).to_bytes(len(to)).decode("utf-16-be", "replace")
            operands = []
        return out


def _shown(code: bytes, font: dict[bytes, str] | None) -> str:
    if not font:
        return code.decode("cp1252", "replace")
    width = max(map(len, font))
    return "".join(font.get(code[i : i + width], "") for i in range(0, len(code), width))


def text_of(data: bytes) -> str:
    """The text of the first pages, white space collapsed; ValueError if the file has none to read."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("The file is no PDF.")
    file, out, failed, n = File(data), [], None, 0
    for n, page in enumerate(file.pages(), 1):
        if n > PAGES:
            break
        try:
            out.append(file.page_text(page))
        except (ValueError, TypeError, AttributeError, IndexError, OverflowError, zlib.error) as e:
            failed = e
    if failed and not any(out):
        raise ValueError(f"No page can be read: {failed}")
    return " ".join(" ".join(out).split())


_TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_TEXT)
def pdf_text(content: pd.Series) -> pd.DataFrame:
    """text and error of each file: a file that can't be read is a value of its row."""

    def one(data):
        if data is None:
            return None, None
        try:
            return text_of(bytes(data)), None
        except (ValueError, TypeError, AttributeError, IndexError, RecursionError, zlib.error) as e:
            return None, str(e) or type(e).__name__

    return pd.DataFrame([one(x) for x in content], columns=["text", "error"])
