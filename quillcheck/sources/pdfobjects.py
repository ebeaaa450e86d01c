"""Objects of a PDF file: syntax, cross-references, stream filters and the page tree.

A file whose cross-references are damaged is searched for its objects instead. What cannot be read is left out: a missing object is
None, a damaged stream gives the bytes up to the damage. References are followed once each, so cycles end.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

#: Bytes that a stream may come to when it is decoded; longer ones count as damaged and are empty.
LIMIT = 256 << 20
_BLANK = rb"\x00\t\n\x0c\r "
_TOKEN = re.compile(rb"(?:[%b]+|%%[^\r\n]*)*(?:(<<|>>|[\[\]{}()])|<([0-9A-Fa-f%b]*)>|/([^%b()<>\[\]{}/%%]*)|([^%b()<>\[\]{}/%%]+)|(.))" % ((_BLANK,) * 4), re.S)
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})[%b]+(\d{1,5})[%b]+obj\b" % ((_BLANK,) * 2))
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|[\s\S]))")
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
#: Bytes with which a number may begin.
_NUMERIC = b"+-.0123456789\x0b"
_PAREN = re.compile(rb"\\[\s\S]|[()]")


class Name(str):
    """A name, without its slash."""


class Word(str):
    """A keyword or operator."""


class Ref(int):
    """The number of another object."""


class Stream(dict):
    """A dictionary with the stream's raw bytes in ``raw``."""

    raw = b""


def _number(word: bytes):
    if word[0] not in _NUMERIC:
        return None
    try:
        return int(word)
    except ValueError:
        try:
            return float(word) if not word.strip(b"+-.0123456789") else None
        except ValueError:
            return None


class Syntax:
    """Values one after another from a place in some bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self):
        """The next token: kind (a mark, or one of text, name, number, word) and value; kind None at the end."""
        m = _TOKEN.match(self.data, self.at)
        if not m:
            return None, None
        self.at = m.end()
        mark, digits, name, word, _ = m.groups()
        if mark == b"(":
            return "text", self._text()
        if mark:
            return mark.decode(), None
        if digits is not None:
            try:
                return "text", bytes.fromhex(digits.decode())
            except ValueError:  # blanks within a pair, or half a pair
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
                return "text", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if name is not None:
            return "name", Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), name).decode("latin-1"))
        if word is None:
            return self.token()  # a stray sign
        number = _number(word)
        return ("number", number) if number is not None else ("word", Word(word.decode("latin-1")))

    def _text(self) -> bytes:
        start, depth = self.at, 1
        for m in _PAREN.finditer(self.data, start):
            depth += {b"(": 1, b")": -1}.get(m[0], 0)
            if not depth:
                self.at = m.end()
                body = self.data[start : m.start()]
                return _ESCAPE.sub(lambda x: bytes([int(x[1], 8) & 255]) if x[1] else _PLAIN.get(x[2], x[2]), body) if b"\\" in body else body
        self.at = len(self.data)
        return self.data[start:]

    def values(self) -> Iterator:
        """All values up to the end, operators among them. Arrays and dictionaries nest in a list of what is open, not in calls."""
        open_: list[tuple[str, list]] = []
        while True:
            kind, value = self.token()
            if kind is None:
                return
            if kind in ("[", "<<"):
                open_.append((kind, []))
                continue
            if kind in ("]", ">>"):
                if not open_:
                    continue
                opened, items = open_.pop()
                value = items if opened == "[" else {str(k): v for k, v in zip(items[::2], items[1::2]) if isinstance(k, str)}
            elif kind in ("{", "}", ")"):
                continue
            elif kind == "word" and value in ("true", "false", "null"):
                value = {"true": True, "false": False}.get(value)
            elif kind == "word" and value == "R" and open_ and len(open_[-1][1]) > 1 and isinstance(open_[-1][1][-2], int):
                items = open_[-1][1]
                items.pop()
                value = Ref(items.pop())
            if open_:
                open_[-1][1].append(value)
            else:
                yield value


def inflate(data: bytes) -> bytes:
    """Flate data, up to where it is damaged."""
    for wbits in (15, -15):
        out, machine = bytearray(), zlib.decompressobj(wbits)
        try:
            for at in range(0, len(data), 1 << 16):
                piece = data[at : at + (1 << 16)]
                while piece:
                    out += machine.decompress(piece, 1 << 22)
                    piece = machine.unconsumed_tail
                    if len(out) > LIMIT:
                        return b""
        except zlib.error:
            if not out and wbits > 0:
                continue  # without its header
        return bytes(out)
    return b""


def unpredicted(data: bytes, how: dict) -> bytes:
    """Rows of bytes whose differences from their neighbours were stored."""
    kind, colors, bits, columns = (how.get(k, d) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if not isinstance(kind, int) or kind < 2 or not all(isinstance(x, int) and 0 < x < 1 << 20 for x in (colors, bits, columns)):
        return data
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    out, above = bytearray(), bytearray(width)
    if kind == 2:
        for at in range(0, len(data), width):
            row = bytearray(data[at : at + width])
            for i in range(step, len(row) if bits == 8 else 0):
                row[i] = row[i] + row[i - step] & 255
            out += row
        return bytes(out)
    for at in range(0, len(data), width + 1):
        how_row, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(len(row)):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            if how_row == 1:
                row[i] = row[i] + a & 255
            elif how_row == 2:
                row[i] = row[i] + b & 255
            elif how_row == 3:
                row[i] = row[i] + (a + b) // 2 & 255
            elif how_row == 4:
                p = a + b - c
                row[i] = row[i] + min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2] & 255
        out += row
        above = row + bytearray(width - len(row))
    return bytes(out)


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~")[0]:
        if c == 122 and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(x * 85 ** (4 - k) for k, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n, group = len(group), group + [84] * (5 - len(group))
        out += (sum(x * 85 ** (4 - k) for k, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def run_lengths(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    out, table, before, width, held, bits = bytearray(), {}, b"", 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        code, bits = held >> bits - width, bits - width
        held &= (1 << bits) - 1
        if code == 256:
            table, before, width = {}, b"", 9
            continue
        if code == 257:
            break
        now = bytes([code]) if code < 256 else table.get(code, before + before[:1])
        if before:
            table[258 + len(table)] = before + now[:1]
        out += now
        before = now
        width = min(12, max(9, (258 + len(table) + early).bit_length()))
        if len(out) > LIMIT:
            return b""
    return bytes(out)


class File:
    """A PDF file's objects, read when they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.cache, self.trailer = data, {}, {}
        self.places: dict[int, int | tuple[int, int]] = {}  # where in the file, or in which object stream at which index
        self.packed: dict[int, list] = {}
        self.fonts: dict = {}  # what pages have read of fonts, by reference
        self.standing: dict[int, int] | None = None  # objects by their places in the file, where cross-references are wrong
        try:
            self._cross_references()
        except (ValueError, TypeError, IndexError, KeyError, AttributeError):
            pass
        if not isinstance(self.get(self.trailer.get("Root")), dict) or not self._pages_there():
            self._search()

    def _pages_there(self) -> bool:
        root = self.get(self.trailer.get("Root"))
        return isinstance(self.get(root.get("Pages")), dict)

    def _cross_references(self) -> None:
        at = self.data.rfind(b"startxref")
        todo, seen = [next(Syntax(self.data, at + 9).values(), None)] if at >= 0 else [], set()
        while todo:
            at = todo.pop(0)
            if not isinstance(at, int) or at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            s = Syntax(self.data, at)
            if s.token()[1] == "xref":
                trailer = self._table(s)
            else:
                trailer = self._object_at(at)
                if isinstance(trailer, Stream):
                    self._xref_stream(trailer)
            if isinstance(trailer, dict):
                for k, v in trailer.items():
                    self.trailer.setdefault(k, v)
                todo += [trailer.get("XRefStm"), trailer.get("Prev")]

    def _table(self, s: Syntax) -> dict | None:
        while True:
            kind, first = s.token()
            if kind != "number":
                return next(s.values(), None) if first == "trailer" else None
            count = s.token()[1]
            if not isinstance(first, int) or not isinstance(count, int):
                return None
            for number in range(first, first + count):
                (kind, at), _, (_, use) = s.token(), s.token(), s.token()
                if kind is None:
                    return None
                if use == "n" and isinstance(at, int) and 0 <= at < len(self.data):
                    self.places.setdefault(number, at)

    def _xref_stream(self, stream: Stream) -> None:
        data, widths = self.decoded(stream), stream["W"]
        index, row, at = stream.get("Index") or [0, stream["Size"]], sum(widths), 0
        for first, count in zip(index[::2], index[1::2]):
            for number in range(first, first + count):
                part = data[at : at + row]
                at += row
                if len(part) < row:
                    return
                a, b = widths[0], widths[0] + widths[1]
                kind, x, y = int.from_bytes(part[:a], "big") if a else 1, int.from_bytes(part[a:b], "big"), int.from_bytes(part[b:], "big")
                if kind == 1:
                    self.places.setdefault(number, x)
                elif kind == 2:
                    self.places.setdefault(number, (x, y))

    def _search(self) -> None:
        """Objects where they stand in the file; later ones replace earlier ones."""
        self.cache.clear()
        self.places = {int(m[1]): m.start() for m in _OBJECT.finditer(self.data)}
        for number in [*self.places]:
            value = self.get(Ref(number))
            if isinstance(value, Stream) and value.get("Type") == "ObjStm":
                for k, inner in enumerate(self._unpacked(number)):
                    self.places.setdefault(inner[0], (number, k))
        for m in re.finditer(rb"trailer", self.data):
            found = next(Syntax(self.data, m.end()).values(), None)
            if isinstance(found, dict):
                self.trailer |= found
        for number in self.places:
            value = self.get(Ref(number))
            if isinstance(value, dict) and value.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in value.items() if k in ("Root", "Info", "Encrypt")}
            if isinstance(value, dict) and value.get("Type") == "Catalog" and not isinstance(self.get(self.trailer.get("Root")), dict):
                self.trailer["Root"] = Ref(number)

    def _object_at(self, at: int):
        s = Syntax(self.data, at)
        if [s.token()[0], s.token()[0], s.token()[1]] != ["number", "number", "obj"]:
            return None
        value = next(s.values(), None)
        if not isinstance(value, dict):
            return Ref(value) if isinstance(value, int) and [s.token()[0], s.token()[1]] == ["number", "R"] else value
        here = s.at
        if s.token()[1] != "stream":
            return value
        start = self.data.index(b"stream", here) + 6
        start += 2 if self.data[start : start + 2] == b"\r\n" else 1 if self.data[start : start + 1] in (b"\n", b"\r") else 0
        length = value.get("Length")
        length = self.get(length) if isinstance(length, Ref) else length
        if not isinstance(length, int) or length < 0 or not re.match(rb"\s*endstream", self.data[start + length : start + length + 20]):
            end = self.data.find(b"endstream", start)
            length = (end if end >= 0 else len(self.data)) - start
        stream = Stream(value)
        stream.raw = self.data[start : start + length]
        return stream

    def _unpacked(self, number: int) -> list:
        """Objects (number, value) of an object stream."""
        if number not in self.packed:
            self.packed[number] = []
            stream = self.get(Ref(number))
            if isinstance(stream, Stream):
                data, first, n = self.decoded(stream), self.get(stream.get("First")), self.get(stream.get("N"))
                if isinstance(first, int) and isinstance(n, int):
                    head = [x for x in Syntax(data[:first]).values() if isinstance(x, int)][: 2 * n]
                    self.packed[number] = [(k, next(Syntax(data, first + at).values(), None)) for k, at in zip(head[::2], head[1::2])]
        return self.packed[number]

    def _read(self, number: int):
        at = self.places.get(number)
        if isinstance(at, tuple):
            return next((v for k, v in self._unpacked(at[0]) if k == number), None)
        if at is None or Syntax(self.data, at).token()[1] != number:  # a wrong place: look where the object stands
            if self.standing is None:
                self.standing = {int(m[1]): m.start() for m in _OBJECT.finditer(self.data)}
            at = self.standing.get(number)
        return None if at is None else self._object_at(at)

    def get(self, value):
        """A value with its reference followed."""
        for _ in range(8):  # references to references
            if not isinstance(value, Ref):
                return value
            number = int(value)
            if number not in self.cache:
                self.cache[number] = None  # while it is read
                try:
                    self.cache[number] = self._read(number)
                except (ValueError, TypeError, IndexError, KeyError, AttributeError):
                    pass
            value = self.cache[number]
        return None

    def decoded(self, stream: Stream) -> bytes:
        """A stream's bytes through its filters; images' own formats give nothing."""
        listed = lambda x: x if isinstance(x, list) else [] if x is None else [x]
        filters = [self.get(x) for x in listed(self.get(stream.get("Filter", stream.get("F"))))]
        how = [self.get(x) for x in listed(self.get(stream.get("DecodeParms", stream.get("DP"))))]
        data = stream.raw
        for k, name in enumerate(filters):
            own = {a: self.get(b) for a, b in how[k].items()} if k < len(how) and isinstance(how[k], dict) else {}
            if not isinstance(own.get("EarlyChange", 1), int):
                return b""
            if name in ("FlateDecode", "Fl"):
                data = unpredicted(inflate(data), own)
            elif name in ("LZWDecode", "LZW"):
                data = unpredicted(lzw(data, own.get("EarlyChange", 1)), own)
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif name in ("ASCII85Decode", "A85"):
                data = ascii85(data)
            elif name in ("RunLengthDecode", "RL"):
                data = run_lengths(data)
            else:
                return b""
        return data

    def pages(self) -> Iterator[dict]:
        """Pages in order, with what they inherit; where there is no page tree, all page objects by number."""
        root = self.get(self.trailer.get("Root"))
        todo, seen, some = [(root.get("Pages"), {})] if isinstance(root, dict) else [], set(), False
        while todo:
            ref, above = todo.pop()
            if isinstance(ref, Ref) and ref in seen:
                continue
            seen.add(ref if isinstance(ref, Ref) else None)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            own = above | {k: v for k, v in node.items() if k in ("Resources", "MediaBox", "CropBox", "Rotate")}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(kid, own) for kid in reversed(kids)]
            elif "Kids" not in node:
                some = True
                yield own | node
        if not some:
            for number in sorted(self.places):
                node = self.get(Ref(number))
                if isinstance(node, dict) and node.get("Type") == "Page":
                    yield node


def text_string(value) -> str:
    """A text string of a dictionary: UTF-16 or UTF-8 with a mark, else one byte a character."""
    if not isinstance(value, bytes):
        return ""
    if value[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return value.decode("utf-16", "replace")
    return value[3:].decode("utf-8", "replace") if value[:3] == b"\xef\xbb\xbf" else value.decode("latin-1")
