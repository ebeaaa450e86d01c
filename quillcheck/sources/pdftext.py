"""Spans of text that a page's content draws: a machine over its operators.

A span is what one operator shows in one font: text, box, size and colour. Boxes count from the page's upper left corner. Where
a font has no widths, half its size stands for each character.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator

from .pdfobjects import File, Name, Stream, Syntax, Word, text_string

#: Forms within forms that are followed, and forms that a page may draw in all (forms that draw forms multiply); a form within itself is not drawn.
DEPTH, FORMS = 12, 20_000
#: Height of letters above the base line and depth below it, in sizes of the font, and an advance that parts words.
RISE, FALL, GAP = 0.8, 0.2, 0.18

# Glyph names that are not letters with accents.
GLYPHS = dict(zip("space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde".split(), " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~")) | dict(zip("quoteleft quoteright quotedblleft quotedblright quotesinglbase quotedblbase endash emdash bullet ellipsis dagger daggerdbl fi fl ff ffi ffl germandbls ae AE oe OE oslash Oslash dotlessi lslash Lslash eth Eth thorn Thorn exclamdown questiondown section paragraph degree cent sterling yen Euro copyright registered trademark minus multiply divide plusminus mu guillemotleft guillemotright guilsinglleft guilsinglright".split(), "‘’“”‚„–—•…†‡ﬁﬂﬀﬃﬄßæÆœŒøØıłŁðÐþÞ¡¿§¶°¢£¥€©®™−×÷±µ«»‹›"))
ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌", "macron": "̄", "breve": "̆", "ogonek": "̨", "dotaccent": "̇", "hungarumlaut": "̋"}


def glyph(name: str) -> str:
    """The characters of a glyph name."""
    base = name.split(".")[0]
    if base in GLYPHS:
        return GLYPHS[base]
    if len(base) == 1:
        return base
    for form in (r"uni((?:[0-9A-Fa-f]{4})+)", r"u([0-9A-Fa-f]{4,6})"):
        if m := re.fullmatch(form, base):
            step = 4 if form[2] == "i" else len(m[1])
            codes = [int(m[1][k : k + step], 16) for k in range(0, len(m[1]), step)]
            return "".join(chr(c) for c in codes if c < 0x110000)
    if base[1:] in ACCENTS:
        return unicodedata.normalize("NFC", base[0] + ACCENTS[base[1:]])
    return ""


def _utf16(value: bytes) -> str:
    return value.decode("utf-16-be", "surrogatepass") if len(value) % 2 == 0 else value.decode("latin-1")


class CMap:
    """Texts of character codes, and how many bytes a code has."""

    def __init__(self, data: bytes):
        self.single: dict[int, str] = {}
        self.ranges: list[tuple[int, int, str]] = []
        self.widths: set[int] = set()
        items: list = []
        for x in Syntax(data).values():
            if not isinstance(x, Word):
                items.append(x)
                continue
            if x == "endcodespacerange":
                self.widths |= {len(a) for a in items if isinstance(a, bytes)}
            elif x == "endbfchar":
                for a, b in zip(items[::2], items[1::2]):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        self.single[int.from_bytes(a, "big")] = _utf16(b)
            elif x == "endbfrange":
                for a, b, to in zip(items[::3], items[1::3], items[2::3]):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                        if isinstance(to, list):
                            self.single |= {low + k: _utf16(t) for k, t in enumerate(to) if isinstance(t, bytes)}
                        elif isinstance(to, bytes):
                            self.ranges.append((low, high, _utf16(to)))
            items = []

    def get(self, code: int) -> str | None:
        if code in self.single:
            return self.single[code]
        for low, high, first in self.ranges:
            if low <= code <= high and first:
                last = ord(first[-1]) + code - low
                return first[:-1] + chr(last) if last < 0x110000 else None
        return None


class Font:
    """Texts and advances (in sizes) of the codes of a font."""

    def __init__(self, pdf: File, font: dict):
        get = pdf.get
        self.wide = font.get("Subtype") == "Type0"
        stream = get(font.get("ToUnicode"))
        self.map = CMap(pdf.decoded(stream)) if isinstance(stream, Stream) else None
        self.bytes = max(self.map.widths, default=0) if self.map and not self.wide and {*self.map.widths} != {1} else 0
        self.bytes = 2 if self.wide else self.bytes or 1
        self.names: dict[int, str] = {}
        self.known: dict[int, tuple[int, str, float]] = {}
        self.codec = "cp1252"
        encoding = get(font.get("Encoding"))
        base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
        if base == "MacRomanEncoding":
            self.codec = "mac_roman"
        if isinstance(encoding, dict):
            code = 0
            for x in get(encoding.get("Differences")) or []:
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    self.names[code] = glyph(x)
                    code += 1
        self.widths: dict[int, float] = {}
        self.usual = 0.5
        number = lambda x: float(x) if isinstance(x, (int, float)) else 500.0
        if self.wide:
            inner = get((get(font.get("DescendantFonts")) or [None])[0])
            if isinstance(inner, dict):
                self.usual = number(get(inner.get("DW", 1000))) / 1000
                listed, at = [get(x) for x in get(inner.get("W")) or []], 0
                while at + 1 < len(listed):
                    if isinstance(listed[at + 1], list):
                        self.widths |= {listed[at] + k: number(get(w)) / 1000 for k, w in enumerate(listed[at + 1])}
                        at += 2
                    elif at + 2 < len(listed) and listed[at + 1] - listed[at] < 1 << 16:
                        self.widths |= dict.fromkeys(range(listed[at], listed[at + 1] + 1), number(listed[at + 2]) / 1000)
                        at += 3
                    else:
                        break
        else:
            first = get(font.get("FirstChar"))
            for k, w in enumerate(get(font.get("Widths")) or []):
                self.widths[(first if isinstance(first, int) else 0) + k] = number(get(w)) / 1000

    def read(self, shown: bytes) -> list[tuple[int, str, float]]:
        """Code, text and advance of each character."""
        n, known = len(shown) // self.bytes, self.known
        if self.bytes <= 2:
            codes = shown if self.bytes == 1 else struct.unpack(f">{n}H", shown[: 2 * n])
        else:
            codes = [int.from_bytes(shown[k : k + self.bytes], "big") for k in range(0, n * self.bytes, self.bytes)]
        for code in {*codes}.difference(known):
            text = self.map.get(code) if self.map else None
            if text is None:
                text = self.names.get(code)
            if text is None:
                text = "" if self.wide else bytes([code & 255]).decode(self.codec, "ignore")
            known[code] = (code, text, self.widths.get(code, self.usual))
        return [known[code] for code in codes]


def _times(a: tuple, b: tuple) -> tuple:
    """The matrix that applies ``a``, then ``b``."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _color(parts: list) -> int:
    """Red, green and blue in one number, of one, three or four components."""
    parts = [min(1.0, max(0.0, float(x))) for x in parts if isinstance(x, (int, float))]
    if len(parts) == 4:
        parts = [(1 - x) * (1 - parts[3]) for x in parts[:3]]
    elif len(parts) != 3:
        parts = [parts[0] if parts else 0.0] * 3
    return sum(round(255 * x) << s for x, s in zip(parts, (16, 8, 0)))


class Page:
    """A page's size and its spans."""

    def __init__(self, pdf: File, page: dict):
        self.pdf, self.page, self.fonts, self.forms = pdf, page, {}, 0
        box = pdf.get(page.get("CropBox")) or pdf.get(page.get("MediaBox"))
        box = [pdf.get(x) for x in box] if isinstance(box, list) else []
        if len(box) != 4 or not all(isinstance(x, (int, float)) for x in box):
            box = [0, 0, 612, 792]
        x0, x1, y0, y1 = min(box[0], box[2]), max(box[0], box[2]), min(box[1], box[3]), max(box[1], box[3])
        turn = pdf.get(page.get("Rotate"))
        turn = turn % 360 if isinstance(turn, int) else 0
        w, h = float(x1 - x0), float(y1 - y0)
        self.width, self.height = (h, w) if turn in (90, 270) else (w, h)
        # from the page's own axes to those from the upper left corner
        self.view = {90: (0, 1, 1, 0, -y0, -x0), 180: (-1, 0, 0, 1, x1, -y0), 270: (0, -1, -1, 0, y1, x1)}.get(turn, (1, 0, 0, -1, -x0, y1))

    def annotations(self) -> list[str]:
        listed = self.pdf.get(self.page.get("Annots"))
        found = [self.pdf.get(x) for x in listed] if isinstance(listed, list) else []
        return [text_of(self.pdf, x.get("Contents")) for x in found if isinstance(x, dict)]

    def spans(self) -> Iterator[dict]:
        contents = self.pdf.get(self.page.get("Contents"))
        parts = [self.pdf.get(x) for x in (contents if isinstance(contents, list) else [contents])]
        data = b"\n".join(self.pdf.decoded(x) for x in parts if isinstance(x, Stream))
        yield from self._run(data, self.pdf.get(self.page.get("Resources")) or {}, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (), {})

    def _font(self, resources: dict, name: str) -> Font | None:
        named = self.pdf.get(resources.get("Font")) if isinstance(resources, dict) else None
        ref = named.get(name) if isinstance(named, dict) else None
        known = ref if ref.__class__.__name__ == "Ref" else (id(resources), name)
        fonts = self.pdf.fonts if known is ref else self.fonts  # fonts that are objects are read once a file
        if known not in fonts:
            font = self.pdf.get(ref)
            try:
                fonts[known] = Font(self.pdf, font if isinstance(font, dict) else {})
            except (ValueError, TypeError, IndexError, AttributeError):
                fonts[known] = Font(self.pdf, {})
        return fonts[known]

    def _run(self, data: bytes, resources: dict, ctm: tuple, drawn: tuple, given: dict) -> Iterator[dict]:
        state = {"ctm": ctm, "font": None, "size": 1.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0, "color": 0} | given
        stack, args = [], []
        tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        syntax = Syntax(data)
        for x in syntax.values():
            if not isinstance(x, Word):
                args.append(x)
                continue
            op, own, args = str(x), args, []
            n = [float(a) for a in own if isinstance(a, (int, float)) and not isinstance(a, bool)]
            if op == "q":
                stack.append(dict(state))
            elif op == "Q" and stack:
                state = stack.pop()
            elif op == "cm" and len(n) == 6:
                state["ctm"] = _times(tuple(n), state["ctm"])
            elif op == "BT":
                tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            elif op in ("Td", "TD") and len(n) == 2:
                if op == "TD":
                    state["lead"] = -n[1]
                tm = line = _times((1, 0, 0, 1, *n), line)
            elif op == "Tm" and len(n) == 6:
                tm = line = tuple(n)
            elif op == "Tf" and n and isinstance(own[0], Name):
                state["font"], state["size"] = self._font(resources, own[0]), n[-1]
            elif op in ("Tc", "Tw", "TL", "Ts", "Tz") and n:
                state[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise", "Tz": "scale"}[op]] = n[0] / 100 if op == "Tz" else n[0]
            elif op in ("g", "rg", "k", "sc", "scn"):
                state["color"] = _color(n)
            elif op == "cs":
                state["color"] = 0
            elif op in ("T*", "'", '"', "Tj", "TJ"):
                if op in ("T*", "'", '"'):
                    tm = line = _times((1, 0, 0, 1, 0, -state["lead"]), line)
                if op == '"' and len(n) >= 2:
                    state["word"], state["char"] = n[0], n[1]
                if op != "T*" and own:
                    shown = own[-1] if isinstance(own[-1], list) else [own[-1]]
                    span, tm = self._show(shown, state, tm)
                    if span:
                        yield span
            elif op == "Do" and own and len(drawn) < DEPTH and self.forms < FORMS:
                forms = self.pdf.get(resources.get("XObject")) if isinstance(resources, dict) else None
                form = self.pdf.get(forms.get(own[-1])) if isinstance(forms, dict) and isinstance(own[-1], Name) else None
                if isinstance(form, Stream) and form.get("Subtype") == "Form" and not any(form is x for x in drawn):
                    self.forms += 1
                    matrix = [self.pdf.get(v) for v in self.pdf.get(form.get("Matrix")) or []]
                    matrix = tuple(map(float, matrix)) if len(matrix) == 6 and all(isinstance(v, (int, float)) for v in matrix) else (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
                    inner = self.pdf.get(form.get("Resources"))
                    yield from self._run(self.pdf.decoded(form), inner if isinstance(inner, dict) else resources, _times(matrix, state["ctm"]), (*drawn, form), {"color": state["color"]})
            elif op == "ID":  # an image's bytes within the content
                m = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(data, syntax.at)
                syntax.at = m.end() if m else len(data)

    def _show(self, shown: list, state: dict, tm: tuple) -> tuple[dict | None, tuple]:
        font, size, text, gone = state["font"], state["size"], [], 0.0
        font = font or self._font({}, "")
        for part in shown:
            if isinstance(part, (int, float)):
                gone -= part / 1000 * size
                if -part / 1000 > GAP and text and not text[-1].endswith(" "):
                    text.append(" ")
            elif isinstance(part, bytes):
                read, char, word = font.read(part), state["char"], state["word"]
                text += [letters for _, letters, _ in read]
                if font.bytes == 1 and word:
                    for code, _, advance in read:
                        gone += advance * size + char + (word if code == 32 else 0.0)
                else:
                    for _, _, advance in read:
                        gone += advance * size + char
        gone *= state["scale"]
        at = _times(_times((1, 0, 0, 1, 0, state["rise"]), tm), _times(state["ctm"], self.view))
        after = _times((1, 0, 0, 1, gone, 0), tm)
        said = "".join(text).encode("utf-16", "surrogatepass").decode("utf-16", "replace").replace("\x00", "")
        if not said:
            return None, after
        corners = [(at[0] * x + at[2] * y + at[4], at[1] * x + at[3] * y + at[5]) for x in (0.0, gone) for y in (-FALL * size, RISE * size)]
        xs, ys = zip(*corners)
        scale = abs(at[0] * at[3] - at[1] * at[2]) ** 0.5
        return {"text": said, "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "base": at[5], "size": abs(size) * scale, "color": state["color"]}, after


def text_of(pdf: File, value) -> str:
    return text_string(pdf.get(value))
