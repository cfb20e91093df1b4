"""Content streams: operations, and the text and images that they draw."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from leafloom.sources.pdf.document import Document, Page
from leafloom.sources.pdf.errors import PdfError
from leafloom.sources.pdf.lexer import END, Keyword, Lexer, Name, Stream

MOST_OPERANDS, MOST_STATES, FORM_DEPTH, MOST_RANGE = 4096, 4096, 32, 1 << 20
Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1, 0, 0, 1, 0, 0)


def times(m: Matrix, n: Matrix) -> Matrix:
    """m first, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def at(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def operations(data: bytes) -> Iterator[tuple[str, list, bytes | None]]:
    """(operator, operands, inline image data) in order; what can't be read ends the stream. Never raises."""
    lex, operands = Lexer(data, refs=False), []
    while True:
        try:
            x = lex.object()
        except PdfError:
            return
        if x is END or x == END and isinstance(x, Keyword):
            return
        if not isinstance(x, Keyword):
            operands = [*operands[-(MOST_OPERANDS - 1) :], x]
            continue
        if x == "BI":
            entries, raw = _inline_image(lex)
            yield "BI", [entries], raw
        else:
            yield str(x), operands, None
        operands = []


def _inline_image(lex: Lexer) -> tuple[dict, bytes]:
    entries: dict = {}
    while True:
        key = lex.object()
        if isinstance(key, Keyword):
            break
        entries[key] = lex.object()
    begin = lex.at + 1
    bits = 1 if entries.get("IM") or entries.get("ImageMask") else entries.get("BPC", entries.get("BitsPerComponent", 8))
    parts = {"G": 1, "DeviceGray": 1, "RGB": 3, "DeviceRGB": 3, "CMYK": 4, "DeviceCMYK": 4}.get(entries.get("CS", entries.get("ColorSpace", "G")), 1)
    try:
        size = (int(entries.get("W", entries.get("Width", 0))) * bits * parts + 7) // 8 * int(entries.get("H", entries.get("Height", 0)))
    except (TypeError, ValueError):
        size = 0
    if not ({"F", "Filter"} & entries.keys()) and re.match(rb"[\0\t\n\f\r ]{0,2}EI(?![^\0\t\n\f\r ])", lex.data[begin + size : begin + size + 6]):
        end = begin + size
    else:
        m = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)").search(lex.data, begin)
        end = m.start() if m else len(lex.data)
    lex.at = min(len(lex.data), lex.data.find(b"EI", end) + 2 if lex.data.find(b"EI", end) >= 0 else len(lex.data))
    return entries, lex.data[begin:end]


# -- fonts

_ACCENTS = {"grave": "GRAVE", "acute": "ACUTE", "circumflex": "CIRCUMFLEX", "tilde": "TILDE", "dieresis": "DIAERESIS", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON", "macron": "MACRON", "breve": "BREVE", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE"}
#: Fixed names of glyphs that no rule below gives.
_GLYPHS = {"space": " ", "period": ".", "comma": ",", "hyphen": "-", "colon": ":", "semicolon": ";", "parenleft": "(", "parenright": ")", "slash": "/", "quotesingle": "'", "quotedbl": '"', "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "exclam": "!", "question": "?", "ampersand": "&", "at": "@", "numbersign": "#", "dollar": "$", "percent": "%", "plus": "+", "equal": "=", "asterisk": "*", "underscore": "_", "bracketleft": "[", "bracketright": "]", "braceleft": "{", "braceright": "}", "less": "<", "greater": ">", "bar": "|", "backslash": "\\", "asciitilde": "~", "asciicircum": "^", "grave": "`", "fi": "fi", "fl": "fl", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "Euro": "€", "copyright": "©", "registered": "®", "trademark": "™", "section": "§", "paragraph": "¶", "degree": "°"}
_DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def glyph_text(name: str) -> str | None:
    """A glyph name's characters: letters, digits, accented letters, uniXXXX and a few others."""
    base = name.partition(".")[0]
    if base in _GLYPHS:
        return _GLYPHS[base]
    if len(base) == 1:
        return base
    if base in _DIGITS:
        return str(_DIGITS.index(base))
    m = re.fullmatch(r"(?:uni([0-9A-F]{4})|u([0-9A-F]{4,6}))", base)
    if m:
        return chr(int(m[1] or m[2], 16))
    accent = _ACCENTS.get(base[1:])
    if accent and base[0].isalpha():
        try:
            return unicodedata.lookup(f"LATIN {'SMALL' if base[0].islower() else 'CAPITAL'} LETTER {base[0].upper()} WITH {accent}")
        except KeyError:
            return None
    return None


def parse_afm(text: str) -> dict[str, float]:
    """Glyph widths, in thousandths, of an AFM file."""
    return {m[2]: float(m[1]) for m in re.finditer(r"^C\s+-?\d+\s*;\s*WX\s+([\d.]+)\s*;\s*N\s+(\S+)", text, re.MULTILINE)}


def parse_cmap(data: bytes) -> tuple[list[tuple[int, int, int]], dict[int, str]]:
    """(code space ranges as (bytes, low, high), characters by code) of a ToUnicode map."""
    lex, stack, spaces, out = Lexer(data, refs=False), [], [], {}
    number = lambda b: int.from_bytes(b, "big")
    decode = lambda b: b.decode("utf-16-be", "replace")
    while True:
        try:
            x = lex.object()
        except PdfError:
            break
        if isinstance(x, Keyword):
            if x == "":
                break
            if x == "endcodespacerange":
                spaces += [(len(a), number(a), number(b)) for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)]
            elif x == "endbfchar":
                out.update((number(a), decode(b)) for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes))
            elif x == "endbfrange":
                for a, b, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    if not isinstance(a, bytes) or not isinstance(b, bytes):
                        continue
                    for i in range(min(number(b) - number(a) + 1, MOST_RANGE - len(out))):
                        if isinstance(to, list):
                            if i < len(to) and isinstance(to[i], bytes):
                                out[number(a) + i] = decode(to[i])
                        elif isinstance(to, bytes) and to:
                            last = number(to[-2:]) + i
                            out[number(a) + i] = decode(to[:-2] + min(last, 0xFFFF).to_bytes(2, "big")) if len(to) > 1 else chr(number(to) + i)
            stack = []
        else:
            stack.append(x)
    return spaces, out


#: The characters of both base encodings by code.
_CODES = {codec: {c: bytes([c]).decode(codec, "ignore") for c in range(256)} for codec in ("mac_roman", "cp1252")}


class Font:
    """Codes, characters and advances of a font dictionary."""

    def __init__(self, doc: Document, d: dict, metrics: dict[str, dict[str, float]] | None = None) -> None:
        self.name = str(doc.resolve(d.get("BaseFont")) or "")
        subtype = doc.resolve(d.get("Subtype"))
        self.wide = subtype == "Type0"
        cmap = doc.resolve(d.get("ToUnicode"))
        self.spaces, self.unicode = parse_cmap(doc.decoded(cmap)) if isinstance(cmap, Stream) else ([], {})
        self.widths: dict[int, float] = {}
        self.default = 600.0 if "Courier" in self.name else 500.0
        if self.wide:
            own = doc.resolve((doc.list_of(d, "DescendantFonts") or [{}])[0]) or {}
            self.default = float(doc.resolve(own.get("DW")) or 1000)
            self._cid_widths([doc.resolve(w) for w in doc.list_of(own, "W")], doc)
            return
        names = self._encoding(doc, d)
        first = doc.resolve(d.get("FirstChar")) or 0
        for i, w in enumerate(doc.list_of(d, "Widths")):
            w = doc.resolve(w)
            if isinstance(w, int | float):
                self.widths[first + i] = float(w)
        table = (metrics or {}).get(self.name)
        if table and not self.widths:
            self.widths = {c: table[n] for c, n in names.items() if n in table}

    def _cid_widths(self, w: list, doc: Document) -> None:
        i = 0
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                self.widths.update((w[i] + k, float(x)) for k, x in enumerate(map(doc.resolve, w[i + 1])) if isinstance(x, int | float))
                i += 2
            elif i + 2 < len(w):
                for k in range(min(int(w[i + 1]) - int(w[i]) + 1, MOST_RANGE)):
                    self.widths[int(w[i]) + k] = float(w[i + 2])
                i += 3
            else:
                break

    def _encoding(self, doc: Document, d: dict) -> dict[int, str]:
        enc = doc.resolve(d.get("Encoding"))
        base = enc if isinstance(enc, Name) else doc.resolve(enc.get("BaseEncoding")) if isinstance(enc, dict) else None
        codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        names: dict[int, str] = {}
        self.by_code = dict(_CODES[codec])
        code = 0
        for x in map(doc.resolve, doc.list_of(enc, "Differences") if isinstance(enc, dict) else []):
            if isinstance(x, int):
                code = x
            elif isinstance(x, Name):
                names[code] = str(x)
                self.by_code[code] = glyph_text(x) or self.by_code.get(code, "")
                code += 1
        return names

    def codes(self, raw: bytes) -> Iterator[tuple[int, bytes]]:
        if not self.wide:
            yield from ((c, raw[i : i + 1]) for i, c in enumerate(raw))
            return
        i = 0
        while i < len(raw):
            n = next((k for k, lo, hi in self.spaces if i + k <= len(raw) and lo <= int.from_bytes(raw[i : i + k], "big") <= hi), 2)
            yield int.from_bytes(raw[i : i + n], "big"), raw[i : i + n]
            i += n

    def text(self, code: int) -> str:
        if code in self.unicode:
            return self.unicode[code]
        return "" if self.wide else self.by_code.get(code, "")

    def advance(self, code: int) -> float:
        return self.widths.get(code, self.default) / 1000


# -- interpreter


@dataclass
class State:
    ctm: Matrix = UNIT
    font: Font | None = None
    size: float = 0
    char: float = 0
    word: float = 0
    scale: float = 1
    leading: float = 0
    rise: float = 0
    mode: int = 0


@dataclass(slots=True)
class Glyph:
    op: int
    code: bytes
    text: str
    x: float
    y: float
    width: float
    height: float
    advance: float
    font: str
    size: float
    mode: int
    #: places of the operations that draw it: on the page and, if that draws a form, there and so on
    path: tuple[int, ...] = ()


@dataclass
class Drawn:
    """What a page draws: glyphs by operation, and images with their boxes."""

    glyphs: list[Glyph] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)
    runs: list[list[Glyph]] = field(default_factory=list)


def box_of(m: Matrix, x0: float, y0: float, x1: float, y1: float) -> tuple[float, float, float, float]:
    corners = [at(m, x, y) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)


class Interpreter:
    """Runs a page's operations; only those that place text and images have an effect."""

    ASCENT, DESCENT = 0.75, -0.25

    def __init__(self, doc: Document, metrics: dict | None = None) -> None:
        self.doc, self.metrics, self.out = doc, metrics, Drawn()
        self.fonts: dict[int, Font] = {}

    def page(self, page: Page) -> Drawn:
        self.out = Drawn()
        self._run(page.content, page.resources, State(), (), set())
        return self.out

    def _font(self, resources: dict, name: str) -> Font | None:
        d = self.doc.resolve(self.doc.dict_of(resources, "Font").get(name))
        if not isinstance(d, dict):
            return None
        if id(d) not in self.fonts:
            self.fonts[id(d)] = Font(self.doc, d, self.metrics)
        return self.fonts[id(d)]

    def _run(self, data: bytes, resources: dict, s: State, above: tuple[int, ...], drawing: set) -> None:
        stack: list[State] = []
        tm = line = UNIT
        number = lambda v, i, other=0.0: float(v[i]) if len(v) > i and isinstance(v[i], int | float) and not isinstance(v[i], bool) else other
        for index, (op, v, raw) in enumerate(operations(data)):
            if op == "q":
                if len(stack) < MOST_STATES:
                    stack.append(replace(s))
            elif op == "Q":
                if stack:
                    s = stack.pop()
            elif op == "cm" and len(v) >= 6:
                s.ctm = times(tuple(number(v, i) for i in range(6)), s.ctm)
            elif op == "BT":
                tm = line = UNIT
            elif op == "Tf" and len(v) >= 2:
                s.font, s.size = self._font(resources, v[-2]) if isinstance(v[-2], str) else None, number(v, -1)
            elif op == "Tc":
                s.char = number(v, 0)
            elif op == "Tw":
                s.word = number(v, 0)
            elif op == "Tz":
                s.scale = number(v, 0, 100) / 100
            elif op == "TL":
                s.leading = number(v, 0)
            elif op == "Ts":
                s.rise = number(v, 0)
            elif op == "Tr":
                s.mode = int(number(v, 0))
            elif op in ("Td", "TD"):
                if op == "TD":
                    s.leading = -number(v, 1)
                tm = line = times((1, 0, 0, 1, number(v, 0), number(v, 1)), line)
            elif op == "Tm" and len(v) >= 6:
                tm = line = tuple(number(v, i) for i in range(6))
            elif op == "T*":
                tm = line = times((1, 0, 0, 1, 0, -s.leading), line)
            elif op in ("Tj", "TJ", "'", '"'):
                if op in ("'", '"'):
                    if op == '"' and len(v) >= 3:
                        s.word, s.char = number(v, 0), number(v, 1)
                    tm = line = times((1, 0, 0, 1, 0, -s.leading), line)
                for part in v[-1] if op == "TJ" and v and isinstance(v[-1], list) else v[-1:]:
                    if isinstance(part, bytes):
                        tm = self._show(part, tm, s, (*above, index))
                    elif isinstance(part, int | float):
                        tm = times((1, 0, 0, 1, -part / 1000 * s.size * s.scale, 0), tm)
            elif op == "BI":
                self._image(s, v[0], None, (*above, index))
            elif op == "Do" and v:
                ref = self.doc.dict_of(resources, "XObject").get(v[-1]) if isinstance(v[-1], str) else None
                x = self.doc.resolve(ref)
                if isinstance(x, Stream):
                    if x.dict.get("Subtype") == "Image":
                        self._image(s, x.dict, v[-1], (*above, index))
                    elif x.dict.get("Subtype") == "Form" and len(above) < FORM_DEPTH and id(x) not in drawing:
                        m = self.doc.list_of(x.dict, "Matrix")
                        inner = replace(s, ctm=times(tuple(float(k) for k in m), s.ctm) if len(m) == 6 else s.ctm)
                        own = self.doc.dict_of(x.dict, "Resources") or resources
                        self._run(self.doc.decoded(x), own, inner, (*above, index), drawing | {id(x)})

    def _image(self, s: State, d: dict, name: str | None, path: tuple[int, ...]) -> None:
        x, y, w, h = box_of(s.ctm, 0, 0, 1, 1)
        get = lambda long, short: self.doc.resolve(d.get(long, d.get(short)))
        self.out.images.append({"op": path[0] if len(path) == 1 else -1, "path": path, "ctm": s.ctm, "name": name, "x": x, "y": y, "width": w, "height": h, "pixels_wide": get("Width", "W"), "pixels_high": get("Height", "H")})

    def _show(self, raw: bytes, tm: Matrix, s: State, path: tuple[int, ...]) -> Matrix:
        if s.font is None:
            return tm
        a, b, c, d, e, f = times(tm, s.ctm)
        ux, uy, vx, vy = s.size * s.scale * a, s.size * s.scale * b, s.size * c, s.size * d  # one em along and up
        em = abs(s.size) * abs(ux * vy - uy * vx) ** 0.5 / abs(s.size) if s.size else 0.0
        low_x, low_y, high_x, high_y = self.DESCENT * vx, self.DESCENT * vy, self.ASCENT * vx, self.ASCENT * vy
        op, name, moved, run = path[0] if len(path) == 1 else -1, s.font.name, 0.0, []
        for code, piece in s.font.codes(raw):
            w = s.font.advance(code)
            x, y, wx, wy = e + moved * a + s.rise * c, f + moved * b + s.rise * d, w * ux, w * uy
            left, bottom = x + min(low_x, high_x) + min(0, wx), y + min(low_y, high_y) + min(0, wy)
            shift = (w * s.size + s.char + (s.word if piece == b" " else 0)) * s.scale
            moved += shift
            run.append(Glyph(op, piece, s.font.text(code), left, bottom, abs(high_x - low_x) + abs(wx), abs(high_y - low_y) + abs(wy), shift, name, em, s.mode, path))
        if run:
            self.out.glyphs += run
            self.out.runs.append(run)
        return times((1, 0, 0, 1, moved, 0), tm)


def page_text(glyphs: list[Glyph]) -> str:
    """Text in reading order: lines by baseline from the top, a space where glyphs are apart."""
    marks = [g for g in glyphs if g.text]
    order = sorted(range(len(marks)), key=lambda i: (-round(marks[i].y), marks[i].x, i))
    out, last = [], None
    for i in order:
        g = marks[i]
        if last is not None:
            if round(last.y) != round(g.y):
                out.append("\n")
            elif g.x - (last.x + last.width) > 0.12 * max(g.height, 1) and not last.text.endswith(" ") and not g.text.startswith(" "):
                out.append(" ")
        out.append(g.text)
        last = g
    return "".join(out)


