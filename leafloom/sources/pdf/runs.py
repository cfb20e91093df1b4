"""Text runs of plain pages in array passes.

Many writers place every word by a matrix and show it. A page of nothing but
such pairs, in one-byte fonts whose characters are equally wide, is read here
run by run, with the very numbers that ``content.Interpreter`` gets glyph by
glyph; of any other page ``plain_runs`` says None, and the interpreter reads it.
"""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from leafloom.sources.pdf.content import Font, Interpreter, State, page_text
from leafloom.sources.pdf.document import Page
from leafloom.sources.pdf.lexer import Lexer

_NUMBER = rb"[+-]?[0-9]{1,9}+(?:\.[0-9]*+)?+"
#: A string on one line: literal with only the escapes that it needs, or hexadecimal.
_STRING = rb"(?:\((?:[^()\\\r\n]++|\\[()\\])*+\)|<(?:[0-9A-Fa-f]{2})*+>)"
_PLACED = _NUMBER + rb" " + _NUMBER + rb" Tm\n" + _STRING + rb" Tj\n"
#: Strings under matrices that differ in their last two numbers only.
_STRETCH = re.compile(rb"((?:" + _NUMBER + rb" ){4})" + _PLACED + rb"(?:\1" + _PLACED + rb")*+")
#: Pages of more and shorter stretches are left to the interpreter.
_STRETCHES, _SHORT = 32, 200
_OTHER = re.compile(rb"(?:(BT|ET)|/([A-Za-z0-9]++) (" + _NUMBER + rb") Tf)\n")


@dataclass
class Runs:
    """Runs in drawing order: their texts, the boxes of their first and last glyphs, fonts, sizes. All modes are 0."""

    texts: list[str]
    x: np.ndarray
    y: np.ndarray
    last_x: np.ndarray
    width: np.ndarray
    height: np.ndarray
    #: (name, number of runs) from the first run on
    fonts: list[tuple[str, int]]
    size: np.ndarray

    def boxes(self) -> tuple[np.ndarray, ...]:
        """x, y, width, height of each run."""
        return self.x, self.y, self.last_x + self.width - self.x, self.y + self.height - self.y

    def text(self) -> str | None:
        """What ``content.page_text`` makes of the glyphs, or None if runs of a line overlap or run into another."""
        if not self.texts:
            return ""
        row, x, last, end, height, texts = np.rint(self.y), self.x, self.last_x, self.last_x + self.width, self.height, self.texts
        if ((row[1:] > row[:-1]) | (row[1:] == row[:-1]) & (x[1:] < x[:-1])).any():
            order = np.lexsort((np.arange(len(row)), x, -row))
            row, x, last, end, height, texts = row[order], x[order], last[order], end[order], height[order], [texts[i] for i in order.tolist()]
        same = row[1:] == row[:-1]
        if (same & (last[:-1] >= x[1:])).any():
            return None
        apart = x[1:] - end[:-1] > 0.12 * np.maximum(height[1:], 1)
        gaps = np.where(same, np.where(apart, " ", ""), "\n").tolist()
        if " " in "".join(texts):
            gaps = ["" if g == " " and (a[-1] == " " or b[0] == " ") else g for g, a, b in zip(gaps, texts, texts[1:], strict=False)]
        pieces = [""] * (2 * len(texts))
        pieces[::2], pieces[1:: 2] = ["", *gaps], texts
        return "".join(pieces)


def plain_runs(interpreter: Interpreter, page: Page) -> Runs | None:
    """The page's runs, or None if it holds anything but matrices with strings and fonts."""
    data, at, font, size, found = page.content, 0, None, 0.0, []
    while at < len(data):
        m = _OTHER.match(data, at)
        if m:
            if m[2]:
                font, size = interpreter._font(page.resources, m[2].decode()), float(m[3])
        else:
            m = _STRETCH.match(data, at)
            if not m or font is None:
                return None
            block = _block(m[0], m[1], font, size, interpreter)
            if block is None:
                return None
            found.append(block)
            if len(found) > _STRETCHES and m.end() < _SHORT * len(found):
                return None
        at = m.end()
    if not found:
        return Runs([], *[np.zeros(0)] * 5, [], np.zeros(0))
    join = lambda k: np.concatenate([getattr(b, k) for b in found])
    return Runs([t for b in found for t in b.texts], *map(join, ("x", "y", "last_x", "width", "height")), [f for b in found for f in b.fonts], join("size"))


def text_of(interpreter: Interpreter, page: Page) -> str:
    """The page's text in reading order."""
    plain = plain_runs(interpreter, page)
    text = plain.text() if plain else None
    return page_text(interpreter.page(page).glyphs) if text is None else text


#: What ``columns_of`` can tell of a run.
COLUMNS = {"seq": pa.int32(), "text": pa.string(), **dict.fromkeys(("x", "y", "width", "height"), pa.float32()), "font": pa.string(), "size": pa.float32(), "mode": pa.int32()}


def columns_of(interpreter: Interpreter, page: Page, names: tuple[str, ...] = tuple(COLUMNS)) -> list[pa.Array]:
    """Columns of the page's runs that are neither blank nor without area."""
    plain = plain_runs(interpreter, page)
    if plain is None:
        rows = []
        for i, run in enumerate(interpreter.page(page).runs):
            text = "".join(g.text for g in run)
            x, y = min(g.x for g in run), min(g.y for g in run)
            w, h = max(g.x + g.width for g in run) - x, max(g.y + g.height for g in run) - y
            if text.strip() and w > 0 and h > 0:
                rows.append(dict(zip(COLUMNS, (i, text, x, y, w, h, run[0].font, run[0].size, run[0].mode), strict=True)))
        return [pa.array([r[k] for r in rows], type=COLUMNS[k]) for k in names]
    x, y, w, h = plain.boxes()
    n = len(plain.texts)
    numbers = {"seq": np.arange(n), "x": x, "y": y, "width": w, "height": h, "size": plain.size, "mode": np.zeros(n)}
    strings = {"text": lambda: pa.array(plain.texts, type=pa.string()), "font": lambda: pa.concat_arrays([pa.array([], type=pa.string()), *(pa.repeat(pa.scalar(f, type=pa.string()), k) for f, k in plain.fonts)])}
    found = [strings[k]() if k in strings else pa.array(numbers[k].astype(COLUMNS[k].to_pandas_dtype())) for k in names]
    shown = (w > 0) & (h > 0)
    if not all(map(str.strip, plain.texts)):
        shown &= np.array([bool(t.strip()) for t in plain.texts], dtype=bool)
    return found if shown.all() else [c.filter(pa.array(shown)) for c in found]


def _string(line: bytes) -> bytes:
    return Lexer(line, refs=False).object()


def _block(stretch: bytes, matrix: bytes, font: Font, size: float, interpreter: Interpreter) -> Runs | None:
    if font.wide or font.widths or font.unicode or size <= 0:
        return None
    lines = stretch.split(b"\n")
    if b"\\" in stretch:
        raw = [_string(s) for s in lines[1::2]]
    else:
        raw = [s[1:-4] if s[0] == 0x28 else bytes.fromhex(s[1:-4].decode()) for s in lines[1::2]]
    a, b, c, d = map(float, matrix.split())
    skip = len(matrix)
    e, f = np.fromstring(b"".join([x[skip:-2] for x in lines[:-1:2]]), sep=" ").reshape(-1, 2).T
    joined = b"\n".join(raw)
    single = {k: t for k, t in font.by_code.items() if len(t) == 1}
    if single.get(10) != "\n" or joined.translate(None, bytes(single)) or b or c or a <= 0:
        return None
    texts = codecs.charmap_decode(joined, "strict", single)[0].split("\n")
    if len(texts) != len(raw):
        return None
    length = np.array(list(map(len, raw)))
    shown = length > 0
    if not shown.all():
        texts, length, e, f = [t for t in texts if t], length[shown], e[shown], f[shown]
    # as Interpreter._show does it with a plain state, for the first and the last glyph of a run
    s = State()
    w = font.advance(0)
    ux, vy = size * s.scale * a, size * d
    moved = np.cumsum(np.append(0.0, np.full(int(length.max(initial=1)), (w * size + s.char) * s.scale)))[length - 1]
    low, high = interpreter.DESCENT * vy, interpreter.ASCENT * vy
    em = abs(size) * abs(ux * vy) ** 0.5 / abs(size)
    each = lambda v: np.full(len(texts), v)
    return Runs(texts, e, f + min(low, high), e + moved * a, each(abs(w * ux)), each(abs(high - low)), [(font.name, len(texts))], each(em))
