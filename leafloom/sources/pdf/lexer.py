"""Tokens and objects of PDF syntax."""

from __future__ import annotations

import re
from typing import NamedTuple

from leafloom.sources.pdf.errors import PdfError

DEEPEST = 256
_SPACE = b"\0\t\n\f\r "
_DELIMITERS = b"()<>[]{}/%"
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)")
_REF = re.compile(rb"([0-9]{1,10})[\0\t\n\f\r ]+([0-9]{1,5})[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_ESCAPES = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}


class Name(str):
    """A name object."""

    __slots__ = ()


class Keyword(str):
    """A bare word: an operator or a structural keyword."""

    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream:
    """A stream's dictionary and its raw data."""

    __slots__ = ("dict", "raw")

    def __init__(self, d: dict, raw: bytes) -> None:
        self.dict, self.raw = d, raw


END = Keyword("")


class Lexer:
    def __init__(self, data: bytes, at: int = 0, refs: bool = True) -> None:
        self.data, self.at, self.refs = data, at, refs

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def object(self, depth: int = 0):
        """The next object, a ``Keyword`` for a bare word, or ``END``."""
        if depth > DEEPEST:
            raise PdfError("objects are nested too deeply")
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            return END
        c = data[at]
        if c == 0x2F:
            return self._name()
        if c == 0x28:
            return self._string()
        if c == 0x3C:
            return self._dict(depth) if data[at + 1 : at + 2] == b"<" else self._hex()
        if c == 0x5B:
            self.at += 1
            return self._array(depth)
        if c in b")>]{}":
            self.at += 2 if data[at : at + 2] == b">>" else 1
            return Keyword(data[at : self.at].decode("latin-1"))
        if self.refs and 0x30 <= c <= 0x39:
            m = _REF.match(data, at)
            if m:
                self.at = m.end()
                return Ref(int(m[1]), int(m[2]))
        m = _REGULAR.match(data, at)
        self.at = m.end()
        word = m[0]
        n = _NUMBER.match(word)
        if n and (n.end() == len(word) or word[0] in b"0123456789.+-" and not word[n.end() :].isalpha()):
            text = n[0]
            return float(text) if b"." in text else int(text)
        if word in (b"true", b"false"):
            return word == b"true"
        if word == b"null":
            return None
        return Keyword(word.decode("latin-1"))

    def _name(self) -> Name:
        m = _REGULAR.match(self.data, self.at + 1)
        raw = m[0] if m else b""
        self.at += 1 + len(raw)
        if b"#" in raw:
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), raw)
        return Name(raw.decode("latin-1"))

    def _string(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(data):
            c = data[at]
            at += 1
            if c == 0x5C and at < len(data):
                e = data[at]
                at += 1
                if e in _ESCAPES:
                    out.append(_ESCAPES[e])
                elif 0x30 <= e <= 0x37:
                    m = re.compile(rb"[0-7]{1,3}").match(data, at - 1)
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                elif e == 13:
                    at += data[at : at + 1] == b"\n"
                elif e != 10:
                    out.append(e)
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                self.at = at
                return bytes(out)
            out.append(c)
        raise PdfError("a string is not closed")

    def _hex(self) -> bytes:
        end = self.data.find(b">", self.at)
        if end < 0:
            raise PdfError("a hexadecimal string is not closed")
        body = bytes(c for c in self.data[self.at + 1 : end] if c not in _SPACE)
        self.at = end + 1
        if not re.fullmatch(rb"[0-9A-Fa-f]*", body):
            raise PdfError("a hexadecimal string holds other characters")
        return bytes.fromhex((body + b"0" * (len(body) % 2)).decode())

    def _array(self, depth: int) -> list:
        out = []
        while True:
            x = self.object(depth + 1)
            if isinstance(x, Keyword):
                if x == "]":
                    return out
                if x == "" or x in (">>", "endobj", "stream"):
                    raise PdfError("an array is not closed")
                continue
            out.append(x)

    def _dict(self, depth: int) -> dict:
        self.at += 2
        out: dict = {}
        while True:
            key = self.object(depth + 1)
            if isinstance(key, Keyword):
                if key == ">>":
                    return out
                if key == "" or key in ("endobj", "stream"):
                    raise PdfError("a dictionary is not closed")
                continue
            if not isinstance(key, Name):
                continue
            value = self.object(depth + 1)
            if isinstance(value, Keyword):
                if value == ">>":
                    return out
                if value == "":
                    raise PdfError("a dictionary is not closed")
                continue
            out[key] = value


def text_of(raw: bytes) -> str:
    """A text string's characters: UTF-16 or UTF-8 with a mark, else Latin-1 as its nearest standard."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1")
