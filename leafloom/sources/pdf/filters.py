"""Stream filters. Decoding is strict: data that ends early or is malformed is an error."""

from __future__ import annotations

import re
import zlib

from leafloom.sources.pdf.errors import PdfError

#: Limits: bytes of one decoded stream, filters of one chain.
MOST_BYTES = 256 << 20
MOST_FILTERS = 8
SHORT_NAMES = {"Fl": "FlateDecode", "LZW": "LZWDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode", "DCT": "DCTDecode", "CCF": "CCITTFaxDecode"}
#: Image codecs, whose data is kept as it is.
IMAGE_CODECS = frozenset({"DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode"})


def inflate(data: bytes) -> bytes:
    engine = zlib.decompressobj()
    try:
        out = engine.decompress(data, MOST_BYTES + 1)
    except zlib.error as e:
        raise PdfError(f"flate: {e}") from e
    if len(out) > MOST_BYTES:
        raise PdfError("flate: the stream is too large")
    if not engine.eof:
        raise PdfError("flate: the data ends early")
    return out


def ascii_hex(data: bytes) -> bytes:
    body = re.sub(rb"[\0\t\n\f\r ]", b"", data.partition(b">")[0])
    if not re.fullmatch(rb"[0-9A-Fa-f]*", body):
        raise PdfError("hex: a character is not a digit")
    return bytes.fromhex((body + b"0" * (len(body) % 2)).decode())


def ascii_85(data: bytes) -> bytes:
    body = re.sub(rb"[\0\t\n\f\r ]", b"", data).removeprefix(b"<~").partition(b"~")[0]
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += _base85(group)
                group = []
        else:
            raise PdfError("base 85: a character is out of range")
    if len(group) == 1:
        raise PdfError("base 85: the data ends early")
    if group:
        out += _base85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _base85(digits: list[int]) -> bytes:
    value = 0
    for d in digits:
        value = value * 85 + d
    if value >= 1 << 32:
        raise PdfError("base 85: a group is out of range")
    return value.to_bytes(4, "big")


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n == 128:
            return bytes(out)
        take = n + 1 if n < 128 else 1
        if at + take > len(data):
            raise PdfError("run length: the data ends early")
        out += data[at : at + take] if n < 128 else data[at : at + 1] * (257 - n)
        at += take
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    table = {i: bytes([i]) for i in range(256)}
    out, width, next_code, last = bytearray(), 9, 258, b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits & (1 << width) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table = {i: bytes([i]) for i in range(256)}
                width, next_code, last = 9, 258, b""
                continue
            if code in table:
                entry = table[code]
            elif code == next_code and last:
                entry = last + last[:1]
            else:
                raise PdfError("lzw: a code is not in the table")
            out += entry
            if len(out) > MOST_BYTES:
                raise PdfError("lzw: the stream is too large")
            if last and next_code < 4096:
                table[next_code] = last + entry[:1]
                next_code += 1
            last = entry
            width = min(12, max(9, (next_code + early).bit_length()))
    return bytes(out)


def unpredicted(data: bytes, parms: dict) -> bytes:
    """Undoes PNG and TIFF predictors."""
    kind = int(parms.get("Predictor", 1))
    if kind <= 1:
        return data
    colors, depth, columns = int(parms.get("Colors", 1)), int(parms.get("BitsPerComponent", 8)), int(parms.get("Columns", 1))
    step, size = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    if size <= 0 or colors * depth * columns > 1 << 30:
        raise PdfError("predictor: a row's size is out of range")
    out, above = bytearray(), bytearray(size)
    if kind == 2:
        if depth != 8:
            raise PdfError("predictor: only whole bytes are supported")
        for at in range(0, len(data), size):
            row = bytearray(data[at : at + size])
            for i in range(step, len(row)):
                row[i] = (row[i] + row[i - step]) & 255
            out += row
        return bytes(out)
    for at in range(0, len(data), size + 1):
        tag, row = data[at], bytearray(data[at + 1 : at + 1 + size])
        if tag > 4:
            raise PdfError("predictor: a row's kind is out of range")
        for i in range(len(row)):
            left, up, corner = (row[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
            if tag == 1:
                guess = left
            elif tag == 2:
                guess = up
            elif tag == 3:
                guess = (left + up) // 2
            elif tag == 4:
                p = left + up - corner
                guess = min((left, up, corner), key=lambda v, p=p: abs(p - v))
            else:
                guess = 0
            row[i] = (row[i] + guess) & 255
        out += row
        above = row + bytearray(size - len(row))
    return bytes(out)


def decode(data: bytes, filters: list[str], parms: list[dict]) -> tuple[bytes, str | None]:
    """(decoded data, image codec left over or None)."""
    if len(filters) > MOST_FILTERS:
        raise PdfError("a stream has too many filters")
    for i, name in enumerate(filters):
        name, own = SHORT_NAMES.get(name, name), parms[i] if i < len(parms) else {}
        if name in IMAGE_CODECS:
            return data, name
        if name == "FlateDecode":
            data = unpredicted(inflate(data), own)
        elif name == "LZWDecode":
            data = unpredicted(lzw(data, int(own.get("EarlyChange", 1))), own)
        elif name == "ASCII85Decode":
            data = ascii_85(data)
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "RunLengthDecode":
            data = run_length(data)
        elif name != "Crypt":
            raise PdfError(f"unknown filter {name}")
    return data, None
