"""Structural findings of PDF files. Never raises."""

from __future__ import annotations

import re

from leafloom.sources.pdf.document import Document
from leafloom.sources.pdf.errors import PdfError
from leafloom.sources.pdf.lexer import Stream
from leafloom.sources.pdf.scan import fields

#: Findings listed of one class.
LISTED = 10


def findings(data: bytes, password: str | None = None) -> list[tuple[str, str, str, str]]:
    """(code, severity, location, message) in the order of the checks."""
    out: list[tuple[str, str, str, str]] = []
    add = lambda code, severity, where, text: out.append((code, severity, where, text))
    head = data[:1024].find(b"%PDF-")
    if head:
        add("PDF001", "Error", "offset 0", "the signature is missing" if head < 0 else f"the signature is at {head}")
    if b"%%EOF" not in data[-2048:]:
        add("PDF002", "Error", "end of file", "the end marker is missing")
    _check_xref(data, add)
    _check_lengths(data, add)
    try:
        doc = Document(data, password)
    except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is a finding
        add("PDF010", "Error", "file", f"the file can't be read: {e}")
        return out
    try:
        _check_document(doc, add)
    except Exception as e:  # noqa: BLE001
        add("PDF010", "Error", "file", f"the file can't be checked: {e}")
    return out


def _check_xref(data: bytes, add) -> None:
    m = list(re.finditer(rb"startxref[\0\t\n\f\r ]*([^\0\t\n\f\r ]*)", data[-2048:]))
    if not m:
        add("PDF003", "Error", "end of file", "startxref is missing")
        return
    word = m[-1][1]
    if not word.isdigit():
        add("PDF003", "Error", "end of file", "startxref is not a number")
        return
    at = int(word)
    if at >= len(data):
        add("PDF003", "Error", f"offset {at}", "startxref is out of range")
        return
    if not re.match(rb"[\0\t\n\f\r ]*(?:xref|[0-9]+[\0\t\n\f\r ]+[0-9]+[\0\t\n\f\r ]+obj)", data[at : at + 64]):
        add("PDF003", "Error", f"offset {at}", "startxref names no cross-reference section")
        return
    rows = re.match(rb"[\0\t\n\f\r ]*xref", data[at : at + 16])
    if not rows:
        return
    listed, pos, line = 0, at + rows.end(), re.compile(rb"[\0\t\n\f\r ]*([0-9]+)[\0\t\n\f\r ]+([0-9]+)(?:[\0\t\n\f\r ]+([nf]))?")
    number = left = 0
    while True:
        m = line.match(data, pos)
        if not m:
            break
        pos = m.end()
        if not left:
            number, left = int(m[1]), int(m[2])
            continue
        left -= 1
        if m[3] == b"n" and listed < LISTED and not re.match(rb"[\0\t\n\f\r ]*%d[\0\t\n\f\r ]+[0-9]+[\0\t\n\f\r ]+obj" % number, data[int(m[1]) : int(m[1]) + 40]):
            add("PDF004", "Error", f"object {number}", "the cross-reference entry does not point at its object")
            listed += 1
        number += 1


def _check_lengths(data: bytes, add) -> None:
    listed = 0
    for m in re.finditer(rb"/Length[\0\t\n\f\r ]+([0-9]+)(?![\0\t\n\f\r ]+[0-9]+[\0\t\n\f\r ]+R)[^>]*>>[\0\t\n\f\r ]*stream(\r\n|\n|\r)", data):
        end = m.end() + int(m[1])
        if listed < LISTED and not re.match(rb"[\0\t\n\f\r ]{0,4}endstream", data[end : end + 16]):
            add("PDF031", "Error", f"offset {m.start()}", "a stream's length does not lead to its end")
            listed += 1


def _check_document(doc: Document, add) -> None:
    if doc.rebuilt:
        add("PDF005", "Warning", "file", "the cross-reference table had to be rebuilt")
    root = doc.dict_of(doc.catalog, "Pages")
    if not root:
        add("PDF011", "Error", "catalog", "there are no pages")
    pages = doc.pages()
    if root and isinstance(doc.resolve(root.get("Count")), int) and doc.resolve(root["Count"]) != len(pages):
        add("PDF012", "Warning", "page tree", "the number of pages is wrong")
    if not pages:
        add("PDF020", "Error", "page tree", "no page can be reached")
    for p in pages:
        box = p._box("MediaBox")
        if box is None or box[0] == box[2] or box[1] == box[3]:
            add("PDF021", "Error", f"page {p.number}", "the media box is missing, malformed or empty")
        if doc.resolve(p.dict.get("Type")) != "Page":
            add("PDF022", "Warning", f"page {p.number}", "the page does not say that it is one")
    listed = 0
    for num in sorted(doc.entries):
        try:
            x = doc.get(num)
        except PdfError as e:
            add("PDF030", "Error", f"object {num}", f"the object can't be read: {e}")
            continue
        if isinstance(x, Stream) and listed < LISTED:
            try:
                doc.decoded(x)
            except PdfError as e:
                add("PDF032" if "unknown filter" in str(e) else "PDF030", "Error", f"object {num}", f"the stream does not decode: {e}")
                listed += 1
    for f in fields(doc):
        if not f["has_appearance"]:
            add("PDF040", "Warning", f"field {f['name']}", "the field has no appearance")
        if not f["on_page"]:
            add("PDF041", "Warning", f"field {f['name']}", "the field is on no page")
