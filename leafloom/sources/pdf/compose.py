"""Texts as PDF files in the layout of ``leafloom.operators.layout``: Courier, so that a character is as wide there."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.operators import layout
from leafloom.sources.pdf.lexer import Name
from leafloom.sources.pdf.writer import Builder, number, operation, serialized


class _Places(dict):
    """Where a line's character begins, as the file says it; those of very long lines are not kept."""

    def __missing__(self, off: int) -> bytes:
        place = number(layout.LEFT + layout.ADVANCE * off).encode()
        if off < 1 << 14:
            self[off] = place
        return place


_LEFT = _Places()


def composed(text: str) -> bytes:
    """A file with a page for each 50 lines begun; characters that the font's encoding lacks become question marks."""
    out = Builder()
    tree = out.add(None)
    font = out.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding")})
    # every character is one byte, so that offsets and separators are those of the text
    lines, kids = text.encode("cp1252", "replace").split(b"\n"), []
    for begin in range(0, len(lines), layout.PAGE_LINES):
        body = bytearray(operation("BT", []) + operation("Tf", [Name("F1"), layout.SIZE]))
        for row, line in enumerate(lines[begin : begin + layout.PAGE_LINES]):
            off, pieces = 0, []
            top = number(layout.TOP - layout.LEADING * row).encode()
            literal, other = b" %b Tm\n(" % top, b" %b Tm\n" % top
            for word in line.split(b" "):
                if word.isalnum():
                    pieces += b"1 0 0 1 ", _LEFT[off], literal, word, b") Tj\n"
                elif word:
                    pieces += b"1 0 0 1 ", _LEFT[off], other, serialized(word), b" Tj\n"
                off += len(word) + 1
            body += b"".join(pieces)
        body += operation("ET", [])
        kids.append(out.add({"Type": Name("Page"), "Parent": tree, "Contents": out.stream(bytes(body), level=1), "Resources": {"Font": {"F1": font}}}))
    out.objects[tree.num - 1] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, layout.PAGE_WIDTH, layout.PAGE_HEIGHT]}
    return out.save(out.add({"Type": Name("Catalog"), "Pages": tree}))


def as_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path (the id) and content of a file for every text; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([composed(t) for t in part.column(1).to_pylist()], type=pa.binary())], ["path", "content"])

    return docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("path"), text_col).mapInArrow(run, "path string, content binary")
