"""PDF files made for tests."""

from __future__ import annotations

from leafloom.sources.pdf.lexer import Name, Stream
from leafloom.sources.pdf.writer import Builder


def positioned(pages: list[list[tuple[str, float, float, float]]], extras: dict | None = None, catalog=None, info: dict | None = None, compress: bool = True) -> bytes:
    """Pages of (text, x, y, size) on 595 x 842 points; ``extras`` by page number adds entries."""
    out = Builder()
    tree = out.add(None)
    font = out.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding")})
    kids = []
    for n, lines in enumerate(pages, 1):
        body = b"".join(b"BT /F1 %g Tf %g %g Td (%s) Tj ET\n" % (size, x, y, text.encode("cp1252")) for text, x, y, size in lines)
        content = out.stream(body) if compress else out.add(Stream({}, body))
        own = (extras or {}).get(n, {})
        own = own(out) if callable(own) else own
        resources = {"Font": {"F1": font}} | own.pop("Resources", {})
        kids.append(out.add({"Type": Name("Page"), "Parent": tree, "Contents": content, "Resources": resources, **own}))
    out.objects[tree.num - 1] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 595, 842]}
    root = {"Type": Name("Catalog"), "Pages": tree, **(catalog(out, kids) if catalog else {})}
    return out.save(out.add(root), out.add(info) if info else None)


def simple(n: int = 1, prefix: str = "page") -> bytes:
    return positioned([[(f"{prefix} {i} alpha beta", 72, 700, 12), ("second line", 72, 680, 12)] for i in range(1, n + 1)])


def hidden() -> bytes:
    """Metadata, an attachment, a script, annotations, a bookmark, a layer, a form."""

    def catalog(out: Builder, kids: list) -> dict:
        mark = out.add(None)
        outlines = out.add({"Type": Name("Outlines"), "First": mark, "Last": mark, "Count": 1})
        out.objects[mark.num - 1] = {"Title": b"Start", "Parent": outlines, "Dest": [kids[0], Name("Fit")]}
        script = {"S": Name("JavaScript"), "JS": b"app.alert('hi')"}
        field = out.add({"FT": Name("Tx"), "T": b"who", "V": b"me", "Subtype": Name("Widget"), "Rect": [10, 10, 50, 20], "Ff": 1})
        return {
            "Outlines": outlines, "Names": {"JavaScript": {"Names": [b"start", script]}, "EmbeddedFiles": {"Names": [b"a", {"F": b"a.txt"}]}},
            "OCProperties": {"OCGs": [out.add({"Name": b"layer"})]}, "AcroForm": {"Fields": [field]}, "Metadata": out.add(Stream({"Type": Name("Metadata")}, b"<x/>")),
        }

    annots = {"Annots": [{"Subtype": Name("Text"), "Rect": [1, 1, 9, 9]}, {"Subtype": Name("FileAttachment"), "Rect": [1, 1, 9, 9]}, {"Subtype": Name("Link"), "Rect": [70, 690, 150, 715], "A": {"S": Name("URI"), "URI": b"https://example.org/", "Next": {"S": Name("JavaScript"), "JS": b"x()"}}}]}
    return positioned([[("visible words", 72, 700, 12)]], {1: annots}, catalog, {"Title": b"T", "Producer": b"P", "Custom": b"C"})
