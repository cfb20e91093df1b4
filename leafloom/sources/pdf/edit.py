"""Edits of PDF files: pages, redaction, added text, cleaning, forms."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from typing import Any

from leafloom.functions.text import BOLD_PARTS, FACES, FAMILY_PARTS, ITALIC_PARTS
from leafloom.sources.pdf.content import Drawn, Glyph, Interpreter, operations, page_text
from leafloom.sources.pdf.document import Document, Page
from leafloom.sources.pdf.errors import PdfError
from leafloom.sources.pdf.lexer import Name, Ref, Stream
from leafloom.sources.pdf.scan import KEPT_ANNOTATIONS, OUTWARD, STAMPED, rect
from leafloom.sources.pdf.writer import assembled, operation

Box = tuple[float, float, float, float]
SLACK = 0.05


def _pages(doc: Document) -> list[Page]:
    found = doc.pages()
    if not found:
        raise PdfError("the file has no pages")
    return found


def _wanted(pages: list[Page], numbers: Sequence[int], strict: bool) -> list[int]:
    if not numbers:
        return [p.number for p in pages]
    if strict and any(not 1 <= n <= len(pages) for n in numbers):
        raise PdfError("a page is out of range")
    return sorted({n for n in numbers if 1 <= n <= len(pages)})


def arrange(doc: Document, order: Sequence[int]) -> bytes:
    """Pages in a new order; repeats duplicate, pages not named go."""
    pages = _pages(doc)
    if not order or any(not 1 <= n <= len(pages) for n in order):
        raise PdfError("an order names pages of the file, at least one")
    return assembled([pages[n - 1] for n in order])


def rotate(doc: Document, degrees: int, numbers: Sequence[int] = ()) -> bytes:
    if degrees % 90:
        raise PdfError("a rotation is a multiple of 90")
    pages = _pages(doc)
    turned = set(_wanted(pages, numbers, True))
    return assembled(pages, {i: {"Rotate": (p.rotation + degrees) % 360} for i, p in enumerate(pages) if p.number in turned}, keep=doc)


def merge(docs: Sequence[Document]) -> bytes:
    """All pages after one another; a single file comes back as it is."""
    if len(docs) == 1:
        return docs[0].data
    return assembled([p for d in docs for p in _pages(d)])


def _wrapped(page: Page, drawing: bytes) -> bytes:
    """The page's content in a state of its own, then the drawing in default user space."""
    return b"q\n" + page.content + b"\nQ\n" + drawing


def _with_font(page: Page, base: str) -> tuple[dict, str]:
    resources = dict(page.resources)
    fonts = dict(page.doc.dict_of(resources, "Font"))
    name = next(n for n in (f"L{i}" for i in range(len(fonts) + 1)) if n not in fonts)
    fonts[name] = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(base), "Encoding": Name("WinAnsiEncoding")}
    return resources | {"Font": fonts}, name


def add_text(doc: Document, places: Sequence[tuple[int, float, float, str]], size: float = 12, font: str = "Helvetica", colour: tuple = (0, 0, 0)) -> bytes:
    """Lines of text at (page, x, y)."""
    pages = _pages(doc)
    changes: dict[int, dict] = {}
    for i, page in enumerate(pages):
        own = [p for p in places if p[0] == page.number]
        if not own:
            continue
        resources, name = _with_font(page, font)
        draw = b"".join(operation("BT", []) + operation("Tf", [Name(name), size]) + operation("rg", list(colour)) + operation("Td", [x, y]) + operation("Tj", [text.encode("cp1252", "replace")]) + operation("ET", []) for _, x, y, text in own)
        changes[i] = {"Resources": resources, "Contents": _wrapped(page, draw)}
    return assembled(pages, changes, keep=doc)


def labels(doc: Document, prefix: str = "", suffix: str = "", start: int = 1, digits: int = 6, numbers: Sequence[int] = (), corner: str = "BottomRight", size: float = 10) -> tuple[bytes, list[str]]:
    """Consecutive labels on the pages named, those out of range ignored; half an em a character."""
    if start < 0:
        raise PdfError("numbers start at zero or above")
    pages = _pages(doc)
    made, places = [], []
    for i, n in enumerate(_wanted(pages, numbers, False)):
        text = prefix + str(start + i).rjust(max(1, min(12, digits)), "0") + suffix
        x0, y0, x1, y1 = pages[n - 1].media_box
        width = 0.5 * size * len(text)
        x = x0 + 24 if corner.endswith("Left") else (x0 + x1 - width) / 2 if corner.endswith("Center") else x1 - 24 - width
        made.append(text)
        places.append((n, x, y1 - 24 - size if corner.startswith("Top") else y0 + 24, text))
    return add_text(doc, places, size), made


def watermark(doc: Document, text: str, opacity: float = 0.3, numbers: Sequence[int] = ()) -> bytes:
    """A text across each page, as wide as four fifths of its diagonal."""
    pages = _pages(doc)
    wanted, changes = set(_wanted(pages, numbers, False)), {}
    for i, page in enumerate(pages):
        if page.number not in wanted:
            continue
        x0, y0, x1, y1 = page.box
        diagonal = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        size = max(8, min(200, 0.8 * diagonal / max(0.001, 0.5 * len(text))))
        c, s = (x1 - x0) / diagonal, (y1 - y0) / diagonal
        half = 0.25 * size * len(text)
        resources, name = _with_font(page, "Helvetica")
        resources["ExtGState"] = {**page.doc.dict_of(resources, "ExtGState"), "LW": {"ca": opacity}}
        m = [c, s, -s, c, (x0 + x1) / 2 - half * c, (y0 + y1) / 2 - half * s]
        draw = operation("q", []) + operation("gs", [Name("LW")]) + operation("BT", []) + operation("Tf", [Name(name), size]) + operation("g", [0.5]) + operation("Tm", m) + operation("Tj", [text.encode("cp1252", "replace")]) + operation("ET", []) + operation("Q", [])
        changes[i] = {"Resources": resources, "Contents": _wrapped(page, draw)}
    return assembled(pages, changes, keep=doc)


def draw_boxes(doc: Document, boxes: Sequence[tuple[int, Box]], colour: tuple = (1, 1, 0), blend: str = "Multiply") -> bytes:
    """Filled boxes, by default as a highlighter draws them."""
    pages, changes = _pages(doc), {}
    for i, page in enumerate(pages):
        own = [b for n, b in boxes if n == page.number]
        if own:
            resources = dict(page.resources)
            resources["ExtGState"] = {**doc.dict_of(resources, "ExtGState"), "LB": {"BM": Name(blend)}}
            draw = operation("q", []) + operation("gs", [Name("LB")]) + operation("rg", list(colour)) + b"".join(operation("re", list(b)) for b in own) + operation("f", []) + operation("Q", [])
            changes[i] = {"Resources": resources, "Contents": _wrapped(page, draw)}
    return assembled(pages, changes, keep=doc)


def ink(doc: Document, page_number: int, points: Sequence[tuple[float, float]], width: float = 2, colour: tuple = (0, 0, 0)) -> bytes:
    """A stroke through the points; a single point is a dot."""
    if not points:
        raise PdfError("a stroke has at least one point")
    pages = _pages(doc)
    path = [*points, points[0]] if len(points) == 1 else list(points)
    draw = operation("q", []) + operation("J", [1]) + operation("j", [1]) + operation("w", [width]) + operation("RG", list(colour)) + operation("m", list(path[0])) + b"".join(operation("l", list(p)) for p in path[1:]) + operation("S", []) + operation("Q", [])
    return assembled(pages, {page_number - 1: {"Contents": _wrapped(pages[page_number - 1], draw)}}, keep=doc)


# -- redaction


def _touches(b: Box, g: Box, slack: float = SLACK) -> bool:
    return b[0] < g[0] + g[2] - slack and g[0] < b[0] + b[2] - slack and b[1] < g[1] + g[3] - slack and g[1] < b[1] + b[3] - slack


def _covers(b: Box, g: Box, slack: float = SLACK) -> bool:
    return b[0] - slack <= g[0] and b[1] - slack <= g[1] and g[0] + g[2] <= b[0] + b[2] + slack and g[1] + g[3] <= b[1] + b[3] + slack


def _glyph_box(g: Glyph) -> Box:
    return g.x, g.y, g.width, g.height


class _Eraser:
    """Content without what boxes touch, form by form.

    A form that holds something touched is drawn from a copy of its own without that, under
    a new name; other drawings of the same form, and other forms, stay as they are.
    """

    def __init__(self, doc: Document, drawn: Drawn, boxes: Sequence[Box], text_only: bool) -> None:
        self.doc = doc
        self.hit = lambda g: any(_touches(b, _glyph_box(g)) for b in boxes)
        self.glyphs: dict[tuple, list[Glyph]] = {}
        for g in drawn.glyphs:
            self.glyphs.setdefault(g.path, []).append(g)
        self.images = {im["path"] for im in drawn.images if not text_only and any(_touches(b, _image_box(im)) for b in boxes)}
        touched = self.images | {path for path, held in self.glyphs.items() if any(map(self.hit, held))}
        #: operations that draw a form with something touched in it
        self.above = {path[:k] for path in touched for k in range(1, len(path))}
        self.removed: dict = {"glyphs": 0, "images": len(self.images), "forms": len(self.above), "text": []}

    def content(self, data: bytes, resources: dict, above: tuple[int, ...] = (), size: float = 1.0, scale: float = 1.0) -> tuple[bytes, dict]:
        """The operations that stay, and the resources that they need."""
        out, xobjects, used = bytearray(), self.doc.dict_of(resources, "XObject"), {}
        for i, (op, v, raw) in enumerate(operations(data)):
            path = (*above, i)
            if op == "Tf" and len(v) >= 2 and isinstance(v[-1], int | float):
                size = float(v[-1])
            elif op == "Tz" and v:
                scale = float(v[0]) / 100
            if path in self.images:
                continue
            if op == "Do" and v and v[-1] in xobjects:
                name, drawn = v[-1], xobjects[v[-1]]
                if path in self.above:
                    name, drawn = Name(f"{name}_{'_'.join(map(str, path))}"), self.form(self.doc.resolve(drawn), resources, path, size, scale)
                used[name] = drawn
                out += operation(op, [name])
                continue
            glyphs = self.glyphs.get(path, [])
            if op in ("Tj", "TJ", "'", '"') and any(map(self.hit, glyphs)):
                if op in ("'", '"'):
                    if op == '"' and len(v) >= 3:
                        out += operation("Tw", [v[0]]) + operation("Tc", [v[1]])
                    out += operation("T*", [])
                out += operation("TJ", [_kept(v[-1] if op == "TJ" and v else v[-1:], glyphs, self.hit, size * scale, self.removed)])
                continue
            out += operation(op, v, raw)
        return bytes(out), {k: used if k == "XObject" else v for k, v in resources.items()}

    def form(self, x: Stream, resources: dict, path: tuple[int, ...], size: float, scale: float) -> Stream:
        content, own = self.content(self.doc.decoded(x), self.doc.dict_of(x.dict, "Resources") or resources, path, size, scale)
        entries = {k: v for k, v in x.dict.items() if k not in ("Filter", "DecodeParms", "Length", "Resources")}
        return Stream({**entries, "Filter": Name("FlateDecode"), "Resources": own}, zlib.compress(content))


def _image_box(im: dict) -> Box:
    return im["x"], im["y"], im["width"], im["height"]


def redacted_content(page: Page, boxes: Sequence[Box], metrics: dict | None = None, text_only: bool = False) -> tuple[bytes, dict, dict]:
    """The page's operations without the glyphs and images in the boxes, what was removed, and the resources.

    A glyph that a box touches becomes a displacement of its width, so the line keeps its
    place. Images go if a box touches them: their pixels are not edited, so nothing of a
    touched image stays. Both hold within forms, at any depth that is drawn.
    """
    drawn = Interpreter(page.doc, metrics).page(page)
    eraser = _Eraser(page.doc, drawn, boxes, text_only)
    content, resources = eraser.content(page.content, page.resources)
    removed = eraser.removed
    removed["text"] = "".join(removed["text"])
    # a glyph or an image under two regions counts for each of them
    touched = [([g for g in drawn.glyphs if _touches(b, _glyph_box(g))], [im for im in drawn.images if not text_only and _touches(b, _image_box(im))]) for b in boxes]
    removed["by_region"] = [{"box": list(b), "glyphs": len(gs), "images": len(ims), "text": "".join(g.text for g in gs)} for b, (gs, ims) in zip(boxes, touched, strict=True)]
    return content, removed, resources


def _kept(parts: list, glyphs: list[Glyph], hit: Any, unit: float, removed: dict) -> list:
    """The operand of TJ with hit glyphs as displacements."""
    out: list = []
    rest = iter(glyphs)
    for part in parts:
        if not isinstance(part, bytes):
            out.append(part)
            continue
        at = 0
        while at < len(part):
            g = next(rest, None)
            if g is None:
                break
            at += len(g.code)
            if hit(g):
                removed["glyphs"] += 1
                removed["text"].append(g.text)
                out.append(-g.advance * 1000 / unit if unit else 0)
            elif out and isinstance(out[-1], bytes):
                out[-1] += g.code
            else:
                out.append(g.code)
    return out


def redact(doc: Document, regions: Sequence[tuple[int, Box]], metrics: dict | None = None) -> tuple[bytes, list[dict]]:
    """Regions' content removed and painted over; a row of what was removed for each page."""
    pages = _pages(doc)
    if any(not 1 <= n <= len(pages) for n, _ in regions):
        raise PdfError("a page is out of range")
    changes, report = {}, []
    for i, page in enumerate(pages):
        boxes = [b for n, b in regions if n == page.number]
        if not boxes:
            continue
        content, removed, resources = redacted_content(page, boxes, metrics)
        stay = [a for a in doc.list_of(page.dict, "Annots") if not (isinstance(d := doc.resolve(a), dict) and (r := rect(doc, d)) and any(_touches(b, r, 0) for b in boxes))]
        removed["annotations"] = len(doc.list_of(page.dict, "Annots")) - len(stay)
        paint = operation("q", []) + operation("g", [0]) + b"".join(operation("re", list(b)) for b in boxes) + operation("f", []) + operation("Q", [])
        changes[i] = {"Contents": b"q\n" + content + b"\nQ\n" + paint, "Annots": stay or None, "Resources": resources}
        report.append({"page": page.number, "regions": len(boxes), **removed})
    return assembled(pages, changes, keep=doc), report


# -- cleaning and forms


def _without_actions(page: Page, javascript: bool, urls: bool) -> dict:
    """Changes that take actions off a page. Only an action that stands by itself is tested, as in the rule for files."""
    doc, annotations = page.doc, []
    for a in doc.list_of(page.dict, "Annots"):
        d = doc.resolve(a)
        if isinstance(d, dict):
            action = doc.resolve(d.get("A"))
            kind = doc.resolve(action.get("S")) if isinstance(action, dict) else None
            gone = {k for k, bad in (("AA", javascript), ("A", kind == "JavaScript" and javascript or kind in OUTWARD and urls)) if bad}
            if gone & d.keys():
                a = {k: v for k, v in d.items() if k not in gone}
        annotations.append(a)
    return {"Annots": annotations or None, **({"AA": None} if javascript else {})}


def _quiet_catalog(doc: Document, javascript: bool, urls: bool) -> dict:
    """Changes that take actions off the catalog."""
    catalog = doc.catalog or {}
    action = doc.resolve(catalog.get("OpenAction"))
    kind = doc.resolve(action.get("S")) if isinstance(action, dict) else None
    out: dict = {}
    if kind == "JavaScript" and javascript or kind in OUTWARD and urls:
        out["OpenAction"] = None
    if javascript:
        out |= {"AA": None, "Names": {k: v for k, v in doc.dict_of(catalog, "Names").items() if k != "JavaScript"} or None}
    return out


def strip_active(doc: Document, javascript: bool = True, urls: bool = True) -> bytes:
    """The file without scripts and/or outward actions; links within the file stay."""
    pages = _pages(doc)
    return assembled(pages, {i: _without_actions(p, javascript, urls) for i, p in enumerate(pages)}, keep=doc, catalog=_quiet_catalog(doc, javascript, urls))


def sanitize(doc: Document, metadata: bool = True, attachments: bool = True, scripts: bool = True, annotations: bool = True, bookmarks: bool = True, layers: bool = True) -> bytes:
    """The file without the kinds of hidden data chosen; scripts go first."""
    pages, changes = _pages(doc), {}
    catalog = _quiet_catalog(doc, True, True) if scripts else {}
    for i, page in enumerate(pages):
        own = _without_actions(page, True, True) if scripts else {"Annots": doc.list_of(page.dict, "Annots") or None}
        rows = own["Annots"] or []
        kind = lambda a: doc.resolve((doc.resolve(a) or {}).get("Subtype"))
        if annotations:
            rows = [a for a in rows if kind(a) in KEPT_ANNOTATIONS]
        if attachments:
            rows = [a for a in rows if kind(a) != "FileAttachment"]
            own["AF"] = None
        changes[i] = own | {"Annots": rows or None} | ({"Metadata": None} if metadata else {})
    if metadata:
        catalog["Metadata"] = None
    if attachments:
        names = catalog.get("Names", doc.dict_of(doc.catalog, "Names")) or {}
        catalog |= {"AF": None, "Names": {k: v for k, v in names.items() if k != "EmbeddedFiles"} or None}
    if layers:
        catalog["OCProperties"] = None
    return assembled(pages, changes, outlines=not bookmarks, keep=doc, catalog=catalog, info=not metadata)


def custom_info(doc: Document) -> list[str]:
    """Entries of the information dictionary that no standard names."""
    return [k for k in doc.info if k not in STAMPED and k not in ("Author", "Title", "Subject", "Keywords", "Creator")]


def fill(doc: Document, values: dict[str, str]) -> bytes:
    """Text, choice and check-box fields set by qualified name, in a new revision; unknown names are ignored."""
    from leafloom.sources.pdf.writer import incremental

    changed: dict[int, Any] = {}

    def walk(ref: Any, prefix: str, kind: Any, depth: int) -> None:
        d = doc.resolve(ref)
        if not isinstance(d, dict) or depth > 64:
            return
        part, kind = doc.text(d.get("T")), doc.resolve(d.get("FT")) or kind
        name = f"{prefix}.{part}" if prefix and part is not None else part if part is not None else prefix
        kids = [k for k in doc.list_of(d, "Kids") if isinstance(x := doc.resolve(k), dict) and "T" in x]
        for k in kids:
            walk(k, name, kind, depth + 1)
        if not kids and name in values and name not in done and isinstance(ref, Ref):
            done.add(name)
            new = values[name]
            if kind == "Btn":
                states = doc.dict_of(doc.dict_of(d, "AP"), "N")
                state = Name(new if new in states else "Off")
                changed[ref.num] = d | {"V": state, "AS": state}
            else:
                changed[ref.num] = {k: v for k, v in d.items() if k != "AP"} | {"V": new.encode("latin-1") if new.isascii() else b"\xfe\xff" + new.encode("utf-16-be")}

    done: set[str] = set()
    for f in doc.list_of(doc.dict_of(doc.catalog, "AcroForm"), "Fields"):
        walk(f, "", None, 0)
    if not changed:
        return doc.data
    form_ref = (doc.catalog or {}).get("AcroForm")
    if isinstance(form_ref, Ref):
        changed[form_ref.num] = doc.dict_of(doc.catalog, "AcroForm") | {"NeedAppearances": True}
    return incremental(doc, changed)


def flatten(doc: Document) -> tuple[bytes, int, int]:
    """Appearances of fields and annotations drawn into their pages: (file, fields, annotations)."""
    pages, changes, fields, others = _pages(doc), {}, 0, 0
    for i, page in enumerate(pages):
        resources = dict(page.resources)
        xobjects = dict(doc.dict_of(resources, "XObject"))
        draw, stay = bytearray(), []
        for ref in doc.list_of(page.dict, "Annots"):
            a = doc.resolve(ref)
            kind = doc.resolve(a.get("Subtype")) if isinstance(a, dict) else None
            if not isinstance(a, dict) or kind in ("Link", "Popup"):
                stay.append(ref)
                continue
            normal = doc.resolve(doc.dict_of(a, "AP").get("N"))
            if isinstance(normal, dict):
                normal = doc.resolve(normal.get(doc.resolve(a.get("AS"))))
            box = rect(doc, a)
            if kind == "Widget":
                fields += 1
            if not isinstance(normal, Stream) or box is None:
                if kind != "Widget":
                    stay.append(ref)
                continue
            others += kind != "Widget"
            if kind == "Widget" and (doc.resolve(a.get("F")) or 0) & 2:
                continue
            name = f"LX{len(xobjects)}"
            xobjects[name] = normal
            b = [float(doc.resolve(x)) for x in doc.list_of(normal.dict, "BBox")] or [0, 0, box[2], box[3]]
            sx, sy = (box[2] / (b[2] - b[0]) if b[2] != b[0] else 1), (box[3] / (b[3] - b[1]) if b[3] != b[1] else 1)
            draw += operation("q", []) + operation("cm", [sx, 0, 0, sy, box[0] - b[0] * sx, box[1] - b[1] * sy]) + operation("Do", [Name(name)]) + operation("Q", [])
        if draw or len(stay) != len(doc.list_of(page.dict, "Annots")):
            changes[i] = {"Resources": resources | {"XObject": xobjects}, "Contents": _wrapped(page, bytes(draw)), "Annots": stay or None}
    return assembled(pages, changes, keep=doc, catalog={"AcroForm": None}), fields, others


# -- text of regions, search, replacement


def in_region(glyphs: list[Glyph], box: Box) -> list[Glyph]:
    """Glyphs whose centre lies in the box, edges included."""
    inside = lambda g: box[0] <= g.x + g.width / 2 <= box[0] + box[2] and box[1] <= g.y + g.height / 2 <= box[1] + box[3]
    return [g for g in glyphs if g.width > 0 and inside(g)]


def region_text(glyphs: list[Glyph], box: Box) -> dict:
    """A region's text, lines from the top, and its dominant font and size.

    A glyph joins the first line whose first glyph's bottom is within 0.6 of that glyph's height.
    """
    found = sorted(in_region(glyphs, box), key=lambda g: -g.y)
    lines: list[list[Glyph]] = []
    for g in found:
        line = next((ln for ln in lines if abs(ln[0].y - g.y) <= 0.6 * ln[0].height), None)
        lines.append([g]) if line is None else line.append(g)
    rows = []
    for line in lines:
        line.sort(key=lambda g: g.x)
        text = ""
        for i, g in enumerate(line):
            before = line[i - 1] if i else None
            if before and g.x - (before.x + before.width) > 0.25 * before.height and not text.endswith(" ") and not g.text.startswith(" "):
                text += " "
            text += g.text
        rows.append(text)
    fonts: dict[str, list[float]] = {}
    for g in in_region(glyphs, box):
        fonts.setdefault(g.font, []).append(g.size)
    font = max(fonts, key=lambda f: len(fonts[f]), default="")
    low = font.lower()
    family = next((f for f, parts in FAMILY_PARTS.items() if any(p in low for p in parts)), "helvetica")
    return {"text": "\n".join(rows), "size": round(max(fonts[font]), 2) if font else 12.0, "family": family, "bold": any(p in low for p in BOLD_PARTS), "italic": any(p in low for p in ITALIC_PARTS), "source_font": font[7:] if len(font) > 7 and font[6] == "+" else font, "left": min((g.x for g in found), default=None), "bottom": max((g.y for g in found), default=None), "invisible": bool(found) and all(g.mode == 3 for g in found)}


def face(info: dict) -> str:
    return FACES[info["family"]][info["bold"] + 2 * info["italic"]]


def find(doc: Document, phrase: str, mode: str = "contains", case_sensitive: bool = False) -> list[dict]:
    """page, text and box of every match; a match over several lines has a box for each; from the bottom of a page upwards."""
    import re

    from leafloom.functions.text import phrase_pattern

    if not phrase:
        return []
    pattern, out = re.compile(phrase_pattern(phrase, mode, case_sensitive)), []
    interpreter = Interpreter(doc)
    for page in _pages(doc):
        marks = [g for g in interpreter.page(page).glyphs if g.text]
        order = sorted(range(len(marks)), key=lambda i: (-round(marks[i].y), marks[i].x, i))
        text, owner, last = "", [], None
        for i in order:
            g = marks[i]
            joint = "" if last is None else "\n" if round(last.y) != round(g.y) else " " if g.x - (last.x + last.width) > 0.12 * max(g.height, 1) and g.text != " " and not last.text.endswith(" ") else ""
            text += joint + g.text
            owner += [None] * len(joint) + [i] * len(g.text)
            last = g
        found = set()
        for m in pattern.finditer(text):
            rows: dict[int, list[Glyph]] = {}
            for i in dict.fromkeys(owner[m.start() : m.end()]):
                if i is not None:
                    rows.setdefault(round(marks[i].y), []).append(marks[i])
            for line in rows.values():
                x, y = min(g.x for g in line), min(g.y for g in line)
                found.add((y, x, max(g.x + g.width for g in line) - x, max(g.y + g.height for g in line) - y, m[0]))
        out += [{"page": page.number, "text": t, "box": (x, y, w, h)} for y, x, w, h, t in sorted(found)]
    return out


def _rewritten(doc: Document, jobs: Sequence[tuple[int, Box, str, float, float, dict]]) -> bytes:
    """Text taken out of boxes and other text set: (page, box, text, dx, dy, what was there)."""
    pages, changes = _pages(doc), {}
    for i, page in enumerate(pages):
        own = [j for j in jobs if j[0] == page.number]
        if not own:
            continue
        # text that is not seen lies over an image that shows it, so the image goes as well
        content, _, resources = redacted_content(page, [j[1] for j in own], text_only=not any(j[5]["invisible"] for j in own))
        draw = b""
        for _, _, text, dx, dy, was in own:
            holder = Page(doc, page.number, page.ref, {**page.dict, "Resources": resources}, page.above)
            resources, name = _with_font(holder, face(was))
            x, y = was["left"] + dx, was["bottom"] + 0.25 * was["size"] + dy
            for k, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                draw += operation("BT", []) + operation("Tf", [Name(name), was["size"]]) + operation("g", [0]) + operation("Td", [x, y - 1.2 * was["size"] * k]) + operation("Tj", [line.encode("cp1252", "replace")]) + operation("ET", [])
        changes[i] = {"Contents": b"q\n" + content + b"\nQ\n" + draw, "Resources": resources}
    return assembled(pages, changes, keep=doc)


def _there(doc: Document, number: int, box: Box) -> dict:
    pages = _pages(doc)
    if not 1 <= number <= len(pages):
        raise PdfError("a page is out of range")
    return region_text(Interpreter(doc).page(pages[number - 1]).glyphs, box)


def replace_region(doc: Document, number: int, box: Box, text: str) -> bytes:
    """A region's text replaced in its own style; the new text is not confined to the box."""
    was = _there(doc, number, box)
    if was["left"] is None:
        was |= {"left": box[0], "bottom": box[1]}
    return _rewritten(doc, [(number, box, text, 0, 0, was)])


def move_text(doc: Document, number: int, box: Box, dx: float, dy: float) -> bytes:
    """A region's text set elsewhere; the file as it is if the region has none."""
    was = _there(doc, number, box)
    return doc.data if was["left"] is None else _rewritten(doc, [(number, box, was["text"], dx, dy, was)])


def replace_all(doc: Document, phrase: str, by: str) -> tuple[bytes, int]:
    """Every occurrence replaced, case-sensitively and anywhere, and how many there were."""
    jobs = []
    for m in find(doc, phrase, "contains", True):
        x, y, w, h = m["box"]
        inner = (x + 0.2, y + 0.2, max(0.1, w - 0.4), max(0.1, h - 0.4))
        jobs.append((m["page"], inner, by, 0, 0, _there(doc, m["page"], inner)))
    jobs = [j for j in jobs if j[5]["left"] is not None]
    return (_rewritten(doc, jobs), len(jobs)) if jobs else (doc.data, 0)


def move_image(doc: Document, number: int, box: Box, dx: float, dy: float) -> bytes:
    """Images that touch a region, drawn elsewhere."""
    pages = _pages(doc)
    page = pages[number - 1]
    hits = {im["op"]: im["ctm"] for im in Interpreter(doc).page(page).images if im["op"] >= 0 and _touches(box, (im["x"], im["y"], im["width"], im["height"]), 0)}
    if not hits:
        return doc.data
    out = bytearray()
    for i, (op, v, raw) in enumerate(operations(page.content)):
        if i in hits:
            a, b, c, d, _, _ = hits[i]
            det = a * d - b * c
            shift = ((dx * d - dy * c) / det, (dy * a - dx * b) / det) if det else (0, 0)
            out += operation("q", []) + operation("cm", [1, 0, 0, 1, *shift]) + operation(op, v, raw) + operation("Q", [])
        else:
            out += operation(op, v, raw)
    return assembled(pages, {number - 1: {"Contents": bytes(out)}}, keep=doc)


# -- scripts, fields, encryption, comparison


def _script_tree(doc: Document, rows: dict[bytes, Any]) -> bytes:
    names = {k: v for k, v in doc.dict_of(doc.catalog, "Names").items() if k != "JavaScript"}
    if rows:
        names["JavaScript"] = {"Names": [x for k in sorted(rows) for x in (k, rows[k])]}
    return assembled(_pages(doc), keep=doc, catalog={"Names": names or None})


def _scripts(doc: Document) -> dict[bytes, Any]:
    return dict(doc.name_tree(doc.dict_of(doc.catalog, "Names").get("JavaScript")))


def add_script(doc: Document, name: str, source: str) -> bytes:
    """A named script added, or replaced if the name is taken; names are kept in byte order."""
    return _script_tree(doc, _scripts(doc) | {name.encode("latin-1", "replace"): {"S": Name("JavaScript"), "JS": source.encode("latin-1", "replace")}})


def remove_script(doc: Document, name: str) -> bytes:
    """A named script removed; an unknown name changes nothing."""
    rows = _scripts(doc)
    return _script_tree(doc, rows) if rows.pop(name.encode("latin-1", "replace"), None) is not None else doc.data


def add_field(doc: Document, number: int, box: Box, name: str, kind: str = "text", value: str = "", options: Sequence[str] = ()) -> bytes:
    """A text, checkbox, choice or signature field; a taken name gets _2, _3, ..."""
    from leafloom.sources.pdf.scan import fields

    pages = _pages(doc)
    if not 1 <= number <= len(pages):
        raise PdfError("a page is out of range")
    taken = {f["name"] for f in fields(doc)}
    own = next(n for n in (name, *(f"{name}_{k}" for k in range(2, len(taken) + 3))) if n not in taken)
    d: dict = {"Type": Name("Annot"), "Subtype": Name("Widget"), "T": own.encode("latin-1", "replace"), "Rect": [box[0], box[1], box[0] + box[2], box[1] + box[3]], "F": 4, "FT": Name({"checkbox": "Btn", "choice": "Ch", "signature": "Sig"}.get(kind, "Tx")), "DA": b"/Helv 10 Tf 0 g"}
    look = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, box[2], box[3]]}, b"")
    if kind == "checkbox":
        d |= {"V": Name("Yes" if value else "Off"), "AS": Name("Yes" if value else "Off"), "AP": {"N": {"Yes": look, "Off": look}}}
    else:
        d |= {"AP": {"N": look}} | ({"V": value.encode("latin-1", "replace")} if value else {}) | ({"Opt": [o.encode("latin-1", "replace") for o in options]} if options else {})
    # the field is one object that both the page and the form refer to
    num = max([*doc.entries, 0]) + 1
    doc._cache[num] = d
    form = doc.dict_of(doc.catalog, "AcroForm")
    catalog = {"AcroForm": form | {"Fields": [*doc.list_of(form, "Fields"), Ref(num, 0)], "NeedAppearances": True}}
    page = pages[number - 1]
    return assembled(pages, {number - 1: {"Annots": [*doc.list_of(page.dict, "Annots"), Ref(num, 0)]}}, keep=doc, catalog=catalog)


def encrypt(doc: Document, user: str, owner: str | None = None) -> bytes:
    """The file under a password."""
    from leafloom.sources.pdf.crypt import Lock

    return assembled(_pages(doc), keep=doc, lock=Lock(user, owner))


def decrypt(doc: Document) -> bytes:
    """The file, opened with its password, without one."""
    return assembled(_pages(doc), keep=doc)


def compare(old: Document, new: Document) -> dict:
    """Words added and removed on every page, a page that one lacks counting as empty."""
    from leafloom.operators.diff import sequence_diff

    words = lambda doc: [page_text(Interpreter(doc).page(p).glyphs).split() for p in doc.pages()]
    a, b = words(old), words(new)
    pages = []
    for i in range(max(len(a), len(b))):
        added, removed = sequence_diff(a[i] if i < len(a) else [], b[i] if i < len(b) else [])
        pages.append({"page": i + 1, "added": added, "removed": removed})
    changed = [p for p in pages if p["added"] or p["removed"]]
    return {"pages_old": len(a), "pages_new": len(b), "changed_pages": len(changed), "added_words": sum(len(p["added"]) for p in pages), "removed_words": sum(len(p["removed"]) for p in pages), "identical": not changed, "pages": changed}
