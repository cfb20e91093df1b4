"""What a document holds: links, scripts, fields, signatures, hidden and active content."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from leafloom.functions.urls import ACTION_KINDS
from leafloom.sources.pdf.document import TREE_DEPTH, Document
from leafloom.sources.pdf.lexer import Name, Ref, Stream
from leafloom.sources.pdf.writer import bookmarks

#: Fixed sets: actions that reach out of the file, entries that software stamps, annotations that are no hidden data.
OUTWARD = frozenset({"URI", "Launch", "SubmitForm", "GoToR", "ImportData"})
STAMPED = frozenset({"Producer", "CreationDate", "ModDate", "Trapped"})
KEPT_ANNOTATIONS = frozenset({"Link", "Widget"})
SAMPLES, SAMPLE_CHARS = 12, 80


def rect(doc: Document, d: dict) -> tuple[float, float, float, float] | None:
    raw = [doc.resolve(x) for x in doc.list_of(d, "Rect")]
    if len(raw) != 4 or not all(isinstance(x, int | float) for x in raw):
        return None
    x0, y0, x1, y1 = raw
    return min(x0, x1), min(y0, y1), abs(x1 - x0), abs(y1 - y0)


def chain(doc: Document, x: Any, depth: int = 0) -> Iterator[dict]:
    """Actions of an entry: arrays and what comes next are followed."""
    x = doc.resolve(x)
    if depth > TREE_DEPTH:
        return
    if isinstance(x, list):
        for v in x:
            yield from chain(doc, v, depth + 1)
    elif isinstance(x, dict):
        yield x
        yield from chain(doc, x.get("Next"), depth + 1)


def actions(doc: Document) -> Iterator[tuple[str, int, dict]]:
    """(origin, page, action) of every action, in the order of the catalog, pages and annotations."""
    catalog = doc.catalog or {}
    names = doc.dict_of(catalog, "Names")
    for key, x in doc.name_tree(names.get("JavaScript")):
        d = doc.resolve(x)
        if isinstance(d, dict):
            yield "tree", 0, d | {"S": Name("JavaScript")}
    yield from (("open", 0, a) for a in chain(doc, catalog.get("OpenAction")))
    yield from (("document", 0, a) for v in doc.dict_of(catalog, "AA").values() for a in chain(doc, v))
    for page in doc.pages():
        yield from (("page", page.number, a) for v in doc.dict_of(page.dict, "AA").values() for a in chain(doc, v))
        for annotation in page.annotations:
            yield from (("annotation", page.number, a) for a in chain(doc, annotation.get("A")))
            yield from (("annotation", page.number, a) for v in doc.dict_of(annotation, "AA").values() for a in chain(doc, v))


def scripts(doc: Document) -> list[dict]:
    """origin, page, name, source of every script."""
    named = [(doc.text(k) or "", v) for k, v in doc.name_tree(doc.dict_of(doc.catalog, "Names").get("JavaScript"))]
    out = []
    for origin, page, a in actions(doc):
        if doc.resolve(a.get("S")) == "JavaScript":
            out.append({"origin": origin, "page": page, "name": named[len(out)][0] if origin == "tree" and len(out) < len(named) else "", "source": doc.text(a.get("JS")) or ""})
    return out


def safety(doc: Document) -> dict:
    """Scripts, outward actions, and at most 12 distinct samples in the order found."""
    js = urls = 0
    samples: dict[str, None] = {}
    for _, _, a in actions(doc):
        kind = doc.resolve(a.get("S"))
        if kind == "JavaScript":
            js += 1
            flat = (doc.text(a.get("JS")) or "JavaScript").replace("\r", " ").replace("\n", " ").strip()
            samples["JS: " + (flat[:SAMPLE_CHARS] + "…" if len(flat) > SAMPLE_CHARS else flat)] = None
        elif kind in OUTWARD:
            urls += 1
            samples[(doc.text(a.get("URI")) or "URI") if kind == "URI" else str(kind)] = None
    return {"js_count": js, "url_count": urls, "samples": list(samples)[:SAMPLES]}


def links(doc: Document) -> list[dict]:
    """page, kind, url and box of every link annotation."""
    out = []
    for page in doc.pages():
        for a in page.annotations:
            if doc.resolve(a.get("Subtype")) != "Link":
                continue
            action = doc.dict_of(a, "A")
            kind = doc.resolve(action.get("S"))
            url = doc.text(action.get("URI")) if kind == "URI" else str(doc.resolve(action.get("N")) or "") if kind == "Named" else ""
            name = ACTION_KINDS.get(kind, "link") if kind else "goto" if a.get("Dest") is not None else "link"
            out.append({"page": page.number, "kind": name, "url": url or "", "box": rect(doc, a)})
    return out


def uris(doc: Document) -> list[dict]:
    """page and url of every URI action of any annotation, chained ones too; blank ones are left out."""
    return [{"page": p.number, "url": u, "box": rect(doc, a)} for p in doc.pages() for a in p.annotations for x in chain(doc, a.get("A")) if doc.resolve(x.get("S")) == "URI" and (u := (doc.text(x.get("URI")) or "").strip())]


def fields(doc: Document) -> list[dict]:
    """Terminal form fields with what they inherit: name, type, value, options, flags, page, box."""
    pages = {p.ref.num: p.number for p in doc.pages() if p.ref}
    by_widget = {r.num: p.number for p in doc.pages() for r in doc.list_of(p.dict, "Annots") if isinstance(r, Ref)}
    out: list[dict] = []

    def walk(ref: Any, prefix: str, above: dict, depth: int) -> None:
        d = doc.resolve(ref)
        if not isinstance(d, dict) or depth > TREE_DEPTH:
            return
        own = above | {k: d[k] for k in ("FT", "Ff", "V", "Opt") if k in d}
        part = doc.text(d.get("T"))
        name = f"{prefix}.{part}" if prefix and part is not None else part if part is not None else prefix
        kids = [(k, doc.resolve(k)) for k in doc.list_of(d, "Kids")]
        inner = [k for k, x in kids if isinstance(x, dict) and "T" in x]
        if inner:
            for k in inner:
                walk(k, name, own, depth + 1)
            return
        widget_ref, widget = next(((k, x) for k, x in kids if isinstance(x, dict)), (ref, d))
        flags = doc.resolve(own.get("Ff")) or 0
        kind = doc.resolve(own.get("FT"))
        options = [doc.text(o if not isinstance(doc.resolve(o), list) else doc.resolve(o)[-1]) or "" for o in own.get("Opt", []) or []] if isinstance(own.get("Opt"), list) else []
        if not options and kind == "Btn":
            options = list(dict.fromkeys(str(s) for w in ([x for _, x in kids] or [d]) if isinstance(w, dict) for s in doc.dict_of(doc.dict_of(w, "AP"), "N")))
        value = doc.resolve(own.get("V"))
        type_ = {"Btn": "button" if flags & 1 << 16 else "radio" if flags & 1 << 15 else "checkbox", "Ch": "choice", "Sig": "signature"}.get(kind, "text")
        where = widget.get("P")
        page = pages.get(where.num, 0) if isinstance(where, Ref) else by_widget.get(widget_ref.num, 0) if isinstance(widget_ref, Ref) else 0
        out.append({"name": name or "", "type": type_, "value": str(value) if isinstance(value, Name) else doc.text(value) or "", "options": options, "read_only": bool(flags & 1), "page": page, "box": rect(doc, widget), "has_appearance": bool(doc.dict_of(widget, "AP")), "on_page": isinstance(widget_ref, Ref) and widget_ref.num in by_widget})

    for f in doc.list_of(doc.dict_of(doc.catalog, "AcroForm"), "Fields"):
        walk(f, "", {}, 0)
    return out


def signatures(doc: Document) -> list[dict]:
    """name, signer, covered bytes, whether the whole file is covered; ordered by covered bytes. Cryptography is not checked."""
    out = []

    def walk(ref: Any, depth: int) -> None:
        d = doc.resolve(ref)
        if not isinstance(d, dict) or depth > TREE_DEPTH:
            return
        if doc.resolve(d.get("FT")) == "Sig":
            v = doc.dict_of(d, "V")
            spans = [doc.resolve(x) for x in doc.list_of(v, "ByteRange")]
            if len(spans) == 4 and all(isinstance(x, int) for x in spans):
                out.append({"name": doc.text(d.get("T")) or "", "signer": doc.text(v.get("Name")), "covered": spans[2] + spans[3], "covers_whole": spans[0] == 0 and spans[2] + spans[3] == len(doc.data)})
        for k in doc.list_of(d, "Kids"):
            walk(k, depth + 1)

    for f in doc.list_of(doc.dict_of(doc.catalog, "AcroForm"), "Fields"):
        walk(f, 0)
    return sorted(out, key=lambda s: s["covered"])


def hidden(doc: Document) -> dict:
    """Counts of hidden data. A file attached as an annotation counts as an attachment and as an annotation."""
    catalog = doc.catalog or {}
    found = [doc.resolve(a.get("Subtype")) for p in doc.pages() for a in p.annotations]
    metadata = sum(1 for k, v in doc.info.items() if k not in STAMPED and (doc.text(v) or "")) + (doc.resolve(catalog.get("Metadata")) is not None)
    attached = sum(1 for _ in doc.name_tree(doc.dict_of(catalog, "Names").get("EmbeddedFiles"))) + len(doc.list_of(catalog, "AF")) + found.count("FileAttachment")
    active = safety(doc)
    return {"metadata": metadata, "attachments": attached, "scripts_and_actions": active["js_count"] + active["url_count"], "annotations": sum(s not in KEPT_ANNOTATIONS for s in found), "bookmarks": len(bookmarks(doc)), "layers": len(doc.list_of(doc.dict_of(catalog, "OCProperties"), "OCGs"))}


def streams(doc: Document) -> Iterator[tuple[int, Stream]]:
    for num in sorted(doc.entries):
        x = doc.get(num)
        if isinstance(x, Stream):
            yield num, x
