"""Writing PDF files: reachable objects only, numbered densely."""

from __future__ import annotations

import zlib
from typing import Any

from leafloom.sources.pdf.crypt import Lock
from leafloom.sources.pdf.document import Document, Page
from leafloom.sources.pdf.lexer import Keyword, Name, Ref, Stream

_PLAIN = frozenset(range(0x21, 0x7F)) - frozenset(b"()<>[]{}/%#")


def number(x: float) -> str:
    """At most six decimals, no exponent, no minus zero."""
    if isinstance(x, int):
        return str(x)
    text = f"{x:.6f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "", "nan", "inf", "-inf") else text


def serialized(x: Any) -> bytes:
    if x is None:
        return b"null"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, int | float):
        return number(x).encode()
    if isinstance(x, Name):
        return b"/" + b"".join(bytes([c]) if c in _PLAIN else b"#%02X" % c for c in x.encode("latin-1", "replace"))
    if isinstance(x, Keyword):
        return x.encode("latin-1")
    if isinstance(x, bytes):
        return b"<" + x.hex().encode() + b">" if any(c > 126 or c < 32 for c in x) else b"(" + x.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
    if isinstance(x, Ref):
        return b"%d %d R" % x
    if isinstance(x, list):
        return b"[" + b" ".join(map(serialized, x)) + b"]"
    if isinstance(x, dict):
        return b"<<" + b"".join(serialized(Name(k)) + b" " + serialized(v) + b"\n" for k, v in x.items()) + b">>"
    raise TypeError(f"{type(x).__name__} is no PDF object")


def operation(op: str, operands: list, raw: bytes | None = None) -> bytes:
    """One content operation."""
    if op == "BI":
        return b"BI " + b" ".join(serialized(Name(k)) + b" " + serialized(v) for k, v in operands[0].items()) + b"\nID " + (raw or b"") + b"\nEI\n"
    return b" ".join([*map(serialized, operands), op.encode("latin-1")]) + b"\n"


class Builder:
    """Collects objects, copying them from documents as they are reached."""

    def __init__(self) -> None:
        self.objects: list[Any] = []
        self._copied: dict[tuple[int, int], Ref] = {}

    def add(self, x: Any) -> Ref:
        self.objects.append(x)
        return Ref(len(self.objects), 0)

    def copy(self, doc: Document, x: Any, drop: frozenset[str] = frozenset()) -> Any:
        """An object with all that it reaches; ``drop`` names keys left out of dictionaries at any depth."""
        if isinstance(x, Ref):
            key = (id(doc), x.num)
            if key not in self._copied:
                self._copied[key] = self.add(None)
                at, found = self._copied[key].num - 1, doc.get(x.num)
                self.objects[at] = self._stream(doc, found, drop) if isinstance(found, Stream) else self.copy(doc, found, drop)
            return self._copied[key]
        if isinstance(x, list):
            return [self.copy(doc, v, drop) for v in x]
        if isinstance(x, dict):
            return {k: self.copy(doc, v, drop) for k, v in x.items() if k not in drop}
        if isinstance(x, Stream):  # a stream is never part of another object
            return self.add(self._stream(doc, x, drop))
        return x

    def _stream(self, doc: Document, x: Stream, drop: frozenset[str]) -> Stream:
        return Stream(self.copy(doc, {k: v for k, v in x.dict.items() if k != "Length"}, drop), x.raw)

    def place(self, doc: Document, ref: Ref, new: Ref) -> None:
        """From now on a reference of a document means an object that is already here."""
        self._copied[id(doc), ref.num] = new

    def stream(self, data: bytes, *, level: int = -1, **entries: Any) -> Ref:
        return self.add(Stream({"Filter": Name("FlateDecode"), **entries}, zlib.compress(data, level)))

    def save(self, root: Ref, info: Ref | None = None, lock: Lock | None = None) -> bytes:
        if lock:
            self.objects = [lock.closed(x) for x in self.objects]
            self.objects.append(lock.entries)
        out, offsets = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
        for i, x in enumerate(self.objects):
            offsets.append(len(out))
            out += b"%d 0 obj\n" % (i + 1)
            if isinstance(x, Stream):
                out += serialized(x.dict | {"Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
            else:
                out += serialized(x)
            out += b"\nendobj\n"
        at = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(offsets) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
        trailer = {"Size": len(offsets) + 1, "Root": root} | ({"Info": info} if info else {}) | ({"Encrypt": Ref(len(offsets), 0), "ID": [lock.id, lock.id]} if lock else {})
        return bytes(out + b"trailer\n" + serialized(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at)


#: Entries that a page passes on to a copy by itself, with what it inherits made its own.
_OWN = ("MediaBox", "CropBox", "Rotate", "Resources")


def assembled(pages: list[Page], changes: dict[int, dict] | None = None, drop: frozenset[str] = frozenset(), outlines: bool = True, keep: Document | None = None, catalog: dict | None = None, info: bool = True, lock: Lock | None = None) -> bytes:
    """A file of the pages in order; a page may come from any document and more than once.

    ``keep`` names a document whose catalog and information stay, with the entries of
    ``catalog`` set (a value of None removes one); else only pages and bookmarks do.

    ``changes``: by place in the list, entries set (a value of None removes one). Bookmarks of
    the documents stay where a page that they lead to does, together with the entries above them.
    """
    out = Builder()
    tree = out.add(None)
    kids, first = [], {}
    for i, page in enumerate(pages):
        new = out.add(None)
        kids.append(new)
        if page.ref and (id(page.doc), page.ref.num) not in first:
            first[id(page.doc), page.ref.num] = new
            out.place(page.doc, page.ref, new)
    for i, page in enumerate(pages):
        d = {k: v for k, v in page.dict.items() if k != "Parent"}
        for key in _OWN:
            found = page.inherited(key)
            if key not in d and found is not None:
                d[key] = found
        new = (changes or {}).get(i) or {}
        # what is replaced is not copied, so that nothing of it stays in the file
        own = out.copy(page.doc, {k: v for k, v in d.items() if k not in new}, drop)
        for k, v in new.items():
            if v is not None:
                own[k] = out.stream(v) if k == "Contents" and isinstance(v, bytes) else out.copy(page.doc, v, drop)
        out.objects[kids[i].num - 1] = {"Type": Name("Page"), **own, "Parent": tree}
    out.objects[tree.num - 1] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    root = {"Type": Name("Catalog"), "Pages": tree}
    told = None
    if keep is not None:
        own = {k: v for k, v in (keep.catalog or {}).items() if k not in ("Type", "Pages", "Outlines")} | (catalog or {})
        root |= {k: out.copy(keep, v, drop) for k, v in own.items() if v is not None}
        told = out.add(out.copy(keep, keep.info)) if info and keep.info else None
    if outlines:
        marks = _outlines(out, pages)
        if marks:
            root["Outlines"] = marks
    return out.save(out.add(root), told, lock)


def destination(doc: Document, x: Any) -> Ref | None:
    """The page that a bookmark's or link's destination leads to."""
    for _ in range(4):
        x = doc.resolve(x) if not isinstance(x, list) else x
        if isinstance(x, list):
            return x[0] if x and isinstance(x[0], Ref) else None
        if isinstance(x, dict):
            x = x.get("D")
        elif isinstance(x, Name):
            x = doc.dict_of(doc.catalog, "Dests").get(x)
        elif isinstance(x, bytes):
            x = next((v for k, v in doc.name_tree(doc.dict_of(doc.catalog, "Names").get("Dests")) if k == x), None)
        else:
            return None
    return None


def bookmarks(doc: Document, most: int = 100_000) -> list[dict]:
    """path (from 1), title, page reference of every outline item, in order."""
    found: list[dict] = []
    seen: set[int] = set()

    def walk(ref: Any, path: tuple[int, ...]) -> None:
        i = 0
        while isinstance(ref, Ref) and ref.num not in seen and len(found) < most and len(path) < 64:
            seen.add(ref.num)
            item = doc.resolve(ref)
            if not isinstance(item, dict):
                return
            i += 1
            found.append({"path": (*path, i), "title": doc.text(item.get("Title")) or "", "page": destination(doc, item.get("Dest", doc.dict_of(item, "A").get("D")))})
            walk(item.get("First"), (*path, i))
            ref = item.get("Next")

    walk(doc.dict_of(doc.catalog, "Outlines").get("First"), ())
    return found


def _outlines(out: Builder, pages: list[Page]) -> Ref | None:
    items: list[tuple[tuple, str, Ref | None]] = []
    docs: list[Document] = list({id(p.doc): p.doc for p in pages}.values())
    for k, doc in enumerate(docs):
        here = {p.ref.num for p in pages if p.doc is doc and p.ref}
        marks = bookmarks(doc)
        needed = {m["path"][:n] for m in marks if m["page"] and m["page"].num in here for n in range(1, len(m["path"]) + 1)}
        for m in marks:
            if m["path"] in needed:
                target = out._copied.get((id(doc), m["page"].num)) if m["page"] and m["page"].num in here else None
                items.append(((k, *m["path"]), m["title"], target))
    if not items:
        return None
    root = out.add(None)
    refs = {path: out.add(None) for path, _, _ in items}
    children: dict[tuple, list[tuple]] = {}
    for path, _, _ in items:
        children.setdefault(path[:-1] if len(path) > 2 else (), []).append(path)
    for path, title, target in items:
        own = children.get(path[:-1] if len(path) > 2 else (), [])
        at = own.index(path)
        d = {"Title": title.encode("latin-1") if title.isascii() else b"\xfe\xff" + title.encode("utf-16-be"), "Parent": refs.get(path[:-1], root) if len(path) > 2 else root}
        if target:
            d["Dest"] = [target, Name("Fit")]
        if at:
            d["Prev"] = refs[own[at - 1]]
        if at + 1 < len(own):
            d["Next"] = refs[own[at + 1]]
        below = children.get(path, [])
        if below:
            d |= {"First": refs[below[0]], "Last": refs[below[-1]], "Count": len(below)}
        out.objects[refs[path].num - 1] = d
    top = children[()]
    out.objects[root.num - 1] = {"Type": Name("Outlines"), "First": refs[top[0]], "Last": refs[top[-1]], "Count": len(items)}
    return root


def incremental(doc: Document, changed: dict[int, Any]) -> bytes:
    """The file with a revision appended that redefines the given objects."""
    out, offsets = bytearray(doc.data), {}
    if not out.endswith(b"\n"):
        out += b"\n"
    for num, x in sorted(changed.items()):
        offsets[num] = len(out)
        out += b"%d 0 obj\n" % num
        out += serialized(x.dict | {"Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream" if isinstance(x, Stream) else serialized(x)
        out += b"\nendobj\n"
    at = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % p for p in offsets.items())
    before = doc.data.rfind(b"startxref")
    trailer = {k: doc.trailer[k] for k in ("Root", "Info", "ID") if k in doc.trailer} | {"Size": max([*doc.entries, *changed]) + 1, "Prev": int(doc.data[before + 9 :].split()[0])}
    return bytes(out + b"trailer\n" + serialized(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at)
