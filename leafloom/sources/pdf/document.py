"""A PDF file's objects and pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from leafloom.sources.pdf import filters
from leafloom.sources.pdf.crypt import Security
from leafloom.sources.pdf.errors import PdfError
from leafloom.sources.pdf.lexer import Keyword, Lexer, Name, Ref, Stream, text_of

#: Limits: sections of the cross-reference chain, entries of one table, pages, depths of trees.
MOST_SECTIONS, MOST_ENTRIES, MOST_PAGES = 1024, 10_000_000, 1_000_000
TREE_DEPTH, PAGE_DEPTH = 64, 256
LETTER = [0, 0, 612, 792]
_OBJ = re.compile(rb"(?<![0-9])([0-9]{1,10})[\0\t\n\f\r ]+([0-9]{1,5})[\0\t\n\f\r ]+obj(?![A-Za-z])")
_START = re.compile(rb"startxref[\0\t\n\f\r ]*([0-9]+)")


class Document:
    """An opened file. The newest definition of an object counts; damage makes the table be rebuilt."""

    def __init__(self, data: bytes, password: str | None = None) -> None:
        self.data, self.rebuilt = data, False
        self.entries: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.security: Security | None = None
        self._cache: dict[int, Any] = {}
        self._packed: dict[int, dict[int, Any]] = {}
        self._busy: set[int] = set()
        if b"%PDF-" not in data[:1024] and not re.search(rb"\bobj\b", data[:4096]):
            raise PdfError("this is not a PDF file")
        try:
            self._read_chain()
            sound = "Root" in self.trailer and all(self._at_header(n, e) for n, e in self.entries.items())
        except (PdfError, IndexError, ValueError, KeyError):
            sound = False
        if not sound:
            self._rebuild()
        crypt = self.resolve(self.trailer.get("Encrypt"))
        if isinstance(crypt, dict):
            ids = self.resolve(self.trailer.get("ID")) or [b""]
            d = {k: self.resolve(v) for k, v in crypt.items()}
            self.security = Security(d, ids[0] if isinstance(ids[0], bytes) else b"", password)
            where = self.trailer.get("Encrypt")
            self._plain = where.num if isinstance(where, Ref) else None
            self._cache.clear()
        if not isinstance(self.catalog, dict):
            if self.rebuilt:
                raise PdfError("the file has no catalog")
            self._rebuild()
            if not isinstance(self.catalog, dict):
                raise PdfError("the file has no catalog")

    # -- cross references

    def _read_chain(self) -> None:
        tail = self.data[-2048:]
        starts = _START.findall(tail)
        if not starts:
            raise PdfError("no startxref")
        todo, seen = [int(starts[-1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            if len(seen) > MOST_SECTIONS or not 0 <= at < len(self.data):
                raise PdfError("the cross-reference chain is broken")
            trailer = self._table(at) if re.match(rb"[\0\t\n\f\r ]*xref", self.data[at : at + 40]) else self._xref_stream(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            todo += [int(trailer[k]) for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)]

    def _table(self, at: int) -> dict:
        lex = Lexer(self.data, at, refs=False)
        lex.object()
        while True:
            first = lex.object()
            if isinstance(first, Keyword):
                if first != "trailer":
                    raise PdfError("a cross-reference table does not end in a trailer")
                lex.refs = True
                d = lex.object()
                if not isinstance(d, dict):
                    raise PdfError("a trailer is not a dictionary")
                return d
            count = lex.object()
            if not isinstance(first, int) or not isinstance(count, int) or not 0 <= count <= MOST_ENTRIES:
                raise PdfError("a cross-reference section is malformed")
            for i in range(count):
                offset, gen, kind = lex.object(), lex.object(), lex.object()
                if kind not in ("n", "f") or not isinstance(offset, int):
                    raise PdfError("a cross-reference entry is malformed")
                self.entries.setdefault(first + i, ("n", offset, gen) if kind == "n" else ("f",))

    def _xref_stream(self, at: int) -> dict:
        _, stream = self._indirect(at)
        if not isinstance(stream, Stream) or stream.dict.get("Type") != "XRef":
            raise PdfError("no cross-reference stream here")
        d, data = stream.dict, self.decoded(stream)
        widths = d.get("W")
        if not isinstance(widths, list) or len(widths) < 3 or any(not isinstance(w, int) or not 0 <= w <= 8 for w in widths):
            raise PdfError("a cross-reference stream's widths are malformed")
        index, size, p = d.get("Index") or [0, d.get("Size", 0)], sum(widths[:3]), 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for i in range(min(count, MOST_ENTRIES)):
                row = data[p : p + size]
                p += size
                if len(row) < size or not size:
                    break
                a, b = widths[0], widths[0] + widths[1]
                kind = int.from_bytes(row[:a], "big") if a else 1
                x, y = int.from_bytes(row[a:b], "big"), int.from_bytes(row[b:size], "big")
                self.entries.setdefault(first + i, ("n", x, y) if kind == 1 else ("c", x, y) if kind == 2 else ("f",))
        return d

    def _at_header(self, num: int, entry: tuple) -> bool:
        if entry[0] != "n":
            return True
        m = _OBJ.match(self.data, Lexer_skip(self.data, entry[1])) if 0 < entry[1] < len(self.data) else None
        return bool(m) and int(m[1]) == num

    def _rebuild(self) -> None:
        """Finds objects by their headers; the last definition of each counts."""
        self.rebuilt, self.entries, self.trailer = True, {}, {}
        self._cache.clear()
        self._packed.clear()
        for m in _OBJ.finditer(self.data):
            self.entries[int(m[1])] = ("n", m.start(), int(m[2]))
        for m in re.finditer(rb"trailer", self.data):
            try:
                d = Lexer(self.data, m.end()).object()
            except PdfError:
                continue
            if isinstance(d, dict):
                self.trailer.update(d)
        for num in list(self.entries):
            try:
                x = self.get(num)
            except PdfError:
                continue
            if isinstance(x, Stream) and x.dict.get("Type") == "XRef":
                for k, v in x.dict.items():
                    self.trailer.setdefault(k, v)
            elif isinstance(x, Stream) and x.dict.get("Type") == "ObjStm":
                for inner in self._objects_in(num):
                    self.entries.setdefault(inner, ("c", num, 0))
        if "Root" not in self.trailer:
            for num in self.entries:
                try:
                    x = self.get(num)
                except PdfError:
                    continue
                if isinstance(x, dict) and x.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(num, 0)
        if "Root" not in self.trailer:
            raise PdfError("the file has no trailer")

    # -- objects

    def _indirect(self, at: int) -> tuple[int, Any]:
        m = _OBJ.match(self.data, Lexer_skip(self.data, at))
        if not m:
            raise PdfError("no object at its place")
        lex = Lexer(self.data, m.end())
        x = lex.object()
        if isinstance(x, dict):
            lex.skip()
            if self.data.startswith(b"stream", lex.at):
                x = Stream(x, self._stream_data(x, lex.at + 6))
        if isinstance(x, Keyword):
            x = None
        return int(m[1]), x

    def _stream_data(self, d: dict, at: int) -> bytes:
        at += 2 if self.data[at : at + 2] == b"\r\n" else 1 if self.data[at : at + 1] in (b"\n", b"\r") else 0
        length = d.get("Length")
        if isinstance(length, Ref):
            length = self.resolve(length)
        if isinstance(length, int) and 0 <= length <= len(self.data) - at and re.match(rb"[\0\t\n\f\r ]{0,4}endstream", self.data[at + length : at + length + 16]):
            return self.data[at : at + length]
        end = self.data.find(b"endstream", at)
        if end < 0:
            raise PdfError("a stream does not end")
        body = self.data[at:end]
        return body[:-2] if body.endswith(b"\r\n") else body[:-1] if body[-1:] in (b"\n", b"\r") else body

    def get(self, num: int) -> Any:
        """The object of a number; null if there is none."""
        if num in self._cache:
            return self._cache[num]
        entry = self.entries.get(num)
        if entry is None or entry[0] == "f" or num in self._busy:
            return None
        self._busy.add(num)
        try:
            if entry[0] == "n":
                _, x = self._indirect(entry[1])
                if self.security and num != self._plain:
                    x = self.security.opened(x, num, entry[2])
            else:
                x = self._objects_in(entry[1]).get(num)
        finally:
            self._busy.discard(num)
        self._cache[num] = x
        return x

    def _objects_in(self, num: int) -> dict[int, Any]:
        """The objects of an object stream; what comes before damage is kept."""
        if num not in self._packed:
            out: dict[int, Any] = {}
            holder = self.get(num)
            if isinstance(holder, Stream):
                try:
                    data = self.decoded(holder)
                    n, first = int(holder.dict.get("N", 0)), int(holder.dict.get("First", 0))
                    head = Lexer(data, 0, refs=False)
                    pairs = [(head.object(), head.object()) for _ in range(min(n, MOST_ENTRIES))]
                    for inner, offset in pairs:
                        if not isinstance(inner, int) or not isinstance(offset, int):
                            break
                        out[inner] = Lexer(data, first + offset).object()
                except PdfError:
                    pass
            self._packed[num] = out
        return self._packed[num]

    def resolve(self, x: Any) -> Any:
        for _ in range(TREE_DEPTH):
            if not isinstance(x, Ref):
                return x
            x = self.get(x.num)
        return None

    def decoded(self, stream: Stream) -> bytes:
        return self.decoded_or_codec(stream)[0]

    def decoded_or_codec(self, stream: Stream) -> tuple[bytes, str | None]:
        names, parms = self.resolve(stream.dict.get("Filter")), self.resolve(stream.dict.get("DecodeParms"))
        names = [names] if isinstance(names, Name) else [self.resolve(n) for n in names or []]
        parms = [parms] if isinstance(parms, dict) else [self.resolve(p) for p in parms or []]
        return filters.decode(stream.raw, names, [{k: self.resolve(v) for k, v in (p or {}).items()} for p in parms])

    # -- structure

    @property
    def catalog(self) -> dict | None:
        root = self.resolve(self.trailer.get("Root"))
        return root if isinstance(root, dict) else None

    @property
    def info(self) -> dict:
        found = self.resolve(self.trailer.get("Info"))
        return found if isinstance(found, dict) else {}

    def dict_of(self, owner: dict | None, key: str) -> dict:
        """A dictionary entry, or an empty one: a wrong type is as good as absent."""
        x = self.resolve((owner or {}).get(key))
        return x if isinstance(x, dict) else x.dict if isinstance(x, Stream) else {}

    def list_of(self, owner: dict | None, key: str) -> list:
        x = self.resolve((owner or {}).get(key))
        return x if isinstance(x, list) else []

    def page_nodes(self) -> Iterator[tuple[Ref | None, dict, list[dict]]]:
        """(reference, page, its ancestors from the nearest) of every page that the tree reaches."""
        seen: set[int] = set()
        count = 0

        def walk(ref: Any, above: list[dict]) -> Iterator:
            nonlocal count
            node = self.resolve(ref)
            if not isinstance(node, dict) or len(above) > PAGE_DEPTH or isinstance(ref, Ref) and ref.num in seen:
                return
            if isinstance(self.resolve(node.get("Kids")), list):
                if isinstance(ref, Ref):
                    seen.add(ref.num)
                for kid in self.list_of(node, "Kids"):
                    yield from walk(kid, [node, *above])
            else:
                count += 1
                if count > MOST_PAGES:
                    raise PdfError("too many pages")
                yield ref if isinstance(ref, Ref) else None, node, above

        yield from walk((self.catalog or {}).get("Pages"), [])

    def pages(self) -> list["Page"]:
        return [Page(self, i + 1, *x) for i, x in enumerate(self.page_nodes())]

    def name_tree(self, root: Any) -> Iterator[tuple[bytes, Any]]:
        """(key, value) in the tree's order."""
        seen: set[int] = set()

        def walk(ref: Any, depth: int) -> Iterator[tuple[bytes, Any]]:
            node = self.resolve(ref)
            if not isinstance(node, dict) or depth > TREE_DEPTH or isinstance(ref, Ref) and ref.num in seen:
                return
            if isinstance(ref, Ref):
                seen.add(ref.num)
            names = self.list_of(node, "Names")
            yield from ((k, v) for k, v in zip(map(self.resolve, names[::2]), names[1::2], strict=False) if isinstance(k, bytes))
            for kid in self.list_of(node, "Kids"):
                yield from walk(kid, depth + 1)

        yield from walk(root, 0)

    def text(self, x: Any) -> str | None:
        x = self.resolve(x)
        if isinstance(x, Stream):
            return self.decoded(x).decode("utf-8", "replace")
        return text_of(x) if isinstance(x, bytes) else None


def Lexer_skip(data: bytes, at: int) -> int:
    lex = Lexer(data, at)
    lex.skip()
    return lex.at


class Page:
    """A page and what it inherits."""

    def __init__(self, doc: Document, number: int, ref: Ref | None, d: dict, above: list[dict]) -> None:
        self.doc, self.number, self.ref, self.dict, self.above = doc, number, ref, d, above

    def inherited(self, key: str) -> Any:
        return next((x for x in (self.doc.resolve(n.get(key)) for n in [self.dict, *self.above[:TREE_DEPTH]]) if x is not None), None)

    def _box(self, key: str) -> list[float] | None:
        raw = self.inherited(key)
        found = [self.doc.resolve(x) for x in raw] if isinstance(raw, list) else []
        if len(found) != 4 or any(isinstance(x, bool) or not isinstance(x, int | float) for x in found):
            return None
        x0, y0, x1, y1 = map(float, found)
        return [min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)]

    @property
    def media_box(self) -> list[float]:
        return self._box("MediaBox") or [float(x) for x in LETTER]

    @property
    def box(self) -> list[float]:
        """Crop box within the media box, or the media box if nothing is left."""
        media, crop = self.media_box, self._box("CropBox")
        if not crop:
            return media
        both = [max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3])]
        return both if both[0] < both[2] and both[1] < both[3] else media

    @property
    def rotation(self) -> int:
        r = self.inherited("Rotate")
        return int(r // 90 % 4 * 90) if isinstance(r, int | float) else 0

    @property
    def resources(self) -> dict:
        found = self.inherited("Resources")
        return found if isinstance(found, dict) else {}

    @property
    def content(self) -> bytes:
        c = self.doc.resolve(self.dict.get("Contents"))
        parts = [c] if isinstance(c, Stream) else [self.doc.resolve(x) for x in c] if isinstance(c, list) else []
        return b"\n".join(self.doc.decoded(p) for p in parts if isinstance(p, Stream))

    @property
    def annotations(self) -> list[dict]:
        return [a for a in map(self.doc.resolve, self.doc.list_of(self.dict, "Annots")) if isinstance(a, dict)]
