"""PDF files as DataFrames: one row a file in, one row a page, run, link, ... out.

Files are read by Spark's binary source, so any file system works; each file is
parsed where it lies, one at a time. A malformed file gives an error row in
``files`` and no rows elsewhere; it never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.sources.pdf import scan, writer
from leafloom.sources.pdf.content import Interpreter, operations
from leafloom.sources.pdf.document import Document
from leafloom.sources.pdf.errors import PdfError
from leafloom.sources.pdf.runs import COLUMNS, columns_of, text_of
from leafloom.sources.pdf.validate import findings as file_findings

#: Rows of several files that go out together.
ROWS = 256
BOX = "x float, y float, width float, height float"


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every .pdf file under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "content")


def table(files: DataFrame, schema: str, rows: Callable[[Document], Iterator[tuple]], password: str | None = None) -> DataFrame:
    """path and the rows that a function finds in each file; files that can't be read have none."""
    full = f"path string, {schema}"
    names = [c.split()[0] for c in _columns(full)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, _arrow(t)) for n, t in (c.split(None, 1) for c in _columns(full))])
        together = lambda held: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], names)
        for batch in batches:
            held: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    held += [(path, *r) for r in rows(Document(content.as_py() or b"", password))]
                except (PdfError, RecursionError):
                    continue
                if len(held) >= ROWS:
                    yield together(held)
                    held = []
            if held:
                yield together(held)

    return files.select("path", "content").mapInArrow(run, full)


def _columns(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}[kind]


def files(df: DataFrame, password: str | None = None) -> DataFrame:
    """path, pages, encrypted, rebuilt, sha256, error of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    doc = Document(content.as_py() or b"", password)
                    row = (len(doc.pages()), doc.security is not None, doc.rebuilt, None)
                except (PdfError, RecursionError) as e:
                    row = (None, None, None, str(e) or "malformed")
                yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip((path, *row), (pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()), strict=True)], ["path", "pages", "encrypted", "rebuilt", "error"])

    found = df.select("path", "content").mapInArrow(run, "path string, pages int, encrypted boolean, rebuilt boolean, error string")
    return found.join(df.select("path", F.sha2("content", 256).alias("sha256")), "path")


def pages(df: DataFrame) -> DataFrame:
    """path, page, its effective box, rotation, and text in reading order."""

    def rows(doc: Document) -> Iterator[tuple]:
        interpreter = Interpreter(doc)
        for p in doc.pages():
            b = p.box
            yield p.number, b[0], b[1], b[2] - b[0], b[3] - b[1], p.rotation, text_of(interpreter, p)

    return table(df, f"page int, {BOX}, rotation int, text string", rows)


def text_runs(df: DataFrame, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """path, page, seq, text, box, font, size, mode of every run that is neither blank nor without area; ``columns`` names those wanted besides path and page."""
    kinds = pa.schema([("path", pa.string()), ("page", pa.int32()), *((k, COLUMNS[k]) for k in columns)])
    schema = ", ".join(f"{f.name} {f.type}".replace("int32", "int") for f in kinds)

    def found(path: str, content: bytes) -> list[pa.RecordBatch]:
        doc = Document(content)
        interpreter, out = Interpreter(doc), []
        for p in doc.pages():
            own = columns_of(interpreter, p, columns)
            same = [pa.repeat(pa.scalar(v, type=f.type), len(own[0])) for v, f in zip((path, p.number), kinds, strict=False)]
            out.append(pa.RecordBatch.from_arrays([*same, *own], schema=kinds))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    own = [b for b in found(path, content.as_py() or b"") if b.num_rows]
                except (PdfError, RecursionError):
                    continue
                held, n = held + own, n + sum(b.num_rows for b in own)
                if n >= ROWS * 16:
                    yield pa.concat_batches(held)
                    held, n = [], 0
            if held:
                yield pa.concat_batches(held)

    return df.select("path", "content").mapInArrow(run, schema)


def glyphs(df: DataFrame) -> DataFrame:
    """path, page, seq, text, box, invisible of every glyph that has a width."""

    def rows(doc: Document) -> Iterator[tuple]:
        interpreter = Interpreter(doc)
        for p in doc.pages():
            yield from ((p.number, i, g.text, g.x, g.y, g.width, g.height, g.mode == 3) for i, g in enumerate(interpreter.page(p).glyphs) if g.width > 0)

    return table(df, f"page int, seq int, text string, {BOX}, invisible boolean", rows)


def images(df: DataFrame) -> DataFrame:
    """path, page, name, box and size in pixels of every image drawn."""

    def rows(doc: Document) -> Iterator[tuple]:
        interpreter = Interpreter(doc)
        for p in doc.pages():
            yield from ((p.number, m["name"], m["x"], m["y"], m["width"], m["height"], m["pixels_wide"], m["pixels_high"]) for m in interpreter.page(p).images)

    return table(df, f"page int, name string, {BOX}, pixels_wide int, pixels_high int", rows)


def content_operations(df: DataFrame) -> DataFrame:
    """path, page, seq, operator, operands of every operation."""
    return table(df, "page int, seq int, operator string, operands array<string>", lambda doc: ((p.number, i, op, [writer.serialized(x).decode("latin-1") for x in v]) for p in doc.pages() for i, (op, v, _) in enumerate(operations(p.content))))


def annotations(df: DataFrame) -> DataFrame:
    """path, page, subtype, contents of every annotation."""
    return table(df, "page int, subtype string, contents string", lambda doc: ((p.number, str(doc.resolve(a.get("Subtype")) or ""), doc.text(a.get("Contents"))) for p in doc.pages() for a in p.annotations))


def links(df: DataFrame) -> DataFrame:
    """path, page, kind, url, box of every link."""
    return table(df, f"page int, kind string, url string, {BOX}", lambda doc: ((r["page"], r["kind"], r["url"], *(r["box"] or (None,) * 4)) for r in scan.links(doc)))


def uris(df: DataFrame) -> DataFrame:
    """path, page, url of every URI action."""
    return table(df, "page int, url string", lambda doc: ((r["page"], r["url"]) for r in scan.uris(doc)))


def scripts(df: DataFrame) -> DataFrame:
    """path, seq, origin, page, name, source of every script."""
    return table(df, "seq int, origin string, page int, name string, source string", lambda doc: ((i, r["origin"], r["page"], r["name"], r["source"]) for i, r in enumerate(scan.scripts(doc))))


def form_fields(df: DataFrame) -> DataFrame:
    """path, name, type, value, options, read_only, page of every terminal field."""
    return table(df, "name string, type string, value string, options array<string>, read_only boolean, page int", lambda doc: ((f["name"], f["type"], f["value"], f["options"], f["read_only"], f["page"]) for f in scan.fields(doc)))


def signatures(df: DataFrame) -> DataFrame:
    """path, name, signer, covered bytes, whether all is covered."""
    return table(df, "name string, signer string, covered long, covers_whole boolean", lambda doc: ((s["name"], s["signer"], s["covered"], s["covers_whole"]) for s in scan.signatures(doc)))


def outlines(df: DataFrame) -> DataFrame:
    """path, place in the tree, title, page of every bookmark."""

    def rows(doc: Document) -> Iterator[tuple]:
        number = {p.ref.num: p.number for p in doc.pages() if p.ref}
        yield from ((list(m["path"]), m["title"], number.get(m["page"].num) if m["page"] else None) for m in writer.bookmarks(doc))

    return table(df, "place array<int>, title string, page int", rows)


def hidden_data(df: DataFrame) -> DataFrame:
    """path and the counts of hidden data."""
    keys = ("metadata", "attachments", "scripts_and_actions", "annotations", "bookmarks", "layers")
    out = table(df, ", ".join(f"{k} int" for k in keys), lambda doc: iter([tuple(scan.hidden(doc)[k] for k in keys)]))
    return out.withColumn("has_any", F.greatest(*keys) > 0)


def safety(df: DataFrame) -> DataFrame:
    """path, scripts, outward actions, samples."""
    return table(df, "js_count int, url_count int, samples array<string>", lambda doc: iter([tuple(scan.safety(doc).values())]))


def findings(df: DataFrame, password: str | None = None) -> DataFrame:
    """path, code, severity, location, message of every structural finding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [(path, *f) for f in file_findings(content.as_py() or b"", password)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*found, strict=True)], ["path", "code", "severity", "location", "message"])

    return df.select("path", "content").mapInArrow(run, "path string, code string, severity string, location string, message string")


def edited(df: DataFrame, change: Callable[[Document], bytes], password: str | None = None) -> DataFrame:
    """path, content after an edit, error; a file that can't be edited keeps its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    row = (change(Document(content or b"", password)), None)
                except (PdfError, RecursionError) as e:
                    row = (content, str(e) or "malformed")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([row[0]], type=pa.binary()), pa.array([row[1]], type=pa.string())], ["path", "content", "error"])

    return df.select("path", "content").mapInArrow(run, "path string, content binary, error string")
