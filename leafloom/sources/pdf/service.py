"""Requests on files: {id, action, payload} in, {id, ok, result} out.

A request that can't be served is an answer with ok false and an error; it never
fails the job. Files travel as base64 in ``pdf``. Actions that need a raster, OCR,
office import, certificates or a network are not offered.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame

from leafloom.sources.pdf import edit, scan, validate
from leafloom.sources.pdf.content import Interpreter, page_text
from leafloom.sources.pdf.document import Document
from leafloom.sources.pdf.errors import PdfError


def _doc(p: dict, key: str = "pdf") -> Document:
    return Document(base64.b64decode(p[key]), p.get("password"))


def _file(data: bytes, **more: object) -> dict:
    return {"pdf": base64.b64encode(data).decode(), **more}


def _box(r: dict) -> tuple[float, float, float, float]:
    return float(r["x"]), float(r["y"]), float(r["width"]), float(r["height"])


def _page(p: dict) -> int:
    return int(p.get("page", 1))


def _info(p: dict) -> dict:
    doc = _doc(p)
    pages = [{"number": x.number, "x": x.box[0], "y": x.box[1], "width": x.box[2] - x.box[0], "height": x.box[3] - x.box[1], "rotation": x.rotation} for x in doc.pages()]
    return {"page_count": len(pages), "pages": pages, "encrypted": doc.security is not None}


def _redact(p: dict) -> dict:
    doc = _doc(p)
    out, report = edit.redact(doc, [(int(r["page"]), _box(r)) for r in p["regions"]])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _file(out, report={"pages": report, "sha256_before": sha(doc.data), "sha256_after": sha(out), "timestamp": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "residual_scripts": scan.safety(doc)["js_count"]})


def _labels(p: dict) -> dict:
    out, made = edit.labels(_doc(p), p.get("prefix", ""), p.get("suffix", ""), int(p.get("start", 1)), int(p.get("digits", 6)), p.get("pages") or ())
    return _file(out, first=made[0] if made else "", last=made[-1] if made else "")


def _flatten(p: dict) -> dict:
    out, fields, others = edit.flatten(_doc(p))
    return _file(out, fields=fields, annotations=others)


def _replace_all(p: dict) -> dict:
    out, n = edit.replace_all(_doc(p), p.get("find", ""), p.get("replace", ""))
    return _file(out, replaced=n)


def _findings(p: dict) -> dict:
    keys = ("code", "severity", "location", "message")
    found = [dict(zip(keys, f, strict=True)) for f in validate.findings(base64.b64decode(p["pdf"]), p.get("password"))]
    return {"findings": found, "valid": not any(f["severity"] == "Error" for f in found)}


def _page_texts(p: dict) -> dict:
    doc = _doc(p)
    pages, interpreter = doc.pages(), Interpreter(doc)
    n = _page(p)
    return {"text": page_text(interpreter.page(pages[n - 1]).glyphs) if 1 <= n <= len(pages) else ""}


def _region(p: dict) -> dict:
    doc = _doc(p)
    pages, n = doc.pages(), _page(p)
    return edit.region_text(Interpreter(doc).page(pages[n - 1]).glyphs if 1 <= n <= len(pages) else [], _box(p))


ACTIONS: dict[str, Callable[[dict], dict]] = {
    "ping": lambda p: {"pong": True},
    "diagnostics": lambda p: {"actions": sorted(ACTIONS)},
    "info": _info,
    "page-text": _page_texts,
    "get-region-text": _region,
    "find-text": lambda p: {"matches": edit.find(_doc(p), p.get("phrase", ""), p.get("mode", "contains"), bool(p.get("caseSensitive", False)))},
    "replace-all": _replace_all,
    "replace-region-text": lambda p: _file(edit.replace_region(_doc(p), _page(p), _box(p), p["text"])),
    "move-text": lambda p: _file(edit.move_text(_doc(p), _page(p), _box(p), float(p["dx"]), float(p["dy"]))),
    "move-image": lambda p: _file(edit.move_image(_doc(p), _page(p), _box(p), float(p["dx"]), float(p["dy"]))),
    "add-text": lambda p: _file(edit.add_text(_doc(p), [(_page(p), float(p["x"]), float(p["y"]), p["text"])], float(p.get("size", 12)))),
    "add-drawing": lambda p: _file(edit.ink(_doc(p), _page(p), [tuple(map(float, q)) for q in p["points"]], float(p.get("width", 2)))),
    "add-highlight": lambda p: _file(edit.draw_boxes(_doc(p), [(int(r.get("page", _page(p))), _box(r)) for r in p["regions"]])),
    "redact": _redact,
    "rotate": lambda p: _file(edit.rotate(_doc(p), int(p["degrees"]), p.get("pages") or ())),
    "arrange-pages": lambda p: _file(edit.arrange(_doc(p), p["order"])),
    "merge": lambda p: _file(edit.merge([Document(base64.b64decode(x)) for x in p["pdfs"]])),
    "merge-files": lambda p: _file(edit.merge([_doc(x) for x in p["files"]])),
    "watermark": lambda p: _file(edit.watermark(_doc(p), p["text"], float(p.get("opacity", 0.3)), p.get("pages") or ())),
    "bates": _labels,
    "flatten": _flatten,
    "form-fields": lambda p: {"fields": scan.fields(_doc(p))},
    "fill-form": lambda p: _file(edit.fill(_doc(p), p["values"])),
    "add-form-field": lambda p: _file(edit.add_field(_doc(p), _page(p), _box(p), p["name"], p.get("type", "text"), p.get("value", ""), p.get("options") or ())),
    "validate": _findings,
    "scan-safety": lambda p: scan.safety(_doc(p)),
    "js-sources": lambda p: {"sources": [s["source"] for s in scan.scripts(_doc(p))]},
    "list-scripts": lambda p: {"scripts": [s for s in scan.scripts(_doc(p)) if s["origin"] == "tree"]},
    "add-script": lambda p: _file(edit.add_script(_doc(p), p["name"], p["script"])),
    "remove-script": lambda p: _file(edit.remove_script(_doc(p), p["name"])),
    "strip-active": lambda p: _file(edit.strip_active(_doc(p), bool(p.get("javaScript", True)), bool(p.get("urls", True)))),
    "inspect-hidden": lambda p: scan.hidden(_doc(p)),
    "sanitize": lambda p: _file(edit.sanitize(_doc(p), **{k: bool(p.get(k, True)) for k in ("metadata", "attachments", "scripts", "annotations", "bookmarks", "layers")})),
    "list-urls": lambda p: {"links": scan.uris(_doc(p))},
    "list-link-hotspots": lambda p: {"links": scan.links(_doc(p))},
    "compare": lambda p: edit.compare(_doc(p, "other"), _doc(p)),
    "signatures": lambda p: {"signatures": scan.signatures(_doc(p))},
    "encrypt": lambda p: _file(edit.encrypt(_doc(p), p["userPassword"], p.get("ownerPassword"))),
    "decrypt": lambda p: _file(edit.decrypt(_doc(p))),
}


def handle(request: str) -> dict:
    """The answer to one request."""
    asked: dict = {}
    try:
        asked = json.loads(request)
        payload = asked.get("payload") or {}
        if asked.get("action") not in ACTIONS:
            raise PdfError(f"unknown action {asked.get('action')!r}")
        return {"id": asked.get("id", ""), "ok": True, "result": ACTIONS[asked["action"]](payload)}
    except (PdfError, ValueError, KeyError, TypeError, AttributeError, IndexError, RecursionError) as e:
        name = asked.get("id", "") if isinstance(asked, dict) else ""
        return {"id": name, "ok": False, "result": {"error": str(e) or type(e).__name__}}


def served(requests: DataFrame, body_col: str = "body") -> DataFrame:
    """id, ok, result (JSON) of every request body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [handle(b or "") for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([str(a["id"]) for a in answers]), pa.array([a["ok"] for a in answers]), pa.array([json.dumps(a["result"]) for a in answers])], ["id", "ok", "result"])

    return requests.select(body_col).mapInArrow(run, "id string, ok boolean, result string")
