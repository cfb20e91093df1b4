"""Text edits, forms, encryption and the request service of the PDF source."""

import base64
import json

import pytest
from pdf_samples import hidden, positioned, simple
from test_pdf import texts

from leafloom.sources.pdf import edit, scan, service, validate
from leafloom.sources.pdf.content import Interpreter
from leafloom.sources.pdf.document import Document
from leafloom.sources.pdf.errors import PdfError
from leafloom.sources.pdf.lexer import Name


def ask(action, **payload):
    return service.handle(json.dumps({"id": "7", "action": action, "payload": payload}))


def b64(data):
    return base64.b64encode(data).decode()


def made(answer):
    assert answer["ok"], answer
    return base64.b64decode(answer["result"]["pdf"])


def test_find_and_boxes():
    doc = Document(positioned([[("The cat concat", 72, 700, 10), ("Cat", 72, 650, 10)], [("no", 72, 700, 10)]]))
    got = edit.find(doc, "cat")
    assert [(m["page"], m["text"]) for m in got] == [(1, "Cat"), (1, "cat"), (1, "cat")] and got[0]["box"][1] < got[1]["box"][1]
    assert got[1]["box"][0] == 72 + 4 * 6 and abs(got[1]["box"][2] - 18) < 1e-6
    assert len(edit.find(doc, "cat", "whole-word")) == 2 and len(edit.find(doc, "cat", "starts", True)) == 1 and edit.find(doc, "") == [] == edit.find(doc, "dog")
    over = Document(positioned([[("end", 72, 700, 10), ("start", 72, 688, 10)]]))
    assert len(edit.find(over, "end\nstart")) == 2  # a box on each line


def test_region_text_style_and_lines():
    doc = Document(positioned([[("one two", 72, 700, 10), ("below", 72, 688, 14), ("far", 400, 700, 10)]]))
    glyphs = Interpreter(doc).page(doc.pages()[0]).glyphs
    got = edit.region_text(glyphs, (70, 680, 100, 40))
    assert got["text"] == "one two\nbelow" and (got["family"], got["size"]) == ("courier", 14.0)
    assert edit.region_text(glyphs, (0, 0, 5, 5))["text"] == "" and edit.region_text([], (0, 0, 1, 1))["size"] == 12.0


def test_replace_and_move():
    doc = Document(positioned([[("old word here", 72, 700, 10), ("other", 72, 600, 10)]]))
    new, n = edit.replace_all(doc, "word", "wurd")
    assert n == 1 and "wurd" in texts(new)[0] and "word" not in texts(new)[0] and "other" in texts(new)[0]
    assert edit.replace_all(doc, "Word", "x") == (doc.data, 0)
    assert "fresh" in texts(edit.replace_region(doc, 1, (70, 595, 60, 20), "fresh"))[0]
    moved = Document(edit.move_text(doc, 1, (70, 595, 60, 20), 100, -50))
    (m,) = edit.find(moved, "other")
    assert abs(m["box"][0] - 172) < 1 and m["box"][1] < 560
    assert edit.move_text(doc, 1, (0, 0, 1, 1), 5, 5) is doc.data
    for out in (new, moved.data):
        assert validate.findings(out) == []


def test_images_move():
    def extra(out):
        image = out.stream(b"\0", Type=Name("XObject"), Subtype=Name("Image"), Width=1, Height=1, BitsPerComponent=8, ColorSpace=Name("DeviceGray"))
        return {"Contents": out.stream(b"q 0 50 -40 0 100 20 cm /Im Do Q"), "Resources": {"XObject": {"Im": image}}}

    doc = Document(positioned([[]], {1: extra}))
    out = Document(edit.move_image(doc, 1, (70, 30, 5, 5), 10, 7))
    (im,) = Interpreter(out).page(out.pages()[0]).images
    assert (round(im["x"], 6), round(im["y"], 6)) == (70, 27)
    assert edit.move_image(doc, 1, (500, 500, 5, 5), 10, 7) is doc.data


def test_scripts_and_fields_by_name():
    doc = Document(edit.add_script(Document(edit.add_script(Document(hidden()), "b", "two()")), "start", "one()"))
    assert [(s["name"], s["source"]) for s in scan.scripts(doc) if s["origin"] == "tree"] == [("b", "two()"), ("start", "one()")]
    assert [s["name"] for s in scan.scripts(Document(edit.remove_script(doc, "b"))) if s["origin"] == "tree"] == ["start"]
    assert edit.remove_script(doc, "none") is doc.data
    grown = Document(edit.add_field(Document(edit.add_field(Document(hidden()), 1, (10, 50, 40, 12), "who", value="x")), 1, (10, 80, 12, 12), "tick", "checkbox", "y"))
    got = {f["name"]: (f["type"], f["value"], f["page"], f["on_page"]) for f in scan.fields(grown)}
    assert got["who_2"] == ("text", "x", 1, True) and got["tick"] == ("checkbox", "Yes", 1, True) and "who" in got
    assert scan.fields(Document(edit.fill(grown, {"tick": "Maybe"})))[-1]["value"] == "Off"


def test_catalog_stays_where_pages_do():
    doc = Document(hidden())
    for out in (edit.rotate(doc, 90), edit.labels(doc)[0], edit.redact(doc, [(1, (0, 0, 1, 1))])[0]):
        kept = Document(out)
        assert len(scan.fields(kept)) == 1 and len(scan.scripts(kept)) == 2 and scan.hidden(kept)["layers"] == 1 and kept.text(kept.info.get("Title")) == "T"
    part = scan.hidden(Document(edit.sanitize(doc, metadata=False, layers=False)))
    assert part["metadata"] == 3 and part["layers"] == 1 and part["scripts_and_actions"] == part["attachments"] == part["annotations"] == part["bookmarks"] == 0


def test_encryption_round_trip():
    locked = edit.encrypt(Document(simple(1)), "user", "owner")
    assert b"alpha" not in locked
    for password in ("user", "owner"):
        doc = Document(locked, password)
        assert doc.security.method == "aes256" and texts(edit.decrypt(doc)) == texts(simple(1))
    for password in (None, "wrong"):
        with pytest.raises(PdfError):
            Document(locked, password)


def test_compare_files():
    same = edit.compare(Document(simple(2)), Document(simple(2)))
    assert same["identical"] and same["pages"] == []
    got = edit.compare(Document(simple(1)), Document(simple(2)))
    assert (got["pages_old"], got["pages_new"], got["changed_pages"], got["removed_words"]) == (1, 2, 1, 0) and got["pages"][0]["page"] == 2


def test_requests():
    pdf = b64(simple(3))
    assert ask("ping") == {"id": "7", "ok": True, "result": {"pong": True}}
    assert ask("info", pdf=pdf)["result"]["page_count"] == 3
    assert "alpha" in ask("page-text", pdf=pdf, page=2)["result"]["text"] and ask("page-text", pdf=pdf, page=9)["result"]["text"] == ""
    assert len(ask("find-text", pdf=pdf, phrase="ALPHA")["result"]["matches"]) == 3
    assert len(texts(made(ask("arrange-pages", pdf=pdf, order=[2, 2])))) == 2
    assert len(texts(made(ask("merge", pdfs=[pdf, pdf])))) == 6
    assert ask("bates", pdf=pdf, prefix="A", digits=3)["result"]["last"] == "A003"
    red = ask("redact", pdf=pdf, regions=[{"page": 1, "x": 70, "y": 695, "width": 400, "height": 20}])
    assert "alpha" not in texts(made(red))[0] and red["result"]["report"]["pages"][0]["glyphs"] > 10
    assert ask("validate", pdf=pdf)["result"] == {"findings": [], "valid": True}
    assert ask("compare", pdf=pdf, other=pdf)["result"]["identical"]
    h = b64(hidden())
    assert ask("inspect-hidden", pdf=h)["result"]["layers"] == 1 and ask("scan-safety", pdf=h)["result"]["js_count"] == 2
    assert scan.hidden(Document(made(ask("sanitize", pdf=h, layers=False))))["layers"] == 1
    assert ask("list-link-hotspots", pdf=h)["result"]["links"][0]["kind"] == "uri" and ask("form-fields", pdf=h)["result"]["fields"][0]["name"] == "who"
    for bad in (ask("nope"), ask("info"), ask("info", pdf=b64(b"x")), ask("rotate", pdf=pdf, degrees=5), service.handle("{"), service.handle("[]"), service.handle('{"payload": {}}')):
        assert not bad["ok"] and bad["result"]["error"]


def test_every_action_answers():
    h = b64(hidden())
    more = {"x": 1, "y": 1, "width": 500, "height": 700, "dx": 1, "dy": 1, "text": "t", "points": [[1, 1], [2, 2]], "regions": [], "degrees": 90, "order": [1], "pdfs": [h], "files": [{"pdf": h}], "values": {"who": "x"}, "name": "n", "script": "s()", "other": h, "userPassword": "u", "phrase": "visible", "find": "visible", "replace": "shown"}
    for action in service.ACTIONS:
        answer = ask(action, pdf=h, **more)
        assert answer["ok"], (action, answer)
        json.dumps(answer)


def test_served(spark):
    df = spark.createDataFrame([(json.dumps({"id": "a", "action": "ping"}),), ("junk",), (None,)], "body string")
    assert sorted((r.id, r.ok) for r in service.served(df).collect()) == [("", False), ("", False), ("a", True)]
