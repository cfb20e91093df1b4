"""The PDF source: reading, repair, filters, text, scans, edits, findings, robustness."""

import random
import zlib

import numpy as np
import pytest
from pdf_samples import hidden, positioned, simple

from leafloom.sources.pdf import crypt, edit, filters, runs, scan, tables, validate, writer
from leafloom.sources.pdf.compose import as_files, composed
from leafloom.sources.pdf.content import Interpreter, glyph_text, operations, page_text, parse_afm, parse_cmap
from leafloom.sources.pdf.document import Document
from leafloom.sources.pdf.errors import PdfError
from leafloom.sources.pdf.lexer import Keyword, Lexer, Name, Ref, Stream, text_of
from leafloom.sources.pdf.writer import Builder


def texts(data):
    doc = Document(data)
    return [page_text(Interpreter(doc).page(p).glyphs) for p in doc.pages()]


# -- syntax


@pytest.mark.parametrize("raw,want", [(b"12", 12), (b"-.5", -0.5), (b"(a\\(b\\)\\101\\n(x))", b"a(b)A\n(x)"), (b"<48 656>", b"He`"), (b"/A#20B", Name("A B")), (b"[1 [2] 3 0 R]", [1, [2], Ref(3, 0)]), (b"<</A 1/B null>>", {"A": 1, "B": None}), (b"true", True), (b"% note\n7", 7), (b"Tj", Keyword("Tj")), (b"", Keyword(""))])
def test_objects(raw, want):
    got = Lexer(raw).object()
    assert got == want and type(got) is type(want)


@pytest.mark.parametrize("raw", [b"(open", b"<4x>", b"<12", b"[1 2", b"<</A 1", b"[" * 300])
def test_malformed_objects(raw):
    with pytest.raises(PdfError):
        Lexer(raw).object()


def test_numbers_and_strings_are_written_back():
    for x in (0, -1, 1.5, -0.0000001, 1e-7, 123456.789, b"a(b)\\", b"\xff\0", Name("A B#"), [1, None, True, Ref(2, 0)], {"K": [b"x"]}):
        back = Lexer(writer.serialized(x)).object()
        assert back == x or isinstance(x, float) and abs(back - x) < 1e-6
    assert writer.number(-0.0) == "0" and writer.number(1e-9) == "0" and writer.number(2.5) == "2.5"
    assert text_of(b"\xfe\xff\x00a\x20\xac") == "a€"


# -- filters


def lzw_coded(data):
    table, width, code, out, bits = {bytes([i]): i for i in range(256)}, 9, 258, 256, 9
    now = b""
    for c in data:
        if now + bytes([c]) in table:
            now += bytes([c])
            continue
        out, bits = out << width | table[now], bits + width
        table[now + bytes([c])] = code
        code += 1
        width = min(12, max(9, (code + 1).bit_length()))
        now = bytes([c])
    for c, w in ((table.get(now), width), (257, min(12, max(9, (code + 2).bit_length())))):
        if c is not None:
            out, bits = out << w | c, bits + w
    return (out << -bits % 8).to_bytes((bits + 7) // 8, "big")


def test_filters_decode():
    data = bytes(random.Random(1).choices(b"abcab", k=600))
    assert filters.decode(zlib.compress(data), ["FlateDecode"], [])[0] == data
    assert filters.decode(data.hex().encode() + b">", ["AHx"], [])[0] == data
    import base64

    assert filters.decode(base64.a85encode(data + b"\0\0\0\0x") + b"~>", ["A85"], [])[0] == data + b"\0\0\0\0x"
    assert filters.decode(b"\x02abc\xfed\x80zz", ["RL"], [])[0] == b"abcddd"
    assert filters.lzw(lzw_coded(data)) == data
    assert filters.decode(zlib.compress(data).hex().encode() + b">", ["AHx", "Fl"], [])[0] == data
    rows = [b"\x00\x01\x02\x03", b"\x02\x01\x01\x01", b"\x01\x05\x01\x01", b"\x03\x02\x02\x02", b"\x04\x01\x01\x01"]
    want = [[1, 2, 3], [2, 3, 4], [5, 6, 7], [4, 7, 9], [5, 8, 10]]
    assert filters.unpredicted(b"".join(rows), {"Predictor": 15, "Columns": 3}) == bytes(x for r in want for x in r)
    assert filters.unpredicted(b"\x01\x01\x01\x02\x01\x01", {"Predictor": 2, "Columns": 3}) == b"\x01\x02\x03\x02\x03\x04"
    assert filters.decode(b"raw", ["DCT"], []) == (b"raw", "DCTDecode")


@pytest.mark.parametrize("data,names", [(zlib.compress(b"x" * 99)[:-6], ["Fl"]), (b"junk", ["Fl"]), (b"4g>", ["AHx"]), (b"!!~>"[:1] + b"~>", ["A85"]), (b"zz\x7f", ["A85"]), (b"\x05ab", ["RL"]), (b"x", ["Nope"]), (b"x", ["Crypt"] * 9)])
def test_filters_are_strict(data, names):
    with pytest.raises(PdfError):
        filters.decode(data, names, [])


# -- reading and repair


def test_reads_pages_boxes_and_rotation():
    data = positioned([[("a", 1, 1, 9)], [("b", 1, 1, 9)]], {2: {"Rotate": -90, "CropBox": [10, 10, 900, 400]}})
    doc = Document(data)
    one, two = doc.pages()
    assert (one.box, one.rotation) == ([0, 0, 595, 842], 0) and (two.box, two.rotation) == ([10, 10, 595, 400], 270)
    assert not doc.rebuilt and validate.findings(data) == []


@pytest.mark.parametrize("damage", [lambda d: d.replace(b"startxref\n", b"startxref\n9"), lambda d: d[: d.rindex(b"xref\n0")], lambda d: b"junk\n" + d, lambda d: d.replace(b"0000000000 65535 f ", b"0000000000 x5535 f "), lambda d: d.replace(b"/Length ", b"/Length 9", 1)])
def test_repairs(damage):
    data = damage(simple(2))
    if b"trailer" not in data:
        data += b"trailer\n<</Root 6 0 R>>" if b"6 0 obj\n<</Type /Catalog" in data else b""
    assert texts(data) == texts(simple(2))


def test_object_streams_and_xref_streams():
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 9 9]>>"]
    head, offset = b"", 0
    for i, x in enumerate(inner, 1):
        head += b"%d %d " % (i, offset)
        offset += len(x) + 1
    packed = zlib.compress(head + b" ".join(inner))
    out = bytearray(b"%PDF-1.5\n")
    at4 = len(out)
    out += b"4 0 obj\n<</Type/ObjStm/N 3/First %d/Filter/FlateDecode/Length %d>>stream\n" % (len(head), len(packed)) + packed + b"\nendstream\nendobj\n"
    at5 = len(out)
    rows = b"".join(bytes([k]) + a.to_bytes(4, "big") + bytes([b]) for k, a, b in [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0)])
    out += b"5 0 obj\n<</Type/XRef/Size 6/W[1 4 1]/Root 1 0 R/Length %d>>stream\n" % len(rows) + rows + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at5
    doc = Document(bytes(out))
    assert len(doc.pages()) == 1 and not doc.rebuilt
    assert len(Document(bytes(out).replace(b"startxref", b"startxxxx")).pages()) == 1


@pytest.mark.parametrize("data", [b"", b"hello", b"%PDF-1.7\n%%EOF", b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\ntrailer\n<</Size 1>>"])
def test_not_a_pdf(data):
    with pytest.raises(PdfError):
        Document(data)
    assert any(f[1] == "Error" for f in validate.findings(data))


def test_cycles_end():
    data = simple(1).replace(b"/Kids [", b"/Kids [1 0 R ")
    assert len(Document(data).pages()) == 1


# -- encryption


def encrypted(data, password=b"pw", aes=False):
    """The sample with its strings and streams encrypted by the 128-bit scheme."""
    doc = Document(data)
    file_id = b"0123456789abcdef"
    d = {"Filter": Name("Standard"), "V": 4 if aes else 2, "R": 4 if aes else 3, "Length": 128, "P": -4}
    if aes:
        d |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    import hashlib

    k = hashlib.md5((password + crypt.PAD)[:32]).digest()
    for _ in range(50):
        k = hashlib.md5(k).digest()
    owner = (password + crypt.PAD)[:32]
    for i in range(20):
        owner = crypt.rc4(bytes(b ^ i for b in k), owner)
    k = hashlib.md5((password + crypt.PAD)[:32] + owner + (-4 & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
    for _ in range(50):
        k = hashlib.md5(k).digest()
    user = hashlib.md5(crypt.PAD + file_id).digest()
    for i in range(20):
        user = crypt.rc4(bytes(b ^ i for b in k), user)
    d |= {"O": owner, "U": user + bytes(16)}
    out, offsets = bytearray(b"%PDF-1.6\n"), []
    for num in range(1, max(doc.entries) + 1):
        x = doc.get(num)
        own = hashlib.md5(k + num.to_bytes(3, "little") + b"\0\0" + b"sAlT" * aes).digest()
        offsets.append(len(out))
        out += b"%d 0 obj\n" % num
        if isinstance(x, Stream):
            pad = x.raw + bytes([16 - len(x.raw) % 16]) * (16 - len(x.raw) % 16)
            raw = b"v" * 16 + crypt.cbc_encrypt(own, pad, b"v" * 16) if aes else crypt.rc4(own, x.raw)
            out += writer.serialized(x.dict | {"Length": len(raw)}) + b"\nstream\n" + raw + b"\nendstream"
        else:
            out += writer.serialized(x)
        out += b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(offsets) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n" + writer.serialized({"Size": len(offsets) + 1, "Root": doc.trailer["Root"], "Encrypt": d, "ID": [file_id, file_id]}) + b"\nstartxref\n%d\n%%%%EOF" % at)


@pytest.mark.parametrize("aes", [False, True])
def test_decryption(aes):
    data = encrypted(simple(1), aes=aes)
    doc = Document(data, "pw")
    assert doc.security and page_text(Interpreter(doc).page(doc.pages()[0]).glyphs) == texts(simple(1))[0]
    with pytest.raises(PdfError):
        Document(data, "wrong")
    with pytest.raises(PdfError):
        Document(data)


def test_aes_vectors():
    key, plain = bytes.fromhex("000102030405060708090a0b0c0d0e0f"), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.Aes(key).encrypt(plain).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a" and crypt.Aes(key).decrypt(crypt.Aes(key).encrypt(plain)) == plain
    assert crypt.Aes(bytes(range(32))).encrypt(plain).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


# -- text


def test_reading_order_and_words():
    data = positioned([[("low", 72, 100, 12), ("right", 200, 700, 12), ("left", 72, 700, 12)]])
    assert texts(data) == ["left right\nlow"]


@pytest.mark.parametrize("body,want", [(b"BT /F1 10 Tf 72 700 Td [(ab) -50 (cd) -2000 (e)] TJ ET", "abcd e"), (b"BT /F1 10 Tf 12 TL 72 700 Td (a) Tj (b) ' 1 2 (c) \" ET", "a\nb\nc"), (b"q 2 0 0 2 0 0 cm BT /F1 10 Tf 36 350 Td (x) Tj ET Q BT /F1 10 Tf 72 10 Td (y) Tj ET", "x\ny"), (b"BT /F1 10 Tf 1 0 0 1 72 700 Tm (a) Tj T* (b) Tj ET", "ab"), (b"BT /Nope 10 Tf (a) Tj ET", ""), (b"Q Q ET (x) Tj", "")])
def test_text_operators(body, want):
    data = positioned([[]], {1: lambda out: {"Contents": out.stream(body)}})
    assert texts(data) == [want]


def test_forms_images_and_inline_images():
    def extra(out):
        form = out.stream(b"BT /F1 10 Tf 10 10 Td (inner) Tj ET /Self Do", Type=Name("XObject"), Subtype=Name("Form"), BBox=[0, 0, 99, 99], Matrix=[1, 0, 0, 1, 100, 500])
        image = out.stream(b"\0" * 4, Type=Name("XObject"), Subtype=Name("Image"), Width=2, Height=2, BitsPerComponent=8, ColorSpace=Name("DeviceGray"))
        return {"Contents": out.stream(b"/Fm Do q 50 0 0 40 10 20 cm /Im Do Q q 5 0 0 5 0 0 cm BI /W 2 /H 1 /BPC 8 /CS /G ID EI EI Q"), "Resources": {"XObject": {"Fm": form, "Im": image, "Self": form}}}

    doc = Document(positioned([[]], {1: extra}))
    drawn = Interpreter(doc).page(doc.pages()[0])
    assert "".join(g.text for g in drawn.glyphs) == "inner" and (drawn.glyphs[0].x, round(drawn.glyphs[0].y)) == (110, 508)
    assert [(m["name"], m["x"], m["y"], m["width"], m["height"], m["pixels_wide"]) for m in drawn.images] == [("Im", 10, 20, 50, 40, 2), (None, 0, 0, 5, 5, 2)]


def test_encodings_and_maps():
    assert [glyph_text(n) for n in ("A", "eacute", "Ntilde", "uni20AC", "five", "space", "u1F600", "a.alt", "nonsense")] == ["A", "é", "Ñ", "€", "5", " ", "😀", "a", None]
    spaces, chars = parse_cmap(b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <02> <04> <0061> <05> <06> [<0031> <00320033>] endbfrange")
    assert spaces == [(1, 0, 255)] and chars == {1: "A", 2: "a", 3: "b", 4: "c", 5: "1", 6: "23"}
    assert parse_afm("C 65 ; WX 722 ; N A ; B 1 2 3 4 ;\nC -1 ; WX 500 ; N Euro ;") == {"A": 722.0, "Euro": 500.0}

    def extra(out):
        font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("ABCDEF+X"), "FirstChar": 65, "Widths": [1000, 250], "Encoding": {"Differences": [66, Name("eacute")]}}
        wide = {"Type": Name("Font"), "Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [{"DW": 500, "W": [1, [250], 2, 3, 750]}], "ToUnicode": out.stream(b"1 beginbfchar <0001> <65E5> endbfchar")}
        return {"Contents": out.stream(b"BT /F2 10 Tf 0 100 Td (AB) Tj /F3 10 Tf 0 -50 Td <00010002> Tj ET"), "Resources": {"Font": {"F2": font, "F3": wide}}}

    doc = Document(positioned([[]], {1: extra}))
    g = Interpreter(doc).page(doc.pages()[0]).glyphs
    assert [x.text for x in g] == ["A", "é", "日", ""] and [round(x.advance, 3) for x in g] == [10, 2.5, 2.5, 7.5]


def test_operations_never_raise():
    rng = random.Random(7)
    for _ in range(300):
        list(operations(bytes(rng.choices(b"()<>[]{}/% 0123BTETqQTjBI\nID EI\\ab", k=rng.randrange(60)))))


# -- scans


def test_hidden_data_and_scripts():
    doc = Document(hidden())
    assert scan.hidden(doc) == {"metadata": 3, "attachments": 2, "scripts_and_actions": 3, "annotations": 2, "bookmarks": 1, "layers": 1}
    assert scan.safety(doc) == {"js_count": 2, "url_count": 1, "samples": ["JS: app.alert('hi')", "https://example.org/", "JS: x()"]}
    assert [(s["origin"], s["name"], s["source"]) for s in scan.scripts(doc)] == [("tree", "start", "app.alert('hi')"), ("annotation", "", "x()")]
    assert [(x["kind"], x["url"]) for x in scan.links(doc)] == [("uri", "https://example.org/")] and len(scan.uris(doc)) == 1
    assert [(f["name"], f["type"], f["value"], f["read_only"]) for f in scan.fields(doc)] == [("who", "text", "me", True)]
    assert not any(scan.hidden(Document(simple())).values())
    assert edit.custom_info(doc) == ["Custom"]


# -- edits


def test_arrange_rotate_merge():
    doc = Document(simple(3))
    assert [t.split("\n")[0] for t in texts(edit.arrange(doc, [3, 1, 3]))] == ["page 3 alpha beta", "page 1 alpha beta", "page 3 alpha beta"]
    turned = Document(edit.rotate(doc, 450, [2])).pages()
    assert [p.rotation for p in turned] == [0, 90, 0]
    both = edit.merge([doc, Document(simple(2, "other"))])
    assert len(texts(both)) == 5 and validate.findings(both) == []
    assert edit.merge([doc]) is doc.data
    for bad in (lambda: edit.arrange(doc, []), lambda: edit.arrange(doc, [4]), lambda: edit.rotate(doc, 30), lambda: edit.rotate(doc, 90, [9])):
        with pytest.raises(PdfError):
            bad()


def test_bookmarks_follow_their_pages():
    doc = Document(hidden())
    kept = Document(edit.merge([Document(simple(2)), doc]))
    (mark,) = writer.bookmarks(kept)
    assert mark["title"] == "Start" and mark["page"] == kept.pages()[2].ref
    assert writer.bookmarks(Document(edit.merge([Document(simple(1)), Document(edit.sanitize(doc))]))) == []


def test_labels_and_added_text():
    data, made = edit.labels(Document(simple(3)), "DOC", "-X", 100, 4, [1, 3, 9])
    assert made == ["DOC0100-X", "DOC0101-X"] and ["DOC0100-X" in texts(data)[0], "DOC" in texts(data)[1], "DOC0101-X" in texts(data)[2]] == [True, False, True]
    for out in (edit.watermark(Document(simple(1)), "DRAFT"), edit.draw_boxes(Document(simple(1)), [(1, (1, 1, 5, 5))]), edit.ink(Document(simple(1)), 1, [(5, 5)])):
        assert "alpha" in texts(out)[0] and validate.findings(out) == []


def test_redaction_removes_text_and_keeps_places():
    data = positioned([[("keep SECRET tail", 72, 700, 10), ("other", 72, 600, 10)]], {1: {"Annots": [{"Subtype": Name("Link"), "Rect": [100, 690, 150, 710]}, {"Subtype": Name("Link"), "Rect": [300, 10, 310, 20]}]}})
    out, report = edit.redact(Document(data), [(1, (102, 697, 35.9, 10))])
    doc = Document(out)
    drawn = Interpreter(doc).page(doc.pages()[0])
    assert page_text(drawn.glyphs).split() == ["keep", "tail", "other"] and report[0]["text"] == "SECRET" and report[0]["annotations"] == 1
    before = {g.text + str(round(g.y)): g.x for g in Interpreter(Document(data)).page(Document(data).pages()[0]).glyphs if g.text in "lo"}
    after = {g.text + str(round(g.y)): g.x for g in drawn.glyphs if g.text in "lo"}
    assert all(abs(before[k] - v) < 0.01 for k, v in after.items())
    assert b"SECRET" not in b"".join(doc.decoded(s) for _, s in scan.streams(doc)) and validate.findings(out) == []
    with pytest.raises(PdfError):
        edit.redact(Document(data), [(2, (0, 0, 1, 1))])


def test_redaction_drops_touched_images():
    def extra(out):
        image = out.stream(b"\0" * 4, Type=Name("XObject"), Subtype=Name("Image"), Width=2, Height=2, BitsPerComponent=8, ColorSpace=Name("DeviceGray"))
        return {"Contents": out.stream(b"q 50 0 0 40 10 20 cm /Im Do Q q 50 0 0 40 300 20 cm /Im2 Do Q"), "Resources": {"XObject": {"Im": image, "Im2": image}}}

    out, report = edit.redact(Document(positioned([[]], {1: extra})), [(1, (0, 0, 30, 30))])
    doc = Document(out)
    assert report[0]["images"] == 1 and [m["name"] for m in Interpreter(doc).page(doc.pages()[0]).images] == ["Im2"]


def nested_forms(out):
    """A form drawn twice, with text, an image and an inner form; a second form with text."""
    image = out.stream(b"\0" * 4, Type=Name("XObject"), Subtype=Name("Image"), Width=2, Height=2, BitsPerComponent=8, ColorSpace=Name("DeviceGray"))
    font = out.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding")})
    form = lambda body, **res: out.stream(body, Type=Name("XObject"), Subtype=Name("Form"), BBox=[0, 0, 300, 100], Resources={"Font": {"F": font}, **res})
    inner = form(b"BT /F 10 Tf 0 5 Td (deep HIDDEN end) Tj ET")
    outer = form(b"BT /F 10 Tf 0 50 Td (keep SECRET tail) Tj ET q 20 0 0 20 200 40 cm /Im Do Q q 1 0 0 1 0 0 cm /In Do Q", XObject={"Im": image, "In": inner})
    other = form(b"BT /F 10 Tf 0 5 Td (KEEP ME) Tj ET")
    return {"Contents": out.stream(b"q 1 0 0 1 100 600 cm /Fm Do Q q 1 0 0 1 100 300 cm /Fm Do Q q 1 0 0 1 100 100 cm /Fo Do Q"), "Resources": {"XObject": {"Fm": outer, "Fo": other}}}


def test_redaction_within_forms():
    data = positioned([[]], {1: nested_forms})
    words = lambda d: [page_text([g for g in Interpreter(d).page(d.pages()[0]).glyphs if lo < g.y < lo + 100]).split() for lo in (590, 290, 90)]
    assert words(Document(data)) == [["keep", "SECRET", "tail", "deep", "HIDDEN", "end"]] * 2 + [["KEEP", "ME"]]
    # text and an image of one drawing of the form, and text of the form in it
    out, report = edit.redact(Document(data), [(1, (130.5, 645, 35, 20)), (1, (305, 645, 5, 5)), (1, (131, 602, 34, 8))])
    doc = Document(out)
    assert words(doc) == [["keep", "tail", "deep", "end"], ["keep", "SECRET", "tail", "deep", "HIDDEN", "end"], ["KEEP", "ME"]]
    assert len(Interpreter(doc).page(doc.pages()[0]).images) == 1 and validate.findings(out) == []
    (row,) = report
    assert (row["glyphs"], row["images"], row["forms"], sorted(row["text"])) == (12, 1, 2, sorted("SECRETHIDDEN"))
    assert [(r["glyphs"], r["images"], r["text"]) for r in row["by_region"]] == [(6, 0, "SECRET"), (0, 1, ""), (6, 0, "HIDDEN")]
    # with both drawings redacted nothing of it stays in the file
    both, _ = edit.redact(Document(data), [(1, (130.5, y, 35, 20)) for y in (645, 345)])
    assert not any(b"SECRET" in Document(both).decoded(s) for _, s in scan.streams(Document(both)))


def test_strip_and_sanitize():
    doc = Document(hidden())
    stripped = scan.safety(Document(edit.strip_active(doc)))
    assert (stripped["js_count"], stripped["url_count"]) == (0, 0)
    only_js = scan.safety(Document(edit.strip_active(doc, urls=False)))
    assert only_js["url_count"] == 1 and only_js["js_count"] == 1  # what is chained to a kept action stays
    assert not any(scan.hidden(Document(edit.sanitize(doc))).values())


def test_fill_and_flatten():
    doc = Document(hidden())
    filled = Document(edit.fill(doc, {"who": "Zoë", "nobody": "x"}))
    assert scan.fields(filled)[0]["value"] == "Zoë" and filled.data.startswith(doc.data)
    assert edit.fill(doc, {"nobody": "x"}) is doc.data

    def extra(out):
        look = out.stream(b"BT /F1 10 Tf 2 2 Td (drawn) Tj ET", Type=Name("XObject"), Subtype=Name("Form"), BBox=[0, 0, 40, 10])
        return {"Annots": [{"Subtype": Name("Widget"), "Rect": [100, 100, 140, 110], "AP": {"N": look}}, {"Subtype": Name("Link"), "Rect": [0, 0, 1, 1]}, {"Subtype": Name("Stamp"), "Rect": [100, 200, 140, 210], "AP": {"N": look}}]}

    flat, fields, others = edit.flatten(Document(positioned([[("base", 72, 700, 10)]], {1: extra})))
    assert (fields, others) == (1, 1) and texts(flat)[0] == "base\ndrawn\ndrawn" and len(Document(flat).pages()[0].annotations) == 1


# -- findings


@pytest.mark.parametrize("change,codes", [(lambda d: b"junk before " + d, {"PDF001", "PDF003", "PDF005"}), (lambda d: d.replace(b"%%EOF", b""), {"PDF002"}), (lambda d: d.replace(b"startxref\n", b"startxref\n99999"), {"PDF003", "PDF005"}), (lambda d: d.replace(b"/Count 1", b"/Count 7"), {"PDF012"}), (lambda d: d.replace(b"[0 0 595 842]", b"[0 0 000 842]"), {"PDF021"}), (lambda d: d.replace(b"/Type /Page\n", b"/Type /Pagx\n"), {"PDF022"}), (lambda d: d.replace(b"/FlateDecode", b"/FlateDecodX"), {"PDF032"})])
def test_findings(change, codes):
    found = {f[0] for f in validate.findings(change(simple(1)))}
    assert codes <= found or found == codes


def test_field_findings():
    assert {f[0] for f in validate.findings(hidden())} == {"PDF040", "PDF041"}


def test_damaged_files_never_raise_anything_else():
    rng = random.Random(0x5EED54)
    for seed in (simple(2), hidden()):
        for _ in range(40):
            data = bytearray(seed)
            for _ in range(rng.randrange(1, 12)):
                i = rng.randrange(len(data))
                if rng.random() < 0.3:
                    del data[i : i + rng.randrange(40)]
                else:
                    data[i % len(data)] = rng.randrange(256)
            validate.findings(bytes(data))
            try:
                doc = Document(bytes(data))
                scan.hidden(doc)
                texts(bytes(data))
            except PdfError as e:
                assert str(e)


# -- tables


def test_tables(spark, tmp_path):
    for name, data in (("a", simple(2)), ("b", hidden()), ("c", b"%PDF-1.7 broken")):
        (tmp_path / f"{name}.pdf").write_bytes(data)
    df = tables.read(spark, str(tmp_path))
    last = lambda rows: sorted((r[0].rsplit("/", 1)[1], *r[1:]) for r in rows)
    assert [(n, p) for n, p in last(tables.files(df).select("path", "pages").na.fill(-1).collect())] == [("a.pdf", 2), ("b.pdf", 1), ("c.pdf", -1)]
    assert last(tables.pages(df).select("path", "page", "rotation").collect()) == [("a.pdf", 1, 0), ("a.pdf", 2, 0), ("b.pdf", 1, 0)]
    assert tables.text_runs(df).count() == 5 and tables.glyphs(df).count() > 30 and tables.images(df).count() == 0
    assert tables.content_operations(df).filter("operator = 'Tj'").count() == 5
    assert last(tables.links(df).select("path", "kind", "url").collect()) == [("b.pdf", "uri", "https://example.org/")]
    assert tables.scripts(df).count() == 2 and tables.form_fields(df).first().name == "who" and tables.annotations(df).count() == 3
    assert tables.outlines(df).first().place == [1] and tables.signatures(df).count() == 0 and tables.uris(df).count() == 1
    assert {r.has_any for r in tables.hidden_data(df).filter("path like '%a.pdf'").collect()} == {False} and tables.safety(df).count() == 2
    assert {r.code for r in tables.findings(df).filter("path like '%c.pdf'").collect()} >= {"PDF010"}
    out = tables.edited(df, lambda doc: edit.rotate(doc, 90)).collect()
    assert {r.path[-5:]: r.error is None for r in out} == {"a.pdf": True, "b.pdf": True, "c.pdf": False}
    assert Document(bytes(next(r.content for r in out if r.path.endswith("a.pdf")))).pages()[0].rotation == 90


# -- plain pages


def _page_of(body, base="Courier", **font):
    out = Builder()
    tree, own = out.add(None), out.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(base), "Encoding": Name("WinAnsiEncoding"), **font})
    page = out.add({"Type": Name("Page"), "Parent": tree, "Contents": out.stream(body), "Resources": {"Font": {"F1": own}}})
    out.objects[tree.num - 1] = {"Type": Name("Pages"), "Kids": [page], "Count": 1, "MediaBox": [0, 0, 612, 792]}
    doc = Document(out.save(out.add({"Type": Name("Catalog"), "Pages": tree})))
    return Interpreter(doc), doc.pages()[0]


def _by_glyphs(interpreter, page):
    rows = []
    for i, run in enumerate(interpreter.page(page).runs):
        x, y = min(g.x for g in run), min(g.y for g in run)
        w, h, text = max(g.x + g.width for g in run) - x, max(g.y + g.height for g in run) - y, "".join(g.text for g in run)
        if text.strip() and w > 0 and h > 0:
            rows.append((i, text, x, y, w, h, run[0].font, run[0].size, run[0].mode))
    return rows, page_text(interpreter.page(page).glyphs)


def _columns(interpreter, page):
    return list(zip(*(c.to_pylist() for c in runs.columns_of(interpreter, page)), strict=True))


_PLACED = b"1 0 0 1 %d %s Tm\n%s Tj\n"
_WORDS = [b"(one)", b"(two\\(\\\\)", b"<e4f6>", b"( )", b"()", b"(a b )", b"< >", b"(x)", b"(%)"]


@pytest.mark.parametrize(
    "body,plain",
    [
        (b"BT\n/F1 10 Tf\n" + b"".join(_PLACED % (72 + 60 * (k % 5), str(700.5 - 12 * (k // 5)).encode(), w) for k, w in enumerate([x for x in _WORDS if x != b"< >"] * 4)) + b"ET\n", True),
        (b"BT\n/F1 7.3 Tf\n" + b"1.7 0 0 2.1 30.25 +400.125 Tm\n(scaled) Tj\n" * 3 + b"/F1 9 Tf\n2 0 0 -2 300 400 Tm\n(down) Tj\nET\n", True),
        (b"BT\n/F1 10 Tf\n" + _PLACED % (100, b"700", b"(right)") + _PLACED % (72, b"700", b"(left)") + _PLACED % (72, b"712", b"(above)") + b"ET\n", True),
        (b"BT\n/F1 10 Tf\n" + _PLACED % (72, b"700", b"(over)") + _PLACED % (80, b"700", b"(lap)") + b"ET\n", True),
        (b"BT\n/F1 10 Tf\n0 1 -1 0 72 700 Tm\n(turned) Tj\nET\n", False),
        (b"BT\n/F1 10 Tf\n2 Tc\n" + _PLACED % (72, b"700", b"(spaced)") + b"ET\n", False),
        (b"BT\n/F1 10 Tf\n" + _PLACED % (72, b"700", b"< 41>") + b"ET\n", False),
        (b"BT\n/F1 10 Tf\n" + _PLACED % (72, b"700", b"<410a42>") + b"ET\n", False),
        (b"BT\n/F1 10 Tf\n" + _PLACED % (72, b"700", b"(cut)") + b"1 0 0 1 72", False),
        (b"".join(b"BT\n/F1 10 Tf\n" + _PLACED % (72, b"%d" % (700 - k), b"(short)") + b"ET\n" for k in range(40)), False),
        (b"", True),
    ],
)
def test_plain_pages_equal_the_interpreter(body, plain):
    interpreter, page = _page_of(body)
    assert (runs.plain_runs(interpreter, page) is not None) == plain
    rows, text = _by_glyphs(interpreter, page)
    assert _columns(interpreter, page) == [tuple(np.float32(v) if isinstance(v, float) else v for v in r) for r in rows]
    assert runs.text_of(interpreter, page) == text


def test_fonts_of_other_widths_are_left_to_the_interpreter():
    body = b"BT\n/F1 10 Tf\n" + _PLACED % (72, b"700", b"(wide)") + b"ET\n"
    for font in ({"FirstChar": 100, "Widths": [300, 900]}, {"Encoding": {"Differences": [119, Name("f_f")]}}):
        interpreter, page = _page_of(body, **font)
        rows, text = _by_glyphs(interpreter, page)
        assert _columns(interpreter, page) == [tuple(np.float32(v) if isinstance(v, float) else v for v in r) for r in rows] and runs.text_of(interpreter, page) == text


def test_composed_pages_need_no_glyphs(spark, monkeypatch):
    long = "\n".join(" ".join(f"wört{k}(" for k in range(row % 7)) for row in range(120))
    rows = [(1, long), (2, ""), (3, "a  b\\ \x81 \t€")]
    glyphs = {str(i): [_by_glyphs(Interpreter(doc), p) for p in doc.pages()] for i, t in rows for doc in [Document(composed(t))]}
    monkeypatch.setattr(Interpreter, "_show", lambda *a: pytest.fail("a glyph at a time"))
    for i, t in rows[:2]:
        doc = Document(composed(t))
        assert [runs.text_of(Interpreter(doc), p) for p in doc.pages()] == [text for _, text in glyphs[str(i)]]
    monkeypatch.undo()
    files = as_files(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.path, r.page, r.text) for r in tables.pages(files).collect()) == [(i, k + 1, text) for i, own in glyphs.items() for k, (_, text) in enumerate(own)]
    got = sorted((r.path, r.page, r.seq, r.text, r.x) for r in tables.text_runs(files).collect())
    assert got == [(i, k + 1, *run[:3]) for i, own in glyphs.items() for k, (found, _) in enumerate(own) for run in found]
