"""Literal cases of the operators: boundaries, ties, orders that generated tables do not reach."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafloom.functions import geometry, text, urls
from leafloom.functions import records as R
from leafloom.operators import diff, layout, links, pages, safety, search, spatial, validate
from leafloom.operators import records as O
from leafloom.operators.formscripts import run_script
from leafloom.streaming import messages


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


# -- search


@pytest.mark.parametrize("phrase,mode,case,want", [("cat", "contains", False, 4), ("cat", "contains", True, 2), ("cat", "starts", False, 3), ("cat", "suffix", False, 3), ("cat", "whole-word", False, 2), ("dog", "contains", False, 0), ("", "contains", False, 0), ("a.b", "contains", False, 1), ("été", "contains", False, 2)])
def test_search_modes(spark, phrase, mode, case, want):
    df = spark.createDataFrame([(1, "cat Cat CATS bobcat a.b axb été ÉTÉ")], "doc_id long, text string")
    got = search.find(df, phrase, mode, case).first()
    assert (got.n_matches if got else 0) == want


def test_match_offsets_and_mode_names(spark):
    df = spark.createDataFrame([(1, "aa aaa\nxaay"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.line_no, r.match_no, r.start, r.end) for r in search.match_offsets(df, "aa").orderBy("line_no", "match_no").collect()]
    assert got == [(0, 0, 0, 2), (0, 1, 3, 5), (1, 0, 1, 3)]
    assert [text.match_mode(m) for m in ("Starts_With", "prefix", "ENDS", "exact", "?", None)] == ["starts", "starts", "ends", "whole", "contains", "contains"]


def test_replace_counts_and_wrap(spark):
    df = spark.createDataFrame([(1, "the The the")], "doc_id long, text string")
    r = search.replace_all(df, "the", "a").first()
    assert (r.n_replaced, r.text) == (2, "a The a")
    assert search.replace_all(df, "", "a").first().n_replaced == 0
    w = search.wrapped(spark.createDataFrame([(1, "one two three\r\nabcdefghij k"), (2, None)], "doc_id long, text string"), 7).orderBy("doc_id").collect()
    assert w[0].lines == ["one two", "three", "abcdefg", "hij k"] and w[1].lines is None


# -- layout and regions


def test_layout_of_long_lines_and_blanks(spark):
    line = " ".join(f"w{i}" for i in range(500))
    df = spark.createDataFrame([(1, f"{line}\n\n  a  b "), (2, None), (3, "")], "doc_id long, text string")
    tok = layout.tokens(df).collect()
    assert [(t.text, t.char_off) for t in tok if t.line_no == 2] == [("a", 2), ("b", 5)]
    assert all(line[t.char_off : t.char_off + len(t.text)] == t.text for t in tok if t.line_no == 0) and sum(t.line_no == 0 for t in tok) == 500
    assert {(p.doc_id, p.page) for p in layout.pages(df).collect()} == {(1, 1), (3, 1)}


def test_page_text_within_the_row_equals_that_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(layout, "BATCH_BYTES", 64)
    texts = ["\n".join(f"l{k}  é{k} 𝄞" for k in range(120)), "", None, "  \n \n", "a", "x " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.page): (r.page_text, r.n_tokens) for r in layout.page_texts(layout.marks(df)).collect()}
    assert got == {(r.doc_id, r.page): (r.page_text, r.n_tokens) for r in layout.reading_text(layout.tokens(df)).collect()}
    assert {k: v[1] for k, v in got.items()} == {(0, 1): 150, (0, 2): 150, (0, 3): 60, (4, 1): 1, (5, 1): 400}
    assert {(r.doc_id, r.page) for r in layout.marks(df).collect()} == {(r.doc_id, r.page) for r in layout.pages(df).collect()}


def test_bands_keep_each_pair_once(spark):
    rng = random.Random(5)
    box = lambda: (rng.uniform(-50, 600), rng.uniform(-200, 2600), rng.choice((0.0, 5.0, 90.0, 900.0)), rng.choice((0.0, 10.0, 36.0, 300.0, 1e9)))
    regions, marks = [box() for _ in range(60)], [box() for _ in range(60)]
    df = spark.createDataFrame([(1, 1, k, *r) for k, r in enumerate(regions)], "doc_id long, page int, region_no int, x double, y double, width double, height double")
    tok = spark.createDataFrame([(1, 1, str(k), *t) for k, t in enumerate(marks)] + [(1, 2, "other", *regions[0]), (1, 1, "none", 1.0, None, 1.0, 1.0)], "doc_id long, page int, text string, x double, y double, width double, height double")
    meet = lambda a, b: a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]
    want = sorted((i, str(j)) for i, r in enumerate(regions) for j, t in enumerate(marks) if meet(r, t))
    assert sorted((r.region_no, r.text) for r in spatial.overlaps(df, tok).collect()) == want
    counts = {r.region_no: r.text_runs for r in spatial.audit_regions(df, tok).collect()}
    assert counts == {i: sum(w[0] == i for w in want) for i in range(60)}


def test_edges_do_not_overlap(spark):
    tok = spark.createDataFrame([(1, 1, 0, 0, 0, "a", 10.0, 10.0, 10.0, 10.0)], "doc_id long, page int, line_no int, tok_no int, char_off int, text string, x double, y double, width double, height double")
    regions = [(0.0, 0.0, 10.0, 30.0), (0.0, 1.0, 10.1, 30.0), (15.0, 15.0, 1.0, 1.0), (20.0, 10.0, 5.0, 5.0), (0.0, 20.0, 30.0, 5.0)]
    df = spatial.numbered(spark.createDataFrame([(1, 1, *r) for r in regions], "doc_id long, page int, x double, y double, width double, height double"))
    place = {r.region_no: (r.x, r.y) for r in df.collect()}
    hits = {place[r.region_no]: (r.text_runs, r.centre_hits) for r in spatial.audit_regions(df, tok).collect()}
    assert hits == {(0.0, 0.0): (0, 0), (0.0, 1.0): (1, 0), (15.0, 15.0): (1, 1), (20.0, 10.0): (0, 0), (0.0, 20.0): (0, 0)}
    page = spatial.audit_pages(df, tok).first()
    assert (page.regions, page.text_runs) == (5, 1)  # two regions over one token count it once
    assert spatial.missed_tokens(df, tok).count() == 0


def test_region_text_can_be_empty_where_runs_are_hit(spark):
    tok = layout.tokens(spark.createDataFrame([(1, "abcdefgh ij")], "doc_id long, text string"))
    region = spatial.numbered(spark.createDataFrame([(1, 1, 72.0, 758.0, 5.0, 20.0)], "doc_id long, page int, x double, y double, width double, height double"))
    r = spatial.audit_regions(region, tok).first()
    assert (r.text_runs, r.centre_hits, r.region_text) == (1, 0, "")


BOX = "doc_id long, page int, x double, y double, width double, height double"


@pytest.mark.parametrize("x,width,want", [(72.0, 40.0, (72.0, 144.0)), (72.0, 36.0, (72.0, 72.0)), (72.0, 37.0, (72.0, 144.0)), (550.0, 30.0, (540.0, 72.0)), (0.0, 600.0, (0.0, 612.0)), (0.0, 700.0, (0.0, 700.0))])
def test_quantized_boxes(spark, x, width, want):
    page = layout.pages(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    box = spatial.expanded(spark.createDataFrame([(1, 1, x, 5.0, width, 9.0), (1, 9, x, 5.0, width, 9.0)], BOX), page, "quantize").orderBy("page").collect()
    assert (box[0].x, box[0].width) == want and box[0].x <= x and box[0].x + box[0].width >= x + width
    assert (box[1].x, box[1].width) == (x, width)  # no such page


def test_merging_boxes(spark):
    near, far, other = [(1, 1, 72.0, 700.0, 40.0, 12.0), (1, 1, 120.0, 700.0, 40.0, 12.0)], (1, 1, 400.0, 700.0, 40.0, 12.0), (1, 1, 72.0, 660.0, 40.0, 12.0)
    df = spark.createDataFrame([*near, far, other], BOX)
    want = {(72.0, 700.0, 88.0), (400.0, 700.0, 40.0), (72.0, 660.0, 40.0)}
    assert {(r.x, r.y, r.width) for r in spatial.merged_lines(df).collect()} == want
    assert {(r.x, r.y, r.width) for r in spatial.merged_boxes(df.withColumn("seq", F.monotonically_increasing_id()), "seq").collect()} == want
    levels = [spatial.prepared(df, layout.pages(spark.createDataFrame([(1, "a")], "doc_id long, text string")), k).count() for k in (-1, 0, 1, 2, 3, 9)]
    assert levels == [4, 4, 3, 3, 3, 3]


# -- comparison


@pytest.mark.parametrize("a,b,added,removed", [("the quick fox", "the quick brown fox", ["brown"], []), ("alpha beta gamma delta", "alpha gamma delta", [], ["beta"]), ("a b c d", "a c b d", ["b"], ["b"]), ("", "x y", ["x", "y"], []), ("x", "", [], ["x"]), ("a b", "b a", ["a"], ["a"])])
def test_sequence_diff(a, b, added, removed):
    got = diff.sequence_diff(a.split(), b.split())
    assert len(got[0]) == len(added) and len(got[1]) == len(removed)
    if (a, b) != ("a b c d", "a c b d"):
        assert got == (added, removed)


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_sequence_diff_follows_the_table(a, b):
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    added, removed, i, j = [], [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif j == m or i < n and t[i + 1][j] >= t[i][j + 1]:
            removed.append(a[i])
            i += 1
        else:
            added.append(b[j])
            j += 1
    assert diff.sequence_diff(a, b) == (added, removed)


def test_long_sequences():
    a = [str(i % 97) for i in range(3900)]
    b = a[:1000] + ["new"] + a[1001:]
    assert diff.sequence_diff(a, b) == (["new"], [a[1000]])


def test_large_pages_compare_as_bags(monkeypatch):
    monkeypatch.setattr(diff, "LCS_PRODUCT", 3)
    assert diff.sequence_diff("a b c d a".split(), "a c b d e".split()) == (["e"], ["a"])


def test_bags_of_whole_texts(spark):
    schema, rng = "doc_id long, text string", random.Random(5)
    texts = lambda: [" ".join(rng.choices("a b c dd e\u0301 f".split(), k=rng.randrange(12))).replace("b c", "b\t\nc") for _ in range(30)]
    rows = [[*enumerate(texts()), (40, "same words"), (41, None), (42, ""), (43, only), (None, "x y")] for only in ("old", "new")]
    old, new = (spark.createDataFrame([*r, (50 + k, "b b a b")], schema) for k, r in enumerate(rows))
    as_words = lambda df: df.select("doc_id", F.posexplode(text.words(F.col("text"))).alias("seq", "word"))
    key = lambda df: sorted((str(r.doc_id), r.added, r.removed) for r in df.collect())
    got = diff.bag_diff_texts(old, new, ("doc_id",), "text")
    assert key(got) == key(diff.bag_diff(as_words(old), as_words(new), ("doc_id",)))
    twice = diff.bag_diff_texts(spark.createDataFrame([(1, "a b"), (1, "c")], schema), spark.createDataFrame([(1, "c d a")], schema), ("doc_id",), "text")
    assert key(twice) == [("1", ["d"], ["b"])]


def test_bag_comparison_moves_texts_once(spark):
    from leafloom.plans import comparisons

    plan = comparisons.compare_bag_order(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Window" not in plan and "Generate" not in plan


def test_full_outer_pages(spark):
    schema = "doc_id long, page int, page_text string"
    old, new = spark.createDataFrame([(1, 1, "a b")], schema), spark.createDataFrame([(1, 1, "a b"), (1, 2, "c d")], schema)
    sides = diff.compare_pages(old, new)
    out = sides.withColumn("d", diff.lcs_diff(F.col("old_words"), F.col("new_words"))).select("doc_id", "page", "d.*")
    t = diff.diff_totals(out, ("doc_id",)).first()
    assert (t.pages, t.changed_pages, t.added_words, t.removed_words, t.identical) == (2, 1, 2, 0, False)


# -- URLs


@pytest.mark.parametrize("url,level,category", [("https://www.google.com", "green", "known-site"), ("https://en.wikipedia.org/", "green", "known-site"), ("https://irs.gov", "green", "known-site"), ("https://github.com/a", "yellow", "code-hosting"), ("https://dropbox.com/", "yellow", "file-hosting"), ("https://bit.ly/a", "yellow", "url-shortener"), ("http://a.xyz", "red", "risky-tld"), ("javascript:x", "red", "unsafe-scheme"), ("https://nowhere.example/", "yellow", "unknown"), ("/relative", "yellow", "unparseable"), ("https://notgoogle.com", "yellow", "unknown")])
def test_url_rating(spark, url, level, category):
    r = one(spark, urls.rating(F.lit(url))).c0
    assert (r.level, r.category) == (level, category)


def test_verdicts_and_targets(spark):
    rows = spark.createDataFrame([(1, "https://a.gov/"), (2, "https://A.gov/"), (3, "https://b.org/"), (4, "https://c.org/")], "seq long, url string")
    assert [r.url for r in links.scan_targets(rows, "seq", limit=2).collect()] == ["https://a.gov/", "https://b.org/"]
    told = spark.createDataFrame([("https://a.GOV/", True), ("https://b.org/", False)], "url string, malicious boolean")
    got = {r.seq: (r.level, r.category, r.source) for r in links.with_verdicts(links.rated(rows), told).collect()}
    assert got == {1: ("red", "malicious", "scanner"), 2: ("red", "malicious", "scanner"), 3: ("yellow", "unknown", "scanner"), 4: ("yellow", "unknown", "heuristic")}
    assert links.first_per_url(rows, "seq").count() == 3


# -- pages


def test_page_lists(spark):
    got = one(spark, pages.page_list(F.array(*map(F.lit, (3, 1, 9, 1, 0))), F.lit(3)), pages.page_list(F.lit(None).cast("array<int>"), F.lit(2)), pages.page_list(F.array().cast("array<int>"), F.lit(0)))
    assert (got.c0, got.c1, got.c2) == ([1, 3], [1, 2], [])


def test_numbering(spark):
    rows = spark.createDataFrame([(i // 3, i % 3) for i in range(30)], "doc_id long, page int").repartition(5)
    got = pages.numbered(rows, ["doc_id", "page"], "ACME", "", 1, 1).orderBy("doc_id", "page").collect()
    assert [r.label for r in got] == [f"ACME{i}" for i in range(1, 31)]
    with pytest.raises(ValueError):
        pages.numbered(rows, ["doc_id"], start=-1)
    ends = pages.label_ends(pages.numbered(rows.limit(0), ["doc_id"])).first()
    assert (ends.n, ends.first_label) == (0, None)


def test_arranged_rotated_and_bookmarks(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 90), (1, 3, 270)], "doc_id long, page int, rotation int")
    assert [(r.page, r.source_page) for r in pages.arranged(rows, [3, 1, 3], "doc_id", "page").orderBy("page").collect()] == [(1, 3), (2, 1), (3, 3)]
    assert pages.check_order(rows, [4], "doc_id", "page").count() == 1
    assert [r.rotation for r in pages.rotated(rows, -90).orderBy("page").collect()] == [270, 0, 180]
    for bad in (lambda: pages.rotated(rows, 45), lambda: pages.arranged(rows, [], "doc_id", "page")):
        with pytest.raises(ValueError):
            bad()
    both = pages.merged([rows.drop("rotation"), rows.drop("rotation")], "doc_id", "page")
    marks = spark.createDataFrame([(1, 2, "two", 1), (1, 2, "lost", 9)], "doc_id long, part int, title string, page int")
    assert [(r.title, r.out_page) for r in pages.shifted_bookmarks(marks, both, "doc_id", "page").collect()] == [("two", 4)]


def test_field_types_and_names(spark):
    got = one(spark, *[pages.field_type(F.lit(k), F.lit(f)) for k, f in (("Btn", 0), ("Btn", 1 << 15), ("Btn", 1 << 16), ("Ch", 0), ("Tx", 0), ("Sig", 0))])
    assert list(got) == ["checkbox", "radio", "button", "choice", "text", "signature"]
    taken = spark.createDataFrame([("a",), ("a_2",), ("b",)], "name string")
    assert pages.free_name(taken, "a").first().name == "a_3" and pages.free_name(taken, "c").first().name == "c"


# -- safety, records, messages


def test_scan_after_strip(spark):
    html = '<a href="https://x.org/">a</a><a href="/in">b</a><script>x()</script><p onclick="y()">z</p>'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    before, after = safety.scan(df).first(), safety.scan(safety.stripped(df)).first()
    assert (before.js_count, before.url_count) == (2, 2) and (after.js_count, after.url_count) == (0, 1)
    only_js = safety.scan(safety.stripped(df, urls=False)).first()
    assert (only_js.js_count, only_js.url_count) == (0, 2)
    assert [s.source for s in safety.scripts(df).orderBy("seq").collect()] == ["x()", '"y()"']


def test_upsert_and_delete(spark):
    own = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, script string")
    changes = spark.createDataFrame([(1, "b", "x"), (2, "b", "y"), (3, "c", "z")], "seq int, name string, script string")
    got = safety.deleted(safety.upserted(own, changes), spark.createDataFrame([("a",), ("zz",)], "name string"))
    assert sorted(tuple(r) for r in got.collect()) == [("b", "y"), ("c", "z")]


@pytest.mark.parametrize("script,values,want", [("this.getField('t').value = this.getField('a').value + this.getField('b').value", {"a": "2", "b": "3"}, "5"), ("this.getField('t').value = Number(this.getField('a').value)*2+this.getField('b').value", {"a": "4", "b": "1"}, "9"), ("this.getField('t').value = this.getField('none').value + 1", {}, "1"), ("this.getField('t').value = 1 / 0", {}, None), ("this.getField('t').value = 2 - -(3 + 1) * .5", {}, "4"), ("this.getField('t').value = __import__", {}, None)])
def test_form_script_arithmetic(script, values, want):
    got = run_script(script, values)
    assert got["ok"] == (want is not None) and [s["value"] for s in got["sets"]] == ([want] if want else [])


def test_form_script_is_all_or_nothing():
    assert not run_script("this.resetForm(); steal()", {})["ok"] and not run_script("", {})["ok"] and not run_script(None, {})["ok"]
    got = run_script("this.resetForm(); app.alert({cMsg: 'm', cTitle: 't'}); this.getField('x').display = display.visible", {})
    assert got["reset"] and got["alerts"] == ["m"] and got["display"] == [{"name": "x", "hidden": False}]


@pytest.mark.parametrize("script,values,want", [("this . getField ( 't' ) . value = parseFloat(this.getField('a').value) / 4", {"a": " 3.5e1 pieces"}, "8.75"), ("this.getField('t').value = 1.2.3 + 2", {}, "3.2"), ("this.getField('t').value = Number((1))", {}, None), ("this.getField('t').value = (1 + 2", {}, None), ("this.getField('t').value = 1 +", {}, None), ("this.getField('t').value = -(-(2)) * +3", {}, "6"), ("this.getField('t').value = 'x'", {}, None), ("this.getField('t;u').value = 1", {}, None), ("this.getField('t').value = " + "(" * 5000, {}, None)])
def test_form_script_grammar(script, values, want):
    assert [s["value"] for s in run_script(script, values)["sets"]] == ([want] if want else [])


def test_form_script_statements():
    assert run_script("app.alert('a', 1, \"x\");; app.alert(\"it's\")", {})["alerts"] == ["a", "it's"]
    assert not run_script("app.alert('a', f(1))", {})["ok"] and not run_script("app.alert({cMsg: {}})", {})["ok"] and not run_script("this.getField('x').display = display.other", {})["ok"]
    assert run_script("app.alert({ cTitle: 'T', cMsg : \"hi\", nIcon: 3 })", {})["alerts"] == ["hi"]


def test_private_hosts(spark):
    hosts = ["localhost", "0.0.0.0", "::1", "[::1]", "", None, "127.0.0.1", "10.1.2.3", "172.16.0.1", "172.31.255.1", "192.168.1.1", "169.254.9.9", "[fd00::1]", "fc12:3::", "172.15.0.1", "172.32.0.1", "192.169.1.1", "11.0.0.1", "example.org", "[fe80::1]", "1270.0.0.1", "face.org"]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string")
    assert [r.p for r in rows.orderBy("i").select(urls.is_private(F.col("h")).alias("p")).collect()] == [True] * 14 + [False] * 8


def test_versions_paths_and_pairs(spark):
    got = one(spark, R.version_state(F.lit("2.0.0.0"), F.lit("2.0.0")), R.version_state(F.lit("1.9"), F.lit("2.0")), R.version_state(F.lit("x"), F.lit("2.0")), R.relative_path(F.lit("k:a/b"), F.lit("k")), R.relative_path(F.lit("o:br:c"), F.lit("k")), R.relative_path(F.lit("plain"), F.lit("k")), R.key_values(F.lit("a=b=c")), R.key_values(F.lit("none")), R.platform_of(F.lit("X11; CrOS")), R.issue_level(F.array().cast("array<string>"), F.lit("critical")))
    assert [got[i] for i in range(6)] == ["ok", "host-older", "unknown", "a/b", "c", "plain"]
    assert got.c6.value == "b=c" and got.c7 is None and got.c8 == "chromeos" and got.c9 == "error"


def test_geometry(spark):
    m = F.array(*[F.lit(float(x)) for x in (2, 1, 0, 3, 5, 7)])
    same = geometry.multiplied(m, geometry.inverted(m))
    got = one(spark, same, geometry.inverted(F.array(*[F.lit(0.0)] * 6)), geometry.rgb(F.lit("#ff0080")), geometry.rgb(F.lit("nope")), geometry.normal_rotation(F.lit(-90)), *[geometry.corner_of(F.lit(c)) for c in ("bottom-left", "TOP_RIGHT", "topcentre", "nonsense")])
    assert [round(x, 9) for x in got.c0] == [1, 0, 0, 1, 0, 0] and got.c1 is None and got.c2.r == 1.0 and got.c3 is None and got.c4 == 270
    assert [got[i] for i in range(5, 9)] == ["BottomLeft", "TopRight", "TopCenter", "BottomRight"]


def test_findings(spark):
    docs = spark.createDataFrame([(1, "x" * 50, "en", 50), (2, "", "en", 0), (3, "abc", "xx", 4), (3, None, "en", None)], "doc_id long, text string, lang string, n_chars long")
    empty = lambda s: spark.createDataFrame([], s)
    tables = {"documents": docs, "pages": empty("page_id long, url string, html string"), "conversations": empty("conv_id long, turn long, role string, text string"), "orders": spark.createDataFrame([(1, -2.0)], "o_orderkey long, o_totalprice double"), "lineitem": spark.createDataFrame([(1, 0.1), (2, 1.5)], "l_orderkey long, l_discount double"), "events": spark.createDataFrame([(1, "{"), (2, "{}")], "event_id long, props string")}
    found = validate.all_findings(tables)
    assert {(r.code, r.n) for r in validate.census(found).collect()} == {("DOC001", 2), ("DOC002", 1), ("DOC003", 1), ("DOC004", 2), ("DOC005", 1), ("ORD001", 1), ("LIN001", 1), ("LIN002", 1), ("EVT001", 1)}
    assert not validate.report(found).first().is_valid and validate.report(found.limit(0)).first().is_valid
    assert validate.log_text(found.limit(0)).first().log == "No findings." and "ERROR DOC005 [doc 3]" in validate.log_text(found).first().log
    many = found.limit(0).union(spark.range(30).select(F.lit("A"), F.lit("Error"), F.col("id").cast("string"), F.lit("m")))
    assert validate.capped(many, ("A",)).count() == 10


def test_messages(spark):
    body = "é" * 1000
    parts = messages.framed(spark.createDataFrame([("m", body), ("s", "short")], "id string, body string"), whole=100, chunk=64)
    rows = [r for r in parts.collect() if r.chunk_index is not None]
    assert [r.data for r in parts.collect() if r.chunk_index is None] == ["short"]
    seq = [(i, r.id, r.chunk_index, r.chunk_count, r.data) for i, r in enumerate(reversed(rows))]
    seq += [(900, "m", 0, rows[0].chunk_count, rows[0].data), (901, "bad", 5, 2, "x"), (902, "big", 0, 10_001, "x"), (903, "open", 0, 2, "YQ==")]
    df = spark.createDataFrame(seq, "seq long, id string, chunk_index int, chunk_count int, data string")
    assert [(r.id, r.body) for r in messages.assembled(df).collect()] == [("m", body)]


def test_log_ring(spark):
    got = messages.ring(spark.range(20).withColumnRenamed("id", "k"), "k", 5).orderBy("k").collect()
    assert [(r.k, r.seq, r.dropped) for r in got] == [(15, 16, 15), (16, 17, 15), (17, 18, 15), (18, 19, 15), (19, 20, 15)]
    assert messages.ring(spark.range(3).withColumnRenamed("id", "k"), "k", 5).first().dropped == 0
