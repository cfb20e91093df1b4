"""Near-dedup, line dedup, top-k and language-model scores against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafloom.llm import linededup, minhash, pitmanyor, textops, topk
from leafloom.llm.components import components
from leafloom.llm.shared import HotKeys, Workspace

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(text, size):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def plain_components(rows, size, percent=80):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t, size)) for d, t in rows if d is not None]
    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d, _ in sets}


def near_copies(rng):
    """Groups of edited copies around the threshold, chains, short texts and exact copies."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 12, 40, 150, 900]))]
        now = base
        for k in range(rng.randrange(1, 14)):
            rows.append(" ".join(now))
            now = list(now if k % 2 else base)  # copies of the base and chains of copies
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                now[rng.randrange(len(now))] = word()
    return rows + ["", " \n", "Same Words Here now", "same words here NOW", "one", "one", "two words"]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_match_brute_force(spark, size):
    rows = list(enumerate(near_copies(random.Random(size))))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, Workspace(spark, "test"), size=size).collect()}
    want = plain_components(rows, size)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(dict(rows)[d], size)) and r.kept == (d == want[d]) for d, r in got.items())


def test_near_duplicates_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c d e f", "x"), (3, "a b c d e f", "x"), (3, "a b c d e f", "x"), (4, "q w e r t y u", "x"), (4, "a b c d e f", "x"), (5, "q w e r t y u", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumns({c: F.lit(1) for c in ("rep", "n", "key", "hub")})
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, Workspace(spark, "test"), size=4).collect())
    # rows of document 4 link documents 3 and 5
    assert got == Counter({(1, 1, True): 1, (2, 2, True): 1, (None, None, True): 1, (3, 3, True): 2, (4, 3, False): 2, (5, 3, False): 1})
    kept = minhash.keep_one(df, Workspace(spark, "test"), size=4)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 3]
    assert minhash.near_duplicates(df.limit(0), Workspace(spark, "test")).count() == 0


def test_near_duplicates_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 3)
    rows = list(enumerate(near_copies(random.Random(9))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, Workspace(spark, "test"), size=4).collect()}
    assert got == plain_components(rows, 4)


def test_near_duplicates_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.component_id for r in minhash.op4_neardup(spark, SF).collect()}
    assert got == plain_components(rows, 4)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64)
        n = int(len(both) * (1 - share) / 2)
        one, two = np.sort(both[n:]), np.sort(both[: len(both) - n])
        doc = np.r_[np.zeros(len(one), dtype=np.int64), np.ones(len(two), dtype=np.int64)]
        regs = minhash.densify(minhash.registers(doc, np.r_[one, two], 2))
        assert abs(minhash.agreements(regs[0], regs[1]) - share) < 0.15


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1003, 1001), (5000, 5000)]
    random.Random(4).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"), "c").collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 1001: 1000, 1003: 1000}


def random_line(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(3, 12)))


def test_repeated_passages_go_to_their_edges(spark):
    rng = random.Random(8)
    line = lambda: random_line(rng)
    passage, long_line = [line() for _ in range(40)], " ".join(["passage"] * 51)
    docs = [(i, "\n".join([*(line() for _ in range(rng.randrange(1, 9))), *passage, line(), long_line, *(line() for _ in range(rng.randrange(1, 4)))])) for i in range(30)]
    out = {r.doc_id: r.text.split("\n") for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == docs[0][1].split("\n")
    left = 0
    for i, text in docs[1:]:
        assert [x for x in out[i] if x not in passage] == [x for x in text.split("\n") if x not in passage and x != long_line]
        left += sum(x in passage for x in out[i])
    assert left <= 0.05 * 29 * len(passage)


def test_passages_of_any_length(spark):
    """Of passages of over 50 words in short lines, those with a whole chunk go; a shorter one may hold none."""
    rng = random.Random(2)
    share = {}
    for n in (6, 10, 20):
        passages = [[random_line(rng) + " and so on" for _ in range(n)] for _ in range(60)]
        docs = [(2 * i + j, "\n".join([random_line(rng), random_line(rng), random_line(rng), *p, random_line(rng), random_line(rng), random_line(rng)])) for i, p in enumerate(passages) for j in (0, 1)]
        out = {r.doc_id: r.text.split("\n") for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert all(out[2 * i] == docs[2 * i][1].split("\n") for i in range(60))
        share[n] = 1 - sum(x in p for i, p in enumerate(passages) for x in out[2 * i + 1]) / (60 * n)
        whole = {r.doc_id: r.text.split("\n") for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), run_words=50).collect()}
        assert not any(x in p for i, p in enumerate(passages) for x in whole[2 * i + 1] if len(" ".join(p).split()) > 50)
    assert share[20] > 0.95 and share[10] > 0.6, share


def test_chunks_are_shift_resistant_and_have_two_lines(spark):
    rng = random.Random(4)
    lines = [random_line(rng) for _ in range(300)]
    texts = ["\n".join(lines), "\n".join([random_line(rng), *lines[:150], random_line(rng), *lines[150:]])]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("doc_id", linededup.chunks(F.col("text")).alias("c")).collect()
    one, two = ([c.body for c in r.c] for r in sorted(rows))
    assert ["\n".join(x) for x in (one, two)] == texts and all("\n" in c for c in one + two)
    assert len(set(one) - set(two)) <= 4 and len(one) > 70


def test_line_dedup_of_a_hostile_text(spark):
    """One text of 50,000 repeated chunks, in time that grows with its length."""
    long_line = " ".join(["w"] * 51)
    df = spark.createDataFrame([(1, "\n".join([long_line] * 50_000)), (2, "\n" * 100_000), (3, "a " * 500_000)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert out == {1: long_line, 2: "\n" * 100_000, 3: "a " * 500_000}


def plain_chunks(text):
    """(first line, lines) of each chunk, by the rule read line by line."""
    lines = text.split("\n")
    n, h = len(lines), [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [((h[i - 1] if i else 0) * 65599 + h[i]) % 4294967291 for i in range(n)]
    big = [len(WORD.findall(x)) > 50 for x in lines]
    out, start = [], 0
    for i in range(n):
        least = 1 <= i < n - 2 and r[i] < r[i - 1] and r[i] <= r[i + 1] and not any(big[i - 1 : i + 3])
        if i == n - 1 or big[i] or big[i + 1] or least:
            out.append((start, lines[start : i + 1]))
            start = i + 1
    return out


def plain_line_dedup(rows):
    """The texts that stay, by dictionaries of chunks: {id: text}; ids are distinct and texts not null."""
    cut = {d: plain_chunks(t) for d, t in rows}
    places = defaultdict(list)
    for d in sorted(cut):
        for k, (_, lines) in enumerate(cut[d]):
            if len(WORD.findall(" ".join(lines))) > 50 if len(lines) == 1 else sum(bool(WORD.search(x)) for x in lines) > 1:
                places["\n".join(lines)].append((d, k))
    again = {p for at in places.values() if len(at) > 1 for p in at}
    gone = defaultdict(set)
    same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for (d0, k0), *later in places.values():
        for d, k in later:
            at, lines = cut[d][k]
            lo, hi = at, at + len(lines)
            if k and k0 and (d, k - 1) not in again:
                lo -= same(cut[d][k - 1][1][::-1], cut[d0][k0 - 1][1][::-1])
            if k + 1 < len(cut[d]) and k0 + 1 < len(cut[d0]) and (d, k + 1) not in again:
                hi += same(cut[d][k + 1][1], cut[d0][k0 + 1][1])
            gone[d].update(range(lo, hi))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(6)
    pool = [random_line(rng) for _ in range(60)] + [" ".join(rng.choices("abcdef", k=60)) for _ in range(6)] + ["", "x"]
    docs = []
    for i in range(80):
        at = rng.randrange(50)
        docs.append((i, "\n".join([*rng.choices(pool, k=rng.randrange(5)), *pool[at : at + rng.randrange(16)], *rng.choices(pool[-10:], k=rng.randrange(4))])))
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), drop_emptied=False).collect()}
    assert got == plain_line_dedup(docs) and sum(got[d] != t for d, t in docs) > 20


def plain_runs(docs, words=50):
    """Runs of two or more lines and over so many words of each text that stand in one earlier text too, in id order."""
    places, out = defaultdict(list), []
    for d, text in sorted(docs):
        lines, i = text.split("\n"), 0
        while i < len(lines) - 1:
            longest = i
            for e, j in places[lines[i], lines[i + 1]]:
                n = 0
                while i + n < len(lines) and j + n < len(e) and lines[i + n] == e[j + n]:
                    n += 1
                longest = max(longest, i + n)
            if longest > i + 1 and len(WORD.findall(" ".join(lines[i:longest]))) > words:
                out.append((d, i, longest))
                i = longest
            else:
                i += 1
        for k in range(len(lines) - 1):
            places[lines[k], lines[k + 1]].append((lines, k))
    return out


@pytest.mark.parametrize("blank", [False, True])
def test_line_dedup_removes_whole_runs(spark, blank):
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(4, 12)))
    passage, docs = [line() for _ in range(14)], []
    for i in range(30):
        a = rng.randrange(0, 4) if i else 0
        docs.append((i, ("\n\n" if blank else "\n").join([line(), *passage[a : a + (rng.randrange(10, 15) if i else 14)], line(), passage[1], line()])))
    out = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), run_words=linededup.PASSAGE_WORDS).collect()}
    assert out[0] == docs[0][1] and plain_runs(docs)
    for d, text in docs[1:]:
        lines, own = out[d].split("\n"), [x for x in text.split("\n") if x not in passage and x]
        # its own lines and a passage line that stands alone stay, in order
        kept = [x for x in lines if x]
        assert kept == [*own[:2], passage[1], own[2]]


def test_line_dedup_leaves_no_long_run_in_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").filter("text IS NOT NULL").select("doc_id", "text")
    before = [tuple(r) for r in df.collect()]
    assert plain_runs(before)
    after = [tuple(r) for r in linededup.dedup_lines(df, run_words=linededup.PASSAGE_WORDS).collect()]
    assert not plain_runs(after)
    lines = lambda rows: {x for _, t in rows for x in t.split("\n") if WORD.search(x)}
    assert lines(after) == lines(before)  # every line still stands somewhere


def test_line_dedup_edges(spark):
    x, y = " ".join(["x"] * 51), " ".join(["y"] * 51)
    text = f"one line here\n{x}\nlast"
    rows = [(1, None, 0), (2, "", 0), (3, text, len(text)), (3, text, len(text)), (4, x, 101), (None, y, 101), (5, f"{y}\nrest", 106), (6, "z\nz\nz\nz", 7), (7, "\n\n\n", 3), (8, "\n\n\n", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({c: F.lit("k") for c in ("no", "body", "h", "first", "_ll", "n")})
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text, r.n_chars) for r in out.collect())
    assert got[(1, None, 0)] == got[(2, "", 0)] == 1 and got[(3, text, len(text))] == 2
    assert not any(k[0] == 4 for k in got)  # all its words stand in document 3
    assert got[(None, y, 101)] == 1 and got[(5, "rest", 4)] == 1 and got[(7, "\n\n\n", 3)] == got[(8, "\n\n\n", 3)] == 1
    kept = linededup.dedup_lines(df, drop_emptied=False)
    assert kept.count() == 10 and kept.filter("doc_id = 4").first().text == ""
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_has_no_python_in_its_plan(spark):
    plan = linededup.op5_linededup(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("name,module", [("op4_neardup", minhash), ("op5_linededup", linededup), ("op6_topk", topk)])
def test_oracles(spark, name, module):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = module.QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({module.ORACLES[name]})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want) and len(want) > 0


def plain_top_k(rows, is_query, k):
    """Every query id's best rows; a row counts once, with the best score of the query's vectors."""
    valid = [(n, i, v) for n, (i, v) in enumerate(rows) if i is not None and v and None not in v]
    want = {}
    for q in {i for _, i, _ in valid if is_query(i)}:
        best = {}
        for _, i, v in valid:
            if i == q:
                for n, c, u in valid:
                    if c != q and len(u) == len(v):
                        best[n, c] = max(best.get((n, c), -math.inf), max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(u, v, strict=True)))))
        top = sorted((-s, c) for (_, c), s in best.items())[:k]
        want[q] = [(r + 1, c, -s) for r, (s, c) in enumerate(top)]
    return want


def found_top_k(spark, df, is_query, k, **more):
    got = defaultdict(list)
    for r in topk.top_k(df, is_query, Workspace(spark, "test"), k=k, **more).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    ids = [*range(300), 7, 20, 40, 40]  # an id twice, two query ids twice and thrice
    vectors = [rng.integers(-3, 4, 5).tolist() for _ in ids]
    vectors[-2] = vectors[40]  # one of them with the same vector
    rows = [*zip(ids, vectors, strict=True), (900, None), (901, [1, None, 2, 3, 4]), (902, [1, 2]), (920, [5, 6]), (None, [1] * 5), (903, []), (40, [1, 1]), *[(1000 + i, [2, 2, 2, 2, 2]) for i in range(300)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>").withColumns({c: F.lit("x") for c in ("id", "v", "dim", "part", "score", "group")})
    got = found_top_k(spark, df, F.col("vec_id") % 20 == 0, 7, shard_rows=40, query_rows=4)
    assert got == {q: x for q, x in plain_top_k(rows, lambda i: i % 20 == 0, 7).items() if x}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, Workspace(spark, "test")).count() == 0


def test_top_k_of_huge_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [int(x) for x in rng.integers(-(2**62), 2**62, 3)]) for i in range(40)] + [(100 + i, [int(x) for x in rng.integers(-(2**33), 2**33, 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    assert found_top_k(spark, df, F.col("vec_id") % 10 == 0, 5, shard_rows=20) == plain_top_k(rows, lambda i: i % 10 == 0, 5)


def test_top_k_sends_queries_where_the_bound_reaches(spark, monkeypatch):
    """200,000 clustered vectors against brute force; few of all pairs of query and shard are searched."""
    rng = np.random.default_rng(5)
    vectors = (rng.integers(-300, 300, (100, 12))[rng.integers(0, 100, 200_000)] + rng.integers(-9, 10, (200_000, 12))).astype(np.int64)
    sent = {}
    written = Workspace.written
    monkeypatch.setattr(Workspace, "written", lambda self, df, name: sent.setdefault(name, written(self, df, name)))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<long>")
    got = found_top_k(spark, df, F.col("vec_id") % 1000 == 0, 10)
    shards = sent["others"].select("group", "part").distinct().count()
    assert shards > 30 and sent["others"].count() < 0.2 * 200 * shards
    for q in range(0, 200_000, 1000):
        score = vectors @ vectors[q]
        score[q] = -(2**62)
        near = np.flatnonzero(score >= np.partition(score, -10)[-10])
        want = sorted(zip((-score[near]).tolist(), near.tolist(), strict=True))[:10]
        assert got[q] == [(r + 1, c, -s) for r, (s, c) in enumerate(want)]


def test_ball_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (20, 8))
    vectors = np.concatenate([c + rng.integers(-9, 10, (200, 8)) for c in centres])
    queries = vectors[::100]
    ids, q_ids = np.arange(len(vectors)), np.arange(len(vectors))[::100]
    s = topk.Search(ids, vectors, q_ids, queries, np.full(len(queries), topk._NONE + 1), 5)
    assert s.scored < 0.5 * len(queries) * len(vectors)
    q, v, _, score = s.results()
    for i, x in zip(q_ids, queries, strict=True):
        all_scores = vectors @ x
        want = sorted((-int(all_scores[j]), int(j)) for j in range(len(vectors)) if j != i)[:5]
        assert sorted((-int(b), int(a)) for a, b in zip(v[q == i], score[q == i], strict=True)) == want
    huge = topk.Search(ids[:50], vectors[:50] * 2**26, q_ids[:1], queries[:1] * 2**20, np.full(1, topk._NONE + 1), 3)
    assert not huge.whole and len(huge.results()[0]) == 3


def plain_base(rows):
    tokens = {i: [*WORD.findall(lower(t)), None] for i, (d, t) in enumerate(rows)}
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, _ in rows]
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    return [(held[i], len(ws), sum(w in count for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens.items()]


def test_language_model_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in pitmanyor.op7_lmscore(spark, SF).collect()}
    better = tokens = 0
    for (d, _), (held, n, known, train, base) in zip(rows, plain_base(rows), strict=True):
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train) and abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.score < 0
        if held:
            better += r.score - r.base_score
            tokens += r.n_tokens
    assert better / tokens > 0.05  # the model predicts held-out tokens better than counts alone


def test_language_model_edges(spark):
    rows = [(1, None), (2, ""), (None, "A b a"), (3, "a b A b"), (3, "a b A b"), (7, "a b " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "words", "held", "score")})
    got = pitmanyor.score_texts(df, Workspace(spark, "test")).collect()
    want = plain_base(rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == Counter((d, *w[:4], round(w[4], 3)) for (d, _), w in zip(rows, want, strict=True))
    assert pitmanyor.score_texts(df.limit(0), Workspace(spark, "test")).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(40) if pitmanyor.is_held_out(i)], "doc_id long, text string")
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(0.0) for r in pitmanyor.score_texts(only_held, Workspace(spark, "test")).collect())


def test_many_buckets_and_blocks_change_no_count(spark, monkeypatch):
    rows = [(i, " ".join(random.Random(i % 9).choices(["a", "b", "cc", "dd", "e"], k=30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(pitmanyor, "BLOCK_TOKENS", 100)
    monkeypatch.setattr(pitmanyor, "BUCKET_WORDS", 3)
    got = {r.doc_id: r for r in pitmanyor.score_texts(df, Workspace(spark, "test")).collect()}
    for (d, _), w in zip(rows, plain_base(rows), strict=True):
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == w[1:4] and got[d].base_score == pytest.approx(w[4])


def plain_model(rows, s):
    """Scores by a sampler in plain loops, seat by seat, and the sums of all contexts' probabilities."""
    texts = [WORD.findall(lower(t)) for _, t in rows]
    train = [x for (d, _), x in zip(rows, texts, strict=True) if not pitmanyor.is_held_out(d)]
    counts = Counter(w for x in train for w in [*x, None])
    n_train = sum(counts.values())
    name = {w: int(pitmanyor.END) if w is None else int(textops.strong_hashes(np.frombuffer(w.encode(), dtype=np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) for x in texts for w in [*x, None]}
    hot = sorted((name[w], w is None, w) for w, c in counts.items() if c > 1 and c * pitmanyor.CONTEXT_STEP >= math.sqrt(n_train))
    number = {w: pitmanyor.FIRST + i for i, (_, _, w) in enumerate(hot)}
    context = lambda w: number.get(w, 1 + w.encode()[-1])
    pairs = lambda x: [(0 if i == 0 else context(x[i - 1]), w) for i, w in enumerate([*x, None])]
    n = Counter(p for x in train for p in pairs(x))
    customers = Counter()
    for (c, _), k in n.items():
        customers[c] += k
    word_key = lambda w: pitmanyor._mixed(s.seed, sweep, np.array([name[w]], dtype=np.uint64), 0)

    def sit(k, base, step, d, key):
        t = min(k, 1)
        for sat in range(1, k):
            new = base + step * t
            if pitmanyor.uniform(key, np.array([sat]))[0] * (new + max(sat - d * t, 1e-9)) < new:
                t += 1
        return t

    share = lambda x: min(0.95, max(0.05, sum(v == 1 for v in x) / (sum(v == 1 for v in x) + 2 * sum(v == 2 for v in x)))) if 1 in x else 0.5
    t = dict.fromkeys(n, 1)
    root_n = Counter(w for _, w in t)
    root_t = dict.fromkeys(root_n, 1)
    d, root_d, v = share(list(n.values())), share(list(root_n.values())), len(counts)
    scores, sums = [0.0] * len(rows), []
    p = defaultdict(float)
    for sweep in range(1, s.burn_in + s.samples + 1):
        tables = Counter()
        for (c, _), x in t.items():
            tables[c] += x
        base, all_n = (s.root_strength + root_d * sum(root_t.values())) / (v + 1), sum(root_n.values())
        new = {}
        for (c, w), k in n.items():
            rest = root_n[w] - t[c, w]
            parent = (rest - root_d * min(root_t[w], rest) + base) / (s.root_strength + all_n)
            key = pitmanyor._mixed(s.seed, sweep, np.array([name[w]], dtype=np.uint64), c + 1)
            new[c, w] = sit(k, (s.strength + d * (tables[c] - t[c, w])) * parent, d * parent, d, key) if k > 1 else 1
        t = new
        root_n = Counter()
        for (_, w), x in t.items():
            root_n[w] += x
        root_t = {w: sit(x, base, 0.0, root_d, word_key(w)) for w, x in root_n.items()}
        if sweep > s.burn_in:
            tables = Counter()
            for (c, _), x in t.items():
                tables[c] += x
            base, all_n = (s.root_strength + root_d * sum(root_t.values())) / (v + 1), sum(root_n.values())
            root = lambda w: (root_n[w] - root_d * root_t.get(w, 0) + base) / (s.root_strength + all_n)
            chance = lambda c, w: (n[c, w] - d * t.get((c, w), 0) + (s.strength + d * tables[c]) * root(w)) / (s.strength + customers[c])
            sums += [sum(chance(c, w) for w in [*counts, "never seen"]) for c in customers]
            for x in texts:
                for c, w in set(pairs(x)):
                    p[c, w, sweep] = chance(c, w)
    for i, x in enumerate(texts):
        scores[i] = sum(math.log10(sum(p[c, w, k] for k in range(s.burn_in + 1, s.burn_in + s.samples + 1)) / s.samples) for c, w in pairs(x))
    return scores, sums


def tiny_corpus():
    rng = random.Random(12)
    words = ["the", "of", "a", "often9", "longer-than-eight", "zz\x00", *(f"w{k}" for k in range(40))]
    return [(i, " ".join(rng.choices(words, weights=[20, 14, 9, 16 if i < 20 else 5, 3, 2, *[1] * 40], k=rng.randrange(0, 50)))) for i in range(60)]


def test_language_model_equals_a_plain_sampler(spark, monkeypatch):
    rows, s = tiny_corpus(), pitmanyor.Sweeps(samples=3)
    want, sums = plain_model(rows, s)
    assert sums == pytest.approx([1.0] * len(sums))  # every context's probabilities, with that of an unseen word
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for partitions, tokens, words, together in ((1, 600_000, 300_000, 500_000), (3, 100, 7, 5), (50, 30, 3, 40)):
        monkeypatch.setattr(pitmanyor, "BLOCK_TOKENS", tokens)
        monkeypatch.setattr(pitmanyor, "BUCKET_WORDS", words)
        monkeypatch.setattr(pitmanyor, "TOGETHER", together)
        got = {r.doc_id: r.score for r in pitmanyor.score_texts(df.repartition(partitions), Workspace(spark, "test"), sweeps=s).collect()}
        assert [got[i] for i, _ in rows] == pytest.approx(want, rel=1e-12)


def test_rare_context_words_have_restaurants_whatever_the_size(spark, monkeypatch):
    # the plain sampler's limit is lowered to two; words of one occurrence and unseen ones differ in their last byte, so its
    # classes hold one word each, and the former have the highest hashes, as it numbers only the other words
    rng = random.Random(4)
    name = lambda w: int(textops.strong_hashes(np.frombuffer(w.encode(), dtype=np.uint8), np.array([0]), np.array([len(w)]))[0])
    top = max(int(pitmanyor.END), *(name(w) for w in ["the", "of", "a", *(f"{x}{k}" for x in "pq" for k in range(12))]))
    once = [next(w for w in (f"{j}-{end}" for j in range(10**6)) if name(w) > top) for end in "abcdefgh"]
    train, held = ([i for i in range(90) if pitmanyor.is_held_out(i) == x] for x in (False, True))
    texts = {i: rng.choices(["the", "of", "a"], k=14) for i in range(90)}
    for k in range(12):
        for i in rng.sample(train, 2 + k % 2):
            texts[i] += [f"p{k}", f"q{k}"]
        texts[held[k]] += [f"p{k}", f"q{k}", "new-" + "{|}~"[k % 4], "of"]
    for k, w in enumerate(once):
        texts[train[k]] += [w, "the"]
        texts[held[k]] += [w, "the"]
    counts = Counter(w for i in train for w in texts[i])
    assert math.sqrt(sum(counts.values()) + len(train)) / pitmanyor.CONTEXT_STEP > 3 and sorted({counts[w] for w in counts if w not in ("the", "of", "a")}) == [1, 2, 3]
    rows, s = [(i, " ".join(x)) for i, x in texts.items()], pitmanyor.Sweeps()
    df, step = spark.createDataFrame(rows, "doc_id long, text string"), pitmanyor.CONTEXT_STEP
    monkeypatch.setattr(pitmanyor, "CONTEXT_STEP", 1e9)
    want, sums = plain_model(rows, s)
    assert sums == pytest.approx([1.0] * len(sums))
    monkeypatch.setattr(pitmanyor, "BLOCK_TOKENS", 200)
    monkeypatch.setattr(pitmanyor, "BUCKET_WORDS", 20)
    for deal in (step, 0.2, 1e9):  # which words are dealt by pair is no matter
        monkeypatch.setattr(pitmanyor, "CONTEXT_STEP", deal)
        got = {r.doc_id: r.score for r in pitmanyor.score_texts(df, Workspace(spark, "test"), sweeps=s).collect()}
        assert [got[i] for i, _ in rows] == pytest.approx(want, rel=1e-12)


def test_seating_follows_the_restaurant():
    # a one-dish restaurant of strength 1 and discount 0.5: the mean number of tables is known
    s, d = 1.0, 0.5
    for n, dishes in ((40, 20_000), (5000, 3000)):
        t = pitmanyor.seat(np.full(dishes, n), np.full(dishes, s), np.full(dishes, d), d, textops.mix(np.arange(dishes).astype(np.uint64)))
        mean = math.exp(math.lgamma(s + d + n) + math.lgamma(s) - math.lgamma(s + n) - math.lgamma(s + d)) * s / d - s / d
        assert abs(t.mean() - mean) < 0.05 * mean and t.min() >= 1 and t.max() <= n
    assert pitmanyor.seat(np.array([0, 1, 2]), np.ones(3), np.ones(3), 0.5, np.arange(3).astype(np.uint64)).tolist()[:2] == [0, 1]


def test_word_identity():
    offsets, raw = np.array([0, 5, 5, 12]), np.frombuffer(b"ab cdab ab\tc", dtype=np.uint8)
    w = textops.Words(offsets, raw)
    h = w.hashes()
    assert w.counts.tolist() == [2, 0, 3] and h[0] == h[2] == h[3] and len(set(h.tolist())) == 3


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    rng = random.Random(3)
    words = [bytes(rng.choices(b"ab\x00", k=rng.choice([1, 2, 3, 7, 8, 9, 16, 17, 70]))) for _ in range(500)] * 2
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - np.array([len(w) for w in words])
    for hashes in (textops.span_hashes, lambda r, s, e: (e - s).astype(np.uint64) % np.uint64(3)):
        monkeypatch.setattr(textops, "span_hashes", hashes)
        kind, first = textops.span_classes(raw, start, end)
        assert len(first) == len(set(words)) and all(words[first[k]] == w for k, w in zip(kind, words, strict=True))
        strong = textops.strong_hashes(raw, start, end)
        assert len(set(strong.tolist())) == len(set(words))


def test_joins_without_hot_keys_are_plain(spark):
    many = spark.createDataFrame([(k, v) for k in range(1500) for v in range(2)] + [(None, 1)], "k long, v int")
    one = spark.createDataFrame([(k, -k) for k in range(1500)], "k long, w long")
    weighed = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    rows = lambda df: sorted(map(tuple, df.select("k", "v", "w").collect()), key=str)
    for how in ("inner", "left"):
        plain = HotKeys(weighed, ["k"], "n", look=True)
        assert not plain.any and rows(plain.join(many, one, ["v"], how=how)) == rows(HotKeys(weighed, ["k"], "n").join(many, one, ["v"], how=how))
    text = plain.join(many, one, ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" not in text
    hot = HotKeys(weighed, ["k"], "n", total=300, look=True)
    assert hot.any and rows(hot.join(many, one, ["v"])) == rows(many.join(one, "k"))


def test_intermediate_tables_have_few_files(spark):
    """On a local file system every file and folder takes a process of the executor, so none is made that nobody reads."""
    space, held = Workspace(spark, "test"), {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    edges = [(i, i - 1) for i in range(1, 40)] + [(1000 + i, 1000) for i in range(1, 400)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        whole = space.written(spark.range(5000).repartition(60), "whole")
        few = space.written(spark.range(5000).repartition(60), "few", few=True)
        comp = components(spark.createDataFrame(edges, "a long, b long"), space, "c")
        assert whole.count() == few.count() == 5000 and few.agg(F.sum("id")).first()[0] == 5000 * 4999 // 2
        assert {r.node: r.component for r in comp.collect()} == {a: 0 if a < 1000 else 1000 for a, _ in edges}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {t.name: [f.name for f in t.iterdir() if not (f.name.startswith("part-") and f.name.endswith(".parquet"))] for t in Path(space.path.removeprefix("file://")).iterdir()}
    assert {"whole", "few"} < set(files) and not any(files.values())
    counts = {t: len(list(Path(space.path.removeprefix("file://"), t).iterdir())) for t in files}
    assert counts["whole"] == 60 and all(n <= 24 for t, n in counts.items() if t != "whole")


def test_a_damaged_intermediate_table_is_not_read(spark):
    space = Workspace(spark, "test")
    table = space.written(spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("v")).coalesce(1), "t")
    assert table.filter("length(v) = 64").count() == 5000
    (path,) = Path(space.path.removeprefix("file://"), "t").iterdir()
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        table.agg(F.max("v")).collect()
