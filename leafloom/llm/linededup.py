"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A text's lines are hashed, and a rolling hash runs over every two of them. A
chunk ends after a line whose rolling hash is less than that of its
neighbours, so a passage is cut alike wherever it stands, insertions
elsewhere do not shift its chunks, and a chunk has two lines at least. A line
of more than ``PASSAGE_WORDS`` words is a passage, and so a chunk, by itself.
One short line between two such lines, or between one and the text's edge, is
all that is left for a chunk of its own; it and chunks with fewer than two
lines that hold a word are never removed for themselves.

Chunks that occur again anywhere in the table are removed from all places but
the first, by document id and position, with those lines right before and
after them that equal, one by one, the lines next to the first occurrence, as
far as its neighbouring chunks go. So a repeated passage goes to its edges,
where its chunks straddle them, and every removed line still stands where it
came first.

1. Chunk hashes are counted: no text is shuffled for that. 2. Documents get
the numbers of their chunks whose hash is repeated, and give the bytes of
those chunks only. 3. A partial aggregate on (hash, bytes) finds the first
place, so a chunk that holds a third of all rows leaves each task as one row;
every removal is a match of bytes. Occurrences of very common hashes are dealt
to parts (``HotKeys``), so no join meets a hot key. 4. Documents get back line numbers.

A passage of short lines that holds no whole chunk stays. With ``run_words``
(such as ``PASSAGE_WORDS``) ``dedup_lines`` also looks at every pair of
neighbouring lines (blank ones between them belong to it), by 128 bits of its
SHA-256; pairs that occur earlier, joined where they overlap, make up runs,
and runs of more words than that are removed too.

Defined results: a null text stays null; an empty one stays empty; rows
equal in id and text count as one document and get the same result; rows
with the same id and other texts are documents of their own, ordered by the
texts' hashes; null ids come first; other columns pass through, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.shared import HotKeys, Workspace, documents

PASSAGE_WORDS = 50
_SPACE = " \\t\\n\\x0B\\f\\r"
_WORD = f"[^{_SPACE}]+"
#: The rolling hash: the hash of the line before times the factor plus that of the line, modulo a prime.
_FACTOR, _PRIME = 65599, 4294967291
_HASH = "_ll_text_hash"


def line_hash(line: Column) -> Column:
    """32 bits of the line's MD5, as a long."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunks(text: Column, passage_words: int = PASSAGE_WORDS) -> Column:
    """array<struct<no, line, n_lines, body, whole>>: the text's chunks in order; joined by line feeds they give the text.

    ``whole`` tells whether the chunk may be removed if it is repeated.
    """
    words = lambda line: F.regexp_count(line, F.lit(_WORD))
    lines = F.transform(F.split(text, "\n"), lambda t: F.struct(t.alias("t"), words(t).alias("w"), line_hash(t).alias("h")))

    def rolled(state: Column) -> Column:
        before = lambda i: F.coalesce(F.get(state, i - 1)["h"], F.lit(0))
        return F.transform(state, lambda x, i: F.pmod(before(i) * _FACTOR + x.h, F.lit(_PRIME)))

    def ends(state: Column) -> Column:
        n = F.size(state.lines)
        r = lambda i: F.get(state.rolled, i - 1)
        is_long = lambda i: F.get(state.lines, i - 1)["w"] > passage_words
        least = lambda i: (r(i) < r(i - 1)) & (r(i) <= r(i + 1)) & ~(is_long(i - 1) | is_long(i) | is_long(i + 1) | is_long(i + 2))
        return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | is_long(i) | is_long(i + 1) | F.coalesce((i > 1) & (i < n - 1) & least(i), F.lit(False)))

    def cut(state: Column) -> Column:
        def chunk(end: Column, k: Column) -> Column:
            begin = F.coalesce(F.get(state.ends, k - 1), F.lit(0)) + 1
            part = F.slice(state.lines, begin, end - begin + 1)
            whole = F.when(end == begin, F.get(state.lines, end - 1)["w"] > passage_words).otherwise(F.size(F.filter(part, lambda x: x.w > 0)) > 1)
            return F.struct((k + 1).alias("no"), begin.alias("line"), (end - begin + 1).alias("n_lines"), F.array_join(F.transform(part, lambda x: x.t), "\n").alias("body"), whole.alias("whole"))

        return F.transform(state.ends, chunk)

    # one-element arrays bind what is used often, so that it is computed once a row
    bound = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), rolled(x).alias("rolled")))
    bound = F.transform(bound, lambda s: F.struct(s.lines.alias("lines"), ends(s).alias("ends")))
    return F.element_at(F.transform(bound, cut), 1)


def windows(text: Column) -> Column:
    """array<struct<no, first, last, key>>: each line with a word and the next such line, by line numbers, and the hash of all between."""
    lines = F.split(text, "\n")

    def pairs(state: Column) -> Column:
        at = lambda k: F.element_at(state.full, k)
        body = lambda k: F.array_join(F.slice(state.lines, at(k), at(k + 1) - at(k) + 1), "\n")
        key = lambda k: F.substring(F.unhex(F.sha2(body(k), 256)), 1, 16)
        numbers = F.filter(F.sequence(F.lit(1), F.greatest(F.size(state.full) - 1, F.lit(1))), lambda k: k < F.size(state.full))
        return F.transform(numbers, lambda k: F.struct(k.alias("no"), at(k).alias("first"), at(k + 1).alias("last"), key(k).alias("key")))

    full = lambda x: F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: F.element_at(x, i).rlike(f"[^{_SPACE}]"))
    bound = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), full(x).alias("full")))
    return F.element_at(F.transform(bound, pairs), 1)


def _joined(docs: DataFrame, by_doc: DataFrame, id_col: str, how: str) -> DataFrame:
    """Documents with what was gathered for them under ``_ll_id`` and ``_ll_hash``."""
    same = docs[id_col].eqNullSafe(by_doc["_ll_id"]) & (docs[_HASH] == by_doc["_ll_hash"])
    return docs.join(by_doc, same, how).drop("_ll_id", "_ll_hash")


def _same_lines(own: Column, first: Column, from_end: bool) -> Column:
    """How many lines at the start, or at the end, of two texts are equal one by one; 0 if either is null."""
    turned = (lambda x: F.reverse(F.split(x, "\n"))) if from_end else (lambda x: F.split(x, "\n"))
    equal = F.zip_with(turned(own), turned(first), lambda a, b: a.eqNullSafe(b))
    at = F.array_position(equal, F.lit(False)).cast("int")
    return F.coalesce(F.when(at > 0, at - 1).otherwise(F.size(equal)), F.lit(0))


def _later(docs: DataFrame, id_col: str, text_col: str, passage_words: int) -> DataFrame:
    """_ll_id, _ll_hash, no, first, last: the lines to remove for each chunk that occurred before."""
    ids = [F.col(id_col).alias("_ll_id"), F.col(_HASH).alias("_ll_hash")]
    place = F.struct("_ll_id", "_ll_hash", "no")
    cut = chunks(F.col(text_col), passage_words)
    spread = (
        docs.filter(F.col(text_col).isNotNull())
        .select(*ids, F.explode(F.transform(F.filter(cut, lambda c: c.whole), lambda c: F.struct(c.no.alias("no"), F.xxhash64(c.body).alias("h")))).alias("c"))
        .select("_ll_id", "_ll_hash", "c.no", "c.h")
    )
    space = Workspace(docs.sparkSession, "lines")
    repeated = space.written(spread.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("origin")).filter("n > 1"), "repeated", few=True)
    hot, ids_only = HotKeys(repeated, ["h"], "n"), ["_ll_id", "_ll_hash"]
    named = hot.join(spread, repeated.drop("n"), ids_only).select("_ll_id", "_ll_hash", "no", place.eqNullSafe(F.col("origin")).alias("is_first"))
    lists = named.groupBy("_ll_id", "_ll_hash").agg(F.array_sort(F.collect_set(F.struct("no", "is_first"))).alias("_ll_named"))

    def given(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            c = F.get(s.c, x.no - 1)
            # the list is in order, so a neighbour that is named too stands beside
            beside = lambda k: F.when(x.is_first | ~F.coalesce(F.get(s.named, i + k)["no"] == x.no + k, F.lit(False)), F.get(s.c, x.no - 1 + k)["body"])
            return F.struct(x.no.alias("no"), c.line.alias("line"), c.n_lines.alias("n_lines"), c.body.alias("body"), x.is_first.alias("is_first"), beside(-1).alias("before"), beside(1).alias("after"))

        return F.transform(s.named, one)

    bound = F.transform(F.array(cut), lambda c: F.struct(c.alias("c"), F.col("_ll_named").alias("named")))
    found = _joined(docs, lists, id_col, "inner").select(*ids, F.explode(F.element_at(F.transform(bound, given), 1)).alias("c")).select("_ll_id", "_ll_hash", "c.*").withColumn("h", F.xxhash64("body"))
    beside = [F.when(F.col("is_first"), F.col(c)).alias(f"{c}_first") for c in ("before", "after")]
    origin = found.groupBy("h", "body").agg(F.min(F.struct("_ll_id", "_ll_hash", "no", *beside)).alias("origin"))
    both = hot.join(found, origin, ids_only, ["h", "body"]).filter(~place.eqNullSafe(F.struct("origin._ll_id", "origin._ll_hash", "origin.no")))
    more = lambda c, from_end: _same_lines(F.col(c), F.col(f"origin.{c}_first"), from_end)
    return both.select("_ll_id", "_ll_hash", "no", (F.col("line") - more("before", True)).alias("first"), (F.col("line") + F.col("n_lines") - 1 + more("after", False)).alias("last"))


def _later_runs(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """_ll_id, _ll_hash, no, first, last of the longest runs of more words than that whose every pair of lines occurs earlier."""
    ids = ("_ll_id", "_ll_hash")
    place = F.struct(*ids, "no")
    spread = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_ll_id"), F.col(_HASH).alias("_ll_hash"), F.explode(windows(F.col(text_col))).alias("c")).select(*ids, "c.*")
    repeated = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("origin")).filter("n > 1").drop("n")
    later = spread.join(repeated, "key").filter(~place.eqNullSafe(F.col("origin")))
    # rows equal in id and text give equal pairs, which share a rank
    run = F.col("no") - F.dense_rank().over(Window.partitionBy(*ids).orderBy("no"))
    runs = later.withColumn("run", run).groupBy(*ids, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).groupBy(*ids).agg(F.collect_list(F.struct("first", "last")).alias("_ll_runs"))
    text = lambda r: F.array_join(F.slice(F.split(text_col, "\n"), r["first"], r["last"] - r["first"] + 1), "\n")
    long = F.filter("_ll_runs", lambda r: F.regexp_count(text(r), F.lit(_WORD)) > words)
    return _joined(docs, runs, id_col, "inner").select(F.col(id_col).alias("_ll_id"), F.col(_HASH).alias("_ll_hash"), F.explode(long).alias("r")).select(*ids, F.lit(0).alias("no"), "r.first", "r.last")


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_words: int = PASSAGE_WORDS, run_words: int | None = None) -> DataFrame:
    """The rows with ``_ll_lines``, the numbers of the lines that stay, or null where all do, and ``_ll_removed``, the number of chunks removed."""
    docs = df.withColumn(_HASH, F.xxhash64(text_col))
    found = _later(docs, id_col, text_col, passage_words)
    if run_words is not None:
        found = found.unionByName(_later_runs(docs, id_col, text_col, run_words))
    # rows equal in id and text name the same lines
    lists = found.groupBy("_ll_id", "_ll_hash").agg(F.collect_set(F.struct("first", "last")).alias("_ll_cut"), F.collect_set(F.when(F.col("no") > 0, F.col("no"))).alias("_ll_no"))
    gone = F.flatten(F.transform("_ll_cut", lambda r: F.sequence(r["first"], r["last"])))
    stay = F.when(F.col("_ll_cut").isNotNull(), F.array_except(F.sequence(F.lit(1), F.size(F.split(text_col, "\n"))), gone))
    return _joined(docs, lists, id_col, "left").select(*df.columns, stay.alias("_ll_lines"), F.coalesce(F.size("_ll_no"), F.lit(0)).alias("_ll_removed"))


def _kept_text(text_col: str) -> Column:
    """The text without the removed lines; null where none is removed."""
    bound = F.transform(F.array(F.split(text_col, "\n")), lambda x: F.array_join(F.transform("_ll_lines", lambda i: F.get(x, i - 1)), "\n"))
    return F.when(F.col("_ll_lines").isNotNull(), F.element_at(bound, 1))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", drop_emptied: bool = True, passage_words: int = PASSAGE_WORDS, run_words: int | None = None) -> DataFrame:
    """The rows with later occurrences of repeated chunks removed from their texts, and with ``run_words`` those of runs of lines over so many words.

    ``n_chars_col``, where the rows have it, follows the new length. With ``drop_emptied``
    a document goes whose every word has been removed, as its text stands elsewhere.
    """
    new = mark(df, id_col, text_col, passage_words, run_words).withColumn("_ll_kept", _kept_text(text_col))
    touched = F.col("_ll_kept").isNotNull()
    if drop_emptied:
        new = new.filter(~touched | F.col("_ll_kept").rlike(f"[^{_SPACE}]"))
    if n_chars_col in df.columns:
        new = new.withColumn(n_chars_col, F.when(touched, F.char_length("_ll_kept")).otherwise(F.col(n_chars_col)).cast(df.schema[n_chars_col].dataType))
    return new.withColumn(text_col, F.coalesce("_ll_kept", text_col)).select(*df.columns)


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's removed chunks and lines, and the text that stays."""
    marked = mark(documents(spark, sf_dir))
    n_lines = F.size(F.split("text", "\n"))
    return marked.select(
        "doc_id",
        F.col("_ll_removed").cast("long").alias("n_removed"),
        F.coalesce(n_lines - F.size("_ll_lines"), F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce(_kept_text("text"), "text").alias("text"),
    )


QUERIES = {"op5_linededup": op5_linededup}

#: Written over single lines and windows of them, not over arrays as the operator is.
ORACLES = {
    "op5_linededup": rf"""
WITH ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
a AS (SELECT *, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM ls),
b AS (SELECT *, (coalesce(lag(h) OVER d, 0) * {_FACTOR} + h) % {_PRIME} AS r, w > {PASSAGE_WORDS} AS big FROM a WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, i = n OR big OR lead(big) OVER d
        OR (i BETWEEN 2 AND n - 2 AND r < lag(r) OVER d AND r <= lead(r) OVER d AND NOT (lag(big) OVER d OR lead(big) OVER d OR lead(big, 2) OVER d)) AS ends
      FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, count(*) FILTER (ends) OVER (PARTITION BY doc_id ORDER BY i) - ends::INT AS k FROM c),
m AS (SELECT doc_id, k, min(i) AS lo, max(i) AS hi, string_agg(t, chr(10) ORDER BY i) AS body, CASE WHEN count(*) = 1 THEN bool_or(big) ELSE count(*) FILTER (w > 0) > 1 END AS whole FROM k GROUP BY doc_id, k),
o AS (SELECT *, row_number() OVER p AS copy, first(doc_id) OVER p AS doc0, first(k) OVER p AS k0, first(lo) OVER p AS lo0, first(hi) OVER p AS hi0
      FROM m WHERE whole WINDOW p AS (PARTITION BY body ORDER BY doc_id, k)),
later AS (SELECT * FROM o WHERE copy > 1),
-- how many lines of the chunk after, and of the chunk before, equal those of the first occurrence's neighbour
up AS (SELECT l.doc_id, l.k, coalesce(min(x.i) FILTER (y.t IS NULL OR x.t <> y.t), max(x.i) + 1) - l.hi - 1 AS n
       FROM later l JOIN k x ON x.doc_id = l.doc_id AND x.k = l.k + 1 LEFT JOIN k y ON y.doc_id = l.doc0 AND y.k = l.k0 + 1 AND y.i - l.hi0 = x.i - l.hi GROUP BY l.doc_id, l.k, l.hi),
down AS (SELECT l.doc_id, l.k, l.lo - 1 - coalesce(max(x.i) FILTER (y.t IS NULL OR x.t <> y.t), min(x.i) - 1) AS n
       FROM later l JOIN k x ON x.doc_id = l.doc_id AND x.k = l.k - 1 LEFT JOIN k y ON y.doc_id = l.doc0 AND y.k = l.k0 - 1 AND l.lo0 - y.i = l.lo - x.i GROUP BY l.doc_id, l.k, l.lo),
-- a neighbour whose own hash is repeated is judged by itself
named AS (SELECT doc_id, k FROM o QUALIFY count(*) OVER (PARTITION BY body) > 1),
cut AS (SELECT l.doc_id, l.lo - CASE WHEN p.k IS NULL THEN coalesce(down.n, 0) ELSE 0 END AS lo, l.hi + CASE WHEN q.k IS NULL THEN coalesce(up.n, 0) ELSE 0 END AS hi
        FROM later l LEFT JOIN up USING (doc_id, k) LEFT JOIN down USING (doc_id, k)
        LEFT JOIN named p ON p.doc_id = l.doc_id AND p.k = l.k - 1 LEFT JOIN named q ON q.doc_id = l.doc_id AND q.k = l.k + 1),
left_over AS (SELECT doc_id, count(*) AS n, string_agg(t, chr(10) ORDER BY i) AS text FROM ls WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.doc_id = ls.doc_id AND ls.i BETWEEN cut.lo AND cut.hi) GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_removed, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(l.n, 0) END::BIGINT AS n_removed_lines,
       CASE WHEN d.text IS NOT NULL THEN coalesce(l.text, '') END AS text
FROM documents d LEFT JOIN left_over l USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM later GROUP BY doc_id) c USING (doc_id)
"""
}
