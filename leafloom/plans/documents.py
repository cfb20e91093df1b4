"""Queries on documents: search, text, pages, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions import geometry
from leafloom.operators import layout, pages, search
from leafloom.session import spread, table

TOK = """
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
wd AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS w, generate_subscripts(string_split(line, ' '), 1) AS k FROM ln),
pl AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_off FROM wd),
tok AS (SELECT doc_id, (line_no // 50 + 1)::INTEGER AS page, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k) - 1 AS tok_no, char_off::BIGINT AS char_off, w AS text,
        72.0::DOUBLE + 6 * char_off AS x, 760.0::DOUBLE - 12 * (line_no % 50) AS y, (6.0 * length(w))::DOUBLE AS width, 10.0::DOUBLE AS height FROM pl WHERE w <> '')"""

PHRASES = ("the", "and the", "of the", "tion", "Licensed under", "All rights reserved.", "no such phrase")
SEARCHES = {"find_contains": ("the", "contains", False), "find_starts_with": ("con", "starts-with", False), "find_ends_with": ("ing", "suffix", False), "find_whole_word": ("the", "whole_word", False), "find_case_sensitive": ("The", "word", True)}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.tokens(spread(_docs(spark, sf_dir).select("doc_id", "text")))


def _search(phrase: str, mode: str, case: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from leafloom.functions.text import count_matches

        n = count_matches(F.col("text"), phrase, mode, case)
        hits = _docs(spark, sf_dir).select("lang", n.cast("long").alias("n")).filter("n > 0")
        return hits.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_matches"))

    return query


def _search_oracle(phrase: str, mode: str, case: bool) -> str:
    from leafloom.functions.text import phrase_pattern

    return f"""SELECT lang, count(*) AS n_docs, sum(n)::BIGINT AS n_matches
FROM (SELECT lang, len(regexp_extract_all(text, '{phrase_pattern(phrase, mode, case)}')) AS n FROM documents) WHERE n > 0 GROUP BY lang"""


def find_multi_phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and occurrences of several phrases in one pass."""
    return search.find_each(_docs(spark, sf_dir), PHRASES)


def find_match_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of every whole word ``the``."""
    return search.match_rects(spread(_docs(spark, sf_dir).select("doc_id", "text")), "the", "word", True)


def replace_all_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements in every document and the new text's hash."""
    new = search.replace_all(_docs(spark, sf_dir), "the", "THE")
    return new.filter("n_replaced > 0").select("doc_id", "n_replaced", F.sha2("text", 256).alias("new_sha256"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text in reading order."""
    own = layout.marks(spread(_docs(spark, sf_dir).select("doc_id", "text")))
    return layout.page_texts(own).select("doc_id", "page", "n_tokens", F.sha2("page_text", 256).alias("text_sha256"))


def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every document: number, box, rotation, and the tokens on it."""
    own = layout.marks(spread(_docs(spark, sf_dir).select("doc_id", "text")))
    box = {"x": F.lit(0.0), "y": F.lit(0.0), "width": F.lit(layout.PAGE_WIDTH), "height": F.lit(layout.PAGE_HEIGHT)}
    return own.select("doc_id", "page", F.size("marks").cast("long").alias("n_tokens")).withColumns(box).withColumn("rotation", F.lit(0))


def rotation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page fractions shown under each rotation, and back."""
    grid = spark.range(0, 100).select(F.floor(F.col("id") / 25).alias("q"), (F.floor(F.col("id") / 5) % 5).alias("a"), (F.col("id") % 5).alias("b"))
    at = grid.select((F.col("q") * 90).cast("int").alias("rotation"), (F.col("a") / 4).alias("fx"), (F.col("b") / 4).alias("fy"))
    u, v = geometry.to_display(F.col("fx"), F.col("fy"), F.col("rotation"))
    shown = at.withColumns({"u": u, "v": v})
    x, y = geometry.to_page(F.col("u"), F.col("v"), F.col("rotation"))
    return shown.withColumns({"back_x": x, "back_y": y})


def arrange_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations in the order third, first, first."""
    talks = table(spark, sf_dir, "conversations").withColumn("page", (F.col("turn") + 1).cast("int")).select("conv_id", "page", "role", "text")
    short = pages.check_order(talks, [3, 1, 1], "conv_id", "page")
    return pages.arranged(talks.join(short, "conv_id", "left_anti"), [3, 1, 1], "conv_id", "page").select("conv_id", "page", "source_page", "role", F.length("text").alias("n_chars"))


def rotate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages turned by 450 degrees, the second of each document only."""
    own = layout.pages(_docs(spark, sf_dir).select("doc_id", "text")).withColumn("rotation", F.lit(270))
    return pages.rotated(own, 450, [2]).select("doc_id", "page", "rotation")


def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each source's documents after one another: the user turns, then the others."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return pages.merged([talks.filter("role = 'user'"), talks.filter("role <> 'user'")], "conv_id", "turn").select("conv_id", "part", "turn", "out_page", F.length("text").alias("n_chars"))


def bates_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive labels over all pages of all documents."""
    own = layout.pages(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "page")
    return pages.numbered(own, ["doc_id", "page"], "DOC", "-X", 100, 4)


def bates_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last label."""
    return pages.label_ends(bates_numbers(spark, sf_dir))


QUERIES = {name: _search(*a) for name, a in SEARCHES.items()} | {
    f.__name__: f for f in (find_multi_phrase_counts, find_match_rects, replace_all_count, page_text, page_info, rotation_map, arrange_pages, rotate_pages, merge_documents, bates_numbers, bates_first_last)
}

_BATES = """SELECT doc_id, page, seq, 'DOC' || CASE WHEN length(seq::VARCHAR) < 4 THEN lpad(seq::VARCHAR, 4, '0') ELSE seq::VARCHAR END || '-X' AS label
FROM (SELECT doc_id, page, row_number() OVER (ORDER BY doc_id, page) + 99 AS seq
      FROM (SELECT doc_id, unnest(range(1, (len(string_split(text, chr(10))) + 49) // 50 + 1))::INTEGER AS page FROM documents))"""

ORACLES = {name: _search_oracle(*a) for name, a in SEARCHES.items()} | {
    "find_multi_phrase_counts": "SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in PHRASES) + ") AS p(phrase) JOIN LATERAL (SELECT count(*) AS n_docs, sum((length(text) - length(replace(text, phrase, ''))) // length(phrase))::BIGINT AS n_matches FROM documents WHERE contains(text, phrase)) ON n_docs > 0",
    "find_match_rects": r"""
WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
r AS (SELECT *, regexp_split_to_array(line, '\bthe\b') AS s FROM ln WHERE regexp_matches(line, '\bthe\b')),
m AS (SELECT doc_id, line_no, unnest(range(1, len(s))) AS k, s FROM r)
SELECT doc_id, (line_no // 50 + 1)::INTEGER AS page, 'the' AS text, 72.0::DOUBLE + 6 * (list_sum(list_transform(s[1:k], lambda x: length(x))) + 3 * (k - 1)) AS x,
       760.0::DOUBLE - 12 * (line_no % 50) AS y, 18.0::DOUBLE AS width, 10.0::DOUBLE AS height FROM m""",
    "replace_all_count": "SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n_replaced, sha256(replace(text, 'the', 'THE')) AS new_sha256 FROM documents WHERE contains(text, 'the')",
    "page_text": f"""WITH {TOK},
l AS (SELECT doc_id, page, line_no, count(*) AS n, string_agg(text, ' ' ORDER BY tok_no) AS s FROM tok GROUP BY ALL)
SELECT doc_id, page, sum(n)::BIGINT AS n_tokens, sha256(string_agg(s, chr(10) ORDER BY line_no)) AS text_sha256 FROM l GROUP BY doc_id, page""",
    "page_info": f"""WITH {TOK},
p AS (SELECT doc_id, unnest(range(1, (len(string_split(text, chr(10))) + 49) // 50 + 1))::INTEGER AS page FROM documents),
n AS (SELECT doc_id, page, count(*) AS n_tokens FROM tok GROUP BY ALL)
SELECT doc_id, page, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, coalesce(n_tokens, 0) AS n_tokens, 0 AS rotation FROM p LEFT JOIN n USING (doc_id, page)""",
    "rotation_map": """
WITH g AS (SELECT (id // 25 * 90)::INTEGER AS rotation, (id // 5 % 5) / 4 AS fx, (id % 5) / 4 AS fy FROM range(100) t(id)),
s AS (SELECT *, CASE rotation WHEN 90 THEN fy WHEN 180 THEN 1 - fx WHEN 270 THEN 1 - fy ELSE fx END AS u, CASE rotation WHEN 90 THEN fx WHEN 180 THEN fy WHEN 270 THEN 1 - fx ELSE 1 - fy END AS v FROM g)
SELECT *, fx AS back_x, fy AS back_y FROM s""",
    "arrange_pages": """
WITH t AS (SELECT conv_id, turn + 1 AS page, role, length(text) AS n_chars FROM conversations),
o AS (SELECT * FROM (VALUES (1, 3), (2, 1), (3, 1)) AS o(place, source_page))
SELECT conv_id, place AS page, source_page, role, n_chars::INTEGER AS n_chars FROM o JOIN t ON t.page = source_page
WHERE conv_id IN (SELECT conv_id FROM t GROUP BY conv_id HAVING max(page) >= 3)""",
    "rotate_pages": "SELECT doc_id, page, CASE WHEN page = 2 THEN 0 ELSE 270 END AS rotation FROM (SELECT doc_id, unnest(range(1, (len(string_split(text, chr(10))) + 49) // 50 + 1))::INTEGER AS page FROM documents)",
    "merge_documents": "SELECT conv_id, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS part, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'user', turn)::INTEGER AS out_page, length(text)::INTEGER AS n_chars FROM conversations",
    "bates_numbers": _BATES,
    "bates_first_last": f"SELECT count(*) AS n, arg_min(label, seq) AS first_label, arg_max(label, seq) AS last_label FROM ({_BATES})",
}
