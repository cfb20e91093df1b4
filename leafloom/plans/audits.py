"""Queries on regions of documents: audits, redaction, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.operators import layout, search, spatial
from leafloom.plans.documents import TOK, _docs, _tok
from leafloom.session import table

#: Regions: every token ``of``, padded so that it overlaps its neighbours; and a band across every page.
REGIONS = f"""{TOK},
reg AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page, y - 1 DESC, x - 13, width + 26, height + 2) - 1 AS region_no, x - 13 AS rx, y - 1 AS ry, width + 26 AS rw, height + 2 AS rh FROM tok WHERE text = 'of'),
hit AS (SELECT r.*, t.line_no, t.tok_no, t.text, t.x, t.y, t.width, t.height FROM reg r JOIN tok t ON r.doc_id = t.doc_id AND r.page = t.page AND r.rx < t.x + t.width AND t.x < r.rx + r.rw AND r.ry < t.y + t.height AND t.y < r.ry + r.rh)"""


def _regions(tok: DataFrame) -> DataFrame:
    own = tok.filter("text = 'of'").select("doc_id", "page", (F.col("x") - 13).alias("x"), (F.col("y") - 1).alias("y"), (F.col("width") + 26).alias("width"), (F.col("height") + 2).alias("height"))
    return spatial.numbered(own)


def audit_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every region, the tokens it overlaps and the text whose centre it holds."""
    tok = _tok(spark, sf_dir)
    return spatial.audit_regions(_regions(tok), tok)


def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every page with regions, the tokens that any of them overlaps."""
    tok = _tok(spark, sf_dir)
    return spatial.audit_pages(_regions(tok), tok)


def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of every document."""
    tok = _tok(spark, sf_dir)
    return spatial.audit_totals(_regions(tok), tok)


def region_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text in a band across each page's upper part."""
    own = layout.pages(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "page", F.lit(70.0).alias("x"), F.lit(735.0).alias("y"), F.lit(300.0).alias("width"), F.lit(40.0).alias("height"))
    return spatial.region_text(spatial.numbered(own), _tok(spark, sf_dir)).select("doc_id", "page", F.sha2("region_text", 256).alias("text_sha256"), F.length("region_text").alias("n_chars"))


def surviving_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every page that no region overlaps."""
    tok = _tok(spark, sf_dir)
    return spatial.missed_tokens(_regions(tok), tok).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("width").alias("width"))


def swept_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of tokens that the regions cover."""
    tok = _tok(spark, sf_dir)
    parts = spatial.swept(_regions(tok), tok)
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.col("width") * F.col("height")).alias("area"))


def nearest_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token nearest to three points of each page."""
    points = ((0, 100.0, 700.0), (1, 400.0, 100.0), (2, 71.0, 765.0))
    own = layout.pages(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "page", F.explode(F.array(*[F.struct(F.lit(k).alias("point_no"), F.lit(x).alias("px"), F.lit(y).alias("py")) for k, x, y in points])).alias("p")).select("doc_id", "page", "p.*")
    return spatial.nearest_token(own, _tok(spark, sf_dir)).select("doc_id", "page", "point_no", "score", "text")


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole word ``the`` masked, with the hashes before and after."""
    docs = _docs(spark, sf_dir)
    masked = F.regexp_replace("text", r"\bthe\b", "███")
    return docs.filter(F.col("text").rlike(r"\bthe\b")).select("doc_id", F.sha2("text", 256).alias("before"), F.sha2(masked, 256).alias("after"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tok(spark, sf_dir).filter(F.col("text").isin("the", "of", "and", "de", "la", "der")).select("doc_id", "page", "x", "y", "width", "height")


def box_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of frequent words, neighbours merged."""
    return spatial.merged_lines(_boxes(spark, sf_dir))


def box_merge_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by pairwise folding, which also holds for boxes of mixed heights."""
    return spatial.merged_boxes(_boxes(spark, sf_dir).withColumn("seq", F.col("x") - 1000 * F.col("y")), "seq")


def box_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged boxes widened to the grid."""
    return spatial.prepared(_boxes(spark, sf_dir), layout.pages(_docs(spark, sf_dir).select("doc_id", "text")), 2)


def box_full_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged boxes widened to the line."""
    return spatial.prepared(_boxes(spark, sf_dir), layout.pages(_docs(spark, sf_dir).select("doc_id", "text")), 3)


def match_insets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches drawn in a little before replacement, summed over each document."""
    rects = search.match_rects(_docs(spark, sf_dir), "the", "word", True)
    small = rects.withColumns(search.inset(F.col("x"), F.col("y"), F.col("width"), F.col("height")))
    return small.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("width"), 3).alias("width"))


def dominant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's most frequent kind of event; of several the one seen first; its greatest value."""
    events = table(spark, sf_dir, "events")
    return spatial.dominant(events, "user_id", "event_type", F.col("event_id"), F.col("value"))


QUERIES = {f.__name__: f for f in (audit_region, audit_page, audit_totals, region_text, surviving_tokens, swept_areas, nearest_tokens, redact_text, box_merge, box_merge_any, box_quantize, box_full_line, match_insets, dominant_value)}

_MERGE = f"""{TOK},
bx AS (SELECT doc_id, page, x, y, width, height FROM tok WHERE text IN ('the', 'of', 'and', 'de', 'la', 'der')),
st AS (SELECT *, CASE WHEN x - max(x + width) OVER (PARTITION BY doc_id, page, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 15 THEN 0 ELSE 1 END AS fresh FROM bx),
il AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS island FROM st),
mg AS (SELECT doc_id, page, min(x) AS x, y, max(x + width) - min(x) AS width, height, count(*) AS merged FROM il GROUP BY doc_id, page, y, height, island)"""

ORACLES = {
    "audit_region": f"""WITH {REGIONS},
a AS (SELECT doc_id, page, region_no, count(*) AS text_runs, count(*) FILTER (x + width / 2 BETWEEN rx AND rx + rw AND y + height / 2 BETWEEN ry AND ry + rh) AS centre_hits,
  coalesce(string_agg(text, ' ' ORDER BY y DESC, x) FILTER (x + width / 2 BETWEEN rx AND rx + rw AND y + height / 2 BETWEEN ry AND ry + rh), '') AS region_text FROM hit GROUP BY ALL)
SELECT r.doc_id, r.page, r.region_no::INTEGER AS region_no, coalesce(text_runs, 0) AS text_runs, coalesce(centre_hits, 0) AS centre_hits, coalesce(region_text, '') AS region_text FROM reg r LEFT JOIN a USING (doc_id, page, region_no)""",
    "audit_page": f"""WITH {REGIONS},
d AS (SELECT DISTINCT doc_id, page, line_no, tok_no FROM hit), n AS (SELECT doc_id, page, count(*) AS text_runs FROM d GROUP BY ALL)
SELECT doc_id, page, regions, coalesce(text_runs, 0) AS text_runs FROM (SELECT doc_id, page, count(*) AS regions FROM reg GROUP BY ALL) LEFT JOIN n USING (doc_id, page)""",
    "audit_totals": f"""WITH {REGIONS},
d AS (SELECT DISTINCT doc_id, page, line_no, tok_no FROM hit), n AS (SELECT doc_id, count(*) AS text_runs FROM d GROUP BY ALL)
SELECT doc_id, regions, pages_affected, coalesce(text_runs, 0) AS text_runs FROM (SELECT doc_id, count(*) AS regions, count(DISTINCT page) AS pages_affected FROM reg GROUP BY ALL) LEFT JOIN n USING (doc_id)""",
    "region_text": f"""WITH {TOK},
h AS (SELECT * FROM tok WHERE x + width / 2 BETWEEN 70 AND 370 AND y + height / 2 BETWEEN 735 AND 775 AND x < 370 AND x + width > 70 AND y < 775 AND y + height > 735),
l AS (SELECT doc_id, page, y, string_agg(text, ' ' ORDER BY x) AS s FROM h GROUP BY ALL),
p AS (SELECT doc_id, page, string_agg(s, chr(10) ORDER BY y DESC) AS s FROM l GROUP BY ALL)
SELECT doc_id, page, sha256(s) AS text_sha256, length(s)::INTEGER AS n_chars FROM p""",
    "surviving_tokens": f"""WITH {REGIONS}
SELECT doc_id, page, count(*) AS n_tokens, sum(width) AS width FROM tok ANTI JOIN hit USING (doc_id, page, line_no, tok_no) GROUP BY ALL""",
    "swept_areas": f"""WITH {REGIONS}
SELECT doc_id, count(*) AS parts, sum((least(rx + rw, x + width) - greatest(rx, x)) * (least(ry + rh, y + height) - greatest(ry, y))) AS area FROM hit GROUP BY doc_id""",
    "nearest_tokens": f"""WITH {TOK}, p AS (SELECT * FROM (VALUES (0, 100.0::DOUBLE, 700.0::DOUBLE), (1, 400.0, 100.0), (2, 71.0, 765.0)) AS p(point_no, px, py)),
s AS (SELECT doc_id, page, point_no, greatest(0, y - py, py - (y + height)) * 1000 + greatest(0, x - px, px - (x + width)) AS score, line_no, tok_no, text FROM tok, p)
SELECT doc_id, page, point_no, score, text FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, page, point_no ORDER BY score, line_no, tok_no) = 1""",
    "redact_text": r"SELECT doc_id, sha256(text) AS before, sha256(regexp_replace(text, '\bthe\b', '███', 'g')) AS after FROM documents WHERE regexp_matches(text, '\bthe\b')",
    "box_merge": f"WITH {_MERGE} SELECT * FROM mg",
    "box_merge_any": f"WITH {_MERGE} SELECT doc_id, page, x, y, width, height FROM mg",
    "box_quantize": f"""WITH {_MERGE}, q AS (SELECT *, least(greatest(ceil((width + 36) / 72) * 72, width), greatest(width, 612)) AS w FROM mg)
SELECT doc_id, page, least(greatest(least(x, 612 - w), 0), x) AS x, y, w AS width, height FROM q""",
    "box_full_line": f"WITH {_MERGE} SELECT doc_id, page, 18.0::DOUBLE AS x, y, 576.0::DOUBLE AS width, height FROM mg",
    "match_insets": r"SELECT doc_id, count(*) AS n, round(count(*) * 17.6::DOUBLE, 3) AS width FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\bthe\b')) AS m FROM documents) GROUP BY doc_id",
    "dominant_value": """SELECT user_id, event_type, n, size FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f, round(max(value), 2) AS size FROM events GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""",
}
