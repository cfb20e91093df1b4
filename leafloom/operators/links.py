"""Links of web pages and their ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import urls

HREF = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, link_no, url of every anchor with a target that is not blank."""
    found = pages.select(F.col(id_col).alias("page_id"), F.posexplode(F.regexp_extract_all(html_col, F.lit(HREF), F.lit(1))).alias("link_no", "url"))
    return found.filter(F.trim("url") != "")


def kinds(found: DataFrame) -> DataFrame:
    """The links with their kind: by scheme, or goto for fragments and relative targets."""
    low = F.lower("url")
    kind = F.when(low.startswith("javascript:"), "javascript").when(low.startswith("mailto:"), "mailto").when(low.rlike("^[a-z][a-z0-9+.-]*:"), "uri").when(low.startswith("#"), "goto").otherwise("link")
    return found.withColumn("kind", kind)


def rated(rows: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows with host, level and category of their URL by local rules."""
    return rows.withColumn("host", urls.host_of(F.col(url_col))).withColumn("r", urls.rating(F.col(url_col))).select(*rows.columns, "host", "r.level", "r.category")


def scan_targets(rows: DataFrame, order_col: str, url_col: str = "url", limit: int = 100) -> DataFrame:
    """Distinct URLs, case aside, in the order first seen, at most ``limit``: url, key, seq.

    The limit belongs to the feature: a scan service is asked about no more.
    """
    firsts = rows.groupBy(F.lower(url_col).alias("key")).agg(F.min(F.struct(F.col(order_col).alias("seq"), F.col(url_col).alias("url"))).alias("f"))
    return firsts.select("key", "f.seq", "f.url").orderBy("seq", "key").limit(limit)


def with_verdicts(rows: DataFrame, verdicts: DataFrame, url_col: str = "url") -> DataFrame:
    """Rated rows combined with verdicts (url, malicious): true makes a link red, false confirms its level, none changes nothing.

    Of several verdicts on a URL, case aside, the worst counts.
    """
    known = verdicts.groupBy(F.lower("url").alias("k")).agg(F.max("malicious").alias("malicious"))
    joined = rows.join(known, F.lower(url_col) == F.col("k"), "left")
    bad, seen = F.coalesce("malicious", F.lit(False)), F.col("malicious").isNotNull()
    return joined.select(
        *[c for c in rows.columns if c not in ("level", "category")],
        F.when(bad, "red").otherwise(F.col("level")).alias("level"),
        F.when(bad, "malicious").otherwise(F.col("category")).alias("category"),
        F.when(seen, "scanner").otherwise("heuristic").alias("source"),
    )


def by_host(rows: DataFrame) -> DataFrame:
    """host, level, category and the number of links."""
    return rows.groupBy("host", "level", "category").agg(F.count(F.lit(1)).alias("n"))


def first_per_url(rows: DataFrame, order_col: str, url_col: str = "url") -> DataFrame:
    """The first row of each URL, case aside."""
    order = Window.partitionBy(F.lower(url_col)).orderBy(order_col)
    return rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")
