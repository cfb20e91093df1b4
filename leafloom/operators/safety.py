"""Active and hidden content of web pages: counts, samples, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators.links import HREF

SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script\s*>"
HANDLER = r"(?i)\son[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*')"
SAMPLES = 12
#: What each kind of hidden content is found by.
HIDDEN = {"metadata": r"(?i)<meta\b", "attachments": r"(?i)<(?:object|embed|iframe)\b", "comments": r"(?s)<!--.*?-->", "bookmarks": r"(?i)<a\b[^>]*\bname\s*=", "layers": r"(?i)display\s*:\s*none"}


def _hits(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(pattern))


def scan(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, scripts (with handlers), links, at most 12 distinct samples in order, and what they mean."""
    html = F.col(html_col)
    scripts, handlers = F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1)), _hits(html, HANDLER)
    targets = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    samples = F.slice(F.array_distinct(F.concat(F.transform(scripts, lambda s: T.sample(s)), targets)), 1, SAMPLES)
    out = pages.select(F.col(id_col).alias("page_id"), (F.size(scripts) + handlers).alias("js_count"), F.size(targets).alias("url_count"), samples.alias("samples"))
    return out.withColumns({"has_js": F.col("js_count") > 0, "has_urls": F.col("url_count") > 0, "is_clean": (F.col("js_count") + F.col("url_count")) == 0})


def scripts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, seq, origin, source of every script element and then every handler."""
    one = lambda pattern, origin: F.transform(F.regexp_extract_all(html_col, F.lit(pattern), F.lit(1)), lambda s: F.struct(F.lit(origin).alias("origin"), s.alias("source")))
    found = pages.select(F.col(id_col).alias("page_id"), F.posexplode(F.concat(one(SCRIPT, "element"), one(HANDLER, "handler"))).alias("seq", "s"))
    return found.select("page_id", "seq", "s.origin", "s.source")


def stripped(pages: DataFrame, javascript: bool = True, urls: bool = True, html_col: str = "html") -> DataFrame:
    """The pages without scripts and handlers and/or without outward targets; targets within the site stay."""
    html = F.col(html_col)
    if javascript:
        html = F.regexp_replace(F.regexp_replace(html, SCRIPT, ""), HANDLER, "")
    if urls:
        html = F.regexp_replace(html, r"(?i)\shref\s*=\s*[\"'](?:[a-z][a-z0-9+.-]*:|//)[^\"']*[\"']", "")
    return pages.withColumn(html_col, html)


def hidden_report(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, a count for each kind of hidden content, scripts and links, and whether there is any."""
    html = F.col(html_col)
    counts = {k: _hits(html, p) for k, p in HIDDEN.items()} | {"scripts_and_actions": _hits(html, SCRIPT) + _hits(html, HANDLER) + _hits(html, HREF)}
    out = pages.select(F.col(id_col).alias("page_id"), *[v.alias(k) for k, v in counts.items()])
    return out.withColumn("has_any", F.greatest(*counts) > 0)


def sanitized(pages: DataFrame, metadata: bool = True, comments: bool = True, scripts: bool = True, html_col: str = "html") -> DataFrame:
    """The pages without the kinds of hidden content chosen; scripts go first."""
    out = stripped(pages, html_col=html_col) if scripts else pages
    html = F.col(html_col)
    if metadata:
        html = F.regexp_replace(html, r"(?i)<meta\b[^>]*>", "")
    if comments:
        html = F.regexp_replace(html, HIDDEN["comments"], "")
    return out.withColumn(html_col, html)


def tag_census(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """tag, number of occurrences, number of pages."""
    names = F.transform(F.regexp_extract_all(html_col, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)
    found = pages.select(F.explode(F.transform(F.array_distinct(names), lambda t: F.struct(t.alias("tag"), F.size(F.filter(names, lambda n: n == t)).alias("n")))).alias("x"))
    return found.groupBy("x.tag").agg(F.sum("x.n").alias("occurrences"), F.count(F.lit(1)).alias("pages"))


def upserted(table: DataFrame, changes: DataFrame, key: str = "name") -> DataFrame:
    """Rows replaced or added by key; of several changes to a key the last by ``seq`` counts."""
    last = changes.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.col("seq").desc()))).filter("_k = 1").drop("_k", "seq")
    return table.join(last.select(key), key, "left_anti").unionByName(last.select(*table.columns))


def deleted(table: DataFrame, keys: DataFrame, key: str = "name") -> DataFrame:
    """Rows without those keys; unknown keys are ignored."""
    return table.join(keys.select(key), key, "left_anti")
