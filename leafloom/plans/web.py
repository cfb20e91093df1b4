"""Queries on web pages: links, ratings, active and hidden content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions import urls
from leafloom.operators import links, safety
from leafloom.session import table

#: URLs that reach every branch of the rating.
SAMPLES = (
    "https://www.google.com/x", "https://en.wikipedia.org/wiki/A", "https://www.irs.gov/", "http://mit.edu", "https://github.com/a/b", "https://gist.github.com/a", "https://dropbox.com/s", "https://drive.google.com/f",
    "https://bit.ly/x", "https://t.co/y", "http://evil.xyz/", "http://a.b.tk/z", "javascript:alert(1)", "FILE:///etc/passwd", "data:text/html,x", "https://example.com/", "HTTP://WWW.GOOGLE.COM", "not a url", "", "https://notgoogle.com/",
    "https://user@github.com:443/a.pdf", "http://localhost/a.pdf", "http://127.0.0.1/a.pdf", "http://10.1.2.3/a.pdf", "http://172.16.0.1/a.pdf", "http://172.32.0.1/a.PDF", "http://192.168.1.1/a.pdf", "http://169.254.169.254/a.pdf", "https://example.com/a.pdf?x=1", "https://example.com/a.pdfx", "ftp://example.com/a.pdf", "http://[::1]/a.pdf", "http://[fd00::1]/a.pdf", "file:///home/a.pdf",
)
_VALUES = "(VALUES " + ", ".join(f"({i}, '{u}')" for i, u in enumerate(SAMPLES)) + ") AS t(seq, url)"
#: What a scanner said: (end of the URL's host, malicious).
_VERDICTS = "(VALUES ('https://bit.ly/x', true), ('https://BIT.ly/X', false), ('https://example.com/', false), ('https://github.com/a/b', true)) AS v(url, malicious)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _pages(spark, sf_dir).select((F.col("page_id") + 1000).alias("seq"), "url")
    return spark.sql(f"SELECT CAST(seq AS LONG) AS seq, url FROM {_VALUES}").unionAll(own)


def list_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page."""
    return links.links(_pages(spark, sf_dir))


def link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by kind."""
    return links.kinds(links.links(_pages(spark, sf_dir))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))


def url_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, level and category of page URLs and of samples for every rule."""
    return links.rated(_sampled(spark, sf_dir))


def url_verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings combined with a scanner's verdicts on the first hundred distinct URLs."""
    rows = _sampled(spark, sf_dir)
    asked = links.scan_targets(rows, "seq")
    told = spark.sql(f"SELECT * FROM {_VERDICTS}").join(asked.select("key"), F.lower("url") == F.col("key"), "left_semi")
    return links.with_verdicts(links.rated(rows), told)


def host_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host and rating."""
    return links.by_host(links.rated(_pages(spark, sf_dir).select("page_id", "url")))


def private_host_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of hosts that are not public."""
    return _sampled(spark, sf_dir).filter(urls.host_of(F.col("url")).isNotNull() & urls.is_private(urls.host_of(F.col("url"))))


def is_pdf_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that may be fetched as documents, and the kind of file they name."""
    return _sampled(spark, sf_dir).filter(urls.is_pdf_url(F.col("url"))).withColumn("kind", urls.file_kind(F.col("url")))


def active_content_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts, links and samples of every page."""
    return safety.scan(_pages(spark, sf_dir)).select("page_id", "js_count", "url_count", "has_js", "has_urls", "is_clean", F.array_join("samples", "\n").alias("samples"))


def script_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of every script."""
    return safety.scripts(_pages(spark, sf_dir))


def strip_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without scripts and outward links: what a scan still finds, and the new length and hash."""
    clean = safety.stripped(_pages(spark, sf_dir))
    return safety.scan(clean).select("page_id", "js_count", "url_count").join(clean.select("page_id", F.length("html").alias("n_chars"), F.sha2("html", 256).alias("sha256")), "page_id")


def hidden_data_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every kind of hidden content."""
    return safety.hidden_report(_pages(spark, sf_dir))


def sanitize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden content that is left after all of it has been removed."""
    clean = safety.sanitized(_pages(spark, sf_dir))
    return safety.hidden_report(clean).select("page_id", "metadata", "comments", "scripts_and_actions")


def operator_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of all pages."""
    return safety.tag_census(_pages(spark, sf_dir))


QUERIES = {f.__name__: f for f in (list_links, link_kinds, url_rating, url_verdict_merge, host_census, private_host_filter, is_pdf_url, active_content_scan, script_sources, strip_active, hidden_data_report, sanitize_pages, operator_census)}

_ALL = f"s AS (SELECT seq::BIGINT AS seq, url FROM {_VALUES} UNION ALL SELECT page_id + 1000, url FROM pages)"
_HOST = r"""nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\s]+)(?::[0-9]*)?(?:[/?#].*)?$', 1)), '')"""


def _in(domains: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in domains) + ")"


_RULES = (
    ("starts_with(lower(url), 'javascript:') OR starts_with(lower(url), 'file:') OR starts_with(lower(url), 'data:')", "red", "unsafe-scheme"),
    ("host IS NULL", "yellow", "unparseable"),
    (" OR ".join(f"ends_with(host, '{e}')" for e in urls.RISKY_ENDINGS), "red", "risky-tld"),
    (_in(urls.SHORTENERS), "yellow", "url-shortener"),
    (_in(urls.CODE_HOSTS), "yellow", "code-hosting"),
    (_in(urls.FILE_HOSTS), "yellow", "file-hosting"),
    (f"ends_with(host, '.gov') OR ends_with(host, '.edu') OR {_in(urls.KNOWN_SITES)}", "green", "known-site"),
)
_LEVEL = "CASE " + " ".join(f"WHEN {c} THEN '{lv}'" for c, lv, _ in _RULES) + " ELSE 'yellow' END"
_CATEGORY = "CASE " + " ".join(f"WHEN {c} THEN '{cat}'" for c, _, cat in _RULES) + " ELSE 'unknown' END"
_PRIVATE = """(host IN ('', 'localhost', '0.0.0.0', '::1', '[::1]') OR host LIKE '10.%' OR host LIKE '127.%' OR host LIKE '169.254.%' OR host LIKE '192.168.%'
    OR host LIKE '172.%.%' AND TRY_CAST(split_part(host, '.', 2) AS INTEGER) BETWEEN 16 AND 31 OR host SIMILAR TO '\\[?f[cd][0-9a-f]{2}:.*')"""
_H = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"'']([^\"'']*)[\"'']"
_S = r"(?is)<script\b[^>]*>(.*?)</script\s*>"
_ON = r"(?i)\son[a-z]+\s*=\s*(\"[^\"]*\"|''[^'']*'')"
_OUT = r"(?i)\shref\s*=\s*[\"''](?:[a-z][a-z0-9+.-]*:|//)[^\"'']*[\"'']"
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace(html, '{_S}', '', 'g'), '{_ON}', '', 'g'), '{_OUT}', '', 'g')"


def _n(pattern: str, html: str = "html") -> str:
    return f"len(regexp_extract_all({html}, '{pattern}'))::INTEGER"


_ACTIONS = f"({_n(_S)} + {_n(_ON)} + {_n(_H)})"
_HIDDEN = ", ".join(f"{_n(p)} AS {k}" for k, p in safety.HIDDEN.items())

ORACLES = {
    "list_links": f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '{_H}', 1) AS u FROM pages)
SELECT page_id, (i - 1)::INTEGER AS link_no, u[i] AS url FROM (SELECT page_id, u, unnest(range(1, len(u) + 1)) AS i FROM l) WHERE trim(u[i]) <> ''""",
    "link_kinds": f"""WITH l AS (SELECT unnest(regexp_extract_all(html, '{_H}', 1)) AS url FROM pages)
SELECT CASE WHEN starts_with(lower(url), 'javascript:') THEN 'javascript' WHEN starts_with(lower(url), 'mailto:') THEN 'mailto' WHEN regexp_matches(lower(url), '^[a-z][a-z0-9+.-]*:') THEN 'uri' WHEN starts_with(url, '#') THEN 'goto' ELSE 'link' END AS kind,
       count(*) AS n, count(DISTINCT url) AS urls FROM l WHERE trim(url) <> '' GROUP BY 1""",
    "url_rating": f"WITH {_ALL}, h AS (SELECT *, {_HOST} AS host FROM s) SELECT seq, url, host, {_LEVEL} AS level, {_CATEGORY} AS category FROM h",
    "url_verdict_merge": f"""WITH {_ALL}, h AS (SELECT *, {_HOST} AS host FROM s),
a AS (SELECT lower(url) AS k, min(seq) AS f FROM s GROUP BY 1 ORDER BY f LIMIT 100),
v AS (SELECT lower(url) AS k, bool_or(malicious) AS m FROM {_VERDICTS} WHERE lower(url) IN (SELECT k FROM a) GROUP BY 1)
SELECT seq, url, host, CASE WHEN m THEN 'red' ELSE {_LEVEL} END AS level, CASE WHEN m THEN 'malicious' ELSE {_CATEGORY} END AS category, CASE WHEN m IS NULL THEN 'heuristic' ELSE 'scanner' END AS source FROM h LEFT JOIN v ON lower(url) = k""",
    "host_census": f"WITH h AS (SELECT *, {_HOST} AS host FROM pages) SELECT host, {_LEVEL} AS level, {_CATEGORY} AS category, count(*) AS n FROM h GROUP BY ALL",
    "private_host_filter": f"WITH {_ALL}, h AS (SELECT *, {_HOST} AS host FROM s) SELECT seq, url FROM h WHERE host IS NOT NULL AND {_PRIVATE}",
    "is_pdf_url": rf"""WITH {_ALL}, h AS (SELECT *, {_HOST} AS host, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)) AS path FROM s)
SELECT seq, url, 'pdf' AS kind FROM h WHERE scheme IN ('http', 'https', 'file') AND ends_with(path, '.pdf') AND (scheme = 'file' OR NOT coalesce({_PRIVATE}, true))""",
    "active_content_scan": f"""WITH x AS (SELECT page_id, regexp_extract_all(html, '{_S}', 1) AS js, {_n(_ON)} AS handlers, regexp_extract_all(html, '{_H}', 1) AS us FROM pages),
y AS (SELECT *, list_concat(list_transform(js, lambda s: 'JS: ' || CASE WHEN length(trim(regexp_replace(s, '[\r\n]', ' ', 'g'))) > 80 THEN left(trim(regexp_replace(s, '[\r\n]', ' ', 'g')), 80) || '…' ELSE trim(regexp_replace(s, '[\r\n]', ' ', 'g')) END), us) AS a FROM x),
z AS (SELECT page_id, unnest(range(1, len(a) + 1)) AS i, a FROM y),
d AS (SELECT page_id, a[i] AS t, min(i) AS i FROM z GROUP BY ALL),
e AS (SELECT page_id, t, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM d),
f AS (SELECT page_id, string_agg(t, chr(10) ORDER BY k) AS samples FROM e WHERE k <= 12 GROUP BY page_id)
SELECT page_id, (len(js) + handlers)::INTEGER AS js_count, len(us)::INTEGER AS url_count, len(js) + handlers > 0 AS has_js, len(us) > 0 AS has_urls, len(js) + handlers + len(us) = 0 AS is_clean, coalesce(samples, '') AS samples FROM y LEFT JOIN f USING (page_id)""",
    "script_sources": f"""WITH x AS (SELECT page_id, regexp_extract_all(html, '{_S}', 1) AS js, regexp_extract_all(html, '{_ON}', 1) AS ha FROM pages),
y AS (SELECT page_id, list_concat(js, ha) AS a, len(js) AS n FROM x)
SELECT page_id, (i - 1)::INTEGER AS seq, CASE WHEN i <= n THEN 'element' ELSE 'handler' END AS origin, a[i] AS source FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM y)""",
    "strip_active": f"""WITH c AS (SELECT page_id, {_CLEAN} AS html FROM pages)
SELECT page_id, ({_n(_S)} + {_n(_ON)})::INTEGER AS js_count, {_n(_H)} AS url_count, length(html)::INTEGER AS n_chars, sha256(html) AS sha256 FROM c""",
    "hidden_data_report": f"SELECT page_id, {_HIDDEN}, {_ACTIONS} AS scripts_and_actions, greatest({', '.join(_n(p) for p in safety.HIDDEN.values())}, {_ACTIONS}) > 0 AS has_any FROM pages",
    "sanitize_pages": f"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace({_CLEAN}, '(?i)<meta\\b[^>]*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS html FROM pages)
SELECT page_id, {_n(safety.HIDDEN["metadata"])} AS metadata, {_n(safety.HIDDEN["comments"])} AS comments, {_ACTIONS} AS scripts_and_actions FROM c""",
    "operator_census": """WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) SELECT tag, count(*) AS occurrences, count(DISTINCT page_id) AS pages FROM t GROUP BY tag""",
}
