"""Queries on tables of records: quality, forms, messages, logs, issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions import geometry
from leafloom.functions import records as R
from leafloom.functions import text as T
from leafloom.operators import pages, safety, validate
from leafloom.operators import records as O
from leafloom.operators.formscripts import scripted
from leafloom.session import table
from leafloom.streaming import messages

_TABLES = ("documents", "pages", "conversations", "orders", "lineitem", "events")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules, of capped classes the first ten."""
    found = validate.all_findings({t: table(spark, sf_dir, t) for t in _TABLES})
    return validate.capped(found, ("DOC004", "PAG003"))


def finding_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings by severity and code."""
    return validate.census(validate.all_findings({t: table(spark, sf_dir, t) for t in _TABLES}))


def finding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, warnings, validity."""
    return validate.report(validate.all_findings({t: table(spark, sf_dir, t) for t in _TABLES}))


_FILL = "(VALUES (1, 'Customer#000000001', 'one'), (2, 'Customer#000000002', 'two'), (3, 'Customer#000000002', 'two again'), (4, 'nobody', 'x'), (5, 'flag', 'Yes'), (6, 'mark', 'Maybe'), (7, 'push', 'y')) AS v(value_seq, name, value)"
_FIELDS = "(VALUES (-1, 'flag', 'checkbox', 'Off'), (-2, 'mark', 'checkbox', 'Yes'), (-3, 'push', 'button', 'Go'), (-4, 'flag', 'checkbox', 'Off')) AS f(seq, name, type, value)"


def form_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields filled by name."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"), F.lit("text").alias("type"), F.col("c_mktsegment").alias("value"))
    fields = own.unionByName(spark.sql(f"SELECT CAST(-seq AS LONG) AS seq, name, type, value FROM {_FIELDS}")).withColumns({"doc_id": F.lit(1), "options": F.array(F.lit("Yes"), F.lit("Off"))})
    return pages.filled(fields, spark.sql(f"SELECT * FROM {_FILL}")).select("seq", "name", "type", "value", "filled")


def script_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named rows replaced, added and removed."""
    own = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("script"))
    changes = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("seq"), F.when(F.col("r_regionkey") < 2, F.lit("new")).otherwise(F.col("r_name")).alias("name"), F.concat(F.lit("set "), F.col("r_name")).alias("script"))
    first = own.agg(F.min("name").alias("name"))
    return safety.deleted(safety.upserted(own, changes), first)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("body"))
    parts = messages.framed(whole, whole=-1, chunk=400)
    # later chunks come first, and every third message lacks one
    return parts.withColumn("seq", -F.col("chunk_index")).filter(~((F.length("id") % 3 == 0) & (F.col("chunk_index") == 1)))


def chunk_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages cut into chunks, some lost, and those put together again that are complete."""
    return messages.assembled(_chunks(spark, sf_dir)).select("id", F.col("n_chunks").cast("long").alias("n_chunks"), F.sha2("body", 256).alias("body_sha256"))


def log_ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 events, their numbers, and how many are gone."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return messages.ring(rows, "event_id").select("event_id", "event_type", "seq", "dropped")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a log."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 50, "warn").otherwise("notice")
    line = R.log_line(F.col("ts"), level, F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.col("props")), F.col("event_id") % 3 == 0)
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"))


def latency_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    return messages.latency(table(spark, sf_dir, "events"))


_VERSIONS = "(VALUES ('2.0.0.0', '2.0.0'), ('1.9.0.0', '2.0.0'), ('3.0.0.0', '2.0.0'), ('2.0.99.0', '2.0.0'), ('2', '2.0'), ('2.x', '2.0.0'), ('', '1.0'), (' 2.1 ', '2.0.5'), ('10.0', '9.9')) AS v(host, own)"


def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of version pairs."""
    rows = spark.sql(f"SELECT * FROM {_VERSIONS}")
    order = R.compared(R.version_parts(F.col("host")), R.version_parts(F.col("own")))
    return rows.withColumns({"state": R.version_state(F.col("host"), F.col("own")), "full_order": order})


def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as issues: level, path, region, rule index."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    issues = e.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("r:"), "event_type")).alias("rule"),
        F.when(F.col("event_id") % 5 == 0, "proj:src/").when(F.col("event_id") % 2 == 0, F.concat(F.lit("proj:src/"), F.col("user_id").cast("string"), F.lit(".cs"))).otherwise(F.concat(F.lit("other:branch:lib/"), F.col("user_id").cast("string"))).alias("component"),
        F.element_at(F.array(*map(F.lit, ("BLOCKER", "MAJOR", "minor", "odd"))), (F.col("event_id") % 4 + 1).cast("int")).alias("severity"),
        F.when(F.col("event_id") % 7 == 0, F.array(F.struct(F.lit("LOW").alias("severity")))).alias("impacts"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("message"),
        F.when(F.col("event_id") % 9 == 0, 0).otherwise(k).cast("int").alias("line"),
        F.when(F.col("event_id") % 2 == 1, F.struct((k + 1).alias("startLine"), (k + F.col("event_id") % 2).cast("int").alias("endLine"), k.alias("startOffset"), (F.col("event_id") % 60).cast("int").alias("endOffset"))).alias("textRange"),
        F.lit(None).cast("string").alias("hash"),
    )
    return O.sarif_results(issues, "proj").select("seq", "rule_id", "rule_index", "level", "message", "uri", "region.startLine", "region.endLine", "region.startColumn", "region.endColumn", "help_uri")


_ALLOWED = "# reviewed\nEngine1 # a false alarm\n\n  Engine4  "


def verdict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as engines that judge each nation."""
    lines = spark.createDataFrame([(line,) for line in _ALLOWED.split("\n")], "line string")
    allowed = lines.select(R.allowed_name(F.col("line")).alias("engine")).filter("engine is not null")
    verdicts = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), F.concat(F.lit("Engine"), F.col("s_suppkey").cast("string")).alias("engine"), F.when(F.col("s_acctbal") < 2000, "malicious").when(F.col("s_acctbal") < 5000, "suspicious").otherwise("harmless").alias("category"))
    out = O.verdict_gate(verdicts, allowed, 1, True)
    return out.select("file", F.array_join("malicious", ",").alias("malicious"), F.array_join("suspicious", ",").alias("suspicious"), "failed")


def issue_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a service with pages of 500 and a limit of 10,000 gives, by page."""
    rows = O.paged(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500, 10_000)
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


_SCRIPTS = (
    ("this.getField('t').value = this.getField('a').value + this.getField(\"b\").value", "total"),
    ("this.getField('t').value = Number(this.getField('a').value)*2 + this.getField('gone').value; app.alert('done', 3)", "twice"),
    ("this.getField('x').display = display.hidden; this.resetForm()", "hide"),
    ("evil(); this.resetForm()", "unknown"),
    ("this.getField('t').value = (1 + 2) / 4 - -3", "plain"),
    ("app.alert({cTitle: 'T', cMsg: \"hi\"})", "alert"),
)


def form_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What form scripts do with the sizes of parts as field values."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("a"), F.col("p_size").cast("string"), F.lit("b"), F.lit("3")).alias("fields"))
    scripts = F.array(*[F.struct(F.lit(s).alias("script"), F.lit(n).alias("name")) for s, n in _SCRIPTS])
    rows = parts.select("p_partkey", "fields", F.explode(scripts).alias("s"))
    out = rows.withColumn("r", scripted(F.col("s.script"), F.col("fields")))
    return out.select("p_partkey", "s.name", "r.ok", F.try_element_at("r.sets", F.lit(1)).getField("value").alias("value"), "r.reset", F.array_join("r.alerts", ",").alias("alerts"), F.size("r.display").alias("n_display"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions over part names."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        T.printable(F.concat(name, F.lit("é\t"))).alias("printable"),
        T.zero_padded(F.col("p_size"), 1).alias("padded_1"),
        T.zero_padded(F.col("p_partkey"), 4).alias("padded_4"),
        T.html_escaped(F.concat(F.lit("<a href='x'>"), name, F.lit("\"&\""))).alias("escaped"),
        T.clipped(F.concat(name, F.lit(" \t\n "), F.repeat(F.col("p_type"), 20)), 40).alias("clipped"),
        T.approximate_size(F.col("p_partkey") * 7).alias("size"),
        T.match_mode_of(F.element_at(F.array(*map(F.lit, ("Starts-With", "suffix", "EXACT", "other"))), F.col("p_partkey").cast("int") % 4 + 1)).alias("mode"),
        T.bare_font(F.concat(F.lit("ABCDEF+"), "p_brand")).alias("font"),
    )


def geometry_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry over part sizes and prices."""
    box = geometry.Rect(x=F.col("p_size").cast("double"), y=F.lit(10.0), width=(F.col("p_partkey") % 300).cast("double"), height=F.lit(12.0))
    other, page = geometry.Rect(x=F.lit(20.0), y=F.lit(15.0), width=F.lit(40.0), height=F.lit(30.0)), geometry.Rect(x=F.lit(0.0), y=F.lit(0.0), width=F.lit(612.0), height=F.lit(792.0))
    m = F.array(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.col("p_size").cast("double"), F.lit(1.0))
    qx, qw = geometry.quantized(box, page)
    ax, ay = geometry.anchor(geometry.corner_of(F.element_at(F.array(*map(F.lit, ("bottom-left", "TOP_RIGHT", "topcentre", "nonsense"))), F.col("p_partkey").cast("int") % 4 + 1)), page, F.lit(60.0), F.lit(10.0))
    back = geometry.transformed(geometry.inverted(m), *geometry.transformed(m, box.x, box.y))
    return table(spark, sf_dir, "part").select(
        "p_partkey", box.overlaps(other).alias("overlap"), box.overlaps(other, geometry.SLACK).alias("overlap_slack"), page.covers(box).alias("covered"), other.holds(*box.centre()).alias("centre_held"),
        box.intersection(other).getField("width").alias("common_width"), box.union(other).getField("width").alias("union_width"), qx.alias("quantized_x"), qw.alias("quantized_width"), ax.alias("anchor_x"), ay.alias("anchor_y"), back[0].alias("back_x"), back[1].alias("back_y"),
        geometry.bounds(m, box).getField("height").alias("bounds_height"), geometry.normal_rotation(F.col("p_partkey") * 45 - 1000).alias("rotation"),
    )


QUERIES = {f.__name__: f for f in (findings, finding_census, finding_report, form_fill, script_upsert, chunk_assemble, log_ring_buffer, log_lines, latency_windows, version_compare, sarif_results, verdict_gate, issue_paging, form_scripts, text_functions, geometry_functions)}

_HOST = r"nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\s]+)(?::[0-9]*)?(?:[/?#].*)?$', 1), '')"
_FOUND = f"""
f AS (SELECT 'DOC001' AS code, 'Error' AS severity, 'doc ' || doc_id AS location, 'the text is empty' AS message FROM documents WHERE text IS NULL OR trim(text) = ''
UNION ALL SELECT 'DOC002', 'Error', 'doc ' || doc_id, 'n_chars is not the length of the text' FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT 'DOC003', 'Warning', 'doc ' || doc_id, 'the language is not known' FROM documents WHERE lang NOT IN ('en', 'fr', 'de', 'es')
UNION ALL SELECT 'DOC004', 'Warning', 'doc ' || doc_id, 'the text is very short' FROM documents WHERE length(text) < 40
UNION ALL SELECT 'DOC005', 'Error', 'doc ' || doc_id, 'the id occurs again' FROM documents GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'PAG001', 'Error', 'page ' || page_id, 'the URL has no host' FROM pages WHERE {_HOST} IS NULL
UNION ALL SELECT 'PAG002', 'Warning', 'page ' || page_id, 'the page has no title' FROM pages WHERE NOT contains(html, '<title>')
UNION ALL SELECT 'PAG003', 'Warning', 'page ' || page_id, 'paragraphs are not closed' FROM pages WHERE len(regexp_extract_all(html, '<p>')) <> len(regexp_extract_all(html, '</p>'))
UNION ALL SELECT 'TLK001', 'Warning', 'turn ' || conv_id, 'the role is not known' FROM conversations WHERE role NOT IN ('user', 'assistant', 'system')
UNION ALL SELECT 'TLK002', 'Warning', 'turn ' || conv_id, 'the turn is empty' FROM conversations WHERE length(text) = 0
UNION ALL SELECT 'ORD001', 'Error', 'order ' || o_orderkey, 'the price is negative' FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'LIN001', 'Error', 'line of ' || l_orderkey, 'the order does not exist' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'LIN002', 'Warning', 'line of ' || l_orderkey, 'the discount is out of range' FROM lineitem WHERE l_discount < 0 OR l_discount > 1
UNION ALL SELECT 'EVT001', 'Error', 'event ' || event_id, 'the properties are not JSON' FROM events WHERE NOT json_valid(props))"""
_CHUNKED = "c AS (SELECT conv_id || '-' || turn AS id, text, ceil(length(base64(encode(text))) / 400.0)::BIGINT AS n FROM conversations)"

ORACLES = {
    "form_scripts": """SELECT p_partkey, name, name <> 'unknown' AS ok,
    CASE name WHEN 'total' THEN (p_size + 3)::VARCHAR WHEN 'twice' THEN (p_size * 2)::VARCHAR WHEN 'plain' THEN '3.75' END AS value,
    name = 'hide' AS reset, CASE name WHEN 'twice' THEN 'done' WHEN 'alert' THEN 'hi' ELSE '' END AS alerts, CASE name WHEN 'hide' THEN 1 ELSE 0 END::INTEGER AS n_display
    FROM part, unnest(['total', 'twice', 'hide', 'unknown', 'plain', 'alert']) AS u(name)""",
    "findings": f"""WITH {_FOUND} SELECT * FROM f QUALIFY code NOT IN ('DOC004', 'PAG003') OR row_number() OVER (PARTITION BY code ORDER BY location) <= 10""",
    "finding_census": f"WITH {_FOUND} SELECT severity, code, count(*) AS n FROM f GROUP BY ALL",
    "finding_report": f"WITH {_FOUND} SELECT count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Error') = 0 AS is_valid FROM f",
    "form_fill": f"""WITH a AS (SELECT c_custkey AS seq, c_name AS name, 'text' AS type, c_mktsegment AS value FROM customer UNION ALL SELECT -seq, name, type, value FROM {_FIELDS}),
v AS (SELECT name, arg_max(value, value_seq) AS nv FROM {_FILL} GROUP BY name),
k AS (SELECT a.*, nv, nv IS NOT NULL AND row_number() OVER (PARTITION BY name ORDER BY seq) = 1 AS filled FROM a LEFT JOIN v USING (name))
SELECT seq, name, type, CASE WHEN NOT filled OR type = 'button' THEN value WHEN type = 'checkbox' THEN CASE WHEN nv IN ('Yes', 'Off') THEN nv ELSE 'Off' END ELSE nv END AS value, filled FROM k""",
    "script_upsert": """WITH ch AS (SELECT CASE WHEN r_regionkey < 2 THEN 'new' ELSE r_name END AS name, arg_max('set ' || r_name, r_regionkey) AS script FROM region GROUP BY 1),
u AS (SELECT n_name AS name, n_nationkey::VARCHAR AS script FROM nation WHERE n_name NOT IN (SELECT name FROM ch) UNION ALL SELECT name, script FROM ch)
SELECT * FROM u WHERE name <> (SELECT min(n_name) FROM nation)""",
    "chunk_assemble": f"WITH {_CHUNKED} SELECT id, n AS n_chunks, sha256(text) AS body_sha256 FROM c WHERE n > 0 AND NOT (length(id) % 3 = 0 AND n > 1)",
    "log_ring_buffer": "SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS seq, greatest(0, count(*) OVER () - 500) AS dropped FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) <= 500",
    "log_lines": """SELECT event_id, strftime(ts, '%H:%M:%S.') || lpad((millisecond(ts) % 1000)::VARCHAR, 3, '0') || '  ' || CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 50 THEN 'WARN ' ELSE 'INFO ' END || CASE WHEN event_id % 3 = 0 THEN ' [diag]' ELSE '' END || '  ' || event_type || CASE WHEN event_id % 2 = 0 AND props <> '' THEN ' — ' || props ELSE '' END AS line FROM events""",
    "latency_windows": "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, avg(value) AS mean_value, max(value) AS max_value FROM events GROUP BY ALL",
    "version_compare": f"""WITH p AS (SELECT host, own, CASE WHEN regexp_full_match(trim(host), '[0-9]+(\\.[0-9]+)*') THEN string_split(trim(host), '.')::INTEGER[] END AS a, CASE WHEN regexp_full_match(trim(own), '[0-9]+(\\.[0-9]+)*') THEN string_split(trim(own), '.')::INTEGER[] END AS b FROM {_VERSIONS}),
q AS (SELECT *, [coalesce(a[1], 0), coalesce(a[2], 0), coalesce(a[3], 0), coalesce(a[4], 0)] AS x, [coalesce(b[1], 0), coalesce(b[2], 0), coalesce(b[3], 0), coalesce(b[4], 0)] AS y FROM p)
SELECT host, own, CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN x[1:2] < y[1:2] THEN 'host-older' WHEN x[1:2] > y[1:2] THEN 'host-newer' ELSE 'ok' END AS state, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END END AS full_order FROM q""",
    "sarif_results": """WITH e AS (SELECT event_id AS seq, CASE WHEN event_id % 11 <> 0 THEN 'r:' || event_type END AS rule, CASE WHEN event_id % 5 = 0 THEN 'src/' WHEN event_id % 2 = 0 THEN 'src/' || user_id || '.cs' ELSE 'lib/' || user_id END AS path, event_type, (props->>'k')::INTEGER AS k FROM events),
u AS (SELECT * FROM e WHERE rule IS NOT NULL AND NOT ends_with(path, '/')),
r AS (SELECT rule, (row_number() OVER (ORDER BY min(seq)) - 1)::INTEGER AS rule_index FROM u GROUP BY rule),
g AS (SELECT *, seq % 2 = 1 AS ranged, CASE WHEN seq % 2 = 1 AND k + 1 <> 0 THEN k + 1 WHEN seq % 9 <> 0 AND k <> 0 THEN k END AS s FROM u JOIN r USING (rule)),
h AS (SELECT *, CASE WHEN ranged AND k + 1 <> 0 THEN greatest(k + 1, s) END AS l FROM g)
SELECT seq, rule AS rule_id, rule_index, CASE WHEN seq % 7 = 0 THEN 'note' WHEN seq % 4 = 0 THEN 'error' WHEN seq % 4 = 2 THEN 'note' ELSE 'warning' END AS level, CASE WHEN seq % 3 = 0 THEN rule ELSE event_type END AS message, path AS uri,
  s::INTEGER AS startLine, CASE WHEN s IS NOT NULL THEN l END::INTEGER AS endLine, CASE WHEN s IS NOT NULL AND ranged THEN k + 1 END::INTEGER AS startColumn,
  CASE WHEN s IS NOT NULL AND ranged AND (coalesce(l, s) > s OR seq % 60 + 1 >= coalesce(k + 1, 1)) THEN seq % 60 + 1 END::INTEGER AS endColumn, 'https://rules.sonarsource.com/?search=' || rule AS help_uri FROM h""",
    "verdict_gate": """WITH v AS (SELECT s_nationkey AS file, 'Engine' || s_suppkey AS engine, CASE WHEN s_acctbal < 2000 THEN 'malicious' WHEN s_acctbal < 5000 THEN 'suspicious' ELSE 'harmless' END AS c FROM supplier)
SELECT file, coalesce(string_agg(engine, ',' ORDER BY engine) FILTER (c = 'malicious' AND engine NOT IN ('Engine1', 'Engine4')), '') AS malicious, coalesce(string_agg(engine, ',' ORDER BY engine) FILTER (c = 'suspicious' AND engine NOT IN ('Engine1', 'Engine4')), '') AS suspicious,
  count(*) FILTER (c <> 'harmless' AND engine NOT IN ('Engine1', 'Engine4')) > 1 AS failed FROM v GROUP BY file""",
    "issue_paging": """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders)
SELECT ((k - 1) // 500 + 1)::INTEGER AS page, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM r WHERE k <= 10000 GROUP BY 1""",
    "text_functions": """SELECT p_partkey, p_name || '..' AS printable, p_size::VARCHAR AS padded_1, CASE WHEN length(p_partkey::VARCHAR) < 4 THEN lpad(p_partkey::VARCHAR, 4, '0') ELSE p_partkey::VARCHAR END AS padded_4,
  '&lt;a href=&#39;x&#39;&gt;' || p_name || '&quot;&amp;&quot;' AS escaped, CASE WHEN length(c) > 40 THEN left(c, 40) || '…' ELSE c END AS clipped,
  CASE WHEN b >= 1024 THEN round(b / 1024)::BIGINT || ' KB' ELSE b || ' B' END AS size, CASE p_partkey % 4 WHEN 0 THEN 'starts' WHEN 1 THEN 'ends' WHEN 2 THEN 'whole' ELSE 'contains' END AS mode, p_brand AS font
FROM (SELECT *, trim(regexp_replace(p_name || ' ' || repeat(p_type, 20), '\\s+', ' ', 'g')) AS c, round(p_partkey * 7 * 0.75::DOUBLE)::BIGINT AS b FROM part)""",
    "geometry_functions": """WITH b AS (SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 300)::DOUBLE AS w FROM part),
q AS (SELECT *, least(greatest(ceil((w + 36) / 72) * 72, w), greatest(w, 612)) AS qw FROM b)
SELECT p_partkey, x < 60 AND 20 < x + w AS overlap, x < 60 - 0.05 AND 20 < x + w - 0.05 AS overlap_slack, x + w <= 612.05 AS covered, x + w / 2 BETWEEN 20 AND 60 AND true AS centre_held,
  CASE WHEN least(x + w, 60) - greatest(x, 20) > 0 THEN least(x + w, 60) - greatest(x, 20) END AS common_width, greatest(x + w, 60) - least(x, 20) AS union_width,
  least(greatest(least(x, 612 - qw), 0), x) AS quantized_x, qw AS quantized_width, CASE p_partkey % 4 WHEN 0 THEN 24.0 WHEN 1 THEN 528.0 WHEN 2 THEN 276.0 ELSE 528.0 END::DOUBLE AS anchor_x, CASE WHEN p_partkey % 4 IN (1, 2) THEN 758.0 ELSE 24.0 END::DOUBLE AS anchor_y,
  x AS back_x, 10.0::DOUBLE AS back_y, 48.0::DOUBLE AS bounds_height, ((((floor((p_partkey * 45 - 1000) / 90) % 4) + 4) % 4) * 90)::INTEGER AS rotation FROM q""",
}
