"""Side pipelines: issues as SARIF, engine verdicts, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import records as R

ISSUE = "rule string, component string, severity string, impacts array<struct<severity: string>>, message string, line int, textRange struct<startLine: int, endLine: int, startOffset: int, endOffset: int>, hash string, type string"


def sarif_results(issues: DataFrame, project: str, order_col: str = "seq", organization: str | None = None) -> DataFrame:
    """A row for every issue that names a rule and a file, with its rule's index by first appearance."""
    path = R.relative_path(F.col("component"), F.lit(project))
    usable = issues.filter((F.col("rule") != "") & (F.col("component") != "")).withColumn("path", path).filter((F.col("path") != "") & ~F.col("path").endswith("/"))
    # rules are few; their index is found on one row each
    rules = usable.groupBy("rule").agg(F.min(order_col).alias("first")).withColumn("rule_index", F.row_number().over(Window.orderBy("first")) - 1)
    region = R.issue_region(F.col("line"), F.col("textRange.startLine"), F.col("textRange.endLine"), F.col("textRange.startOffset"), F.col("textRange.endOffset"))
    return usable.join(rules, "rule").select(
        order_col,
        F.col("rule").alias("rule_id"),
        "rule_index",
        R.issue_level(F.transform("impacts", lambda i: i.severity), F.col("severity")).alias("level"),
        F.coalesce(F.nullif("message", F.lit("")), "rule").alias("message"),
        F.col("path").alias("uri"),
        region.alias("region"),
        R.help_uri(F.col("rule"), organization).alias("help_uri"),
        F.col("hash").alias("fingerprint"),
    )


def sarif_document(results: DataFrame, order_col: str = "seq") -> DataFrame:
    """One JSON document of all results; a document meets in one place by nature."""
    one = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"), "region").alias("physicalLocation"))).alias("locations"),
    )
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("k"), F.to_json(one).alias("j")))), lambda x: x.j)
    return results.agg(F.concat(F.lit('{"version":"2.1.0","runs":[{"results":['), F.array_join(rows, ","), F.lit("]}]}")).alias("sarif"))


def verdict_gate(verdicts: DataFrame, allowed: DataFrame, threshold: int = 0, suspicious_counts: bool = False, key: str = "file") -> DataFrame:
    """key, engines that call it malicious or suspicious, and whether their number is over the threshold; allowed engines are left out."""
    counted = verdicts.join(allowed.select("engine").distinct(), "engine", "left_anti")
    names = lambda c: F.array_sort(F.collect_list(F.when(F.col("category") == c, F.col("engine"))))
    out = verdicts.select(key).distinct().join(counted.groupBy(key).agg(names("malicious").alias("malicious"), names("suspicious").alias("suspicious")), key, "left")
    empty = F.array().cast("array<string>")
    out = out.select(key, F.coalesce("malicious", empty).alias("malicious"), F.coalesce("suspicious", empty).alias("suspicious"))
    n = F.size("malicious") + (F.size("suspicious") if suspicious_counts else F.lit(0))
    return out.withColumn("failed", n > threshold)


def paged(rows: DataFrame, order_cols: list[str], size: int, most: int) -> DataFrame:
    """The rows a paged service would give, with their page: pages of ``size`` up to ``most`` rows (the service's limit)."""
    first = rows.orderBy(*order_cols).limit(most)
    ranked = first.withColumn("_k", F.row_number().over(Window.orderBy(*order_cols)))
    return ranked.withColumn("page", F.floor((F.col("_k") - 1) / size).cast("int") + 1).drop("_k")


def first_number(*texts: Column) -> Column:
    """The first of several texts that is all digits, as a number."""
    return F.coalesce(*[F.when(t.rlike("^[0-9]+$"), t.cast("long")) for t in texts])
