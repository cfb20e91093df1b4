"""Data-quality rules over the tables; each gives findings, and all are one table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import urls

FINDING = ("code", "severity", "location", "message")
#: Findings listed of a class that are capped; the census counts what is listed.
LISTED = 10


def rule(df: DataFrame, code: str, severity: str, broken: Column, location: Column, message: str) -> DataFrame:
    """A finding for every row that breaks a rule; null is not broken."""
    return df.filter(F.coalesce(broken, F.lit(False))).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), location.alias("location"), F.lit(message).alias("message"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, code: str, severity: str, location: Column, message: str) -> DataFrame:
    """A finding for every row whose key has no parent; null keys are orphans."""
    return child.join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti").select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), location.alias("location"), F.lit(message).alias("message"))


def repeated(df: DataFrame, key: str, code: str, severity: str, prefix: str, message: str) -> DataFrame:
    """A finding for every key that occurs more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("location"), F.lit(message).alias("message"))


def capped(findings: DataFrame, classes: tuple[str, ...], most: int = LISTED) -> DataFrame:
    """Of the named classes only the first findings by location; ranks are cut before they are shuffled."""
    order = Window.partitionBy("code").orderBy("location")
    few = findings.filter(F.col("code").isin(*classes)).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_k")
    return findings.filter(~F.col("code").isin(*classes)).unionByName(few)


def all_findings(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Findings of every rule over documents, pages, conversations, orders, lineitem and events."""
    at = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    docs, pages, talks, orders, lines, events = (tables[t] for t in ("documents", "pages", "conversations", "orders", "lineitem", "events"))
    parts = [
        rule(docs, "DOC001", "Error", F.col("text").isNull() | (F.trim("text") == ""), at("doc ", "doc_id"), "the text is empty"),
        rule(docs, "DOC002", "Error", F.col("n_chars") != F.length("text"), at("doc ", "doc_id"), "n_chars is not the length of the text"),
        rule(docs, "DOC003", "Warning", ~F.col("lang").isin("en", "fr", "de", "es"), at("doc ", "doc_id"), "the language is not known"),
        rule(docs, "DOC004", "Warning", F.length("text") < 40, at("doc ", "doc_id"), "the text is very short"),
        repeated(docs, "doc_id", "DOC005", "Error", "doc ", "the id occurs again"),
        rule(pages, "PAG001", "Error", urls.host_of(F.col("url")).isNull(), at("page ", "page_id"), "the URL has no host"),
        rule(pages, "PAG002", "Warning", ~F.col("html").contains("<title>"), at("page ", "page_id"), "the page has no title"),
        rule(pages, "PAG003", "Warning", F.regexp_count("html", F.lit("<p>")) != F.regexp_count("html", F.lit("</p>")), at("page ", "page_id"), "paragraphs are not closed"),
        rule(talks, "TLK001", "Warning", ~F.col("role").isin("user", "assistant", "system"), at("turn ", "conv_id"), "the role is not known"),
        rule(talks, "TLK002", "Warning", F.length("text") == 0, at("turn ", "conv_id"), "the turn is empty"),
        rule(orders, "ORD001", "Error", F.col("o_totalprice") < 0, at("order ", "o_orderkey"), "the price is negative"),
        orphans(lines, "l_orderkey", orders, "o_orderkey", "LIN001", "Error", at("line of ", "l_orderkey"), "the order does not exist"),
        rule(lines, "LIN002", "Warning", (F.col("l_discount") < 0) | (F.col("l_discount") > 1), at("line of ", "l_orderkey"), "the discount is out of range"),
        rule(events, "EVT001", "Error", F.try_parse_json("props").isNull(), at("event ", "event_id"), "the properties are not JSON"),
    ]
    return reduce(DataFrame.unionByName, parts)


def census(findings: DataFrame) -> DataFrame:
    """severity, code and the number of findings."""
    return findings.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def report(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, whether it is valid (no errors)."""
    return findings.agg(F.count_if(F.col("severity") == "Error").alias("errors"), F.count_if(F.col("severity") == "Warning").alias("warnings")).withColumn("is_valid", F.col("errors") == 0)


def log_text(findings: DataFrame) -> DataFrame:
    """One row: a line for each finding, or a sentence if there are none. A report meets in one place by nature."""
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", F.upper("severity"), "code", F.concat(F.lit("["), F.col("location"), F.lit("]")), "message")))
    return findings.agg(lines.alias("l")).select(F.when(F.size("l") > 0, F.array_join("l", "\n")).otherwise("No findings.").alias("log"))
