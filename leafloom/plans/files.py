"""Queries on PDF files, which are made from the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.plans.documents import TOK, _docs
from leafloom.sources.pdf import tables
from leafloom.session import spread
from leafloom.sources.pdf.compose import as_files


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(spread(_docs(spark, sf_dir).select("doc_id", "text")))


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a file and read again: pages, boxes, text in reading order."""
    own = tables.pages(_files(spark, sf_dir)).filter("text <> ''")
    return own.select(F.col("path").cast("long").alias("doc_id"), "page", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), "rotation", F.sha2("text", 256).alias("text_sha256"))


def pdf_text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text runs of the files by page: how many, and the sums of their places."""
    runs = tables.text_runs(_files(spark, sf_dir), ("x", "y", "width"))
    return runs.groupBy(F.col("path").cast("long").alias("doc_id"), "page").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("x").cast("double")).alias("sum_x"), F.sum(F.rint((F.col("y") + 2.5) * 1000) / 1000).alias("sum_y"), F.sum(F.rint(F.col("width").cast("double") * 1000) / 1000).alias("sum_width"))


def pdf_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural findings of the files by code: there are none, so all files are counted."""
    found = tables.findings(_files(spark, sf_dir))
    census = found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))
    whole = tables.files(_files(spark, sf_dir)).filter("error is null and not rebuilt").agg(F.lit("none").alias("severity"), F.lit("files").alias("code"), F.count(F.lit(1)).alias("n"))
    return census.unionByName(whole)


QUERIES = {f.__name__: f for f in (pdf_pages, pdf_text_runs, pdf_findings)}

ORACLES = {
    "pdf_pages": f"""WITH {TOK},
l AS (SELECT doc_id, page, line_no, string_agg(text, ' ' ORDER BY tok_no) AS s FROM tok GROUP BY ALL)
SELECT doc_id, page, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 0 AS rotation, sha256(string_agg(s, chr(10) ORDER BY line_no)) AS text_sha256 FROM l GROUP BY doc_id, page""",
    "pdf_text_runs": f"WITH {TOK} SELECT doc_id, page, count(*) AS n_runs, sum(x) AS sum_x, sum(y) AS sum_y, sum(width) AS sum_width FROM tok GROUP BY doc_id, page",
    "pdf_findings": "SELECT 'none' AS severity, 'files' AS code, count(*) AS n FROM documents",
}
