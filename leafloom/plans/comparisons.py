"""Queries that compare versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions.text import words
from leafloom.operators import diff
from leafloom.plans.documents import _docs
from leafloom.session import spread, table


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and a later version: one word put in capitals, another doubled; every seventh document is gone, and its words come under a new id."""
    old = spread(_docs(spark, sf_dir).select("doc_id", "text"))
    edited = F.regexp_replace(F.regexp_replace("text", r"\bthe\b", "THE"), r"\band\b", "and and")
    new = old.select(F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("doc_id"), edited.alias("text"))
    return old, new


def _words(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.posexplode(words(F.col("text"))).alias("seq", "word"))


def compare_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words added and removed in every document, as bags."""
    old, new = _versions(spark, sf_dir)
    counts = diff.bag_counts(_words(old), _words(new), ("doc_id",))
    return counts.groupBy("doc_id").agg(F.sum("n_added").alias("added"), F.sum("n_removed").alias("removed"), F.count(F.lit(1)).alias("distinct_words"))


def compare_bag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words themselves, added ones in the new order and removed ones by first appearance."""
    old, new = _versions(spark, sf_dir)
    out = diff.bag_diff_texts(old, new, ("doc_id",), "text")
    return out.select("doc_id", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"), F.sha2(F.array_join("added", " "), 256).alias("added_sha256"), F.sha2(F.array_join("removed", " "), 256).alias("removed_sha256"))


def compare_pages_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of both versions side by side with their word counts."""
    old, new = _versions(spark, sf_dir)
    sides = diff.compare_pages(old, new, ("doc_id",), "text")
    return sides.select("doc_id", F.size("old_words").alias("n_old"), F.size("new_words").alias("n_new"), (F.col("old_words") == F.col("new_words")).alias("identical"))


def compare_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words added and removed in sequence in every document: old against new."""
    old, new = _versions(spark, sf_dir)
    sides = diff.compare_pages(old, new, ("doc_id",), "text")
    return sides.withColumn("d", diff.lcs_diff(F.col("old_words"), F.col("new_words"))).select("doc_id", "d.added", "d.removed")


def compare_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the sequence comparison by language of the old version."""
    langs = _docs(spark, sf_dir).select("doc_id", "lang")
    return diff.diff_totals(compare_lcs(spark, sf_dir).join(langs, "doc_id"), ("lang",))


def changed_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of components that differ between each vector and the next one's."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return diff.changed_fraction(pairs, "vec_id", "embedding", "next", 0.1)


QUERIES = {f.__name__: f for f in (compare_bag, compare_bag_order, compare_pages_full_outer, compare_lcs, compare_totals, changed_fraction)}

_SIDES = r"""
o AS (SELECT doc_id, text FROM documents),
n AS (SELECT CASE WHEN doc_id % 7 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, regexp_replace(regexp_replace(text, '\bthe\b', 'THE', 'g'), '\band\b', 'and and', 'g') AS text FROM documents),
ow AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM o),
nw AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM n),
oe AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS seq FROM ow),
ne AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS seq FROM nw)"""

ORACLES = {
    "compare_bag": f"""WITH {_SIDES}, s AS (SELECT doc_id, word, sum(d) AS d FROM (SELECT doc_id, word, 1 AS d FROM ne UNION ALL SELECT doc_id, word, -1 FROM oe) GROUP BY ALL HAVING sum(d) <> 0)
SELECT doc_id, sum(greatest(d, 0))::BIGINT AS added, sum(greatest(-d, 0))::BIGINT AS removed, count(*) AS distinct_words FROM s GROUP BY doc_id""",
    "compare_bag_order": f"""WITH {_SIDES},
ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY seq) AS k, min(seq) OVER (PARTITION BY doc_id, word) AS f FROM oe),
nk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY seq) AS k FROM ne),
a AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY seq) AS s FROM nk ANTI JOIN ok USING (doc_id, word, k) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY f, seq) AS s FROM ok ANTI JOIN nk USING (doc_id, word, k) GROUP BY doc_id)
SELECT doc_id, coalesce(a.n, 0)::INTEGER AS n_added, coalesce(r.n, 0)::INTEGER AS n_removed, sha256(coalesce(a.s, '')) AS added_sha256, sha256(coalesce(r.s, '')) AS removed_sha256 FROM a FULL JOIN r USING (doc_id)""",
    "compare_pages_full_outer": f"""WITH {_SIDES}
SELECT doc_id, coalesce(len(ow.w), 0)::INTEGER AS n_old, coalesce(len(nw.w), 0)::INTEGER AS n_new, coalesce(ow.w, []) = coalesce(nw.w, []) AS identical FROM ow FULL JOIN nw USING (doc_id)""",
    "changed_fraction": """WITH c AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, count(*) AS cells, count(*) FILTER (abs(x - y) > 0.1) AS changed, avg((abs(x - y) > 0.1)::INTEGER) AS fraction,
       count(*) FILTER (abs(x - y) > 0.1 AND y > x) AS grown, count(*) FILTER (abs(x - y) > 0.1 AND y < x) AS shrunk FROM c GROUP BY vec_id""",
}
