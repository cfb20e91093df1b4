"""Phrase search: matches, their places, replacement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators import layout

INSET, LEAST_SIDE = 0.2, 0.1


def find(docs: DataFrame, phrase: str, mode: str = "contains", case_sensitive: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the number of matches that do not overlap, for documents that have any."""
    n = T.count_matches(F.col(text_col), phrase, mode, case_sensitive)
    return docs.select(F.col(id_col).alias("doc_id"), n.cast("long").alias("n_matches")).filter("n_matches > 0")


def find_each(docs: DataFrame, phrases: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """phrase, number of documents and of (literal, case-sensitive) occurrences, for every phrase given.

    One pass over the texts; only phrases that a text holds become rows, and sums are partial.
    """
    wanted = [p for p in dict.fromkeys(phrases) if p]
    hits = F.filter(F.array(*map(F.lit, wanted)), lambda p: F.contains(F.col(text_col), p))
    found = docs.select(F.col(text_col).alias("t"), F.explode(hits).alias("phrase"))
    n = ((F.length("t") - F.length(F.replace("t", "phrase"))) / F.length("phrase")).cast("long")
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("n_matches"))


def match_offsets(docs: DataFrame, phrase: str, mode: str = "contains", case_sensitive: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, match_no, line_no, start, end (end exclusive) of every match within a line.

    Matches are cut out of a line by splitting it, so that offsets need no Python.
    """
    pattern = T.java_pattern(phrase, mode, case_sensitive)
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).filter(F.regexp_count("line", F.lit(pattern)) > 0)
    hits = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
    rest = F.split("line", pattern, -1)
    # a match starts after the pieces and the matches before it
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, s: n + F.length(s))
    start = lambda hit, i: total(F.slice(rest, F.lit(1), i + 1)) + F.when(i > 0, total(F.slice(hits, F.lit(1), F.greatest(i, F.lit(1))))).otherwise(0)
    found = lines.select("doc_id", "line_no", F.posexplode(F.transform(hits, lambda h, i: F.struct(start(h, i).alias("start"), h.alias("text")))).alias("k", "m"))
    return found.select("doc_id", "line_no", F.col("k").alias("match_no"), F.col("m.start").alias("start"), (F.col("m.start") + F.length("m.text")).alias("end"), F.col("m.text").alias("text"))


def match_rects(docs: DataFrame, phrase: str, mode: str = "contains", case_sensitive: bool = False) -> DataFrame:
    """doc_id, page, text, x, y, width, height of every match, from the bottom of a page upwards."""
    row = F.pmod("line_no", F.lit(layout.PAGE_LINES))
    return match_offsets(docs, phrase, mode, case_sensitive).select(
        "doc_id",
        (F.floor(F.col("line_no") / layout.PAGE_LINES) + 1).cast("int").alias("page"),
        "text",
        (layout.LEFT + layout.ADVANCE * F.col("start")).alias("x"),
        (layout.TOP - layout.LEADING * row).alias("y"),
        (layout.ADVANCE * (F.col("end") - F.col("start"))).alias("width"),
        F.lit(layout.SIZE).alias("height"),
    )


def match_order() -> Window:
    """Matches of a document in the order they are reported."""
    return Window.partitionBy("doc_id").orderBy("page", "y", "x")


def replace_all(docs: DataFrame, phrase: str, by: str, text_col: str = "text") -> DataFrame:
    """The rows with the phrase replaced, always case-sensitively and anywhere, and n_replaced."""
    if not phrase:
        return docs.withColumn("n_replaced", F.lit(0).cast("long"))
    old = F.col(text_col)
    new = F.replace(old, F.lit(phrase), F.lit(by))
    n = ((F.length(old) - F.length(F.replace(old, F.lit(phrase)))) / len(phrase)).cast("long")
    return docs.withColumns({"n_replaced": n, text_col: new})


def inset(x: Column, y: Column, width: Column, height: Column) -> dict[str, Column]:
    """A match's box drawn in a little, so that it touches no neighbour."""
    small = lambda side: F.greatest(F.lit(LEAST_SIDE), side - 2 * INSET)
    return {"x": x + INSET, "y": y + INSET, "width": small(width), "height": small(height)}


def wrapped(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text's lines wrapped greedily to a width in characters; longer words are broken."""

    def wrap(line: str) -> list[str]:
        out, now = [], ""
        for word in line.split(" "):
            joined = f"{now} {word}" if now else word
            if len(joined) <= width:
                now = joined
                continue
            if now:
                out.append(now)
            while len(word) > width:
                out.append(word[:width])
                word = word[width:]
            now = word
        return [*out, now]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [None if t is None else [w for line in t.replace("\r\n", "\n").replace("\r", "\n").split("\n") for w in wrap(line)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, type=pa.list_(pa.string()))], ["doc_id", "lines"])

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lines array<string>")
