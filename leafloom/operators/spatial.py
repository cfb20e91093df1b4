"""Regions against tokens: overlap joins, audit reports, box preparation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions.geometry import Rect, full_line, quantized

KEYS = ("doc_id", "page")
#: Height of the bands that boxes are joined by, and the number of the last.
BAND, LAST_BAND = 36.0, 63


def _boxes(regions: DataFrame, *extra: str) -> DataFrame:
    return regions.select(*KEYS, *extra, *[F.col(c).alias(f"r_{c}") for c in ("x", "y", "width", "height")])


def numbered(regions: DataFrame) -> DataFrame:
    """The regions with region_no, from 0, within a document, by page and place."""
    order = Window.partitionBy("doc_id").orderBy("page", F.col("y").desc(), "x", "width", "height")
    return regions.withColumn("region_no", F.row_number().over(order) - 1)


def _banded(boxes: DataFrame, prefix: str, name: str) -> DataFrame:
    """A row for each band of its page that a box reaches, and the first of them; far bands count as the last."""
    band = lambda y: F.coalesce(F.least(F.greatest(F.floor(y / BAND), F.lit(0)), F.lit(LAST_BAND)), F.lit(0))
    first, top = band(F.col(f"{prefix}y")), band(F.col(f"{prefix}y") + F.col(f"{prefix}height"))
    return boxes.withColumn(f"{name}_first", first).withColumn(f"{name}_band", F.explode(F.sequence(first, F.greatest(first, top))))


def overlaps(regions: DataFrame, tok: DataFrame, how: str = "inner") -> DataFrame:
    """Regions joined to the tokens they strictly overlap: equal page and band first, then the boxes.

    Boxes meet in each band they share and count in the first of these. With ``left``, a region also has an
    empty row for each band where it overlaps none. Regions are hashed by partition and tokens stream past
    unsorted; neither side is broadcast, as estimates know nothing of the size of what is laid out.
    """
    r = _banded(_boxes(regions, "region_no"), "r_", "r").hint("shuffle_hash")
    t = _banded(tok.select(*[F.col(c).alias(f"t_{c}") for c in KEYS], *[c for c in tok.columns if c not in KEYS]), "", "t")
    same = (F.col("t_doc_id") == F.col("doc_id")) & (F.col("t_page") == F.col("page")) & (F.col("t_band") == F.col("r_band"))
    counts = F.col("r_band") == F.greatest("r_first", "t_first")
    return r.join(t, same & counts & Rect("r_").overlaps(Rect()), how).drop("t_doc_id", "t_page", "r_first", "r_band", "t_first", "t_band")


def hit_tokens(regions: DataFrame, tok: DataFrame) -> DataFrame:
    """Tokens that any region strictly overlaps, each once."""
    r = _boxes(regions).withColumnsRenamed({k: f"r_{k}" for k in KEYS})
    same = (F.col("r_doc_id") == F.col("doc_id")) & (F.col("r_page") == F.col("page")) & Rect("r_").overlaps(Rect())
    return tok.join(r.hint("shuffle_hash"), same, "left_semi")


def missed_tokens(regions: DataFrame, tok: DataFrame) -> DataFrame:
    """Tokens that no region overlaps: what stays after redaction."""
    r = _boxes(regions).withColumnsRenamed({k: f"r_{k}" for k in KEYS})
    same = (F.col("r_doc_id") == F.col("doc_id")) & (F.col("r_page") == F.col("page")) & Rect("r_").overlaps(Rect())
    return tok.join(r.hint("shuffle_hash"), same, "left_anti")


def audit_regions(regions: DataFrame, tok: DataFrame) -> DataFrame:
    """A row for every region: tokens overlapped, tokens whose centre lies within, and their text in reading order."""
    inside = Rect("r_").holds(*Rect().centre())
    texts = F.array_sort(F.collect_list(F.when(inside, F.struct((-F.col("y")).alias("down"), "x", "text"))))
    return overlaps(regions, tok, "left").groupBy("doc_id", "page", "region_no").agg(
        F.count("text").alias("text_runs"),
        F.count_if(inside).alias("centre_hits"),
        F.array_join(F.transform(texts, lambda t: t.text), " ").alias("region_text"),
    )


def audit_pages(regions: DataFrame, tok: DataFrame) -> DataFrame:
    """A row for every page with regions: regions, and distinct tokens that any of them overlaps."""
    per_page = regions.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("regions"))
    hits = hit_tokens(regions, tok).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("text_runs"))
    return per_page.join(hits, list(KEYS), "left").na.fill(0, ["text_runs"])


def audit_totals(regions: DataFrame, tok: DataFrame) -> DataFrame:
    """One row a document: regions, pages affected, distinct tokens."""
    pages = audit_pages(regions, tok)
    return pages.groupBy("doc_id").agg(F.sum("regions").alias("regions"), F.count(F.lit(1)).alias("pages_affected"), F.sum("text_runs").alias("text_runs"))


def region_text(regions: DataFrame, tok: DataFrame) -> DataFrame:
    """Each region's text: tokens with their centre in it, lines from the top, a space where they are apart."""
    lines = (
        overlaps(regions, tok)
        .filter(Rect("r_").holds(*Rect().centre()))
        .groupBy("doc_id", "page", "region_no", "y")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda t: t.text), " ").alias("line"))
    )
    parts = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "line")))
    return lines.groupBy("doc_id", "page", "region_no").agg(F.array_join(F.transform(parts, lambda p: p.line), "\n").alias("region_text"))


def merged_lines(boxes: DataFrame) -> DataFrame:
    """Boxes of equal height on separate lines, neighbours within 1.5 heights merged: gaps and islands."""
    line = Window.partitionBy(*KEYS, "y", "height").orderBy("x", "width")
    reach = F.max(F.col("x") + F.col("width")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    starts = boxes.withColumn("new", F.when(F.col("x") - reach <= 1.5 * F.col("height"), 0).otherwise(1))
    islands = starts.withColumn("island", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.min("x")
    return islands.groupBy(*KEYS, "y", "height", "island").agg(left.alias("x"), (F.max(F.col("x") + F.col("width")) - left).alias("width"), F.count(F.lit(1)).alias("merged")).drop("island")


def merged_boxes(boxes: DataFrame, order_col: str) -> DataFrame:
    """Boxes of any heights, merged pair by pair in the given order until none can be.

    The result depends on the order, so a page's boxes are folded together in one group;
    a page holds no more boxes than its marks.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        now = [tuple(r) for r in rows.sort_values(order_col)[["x", "y", "width", "height"]].itertuples(index=False)]

        def mergeable(a: tuple, b: tuple) -> bool:
            overlap = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
            first, second = (a, b) if a[0] <= b[0] else (b, a)
            return overlap > 0.5 * min(a[3], b[3]) and second[0] - (first[0] + first[2]) <= 1.5 * max(a[3], b[3])

        pair = True
        while pair:
            pair = next(((i, j) for i in range(len(now)) for j in range(i + 1, len(now)) if mergeable(now[i], now[j])), None)
            if pair:
                a, b = now[pair[0]], now.pop(pair[1])
                x, y = min(a[0], b[0]), min(a[1], b[1])
                now[pair[0]] = (x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y)
        out = pd.DataFrame(now, columns=["x", "y", "width", "height"])
        return out.assign(**{k: rows[k].iloc[0] for k in KEYS})[[*KEYS, "x", "y", "width", "height"]]

    types = ", ".join(f"{k} {boxes.schema[k].dataType.simpleString()}" for k in KEYS)
    return boxes.select(*KEYS, "x", "y", "width", "height", order_col).groupBy(*KEYS).applyInPandas(fold, f"{types}, x double, y double, width double, height double")


def expanded(boxes: DataFrame, pages: DataFrame, mode: str) -> DataFrame:
    """Boxes widened to the grid (``quantize``) or across the page (``line``); those of missing pages stay as they are."""
    own = boxes.join(pages.select(*KEYS, *[F.col(c).alias(f"p_{c}") for c in ("x", "y", "width", "height")]), list(KEYS), "left")
    x, width = quantized(Rect(), Rect("p_")) if mode == "quantize" else full_line(Rect("p_"))
    known = F.col("p_x").isNotNull()
    new = {"x": F.when(known, x).otherwise(F.col("x")), "width": F.when(known, width).otherwise(F.col("width"))}
    return own.withColumns(new).select(*boxes.columns)


def prepared(boxes: DataFrame, pages: DataFrame, level: int) -> DataFrame:
    """Boxes for a privacy level, clamped to 0..3: as they are, merged, and widened too."""
    level = max(0, min(3, level))
    if level == 0:
        return boxes
    merged = merged_lines(boxes).select(*KEYS, "x", "y", "width", "height")
    return merged if level == 1 else expanded(merged, pages, "quantize" if level == 2 else "line")


def nearest_token(points: DataFrame, tok: DataFrame) -> DataFrame:
    """The token nearest to each point (doc_id, page, point_no, px, py): lines count a thousand times as much."""
    dx = F.greatest(F.lit(0.0), F.col("x") - F.col("px"), F.col("px") - (F.col("x") + F.col("width")))
    dy = F.greatest(F.lit(0.0), F.col("y") - F.col("py"), F.col("py") - (F.col("y") + F.col("height")))
    best = F.min(F.struct((dy * 1000 + dx).alias("score"), "line_no", "tok_no", "text"))
    return points.join(tok, list(KEYS)).groupBy(*KEYS, "point_no").agg(best.alias("b")).select(*KEYS, "point_no", "b.score", "b.line_no", "b.tok_no", "b.text")


def swept(areas: DataFrame, tok: DataFrame) -> DataFrame:
    """Parts of tokens that each area covers, where it covers any; else the area itself."""
    hits = overlaps(areas, tok).select("doc_id", "page", "region_no", Rect("r_").intersection(Rect()).alias("part"))
    missed = areas.join(hits.select("doc_id", "page", "region_no").distinct(), ["doc_id", "page", "region_no"], "left_anti")
    raw = missed.select("doc_id", "page", "region_no", F.struct("x", "y", "width", "height").alias("part"))
    return hits.filter("part is not null").unionByName(raw).select("doc_id", "page", "region_no", "part.*")


def dominant(rows: DataFrame, key: str, value: str, order: Column, size: Column | None = None) -> DataFrame:
    """The most frequent value of each key; of several, the one seen first; with its greatest size if given."""
    measures = [F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), *([F.round(F.max(size), 2).alias("size")] if size is not None else [])]
    per = rows.groupBy(key, value).agg(*measures)
    best = F.max_by(F.struct(F.col(value), "n", *(["size"] if size is not None else [])), F.struct("n", (-F.col("first").cast("double")).alias("early")))
    return per.groupBy(key).agg(best.alias("b")).select(key, "b.*")
