"""Differences of two versions: word bags, sequences, pages, vectors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Above this product of word counts a page is compared as two bags.
LCS_PRODUCT = 4000 * 4000
#: What ``functions.text.words`` yields.
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
#: Texts of a batch that Python holds at a time.
_ROWS = 200


def bag_counts(old: DataFrame, new: DataFrame, keys: tuple[str, ...], word: str = "word") -> DataFrame:
    """keys, word, n_added, n_removed: EXCEPT ALL both ways, by one sum of signs."""
    signed = new.select(*keys, word, F.lit(1).alias("d")).unionAll(old.select(*keys, word, F.lit(-1).alias("d")))
    total = signed.groupBy(*keys, word).agg(F.sum("d").alias("d")).filter("d <> 0")
    return total.select(*keys, word, F.greatest("d", F.lit(0)).alias("n_added"), F.greatest(-F.col("d"), F.lit(0)).alias("n_removed"))


def bag_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...], seq: str = "seq", word: str = "word") -> DataFrame:
    """keys, added (in new order) and removed (grouped by first appearance in the old), of words that the other bag lacks."""

    def surplus(a: DataFrame, b: DataFrame) -> DataFrame:
        number = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys, word).orderBy(seq)))
        return number(a).join(number(b).select(*keys, word, "k"), [*keys, word, "k"], "left_anti")

    gather = lambda name, order: F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(word).alias("w")))), lambda x: x.w).alias(name)
    first = old.withColumn("first", F.min(seq).over(Window.partitionBy(*keys, word)))
    added = surplus(new, old).groupBy(*keys).agg(gather("added", [seq]))
    # the first copies of a word are matched, so the last ones remain
    removed = surplus(first, new).groupBy(*keys).agg(gather("removed", ["first", seq]))
    empty = F.array().cast("array<string>")
    return added.join(removed, list(keys), "full").select(*keys, F.coalesce("added", empty).alias("added"), F.coalesce("removed", empty).alias("removed"))


def surplus_words(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """(added, removed) as ``bag_diff`` has them: b's words beyond a's copies in order, a's beyond b's by first appearance."""
    had, has = Counter(a), Counter(b)
    short = {w: k - had.get(w, 0) for w, k in has.items() if k > had.get(w, 0)}
    added = []
    # the last copies of a word are the ones beyond
    for w in reversed(b) if short else ():
        if short.get(w, 0):
            short[w] -= 1
            added.append(w)
    return added[::-1], [w for w, k in had.items() for _ in range(k - has.get(w, 0))]


def sequence_diff(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """(added, removed) by a longest common subsequence; where both ways are as long, removal comes first."""
    if len(a) * len(b) > LCS_PRODUCT:
        return surplus_words(a, b)
    n, m = len(a), len(b)
    rows = _subsequence_rows(a[::-1], b[::-1])

    def longest(i: int, j: int) -> int:
        """Length of the longest common subsequence of a[i:] and b[j:]."""
        return m - j - (rows[n - i] & (1 << m - j) - 1).bit_count()

    added, removed, i, j = [], [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif longest(i + 1, j) >= longest(i, j + 1):
            removed.append(a[i])
            i += 1
        else:
            added.append(b[j])
            j += 1
    return added + b[j:], removed + a[i:]


def _subsequence_rows(a: list[str], b: list[str]) -> list[int]:
    """Row k: an integer whose zero bits mark where the longest common subsequence of a[:k] and b grows (Hyyroe's recurrence)."""
    where: dict[str, int] = {}
    for j, word in enumerate(b):
        where[word] = where.get(word, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for word in a:
        hit = rows[-1] & where.get(word, 0)
        rows.append((rows[-1] + hit | rows[-1] - hit) & full)
    return rows


def lcs_diff(old: Column, new: Column) -> Column:
    """struct<added, removed> of two columns of words; a missing side has none."""

    @F.pandas_udf("struct<added: array<string>, removed: array<string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        words = lambda x: [] if x is None else list(x)
        return pd.DataFrame([sequence_diff(words(x), words(y)) for x, y in zip(a, b, strict=True)], columns=["added", "removed"])

    return run(old, new)


def bag_diff_texts(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), text: str = "page_text") -> DataFrame:
    """``bag_diff`` of the words of texts: each text moves once and whole, and only keys with a difference have a row.

    Texts of one key are one bag, in any order. Keys that hold a null match nothing, so each side has its own row.
    """
    side = lambda df, is_new: df.filter(F.col(text).isNotNull()).select(*keys, F.lit(is_new).alias("_new"), F.col(text).alias("_text"))
    both = side(old, False).unionAll(side(new, True))
    apart = F.when(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)), F.col("_new")).alias("_apart")
    texts = lambda is_new: F.array_join(F.collect_list(F.when(F.col("_new") == is_new, F.col("_text"))), "\n")
    sides = both.groupBy(*keys, apart).agg(texts(False).alias("old"), texts(True).alias("new"))

    fields, kind = [sides.schema[k] for k in keys], pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                found = [(i, *surplus_words(_WORD.findall(x), _WORD.findall(y))) for i, (x, y) in enumerate(zip(part["old"].to_pylist(), part["new"].to_pylist(), strict=True)) if x != y]
                found = [f for f in found if f[1] or f[2]]
                own = part.select(list(keys)).take(pa.array([f[0] for f in found], type=pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([f[1] for f in found], type=kind), pa.array([f[2] for f in found], type=kind)], [*keys, "added", "removed"])

    out = StructType([*fields, *(StructField(c, ArrayType(StringType())) for c in ("added", "removed"))])
    return sides.select(*keys, "old", "new").mapInArrow(run, out)


def compare_pages(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), text: str = "page_text") -> DataFrame:
    """Pages of two versions side by side, by a full outer join; a page that one lacks has no words there."""
    from leafloom.functions.text import words

    sides = old.select(*keys, words(F.col(text)).alias("old_words")).join(new.select(*keys, words(F.col(text)).alias("new_words")), list(keys), "full")
    empty = F.array().cast("array<string>")
    return sides.select(*keys, F.coalesce("old_words", empty).alias("old_words"), F.coalesce("new_words", empty).alias("new_words"))


def diff_totals(diffs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, pages, changed pages, added and removed words, identical."""
    n_added, n_removed = F.size("added"), F.size("removed")
    out = diffs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), F.count_if((n_added + n_removed) > 0).alias("changed_pages"), F.sum(n_added).alias("added_words"), F.sum(n_removed).alias("removed_words"))
    return out.withColumn("identical", F.col("changed_pages") == 0)


def changed_fraction(pairs: DataFrame, key: str, old: str, new: str, limit: float) -> DataFrame:
    """key, positions, changed ones (differences over the limit), their share, and how many grew or shrank."""
    cells = pairs.select(key, F.explode(F.arrays_zip(F.col(old).alias("a"), F.col(new).alias("b"))).alias("c")).select(key, F.col("c.a").cast("double").alias("a"), F.col("c.b").cast("double").alias("b"))
    changed = F.abs(F.col("a") - F.col("b")) > limit
    return cells.groupBy(key).agg(F.count(F.lit(1)).alias("cells"), F.count_if(changed).alias("changed"), F.avg(changed.cast("double")).alias("fraction"), F.count_if(changed & (F.col("b") > F.col("a"))).alias("grown"), F.count_if(changed & (F.col("b") < F.col("a"))).alias("shrunk"))
