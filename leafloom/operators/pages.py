"""Page operators: order, rotation, merging, numbering, forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions.geometry import normal_rotation
from leafloom.functions.text import zero_padded


def page_list(wanted: Column, total: Column) -> Column:
    """Pages named, those out of range dropped, each once, ascending; all if none are named."""
    every = F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, every).otherwise(F.array_sort(F.array_distinct(F.filter(wanted, lambda p: (p >= 1) & (p <= total)))))


def arranged(pages: DataFrame, order: Sequence[int], key: str, number: str) -> DataFrame:
    """Pages in a new order: repeats duplicate, pages not named go; ``number`` counts anew from 1.

    A document that lacks a page of the order loses that place only if it is checked
    beforehand (``check_order``), as the order is one for all.
    """
    if not order:
        raise ValueError("an order names at least one page")
    wanted = pages.withColumn("_place", F.filter(F.sequence(F.lit(1), F.lit(len(order))), lambda i: F.element_at(F.array(*map(F.lit, order)), i) == F.col(number)))
    placed = wanted.select(*[c for c in pages.columns if c != number], F.col(number).alias("source_page"), F.explode("_place").alias("_place"))
    return placed.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy("_place"))).drop("_place")


def check_order(pages: DataFrame, order: Sequence[int], key: str, number: str) -> DataFrame:
    """The documents in which a page of the order is missing."""
    return pages.groupBy(key).agg(F.max(number).alias("n")).filter((F.col("n") < max(order)) | F.lit(min(order) < 1)).select(key)


def rotated(pages: DataFrame, degrees: int, wanted: Sequence[int] = (), number: str = "page", rotation: str = "rotation") -> DataFrame:
    """Pages turned by a multiple of 90; all if none are named."""
    if degrees % 90:
        raise ValueError("a rotation is a multiple of 90")
    turned = normal_rotation(F.col(rotation) + degrees)
    return pages.withColumn(rotation, F.when(F.col(number).isin(list(wanted)), turned).otherwise(F.col(rotation)) if wanted else turned)


def merged(parts: Sequence[DataFrame], key: str, number: str) -> DataFrame:
    """Pages of several documents after one another: part, from 1, and out_page across all parts of a key.

    A running count within each key; keys are documents, so a window holds one document's pages.
    """
    union = None
    for i, part in enumerate(parts):
        one = part.withColumn("part", F.lit(i + 1))
        union = one if union is None else union.unionByName(one)
    return union.withColumn("out_page", F.row_number().over(Window.partitionBy(key).orderBy("part", number)))


def shifted_bookmarks(marks: DataFrame, pages: DataFrame, key: str, number: str) -> DataFrame:
    """Bookmarks (key, part, title, page) carried to the merged pages; those without a page go."""
    return marks.join(pages.select(key, "part", F.col(number).alias("page"), "out_page"), [key, "part", "page"]).select(key, "part", "title", "out_page")


def numbered(pages: DataFrame, order: Sequence[str], prefix: str = "", suffix: str = "", start: int = 1, digits: int = 6) -> DataFrame:
    """The rows with seq and label: consecutive numbers, padded and never cut.

    Numbers run over the whole table, so ranks are made by range partition and offset:
    rows are range-partitioned by the order, counted by partition, and each partition
    starts where those before it end. Only the counts meet in one place.
    """
    if start < 0:
        raise ValueError("numbers start at zero or above")
    digits = max(1, min(12, digits))
    # a stated number of partitions is kept at run time, so that both uses below see the same ones
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pages.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    local = placed.withColumn("_local", F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33))
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = local.join(before, "_part").withColumn("seq", F.col("_before") + F.col("_local") + start)
    return out.withColumn("label", F.concat(F.lit(prefix), zero_padded(F.col("seq"), digits), F.lit(suffix))).select(*pages.columns, "seq", "label")


def label_ends(rows: DataFrame) -> DataFrame:
    """One row: number of labels, the first and the last."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min_by("label", "seq").alias("first_label"), F.max_by("label", "seq").alias("last_label"))


def filled(fields: DataFrame, values: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """Fields with new values: unknown names are ignored, the last value of a name counts, the first field of a name takes it.

    Buttons keep theirs; a check box takes a state it has, else Off.
    """
    new = values.groupBy(name).agg(F.max_by("value", "value_seq").alias("_new"))
    order = Window.partitionBy("doc_id", name).orderBy(seq)
    ranked = fields.withColumn("_k", F.row_number().over(order)).join(new, name, "left")
    state = F.when(F.array_contains("options", F.col("_new")), F.col("_new")).otherwise("Off")
    chosen = F.when(F.col("type") == "button", F.col("value")).when(F.col("type").isin("checkbox", "radio"), state).otherwise(F.col("_new"))
    changed = (F.col("_k") == 1) & F.col("_new").isNotNull()
    return ranked.withColumns({"value": F.when(changed, chosen).otherwise(F.col("value")), "filled": F.coalesce(changed, F.lit(False))}).select(*fields.columns, "filled")


def field_type(kind: Column, flags: Column) -> Column:
    """text, checkbox, radio, button, choice or signature by kind and flag bits 15 and 16."""
    bit = lambda n: F.bitwise_and(flags, F.lit(1 << n)) != 0 if hasattr(F, "bitwise_and") else flags.bitwiseAND(1 << n) != 0
    return F.when(kind == "Btn", F.when(bit(16), "button").when(bit(15), "radio").otherwise("checkbox")).when(kind == "Ch", "choice").when(kind == "Sig", "signature").otherwise("text")


def free_name(taken: DataFrame, wanted: str, most: int = 10_000) -> DataFrame:
    """One row: the name, or with _2, _3, ... the first that is not taken."""
    spark = taken.sparkSession
    tries = spark.range(1, most + 1).select("id", F.when(F.col("id") == 1, F.lit(wanted)).otherwise(F.concat(F.lit(f"{wanted}_"), F.col("id").cast("string"))).alias("name"))
    return tries.join(taken.select("name"), "name", "left_anti").agg(F.min_by("name", "id").alias("name"))
