"""Documents as positioned tokens, and back.

Lines are what line feeds part; a page has ``PAGE_LINES`` of them. A token
is a run without spaces; its place follows from its line and its offset, in
points, so that text tables carry the geometry spatial operators need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_LINES = 50
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
#: Bytes of text that are laid out at once; a longer text is laid out by itself.
BATCH_BYTES = 1 << 21
LEFT, TOP, ADVANCE, LEADING, SIZE = 72.0, 760.0, 6.0, 12.0, 10.0


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's tokens, by splits and running sums over the columns of a few texts at a time."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + BATCH_BYTES, "right")))
            yield _page_rows(batch.slice(begin, end - begin))
            begin = end


def _page_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    lines = pc.split_pattern(batch.column(1).cast(pa.large_string()), "\n")
    doc = pc.list_parent_indices(lines).to_numpy()
    line_no = np.arange(len(doc)) - lines.offsets.to_numpy()[doc]
    words = pc.split_pattern(lines.flatten(), " ")
    line = pc.list_parent_indices(words).to_numpy()
    pieces = words.flatten()
    length = pc.utf8_length(pieces).to_numpy()
    starts = np.cumsum(length + 1) - length - 1
    kept = np.flatnonzero(length)
    off = (starts - starts[words.offsets.to_numpy()[line]])[kept]
    line = line[kept]
    tok_no = np.arange(len(kept)) - np.searchsorted(line, line)
    page = line_no // PAGE_LINES
    ahead = np.flatnonzero(line_no % PAGE_LINES == 0)
    ints = [pa.array(c.astype(np.int32)) for c in (line_no[line], tok_no, off)]
    marks = pa.StructArray.from_arrays([*ints, pieces.take(pa.array(kept)).cast(pa.string())], ["line_no", "tok_no", "char_off", "text"])
    cuts = np.append(np.searchsorted(line, ahead), len(kept)).astype(np.int32)
    rows = [batch.column(0).take(pa.array(doc[ahead])), pa.array((page[ahead] + 1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(cuts), marks)]
    return pa.RecordBatch.from_arrays(rows, ["doc_id", "page", "marks"])


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, page and marks, the page's tokens in order (line_no, tok_no, char_off, text); null texts have no page.

    A page never leaves its document's row, so there is no shuffle.
    """
    own = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text_col)
    return own.mapInArrow(_marks, f"doc_id {docs.schema[id_col].dataType.simpleString()}, page int, marks array<struct<line_no:int,tok_no:int,char_off:int,text:string>>")


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, page, line_no, tok_no, char_off, text, x, y, width, height; null texts have none."""
    found = marks(docs, id_col, text_col).select("doc_id", "page", F.inline("marks"))
    return found.select(
        "*",
        (LEFT + ADVANCE * F.col("char_off")).alias("x"),
        (TOP - LEADING * F.pmod("line_no", F.lit(PAGE_LINES))).alias("y"),
        (ADVANCE * F.length("text")).alias("width"),
        F.lit(SIZE).alias("height"),
    )


def pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, page and its box; a document has a page for each 50 lines begun."""
    count = F.ceil(F.size(F.split(text_col, "\n")) / PAGE_LINES).cast("int")
    return docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(F.sequence(F.lit(1), count)).alias("page"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"))


def reading_text(tok: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """The text of every page in reading order: a space where tokens of a line are apart, a line feed between lines.

    Lines are told apart by their baseline, so blank lines leave none behind. One shuffle; a
    group is a page.
    """
    rows = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "tok_no", "width", "text")))
    sorted_rows = tok.groupBy(*keys).agg(rows.alias("rows"))

    def joined(t: Column, i: Column) -> Column:
        before = F.element_at("rows", F.greatest(i, F.lit(1)))
        apart = t.x - (before.x + before.width) > 0.5 * ADVANCE
        return F.concat(F.when(i == 0, "").when(before.down != t.down, "\n").when(apart, " ").otherwise(""), t.text)

    return sorted_rows.select(*keys, F.array_join(F.transform("rows", joined), "").alias("page_text"), F.size("rows").cast("long").alias("n_tokens"))


def page_texts(marked: DataFrame) -> DataFrame:
    """The same for pages as :func:`marks` gives them, within the row and so without a shuffle.

    Tokens of a line are always a space or more apart.
    """
    joined = F.transform("marks", lambda t, i: F.concat(F.when(i == 0, "").when(t.line_no != F.col("marks")[F.greatest(i - 1, F.lit(0))].line_no, "\n").otherwise(" "), t.text))
    return marked.filter(F.size("marks") > 0).select("doc_id", "page", F.array_join(joined, "").alias("page_text"), F.size("marks").cast("long").alias("n_tokens"))
