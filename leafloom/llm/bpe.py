"""Byte-level BPE encoding and decoding by a local file of ranks.

Defined results: a null text counts as empty and gives no ids; null ids
decode to empty bytes; a null document id is passed on; rows are
independent; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import textops
from leafloom.llm.shared import documents
from leafloom.llm.tokens import rank_ids


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, ids array<int>."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_ids(ranks, pattern)
        for batch in batches:
            for part in textops.slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([coder.encode(t or "") for t in part.column(1).to_pylist()], type=pa.list_(pa.int32()))], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "bytes", ranks: str | None = None) -> DataFrame:
    """The rows with the ids replaced by the bytes they stand for, which need not be whole characters."""
    at = df.columns.index(ids_col)
    schema = df.schema.fieldNames()
    types = ", ".join(f"`{out_col}` binary" if c == ids_col else f"`{c}` {df.schema[c].dataType.simpleString()}" for c in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_ids(ranks)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                raw = pa.array([coder.decode(x or []) for x in part.column(at).to_pylist()], type=pa.binary())
                yield part.set_column(at, out_col, raw)

    return df.mapInArrow(run, types)


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, ids array<int>, bytes binary: both directions in one pass, so that one worker a task holds the ranks."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_ids(ranks, pattern)
        for batch in batches:
            for part in textops.slices(batch, 1):
                ids = [coder.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, type=pa.list_(pa.int32())), pa.array(map(coder.decode, ids), type=pa.binary())], [id_col, "ids", "bytes"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text of ``documents`` and of the bytes they decode to."""
    coded = encode_decode(documents(spark, sf_dir))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES = {"op8_bpe": op8_bpe}
