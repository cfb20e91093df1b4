"""Small sources: key=value files, allow lists, length-framed messages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions import records as R

#: The largest message of a frame.
MOST_FRAME = 64 << 20


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """key, value of every line with an equals sign; the first one parts."""
    return spark.read.text(path).select(R.key_values(F.col("value")).alias("p")).filter("p is not null").select("p.key", "p.value")


def allowed(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names of a list with comments."""
    return spark.read.text(path).select(R.allowed_name(F.col("value")).alias("engine")).filter("engine is not null").distinct()


def framed(body: bytes) -> bytes:
    """A message with its length in four bytes, little-endian."""
    return len(body).to_bytes(4, "little") + body


def frames(files: DataFrame, most: int = MOST_FRAME) -> DataFrame:
    """path, seq, body, error of every frame of files (path, content). A bad length or a cut end is the file's last row."""

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        at = seq = 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 4], "little", signed=True) if at + 4 <= len(data) else None
            if n is None or n < 0 or n > most or at + 4 + n > len(data):
                yield path, seq, None, "the length is out of range" if n is not None and not 0 <= n <= most else "the frame is cut short"
                return
            yield path, seq, data[at + 4 : at + 4 + n].decode("utf-8", "replace"), None
            at, seq = at + 4 + n, seq + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(rows(path, content or b""))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["path", "seq", "body", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, seq int, body string, error string")


def requests(found: DataFrame) -> DataFrame:
    """id, action, payload, ok of every message body: without an action it is an error, without an id the id is empty."""
    doc = F.try_parse_json("body")
    get = lambda key: F.try_variant_get(doc, f"$.{key}", "string")
    return found.select("seq", F.coalesce(get("id"), F.lit("")).alias("id"), get("action").alias("action"), get("payload").alias("payload"), F.coalesce(get("action") != "", F.lit(False)).alias("ok"))
