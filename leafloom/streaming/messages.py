"""Message streams: frames, chunk assembly, logs.

Chunks of a message carry {id, chunkIndex, chunkCount, data}; the message is
complete when every index has come, in any order. The batch form is one
aggregate; the stream form keeps the chunks of unfinished messages as state
that expires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed limits of messages: chunks, bytes of a whole frame, base64 characters of a chunk.
MOST_CHUNKS = 10_000
WHOLE_BYTES = 900_000
CHUNK_CHARS = 600_000
LOG_LINES = 500


def framed(messages: DataFrame, id_col: str = "id", body_col: str = "body", whole: int = WHOLE_BYTES, chunk: int = CHUNK_CHARS) -> DataFrame:
    """id, chunk_index, chunk_count, data: a short message as it is (null index), a longer one as base64 in chunks."""
    body = F.col(body_col)
    short = F.octet_length(body) <= whole
    code = F.regexp_replace(F.base64(body.cast("binary")), "[\r\n]", "")
    count = F.ceil(F.length(code) / chunk).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.struct(i.alias("chunk_index"), count.alias("chunk_count"), F.substring(code, i * chunk + 1, F.lit(chunk)).alias("data")))
    one = F.array(F.struct(F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("int").alias("chunk_count"), body.alias("data")))
    return messages.select(F.col(id_col).alias("id"), F.explode(F.when(short, one).otherwise(pieces)).alias("c")).select("id", "c.*")


def valid_chunk(index: Column, count: Column) -> Column:
    return (count > 0) & (count <= MOST_CHUNKS) & (index >= 0) & (index < count)


def assembled(chunks: DataFrame, order_col: str = "seq") -> DataFrame:
    """id, n_chunks, body of every complete message: the last data of an index counts, and so does the last count of an id.

    At most ``MOST_CHUNKS`` chunks make a message, so a group is bounded.
    """
    good = chunks.filter(valid_chunk(F.col("chunk_index"), F.col("chunk_count")))
    last = good.groupBy("id", "chunk_count", "chunk_index").agg(F.max_by("data", order_col).alias("data"), F.max(order_col).alias("seen"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "data")))
    whole = last.groupBy("id", "chunk_count").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("seen").alias("seen"), parts.alias("parts")).filter("n_chunks = chunk_count")
    newest = whole.groupBy("id").agg(F.max_by(F.struct("n_chunks", "parts"), "seen").alias("w"))
    joined = F.array_join(F.transform("w.parts", lambda p: p.data), "")
    return newest.select("id", "w.n_chunks", F.decode(F.unbase64(joined), "UTF-8").alias("body"))


class Assembler(StatefulProcessor):
    """Keeps the chunks of an unfinished message; a changed count begins it anew; a repeated index takes the place of the old."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n int", ttlDurationMs=self.ttl_ms)
        self.parts = handle.getMapState("parts", "i int", "data string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        import base64

        for frame in rows:
            for index, count, data in frame[["chunk_index", "chunk_count", "data"]].itertuples(index=False):
                if not (0 < count <= MOST_CHUNKS and 0 <= index < count):
                    continue
                if not self.count.exists() or self.count.get()[0] != count:
                    self.parts.clear()
                    self.count.update((int(count),))
                self.parts.updateValue((int(index),), (data,))
                found = dict((k[0], v[0]) for k, v in self.parts.iterator())
                if len(found) == count:
                    body = base64.b64decode("".join(found[i] for i in range(count))).decode()
                    self.parts.clear()
                    self.count.clear()
                    yield pd.DataFrame({"id": [key[0]], "n_chunks": [int(count)], "body": [body]})

    def close(self) -> None:
        """Nothing is held outside the state."""


def assembling(chunks: DataFrame, ttl_ms: int = 600_000) -> DataFrame:
    """The stream form of ``assembled``; needs the RocksDB state store."""
    return chunks.groupBy("id").transformWithStateInPandas(statefulProcessor=Assembler(ttl_ms), outputStructType="id string, n_chunks int, body string", outputMode="Append", timeMode="ProcessingTime")


def ring(rows: DataFrame, order_col: str, most: int = LOG_LINES) -> DataFrame:
    """The last entries of a log (the limit is the log's size), with seq; and dropped, the number gone before them."""
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    last = rows.orderBy(F.col(order_col).desc()).limit(most).crossJoin(F.broadcast(total))
    back = F.row_number().over(Window.orderBy(F.col(order_col).desc()))
    return last.withColumn("seq", F.col("_n") - back + 1).withColumn("dropped", F.greatest(F.lit(0), F.col("_n") - most)).drop("_n")


def latency(calls: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """action, window, calls, mean and highest value; late calls beyond the watermark are left out of a stream."""
    return calls.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value", "max_value")
