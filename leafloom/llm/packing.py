"""Best-fit packing in bulk-synchronous rounds.

1. Texts become ids; each row gives its pieces of at most ``capacity`` ids.
2. Pieces are range-sorted by descending length and written; each partition
   counts its pieces of each length. Partitions times lengths that meet
   there are at most partitions + capacity, whatever the input.
3. Rounds go over lengths from the longest. In a round the pieces of one
   length meet the open gaps, sorted by size: a sweep gives every piece the
   successor of its length, the smallest gap that holds it, and the pieces
   that no gap holds open new sequences. Pieces of one length and gaps of
   one size are interchangeable, so a sweep moves whole intervals of ranks;
   rank settles which of them get a gap that too many want. The gaps shrink
   and the next round starts. This is best-fit decreasing over all pieces,
   carried out on counts.
4. Each partition places its pieces: the rank of a piece among all of its
   length lies in one interval, which names its sequence and offset.

Only step 3 runs on the driver, over at most ``capacity`` lengths; its plan
has a row for each interval moved, the number of which depends on the
capacity and on the lengths, not on the rows.

Defined results: a null or empty text has only the end id and is packed;
rows with equal ids are packed one by one; a null id is passed on; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import textops
from leafloom.llm.shared import Workspace, documents
from leafloom.llm.tokens import END_ID, word_ids

CAPACITY = 4096


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece as unsigned 32-bit integers."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, step = word_ids(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            for part in textops.slices(batch, 1):
                rows: list[tuple] = []
                for at, packed in enumerate(coder.pack([t or "" for t in part.column(1).to_pylist()])):
                    packed += end
                    for k, i in enumerate(range(0, len(packed), step)):
                        one = packed[i : i + step]
                        rows.append((at, k, i // 4, len(one) // 4, zlib.crc32(one), *([one] if with_ids else [])))
                at, k, start, length, crc, *ids = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), pa.array(k, type=pa.int32()), *(pa.array(x, type=pa.int64()) for x in (start, length, crc)), *(pa.array(x, type=pa.binary()) for x in ids)],
                    [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids],
                )

    return df.select(id_col, text_col).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Intervals moved by the rounds, and how many sequences they open.

    Rows: length, first rank, first sequence, offset; an interval goes up to
    the next first rank of its length. Ranks are among pieces of one length.
    """
    gaps: dict[int, deque] = defaultdict(deque)  # size -> intervals of sequences
    sizes: list[int] = []  # of the open gaps, ascending
    moved: list[tuple[int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):
                # none fits: as many new sequences as the rest of this length fills
                size, first, n = capacity, opened, -(-left // max(1, capacity // length))
                opened += n
            else:
                size = sizes[k]
                first, n = gaps[size].popleft()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(k)
            take = min(n, left)
            moved.append((length, rank, first, capacity - size))
            if take < n:
                _put(gaps, sizes, size, (first + take, n - take), front=True)
            if size > length:
                _put(gaps, sizes, size - length, (first, take))
            rank, left = rank + take, left - take
    return np.array(moved, dtype=np.int64).reshape(-1, 4), opened


def _put(gaps: dict[int, deque], sizes: list[int], size: int, interval: tuple[int, int], front: bool = False) -> None:
    if size not in gaps:
        bisect.insort(sizes, size)
    (gaps[size].appendleft if front else gaps[size].append)(interval)


def pack(df: DataFrame, space: Workspace, length_col: str = "length", tie_cols: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """The rows with sequence_id and offset; lengths must lie in 1..capacity."""
    spark = df.sparkSession
    ties = [c for c in tie_cols if c in df.columns]
    ordered = df.repartitionByRange(F.col(length_col).desc(), *ties).sortWithinPartitions(F.col(length_col).desc(), *ties)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(length) and not (1 <= length.min() and length.max() <= capacity):
                raise ValueError("a length outside 1..capacity")
            local = np.zeros(len(length), dtype=np.int64)
            if len(length):
                # rows are sorted by length, so equal lengths are neighbours
                begins = np.flatnonzero(np.r_[True, length[1:] != length[:-1]])
                local = np.arange(len(length)) - np.repeat(begins, np.diff(np.r_[begins, len(length)])) + seen[length]
                np.add.at(seen, length, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part), type=pa.int32()), pa.array(local)], [*batch.schema.names, "_part", "_rank"])

    at = df.columns.index(length_col)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    table = space.written(ordered.mapInArrow(ranked, f"{types}, _part int, _rank long"), "ranked")

    # at most partitions + capacity rows, as each length but those at the edges lies in one partition
    seen = table.groupBy(F.col(length_col).alias("length"), "_part").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "_part").collect()
    counts: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for r in seen:
        before[r._part, r.length] = counts[r.length]
        counts[r.length] += r.n
    moved, _ = plan(counts, capacity)
    keys = moved[:, 0] * (1 << 40) + moved[:, 1]  # ascending within a length, and lengths are put in order below
    order = np.argsort(keys, kind="stable")
    keys, first, ranks, offsets = keys[order], moved[order, 2], moved[order, 1], moved[order, 3]
    starts = {k: v for k, v in before.items() if v}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            part, rank = (batch.column(len(batch.schema.names) - 2 + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            if starts:
                pairs, inverse = np.unique(part * (capacity + 1) + length, return_inverse=True)
                rank = rank + np.array([starts.get((int(p) // (capacity + 1), int(p) % (capacity + 1)), 0) for p in pairs], dtype=np.int64)[inverse]
            k = np.searchsorted(keys, length * (1 << 40) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(first[k] + rank - ranks[k]), pa.array(offsets[k])], [*batch.schema.names[:-2], "sequence_id", "offset"])

    return table.mapInArrow(placed, f"{types}, sequence_id long, offset long")


def sequences(packed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """The packed sequences: sequence_id and its ids in order, as one binary; a group holds at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", ids_col)))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x[ids_col]))
    return packed.groupBy("sequence_id").agg(joined.alias(ids_col))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 ids."""
    docs = documents(spark, sf_dir)
    space = Workspace(spark, "packing")
    return pack(space.written(pieces(docs), "pieces"), space)


QUERIES = {"op10_packing": op10_packing}
