"""Quality rules by compression bands.

A document's zstandard ratio (compressed by raw bytes) is taken over the
whole text and over fixed chunks. Each length class has its own band:
below it a text is repetitive, above it incompressible. A text is rejected
when its whole ratio leaves the band, or when more than a given share of
its chunks do; the last chunk overlaps the one before, so every byte is
judged. Word and line counts come from vectorised passes over the
batch's bytes; repeated windows and lines are confirmed by their bytes.

Defined results: a null or empty text has no words, so it fails the base
rule; a null id is passed on; rows are independent; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import textops
from leafloom.llm.shared import documents

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 5


@dataclass(frozen=True)
class Bands:
    """Limits of the zstandard ratio.

    ``whole``: (bytes up to, lowest, highest) by length; the last holds for
    all longer texts. Short texts carry the frame's own bytes, so their
    upper limits rise as they shorten; over 128 bytes they lie between clean
    texts and random base64 in words of that length. The lowest values lie about 5 % under those of prose
    in European languages of that length, and fall with it: measured on clean
    texts joined by language, up to 16 MB, where the 2 MB window of the level
    has long ended the fall. ``chunk``: the same limits for one chunk.
    """

    level: int = 3
    chunk_bytes: int = 4096
    whole: tuple[tuple[float, float, float], ...] = ((128, 0.50, 1.60), (192, 0.50, 1.00), (256, 0.50, 0.91), (384, 0.50, 0.84), (512, 0.50, 0.79), (1024, 0.44, 0.745), (2048, 0.44, 0.72), (8192, 0.405, 0.72), (16384, 0.385, 0.70), (32768, 0.378, 0.70), (65536, 0.37, 0.70), (262144, 0.362, 0.70), (float("inf"), 0.345, 0.70))
    chunk: tuple[float, float] = (0.30, 0.72)
    bad_chunk_share: float = 0.5


DEFAULT = Bands()


def verdict(data: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, float, float, str | None]:
    """(whole ratio, lowest chunk ratio, highest chunk ratio, reason to reject or None)."""
    n = len(data)
    if not n:
        return 0.0, 0.0, 0.0, None
    ratio = len(press.compress(data)) / n
    low, high = next((lo, hi) for upto, lo, hi in bands.whole if n <= upto)
    lowest = highest = ratio
    bad = chunks = 0
    if n > bands.chunk_bytes:
        # a short rest would carry mostly the frame's bytes, so the last chunk is the text's last bytes and overlaps the one before
        starts = [*range(0, n - bands.chunk_bytes, bands.chunk_bytes), n - bands.chunk_bytes]
        rest = [len(press.compress(data[i : i + bands.chunk_bytes])) / bands.chunk_bytes for i in starts]
        lowest, highest, chunks = min(rest), max(rest), len(rest)
        bad = sum(not bands.chunk[0] <= r <= bands.chunk[1] for r in rest)
    reason = "repetitive" if ratio < low else "incompressible" if ratio > high else "chunks" if bad > bands.bad_chunk_share * chunks else None
    return ratio, lowest, highest, reason


def _in_document(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Keys that differ for equal values of different documents."""
    return value + textops.mix(group.astype(np.uint64) + np.uint64(1))


def measures(offsets: np.ndarray, raw: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(offsets) - 1
    words = textops.Words(offsets, raw)
    points = textops.code_points(raw)
    by_doc = lambda at, weight=None: np.bincount(at, weights=weight, minlength=n).astype(np.int64)
    out = {"n_words": words.counts, "word_chars": by_doc(words.doc, points[words.end] - points[words.start])}
    out["n_symbols"] = by_doc(np.searchsorted(offsets, np.flatnonzero(_SYMBOL[raw]), side="right") - 1)

    at, value = words.windows(textops.span_hashes(raw, words.start, words.end), WINDOW)
    covered = np.zeros(len(words.start) + 1, dtype=np.int64)

    def same_windows(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        same = words.doc[at[i]] == words.doc[at[j]]
        for k in range(WINDOW):
            a, b = at[i] + k, at[j] + k
            same &= textops.same_spans(raw, words.start[a], words.end[a], raw, words.start[b], words.end[b])
        return same

    kind, _ = textops.classes(_in_document(words.doc[at], value), same_windows)
    again = at[np.bincount(kind)[kind] > 1] if len(at) else at
    np.add.at(covered, again, 1)
    np.add.at(covered, again + WINDOW, -1)
    inside = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = by_doc(words.doc[inside])

    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1]), kind="stable")
    ends = offsets[doc + 1].copy()
    same = np.flatnonzero(doc[1:] == doc[:-1])
    ends[same] = starts[same + 1] - 1
    has_word = np.searchsorted(words.start, ends, side="left") > np.searchsorted(words.start, starts, side="left")
    starts, ends, doc = starts[has_word], ends[has_word], doc[has_word]
    if len(starts):
        same_lines = lambda i, j: (doc[i] == doc[j]) & textops.same_spans(raw, starts[i], ends[i], raw, starts[j], ends[j])
        _, first = textops.classes(_in_document(doc, textops.span_hashes(raw, starts, ends)), same_lines)
        out["n_dup_lines"] = by_doc(doc) - by_doc(doc[first])
    else:
        out["n_dup_lines"] = np.zeros(n, dtype=np.int64)
    return out


_COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64(), "lowest_chunk": pa.float64(), "highest_chunk": pa.float64(), "reason": pa.string()}


def _judged(column: pa.Array, bands: Bands, press: zstandard.ZstdCompressor) -> list[pa.Array]:
    offsets, raw = textops.strings(column)
    m = measures(offsets, raw)
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    data = raw.tobytes()
    each = [verdict(data[offsets[i] : offsets[i + 1]], bands, press) for i in range(len(offsets) - 1)]
    m["base_failed"] = failed
    m["kept"] = ~failed & np.array([e[3] is None for e in each], dtype=bool)
    m |= {"ratio": [e[0] for e in each], "lowest_chunk": [e[1] for e in each], "highest_chunk": [e[2] for e in each], "reason": ["base" if f else e[3] for f, e in zip(failed, each, strict=True)]}
    return [pa.array(m[k], type=kind) for k, kind in _COLUMNS.items()]


def judge_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = DEFAULT) -> DataFrame:
    """id, the counts, base_failed, kept, and the ratios and the reason behind the verdict."""
    names = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double", pa.string(): "string"}
    schema = ", ".join([f"`{id_col}` {df.schema[id_col].dataType.simpleString()}", *(f"{k} {names[v]}" for k, v in _COLUMNS.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for part in textops.slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), *_judged(part.column(1), bands, press)], [id_col, *_COLUMNS])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def keep_good(df: DataFrame, text_col: str = "text", bands: Bands = DEFAULT) -> DataFrame:
    """The rows whose text the rules keep, with all their columns."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        kept = list(_COLUMNS).index("kept")
        for batch in batches:
            for part in textops.slices(batch, at):
                yield part.filter(_judged(part.column(at), bands, press)[kept])

    return df.mapInArrow(run, df.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every text of ``documents``."""
    found = judge_quality(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("ratio", 6).alias("ratio"), "reason")


QUERIES = {"op3_quality": op3_quality}
