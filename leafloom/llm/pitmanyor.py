"""Language-model scores by a hierarchical Pitman-Yor model.

Words are drawn in restaurants, one for each context; a context is the word
before, however rare, or the start of a text. Context restaurants share one
parent, the restaurant of words without context, whose base is uniform over
the vocabulary and one unknown word. Every table of a context restaurant is a
customer of the parent. A word that training never saw has an empty one.

Seating is sampled by blocked Gibbs sweeps: all customers of one dish leave
their restaurant and take seats again, one after another, each from its
conditional given who sits already: a new table with weight (s + d T) P(dish),
an old one with its size less d. Only tables are counted, as sizes do not
enter predictions. In a sweep all dishes see the tables of the others as they
were after the sweep before. After burn-in every sweep gives a sample, and a
word's probability is the average over samples.

Each draw is a hash of the sweep, word, context and customer, not the next
number of a generator, so results do not depend on partitions, blocks or
buckets, and the customers of many dishes are seated in a few array passes
with the very outcome of seating them one by one (``seat``).

How it scales: texts are packed into blocks of about ``BLOCK_TOKENS`` tokens,
which send each bucket their distinct words, contexts and training counts
once, and get for each in the same order its count and tables: whole numbers,
from which the block takes the probabilities. Rare words are dealt to buckets
by ranges of their hash; frequent ones by word and context, so no bucket holds
more of a frequent word than its share. Which words are dealt so changes no
result. Words are counted over all blocks to find the frequent ones. Those
with their counts reach the driver, and a number for each bucket; all else
stays in the cluster and grows with the input.

A restaurant's dishes lie in many buckets. As many sit in it as the word
occurs in training, and a dish of one customer has one table, so its tables
are its customers less those who joined a table of others; these are summed in
each sweep over the dishes of several customers, by groups of ``HOME_BUCKETS``
ranges of hashes, and sent back to the buckets that have such a dish.

Words are told apart by 64-bit hashes: a bijection up to eight bytes, BLAKE2b
beyond. Defined results: a null or empty text is the end token alone; a null id
counts as the empty text for the split; a table without training tokens gives
every token the base probability; rows with equal ids are scored one by one;
other columns are not read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import textops
from leafloom.llm.shared import Workspace, documents

U64 = np.uint64
CONTEXT_STEP = 8
#: Restaurants' numbers in draws: 0 is the start of a text, from here on those of words.
FIRST = 1
BLOCK_TOKENS = 600_000
BUCKET_WORDS = 300_000
HOME_BUCKETS = 8
TOGETHER = 500_000
END = U64(0xE1D0E1D0E1D0E1D1)
FOLDS, HELD_FOLD = 5, 1


def _pack(x: np.ndarray) -> bytes:
    """Integers as zstandard of their byte planes."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T if len(x) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _open(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


@dataclass(frozen=True)
class Sweeps:
    """How long the sampler runs; concentrations of the two levels."""

    burn_in: int = 2
    samples: int = 2
    strength: float = 1.0
    root_strength: float = 1.0
    seed: int = 11


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_FOLD


# -- blocks ------------------------------------------------------------------

_BLOCK = pa.schema([("block", pa.int64()), ("n_train", pa.int64()), ("n_words", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_())), ("words", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
_BLOCK_SQL = "block long, n_train long, n_words long, doc_ids array<long>, n_tokens array<int>, held array<boolean>, words binary, counts binary, ids binary"


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each token of the texts; an end token closes every text."""
    offsets, raw = textops.strings(part.column(1))
    words = textops.Words(offsets, raw, lower=True)
    n = part.num_rows
    doc = np.concatenate([words.doc, np.arange(n)])
    order = np.argsort(doc, kind="stable")  # the end tokens come after the words of their text
    value = np.concatenate([words.hashes(), np.full(n, END)])[order]
    return value, doc[order]


def blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts as blocks of local word numbers, frequent words first."""

    def closed(held: list, number: int) -> pa.RecordBatch:
        value = np.concatenate([h[0] for h in held])
        doc_ids = [d for h in held for d in h[2]]
        n_tokens = np.concatenate([np.bincount(h[1], minlength=len(h[2])) for h in held])
        out = np.array([is_held_out(d) for d in doc_ids], dtype=bool)
        train = np.repeat(~out, n_tokens)
        words, inverse, total = np.unique(value, return_inverse=True, return_counts=True)
        rank = np.argsort(-total, kind="stable")
        place = np.empty(len(rank), dtype=np.int64)
        place[rank] = np.arange(len(rank))
        words, ids = words[rank], place[inverse]
        counts = np.bincount(ids[train], minlength=len(words))
        n_train = int(train.sum())
        block = (TaskContext.get().partitionId() << 32) + number
        row = [block, n_train, len(words), doc_ids, n_tokens.tolist(), out.tolist(), _pack(words.astype("<u8")), _pack(counts.astype("<u4")), _pack(ids.astype("<u4"))]
        return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            for part in textops.slices(batch, 1):
                held.append((*_tokens(part), part.column(0).to_pylist()))
                size += len(held[-1][0])
                if size >= BLOCK_TOKENS:
                    yield closed(held, number)
                    held, size, number = [], 0, number + 1
                    textops.trim(0)
        if held:
            yield closed(held, number)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _BLOCK_SQL)


def frequent(table: DataFrame, n_train: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, training counts) of the frequent words, sorted by hash; at most CONTEXT_STEP * sqrt(n_train).

    Words are counted in cells first, by a hash; only those of cells that reach the limit
    are then counted one by one, so most words leave no row. Only how words are dealt to
    buckets depends on them.
    """
    least = max(2, math.ceil(math.sqrt(n_train) / CONTEXT_STEP))
    bits = max(10, min(28, (16 * n_train // least).bit_length()))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                np.add.at(total, (_open(row["words"], "<u8") >> U64(64 - bits)).astype(np.int64), _open(row["counts"], "<u4"))
        parts = total.reshape(-1, 1 << 10)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([_pack(x) for x in parts], type=pa.binary())], ["part", "n"])

    def summed(group: pa.Table) -> pa.Table:
        total = sum(_open(x, "<i8") for x in group.column("n").to_pylist())
        at = np.flatnonzero(total >= least) + (group.column("part")[0].as_py() << 10)
        return pa.table([pa.array(at, type=pa.int64())], names=["cell"])

    table = table.select("words", "counts")
    full = np.zeros(1 << bits, dtype=bool)
    full[[r.cell for r in table.mapInArrow(cells, "part long, n binary").groupBy("part").applyInArrow(summed, "cell long").collect()]] = True

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = _open(row["words"], "<u8"), _open(row["counts"], "<u4")
                seen = (counts > 0) & full[(words >> U64(64 - bits)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(words[seen].view(np.int64)), pa.array(counts[seen].astype(np.int64))], ["w", "n"])

    found = table.mapInArrow(named, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()
    words, counts = np.array([r.w for r in found], dtype=np.int64).view(U64), np.array([r.n for r in found], dtype=np.int64)
    order = np.argsort(words)
    return words[order], counts[order]


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """One hash of several numbers, elementwise."""
    out = np.zeros(1, dtype=U64)
    for x in parts:
        out = textops.chained(out, np.asarray(x).astype(U64))
    return out


def _slim(row: dict, hot: np.ndarray) -> dict:
    """A block's row without the words' hashes: 20 bits of each, and which are frequent."""
    words = _open(row["words"], "<u8")
    at = np.minimum(np.searchsorted(hot, words), max(0, len(hot) - 1))
    spot = np.flatnonzero(hot[at] == words) if len(hot) else np.zeros(0, dtype=np.int64)
    own = {"marks": _pack(_marks(words)), "hot_spot": _pack(spot.astype("<u4")), "hot": _pack(at[spot].astype("<u4"))}
    return {k: row[k] for k in ("block", "doc_ids", "n_tokens", "held", "ids")} | own


_SLIM = pa.schema([*(f for f in _BLOCK if f.name in ("block", "doc_ids", "n_tokens", "held", "ids")), *((k, pa.binary()) for k in ("marks", "hot_spot", "hot"))])


def _home(marks: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket whose range of hashes holds each word, by the first 20 bits of its hash."""
    return (marks.astype(np.int64) * buckets) >> 20


def _marks(words: np.ndarray) -> np.ndarray:
    return (words >> U64(44)).astype("<u4")


class Pairs:
    """The distinct (word, context) pairs of one block, in a fixed order, dealt to buckets."""

    def __init__(self, row: dict, buckets: int) -> None:
        marks, ids = _open(row["marks"], "<u4"), _open(row["ids"], "<u4").astype(np.int64)
        n_tokens = np.array(row["n_tokens"], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(n_tokens)), n_tokens)
        #: where a word stands among the frequent ones, or -1
        self.hot_at = np.full(len(marks), -1)
        self.hot_at[_open(row["hot_spot"], "<u4")] = _open(row["hot"], "<u4")
        # before a text's first word stands an end token, which is the context of the start
        key, self.inverse = np.unique(ids * len(marks) + np.roll(ids, 1), return_inverse=True)
        self.word, self.context = key // len(marks), key % len(marks)
        held = np.repeat(np.array(row["held"], dtype=bool), n_tokens)
        self.count = np.bincount(self.inverse[~held], minlength=len(key))
        self.ids = ids
        # a rare word's pairs go to one bucket, a frequent one's to that of each pair; there, rare words come first
        split = self.hot_at[self.word] >= 0
        bucket = np.where(split, (_mixed(marks[self.word], marks[self.context] + 1) % U64(buckets)).astype(np.int64), _home(marks, buckets)[self.word])
        self.order = np.argsort(2 * bucket + split, kind="stable")
        self.buckets, self.cut = np.unique(bucket[self.order], return_index=True)
        self.cut = np.append(self.cut, len(key))

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs of the k-th bucket that this block has, their words in order, pairs of each word)."""
        p = self.order[self.cut[k] : self.cut[k + 1]]
        first, each = _runs(self.word[p])
        return p, self.word[p[first]], each


def _runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of each run of equal words."""
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.append(first, len(words)))


def _requests(table: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """bucket, block and what the block asks of it: hashes of rare words and numbers of frequent ones, their training counts, pairs a word, contexts (1 and on a frequent word, 0 the next of the hashes), training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, words, counts = Pairs(_slim(row, hot), buckets), _open(row["words"], "<u8"), _open(row["counts"], "<u4")
                out: list[tuple] = []
                for k, b in enumerate(pairs.buckets.tolist()):
                    p, w, each = pairs.of(k)
                    spot = pairs.hot_at[w]
                    rare, c = w[spot < 0], pairs.context[p]
                    known = pairs.hot_at[c] + 1
                    out.append((b, row["block"], _pack(words[rare]), _pack(spot[spot >= 0].astype("<u4")), _pack(counts[rare]), _pack(each.astype("<u4")), _pack(known.astype("<u4")), _pack(words[c[known == 0]]), _pack(pairs.count[p].astype("<u4"))))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 7), strict=True)], ["bucket", "block", "w", "h", "wn", "each", "c", "cw", "cn"])

    return table.mapInArrow(run, "bucket long, block long, w binary, h binary, wn binary, each binary, c binary, cw binary, cn binary")


# -- buckets -----------------------------------------------------------------

#: What each block asked: places among the bucket's words, pairs a word, and for each pair 0 if training has none, 1 if one, 2 and on for the word's pairs of several customers.
_ASKED = pa.list_(pa.struct([("block", pa.int64()), ("at", pa.binary()), ("each", pa.binary()), ("pair", pa.binary())]))
_MERGED = pa.schema([("bucket", pa.int64()), *((x, pa.binary()) for x in ("words", "hot", "wn", "single", "each", "c", "n", "contexts")), ("asked", _ASKED)])
_MERGED_SQL = "bucket long, words binary, hot binary, wn binary, single binary, each binary, c binary, n binary, contexts binary, asked array<struct<block: long, at: binary, each: binary, pair: binary>>"


def _merged(hot: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """One bucket's words and pairs over all blocks, and what each block asked."""
        rows = table.to_pylist()
        rare, spots = [_open(r["w"], "<u8") for r in rows], [_open(r["h"], "<u4") for r in rows]
        own = [np.concatenate([w, hot[h]]) for w, h in zip(rare, spots, strict=True)]
        words, inverse = np.unique(np.concatenate(own), return_inverse=True)
        counts = np.concatenate([np.concatenate([_open(r["wn"], "<u4"), np.zeros(len(h))]) for r, h in zip(rows, spots, strict=True)])
        wn = np.bincount(inverse, weights=counts, minlength=len(words)).astype(np.int64)
        where = np.full(len(words), -1)
        every = np.unique(np.concatenate(spots))
        where[np.searchsorted(words, hot[every])] = every
        n = np.concatenate([_open(r["cn"], "<u4") for r in rows]).astype(np.int64)
        known = np.concatenate([_open(r["c"], "<u4") for r in rows]).astype(np.int64)
        context = np.zeros(len(known), dtype=U64)
        context[known > 0] = hot[known[known > 0] - 1]
        context[known == 0] = np.concatenate([_open(r["cw"], "<u8") for r in rows])
        contexts, at = np.unique(context, return_inverse=True)
        key = np.repeat(inverse, np.concatenate([_open(r["each"], "<u4") for r in rows])) * len(contexts) + at
        del context, known, at
        seen = n > 0
        pairs, inside = np.unique(key[seen], return_inverse=True)
        total = np.bincount(inside, weights=n[seen], minlength=len(pairs)).astype(np.int64)
        several = total > 1
        word = pairs // len(contexts)
        each = np.bincount(word[several], minlength=len(words))
        code = np.append(np.where(several, 1 + np.cumsum(several) - (np.cumsum(each) - each)[word], 1), 0)
        place = np.full(len(key), len(pairs))
        place[seen] = inside
        other = np.searchsorted(pairs, key[~seen])
        place[~seen] = np.where(np.append(pairs, -1)[other] == key[~seen], other, len(pairs))
        code = code[place]
        contexts, c = np.unique(contexts[pairs[several] % len(contexts)], return_inverse=True)
        asked, a, b = [], 0, 0
        for r, w in zip(rows, own, strict=True):
            k = len(_open(r["cn"], "<u4"))
            asked.append({"block": r["block"], "at": _pack(inverse[a : a + len(w)].astype("<u4")), "each": r["each"], "pair": _pack(code[b : b + k].astype("<u4"))})
            a, b = a + len(w), b + k
        out = [rows[0]["bucket"], _pack(words), _pack(where.astype("<i4")), _pack(wn), _pack(np.bincount(word[~several], minlength=len(words)).astype("<u4")), _pack(each.astype("<u4")), _pack(c.astype("<u4")), _pack(total[several]), _pack(contexts), asked]
        del rows, n, key, place, code, own, rare, pairs
        textops.trim(0)
        return pa.Table.from_arrays([pa.array([x], type=f.type) for x, f in zip(out, _MERGED, strict=True)], schema=_MERGED)

    return run


@dataclass(frozen=True)
class Lexicon:
    """The training vocabulary in the order of hashes: the number of each bucket's first word, the frequent words with their counts and numbers."""

    first: np.ndarray
    hot: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.first) - 1

    def of(self, homes: np.ndarray) -> slice:
        """The frequent words of these neighbouring buckets."""
        return slice(*np.searchsorted(_home(_marks(self.hot), self.buckets), [homes[0], homes[-1] + 1]))

    def group(self, home: int) -> np.ndarray:
        """The buckets of a group."""
        return np.arange(home * HOME_BUCKETS, min(self.buckets, (home + 1) * HOME_BUCKETS))

    def words(self, homes: np.ndarray, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, training counts) of all words of these buckets, in order."""
        spot = self.of(homes)
        known = [_rare(r) for r in rows]
        words, counts = (np.concatenate([x, *(k[i] for k in known)]) for i, x in enumerate((self.hot[spot], self.counts[spot])))
        order = np.argsort(words)
        return words[order], counts[order]


def _rare(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, training counts) of a bucket's rare words that training has."""
    words, wn = _open(row["words"], "<u8"), _open(row["wn"], "<i8")
    own = (_open(row["hot"], "<i4") < 0) & (wn > 0)
    return words[own], wn[own]


def lexicon(merged: DataFrame, hot: np.ndarray, counts: np.ndarray, buckets: int) -> Lexicon:
    """Numbers all words; a row for each bucket reaches the driver."""
    home = _home(_marks(hot), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _rare(row)[0]
                below = np.searchsorted(words, hot[home == row["bucket"]])
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]]), pa.array([len(words)]), pa.array([_pack(below)], type=pa.binary())], ["bucket", "n", "below"])

    size, below = np.bincount(home, minlength=buckets), np.zeros(len(hot), dtype=np.int64)
    for r in merged.select("bucket", "words", "hot", "wn").mapInArrow(run, "bucket long, n long, below binary").collect():
        size[r.bucket] += r.n
        below[home == r.bucket] = _open(r.below, "<i8")
    first = np.concatenate([[0], np.cumsum(size)])
    return Lexicon(first, hot, counts, first[home] + below + np.arange(len(hot)) - np.searchsorted(home, home))


_FIELDS = {"words": "<u8", "hot": "<i4", "single": "<u4", "each": "<u4", "c": "<u4", "n": "<i8", "numbers": "<i8", "sits": "<i8"}
_STATE = f"bucket long, start long, {', '.join(f'{x} binary' for x in _FIELDS)}, samples array<binary>, roots array<binary>"
_STATE_ARROW = pa.schema([("bucket", pa.int64()), ("start", pa.int64()), *((x, pa.binary()) for x in _FIELDS), ("samples", pa.list_(pa.binary())), ("roots", pa.list_(pa.binary()))])


@dataclass
class Bucket:
    """One bucket's words (with their place among the frequent ones, or -1), how many pairs of one customer and of several each has, the latter by word and context, and these contexts' numbers and customers."""

    words: np.ndarray
    hot: np.ndarray
    single: np.ndarray
    each: np.ndarray
    c: np.ndarray
    n: np.ndarray
    numbers: np.ndarray
    sits: np.ndarray

    def __post_init__(self) -> None:
        #: the word of each pair
        self.word = np.repeat(np.arange(len(self.each)), self.each)

    @classmethod
    def open(cls, row: dict) -> "Bucket":
        return cls(*(_open(row[k], t) if t == "<u8" else _open(row[k], t).astype(np.int64) for k, t in _FIELDS.items()))

    def customers(self, t: np.ndarray) -> np.ndarray:
        """The root's customers of each word: the tables of its pairs here."""
        return self.single + np.bincount(self.word, weights=t, minlength=len(self.words)).astype(np.int64)


def _by_home(rows: pa.Table, *kinds: tuple[str, str]) -> Iterator[np.ndarray]:
    """Packed columns of a bucket's rows, joined in the order of ``home``."""
    found = sorted(rows.select(["home", *(k for k, _ in kinds)]).to_pylist(), key=lambda r: r["home"])
    return (np.concatenate([np.zeros(0, dtype=t), *(_open(r[k], t) for r in found)]) for k, t in kinds)


def _first_state(merged: DataFrame, known: Lexicon) -> DataFrame:
    """The buckets with every dish at one table, and the numbers and customers of their contexts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                contexts = _open(row["contexts"], "<u8")
                home = _home(_marks(contexts), known.buckets) // HOME_BUCKETS
                first, each = _runs(home)
                out = [home[first], np.full(len(first), row["bucket"]), [_pack(contexts[a : a + k]) for a, k in zip(first, each, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["home", "bucket", "contexts"])

    def tell(asked: pa.Table, own: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows:
            home = asked.column("home")[0].as_py()
            group = known.group(home)
            words, counts = known.words(group, own.to_pylist())
            for r in asked.select(["bucket", "contexts"]).to_pylist():
                at = np.searchsorted(words, _open(r["contexts"], "<u8"))
                out.append((r["bucket"], home, _pack(known.first[group[0]] + at), _pack(counts[at])))
        return pa.table({k: pa.array([x[i] for x in out], type=t) for i, (k, t) in enumerate((("bucket", pa.int64()), ("home", pa.int64()), ("numbers", pa.binary()), ("sits", pa.binary())))})

    def begin(own: pa.Table, told: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        numbers, sits = _by_home(told, ("numbers", "<i8"), ("sits", "<i8"))
        start = np.flatnonzero(_open(row["contexts"], "<u8") == END)
        row |= {"start": int(numbers[start[0]]) if len(start) else -1, "numbers": _pack(numbers), "sits": _pack(sits)}
        b = Bucket.open(row)
        t = np.ones(len(b.n), dtype="<u4")
        row |= {"samples": [_pack(t)], "roots": [_pack((b.customers(t) > 0).astype("<u4"))]}
        return pa.Table.from_pylist([{k: row[k] for k in _STATE_ARROW.names}], schema=_STATE_ARROW)

    asked = merged.select("bucket", "contexts").mapInArrow(ask, "home long, bucket long, contexts binary")
    own = merged.select(F.expr(f"bucket div {HOME_BUCKETS}").alias("home"), "words", "hot", "wn")
    told = asked.groupBy("home").cogroup(own.groupBy("home")).applyInArrow(tell, "bucket long, home long, numbers binary, sits binary")
    return merged.drop("asked", "wn").groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(begin, _STATE)


def _joined(state: DataFrame, known: Lexicon) -> DataFrame:
    """How many customers of each context joined a table of others, over all buckets, after the last sweep: for the contexts of each bucket by ``home``, and where that is null for all words of the bucket's range."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b, t = Bucket.open(row), _open(row["samples"][-1], "<u4").astype(np.int64)
                more = np.bincount(b.c, weights=b.n - t, minlength=len(b.numbers)).astype(np.int64)
                home = (np.searchsorted(known.first, b.numbers, side="right") - 1) // HOME_BUCKETS
                place = b.numbers - known.first[home * HOME_BUCKETS]
                first, each = _runs(home)
                out = [home[first], np.full(len(first), row["bucket"]), *([_pack(x[a : a + k].astype(t)) for a, k in zip(first, each, strict=True)] for x, t in ((place, "<u4"), (more, "<i8")))]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["home", "bucket", "place", "more"])

    def add(asked: pa.Table) -> pa.Table:
        home, rows = asked.column("home")[0].as_py(), asked.select(["bucket", "place", "more"]).to_pylist()
        group = known.group(home)
        cut = known.first[group[0] : group[-1] + 2] - known.first[group[0]]
        total = np.zeros(int(cut[-1]), dtype=np.int64)
        for r in rows:
            total[_open(r["place"], "<u4")] += _open(r["more"], "<i8")
        out = [(r["bucket"], home, _pack(total[_open(r["place"], "<u4")])) for r in rows]
        out += [(b, None, _pack(total[x:y])) for b, x, y in zip(group.tolist(), cut[:-1], cut[1:], strict=True)]
        return pa.table({k: pa.array([x[i] for x in out], type=t) for i, (k, t) in enumerate((("bucket", pa.int64()), ("home", pa.int64()), ("more", pa.binary())))})

    return state.mapInArrow(ask, "home long, bucket long, place binary, more binary").groupBy("home").applyInArrow(add, "bucket long, home long, more binary")


def _hot_joined(joined: DataFrame, known: Lexicon) -> np.ndarray:
    """Of the frequent words as contexts, how many customers joined a table of others; a row for each bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = known.numbers[known.of(np.array([row["bucket"]]))] - known.first[row["bucket"]]
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]]), pa.array([_pack(_open(row["more"], "<i8")[at])], type=pa.binary())], ["bucket", "more"])

    out = np.zeros(len(known.hot), dtype=np.int64)
    for r in joined.filter("home is null").select("bucket", "more").mapInArrow(run, "bucket long, more binary").collect():
        out[known.of(np.array([r.bucket]))] = _open(r.more, "<i8")
    return out


@dataclass(frozen=True)
class Totals:
    """Sums over all buckets after one sweep: customers and tables of the root, all and of each frequent word."""

    root_customers: int
    root_tables: int
    hot_customers: np.ndarray
    hot_tables: np.ndarray
    discount: float
    root_discount: float
    vocabulary: int

    def root_base(self, s: Sweeps) -> float:
        """What a new table of the root weighs for each word."""
        return (s.root_strength + self.root_discount * self.root_tables) / (self.vocabulary + 1)

    def root(self, customers: np.ndarray, tables: np.ndarray, s: Sweeps) -> np.ndarray:
        """The root's probability of words with so many customers at so many tables."""
        return (customers - self.root_discount * tables + self.root_base(s)) / (s.root_strength + self.root_customers)


def uniform(key: np.ndarray, customer: np.ndarray) -> np.ndarray:
    """The number between 0 and 1 that decides on the seat of a dish's customer."""
    return ((_mixed(key, customer) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def seat(n: np.ndarray, base: np.ndarray, step: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """Tables of each dish after its n customers sit down one after another.

    With k customers at t tables, a new table weighs a = base + step * t and the old ones
    k - d t. A dish of very many customers is seated in stretches of ``TOGETHER``.
    """
    t, sat = np.minimum(n, 1), np.minimum(n, 1)
    while True:
        live = np.flatnonzero(n > sat)
        if not len(live):
            return t
        size = np.minimum(n[live] - sat[live], TOGETHER)
        now = live[: max(1, int(np.searchsorted(np.cumsum(size), TOGETHER, side="right")))]
        t[now] = _seated(sat[now], size[: len(now)], t[now], base[now], step[now], d, key[now])
        sat[now] += size[: len(now)]


def _seated(sat: np.ndarray, size: np.ndarray, t: np.ndarray, base: np.ndarray, step: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """Tables after ``size`` more customers of each dish.

    Each pass seats all customers as if the tables before them were those of the pass
    before, beginning with none opened. A pass gets at least one more customer of a dish
    right, those before being right; the dish is done when a pass changes nothing, which
    takes a few passes, as one table more or less seldom changes a choice.
    """
    out, left = t.copy(), np.arange(len(t))
    dish = np.repeat(left, size)
    k = sat[dish] + np.arange(len(dish)) - (np.cumsum(size) - size)[dish]
    u, tables = uniform(key[dish], k), t[dish].astype(np.float64)
    while len(left):
        # places of the dishes that are left, and of each of their customers
        first = np.flatnonzero(np.r_[True, dish[1:] != dish[:-1]])
        spot = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(dish))))
        new = base[dish] + step[dish] * tables
        opens = u * (new + np.maximum(k - d * tables, 1e-9)) < new
        before = np.cumsum(opens) - opens
        path = t[dish] + before - before[first][spot]
        moved = np.logical_or.reduceat(path != tables, first)
        last = np.append(first[1:], len(dish)) - 1
        out[dish[last]] = path[last] + opens[last]
        stay = moved[spot]
        left, dish, k, u, tables = dish[first][moved], dish[stay], k[stay], u[stay], path[stay].astype(np.float64)
    return out


def _sweep(bucket: Bucket, start: int, t: np.ndarray, root: np.ndarray, more: np.ndarray, now: Totals, s: Sweeps, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """One sweep over a bucket's dishes; every dish sees the others as they were after the sweep before, when ``more`` customers of each context had joined a table of others."""
    m = bucket.customers(t)
    is_hot = bucket.hot >= 0
    m[is_hot] = now.hot_customers[bucket.hot[is_hot]]
    tables = np.where(is_hot, now.hot_tables[np.maximum(bucket.hot, 0)] if is_hot.any() else 0, root)
    word, c = bucket.word, bucket.c
    # the parent's prediction without the dish's own tables
    rest = np.maximum(m[word] - t, 0)
    p = (rest - now.root_discount * np.minimum(tables[word], rest) + now.root_base(s)) / (s.root_strength + now.root_customers)
    others = (bucket.sits - more)[c] - t
    number = np.where(bucket.numbers == start, 0, FIRST + bucket.numbers)[c]
    new = seat(bucket.n, (s.strength + now.discount * others) * p, now.discount * p, now.discount, _mixed(s.seed, sweep, bucket.words[word], number + 1))
    return new, root_tables(bucket.words, np.where(is_hot, 0, bucket.customers(new)), now, s, sweep)


def root_tables(words: np.ndarray, customers: np.ndarray, now: Totals, s: Sweeps, sweep: int) -> np.ndarray:
    """The root's tables of words with so many customers."""
    return seat(customers, np.full(len(words), now.root_base(s)), np.zeros(len(words)), now.root_discount, _mixed(s.seed, sweep, words, 0))


def _swept(state: DataFrame, joined: DataFrame, now: Totals, s: Sweeps, sweep: int, keep: bool) -> DataFrame:
    """The state after one more sweep, which is added to the samples or takes the last one's place."""

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        samples, roots = row["samples"], row["roots"]
        t, root = (_open(x[-1], "<u4").astype(np.int64) for x in (samples, roots))
        (more,) = _by_home(found, ("more", "<i8"))
        t, root = _sweep(Bucket.open(row), row["start"], t, root, more, now, s, sweep)
        kept = -1 if not keep else len(samples)
        row["samples"], row["roots"] = [*samples[:kept], _pack(t.astype("<u4"))], [*roots[:kept], _pack(root.astype("<u4"))]
        return pa.Table.from_pylist([row], schema=_STATE_ARROW)

    return state.groupBy("bucket").cogroup(joined.filter("home is not null").groupBy("bucket")).applyInArrow(run, _STATE)


def _totals(state: DataFrame, before: Totals | None, known: Lexicon, s: Sweeps, sweep: int) -> Totals:
    """Sums over all buckets of the last sample; a row for each frequent word reaches the driver."""
    hot = known.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Bucket.open(row)
                t, root = (_open(x[-1], "<u4").astype(np.int64) for x in (row["samples"], row["roots"]))
                m = b.customers(t)
                rare = b.hot < 0
                # kinds: 1 a frequent word's customers of the root, 2 and on sums of rare words
                sums = [(int(m[rare].sum()), int(root[rare].sum())), (int(b.single.sum()), int((b.n == 2).sum())), (int((m[rare] == 1).sum()), int((m[rare] == 2).sum()))]
                kind = [1] * int((~rare).sum()) + [2, 3, 4]
                key = [*b.hot[~rare].tolist(), 0, 0, 0]
                x = [*m[~rare].tolist(), *(v for v, _ in sums)]
                y = [*[0] * int((~rare).sum()), *(v for _, v in sums)]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=pa.int64()) for v in (kind, key, x, y)], ["kind", "key", "x", "y"])

    rows = state.mapInArrow(run, "kind long, key long, x long, y long").groupBy("kind", "key").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()
    hot_customers = np.zeros(len(hot), dtype=np.int64)
    sums = {k: (0, 0) for k in (2, 3, 4)}
    for r in rows:
        if r.kind == 1:
            hot_customers[r.key] = r.x
        else:
            sums[r.kind] = (r.x, r.y)
    share = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
    if before is None:
        discount, root_discount = share(*sums[3]), share(sums[4][0] + int((hot_customers == 1).sum()), sums[4][1] + int((hot_customers == 2).sum()))
        hot_tables = np.minimum(hot_customers, 1)
    else:
        discount, root_discount = before.discount, before.root_discount
        hot_tables = root_tables(hot, hot_customers, before, s, sweep)
    return Totals(sums[2][0] + int(hot_customers.sum()), sums[2][1] + int(hot_tables.sum()), hot_customers, hot_tables, discount, root_discount, int(known.first[-1]))


def _answers(state: DataFrame, merged: DataFrame, joined: DataFrame, known: Lexicon) -> DataFrame:
    """block, bucket and for all that the block asked there: training counts and, for each sample, the root's customers and tables of the rare words and the customers of theirs that joined a table; customers and, for each sample, tables of the pairs."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("wn", pa.binary()), ("m", pa.list_(pa.binary())), ("root", pa.list_(pa.binary())), ("more", pa.list_(pa.binary())), ("n", pa.binary()), ("t", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b, wn = Bucket.open(row), _open(row["wn"], "<i8")
                tables, roots = ([_open(x, "<u4").astype(np.int64) for x in row[k]] for k in ("samples", "roots"))
                m = [b.customers(t) for t in tables]
                words, _ = known.words(np.array([row["bucket"]]), [row])
                own = (b.hot < 0) & (wn > 0)
                more = [np.zeros(len(wn), dtype=np.int64) for _ in tables]
                for x in row["joined"] or []:
                    more[x["sample"]][own] = _open(x["more"], "<i8")[np.searchsorted(words, b.words[own])]
                first = np.cumsum(b.each) - b.each
                # pairs that training has not, those of one customer, those of several
                n, t = np.concatenate([[0, 1], b.n]), [np.concatenate([[0, 1], x]) for x in tables]
                for ask in row["asked"]:
                    at, pair = _open(ask["at"], "<u4").astype(np.int64), _open(ask["pair"], "<u4").astype(np.int64)
                    pair += np.where(pair > 1, np.repeat(first[at], _open(ask["each"], "<u4")), 0)
                    at = at[b.hot[at] < 0]
                    out = {"block": ask["block"], "bucket": row["bucket"], "wn": _pack(wn[at]), "m": [_pack(x[at]) for x in m], "root": [_pack(x[at].astype("<u4")) for x in roots], "more": [_pack(x[at]) for x in more], "n": _pack(n[pair].astype("<u4")), "t": [_pack(x[pair].astype("<u4")) for x in t]}
                    yield pa.RecordBatch.from_pylist([out], schema=schema)

    sums = joined.groupBy("bucket").agg(F.collect_list(F.struct("sample", "more")).alias("joined"))
    table = state.join(merged.select("bucket", "wn", "asked").hint("merge"), "bucket").join(sums.hint("merge"), "bucket", "left")
    return table.mapInArrow(run, "block long, bucket long, wn binary, m array<binary>, root array<binary>, more array<binary>, n binary, t array<binary>")


def probabilities(n: np.ndarray, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, root: np.ndarray, now: Totals, s: Sweeps) -> np.ndarray:
    """Predictive probabilities of dishes with n customers at t tables in restaurants of so many, and the parent's probability ``root``."""
    return (n - now.discount * t + (s.strength + now.discount * tables) * root) / (s.strength + customers)


def _scored(table: DataFrame, answers: DataFrame, known: Lexicon, n_train: int, totals: list[Totals], hot_joined: list[np.ndarray], s: Sweeps, id_col: str) -> DataFrame:
    """One row a document: every block with the answers to it."""
    schema = pa.schema([(id_col, pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        pairs, answers = Pairs(row, known.buckets), found.to_pylist()
        is_hot = pairs.hot_at >= 0
        spots = pairs.hot_at[is_hot]
        asked = [pairs.of(int(np.searchsorted(pairs.buckets, a["bucket"]))) for a in answers]
        rare = [w[pairs.hot_at[w] < 0] for _, w, _ in asked]

        def by_word(hot: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
            out = np.zeros(len(is_hot), dtype=np.int64)
            out[is_hot] = hot[spots]
            for w, x in zip(rare, found, strict=True):
                out[w] = x
            return out

        def by_pair(found: list[np.ndarray]) -> np.ndarray:
            out = np.zeros(len(pairs.word), dtype=np.int64)
            for (at, _, _), x in zip(asked, found, strict=True):
                out[at] = x
            return out

        count, n, p = by_word(known.counts, [_open(a["wn"], "<i8") for a in answers]), by_pair([_open(a["n"], "<u4") for a in answers]), np.zeros(len(pairs.word))
        for k, now in enumerate(totals):
            m, root, more = (by_word(x, [_open(a[f][k], t) for a in answers]) for x, f, t in ((now.hot_customers, "m", "<i8"), (now.hot_tables, "root", "<u4"), (hot_joined[k], "more", "<i8")))
            p += probabilities(n, by_pair([_open(a["t"][k], "<u4") for a in answers]), count[pairs.context], (count - more)[pairs.context], now.root(m, root, s)[pairs.word], now, s)
        logp = np.log10(p / len(totals))
        n_docs = len(row["n_tokens"])
        base = np.log10((count + 0.5) / (n_train + 0.5 * (totals[0].vocabulary + 1)))
        by_doc = lambda x: np.bincount(pairs.doc, weights=x, minlength=n_docs)
        columns = [row["doc_ids"], row["held"], row["n_tokens"], by_doc((count > 0)[pairs.ids]).astype(np.int64), np.full(n_docs, n_train), by_doc(base[pairs.ids]), by_doc(logp[pairs.inverse])]
        del row, pairs, answers, asked, rare, count, logp, base, n, p
        textops.trim(0)
        return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    types = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def slimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([_slim(r, known.hot)], schema=_SLIM)

    slim = table.drop("counts", "n_train", "n_words").mapInArrow(slimmed, "block long, doc_ids array<long>, n_tokens array<int>, held array<boolean>, ids binary, marks binary, hot_spot binary, hot binary")
    return slim.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, types)


def score_texts(df: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text", sweeps: Sweeps = Sweeps()) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row."""
    table = space.written(blocks(df, id_col, text_col), "blocks")
    n_train, n_words = (x or 0 for x in table.agg(F.sum("n_train"), F.sum("n_words")).first())
    hot, hot_counts = frequent(table, n_train)
    buckets = max(1, -(-n_words // BUCKET_WORDS))

    merged = space.written(_requests(table, hot, buckets).groupBy("bucket").applyInArrow(_merged(hot), _MERGED_SQL), "merged", tidy=True)
    known = lexicon(merged, hot, hot_counts, buckets)
    state = space.written(_first_state(merged, known), "state-0", tidy=True)
    now, totals, sums, hot_joined = _totals(state, None, known, sweeps, 0), [], [], []
    joined = space.written(_joined(state, known), "joined-0", tidy=True)
    for k in range(1, sweeps.burn_in + sweeps.samples + 1):
        keep = k > sweeps.burn_in + 1
        state = space.written(_swept(state, joined, now, sweeps, k, keep), f"state-{k}", tidy=True)
        space.drop(f"state-{k - 1}", *([f"joined-{k - 1}"] if k <= sweeps.burn_in + 1 else []))
        now = _totals(state, now, known, sweeps, k)
        joined = space.written(_joined(state, known), f"joined-{k}", tidy=True)
        if k > sweeps.burn_in:
            sums.append(joined.filter("home is null").select("bucket", F.lit(len(totals)).alias("sample"), "more"))
            totals.append(now)
            hot_joined.append(_hot_joined(joined, known))
    answers = _answers(state, merged, functools.reduce(DataFrame.unionAll, sums), known)
    return _scored(table, answers, known, n_train, totals, hot_joined, sweeps, id_col)


def op7_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a model of four fifths of them."""
    return score_texts(documents(spark, sf_dir), Workspace(spark, "lm"))


QUERIES = {"op7_lmscore": op7_lmscore}
