"""MinHash near-dedup with HyperMinHash sketches.

1. One pass over the texts gives each document's number of distinct
   shingles, a 128-bit fingerprint of the set, and its sketch: 128 buckets,
   each with the leading-zero count and ten mantissa bits of its smallest
   hash. Empty buckets of short texts borrow from others by a fixed probe
   sequence, so that agreement stays near the Jaccard index.
2. Documents with equal sets are one class, stood for by its smallest id.
3. Bands of four compressed registers bring classes together: at a
   similarity of 0.8, 32 bands miss a pair with a chance of 5e-8. In every
   band group each class is first paired with the group's smallest id only,
   and only its most frequent such partner is checked.
4. Pairs whose sizes and collision-corrected estimate allow it are checked
   on their full sets; links give components.
5. What is left are groups whose members lie in several components. There,
   members outside the largest component are compared, in blocks, with all
   members of other components: sizes and estimates first, then full sets, by
   products of incidence matrices. Only links become rows, one for each
   component that a member reaches. So no link between components goes
   unchecked, and no group is expanded into all its pairs.

Band keys, hubs, sets of copies and centres of stars with more than a
thousandth of all rows are dealt to parts where rows are joined by them.

Shingles are told apart by 64-bit hashes, built from the words' own: a
bijection of words up to eight bytes and BLAKE2b beyond.

Defined results: texts without words have no shingles and are linked with
nothing; rows with the same id are one document, linked by any of its
texts; a row without id has no component and is kept; an empty table gives
no rows; other columns pass through or are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import textops
from leafloom.llm.components import components
from leafloom.llm.shared import HotKeys, Workspace, documents

U64 = np.uint64
BUCKET_BITS, MANTISSA_BITS, BAND = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
#: Expected share of chance agreements of two registers (the sketch's published constant).
COLLISION = 0.169919487159739093975315012348630288992 / (1 << MANTISSA_BITS)
PROBES = 256
BLOCK_ROWS = 512
_probe = np.random.default_rng(7).integers(0, BUCKETS, (PROBES, BUCKETS))


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, sorted by both; a shorter text is one shingle."""
    words = textops.Words(offsets, raw, lower=True)
    hashes = words.hashes()
    at, value = words.windows(hashes, size)
    doc = words.doc[at]
    counts, first = words.counts, words.first[:-1]
    more = []
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        acc = np.full(len(short), n, dtype=U64)
        for k in range(n):
            acc = textops.chained(acc, hashes[first[short] + k])
        more.append((short, acc))
    doc = np.concatenate([doc, *(d for d, _ in more)])
    value = np.concatenate([value, *(v for _, v in more)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[fresh], value[fresh]


def registers(doc: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs x BUCKETS registers of sorted sets; zero is an empty bucket."""
    table = np.zeros(n_docs * BUCKETS, dtype=np.uint16)
    place = doc * BUCKETS + (value >> U64(64 - BUCKET_BITS)).astype(np.int64)
    lead = np.ones(len(place), dtype=bool)
    lead[1:] = place[1:] != place[:-1]
    rest = value[lead] << U64(BUCKET_BITS)  # the smallest of its bucket comes first
    length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    length -= (length > 0) & ((rest >> np.maximum(length - 1, 0).astype(U64)) == 0)  # the conversion may round up
    down, up = np.maximum(length - 1 - MANTISSA_BITS, 0).astype(U64), np.maximum(MANTISSA_BITS + 1 - length, 0).astype(U64)
    mantissa = ((rest >> down) << up) & U64((1 << MANTISSA_BITS) - 1)
    zeros = np.minimum(64 - length, 62) + 1
    table[place[lead]] = (zeros << MANTISSA_BITS) | mantissa.astype(np.int64)
    return table.reshape(n_docs, BUCKETS)


def densify(table: np.ndarray) -> np.ndarray:
    """Fills empty buckets from the first non-empty one of their probe sequence."""
    out = table.copy()
    row, bucket = np.nonzero(table == 0)
    some = table.any(axis=1)
    keep = some[row]
    row, bucket = row[keep], bucket[keep]
    for probe in _probe:
        if not len(row):
            break
        found = table[row, probe[bucket]]
        hit = found > 0
        out[row[hit], bucket[hit]] = found[hit]
        row, bucket = row[~hit], bucket[~hit]
    if len(row):
        out[row, bucket] = table[row, (table[row] > 0).argmax(axis=1)]
    return out


def _column(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    return textops.strings(batch.column(at))


def sketches(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n, f1, f2, regs of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, 1):
                n = part.num_rows
                doc, value = shingle_sets(*_column(part, 1), size)
                count = np.bincount(doc, minlength=n)
                begin = np.concatenate([[0], np.cumsum(count)])
                prints = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    total = np.zeros(len(value) + 1, dtype=U64)
                    np.cumsum(textops.mix(value ^ U64(salt)), out=total[1:])
                    prints.append((total[begin[1:]] - total[begin[:-1]]).view(np.int64))
                table = densify(registers(doc, value, n)).astype("<u2")
                regs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BUCKETS), n, [None, pa.py_buffer(table.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count, type=pa.int64()), pa.array(prints[0]), pa.array(prints[1]), regs], ["id", "n", "f1", "f2", "regs"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, f1 long, f2 long, regs binary")


def _member_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bit set of id hashes, of at most 2**24 bits, that lets every one of the ids through."""
    n = ids.count()
    bits = 1 << min(24, max(12, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(F.floor(place / 32).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(32)).cast("int")).alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    table = np.zeros(bits // 32, dtype=np.uint32)
    for r in rows:
        table[r.w] = r.b
    return table, bits


def sets_of(df: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, s: the full sets, as sorted arrays, of the documents named in ``ids``.

    A bit set of bounded size keeps most other texts from being parsed; a semi-join
    decides. It lets more through on a larger table, which costs time only.
    """
    table, bits = _member_filter(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) % bits
            named = batch.filter(pa.array((table[place // 32] >> (place % 32).astype(np.uint32)) & 1 == 1)).select([0, 1])
            for part in textops.slices(named, 1):
                doc, value = shingle_sets(*_column(part, 1), size)
                begin = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(begin, type=pa.int32()), pa.array(value.view(np.int64)))], ["id", "s"])

    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(run, "id long, s array<long>")
    return found.filter(F.size("s") > 0).join(ids, "id", "left_semi")


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of registers, row by row."""
    return ((a == b).mean(axis=-1) - COLLISION) / (1 - COLLISION)


def _least(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """The least estimate worth a check: six deviations under the threshold, with as many independent registers as the smaller set fills."""
    t = percent / 100
    filled = BUCKETS * -np.expm1(-np.minimum(n_a, n_b) / BUCKETS)
    return t - 6 * np.sqrt(t * (1 - t) / filled)


def _sizes_allow(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, BUCKETS)


def _promising(pairs: DataFrame, reps: DataFrame, percent: int, hot: HotKeys) -> DataFrame:
    """The pairs (a, b) whose sizes and estimates allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
            if batch.num_rows:
                ok = _sizes_allow(n_a, n_b, percent) & (agreements(_regs(batch.column(3)), _regs(batch.column(5))) >= _least(n_a, n_b, percent))
                yield batch.select([0, 1]).filter(pa.array(ok))

    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"r_{c}"))
    both = hot.join(pairs.join(side("a"), "a"), side("b"), ["a"]).select("a", "b", "n_a", "r_a", "n_b", "r_b")
    return both.mapInArrow(run, "a long, b long").distinct()


def _links(pairs: DataFrame, sets: DataFrame, percent: int, hot: HotKeys) -> DataFrame:
    """The pairs that are linked by their full sets."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}"))
    both = hot.join(pairs.join(side("a"), "a"), side("b"), ["a"])
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(100 * shared >= percent * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b").distinct()


def _linked_blocks(members: DataFrame, percent: int) -> DataFrame:
    """a, b: links between different components of each group, one of a row to each component it reaches.

    ``members``: hub, id, comp, s, n, regs, out (not of the group's largest component), size, n_out.
    Outsiders and members are dealt to blocks; a task sees one block of each and compares all
    of the one with all of the other: sizes and estimates first, then whole sets, as products
    of incidence matrices over the shingles that both blocks hold.
    """
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.ceil(F.col(n) / BLOCK_ROWS)).cast("int")
    every = lambda n: F.sequence(F.lit(0), (F.ceil(F.col(n) / BLOCK_ROWS) - 1).cast("int"))
    rows = ["hub", "id", "comp", "n", "regs", "s"]
    outside = members.filter("out").select(*rows, F.lit(True).alias("asks"), deal("n_out", 1).alias("x"), F.explode(every("size")).alias("y"))
    inside = members.select(*rows, F.lit(False).alias("asks"), F.explode(every("n_out")).alias("x"), deal("size", 2).alias("y"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        one, two = (_Block(table.filter(pa.array(m))) for m in (asks, ~asks))
        found: list[tuple[int, int]] = []
        if len(one.ids) and len(two.ids):
            maybe = (one.comp[:, None] != two.comp[None, :]) & _sizes_allow(one.n[:, None], two.n[None, :], percent)
            for i in np.flatnonzero(maybe.any(axis=1)):
                j = np.flatnonzero(maybe[i])
                maybe[i, j] = agreements(two.regs[j], one.regs[i]) >= _least(two.n[j], one.n[i], percent)
            shared = one.shared_with(two, maybe.any(axis=1), maybe.any(axis=0))
            linked = maybe & (100 * shared >= percent * (one.n[:, None] + two.n[None, :] - shared))
            for i in np.flatnonzero(linked.any(axis=1)):
                j = np.flatnonzero(linked[i])
                for k in j[np.unique(two.comp[j], return_index=True)[1]]:
                    found.append((max(one.ids[i], two.ids[k]), min(one.ids[i], two.ids[k])))
        del one, two
        textops.trim(0)
        return pa.table([pa.array([f[i] for f in found], type=pa.int64()) for i in (0, 1)], schema=schema)

    return outside.unionAll(inside).groupBy("hub", "x", "y").applyInArrow(run, "a long, b long").distinct()


class _Block:
    """Rows of one block as arrays; the sets as one run of shingles."""

    def __init__(self, table: pa.Table) -> None:
        self.ids, self.comp, self.n = (table.column(c).to_numpy() for c in ("id", "comp", "n"))
        self.regs = _regs(table.column("regs"))
        lists = table.column("s").combine_chunks()
        self.items = lists.flatten().to_numpy()
        self.row = np.repeat(np.arange(len(self.ids)), lists.value_lengths().to_numpy(zero_copy_only=False))

    def shared_with(self, other: "_Block", rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the marked rows with the marked ones of the other block."""
        out = np.zeros((len(self.ids), len(other.ids)), dtype=np.float32)
        mine, theirs = rows[self.row], columns[other.row]
        both = np.intersect1d(self.items[mine], other.items[theirs])
        for at in range(0, len(both), 4096):
            part = both[at : at + 4096]
            out += _incidence(self, mine, part) @ _incidence(other, theirs, part).T
        return out


def _incidence(block: _Block, marked: np.ndarray, part: np.ndarray) -> np.ndarray:
    items, row = block.items[marked], block.row[marked]
    at = np.minimum(np.searchsorted(part, items), len(part) - 1)
    hit = part[at] == items
    out = np.zeros((len(block.ids), len(part)), dtype=np.float32)
    out[row[hit], at[hit]] = 1
    return out


def near_duplicates(df: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id, kept for every row; links where 100 |a & b| >= percent |a | b|."""
    docs = space.written(sketches(df, id_col, text_col, size), "sketches")
    equal = ["f1", "f2", "n"]
    some = docs.filter("n > 0 and id is not null")
    # equal sets have equal registers
    classes = space.written(some.groupBy(*equal).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c"), F.first("regs").alias("regs")), "classes", few=True)
    reps = classes.select(F.col("rep").alias("id"), "n", "regs")

    keys = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // BAND - 1)), lambda b: F.xxhash64(b, F.substring("regs", b * (2 * BAND) + 1, F.lit(2 * BAND))))
    bands = reps.select("id", F.explode(keys).alias("key"))
    hubs = space.written(bands.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "hubs", few=True)
    groups = space.written(HotKeys(hubs, ["key"], "c", look=True).join(bands, hubs.drop("c"), ["id"]).select("hub", "id"), "groups", few=True)
    sets = space.written(sets_of(df, groups.select("id").distinct(), id_col, text_col, size), "sets")

    often = groups.filter("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("c"))
    first = often.groupBy("id").agg(F.max(F.struct("c", (-F.col("hub")).alias("h"))).alias("m")).select(F.col("id").alias("a"), (-F.col("m.h")).alias("b"))
    first = space.written(first, "first", few=True)
    hot = HotKeys(first.groupBy("b").agg(F.count(F.lit(1)).alias("c")), ["b"], "c", look=True)
    # rows of one id are one document, so an id links the classes of all its texts
    several = some.groupBy("id").agg(F.min(F.struct(*equal)).alias("lo"), F.max(F.struct(*equal)).alias("hi")).filter("lo <> hi").select("id")
    own = some.select("id", *equal).join(several, "id").join(classes.select(*equal, "rep"), equal).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = space.written(_links(_promising(first, reps, percent, hot), sets, percent, hot).unionAll(own), "links", few=True)
    comp = components(links, space, "comp-a")

    # two classes that share a band share its group's hub, so what is left lies among the members of one hub
    placed = groups.select("hub", "id").distinct().join(comp.withColumnRenamed("node", "id"), "id", "left").select("hub", "id", F.coalesce("component", "id").alias("comp"))
    parts = placed.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("c"))
    split = parts.groupBy("hub").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    split = space.written(split.select("hub", F.col("top.comp").alias("top"), "size", (F.col("size") - F.col("top.c")).alias("n_out")), "split", few=True)
    left = HotKeys(split, ["hub"], "size", look=True).join(placed, split, ["id"]).join(reps, "id").join(sets, "id").select("hub", "id", "comp", F.size("s").cast("long").alias("n"), "regs", "s", (F.col("comp") != F.col("top")).alias("out"), "size", "n_out")
    more = space.written(_linked_blocks(left, percent), "links-more", few=True)
    comp = components(links.unionAll(more), space, "comp-b")

    labels = classes.select("rep", *equal).join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(*equal, F.coalesce("component", "rep").alias("component"))
    out = HotKeys(classes.select(*equal, "c"), equal, "c", look=True).join(docs.select("id", *equal), labels, ["id"], how="left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("id") == found, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of which one document of each component stays, the one with the smallest id, with all their columns."""
    gone = near_duplicates(df, space, id_col, text_col, size, percent).filter("not kept").select(F.col(id_col).alias("_nd_id")).distinct()
    return df.join(gone, df[id_col] == gone["_nd_id"], "left_anti")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate ``documents``: four-word shingles, 80 percent."""
    docs = documents(spark, sf_dir)
    return near_duplicates(docs, Workspace(spark, "neardup"), size=4, percent=80)


QUERIES = {"op4_neardup": op4_neardup}

#: Exact sets and all links, for tables of a size that SQL can still pair.
ORACLES = {
    "op4_neardup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, doc_id = c.m AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) c USING (doc_id)"""
}
