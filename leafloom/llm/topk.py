"""Exact top-k inner products by branch and bound over ball trees.

Space is cut into regions by a ball tree over a bounded sample (``SAMPLE``
vectors, ``REGION_SAMPLE`` a region); the sample decides only where rows lie,
and each region's radius is taken over all its rows. Neighbouring regions
together make a group of about a shard's rows; a region of more rows is a group
by itself and is dealt to parts by a hash of the id, so one very common vector
makes no hot shard. Each shard, a group's part, builds its own ball tree. A block of queries goes down a tree together: at each node the
queries whose upper bound, q.c + |q| r, reaches their current k-th score stay
active, the child with the higher bounds comes first, and leaves are scored
with one matrix product.

The k-th score is shared in two rounds: first each query searches one shard of
the group with the best centre; then the regions' bounds are compared with
the k-th score found there, and the query is sent to those shards only that
hold a region whose bound reaches it. Rows are copied only where more queries come than one block
holds. Regions' centres, radii and counts are all that reaches the driver.

Only the stated queries meet all rows, in blocks of both. Vectors that are null
or hold null or non-finite components, or one of 2^63 or more, take no part;
vectors meet only others of their own dimension; rows with a query's id are
never its results; rows with equal ids are each a candidate; query rows of one
id are one query, for which a candidate has the best of their scores; equal
scores go to the smaller id. Scores are exact integers; those beyond 64 bits
count as the largest or smallest one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.shared import Workspace

K = 20
SCALE = 64
SHARD_ROWS = 4096
QUERY_ROWS = 8192
LEAF_ROWS = 128
SAMPLE, REGION_SAMPLE = 32768, 16
_NONE = -(1 << 63)
_MOST = (1 << 63) - 1


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: slice
    children: tuple["Node", ...] = ()
    #: rows with a projection on the normal below the cut belong to the first child
    normal: np.ndarray | None = None
    cut: float = 0.0
    region: int = -1


class BallTree:
    """Rows are reordered so that each node's are neighbours."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF_ROWS, widest: float = np.inf) -> None:
        """Nodes of more rows than ``leaf`` or a wider radius than ``widest`` are split."""
        self.order, self.leaf, self.widest = np.arange(len(vectors)), leaf, widest
        self.vectors = vectors.astype(np.float64)
        self.root = self._build(0, len(vectors))

    def _build(self, lo: int, hi: int) -> Node:
        rows = self.vectors[lo:hi]
        centre = rows.mean(axis=0)
        off = rows - centre
        far = np.einsum("ij,ij->i", off, off)
        node = Node(centre, float(np.sqrt(far.max())), slice(lo, hi))
        if (hi - lo > self.leaf or node.radius > self.widest) and node.radius > 0:
            # split along two far-apart rows, at the widest gap of the middle half so that clusters stay whole and depth logarithmic
            a = rows[far.argmax()]
            b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
            normal = b - a  # before the rows, which these are views of, change places
            along = rows @ normal
            rank = np.argsort(along, kind="stable")
            self.vectors[lo:hi], self.order[lo:hi] = rows[rank], self.order[lo:hi][rank]
            n = hi - lo
            gaps = np.diff(along[rank][n // 4 : n - n // 4])
            mid = lo + (n // 4 + 1 + int(gaps.argmax()) if len(gaps) and gaps.max() > 0 else n // 2)
            node.normal, node.cut = normal, float(along[rank[mid - lo - 1 : mid - lo + 1]].mean())
            node.children = (self._build(lo, mid), self._build(mid, hi))
        return node


class Regions:
    """The leaves of a ball tree over a sample, as regions of the whole space."""

    def __init__(self, sample: np.ndarray, leaf: int) -> None:
        # a leaf across two clusters would be reached by most queries, so those far wider than others are split on
        usual = np.median([node.radius for node in self._leaves(BallTree(sample, leaf).root)])
        self.root = BallTree(sample, leaf, 2 * usual if usual > 0 else np.inf).root
        leaves = list(self._leaves(self.root))
        for i, node in enumerate(leaves):
            node.region = i
        self.centres = np.array([node.centre for node in leaves])

    def _leaves(self, node: Node) -> Iterator[Node]:
        if not node.children:
            yield node
        for child in node.children:
            yield from self._leaves(child)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        out = np.zeros(len(vectors), dtype=np.int64)
        todo = [(self.root, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not node.children:
                out[rows] = node.region
                continue
            first = vectors[rows] @ node.normal < node.cut
            todo += [(node.children[0], rows[first]), (node.children[1], rows[~first])]
        return out


class Search:
    """The best k of one shard's rows for a block of queries, given scores to reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int = K) -> None:
        # by id, and rows of one id by their components, so that a row has the same place in every search of its shard
        by_id = np.argsort(ids, kind="stable") if len(np.unique(ids)) == len(ids) else np.lexsort((*vectors.T[::-1], ids))
        self.tree = BallTree(vectors[by_id])
        self.ids = ids[by_id]
        self.q, self.query_ids, self.k = queries.astype(np.float64), query_ids, k
        self.norm = np.sqrt((self.q**2).sum(axis=1))
        self.floor = floor.copy()
        self.score = np.full((len(queries), k), _NONE, dtype=np.int64)
        self.row = np.zeros((len(queries), k), dtype=np.int64)
        self.scored = 0
        limit = np.abs(queries.astype(np.float64)).max(initial=0) * np.abs(vectors.astype(np.float64)).max(initial=0) * max(1, queries.shape[1])
        self.whole = limit < 2**53
        kind = np.int64 if limit < 2**62 else object  # Python's integers have no end
        self.exact = None if self.whole else (queries.astype(kind), vectors[by_id].astype(kind)[self.tree.order])
        self._visit(self.tree.root, np.arange(len(queries)))

    def _bound(self, node: Node, active: np.ndarray) -> np.ndarray:
        raw = self.q[active] @ node.centre + self.norm[active] * node.radius
        return np.floor(raw + 1e-6 + 1e-9 * np.abs(raw))

    def _visit(self, node: Node, active: np.ndarray) -> None:
        if not node.children:
            self._leaf(node, active)
            return
        bounds = [self._bound(child, active) for child in node.children]
        for i in np.argsort([-b.sum() for b in bounds], kind="stable"):
            # an equal score counts, as a smaller id may win
            left = active[bounds[i] >= self.floor[active]]
            if len(left):
                self._visit(node.children[i], left)

    def _leaf(self, node: Node, active: np.ndarray) -> None:
        rows = self.tree.order[node.rows]
        if self.whole:
            score = np.rint(self.q[active] @ self.tree.vectors[node.rows].T).astype(np.int64)
        else:
            score = np.clip(self.exact[0][active] @ self.exact[1][node.rows].T, _NONE + 1, _MOST).astype(np.int64)
        self.scored += score.size
        score[self.ids[rows][None, :] == self.query_ids[active][:, None]] = _NONE
        better = (score >= self.floor[active][:, None]).any(axis=1)
        active, score = active[better], score[better]
        if not len(active):
            return
        all_score = np.concatenate([self.score[active], score], axis=1)
        all_row = np.concatenate([self.row[active], np.broadcast_to(rows, score.shape)], axis=1)
        best = np.lexsort((all_row, ~all_score), axis=1)[:, : self.k]  # ~x falls as x rises, for the smallest one too
        self.score[active] = np.take_along_axis(all_score, best, axis=1)
        self.row[active] = np.take_along_axis(all_row, best, axis=1)
        self.floor[active] = np.maximum(self.floor[active], self.score[active][:, -1])

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query id, row id, the row's place in the shard, score) of what reaches the floor, a query's best k at most."""
        at, j = np.nonzero((self.score != _NONE) & (self.score >= self.floor[:, None]))
        return self.query_ids[at], self.ids[self.row[at, j]], self.row[at, j], self.score[at, j]


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


_KEYS = ("dim", "group", "part", "block")
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("dim", pa.int32()), ("group", pa.int32()), ("part", pa.int64()), ("place", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "query_id long, vec_id long, dim int, group int, part long, place long, score long"


def _searcher(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        column = lambda t, c: t.column(c).to_numpy()
        matrix = lambda t: _matrix(t.column("v").combine_chunks())
        query_id, vec_id, place, score = Search(column(rows, "id"), matrix(rows), column(queries, "id"), matrix(queries), column(queries, "floor"), k).results()
        same = [np.full(len(score), rows.column(c)[0].as_py()) for c in ("dim", "group", "part")]
        return pa.table([pa.array(x, type=f.type) for x, f in zip((query_id, vec_id, *same, place, score), _FOUND, strict=True)], schema=_FOUND)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query, a row that several vectors of the query found once."""
    row = Window.partitionBy("query_id", "vec_id", "dim", "group", "part", "place").orderBy(F.col("score").desc())
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "dim", "group", "part", "place")
    once = found.repartition("query_id").withColumn("_n", F.row_number().over(row)).filter("_n = 1").drop("_n")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _placed(rows: DataFrame, regions: dict[int, Regions]) -> DataFrame:
    """The rows with their region and their distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            region, far = np.zeros(len(dims), dtype=np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                vectors = _matrix(batch.column(1).take(pa.array(at))).astype(np.float64)
                centres = np.zeros((1, dim))
                if dim in regions:
                    region[at], centres = regions[dim].of(vectors), regions[dim].centres
                far[at] = np.sqrt(((vectors - centres[region[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(far)], [*batch.schema.names, "region", "far"])

    return rows.mapInArrow(run, "id long, v array<long>, dim int, q boolean, region int, far double")


@dataclass
class Layout:
    """What the driver knows of one dimension: regions, their radii (under zero where no row lies) and groups, and the groups' parts."""

    regions: Regions | None
    radius: np.ndarray
    group: np.ndarray
    parts: list[int]

    @classmethod
    def of(cls, regions: Regions | None, seen: dict[int, tuple[int, float]], shard_rows: int) -> "Layout":
        n = len(regions.centres) if regions else 1
        radius, group, parts, held = np.full(n, -1.0), np.zeros(n, dtype=np.int32), [], shard_rows
        for r in range(n):  # leaves are numbered from left to right, so those of near numbers lie near
            rows, radius[r] = seen.get(r, (0, -1.0))
            if held + rows > shard_rows:
                parts.append(max(1, -(-rows // shard_rows)))
                held = 0
            held += rows
            group[r] = len(parts) - 1
        return cls(regions, radius, group, parts)

    def scores(self, q: np.ndarray, bound: bool) -> np.ndarray:
        """Scores of each query at each region's centre, or upper bounds of those in the region."""
        raw = q @ (self.regions.centres if self.regions else np.zeros((1, q.shape[1]))).T
        if bound:
            raw += np.sqrt((q**2).sum(axis=1))[:, None] * self.radius[None, :]
            raw += 1e-6 + 1e-9 * np.abs(raw)
        return np.where(self.radius < 0, -np.inf, raw)


def _bounded(queries: DataFrame, layout: dict[int, Layout], home_only: bool) -> DataFrame:
    """id, v, dim, floor and the groups with a region whose bound reaches a query's floor, or the group of the best centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, floor = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                at, one = np.flatnonzero(dims == dim), layout[dim]
                for lo in range(0, len(at), 512):
                    rows = at[lo : lo + 512]
                    bound = one.scores(_matrix(batch.column(1).take(pa.array(rows))).astype(np.float64), not home_only)
                    if home_only:
                        i, g = np.arange(len(rows)), one.group[bound.argmax(axis=1)]
                    else:
                        i, r = np.nonzero(bound >= floor[rows][:, None])
                        i, g = np.unique(np.stack([i, one.group[r]]), axis=1)
                    part = batch.take(pa.array(rows[i]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(g.astype(np.int32))], [*part.schema.names, "group"])

    return queries.mapInArrow(run, "id long, v array<long>, dim int, floor long, group int")


def top_k(vectors: DataFrame, is_query: Column, space: Workspace, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of every query's best k rows; vectors hold integers.

    ``is_query`` is a condition on the table's rows.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float(2**63)))
    ready = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite)
    rows = ready.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v"), F.size(vector_col).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q"))

    n = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}
    held: dict[int, list] = {}
    for r in rows.select("dim", "v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE).collect():
        held.setdefault(r.dim, []).append(r.v)
    regions = {dim: Regions(np.array(v, dtype=np.float64), min(REGION_SAMPLE, shard_rows)) for dim, v in held.items()}
    placed = space.written(_placed(rows, regions), "placed")
    seen: dict[int, dict] = {dim: {} for dim in n}
    for r in placed.groupBy("dim", "region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
        seen[r.dim][r.region] = (r.n, r.far)
    layout = {dim: Layout.of(regions.get(dim), found, shard_rows) for dim, found in seen.items()}

    def table(values: list[tuple], names: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(values, names))

    grouped = table([(d, r, g, one.parts[g]) for d, one in layout.items() for r, g in enumerate(one.group.tolist())], "dim int, region int, group int, parts long")
    parts = table([(d, g, p) for d, one in layout.items() for g, p in enumerate(one.parts)], "dim int, group int, parts long")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))
    shelved = placed.join(grouped, ["dim", "region"]).select("id", "v", "dim", "group", part.alias("part"))

    def searched(asked: DataFrame) -> DataFrame:
        """``asked``: id, v, dim, group, part, floor."""
        many = asked.groupBy("dim", "group").agg(F.count(F.lit(1)).alias("n")).collect()
        blocks = table([(r.dim, r.group, max(1, -(-r.n // (query_rows * layout[r.dim].parts[r.group])))) for r in many], "dim int, group int, blocks long")
        left = shelved.join(blocks, ["dim", "group"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        right = asked.join(blocks, ["dim", "group"]).select("id", "v", "dim", "group", "part", "floor", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).alias("block"))
        return left.groupBy(*_KEYS).cogroup(right.groupBy(*_KEYS)).applyInArrow(_searcher(k), _FOUND_SQL)

    # query rows equal in id and vector are one
    queries = placed.filter("q").select("id", "v", "dim").dropDuplicates().withColumn("floor", F.lit(_NONE + 1))
    home = space.written(_bounded(queries, layout, True).join(parts, ["dim", "group"]).withColumn("part", part).drop("parts"), "home")
    reached = space.written(_best(searched(home), k), "reached")
    floors = reached.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(_NONE + 1)).alias("floor"))
    again = home.select("id", "v", "dim").join(floors, "id", "left").select("id", "v", "dim", F.coalesce("floor", F.lit(_NONE + 1)).alias("floor"))
    every = _bounded(again, layout, False).join(parts, ["dim", "group"])
    others = every.select("id", "v", "dim", "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "floor")
    done = home.select("id", "v", "dim", "group", "part")
    others = space.written(others.join(done, done.columns, "left_anti"), "others")
    return _best(reached.drop("rank").unionByName(searched(others)), k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 of all ``embeddings`` for those whose vec_id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    scaled = rows.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * SCALE))
    # a component that no 64-bit integer holds takes its vector out, as a non-finite one does
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(2**63)))
    whole = scaled.filter(finite).withColumn("embedding", F.transform("embedding", lambda x: F.floor(x)))
    return top_k(whole, F.col("vec_id") % 20 == 0, Workspace(spark, "topk"))


QUERIES = {"op6_topk": op6_topk}

ORACLES = {
    "op6_topk": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
}
