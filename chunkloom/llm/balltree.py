"""Exact inner-product top-k: a ball tree per shard, searched by branch and bound.

Vectors are sharded by where they lie: pivots from a bounded sample cut the space into
cells, and a cell is cut into shards of bounded size, so that a cell with very many
vectors is many shards. A shard's tree is one binary row in the shared folder, with its
root's ball and box beside it. Queries come in blocks of bounded size. A block meets the
shards in waves, each about four times as large as the one before: within a wave a task
walks through its shards, those of the highest bound first, and carries each query's k-th
score from tree to tree; after a wave the best k-th scores of all tasks are what the next
one starts from, so that later waves skip whole shards by their root alone. Tree nodes are
taken in order of their upper bound, the lesser of <q, centre> + |q| radius and of the
highest product with any point of the node's box; a query is dropped from a node whose
bound is below its k-th score.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_scratch, kept, scratch_path

SHARD_ROWS = 8192
LEAF_ROWS = 64
#: Queries that the driver holds and ships at once (as longs, 64 dimensions: 8 MB).
QUERY_BLOCK = 16384
#: Vectors of the sample from which pivots come, and pivots at most.
SAMPLE_ROWS, PIVOTS = 20_000, 1024
#: Shards of the first wave; each next one has WAVE_GROWTH times as many.
FIRST_WAVE, WAVE_GROWTH = 16, 4
SCALE = 64
_NONE = np.iinfo(np.int64).min


def quantised(vectors: Iterable) -> tuple[np.ndarray, list[np.ndarray]]:
    """floor(64 x) of every usable vector; which these are, and the integers."""
    keep, out = [], []
    for i, v in enumerate(vectors):
        if v is None:
            continue
        x = np.array([np.nan if c is None else c for c in v], np.float64) if getattr(v, "dtype", None) == object else np.asarray(v, np.float64)
        if np.isfinite(x).all():
            keep.append(i)
            out.append(np.floor(x * SCALE).astype(np.int64))
    return np.array(keep, np.int64), out


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows; in floating point where that is exact."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _bound(queries: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds (query, node) of inner products with any row of a node."""
    ball = queries @ centres.T + norms[:, None] * radii
    box = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    out = np.minimum(ball, box)
    return out + 1e-6 * (1 + np.abs(ball) + np.abs(box))  # rounding never hides a tie


class BallTree:
    """A binary tree over rows of integers; nodes hold a ball, a box and a row range."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order, nodes = np.arange(len(rows)), []
        todo = [(0, len(rows), -1, 0)]
        centres, radii, low, high = [], [], [], []
        floats = rows.astype(np.float64)
        while todo:
            lo, hi, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = at
            nodes.append([lo, hi, -1, -1])
            part = floats[order[lo:hi]]
            centre = part.mean(axis=0)
            away = ((part - centre) ** 2).sum(axis=1)
            centres.append(centre)
            radii.append(np.sqrt(away.max()))
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            if hi - lo <= LEAF_ROWS or (low[-1] == high[-1]).all():
                continue
            # each to the nearer of two far points; where that leaves nearly all on one side,
            # half to each, so that the tree stays shallow
            p = part[away.argmax()]
            q = part[((part - p) ** 2).sum(axis=1).argmax()]
            along = part @ (q - p)
            cut = np.argsort(along, kind="stable")
            mid = int(np.searchsorted(along[cut], ((q @ q) - (p @ p)) / 2))
            if not (hi - lo) // 16 < mid < (hi - lo) * 15 // 16:
                mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][cut]
            todo += [(lo, lo + mid, at, 0), (lo + mid, hi, at, 1)]
        self.nodes, self.centres, self.radii = nodes, np.array(centres), np.array(radii)
        self.low, self.high = np.array(low), np.array(high)
        self.ids, self.rows = ids[order], rows[order]

    def root(self) -> tuple[np.ndarray, ...]:
        """Centre, radius and box of all rows, one row each."""
        return self.centres[:1], self.radii[:1], self.low[:1], self.high[:1]

    def dump(self) -> bytes:
        rows = self.rows
        small = rows.astype(np.int32) if not rows.size or np.abs(rows).max() < 2**31 else rows
        return pickle.dumps((self.nodes, self.centres, self.radii, self.low, self.high, self.ids, small), 5)

    @classmethod
    def load(cls, data: bytes) -> BallTree:
        tree = cls.__new__(cls)
        tree.nodes, tree.centres, tree.radii, tree.low, tree.high, tree.ids, rows = pickle.loads(data)
        tree.rows = rows.astype(np.int64)
        return tree


class TopK:
    """The best candidates of a block of queries so far, and each one's k-th score."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.rows, self.k = query_ids, queries, k
        self.best = np.full((len(queries), k), _NONE)
        self.kth = np.full(len(queries), _NONE) if floor is None else floor.copy()
        self.norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        self.floats = queries.astype(np.float64)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.scored = 0

    def bounds(self, *nodes: np.ndarray) -> np.ndarray:
        return _bound(self.floats, self.norms, *nodes)

    def search(self, tree: BallTree) -> None:
        if not len(self.rows) or not len(tree.ids) or tree.rows.shape[1] != self.rows.shape[1]:
            return
        bounds = self.bounds(tree.centres, tree.radii, tree.low, tree.high)
        heap = [(-float(bounds[:, 0].max()), 0)]
        while heap:
            _, at = heapq.heappop(heap)
            live = np.flatnonzero(bounds[:, at] >= self.kth)
            if not len(live):
                continue
            lo, hi, left, right = tree.nodes[at]
            if left < 0:
                for i in range(lo, hi, LEAF_ROWS):
                    self._take(live, tree.ids[i : min(hi, i + LEAF_ROWS)], tree.rows[i : min(hi, i + LEAF_ROWS)])
                continue
            for child in (left, right):
                heapq.heappush(heap, (-float(bounds[live, child].max()), child))

    def _take(self, live: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.scored += len(live) * len(ids)
        scores = dot(self.rows[live], rows)
        own = self.ids[live][:, None] == ids
        scores[own] = _NONE
        good = (scores >= self.kth[live][:, None]) & ~own
        hit = good.any(axis=1)
        if not hit.any():
            return
        live, scores, good = live[hit], scores[hit], good[hit]
        q, c = np.nonzero(good)
        self.found.append((live[q], ids[c], scores[q, c]))
        self.held += len(q)
        both = np.concatenate((self.best[live], scores), axis=1)
        both = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        self.best[live] = both
        self.kth[live] = np.maximum(self.kth[live], both.min(axis=1))
        if self.held > 40 * self.k * len(self.rows) + 1_000_000:
            self._shrink()

    def _shrink(self) -> None:
        q, c, s = (np.concatenate(x) for x in zip(*self.found))
        good = s >= self.kth[q]
        q, c, s = q[good], c[good], s[good]
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        begin = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(begin, np.arange(len(q)), 0)) if len(q) else q
        good = place < self.k
        self.found, self.held = [(q[good], c[good], s[good])], int(good.sum())

    def result(self) -> pd.DataFrame:
        if not self.found:
            self.found = [(np.zeros(0, np.int64),) * 3]
        self._shrink()
        q, c, s = self.found[0]
        return pd.DataFrame({"query_id": self.ids[q], "vec_id": c, "score": s})


def _cut(batches: Iterable[pd.DataFrame], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cells, ids and rows of up to ``size`` vectors that lie in one cell and are of one length."""
    held: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for pdf in batches:
        keep, vectors = quantised(pdf["embedding"])
        cells = pdf["cell"].to_numpy(np.int64)[keep].tolist() if "cell" in pdf else [0] * len(keep)
        for cell, i, v in zip(cells, pdf["vec_id"].to_numpy(np.int64)[keep].tolist(), vectors):
            if (cell, len(v)) not in held:
                if len(held) > 64:  # rows come sorted by cell
                    yield from map(_piled, held.items())
                    held = {}
                held[cell, len(v)] = []
            part = held[cell, len(v)]
            part.append((i, v))
            if len(part) >= size:
                yield _piled(((cell, len(v)), held.pop((cell, len(v)))))
    yield from map(_piled, held.items())


def _piled(item) -> tuple[int, np.ndarray, np.ndarray]:
    (cell, _), part = item
    return cell, np.array([i for i, _ in part], np.int64), np.stack([v for _, v in part])


def _builder(size: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell, ids, rows in _cut(batches, size):
            tree = BallTree(ids, rows)
            yield pd.DataFrame({"dims": [rows.shape[1]], "shard": [f"{cell}-{ids[0]}-{len(ids)}"], "root": [pickle.dumps(tree.root(), 5)], "tree": [tree.dump()]})

    return run


def _block(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, ids, rows in _cut(batches, SHARD_ROWS):
        yield pd.DataFrame({"dims": [rows.shape[1]], "block": [pickle.dumps((ids, rows), 5)]})


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def pivots(rows: DataFrame, n: int, shard_rows: int = SHARD_ROWS) -> dict[int, np.ndarray]:
    """By length, vectors of a bounded sample that lie far apart: one for about every shard."""
    wanted = min(PIVOTS, -(-n // shard_rows))
    if wanted < 2:
        return {}
    luck = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) / float(1 << 20)
    some = rows.where(luck < SAMPLE_ROWS / n).limit(2 * SAMPLE_ROWS).collect()
    by: dict[int, list] = {}
    for r in sorted(some, key=lambda r: (r["vec_id"], r["embedding"])):
        by.setdefault(len(r["embedding"]), []).append(r["embedding"])
    out = {}
    for dims, vectors in by.items():
        if not dims:
            continue
        x = np.array(vectors, np.float64)
        far, chosen = np.full(len(x), np.inf), [0]
        while True:
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
            if len(chosen) >= wanted or far.max() == 0:
                break
            chosen.append(int(far.argmax()))
        at = x[chosen]
        for _ in range(3):  # towards the middles of their cells
            nearest = ((at**2).sum(axis=1) - 2 * (x @ at.T)).argmin(axis=1)
            count = np.bincount(nearest, minlength=len(at))
            total = np.zeros_like(at)
            np.add.at(total, nearest, x)
            at = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], at)
        out[dims] = at
    return out


def sharded(rows: DataFrame, n: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``vec_id, embedding, cell``, the rows of a cell one after another, many tasks to a
    cell that has many rows."""
    at = pivots(rows, n, shard_rows)
    if not at:
        return rows.withColumn("cell", F.lit(0))

    @F.pandas_udf("int")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            out = np.zeros(len(vectors), np.int32)
            sizes = vectors.map(len).to_numpy()
            for dims, points in at.items():
                if len(some := np.flatnonzero(sizes == dims)):
                    x = np.stack(vectors.iloc[some].to_numpy())
                    out[some] = ((points**2).sum(axis=1) - 2 * (x @ points.T)).argmin(axis=1)
            yield pd.Series(out)

    placed = rows.withColumn("cell", nearest("embedding"))
    # a range sort: a cell of very many rows goes to several tasks, as ids part them
    tasks = max(1, -(-n // (4 * shard_rows)))
    return placed.repartitionByRange(tasks, "cell", "vec_id").sortWithinPartitions("cell", "vec_id")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
    shard_rows: int = SHARD_ROWS,
    scored: list[int] | None = None,
) -> DataFrame:
    """The ``k`` highest inner products of every query: ``query_id, rank, vec_id, score``.

    Components become floor(64 x); scores are exact longs (they wrap beyond 63 bits),
    ties go to the smaller vec_id. A query never meets rows of its own id. Rows with a
    null id or vector, or with a null, NaN or infinite component, take no part; vectors of
    different lengths don't meet. Repeated rows count each as candidates; of several usable
    vectors of one query id the least, component by component, is the query. No queries or
    no candidates give no rows; other columns are ignored. ``scored`` gets the number of
    pairs of which the product was taken, a number for each block and wave.
    """
    spark = vectors.sparkSession
    candidates = usable(vectors, id_col, vec_col)
    n = candidates.count()
    shape = "dims int, shard string, root binary, tree binary"
    trees, trees_path = kept(sharded(candidates, n, shard_rows).mapInPandas(_builder(shard_rows), shape), "trees")
    asked = usable(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked, asked_path = kept(asked.mapInPandas(_block, "dims int, block binary"), "queries")
    path = scratch_path(spark, "hits")
    hit = "query_id long, vec_id long, score long"
    spark.createDataFrame([], hit).write.parquet(path)
    shards = trees.groupBy("dims").agg(F.count("*").alias("n")).collect()  # one row a length

    def search(dims: int, ids: np.ndarray, rows: np.ndarray, shards: int) -> None:
        floor = np.full(len(ids), _NONE)
        # shards in waves by a hash of their name: lines of 0 to 1 that grow
        sizes, at = [], 0
        while at < shards:
            sizes.append(min(shards - at, FIRST_WAVE * WAVE_GROWTH ** len(sizes)))
            at += sizes[-1]
        luck = F.pmod(F.xxhash64("shard"), F.lit(1 << 20)) / float(1 << 20)
        edges = np.concatenate(([0.0], np.cumsum(sizes) / shards))
        edges[-1] = 2.0
        for low, high in zip(edges, edges[1:]):
            block = spark.sparkContext.broadcast((ids, rows, floor))  # query_block rows

            def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                got, held = TopK(*block.value[:2], k, block.value[2]), []
                for pdf in batches:
                    for root, data in zip(pdf["root"], pdf["tree"]):
                        bounds = got.bounds(*pickle.loads(root))[:, 0]
                        if (bounds >= got.kth).any():
                            held.append((float(bounds.max()), bounds, data))
                    held.sort(key=lambda x: -x[0])
                    for _, bounds, data in held:  # a batch of trees, the best first
                        if (bounds >= got.kth).any():
                            got.search(BallTree.load(data))
                    held = []
                out = got.result().assign(kth=_NONE, scored=0)
                floors = pd.DataFrame({"query_id": got.ids, "vec_id": -1, "score": 0, "kth": got.kth, "scored": 0})
                floors.loc[0, "scored"] = got.scored
                yield pd.concat([out, floors[(floors["kth"] > block.value[2]) | (floors["scored"] > 0)].assign(vec_id=None)]).astype({"vec_id": "Int64"})

            wave = trees.where((F.col("dims") == dims) & (luck >= float(low)) & (luck < float(high))).select("root", "tree")
            found, found_path = kept(wave.mapInPandas(run, f"{hit}, kth long, scored long"), "wave")
            found.where("vec_id is not null").select("query_id", "vec_id", "score").write.mode("append").parquet(path)
            tops = found.where("vec_id is null").groupBy("query_id").agg(F.max("kth").alias("kth"), F.sum("scored").alias("scored"))
            got = tops.toPandas()  # a row a query of the block at most
            place = np.searchsorted(ids, got["query_id"].to_numpy(np.int64))
            floor[place] = np.maximum(floor[place], got["kth"].to_numpy(np.int64))
            if scored is not None:
                scored.append(int(got["scored"].sum()))
            block.unpersist()
            drop_scratch(spark, found_path)

    for dims, count in sorted((r["dims"], r["n"]) for r in shards):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def ask() -> None:
            ids, rows = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(ids)
            search(dims, ids[order], rows[order], count)
            held.clear()

        for row in asked.where(F.col("dims") == dims).select("block").toLocalIterator():
            held.append(pickle.loads(row["block"]))
            if sum(len(i) for i, _ in held) >= query_block:
                ask()
        if held:
            ask()
    drop_scratch(spark, trees_path, asked_path)
    hits = spark.read.schema(hit).parquet(path)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
