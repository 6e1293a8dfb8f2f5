"""Exact top-k inner-product search with M-trees.

Vectors of one shard get an extra component that gives all of them the same norm M, so
that the inner product falls as the Euclidean distance grows (d^2 = |q|^2 + M^2 - 2 q.x)
and a metric tree applies.  Every node is a page: its entries hold a routing vector, a
covering radius and the distance to the parent's routing vector.  A search takes pages
best first; |d(q,parent) - d(entry,parent)| - radius bounds an entry's distance from below
before it is computed, and pages whose bound exceeds the k-th best distance are left.
Bounds carry a slack and every reported score is an exact integer, so results are exact (while
the squared norms of the integer vectors stay under 2**52, in which doubles are exact).

Vectors are dealt to shards near a bounded set of pivots, as many as the session has cores for
at least, if that leaves them LEAST vectors.  Each block of queries meets each shard once (a
stated query set against all rows, in blocks): first the shard of its own pivot, whose k-th best
score then bounds the search in all others.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither
as query nor as candidate; vectors of different lengths have no inner product and raise; rows
with a null id take no part; ties go to the smaller id; repeated rows are candidates each, and one
query, but a query never meets rows of its own id; fewer candidates than k give fewer rows; very
long vectors only make pages larger; empty tables give none; other columns take no part.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Entries of a leaf page, and of an inner page.
LEAF, FANOUT = 128, 24
#: Vectors of one tree, vectors of one shard, queries of one block.
TREE, SHARD, BLOCK = 16_384, 65_536, 4_096
#: Vectors of a shard at least.
LEAST = 2_048
#: Pivots that deal vectors to shards: a bounded sample, whatever the table's size.
PIVOTS = 64


class _Page:
    """Entries of a node: routing vectors (or members), radii, distances to the parent."""

    __slots__ = ("children", "ids", "radii", "to_parent", "vectors")

    def __init__(self, vectors, radii, to_parent, children=None, ids=None):
        self.vectors, self.radii, self.to_parent, self.children, self.ids = vectors, radii, to_parent, children, ids


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((a - b) ** 2).sum(1)))


def _groups(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``most``, halved between two far members."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        far = rows[np.argmax(_distances(x[rows], x[rows[0]]))]
        other = rows[np.argmax(_distances(x[rows], x[far]))]
        lean = _distances(x[rows], x[far]) - _distances(x[rows], x[other])
        order = np.argsort(lean, kind="stable")
        cut = min(max(int((lean < 0).sum()), len(rows) // 4), len(rows) - len(rows) // 4)
        todo += [rows[order[:cut]], rows[order[cut:]]]
    return done


def build(vectors: np.ndarray, ids: np.ndarray) -> tuple[_Page, float]:
    """The root page of an M-tree over the rows, and their largest norm."""
    norms = (vectors.astype(np.float64) ** 2).sum(1)
    top = float(norms.max(initial=0.0))
    x = np.hstack([vectors.astype(np.float64), np.sqrt(np.maximum(0.0, top - norms))[:, None]])

    def routed(members: np.ndarray) -> tuple[int, np.ndarray]:
        mean = x[members].mean(0)
        centre = members[np.argmin(_distances(x[members], mean))]
        return centre, _distances(x[members], x[centre])

    level = []  # (centre row, radius, page, rows below)
    for rows in _groups(x, LEAF):
        centre, d = routed(rows)
        level.append((centre, d.max(), _Page(x[rows], np.zeros(len(rows)), d, ids=ids[rows]), rows))
    while len(level) > FANOUT:
        centres = np.array([e[0] for e in level])
        above = []
        for group in _groups(x[centres], FANOUT):
            own = [level[g] for g in group]
            rows = np.concatenate([e[3] for e in own])
            centre, _ = routed(np.array([e[0] for e in own]))
            to = _distances(x[[e[0] for e in own]], x[centre])
            page = _Page(x[[e[0] for e in own]], np.array([e[1] for e in own]), to, children=[e[2] for e in own])
            above.append((centre, _distances(x[rows], x[centre]).max(), page, rows))
        level = above
    roots = [e[0] for e in level]
    return _Page(x[roots], np.array([e[1] for e in level]), None, children=[e[2] for e in level]), top


def search(root: _Page, top: float, q: np.ndarray, q_id: int, best: list[tuple[int, int]], k: int, least: int | None = None) -> None:
    """Bring ``best`` (a heap of (score, -id), worst first) up to date with a tree.

    ``least``: a score that k others are known to reach; nothing below it is needed.
    """
    norm = float((q.astype(np.float64) ** 2).sum())
    q64 = np.append(q.astype(np.float64), 0.0)
    slack = 1e-6 * (norm + top + 1.0)
    ticket = itertools.count()
    heap = [(0.0, next(ticket), root, None)]

    def needed() -> int | None:
        own = best[0][0] if len(best) == k else None
        return own if least is None else least if own is None else max(own, least)

    def reach() -> float:
        bound = needed()
        return np.inf if bound is None else float(np.sqrt(max(0.0, norm + top - 2.0 * bound) + slack))

    while heap:
        low, _, page, d_parent = heapq.heappop(heap)
        limit = reach()
        if low > limit:
            break
        rows = np.arange(len(page.radii))
        if d_parent is not None:  # stored distances spare computing new ones
            rows = rows[np.abs(d_parent - page.to_parent) - page.radii <= limit]
        if not len(rows):
            continue
        if page.children is None:
            scores = np.rint(page.vectors[rows] @ q64).astype(np.int64)
            bound = needed()
            if bound is not None:
                keep = scores >= bound
                rows, scores = rows[keep], scores[keep]
            for s, i in zip(scores.tolist(), page.ids[rows].tolist(), strict=True):
                if i != q_id:
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (s, -i))
        else:
            d = _distances(page.vectors[rows], q64)
            for r, x, bound in zip(rows.tolist(), d.tolist(), (d - page.radii[rows]).tolist(), strict=True):
                if bound <= limit:
                    heapq.heappush(heap, (max(bound, low), next(ticket), page.children[r], x))


def integer_vectors(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", scale: float = 256.0) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component; invalid vectors are left out."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    Both sides are (id, v array<long>) as ``integer_vectors`` gives them.
    """
    spark = vectors.sparkSession
    widths = vectors.select(F.size("v").alias("d")).unionByName(queries.select(F.size("v").alias("d"))).agg(F.min("d"), F.max("d")).first()
    n = vectors.count()
    if not n or widths[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if widths[0] != widths[1]:
        raise ValueError(f"vectors of {widths[0]} to {widths[1]} components have no inner product")
    queries = queries.select("id", "v").distinct()
    asked_n, cores = queries.count(), max(1, spark.sparkContext.defaultParallelism)
    shards = max(-(-n // SHARD), min(cores, n // LEAST), 1)
    shard_size = -(-n // shards)
    shards = -(-n // shard_size)
    chunks = max(-(-asked_n // BLOCK), min(-(-2 * cores // shards), asked_n // 64), 1)
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = np.array([r["v"] for r in sample], dtype=np.float64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(1) / 2
        for b in batches:
            near = np.argmax(_matrix(b.column(1)) @ pivots.T - half, axis=1) if b.num_rows else np.array([], int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32))], names=["id", "v", "pivot"])

    dealt = vectors.select("id", "v").mapInArrow(deal, "id long, v array<long>, pivot int")
    # A shard is a range of (pivot, hash): neighbours stay together, a crowded pivot is split.
    sizes = {r["pivot"]: r["count"] for r in dealt.groupBy("pivot").count().collect()}  # PIVOTS rows at most
    start = np.cumsum([0] + [sizes.get(p, 0) for p in range(len(pivots))])
    at = lambda xs: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in xs]), F.col("pivot") + 1)
    place = at(start[:-1]) + F.pmod(F.xxhash64("id"), at([max(1, sizes.get(p, 0)) for p in range(len(pivots))]))
    order = dealt.withColumn("shard", F.floor(place / shard_size)).repartition("shard")
    built = materialise(order.sortWithinPartitions("shard", "pivot", "id").mapInArrow(_plant, "shard long, tree binary"), "trees")
    home = F.least(F.floor(place / shard_size), F.lit(shards - 1)).cast("long")
    chunk = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(chunks)).cast("long")
    asked = queries.mapInArrow(deal, "id long, v array<long>, pivot int").select(chunk.alias("chunk"), "id", "v", home.alias("home"))
    every = F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>")
    trees = built.withColumn("chunk", F.explode(every)).select("shard", "chunk", F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("v", "array<long>"), ("least", "long"))], "tree")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, best = None, [], {}

        def flush():
            rows = [(q, -i, s) for (q, *_), h in zip(asked, best.values(), strict=True) for s, i in h]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

        for b in batches:
            for row in range(b.num_rows):
                key = (b.column(0)[row].as_py(), b.column(1)[row].as_py())
                if key != now:
                    if asked:
                        yield flush()
                    now, asked, best = key, [], {}
                if b.column(2)[row].as_py() == 0:
                    best[len(asked)] = []
                    asked.append((b.column(3)[row].as_py(), b.column(4)[row].values.to_numpy(), b.column(5)[row].as_py()))
                elif asked:
                    root, top = pickle.loads(b.column(6)[row].as_py())
                    for at, (i, v, least) in enumerate(asked):
                        search(root, top, v, i, best[at], k, least)
        if asked:
            yield flush()

    def searched(asked: DataFrame) -> DataFrame:
        rows = asked.select("shard", "chunk", F.lit(0).alias("kind"), "id", "v", "least", F.lit(None).cast("binary").alias("tree"))
        both = rows.unionByName(trees).repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "kind", "id")
        return both.mapInArrow(meet, "query_id long, vec_id long, score long")

    first = materialise(searched(asked.withColumns({"shard": F.col("home"), "least": F.lit(None).cast("long")})), "nearest")
    found = first
    if shards > 1:
        # The k-th best of the nearest shard: a row a query.
        known = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"), lambda s: s != F.col("home"))
        found = first.unionByName(searched(asked.join(known, "id", "left").withColumn("shard", F.explode(others))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their shards to trees of at most TREE vectors."""
    held, size, now = [], 0, None

    def tree(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        made = build(_matrix(part.column("v").chunk(0)), part.column("id").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([pickle.dumps(made)], pa.binary())], names=["shard", "tree"])

    for b in batches:
        shards = b.column(b.schema.get_field_index("shard")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for i, j in itertools.pairwise(cuts):
            if i == j:
                continue
            if shards[i] != now:
                if size:
                    yield tree(pa.Table.from_batches(held))
                held, size, now = [], 0, int(shards[i])
            held.append(b.slice(i, j - i))
            size += j - i
            while size >= TREE:
                whole = pa.Table.from_batches(held)
                yield tree(whole.slice(0, TREE))
                held, size = whole.slice(TREE).to_batches(), size - TREE
    if size:
        yield tree(pa.Table.from_batches(held))
