"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

1. Equal vectors become one row with their number and smallest id, so that copies are compared once.
2. From a bounded sample (SAMPLE vectors, drawn by hash) the driver learns unit centroids of the
   coarse lists and codebooks of the residuals' subspaces.  From the same sample come partners made
   at exactly the wanted cosine, in the directions in which the sample's vectors differ; ``gap`` is
   how much worse than its own centroid a vector scores the centroid of such a partner, at most, in
   COVERED of the cases.
3. Every vector goes to its best list, with a code byte for each subspace and the exact error of
   its code, and visits every list whose centroid it scores within ``gap`` of its own: the probes
   are as many as the place needs.
4. Neighbouring lists share a bin of some BLOCK members, crowded lists are split into several; a
   visitor is sent once to each bin with a list that it visits.  Bins are split by visitors too, so
   that no task gets more than a block of either.  There, tables of a visitor's squared distances
   to all codes give its distance to every member's code; who may be near enough by the triangle
   inequality with the stored error, hence every near one, is measured again: cosine in double
   precision.
5. Tasks return numbers of links and links that span what they connected, never all pairs; a pair
   that both sides would find is counted once for each.  Components follow from the spanning links.

What a list's task finds is exact; only a partner in a list that neither side visits is missed.

Defined cases: null and zero vectors, and those with null or non-finite components, link with
nothing, not even with copies; shorter vectors count as padded with zeros; repeated rows link to
each other; ids may be null: such rows link, but name no component unless all ids of it are null,
and are not kept; ties cannot occur; an empty table gives no rows; other columns pass, but for
n_links, component_id and kept, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components

#: Vectors from which the index is learnt; every vector is indexed.
SAMPLE = 32_768
#: Share of made partners whose list is visited; real ones have two chances, one from each side
#: (measured on vectors without structure: 0.999 and more at the least cosine).
COVERED = 0.97
SUBSPACES, CODES = 16, 256
#: Members and visitors of a task, at most; fewer where that keeps all cores busy.
BLOCK = 65_536
#: Pairs of a visitor and a member that are compared at once.
STEP = 1 << 21


class Index(NamedTuple):
    centroids: np.ndarray
    parts: list[np.ndarray]  # the components of each subspace
    books: list[np.ndarray]  # its codes
    gap: float

    def codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A byte for each subspace, and the distance to what the bytes stand for."""
        out, error = np.empty((len(residual), len(self.parts)), np.uint8), np.zeros(len(residual))
        for m, (part, book) in enumerate(zip(self.parts, self.books)):
            apart = _squares(residual[:, part], book)
            out[:, m] = apart.argmin(1)
            error += ((residual[:, part] - book[out[:, m]]) ** 2).sum(1)
        return out, np.sqrt(error)

    def distances(self, from_centroid: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of visitors (less the list's centroid) to members' codes, by tables."""
        total = np.zeros((len(from_centroid), len(codes)), np.float32)
        for m, (part, book) in enumerate(zip(self.parts, self.books)):
            total += _squares(from_centroid[:, part], book).astype(np.float32)[:, codes[:, m]]
        return total


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def _means(x: np.ndarray, k: int, unit: bool, rounds: int = 10) -> np.ndarray:
    """k-means of the rows of ``x``, seeded by rows spread over it; unit: of directions."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centres.T if unit else -_squares(x[i : i + 4096], centres)).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        scale = np.linalg.norm(sums, axis=1) if unit else np.bincount(near, minlength=k)
        centres = np.where(scale[:, None] > 1e-9, sums / np.maximum(scale, 1e-9)[:, None], centres)
    return centres


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, however large or small they are."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def learn(sample: np.ndarray, n: int, least: float) -> Index:
    """The index of ``n`` vectors like those of the sample."""
    x = unit(sample)
    lists = int(min(max(1, round(2 * n**0.5)), 2048, max(1, len(x) // 16)))
    centroids = _means(x, lists, True)
    scores = x @ centroids.T
    own = scores.argmax(1)
    parts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
    books = [_means((x - centroids[own])[:, p], min(CODES, len(x)), False) for p in parts]
    # Partners at the least cosine, in the direction of another vector of the sample.
    across = np.roll(x, 1 + len(x) // 3, 0)
    across = across - (across * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(across, axis=1, keepdims=True)
    made = least * x + (1 - least**2) ** 0.5 * across / np.where(size > 1e-9, size, 1)
    theirs = (made @ centroids.T).argmax(1)
    at = np.arange(len(x))
    return Index(centroids, parts, books, float(np.quantile(scores[at, own] - scores[at, theirs], COVERED)) + 1e-9)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.float64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _spanning(near: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """For each visitor (row), one member of each group of members that it links; ``label`` joins them."""
    for i in np.flatnonzero(near.any(1)):
        js = np.flatnonzero(near[i])
        groups, first = np.unique(label[js], return_index=True)
        for j in js[first]:
            yield int(i), int(j)
        if len(groups) > 1:
            label[np.isin(label, groups)] = groups[0]


class Bins(NamedTuple):
    """Which bins hold a list: ``parts[i]`` of them from ``first[i]`` on."""

    first: np.ndarray
    parts: np.ndarray
    count: int

    def home(self, own: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The bin of each member; members of a split list are dealt by number."""
        return self.first[own] + node % self.parts[own]

    def visited(self, visits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, bin), once each, for rows that visit ``sizes`` of the lists ``visits``."""
        row = np.repeat(np.repeat(np.arange(len(sizes)), sizes), self.parts[visits])
        held = self.parts[visits]
        at = np.repeat(self.first[visits], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        pairs = np.unique(row * self.count + at)
        return pairs // self.count, pairs % self.count


def binned(sizes: np.ndarray, centroids: np.ndarray, most: int) -> Bins:
    """Lists in bins of about ``most`` members, next to next in a chain of near centroids; larger lists alone, in parts."""
    left, order = set(range(len(sizes))), [0]
    left.discard(0)
    near = centroids @ centroids.T
    while left:
        rest = np.fromiter(left, int)
        order.append(int(rest[near[order[-1], rest].argmax()]))
        left.discard(order[-1])
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    count, held = 0, 0
    for i in order:
        if held and held + sizes[i] > most:
            count, held = count + 1, 0
        first[i], parts[i] = count, max(1, -(-int(sizes[i]) // most))
        held += int(sizes[i])
        if parts[i] > 1:
            count, held = count + int(parts[i]), 0
    return Bins(first, parts, count + 1)


def links(nodes: DataFrame, index: Index, width: int, least: float) -> DataFrame:
    """Of (node, vector, weight): (a, null, n) counts n more links of a; (a, b, null) is a link of a spanning set."""
    spark = nodes.sparkSession
    sent = spark.sparkContext.broadcast(index)  # at most 2,048 centroids and SUBSPACES * CODES codes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_index = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_rows(batch.column(1), width))
            scores = x @ own_index.centroids.T
            own = scores.argmax(1)
            codes, error = own_index.codes(x - own_index.centroids[own])
            row, at = np.nonzero(scores >= scores[np.arange(len(x)), own][:, None] - own_index.gap)
            visits = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)), pa.array(at.astype(np.int32)))
            columns = [batch.column(0), batch.column(2), pa.array(own.astype(np.int32)), visits, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "weight", "own", "visits", "codes", "error", "vector"])

    fields = f"node long, weight long, own int, visits array<int>, codes binary, error double, vector {dict(nodes.dtypes)['vector']}"
    indexed = materialise(nodes.select("node", "vector", "weight").mapInArrow(place, fields), "pq-index")
    # One row a list, then one a bin.
    sizes = np.zeros(len(index.centroids), np.int64)
    for own, n in indexed.groupBy("own").count().collect():
        sizes[own] = n
    most = max(1, min(BLOCK, int(sizes.sum()) // (4 * spark.sparkContext.defaultParallelism)))
    bins = binned(sizes, index.centroids, most)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins.count, np.int64)
        for batch in batches:
            visits = batch.column(0)
            total += np.bincount(bins.visited(visits.flatten().to_numpy(), visits.value_lengths().to_numpy())[1], minlength=bins.count)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins.count)), pa.array(total)], names=["bin", "n"])

    visitors = np.ones(bins.count, np.int64)
    for at, n in indexed.select("visits").mapInArrow(asked, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect():
        visitors[at] = max(1, -(-n // BLOCK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, own, visits = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            home = bins.home(own, node)
            times = visitors[home]
            rows = np.repeat(np.arange(len(node)), times)
            block = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            row, at = bins.visited(visits.flatten().to_numpy(), visits.value_lengths().to_numpy())
            for role, r, b, v in ((0, rows, home[rows], block), (1, row, at, node[row] % visitors[at])):
                for k in range(0, len(r), 8192):
                    part = r[k : k + 8192]
                    sent_ = batch.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array(b[k : k + 8192]), pa.array(v[k : k + 8192]), pa.array(np.full(len(part), role)), *sent_.columns], names=["bin", "block", "role", *sent_.schema.names])

    reach = (2 - 2 * least) ** 0.5 + 1e-4

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, None
        for batch in batches:
            at = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                now = tuple(at[:2, i].tolist())
                if now != key:
                    if members:
                        yield from members.counts()
                    key, members = now, _Members(sent.value, width, reach, least)
                part = batch.slice(i, j - i)
                if at[2, i] == 0:
                    members.add(part)
                else:
                    yield from members.meet(part)
        if members:
            yield from members.counts()

    dealt = indexed.mapInArrow(deal, f"bin long, block long, role long, {fields}").repartition("bin", "block").sortWithinPartitions("bin", "block", "role")
    return dealt.mapInArrow(compare, "a long, b long, n long")


def _found(a: np.ndarray, b, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])


class _Members:
    """Members of one bin, list by list, and what visitors found there."""

    def __init__(self, index: Index, width: int, reach: float, least: float):
        self.index, self.width, self.reach, self.least = index, width, reach, least
        self.batches, self.ready = [], False

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)

    def _read(self) -> None:
        at = pa.Table.from_batches(self.batches).combine_chunks()
        order = np.argsort(at["own"].to_numpy(), kind="stable")
        at = at.take(pa.array(order)).combine_chunks()
        self.node, self.weight, self.error = (at[k].to_numpy() for k in ("node", "weight", "error"))
        own = at["own"].to_numpy()
        self.lists, starts = np.unique(own, return_index=True)
        self.ends = [*starts.tolist(), len(own)]
        self.unit = unit(_rows(at["vector"].chunk(0), self.width))
        self.codes = np.frombuffer(b"".join(at["codes"].to_pylist()), np.uint8).reshape(len(own), -1)
        visits = at["visits"].chunk(0)
        self.visits, self.visit_at = visits.flatten().to_numpy(), np.concatenate([[0], np.cumsum(visits.value_lengths().to_numpy())])
        self.label, self.found = np.arange(len(own)), np.zeros(len(own), np.int64)
        self.batches, self.ready = [], True

    def meet(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Compare visitors with the members of the lists that they visit."""
        if not self.ready:
            if not self.batches:
                return
            self._read()
        node, weight, own = (batch.column(k).to_numpy() for k in (3, 4, 5))
        visits, x = batch.column(6), unit(_rows(batch.column(9), self.width))
        row, wanted = np.repeat(np.arange(len(node)), visits.value_lengths().to_numpy()), visits.flatten().to_numpy()
        for k, name in enumerate(self.lists):
            rows = row[wanted == name]
            step = max(1, STEP // (self.ends[k + 1] - self.ends[k]))
            for i in range(0, len(rows), step):
                at = rows[i : i + step]
                yield from self._compare(slice(self.ends[k], self.ends[k + 1]), name, node[at], weight[at], own[at], x[at])

    def _compare(self, part: slice, name: int, node: np.ndarray, weight: np.ndarray, own: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        near = self.index.distances(x - self.index.centroids[name], self.codes[part]) <= ((self.reach + self.error[part]) ** 2).astype(np.float32)
        near &= node[:, None] != self.node[None, part]
        some = np.flatnonzero(near.any(0))
        near = near[:, some] & (x @ self.unit[part][some].T >= self.least)
        if not near.any():
            return
        member = some + part.start
        counts = near @ self.weight[member]
        # A member is counted here where it does not visit the visitor's list itself.
        v, m = np.nonzero(near.T)[::-1]
        cuts = [0, *(np.flatnonzero(np.diff(m)) + 1).tolist(), len(m)]
        for i, j in zip(cuts, cuts[1:]):
            one = member[m[i]]
            theirs = v[i:j]
            self.found[one] += weight[theirs[~np.isin(own[theirs], self.visits[self.visit_at[one] : self.visit_at[one + 1]])]].sum()
        met = np.flatnonzero(counts)
        yield _found(node[met], [None] * len(met), counts[met])
        label = self.label[member]
        pairs = np.array(list(_spanning(near, label)), int).reshape(-1, 2)
        self.label[member] = label
        yield _found(node[pairs[:, 0]], self.node[member[pairs[:, 1]]], [None] * len(pairs))

    def counts(self) -> Iterator[pa.RecordBatch]:
        """Links that only visitors found."""
        if self.ready:
            met = np.flatnonzero(self.found)
            yield _found(self.node[met], [None] * len(met), self.found[met])


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Add n_links, component_id and kept to the rows of ``vectors``."""
    rows = vectors.drop("n_links", "component_id", "kept")
    spoilt = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = ~spoilt & F.exists(vector, lambda x: x != 0)
    copies = rows.where(usable).groupBy(F.col(vector).alias("vector")).agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("weight"))
    nodes = materialise(copies.withColumn("node", F.monotonically_increasing_id()), "pq-nodes")
    n, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if n:
        drawn = nodes.select("vector").orderBy(F.xxhash64("vector"), "node").limit(SAMPLE)
        sample = np.array([r[0] + [0.0] * (width - len(r[0])) for r in drawn.toLocalIterator()], np.float32 if dict(rows.dtypes)[vector] == "array<float>" else np.float64)
        found = materialise(links(nodes, learn(sample, n, least), width, least), "pq-links")
    else:
        found = rows.sparkSession.createDataFrame([], "a long, b long, n long")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    groups = components(found.where("b IS NOT NULL").select("a", "b"))
    named = nodes.join(counts, "node", "left").join(groups, "node", "left").select("vector", "first", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    named = materialise(named, "pq-named")
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    # Written, as the other sides are: a vector with very many copies is then split in the join.
    named = materialise(named.join(least_id, "component").select(F.col("vector").alias("_v"), F.col("n_links").alias("_n"), F.col("component_id").alias("_c")), "pq-named")
    met = rows.join(named, F.when(usable, F.col(vector)) == F.col("_v"), "left")
    component = F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(F.col(id_col))
    return met.select(*rows.columns, F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(False)).alias("kept"))
