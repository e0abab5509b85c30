"""Most similar vectors for every vector.

A forest of random-projection trees over sparse vectors. Vectors are projected
by hashed random signs, so that no projection table depends on the terms. Each
tree halves a bounded sample at the median of a random direction between two of
its points; the planes of all trees are a few MB whatever the number of rows. A
vector is a member of one leaf in each tree, and as a query it visits further
leaves, chosen over all trees by one priority queue of margins. Where the rows
are more than these leaves hold, every leaf is split again by planes of its own,
fitted on a bounded sample of its members; those planes are a table that meets
the rows at their leaf, pass after pass, until a leaf holds ``LEAF_ROWS`` rows. So
the work of a row stays the same however many there are. Members and visitors
meet at their leaf, where the cosines are computed exactly and the best are kept.
Copies are one vector in all of this.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import durable

#: Rows that the forest is fitted on, at most; every row is indexed.
SAMPLE = 32_768
DIMS = 128
TREES = 8
#: Leaves that a vector visits over all trees, its own among them.
VISITS = 20
#: Sample rows in a leaf.
LEAF_SAMPLE = 16
#: Rows that a leaf holds on average at most; further levels are fitted on so many sample rows for each of their leaves.
LEAF_ROWS = 64
SPLIT_SAMPLE = 8
#: Levels that one more pass adds at most.
SPLIT_LEVELS = 6
#: Steps of a projected number where it travels with its row, in one byte.
STEPS = 24
#: Members of a block; a larger leaf is compared block by block.
BLOCK_ROWS = 2048
#: Rows that visit leaves in a partition.
VISITS_PER_PARTITION = 400_000
#: Vectors in a block of the exact search, and cosines that it holds at a time.
EXACT_ROWS = 16_384
CELLS = 4_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def project(terms: np.ndarray, weights: np.ndarray, offsets: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Rows of ``dims`` numbers from sparse rows: each term has a sign in each dimension, from its hash."""
    seeds = np.arange(1, dims // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros((len(offsets) - 1, dims), dtype=np.float32)
    for start in range(0, len(offsets) - 1, 4096):
        ends = offsets[start : start + 4097]
        part = slice(ends[0], ends[-1])
        with np.errstate(over="ignore"):
            hashes = _mix(terms[part].astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x2545F4914F6CDD1D) + seeds)
        signs = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1).astype(np.float32) * 2 - 1
        signs *= weights[part, None]
        filled = np.flatnonzero(np.diff(ends))
        if len(filled):
            out[start + filled] = np.add.reduceat(signs, ends[:-1][filled] - ends[0], axis=0)
    return out


class Forest(NamedTuple):
    """Complete binary trees: planes[tree, node], thresholds[tree, node]; the children of node n are 2n+1 and 2n+2."""

    planes: np.ndarray
    thresholds: np.ndarray
    depth: int

    @classmethod
    def fit(cls, points: np.ndarray, trees: int = TREES, leaf: int = LEAF_SAMPLE, seed: int = 0, depth: int | None = None) -> Forest:
        """Split a sample at medians until a leaf holds ``leaf`` of its rows, or to ``depth``."""
        rng = np.random.default_rng(seed)
        depth = max(0, int(np.ceil(np.log2(max(len(points), 1) / leaf)))) if depth is None else depth
        nodes, dims = 2**depth - 1, points.shape[1]
        planes = np.zeros((trees, nodes, dims), dtype=np.float32)
        thresholds = np.zeros((trees, nodes), dtype=np.float32)
        for t in range(trees):
            inside = {0: np.arange(len(points))}
            for node in range(nodes):
                rows = inside.pop(node)
                direction = rng.standard_normal(dims).astype(np.float32)
                if len(rows) > 1:
                    a, b = points[rng.choice(rows, 2, replace=False)]
                    if (a != b).any():
                        direction = a / max(np.linalg.norm(a), 1e-9) - b / max(np.linalg.norm(b), 1e-9)
                direction /= max(np.linalg.norm(direction), 1e-9)
                values = points[rows] @ direction
                cut = np.median(values).astype(np.float32) if len(rows) else np.float32(0)
                planes[t, node], thresholds[t, node] = direction, cut
                inside[2 * node + 1], inside[2 * node + 2] = rows[values <= cut], rows[values > cut]
        return cls(planes, thresholds, depth)

    def visit(self, points: np.ndarray, visits: int) -> np.ndarray:
        """The leaves that each point visits, as tree * 2**depth + leaf; the first of each tree is the point's own.

        One queue holds the unexplored sides of all trees by the margin at which
        they were left; the smallest margin is explored next, down to a leaf.
        """
        trees, nodes = len(self.planes), 2**self.depth - 1
        rows, b = np.arange(len(points)), len(points)
        visits = max(min(visits, trees * (nodes + 1)), trees)
        slots = visits * max(self.depth, 1)
        margin = np.full((b, slots), np.inf, dtype=np.float32)
        waiting = np.zeros((b, slots), dtype=np.int32)
        out = np.empty((b, visits), dtype=np.int32)
        for v in range(visits):
            if v < trees:
                tree, node, worst = np.full(b, v), np.zeros(b, dtype=np.int64), np.zeros(b, dtype=np.float32)
            else:
                best = margin[:, : v * self.depth].argmin(axis=1)
                worst = margin[rows, best].copy()
                margin[rows, best] = np.inf
                tree, node = np.divmod(waiting[rows, best].astype(np.int64), 2 * nodes + 1)
            for level in range(self.depth):
                deep = node < nodes
                if not deep.any():
                    break
                r = rows[deep]
                m = np.einsum("ij,ij->i", points[r], self.planes[tree[r], node[r]]) - self.thresholds[tree[r], node[r]]
                slot = v * self.depth + level
                margin[r, slot] = np.maximum(worst[r], np.abs(m))
                right = m > 0
                waiting[r, slot] = tree[r] * (2 * nodes + 1) + 2 * node[r] + np.where(right, 1, 2)
                node[r] = 2 * node[r] + np.where(right, 2, 1)
            out[:, v] = tree * (nodes + 1) + node - nodes
        return out


def _sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values of a list column."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return offsets - offsets[0], column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_numpy(zero_copy_only=False)


def unit_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(vec_id, terms, weights) of length one, terms in order; null and zero vectors are left out.

    Entries that are null, have a null term or weight, or weigh 0 are dropped;
    the weights of a repeated term add up. A repeated row counts once.
    """
    entry = F.filter(F.col(vector_col), lambda e: e.isNotNull() & e["term"].isNotNull() & (F.coalesce(e["weight"], F.lit(0.0)) != 0))
    rows = vectors.select(F.col(id_col).alias("vec_id"), entry.alias("v")).filter("vec_id is not null and size(v) > 0")
    rows = rows.select("vec_id", F.transform("v", lambda e: e["term"].cast("long")).alias("t"), F.transform("v", lambda e: e["weight"].cast("double")).alias("w"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, terms = _sparse(batch.column(1))
            weights = _sparse(batch.column(2))[1]
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            order = np.lexsort((terms, row))
            row, terms, weights = row[order], terms[order], weights[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (terms[1:] != terms[:-1])])) if len(row) else np.zeros(0, dtype=np.int64)
            if len(first):
                row, terms, weights = row[first], terms[first], np.add.reduceat(weights, first)
            norm = np.sqrt(np.bincount(row, weights**2, batch.num_rows))
            keep = (norm[row] > 0) & np.isfinite(norm[row]) & (weights != 0)
            row, terms, weights = row[keep], terms[keep], (weights[keep] / norm[row[keep]]).astype(np.float32)
            counts = np.bincount(row, minlength=batch.num_rows)
            some = np.flatnonzero(counts)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(terms)), pa.ListArray.from_arrays(ends, pa.array(weights))], ["vec_id", "terms", "weights"]
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(unit, f"vec_id {kind}, terms array<bigint>, weights array<float>").dropDuplicates(["vec_id"])


def _fit(vectors: DataFrame, sample: int, trees: int, leaf: int, seed: int) -> tuple[Forest, int]:
    rows = vectors.count()
    chosen = vectors.select("terms", "weights")
    if rows > sample:
        chosen = chosen.sample(fraction=min(1.0, 1.05 * sample / rows), seed=seed).limit(sample)
    table = chosen.toArrow().combine_chunks()
    if not table.num_rows:
        return Forest.fit(np.zeros((0, DIMS), dtype=np.float32), trees, leaf, seed), rows
    terms, weights = table.column(0).combine_chunks(), table.column(1).combine_chunks()
    terms, weights = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (terms, weights))
    offsets, t = _sparse(terms)
    return Forest.fit(project(t, _sparse(weights)[1], offsets), trees, leaf, seed), rows


def _best_at_leaf(members: tuple, queries: tuple, k: int, least: float) -> list[np.ndarray]:
    """[query ids, member ids, cosines]: for each query its k best members of at least ``least``, without itself."""
    m_ids, m_off, m_terms, m_weights = members
    q_ids, q_off, q_terms, q_weights = queries
    known, place = np.unique(m_terms, return_inverse=True)
    dense = np.zeros((len(m_ids), len(known)), dtype=np.float32)
    dense[np.repeat(np.arange(len(m_ids)), np.diff(m_off)), place] = m_weights
    at = np.minimum(np.searchsorted(known, q_terms), len(known) - 1)
    hit = known[at] == q_terms
    other = np.zeros((len(q_ids), len(known)), dtype=np.float32)
    other[np.repeat(np.arange(len(q_ids)), np.diff(q_off))[hit], at[hit]] = q_weights[hit]
    cosines = other @ dense.T
    cosines[q_ids[:, None] == m_ids[None, :]] = -2
    if len(m_ids) > 4 * k:  # ties at the last place are kept, the ranking by id comes later
        least_of_row = np.maximum(np.partition(cosines, len(m_ids) - k, axis=1)[:, len(m_ids) - k], least)
        q, m = np.nonzero((cosines >= least_of_row[:, None]) & (cosines > -1.5))
    else:
        q, m = np.nonzero((cosines >= least) & (cosines > -1.5))
    return [q_ids[q], m_ids[m], cosines[q, m]]


def nearest(
    vectors: DataFrame, k: int = 5, min_cosine: float = -1.0, id_col: str = "vec_id", vector_col: str = "vector",
    trees: int = TREES, visits: int = VISITS, sample: int = SAMPLE, leaf: int = LEAF_SAMPLE, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS, seed: int = 0,
) -> DataFrame:
    """(vec_id, neighbour, cosine, rank): for every vector its ``k`` most similar others of at least ``min_cosine``.

    Ties go to the smaller id. A vector equal to another in direction has cosine
    1 with it and counts as any other. Null, empty and zero vectors have no
    neighbours and are none. The forest may miss neighbours; cosines are exact.
    """
    copies, reps = _classes(vectors, id_col, vector_col)
    forest, rows = _fit(reps, sample, trees, leaf, seed)
    levels = _levels(rows, forest.depth, leaf_rows)
    visited = _visited(reps, forest, visits, bool(levels))
    if levels:
        # a sample of members, each at its own leaf of every tree, follows the rows down and is split before them
        share = min(1.0, 1.25 * SPLIT_SAMPLE * 2 ** (forest.depth + sum(levels)) / max(rows, 1))
        members = durable(_visited(reps.sample(share, seed=seed), forest, trees, True).select("leaf", "query", "copy", "point"))
        for turn, depth in enumerate(levels, start=1):
            planes = durable(_split_planes(members, depth, seed + turn))
            visited = _descended(visited, planes, depth, 2, rows * visits)
            if turn < len(levels):
                members = durable(_descended(members, planes, depth, 1, rows))
        visited = visited.drop("point")
    met = visited.repartition(_parts(vectors, rows * visits), "leaf").sortWithinPartitions("leaf", "query")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, asked = None, [], []

        def part(rows: list[pa.RecordBatch]) -> tuple:
            t = pa.Table.from_batches(rows).combine_chunks()
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (t.column(n).combine_chunks() for n in ("copy", "terms", "weights"))]
            offsets, terms = _sparse(columns[1])
            return columns[0].to_numpy(zero_copy_only=False), offsets, terms, _sparse(columns[2])[1]

        def blocks(rows: list[pa.RecordBatch]) -> Iterator[tuple]:
            if rows:
                t = pa.Table.from_batches(rows).combine_chunks()
                for start in range(0, t.num_rows, block_rows):
                    yield part(t.slice(start, block_rows).to_batches())

        def results(own: bool) -> Iterator[pa.RecordBatch]:
            pieces, others = list(blocks(members)), list(blocks(asked))
            for m in pieces:
                for q in pieces if own else []:
                    found = _best_at_leaf(m, q, k, min_cosine)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "cosine"])
                for q in others:
                    a, b, c = _best_at_leaf(m, q, k, min_cosine)
                    # both ways: the visitor is as good a neighbour of the member
                    both = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([c, c])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["a", "b", "cosine"])

        first = True
        for batch in batches:
            leaf_, query_ = (batch.column(batch.schema.names.index(n)).to_numpy(zero_copy_only=False) for n in ("leaf", "query"))
            change = np.flatnonzero((leaf_[1:] != leaf_[:-1]) | (query_[1:] != query_[:-1])) + 1
            for start, end in zip([0, *change], [*change, batch.num_rows]):
                if start == end:
                    continue
                if key != leaf_[start]:
                    yield from results(first)
                    key, members, asked, first = leaf_[start], [], [], True
                (asked if query_[start] else members).append(batch.slice(start, end - start))
                if members and sum(x.num_rows for x in asked) > 4 * block_rows:
                    yield from results(first)
                    asked, first = [], False
        yield from results(first)

    pairs = met.mapInArrow(rank, "a bigint, b bigint, cosine float")
    best = _top(pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "a", "b", k + 1)
    return _listed(best, copies, k, id_col).filter(F.col("cosine") >= min_cosine)


def _parts(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // VISITS_PER_PARTITION)


def _levels(rows: int, depth: int, leaf_rows: int) -> list[int]:
    """The levels of each further pass, so that a leaf of all rows holds ``leaf_rows`` on average at most."""
    more = max(0, int(np.ceil(np.log2(max(rows, 1) / leaf_rows))) - depth)
    return [min(SPLIT_LEVELS, more - k) for k in range(0, more, SPLIT_LEVELS)]


def _visited(reps: DataFrame, forest: Forest, visits: int, pointed: bool) -> DataFrame:
    """(leaf, query, copy, terms, weights): each vector at its own leaves, and as a query at the others that it visits; with ``pointed`` also its projection ``point``."""
    shared = reps.sparkSession.sparkContext.broadcast(tuple(forest))  # plain arrays, which executors read without the package
    names = ["leaf", "query", "copy", "terms", "weights"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Forest(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                piece = batch.slice(start, 2048)
                offsets, terms = _sparse(piece.column(1))
                points = project(terms, _sparse(piece.column(2))[1], offsets)
                leaves = own.visit(points, visits)
                many = leaves.shape[1]
                take = pa.array(np.repeat(np.arange(piece.num_rows), many))
                query = np.tile(np.arange(many) >= len(own.planes), piece.num_rows)
                columns = [pa.array(leaves.ravel().astype(np.int64)), pa.array(query), *(c.take(take) for c in piece.columns)]
                if pointed:
                    columns.append(_bytes(points).take(take))
                yield pa.RecordBatch.from_arrays(columns, names + ["point"] * pointed)

    return reps.select("copy", "terms", "weights").mapInArrow(visit, "leaf bigint, query boolean, copy bigint, terms array<bigint>, weights array<float>" + ", point binary" * pointed)


def _bytes(points: np.ndarray) -> pa.Array:
    small = np.clip(np.rint(points * STEPS), -127, 127).astype(np.int8)
    return pa.Array.from_buffers(pa.binary(), len(small), [None, pa.py_buffer((np.arange(len(small) + 1) * small.shape[1]).astype(np.int32)), pa.py_buffer(small.tobytes())])


def _points(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(len(column), -1).astype(np.float32) / STEPS


def _split_planes(members: DataFrame, depth: int, seed: int) -> DataFrame:
    """(leaf, planes, thresholds): a tree of ``depth`` levels for each leaf, fitted on its members, of which a leaf with more than its share takes the first in the order of a hash."""
    cap = 4 * SPLIT_SAMPLE * 2**depth
    order = Window.partitionBy("leaf").orderBy(F.xxhash64("copy", F.lit(seed)))
    few = members.filter("not query").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap)

    def fit(group: pa.Table) -> pa.Table:
        leaf = group["leaf"][0].as_py()
        tree = Forest.fit(_points(group["point"].combine_chunks()), 1, SPLIT_SAMPLE, seed + leaf, depth)
        return pa.table({"leaf": [leaf], "planes": [tree.planes.tobytes()], "thresholds": [tree.thresholds.tobytes()]})

    return few.select("leaf", "point").groupBy("leaf").applyInArrow(fit, "leaf bigint, planes binary, thresholds binary")


def _descended(visited: DataFrame, planes: DataFrame, depth: int, visits: int, rows: int) -> DataFrame:
    """``visited`` with each leaf split in 2**depth by its planes: a member goes to its own part and asks the next ones by margin, ``visits`` in all; a query asks its own part."""
    order = visited.columns
    kinds = {f.name: f.dataType for f in visited.schema}
    trees = planes.select("leaf", F.lit(0).alias("turn"), *[F.lit(None).cast(kinds[c]).alias(c) for c in order if c != "leaf"], "planes", "thresholds")
    both = trees.unionByName(visited.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    met = both.repartition(_parts(visited, rows), "leaf").sortWithinPartitions("leaf", "turn")

    def split(piece: pa.RecordBatch, tree: Forest | None, leaf: int) -> pa.RecordBatch:
        query = piece.column(order.index("query")).to_numpy(zero_copy_only=False).astype(bool)
        if tree is None:  # none of its members is in the sample
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(query), leaf << depth)) if n == "leaf" else c for n, c in zip(order, piece.columns)], order)
        parts = tree.visit(_points(piece.column(order.index("point"))), visits)
        row, nth = np.nonzero((np.arange(parts.shape[1]) == 0) | ~query[:, None])
        take = pa.array(row)
        new = {"leaf": pa.array((leaf << depth) + parts[row, nth].astype(np.int64)), "query": pa.array(query[row] | (nth > 0))}
        return pa.RecordBatch.from_arrays([new[n] if n in new else c.take(take) for n, c in zip(order, piece.columns)], order)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, None
        for batch in batches:
            names = batch.schema.names
            leaf, turn = (batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in ("leaf", "turn"))
            planes_, thresholds_ = (batch.column(names.index(n)) for n in ("planes", "thresholds"))
            piece = batch.select(order)
            change = np.flatnonzero(leaf[1:] != leaf[:-1]) + 1
            for start, end in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if start == end:
                    continue
                if key != leaf[start]:
                    key, tree = int(leaf[start]), None
                if turn[start] == 0:
                    thresholds = np.frombuffer(thresholds_[start].as_py(), dtype=np.float32)
                    tree = Forest(np.frombuffer(planes_[start].as_py(), dtype=np.float32).reshape(1, len(thresholds), -1), thresholds.reshape(1, -1), depth)
                    start += 1
                if start < end:
                    yield split(piece.slice(start, end - start), tree, key)

    return met.mapInArrow(descend, visited.schema)


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(copy, vec_id) of all vectors, and one representative (copy, vec_id, terms, weights) of each class of copies."""
    units = durable(unit_vectors(vectors, id_col, vector_col))
    units = units.withColumn("copy", F.xxhash64("terms", F.transform("weights", lambda w: F.floor(w * 1e5 + 0.5))))
    reps = durable(units.groupBy("copy").agg(F.min_by(F.struct("terms", "weights"), "vec_id").alias("v"), F.min("vec_id").alias("vec_id")).select("copy", "vec_id", "v.terms", "v.weights"))
    return units.select("copy", "vec_id"), reps


def _listed(best: DataFrame, copies: DataFrame, k: int, id_col: str) -> DataFrame:
    """(id_col, neighbour, cosine, rank) from the best k + 1 classes (a, b, cosine); of a class the k + 1 smallest ids are all that anyone can need."""
    few = _first_ids(copies, k + 1)
    # candidates of a copy class: the first ids of its neighbours' classes, and its own
    near = best.join(few.withColumnRenamed("copy", "b"), "b").select(F.col("a").alias("copy"), "vec_id", "cosine")
    own = few.select("copy", "vec_id", F.lit(1.0).cast("float").alias("cosine"))
    listed = (
        _top(near.unionByName(own), "copy", "vec_id", k + 1)
        .groupBy("copy")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("far"), F.col("vec_id").alias("neighbour")))).alias("list"))
    )
    return (
        copies.join(listed, "copy")
        .withColumn("list", F.slice(F.filter("list", lambda e: e["neighbour"] != F.col("vec_id")), 1, k))
        .select("vec_id", F.posexplode("list").alias("p", "e"))
        .select(F.col("vec_id").alias(id_col), F.col("e.neighbour").alias("neighbour"), F.least(-F.col("e.far"), F.lit(1.0).cast("float")).alias("cosine"), (F.col("p") + 1).alias("rank"))
    )


def _best_of_all(members: tuple, queries: tuple, k: int) -> list[np.ndarray]:
    """[query places, member places, cosines]: for each query its k best members without itself; ties go to the earlier member.

    Members are read by term, so that only terms which both hold are multiplied;
    members that share none have cosine 0 and count like the others.
    """
    m_copy, m_off, m_terms, m_weights = members
    q_copy, q_off, q_terms, q_weights = queries
    n, k = len(m_copy), min(k, len(m_copy))
    order = np.argsort(m_terms, kind="stable")
    known, first = np.unique(m_terms[order], return_index=True)
    first = np.append(first, len(order))
    holder, weight = np.repeat(np.arange(n), np.diff(m_off))[order], m_weights[order]
    place = np.minimum(np.searchsorted(known, q_terms), len(known) - 1)
    many = np.where(known[place] == q_terms, first[place + 1] - first[place], 0)
    upto, out = np.concatenate([[0], np.cumsum(many)]), []
    start, rows = 0, max(1, CELLS // n)
    while start < len(q_copy):
        # a piece has at most so many cells and, unless it is one row, so many products
        end = int(np.searchsorted(upto[q_off], upto[q_off[start]] + CELLS, side="right")) - 1
        end = min(max(end, start + 1), start + rows, len(q_copy))
        a, b = q_off[start], q_off[end]
        entry = np.repeat(np.arange(a, b), many[a:b])
        at = np.arange(upto[a], upto[b]) - upto[entry] + first[place[entry]]
        row = np.repeat(np.arange(end - start), np.diff(q_off[start : end + 1]))[entry - a]
        cosines = np.bincount(row * n + holder[at], q_weights[entry].astype(np.float64) * weight[at], (end - start) * n).astype(np.float32).reshape(-1, n)
        mine = np.searchsorted(m_sorted := np.sort(m_copy), q_copy[start:end])
        same = m_sorted[np.minimum(mine, n - 1)] == q_copy[start:end]
        if same.any():
            q, m = np.nonzero(q_copy[start:end][same][:, None] == m_copy[None, :])
            cosines[np.flatnonzero(same)[q], m] = -2
        least = np.partition(cosines, n - k, axis=1)[:, n - k]
        over = cosines > least[:, None]
        q, m = np.nonzero(over)
        tie_q, tie_m = np.nonzero(cosines == least[:, None])
        nth = np.arange(len(tie_q)) - np.searchsorted(tie_q, tie_q)
        keep = nth < (k - over.sum(axis=1))[tie_q]
        q, m = np.concatenate([q, tie_q[keep]]), np.concatenate([m, tie_m[keep]])
        c = cosines[q, m]
        real = c > -1.5
        out.append((q[real] + start, m[real], c[real]))
        start = end
    return [np.concatenate(x) for x in zip(*out)]


def exact_nearest(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector", block_rows: int = EXACT_ROWS) -> DataFrame:
    """(vec_id, neighbour, cosine, rank): for every vector its ``k`` most similar others, however low their cosine; none is missed.

    Ties go to the smaller id. Null, empty and zero vectors have no neighbours and
    are none. Every block of vectors meets every block; the work is the number of
    pairs that share a term, once for each term shared.
    """
    copies, reps = _classes(vectors, id_col, vector_col)
    blocks = max(1, -(-reps.count() // block_rows))
    block = F.pmod(F.xxhash64("copy", F.lit(1)), F.lit(blocks)).cast("int")
    turns = F.concat(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(block.alias("m"), x.cast("int").alias("q"), F.lit(False).alias("asks"))), F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(x.cast("int").alias("m"), block.alias("q"), F.lit(True).alias("asks"))))
    met = reps.select(F.explode(turns).alias("turn"), "copy", "vec_id", "terms", "weights").select("turn.m", "turn.q", "turn.asks", "copy", "vec_id", "terms", "weights")
    kind = reps.schema["vec_id"].dataType.simpleString()

    def rank(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        sides = []
        for asks in (False, True):
            side = rows.filter(pc.equal(rows["asks"], asks)).combine_chunks()
            terms, weights = (_sparse(pa.concat_arrays(side[c].chunks) if side.num_rows else pa.array([], side[c].type)) for c in ("terms", "weights"))
            sides.append((side["vec_id"], (side["copy"].to_numpy(), terms[0], terms[1], weights[1])))
        (ids, members), (_, queries) = sides
        if not len(members[0]) or not len(queries[0]):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "vec_id": pa.array([], rows.schema.field("vec_id").type), "cosine": pa.array([], pa.float32())})
        q, m, c = _best_of_all(members, queries, k + 1)
        return pa.table({"a": queries[0][q], "b": members[0][m], "vec_id": ids.take(pa.array(m)), "cosine": c})

    found = met.groupBy("m", "q").applyInArrow(rank, f"a bigint, b bigint, vec_id {kind}, cosine float")
    return _listed(_top(found, "a", "vec_id", k + 1).select("a", "b", "cosine"), copies, k, id_col)


def _top(rows: DataFrame, of: str, id_col: str, k: int) -> DataFrame:
    """The k rows of highest cosine, then smallest id, of each ``of``."""
    order = Window.partitionBy(of).orderBy(F.desc("cosine"), id_col)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def _first_ids(copies: DataFrame, k: int) -> DataFrame:
    """The k smallest ids of each class of copies, first within salted parts of it."""
    salted = Window.partitionBy("copy", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = copies.withColumn("_n", F.row_number().over(salted)).filter(F.col("_n") <= k).drop("_n")
    whole = Window.partitionBy("copy").orderBy("vec_id")
    return few.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= k).drop("_n")


def mutual(nearest_rows: DataFrame, min_cosine: float, id_col: str = "vec_id") -> DataFrame:
    """(vec_a, vec_b, cosine), vec_a < vec_b: pairs that are among each other's nearest, of at least ``min_cosine``."""
    pairs = nearest_rows.filter(F.col("cosine") >= min_cosine).select(F.least(id_col, "neighbour").alias("vec_a"), F.greatest(id_col, "neighbour").alias("vec_b"), "cosine")
    return pairs.groupBy("vec_a", "vec_b").agg(F.count(F.lit(1)).alias("ways"), F.max("cosine").alias("cosine")).filter("ways = 2").drop("ways")
