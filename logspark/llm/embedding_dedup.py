"""Embedding near-duplicates: exact threshold pairs by a dual traversal of cover trees.

Vectors are scaled to length 1, where cosine >= c is distance <= sqrt(2 - 2c). Centers from a bounded sample split
all vectors into cells, large cells into blocks, and each block gets a cover tree: nested levels whose nodes have
halving radii. Two nodes are left out if their centers lie farther apart than their covering radii and the
threshold together; what remains is compared by cosine. Cells are left out by the same bound. Blocks are dealt into
groups of a bounded number of vectors, and each two groups meet in a tile, block by block: every pair of blocks that can
hold a link meets in one task, no task holds more than two groups, and a vector goes to a tile for each group, not to
one for each block."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

LEVELS = (1.0, 0.5, 0.25)

#: Blocks of a group at the most, groups at the least where there are as many blocks, and pairs whose vectors are side by side at once.
_BLOCKS, _GROUPS, _PAIRS = 16, 8, 1 << 15


def _array(rows: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _cosines(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of rows i of x with rows j of y, some at a time: both sides of all pairs would be many times x and y."""
    out = np.empty(len(i))
    for k in range(0, len(i), _PAIRS):
        out[k : k + _PAIRS] = np.einsum("ij,ij->i", x[i[k : k + _PAIRS]], y[j[k : k + _PAIRS]])
    return out


def unit_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id, embedding -> id long, unit binary (doubles of length 1, padded with zeros to width), null where a
    vector is null, zero or holds a null or non-finite component."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                x = np.array([np.nan if c is None else c for c in v or ()], np.float64)
                top = np.abs(x).max() if len(x) else 0.0
                if not np.isfinite(x).all() or not top:
                    out.append(None)
                    continue
                x = x / top  # lengths neither overflow nor vanish
                out.append(np.pad(x / np.sqrt(x @ x), (0, width - len(x))).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "unit"])

    own = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.mapInArrow(of, "id long, unit binary")


def sample_centers(units: DataFrame, n: int, per_cell: int, most: int = 256, sample: int = 4096) -> np.ndarray:
    """Up to `most` centers, each the vector of the sample that is farthest from those before it."""
    rows = [r["unit"] for r in units.orderBy(F.xxhash64("unit")).limit(sample).collect()]  # bounded by `sample`
    x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    chosen, near = [0], _distance(x, x[:1])[:, 0]
    while len(chosen) < min(most, -(-n // per_cell)) and near.max() > 1e-6:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distance(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def cover_tree(x: np.ndarray, levels: tuple[float, ...] = LEVELS) -> np.ndarray:
    """For each level the center (a row number) of each row's node. Centers of a level are centers of all finer
    levels, any two centers of one lie farther apart than its radius, and a node's rows lie within it."""
    distance, owner = _distance(x, x), []
    centers: list[int] = []
    for radius in levels:
        free = np.ones(len(x), bool)
        own = np.full(len(x), -1)
        for c in centers:  # those of the coarser level first: nested
            hit = free & (distance[c] <= radius)
            own[hit] = c
            free &= ~hit
        while free.any():
            c = int(free.argmax())
            centers.append(c)
            hit = free & (distance[c] <= radius)
            hit[c] = True
            own[hit] = c
            free &= ~hit
        for c in centers:
            own[c] = c
        owner.append(own)
    return np.array(owner)


class _Forest:
    """Smallest row number of each connected set, for links that come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            apart = low != high
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, high[apart], low[apart])
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def dual_traversal(x: np.ndarray, tx: np.ndarray, y: np.ndarray, ty: np.ndarray, cosine: float, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of x and y with at least this cosine, from coarse nodes to fine ones and then to rows; with `within`
    x is y and each pair comes in both directions, rows with themselves left out."""
    reach = np.sqrt(2 - 2 * cosine) + 1e-9
    nodes = []
    for v, t in ((x, tx), (y, ty)):
        own = []
        for level in t:
            centers, index = np.unique(level, return_inverse=True)
            radius = np.zeros(len(centers))
            np.maximum.at(radius, index, np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", v, v[level]), 0)))
            own.append((centers, index, radius))
        nodes.append(own)
    # Only levels that join rows together are worth a visit; the finest always is.
    last = len(tx) - 1
    visit = [k for k in range(last) if 4 * len(nodes[0][k][0]) * len(nodes[1][k][0]) <= len(nodes[0][last][0]) * len(nodes[1][last][0])]
    alive, before = None, None
    for level in [*visit, last]:
        (ca, ia, ra), (cb, ib, rb) = nodes[0][level], nodes[1][level]
        # No pair is nearer than the largest radii allow: a first look at cosines alone, in single precision and wider by
        # more than what that loses, then each pair's own bound.
        widest = min(ra.max() + rb.max() + reach, 2.0)
        i, j = np.nonzero(x[ca].astype(np.float32) @ y[cb].astype(np.float32).T >= np.float32(1 - widest**2 / 2 - 1e-5))
        near = np.sqrt(np.maximum(2 - 2 * _cosines(x, ca[i], y, cb[j]), 0)) <= ra[i] + rb[j] + reach
        i, j = i[near], j[near]
        if alive is not None:  # a node's rows may lie in several coarser ones: it lives if a pair of those does
            up = [_shares(nodes[s][before][1], nodes[s][level][1]) for s in (0, 1)]
            live = ((up[0] @ alive @ up[1].T)[i, j]) > 0
            i, j = i[live], j[live]
        alive, before = np.zeros((len(ca), len(cb)), np.float32), level
        alive[i, j] = 1
    alive = alive > 0
    (ca, ia, _), (cb, ib, _) = nodes[0][-1], nodes[1][-1]
    rows_a, rows_b = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    from_a, from_b = np.searchsorted(ia[rows_a], np.arange(len(ca) + 1)), np.searchsorted(ib[rows_b], np.arange(len(cb) + 1))
    single = (np.diff(from_a) == 1)[:, None] & (np.diff(from_b) == 1)[None, :]
    a, b = np.nonzero(alive & single)
    if len(a):
        a, b = rows_a[from_a[a]], rows_b[from_b[b]]
        hit = _cosines(x, a, y, b) >= cosine
        if within:
            hit &= a != b
        yield a[hit], b[hit]
    for i, j in zip(*np.nonzero(alive & ~single)):
        a, b = rows_a[from_a[i] : from_a[i + 1]], rows_b[from_b[j] : from_b[j + 1]]
        u, v = np.nonzero(x[a] @ y[b].T >= cosine)
        a, b = a[u], b[v]
        if within:
            a, b = a[a != b], b[a != b]
        yield a, b


def _shares(coarse: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """Which fine node has a row in which coarse node, as a matrix of 0 and 1."""
    out = np.zeros((fine.max() + 1, coarse.max() + 1), np.float32)
    out[fine, coarse] = 1
    return out


def embedding_links(units: DataFrame, cosine: float = 0.95, per_cell: int = 2000) -> DataFrame:
    """units (rep long, unit binary, copies long), distinct -> rep long, n long, root long, in parts: how many vectors
    (with copies) a vector is linked to in a task, and the smallest rep that its links there lead to."""
    n = units.count()
    spark = units.sparkSession
    if not n:
        return spark.createDataFrame([], "rep long, n long, root long")
    centers = sample_centers(units, n, per_cell)
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-9

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = _distance(_array(b["unit"]), centers)
            yield b.assign(cell=d.argmin(1), away=d.min(1))

    cells = materialise(units.mapInPandas(assign, "rep long, unit binary, copies long, cell long, away double"), "cells")
    sizes = {r["cell"]: (r["n"], r["radius"]) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}  # a row a center
    names = sorted(sizes)
    radius = np.array([sizes[c][1] for c in names])
    parts = np.array([-(-sizes[c][0] // per_cell) for c in names])
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        t = cover_tree(_array(rows["unit"]))
        return rows.assign(tree=[c.astype("<i4").tobytes() for c in t.T], row=np.arange(len(rows), dtype=np.int32))

    block = F.element_at(F.lit([int(x) for x in first]), F.array_position(F.lit(names), F.col("cell")).cast("int"))
    part = F.element_at(F.lit([int(x) for x in parts]), F.array_position(F.lit(names), F.col("cell")).cast("int"))
    blocks = cells.withColumn("block", (block + F.pmod(F.xxhash64("rep"), part)).cast("long")).select("rep", "unit", "copies", "cell", "block")
    blocks = blocks.groupBy("block").applyInPandas(tree, "rep long, unit binary, copies long, cell long, block long, tree binary, row int")

    # Blocks in a row go to one group. More vectors in a group mean fewer tiles that a vector goes to; a group's bound is that of a task.
    held = min(_BLOCKS * per_cell, max(per_cell, -(-n // _GROUPS)))
    rows_of = np.repeat([sizes[c][0] / k for c, k in zip(names, parts)], parts)
    group_of = ((np.cumsum(rows_of) - rows_of / 2) // held).astype(np.int64)
    cells_of = np.repeat(np.arange(len(names)), parts)
    spots = np.array(names)
    holds = np.zeros((len(names), group_of[-1] + 1), bool)  # which cell has blocks in which group
    holds[cells_of, group_of] = True

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = _distance(_array(b["unit"]), centers[spots]) <= radius[None, :] + reach
            near[np.arange(len(b)), np.searchsorted(spots, b["cell"])] = True
            own = group_of[b["block"]]
            met = near.astype(np.float32) @ holds.astype(np.float32) > 0
            met[np.arange(len(b)), own] = True
            yield b.assign(own=own, others=[np.flatnonzero(m) for m in met])

    columns = "rep long, unit binary, copies long, cell long, block long, tree binary, row int"
    met = blocks.mapInPandas(meet, f"{columns}, own long, others array<long>").withColumn("other", F.explode("others"))
    met = met.drop("others").withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable").reset_index(drop=True)
        found, forest = np.zeros(len(rows), np.int64), _Forest(len(rows))
        x, row, copies = _array(rows["unit"]), rows["row"].to_numpy(), rows["copies"].to_numpy()
        trees = np.frombuffer(b"".join(rows["tree"]), "<i4").reshape(len(rows), -1).T
        block = rows["block"].to_numpy()
        at = np.argsort(block, kind="stable")
        there, start = np.unique(block[at], return_index=True)
        at = dict(zip(there, np.split(at, start[1:])))
        one, two = ([k for k in there if group_of[k] == g] for g in key)
        for p in one:
            for q in two:
                if p > q and key[0] == key[1]:
                    continue
                sides = []
                for k, c in ((p, cells_of[q]), (q, cells_of[p])):  # rows of k that can reach cell c
                    near = at[k]
                    if cells_of[k] != c:
                        near = near[_distance(x[near], centers[spots[c : c + 1]])[:, 0] <= radius[c] + reach]
                    sides.append(near)
                if not all(map(len, sides)):
                    continue
                v, t = zip(*[(x[s], _tree(trees[:, s], row[s])) for s in sides])
                for a, b in dual_traversal(v[0], t[0], v[1], t[1], cosine, p == q):
                    a, b = sides[0][a], sides[1][b]
                    found += np.bincount(a, copies[b], len(rows)).astype(np.int64)
                    if p != q:
                        found += np.bincount(b, copies[a], len(rows)).astype(np.int64)
                    forest.add(a, b)
        some = found > 0
        reps = rows["rep"].to_numpy()
        return pd.DataFrame({"rep": reps[some], "n": found[some], "root": reps[forest.root[some]]})

    return met.groupBy("one", "two").applyInPandas(compare, "rep long, n long, root long")


def _tree(tree: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The tree of those rows of a block that are there, by their place among them; a node's center that is not among
    them gives way to one of its rows."""
    where = np.full(max(tree.max(), row.max()) + 1, -1)
    where[row] = np.arange(len(row))
    out = []
    for level in tree:
        own, firsts, index = np.unique(level, return_index=True, return_inverse=True)
        out.append(np.where(where[own] < 0, firsts, where[own])[index])
    return np.array(out)


def embedding_components(vectors: DataFrame, cosine: float = 0.95, per_cell: int = 2000) -> DataFrame:
    """vec_id, embedding, ... -> vec_id long, n_links long, component_id long, kept boolean, a row for each row.

    Cosines in double precision. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; shorter ones count as padded with zeros. Vectors of one direction are compared once. Rows that repeat a
    vec_id count as vectors of their own. Other columns are ignored; an empty table gives no rows."""
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    units = materialise(unit_vectors(vectors, max(width, 1)), "units")
    reps = materialise(units.where("unit IS NOT NULL").groupBy("unit").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    reps = reps.withColumn("rep", F.col("rep"))
    parts = materialise(embedding_links(reps.select("rep", "unit", "copies"), cosine, per_cell), "embedding-links")
    groups = connected_components(parts.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = parts.groupBy("rep").agg(F.sum("n").alias("n"))
    named = reps.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("unit", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = units.join(named, "unit", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
