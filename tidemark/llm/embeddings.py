"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them.

Equal vectors form one class, counted and represented once. Centroids are fitted on a bounded
sample; every class is then assigned to its nearest cell. Cells lie in blocks, and every two
blocks whose members may link meet in a task of their own, as matrix products in double
precision: a cell of any size is split, none is sampled. What may link follows exactly from the
angles to the centroids, by the triangle inequality, so no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Vectors that the centroids are fitted on, at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8
#: Members for each cell aimed at, and cells at most (they are broadcast: 8 * dimensions bytes each).
CELL, MOST_CELLS = 400, 4096
#: Bytes of a block's vectors, at most; blocks that a smaller table is dealt into for parallel work.
BLOCK_BYTES, SPREAD = 8 << 20, 8
#: Rows compared with all centroids at once; what angles may be off by rounding.
STEP, MARGIN = 1024, 1e-6


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """``k`` unit centroids of the unit rows ``x``; an emptied cell restarts at a far row."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        cell, best = np.empty(len(x), dtype=np.int64), np.empty(len(x))
        for a in range(0, len(x), 4096):
            dots = x[a : a + 4096] @ centroids.T
            cell[a : a + 4096] = dots.argmax(axis=1)
            best[a : a + 4096] = dots.max(axis=1)
        order = np.argsort(cell, kind="stable")
        present, first = np.unique(cell[order], return_index=True)
        sums = np.zeros_like(centroids)
        sums[present] = np.add.reduceat(x[order], first, axis=0)
        empty = np.setdiff1d(np.arange(k), present)
        if len(empty):
            sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


def _classes(vectors: DataFrame) -> DataFrame:
    """(id, d, unit, print) of each row; d, unit and print are null for unusable vectors.

    unit: the unit vector's doubles as bytes. print: a fingerprint of the vector itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            d, unit, prints = [], [], []
            edges = np.asarray(lists.offsets, dtype=np.int64)
            values = np.asarray(lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)  # nulls become nan
            valid = np.asarray(lists.is_valid())
            for ok, a, b in zip(valid.tolist(), edges.tolist(), edges[1:].tolist(), strict=False):
                v = values[a:b]
                top = np.abs(v).max() if ok and b > a else 0.0
                if not np.isfinite(top) or top == 0.0:
                    d.append(None), unit.append(None), prints.append(None)
                    continue
                u = v / top  # so that neither very small nor very large components lose their squares
                u = u / np.sqrt(u @ u)
                d.append(len(v)), unit.append(u.tobytes()), prints.append(xxhash.xxh3_128_digest((v + 0.0).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(d, type=pa.int32()), pa.array(unit, type=pa.binary()), pa.array(prints, type=pa.binary())], names=["id", "d", "unit", "print"])

    return vectors.mapInArrow(common.lean(run), "id long, d int, unit binary, print binary")


def _fit(classes: DataFrame, rows: int, d: int) -> np.ndarray:
    """Centroids for vectors of length ``d``, from a sample bounded by SAMPLE in expectation."""
    part = min(1.0, SAMPLE / max(rows, 1))
    sample = classes.where(F.col("d") == d).where(F.pmod(F.xxhash64("print"), F.lit(1 << 30)) <= int(part * (1 << 30))).select("unit", F.hex("print").alias("at"))
    raw = sorted(sample.collect(), key=lambda r: r["at"])
    x = np.stack([np.frombuffer(r["unit"], dtype=np.float64) for r in raw]) if raw else np.zeros((0, d))
    k = min(MOST_CELLS, max(1, rows // CELL), max(1, len(x) // 4))
    return spherical_kmeans(x, k, ROUNDS) if len(x) else np.eye(1, d)


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1.0, 1.0))


def _units(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(u, dtype=np.float64) for u in column])


def _cells(classes: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """Each class with its nearest cell and the angle to that cell's centroid."""
    shared = classes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                for d, rows in batch.slice(k, STEP).to_pandas().groupby("d"):
                    angles = _angles(_units(rows["unit"]), shared.value[int(d)])
                    cell = angles.argmin(axis=1)
                    out = rows.assign(cell=cell.astype(np.int32), angle=angles[np.arange(len(cell)), cell])
                    yield pa.RecordBatch.from_pandas(out[["d", "cell", "angle", "rep", "size", "unit"]], preserve_index=False)

    return classes.select("d", "rep", "size", "unit").mapInArrow(common.lean(run), "d int, cell int, angle double, rep long, size long, unit binary")


@dataclass
class Plan:
    """The cells of one length: centroids, angles of their members, and the blocks these are dealt into."""

    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray  # a cell's first block, and in how many it is
    parts: np.ndarray
    cells: np.ndarray  # the cells of all blocks, block by block, and each block's first place in them
    edges: np.ndarray


def _plan(centroids: np.ndarray, regions: list) -> Plan:
    """Deals the cells into blocks, near ones beside each other; a cell larger than a block has some of its own."""
    k, d = centroids.shape
    low, high, members = np.full(k, np.inf), np.full(k, -np.inf), np.zeros(k, dtype=np.int64)
    for r in regions:
        low[r["cell"]], high[r["cell"]], members[r["cell"]] = r["low"], r["high"], r["members"]
    n = int(members.sum())
    most = max(256, BLOCK_BYTES // (8 * d))
    most = max(1, -(-n // max(-(-n // most), min(SPREAD, -(-n // 1024)))))
    left, now, chain = members > 0, int(members.argmax()), []
    while left.any():  # from each cell to the nearest one that is left
        chain.append(now)
        left[now] = False
        now = int(np.where(left, centroids @ centroids[now], -np.inf).argmax())
    first, parts, held, at, cells = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), 0, 0, []
    for c in chain:
        size = int(members[c])
        if held and held + size > most:
            at, held = at + 1, 0
        parts[c] = max(1, -(-size // most))
        first[c] = at
        cells += [(at + i, c) for i in range(int(parts[c]))]
        held += size
        if parts[c] > 1:
            at, held = at + int(parts[c]), 0
    block = np.array([b for b, _ in cells], dtype=np.int64)
    return Plan(centroids, low, high, first, parts, np.array([c for _, c in cells], dtype=np.int64), np.flatnonzero(np.diff(block, prepend=-1)))


def _dealt(cells: DataFrame, plans: dict[int, Plan], reach: float) -> DataFrame:
    """Each class once for every pair of blocks (i, j), one of them its own, in which it may have links."""
    shared = cells.sparkSession.sparkContext.broadcast(plans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                for d, rows in batch.slice(k, STEP).to_pandas().groupby("d"):
                    plan = shared.value[int(d)]
                    angles = _angles(_units(rows["unit"]), plan.centroids)
                    near = (angles <= plan.high + (reach + MARGIN)) & (angles >= plan.low - (reach + MARGIN))
                    near = np.logical_or.reduceat(near[:, plan.cells], plan.edges, axis=1)
                    cell = rows["cell"].to_numpy()
                    part = common.mix(rows["rep"].to_numpy().view(np.uint64)) % plan.parts[cell].astype(np.uint64)
                    own = plan.first[cell] + part.astype(np.int64)
                    near[np.arange(len(own)), own] = True
                    at, other = np.nonzero(near)
                    out = rows.iloc[at].assign(i=np.minimum(own[at], other).astype(np.int32), j=np.maximum(own[at], other).astype(np.int32), block=own[at].astype(np.int32))
                    yield pa.RecordBatch.from_pandas(out[["d", "i", "j", "block", "cell", "angle", "rep", "size", "unit"]], preserve_index=False)

    return cells.mapInArrow(common.lean(run), "d int, i int, j int, block int, cell int, angle double, rep long, size long, unit binary")


def _spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reached) that connect what the matrix ``links`` connects; one a node."""
    rows, columns = links.any(axis=1), links.any(axis=0)
    m, l, r = links[np.ix_(rows, columns)], left[rows], right[columns]
    if not m.size:
        return l, l
    far = np.iinfo(np.int64).max
    a, b = l.copy(), r.copy()
    while True:
        b2 = np.minimum(b, np.where(m, a[:, None], far).min(axis=0))
        a2 = np.minimum(a, np.where(m, b2[None, :], far).min(axis=1))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    node, low = np.concatenate([l, r]), np.concatenate([a, b])
    keep = node != low
    return node[keep], low[keep]


def _shortened(node: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same: each node with the smallest one that it reaches."""
    names, code = np.unique(np.concatenate([node, low]), return_inverse=True)
    u, v = code[: len(node)], code[len(node) :]
    label = np.arange(len(names))
    while True:
        a, b = label[u], label[v]
        new, least = label.copy(), np.minimum(a, b)
        for x in (u, v, a, b):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(names))
    return names[keep], names[label[keep]]


def _links(dealt: DataFrame, plans: dict[int, Plan], threshold: float, reach: float) -> DataFrame:
    """Rows (rep, other, n): n linked rows of other classes where ``other`` is null, else an edge.

    Two blocks meet in one task, cell by cell. By the triangle inequality a vector has links in a
    cell only if its angle to the centroid is within ``reach`` of the members' angles, and has all
    of them if the angle and the largest one of the members stay below ``reach`` together: that
    needs no products. Edges span the links found in a task, one for each class at most, so no
    group's pairs are listed.
    """
    shared = dealt.sparkSession.sparkContext.broadcast({d: plan.centroids for d, plan in plans.items()})

    def side(rows: pd.DataFrame) -> tuple:
        rows = rows.sort_values("cell", kind="stable")
        cells, starts = np.unique(rows["cell"].to_numpy(), return_index=True)
        edges = [*starts.tolist(), len(rows)]
        angle = rows["angle"].to_numpy()
        return cells, edges, np.minimum.reduceat(angle, starts), np.maximum.reduceat(angle, starts), _units(rows["unit"]), rows["rep"].to_numpy(), rows["size"].to_numpy()

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        a, b = rows[rows["block"] == i], rows[rows["block"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "other": [], "n": []}, dtype="int64")
        cells_a, edges_a, low_a, high_a, x, ra, sa = left = side(a)
        cells_b, edges_b, low_b, high_b, y, rb, sb = left if i == j else side(b)
        centroids = shared.value[int(rows["d"].iloc[0])]
        to_b, to_a = _angles(x, centroids[cells_b]), _angles(y, centroids[cells_a])
        far = reach + MARGIN
        seen_a, edges = np.zeros(len(ra), dtype=np.int64), []
        seen_b = seen_a if i == j else np.zeros(len(rb), dtype=np.int64)
        for p in range(len(cells_a)):
            of_a = slice(edges_a[p], edges_a[p + 1])
            for q in range(p if i == j else 0, len(cells_b)):
                of_b = slice(edges_b[q], edges_b[q + 1])
                own = i == j and p == q
                t, u = to_b[of_a, q], to_a[of_b, p]
                k = np.flatnonzero((t <= high_b[q] + far) & (t >= low_b[q] - far)) + of_a.start
                m = np.flatnonzero((u <= high_a[p] + far) & (u >= low_a[p] - far)) + of_b.start
                if not len(k) or not len(m):
                    continue
                if to_b[k, q].max() + high_b[q] <= reach - MARGIN:
                    # every one of k has all of the cell
                    seen_a[k] += sb[of_b].sum() - (sa[k] if own else 0)
                    if not own:
                        seen_b[of_b] += sa[k].sum()
                    node = np.concatenate([ra[k], rb[of_b]])
                    low = np.full(len(node), node.min())
                else:
                    links = x[k] @ y[m].T >= threshold
                    if own:
                        links &= ra[k][:, None] != rb[m][None, :]
                    if not links.any():
                        continue
                    seen_a[k] += links @ sb[m]
                    if not own:
                        seen_b[m] += links.T @ sa[k]
                    node, low = _spanning(links, ra[k], rb[m])
                edges.append((node[node != low], low[node != low]))
        node, low = _shortened(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])) if edges else (ra[:0], ra[:0])
        rep, n = (ra, seen_a) if i == j else (np.concatenate([ra, rb]), np.concatenate([seen_a, seen_b]))
        rep, n = rep[n > 0], n[n > 0]
        other = pd.array(np.concatenate([np.zeros(len(rep), dtype=np.int64), low]), dtype="Int64")
        other[: len(rep)] = pd.NA
        return pd.DataFrame({"rep": np.concatenate([rep, node]), "other": other, "n": np.concatenate([n, np.zeros(len(node), dtype=np.int64)])})

    return dealt.groupBy("d", "i", "j").applyInPandas(compare, "rep long, other long, n long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Two vectors link when their cosine in double precision is at least ``threshold``. n_links:
    other rows linked directly; component_id: the smallest vec_id reachable by links, itself
    included; kept: whether that is the row itself.

    Cases: null, empty and zero vectors and those with null or non-finite components link with
    nothing; vectors of different lengths do not link; equal vectors link, as often as they
    occur; repeated rows count as rows; a null vec_id has no component and is not kept, and
    links of it count; an empty table gives no rows; other columns are not read. All
    links are found; where vectors spread evenly in many dimensions no cell can be left out, and
    the products grow with the square of the rows.
    """
    narrow = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector_column].cast("array<double>").alias("vector"))
    rows = common.written(_classes(narrow), "vectors")
    # classes are numbered by their smallest id, or by a hash where all ids are null
    classes = rows.where("print is not null").groupBy("print").agg(F.count("*").alias("size"), F.min("id").alias("least"), F.first("d").alias("d"), F.first("unit").alias("unit"))
    classes = common.written(classes.withColumn("rep", F.coalesce("least", F.xxhash64("print"))), "classes")
    lengths = {r["d"]: r["count"] for r in classes.groupBy("d").count().collect()}
    centroids = {d: _fit(classes, n, d) for d, n in lengths.items()}
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0)))
    cells = common.written(_cells(classes, centroids), "cells")
    regions: dict[int, list] = {d: [] for d in lengths}
    for r in cells.groupBy("d", "cell").agg(F.count("*").alias("members"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # MOST_CELLS a length at most
        regions[r["d"]].append(r)
    plans = {d: _plan(centroids[d], regions[d]) for d in lengths}
    found = common.written(_links(_dealt(cells, plans, reach), plans, threshold, reach), "links")
    linked = found.where("other is null").groupBy("rep").agg(F.sum("n").alias("others"))
    edges = found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    parts = common.connected_components(edges).select(F.col("id").alias("rep"), F.col("component"))
    told = classes.join(linked, "rep", "left").join(parts, "rep", "left")
    told = told.select("print", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    full = rows.select("id", "print").join(told, "print", "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "id"))
    return full.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
