"""Embedding near-dedup by an inverted multi-index: a codebook for each half of the vectors, their product as the grid.

A search visits the grid's cells in the order in which the multi-sequence algorithm gives them, by the sum of both
halves' excess distances, and stops where that sum passes the index's reach: the sum within which the target share of
neighbours at the threshold lies. Since all cells up to one sum are visited, tasks need not walk them one by one.
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

from .common import Scratch, cut, join_skewed
from .components import components

#: Vectors that codebooks and the reach of the search are fitted on, at most (those whose id hashes lowest).
FIT_ROWS = 20_000
#: Share of neighbours at the threshold whose cell a search must visit; nearer ones are met more surely.
TARGET_RECALL = 0.9995
#: Vectors a cell should hold, and vectors of the sample for each centroid of a half (2,500 at most, then cells grow).
PER_CELL, PER_CENTROID = 32, 8
#: Vectors of a band of the grid (neighbouring rows), and queries, that meet in one group of a task.
MEMBERS, QUERIES = 4096, 4096


@dataclass
class Index:
    """Two codebooks; how far from its own cell (in excess squared distance, both halves added) a search goes."""

    first: np.ndarray
    second: np.ndarray
    reach: float
    threshold: float

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def excess(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to all centroids, less the least of them."""
        return _same_excess(x[:, : self.half], self.first), _same_excess(x[:, self.half :], self.second)


def _excess(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)
    return d - d.min(axis=1, keepdims=True)


def _same_excess(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """_excess without a matrix product, whose last bits depend on how many vectors go through it at once."""
    d = (centroids * centroids).sum(1) - 2 * np.einsum("ij,kj->ik", np.ascontiguousarray(x), centroids, optimize=False)
    return d - d.min(axis=1, keepdims=True)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(10):
        own = _excess(x, c).argmin(axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def fit(x: np.ndarray, total: int, threshold: float, recall: float = TARGET_RECALL) -> Index:
    """x: unit vectors, a bounded sample of total. The reach is the excess that recall of the neighbours at the very
    threshold, drawn in random directions around the sample, stay within."""
    rng = np.random.default_rng(7)
    half = (x.shape[1] + 1) // 2
    k = int(min(max(1, np.ceil(np.sqrt(total / PER_CELL))), max(1, FIT_ROWS // PER_CENTROID), len(x)))
    index = Index(_codebook(x[:, :half], k, rng), _codebook(x[:, half:], k, rng), 0.0, threshold)
    at = rng.choice(len(x), min(len(x), 4000), replace=False)
    tot, base = [], x[at]
    own = index.excess(base)
    for _ in range(5):
        away = rng.normal(size=base.shape)
        away -= (away * base).sum(1, keepdims=True) * base
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        near = threshold * base + np.sqrt(max(0.0, 1 - threshold**2)) * away
        cell = [e.argmin(axis=1) for e in index.excess(near)]
        tot.append(sum(e[np.arange(len(at)), c] for e, c in zip(own, cell, strict=True)))
    index.reach = float(np.quantile(np.concatenate(tot), recall)) + 1e-12
    return index


def _far_scaled(x: np.ndarray) -> np.ndarray | None:
    """The unit vector of finite components whose squares over- or underflow; None for zeros."""
    n = np.abs(x).max()
    return x / n / np.linalg.norm(x / n) if n > 0 else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of doubles, with a digest of the vector as given; null for what can't be compared."""
    for batch in batches:
        column = batch.column("embedding")
        starts = column.offsets.to_numpy()
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
        values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
        keys, dims, units = [bytes(16)] * len(batch), [None] * len(batch), [None] * len(batch)
        for size in np.unique(sizes[sizes > 0]).tolist():  # vectors of one length together
            rows = np.flatnonzero(sizes == size)
            x = values[starts[rows][:, None] + np.arange(size)]
            finite = np.isfinite(x).all(axis=1)
            rows, x = rows[finite], x[finite]
            with np.errstate(all="ignore"):
                n = np.sqrt((x * x).sum(axis=1))
                unit = x / n[:, None]
            given, made, step = x.tobytes(), unit.tobytes(), 8 * size
            for k, row in enumerate(rows.tolist()):
                own = made[k * step : (k + 1) * step]
                if not 1e-150 < n[k] < np.inf:
                    if (far := _far_scaled(x[k])) is None:
                        continue
                    own = far.tobytes()
                keys[row], dims[row], units[row] = xxhash.xxh3_128_digest(given[k * step : (k + 1) * step]), size, own
        pair = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(dims, pa.int32()), pa.array(units, pa.binary())],
            names=["vec_id", "k1", "k2", "dim", "unit"],
        )


def _vectors(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def _cells(indexes: dict[int, Index]):
    """For each vector its own cell, and the rows of the grid that its search visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_dims = np.array(batch.column("dim").to_pylist())
            for dim in np.unique(all_dims):
                index, own = indexes[int(dim)], batch.filter(pa.array(all_dims == dim))
                for at in range(0, len(own), 1000):
                    part = own.slice(at, 1000)
                    first, second = index.excess(_vectors(part.column("unit").to_pylist(), int(dim)))
                    rows = [np.flatnonzero(x) for x in index.reach - first >= 0]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("vec_id", "n", "dim", "unit")), pa.array(first.argmin(axis=1), pa.int32()), pa.array(second.argmin(axis=1), pa.int32()), pa.array(rows, pa.list_(pa.int32()))],
                        names=["vec_id", "n", "dim", "unit", "c1", "c2", "rows"],
                    )

    return run


def _meet(indexes: dict[int, Index]):
    """Queries against the members of the cells they visit: links counted, and a spanning forest instead of all pairs.

    A pair that both searches meet is counted by either at its own end; one that only one search meets, at both ends.
    """

    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(queries):
            return pd.DataFrame({"vec_id": np.empty(0, np.int64), "links": np.empty(0, np.int64), "label": np.empty(0, np.int64)})
        dim = int(members["dim"].iloc[0])
        index = indexes[dim]
        m, q = _vectors(members["unit"], dim), _vectors(queries["unit"], dim)
        mid, msize, m1, m2 = (members[c].to_numpy() for c in ("vec_id", "n", "c1", "c2"))
        qid, qsize, q1, q2 = (queries[c].to_numpy() for c in ("vec_id", "n", "c1", "c2"))
        first, second = index.excess(q)
        left = index.reach - first
        order = np.lexsort((m2, m1))
        cuts = np.flatnonzero(np.r_[True, (np.diff(m1[order]) != 0) | (np.diff(m2[order]) != 0), True])
        a, b = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            cols = order[s:e]
            rows = np.flatnonzero(second[:, m2[cols[0]]] <= left[:, m1[cols[0]]])
            i, j = np.nonzero(q[rows] @ m[cols].T >= index.threshold)
            a.append(rows[i])
            b.append(cols[j])
        a, b = np.concatenate(a), np.concatenate(b)
        other = qid[a] != mid[b]
        a, b = a[other], b[other]
        met = np.unique(b)
        back1, back2 = index.excess(m[met])
        at = np.searchsorted(met, b)
        alone = ~(back2[at, q2[a]] <= index.reach - back1[at, q1[a]])  # the member's search doesn't visit the query's cell
        links = np.bincount(a, msize[b], len(q)).astype(np.int64)
        given = np.bincount(b[alone], qsize[a[alone]], len(m)).astype(np.int64)
        of_q, of_m = qid.copy(), mid.copy()
        while True:  # least label of each component of this block
            np.minimum.at(of_m, b, of_q[a])
            before = of_q.copy()
            np.minimum.at(of_q, a, of_m[b])
            if (before == of_q).all():
                break
        some = links > 0
        return pd.DataFrame({"vec_id": np.r_[qid[some], mid[met]], "links": np.r_[links[some], given[met]], "label": np.r_[of_q[some], of_m[met]]})

    return run


def _bands(counts: list[tuple[int, int]]) -> dict[int, int]:
    """Rows of a grid with their numbers of vectors to bands: neighbours share a band of some MEMBERS vectors."""
    out, band, held = {}, 0, 0
    for row, n in counts:
        if held and held + n > MEMBERS:
            band, held = band + 1, 0
        out[row] = band
        held += n
    return out


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept (vec_id = component_id).

    Equal vectors are one class with one representative; a class's links count all its copies. Cells whose excess
    distance stays within the index's reach are visited in both directions of a pair, and every vector there is
    verified by its cosine in double precision; a link counts at both ends, whichever search finds it. A query goes to
    a band of the grid's rows once; bands are dealt out in blocks, so one crowded cell is shared between tasks.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths don't link. Rows that repeat a vec_id are so many vectors in the counts, with one id. A null vec_id links
    with nothing, has a null component and is kept. Other columns are ignored.
    """
    with Scratch(vectors.sparkSession) as tables:
        return cut(_near_duplicate_vectors(vectors.select("vec_id", "embedding"), threshold, tables), "near-vectors")


def _near_duplicate_vectors(vectors: DataFrame, threshold: float, tables: Scratch) -> DataFrame:
    cut = tables.cut
    parsed = cut(vectors.mapInArrow(_parse, "vec_id long, k1 long, k2 long, dim int, unit binary"), "vectors")
    good = parsed.where("vec_id is not null and dim is not null")
    classes = cut(good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = good.join(classes.withColumnRenamed("rep", "vec_id"), ["vec_id", "k1", "k2"]).dropDuplicates(["vec_id", "k1", "k2"])
    reps = cut(reps.select("vec_id", "n", "dim", "unit"), "reps")
    indexes = {}
    for dim, total in [(r["dim"], r["n"]) for r in reps.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()]:
        sample = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vec_id", "unit").collect()
        x = _vectors([r["unit"] for r in sorted(sample, key=lambda r: (r["vec_id"], bytes(r["unit"])))], dim)
        indexes[dim] = fit(x, total, threshold)
    placed = cut(reps.mapInArrow(_cells(indexes), "vec_id long, n long, dim int, unit binary, c1 int, c2 int, rows array<int>"), "cells")
    # a number for each row of a grid, 2,500 at most for each length of vectors
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(placed.groupBy("dim", "c1").agg(F.count("*").alias("m")).collect()):
        counts.setdefault(r["dim"], []).append((r["c1"], r["m"]))
    bands = [(dim, row, band) for dim, rows in counts.items() for row, band in _bands(rows).items()]
    bands = F.broadcast(vectors.sparkSession.createDataFrame(bands, "dim int, row int, band int"))
    of_dim = F.broadcast(bands.groupBy("dim").agg(F.map_from_entries(F.collect_list(F.struct("row", "band"))).alias("band_of")))
    visits = placed.join(of_dim, "dim").withColumn("band", F.explode(F.array_distinct(F.filter(F.transform("rows", lambda r: F.col("band_of")[r]), lambda x: x.isNotNull())))).drop("band_of", "rows")
    own = placed.join(bands.withColumnRenamed("row", "c1"), ["dim", "c1"]).drop("rows")
    sizes = own.groupBy("dim", "band").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("ms")).join(visits.groupBy("dim", "band").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qs")), ["dim", "band"])
    blocks = F.broadcast(cut(sizes, "blocks"))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = own.join(blocks, ["dim", "band"]).withColumn("mb", deal("ms")).withColumn("qb", every("qs"))
    queries = visits.join(blocks, ["dim", "band"]).withColumn("qb", deal("qs")).withColumn("mb", every("ms"))
    key = ["dim", "band", "mb", "qb"]
    members, queries = (x.toDF(*x.columns) for x in (members, queries))  # attributes of their own
    met = members.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(_meet(indexes), "vec_id long, links long, label long")
    met = cut(met, "links")
    settled = components(met.where("vec_id <> label").select(F.col("vec_id").alias("a"), F.col("label").alias("b")).distinct(), keep=tables)
    counts = met.groupBy("vec_id").agg(F.sum("links").alias("links"))
    of_class = classes.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(settled.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = cut(of_class.select(F.struct("k1", "k2").alias("key"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "of_class")
    usable = F.col("vec_id").isNotNull() & F.col("dim").isNotNull()
    linked = join_skewed(parsed.where(usable).select("vec_id", F.struct("k1", "k2").alias("key")), of_class, "key").select("vec_id", "n_links", "component_id")
    alone = parsed.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
