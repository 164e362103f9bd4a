"""Embedding near-duplicates by collision counting over one-dimensional projections.

Vectors of one label are sorted by a projection and cut into tiles. Tiles whose query-centred windows
on that projection overlap are compared: for every pair of vectors the windows of all projections in
which the two meet are counted, and pairs that pass a count calibrated for recall are verified by
their cosine in double precision. Counts and links stay inside the task that compares two tiles; it
hands on a sum for each vector and a spanning forest, so a group of copies never turns into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components


@dataclass(frozen=True)
class Scheme:
    """Projections and windows for a cosine bound.

    Two unit vectors at the bound differ by a vector of length ``reach``; on a normal direction they
    differ by a normal number of that deviation. ``width`` and ``outer`` are windows in deviations.
    """

    cosine: float = 0.98
    projections: int = 16
    width: float = 1.5
    outer: float = 4.0
    recall: float = 0.9998
    tile: int = 2048
    seed: int = 20240

    @property
    def reach(self) -> float:
        return math.sqrt(max(0.0, 2.0 - 2.0 * self.cosine))

    @property
    def collisions(self) -> int:
        """Most windows that a pair at the bound shares with at least the wanted probability."""
        p = math.erf(self.width / math.sqrt(2.0))
        m, missed = self.projections, 0.0
        for k in range(m):
            missed += math.comb(m, k) * p**k * (1 - p) ** (m - k)
            if missed > 1 - self.recall:
                return k
        return m

    def directions(self, dimension: int) -> np.ndarray:
        return np.random.default_rng([self.seed, dimension]).standard_normal((dimension, self.projections))


def _units(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / scale
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def near_pairs(a: np.ndarray, b: np.ndarray, scheme: Scheme, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i in a, j in b) of the verified pairs; of a tile with itself only i < j."""
    ua, ub = _units(a), _units(b)
    lines = scheme.directions(a.shape[1])
    pa_, pb = (np.ascontiguousarray((u @ lines).T.astype(np.float32)) for u in (ua, ub))
    window = np.float32(scheme.width * scheme.reach + 1e-5)
    least = scheme.collisions
    out_i, out_j = [], []
    for low in range(0, len(a), 128):
        high = min(low + 128, len(a))
        counts = np.zeros((high - low, len(b)), np.uint8)
        for k in range(scheme.projections):
            counts += np.abs(pa_[k, low:high, None] - pb[k][None, :]) <= window
        i, j = np.nonzero(counts >= least)
        i += low
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            ii, jj = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            met = np.einsum("nd,nd->n", ua[ii], ub[jj]) >= scheme.cosine
            out_i.append(ii[met])
            out_j.append(jj[met])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_i or none), np.concatenate(out_j or none)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node reachable over the pairs."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[i], low[j])
        if (least == low[i]).all() and (least == low[j]).all():
            return low
        np.minimum.at(low, low[i], least)
        np.minimum.at(low, low[j], least)
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]


def _tiles(scheme: Scheme):
    names = ["label", "dims", "part", "nth", "low", "high", "ids", "sizes", "vectors"]
    kinds = (
        pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(),
        pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(),
    )

    def cut_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held = TaskContext.get().partitionId(), 0, []
        key = None

        def full() -> pa.RecordBatch:
            place, ids, sizes, vectors = zip(*held, strict=True)
            row = (*key, part, nth, place[0], place[-1], ids, sizes, np.array(vectors, "<f8").tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names
            )

        for batch in parts:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[:2] != key or len(held) == scheme.tile):
                    yield full()
                    nth, held = nth + 1, []
                key = row[:2]
                held.append(row[2:])
        if held:
            yield full()

    return cut_up, ", ".join(
        f"{n} {k}" for n, k in zip(
            names, ("string", "int", "int", "int", "double", "double", "array<long>", "array<long>", "binary"), strict=True
        )
    )


def _compare(scheme: Scheme):
    def compared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in batch.to_pylist():
                same = row["same"]
                sides = [
                    (np.array(row[f"{s}_ids"]), np.array(row[f"{s}_sizes"]),
                     np.frombuffer(row[f"{s}_vectors"], "<f8").reshape(-1, row["dims"]))
                    for s in "ab"
                ]
                (ids, sizes, a), (ids_b, sizes_b, b) = sides
                i, j = near_pairs(a, b, scheme, same)
                if not len(i):
                    continue
                if same:
                    links = np.bincount(i, sizes[j], len(a)) + np.bincount(j, sizes[i], len(a))
                else:
                    links = np.concatenate([np.bincount(i, sizes_b[j], len(a)), np.bincount(j, sizes[i], len(b))])
                    ids, j = np.concatenate([ids, ids_b]), j + len(a)
                low = forest(len(ids), i, j)
                met = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[met]), pa.array(links[met].astype(np.int64)), pa.array(ids[low[met]])],
                    ["u", "links", "v"],
                )

    return compared


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scheme: Scheme = Scheme(),
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows are linked if their labels are equal and not null and their cosine is at least the bound.
    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of other
    lengths, link with nothing. Equal vectors are compared once and count as often as they occur;
    repeated ids count as vectors of their own. A null id is a row without links or component. Other
    columns are not read.
    """
    source = rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    unfit = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & ~unfit & F.exists("vector", lambda x: x != 0),
        F.lit(False),
    )
    classes = saved(
        source.where(usable).groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("size"))
    )
    tiles_of, tile_schema = _tiles(scheme)
    placed = classes.select("label", F.size("vector").alias("dims"), "id", "size", "vector").mapInArrow(
        _projected(scheme), "label string, dims int, place double, id long, size long, vector array<double>"
    )
    tiles = saved(
        placed.repartitionByRange("label", "dims", "place")
        .sortWithinPartitions("label", "dims", "place", "id")
        .mapInArrow(tiles_of, tile_schema)
    )
    a, b = (
        tiles.select("label", "dims", *[F.col(c).alias(f"{s}_{c}") for c in ("part", "nth", "low", "high")])
        for s in "ab"
    )
    order = (F.col("a_part") < F.col("b_part")) | ((F.col("a_part") == F.col("b_part")) & (F.col("a_nth") <= F.col("b_nth")))
    reach = scheme.outer * scheme.reach
    meetings = a.join(b, ["label", "dims"]).where(
        order & (F.col("b_low") - F.col("a_high") <= reach) & (F.col("a_low") - F.col("b_high") <= reach)
    ).select("dims", "a_part", "a_nth", "b_part", "b_nth")

    def held(s: str) -> DataFrame:
        return tiles.select(*[F.col(c).alias(f"{s}_{c}") for c in ("part", "nth", "ids", "sizes", "vectors")])

    work = (
        meetings.join(held("a"), ["a_part", "a_nth"])
        .join(held("b"), ["b_part", "b_nth"])
        .select(
            ((F.col("a_part") == F.col("b_part")) & (F.col("a_nth") == F.col("b_nth"))).alias("same"), "dims",
            *[f"{s}_{c}" for s in "ab" for c in ("ids", "sizes", "vectors")],
        )
    )
    found = saved(work.mapInArrow(_compare(scheme), "u long, links long, v long"))
    roots = components(found.select("u", "v"))
    rated = (
        classes.join(found.groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links")), "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "label", "vector", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "id").alias("component"),
        )
    )
    linked = source.where(usable).join(rated, ["label", "vector"]).select(
        "id", "n_links", F.col("component").alias("component_id")
    )
    alone = source.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _projected(scheme: Scheme):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            vectors = batch.column("vector")
            places = np.zeros(len(vectors))
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                block = np.array(vectors.take(pa.array(own)).to_pylist(), float).reshape(len(own), d)
                places[own] = _units(block) @ scheme.directions(int(d))[:, 0]
            columns = {name: batch.column(name) for name in ("label", "dims", "id", "size", "vector")}
            columns["place"] = pa.array(places)
            names = ["label", "dims", "place", "id", "size", "vector"]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return rows
