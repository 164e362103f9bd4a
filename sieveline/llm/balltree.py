"""Exact largest inner products by branch and bound in ball trees, one tree for each shard.

Rows are dealt to shards by their nearest of a few sampled pivots, so that a shard is a neighbourhood;
the sample decides speed only. A shard becomes a balanced tree of balls over whole-number vectors.
Queries search the tree of their own shard first, then travel in blocks: to the shards with the largest
bounds, and, with the k-th scores that all of these have found, to every shard whose ball may still
hold a better row. A task takes the shards of a block one after the other and carries the k-th scores on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .whitening import matrix_of, whole

_LOWEST = -(1 << 63)
_NO_ID = (1 << 63) - 1
_STEP = 1 << 20  # shards are numbered in steps, so that one cut in two keeps numbers of its own


@dataclass(frozen=True)
class Scheme:
    k: int = 5
    shard: int = 8192  # rows that a shard aims at; it is cut at twice as many
    leaf: int = 64
    pivots: int = 256
    block: int = 4096  # queries that travel together
    run: int = 16  # shards that one task searches in a row
    first: int = 4  # shards searched before scores are shared


@dataclass
class Tree:
    """A balanced ball tree over rows in leaf order; level l has 2^l nodes of neighbouring rows."""

    ids: np.ndarray
    x: np.ndarray
    centers: list[np.ndarray]
    radii: list[np.ndarray]
    least: list[np.ndarray]  # smallest id of each node

    @property
    def ends(self) -> np.ndarray:
        return cuts(len(self.ids), len(self.radii) - 1)


def cuts(n: int, level: int) -> np.ndarray:
    """Borders of the nodes of a level: every node is halved."""
    ends = np.array([0, n])
    for _ in range(level):
        middle = (ends[:-1] + ends[1:]) // 2
        ends = np.sort(np.concatenate([ends, middle]))
    return ends


def _balls(x: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = list(zip(ends[:-1], ends[1:], strict=True))
    centers = np.array([x[a:b].mean(axis=0) for a, b in parts]).reshape(len(parts), x.shape[1])
    radii = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(axis=1)).max() for (a, b), c in zip(parts, centers, strict=True)])
    return centers, radii, np.array([ids[a:b].min() for a, b in parts])


def grow(ids: np.ndarray, x: np.ndarray, leaf: int) -> Tree:
    """Halve the rows along the line between two far points until leaves are small enough."""
    levels = max(0, int(np.ceil(np.log2(max(len(ids), 1) / leaf))))
    f = x.astype(np.float64)
    order = np.argsort(ids, kind="stable")
    for level in range(levels):
        ends = cuts(len(ids), level)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            own = f[order[a:b]]
            far = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            order[a:b] = order[a:b][np.argsort(own @ (other - far), kind="stable")]
    ids, x, f = ids[order], x[order], f[order]
    nodes = [_balls(f, ids, cuts(len(ids), level)) for level in range(levels + 1)]
    return Tree(ids, x, *map(list, zip(*nodes, strict=True)))


class Tops:
    """The best rows of each query so far; ``fresh`` marks those that this task has found."""

    def __init__(self, scores: np.ndarray, ids: np.ndarray) -> None:
        self.scores, self.ids = scores, ids
        self.fresh = np.zeros(scores.shape, bool)

    @classmethod
    def empty(cls, n: int, k: int) -> Tops:
        return cls(np.full((n, k), _LOWEST), np.full((n, k), _NO_ID))

    def passes(self, q: np.ndarray, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether something of at most this score and at least this id may still enter the tops."""
        kth, last = self.scores[q, -1], self.ids[q, -1]
        return (bound > kth) | ((bound == kth) & (least < last))

    def enter(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        k = self.scores.shape[1]
        some, place = np.unique(q, return_inverse=True)
        group = np.concatenate([np.repeat(np.arange(len(some)), k), place])
        s = np.concatenate([self.scores[some].ravel(), scores])
        i = np.concatenate([self.ids[some].ravel(), ids])
        new = np.concatenate([self.fresh[some].ravel(), np.ones(len(q), bool)])
        order = np.lexsort((i, ~s, group))  # ~s falls as s grows and, unlike -s, never overflows
        rank = np.arange(len(order)) - np.searchsorted(group[order], group[order])
        order = order[rank < k]
        self.scores[some], self.ids[some], self.fresh[some] = (v[order].reshape(-1, k) for v in (s, i, new))


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; what exceeds a long counts as its limit."""
    reach = float(np.abs(q, dtype=float).max(initial=0)) * float(np.abs(x, dtype=float).max(initial=0)) * q.shape[1]
    if reach < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, 1 - _NO_ID, _NO_ID - 1).astype(np.int64)


def search(tree: Tree, q: np.ndarray, own: np.ndarray, tops: Tops, asked: np.ndarray) -> None:
    """Enter into ``tops`` what the tree holds for the queries ``asked`` (row numbers of ``q``).

    A query first falls to the leaf of the largest bounds; then nodes that cannot reach its k-th score
    are dropped level by level, and what is left of the leaves is scored in the order of the bounds.
    """
    f = q[asked].astype(np.float64)
    length = np.sqrt((f * f).sum(axis=1))
    bounds = []
    for centers, radii in zip(tree.centers, tree.radii, strict=True):
        far = length[:, None] * radii
        slack = 1e-9 * (length[:, None] * np.sqrt((centers * centers).sum(axis=1)) + far)
        bound = np.floor(f @ centers.T + far + slack)
        limit = np.maximum(np.clip(bound, -(2.0**63), 2.0**62).astype(np.int64), 1 - _NO_ID)
        limit[bound >= 2.0**62] = _NO_ID
        bounds.append(limit)
    ends = tree.ends

    def score(rows: np.ndarray, leaves: np.ndarray) -> None:
        hits: list[tuple[np.ndarray, ...]] = []
        order = np.argsort(leaves, kind="stable")
        rows, leaves = rows[order], leaves[order]
        for a, b in _runs(leaves):
            low, high = ends[leaves[a]], ends[leaves[a] + 1]
            who = asked[rows[a:b]]
            found = inner(q[who], tree.x[low:high])
            ids = tree.ids[low:high]
            each, col = np.nonzero(found >= tops.scores[who, -1][:, None])
            s, i, w = found[each, col], ids[col], who[each]
            better = tops.passes(w, s, i) & (i != own[w])
            hits.append((w[better], s[better], i[better]))
        if hits:
            tops.enter(*(np.concatenate(h) for h in zip(*hits, strict=True)))

    rows = np.arange(len(asked))
    node = np.zeros(len(asked), np.int64)
    for bound in bounds[1:]:
        left, right = bound[rows, 2 * node], bound[rows, 2 * node + 1]
        node = 2 * node + (right > left)
    score(rows, node)
    home = node
    at_row, at_node = rows, np.zeros(len(asked), np.int64)
    for level, (bound, least) in enumerate(zip(bounds, tree.least, strict=True)):
        if level:
            at_row, at_node = np.repeat(at_row, 2), np.stack([2 * at_node, 2 * at_node + 1], axis=1).ravel()
        alive = tops.passes(asked[at_row], bound[at_row, at_node], least[at_node])
        at_row, at_node = at_row[alive], at_node[alive]
    left = at_node != home[at_row]
    at_row, at_node = at_row[left], at_node[left]
    bound, least = bounds[-1][at_row, at_node], tree.least[-1][at_node]
    order = np.lexsort((least, ~bound, at_row))
    at_row, at_node, bound, least = at_row[order], at_node[order], bound[order], least[order]
    many = 1
    while len(at_row):
        alive = tops.passes(asked[at_row], bound, least)
        at_row, at_node, bound, least = at_row[alive], at_node[alive], bound[alive], least[alive]
        now = np.arange(len(at_row)) - np.searchsorted(at_row, at_row) < many
        score(at_row[now], at_node[now])
        at_row, at_node, bound, least = at_row[~now], at_node[~now], bound[~now], least[~now]
        many *= 2


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = [0, *(np.flatnonzero(np.diff(sorted_values)) + 1).tolist(), len(sorted_values)]
    if len(sorted_values):
        yield from zip(ends[:-1], ends[1:], strict=True)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest type that holds them."""
    top = int(np.abs(x, dtype=float).max(initial=0))
    kind = next((k for k, most in (("<i2", 1 << 15), ("<i4", 1 << 31)) if top < most), "<i8")
    return kind, x.astype(kind).tobytes()


def _unpacked(kind: str, raw: bytes, dims: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, dims).astype(np.int64)


_SHARDS = (
    "shard long, dims int, n long, center array<double>, radius double, ids binary, kind string, vectors binary, "
    "balls binary, radii binary, least binary, q_ids binary, q_kind string, q_vectors binary, q_scores binary, q_best binary, "
    "n_queries long"
)
_BLOCKS = (
    "block long, dims int, n long, center array<double>, radius double, floor long, homes binary, q_ids binary, "
    "q_kind string, q_vectors binary, q_scores binary, q_best binary"
)
_FOUND = "block long, q int, query_id long, score long, vec_id long"


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
        "array<double>": pa.list_(pa.float64()),
    }
    fields = [c.strip().split(" ") for c in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


def _build(scheme: Scheme):
    """Cut rows sorted by shard and length into trees, and let their own queries search them."""

    def made(shard: int, dims: int, nth: int, ids, x, asks) -> dict:
        tree = grow(ids, x, scheme.leaf)
        tops = Tops.empty(int(asks.sum()), scheme.k)
        q_ids, q = ids[asks], x[asks]
        if len(q_ids):
            search(tree, q, q_ids, tops, np.arange(len(q_ids)))
        kind, vectors = _packed(tree.x)
        q_kind, q_vectors = _packed(q)
        return {
            "shard": shard * _STEP + nth, "dims": dims, "n": len(ids), "center": tree.centers[0][0].tolist(),
            "radius": float(tree.radii[0][0]), "ids": tree.ids.tobytes(), "kind": kind, "vectors": vectors,
            "balls": np.concatenate(tree.centers).tobytes(), "radii": np.concatenate(tree.radii).tobytes(),
            "least": np.concatenate(tree.least).tobytes(), "q_ids": q_ids.tobytes(), "q_kind": q_kind,
            "q_vectors": q_vectors, "q_scores": tops.scores.tobytes(), "q_best": tops.ids.tobytes(), "n_queries": len(q_ids),
        }

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        key, nth, n = None, 0, 0
        for batch in parts:
            shards, dims = (batch.column(c).to_numpy() for c in ("shard", "dims"))
            for low, high in _pieces(shards, dims):
                own = (int(shards[low]), int(dims[low]))
                x = matrix_of(batch.column("x").slice(low, high - low), own[1])
                at = 0
                while at < len(x):
                    if held and (own != key or n >= 2 * scheme.shard):
                        yield _batch([made(*key, nth, *map(np.concatenate, zip(*held, strict=True)))], _SHARDS)
                        nth, n, held = nth + 1, 0, []
                    key = own
                    upto = min(len(x), at + 2 * scheme.shard - n)
                    piece = slice(low + at, low + upto)
                    held.append((
                        batch.column("id").to_numpy()[piece], x[at:upto],
                        batch.column("asks").to_numpy(zero_copy_only=False)[piece].astype(bool),
                    ))
                    n, at = n + upto - at, upto
        if held:
            yield _batch([made(*key, nth, *map(np.concatenate, zip(*held, strict=True)))], _SHARDS)

    return rows


def _pieces(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    n = len(columns[0])
    new = np.zeros(n, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    ends = [0, *np.flatnonzero(new).tolist(), n]
    if n:
        yield from zip(ends[:-1], ends[1:], strict=True)


def _queries_of(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, Tops]:
    ids = np.frombuffer(row["q_ids"], np.int64)
    q = _unpacked(row["q_kind"], row["q_vectors"], row["dims"], len(ids))
    tops = (np.frombuffer(row[c], np.int64).reshape(-1, k).copy() for c in ("q_scores", "q_best"))
    return ids, q, Tops(*tops)


def _gather(scheme: Scheme):
    """Queries of neighbouring shards as one block, at most ``scheme.block`` of them."""

    def block(number: int, held: list[tuple]) -> dict:
        dims = held[0][2].shape[1]
        homes, ids, q, scores, best = (np.concatenate(c) for c in zip(*held, strict=True))
        f = q.astype(np.float64)
        center = f.mean(axis=0)
        kind, vectors = _packed(q)
        return {
            "block": number, "dims": dims, "n": len(ids), "center": center.tolist(),
            "radius": float(np.sqrt(((f - center) ** 2).sum(axis=1)).max()), "floor": int(scores[:, -1].min()),
            "homes": homes.tobytes(), "q_ids": ids.tobytes(), "q_kind": kind, "q_vectors": vectors,
            "q_scores": scores.tobytes(), "q_best": best.tobytes(),
        }

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, nth, n = None, 0, 0
        for batch in parts:
            for row in batch.to_pylist():
                own = (row["team"], row["dims"])
                ids, q, tops = _queries_of(row, scheme.k)
                for low in range(0, len(ids), scheme.block):
                    piece = slice(low, low + scheme.block)
                    many = len(ids[piece])
                    if held and (own != key or n + many > scheme.block):
                        yield _batch([block(key[0] * _STEP + nth, held)], _BLOCKS)
                        nth, n, held = nth + 1, 0, []
                    key = own
                    held.append((np.full(many, row["shard"]), ids[piece], q[piece], tops.scores[piece], tops.ids[piece]))
                    n += many
        if held:
            yield _batch([block(key[0] * _STEP + nth, held)], _BLOCKS)

    return rows


def _visit(scheme: Scheme):
    """Search shards for blocks; rows of one block that follow each other share their k-th scores."""

    def told(block: int, ids: np.ndarray, tops: Tops) -> pa.RecordBatch:
        q, rank = np.nonzero(tops.fresh)
        columns = [np.full(len(q), block), q.astype(np.int32), ids[q], tops.scores[q, rank], tops.ids[q, rank]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.strip().split(" ")[0] for c in _FOUND.split(",")])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in parts:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if held is None or held[0] != row["block"]:
                    if held is not None:
                        yield told(held[0], held[2], held[4])
                    held = (row["block"], np.frombuffer(row["homes"], np.int64), *_queries_of(row, scheme.k))
                _, homes, ids, q, tops = held
                search(_tree_of(row), q, ids, tops, np.flatnonzero(homes != row["shard"]))
        if held is not None:
            yield told(held[0], held[2], held[4])

    return rows


def _tree_of(row: dict) -> Tree:
    ids = np.frombuffer(row["ids"], np.int64)
    radii, least = np.frombuffer(row["radii"]), np.frombuffer(row["least"], np.int64)
    balls = np.frombuffer(row["balls"]).reshape(len(radii), row["dims"])
    starts = [(1 << level) - 1 for level in range(len(radii).bit_length())]
    split = lambda v: [v[a : 2 * a + 1] for a in starts]
    return Tree(ids, _unpacked(row["kind"], row["vectors"], row["dims"], len(ids)), split(balls), split(radii), split(least))


def _renew(scheme: Scheme):
    """Blocks with what the first shards have yielded entered into their tops."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                _, _, tops = _queries_of(row, scheme.k)
                got = row.pop("got") or []
                tops.enter(*(np.array([g[c] for g in got], np.int64) for c in ("q", "score", "vec_id")))
                row |= {"floor": int(tops.scores[:, -1].min()), "q_scores": tops.scores.tobytes(), "q_best": tops.ids.tobytes()}
                yield _batch([row], _BLOCKS)

    return rows


def _dealt(source: DataFrame, scheme: Scheme) -> DataFrame:
    """A shard number for each row: the nearest pivot's, large neighbourhoods split by a hash of the id."""
    n = source.count()
    wanted = min(scheme.pivots, -(-n // scheme.shard))
    picked = source.orderBy(F.xxhash64("id"), "id", "x").limit(wanted).collect() if wanted > 1 else []
    pivots: dict[int, list] = {}
    for number, row in enumerate(picked):
        pivots.setdefault(len(row.x), []).append((number, row.x))

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            dims = batch.column("dims").to_numpy()
            cell = np.full(len(dims), -1, np.int32)
            for d, known in pivots.items():
                own = np.flatnonzero(dims == d)
                if len(own):
                    x = matrix_of(batch.column("x").take(pa.array(own)), d).astype(np.float64)
                    p = np.array([v for _, v in known], np.float64).reshape(len(known), d)
                    closest = (x @ p.T - (p * p).sum(axis=1) / 2).argmax(axis=1)
                    cell[own] = np.array([number for number, _ in known], np.int32)[closest]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    placed = source.withColumn("dims", F.size("x")).mapInArrow(
        nearest, "id long, x array<long>, asks boolean, dims int, cell int"
    )
    shard, total = F.lit(0), 0
    for cell, size in sorted(map(tuple, placed.groupBy("cell").count().collect())):  # a row for each pivot
        many = -(-size // scheme.shard)
        shard = F.when(F.col("cell") == cell, F.lit(total) + F.pmod(F.xxhash64("id"), F.lit(many))).otherwise(shard)
        total += many
    return placed.withColumn("shard", shard.cast("long"))


def _bound(a: str, b: str) -> Column:
    """Largest inner product that two balls allow, a little rounded up."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    ca, cb, ra, rb = (F.col(f"{s}_{c}") for c in ("center", "radius") for s in (a, b))
    la, lb = F.sqrt(dot(ca, ca)), F.sqrt(dot(cb, cb))
    bound = dot(ca, cb) + (la * rb + lb * ra + ra * rb + la * lb) * (1 + 1e-9) - la * lb
    return F.greatest(bound, F.lit(-float(1 << 63)))


def largest_products(
    rows: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", scheme: Scheme = Scheme()
) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row where ``asks`` holds: its ``scheme.k`` largest
    inner products with the rows of other ids, ties to the smaller id; fewer if there are fewer.

    Entries become floor(256 * entry). Rows with a null id, a null vector or an entry that is null, not
    finite or too large for a long take no part; vectors meet those of their own length only, empty ones
    with score 0. A repeated row is found as often as it occurs, and each query row has an answer of its
    own. Scores beyond a long count as its limit. An empty table gives no rows. Other columns are not read.
    """
    source = rows.select(
        F.col(id_col).cast("long").alias("id"),
        whole(F.col(vector_col).cast("array<double>")).alias("x"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
    ).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    shards = saved(
        _dealt(source, scheme)
        .repartition("shard")
        .sortWithinPartitions("shard", "dims", "id")
        .mapInArrow(_build(scheme), _SHARDS)
    )
    many, queries = shards.agg(F.count("*"), F.sum("n_queries")).first()
    team = max(1, round(scheme.block * many / max(queries or 0, 1)))
    blocks = saved(
        shards.where("n_queries > 0")
        .select(F.expr(f"shard div {_STEP * team}").alias("team"), "shard", "dims", *[f"q_{c}" for c in ("ids", "kind", "vectors", "scores", "best")])
        .repartition("team")
        .sortWithinPartitions("team", "dims", "shard")
        .mapInArrow(_gather(scheme), _BLOCKS)
    )
    runs = -(-many // scheme.run)

    def balls(df: DataFrame, key: str, *more: str) -> DataFrame:
        return df.select(key, "dims", *[F.col(c).alias(f"{key}_{c}") for c in ("center", "radius")], *more)

    sides = (
        balls(blocks, "block", "floor").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(max(runs, 1) - 1)))),
        balls(shards, "shard").withColumn("run", F.pmod(F.xxhash64("shard"), F.lit(max(runs, 1))).cast("int")),
    )
    order = Window.partitionBy("block").orderBy(F.desc("bound"), "shard")
    meetings = saved(
        sides[0]
        .join(sides[1], ["dims", "run"])
        .select("block", "run", "shard", "floor", _bound("block", "shard").alias("bound"))
        .where("bound >= floor")
        .select("block", "run", "shard", "bound", F.row_number().over(order).alias("place"))
    )

    def visited(chosen: DataFrame, asking: DataFrame) -> DataFrame:
        asked = asking.drop("dims", "n", "center", "radius", "floor")
        per_run = chosen.select("block", "run").distinct().join(asked, "block")
        trees = shards.select("shard", "dims", "ids", "kind", "vectors", "balls", "radii", "least")
        work = chosen.select("block", "run", "shard").join(trees, "shard").join(per_run, ["block", "run"])
        return saved(work.mapInArrow(_visit(scheme), _FOUND))

    near = visited(meetings.where(F.col("place") <= scheme.first), blocks)
    ranked = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= scheme.k)
    got = best.groupBy("block").agg(F.collect_list(F.struct("q", "score", "vec_id")).alias("got"))
    renewed = saved(blocks.join(got, "block", "left").mapInArrow(_renew(scheme), _BLOCKS))
    open_ = meetings.where(F.col("place") > scheme.first).join(renewed.select("block", "floor"), "block")
    far = visited(open_.where("bound >= floor"), renewed)
    held = renewed.mapInArrow(_held(scheme), _FOUND)
    return (
        held.union(far)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= scheme.k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _held(scheme: Scheme):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in batch.select(["block", "dims", "q_ids", "q_kind", "q_vectors", "q_scores", "q_best"]).to_pylist():
                ids, _, tops = _queries_of(row, scheme.k)
                q, rank = np.nonzero(tops.ids != _NO_ID)
                columns = [np.full(len(q), row["block"]), q.astype(np.int32), ids[q], tops.scores[q, rank], tops.ids[q, rank]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.strip().split(" ")[0] for c in _FOUND.split(",")])

    return rows

