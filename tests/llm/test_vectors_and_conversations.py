import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import balltree, prefixtrie, whitening

from .helpers import CLASHING

NAN, INF = float("nan"), float("inf")
MOST = (1 << 63) - 2
ODD = [
    (900, None, 1), (901, [], 1), (902, [0.1, None, 0.2], 1), (903, [0.1, NAN, 0.2], 1), (904, [INF, 0.0, 0.0], 1),
    (905, [1e30, 0.0, 0.0], 1), (950, [0.5, -0.25], 2), (951, [0.5, 0.25], 2), (None, [0.1, 0.2, 0.3], 1), (1000, [], 1),
]


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.selectExpr("*", *[f"'x' as {n}" for n in CLASHING if n not in ("vec_id", "label", "vector")], "1 as x", "2 as asks", "3 as shard")


def cloud(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dims))
    rows = [(k, (centers[rng.integers(5)] + 0.2 * rng.normal(size=dims)).astype(np.float32).tolist(), 0) for k in range(n)]
    return rows + [(10_000 + k, rows[1][1], 0) for k in range(copies)]


def usable(rows, with_id):
    for i, v, _ in rows:
        if v is not None and all(c is not None and abs(c) * 256 < 2.0**63 for c in v) and (i is not None or not with_id):
            yield i, [math.floor(256.0 * float(np.float32(c))) for c in v]


def best(rows, k):
    known = list(usable(rows, True))
    out = []
    for i, q in known:
        if i % 50 == 0:
            score = lambda x: max(-MOST, min(MOST, sum(a * b for a, b in zip(q, x, strict=True))))  # noqa: B023, E731
            found = sorted((-score(x), j) for j, x in known if j != i and len(x) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize(
    "rows, scheme",
    [
        (cloud(700, 3, 1) + ODD, balltree.Scheme(shard=40, leaf=4, block=3, run=2, first=1)),
        (cloud(300, 6, 2, copies=200) + ODD, balltree.Scheme(shard=64, leaf=8, pivots=3, block=4)),
        (cloud(200, 2, 3) * 2 + ODD, balltree.Scheme(shard=30, leaf=2, run=1, first=2)),
        (cloud(60, 4, 4) + [(5000, [2e16, 0.0, 1.0, -2e16], 0), (5001, [2e16, 1.0, 0.0, 1.0], 0), (5050, [-3.0, 2.0, 0.0, 9e15], 0)], balltree.Scheme(shard=20, leaf=4)),
        (cloud(3, 4, 5), balltree.Scheme()),
        (ODD, balltree.Scheme()),
    ],
)
def test_largest_products(spark, rows, scheme):
    got = balltree.largest_products(vectors(spark, rows), F.col("vec_id") % 50 == 0, scheme=scheme)
    assert sorted(map(tuple, got.collect())) == best(rows, scheme.k)


def test_products_of_empty_tables_and_without_queries(spark):
    none = vectors(spark, [])
    assert balltree.largest_products(none, F.col("vec_id") % 50 == 0).count() == 0
    rows = vectors(spark, cloud(80, 3, 6))
    assert balltree.largest_products(rows, F.col("vec_id") < 0).count() == 0
    assert balltree.largest_products(rows, F.lit(None).cast("boolean")).count() == 0


def test_a_tree_drops_what_cannot_enter():
    rng = np.random.default_rng(7)
    x = rng.integers(-99, 99, (1000, 8)) + 2000 * np.eye(8, dtype=int)[rng.integers(0, 8, 1000)]
    tree = balltree.grow(np.arange(1000), x, 16)
    assert [len(r) for r in tree.radii] == [1, 2, 4, 8, 16, 32, 64]
    q = x[:20]
    tops = balltree.Tops.empty(20, 5)
    seen = []
    inner = balltree.inner
    balltree.inner = lambda a, b: seen.append(len(a) * len(b)) or inner(a, b)
    try:
        balltree.search(tree, q, np.arange(20), tops, np.arange(20))
    finally:
        balltree.inner = inner
    assert sum(seen) < 0.4 * 20 * 1000
    scores = q @ x.T
    scores[np.arange(20), np.arange(20)] = -(10**9)
    assert (tops.scores == -np.sort(-scores, axis=1)[:, :5]).all()


def whitened(rows, shown=4):
    known = list(usable(rows, False))
    sizes = defaultdict(int)
    for _, x in known:
        sizes[len(x)] += 1
    dims = max(sizes, key=lambda d: (sizes[d], d))
    known = [(i, x) for i, x in known if len(x) == dims]
    fit = np.array(sorted(set(tuple(x) for _, x in known)), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    far = [sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for _, x in known]
    project = np.array([[float(n * a - b) / n for a, b in zip(x, s, strict=True)] for _, x in known]) @ axes[:, :shown]
    return known, n, far, project / np.sqrt(np.maximum(values[:shown], 1e-300)), values[:shown] / values.sum()


@pytest.mark.parametrize("rows", [cloud(400, 6, 11) + ODD, cloud(150, 3, 12, copies=50) * 2 + ODD, cloud(90, 2, 13)])
def test_whitening(spark, rows):
    got = whitening.whiten(vectors(spark, rows)).collect()
    known, n, far, wanted, share = whitened(rows)
    shown = wanted.shape[1]
    assert len(got) == len(known) * shown
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-12
    for c in range(shown):
        own = sorted((r.vec_id is not None, r.vec_id or 0, r.deviation, r.whitened) for r in got if r.component == c + 1)
        true = sorted((i is not None, i or 0, far[k], wanted[k, c]) for k, (i, _) in enumerate(known))
        assert [o[:3] for o in own] == [t[:3] for t in true]
        signs = np.sign([o[3] * t[3] for o, t in zip(own, true, strict=True) if abs(t[3]) > 1e-6])
        assert (signs == signs[0]).all()
        assert np.allclose([o[3] for o in own], [signs[0] * t[3] for t in true], atol=1e-9)
        assert all(abs(r.explained / share[c] - 1) < 1e-10 for r in got if r.component == c + 1)


def test_whitening_without_variance_and_wide_numbers(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, 0), (2, [], 0)])).count() == 0
    same = whitening.whiten(vectors(spark, [(k, [0.5, 0.25], 0) for k in range(9)])).collect()
    assert len(same) == 18 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, None)}
    line = whitening.whiten(vectors(spark, [(k, [k / 2, k / 4, 1.0], 0) for k in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line)
    wide = [(k, [3e16 * (k % 7 - 3), 1e16 * (k % 3), float(k)], 0) for k in range(40)]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(vectors(spark, wide)).collect()}
    known, n, far, wanted, _ = whitened(wide)
    for k, (i, _) in enumerate(known):
        assert got[i, 1].deviation == (far[k] if far[k] < 1 << 63 else None)
        assert abs(abs(got[i, 1].whitened) - abs(wanted[k, 0])) < 1e-9


@pytest.mark.parametrize(
    "values",
    [np.arange(40, 0, -1.0), 10.0 ** -np.arange(40), np.r_[np.full(20, 5.0), 5 + 1e-12, np.full(19, 1.0)], np.r_[1, 1 + 1e-10, 1 - 1e-10, np.zeros(37)], np.ones(40)],
)
def test_eigenvectors_of_clustered_eigenvalues(values):
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((40, 40)))[0].astype(np.longdouble)
    for _ in range(6):
        turn = turn @ (1.5 * np.eye(40) - 0.5 * (turn.T @ turn))
    a = (turn * values.astype(np.longdouble)) @ turn.T
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-16 * values.max()
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-16
    assert np.abs(a @ x - x * found).max() < 1e-16 * values.max()


def test_limbs_hold_any_whole_number():
    for kind in (object, np.int64):
        values = np.array([0, 1, -1, 2**62, -(2**62), 12345678901], kind)
        assert whitening.from_limbs(whitening.to_limbs(values)).tolist() == values.tolist()
    wide = np.array([3**90, -(3**90)], object)
    assert whitening.from_limbs(whitening.to_limbs(wide) * 7).tolist() == (7 * wide).tolist()


def trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [turn[2:] for turn in sorted(own)] for c, own in convs.items()}
    nodes = defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append((c, len(path) == d))
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] += not kids[p]
        if p:
            saved[p] += (len(nodes[p]) - 1) * len(p[-1][1].encode())
            kids[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(
        (min(m)[0], len(p), min(nodes[p[:-1]])[0] if p else -1, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c, e in sorted(m) if e).encode()).hexdigest())
        for p, m in nodes.items()
    )


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return df.selectExpr("*", *[f"'x' as {n}" for n in CLASHING], "1 as conv", "2 as a", "3 as b", "4 as depth", "5 as bytes", "6 as part")


def talks(seed, n, texts, longest):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice(("user", "assistant", None)), rng.choice(texts))
        for c in range(n) for t in range(rng.randrange(longest))
    ]


@pytest.mark.parametrize(
    "rows",
    [
        talks(1, 60, ["a", "bb", None], 6),
        talks(2, 40, ["é日", "x y"], 12) + [(None, 1, "user", "a"), (-7, None, "user", "a"), (-7, 1, None, None), (-5, 3, "user", "b")],
        [(c, t, "user", "same" * (t + 1)) for c in range(30) for t in range(7)],
        [(1, t, "user", str(t % 3)) for t in range(700)] + [(0, t, "user", "z") for t in range(4)] + talks(3, 9, ["q"], 400),
        [(3, 1, "user", "a"), (3, 1, "user", "a"), (3, None, "b", "x"), (3, 1, "assistant", "c"), (8, 2, "", "")],
        [],
    ],
)
def test_prefix_trie(spark, rows):
    got = prefixtrie.prefix_trie(conversations(spark, rows)).fillna(-1, ["parent_conv_id"])
    assert sorted(map(tuple, got.collect())) == trie(rows)


@pytest.mark.parametrize("shape", ["chain", "star", "caterpillar", "random", "forest", "binary"])
def test_contraction_of_any_tree(spark, shape):
    n, rng = 600, random.Random(5)
    above = {
        "chain": lambda k: k - 1, "star": lambda k: 0, "caterpillar": lambda k: k - 2 if k % 2 == 0 else k - 1,
        "random": lambda k: rng.randrange(k), "forest": lambda k: None if k % 50 == 0 else k - 1, "binary": lambda k: (k - 1) // 2,
    }[shape]
    rows = [(0, None, 5)] + [(k, above(k), k % 11) for k in range(1, n)]
    totals = {k: [1, w] for k, _, w in rows}
    for k, p, _ in rows:
        if p is not None:
            totals[p][0] = 0
    for k, p, _ in reversed(rows):
        if p is not None:
            totals[p] = [x + y for x, y in zip(totals[p], totals[k], strict=True)]
    got = prefixtrie.subtree_sums(spark.createDataFrame(rows, "id long, parent long, weight long"))
    assert sorted(map(tuple, got.collect())) == sorted((k, *v) for k, v in totals.items())
