"""Links and components of embeddings against all pairs compared one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from proofcast.llm import embedding_dedup as E

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        # names that the operator uses itself
        T.StructField("key", T.LongType()),
        T.StructField("ball", T.StringType()),
        T.StructField("unit", T.LongType()),
        T.StructField("n_links", T.LongType()),
    ]
)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "b", 2, 3) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, least=0.95):
    vectors = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float32).astype(float) if ok else None
        vectors.append(x / np.linalg.norm(x) if ok and np.linalg.norm(x) else None)
    n = len(rows)
    linked = [[j for j in range(n) if j != i and vectors[i] is not None and vectors[j] is not None and len(vectors[i]) == len(vectors[j]) and vectors[i] @ vectors[j] >= least] for i in range(n)]
    root = list(range(n))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in linked[i]:
            root[max(up(i), up(j))] = min(up(i), up(j))
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[up(i)] = min(names.get(up(i), d), d)
    return [(d, len(linked[i]), names.get(up(i)), d == names.get(up(i))) for i, (d, _) in enumerate(rows)]


def turned(rng, v, cosine):
    """A vector at this cosine from v."""
    side = rng.normal(size=len(v))
    side -= side @ v * v
    return cosine * v + math.sqrt(1 - cosine * cosine) * side / np.linalg.norm(side)


def made(seed, n, dim=24):
    rng = np.random.default_rng(seed)
    alone = rng.normal(size=(n, dim))
    rows = [v / np.linalg.norm(v) for v in alone]
    for size, cosine in ((60, 0.995), (40, 0.98), (30, 0.97)):  # groups of near copies, tight and loose
        centre = rows[rng.integers(n)]
        rows += [turned(rng, centre, cosine) for _ in range(size)]
    chain = rows[0]
    for _ in range(12):  # each links to the next only
        chain = turned(rng, chain, 0.955)
        rows.append(chain)
    for _ in range(40):  # both sides of the border
        rows.append(turned(rng, rows[rng.integers(n)], rng.uniform(0.94, 0.96)))
    rows += [rows[5]] * 9 + [3.5 * rows[6]]
    order = rng.permutation(len(rows))
    return [(int(i), rows[j].tolist()) for i, j in enumerate(order)]


@pytest.mark.parametrize("shard", [512, 40])
def test_links_and_components(spark, monkeypatch, shard):
    monkeypatch.setattr(E, "SHARD", shard)
    rows = made(3, 500)
    got = sorted(map(tuple, E.embedding_classes(frame(spark, rows)).collect()))
    want = sorted(brute(rows))
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert [g[0] for g in got] == [w[0] for w in want] and there > 5000
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert found >= 0.99 * there
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.98 * len(want)


def test_small_blocks_count_the_same(spark, monkeypatch):
    rows = made(4, 150)
    monkeypatch.setattr(E, "BLOCK", 16)
    monkeypatch.setattr(E, "LARGEST", 64)
    monkeypatch.setattr(E, "VISITS", 50)
    got = sorted(map(tuple, E.embedding_classes(frame(spark, rows), probes=64).collect()))
    assert got == sorted(brute(rows))


def test_odd_rows(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, float("inf")]),
        (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None), (10, [1.0]), (11, [1.0, 0.0, 0.0]),
        (12, [0.0, 1e-38]), (13, [0.0, 3e38]), (14, [-1.0, 0.0]),
    ]
    got = sorted(map(tuple, E.embedding_classes(frame(spark, rows)).collect()), key=str)
    want = sorted(((d, n, c if c is not None else d, d == c) for d, n, c, _ in brute(rows)), key=str)
    want = [(d, n, c, d == c) for d, n, c, _ in want]
    assert got == want


def test_empty_table(spark):
    assert E.embedding_classes(frame(spark, [])).count() == 0
    assert [tuple(r) for r in E.embedding_classes(frame(spark, [(4, None)])).collect()] == [(4, 0, 4, True)]


def test_every_point_is_reached_and_pruned():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 8))
    points[:150] = points[0] + 0.05 * points[:150]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    start, near = E.flat_graph(points)
    seen, todo = {start}, [start]
    while todo:
        for j in near[todo.pop()]:
            if j not in seen:
                seen.add(j)
                todo.append(j)
    assert len(seen) == 300
    dist = np.sqrt(np.maximum(0, 2 - 2 * points @ points.T))
    for p, row in enumerate(E.robust_prune(dist)):
        taken = [j for j in row if j >= 0]
        assert taken == sorted(taken, key=lambda j: (dist[p, j], j))
        for a in range(len(taken)):
            for b in range(a):
                assert E.ALPHA * dist[taken[b], taken[a]] > dist[p, taken[a]]
