import random

import numpy as np
import pytest

from statuta.llm.topn import top_n
from statuta.llm.vectors import Index, nearest, pairs


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), s), s)
    out = {}
    for (g, i), s in sorted(best.items(), key=lambda kv: (kv[1], kv[0][1]), reverse=True):
        if sum(k[0] == g for k in out) < n:
            out[g, i] = sum(k[0] == g for k in out) + 1
    return out


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("seed", range(2))
def test_top_n_against_brute_force(spark, parts, seed):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.5 else f"g{r.randint(0, 9)}", f"i{r.randint(0, 80):02}", r.choice([0.1, 0.5, r.random()])) for _ in range(600)]
    rows += [(None, "i", 1.0), ("g1", None, 1.0), ("g1", "x", None), ("g1", "y", float("nan")), *rows[:50]]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, i string, s double").selectExpr("*", "1 AS position", "'x' AS pid")
        out = {(x["g"], x["i"]): x["position"] for x in top_n(df, "g", "i", "s", 5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out == brute(rows, 5)


def test_top_n_of_nothing_and_long_names(spark):
    df = spark.createDataFrame([("g" * 100_000, "i", 1.0), ("", "", -1.0)], "g string, i string, s double")
    assert top_n(df.limit(0), "g", "i", "s", 3).count() == 0
    assert top_n(df, "g", "i", "s", 3).count() == 2


def truth(ids, m, k, least):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = set()
    for a in range(len(ids)):
        near = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a and s[a, b] >= least)
        out |= {(min(ids[a], j), max(ids[a], j)) for _, j in near[:k]}
    return out


def clustered(seed, n):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 8, 16))
    m = centres[r.integers(0, len(centres), n)] + 0.12 * r.normal(size=(n, 16))
    m[5] = m[6] = m[7]
    return list(range(1, n + 1)), m.astype(np.float32).astype(np.float64)


def test_neighbours_recall(spark):
    ids, m = clustered(1, 400)
    rows = [(i, x.tolist()) for i, x in zip(ids, m)] + [(9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0]), (9004, None), (9005, [None] * 16), (9006, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<float>").selectExpr("*", "'x' AS other", "1 AS rep")
    want = truth(ids, m, 5, 0.9)
    for index in (Index(group=20, candidates=12), Index(candidates=None)):  # blocks and few candidates; exact
        got = {tuple(r) for r in pairs(nearest(df, "id", "v", 5, 0.9, 16, index)).collect()}
        assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    with pytest.raises(ValueError):
        Index(postings=9)


@pytest.mark.parametrize("size", [65_536, 150])
def test_dense_group_of_a_third_of_the_rows(spark, size):
    ids, m = clustered(2, 2_000)
    r = np.random.default_rng(3)
    group = (r.normal(size=16) * 4 + r.normal(size=(1_000, 16))).astype(np.float32).astype(np.float64)
    ids, m = [*ids, *range(5_001, 6_001)], np.vstack([m, group])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, m)], "id long, v array<float>")
    got = {tuple(r) for r in pairs(nearest(df, "id", "v", 5, 0.9, 16, Index(group=size))).collect()}
    want = truth(ids, m, 5, 0.9)
    dense = {p for p in want if p[0] > 5_000}
    assert len(dense) > 2_000 and len(got & dense) >= 0.99 * len(dense)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(got)


def test_copies_are_exact(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(1, 31)] + [(100, [1.0, 0.0, 0.5001]), (200, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {tuple(r) for r in pairs(nearest(df, "id", "v", 5, 0.9, 3)).collect()}
    assert got == truth([i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float32).astype(float), 5, 0.9)


def test_few_or_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<float>")
    assert nearest(df, "id", "v", dim=2).count() == 0 and nearest(df.limit(0), "id", "v", dim=2).count() == 0
