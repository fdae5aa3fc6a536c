"""Dense search and its fusion without copies of either side."""

import numpy as np
import pytest

from statuta.operators import dense
from statuta.operators.dense import dense_rrf_top, dense_top_k


def _shuffled(spark) -> int:
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_more_blocks_shuffle_no_more(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 10)
    monkeypatch.setattr(dense, "CORPUS_BLOCK", 10)
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(f"x{i:03}", r.normal(size=64).tolist()) for i in range(400)], "id string, v array<float>")
    before = _shuffled(spark)
    assert dense_top_k(rows, "id", "v", rows, "id", "v", 1).where("rank = 1").count() == 400
    assert _shuffled(spark) - before < 400_000  # 800 vectors are 0.2 MB


@pytest.mark.parametrize("most", [None, 3])
def test_fused_ranking_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    monkeypatch.setattr(dense, "CORPUS_BLOCK", 7)
    r = np.random.default_rng(2)
    v, c = r.integers(-2, 3, (40, 3)) + 0.5, r.integers(-2, 3, (60, 3)) + 0.5  # many ties
    names = [f"c{i % 45:02}" for i in range(50)] + ["c07"] * 10  # one item over more than a block
    asked = [(f"q{min(i, 25) // 5}", f"s{i - (i == 3)}", x) for i, x in enumerate(v)]  # q5 over several blocks, a repeated sub-query
    qs = spark.createDataFrame([(q, s, x.tolist()) for q, s, x in asked] + [(None, "s", [1.0] * 3), ("q9", None, [1.0] * 3)], "q string, s string, v array<double>")
    cs = spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, c)], "c string, v array<double>")
    got = {}
    for x in dense_rrf_top(qs, "q", "s", "v", cs, "c", "v", 6, most=most, dim=3).collect():
        got.setdefault(x["q"], {})[x["rank"]] = (x["c"], x["rrf"], x["best"])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cos, subs, want = np.round(unit(v) @ unit(c).T, 6), {}, {}
    for (q, s, _), near in zip(asked, cos):
        best = subs.setdefault((q, s), {})
        for n, x in zip(names, near):
            best[n] = max(best.get(n, -2), x)
    for (q, _), best in subs.items():
        for place, (n, x) in enumerate(sorted(best.items(), key=lambda kv: (kv[1], kv[0]), reverse=True)[:6], 1):
            rrf, most_near = want.setdefault(q, {}).get(n, (0, -2))
            want[q][n] = rrf + 1 / (60 + place), max(most_near, x)
    for q, items in want.items():
        order = sorted(((round(a, 9), b, n) for n, (a, b) in items.items()), reverse=True)[:most]
        assert [got[q][i + 1] for i in range(len(got[q]))] == [(n, pytest.approx(a, abs=1e-12), b) for a, b, n in order]
    assert set(got) == set(want)
