import random

import pytest
from pyspark.sql import functions as F

from statuta.operators import scores as sc
from statuta.operators import selection as sel
from statuta.operators.diversify import mmr

S = "q string, c string, score double"


def frame(spark, rows):
    return spark.createDataFrame(rows, S)


def values(df, name="score"):
    return {r["c"]: r[name] for r in df.collect()}


def test_rrf_drops_repeats(spark):
    df = spark.createDataFrame([("q", 0, 0, "A"), ("q", 0, 1, "A"), ("q", 0, 2, "B")], "q string, r int, p int, c string")
    assert values(sc.fuse_rankings(df, "q", "r", "c", "p", 0), "rrf") == {"A": 1.0, "B": 0.5}
    with pytest.raises(ValueError):
        sc.fuse_rankings(df, "q", "r", "c", "p", -1)


def test_minmax_rules(spark):
    flat, wide = frame(spark, [("q", "a", 2.0), ("q", "b", 2.0)]), frame(spark, [("q", "a", 1.0), ("q", "b", 3.0), ("q", "c", None)])
    assert values(sc.minmax(flat, ["q"], "score")) == {"a": 1.0, "b": 1.0}
    assert values(sc.minmax(flat, ["q"], "score", 0.0)) == {"a": 0.0, "b": 0.0}
    assert values(sc.minmax(wide, ["q"], "score")) == {"a": 0.0, "b": 1.0, "c": None}
    assert values(sc.minmax_within(wide, ["q"], "score")) == {"a": pytest.approx(1 / 3), "b": 1.0, "c": 0.0}
    assert values(sc.minmax_within(frame(spark, [("q", "a", float("nan")), ("q", "b", float("inf"))]), ["q"], "score")) == {"a": 0.0, "b": 0.0}
    assert values(sc.minmax_within(frame(spark, [("q", "a", 2.0), ("q", "b", 4.0), ("q", "c", float("nan"))]), ["q"], "score"))["c"] == -1.0
    assert sc.minmax(flat.limit(0), ["q"], "score").count() == 0
    assert values(sc.local_factor(wide.where("score is not null"), ["q"], "score", "f"), "f") == {"a": 0.5, "b": 1.0}


def test_rank_scores(spark):
    assert values(sc.rank_scores(frame(spark, [("q", "a", 1.0), ("q", "b", 3.0), ("q", "c", None), ("r", "d", 5.0)]), ["q"], "score", "c", "n"), "n") == {"a": 0.5, "b": 1.0, "c": 0.0, "d": 1.0}


def test_combine(spark):
    p = {"t": (frame(spark, [("q", "a", 1.0)]), 0.4), "c": (frame(spark, [("q", "a", 0.5)]), 0.2), "x": (frame(spark, [("q", "b", 1.0)]), 0.4)}
    assert values(sc.combine_weighted(p, ["q", "c"])) == {"a": pytest.approx(0.5), "b": pytest.approx(0.4)}
    with pytest.raises(ValueError):
        sc.combine_weighted({"t": (p["t"][0], 0.0)}, ["q", "c"])


def test_ordered_union_and_ordinals(spark):
    a = spark.createDataFrame([("q", "x", 5), ("q", "y", 9)], "q string, c string, p int")
    b = spark.createDataFrame([("q", "z", 0), ("q", "x", 1)], "q string, c string, p int")
    assert [r["c"] for r in sc.ordered_union([a, b], ["q"], "c", "p").orderBy("rank").collect()] == ["x", "y", "z"]
    n = spark.range(0, 1000, 1, 7).selectExpr("id * 7 % 1009 AS k")
    assert all(r["ord"] == i for i, r in enumerate(sorted(sc.ordinals(n, "k").collect(), key=lambda r: r["k"]), 1))


def test_injection_and_fill(spark):
    rank = lambda rows: spark.createDataFrame([("q", c, i) for i, c in enumerate(rows, 1)], "q string, c string, rank int")
    pool = frame(spark, [("q", "a", 0.1), ("q", "b", 0.2), ("q", "c", 0.3), ("q", "d", 0.4)])
    assert {r["c"] for r in sel.new_first_n(rank("axbyz"), pool, ["q"], "c", "rank", 2).collect()} == {"x", "y"}
    assert values(sel.inject(rank("axbyz"), pool, ["q"], "c", "rank", 1))["x"] == 0.4
    filled = sel.fill_to_k(rank("ba"), rank("abcde"), ["q"], "c", "rank", 4).orderBy("rank").collect()
    assert [r["c"] for r in filled] == ["b", "a", "c", "d"]


def brute_cut(scores, threshold, top, lo, hi):
    kept = [i for i, s in enumerate(scores, 1) if s is not None and s >= threshold or i <= top][:hi]
    for i in range(1, len(scores) + 1):
        if len(kept) >= lo:
            break
        if i not in kept and len(kept) < hi:
            kept.append(i)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_dynamic_cut_against_brute_force(spark, seed):
    r = random.Random(seed)
    scores = [r.choice([None, r.random()]) for _ in range(r.randint(0, 15))]
    args = (0.5, r.randint(0, 3), r.randint(0, 6), r.randint(6, 9))
    df = spark.createDataFrame([("q", i, s) for i, s in enumerate(scores, 1)], "q string, rank int, score double")
    out = [x["rank"] for x in sel.dynamic_cut(df, ["q"], "rank", "score", args[0], args[1], args[2], args[3]).orderBy("final_rank").collect()]
    assert out == brute_cut(scores, *args)


@pytest.mark.parametrize("seed", range(3))
def test_frozen_places(spark, seed):
    r = random.Random(seed)
    rows = [("q", i, r.random(), r.random() < 0.6) for i in range(1, 12)]
    df = spark.createDataFrame(rows, "q string, rank int, score double, free boolean")
    out = {x["rank"]: x["final_rank"] for x in sel.permute_free(df, ["q"], "rank", "score", F.col("free")).collect()}
    assert sorted(out.values()) == list(range(1, 12)) and all(out[i] == i for _, i, _, f in rows if not f)
    moved = [i for _, i, s, f in sorted(rows, key=lambda x: -x[2]) if f]
    assert [out[i] for i in moved] == sorted(i for _, i, _, f in rows if f)


def test_first_parent_takes(spark):
    pool = frame(spark, [("q", "a", 1.0), ("q", "b", 0.5)])
    links = spark.createDataFrame([("a", "b", 1), ("a", "x", 2), ("a", "y", 3), ("a", "z", 4), ("b", "y", 1), ("b", "z", 2)], "src string, dst string, place int")
    assert values(sel.expand_first_parent(pool, ["q"], "c", "score", links, 0.1, 2, 5)) == {"a": 1.0, "b": 0.5, "x": pytest.approx(0.1), "y": pytest.approx(0.1), "z": pytest.approx(0.05)}


def test_batches(spark):
    out = sel.batches(spark.createDataFrame([("q", i) for i in range(1, 7)], "q string, rank int"), ["q"], "rank").orderBy("rank").collect()
    assert [(r["batch_id"], r["label"]) for r in out] == [(0, "A"), (0, "B"), (0, "C"), (0, "D"), (1, "A"), (1, "B")]


def test_mmr_against_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(3)
    m, rel = r.normal(size=(12, 4)), r.random(12).round(2)
    df = spark.createDataFrame([("q", f"c{i:02}", float(rel[i]), m[i].tolist()) for i in range(12)], "q string, c string, score double, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    left, chosen = sorted(range(12), key=lambda i: (-rel[i], i)), []
    chosen.append(left.pop(0))
    while len(chosen) < 5:
        best = max(left, key=lambda i: 0.7 * rel[i] - 0.3 * max(u[i] @ u[j] for j in chosen))
        chosen.append(best)
        left.remove(best)
    assert [x["c"] for x in mmr(df, "q", "c", "score", "v", 5, 0.7).orderBy("pick").collect()] == [f"c{i:02}" for i in chosen]
