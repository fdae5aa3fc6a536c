import itertools
import math
import random

import pytest

from statuta.operators import cooccurrence as co
from statuta.operators import graph as g
from statuta.operators import lexical as lx
from statuta.operators.dense import dense_rrf, dense_top_k, score_in_batches
from statuta.plans import catalog


def test_directions(spark):
    e = spark.createDataFrame([("A", "B"), ("C", "A"), ("A", "A")], "src string, dst string")
    e = g.edges(e, "src", "dst")
    seeds = spark.createDataFrame([("q", "A")], "q string, c string")
    hop = lambda m: {r["c"] for r in g.expand(seeds, ["q"], "c", e, m).collect()}
    assert hop("both") == {"B", "C"} and hop("incoming") == {"C"} and hop("outgoing") == {"B"}
    with pytest.raises(ValueError):
        hop("sideways")


def test_edges_stay_in_corpus(spark):
    refs = spark.createDataFrame([("A", "B"), ("A", "X"), ("A", "B"), ("Y", "A"), (None, "A")], "s string, d string")
    corpus = spark.createDataFrame([("A",), ("B",), (None,)], "citation string")
    assert [tuple(r) for r in g.edges(refs, "s", "d", corpus).collect()] == [("A", "B")]


def test_two_hops_and_families(spark):
    refs = spark.createDataFrame([("d1", "a"), ("d1", "a"), ("d1", "b"), ("d2", "a"), ("d2", "c"), ("d3", "c")], "d string, i string")
    seeds = spark.createDataFrame([("q", "a"), ("q", "b")], "q string, i string")
    assert {r["i"]: r["n"] for r in g.two_hops(seeds, ["q"], "i", refs, "d", "i").collect()} == {"a": 2, "b": 1, "c": 1}
    fam = spark.createDataFrame([("Art. 1 Abs. 2 A",), ("Art. 1 A",), ("Art. 1 Abs. 10 A",), ("x",)], "citation string")
    assert [r["citation"] for r in g.families(fam, "citation").orderBy("place").collect()] == ["Art. 1 A", "Art. 1 Abs. 10 A", "Art. 1 Abs. 2 A"]


@pytest.mark.parametrize("seed", range(2))
def test_cooccurrence_against_brute_force(spark, seed):
    r = random.Random(seed)
    docs = {f"d{i}": {f"i{r.randint(0, 6)}" for _ in range(r.randint(0, 5))} for i in range(20)}
    rows = [(d, i) for d, s in docs.items() for i in s] or [("d", "i")]
    sets = co.citing_sets(spark.createDataFrame(rows + rows + [("d0", None)], "doc string, item string"), "doc", "item")
    pairs = {}
    for s in docs.values():
        for a, b in itertools.permutations(s, 2):
            pairs[a, b] = pairs.get((a, b), 0) + 1
    assert {(x["src"], x["dst"]): x["n"] for x in co.pair_counts(sets).collect()} == pairs
    conf = {(x["src"], x["dst"]): x["weight"] for x in co.confidence(co.pair_counts(sets), co.support(sets, 2), 2).collect()}
    assert conf == {(a, b): pytest.approx(n / sum(a in s and len(s) > 1 for s in docs.values())) for (a, b), n in pairs.items() if n >= 2}
    total = sum(bool(s) for s in docs.values())
    raw = {(a, b): n * (1 + math.log((1 + total) / (1 + sum(b in s for s in docs.values())))) for (a, b), n in pairs.items()}
    top = {a: max(v for (x, _), v in raw.items() if x == a) for a, _ in raw}
    assert {(x["src"], x["dst"]): x["weight"] for x in co.tfidf(co.pair_counts(sets), sets).collect()} == {k: pytest.approx(v / top[k[0]]) for k, v in raw.items()}


def test_anchor_and_spread(spark):
    index = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.5), ("a", "z", 0.5)], "src string, dst string, weight double")
    anchors = spark.createDataFrame([("q", "a"), ("q", "a")], "q string, c string")
    assert {r["c"]: r["score"] for r in co.anchor_scores(anchors, ["q"], "c", index, 0.1, 2).collect()} == {"x": pytest.approx(0.1), "z": pytest.approx(0.05)}
    seeds = spark.createDataFrame([("q", "a", 1.0)], "q string, b string, score double")
    assert {r["b"]: r["score"] for r in co.spread(seeds, ["q"], "b", [index, index], 0.25).collect()} == {"a": 1.0, "x": 0.5, "y": 0.25, "z": 0.25}


def test_dense_blocks_against_brute_force(spark, monkeypatch):
    import numpy as np

    from statuta.operators import dense

    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    monkeypatch.setattr(dense, "CORPUS_BLOCK", 7)
    r = np.random.default_rng(1)
    q, c = r.normal(size=(9, 5)), r.normal(size=(30, 5))
    qs = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)] + [("bad", [float("nan")] * 5), ("none", None)], "q string, v array<double>")
    cs = spark.createDataFrame([(f"c{i % 25:02}", x.tolist()) for i, x in enumerate(c)] + [("zero", [0.0] * 5), ("short", [1.0])], "c string, v array<double>")
    out = {}
    for x in dense_top_k(qs, "q", "v", cs, "c", "v", 4, dim=5).collect():
        out.setdefault(x["q"], {})[x["rank"]] = x["c"]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(c).T, 6)
    for i in range(9):
        best = {}
        for j in range(30):
            best[f"c{j % 25:02}"] = max(best.get(f"c{j % 25:02}", -2), s[i, j])
        assert list(dict(sorted(out[f"q{i}"].items())).values()) == [k for k, _ in sorted(best.items(), key=lambda kv: (kv[1], kv[0]), reverse=True)[:4]]
    assert set(out) == {f"q{i}" for i in range(9)}
    fused = dense_rrf(spark.createDataFrame([("q", "a", 0.9, 1), ("q", "a", 0.8, 2)], "q string, c string, cos double, rank int"), "q", "c").first()
    assert fused["best"] == 0.9 and fused["rrf"] == pytest.approx(1 / 61 + 1 / 62)


def test_tfidf_formula(spark):
    docs = spark.createDataFrame([("d1", "aa bb"), ("d2", "aa cc cc"), ("d3", None)], "d string, t string")
    weights, vocabulary = lx.term_weights(docs, "d", "t", max_df=1.0)
    idf = {r["term"]: r["idf"] for r in vocabulary.collect()}
    assert idf["aa"] == pytest.approx(1 + math.log(4 / 3)) and idf["cc"] == pytest.approx(1 + math.log(4 / 2))
    w = {(r["d"], r["term"]): r["w"] for r in weights.collect()}
    a, c = idf["aa"], (1 + math.log(2)) * idf["cc"]
    assert w["d2", "cc"] == pytest.approx(c / math.hypot(a, c))
    top = lx.tfidf_top_k(spark.createDataFrame([("q", "cc zz")], "q string, t string"), "q", "t", docs, "d", "t", 3, max_df=1.0).collect()
    assert [r["d"] for r in top] == ["d2"]


def test_errors_become_rows(spark):
    def boom(b):
        raise RuntimeError("no model")

    assert score_in_batches(spark.range(2), boom, "id long, error string").collect()[0]["error"] == "no model"


def test_edges_by_references_however_spelled(spark, tmp_path):
    refs = "Artikel 2 Absatz 3 AbG; art.\u00a02 Abs.3 AbG; Art. 4 lit. a AbG; Art. 99 AbG; Art. 1 AbG"
    rows = [("Art. 1 AbG", refs), ("Art. 2 Abs. 3 AbG", None), ("Art. 2  Abs. 3 AbG", ""), ("Art. 4 AbG", None), (None, "Art. 1 AbG")]
    spark.createDataFrame(rows, "citation string, references string").write.parquet(f"{tmp_path}/laws_db.parquet")
    got = {tuple(r) for r in catalog._whole_edges(spark, str(tmp_path)).collect()}
    assert got == {("Art. 1 AbG", x) for x in ("Art. 2 Abs. 3 AbG", "Art. 2  Abs. 3 AbG", "Art. 4 AbG")}
