"""TF-IDF search over several blocks."""

from statuta.operators import lexical as lx
from tests.test_dense_at_size import _shuffled
from tests.test_words_at_size import _small_blocks, _texts


def test_tfidf_in_blocks_against_the_weights(spark, monkeypatch):
    _small_blocks(monkeypatch)
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(f"d{i:02}", x) for i, x in enumerate(_texts(50, words, 6))] + [("none", None), (None, "w1 w2")], "d string, t string")
    queries = spark.createDataFrame([(i, x) for i, x in enumerate(_texts(20, words, 7))] + [(99, None), (None, "w1")], "q int, t string")
    for options in ({"ngrams": 2, "min_df": 2}, {"max_features": 5, "max_df": 1.0}):
        weights, vocabulary = lx.term_weights(docs, "d", "t", **options)
        own = {}
        for x in weights.collect():
            own.setdefault(x["d"], {})[x["term"]] = x["w"]
        bag = queries.where("q IS NOT NULL").selectExpr("q", "t").select("q", lx.F.explode(lx.words(lx.F.col("t"), options.get("ngrams", 1))).alias("term"))
        want = {}
        for x in lx.weigh(bag.groupBy("q", "term").agg(lx.F.count("*").alias("tf")), "q", vocabulary).collect():
            for d, terms in own.items():
                if x["term"] in terms:
                    want.setdefault(x["q"], {})[d] = want.get(x["q"], {}).get(d, 0) + x["w"] * terms[x["term"]]
        start, got = _shuffled(spark), {}
        for x in lx.tfidf_top_k(queries, "q", "t", docs, "d", "t", 4, **options).collect():
            got.setdefault(x["q"], []).append((x["rank"], -x["score"], x["d"]))
        assert _shuffled(spark) - start < 60_000  # a row for each term of a text, and a copy for each block, were far more
        for q, scores in want.items():
            best = sorted((-round(s, 9), d) for d, s in scores.items())[:4]
            assert [(s, d) for _, s, d in sorted(got[q])] == best
        assert set(got) == set(want)
