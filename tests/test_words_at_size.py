"""Shared words and the ranking pipeline over several blocks, without copies of either side."""

import random

from pyspark.sql import functions as F

from statuta.functions.text import tokens
from statuta.operators import overlap
from statuta.plans.config import PipelineConfig
from statuta.plans.pipeline import run_pipeline
from tests.test_dense_at_size import _shuffled


def _small_blocks(monkeypatch):
    for name, n in (("QUESTIONS", 8), ("COUNTED", 8), ("DOCUMENTS", 8)):
        monkeypatch.setattr(overlap, name, n, raising=False)


def _texts(n, words, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(words and r.randint(0, 12))) for _ in range(n)]


def test_ranking_in_blocks_equals_one_block_and_shuffles_no_more(spark, monkeypatch):
    words = [f"w{i}" for i in range(25)] + ["bk1", "bk2", "bk3"]
    docs = [(i, f"c{i:03}", x, [f"BK{i % 3 + 1}"] if i % 4 else ["bk1", "bk2"], [f"c{(i * 7) % 200:03}"]) for i, x in enumerate(_texts(200, words, 1))]
    documents = spark.createDataFrame(docs, "doc_ord int, citation string, text string, keywords array<string>, neighbors array<string>")
    queries = spark.createDataFrame(list(enumerate(_texts(80, words, 2))), "query_id int, text string")
    rank = lambda: sorted(tuple(x) for x in run_pipeline(queries, documents, PipelineConfig(seed_k=3, result_limit=5)).collect())
    start = _shuffled(spark)
    whole, once = rank(), _shuffled(spark) - start
    _small_blocks(monkeypatch)
    start = _shuffled(spark)
    assert rank() == whole
    assert _shuffled(spark) - start < 1.5 * once  # with a copy for each block it was several times as much


def test_ranking_by_several_keywords_against_brute_force(spark, monkeypatch):
    _small_blocks(monkeypatch)
    words = [f"w{i}" for i in range(8)] + ["k1", "k2"]
    r, texts, asked = random.Random(3), _texts(60, words[:8], 4), _texts(12, words, 5)
    keys = [[k for k in ("k1", "k2") if r.random() < 0.4] for _ in texts]
    links = {(i, (i * 11 + 3) % 60) for i in range(0, 60, 2)}
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    corpus = df([(i, x.split() + k, k) for i, (x, k) in enumerate(zip(texts, keys))], "d long, w array<string>, k array<string>")
    corpus = corpus.selectExpr("d", "transform(array_distinct(w), x -> xxhash64(x)) AS words", "transform(k, x -> xxhash64(x)) AS keys")
    questions = df(list(enumerate(asked)), "q int, t string").select("q", overlap.hashed(tokens(F.col("t"))).alias("words"))
    got = {}
    for x in overlap.overlap_places(questions, corpus, df(list(links), "src long, dst long"), 2, 2).collect():
        got.setdefault(x["q"], {})[x["d"]] = (x["lex"], x["r_lex"], x["r_key"], x["graph"])
    for q, text in enumerate(asked):
        have = set(text.split())
        lex = [len(have & (set(x.split()) | set(k))) for x, k in zip(texts, keys)]
        key = [len(have & set(k)) for k in keys]
        r_lex = {d: i + 1 for i, d in enumerate(sorted(range(60), key=lambda d: (-lex[d], d)))}
        r_key = {d: i + 1 for i, d in enumerate(sorted(range(60), key=lambda d: (-key[d], d)))}
        led = {b for a, b in links if r_lex[a] <= 2}
        assert {d for d, x in got[q].items() if x[3]} == led
        assert all(x[:3] == (lex[d], r_lex[d], r_key[d]) for d, x in got[q].items())
        assert {min(d for d in range(60) if (lex[d], key[d]) == c) for c in set(zip(lex, key))} <= set(got[q])
