"""The law cascade in blocks: the results of the plain plan, without moving the neighbours of candidates."""

import numpy as np
import pytest

from statuta.plans import cascade_blocks, catalog
from statuta.plans import law_cascade as lc


def _shuffled(spark) -> int:
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_no_shuffle_of_neighbours(spark, data):
    before = _shuffled(spark)
    assert catalog.QUERIES["law_cascade"](spark, data).count() > 700
    assert _shuffled(spark) - before < 600_000  # 1.0 MB when neighbours were shuffled


@pytest.mark.parametrize("mode", ["both", "incoming", "none"])
def test_blocks_against_the_plain_plan(spark, monkeypatch, mode):
    for name, n in (("LINKS", 7), ("NAMES", 5), ("QUESTIONS", 3)):
        monkeypatch.setattr(cascade_blocks, name, n)
    r = np.random.default_rng(3)
    books = ["AB", "BC", "CD", "DE", "EF"]
    names = sorted([f"Art. {i} {books[i % 5]}" for i in range(60)] + ["without a book", "Anhang 1"])
    config = lc.CascadeConfig(per_subquery=15, final_k=6, graph_mode=mode, graph_seeds=10, anchor_targets=4, cocitation_seeds=5, cocitation_targets=4, top_books=3)
    queries = [f"q{i:02}" for i in range(20)]
    pick = lambda n, of=names: [str(x) for x in r.choice(of, n, replace=False)]
    ranked = [(q, c, i + 1) for q in queries[:17] for i, c in enumerate(pick(15))]
    exact = [(q, c, i + 1) for q in queries[8:] for i, c in enumerate(pick(2))]  # three questions with nothing else
    hinted = [(q, b) for q in queries[5:15] for b in pick(2, books)]
    links = sorted({(a, names[0] if i % 3 else b) for a in names for i, b in enumerate(pick(4)) if a != b} - {(names[0], names[0])})  # one has most links
    weighted = lambda: [(a, b, float(r.integers(1, 4)) / 4) for a in names for b in pick(6) if a != b]  # noqa: E731  # many ties
    anchors, cocitation = weighted(), weighted()
    networks = [[(a, b, float(r.integers(1, 4)) / 4) for a in books for b in books if a != b and r.random() < 0.7] for _ in range(3)]
    domains = [(f"d{i:02}", books[i % 5] if i % 7 else None) for i in range(12)]
    near = [(q, *domains[int(d)], round(1 - i / 50, 2), i + 1) for q in queries[2:19] for _ in range(3) for i, d in enumerate(r.choice(12, 5, replace=False))]

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    nets = [frame(n, "src string, dst string, weight double") for n in networks]
    seeds = lc.book_seeds(frame(near, "query string, domain string, book string, cos double, rank int").where("book IS NOT NULL"), "query", top_domains=4)
    network = lc.book_scores(seeds, frame(hinted, "query string, book string"), "query", nets, config)
    plain = lc.law_cascade(
        frame(ranked, "query string, citation string, rank int"), "query", frame(exact, "query string, citation string, place int"), frame(hinted, "query string, book string"), network,
        frame(links, "src string, dst string"), frame(anchors, "src string, dst string, weight double"), frame(cocitation, "src string, dst string, weight double"), config,
    )

    at, book, domain = {n: i + 1 for i, n in enumerate(names)}, {b: i + 1 for i, b in enumerate(books)}, {d: i + 1 for i, (d, _) in enumerate(domains)}
    fused: dict = {}
    for q, d, _, cos, rank in near:
        rrf, best = fused.setdefault(q, {}).get(d, (0.0, 0.0))
        fused[q][d] = rrf + 1 / (60 + rank), max(best, cos)
    lists = [(q, *map(list, zip(*[(domain[d], x, best) for x, best, d in sorted(((round(x, 9), best, d) for d, (x, best) in found.items()), reverse=True)]))) for q, found in fused.items()]
    got = cascade_blocks.cascade(
        frame([(q, [at[c] for p, c, _ in ranked if p == q]) for q in queries[:17]], "query string, ids array<long>"), frame(lists, "query string, ids array<long>, rrf array<double>, best array<double>"),
        frame([(q, at[c]) for q, c, _ in exact], "query string, id long"), frame([(q, book[b]) for q, b in hinted], "query string, book long"), "query",
        frame([(i, n, book.get(n.split(" ")[-1])) for n, i in at.items()], "id long, name string, book long"), frame([(domain[d], book.get(b)) for d, b in domains], "id long, book long"),
        [frame([(book[a], book[b], w) for a, b, w in n], "src long, dst long, weight double") for n in networks],
        frame([(at[a], at[b]) for a, b in links], "src long, dst long"), *[frame([(at[a], at[b], w) for a, b, w in x], "src long, dst long, weight double") for x in (anchors, cocitation)], config, top_domains=4,
    )
    rows = lambda df: sorted((x["query"], x["rank"], x["citation"], round(x["score"], 10)) for x in df.collect())
    assert rows(got) == rows(plain)
    assert {x["query"] for x in got.select("query").distinct().collect()} == set(queries)
