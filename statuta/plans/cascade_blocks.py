"""The law cascade behind the dense ranking, worked out where a question's candidates are.

What links items and books lies in blocks in the shared folder (:mod:`statuta.sources.shelf`). A question comes to one task
with its ranking, hints and near domains, as numbers; the task reads the blocks and ends with the question's first places, so
no row moves for a neighbour of a candidate. Gives what ``law_cascade.law_cascade`` gives with ``book_seeds`` and
``book_scores``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.operators import graph as g
from statuta.plans.law_cascade import CascadeConfig
from statuta.sources.shelf import read, shelve, slabs

#: Links and names in a block; questions that a task works on at a time; sums that it gathers before it adds them up.
LINKS, NAMES, QUESTIONS, HELD = 65_536, 16_384, 4_000, 2_000_000

#: Bits of a number of an item or book; above are those of the question's place among ``QUESTIONS``.
BITS = 40


def shelve_links(links: DataFrame) -> str:
    """Blocks of ``links(src, dst, weight)``, numbers and a weight, each in order of ``src``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slabs(batches, LINKS):
            yield pa.RecordBatch.from_pydict({c: [part[c].to_numpy().tobytes()] for c in ("src", "dst", "weight")})

    rows = links.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    return shelve(rows.where("src IS NOT NULL AND dst IS NOT NULL").repartition("src").sortWithinPartitions("src").mapInArrow(pack, "src binary, dst binary, weight binary"))


def shelve_names(names: DataFrame) -> str:
    """Blocks of ``names(id, name)``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slabs(batches, NAMES):
            yield pa.RecordBatch.from_pydict({"ids": [part["id"].to_numpy().tobytes()], "names": [part["name"].to_pylist()]}, pa.schema([("ids", pa.binary()), ("names", pa.list_(pa.string()))]))

    return shelve(names.select(F.col("id").cast("long").alias("id"), "name").mapInArrow(pack, "ids binary, names array<string>"))


def _links(place: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in read(place):
        yield tuple(np.frombuffer(b[c][0].as_buffer(), kind) for c, kind in (("src", np.int64), ("dst", np.int64), ("weight", np.float64)))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of them, one run after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _find(place: str, ids: np.ndarray) -> np.ndarray:
    """The ``dst`` of each number, -1 where there is none; each has one at most."""
    wanted, at = np.unique(ids, return_inverse=True)
    out = np.full(len(wanted), -1, np.int64)
    if len(wanted):
        for src, dst, _ in _links(place):
            there = np.minimum(np.searchsorted(wanted, src), len(wanted) - 1)
            hit = wanted[there] == src
            out[there[hit]] = dst[hit]
    return out[at]


def _spread(place: str, owners: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and parts: what each number's links give, its weight times theirs."""
    by = np.argsort(ids, kind="stable")
    owners, ids, weights = owners[by] << BITS, ids[by], weights[by]
    for src, dst, weight in _links(place):
        first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
        sizes, lo, hi = np.diff(np.r_[first, len(src)]), np.searchsorted(ids, src[first]), np.searchsorted(ids, src[first], "right")
        seeds, of = _runs(lo, hi - lo), np.repeat(np.arange(len(first)), hi - lo)
        if not len(seeds):
            continue
        ends = np.cumsum(sizes[of])
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(HELD, ends[-1], HELD), "right"), len(seeds)])
        for a, b in zip(cuts[:-1], cuts[1:]):
            n, own = sizes[of[a:b]], seeds[a:b]
            at = _runs(first[of[a:b]], n)
            yield np.repeat(owners[own], n) | dst[at], np.repeat(weights[own], n) * weight[at]


def _summed(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each."""

    def add(held: list) -> tuple[np.ndarray, np.ndarray]:
        keys, values = (np.concatenate([p[i] for p in held]) for i in (0, 1))
        by = np.argsort(keys, kind="stable")
        first = _starts(keys := keys[by])
        return keys[first], np.add.reduceat(values[by], first) if len(first) else values

    held, n, most = [(np.empty(0, np.int64), np.empty(0))], 0, HELD
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= most:
            held = [add(held)]
            n = len(held[0][0])
            most = HELD + 2 * n
    return add(held)


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)


def _places(ordered: np.ndarray) -> np.ndarray:
    """Place from 0 of each row among those of its owner."""
    first = _starts(ordered)
    return np.arange(len(ordered)) - np.repeat(first, np.diff(np.r_[first, len(ordered)]))


def _best(owners: np.ndarray, k: int, score: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """Rows of the ``k`` largest scores of each owner (ties: the larger), in this order; ``owners`` is in order."""
    first, keep = _starts(owners), np.ones(len(owners), bool)
    for a, b in zip(first, np.r_[first[1:], len(owners)]):
        if b - a > k:
            keep[a:b] = score[a:b] >= np.partition(score[a:b], b - a - k)[b - a - k]
    rows = np.flatnonzero(keep)
    rows = rows[np.lexsort([-t[rows] for t in reversed(ties)] + [-score[rows], owners[rows]])]
    return rows[_places(owners[rows]) < k]


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10**digits + 0.5) / 10**digits


def _at(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each asked key, 0 where there is none; ``keys`` in order."""
    if not len(keys):
        return np.zeros(len(asked))
    there = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[there] == asked, values[there], 0.0)


def _stretched(owners: np.ndarray, x: np.ndarray) -> np.ndarray:
    """To 0..1 within an owner, 1 where all are equal."""
    first = _starts(owners)
    n = np.diff(np.r_[first, len(owners)])
    lo, hi = (np.repeat(f.reduceat(x, first), n) for f in (np.minimum, np.maximum))
    return np.where(hi <= lo, 1.0, (x - lo) / np.where(hi <= lo, 1.0, hi - lo))


def _book_scores(owners, domains, rrf, best, hinted, domain_books: str, network: str, config: CascadeConfig, top_domains: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and scores of each question's best books, as ``book_seeds`` and ``book_scores``. ``hinted``: keys, distinct."""
    books = _find(domain_books, domains)
    owners, books, rrf, best = (x[books >= 0] for x in (owners, books, rrf, best))
    head = _places(owners) < top_domains
    keys = (owners[head] << BITS) | books[head]
    by = np.argsort(keys, kind="stable")
    first = _starts(keys := keys[by])
    seeds = np.empty(0)
    if len(first):
        counts = np.diff(np.r_[first, len(keys)]).astype(float)
        keys, own = keys[first], keys[first] >> BITS
        seeds = 0.45 * _stretched(own, counts) + 0.45 * _stretched(own, np.add.reduceat(rrf[head][by], first)) + 0.10 * _stretched(own, np.maximum.reduceat(best[head][by], first))
    keys, seeds = _summed([(keys, seeds), (hinted, np.full(len(hinted), float(config.hint_weight)))])

    def parts():
        yield keys, seeds
        yield from _spread(network, keys >> BITS, keys & ((1 << BITS) - 1), config.network_weight * seeds)

    wide, score = _summed(parts())
    score = _rounded(score, 9)
    rows = _best(wide >> BITS, config.top_books, score, _at(keys, seeds, wide), wide)
    wide, score = wide[rows], score[rows]
    if len(rows):
        first = _starts(wide >> BITS)
        hi = np.repeat(score[first], np.diff(np.r_[first, len(rows)]))  # the best comes first
        score = np.where(hi > 0, score / np.where(hi > 0, hi, 1.0), score)
    return wide, score


def cascade(ranked: DataFrame, near: DataFrame, exact: DataFrame, hinted: DataFrame, query: str, items: DataFrame, domains: DataFrame, networks: list[DataFrame], graph: DataFrame, anchors: DataFrame, cocitation: DataFrame, config: CascadeConfig = CascadeConfig(), rrf_k: float = 60.0, top_domains: int = 100) -> DataFrame:
    """``query, citation, score, rank``: the first ``final_k`` laws of every question.

    Items, books and domains are numbers in the order of their names. ``ranked(query, ids)``: the items in order, ``near(query,
    ids, rrf, best)``: the domains in order; ``exact(query, id)``, ``hinted(query, book)``, ``items(id, name, book)``,
    ``domains(id, book)``, ``networks``: each ``src, dst, weight`` of books; of items ``graph(src, dst)``, ``anchors(src, dst,
    weight)``, ``cocitation(src, dst, weight)``.
    """
    from statuta.operators.scores import top_k

    links = lambda index, n: shelve_links(top_k(index, ["src"], n, F.col("weight").desc(), F.col("dst").desc()))
    one = reduce(DataFrame.unionByName, [n.select("src", "dst", "weight") for n in networks]).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    linked = config.graph_mode != "none" and config.graph_boost > 0
    beside = shelve_links(g.directed(graph, config.graph_mode).select(F.col("node").alias("src"), F.col("neighbor").alias("dst"), F.lit(1.0).alias("weight"))) if linked else ""
    network, anchored, cited = shelve_links(one), links(anchors, config.anchor_targets), links(cocitation, config.cocitation_targets)
    domain_books, item_books = (shelve_links(df.select(F.col("id").alias("src"), F.col("book").alias("dst"), F.lit(0.0).alias("weight"))) for df in (domains, items))
    names, low, wide, questions = shelve_names(items), (1 << BITS) - 1, max(config.final_k, config.per_subquery), QUESTIONS

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Whole questions, and the place of each row's among them."""
        held: list[pa.RecordBatch] = []

        def split(last: bool):
            nonlocal held
            if not held:
                return
            t = pa.Table.from_batches(held)
            codes = t["q"].combine_chunks().dictionary_encode().indices.to_numpy()  # in order of appearance
            ends = int(codes[-1]) + last  # the last question may go on
            for a in range(0, ends, questions):
                lo, hi = np.searchsorted(codes, [a, min(a + questions, ends)])
                yield t.slice(lo, hi - lo), codes[lo:hi].astype(np.int64) - a
            rest = t.slice(np.searchsorted(codes, ends))
            held = rest.to_batches() if len(rest) else []

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= 8 * questions:
                yield from split(False)
        yield from split(True)

    def ranking(t: pa.Table, of: np.ndarray) -> pa.RecordBatch:
        def flat(column: str) -> tuple[np.ndarray, np.ndarray]:
            values = t[column].combine_chunks()
            return np.repeat(of, pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)), values.flatten().to_numpy(zero_copy_only=False)

        def single(column: str) -> np.ndarray:
            values = t[column].combine_chunks()
            there = values.is_valid().to_numpy(zero_copy_only=False)
            return (of[there] << BITS) | values.drop_null().to_numpy(zero_copy_only=False)

        hints, hits = np.unique(single("hinted")), single("exact")
        own, places = flat("near")
        book_keys, shares = _book_scores(own, places, flat("rrf")[1], flat("best")[1], hints, domain_books, network, config, top_domains)
        book_keys, plus = _summed([(hints, np.full(len(hints), float(config.book_boost))), (book_keys, config.book_network_boost * shares)])
        own, ids = flat("ids")
        rank = _places(own) + 1
        reciprocal, keys = 1.0 / (config.rrf_k + rank), (own << BITS) | ids

        def parts():
            yield keys, reciprocal
            yield hits, np.full(len(hits), float(config.exact_boost))
            if linked:
                seed = rank <= config.graph_seeds
                yield from _spread(beside, own[seed], ids[seed], config.graph_boost * reciprocal[seed])
            heads = np.unique(np.concatenate([hits, keys[rank <= config.anchor_ranked]]))
            yield from _spread(anchored, heads >> BITS, heads & low, np.full(len(heads), float(config.anchor_boost)))

        pool, base = _summed(parts())
        books = _find(item_books, pool & low)
        score = _rounded(base + np.where(books >= 0, _at(book_keys, plus, (pool >> BITS << BITS) | np.maximum(books, 0)), 0.0), 9)
        rows = _best(pool >> BITS, wide, score, pool)
        pool = pool[rows]
        own, rank = pool >> BITS, _places(pool >> BITS) + 1
        seed, ordered = rank <= config.cocitation_seeds, np.sort(pool)
        weight = config.cocitation_boost * (1.0 / (config.rrf_k + rank)) / (1.0 / (config.rrf_k + 1.0))

        def inside():
            for k, w in _spread(cited, own[seed], pool[seed] & low, weight[seed]):
                hit = ordered[np.minimum(np.searchsorted(ordered, k), len(ordered) - 1)] == k
                yield k[hit], w[hit]

        score = _rounded(1.0 / (config.rrf_k + rank) + _at(*_summed(inside()), pool), 12)
        rows = _best(own, config.final_k, score, pool)
        own, ids, score = own[rows], pool[rows] & low, score[rows]
        wanted, at = np.unique(ids, return_inverse=True)
        found, known = [np.empty(0, np.int64)], [pa.array([], pa.string())]
        for b in read(names):
            block = np.frombuffer(b["ids"][0].as_buffer(), np.int64)
            there = np.flatnonzero(np.isin(block, wanted))
            found.append(block[there])
            known.append(b["names"].combine_chunks().flatten().take(pa.array(there)))
        by = np.argsort(np.concatenate(found))
        first = _starts(of)
        return pa.RecordBatch.from_arrays([
            t["q"].combine_chunks().take(pa.array(first[own])), pa.concat_arrays(known).take(pa.array(by[at])), pa.array(score), pa.array((_places(own) + 1).astype(np.int32)),
        ], ["q", "citation", "score", "rank"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, of in groups(batches):
            whole = ranking(t, of)
            for i in range(0, len(whole), 65_536):
                yield whole.slice(i, 65_536)

    columns = {"ids": "array<long>", "near": "array<long>", "rrf": "array<double>", "best": "array<double>", "exact": "long", "hinted": "long"}
    row = lambda df, **has: df.select(F.col(query).cast("string").alias("q"), *[(F.col(has[c]) if c in has else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])
    rows = [row(ranked, ids="ids"), row(near, near="ids", rrf="rrf", best="best"), row(exact, exact="id"), row(hinted, hinted="book")]
    n = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stacked = reduce(DataFrame.unionByName, rows).where("q IS NOT NULL").repartition(n, "q").sortWithinPartitions("q")
    return stacked.mapInArrow(kernel, "q string, citation string, score double, rank int").withColumnRenamed("q", query)
