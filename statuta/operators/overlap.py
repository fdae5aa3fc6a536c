"""Numbers of shared words between all questions and all documents, without a row for every pair.

The documents' postings are written once, as blocks of consecutive documents, into the shared folder. Questions are dealt
to the tasks; a task reads block after block, counts what its questions and the block's documents share, and keeps only
what can matter: the best few, or of each class of equal counts its size and its ends. Neither side is copied by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.sources.shelf import blocks, read, read_file, shelve

#: Questions that a task holds (those with counts of every block: fewer), and documents of a block.
QUESTIONS, COUNTED, DOCUMENTS = 2_048, 512, 16_384


def hashed(words: Column) -> Column:
    """Words as numbers of 64 bits."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements of lists, and each list's size; null is empty."""
    sizes = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def postings(documents: DataFrame, *names: str, weigh: Callable | None = None) -> str:
    """Blocks of ``documents(d, ...)``, in order of ``d``, which runs from 0 without gaps: ``lo``, ``n`` and for each of the
    columns ``names``, lists of numbers, ``x_words``, ``x_starts``, ``x_docs``. ``weigh`` gets a block's elements and the document of
    each, and gives both without repetitions, and weights (``x_weights``)."""
    size = DOCUMENTS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sized(batches, size):
            out = {"lo": t["d"][0].as_py(), "n": len(t)}
            for x in names:
                words, sizes = _lists(t[x].combine_chunks())
                docs = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
                words, docs, weights = weigh(words, docs) if weigh else (words, docs, np.zeros(0))
                by = np.argsort(words, kind="stable")
                some, starts = np.unique(words[by], return_index=True)
                out |= {f"{x}_words": some.astype(np.int64).tobytes(), f"{x}_starts": np.append(starts, len(words)).astype(np.int64).tobytes(), f"{x}_docs": docs[by].tobytes(), f"{x}_weights": (weights[by] if weigh else weights).tobytes()}
            yield pa.RecordBatch.from_pylist([out])

    columns = "".join(f", {x}_{part} binary" for x in names for part in ("words", "starts", "docs", "weights"))
    return shelve(documents.repartitionByRange("d").sortWithinPartitions("d").mapInArrow(pack, f"lo long, n long{columns}"))


def sized(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in tables of ``size``, the last one of a partition smaller."""
    held, n = [], 0
    for b in batches:
        while len(b):
            held.append(b.slice(0, size - n))
            n, b = n + len(held[-1]), b.slice(size - n)
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


class _Postings:
    """One block's postings of a column."""

    def __init__(self, block: pa.Table, x: str) -> None:
        get = lambda part, kind: np.frombuffer(block[f"{x}_{part}"][0].as_buffer(), kind)
        self.words, self.starts, self.docs, self.weights = get("words", np.int64), get("starts", np.int64), get("docs", np.int32), get("weights", np.float64)
        self.lo, self.n = block["lo"][0].as_py(), block["n"][0].as_py()

    def _at(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.words, asked)
        there = at < len(self.words)
        there[there] = self.words[at[there]] == asked[there]
        return there, at[there]

    def count(self, asked: np.ndarray) -> np.ndarray:
        """How many of the words each document has."""
        _, at = self._at(asked)
        if not len(at):
            return np.zeros(self.n, np.int64)
        return np.bincount(np.concatenate([self.docs[self.starts[i] : self.starts[i + 1]] for i in at]), minlength=self.n)

    def product(self, asked: np.ndarray, weights: np.ndarray) -> np.ndarray | None:
        """The sum of the products of both weights."""
        there, at = self._at(asked)
        if not len(at):
            return None
        cuts = [slice(self.starts[i], self.starts[i + 1]) for i in at]
        own = np.repeat(weights[there], [c.stop - c.start for c in cuts])
        return np.bincount(np.concatenate([self.docs[c] for c in cuts]), weights=np.concatenate([self.weights[c] for c in cuts]) * own, minlength=self.n)


def ask(questions: DataFrame, kernel: Callable[[list, list], Iterator[tuple]], schema: str, most: int) -> DataFrame:
    """``kernel`` on the keys and word lists of every ``most`` of ``questions(q, words)`` that are in one task."""
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, None if i else kind) for i, x in enumerate(zip(*rows))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sized(batches, most):
            words, sizes = _lists(t["words"].combine_chunks())
            rows = []
            for row in kernel(t["q"].to_pylist(), np.split(words, np.cumsum(sizes)[:-1])):
                rows.append(row)
                if len(rows) >= 50_000:
                    yield batch(rows, t["q"].type)
                    rows = []
            if rows:
                yield batch(rows, t["q"].type)

    n = max(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(questions.count() / most))
    return questions.select("q", "words").repartition(n, "q").mapInArrow(run, schema)


def _better(best: list, scores: np.ndarray, lo: int, k: int, digits: int | None = None) -> list:
    """``best``, up to ``k`` pairs of a score and a document in order, with those of a later block."""
    edge = best[-1][0] if len(best) == k else 0
    at = np.flatnonzero(scores > (edge if digits is None else edge - 10.0**-digits))
    if not len(at):
        return best
    own = scores[at] if digits is None else np.round(scores[at], digits)
    first = np.argsort(-own, kind="stable")[:k]
    return sorted([*best, *((float(own[i]), lo + int(at[i])) for i in first if own[i] > 0)], key=lambda x: (-x[0], x[1]))[:k]


def top_overlaps(questions: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """``q, d, score``: the ``k`` documents that share most words with a question, ties by ``d``; those that share none are
    left out. ``documents(d, words)``."""
    place = postings(documents, "words")

    def kernel(keys: list, lists: list) -> Iterator[tuple]:
        best = [[] for _ in keys]
        for block in read(place):
            p = _Postings(block, "words")
            for i, asked in enumerate(lists):
                best[i] = _better(best[i], p.count(asked), p.lo, k)
        return ((q, d, s) for q, b in zip(keys, best) for s, d in b)

    return ask(questions, kernel, f"q {dict(questions.dtypes)['q']}, d long, score double", QUESTIONS)


def top_products(questions: DataFrame, documents: DataFrame, k: int, weigh: Callable, digits: int = 9) -> DataFrame:
    """``q, d, score``: the ``k`` documents with the largest sum, over shared words, of both weights, ties by ``d``; only
    sums above zero. Both sides have ``words`` with repetitions, which ``weigh`` turns into words and weights."""
    place = postings(documents, "words", weigh=weigh)

    def kernel(keys: list, lists: list) -> Iterator[tuple]:
        sizes = [len(x) for x in lists]
        words, of, weights = weigh(np.concatenate(lists), np.repeat(np.arange(len(keys), dtype=np.int32), sizes))
        cuts = np.searchsorted(of, np.arange(1, len(keys)))
        lists, own, best = np.split(words, cuts), np.split(weights, cuts), [[] for _ in keys]
        for block in read(place):
            p = _Postings(block, "words")
            for i, (asked, w) in enumerate(zip(lists, own)):
                n = p.product(asked, w)
                if n is not None:
                    best[i] = _better(best[i], n, p.lo, k, digits)
        return ((q, d, s) for q, b in zip(keys, best) for s, d in b)

    return ask(questions, kernel, f"q {dict(questions.dtypes)['q']}, d long, score double", QUESTIONS)


class _Places:
    """Of one question: how many documents each block has of a number of shared words and of keywords, and the ends of
    each class of both numbers: the first ``most`` and the last one, with their places."""

    def __init__(self, most: int) -> None:
        self.most, self.ends = most, {}
        self.sizes: tuple[list, list] = ([], [])
        self.sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _before(self, axis: int, value: int) -> int:
        return int(self.sums[axis][value]) if value < len(self.sums[axis]) else 0

    def add(self, n: np.ndarray, key: np.ndarray, lo: int) -> None:
        order = np.argsort(n.astype(np.uint16) if n.max(initial=0) < 65_536 else n, kind="stable")
        level = n[order]
        cuts = np.flatnonzero(np.r_[True, level[1:] != level[:-1], True])
        same = {int(v): np.flatnonzero(key == v) for v in np.unique(key)} if key.any() else None
        for i, j in zip(cuts[:-1], cuts[1:]):
            mine, lex = order[i:j], int(level[i])
            of = key[mine] if same else None
            for v in np.unique(of) if same else (0,):
                at = np.flatnonzero(of == v) if same else range(j - i)
                end = self.ends.setdefault((lex, int(v)), [[], None])
                place = lambda p: (lo + int(mine[p]), self._before(0, lex) + int(p) + 1, self._before(1, int(v)) + (int(np.searchsorted(same[int(v)], mine[p])) if same else int(mine[p])) + 1)  # noqa: B023, E731
                end[0] += [place(p) for p in at[: self.most - len(end[0])]] if len(end[0]) < self.most else []
                end[1] = place(at[-1])
        for axis, counts in enumerate((np.bincount(n), np.bincount(key))):
            self.sizes[axis].append(counts.astype(np.int32))
            old = self.sums[axis]
            new = np.zeros(max(len(old), len(counts)), np.int64)
            new[: len(old)] += old
            new[: len(counts)] += counts
            self.sums = (new, self.sums[1]) if axis == 0 else (self.sums[0], new)

    def ranks(self, lex: int, v: int, by_lex: int, by_key: int) -> tuple[int, int]:
        """Places in all, of places within equals."""
        return int(self.sums[0][lex + 1 :].sum()) + by_lex, int(self.sums[1][v + 1 :].sum()) + by_key

    def of(self, b: int, p: int, n: np.ndarray, key: np.ndarray) -> tuple[int, int, int, int]:
        """Numbers and places of the document at ``p`` of block ``b``."""
        lex, v = int(n[p]), int(key[p])
        earlier = lambda axis, x, own: sum(int(c[x]) for c in self.sizes[axis][:b] if x < len(c)) + int((own[:p] == x).sum()) + 1
        return lex, v, *self.ranks(lex, v, earlier(0, lex, n), earlier(1, v, key))


def overlap_places(questions: DataFrame, documents: DataFrame, links: DataFrame, most: int, seed_k: int) -> DataFrame:
    """``q, d, lex, r_lex, r_key, graph``: words shared, place by them, place by keywords shared, ties by ``d``, for each
    question of those documents that can matter: of each class of equal numbers of words and of keywords the first
    ``most`` and the last one (within it, earlier documents are ahead in both), and all that ``links(src, dst)`` lead to from
    the first ``seed_k`` by words (``graph`` 1).

    ``documents(d, words, keys)``: keywords are words too.
    """
    place, size = postings(documents, "words", "keys"), DOCUMENTS

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sized(batches, size):
            yield pa.RecordBatch.from_pylist([{x: t[x].to_numpy().astype(np.int64).tobytes() for x in ("src", "dst")}])

    led_by = shelve(links.select("src", "dst").mapInArrow(pairs, "src binary, dst binary"))

    def kernel(keys: list, lists: list) -> Iterator[tuple]:
        states, starts = [_Places(most) for _ in keys], []
        for block in read(place):
            words, keyed = _Postings(block, "words"), _Postings(block, "keys")
            starts.append(words.lo)
            for state, asked in zip(states, lists):
                state.add(words.count(asked), keyed.count(asked), words.lo)
        found, seeds = [], {}
        for i, state in enumerate(states):
            rows = {}
            for (lex, v), (first, last) in state.ends.items():
                for d, by_lex, by_key in [*first, last]:
                    r = state.ranks(lex, v, by_lex, by_key)
                    rows[d] = (lex, *r, 0.0)
                    if r[0] <= seed_k:
                        seeds.setdefault(d, set()).add(i)
            found.append(rows)
        led: dict[int, dict[int, set]] = {}
        wanted = np.array(sorted(seeds), np.int64)
        for block in read(led_by):
            src, dst = (np.frombuffer(block[x][0].as_buffer(), np.int64) for x in ("src", "dst"))
            there = np.isin(src, wanted)
            for s, d in zip(src[there].tolist(), dst[there].tolist()):
                b = int(np.searchsorted(starts, d, "right")) - 1
                for i in seeds[s]:
                    led.setdefault(b, {}).setdefault(i, set()).add(d)
        system, files = blocks(place)
        for b in sorted(led):
            block = read_file(system, files[b])
            words, keyed = _Postings(block, "words"), _Postings(block, "keys")
            for i, ds in led[b].items():
                n, key = words.count(lists[i]), keyed.count(lists[i])
                for d in ds:
                    lex, _, r_lex, r_key = states[i].of(b, d - words.lo, n, key)
                    found[i][d] = (lex, r_lex, r_key, 1.0)
        return ((q, d, float(lex), r_lex, r_key, graph) for q, rows in zip(keys, found) for d, (lex, r_lex, r_key, graph) in rows.items())

    return ask(questions, kernel, f"q {dict(questions.dtypes)['q']}, d long, lex double, r_lex long, r_key long, graph double", COUNTED)
