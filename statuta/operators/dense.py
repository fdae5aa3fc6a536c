"""Retrieval by dense vectors."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.operators.scores import ordinals
from statuta.sources.shelf import read, shelve, slabs

#: Vectors of each side that meet at a time.
QUERY_BLOCK, CORPUS_BLOCK = 8_192, 16_384

#: Products in single precision may be off by this much; what is nearer to the edge is worked out in double.
MARGIN = 2e-5


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _shelve(corpus: DataFrame, dim: int, size: int) -> str:
    """Blocks of ``corpus(c, v, ord)``: ``ids`` (of each vector, the place of its item in order), ``names`` and ``at`` of the
    items, ``vectors``. The vectors of an item follow each other."""
    kind = "float32" if dict(corpus.dtypes)["v"] == "array<float>" else "float64"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for b in batches:
            for start in range(0, len(b), size):
                part = b.slice(start, size)
                names, ids, ords = part["c"].to_pylist(), [], part["ord"].to_pylist()
                for name, o in zip(names, ords):
                    if name != last:
                        last, at = name, o
                    ids.append(at)
                known = dict(zip(ids, names))
                yield pa.RecordBatch.from_pydict({
                    "ids": [np.array(ids, np.int64).tobytes()], "vectors": [_vectors(part["v"], dim).astype(kind).tobytes()],
                    "names": [list(known.values())], "at": [list(known)],
                }, pa.schema([("ids", pa.binary()), ("vectors", pa.binary()), ("names", pa.list_(pa.string())), ("at", pa.list_(pa.int64()))]))

    return shelve(corpus.select("c", "v", "ord").mapInArrow(pack, "ids binary, vectors binary, names array<string>, at array<long>"))


def _nearest(vectors: np.ndarray, place: str, kind: str, k: int, dim: int, scale: int, shift: int) -> np.ndarray:
    """For each vector the keys of its ``k`` nearest items in descending order, -1 where there are fewer. A key holds the
    cosine, in steps of one over ``scale``, and the item's id below, so that the larger of two keys is the better."""
    unit = _unit(vectors)
    single, best = unit.astype(np.float32), np.full((len(unit), k), -1, np.int64)
    low, tile, ends = (1 << shift) - 1, 512, set()
    for block in read(place, "ids", "vectors"):
        ids = np.frombuffer(block["ids"][0].as_buffer(), np.int64)
        own = _unit(np.frombuffer(block["vectors"][0].as_buffer(), kind).reshape(-1, dim))
        across = own.astype(np.float32).T
        same = ids[1:] == ids[:-1]
        twice, starts = np.r_[same, False] | np.r_[False, same], np.flatnonzero(np.r_[True, ~same])
        shared = bool(ends & {ids[0], ids[-1]})  # an item of several blocks
        ends |= {ids[0], ids[-1]}
        for t in range(0, len(unit), tile):
            have = best[t : t + tile]
            worst = have.min(axis=1)
            near = single[t : t + tile] @ across
            edge = np.where(worst < 0, -2.0, (worst >> shift) / scale - 1 - MARGIN - 1 / scale).astype(np.float32)
            if (worst < 0).any() and len(starts) > k:  # the block has k items of its own
                most = near if len(starts) == len(ids) else np.maximum.reduceat(near, starts, axis=1)
                edge = np.maximum(edge, np.partition(most, len(starts) - k, axis=1)[:, len(starts) - k] - np.float32(MARGIN + 1 / scale))
            rows, cols = np.divmod(np.flatnonzero(near >= edge[:, None]), len(ids))
            if not len(rows):
                continue
            cos = np.empty(len(rows))
            for i in range(0, len(rows), 65_536):
                cos[i : i + 65_536] = np.einsum("ij,ij->i", unit[t + rows[i : i + 65_536]], own[cols[i : i + 65_536]])
            keys = (np.clip(np.rint(cos * scale) + scale, 0, 2 * scale).astype(np.int64) << shift) | ids[cols]
            fresh = keys > worst[rows]
            again = np.flatnonzero(fresh & twice[cols])
            if len(again):  # of an item's vectors the nearest
                again = again[np.lexsort((keys[again], ids[cols[again]], rows[again]))]
                fresh[again[:-1][(rows[again[1:]] == rows[again[:-1]]) & (ids[cols[again[1:]]] == ids[cols[again[:-1]]])]] = False
            rows, keys = rows[fresh], keys[fresh]
            touched, counts = np.unique(rows, return_counts=True)
            if not len(touched):
                continue
            wide = np.full((len(touched), k + counts.max()), -1, np.int64)
            wide[:, :k] = have[touched]
            wide[np.repeat(np.arange(len(touched)), counts), k + np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)] = keys
            best[t + touched] = _distinct(wide, low, shift, k) if shared else np.partition(wide, wide.shape[1] - k, axis=1)[:, -k:]
    return -np.sort(-best, axis=1)


def _distinct(keys: np.ndarray, low: int, shift: int, k: int) -> np.ndarray:
    """Of each row the ``k`` largest keys, of an item only its largest."""
    turned = np.sort(np.where(keys < 0, -1, ((keys & low) << (62 - shift)) | (keys >> shift)), axis=1)  # by item, then cosine
    again = (turned[:, :-1] >> (62 - shift)) == (turned[:, 1:] >> (62 - shift))
    turned[:, :-1][again] = -1
    keys = np.where(turned < 0, -1, ((turned & ((1 << (62 - shift)) - 1)) << shift) | (turned >> (62 - shift)))
    return np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:]


def _search(asked: DataFrame, corpus: DataFrame, item: str, vector: str, k: int, dim: int, digits: int, rrf_k: float | None, most: int | None, numbered: bool = False) -> DataFrame:
    """``q, c, cos, rank``, or fused over the ``s`` of a ``q``: ``q, c, rrf, best, rank``. ``asked(q, s, v)``. With
    ``numbered``, items are numbers already, and a fused ranking is one row: ``q, ids, rrf, best``.

    The corpus is written once, in blocks in the order of its items. All vectors of a ``q`` go to one task, which reads the
    blocks once for every ``QUERY_BLOCK`` of its vectors and ends with the ranking itself; nothing else is shuffled.
    """
    from statuta.functions.vectors import usable

    kinds = {"array<float>": "float32", "array<double>": "float64"}
    whole = lambda df: df if dict(df.dtypes)["v"] in kinds else df.withColumn("v", F.col("v").cast("array<double>"))
    q = whole(asked.where(F.col("q").isNotNull() & F.col("s").isNotNull() & usable(F.col("v"), dim)))
    c = whole(corpus.select(F.col(item).cast("string").alias("c"), F.col(vector).alias("v")).where(F.col("c").isNotNull() & usable(F.col(vector), dim)))
    c = c.withColumn("ord", F.col("c").cast("long")).repartition("ord").sortWithinPartitions("ord") if numbered else ordinals(c, "c")
    place, kind, block, scale = _shelve(c, dim, CORPUS_BLOCK), kinds[dict(c.dtypes)["v"]], QUERY_BLOCK, 10**digits
    shift = 62 - (2 * scale).bit_length()
    low, fused = (1 << shift) - 1, rrf_k is not None

    def runs(rows) -> Iterator[tuple]:
        """Rows of one ``q`` and ``s`` as one."""
        before = None
        for q, s, keys in rows:
            if before and before[:2] == (q, s):
                keys = -np.sort(-_distinct(np.concatenate([before[2], keys])[None], low, shift, k)[0])
            elif before:
                yield before
            before = q, s, keys
        if before:
            yield before

    def add(parts: list) -> list:
        ids, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        best = np.zeros(len(ids), np.int64)
        np.maximum.at(best, inverse, np.concatenate([p[2] for p in parts]))
        return [(ids, np.bincount(inverse, np.concatenate([p[1] for p in parts]), minlength=len(ids)), best)]

    def rankings(rows) -> Iterator[tuple]:
        """``q, ids, (rrf,) cosines`` in order."""
        if not fused:
            for q, _, keys in runs(rows):
                keys = keys[keys >= 0]
                yield q, keys & low, None, keys >> shift
            return
        of, parts = None, []
        ordered = lambda p: np.lexsort((-p[0], -p[2], -p[1]))[:most]

        def close() -> tuple:
            ids, rrf, best = add(parts)[0]
            p = ids, np.floor(rrf * 1e9 + 0.5) / 1e9, best
            by = ordered(p)
            return of, p[0][by], p[1][by], p[2][by]

        for q, _, keys in runs(rows):
            if parts and q != of:
                yield close()
                parts = []
            keys, of = keys[keys >= 0], q
            parts.append((keys & low, 1.0 / (rrf_k + np.arange(1, len(keys) + 1)), keys >> shift))
            if len(parts) >= 256:
                parts = add(parts)
        if parts:
            yield close()

    def named(held: list) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([x[1] for x in held])
        wanted = np.unique(ids)
        names, found = [], []
        for b in read(place, "names", "at"):
            at = b["at"].combine_chunks().flatten().to_numpy()
            there = np.flatnonzero(np.isin(at, wanted))
            found.append(at[there])
            names.append(b["names"].combine_chunks().flatten().take(pa.array(there)))
        names, found = pa.concat_arrays(names), np.concatenate(found)
        by = np.argsort(found, kind="stable")
        items = by[np.searchsorted(found[by], ids)]
        sizes = [len(x[1]) for x in held]
        of, rank = np.repeat(np.arange(len(held)), sizes), np.concatenate([np.arange(1, n + 1) for n in sizes]).astype(np.int32)
        queries, cos = pa.array([x[0] for x in held], pa.string()), np.concatenate([x[3] for x in held]) - scale
        rrf = np.concatenate([x[2] for x in held]) if fused else None
        for i in range(0, len(ids), 65_536):
            cut = slice(i, i + 65_536)
            columns = [queries.take(pa.array(of[cut])), names.take(pa.array(items[cut])), *([pa.array(rrf[cut])] if fused else []), pa.array(cos[cut] / scale), pa.array(rank[cut])]
            yield pa.RecordBatch.from_arrays(columns, ["q", "c", "rrf", "best", "rank"] if fused else ["q", "c", "cos", "rank"])

    def listed(held: list) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(held), 1_024):
            part = held[i : i + 1_024]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.list_(pa.int64())), pa.array([x[2] for x in part], pa.list_(pa.float64())), pa.array([(x[3] - scale) / scale for x in part], pa.list_(pa.float64()))], ["q", "ids", "rrf", "best"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = listed if numbered else named

        def rows():
            for slab in slabs(batches, block):
                keys = _nearest(_vectors(slab["v"].combine_chunks(), dim), place, kind, k, dim, scale, shift)
                yield from zip(slab["q"].to_pylist(), slab["s"].to_pylist(), keys)

        held, n = [], 0
        for x in rankings(rows()):
            if len(x[1]):
                held.append(x)
                n += len(x[1])
            if n >= 2_000_000:
                yield from out(held)
                held, n = [], 0
        if held:
            yield from out(held)

    n = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(asked.count() / block))
    schema = "q string, ids array<long>, rrf array<double>, best array<double>" if numbered else f"q string, c string, {'rrf double, best' if fused else 'cos'} double, rank int"
    return q.repartition(n, "q").sortWithinPartitions("q", "s").mapInArrow(kernel, schema)


def dense_top_k(queries: DataFrame, query: str, query_vector: str, corpus: DataFrame, item: str, item_vector: str, k: int, dim: int = 64, digits: int = 6) -> DataFrame:
    """``query, item, cos, rank``: the ``k`` items nearest to every query by cosine, ties by larger item.

    Every pair is compared, in blocks of bounded size as matrix products; neither side has to fit into one task, and
    neither is copied (:func:`_search`). Vectors that aren't usable take no part; repeated items count once, with their
    best cosine.
    """
    asked = queries.select(F.col(query).cast("string").alias("q"), F.lit("").alias("s"), F.col(query_vector).alias("v"))
    return _search(asked, corpus, item, item_vector, k, dim, digits, None, None).select(F.col("q").alias(query), F.col("c").alias(item), "cos", "rank")


def dense_rrf_top(queries: DataFrame, query: str, sub: str, query_vector: str, corpus: DataFrame, item: str, item_vector: str, k: int, rrf_k: float = 60.0, most: int | None = None, dim: int = 64, digits: int = 6) -> DataFrame:
    """``query, item, rrf, best, rank``: as ``dense_rrf`` over ``dense_top_k`` of each ``sub``, with the ranking by fused
    rank, best cosine, item, descending, of which the first ``most`` are given. All of it is done where a query's vectors
    are, so that no row moves for an item that a sub-query finds."""
    asked = queries.select(F.col(query).cast("string").alias("q"), F.col(sub).cast("string").alias("s"), F.col(query_vector).alias("v"))
    return _search(asked, corpus, item, item_vector, k, dim, digits, float(rrf_k), most).select(F.col("q").alias(query), F.col("c").alias(item), "rrf", "best", "rank")


def dense_rrf_lists(queries: DataFrame, query: str, sub: str, query_vector: str, corpus: DataFrame, number: str, item_vector: str, k: int, rrf_k: float = 60.0, most: int | None = None, dim: int = 64, digits: int = 6) -> DataFrame:
    """``query, ids, rrf, best``: the ranking of ``dense_rrf_top`` in one row, of items that are numbers in their order."""
    asked = queries.select(F.col(query).cast("string").alias("q"), F.col(sub).cast("string").alias("s"), F.col(query_vector).alias("v"))
    return _search(asked, corpus, number, item_vector, k, dim, digits, float(rrf_k), most, True).withColumnRenamed("q", query)


def dense_rrf(ranked: DataFrame, query: str, item: str, rrf_k: float = 60.0) -> DataFrame:
    """``query, item, rrf, best``: ranks of an item over all sub-queries fused, and its best cosine.

    ``ranked``: ``query``, ``item``, ``cos``, ``rank``, a row per sub-query that has the item among its best."""
    return ranked.groupBy(query, item).agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("rrf"), F.max("cos").alias("best"))


def score_in_batches(df: DataFrame, score, schema: str) -> DataFrame:
    """Any model as an operator: ``score`` gets and returns a batch of rows, one after the other within a partition.
    ``schema`` is that of its result; a column ``error`` comes behind. A batch that fails comes back with what columns it
    has in common with the result, the others null, and its error, instead of ending the run."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield score(b)[names].assign(error=None)
            except Exception as e:  # noqa: BLE001
                yield pd.DataFrame({n: b[n] if n in b else pd.Series([None] * len(b), index=b.index, dtype=object) for n in names}).assign(error=str(e))

    return df.mapInPandas(kernel, f"{schema}, error string")


def embed(df: DataFrame, key: str, text: str, model, dim: int, done: DataFrame | None = None) -> DataFrame:
    """``key, embedding, error``: texts through a model, a function from a list of texts to one vector each; keys that are
    ``done`` are left out. Another number of vectors than texts, or of numbers than ``dim``, is an error of the batch."""
    from statuta.operators.incremental import todo

    def score(b: pd.DataFrame) -> pd.DataFrame:
        got = [np.asarray(v, dtype=np.float32) for v in model(b[text].fillna("").tolist())]
        if len(got) != len(b) or any(v.shape != (dim,) for v in got):
            raise ValueError(f"expected {len(b)} vectors of {dim}")
        return pd.DataFrame({key: b[key], "embedding": [v.tolist() for v in got]})

    rows = df.select(key, text)
    return score_in_batches(rows if done is None else todo(rows, done, key), score, f"{key} {dict(df.dtypes)[key]}, embedding array<float>")


def ask(df: DataFrame, key: str, prompt: str, models: list, valid=None, attempts: int = 3, done: DataFrame | None = None) -> DataFrame:
    """``key, answer, error``: prompts put to a model, which of several is settled by a hash of the key, so that load is
    even and a repeated run asks the same one. An answer that raises or isn't ``valid`` is asked for again, ``attempts``
    times; then ``error`` says why. Keys that are ``done`` are left out. Serves translation and decomposition alike."""
    from statuta.operators.incremental import todo

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text, at in zip(b[key], b[prompt], b["__m"]):
                answer = error = None
                for _ in range(attempts):
                    try:
                        answer, error = models[at](text), None
                        if valid is None or valid(answer):
                            break
                        answer, error = None, "invalid answer"
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                out.append((k, answer, error))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    rows = df.select(key, prompt, F.pmod(F.xxhash64(key), F.lit(len(models))).cast("int").alias("__m"))
    return (rows if done is None else todo(rows, done, key)).mapInPandas(kernel, f"{key} {dict(df.dtypes)[key]}, answer string, error string")
