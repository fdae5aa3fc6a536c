"""Most similar vectors for every vector: a permutation index of pivots in inverted files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Index:
    """Settings of the index.

    ``pivots``: their number is so many times the root of the rows. ``sample``: they are drawn from so many vectors, the
    first by hash, or from four times their number if that is more; both grow with the root of the rows only.
    ``apart``: no two pivots are nearer than this cosine, so a dense group has one file, which holds all of it.
    ``prefix``: a vector is represented by so many nearest pivots, in order. ``postings``: it is posted under the first
    so many of them. ``candidates``: so many members of a file, and all that tie with the last, are taken by footrule
    distance and compared exactly; None compares all. ``group``: postings held in one task.
    """

    pivots: float = 1.5
    sample: int = 8_192
    apart: float = 0.80
    prefix: int = 8
    postings: int = 4
    candidates: int | None = 48
    group: int = 65_536

    def __post_init__(self) -> None:
        if not 1 <= self.postings <= self.prefix <= 255 or self.pivots <= 0 or min(self.sample, self.group, self.candidates or 1) < 1:
            raise ValueError("an index needs 1 <= postings <= prefix <= 255 and positive sizes")


#: Tasks that the files are spread over at least.
TASKS = 48
#: Comparisons held at once in a task.
AT_ONCE = 4_000_000
#: A vector with at least this part of all rows as exact copies is a frequent one; so there are at most as many.
FREQUENT = 10_000


def usable(df: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    """``(id, v)``: the vectors with exactly ``dim`` finite numbers, not all zero."""
    v = F.col("v")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(fine)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _unit(v: np.ndarray) -> np.ndarray:
    w = v.astype(np.float64)
    w /= np.abs(w).max(axis=1, keepdims=True)  # tiny and huge vectors keep their direction
    return w / np.linalg.norm(w, axis=1, keepdims=True)


@dataclass(frozen=True)
class _Files:
    pivots: np.ndarray  # one a row
    group: np.ndarray  # of each pivot: the task that has its file
    blocks: np.ndarray  # of each group: more than one where a single file is larger than a task may be


def choose_pivots(rows: DataFrame, dim: int, total: int, index: Index = Index()) -> _Files | None:
    """The pivots, from the bounded sample, and how their files are grouped: near pivots go together, so that a vector
    posted under several of them is sent once."""
    most = max(1, ceil(index.pivots * sqrt(total)))
    drawn = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(max(index.sample, 4 * most)).select("v").toArrow().column("v").combine_chunks()
    if not len(drawn):
        return None
    sample = np.unique(_unit(_matrix(drawn, dim)).round(6), axis=0)
    sample = sample[np.random.default_rng(7).permutation(len(sample))].astype(np.float32)
    pivots, n = np.zeros((most, dim), np.float32), 0
    for x in sample:
        if n < most and not (pivots[:n] @ x >= index.apart).any():
            pivots[n] = x
            n += 1
    pivots = pivots[:n]
    expected = np.zeros(n)
    for at in range(0, len(sample), 4_096):
        near = np.argsort(-(sample[at : at + 4_096] @ pivots.T), axis=1, kind="stable")[:, : index.postings]
        expected += np.bincount(near.ravel(), minlength=n)
    expected *= total / len(sample)
    room = min(index.group, max(1.0, expected.sum() / TASKS))
    group, groups = np.full(n, -1), 0
    for p in range(n):
        if group[p] < 0:
            held = 0.0
            for q in [p, *np.argsort(-(pivots @ pivots[p]), kind="stable").tolist()]:
                if group[q] < 0 and (q == p or held + expected[q] <= room):
                    group[q] = groups
                    held += expected[q]
                if held >= 0.9 * room:
                    break
            groups += 1
    blocks = np.maximum(1, np.ceil(np.bincount(group, weights=expected, minlength=groups) / (2 * index.group))).astype(np.int64)
    return _Files(pivots, group, blocks)


def _post(files: _Files, index: Index, dim: int):
    """Sends each vector, with its permutation, to the groups that have its nearest pivots, once to each. A group of
    several blocks has a task for each pair of them, ``block`` = members' block * blocks + queries' block; a vector goes
    where its own block is either."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = min(index.prefix, len(files.pivots))
        postings = min(index.postings, prefix)
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                b = batch.slice(at, 4_096)
                ids, v = b.column("id").to_numpy(zero_copy_only=False), _matrix(b.column("v"), dim)
                near = _unit(v).astype(np.float32) @ files.pivots.T
                first = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
                order = np.take_along_axis(first, np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable"), 1).astype(np.int32)
                raw = pa.array([x.tobytes() for x in np.ascontiguousarray(v, dtype=np.float32)], pa.binary())
                permutation = pa.array([x.tobytes() for x in np.ascontiguousarray(order)], pa.binary())
                groups = files.group[order[:, :postings]]
                for j in range(postings):
                    new = ~(groups[:, :j] == groups[:, j : j + 1]).any(axis=1)
                    blocks = files.blocks[groups[:, j]]
                    own = (ids * 0x9E3779B1 >> 16) % blocks
                    for other in range(int(blocks[new].max()) if new.any() else 0):
                        for member in (True, False):
                            # where both blocks are the vector's own, it is sent once, as both
                            rows = np.flatnonzero(new & (blocks > other) & (member | (own != other)))
                            block = own[rows] * blocks[rows] + other if member else other * blocks[rows] + own[rows]
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(groups[rows, j].astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(np.full(len(rows), member)),
                                    pa.array(own[rows] == other if member else np.full(len(rows), True)), pa.array(ids[rows]), raw.take(pa.array(rows)), permutation.take(pa.array(rows)),
                                ],
                                names=["cell", "block", "member", "query", "id", "v", "permutation"],
                            )

    return kernel


def _footrule(order: np.ndarray, q: np.ndarray, closeness: np.ndarray) -> np.ndarray:
    """Nearness by footrule of the queries ``q`` to all members: the sum over pivots of the smaller of both closenesses,
    where the first of ``prefix`` pivots has closeness ``prefix``, the last 1 and all others 0. The footrule distance is
    a constant less twice this. ``closeness``: pivots by members."""
    prefix = order.shape[1]
    out = np.zeros((len(q), closeness.shape[1]), np.uint16 if prefix > 21 else np.uint8)
    for j in range(prefix):
        out += np.minimum(closeness[order[q, j]], np.uint8(prefix - j))
    return out


def _search(k: int, least: float, dim: int, files: _Files, index: Index):
    """The ``k`` best members for each query of each file of one task: candidates by footrule distance, compared exactly.
    If a hit is among the last candidates there may be more behind them, as in a dense group, where the distance can't
    tell near from very near; such a query is compared with the whole file."""

    def best(file: np.ndarray, ids, exact, unit, order, member, query):  # noqa: ANN001
        mine = file[member[file]]
        asked = file[query[file]]
        if not len(mine) or not len(asked):
            return
        place = np.full(len(ids), -1)
        place[mine] = np.arange(len(mine))
        members = np.ascontiguousarray(unit[mine].T)
        few = index.candidates is not None and len(mine) > index.candidates
        if few:
            known, where = np.unique(order[file], return_inverse=True)
            local = np.zeros(order.shape, np.int64)
            local[file] = where.reshape(len(file), -1)
            closeness = np.zeros((len(known), len(mine)), np.uint8)
            for j in range(order.shape[1]):
                closeness[local[mine, j], np.arange(len(mine))] = order.shape[1] - j
        step = max(1, min(512, AT_ONCE // len(mine)))
        for at in range(0, len(asked), step):
            q = asked[at : at + step]
            a, b, whole = [], [], np.arange(len(q))
            if few:
                near = _footrule(local, q, closeness)
                self_at = place[q]
                near[np.flatnonzero(self_at >= 0), self_at[self_at >= 0]] = 0
                edge = np.partition(near, len(mine) - index.candidates, axis=1)[:, len(mine) - index.candidates]
                qa, xb = np.nonzero(near >= np.maximum(edge, 1)[:, None])
                cos = np.concatenate([np.zeros(0, np.float32)] + [np.einsum("nd,nd->n", unit[q[qa[i : i + 65_536]]], unit[mine[xb[i : i + 65_536]]]) for i in range(0, len(qa), 65_536)])
                hit = cos >= least - 1e-4
                count = np.bincount(qa[hit], minlength=len(q))
                last = np.bincount(qa[hit & (near[qa, xb] <= edge[qa] + 1)], minlength=len(q))
                dense = (last > 0) | (2 * count > index.candidates)
                keep = hit & ~dense[qa]
                a.append(qa[keep])
                b.append(xb[keep])
                whole = np.flatnonzero(dense)
            if len(whole):
                cos = unit[q[whole]] @ members
                both = np.flatnonzero(place[q[whole]] >= 0)
                cos[both, place[q[whole[both]]]] = -2
                floor = np.full(len(whole), least - 1e-4, np.float32)
                many = np.flatnonzero((cos >= floor[:, None]).sum(axis=1) > 8 * k)
                if len(many):
                    floor[many] = np.maximum(floor[many], np.partition(cos[many], len(mine) - k, axis=1)[:, len(mine) - k] - 2e-5)
                qa, xb = np.nonzero(cos >= floor[:, None])
                a.append(whole[qa])
                b.append(xb)
            qi, xi = q[np.concatenate(a)], mine[np.concatenate(b)]
            s = np.round(np.concatenate([np.zeros(0)] + [np.einsum("nd,nd->n", exact[qi[i : i + 65_536]], exact[xi[i : i + 65_536]]) for i in range(0, len(qi), 65_536)]), 6)
            fine = (s >= least) & (qi != xi)
            qi, xi, s = qi[fine], xi[fine], s[fine]
            by = np.lexsort((ids[xi], -s, qi))
            qi, xi, s = qi[by], xi[by], s[by]
            if len(qi):
                first = np.r_[True, qi[1:] != qi[:-1]]
                rank = np.arange(len(qi)) - np.maximum.accumulate(np.where(first, np.arange(len(qi)), 0))
                yield ids[qi[rank < k]], ids[xi[rank < k]], s[rank < k]

    def kernel(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        exact = _unit(np.frombuffer(b"".join(table.column("v").to_pylist()), dtype=np.float32).reshape(-1, dim))
        unit = exact.astype(np.float32)
        order = np.frombuffer(b"".join(table.column("permutation").to_pylist()), dtype=np.int32).reshape(len(ids), -1)
        member, query = (table.column(n).to_numpy().astype(bool) for n in ("member", "query"))
        cell = table.column("cell")[0].as_py()
        posted = order[:, : index.postings]
        row, col = np.nonzero(files.group[posted] == cell)
        by = np.argsort(posted[row, col], kind="stable")
        row, pivot = row[by], posted[row[by], col[by]]
        cuts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1], True])
        out = [x for i, j in zip(cuts[:-1], cuts[1:]) for x in best(row[i:j], ids, exact, unit, order, member, query)]
        cat = lambda n, kind: np.concatenate([x[n] for x in out]).astype(kind) if out else np.zeros(0, kind)
        return pa.table({"q": pa.array(cat(0, np.int64)), "x": pa.array(cat(1, np.int64)), "cos": pa.array(cat(2, np.float64))})

    return kernel


def nearest(df: DataFrame, id_col: str, vector: str, k: int = 5, least: float = 0.90, dim: int = 64, index: Index = Index()) -> DataFrame:
    """``(id, other, cos)``: the ``k`` most similar others of every usable vector, cosine (6 decimals) at least
    ``least``, ties by smaller id.

    A vector is represented by its nearest pivots in order (its permutation) and posted in the inverted files of the
    first few. Within a file, members are ranked by footrule distance of the permutations, and the first ones compared
    exactly; a query whose hits reach the end of its candidates is compared with the whole file, so a dense group loses
    nothing (the work is quadratic in its size). Files of near pivots lie in one task and a vector is sent there once.
    Every vector is posted; only pivots come from a sample, whose size, like their number, grows with the root of the
    rows. ``Index(candidates=None)`` compares whole files throughout.
    Exact copies are searched once, as one class, and get their answers back afterwards; a vector that a third of all
    rows share is salted. Vectors of other lengths, with null, NaN or infinite numbers or all zero take no part; ids must
    be unique; extra columns are left out; an empty table gives no rows. With fewer than ``k`` others in reach, all.
    """
    rows = usable(df, id_col, vector, dim)
    spark = df.sparkSession
    total = df.count()
    files = choose_pivots(rows, dim, total, index)
    if files is None:
        return spark.createDataFrame([], "id long, other long, cos double")
    one = rows.groupBy("v").agg(F.min("id").alias("id"))
    posted = one.mapInArrow(_post(files, index, dim), "cell int, block int, member boolean, query boolean, id long, v binary, permutation binary")
    hits = posted.groupBy("cell", "block").applyInArrow(_search(k, least, dim, files, index), "q long, x long, cos double")

    keyed = rows.select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    copies = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    frequent = copies.where(F.col("n") >= max(2, ceil(total / FREQUENT))).select("h1", "h2", F.col("rep").alias("hot"))  # at most FREQUENT
    tagged = keyed.join(F.broadcast(frequent), ["h1", "h2"], "left")
    rare = tagged.where("hot IS NULL").join(copies.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", F.col("id").alias("member"))
    members = tagged.where("hot IS NOT NULL").select(F.col("hot").alias("rep"), F.col("id").alias("member")).unionByName(rare)
    # of a class of copies, the k + 1 smallest ids are all that anyone's k best can hold; partitions are cut before they meet
    few = members.withColumn("r", F.expr("row_number() OVER (PARTITION BY rep ORDER BY member)")).where(F.col("r") <= k + 1).groupBy("rep").agg(F.collect_list("member").alias("ids"))
    found = hits.distinct().join(few.withColumnRenamed("rep", "x"), "x", "left").select(F.col("q").alias("rep"), "cos", F.explode(F.coalesce("ids", F.array("x"))).alias("other"))
    own = few.select("rep", F.lit(1.0).alias("cos"), F.explode("ids").alias("other"))
    best = found.unionByName(own).groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cos")).alias("d"), "other"))), 1, k + 1).alias("best"))
    salts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(frequent.select(F.col("hot").alias("rep"), F.lit(salts - 1).alias("s")))
    spread = best.join(hot, "rep", "left").select("rep", "best", F.col("s").isNotNull().alias("f"), F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(0)))).alias("salt"))
    salted = members.join(hot, "rep", "left").select("rep", "member", F.when(F.col("s").isNull(), 0).otherwise(F.pmod(F.xxhash64("member"), F.lit(salts)).cast("int")).alias("salt"))
    each = spread.join(salted, ["rep", "salt"], "left").where("member IS NOT NULL OR NOT f").select(F.coalesce("member", "rep").alias("id"), "best")
    top = each.select("id", F.explode(F.slice(F.filter("best", lambda b: b["other"] != F.col("id")), 1, k)).alias("b"))
    return top.select("id", F.col("b.other").alias("other"), (-F.col("b.d")).alias("cos"))


def pairs(neighbours: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: each pair kept from either side, once."""
    return neighbours.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
