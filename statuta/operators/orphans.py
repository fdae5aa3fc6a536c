"""References to records that do not exist: missing, deleted or arriving later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.plans.runtime import materialise

#: A key is heavy if it has at least this part of all references; so there are at most as many heavy keys.
HEAVY_KEYS = 10_000


def key_states(records: DataFrame, key: str, arrives: str, ends: str) -> DataFrame:
    """``(key, arrives, ends)``: the earliest of each over all rows of a key. Null keys are left out."""
    return records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(arrives).alias("arrives"), F.min(ends).alias("ends"))


def _kind(at: Column, known: Column, arrives: Column, ends: Column) -> Column:
    return F.when(known.isNull(), "missing").when(arrives > at, "late").when(ends <= at, "deleted")


def _heavy(counts: DataFrame, *keys: str) -> DataFrame:
    """The distinct ``keys`` of ``counts(.., n)`` that have at least 1 / ``HEAVY_KEYS`` of all references; so at most as
    many, and safe to broadcast."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= max(2, -(-total // HEAVY_KEYS))).select(*keys)


def _settle(pre: DataFrame, states: DataFrame) -> DataFrame:
    """``pre(key, period, n, first, last)`` where something is wrong: with ``kind``, if that holds for the whole period,
    or with ``split`` and the key's state, if the state changes within it.

    Heavy keys get their state by broadcast. Of the rest, an anti-join finds the keys without any record and a join the
    state of the others, both over the same shuffle of pre-aggregated rows, which has no hot key left.
    """
    heavy = _heavy(pre.groupBy("key").agg(F.sum("n").alias("n")), "key")
    known = states.withColumn("known", F.lit(True))
    marked = heavy.join(known, "key", "left").withColumn("heavy", F.lit(True))
    tagged = pre.join(F.broadcast(marked), "key", "left")
    hot, rest = tagged.where("heavy").drop("heavy"), tagged.where("heavy IS NULL").select(*pre.columns)
    none = [F.lit(None).cast(states.schema[c].dataType).alias(c) for c in ("arrives", "ends")]
    missing = rest.join(states, "key", "left_anti").select(*pre.columns, *none, F.lit(None).cast("boolean").alias("known"))
    joined = hot.unionByName(missing).unionByName(rest.join(known, "key"))
    first, last = (_kind(F.col(c), F.col("known"), F.col("arrives"), F.col("ends")) for c in ("first", "last"))
    inside = lambda c: F.coalesce((F.col(c) > F.col("first")) & (F.col(c) <= F.col("last")), F.lit(False))
    return joined.withColumns({"kind": first, "kind_at_end": last, "split": inside("arrives") | inside("ends")}).where("split OR kind IS NOT NULL").drop("kind_at_end")


def _rows_of(refs: DataFrame, settled: DataFrame, pre: DataFrame) -> DataFrame:
    """``refs(key, period, at, ...)`` that are orphans, with ``kind``, by the settled (key, period) states: heavy pairs of
    key and period by broadcast, all others by a shuffle on both, so that the rows of a hot key spread over its periods."""
    state = settled.select(F.col("key").alias("__k"), F.col("period").alias("__p"), "kind", "split", "known", "arrives", "ends")
    both = F.col("__k").eqNullSafe(F.col("key")) & F.col("__p").eqNullSafe(F.col("period"))
    heavy = _heavy(pre.select("key", "period", "n"), "key", "period")
    tagged = refs.join(F.broadcast(heavy.select(F.col("key").alias("__k"), F.col("period").alias("__p"), F.lit(True).alias("heavy"))), both, "left").drop("__k", "__p")
    few = F.broadcast(state.join(heavy, both, "left_semi"))
    hot = tagged.where("heavy").join(few, both)
    rest = tagged.where("heavy IS NULL").join(state, both)
    found = hot.unionByName(rest).withColumn("kind", F.when(F.col("split"), _kind(F.col("at"), F.col("known"), F.col("arrives"), F.col("ends"))).otherwise(F.col("kind")))
    return found.where("kind IS NOT NULL").drop("__k", "__p", "split", "known", "arrives", "ends", "heavy", "period")


def _aggregated(references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references with their period, and the same pre-aggregated per key and period."""
    refs = materialise(references.where(F.col("key").isNotNull()).withColumn("period", F.trunc("at", "month")))
    return refs, refs.groupBy("key", "period").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def find_orphans(references: DataFrame, records: DataFrame) -> DataFrame:
    """The references without a live record, with their ``kind``.

    ``references``: ``key``, ``at`` (when the referring row was loaded) and any further columns, which are kept (but for
    one called ``period``). ``records``: ``key``, ``arrives``, ``ends``. ``missing``: no record has the key; ``late``: it
    arrives after ``at``; ``deleted``: it ended at or before ``at`` (late comes first if both hold). References are
    pre-aggregated per key and month, the pairs are settled against the records, and only rows of the orphan pairs come
    back. A null ``at`` can only be missing; null keys refer to nothing and give no row; repeated references stay.
    """
    refs, pre = _aggregated(references)
    return _rows_of(refs, _settle(pre, key_states(records, "key", "arrives", "ends")), pre)


def count_orphans(references: DataFrame, records: DataFrame, table: str) -> DataFrame:
    """``(table_name, period, kind, n)``: orphan references per table and month.

    References are pre-aggregated per key and month before any join. A key's state settles a whole month at once unless
    it changes inside it: for these months (two a key at most) the rows themselves are compared, those of a hot key and
    month by broadcast. A null ``at`` counts in the null period.
    """
    refs, pre = _aggregated(references.select("key", "at"))
    settled = _settle(pre, key_states(records, "key", "arrives", "ends"))
    whole = settled.where("NOT split").select("period", "kind", "n")
    rows = _rows_of(refs.withColumn("month", F.col("period")), settled.where("split"), pre).select(F.col("month").alias("period"), "kind", F.lit(1).cast("long").alias("n"))
    total = whole.unionByName(rows).groupBy("period", "kind").agg(F.sum("n").alias("n"))
    return total.select(F.lit(table).alias("table_name"), "period", "kind", F.col("n").cast("long").alias("n"))
