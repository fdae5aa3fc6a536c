"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.plans.runtime import bounded_rows, materialise

#: Ranges of keys, so many for each unit of the key's logarithm, whose sizes are summed before single texts are looked at.
#: An exponential variable of any rate falls into each with a probability of less than 1 in 2,700: no range is hot.
RANGES = 1_024
#: Sources a plan may have; their figures are held on the driver.
MOST_SOURCES = 10_000


def source_name(c: Column) -> Column:
    """A source as it is meant: case, blanks and dashes don't count."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def exponential_key(identity: Column, weight: Column, seed: int) -> Column:
    """Efraimidis-Spirakis key: an exponential variable with rate ``weight``; the smallest keys are the sample.

    The uniform variable comes from a hash, so the same text gets the same key in every run and on every executor.
    """
    u = (F.shiftrightunsigned(F.xxhash64(identity, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.greatest(weight, F.lit(1e-6))


def mix(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """``(chosen, shares)``.

    ``texts``: ``doc_id``, ``source``, ``identity`` (equal for equal texts), ``tokens``, ``weight``; ``targets``:
    ``source``, ``target_share``, ``max_repeats``. ``chosen``: ``source, doc_id, tokens, repeats``, one row per text
    used. ``shares``: ``source, target_share, actual_share, tokens, available_tokens``, one row per target.

    A text that several rows deliver is one text, of the row with the smallest id; it belongs to that row's source, so
    no text exceeds its repeats by being there twice. The total is ``total_tokens`` or, without it, the largest at which
    every source present can supply its share; shares of sources without any text go to the others in proportion. A
    source gives as many complete epochs as its budget holds, then the texts with the smallest keys up to what is left,
    cut where it comes nearest. Keys are cut into ranges by their logarithm, range sizes are prefix-summed per source, and
    only the texts of the one range in which the budget ends are ordered singly: no sort of a whole source, however large.
    What is broadcast is one row a source.
    Texts without a target source, and null sources, take no part; null tokens and weights count as 0; a null or
    negative share is 0, a null number of repeats 1; empty tables give no rows.
    """
    goal = targets.where(F.col("source").isNotNull()).select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("most"))
    plan = {r["source"]: (r["share"], r["most"]) for r in bounded_rows(goal.groupBy("source").agg(F.sum("share").alias("share"), F.max("most").alias("most")), MOST_SOURCES)}
    if not plan:
        raise ValueError("no targets")
    rows = texts.select("doc_id", source_name(F.col("source")).alias("source"), "identity", F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    rows = rows.where(F.col("source").isin(list(plan)))
    one = rows.groupBy("identity").agg(F.min(F.struct("doc_id", "source", "tokens", "weight")).alias("r")).select("identity", "r.*")
    keyed = one.select("doc_id", "source", "tokens", exponential_key(F.col("identity"), F.col("weight"), seed).alias("key"))
    kept = materialise(keyed.withColumn("range", F.floor(F.log(F.greatest("key", F.lit(1e-18))) * RANGES).cast("int")))

    available = {r["source"]: r["n"] for r in kept.groupBy("source").agg(F.sum("tokens").alias("n")).collect() if r["n"]}
    present = {s: plan[s] for s in available if plan[s][0] > 0 and plan[s][1] > 0}
    whole = sum(share for share, _ in present.values())
    most = min((available[s] * m * whole / share for s, (share, m) in present.items()), default=0.0)
    total = most if total_tokens is None else min(float(total_tokens), sum(available[s] * m for s, (_, m) in present.items()))
    budget = {s: min(total * share / whole, float(available[s] * m)) for s, (share, m) in present.items()}
    epochs = {s: int((b + 1e-6) // available[s]) for s, b in budget.items()}
    rest = {s: max(0.0, b - epochs[s] * available[s]) if epochs[s] < present[s][1] else 0.0 for s, b in budget.items()}
    spark = texts.sparkSession
    figures = spark.createDataFrame([(s, epochs[s], rest[s]) for s in present], "source string, epochs int, rest double")

    ranges = kept.groupBy("source", "range").agg(F.sum("tokens").alias("n"))
    before = ranges.select("source", "range", "n", (F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")).alias("start"))
    # the first range that a source's budget doesn't hold whole: one row a source
    edge = before.join(F.broadcast(figures), "source").where(F.col("start") + F.col("n") > F.col("rest")).groupBy("source").agg(F.min(F.struct("range", "start")).alias("e"))
    placed = F.broadcast(figures.join(edge, "source", "left").select("source", "epochs", "rest", F.col("e.range").alias("edge"), F.col("e.start").alias("start")))  # at most MOST_SOURCES
    used = kept.join(placed, "source")
    at_edge = F.coalesce((F.col("range") == F.col("edge")) & (F.col("start") < F.col("rest")), F.lit(False))
    inside = Window.partitionBy("source").orderBy("key", "doc_id")
    last = used.where(at_edge).withColumn("until", F.col("start") + F.sum("tokens").over(inside)).withColumn("taken", (F.col("until") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    clear = used.where(~at_edge).withColumn("taken", F.coalesce((F.col("range") < F.col("edge")).cast("int"), F.lit(1)))
    cols = ["source", "doc_id", "tokens", (F.col("epochs") + F.col("taken")).cast("int").alias("repeats")]
    chosen = clear.select(*cols).unionByName(last.select(*cols)).where("repeats > 0")

    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    wanted = spark.createDataFrame([(s, float(share), int(available.get(s, 0))) for s, (share, _) in plan.items()], "source string, target_share double, available_tokens long")
    out = wanted.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    shares = out.select("source", "target_share", (F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy()), F.lit(1))).alias("actual_share"), "tokens", "available_tokens")
    return chosen, shares
