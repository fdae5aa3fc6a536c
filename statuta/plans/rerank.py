"""Second opinions: cross-encoder scores in frozen places, and a model that may remove candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions.text import cut_dots, prompt_hash, token_budget
from statuta.functions.vectors import dot, l2_normalise
from statuta.operators.decisions import confirm_removals, parse_decisions
from statuta.operators.incremental import cache_misses
from statuta.operators.scores import minmax_within, rank_scores, top_k
from statuta.operators.selection import batches, permute_free

KEYS = ["query_id", "citation"]


def rerank(candidates: DataFrame, cache: DataFrame, weights: dict[str, float], top: int, normaliser: str = "score", score_batch=None, procedural: DataFrame | None = None) -> DataFrame:
    """Candidates with ``combined`` and ``final_rank``: the substantive ones among the first ``top`` change places by the
    weighted mean of their signals; procedural laws and those without text keep theirs.

    ``candidates``: ``query_id, citation, rank, book, document`` and a column for each signal but ``cross_encoder``,
    which comes from the cache (``query_id, citation, score``) or, for what isn't there, from ``score_batch``, a
    function from a pandas batch ``(query_id, citation, document)`` to one with ``score``.
    ``normaliser``: ``score`` (to 0..1) or ``rank``.
    """
    if normaliser not in ("score", "rank"):
        raise ValueError(f"unknown normaliser: {normaliser}")
    if not weights or any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be non-negative and sum to more than zero")
    rows = candidates
    if procedural is not None:
        rows = rows.join(procedural.select(F.col(procedural.columns[0]).alias("book"), F.lit(True).alias("procedural")).distinct(), "book", "left")
    else:
        rows = rows.withColumn("procedural", F.lit(False))
    free = ~F.coalesce("procedural", F.lit(False)) & (F.coalesce("document", F.lit("")) != "") & (F.col("rank") <= top)
    rows = rows.withColumn("scored", free)
    known = cache.select(*KEYS, F.col("score").alias("cross_encoder")).dropDuplicates(KEYS)
    if score_batch is not None:
        fresh = cache_misses(rows.where("scored").select(*KEYS, "document"), cache, KEYS).mapInPandas(lambda bs: (score_batch(b)[[*KEYS, "score"]] for b in bs), "query_id string, citation string, score double")
        known = known.unionByName(fresh.select(*KEYS, F.col("score").alias("cross_encoder")))
    rows = rows.join(known, KEYS, "left")
    asked = rows.where("scored")
    for name in weights:
        asked = minmax_within(asked, ["query_id"], name, f"n_{name}") if normaliser == "score" else rank_scores(asked, ["query_id"], name, "rank", f"n_{name}")
    total = sum(weights.values())
    combined = sum((w * F.col(f"n_{name}") for name, w in weights.items()), F.lit(0.0)) / total
    out = rows.join(asked.select(*KEYS, F.round(combined, 9).alias("combined")), KEYS, "left")
    return permute_free(out, ["query_id"], "rank", "combined", F.col("scored")).drop("procedural")


def merge_variants(scores: DataFrame, how: str = "mean") -> DataFrame:
    """One score per query and citation of several wordings of the query: ``mean`` or ``max``."""
    if how not in ("mean", "max"):
        raise ValueError(f"unknown way to merge: {how}")
    return scores.groupBy(*KEYS).agg((F.avg if how == "mean" else F.max)("score").alias("score"))


def contexts(candidates: DataFrame, refs: DataFrame, courts: DataFrame, queries: DataFrame, k: int, most_chars: int = 600) -> DataFrame:
    """``query_id, citation, contexts``: the ``k`` decisions citing a candidate that are nearest to the query.

    ``refs(court, citation)``, ``courts(court, document, v)``, ``queries(query_id, v)``. References are cut to the
    candidates' laws before any vector is touched.
    """
    wanted = refs.join(candidates.select("citation").distinct(), "citation", "left_semi").select("court", "citation").distinct()
    rows = candidates.select(*KEYS).distinct().join(wanted, "citation").join(courts.select("court", "document", l2_normalise(F.col("v")).alias("cv")), "court")
    scored = rows.join(queries.select("query_id", l2_normalise(F.col("v")).alias("qv")), "query_id").withColumn("sim", F.round(dot(F.col("cv"), F.col("qv")), 9))
    best = top_k(scored.select(*KEYS, "court", "document", "sim"), KEYS, k, F.col("sim").desc(), F.col("court"), name="n")
    return best.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", cut_dots(F.col("document"), most_chars).alias("d")))), lambda x: x["d"]).alias("contexts"))


def prompts(rows: DataFrame, instruction: str, window: int = 8192, buffer: int = 64) -> DataFrame:
    """``query_id, batch_id, labels, prompt, prompt_hash, budget``: one prompt for each batch of up to four candidates.

    ``rows``: ``query_id, batch_id, label, query, citation, document, contexts``."""
    block = F.concat(F.lit("["), "label", F.lit("] "), "citation", F.lit("\n"), cut_dots(F.coalesce("document", F.lit("")), 1200), F.when(F.size("contexts") > 0, F.concat(F.lit("\n"), F.array_join("contexts", "\n"))).otherwise(""))
    grouped = rows.withColumn("block", block).groupBy("query_id", "batch_id").agg(F.array_sort(F.collect_list(F.struct("label", "citation", "block"))).alias("b"), F.first("query").alias("query"))
    text = F.concat(F.lit(instruction + "\n\n"), "query", F.lit("\n\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"))
    made = grouped.select("query_id", "batch_id", F.transform("b", lambda x: F.struct(x["label"], x["citation"])).alias("labels"), text.alias("prompt"))
    return made.withColumn("prompt_hash", prompt_hash(F.col("prompt"))).withColumn("budget", token_budget(F.col("prompt"), F.size("labels"), window, buffer))


def judge(asked: DataFrame, answer, confirm=None) -> DataFrame:
    """``query_id, citation, decision, diagnostic``: what the model says of each candidate; with ``confirm``, a removal
    needs both passes. ``answer`` and ``confirm`` are functions from a list of prompts to a list of answers. What isn't
    answered is kept."""

    def one_pass(ask) -> DataFrame:
        def kernel(batches_):
            for b in batches_:
                try:
                    raw = list(ask(b["prompt"].tolist()))
                except Exception as e:  # noqa: BLE001  # what isn't answered is kept; the diagnostic shows it
                    raw = [f"error: {e}"] * len(b)
                yield b[["query_id", "batch_id"]].assign(raw=raw)

        said = asked.select("query_id", "batch_id", "prompt").mapInPandas(kernel, "query_id string, batch_id int, raw string").withColumn("p", parse_decisions(F.col("raw")))
        each = asked.select("query_id", "batch_id", F.explode("labels").alias("l")).join(said, ["query_id", "batch_id"], "left")
        return each.select("query_id", F.col("l.citation").alias("citation"), F.coalesce(F.col("p.decisions")[F.col("l.label")], F.lit("KEEP")).alias("decision"), F.coalesce("p.diagnostic", F.lit("")).alias("diagnostic"))

    first = one_pass(answer)
    return first if confirm is None else confirm_removals(first, one_pass(confirm), KEYS)


def window(ranked: DataFrame, first: int, last: int, size: int = 4) -> DataFrame:
    """Candidates between two ranks, in labelled batches; those outside aren't asked about."""
    return batches(ranked.where(F.col("rank").between(first, last)), ["query_id"], "rank", size)


def apply_decisions(ranked: DataFrame, decisions: DataFrame) -> DataFrame:
    """The ranking without what was removed, ranked anew."""
    left = ranked.join(decisions.where("decision = 'REMOVE'").select(*KEYS), KEYS, "left_anti")
    return left.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "citation")))
