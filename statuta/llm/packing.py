"""Filling fixed-capacity containers with items, over several container sizes at once."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items packed together in one task; a larger share leaves less unused space, a smaller one less to a task.
SHARE = 25_000
#: Containers in one step group.
STEP = 8


def fill(sizes: np.ndarray, capacities: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Container of each item, and the containers' capacities.

    Items come largest first. Each goes where it leaves the least space among all open containers, whatever their
    capacity, so the gaps of long containers are filled from the shorter tiers; where none has room, a container of the
    item's own tier is opened. The open gaps are bits of one number, so the best fit is found in one step.
    """
    where = np.zeros(len(sizes), dtype=np.int64)
    opened: list[int] = []
    by_gap: dict[int, list[int]] = {}
    gaps = 0
    for i in np.lexsort((np.arange(len(sizes)), -sizes)):
        size = int(sizes[i])
        room = gaps >> size
        if room:
            gap = size + (room & -room).bit_length() - 1
            at = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, at = int(capacities[i]), len(opened)
            opened.append(gap)
        where[i] = at
        left = gap - size
        by_gap.setdefault(left, []).append(at)
        gaps |= 1 << left
    return where, opened


def steps(fills: np.ndarray, capacities: np.ndarray, step: int = STEP) -> np.ndarray:
    """Step group of each container: groups hold containers of one capacity and about equally many tokens (dealt out
    from the fullest, there and back)."""
    out = np.zeros(len(fills), dtype=np.int64)
    begin = 0
    for c in sorted(set(capacities.tolist()), reverse=True):
        mine = np.flatnonzero(capacities == c)
        mine = mine[np.argsort(-fills[mine], kind="stable")]
        groups = max(1, ceil(len(mine) / step))
        turn = np.arange(len(mine)) % (2 * groups)
        out[mine] = begin + np.where(turn < groups, turn, 2 * groups - 1 - turn)
        begin += groups
    return out


def _pack_share(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
    where, opened = fill(pdf["tokens"].to_numpy(), pdf["opens"].to_numpy())
    capacity = np.array(opened, dtype=np.int64)
    step = steps(np.bincount(where, weights=pdf["tokens"], minlength=len(opened)), capacity)
    base = int(pdf["share"].iloc[0]) << 32
    return pd.DataFrame({"plan": pdf["plan"], "container": base + where, "capacity": capacity[where], "step": base + step[where], "doc_id": pdf["doc_id"], "piece": pdf["piece"], "first_token": pdf["first_token"], "tokens": pdf["tokens"]})


_SCHEMA = "plan string, container long, capacity long, step long, doc_id long, piece long, first_token long, tokens long"


def pack(sizes: DataFrame, plans: dict[str, list[int]], total: int | None = None, one_size: bool = False) -> DataFrame:
    """One row per text or piece: ``plan, container, capacity, step, doc_id, piece, first_token, tokens``.

    ``sizes``: ``doc_id``, ``tokens``; ``plans``: for each plan the context sizes of its tiers, which are the capacities
    its containers may have, or, with ``one_size``, all tiers go into containers of the largest; ``total``: about
    how many pieces a plan has; without it they are counted, for which ``sizes`` is read twice. In every plan each text is put into exactly one container, whole; only a text longer
    than the largest capacity is cut, into full pieces and a rest. A text is routed to the smallest tier that holds it,
    the tiers are packed from the longest on, gaps being filled from the shorter ones, and containers of one capacity
    are dealt into step groups of even load. Shares of about ``SHARE`` items, mixed by hash, are packed independently,
    so only numbers move, a few bytes an item, and no task grows with the data; a share leaves a few containers partly
    filled. Texts without tokens, null counts included, are placed too, at size 0. Null ids are one more id; repeated
    texts are packed each; an empty table gives no rows.
    """
    bad = [c for caps in plans.values() for c in caps if not c or c < 1]
    if bad or any(not caps for caps in plans.values()):
        raise ValueError("capacities must be positive")
    rows = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    names = list(plans)
    if total is None:
        counted = rows.agg(*[F.sum(F.greatest(F.ceil(F.col("tokens") / max(plans[n])), F.lit(1))).alias(f"n{i}") for i, n in enumerate(names)]).first()
    shares = {n: max(1, ceil((total if total is not None else counted[i] or 0) / SHARE)) for i, n in enumerate(names)}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("plan"), F.array(*[F.lit(c).cast("long") for c in sorted(caps)]).alias("caps"), F.lit(shares[n]).alias("shares")) for n, caps in plans.items()])).alias("p")
    planned = rows.select("doc_id", "tokens", each).select("doc_id", "tokens", "p.plan", "p.caps", "p.shares").withColumn("most", F.array_max("caps"))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("tokens") / F.col("most")) - 1, F.lit(0)).cast("long"))
    cut = planned.select("*", F.explode(pieces).alias("piece"))
    size: Column = F.least(F.col("most"), F.col("tokens") - F.col("piece") * F.col("most"))
    items = cut.select("plan", "doc_id", "piece", (F.col("piece") * F.col("most")).alias("first_token"), F.greatest(size, F.lit(0)).alias("tokens"), "caps", "shares")
    routed = items.withColumn("opens", F.array_max("caps") if one_size else F.filter("caps", lambda c: c >= F.col("tokens"))[0]).drop("caps")
    shared = routed.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.col("shares"))).drop("shares")
    return shared.groupBy("plan", "share").applyInPandas(_pack_share, _SCHEMA)
