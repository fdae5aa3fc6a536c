"""Free-entered values mapped to a canonical list: a trie of all ways to write an entry, searched with a Levenshtein
automaton."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of the reference list held in one trie; longer lists are searched in blocks of this many.
BLOCK = 20_000

# The kinds of statutes and how they are written in German and English, in full and cut short.
KINDS = {
    "act": (("gesetz", "ges"), ("act",)),
    "ordinance": (("verordnung", "vo", "verord"), ("ordinance", "ord")),
    "regulation": (("reglement", "regl"), ("regulation", "reg")),
}


def allowed(length: int) -> int:
    """Edits allowed for a name of so many letters: none for codes, then one more for every five or so letters."""
    return 0 if length < 6 else 1 if length < 8 else 2 if length < 12 else 3 if length < 17 else 4


def fold(c: Column) -> Column:
    """A name reduced to what tells names apart: lower-case letters without accents, spacing, marks and footnotes."""
    c = F.translate(F.lower(c), "äöüàâéèêëîïôûùçß", "aouaaeeeeiiouucs")
    c = F.regexp_replace(F.regexp_replace(c, "[^a-z]", ""), "([aou])e", "$1")
    return c


def _fold(s: str) -> str:
    import re

    s = s.lower().translate(str.maketrans("äöüàâéèêëîïôûùçß", "aouaaeeeeiiouucs"))
    return re.sub("([aou])e", r"\1", re.sub("[^a-z]", "", s))


def aliases(code: str | None, title: str | None, name: str | None) -> dict[str, list[tuple[str, str]]]:
    """All alias paths of a statute: by code; by kind as ``(kind, written)``, for its own kind and the others.

    The paths of the other kinds are no names of this statute. They stand in the trie as decoys, so that a statute of
    another kind on the same subject isn't taken for this one.
    """
    out: dict[str, list[tuple[str, str]]] = {"code": [("", code)] if code else [], "paths": []}
    german = english = own = None
    for kind, (de, en) in KINDS.items():
        if title and _fold(title).endswith(de[0]):
            own, german = kind, _fold(title)[: -len(de[0])]
        if name and _fold(name).endswith(en[0]):
            own, english = kind, _fold(name)[: -len(en[0])]
    for kind, (de, en) in KINDS.items():
        for k in de:
            if german:
                out["paths"] += [(kind, german + k), (kind, "eidg" + german + k)]
        for k in en:
            if english:
                out["paths"] += [(kind, english + k), (kind, k + english), (kind, k + "on" + english), (kind, "federal" + k + "on" + english), (kind, "federal" + english + k)]
    if own is None:
        out["paths"] = [("", _fold(x)) for x in (title, name) if x]
    out["own"] = own or ""
    return out


class Trie:
    """Words with values, as flat arrays: nodes by level, so that the child of edge ``e`` is node ``e + 1``; some ten
    bytes a node. All words within ``k`` edits (insertion, deletion, exchange, swap of neighbours) of a name are found by
    walking trie and automaton together."""

    def __init__(self, values: dict[str, set[str]]) -> None:
        words = sorted(w for w in values if w)
        self.at_root = sorted(values.get("", ()))
        lengths = np.array([len(w) for w in words], dtype=np.int32)
        table = np.zeros((len(words), int(lengths.max(initial=0))), np.uint32)
        for i, w in enumerate(words):
            table[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        node = np.zeros(len(words), np.int32)  # where each word has got to
        new, letters, parents, ends = np.zeros(len(words), bool), [], [], np.zeros(len(words), np.int32)
        total = 1
        for j in range(table.shape[1]):
            change = np.r_[True, table[1:, j] != table[:-1, j]] if len(words) else new
            new = new | change
            there = lengths > j
            first = new & there
            letters.append(table[first, j])
            parents.append(node[first])
            node = np.where(there, total - 1 + np.cumsum(first), node).astype(np.int32)
            total += int(first.sum())
            ends = np.where(lengths == j + 1, node, ends)
        edges = np.concatenate([np.zeros(0, np.uint32), *letters])
        above = np.concatenate([np.zeros(0, np.int32), *parents])
        low, high = np.full(total, 1 << 20, np.int32), np.zeros(total, np.int32)
        low[ends] = 0
        at = total
        for level in reversed(parents):  # how many letters may follow: from the leaves up
            own = np.arange(at - len(level), at)
            np.minimum.at(low, level, low[own] + 1)
            np.maximum.at(high, level, high[own] + 1)
            at -= len(level)
        begin = np.searchsorted(above, np.arange(total + 1))
        self.letters = [chr(c) for c in np.unique(edges)]
        self.edges = array("H", np.searchsorted(np.unique(edges), edges).astype(np.uint16).tobytes())
        self.begin, self.low, self.high = (array("i", x.astype(np.int32).tobytes()) for x in (begin, low, high))
        order = np.argsort(ends, kind="stable")
        self.ends, self.values = array("i", ends[order].astype(np.int32).tobytes()), [sorted(values[words[i]]) for i in order]

    def within(self, name: str, k: int) -> list[tuple[str, int]]:
        """``(value, edits)`` of all words in reach.

        The automaton's state is ``k + 1`` bit sets, one per number of edits: bit ``i`` stands for ``i`` letters of the
        name read. Places from which no word below could end in time are taken out; a branch is left when none is left.
        """
        n, full = len(name), (1 << (len(name) + 1)) - 1
        chars: dict[str, int] = {}
        for i, ch in enumerate(name):
            chars[ch] = chars.get(ch, 0) | (1 << i)
        masks = [chars.get(ch, 0) for ch in self.letters]
        start, reach = [], 1
        for _ in range(k + 1):
            start.append(reach)
            reach |= (reach << 1) & full
        found: dict[str, int] = {v: n for v in self.at_root if n <= k}
        stack = [(0, start, [0] * (k + 1))]
        begin, edges, low, high = self.begin, self.edges, self.low, self.high
        while stack:
            node, state, swap = stack.pop()
            for edge in range(begin[node], begin[node + 1]):
                mask, child = masks[edges[edge]], edge + 1
                first, last = n - high[child] - k, n - low[child] + k
                bits = ((state[0] & mask) << 1) & full
                new = [bits]
                for e in range(1, k + 1):
                    before = state[e - 1]
                    bits = (((state[e] & mask) << 1) | before | (before << 1) | (bits << 1) | ((swap[e - 1] & mask) << 2)) & full
                    new.append(bits)
                inside = ((1 << (last + 1)) - 1 if last < n else full) if last >= 0 else 0
                if first > 0:
                    inside = inside >> first << first
                if not bits & inside:
                    continue
                if low[child] == 0:
                    for e in range(k + 1):
                        if new[e] >> n & 1:
                            for v in self.values[bisect_left(self.ends, child)]:
                                found[v] = min(found.get(v, e), e)
                            break
                # a swap begins where the letter read is the one after next in the name
                stack.append((child, new, [s & (mask >> 1) for s in state]))
        return list(found.items())


def _trie(rows: list[dict]) -> Trie:
    values: dict[str, set[str]] = {}
    decoys, own = set(), set()
    for r in rows:
        a = aliases(r["title"] and r["code"], r["title"], r["name"])
        for kind, w in [*(("code", _fold(w)) for _, w in a["code"]), *a["paths"]]:
            if kind in ("code", a["own"]):
                own.add(w)
                values.setdefault(w, set()).add(r["code"])
            else:
                decoys.add(w)
    for w in decoys - own:
        values.setdefault(w, set()).add("")
    return Trie(values)


_BUILT: dict[int, Trie] = {}


def _built(block: list[dict]) -> Trie:
    """The trie of a block, kept for the next task of the same worker."""
    key = hash(tuple((r["code"], r["title"], r["name"]) for r in block))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = _trie(block)
    return _BUILT[key]


def _blocks(reference: DataFrame) -> Iterator[list[dict]]:
    """The reference list in blocks of ``BLOCK`` entries, read once in order; one block is held at a time."""
    block: list[dict] = []
    for r in reference.select("code", "title", "name").where("code IS NOT NULL").distinct().orderBy("code", "title", "name").toLocalIterator():
        block.append(r.asDict())
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def search(names: DataFrame, reference: DataFrame) -> DataFrame:
    """All entries of ``reference(code, title, name)`` within reach of each folded name of ``names(name)``: ``(name,
    code, edits)``; ``code`` is empty for a decoy. An empty name or list gives no rows.

    The reference list is taken in blocks of ``BLOCK`` entries, so a trie's size is bounded whatever the list's length; a
    Python worker builds it once. Names are dealt to as many tasks as the session has shuffle partitions: they are small,
    the search isn't. (By a hash of their own: by the name itself they lie already, and the planner would leave it out.)
    """
    spark = names.sparkSession
    dealt = names.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), F.xxhash64("name"))
    out = None
    for block in _blocks(reference):

        def kernel(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            for batch in batches:
                trie = _built(block)
                yield pd.DataFrame([(name, v, e) for name in batch["name"] for v, e in trie.within(name, allowed(len(name)))], columns=["name", "code", "edits"])

        part = dealt.mapInPandas(kernel, "name string, code string, edits int")
        out = part if out is None else out.unionByName(part)
    return names.sparkSession.createDataFrame([], "name string, code string, edits int") if out is None else out


def map_names(df: DataFrame, value: str, keep: list[str], reference: DataFrame) -> DataFrame:
    """``keep`` with ``code``: the entry that ``value`` means, or ``unmatched``.

    ``reference``: ``code``, ``title``, ``name`` (null parts give no alias). A code in brackets behind a name settles it
    if the name itself can't. Names are searched once each, whatever the number of rows that have them. Of the entries
    in reach the nearest wins; if several are as near, none does, and likewise if the nearest is a statute of another
    kind. Null and blank values are unmatched; repeated rows stay; long values are compared whole.
    """
    tail = F.regexp_extract(F.col("__v"), r"\(\s*([^()]*)\s*\)\s*$", 1)
    head = F.regexp_replace(F.col("__v"), r"\(\s*[^()]*\s*\)\s*$", "")
    rows = df.select(*keep, F.col(value).alias("__v")).select(*keep, F.coalesce(fold(head), F.lit("")).alias("__head"), F.coalesce(fold(tail), F.lit("")).alias("__tail"))
    names = rows.select(F.explode(F.array("__head", "__tail")).alias("name")).where("name <> ''").distinct()
    hits = search(names, reference)
    least = hits.groupBy("name").agg(F.min(F.struct("edits")).alias("m"), F.collect_set(F.struct("edits", "code")).alias("all"))
    # a name written exactly is no decoy, even if the trie of another block holds it as one
    best = least.select("name", F.filter("all", lambda x: (x["edits"] == F.col("m.edits")) & ((x["edits"] > 0) | (x["code"] != "")))["code"].alias("codes"))
    best = best.select("name", F.when((F.size("codes") == 1) & (F.col("codes")[0] != ""), F.col("codes")[0]).alias("code")).where("code IS NOT NULL")
    one, two = (best.select(F.col("name").alias(n), F.col("code").alias(c)) for n, c in (("__head", "__c1"), ("__tail", "__c2")))
    out = rows.join(one, "__head", "left").join(two, "__tail", "left")
    return out.select(*keep, F.coalesce("__c1", "__c2", F.lit("unmatched")).alias("code"))
