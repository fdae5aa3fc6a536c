"""Broken prompt and response pairs: ordered rules, every defect that a rule finds."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.plans.runtime import bounded_rows

#: A refusal is the whole answer: what follows its first sentence is no longer than that sentence times the first number
#: plus the second, in characters. A longer answer says something else.
FOLLOWS = (1, 200)
ORDER = ("empty", "refusal", "copy", "language", "truncated")

# What stands for nothing, and how a model declines in four languages.
PLACEHOLDERS = {"", "null", "none", "nan", "n/a", "na", "nil", "tbd", "todo", "tba", "undefined", "unknown", "empty", "leer", "keine", "kein", "vide", "vuoto", "placeholder", "platzhalter", "translation", "übersetzung", "text", "xxx"}
REFUSALS = re.compile(
    r"\bI(?:'m| am)? (?:sorry,? but I )?(?:can ?not|can't|could not|couldn't|won't|will not|am not able|am unable|not able|unable|must decline|have to decline|decline|do not feel|refuse)\b"
    r"|\bmy guidelines\b|\bas an? (?:ai|large|language)\b|\bagainst (?:my|our) (?:guidelines|policy|policies)\b|\bunable to (?:help|assist|comply|translate|provide)\b|\b(?:can't|cannot|can not) (?:help|assist|comply) with\b"
    r"|\bje (?:ne (?:peux|suis|saurais|pourrai)|dois (?:refuser|décliner)|regrette)\b|\bmes (?:directives|consignes)\b|\ben tant que modèle\b|\bil m'est impossible\b"
    r"|\b(?:non posso|non sono in grado|devo rifiutare|devo declinare|mi dispiace)\b|\ble mie (?:linee|direttive)\b|\bcome modello\b|\bin quanto modello\b",
    re.I,
)
# Beginnings and, anywhere behind them in the same clause, ends of German refusals.
REFUSALS_IN_TWO = [
    (re.compile(r"\bich (?:kann|darf|werde|muss|möchte|bin|sehe mich)\b", re.I), re.compile(r"\b(?:nicht|kein\w*|ablehnen|ausserstande|außerstande)\b", re.I)),
    (re.compile(r"\b(?:kann|darf|werde|muss|bin|sehe) ich (?:mich |dazu |diese\w* |leider |die |das |hier |dabei |keine?\w* )", re.I), re.compile(r"\b(?:nicht|kein\w*|ablehnen|ausserstande|außerstande|anbieten|geben)\b", re.I)),
    (re.compile(r"\b(?:kann|darf|muss|sehe) ich\b", re.I), re.compile(r"\b(?:nicht|keine?\w*|ablehnen|ausserstande|außerstande)\b", re.I)),
    (re.compile(r"\bmeine\w* richtlinien\b|\bals (?:ki|sprachmodell|ki-modell)\b", re.I), re.compile("")),
]
_LABEL = re.compile(r"[^:\n\"“«{\[]{2,70}:[*_]*(?=\s|$)\s*")
_LABEL_WORDS = re.compile(r"(?i)deutsch|german|übersetz|uebersetz|translat|query|anfrage|antwort|answer|response|result|ergebnis|output|ausgabe|json|object|hier|here|voici|ecco|tedesc|allemand|traduc|traduz")
_ABBREVIATED = re.compile(r"(?i)\b(?:abs|art|nr|lit|bst|ziff|vgl|bzw|resp|sog|bd|rz|inkl|ca|gem|i\.v\.m|d\.h|z\.b|u\.a|f|ff)\.$")
_QUOTES = {"«": "»", "“": "”", "„": "“", '"': '"', "'": "'", "‹": "›", "”": "”", "»": "«"}
_LANGUAGE_NOTES = ("(german)", "(deutsch)", "(allemand)", "(tedesco)")
_FENCE = re.compile(r"^\s*(?:```|~~~)[ \t]*[\w-]*[ \t]*\n?")
_WORD = re.compile(r"[^\W\d_]+")


def unwrap(text: str) -> tuple[str, bool]:
    """The text without fences, labels, lead-ins and enclosing quotation marks, and whether something that was opened
    isn't closed."""
    t, open_ = text.strip(), False
    while True:
        before = t
        if m := _FENCE.match(t):
            t = t[m.end() :]
            end = re.search(r"(?:```|~~~)\s*$", t)
            open_ |= end is None
            t = (t[: end.start()] if end else t).strip()
        m = _LABEL.match(t)
        if m and len(m.group().split()) <= 8 and _LABEL_WORDS.search(m.group()):
            t = t[m.end() :].strip()
        for note in _LANGUAGE_NOTES:
            if t[-len(note) :].lower() == note:
                t = t[: -len(note)].rstrip()
        if len(t) >= 2 and t[0] in _QUOTES and t[-1] == _QUOTES[t[0]]:
            t = t[1:-1].strip()
        elif t in _QUOTES:
            t = ""
        if t == before:
            break
    return t, open_


def is_nothing(text: str) -> bool:
    bare = text.replace("\u200b", "").replace("\ufeff", "").strip("[](){}<>*_.…\"'«»“”„`- \t\r\n\u00a0").lower()
    return bare in PLACEHOLDERS or not re.search(r"\w", bare)


def is_refusal(text: str) -> bool:
    """A refusal is what the answer says, not what somebody says in it: its first sentence declines, and not much follows
    (``FOLLOWS``). Sentences of any length are read whole."""
    t = text.replace("’", "'")
    end = re.search(r"[.!?](?=\s|$)", t)
    first = t[: end.end()] if end else t
    return len(t) - len(first) < FOLLOWS[0] * len(first) + FOLLOWS[1] and declines(first)


def declines(sentence: str) -> bool:
    """In time linear in the sentence: the first beginning of a refusal reaches as far as any later one."""
    if REFUSALS.search(sentence):
        return True
    for clause in re.split(r"[.!?]", sentence):
        for begin, end in REFUSALS_IN_TWO:
            if (m := begin.search(clause)) and end.search(clause, m.end()):
                return True
    return False


def copies(query: str, text: str) -> bool:
    """The text begins as the query does for most of its words, or most of its word triples stand in the query."""
    a, q = _WORD.findall(text.lower()), _WORD.findall(query.lower())
    if len(a) < 3 or not q:
        return bool(a) and " ".join(a) == " ".join(q)
    prefix = next((i for i, (x, y) in enumerate(zip(a, q)) if x != y), min(len(a), len(q)))
    if prefix >= 3 and prefix >= 0.6 * len(a):
        return True
    triples = set(zip(q, q[1:], q[2:]))
    own = list(zip(a, a[1:], a[2:]))
    return sum(x in triples for x in own) >= 0.6 * len(own)


def foreign(text: str, words: dict[str, set[str]], target: str) -> bool:
    """Frequent words of another language clearly outnumber those of the target language, or the script is another."""
    letters = [c for c in text if c.isalpha()]
    if len(letters) >= 10 and sum(c < "ɐ" for c in letters) < 0.5 * len(letters):
        return True
    tokens = _WORD.findall(text.lower())
    hits = {lang: sum(w in known for w in tokens) for lang, known in words.items()}
    other = max((n for lang, n in hits.items() if lang != target), default=0)
    return other > 1.3 * hits.get(target, 0) and other > 0


def breaks_off(text: str, open_: bool) -> bool:
    t = text.rstrip()
    note = t.rfind("(") if t.endswith(")") else -1
    if note > 0 and ")" not in t[note:-1]:  # a note behind the end
        t = t[:note].rstrip() or t
    if open_ or t.endswith(("…", "...", "..")):
        return True
    t = t.rstrip("»”“\"'›*_)] ")
    return bool(t) and (t[-1] not in ".?!" or bool(_ABBREVIATED.search(t)))


def _strings(x: object) -> list[str]:
    if isinstance(x, str):
        return [x]
    if isinstance(x, dict):
        return [s for v in x.values() for s in _strings(v)]
    return [s for v in x for s in _strings(v)] if isinstance(x, list) else []


def text_defects(query: str, answer: str | None, words: dict[str, set[str]], target: str) -> set[str]:
    t, open_ = unwrap(answer or "")
    if is_nothing(t):
        return {"empty"}
    checks = {"refusal": is_refusal(t), "copy": copies(query, t), "language": foreign(t, words, target), "truncated": breaks_off(t, open_)}
    if checks["copy"]:
        checks["language"] = False
    return {k for k, v in checks.items() if v}


def object_defects(query: str, answer: str | None, words: dict[str, set[str]], target: str, list_key: str, text_key: str) -> set[str]:
    """Defects of an answer that should be an object with a list of parts, each with a text."""
    t, open_ = unwrap(answer or "")
    if is_nothing(t):
        return {"empty"}
    begin = min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return text_defects(query, t, words, target) or {"truncated"}
    try:
        value, end = json.JSONDecoder(strict=False).raw_decode(t[begin:])
    except (ValueError, RecursionError):
        return {"truncated"} | ({"refusal"} if is_refusal(t) and '"' + text_key not in t else set())
    parts = value.get(list_key) if isinstance(value, dict) else value
    if isinstance(parts, str):
        return text_defects(query, parts, words, target)
    parts = parts if isinstance(parts, list) else [parts] if isinstance(parts, dict) else []
    texts = [p.get(text_key) if isinstance(p, dict) else p for p in parts]
    texts = [unwrap(x)[0] for x in texts if isinstance(x, str)]
    texts = [x for x in texts if not is_nothing(x)]
    if not texts:
        said = [s for s in _strings(value) if not is_nothing(s)]
        return {"refusal"} if any(is_refusal(s) for s in said) else {"empty"}
    out = {"truncated"} if open_ else set()
    if all(is_refusal(x) for x in texts):
        out.add("refusal")
    copied = sum(copies(query, x) for x in texts)
    if 2 * copied >= len(texts):
        out.add("copy")
    elif 2 * sum(foreign(x, words, target) for x in texts) >= len(texts):
        out.add("language")
    return out


def find_defects(pairs: DataFrame, words: DataFrame, target: str = "de", list_key: str = "sub_issues", text_key: str = "search_query_de") -> DataFrame:
    """``(id, fld, defect, priority)``: every defect of every pair, ``priority`` 0 for the one that comes first.

    ``pairs``: ``id``, ``fld``, ``query``, ``answer``, ``is_object``; ``words``: ``lang``, ``word``, a fixed list of a
    few hundred frequent words. Rules, in order: nothing said; declined; the query repeated; another language; broken
    off. One pass over the rows, without a shuffle; whole texts are read, whatever their length. A null answer is
    empty, a null query can't be copied; repeated rows stay; further columns are left out.
    """
    known: dict[str, set[str]] = {}
    for r in bounded_rows(words.where("lang IS NOT NULL AND word IS NOT NULL").select(F.lower("lang").alias("lang"), F.lower("word").alias("word")).distinct(), 10_000):
        known.setdefault(r["lang"], set()).add(r["word"])

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, fld, query, answer, is_object in zip(b["id"], b["fld"], b["query"], b["answer"], b["is_object"]):
                query = query if isinstance(query, str) else ""
                answer = answer if isinstance(answer, str) else None
                got = object_defects(query, answer, known, target, list_key, text_key) if is_object else text_defects(query, answer, known, target)
                out += [(i, fld, d, n) for n, d in enumerate(x for x in ORDER if x in got)]
            yield pd.DataFrame(out, columns=["id", "fld", "defect", "priority"])

    return pairs.select("id", "fld", "query", "answer", "is_object").mapInPandas(kernel, "id long, fld string, defect string, priority int")
