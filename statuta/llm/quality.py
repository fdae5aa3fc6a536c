"""Per-document text quality statistics: associative partial counts of chunks, merged as a tree."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.plans.runtime import bounded_rows

#: Documents longer than this many characters are cut into chunks of about this length.
CHUNK = 32_768
#: Chunks merged at once by one step of the tree.
FAN_IN = 64
#: Levels of the tree: a value has at most 2^31 bytes, 65,536 chunks, which is 64 * 64 * 16.
LEVELS = 3

#: What is counted: characters by class; words; lines by looks; segments (sentences or what stands in their place).
SUMS = (
    "visible", "letters", "digits", "marks", "odd", "foreign", "braces", "words", "word_letters", "common", "vowelless", "hex", "long", "tokens", "repeated_tokens",
    "lines", "ended", "tabbed", "piped", "separated", "columns", "cells", "labels", "commas", "tags", "code", "sentences", "repeated", "items", "prose", "all_segments",
)
_AT = {n: i for i, n in enumerate(SUMS)}
_CHARS = SUMS[:7]
_LINE_FLAGS = SUMS[_AT["ended"] : _AT["code"] + 1]
#: What is measured of a segment; of a cut one, its parts add up, and the last part says whether it was ended.
_SEG = ("words", "visible", "common", "lines", "semicolons", "items", "cells", "ended", "leading_cells")

_ENUMERATOR = r"(?m)^[ \t]*(?:\(?([0-9]{1,3}(?:\.[0-9]{1,3})*|[a-zA-Z]|[ivxIVX]{2,4})[.)]+|[0-9]+(?:\.[0-9]+)+|[-*•–·▪>])[ \t]+"
#: Stands before a chunk that begins inside a line, where nothing is at the line's start.
_INSIDE = "\x04"
_ABBREVIATION = r"\b((?i:art|abs|lit|nr|vgl|cf|e|bst|ziff|ref|act|no|tab))\.([ \t])"
_LEADERS = r"\.{3,}|(?: \.){3,}"
_TERMINATOR = r"([.?!])([)\"»”']*)(\s+|$)"
_BREAK = r"\x01|\n[ \t\r]*\n"
_LINES = {
    "ended": r"[.!?:;»”\")]\s*$",
    "tabbed": r"\t.*\t|^\t|^\s*(?:[^\t]{4,}|[0-9']{3})\t",
    "piped": r"\|.*\||^[-+=|: ]{5,}$",
    "separated": r"^[^;]*;[^;\s]|^;|;;",
    "columns": r"\S {2,}\S.*\S {2,}\S|\S {2,}\S {2,}\S|\S {4,}\S",
    "cells": r"<t[dhr]\b",
    "labels": r"^\s*[\pL.]{2,20}: ?.{0,60}$",
    "commas": r"^[^,]*,[^,\s][^,]*,[^,\s]",
    "tags": r"</?[a-zA-Z]+\b[^>]*>",
    "code": r"[{}]\s*$|\)\s*\{|=>|==",
}
_VOWEL = r"[aeiouyäöüàâéèêëîïôûùìòœæ]"


def _char_classes() -> np.ndarray:
    """Class of each code point up to U+3000: 0 blank, 1 letter, 2 digit, 3 mark, 4 letter of another script than Latin,
    5 mark as scanning leaves it, 6 bracket of markup or data."""
    out = np.full(0x3001, 3, dtype=np.int64)
    for cp in range(0x3001):
        ch = chr(cp)
        if cp < 0x20 or ch.isspace() or cp in (0x200B, 0x200C, 0x200D, 0x2060):
            out[cp] = 0
        elif ch.isalpha():
            out[cp] = 1 if cp < 0x250 or 0x1E00 <= cp < 0x1F00 else 4
        elif ch.isdigit():
            out[cp] = 2
    for ch in "|~^¦§¬":
        out[ord(ch)] = 5
    for ch in "{}[]<":
        out[ord(ch)] = 6
    for cp in range(0x370, 0x400):  # unassigned places of the Greek block count as its letters
        out[cp] = 4
    return out


def _good(v: np.ndarray) -> np.ndarray:
    """A segment reads as a sentence: ended, of a sentence's length, with frequent words, without cells or entries."""
    words, common, items, cells, ended = v[..., 0], v[..., 2], v[..., 5], v[..., 6] - v[..., 8], v[..., 7]
    return (ended > 0) & (words >= 4) & (words <= 80) & (common >= 1) & (common >= 0.08 * words) & (items <= 1) & (cells == 0)


#: Hashes of cut tokens and segments are numbers modulo this prime, so that the hash of a whole comes from its parts.
_PRIME = (1 << 61) - 31


def _hash(text: str) -> tuple[int, int]:
    """``(hash, length)`` of a text; see :func:`_and_then`."""
    return int.from_bytes(text.encode("utf-32-be", "surrogatepass"), "big") % _PRIME, len(text)


def _and_then(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return (a[0] * pow(2, 32 * b[1], _PRIME) + b[0]) % _PRIME, a[1] + b[1]


def _line_flags(lines: pa.Array, there: np.ndarray) -> np.ndarray:
    if not len(lines):
        return np.zeros((0, len(_LINE_FLAGS)), bool)
    return np.stack([pc.match_substring_regex(lines, _LINES[name]).to_numpy(zero_copy_only=False) & there for name in _LINE_FLAGS], axis=1)


def _edges(parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each part is the first, and the last, of its text."""
    change = parents[1:] != parents[:-1]
    return (np.r_[True, change], np.r_[change, True]) if len(parents) else (np.zeros(0, bool), np.zeros(0, bool))


def _measure(texts: pa.Array, words: pa.Array, classes: np.ndarray, open_ends: bool) -> tuple[np.ndarray, list[dict]]:
    """Counts of each text. With ``open_ends``, the first and last token, segment and line are left open and come apart,
    as one state a text."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    sums = np.zeros((n, len(SUMS)))

    def put(name: str, parents: np.ndarray, weights: np.ndarray) -> None:
        sums[:, _AT[name]] += np.bincount(parents, weights=weights, minlength=n)[:n]

    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    kind = classes[np.minimum(chars, 0x3000)]
    by = np.bincount(np.repeat(np.arange(n), size) * 7 + kind, minlength=7 * n).reshape(n, 7)
    sums[:, _AT["visible"]] = by[:, 1:].sum(axis=1)
    for name, of in zip(_CHARS[1:], ((1, 4), (2,), (3, 5, 6), (5,), (4,), (6,))):
        sums[:, _AT[name]] = by[:, list(of)].sum(axis=1)

    tokens = pc.split_pattern_regex(texts, r"[\s\x0b\x1c-\x1f\x{85}\pZ]+")
    token, tp = tokens.flatten(), pc.list_parent_indices(tokens).to_numpy()
    tfirst, tlast = _edges(tp)
    tclosed = ~(tfirst | tlast) if open_ends else np.ones(len(token), bool)
    some = pc.utf8_length(token).to_numpy(zero_copy_only=False) * tclosed
    put("tokens", tp, some > 0)
    put("long", tp, some * (some >= 40))
    put("hex", tp, pc.match_substring_regex(token, _HEX).to_numpy(zero_copy_only=False) & tclosed)
    if len(token) > 1:
        same = pc.equal(token.slice(1), token.slice(0, len(token) - 1)).to_numpy(zero_copy_only=False) & ~tfirst[1:] & (some[1:] > 0) & tclosed[:-1]
        put("repeated_tokens", tp[1:], same)

    t = pc.replace_substring_regex(texts, _ENUMERATOR, "\x03\\1 ")
    t = pc.replace_substring_regex(t, _ABBREVIATION, r"\1\2")
    t = pc.replace_substring_regex(t, _LEADERS, " ")
    t = pc.replace_substring_regex(t, _TERMINATOR, "\\1\x02\x01")
    split = pc.split_pattern_regex(t, _BREAK)
    seg, sp = split.flatten(), pc.list_parent_indices(split).to_numpy()
    m = len(seg)
    parts = pc.split_pattern_regex(pc.utf8_lower(seg), r"[^\pL]+")
    word, wp = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
    length = pc.utf8_length(word).to_numpy(zero_copy_only=False)
    frequent = pc.is_in(word, value_set=words).to_numpy(zero_copy_only=False)
    flatless = ~pc.match_substring_regex(word, _VOWEL).to_numpy(zero_copy_only=False)
    owner = sp[wp] if len(wp) else wp
    put("words", owner, length > 0)
    put("word_letters", owner, length)
    put("common", owner, frequent)
    put("vowelless", owner, (length >= 3) & flatless)
    bare = pc.replace_substring_regex(seg, r"[\s\x00-\x1f]+", "")
    v = np.zeros((m, len(_SEG)))
    v[:, 0] = np.bincount(wp, weights=length >= 2, minlength=m)[:m]
    v[:, 1] = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    v[:, 2] = np.bincount(wp, weights=frequent, minlength=m)[:m]
    v[:, 3] = pc.count_substring_regex(seg, r"[^\s\x00-\x1f][^\n]*").to_numpy(zero_copy_only=False)
    v[:, 4] = pc.count_substring_regex(seg, r";\s").to_numpy(zero_copy_only=False)
    v[:, 5] = pc.count_substring(seg, "\x03").to_numpy(zero_copy_only=False)
    v[:, 6] = pc.count_substring_regex(seg, r"[\t|<]").to_numpy(zero_copy_only=False)
    v[:, 8] = v[:, 6] - pc.count_substring_regex(pc.replace_substring_regex(seg, r"^\s+", ""), r"[\t|<]").to_numpy(zero_copy_only=False)
    v[:, 7] = pc.ends_with(seg, "\x02").to_numpy(zero_copy_only=False)
    first, last = _edges(sp)
    closed = ~(first | last) if open_ends else np.ones(m, bool)
    good = _good(v)
    put("sentences", sp, good & closed)
    put("prose", sp, v[:, 1] * (good & closed))
    put("all_segments", sp, v[:, 1] * closed)
    put("items", sp, np.maximum(v[:, 3], v[:, 4]) * (~good & closed))
    if m > 1:
        again = pc.equal(bare.slice(1), bare.slice(0, m - 1)).to_numpy(zero_copy_only=False) & ~first[1:] & good[1:]
        put("repeated", sp[1:], again & closed[1:] & closed[:-1])

    rows = pc.split_pattern_regex(texts, r"\r?\n")
    line, lp = rows.flatten(), pc.list_parent_indices(rows).to_numpy()
    there = pc.match_substring_regex(line, r"[^\s\x04]").to_numpy(zero_copy_only=False)
    lfirst, llast = _edges(lp)
    lclosed = ~(lfirst | llast) if open_ends else np.ones(len(line), bool)
    put("lines", lp, there & lclosed)
    flags = _line_flags(line, there)
    for i, name in enumerate(_LINE_FLAGS):
        put(name, lp, flags[:, i] & lclosed)
    if not open_ends:
        return sums, []

    ends = np.cumsum(size)
    states = []
    for i, (ta, tz, sa, sz, la, lz) in enumerate(zip(*[np.flatnonzero(x) for x in (tfirst, tlast, first, last, lfirst, llast)])):
        inside = size[i] > 0 and chars[ends[i] - size[i]] == ord(_INSIDE)
        begin = ends[i] - size[i] + inside
        letter = [bool(size[i] > inside and kind[at] in (1, 4)) for at in (min(begin, len(chars) - 1), ends[i] - 1)]
        segment = lambda at: (v[at], _hash(bare[at].as_py()))  # noqa: B023, E731
        states.append(
            {
                "sums": sums[i], "inside": bool(inside), "letter": letter,
                "token": _stretch(ta, tz, lambda at: _token(token[at].as_py().removeprefix(_INSIDE))),  # noqa: B023
                "segment": _stretch(sa, sz, segment),
                "line": _stretch(la, lz, lambda at: (line[at].as_py().removeprefix(_INSIDE),)),  # noqa: B023
            }
        )
    return sums, states


_HEX = r"^[0-9a-f]{6,}$"


def _token(text: str) -> tuple[tuple[int, int], bool]:
    return _hash(text), all(ch in "0123456789abcdef" for ch in text)


def _stretch(a: int, z: int, part) -> dict:
    """What lies between two cuts: its first part, open to the left; its last, open to the right (none where it is the
    first too); the first and last of those between, which are whole."""
    return {"head": part(a), "tail": part(z) if z > a else None, "from": part(a + 1) if z > a + 1 else None, "to": part(z - 1) if z > a + 1 else None}


def _close_token(t: tuple, before: tuple | None, after: tuple | None, sums: np.ndarray) -> None:
    (h, size), hexadecimal = t
    if size:
        sums[_AT["tokens"]] += 1
        sums[_AT["long"]] += size * (size >= 40)
        sums[_AT["hex"]] += hexadecimal and size >= 6
        sums[_AT["repeated_tokens"]] += (before is not None and before[0] == t[0]) + (after is not None and after[0] == t[0])


def _close_segment(s: tuple, before: tuple | None, after: tuple | None, sums: np.ndarray) -> None:
    values, own = s
    good = bool(_good(values))
    sums[_AT["sentences"]] += good
    sums[_AT["prose"]] += values[1] * good
    sums[_AT["all_segments"]] += values[1]
    sums[_AT["items"]] += 0 if good else max(values[3], values[4])
    # equal ones are good alike, but for the end mark, which only the later one needs
    later = after is not None and after[1] == own and bool(_good(after[0]))
    sums[_AT["repeated"]] += (good and before is not None and before[1] == own) + later


def _close_line(parts: tuple, before: object, after: object, sums: np.ndarray) -> None:
    line = pa.array(["".join(parts)])
    there = pc.match_substring_regex(line, r"[^\s\x04]").to_numpy(zero_copy_only=False)
    sums[_AT["lines"]] += there[0]
    for name, flag in zip(_LINE_FLAGS, _line_flags(line, there)[0]):
        sums[_AT[name]] += flag


def _join_tokens(a: tuple, b: tuple, _: bool) -> tuple:
    return _and_then(a[0], b[0]), a[1] and b[1]


def _join_segments(a: tuple, b: tuple, same_line: bool) -> tuple:
    values = a[0] + b[0]
    values[3] -= same_line and a[0][3] > 0 and b[0][3] > 0  # the line that goes on over the cut was counted on both sides
    values[7] = b[0][7]
    values[8] -= b[0][8] * (a[0][1] > 0)  # no longer leading
    return values, _and_then(a[1], b[1])


_KINDS = {"token": (_join_tokens, _close_token), "segment": (_join_segments, _close_segment), "line": (lambda a, b, _: a + b, _close_line)}


def merge(a: dict, b: dict) -> dict:
    """The state of two neighbouring stretches of text, as if they had been measured as one; associative."""
    sums = a["sums"] + b["sums"]
    if a["letter"][1] and b["letter"][0]:
        sums[_AT["words"]] -= 1  # one word on both sides of the cut
    out = {"sums": sums, "inside": a["inside"], "letter": [a["letter"][0], b["letter"][1]]}
    for name, (join, close) in _KINDS.items():
        x, y = a[name], b[name]
        middle = join(x["tail"] if x["tail"] is not None else x["head"], y["head"], b["inside"])
        new = {"head": x["head"] if x["tail"] is not None else middle, "tail": y["tail"] if y["tail"] is not None else (middle if x["tail"] is not None else None)}
        if x["tail"] is not None and y["tail"] is not None:
            close(middle, x["to"], y["from"], sums)
            empty = name == "token" and not middle[0][1]
            if empty and x["to"] is not None and y["from"] is not None and x["to"][0] == y["from"][0]:
                sums[_AT["repeated_tokens"]] += 1
            whole = [p for p in (x["from"], None if empty else middle, y["from"]) if p is not None]
            ends = [p for p in (x["to"], None if empty else middle, y["to"]) if p is not None]
            new |= {"from": whole[0] if whole else None, "to": ends[-1] if ends else None}
        else:
            new |= {"from": x["from"] if x["tail"] is not None else y["from"], "to": y["to"] if y["tail"] is not None else x["to"]}
        out[name] = new
    return out


def finish(state: dict) -> np.ndarray:
    sums = state["sums"].copy()
    for name, (_, close) in _KINDS.items():
        x = state[name]
        close(x["head"], None, x["from"], sums)
        if x["tail"] is not None:
            empty = name == "token" and not x["head"][0][1]
            close(x["tail"], x["to"] if x["to"] is not None else None if empty else x["head"], None, sums)
    return sums


_STATE_SCHEMA = "doc_id long, no long, state binary"
_SUM_SCHEMA = "doc_id long, sums array<double>"


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), pa.float64()))


def _partial(words: list[str], chunked: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, known = _char_classes(), pa.array(words, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                b = batch.slice(at, 2_000)
                if not b.num_rows:
                    continue
                sums, states = _measure(b.column("text").cast(pa.string()), known, classes, chunked)
                if chunked:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("no"), pa.array([pickle.dumps(x) for x in states], pa.binary())], names=["doc_id", "no", "state"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(sums)], names=["doc_id", "sums"])

    return kernel


def _merged(pdf: pd.DataFrame) -> dict:
    state = None
    for raw in pdf.sort_values("no")["state"]:
        state = pickle.loads(raw) if state is None else merge(state, pickle.loads(raw))
    return state


def _merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "no": pdf["no"].iloc[:1] // FAN_IN, "state": [pickle.dumps(_merged(pdf))]})


def _finish_group(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"doc_id": pdf["doc_id"].iloc[0], "sums": finish(_merged(pdf)).tolist()}])


def _chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """``(doc_id, no, text)``: long texts cut into chunks of less than twice ``chunk`` characters; every character falls
    into exactly one. Of the ``chunk`` characters before a cut's place the last line's start is taken, of a line with
    something on it; without one, the last word's start; without one, the last place between a letter and a digit."""
    cuts = (r"(?s)^(.*\n)(?=[ \t\r]*\S)", r"(?s)^(.*\s)(?=[\pL\pN])", r"(?s)^(.*(?:\pL(?=\pN)|\pN(?=\pL)))")

    def cut(at: Column) -> Column:
        before = F.substr("text", at - chunk + 1, F.lit(chunk))
        found = [F.nullif(F.length(F.regexp_extract(before, c, 1)), F.lit(0)) for c in cuts]
        return F.when((at <= 0) | (at >= F.length("text")), at).otherwise(at - chunk + F.coalesce(*found, F.lit(chunk)))

    numbered = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))).alias("no"))
    begin, end = cut(F.col("no") * chunk), F.least(cut((F.col("no") + 1) * chunk), F.length("text"))
    out = numbered.select("doc_id", F.col("no").cast("long").alias("no"), "text", begin.cast("int").alias("b"), end.cast("int").alias("e"))
    inside = F.when((F.col("b") > 0) & (F.substr("text", F.col("b"), F.lit(1)) != "\n"), _INSIDE).otherwise("")
    return out.select("doc_id", "no", F.concat(inside, F.substr("text", F.col("b") + 1, F.col("e") - F.col("b"))).alias("text"))


def text_statistics(docs: DataFrame, words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``doc_id``, the counts of ``SUMS`` and the ratios made of them.

    ``docs``: ``doc_id`` (unique), ``text``; ``words``: ``word``, the frequent words of all languages, a fixed list of a
    few hundred. Documents up to ``chunk`` characters are measured where they lie, without any shuffle. Longer ones are
    cut, each chunk gives counts of what it holds whole and the state of what it cuts: the hash and measure of the open
    token and segment, the open line, and what lies next to them. Only these states move, merged ``FAN_IN`` at a time, in
    order, level by level until one is left. All counts are the same wherever the cuts fall; the one exception are runs
    of more than ``chunk`` characters without any blank, in which a single word may be cut. A line longer than a chunk is
    put together again where its end is known, so it travels as text; it is never more than its own document's row.
    Null and empty texts count as zero everywhere (ratios 0); null doc_ids are kept as they are for short texts and left
    out for long ones; repeated texts are measured each; other columns are left out.
    """
    known = sorted({r[0] for r in bounded_rows(words.where("word IS NOT NULL").select(F.lower("word")).distinct(), 10_000)})
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    short = docs.where(size <= chunk).mapInArrow(_partial(known, False), _SUM_SCHEMA)
    states = _chunks(docs.where((size > chunk) & F.col("doc_id").isNotNull()), chunk).mapInArrow(_partial(known, True), _STATE_SCHEMA)
    for _ in range(LEVELS - 1):
        states = states.groupBy("doc_id", F.floor(F.col("no") / FAN_IN).alias("node")).applyInPandas(_merge_group, _STATE_SCHEMA)
    sums = short.unionByName(states.groupBy("doc_id").applyInPandas(_finish_group, _SUM_SCHEMA))
    flat = sums.select("doc_id", *[F.col("sums")[i].alias(n) for n, i in _AT.items()])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return flat.withColumns(
        {
            "word_count": F.col("words").cast("long"), "mean_word_length": ratio("word_letters", "words"), "symbol_ratio": ratio("marks", "visible"),
            "ended_line_share": ratio("ended", "lines"), "common_word_share": ratio("common", "words"), "prose_share": ratio("prose", "all_segments"),
        }
    )


def document_kind() -> Column:
    """``list``, ``table``, ``junk`` or null (prose, or nothing there) for a row of :func:`text_statistics`."""
    c = F.col
    several = c("lines") >= 2
    cells = F.greatest(*[c(n) for n in ("tabbed", "piped", "separated", "columns", "cells", "commas")])
    ruined = (c("foreign") > 0.15 * c("letters")) | ((c("odd") > 0.06 * c("visible")) & ~(several & (c("piped") > 0.5 * c("lines"))))
    over_again = ((c("sentences") >= 3) & (c("repeated") >= 0.5 * c("sentences"))) | ((c("tokens") >= 8) & (c("repeated_tokens") >= 0.5 * c("tokens")))
    prose = (c("sentences") >= 1) & ((c("items") <= 2) | (c("items") <= 2 * c("sentences")) | (c("prose_share") >= 0.75))
    # scanning breaks the ends of sentences in running text, which has frequent words all the same
    damaged = ~several & (c("odd") > 0) & (c("common") >= 0.2 * c("words")) & (c("words") > 0)
    markup = ((c("tags") > 0.5 * c("lines")) & (c("cells") < 0.5 * c("tags"))) | (c("code") > 0.4 * c("lines"))
    table = (several & (cells >= 0.5 * c("lines"))) | ((c("lines") >= 3) & (c("labels") >= 0.6 * c("lines")))
    unreadable = (
        (c("letters") < 0.2 * c("visible")) | (c("vowelless") > 0.3 * c("words")) | (c("hex") > 0.4 * c("tokens")) | (c("long") > 0.4 * c("visible"))
        | (c("braces") > 0.05 * c("visible")) | (~several & (c("words") >= 8) & (c("common") == 0))
    )
    listed = several | (c("items") >= 3)
    return (
        F.when(c("visible") == 0, None).when(ruined | over_again, "junk").when(prose | damaged, None).when(markup, "junk").when(table, "table").when(unreadable, "junk").when(listed, "list")
    )


def document_weight() -> Column:
    """Weight of a document in a mix, from a row of :func:`text_statistics`: prose by its share of sentences and of common
    words, a half of it for lists and tables, little for junk and texts with nothing in them."""
    prose = 0.4 + 0.4 * F.col("prose_share") + 0.2 * F.least(F.lit(1.0), 3 * F.col("common_word_share"))
    kind = document_kind()
    return F.when((F.col("visible") == 0) | (kind == "junk"), 0.05).when(kind.isNotNull(), 0.5 * prose).otherwise(prose)
