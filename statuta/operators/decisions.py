"""KEEP and REMOVE decisions of a model, read and applied with caution. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import let

CHOICES = ("KEEP", "REMOVE")
#: Labels a broken answer is searched for.
LABELS = ("A", "B", "C", "D")


def _body(raw: Column) -> Column:
    """The answer without the lines of a fence around it."""
    lines = F.split(F.trim(F.coalesce(raw, F.lit("")), F.lit(" \t\r\n")), "\n")
    fence = lambda i: F.coalesce(F.trim(F.get(lines, i), F.lit(" \t\r")).startswith("```"), F.lit(False))
    first, last = fence(F.lit(0)).cast("int"), (fence(F.size(lines) - 1) & (F.size(lines) > 1)).cast("int")
    inner = F.array_join(F.slice(lines, first + 1, F.greatest(F.size(lines) - first - last, F.lit(0))), "\n")
    return F.regexp_replace(inner, r"\s*```\s*$", "")


def _whole_list(body: Column) -> Column:
    """The outermost brackets and what is between them, or all where there are none."""
    begin, behind = F.instr(body, "["), F.instr(F.reverse(body), "]")
    end = F.length(body) - behind + 1
    return F.when((begin > 0) & (behind > 0) & (end > begin), F.substr(body, begin, end - begin + 1)).otherwise(body)


def _scan(body: Column) -> Column:
    """Decisions of an answer that can't be parsed: its ``label`` and ``decision`` fields are read one after the other; a
    decision belongs to the label that waits for one, and a label waits until it has one."""
    field = lambda i: F.regexp_extract_all(body, F.lit('"(label|decision)"\\s*:\\s*"([A-Z]+)"'), F.lit(i))
    fields = F.arrays_zip(field(1).alias("name"), field(2).alias("value"))
    start = F.struct(F.lit("").alias("waiting"), F.array().cast("array<struct<label:string,decision:string>>").alias("said"))

    def step(s: Column, f: Column) -> Column:
        label = (f["name"] == "label") & (s["waiting"] == "") & f["value"].isin(*LABELS)
        decided = (f["name"] == "decision") & (s["waiting"] != "") & f["value"].isin(*CHOICES)
        pair = F.array(F.struct(s["waiting"].alias("label"), f["value"].alias("decision")))
        return F.struct(F.when(label, f["value"]).when(decided, "").otherwise(s["waiting"]).alias("waiting"), F.when(decided, F.concat(s["said"], pair)).otherwise(s["said"]).alias("said"))

    return F.aggregate(fields, start, step)["said"]


def _last_wins(said: Column) -> Column:
    """``MAP<label, decision>``: of several decisions on a label the last."""
    each = lambda labels: F.transform(labels, lambda label: F.struct(label, F.element_at(F.filter(said, lambda x: x["label"] == label), -1)["decision"]))
    return F.map_from_entries(let(F.array_distinct(F.transform(said, lambda x: x["label"])), each))


def parse_decisions(raw: Column) -> Column:
    """``STRUCT<decisions MAP<STRING, STRING>, diagnostic STRING>`` of a raw answer.

    A proper answer is a JSON list of objects with ``label`` and ``decision``; its diagnostic is empty. Labels and
    decisions count without case and blanks, unknown decisions are left out, the last on a label wins. An answer that
    is no JSON (``json_decode_error``) or no list (``json_root_not_list``) is searched for fields; if that finds any,
    the diagnostic says so (``..._regex_fallback``). A null or empty answer decides nothing.
    """
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), _whole_list(_body(raw)), F.lit("]"))), "$", "array<variant>")
    value = F.when(F.size(wrapped) == 1, F.get(wrapped, F.lit(0)))
    text = lambda x, n: F.upper(F.trim(F.coalesce(F.try_variant_get(x, f"$.{n}", "string"), F.lit("")), F.lit(" \t\r\n")))

    def read(v: Column) -> Column:
        is_list = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
        listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(text(x, "label").alias("label"), text(x, "decision").alias("decision")))
        proper = F.filter(listed, lambda x: (x["label"] != "") & x["decision"].isin(*CHOICES))
        reason = F.when(v.isNull(), "json_decode_error").otherwise("json_root_not_list")
        found = lambda said: F.struct(_last_wins(said).alias("decisions"), F.when(F.size(said) > 0, F.concat(reason, F.lit("_regex_fallback"))).otherwise(reason).alias("diagnostic"))
        return F.when(is_list, let(proper, lambda p: F.struct(_last_wins(p).alias("decisions"), F.lit("").alias("diagnostic")))).otherwise(let(_scan(_body(raw)), found))

    return let(value, read)


def confirm_removals(first: DataFrame, second: DataFrame, keys: list[str], decision: str = "decision") -> DataFrame:
    """First decisions, of which a removal stands only if the second pass says so too; a missing one keeps."""
    again = second.select(*keys, F.col(decision).alias("__second"))
    both = first.join(again, keys, "left")
    removed = (F.col(decision) == "REMOVE") & F.coalesce(F.col("__second") == "REMOVE", F.lit(False))
    return both.withColumn(decision, F.when(removed, "REMOVE").otherwise("KEEP")).drop("__second")


def removal_quality(rows: DataFrame, gold: str, removed: str, sent: str | None = None) -> DataFrame:
    """One row: candidates, gold and noise among them, removal rates of both, and ``noise rate - 3 * gold rate``; with
    ``sent``, the rates among the rows sent to the model too."""
    g, x = F.coalesce(F.col(gold), F.lit(False)), F.coalesce(F.col(removed), F.lit(False))
    count = lambda c: F.count_if(c)
    rate = lambda a, b: F.when(count(b) > 0, count(a & b) / count(b)).otherwise(0.0)
    aggs = [F.count("*").alias("candidates"), count(g).alias("gold"), count(~g).alias("noise"), count(x).alias("removed"), rate(x, g).alias("gold_removal_rate"), rate(x, ~g).alias("noise_removal_rate"), (rate(x, ~g) - 3 * rate(x, g)).alias("balance")]
    if sent:
        s = F.coalesce(F.col(sent), F.lit(False))
        aggs += [count(s).alias("sent"), rate(x, g & s).alias("sent_gold_removal_rate"), rate(x, ~g & s).alias("sent_noise_removal_rate")]
    return rows.agg(*aggs)
