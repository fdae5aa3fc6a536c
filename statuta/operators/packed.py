"""Several values packed in one field: infer the delimiters, split, explode with position."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidate delimiters: name and the (Java) pattern that finds them.
CANDIDATES: tuple[tuple[str, str], ...] = (
    ("semicolon", ";"),
    ("pipe", r"\|"),
    ("line", r"\r?\n"),
    ("tab", r"\t"),
    ("slash", r"\s/\s"),
    ("comma", ","),
)
#: Start of a citation: its article word and a number.
CITATION_START = r"(?i:art(?:icle|ikel)?)\.?[\s\u00a0]*\d"

_PADS = " \t\r\n\u00a0;|,/[]"
_BLANKS = " \t\r\n\u00a0"


@dataclass(frozen=True)
class SplitSpec:
    """How to recognise the pieces of a packed field.

    ``item_start`` is the pattern a regular piece begins with. A candidate delimiter is accepted for a source if, over
    all records of the source with the same set of candidates in them, at least ``min_score`` of the pieces after it
    are regular, and for a single record if in it all of them are.
    """

    item_start: str = CITATION_START
    min_score: float = 0.02
    candidates: tuple[tuple[str, str], ...] = CANDIDATES


def _regular(piece: Column, spec: SplitSpec) -> Column:
    return piece.rlike(rf"^[\s\u00a0;|,/\[\"']*{spec.item_start}")


def _after(text: Column, pattern: str) -> Column:
    """Pieces after the first delimiter that have something in them."""
    pieces = F.split(text, pattern)
    return F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.trim(p, F.lit(_PADS + "\"'")) != "")


def _measured(df: DataFrame, text: str, spec: SplitSpec) -> DataFrame:
    """Adds for each candidate the number of pieces after it and of the regular ones, and the set of candidates found."""
    cols = {}
    for name, pattern in spec.candidates:
        after = _after(F.col(text), pattern)
        cols[f"__n_{name}"] = F.size(after)
        cols[f"__r_{name}"] = F.size(F.filter(after, lambda p: _regular(p, spec)))
    df = df.withColumns(cols)
    return df.withColumn("__habit", F.concat(*[F.when(F.col(f"__n_{n}") > 0, "1").otherwise("0") for n, _ in spec.candidates]))


def delimiter_scores(df: DataFrame, text: str, source: str, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """The report behind the split: ``(source, habit, delimiter, records, pieces, regularity, consistency, accepted)``.

    ``habit`` tells records apart by the set of candidates in them, so a source that packs in several ways is scored
    for each. ``regularity`` is the share of regular pieces after the delimiter, ``consistency`` the share of records
    in which their number equals the number of pieces. One small aggregate, at most 2^candidates rows a source.
    Null and blank texts count nowhere; an empty table gives no rows.
    """
    m = _measured(df.select(F.col(source).alias("source"), F.col(text).alias("__t")).where(F.col("__t").isNotNull()), "__t", spec)
    aggs = [F.count("*").alias("records")]
    for n, _ in spec.candidates:
        aggs += [F.sum(f"__n_{n}").alias(f"n_{n}"), F.sum(f"__r_{n}").alias(f"r_{n}"), F.sum(F.when((F.col(f"__n_{n}") > 0) & (F.col(f"__n_{n}") == F.col(f"__r_{n}")), 1).otherwise(0)).alias(f"c_{n}")]
    per = m.groupBy("source", F.col("__habit").alias("habit")).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("delimiter"), F.col(f"n_{n}").alias("pieces"), F.col(f"r_{n}").alias("regular"), F.col(f"c_{n}").alias("consistent")) for n, _ in spec.candidates]))
    out = per.select("source", "habit", "records", rows.alias("d")).select("source", "habit", "records", "d.*").where("pieces > 0")
    return out.select(
        "source", "habit", "delimiter", "records", "pieces", (F.col("regular") / F.col("pieces")).alias("regularity"), (F.col("consistent") / F.col("records")).alias("consistency"),
        (F.col("regular") / F.col("pieces") >= spec.min_score).alias("accepted"),
    )


def _clean(piece: Column) -> Column:
    """A piece without pads and enclosing marks; a doubled enclosing mark inside an enclosed piece stands for one."""
    p = F.trim(piece, F.lit(_PADS))

    def unwrap(mark: str) -> Column:
        inner = F.substring(p, F.lit(2), F.length(p) - 2)
        return F.replace(inner, F.lit(mark * 2), F.lit(mark))

    def odd(mark: str) -> Column:
        return (F.length(p) - F.length(F.replace(p, F.lit(mark), F.lit("")))) % 2 == 1

    out = F.when(F.length(p) < 2, p)
    for mark in ('"', "'"):
        out = out.when(p.startswith(mark) & p.endswith(mark), unwrap(mark))
    for mark in ('"', "'"):  # a mark without its partner encloses nothing
        out = out.when(p.startswith(mark) & odd(mark), F.substring(p, F.lit(2), F.length(p)))
        out = out.when(p.endswith(mark) & odd(mark), F.substring(p, F.lit(1), F.length(p) - 1))
    return F.trim(out.otherwise(p), F.lit(_BLANKS))


def split_packed(df: DataFrame, text: str, source: str, keep: list[str], spec: SplitSpec = SplitSpec()) -> DataFrame:
    """One row per packed value: ``keep``, ``pos`` (from 1, empty values do not count) and ``item``.

    The delimiters of each source are inferred first (:func:`delimiter_scores`, joined back as a few rows a source). A
    text is then cut at an accepted delimiter wherever a regular piece follows, so that a delimiter inside a value
    stays in it. Everything runs inside the JVM; the only shuffle is the small aggregate.
    Null, blank and valueless texts give no rows; repeated values stay; other columns of ``df`` are left out, whatever
    their names.
    """
    base = df.select(*keep, F.col(source).alias("__source"), F.col(text).alias("__t")).where(F.col("__t").isNotNull())
    m = _measured(base, "__t", spec)
    scores = delimiter_scores(df, text, source, spec).where("accepted").groupBy("source", "habit").agg(F.collect_set("delimiter").alias("__ok"))
    m = m.join(scores.select(F.col("source").alias("__s2"), F.col("habit").alias("__h2"), "__ok"), F.col("__source").eqNullSafe(F.col("__s2")) & (F.col("__habit") == F.col("__h2")), "left")
    chosen = [
        F.when((F.col(f"__n_{n}") > 0) & (F.coalesce(F.array_contains("__ok", n), F.lit(False)) | (F.col(f"__n_{n}") == F.col(f"__r_{n}"))), F.lit(p)) for n, p in spec.candidates
    ]
    cut = F.concat(F.lit("(?:"), F.concat_ws("|", *chosen), F.lit(rf")[\s\u00a0;|,/]*+(?=[\"'\[]*{spec.item_start})"))
    some = reduce(lambda a, b: a | b, [c.isNotNull() for c in chosen])
    pieces = F.when(some, F.split(F.col("__t"), cut)).otherwise(F.array("__t"))
    items = F.filter(F.transform(pieces, lambda p: F.regexp_extract(_clean(p), rf"(?s){spec.item_start}.*", 0)), lambda p: p != "")
    return m.select(*keep, F.posexplode(items).alias("__p", "item")).select(*keep, (F.col("__p") + 1).cast("long").alias("pos"), "item")
