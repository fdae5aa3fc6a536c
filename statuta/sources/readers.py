"""Where rows come from."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.text import sub_issue_text, sub_issues

CORPUS_JSON = "query STRUCT<query_id: STRING, text: STRING, gold_citations: ARRAY<STRING>>, documents ARRAY<STRUCT<citation: STRING, text: STRING, keywords: ARRAY<STRING>, neighbors: ARRAY<STRING>>>"
LAWS = "citation STRING, document STRING, embedding ARRAY<FLOAT>, references STRING, source_book STRING, target_books STRING"
COURTS = "citation STRING, document STRING, law_references STRING, court_references STRING, embedding ARRAY<FLOAT>"
CONSIDERATIONS = "citation STRING, text STRING"
CACHE = "query_id STRING, citation STRING, model STRING, score DOUBLE"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; quoted fields may span lines and double their quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV or Parquet by extension; any other is an error."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in (".parquet", ".pq"):
        return spark.read.parquet(path)
    if kind == ".csv":
        if schema is None:
            raise ValueError("a CSV file needs a schema")
        return read_csv(spark, path, schema)
    raise ValueError(f"unsupported file type: {path}")


def read_first(spark: SparkSession, path: str, schema: str, order: str, rows: int) -> DataFrame:
    """The first rows of a CSV by an ordering column."""
    return read_csv(spark, path, schema).orderBy(order).limit(rows)


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(queries, documents)`` of a JSON file; documents keep their place as ``doc_ord`` from 0, missing lists are
    empty."""
    raw = spark.read.schema(CORPUS_JSON).option("multiLine", True).json(path)
    none = F.array().cast("array<string>")
    docs = raw.select(F.posexplode("documents").alias("doc_ord", "d"))
    documents = docs.select("doc_ord", "d.citation", "d.text", F.coalesce("d.keywords", none).alias("keywords"), F.coalesce("d.neighbors", none).alias("neighbors"))
    return raw.select("query.query_id", "query.text", F.coalesce("query.gold_citations", none).alias("gold_citations")), documents


def read_procedural_books(spark: SparkSession, path: str) -> DataFrame:
    """``book``: the lines inside the fences of a markdown file, without comments, batch heads and the prefix ``proc``."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)```\w*\n(.*?)```"), F.lit(1))).alias("block"))
    line = lines.select(F.explode(F.split("block", r"\r?\n")).alias("line")).select(F.trim("line").alias("line")).where("line <> ''")
    named = line.where(~F.col("line").startswith("#") & ~F.lower("line").startswith("batch"))
    return named.select(F.trim(F.regexp_replace("line", r"(?i)^proc\s+", "")).alias("book")).distinct()


def read_score_cache(spark: SparkSession, path: str, model: str) -> DataFrame:
    """``query_id, citation, score`` of one model; scores that are no numbers are left out, of repeated ones the largest
    stays."""
    cached = read_table(spark, path, CACHE).where((F.col("model") == model) & F.col("score").isNotNull() & ~F.isnan("score"))
    return cached.groupBy("query_id", "citation").agg(F.max("score").alias("score"))


def submission_rows(df: DataFrame) -> DataFrame:
    """``query_id, citation, rank`` of a submission, wide (``predicted_citations``) or long (``citation`` with a rank)."""
    from statuta.functions.text import split_list

    if "predicted_citations" in df.columns:
        return df.select("query_id", F.posexplode(F.array_distinct(split_list(F.col("predicted_citations")))).alias("p", "citation")).select("query_id", "citation", (F.col("p") + 1).alias("rank"))
    rank = next((c for c in ("rank", "rank_position", "original_rank") if c in df.columns), None)
    if rank is None or "citation" not in df.columns:
        raise ValueError("neither predicted_citations nor citation with a rank")
    return df.select("query_id", "citation", F.col(rank).cast("int").alias("rank"))


def sub_queries(df: DataFrame, query: str, raw: str) -> DataFrame:
    """``query, sub_id, sub_query``: the parts of decomposition answers, numbered as the answer does or by place."""
    parts = df.select(query, F.posexplode(sub_issues(F.col(raw))).alias("p", "s"))
    return parts.select(query, F.coalesce("s.id", F.col("p") + 1).cast("long").alias("sub_id"), sub_issue_text(F.col("s")).alias("sub_query")).where("sub_query IS NOT NULL")


def fill_template(template: str, values: dict[str, str]) -> str:
    """A prompt template with its ``{{marker}}`` places filled; an unknown marker stays."""
    for name, value in values.items():
        template = template.replace("{{" + name + "}}", value)
    return template
