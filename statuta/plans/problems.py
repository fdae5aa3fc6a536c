"""Queries of the general data problems (p1, p4) over the statute tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.citations import book_stem, citation_key, parse_citation, write_citation
from statuta.operators.orphans import count_orphans, find_orphans
from statuta.operators.packed import delimiter_scores, split_packed
from statuta.plans.runtime import read_table


def _packed_fields(spark: SparkSession, d: str) -> DataFrame:
    laws = read_table(spark, d, "laws_db", "law_id", "references").select(F.lit("references").alias("fld"), F.col("law_id").alias("row_id"), F.col("references").alias("text"))
    test = read_table(spark, d, "test", "test_id", "pre_citations", "pre_near_matches")
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("fld"), F.col(c).alias("text")) for c in ("pre_citations", "pre_near_matches")])).alias("f")
    return laws.unionByName(test.select(F.col("test_id").alias("row_id"), both).select("f.fld", "row_id", "f.text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per citation packed in a field, with its position."""
    return split_packed(_packed_fields(spark, d), "text", "fld", ["fld", "row_id"]).select("fld", "row_id", "pos", "item")


def p4_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """What the split of each field rests on: the score of each candidate delimiter."""
    return delimiter_scores(_packed_fields(spark, d), "text", "fld").select(F.col("source").alias("fld"), "habit", "delimiter", "records", "pieces", F.round("regularity", 6).alias("regularity"), F.round("consistency", 6).alias("consistency"), "accepted")


def _law_references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    laws = read_table(spark, d, "laws_db", "law_id", "citation", "references", "loaded_at", "repealed_at")
    items = split_packed(laws.withColumn("src", F.lit("references")), "references", "src", ["law_id", "loaded_at"])
    parsed = items.withColumn("c", parse_citation(F.col("item"))).where("c IS NOT NULL")
    refs = parsed.select("law_id", F.col("loaded_at").alias("at"), citation_key(F.col("c")).alias("key"), book_stem(F.col("c.book")).alias("book"), F.struct("c.*").alias("c"))
    refs = refs.groupBy("law_id", "key").agg(F.min(F.struct("at", "book", "c")).alias("r")).select("law_id", "key", "r.*")
    records = laws.withColumn("c", parse_citation(F.col("citation"))).select(citation_key(F.col("c")).alias("key"), F.col("loaded_at").alias("arrives"), F.col("repealed_at").alias("ends")).where("key IS NOT NULL AND key <> ''")
    return refs, records


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each law row and citation in its references that is missing, deleted or late."""
    refs, records = _law_references(spark, d)
    codes = read_table(spark, d, "domains", "book_code").select("book_code", F.lower("book_code").alias("code")).groupBy("code").agg(F.min("book_code").alias("book_code"))
    found = find_orphans(refs, records).withColumn("code", F.lower("book")).join(codes, "code", "left")
    return found.select("law_id", write_citation(F.col("c"), F.coalesce("book_code", "book")).alias("ref"), "kind")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month of ``loaded_at``."""
    refs, records = _law_references(spark, d)
    return count_orphans(refs.select("key", "at"), records, "laws_db")


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p4_found": p4_found, "p4_delimiters": p4_delimiters}
