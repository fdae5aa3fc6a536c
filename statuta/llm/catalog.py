"""Queries of the subpackage and, where SQL can say it, their equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.citations import parse_citation
from statuta.llm.mixing import mix, source_name
from statuta.llm.names import map_names
from statuta.llm.packing import pack
from statuta.llm.pairs import find_defects
from statuta.llm.quality import document_kind, document_weight, text_statistics
from statuta.llm.tokens import count_tokens
from statuta.llm.topn import top_n
from statuta.llm.vectors import nearest, pairs
from statuta.operators.packed import split_packed
from statuta.plans.runtime import bounded_rows, materialise, read_table

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best citations of every query."""
    return top_n(read_table(spark, d, "ranked_citation", "query_id", "citation", "score"), "query_id", "citation", "score", 5).select("query_id", "citation")


@query
def p6_positions(spark: SparkSession, d: str) -> DataFrame:
    """The same with score and position, only for the results listed in ``pipeline_result``."""
    top = top_n(read_table(spark, d, "ranked_citation", "query_id", "citation", "score"), "query_id", "citation", "score", 5)
    return top.join(read_table(spark, d, "pipeline_result", "query_id"), "query_id", "left_semi").select("query_id", "citation", F.round("score", 6).alias("score"), "position")


_TOP = """
SELECT query_id, citation, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, citation DESC) AS position
FROM (SELECT query_id, citation, max(score) AS s FROM ranked_citation
      WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND citation IS NOT NULL GROUP BY 1, 2)
"""
ORACLES["p6_found"] = f"SELECT query_id, citation FROM ({_TOP}) WHERE position <= 5"
ORACLES["p6_positions"] = f"SELECT query_id, citation, round(score, 6) AS score, position FROM ({_TOP}) WHERE position <= 5 AND query_id IN (SELECT query_id FROM pipeline_result)"


# Single marks stand alone: with a letter or digit before the first or after the last they are apostrophes, and so are those
# between two letters or digits inside.
_SINGLE = "|".join(rf"(?<![\pL\pN]){a}[^{z}]++(?:(?<=[\pL\pN])[{z}](?=[\pL\pN])[^{z}]++)*+[{z}](?![\pL\pN])" for a, z in (("'", "'"), ("‘", "’"), ("‚", "‘’"), ("‹", "›")))
_ENCLOSED = r"«([^»]+)»|“([^”]+)”|„([^“”]+)[“”]|\"([^\"]+)\"|\(([^)]+)\)|\[([^\]]+)\]|" + _SINGLE


def _statute_names(spark: SparkSession, d: str) -> DataFrame:
    """``(test_id, entry_no, name)`` of every statute name typed in ``pre_citations`` and ``query``."""
    test = read_table(spark, d, "test", "test_id", "query", "pre_citations")
    items = split_packed(test.withColumn("src", F.lit("pre_citations")), "pre_citations", "src", ["test_id"])
    cited = items.select("test_id", F.col("pos").alias("entry_no"), parse_citation(F.col("item"))["book"].alias("name"))
    enclosed = F.regexp_extract_all("query", F.lit(_ENCLOSED), 0)
    named = test.select("test_id", F.lit(0).cast("long").alias("entry_no"), F.get(enclosed, F.lit(0)).alias("n")).where("n IS NOT NULL")
    return cited.unionByName(named.select("test_id", "entry_no", F.expr("substring(n, 2, length(n) - 2)").alias("name")))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The statute that each typed name means, or ``unmatched``."""
    reference = read_table(spark, d, "domains", "book_code", "title", "book_description").toDF("code", "title", "name")
    return map_names(_statute_names(spark, d), "name", ["test_id", "entry_no"], reference).withColumnRenamed("code", "book_code")


@query
def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The unmatched values with the number of times each was typed."""
    names = _statute_names(spark, d)
    reference = read_table(spark, d, "domains", "book_code", "title", "book_description").toDF("code", "title", "name")
    out = map_names(names, "name", ["name"], reference).where("code = 'unmatched'")
    return out.groupBy("name").agg(F.count("*").alias("n"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    test = read_table(spark, d, "test", "test_id", "query", "german_translation", "decomposed_queries_raw")
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("fld"), F.col(c).alias("answer"), F.lit(c == "decomposed_queries_raw").alias("is_object")) for c in ("german_translation", "decomposed_queries_raw")])).alias("a")
    return test.select(F.col("test_id").alias("id"), "query", both).select("id", "query", "a.*")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each broken answer with its defect: the first in the order of the rules."""
    found = find_defects(_answers(spark, d), read_table(spark, d, "common_words"))
    return found.where("priority = 0").select(F.col("id").alias("test_id"), "fld", "defect")


@query
def p5_all(spark: SparkSession, d: str) -> DataFrame:
    """Every defect that any rule finds, counted per field."""
    return find_defects(_answers(spark, d), read_table(spark, d, "common_words")).groupBy("fld", "defect").agg(F.count("*").alias("n"))


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_statistics(read_table(spark, d, "documents", "doc_id", "text"), read_table(spark, d, "common_words", "word"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are no natural prose, with their kind."""
    return _statistics(spark, d).select("doc_id", document_kind().alias("kind")).where("kind IS NOT NULL")


@query
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document."""
    ratios = ("mean_word_length", "symbol_ratio", "ended_line_share", "common_word_share")
    return _statistics(spark, d).select("doc_id", "word_count", *[F.round(c, 6).alias(c) for c in ratios])


@query
def p9_words(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of words only."""
    return _statistics(spark, d).select("doc_id", "word_count", *[F.round(c, 9).alias(c) for c in ("mean_word_length", "common_word_share")])


ORACLES["p9_words"] = r"""
SELECT d.doc_id, coalesce(n, 0) AS word_count, round(coalesce(w.letters::DOUBLE / n, 0), 9) AS mean_word_length, round(coalesce(w.common::DOUBLE / n, 0), 9) AS common_word_share
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, sum(length(word)) AS letters, count(*) FILTER (word IN (SELECT lower(word) FROM common_words)) AS common
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\pL+')) AS word FROM documents) GROUP BY 1) w USING (doc_id)
"""


_COLLECTIONS = {"laws_db": ("law_id", "embedding"), "test_sub_query_zembed": ("sub_row_id", "zembed_embedding")}


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of most similar vectors of both collections."""
    parts = [pairs(nearest(read_table(spark, d, t, i, v), i, v)).select(F.lit(t).alias("collection"), "id_a", "id_b") for t, (i, v) in _COLLECTIONS.items()]
    return parts[0].unionByName(parts[1])


@query
def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest laws of every law whose id is divisible by 100, among all laws."""
    near = nearest(read_table(spark, d, "laws_db", "law_id", "embedding"), "law_id", "embedding")
    return near.where("id % 100 = 0").select(F.col("id").alias("law_id"), "other", "cos")


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    rows = bounded_rows(read_table(spark, d, "pack_sizes", "pack_name", "capacity_tokens").where("pack_name IS NOT NULL AND capacity_tokens > 0").orderBy("pack_name"), 100)
    return {r["pack_name"]: r["capacity_tokens"] for r in rows}


@query
def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every text in containers of each capacity: three plans. Texts are routed to the tiers of the plan's capacity, its
    half and its quarter; the longest tier is packed first and its containers' gaps are filled from the shorter ones."""
    docs = read_table(spark, d, "documents", "doc_id", "text")
    plans = {n: sorted({max(1, c // 4), max(1, c // 2), c}) for n, c in _capacities(spark, d).items()}
    return pack(materialise(count_tokens(docs, "text", ["doc_id"])), plans, one_size=True).withColumnRenamed("plan", "pack_name")


@query
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are, and how evenly the step groups are loaded."""
    boxes = p7_packed(spark, d).groupBy("pack_name", "capacity", "step", "container").agg(F.sum("tokens").alias("n"))
    steps = boxes.groupBy("pack_name", "capacity", "step").agg(F.count("*").alias("boxes"), F.sum("n").alias("n"))
    full = F.sum("n") / (F.sum("boxes") * F.col("capacity"))
    return steps.groupBy("pack_name", "capacity").agg(F.sum("boxes").alias("containers"), F.sum("n").alias("tokens"), F.round(full, 6).alias("fill"), F.round(F.min(F.col("n") / (F.col("boxes") * F.col("capacity"))), 6).alias("emptiest_step"))


@query
def p7_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Every text once, in the smallest capacity that holds it or in the gap of a larger container."""
    docs = read_table(spark, d, "documents", "doc_id", "text")
    return pack(materialise(count_tokens(docs, "text", ["doc_id"])), {"all": list(_capacities(spark, d).values())}).drop("plan")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, d, "documents", "doc_id", "text", "source")
    targets = read_table(spark, d, "mix_targets", "source", "target_share", "max_repeats")
    wanted = F.broadcast(targets.select(source_name(F.col("source")).alias("s")).distinct())  # at most MOST_SOURCES names
    docs = docs.withColumn("s", source_name(F.col("source"))).join(wanted, "s", "left_semi")
    docs = docs.withColumn("identity", F.concat_ws("-", F.xxhash64("text").cast("string"), F.hash("text").cast("string"), F.length("text").cast("string")))
    sized = count_tokens(docs, "text", ["doc_id", "source", "identity"])
    quality = text_statistics(docs.select("doc_id", "text"), read_table(spark, d, "common_words", "word")).select("doc_id", document_weight().alias("weight"))
    return mix(sized.join(quality, "doc_id", "left"), targets)


@query
def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The chosen texts with their repeats."""
    return _mix(spark, d)[0]


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of the total that each source really has."""
    return _mix(spark, d)[1].withColumns({c: F.round(c, 6) for c in ("target_share", "actual_share")})
