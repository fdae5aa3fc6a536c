"""All core queries by name, with their SQL equivalents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import text as t
from statuta.functions import vectors as v
from statuta.functions.citations import citation_key, parse_citation
from statuta.operators import cooccurrence as co
from statuta.operators import decisions as dec
from statuta.operators import evaluation as ev
from statuta.operators import extraction as ex
from statuta.operators import graph as g
from statuta.operators import incremental as inc
from statuta.operators import lexical as lx
from statuta.operators import scores as sc
from statuta.operators import selection as sel
from statuta.operators.dense import dense_rrf_lists, dense_rrf_top, dense_top_k
from statuta.operators.diversify import mmr
from statuta.operators.packed import split_packed
from statuta.plans import cascade_blocks
from statuta.plans import court_retrieval as cr
from statuta.plans import equivalents as eq
from statuta.plans import law_cascade as lc
from statuta.plans import problems
from statuta.plans import rerank as rr
from statuta.plans.pipeline import run_pipeline
from statuta.plans.runtime import materialise, read_table
from statuta.sources import readers, sinks

QUERIES = dict(problems.QUERIES)
ORACLES: dict[str, str] = {"p1_found": eq.P1_FOUND, "p1_report": eq.P1_REPORT}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


r6 = lambda c, name=None: F.round(c, 6).alias(name or (c if isinstance(c, str) else None))

# ---------------------------------------------------------------- shared pieces

_MENTION = r"Art\. [0-9]+[a-z]*(?: Abs\. [0-9]+[a-z]*)? [A-ZÄÖÜ][A-Za-zÄÖÜäöü]+"


def _gold(s: SparkSession, d: str) -> DataFrame:
    """``(doc, item)``: a question as a document that cites its gold citations."""
    return read_table(s, d, "test", "test_id", "gold_citations").select(F.col("test_id").alias("doc"), F.explode(t.split_list(F.col("gold_citations"))).alias("item"))


_GOLD = "SELECT DISTINCT test_id AS doc, trim(x) AS item FROM (SELECT test_id, unnest(string_split(gold_citations, ';')) AS x FROM test) WHERE trim(x) <> ''"


def _law_refs(s: SparkSession, d: str) -> DataFrame:
    laws = read_table(s, d, "laws_db", "citation", "references")
    return laws.select(F.col("citation").alias("src"), F.explode(F.regexp_extract_all("references", F.lit(_MENTION), F.lit(0))).alias("dst"))


_EDGES = f"""SELECT DISTINCT e.src, e.dst FROM (SELECT citation AS src, unnest(regexp_extract_all("references", '{_MENTION}')) AS dst FROM laws_db) e
WHERE e.src <> e.dst AND e.dst IN (SELECT citation FROM laws_db)"""


def _edges(s: SparkSession, d: str) -> DataFrame:
    return g.edges(_law_refs(s, d), "src", "dst", read_table(s, d, "laws_db", "citation"))


def _whole_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges by every hand-kept reference, however spelled, to every spelling of its citation; ``_edges`` takes the
    canonical form only, as the SQL does."""
    laws = read_table(s, d, "laws_db", "citation", "references")
    key = lambda c: F.when(parse_citation(c).isNotNull(), citation_key(parse_citation(c)))
    items = split_packed(laws.where("citation IS NOT NULL").withColumn("field", F.lit("references")), "references", "field", ["citation"])
    refs = items.select(F.col("citation").alias("src"), key(F.col("citation")).alias("own"), key(F.col("item")).alias("k")).distinct()
    known = laws.select(F.col("citation").alias("dst"), key(F.col("citation")).alias("k")).where("k IS NOT NULL").distinct()
    return g.edges(refs.where("own IS NULL OR own <> k").join(known, "k"), "src", "dst")


def _scored(s: SparkSession, d: str) -> DataFrame:
    """One row per query and citation with finite scores, the best of each."""
    rc = read_table(s, d, "ranked_citation", "query_id", "citation", "score", "lexical_score", "rrf_score", "graph_score")
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    rc = rc.where("query_id IS NOT NULL AND citation IS NOT NULL")
    return rc.groupBy("query_id", "citation").agg(*[F.max(clean(c)).alias(c) for c in ("score", "lexical_score", "rrf_score", "graph_score")])


_SCORED = "SELECT query_id, citation, " + ", ".join(f"max(CASE WHEN NOT isnan({c}) THEN {c} END) AS {c}" for c in ("score", "lexical_score", "rrf_score", "graph_score")) + " FROM ranked_citation WHERE query_id IS NOT NULL AND citation IS NOT NULL GROUP BY 1, 2"


def _ranked(s: SparkSession, d: str, n: int | None = None) -> DataFrame:
    rows = _scored(s, d).where("score IS NOT NULL").select("query_id", "citation", "score")
    return sc.ranks(rows, ["query_id"], F.col("score").desc(), F.col("citation").desc()) if n is None else sc.top_k(rows, ["query_id"], n, F.col("score").desc(), F.col("citation").desc())


_RANKED = f"SELECT query_id, citation, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation DESC) AS rank FROM ({_SCORED}) WHERE score IS NOT NULL"

_UNIT = lambda c: f"list_transform({c}::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product({c}::DOUBLE[], {c}::DOUBLE[])), 1e-12))"
_FINE = lambda c: f"({c} IS NOT NULL AND len({c}) = 64 AND len(list_filter({c}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({c}, lambda x: x <> 0)) > 0)"
_LAWS_V = f"SELECT citation, {_UNIT('embedding')} AS v FROM laws_db WHERE citation IS NOT NULL AND {_FINE('embedding')}"
_SUBS_V = f"SELECT sub_row_id, query_id, {_UNIT('zembed_embedding')} AS v FROM test_sub_query_zembed WHERE {_FINE('zembed_embedding')}"


def _dense(left: str, key: str, right: str, item: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT {key}, {item}, cos, row_number() OVER (PARTITION BY {key} ORDER BY cos DESC, {item} DESC) AS rank FROM
(SELECT q.{key}, c.{item}, max(round(list_dot_product(q.v, c.v), 6)) AS cos FROM ({left}) q, ({right}) c GROUP BY 1, 2)) WHERE rank <= {k}"""


# ---------------------------------------------------------------- scans, projections, text

_SPLIT = """SELECT test_id, citation, row_number() OVER (PARTITION BY test_id ORDER BY p) AS pos FROM (SELECT test_id, trim(x) AS citation, min(i) AS p FROM
(SELECT test_id, unnest(string_split(gold_citations, ';')) AS x, generate_subscripts(string_split(gold_citations, ';'), 1) AS i FROM test) WHERE trim(x) <> '' GROUP BY 1, 2)"""


@query("SELECT law_id, coalesce(citation, '') AS citation, coalesce(source_book, '') AS source_book FROM laws_db")
def scan_pruned(s, d):
    laws = read_table(s, d, "laws_db", "law_id", "citation", "source_book")
    return laws.select("law_id", t.blank_if_null(F.col("citation")).alias("citation"), t.blank_if_null(F.col("source_book")).alias("source_book"))


@query(_SPLIT)
def list_split_dedupe(s, d):
    rows = read_table(s, d, "test", "test_id", "gold_citations")
    return rows.select("test_id", F.posexplode(F.array_distinct(t.split_list(F.col("gold_citations")))).alias("p", "citation")).select("test_id", "citation", (F.col("p") + 1).cast("long").alias("pos"))


_FORM = r"^Art\.\s*(\S+)(?:\s+Abs\.\s*(\S+))?\s+(\S.*)$"


@query(f"SELECT law_id, regexp_extract(citation, '{_FORM}', 1) AS art, regexp_extract(citation, '{_FORM}', 2) AS abs, regexp_extract(citation, '{_FORM}', 3) AS book FROM laws_db WHERE regexp_matches(citation, '{_FORM}')")
def citation_key_parse(s, d):
    return read_table(s, d, "laws_db", "law_id", "citation").withColumn("p", t.citation_parts(F.col("citation"))).where("p IS NOT NULL").select("law_id", "p.*")


@query(r"""SELECT law_id, coalesce(try_cast(regexp_extract(citation, 'Art\.\s*(\d+)', 1) AS BIGINT) * 10000 + coalesce(try_cast(regexp_extract(citation, 'Abs\.\s*(\d+)', 1) AS BIGINT), 0), 10000000) AS sort_key FROM laws_db""")
def citation_sort_keys(s, d):
    return read_table(s, d, "laws_db", "law_id", "citation").select("law_id", t.citation_sort_key(F.col("citation")).alias("sort_key"))


@query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS n FROM documents")
def token_sets(s, d):
    return read_table(s, d, "documents", "doc_id", "text").select("doc_id", F.size(t.tokens(F.col("text"))).cast("long").alias("n"))


@query(r"SELECT test_id, trim(regexp_replace(coalesce(query, ''), '\s+', ' ', 'g')) AS query, sha256(query) AS hash FROM test")
def squeeze_and_hash(s, d):
    return read_table(s, d, "test", "test_id", "query").select("test_id", t.squeeze(F.col("query")).alias("query"), t.prompt_hash(F.col("query")).alias("hash"))


@query("SELECT law_id, round(v[1], 6) AS v1, round(v[64], 6) AS v64, round(h[1], 6) AS h1 FROM (SELECT law_id, " + _UNIT("embedding") + " AS v, " + _UNIT("embedding[1:16]") + " AS h FROM laws_db WHERE " + _FINE("embedding") + ")")
def unit_vectors(s, d):
    rows = read_table(s, d, "laws_db", "law_id", "embedding").where(v.usable(F.col("embedding"), 64))
    rows = rows.select("law_id", v.l2_normalise(F.col("embedding")).alias("v"), v.shorten(F.col("embedding"), 16).alias("h"))
    return rows.select("law_id", F.round(F.col("v")[0], 6).alias("v1"), F.round(F.col("v")[63], 6).alias("v64"), F.round(F.col("h")[0], 6).alias("h1"))


@query()
def scrubbed_queries(s, d):
    return readers.sub_queries(read_table(s, d, "test", "test_id", "decomposed_queries_raw"), "test_id", "decomposed_queries_raw").withColumn("sub_query", t.scrub_query(F.col("sub_query")))


@query(eq.TRANSLATION_CHECKS)
def translation_checks(s, d):
    rows = read_table(s, d, "test", "test_id", "query", "german_translation").withColumn("clean", t.clean_translation(F.col("german_translation")))
    return rows.select("test_id", "clean", F.array_join(t.translation_faults(F.col("query"), F.col("clean")), ";").alias("faults"))


@query(eq.DOCUMENT_PARTS)
def document_parts(s, d):
    rows = read_table(s, d, "laws_db", "law_id", "document").withColumn("p", t.split_document(F.col("document")))
    return rows.select("law_id", F.col("p.title").alias("title"), F.length("p.body").alias("body_length"), F.array_join(t.genitives(t.law_name(F.col("p.title"))), ";").alias("names"))


# ---------------------------------------------------------------- extraction

_DOCKET_SQL = r"(?:^|[^0-9A-Za-z_])(\d[A-Z]+[_.]\d+/\d{2,4})"


@query(f"""SELECT doc_id, docket, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_DOCKET_SQL}', 1)) AS docket FROM documents) GROUP BY 1, 2""")
def docket_mentions(s, d):
    found = ex.mentions(read_table(s, d, "documents", "doc_id", "text"), ["doc_id"], "text", ex.DOCKET, ["docket", "e"])
    return found.groupBy("doc_id", "docket").agg(F.count("*").alias("n"))


_CANON = f"SELECT DISTINCT upper(regexp_extract(citation, '{_FORM}', 3)) AS book, lower(regexp_extract(citation, '{_FORM}', 1)) AS art, lower(regexp_extract(citation, '{_FORM}', 2)) AS abs FROM laws_db WHERE regexp_matches(citation, '{_FORM}')"


@query(f"SELECT book, art, abs FROM ({_CANON}) WHERE abs <> '' UNION SELECT book, art, '' AS abs FROM ({_CANON})")
def citation_lookup(s, d):
    return ex.citation_lookup(read_table(s, d, "laws_db", "citation"), "citation").select("book", "art", "abs")


@query(eq.LAW_MENTIONS)
def law_mentions(s, d):
    docs = read_table(s, d, "documents", "doc_id", "text")
    return ex.explicit_laws(docs, ["doc_id"], "text", ex.citation_lookup(read_table(s, d, "laws_db", "citation"), "citation")).select("doc_id", "pos", "citation").distinct()


def _aliases(s, d):
    titles = read_table(s, d, "domains", "domain_id", "title", "book_code").withColumn("o", F.regexp_extract("domain_id", r"(\d+)", 1).cast("int"))
    return ex.name_aliases(titles, "title", "book_code", "o", ex.FIXED_NAMES)


@query(eq.ALL_LAW_MENTIONS)
def all_law_mentions(s, d):
    laws = read_table(s, d, "laws_db", "citation")
    return ex.all_laws(read_table(s, d, "documents", "doc_id", "text"), "doc_id", "text", ex.citation_lookup(laws, "citation"), _aliases(s, d)).drop("place")


@query(eq.COURT_REFERENCES)
def court_references(s, d):
    docs = read_table(s, d, "documents", "citation", "text").where("citation IS NOT NULL")
    return ex.court_references(docs, "citation", "text")


@query()
def rebuilt_corpus(s, d):
    docs = read_table(s, d, "documents", "doc_id", "text", "citation").select("doc_id", "text", F.col("citation").alias("doc"))
    return ex.rebuild_corpus(docs, "doc", "text", ex.citation_lookup(read_table(s, d, "laws_db", "citation"), "citation"), "doc_id")


@query(eq.LAW_EDGES)
def law_edges(s, d):
    docs = read_table(s, d, "documents", "citation", "text").where(F.col("citation").startswith("Art."))
    return ex.law_edges(docs, "citation", "text", ex.citation_lookup(read_table(s, d, "laws_db", "citation"), "citation"), _aliases(s, d)).drop("mention")


@query(eq.QUERY_HINTS)
def query_hints(s, d):
    rows = read_table(s, d, "test", "test_id", "query", "german_translation", "decomposed_queries_raw", "pre_citations", "pre_near_matches")
    return ex.query_hints(rows, "test_id", "pre_near_matches", "pre_citations", ["query", "german_translation", "decomposed_queries_raw"], read_table(s, d, "laws_db", "citation"), "citation").drop("place")


@query(eq.QUERY_MENTIONS)
def query_mentions(s, d):
    asked = read_table(s, d, "test", "test_id", "query", "pre_citations").select("test_id", F.concat_ws("\n", "query", "pre_citations").alias("t"))
    found = ex.articles(ex.phrases(asked, ["test_id"], "t"), "chain", ["test_id", "pos", "book"])
    near = ex.article_index(read_table(s, d, "laws_db", "citation"), "citation").select("book", "art", F.size("citations").cast("long").alias("near"))
    return found.join(near, ["book", "art"], "left").select("test_id", "pos", "art", "abs", "book", F.coalesce("near", F.lit(0)).alias("near")).distinct()


@query()
def hints_compared(s, d):
    """Hint columns made anew from the queries, against the given ones."""
    test = read_table(s, d, "test", "test_id", "query", "pre_citations", "pre_near_matches")
    made = ex.pre_citation_columns(test, "test_id", "query", ex.article_index(read_table(s, d, "laws_db", "citation"), "citation"))
    return ex.compare_generated(test, made, "test_id", ["pre_citations", "pre_near_matches"])


@query()
def unmatched_law_names(s, d):
    texts = read_table(s, d, "documents", "text").unionByName(read_table(s, d, "laws_db", "document").withColumnRenamed("document", "text"))
    return ex.unmatched_names(texts, "text", _aliases(s, d))


@query()
def normalised_sub_issues(s, d):
    return read_table(s, d, "test", "test_id", "decomposed_queries_raw").select("test_id", t.normalise_sub_issues(F.col("decomposed_queries_raw")).alias("decomposed"))


# ---------------------------------------------------------------- rankings and scores

_THREE = " UNION ALL ".join(f"SELECT query_id, '{c}' AS ranking, citation, row_number() OVER (PARTITION BY query_id ORDER BY {c} DESC, rc_id) AS pos FROM ranked_citation WHERE query_id IS NOT NULL AND citation IS NOT NULL AND {c} IS NOT NULL AND NOT isnan({c})" for c in ("lexical_score", "rrf_score", "graph_score"))
_DEDUPED = f"SELECT query_id, ranking, citation, row_number() OVER (PARTITION BY query_id, ranking ORDER BY pos, citation) AS r FROM (SELECT query_id, ranking, citation, min(pos) AS pos FROM ({_THREE}) GROUP BY 1, 2, 3)"


@query(f"SELECT query_id, citation, rrf, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, citation DESC) AS rank FROM (SELECT query_id, citation, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf FROM ({_DEDUPED}) GROUP BY 1, 2)) WHERE rank <= 10")
def rrf_fuse(s, d):
    rc = read_table(s, d, "ranked_citation", "rc_id", "query_id", "citation", "lexical_score", "rrf_score", "graph_score").where("query_id IS NOT NULL AND citation IS NOT NULL")
    each = rc.select("rc_id", "query_id", "citation", F.explode(F.array(*[F.struct(F.lit(c).alias("ranking"), F.col(c).alias("s")) for c in ("lexical_score", "rrf_score", "graph_score")])).alias("x")).select("*", "x.*").where("s IS NOT NULL AND NOT isnan(s)")
    placed = sc.ranks(each, ["query_id", "ranking"], F.col("s").desc(), F.col("rc_id"), name="pos")
    fused = sc.fuse_rankings(placed, "query_id", "ranking", "citation", "pos")
    return sc.top_k(fused, ["query_id"], 10, F.col("rrf").desc(), F.col("citation").desc())


def _minmax_sql(constant: str) -> str:
    w = "OVER (PARTITION BY query_id)"
    return f"SELECT query_id, citation, round(CASE WHEN lexical_score IS NULL THEN NULL WHEN max(lexical_score) {w} <= min(lexical_score) {w} THEN {constant} ELSE (lexical_score - min(lexical_score) {w}) / (max(lexical_score) {w} - min(lexical_score) {w}) END, 6) AS scaled FROM ({_SCORED})"


@query(_minmax_sql("1.0"))
def minmax_constant_one(s, d):
    return sc.minmax(_scored(s, d), ["query_id"], "lexical_score", 1.0, "scaled").select("query_id", "citation", r6("scaled"))


@query(_minmax_sql("0.0"))
def minmax_constant_zero(s, d):
    return sc.minmax(_scored(s, d), ["query_id"], "lexical_score", 0.0, "scaled").select("query_id", "citation", r6("scaled"))


@query(f"SELECT query_id, citation, round(CASE WHEN hi <= lo THEN 1.0 ELSE (x - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT query_id, citation, coalesce(rrf_score, 0.0) AS x, min(coalesce(rrf_score, 0.0)) OVER w AS lo, max(coalesce(rrf_score, 0.0)) OVER w AS hi FROM ({_SCORED}) WINDOW w AS (PARTITION BY query_id))")
def minmax_restricted(s, d):
    return sc.minmax_within(_scored(s, d), ["query_id"], "rrf_score", "scaled").select("query_id", "citation", r6("scaled"))


@query(f"SELECT query_id, citation, round(0.5 + 0.5 * (score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-9), 6) AS factor, round(CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE score END, 6) AS of_max FROM ({_SCORED}) WHERE score IS NOT NULL WINDOW w AS (PARTITION BY query_id)")
def local_factors(s, d):
    rows = sc.local_factor(_scored(s, d).where("score IS NOT NULL"), ["query_id"], "score", "factor")
    return sc.share_of_max(rows, ["query_id"], "score", "of_max").select("query_id", "citation", r6("factor"), r6("of_max"))


@query(f"SELECT query_id, citation, round(CASE WHEN score IS NULL THEN 0.0 ELSE 1.0 - (row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, citation) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY query_id) - 1, 1) END, 6) AS scaled FROM ({_SCORED})")
def rank_normalize(s, d):
    return sc.rank_scores(_scored(s, d), ["query_id"], "score", "citation", "scaled").select("query_id", "citation", r6("scaled"))


@query(f"SELECT query_id, citation, round(0.4 * coalesce(lexical_score, 0) + 0.2 * coalesce(rrf_score, 0) + 0.4 * coalesce(graph_score, 0), 6) AS score FROM ({_SCORED})")
def weighted_full_outer(s, d):
    rows = _scored(s, d)
    parts = {c: (rows.select("query_id", "citation", F.col(c).alias("score")), w) for c, w in (("lexical_score", 0.4), ("rrf_score", 0.2), ("graph_score", 0.4))}
    return sc.combine_weighted(parts, ["query_id", "citation"]).select("query_id", "citation", r6("score"))


@query(f"SELECT query_id, string_agg(citation, ';' ORDER BY rank) AS predicted_citations FROM ({_RANKED}) WHERE rank <= 20 GROUP BY 1")
def submission(s, d):
    return sinks.submission(_ranked(s, d, 20), "query_id", "citation", "rank")


# ---------------------------------------------------------------- graph

@query(_EDGES)
def reference_edges(s, d):
    return _edges(s, d)


def _hop_sql(pairs: str) -> str:
    return f"SELECT DISTINCT r.query_id, e.neighbor AS citation FROM ({_RANKED}) r JOIN ({pairs}) e ON e.node = r.citation WHERE r.rank <= 5"


_OUT, _IN = f"SELECT src AS node, dst AS neighbor FROM ({_EDGES})", f"SELECT dst AS node, src AS neighbor FROM ({_EDGES})"


@query(_hop_sql(_OUT))
def one_hop_out(s, d):
    return g.expand(_ranked(s, d, 5), ["query_id"], "citation", _edges(s, d), "outgoing")


@query(_hop_sql(_IN))
def one_hop_in(s, d):
    return g.expand(_ranked(s, d, 5), ["query_id"], "citation", _edges(s, d), "incoming")


@query(_hop_sql(f"{_OUT} UNION {_IN}"))
def one_hop_both(s, d):
    return g.expand(_ranked(s, d, 5), ["query_id"], "citation", _edges(s, d), "both")


@query(f"""SELECT dst AS node, count(*) AS degree, round(1.0 / ln(1 + count(*)), 6) AS idf FROM (SELECT unnest(regexp_extract_all("references", '{_MENTION}')) AS dst FROM laws_db) GROUP BY 1""")
def degree_idf(s, d):
    return g.degrees(_law_refs(s, d), "dst").select("node", "degree", F.round(g.degree_idf(F.col("degree")), 6).alias("idf"))


_HOPS = f"SELECT k.query_id, p.item AS citation, count(*) AS n FROM (SELECT DISTINCT r.query_id, p.doc FROM ({_RANKED}) r JOIN ({_GOLD}) p ON p.item = r.citation WHERE r.rank <= 5) k JOIN ({_GOLD}) p ON p.doc = k.doc GROUP BY 1, 2"


@query(_HOPS)
def cocitation_hops(s, d):
    return g.two_hops(_ranked(s, d, 5), ["query_id"], "citation", _gold(s, d), "doc", "item").withColumnRenamed("item", "citation")


@query(f"SELECT regexp_extract(citation, '{_FORM}', 3) || '|' || regexp_extract(citation, '{_FORM}', 1) AS family, citation, row_number() OVER (PARTITION BY regexp_extract(citation, '{_FORM}', 3), regexp_extract(citation, '{_FORM}', 1) ORDER BY regexp_extract(citation, '{_FORM}', 2), citation) AS place FROM (SELECT DISTINCT citation FROM laws_db WHERE regexp_matches(citation, '{_FORM}'))")
def family_siblings(s, d):
    return g.families(read_table(s, d, "laws_db", "citation"), "citation")


# ---------------------------------------------------------------- co-occurrence

_PAIRS = f"SELECT a.item AS src, b.item AS dst, count(*) AS n FROM ({_GOLD}) a JOIN ({_GOLD}) b ON a.doc = b.doc AND a.item <> b.item GROUP BY 1, 2"
_SUPPORT = f"SELECT item AS src, count(*) AS docs FROM ({_GOLD}) WHERE doc IN (SELECT doc FROM ({_GOLD}) GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1"
_CONF = f"SELECT p.src, p.dst, p.n::DOUBLE / s.docs AS weight FROM ({_PAIRS}) p JOIN ({_SUPPORT}) s USING (src)"
_TFIDF = f"SELECT src, dst, w / max(w) OVER (PARTITION BY src) AS weight FROM (SELECT p.src, p.dst, p.n * (1 + ln((1 + (SELECT count(DISTINCT doc) FROM ({_GOLD})))::DOUBLE / (1 + f.df))) AS w FROM ({_PAIRS}) p JOIN (SELECT item AS dst, count(*) AS df FROM ({_GOLD}) GROUP BY 1) f USING (dst))"


def _sets(s, d):
    return co.citing_sets(_gold(s, d), "doc", "item")


def _conf(s, d):
    sets = _sets(s, d)
    return co.confidence(co.pair_counts(sets), co.support(sets, 2))


def _tfidf(s, d):
    sets = _sets(s, d)
    return co.tfidf(co.pair_counts(sets), sets)


@query(f"SELECT src, dst, round(weight, 6) AS weight FROM ({_CONF})")
def cooc_confidence(s, d):
    return _conf(s, d).select("src", "dst", r6("weight"))


@query(f"SELECT src, dst, round(weight, 6) AS weight FROM ({_TFIDF})")
def cooc_tfidf(s, d):
    return _tfidf(s, d).select("src", "dst", r6("weight"))


_BEST50 = "SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst DESC) AS k FROM ({})) WHERE k <= 50"


@query(f"SELECT r.query_id, b.dst AS citation, round(sum(0.08 * b.weight), 6) AS score FROM ({_RANKED}) r JOIN ({_BEST50.format(_CONF)}) b ON b.src = r.citation WHERE r.rank <= 5 GROUP BY 1, 2")
def anchor_scores(s, d):
    return co.anchor_scores(_ranked(s, d, 5), ["query_id"], "citation", _conf(s, d), 0.08, 50).select("query_id", "citation", r6("score"))


@query(f"""SELECT query_id, citation, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation DESC) AS rank FROM (
SELECT p.query_id, p.citation, round(1.0::DOUBLE / (60 + p.rank) + coalesce(x.plus, 0), 12) AS score FROM (SELECT * FROM ({_RANKED}) WHERE rank <= 50) p LEFT JOIN
(SELECT r.query_id, b.dst AS citation, sum(0.0025 * (1.0::DOUBLE / (60 + r.rank)) / (1.0::DOUBLE / 61) * b.weight) AS plus FROM ({_RANKED}) r JOIN ({_BEST50.format(_TFIDF)}) b ON b.src = r.citation WHERE r.rank <= 10 GROUP BY 1, 2) x USING (query_id, citation))""")
def tfidf_rerank(s, d):
    return co.rerank_by_cocitation(_ranked(s, d, 50).select("query_id", "citation", "rank"), ["query_id"], "citation", "rank", _tfidf(s, d), 0.0025, 10, 50).select("query_id", "citation", r6("score"), "rank")


_BOOKS = "SELECT source_book AS src, trim(x) AS dst FROM (SELECT source_book, unnest(string_split(target_books, ';')) AS x FROM laws_db WHERE source_book IS NOT NULL) WHERE trim(x) <> ''"
_NETWORK = f"SELECT p.src, p.dst, p.n::DOUBLE / t.docs AS weight FROM (SELECT src, dst, count(*) AS n FROM ({_BOOKS}) WHERE src <> dst GROUP BY 1, 2 HAVING count(*) >= 2) p JOIN (SELECT src, count(*) AS docs FROM ({_BOOKS}) GROUP BY 1) t USING (src)"


def _network(s, d):
    laws = read_table(s, d, "laws_db", "source_book", "target_books").where("source_book IS NOT NULL")
    rows = laws.select(F.col("source_book").alias("src"), F.explode(t.split_list(F.col("target_books"))).alias("dst"))
    return co.confidence(rows.groupBy("src", "dst").agg(F.count("*").alias("n")), rows.groupBy("src").agg(F.count("*").alias("docs")), 2)


@query(f"SELECT src, dst, round(weight, 6) AS weight FROM ({_NETWORK})")
def book_network(s, d):
    return _network(s, d).select("src", "dst", r6("weight"))


_BOOK_OF = f"regexp_extract(citation, '{_FORM}', 3)"
_BOOK_SEEDS = f"SELECT query_id, {_BOOK_OF} AS book, sum(score) AS score FROM ({_RANKED}) WHERE rank <= 10 AND regexp_matches(citation, '{_FORM}') GROUP BY 1, 2"


@query(f"SELECT query_id, book, round(sum(part), 9) AS score FROM (SELECT query_id, book, score AS part FROM ({_BOOK_SEEDS}) UNION ALL SELECT b.query_id, n.dst, 0.25 * b.score * n.weight FROM ({_BOOK_SEEDS}) b JOIN ({_NETWORK}) n ON n.src = b.book) GROUP BY 1, 2")
def network_expand(s, d):
    head = _ranked(s, d, 10).withColumn("book", t.citation_book(F.col("citation"))).where("book IS NOT NULL")
    seeds = head.groupBy("query_id", "book").agg(F.sum("score").alias("score"))
    return co.spread(seeds, ["query_id"], "book", [_network(s, d)], 0.25).select("query_id", "book", "score")


# ---------------------------------------------------------------- dense

def _laws_v(s, d):
    return read_table(s, d, "laws_db", "citation", "embedding")


_WHOLE_V = f"SELECT test_id::VARCHAR AS test_id, {_UNIT('zembed_full_german_query')} AS v FROM test WHERE {_FINE('zembed_full_german_query')}"


@query(_dense(_WHOLE_V, "test_id", _LAWS_V, "citation", 10))
def dense_topk(s, d):
    q = read_table(s, d, "test", "test_id", "zembed_full_german_query")
    return dense_top_k(q, "test_id", "zembed_full_german_query", _laws_v(s, d), "citation", "embedding", 10)


_SUB_TOP = _dense(_SUBS_V.replace("sub_row_id", "query_id || '#' || sub_row_id AS id").replace(", query_id,", ","), "id", _LAWS_V, "citation", 20)


@query(f"SELECT query_id, citation, rrf, best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best DESC, citation DESC) AS k FROM (SELECT string_split(id, '#')[1] AS query_id, citation, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(cos) AS best FROM ({_SUB_TOP}) GROUP BY 1, 2)) WHERE k <= 20")
def dense_rrf_subqueries(s, d):
    subs = read_table(s, d, "test_sub_query_zembed", "sub_row_id", "query_id", "zembed_embedding").withColumn("id", F.concat("query_id", F.lit("#"), "sub_row_id"))
    subs = subs.withColumn("query_id", F.substring_index("id", "#", 1))
    return dense_rrf_top(subs, "query_id", "id", "zembed_embedding", _laws_v(s, d), "citation", "embedding", 20, most=20).drop("rank")


_MEANS = f"SELECT query_id, pos, avg(x) AS m FROM (SELECT query_id, unnest(zembed_embedding)::DOUBLE AS x, generate_subscripts(zembed_embedding, 1) AS pos FROM test_sub_query_zembed WHERE query_id IS NOT NULL AND {_FINE('zembed_embedding')}) GROUP BY 1, 2"


@query(f"SELECT query_id, round(max(CASE WHEN pos = 1 THEN m END) / sqrt(sum(m * m)), 6) AS c1, round(max(CASE WHEN pos = 64 THEN m END) / sqrt(sum(m * m)), 6) AS c64 FROM ({_MEANS}) GROUP BY 1")
def centroid(s, d):
    subs = read_table(s, d, "test_sub_query_zembed", "query_id", "zembed_embedding").where(F.col("query_id").isNotNull() & v.usable(F.col("zembed_embedding"), 64))
    return v.centroids(subs, ["query_id"], "zembed_embedding").select("query_id", F.round(F.col("centroid")[0], 6).alias("c1"), F.round(F.col("centroid")[63], 6).alias("c64"))


_ONE_V = f"SELECT citation, min(embedding) AS e FROM laws_db WHERE {_FINE('embedding')} GROUP BY 1"
_PER_DOMAIN = f"""SELECT CASE WHEN title <> '' THEN title ELSE 'UNKNOWN_TITLE::' || coalesce(source_book, '') END AS domain, source_book, embedding FROM (SELECT {eq._TITLE} AS title, source_book, embedding FROM laws_db WHERE {_FINE('embedding')})"""


@query(f"""SELECT m.domain, b.book_code, m.n, round(m.c1, 6) AS c1 FROM (SELECT domain, max(n) AS n, max(CASE WHEN pos = 1 THEN x END) / greatest(sqrt(sum(x * x)), 1e-12) AS c1 FROM (SELECT domain, pos, avg(x) AS x, count(*) AS n FROM (SELECT domain, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM ({_PER_DOMAIN})) GROUP BY 1, 2) GROUP BY 1) m
JOIN (SELECT domain, source_book AS book_code FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY c DESC, source_book NULLS FIRST) AS k FROM (SELECT domain, source_book, count(*) AS c FROM ({_PER_DOMAIN}) GROUP BY 1, 2)) WHERE k = 1) b USING (domain)""")
def domain_centroids(s, d):
    laws = read_table(s, d, "laws_db", "document", "source_book", "embedding").where(v.usable(F.col("embedding"), 64)).withColumn("title", t.split_document(F.col("document"))["title"])
    return lc.domain_vectors(laws, "title", "source_book", "embedding").select("domain", "book_code", "n", F.round(F.col("centroid")[0], 6).alias("c1"))


# ---------------------------------------------------------------- lexical

_TERMS = lambda key, table, col: f"SELECT DISTINCT {key}, unnest(regexp_extract_all(lower({col}), '[a-z0-9]+')) AS term FROM {table}"


@query(f"SELECT test_id, law_id, score FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, law_id) AS k FROM (SELECT q.test_id, c.law_id, count(*)::DOUBLE AS score FROM ({_TERMS('test_id', 'test', 'query')}) q JOIN ({_TERMS('law_id', 'laws_db', 'document')}) c USING (term) GROUP BY 1, 2)) WHERE k <= 10")
def lexical_overlap(s, d):
    return lx.best_overlaps(read_table(s, d, "test", "test_id", "query"), "test_id", "query", read_table(s, d, "laws_db", "law_id", "document"), "law_id", "document", 10).drop("rank")


_GRAMS = lambda key, table, col: f"SELECT {key}, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM (SELECT {key}, regexp_extract_all(lower(coalesce({col}, '')), '[\\pL\\pN_][\\pL\\pN_]+') AS l FROM {table})"
_TFW = lambda key, bag: f"SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM (SELECT {key}, term, (1 + ln(count(*))) * any_value(idf) AS w FROM ({bag}) JOIN voc USING (term) GROUP BY 1, 2)"


@query(f"""WITH db AS MATERIALIZED ({_GRAMS('law_id', 'laws_db', 'document')}), voc AS MATERIALIZED (SELECT term, 1 + ln((1 + (SELECT count(*) FROM laws_db))::DOUBLE / (1 + count(DISTINCT law_id))) AS idf FROM db GROUP BY 1 HAVING count(DISTINCT law_id) BETWEEN 2 AND 0.9 * (SELECT count(*) FROM laws_db))
SELECT test_id, law_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, law_id) AS rank FROM (SELECT q.test_id, c.law_id, round(sum(q.w * c.w), 9) AS score FROM ({_TFW('test_id', _GRAMS('test_id', 'test', 'query || chr(10) || coalesce(german_translation, chr(32))'))}) q JOIN ({_TFW('law_id', 'SELECT * FROM db')}) c USING (term) GROUP BY 1, 2)) WHERE rank <= 5 AND score > 0""")
def tfidf_lexical(s, d):
    asked = read_table(s, d, "test", "test_id", "query", "german_translation").select("test_id", F.concat("query", F.lit("\n"), F.coalesce("german_translation", F.lit(" "))).alias("text"))
    return lx.tfidf_top_k(asked, "test_id", "text", read_table(s, d, "laws_db", "law_id", "document"), "law_id", "document", 5, ngrams=2, min_df=2)


# ---------------------------------------------------------------- pipeline

def _pipeline_input(s, d):
    laws = read_table(s, d, "laws_db", "law_id", "citation", "document", "source_book", "references").where("citation IS NOT NULL")
    one = laws.groupBy("citation").agg(F.min("law_id").alias("law_id"), F.min_by(F.struct("document", "source_book", F.regexp_extract_all("references", F.lit(_MENTION), F.lit(0)).alias("neighbors")), "law_id").alias("r"))
    docs = one.select("law_id", "citation", F.col("r.document").alias("text"), F.array_compact(F.array("r.source_book")).alias("keywords"), F.coalesce("r.neighbors", F.array().cast("array<string>")).alias("neighbors"))
    docs = sc.ordinals(docs, "law_id").withColumn("doc_ord", (F.col("ord") - 1).cast("int"))
    return read_table(s, d, "test", "test_id", "query").select(F.col("test_id").alias("query_id"), F.col("query").alias("text")), docs


_DOCS = f"""SELECT l.citation, l.law_id, row_number() OVER (ORDER BY l.law_id) - 1 AS o, list_distinct(list_concat(regexp_extract_all(lower(coalesce(l.document, '')), '[a-z0-9]+'), CASE WHEN l.source_book IS NULL THEN [] ELSE [lower(l.source_book)] END)) AS t, lower(l.source_book) AS k, regexp_extract_all("references", '{_MENTION}') AS nb
FROM laws_db l JOIN (SELECT citation, min(law_id) AS law_id FROM laws_db WHERE citation IS NOT NULL GROUP BY 1) f ON f.law_id = l.law_id"""
_PIPE = f"""WITH docs AS MATERIALIZED ({_DOCS}), qs AS MATERIALIZED (SELECT test_id AS query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS t FROM test),
hit AS (SELECT q.query_id, c.o, count(*)::DOUBLE AS lex FROM (SELECT query_id, unnest(t) AS term FROM qs) q JOIN (SELECT o, unnest(t) AS term FROM docs) c USING (term) GROUP BY 1, 2),
base AS (SELECT q.query_id, c.o, c.citation, coalesce(h.lex, 0) AS lex, CASE WHEN list_contains(q.t, c.k) THEN 1.0 ELSE 0.0 END AS key FROM qs q CROSS JOIN docs c LEFT JOIN hit h ON h.query_id = q.query_id AND h.o = c.o),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, o) AS rl, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, o) AS rk FROM base),
gr AS (SELECT DISTINCT r.query_id, c.o FROM r JOIN (SELECT o, unnest(nb) AS citation FROM docs) n ON n.o = r.o JOIN docs c ON c.citation = n.citation WHERE r.rl <= 2),
f AS (SELECT r.*, round(1.0::DOUBLE / (60 + rl) + 1.0::DOUBLE / (60 + rk), 12) AS rrf, CASE WHEN gr.o IS NULL THEN 0.0 ELSE 1.0 END AS graph FROM r LEFT JOIN gr ON gr.query_id = r.query_id AND gr.o = r.o),
m AS (SELECT *, CASE WHEN max(lex) OVER w <= min(lex) OVER w THEN 1.0 ELSE (lex - min(lex) OVER w) / (max(lex) OVER w - min(lex) OVER w) END AS l, CASE WHEN max(rrf) OVER w <= min(rrf) OVER w THEN 1.0 ELSE (rrf - min(rrf) OVER w) / (max(rrf) OVER w - min(rrf) OVER w) END AS x FROM f WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT *, round(0.5 * l + 0.3 * x + 0.2 * graph, 9) AS s FROM m)
SELECT query_id, rank, citation, round(s, 6) AS score, round(l, 6) AS lexical_score, round(x, 6) AS rrf_score, graph AS graph_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, o) AS rank FROM z) WHERE rank <= 3"""


@query(_PIPE)
def ranking_pipeline(s, d):
    return run_pipeline(*_pipeline_input(s, d))


def _subs(s, d):
    return read_table(s, d, "test_sub_query_zembed", "sub_row_id", "query_id", "zembed_embedding").where("query_id IS NOT NULL")


_SUB200 = _dense(_SUBS_V.replace("sub_row_id", "query_id || '#' || sub_row_id AS id").replace(", query_id,", ",") + " AND query_id IS NOT NULL", "id", _LAWS_V, "citation", 200)


@query(f"SELECT query_id, citation, rrf, best, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best DESC, citation DESC) AS rank FROM (SELECT string_split(id, '#')[1] AS query_id, citation, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(cos) AS best FROM ({_SUB200}) GROUP BY 1, 2)")
def subquery_ranking(s, d):
    return lc.rank_by_subqueries(_subs(s, d), "query_id", "sub_row_id", "zembed_embedding", _laws_v(s, d), "citation", "embedding")


def _book_network(rows):
    return _network_of(rows.withColumn("item", t.citation_book(F.col("item"))))


def _network_of(rows):
    sets = co.citing_sets(rows, "doc", "item")
    return co.confidence(co.pair_counts(sets), co.support(sets, 1), 2)


_GOLD_BOOKS = f"SELECT DISTINCT doc, regexp_extract(item, '{_FORM}', 3) AS item FROM ({_GOLD}) WHERE regexp_matches(item, '{_FORM}')"


@query(f"SELECT p.src, p.dst, round(p.n::DOUBLE / t.docs, 6) AS weight FROM (SELECT a.item AS src, b.item AS dst, count(*) AS n FROM ({_GOLD_BOOKS}) a JOIN ({_GOLD_BOOKS}) b ON a.doc = b.doc AND a.item <> b.item GROUP BY 1, 2 HAVING count(*) >= 2) p JOIN (SELECT item AS src, count(*) AS docs FROM ({_GOLD_BOOKS}) GROUP BY 1) t USING (src)")
def gold_book_network(s, d):
    return _book_network(_gold(s, d)).select("src", "dst", r6("weight"))


@query()
def law_cascade(s, d):
    """Dense ranking of the sub-queries, hints, graph, anchors, three book networks, co-citation."""
    laws = read_table(s, d, "laws_db", "citation", "document", "source_book", "target_books", "embedding")
    test = read_table(s, d, "test", "query_id", "query", "german_translation", "decomposed_queries_raw", "pre_citations", "pre_near_matches").where("query_id IS NOT NULL")
    test, texts = inc.newest(test.withColumn("o", F.length("query")), ["query_id"], "o", "query"), ["query", "german_translation", "decomposed_queries_raw"]
    exact = ex.query_hints(test, "query_id", "pre_near_matches", "pre_citations", texts, laws, "citation")
    books = ex.hinted_books(test, "query_id", ["pre_citations", "pre_near_matches"], texts, laws.select(t.citation_book(F.col("citation")).alias("book")).where("book IS NOT NULL"))
    domains = lc.domain_vectors(laws.where(v.usable(F.col("embedding"), 64)).withColumn("title", t.split_document(F.col("document"))["title"]), "title", "source_book", "embedding")
    cited = ex.explicit_laws(read_table(s, d, "documents", "doc_id", "text"), ["doc_id"], "text", ex.citation_lookup(laws, "citation")).select(F.col("doc_id").alias("doc"), F.col("citation").alias("item"))
    cited = materialise(co.citing_sets(cited.withColumn("item", t.citation_book(F.col("item"))), "doc", "item"))
    # from here on items, books and domains are numbers, in the order of their names
    items = laws.select("citation").unionByName(_gold(s, d).select(F.col("item").alias("citation"))).where("citation IS NOT NULL").distinct()
    items = sc.ordinals(items, "citation").select(F.col("ord").alias("id"), F.col("citation").alias("name"), t.citation_book(F.col("citation")).alias("book_name"))
    named = [items.select("book_name"), cited.select("item"), laws.select("source_book"), laws.select(F.explode(t.split_list(F.col("target_books"))))]
    numbers = sc.ordinals(reduce(DataFrame.unionByName, [n.toDF("book_name") for n in named]).where("book_name IS NOT NULL").distinct(), "book_name").select("book_name", F.col("ord").alias("book"))
    items = materialise(items.join(numbers, "book_name", "left").select("id", "name", "book"))
    number = lambda df, c, by, name, to: df.join(by.select(F.col(name).alias(c), F.col(to).alias("__n")), c).withColumn(c, F.col("__n")).drop("__n")
    as_item, as_book = (lambda df, c: number(df, c, items, "name", "id")), (lambda df, c: number(df, c, numbers, "book_name", "book"))
    domains = sc.ordinals(domains.select("domain", "centroid", F.col("book_code").alias("book_name")), "domain").join(numbers, "book_name", "left").select(F.col("ord").alias("id"), "centroid", "book")
    subs, config = _subs(s, d), lc.CascadeConfig()
    ranked = dense_rrf_lists(subs, "query_id", "sub_row_id", "zembed_embedding", as_item(_laws_v(s, d), "citation"), "citation", "embedding", config.per_subquery, config.rrf_k, 200)
    near = dense_rrf_lists(subs, "query_id", "sub_row_id", "zembed_embedding", domains, "id", "centroid", 10)
    # each step is cut off, else one plan of hundreds of exchanges fills the driver's memory
    exact = materialise(as_item(exact.select("query_id", "citation"), "citation").withColumnRenamed("citation", "id"))
    books = materialise(as_book(books, "book"))
    networks = [as_book(as_book(n, "src"), "dst") for n in (_network(s, d), _book_network(_gold(s, d)), _network_of(cited))]
    graph = materialise(as_item(as_item(_whole_edges(s, d), "src"), "dst"))
    sets = materialise(as_item(_sets(s, d), "item"))
    pairs = materialise(co.pair_counts(sets))
    out = cascade_blocks.cascade(ranked, near, exact, books, "query_id", items, domains, networks, graph, co.confidence(pairs, co.support(sets, 2)), co.tfidf(pairs, sets), config)
    return out.select("query_id", "citation", "rank", r6("score"))


# ---------------------------------------------------------------- courts

def _near(s, d, k=20):
    """Questions stand for decisions: they have a vector and cite laws."""
    subs = read_table(s, d, "test_sub_query_zembed", "query_id", "zembed_embedding").where(F.col("query_id").isNotNull() & v.usable(F.col("zembed_embedding"), 64))
    courts = read_table(s, d, "test", "test_id", "zembed_full_german_query").withColumn("court", F.col("test_id").cast("string"))
    return cr.near_courts(courts.select(F.lit("").alias("query_id"), "zembed_full_german_query"), "zembed_full_german_query", subs, "zembed_embedding", courts, "court", "zembed_full_german_query", cr.CourtConfig(top_courts=k))


def _court_refs(s, d):
    return _gold(s, d).select(F.col("doc").cast("string").alias("court"), F.col("item").alias("citation"))


_BAG = "SELECT test_id::VARCHAR AS court, trim(x) AS citation FROM (SELECT test_id, unnest(string_split(gold_citations, ';')) AS x FROM test) WHERE trim(x) <> ''"
_MEAN_V = f"SELECT query_id, list_transform(l, lambda x: x / n) AS v FROM (SELECT query_id, list(m ORDER BY pos) AS l, greatest(sqrt(sum(m * m)), 1e-12) AS n FROM ({_MEANS}) GROUP BY 1)"
_NEAR = _dense(_MEAN_V, "query_id", f"SELECT test_id::VARCHAR AS court, {_UNIT('zembed_full_german_query')} AS v FROM test WHERE {_FINE('zembed_full_german_query')}", "court", 20)


@query(f"SELECT query_id, court, cos FROM ({_NEAR})")
def near_courts(s, d):
    return _near(s, d)


_COURT_V = f"SELECT test_id::VARCHAR AS court, {_UNIT('zembed_full_german_query')} AS v FROM test WHERE {_FINE('zembed_full_german_query')}"
_WHOLE_Q = f"SELECT query_id, {_UNIT('zembed_full_german_query')} AS v FROM test WHERE query_id IS NOT NULL AND {_FINE('zembed_full_german_query')}"
_NEAR_WHOLE = _dense(_WHOLE_Q, "query_id", _COURT_V, "court", 20)
_NEAR_EACH = _dense(_SUBS_V.replace("sub_row_id", "query_id || '#' || sub_row_id AS id").replace(", query_id,", ",") + " AND query_id IS NOT NULL", "id", _COURT_V, "court", 20)
_MODE_SQL = {
    "english-query": f"SELECT query_id, court, cos FROM ({_NEAR_WHOLE})",
    "german-query": f"SELECT query_id, court, cos FROM ({_NEAR_WHOLE})",
    "per-subquery": f"SELECT string_split(id, '#')[1] AS query_id, court, max(cos) AS cos FROM ({_NEAR_EACH}) GROUP BY 1, 2",
    **{m: f"SELECT query_id, court, arg_min(cos, src) AS cos FROM (SELECT query_id, court, cos, 0 AS src FROM ({_NEAR}) UNION ALL SELECT query_id, court, cos, 1 FROM ({_NEAR_WHOLE})) GROUP BY 1, 2" for m in ("union-avg-full", "union-avg-german", "union-all-three")},
}


def _court_mode(mode: str):
    def run(s, d):
        subs = read_table(s, d, "test_sub_query_zembed", "query_id", "zembed_embedding").where(F.col("query_id").isNotNull() & v.usable(F.col("zembed_embedding"), 64))
        courts = read_table(s, d, "test", "test_id", "query_id", "zembed_full_german_query").withColumn("court", F.col("test_id").cast("string"))
        return cr.near_courts(courts.where("query_id IS NOT NULL"), "zembed_full_german_query", subs, "zembed_embedding", courts, "court", "zembed_full_german_query", cr.CourtConfig(mode=mode, top_courts=20))

    run.__name__ = "courts_" + mode.replace("-", "_")
    return run


for _mode, _sql in _MODE_SQL.items():
    query(_sql)(_court_mode(_mode))


@query(f"SELECT n.query_id, b.citation, round(sum(n.cos) / ln(1 + max(g.degree)), 9) AS score FROM ({_NEAR}) n JOIN ({_BAG}) b USING (court) JOIN (SELECT citation, count(*) AS degree FROM ({_BAG}) GROUP BY 1) g USING (citation) GROUP BY 1, 2")
def court_path_score(s, d):
    return cr.court_path(_near(s, d), "court", _court_refs(s, d)).select("query_id", "citation", "score")


_DF = f"SELECT item AS citation, ln((SELECT count(DISTINCT doc) FROM ({_GOLD}))::DOUBLE / count(*)) AS w FROM ({_GOLD}) GROUP BY 1"


@query(f"SELECT h.query_id, h.citation, round(h.n * f.w / (SELECT max(w) FROM ({_DF})), 6) AS score FROM ({_HOPS}) h JOIN ({_DF}) f USING (citation)")
def cocitation_path(s, d):
    return cr.cocitation_path(_ranked(s, d, 5), "court", _court_refs(s, d), 5).select("query_id", "citation", r6("score"))


def _mm(sql: str, w: float) -> str:
    return f"SELECT query_id, citation, {w} * CASE WHEN max(score) OVER p <= min(score) OVER p THEN 0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS part FROM ({sql}) WINDOW p AS (PARTITION BY query_id)"


_SIG = lambda c: f"SELECT query_id, citation, {c} AS score FROM ({_SCORED}) WHERE {c} IS NOT NULL"
_BLEND = f"SELECT query_id, citation, round(sum(part), 9) AS score FROM ({_mm(_SIG('lexical_score'), 0.32)} UNION ALL {_mm(_SIG('graph_score'), 0.48)} UNION ALL {_mm(_SIG('rrf_score'), 0.2)}) GROUP BY 1, 2"


def _signal(s, d, c):
    return _scored(s, d).where(F.col(c).isNotNull()).select("query_id", "citation", F.col(c).alias("score"))


def _blend(s, d):
    return cr.blend_signals(_signal(s, d, "lexical_score"), _signal(s, d, "graph_score"), _signal(s, d, "rrf_score"), cr.CourtConfig(cocitation_weight=0.2))


@query(_BLEND)
def signal_blend(s, d):
    return _blend(s, d)


@query(f"""SELECT query_id, citation, round(s.score + 0.3 * coalesce(p.part, 0), 6) AS score FROM (SELECT query_id, citation, score FROM ({_RANKED})) s LEFT JOIN ({_mm(_SIG('graph_score'), 1.0)}) p USING (query_id, citation)""")
def additive_signal(s, d):
    return cr.add_signal(_ranked(s, d).select("query_id", "citation", "score"), _signal(s, d, "graph_score"), 0.3).select("query_id", "citation", r6("score"))


_LAW_BOOK = "SELECT citation, min(source_book) AS book FROM laws_db GROUP BY 1"
_PRIOR = f"SELECT r.query_id, b.book, round(sum(r.score), 9) AS score FROM ({_RANKED}) r JOIN ({_LAW_BOOK}) b USING (citation) WHERE b.book IS NOT NULL AND r.rank <= 20 GROUP BY 1, 2"


@query(f"""SELECT r.query_id, r.citation, round(r.score + 0.1 * coalesce(p.part, 0), 6) AS score FROM ({_RANKED}) r LEFT JOIN ({_LAW_BOOK}) b USING (citation) LEFT JOIN
(SELECT query_id, citation AS book, part FROM ({_mm(f"SELECT query_id, book AS citation, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book) AS k FROM ({_PRIOR.replace('r.rank <= 20', 'r.rank2 <= 20').replace(f'({_RANKED}) r', f'(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS rank2 FROM ({_RANKED})) r')})) WHERE k <= 3", 1.0)})) p ON p.query_id = r.query_id AND p.book = b.book""")
def book_prior(s, d):
    laws = read_table(s, d, "laws_db", "citation", "source_book").groupBy("citation").agg(F.min("source_book").alias("book"))
    return cr.book_prior(_ranked(s, d).select("query_id", "citation", "score"), laws, 20, 3, 0.1).select("query_id", "citation", r6("score"))


@query()
def book_pool(s, d):
    laws = read_table(s, d, "laws_db", "citation", "source_book").groupBy("citation").agg(F.min("source_book").alias("book"))
    test = read_table(s, d, "test", "query_id", "zembed_full_german_query").dropDuplicates(["query_id"])
    near = dense_top_k(test, "query_id", "zembed_full_german_query", _laws_v(s, d), "citation", "embedding", 100)
    return cr.book_pool(_ranked(s, d, 20).select("query_id", "citation", "score"), near, laws, 20, 3, 2, 0.5).select("query_id", "citation", r6("score"))


@query()
def reference_expand(s, d):
    links = sc.ranks(_whole_edges(s, d), ["src"], F.col("dst"), name="place")
    return sel.expand_first_parent(_ranked(s, d, 20).select("query_id", "citation", "score"), ["query_id"], "citation", "score", links, 0.5, 2, 5).select("query_id", "citation", r6("score"))


@query()
def family_expand(s, d):
    fam = g.families(read_table(s, d, "laws_db", "citation"), "citation")
    links = fam.select("family", F.col("citation").alias("src")).join(fam.select("family", F.col("citation").alias("dst"), "place"), "family").where("src <> dst").select("src", "dst", "place")
    return sel.expand_first_parent(_ranked(s, d, 20).select("query_id", "citation", "score"), ["query_id"], "citation", "score", links, 0.5, 2, 5).select("query_id", "citation", r6("score"))


@query(f"SELECT c.query_id, c.citation, round(max(round(list_dot_product(a.v, b.v), 9)), 6) AS score FROM (SELECT * FROM ({_RANKED}) WHERE rank <= 20) c JOIN (SELECT citation, {_UNIT('e')} AS v FROM ({_ONE_V})) a USING (citation) JOIN (SELECT r.query_id, v FROM ({_RANKED}) r JOIN (SELECT citation, {_UNIT('e')} AS v FROM ({_ONE_V})) USING (citation) WHERE r.rank <= 3) b ON b.query_id = c.query_id GROUP BY 1, 2")
def seed_similarity(s, d):
    laws = read_table(s, d, "laws_db", "citation", "embedding").where(v.usable(F.col("embedding"), 64)).groupBy("citation").agg(F.min("embedding").alias("v"))
    return cr.seed_similarity(_ranked(s, d, 20), _ranked(s, d, 3), laws, "max").select("query_id", "citation", r6("score"))


@query(f"""WITH m AS (SELECT query_id, pos, avg(x) AS x FROM (SELECT r.query_id, unnest(e)::DOUBLE AS x, generate_subscripts(e, 1) AS pos FROM ({_RANKED}) r JOIN ({_ONE_V}) USING (citation) WHERE r.rank <= 3) GROUP BY 1, 2),
q AS (SELECT query_id, unnest(e)::DOUBLE AS x, generate_subscripts(e, 1) AS pos FROM (SELECT query_id, min(zembed_full_german_query) AS e FROM test WHERE {_FINE('zembed_full_german_query')} GROUP BY 1)),
b AS (SELECT q.query_id, q.pos, q.x AS own, 0.7 * q.x + 0.3 * c.x AS x FROM q LEFT JOIN (SELECT query_id, pos, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY query_id)), 1e-12) AS x FROM m) c ON c.query_id = q.query_id AND c.pos = q.pos)
SELECT query_id, round(coalesce(max(CASE WHEN pos = 1 THEN x END) / greatest(sqrt(sum(x * x)), 1e-12), max(CASE WHEN pos = 1 THEN own END)), 6) AS v1 FROM b GROUP BY 1""")
def steered_queries(s, d):
    laws = read_table(s, d, "laws_db", "citation", "embedding").where(v.usable(F.col("embedding"), 64)).groupBy("citation").agg(F.min("embedding").alias("v"))
    q = read_table(s, d, "test", "query_id", "zembed_full_german_query").where(v.usable(F.col("zembed_full_german_query"), 64)).groupBy("query_id").agg(F.min("zembed_full_german_query").alias("v"))
    return cr.steer(q, _ranked(s, d, 3).select("query_id", "citation"), laws, 0.3).select("query_id", F.round(F.col("v")[0], 6).alias("v1"))


@query(f"SELECT citation, count(*) AS degree FROM ({_BAG}) WHERE string_split(citation, ' ')[-1] IN ('TorV', 'TreG', 'TunG') GROUP BY 1 ORDER BY degree DESC, citation LIMIT 50")
def most_cited(s, d):
    return cr.most_cited(_court_refs(s, d), s.createDataFrame([("TorV",), ("TreG",), ("TunG",)], "book string"), 50)


# ---------------------------------------------------------------- selection

def _by(c: str, n: int | None = None) -> str:
    limit = "" if n is None else f" WHERE rank <= {n}"
    return f"SELECT query_id, citation, score, rank FROM (SELECT query_id, citation, {c} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {c} DESC, citation DESC) AS rank FROM ({_SCORED}) WHERE {c} IS NOT NULL){limit}"


def _by_df(s, d, c, n=None):
    rows = _signal(s, d, c)
    order = (F.col("score").desc(), F.col("citation").desc())
    return sc.ranks(rows, ["query_id"], *order) if n is None else sc.top_k(rows, ["query_id"], n, *order)


_NEW = f"SELECT query_id, citation FROM (SELECT l.query_id, l.citation, row_number() OVER (PARTITION BY l.query_id ORDER BY l.rank, l.citation) AS k FROM ({_by('lexical_score')}) l ANTI JOIN ({_by('score', 10)}) p USING (query_id, citation)) WHERE k <= 3"


@query(_NEW)
def inject_new_topn(s, d):
    return sel.new_first_n(_by_df(s, d, "lexical_score"), _by_df(s, d, "score", 10), ["query_id"], "citation", "rank", 3).select("query_id", "citation")


_QUART = f"SELECT query_id, score AS level FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, citation) - 1 AS p, count(*) OVER (PARTITION BY query_id) AS n FROM ({_by('score', 10)})) WHERE p = floor(n * 0.75)"


@query(f"SELECT query_id, citation, round(score, 6) AS score FROM ({_by('score', 10)}) UNION ALL SELECT n.query_id, n.citation, round(coalesce(q.level, 0), 6) FROM ({_NEW}) n LEFT JOIN ({_QUART}) q USING (query_id)")
def percentile_pick(s, d):
    return sel.inject(_by_df(s, d, "lexical_score"), _by_df(s, d, "score", 10), ["query_id"], "citation", "rank", 3).select("query_id", "citation", r6("score"))


_CHOSEN = f"SELECT query_id, citation, rank FROM ({_by('graph_score', 4)})"


@query(f"SELECT query_id, citation, rank FROM ({_CHOSEN}) UNION ALL SELECT query_id, citation, r AS rank FROM (SELECT p.query_id, p.citation, coalesce(h.m, 0) + row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank, p.citation) AS r FROM ({_by('score')}) p ANTI JOIN ({_CHOSEN}) c USING (query_id, citation) LEFT JOIN (SELECT query_id, max(rank) AS m FROM ({_CHOSEN}) GROUP BY 1) h ON h.query_id = p.query_id) WHERE r <= 10")
def fill_to_k(s, d):
    return sel.fill_to_k(_by_df(s, d, "graph_score", 4), _by_df(s, d, "score"), ["query_id"], "citation", "rank", 10)


@query(f"SELECT query_id, citation, place AS final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keep DESC, rank) AS place, sum(keep::INT) OVER (PARTITION BY query_id) AS kept FROM (SELECT *, (score >= 0.3 OR rank <= 2) AS keep FROM ({_by('score')}))) WHERE place <= least(12, greatest(kept, 5))")
def dynamic_cut(s, d):
    return sel.dynamic_cut(_by_df(s, d, "score"), ["query_id"], "rank", "score", 0.3, 2, 5, 12).select("query_id", "citation", F.col("final_rank").cast("long").alias("final_rank"))


_FREE = f"SELECT query_id, citation, rank, {_BOOK_OF} <> 'TorV' AND {_BOOK_OF} <> '' AS free, s2 FROM (SELECT r.*, x.lexical_score AS s2 FROM ({_by('score', 20)}) r JOIN ({_SCORED}) x USING (query_id, citation))"


@query(f"SELECT a.query_id, a.citation, CASE WHEN a.free THEN b.rank ELSE a.rank END AS final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, free ORDER BY s2 DESC NULLS LAST, rank) AS k FROM ({_FREE})) a JOIN (SELECT query_id, rank, free, row_number() OVER (PARTITION BY query_id, free ORDER BY rank) AS k FROM ({_FREE})) b ON a.query_id = b.query_id AND a.free = b.free AND a.k = b.k")
def frozen_slot_rerank(s, d):
    rows = _by_df(s, d, "score", 20).join(_scored(s, d).select("query_id", "citation", F.col("lexical_score").alias("s2")), ["query_id", "citation"])
    book = F.coalesce(t.citation_book(F.col("citation")), F.lit(""))
    return sel.permute_free(rows, ["query_id"], "rank", "s2", (book != "TorV") & (book != "")).select("query_id", "citation", F.col("final_rank").cast("long").alias("final_rank"))


@query()
def mmr_select(s, d):
    laws = read_table(s, d, "laws_db", "citation", "embedding").where(v.usable(F.col("embedding"), 64)).groupBy("citation").agg(F.min("embedding").alias("v"))
    return mmr(_by_df(s, d, "score", 50).join(laws, "citation"), "query_id", "citation", "score", "v", 10)


@query(f"SELECT query_id, citation, CAST(floor((rank - 11) / 4) AS INT) AS batch_id, chr(CAST(65 + (rank - 11) % 4 AS INT)) AS label FROM ({_by('score', 20)}) WHERE rank BETWEEN 11 AND 20")
def judge_batches(s, d):
    return rr.window(_by_df(s, d, "score", 20), 11, 20).select("query_id", "citation", "batch_id", "label")


# ---------------------------------------------------------------- decisions, evaluation

def _votes(s, d):
    top = _by_df(s, d, "score", 20).join(_scored(s, d).select("query_id", "citation", "lexical_score", "rrf_score"), ["query_id", "citation"])
    vote = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) < 0.2, "REMOVE").otherwise("KEEP")
    return top.select("query_id", "citation", vote("lexical_score").alias("decision")), top.where("rank % 3 <> 0").select("query_id", "citation", vote("rrf_score").alias("decision"))


_VOTES = f"SELECT r.query_id, r.citation, r.rank, CASE WHEN coalesce(x.lexical_score, 0) < 0.2 THEN 'REMOVE' ELSE 'KEEP' END AS d1, CASE WHEN r.rank % 3 = 0 THEN NULL WHEN coalesce(x.rrf_score, 0) < 0.2 THEN 'REMOVE' ELSE 'KEEP' END AS d2 FROM ({_by('score', 20)}) r JOIN ({_SCORED}) x USING (query_id, citation)"


@query(f"SELECT query_id, citation, CASE WHEN d1 = 'REMOVE' AND d2 = 'REMOVE' THEN 'REMOVE' ELSE 'KEEP' END AS decision FROM ({_VOTES})")
def confirm_removals(s, d):
    return dec.confirm_removals(*_votes(s, d), ["query_id", "citation"])


_GOLDQ = "SELECT query_id, list_distinct(list_filter(list_transform(string_split(min(gold_citations), ';'), lambda x: trim(x)), lambda x: starts_with(x, 'Art.'))) AS gold FROM test WHERE query_id IS NOT NULL GROUP BY 1"


def _gold_by_query(s, d):
    rows = read_table(s, d, "test", "query_id", "gold_citations").where("query_id IS NOT NULL").groupBy("query_id").agg(F.min("gold_citations").alias("gold_citations"))
    return rows.select("query_id", F.array_distinct(t.gold_only(t.split_list(F.col("gold_citations")))).alias("gold"))


@query(f"SELECT count(*) AS candidates, count(*) FILTER (gold) AS gold, count(*) FILTER (NOT gold) AS noise, count(*) FILTER (removed) AS removed, round(count(*) FILTER (removed AND gold)::DOUBLE / greatest(count(*) FILTER (gold), 1), 6) AS gold_removal_rate, round(count(*) FILTER (removed AND NOT gold)::DOUBLE / greatest(count(*) FILTER (NOT gold), 1), 6) AS noise_removal_rate FROM (SELECT v.d1 = 'REMOVE' AS removed, coalesce(list_contains(g.gold, v.citation), FALSE) AS gold FROM ({_VOTES}) v LEFT JOIN ({_GOLDQ}) g USING (query_id))")
def removal_quality(s, d):
    first, _ = _votes(s, d)
    rows = first.join(_gold_by_query(s, d), "query_id", "left").select((F.col("decision") == "REMOVE").alias("removed"), F.array_contains("gold", F.col("citation")).alias("gold"))
    return dec.removal_quality(rows, "gold", "removed").select("candidates", "gold", "noise", "removed", r6("gold_removal_rate"), r6("noise_removal_rate"))


_JUDGED = f"SELECT p.query_id, p.predicted, coalesce(g.gold, []) AS gold FROM (SELECT query_id, list(citation) AS predicted FROM ({_by('score', 5)}) GROUP BY 1) p JOIN ({_GOLDQ}) g USING (query_id)"


def _judged(s, d):
    predicted = _by_df(s, d, "score", 5).groupBy("query_id").agg(F.collect_list("citation").alias("predicted"))
    return ev.judge(predicted, _gold_by_query(s, d), "query_id")


@query(f"SELECT query_id, round(CASE WHEN len(gold) = 0 AND len(predicted) = 0 THEN 1.0 WHEN len(list_intersect(predicted, gold)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(predicted, gold)) / (len(predicted) + len(gold)) END, 6) AS f1 FROM ({_JUDGED})")
def query_f1(s, d):
    return _judged(s, d).select("query_id", F.round(ev.f1(F.col("predicted"), F.col("gold")), 6).alias("f1"))


@query(f"""SELECT count(*) AS queries, round(avg(CASE WHEN p = 0 AND g = 0 THEN 1.0 WHEN h = 0 THEN 0.0 ELSE 2.0 * h / (p + g) END), 6) AS macro_f1, round(2.0 * sum(h) / (sum(p) + sum(g)), 6) AS micro_f1, round(sum(h)::DOUBLE / sum(p), 6) AS precision, round(sum(h)::DOUBLE / sum(g), 6) AS recall, sum(h)::BIGINT AS hits
FROM (SELECT len(list_intersect(predicted, gold)) AS h, len(predicted) AS p, len(gold) AS g FROM ({_JUDGED}))""")
def macro_micro_f1(s, d):
    return ev.score(_judged(s, d)).select("queries", r6("macro_f1"), r6("micro_f1"), r6("precision"), r6("recall"), "hits")


@query(f"SELECT count(*) AS lists, round(avg(n), 6) AS mean_size, min(n) AS min_size, max(n) AS max_size FROM (SELECT query_id, count(*) AS n FROM ({_by('score', 20)}) GROUP BY 1)")
def run_summary(s, d):
    lists = _by_df(s, d, "score", 20).groupBy("query_id").agg(F.collect_list("citation").alias("p"))
    return ev.list_sizes(lists, "p").select("lists", r6("mean_size"), F.col("min_size").cast("long").alias("min_size"), F.col("max_size").cast("long").alias("max_size"))


@query()
def decision_parse(s, d):
    rows = read_table(s, d, "test", "test_id", "decomposed_queries_raw").withColumn("p", dec.parse_decisions(F.col("decomposed_queries_raw")))
    return rows.select("test_id", F.size("p.decisions").alias("decisions"), F.substring_index("p.diagnostic", ":", 1).alias("diagnostic"))


@query()
def cross_encoder_rerank(s, d):
    laws = read_table(s, d, "laws_db", "citation", "document", "source_book").groupBy("citation").agg(F.min("document").alias("document"), F.min("source_book").alias("book"))
    rows = _by_df(s, d, "score", 20).join(_scored(s, d).select("query_id", "citation", F.col("lexical_score").alias("tfidf"), F.col("graph_score").alias("cosine")), ["query_id", "citation"]).join(laws, "citation", "left")
    cache = _signal(s, d, "rrf_score")
    return rr.rerank(rows, cache, {"tfidf": 0.4, "cosine": 0.2, "cross_encoder": 0.4}, 10).select("query_id", "citation", "rank", "final_rank", r6("combined"))


# ---------------------------------------------------------------- aggregates, incremental

@query("SELECT query_id, string_agg(sub_query_de, chr(10) ORDER BY sub_id, sub_row_id) AS text FROM test_sub_query_zembed WHERE query_id IS NOT NULL AND sub_query_de IS NOT NULL GROUP BY 1")
def list_aggregate(s, d):
    rows = read_table(s, d, "test_sub_query_zembed", "sub_row_id", "query_id", "sub_id", "sub_query_de").where("query_id IS NOT NULL AND sub_query_de IS NOT NULL")
    placed = F.array_sort(F.collect_list(F.struct(F.col("sub_id").isNull().alias("z"), F.coalesce("sub_id", F.lit(0)).alias("s"), F.col("sub_row_id").alias("r"), F.col("sub_query_de").alias("x"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(placed, lambda p: p["x"]), "\n").alias("text"))


@query("SELECT source_book, count(*) AS n, count(DISTINCT citation) AS citations FROM laws_db GROUP BY 1")
def book_counts(s, d):
    return read_table(s, d, "laws_db", "source_book", "citation").groupBy("source_book").agg(F.count("*").alias("n"), F.countDistinct("citation").alias("citations"))


@query("SELECT query_id, test_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY received_at DESC, test_id DESC) AS k FROM test WHERE query_id IS NOT NULL) WHERE k = 1")
def newest_delivery(s, d):
    rows = read_table(s, d, "test", "query_id", "test_id", "received_at").where("query_id IS NOT NULL")
    return inc.newest(rows, ["query_id"], "received_at", "test_id").select("query_id", "test_id")


@query("SELECT test_id, query_id FROM test WHERE query_id IS NULL OR query_id NOT IN (SELECT query_id FROM pipeline_result WHERE query_id IS NOT NULL)")
def resume_antijoin(s, d):
    return inc.todo(read_table(s, d, "test", "test_id", "query_id"), read_table(s, d, "pipeline_result", "query_id"), "query_id").select("test_id", "query_id")


@query("SELECT query_id, citation, round(avg(score), 9) AS score FROM ranked_citation WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND citation IS NOT NULL GROUP BY 1, 2")
def score_variants(s, d):
    rows = read_table(s, d, "ranked_citation", "query_id", "citation", "score").where("score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND citation IS NOT NULL")
    return rr.merge_variants(rows).select("query_id", "citation", F.round("score", 9).alias("score"))


@query("SELECT result_id, query_id, macro_f1 FROM pipeline_result WHERE result_id >= 100 AND result_id < 300")
def row_range(s, d):
    return inc.rows_between(read_table(s, d, "pipeline_result", "result_id", "query_id", "macro_f1"), "result_id", 100, 300)


@query(f"SELECT query_id, citation, rank FROM (SELECT query_id, citation, row_number() OVER (PARTITION BY query_id ORDER BY l, p, citation) AS rank FROM (SELECT query_id, citation, min(l) AS l, arg_min(p, l) AS p FROM (SELECT query_id, citation, 0 AS l, rank AS p FROM ({_by('graph_score', 3)}) UNION ALL SELECT query_id, citation, 1, rank FROM ({_by('score', 10)})) GROUP BY 1, 2))")
def ordered_union(s, d):
    return sc.ordered_union([_by_df(s, d, "graph_score", 3), _by_df(s, d, "score", 10)], ["query_id"], "citation", "rank").select("query_id", "citation", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_counts(s, d):
    return read_table(s, d, "events", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))



# ---------------------------------------------------------------- hints, several readings of one table

@query(f"SELECT query_id, max(CASE WHEN rank = 1 THEN citation END) AS first, count(*) AS n FROM ({_RANKED}) WHERE rank <= 200 GROUP BY 1")
def list_heads(s, d):
    return _ranked(s, d, 200).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("citation"))).alias("first"), F.count("*").alias("n"))


_OVERLAP = f"SELECT n.query_id, n.court, round(n.cos + 0.05 * coalesce(o.n, 0), 9) AS cos FROM ({_NEAR}) n LEFT JOIN (SELECT r.query_id, b.court, count(*) AS n FROM (SELECT DISTINCT query_id, citation FROM ({_RANKED}) WHERE rank <= 5) r JOIN (SELECT DISTINCT court, citation FROM ({_BAG})) b USING (citation) GROUP BY 1, 2) o USING (query_id, court)"


@query(_OVERLAP)
def court_overlap_boost(s, d):
    return cr.overlap_boost(_near(s, d), "court", _court_refs(s, d), _ranked(s, d, 5), 0.05).select("query_id", "court", F.round("cos", 9).alias("cos"))


@query(f"SELECT query_id, citation, round(sum(score), 6) AS score FROM (SELECT query_id, citation, score FROM ({_RANKED}) UNION ALL SELECT DISTINCT t.query_id, t.citation, 0.1 FROM (SELECT query_id, trim(unnest(string_split(pre_citations, ';'))) AS citation FROM test WHERE query_id IS NOT NULL) t WHERE t.citation <> '') GROUP BY 1, 2")
def listed_boost(s, d):
    listed = read_table(s, d, "test", "query_id", "pre_citations").where("query_id IS NOT NULL").select("query_id", F.explode(t.split_list(F.col("pre_citations"))).alias("citation"))
    return cr.boost_listed(_ranked(s, d).select("query_id", "citation", "score"), listed, 0.1).select("query_id", "citation", r6("score"))


@query(f"SELECT query_id, regexp_extract(citation, '{_FORM}', 3) AS book, round(sum(score), 6) AS total, round(max(score), 6) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS k FROM ({_RANKED})) WHERE k <= 10 AND regexp_matches(citation, '{_FORM}') GROUP BY 1, 2")
def best_per_book(s, d):
    return lc.best_per_book(_ranked(s, d).select("query_id", "citation", "score"), "query_id", 10).select("query_id", "book", r6("total"), r6("best"))


_WHOLE_NEAR = _dense(_WHOLE_Q, "query_id", _LAWS_V, "citation", 50)
_POOL = f"SELECT query_id, citation FROM ({_RANKED}) WHERE rank <= 20"


@query(f"SELECT query_id, citation FROM ({_POOL}) UNION ALL SELECT query_id, citation FROM (SELECT n.query_id, n.citation, row_number() OVER (PARTITION BY n.query_id ORDER BY n.rank, n.citation) AS k FROM ({_WHOLE_NEAR}) n ANTI JOIN ({_POOL}) p USING (query_id, citation)) WHERE k <= 5")
def cosine_pool(s, d):
    asked = read_table(s, d, "test", "query_id", "zembed_full_german_query").where("query_id IS NOT NULL")
    near = dense_top_k(asked, "query_id", "zembed_full_german_query", _laws_v(s, d), "citation", "embedding", 50)
    return cr.inject_by_cosine(_ranked(s, d, 20), near, 5)


_CENTRE_LAW = f"SELECT court, pos, avg(x) AS x FROM (SELECT b.court, unnest(l.e)::DOUBLE AS x, generate_subscripts(l.e, 1) AS pos FROM (SELECT DISTINCT court, citation FROM ({_BAG})) b JOIN ({_ONE_V}) l USING (citation)) GROUP BY 1, 2"


@query(f"""WITH m AS (SELECT court, pos, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY court)), 1e-12) AS x FROM ({_CENTRE_LAW})), o AS (SELECT court, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM ({_COURT_V})),
b AS (SELECT o.court, o.pos, o.x AS own, 0.7 * o.x + 0.3 * m.x AS x FROM o LEFT JOIN m USING (court, pos))
SELECT court, round(coalesce(max(CASE WHEN pos = 1 THEN x END) / greatest(sqrt(sum(x * x)), 1e-12), max(CASE WHEN pos = 1 THEN own END)), 6) AS v1 FROM b GROUP BY 1""")
def enriched_courts(s, d):
    laws = read_table(s, d, "laws_db", "citation", "embedding").where(v.usable(F.col("embedding"), 64)).groupBy("citation").agg(F.min("embedding").alias("v"))
    courts = read_table(s, d, "test", "test_id", "zembed_full_german_query").where(v.usable(F.col("zembed_full_german_query"), 64)).withColumn("court", F.col("test_id").cast("string"))
    return cr.enrich_courts(courts, "court", "zembed_full_german_query", _court_refs(s, d), laws, 0.3).select("court", F.round(F.col("v")[0], 6).alias("v1"))
