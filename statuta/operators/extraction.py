"""Citations found in running text, as rows.

One grammar reads statute citations: a *phrase* is one article with its details, or several linked by *in Verbindung mit*,
before the book they have in common. It is matched once; what it says is taken apart afterwards, as columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions.text import LIST_MARK, NOISE_BOOKS, NUMBER, book_candidates, citation_parts, expand_numbers, format_citation, genitives, is_self_citation, law_name, normal_docket, split_list

# The grammar, from its parts. It keeps to what Java's and RE2's expressions have in common, so that SQL can read it too.
_S = r"[\s\x{00a0}]"
_ARTICLE = r"[Aa]rt(?:ikel)?\.?"
_PARAGRAPH = r"(?:Abs(?:atz|\.)?|al\.?|cpv\.?)"
_BELOW = r"(?:lit|let|Bst|Buchstabe|Ziffer|Ziff|Satz)\.?"
_BETWEEN = rf"{_S}*(?:{LIST_MARK}|[-–]|bis){_S}*"
_NUMBERS = rf"{NUMBER}(?:{_BETWEEN}{NUMBER})*"
_SIGN = r"(?:[a-z]{1,2}(?:bis|ter)?|\d+[a-z]?(?:bis|ter)?)"
_DETAIL = rf"(?:{_S}*(?:,|und|oder|et)?{_S}*(?:{_PARAGRAPH}{_S}*{_NUMBERS}|{_BELOW}{_S}*{_SIGN}(?:{_BETWEEN}{_SIGN})*))*"
_LINK = rf"{_S}*,?{_S}*(?:in{_S}+Verbindung{_S}+mit|i\.?{_S}?V\.?{_S}?m\.?){_S}*"
_UNIT = rf"{_ARTICLE}{_S}*{_NUMBERS}{_DETAIL}"
#: A book: a word with a capital, of any length, perhaps with footnote digits or a second word in capitals; or a number.
BOOK = rf"(?:[A-ZÄÖÜ][A-Za-zÄÖÜäöüàâçèéêëîïôûùß]*[0-9]{{0,3}}(?:[ \x{{00a0}}][A-Z]{{2,}})?|[0-9]{{3}}(?:\.[0-9]+)+)"
#: Groups: the linked articles, the book. SQL knows no look-ahead and has to leave out phrases with noise afterwards.
PHRASE_SQL = rf"(?:^|[^A-Za-z0-9_])({_UNIT}(?:{_LINK}{_UNIT})*){_S}+({BOOK})"
PHRASE = rf"(?:^|[^A-Za-z0-9_])({_UNIT}(?:{_LINK}{_UNIT})*){_S}+((?!(?i:{'|'.join(NOISE_BOOKS)})(?![A-Za-z])){BOOK})"
#: Groups: article numbers, details.
UNIT = rf"{_ARTICLE}{_S}*({_NUMBERS})({_DETAIL})"
PARAGRAPHS = rf"{_PARAGRAPH}{_S}*({_NUMBERS})"
#: Groups: the article with its details, what may be a law's name (up to the next mark).
NAMED = rf"(?:^|[^A-Za-z0-9_])({_UNIT}){_S}+(?:des|der|dem){_S}+([^,.;:()\[\]\"«»\n]+)"
#: Groups: volume, part, page, consideration.
BGE = r"BGE\s+(\d{1,3})\s+([IVX]+[a-z]?)\s+(\d+)(?:\s+(?:E\.|cons\.?|Erw\.?)\s*((?:[IVX]+\.)?\d+[a-z]?(?:\.\d+[a-z]?)*(?:/[a-z]+|-\d+[a-z]?)?))?"
#: Groups: docket number, consideration.
DOCKET = r"(?:^|[^A-Za-z0-9_])(\d[A-Z]+[_.]\d+/\d{2,4})(?:\s+(?:E\.?|cons\.?|Erw\.?)\s*(\d+[a-z]?(?:\.\d+[a-z]?)*))?"
#: Passes of :func:`all_laws`, by what the phrase looks like.
SHARED, REPEATED, LISTED, SINGLE, BY_NAME = range(5)


#: Law names that stand for a book whatever the titles are.
FIXED_NAMES = {
    "OBLIGATIONENRECHTS": "OR", "ZIVILGESETZBUCHES": "ZGB", "STRAFGESETZBUCHES": "StGB", "BUNDESGERICHTSGESETZES": "BGG", "AUSLÄNDER- UND INTEGRATIONSGESETZES": "AIG",
    "INVALIDENVERSICHERUNGSGESETZES": "IVG", "ARBEITSLOSENVERSICHERUNGSGESETZES": "AVIG", "MEHRWERTSTEUERGESETZES": "MWSTG", "BETREIBUNGS- UND KONKURSGESETZES": "SchKG",
    "KOLLEKTIVANLAGENGESETZES": "KAG", "FINANZMARKTINFRASTRUKTURGESETZES": "FinfraG", "ASYLGESETZES": "AsylG",
}


def mentions(df: DataFrame, keep: list[str], text: str, pattern: str, names: list[str]) -> DataFrame:
    """One row per match: ``keep``, ``pos`` (from 0) and the named groups, empty where a group took no part."""
    groups = F.arrays_zip(*[F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    return df.select(*keep, F.posexplode(groups).alias("pos", "m")).select(*keep, "pos", *[F.col(f"m.{n}").alias(n) for n in names])


def citation_lookup(corpus: DataFrame, citation: str) -> DataFrame:
    """``(book, art, abs, citation)`` of the canonical citations of a corpus; for an article that is there only by its
    paragraphs, the article itself (``abs`` empty) is made up."""
    parts = corpus.select(F.col(citation).alias("citation")).distinct().withColumn("p", citation_parts(F.col("citation"))).where("p IS NOT NULL")
    exact = parts.select(F.upper("p.book").alias("book"), F.lower("p.art").alias("art"), F.lower("p.abs").alias("abs"), "citation", F.col("p.book").alias("b"), F.col("p.art").alias("a"))
    whole = exact.groupBy("book", "art").agg(F.min(F.when(F.col("abs") == "", F.col("citation"))).alias("own"), F.min(F.struct("b", "a")).alias("s"))
    made = whole.select("book", "art", F.lit("").alias("abs"), F.coalesce("own", F.concat_ws(" ", F.lit("Art."), F.col("s.a"), F.col("s.b"))).alias("citation"))
    return exact.where("abs <> ''").groupBy("book", "art", "abs").agg(F.min("citation").alias("citation")).unionByName(made)


def resolve(found: DataFrame, lookup: DataFrame) -> DataFrame:
    """``found(book, art, abs, ...)`` with ``citation``: paragraph of the book, its article, then the same with the
    book's other readings; null if none is known. One join on book and article, the order decided afterwards."""
    asked = found.select("book", "art", "abs").distinct()
    offered = asked.select("*", F.posexplode(book_candidates(F.col("book"))).alias("__n", "__b"), F.lower("art").alias("__art"), F.lower("abs").alias("__asked"))
    known = lookup.select(F.col("book").alias("__b"), F.col("art").alias("__art"), F.col("abs").alias("__abs"), "citation")
    hit = offered.join(known, ["__b", "__art"]).where((F.col("__abs") == F.col("__asked")) | (F.col("__abs") == ""))
    best = hit.groupBy("book", "art", "abs").agg(F.min_by("citation", F.struct("__n", (F.col("__abs") != F.col("__asked")).cast("int"))).alias("citation"))
    return found.join(best, ["book", "art", "abs"], "left")


def phrases(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep, pos, chain, book``: statute phrases; what only looks like a book is none."""
    return mentions(df, keep, text, PHRASE, ["chain", "book"])


def articles(found: DataFrame, chain: str, keep: list[str]) -> DataFrame:
    """``keep, unit, pass, art, abs, detail``: every article and paragraph that a phrase names, in its order.

    ``pass`` tells how: by a book that stands behind a later article, by several paragraph words, by a list, or singly.
    Of a list of articles the details belong to the last; an article without paragraph has an empty ``abs``.
    """
    units = F.arrays_zip(*[F.regexp_extract_all(F.col(chain), F.lit(UNIT), F.lit(i + 1)).alias(n) for i, n in enumerate(("arts", "detail"))])
    rows = found.select(*keep, F.size(units).alias("__n"), F.posexplode(units).alias("unit", "u")).withColumn("__l", F.regexp_extract_all("u.detail", F.lit(PARAGRAPHS), F.lit(1)))
    rows = rows.withColumn("__a", expand_numbers(F.col("u.arts"))).withColumn("__p", F.array_distinct(F.flatten(F.transform("__l", expand_numbers))))
    several = (F.size("__p") > 1) | (F.size("__a") > 1)
    kind = F.when(F.col("unit") < F.col("__n") - 1, SHARED).when(F.size("__l") > 1, REPEATED).when(several, LISTED).otherwise(SINGLE)
    last = F.when(F.size("__p") > 0, F.col("__p")).otherwise(F.array(F.lit("")))
    each = F.flatten(F.transform("__a", lambda a, i: F.transform(F.when(i == F.size("__a") - 1, last).otherwise(F.array(F.lit(""))), lambda p: F.struct(a.alias("art"), p.alias("abs")))))
    return rows.select(*keep, "unit", kind.alias("pass"), F.posexplode(each).alias("sub", "x"), F.col("u.detail").alias("detail")).select(*keep, "unit", "sub", "pass", "x.art", "x.abs", "detail")


def explicit_laws(df: DataFrame, keep: list[str], text: str, lookup: DataFrame) -> DataFrame:
    """``keep, pos, unit, sub, citation``: known statute citations in the order they stand."""
    found = articles(phrases(df, keep, text), "chain", [*keep, "pos", "book"])
    return _resolved(found, [*keep, "pos", "unit", "sub"], lookup)


def _resolved(found: DataFrame, keep: list[str], lookup: DataFrame) -> DataFrame:
    return resolve(found, lookup).where("citation IS NOT NULL").select(*keep, "citation")


def name_aliases(titles: DataFrame, title: str, book: str, order: str, fixed: dict[str, str] | None = None) -> DataFrame:
    """``(alias, book)``: law names in capitals, with genitives: the title, what stands in its parentheses and behind
    its ``über`` or ``betreffend``; of several laws of one name the first in ``order``."""
    general = ("GESETZ", "VERORDNUNG", "BUNDESGESETZ")
    main = F.split(F.col(title), " - ", 2)[0]
    pieces = F.filter(F.transform(F.flatten(F.transform(F.regexp_extract_all(main, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda x: F.split(x, ","))), law_name), lambda x: x != F.upper(book))
    short = law_name(F.regexp_extract(F.regexp_replace(main, r"(?i)\bvom\s+\d{1,2}\..*$", ""), r"(?i)\b(?:über|betreffend)\s+(?:(?:das|die|den|der)\s+)?(.+)$", 1))
    names = F.concat(F.array(law_name(F.col(title))), pieces, F.array(short))
    named = titles.select(F.explode(F.flatten(F.transform(names, genitives))).alias("alias"), F.upper(book).alias("book"), F.col(order).cast("long").alias("o"))
    if fixed:
        more = titles.sparkSession.createDataFrame([(a, b.upper(), -1) for a, b in fixed.items()], "alias string, book string, o long")
        named = named.unionByName(more)
    return named.where((F.length("alias") >= 5) & ~F.col("alias").isin(*general)).groupBy("alias").agg(F.min_by("book", F.struct("o", "book")).alias("book"))


def named_laws(df: DataFrame, keep: list[str], text: str, aliases: DataFrame, how: str = "inner") -> DataFrame:
    """``keep, pos, unit, sub, art, abs, book``: articles of laws called by name (``Art. 1 des ...``); with ``how`` =
    ``left``, unknown names too, with a null book and their ``alias``."""
    found = mentions(df, keep, text, NAMED, ["chain", "name"])
    name = F.split("name", rf"{_S}+(?:und|oder|sowie){_S}+{_ARTICLE}{_S}*[0-9]")[0]
    rows = articles(found.withColumn("alias", law_name(name)), "chain", [*keep, "pos", "alias"])
    return prefix_match(rows, "alias", aliases, how=how)


def all_laws(df: DataFrame, key: str, text: str, lookup: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``key, citation, place``: citations of all kinds (shared book, repeated paragraphs, lists and ranges, single ones,
    named laws), each once, in the order of kind and position."""
    cols = [key, "pass", "pos", "unit", "sub", "art", "abs", "book"]
    found = articles(phrases(df, [key], text), "chain", [key, "pos", "book"]).select(*cols)
    if aliases is not None:
        found = found.unionByName(named_laws(df, [key], text, aliases).withColumn("pass", F.lit(BY_NAME)).select(*cols))
    known = resolve(found, lookup).where("citation IS NOT NULL")
    first = known.groupBy(key, "citation").agg(F.min(F.struct("pass", "pos", "unit", "sub")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at", "citation"))).drop("at")


def prefix_match(found: DataFrame, name: str, aliases: DataFrame, least: int = 6, how: str = "inner") -> DataFrame:
    """``found`` with ``book``: the alias that is the name or its longest beginning at a word's end. Every beginning of
    a name, as far as the longest alias goes, is looked up by equality: there is no comparison of all names with all
    aliases, and a name of any length gives only so many beginnings."""
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    words = F.slice(F.split("__n", " "), 1, longest)
    tried = found.select(F.col(name).alias("__n")).distinct().withColumn("alias", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " "))))
    tried = tried.where((F.col("alias") == F.col("__n")) | (F.length("alias") >= least))
    best = tried.join(aliases, "alias").groupBy("__n").agg(F.max_by("book", F.length("alias")).alias("book"))
    return found.drop("book").join(best, F.col(name) == F.col("__n"), how).drop("__n")


def court_references(df: DataFrame, citation: str, text: str, courts: DataFrame | None = None) -> DataFrame:
    """``citation, ref, place``: decisions referred to, without the document itself; a docket stands for its decision
    too. With ``courts(citation)``, only known ones."""
    bge = mentions(df, [citation], text, BGE, ["vol", "part", "page", "e"])
    bge = bge.select(citation, F.lit(0).alias("pass"), "pos", F.concat(F.lit("BGE "), "vol", F.lit(" "), "part", F.lit(" "), "page", F.when(F.col("e") != "", F.concat(F.lit(" E. "), "e")).otherwise("")).alias("ref"))
    docket = mentions(df, [citation], text, DOCKET, ["docket", "e"]).withColumn("d", normal_docket(F.col("docket")))
    both = F.array_compact(F.array(F.when(F.col("e") != "", F.concat("d", F.lit(" E. "), "e")), F.col("d")))
    docket = docket.select(citation, F.lit(1).alias("pass"), "pos", F.explode(both).alias("ref"))
    found = bge.unionByName(docket).where(~F.coalesce(is_self_citation(F.col(citation), F.col("ref")), F.lit(False)))
    first = found.groupBy(citation, "ref").agg(F.min(F.struct("pass", "pos")).alias("at"))
    if courts is not None:
        first = first.join(courts.select(F.col(courts.columns[0]).alias("ref")).distinct(), "ref", "left_semi")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(citation).orderBy("at", "ref"))).select(citation, "ref", "place")


def rebuild_corpus(df: DataFrame, citation: str, text: str, lookup: DataFrame, order: str) -> DataFrame:
    """``citation, law_references, court_references``: documents with at least one statute citation, each citation once
    (first in ``order``), with its statutes and with the decisions it refers to among these documents."""
    if citation == "citation":
        raise ValueError("name the document's citation other than 'citation'")
    one = df.where(F.col(citation).isNotNull()).groupBy(citation).agg(F.min_by(text, order).alias(text))
    laws = explicit_laws(one, [citation], text, lookup)
    lists = laws.groupBy(citation, F.col("citation").alias("c")).agg(F.min(F.struct("pos", "unit", "sub")).alias("p"))
    statutes = lists.groupBy(citation).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "c"))), lambda x: x["c"]).alias("law_references"))
    refs = court_references(one.join(statutes, citation, "left_semi"), citation, text, statutes.select(citation))
    courts = refs.groupBy(citation).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ref"))), lambda x: x["ref"]).alias("court_references"))
    out = statutes.join(courts, citation, "left")
    return out.select(citation, F.array_join("law_references", ";").alias("law_references"), F.array_join(F.coalesce("court_references", F.array().cast("array<string>")), ";").alias("court_references"))


def prune_articles(refs: DataFrame, keys: list[str], citation: str) -> DataFrame:
    """References without those to a whole article of which a paragraph is referred to as well."""
    p = citation_parts(F.col(citation))
    marked = refs.withColumn("__b", p["book"]).withColumn("__a", p["art"]).withColumn("__p", F.coalesce(p["abs"], F.lit("")) != "")
    finer = F.max("__p").over(Window.partitionBy(*keys, "__b", "__a"))
    return marked.withColumn("__f", finer).where(F.col("__p") | ~F.coalesce("__f", F.lit(False)) | F.col("__a").isNull()).drop("__b", "__a", "__p", "__f")


def law_edges(df: DataFrame, citation: str, text: str, lookup: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``source, target, kind, mention, source_book, target_book``: edges from law to law, each once.

    ``explicit``: by a citation with a known book; ``named``: by a law's name, with ``aliases``; ``internal``: by an
    article without a book, which then is one of the same book. A stretch of text counts for one kind only, in this
    order; a phrase whose last word is no known book has no book, so its articles are internal, unless its articles go on
    to a known one (``Art. 19, 19a und 20 BVG``). Loops and targets that aren't known are left out.
    """
    parts = citation_parts(F.col(citation))
    rows = df.select(F.col(citation).alias("source"), F.col(text).alias("t"), parts["book"].alias("own")).where("t IS NOT NULL AND source IS NOT NULL")
    keys = ["source", "own", "mention"]
    spoken = phrases(rows, ["source", "own"], "t").withColumn("mention", F.concat_ws(" ", "chain", "book"))
    books = lookup.select("book").distinct()
    with_book = spoken.join(_known_books(spoken, books), "book", "left")
    mine = lambda found, kind: _resolved(found.select("art", "abs", "book", *keys), [*keys, "book"], lookup).withColumn("kind", F.lit(kind))
    found = mine(articles(with_book.where("known"), "chain", [*keys, "book"]), "explicit")
    bare = articles(with_book.where("known IS NULL AND own IS NOT NULL").drop("book"), "chain", keys)
    rest = rows.withColumn("t", F.regexp_replace("t", PHRASE, " ; "))
    if aliases is not None:
        named = named_laws(rest, ["source", "own"], "t", aliases).withColumn("mention", F.concat_ws(" ", F.lit("Art."), "art", "alias"))
        found = found.unionByName(mine(named, "named"))
    inner = mentions(rest.withColumn("t", F.regexp_replace("t", NAMED, " ; ")).where("own IS NOT NULL"), ["source", "own"], "t", rf"(?:^|[^A-Za-z0-9_])({_UNIT})", ["chain"])
    bare = bare.unionByName(articles(inner.withColumn("mention", F.col("chain")), "chain", keys))
    found = found.unionByName(mine(bare.withColumn("book", F.col("own")), "internal"))
    out = found.where("source <> citation").groupBy("source", F.col("citation").alias("target")).agg(F.min(F.struct("kind", "mention", "own")).alias("e"))
    return out.select("source", "target", "e.kind", "e.mention", F.col("e.own").alias("source_book"), citation_parts(F.col("target"))["book"].alias("target_book"))


def _known_books(found: DataFrame, books: DataFrame) -> DataFrame:
    """``(book, known)`` of the written books that can be read as a known one."""
    asked = found.select("book").distinct().select("book", F.explode(book_candidates(F.col("book"))).alias("__b"))
    return asked.join(books.select(F.col("book").alias("__b")), "__b", "left_semi").select("book", F.lit(True).alias("known")).distinct()


def unmatched_names(df: DataFrame, text: str, aliases: DataFrame, most: int = 100) -> DataFrame:
    """``alias, n``: the ``most`` frequent names of laws that no alias explains."""
    lost = named_laws(df, [], text, aliases, how="left").where("book IS NULL")
    return lost.groupBy("alias").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "alias").limit(most)


def query_hints(queries: DataFrame, query: str, near: str, pre: str, texts: list[str], corpus: DataFrame, citation: str) -> DataFrame:
    """``query, citation, place``: known citations from the near list, then the given list, then the texts, each once."""
    known = corpus.select(F.col(citation).alias("citation")).distinct()
    lists = [queries.select(query, F.lit(i).alias("src"), F.posexplode(split_list(F.col(c))).alias("pos", "citation"), F.lit(0).alias("unit"), F.lit(0).alias("sub")) for i, c in enumerate((near, pre))]
    text = queries.select(query, F.concat_ws("\n", *texts).alias("t"))
    spoken = explicit_laws(text, [query], "t", citation_lookup(corpus, citation)).select(query, F.lit(2).alias("src"), "pos", "citation", "unit", "sub")
    first = reduce(DataFrame.unionByName, [*lists, spoken]).join(known, "citation", "left_semi").groupBy(query, "citation").agg(F.min(F.struct("src", "pos", "unit", "sub")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("at", "citation"))).drop("at")


def hinted_books(queries: DataFrame, query: str, lists: list[str], texts: list[str], books: DataFrame) -> DataFrame:
    """``query, book``: every known book that a list or text names behind an article, whether or not the article is
    known. ``books(book)``."""
    whole = queries.select(query, F.concat_ws("\n", *texts, *lists).alias("t"))
    asked = phrases(whole, [query], "t").select(query, "book").distinct()
    tried = asked.select(query, "book", F.posexplode(book_candidates(F.col("book"))).alias("n", "upper"))
    known = books.select(F.upper("book").alias("upper"), F.col("book").alias("known")).groupBy("upper").agg(F.min("known").alias("known"))
    return tried.join(known, "upper").groupBy(query, "book").agg(F.min_by("known", "n").alias("known")).select(query, F.col("known").alias("book")).distinct()


def article_index(corpus: DataFrame, citation: str, excluded: DataFrame | None = None) -> DataFrame:
    """``(book, art, citations)``: all citations of an article, sorted; ``excluded(citation)`` left out."""
    rows = corpus.select(F.col(citation).alias("citation")).distinct()
    if excluded is not None:
        rows = rows.join(excluded.select(F.col(excluded.columns[0]).alias("citation")), "citation", "left_anti")
    rows = rows.withColumn("p", citation_parts(F.col("citation"))).where("p IS NOT NULL")
    return rows.groupBy(F.col("p.book").alias("book"), F.col("p.art").alias("art")).agg(F.array_sort(F.collect_set("citation")).alias("citations"))


def query_mentions(queries: DataFrame, query: str, text: str, index: DataFrame) -> DataFrame:
    """``query, pos, unit, sub, pre_citation, near``: each citation written in a query, in canonical form, and the
    citations of its article that the corpus has."""
    found = articles(phrases(queries, [query], text), "chain", [query, "pos", "book"])
    letter = F.regexp_extract("detail", rf"(?:lit|let|Bst)\.?{_S}*([a-z])", 1)
    pre: Column = format_citation(F.col("art"), F.col("abs"), letter, F.col("book"))
    return found.join(index, ["book", "art"], "left").select(query, "pos", "unit", "sub", pre.alias("pre_citation"), F.coalesce("citations", F.array().cast("array<string>")).alias("near"))


def pre_citation_columns(queries: DataFrame, query: str, text: str, index: DataFrame) -> DataFrame:
    """``query, pre_citations, pre_near_matches``: the two hint columns of every query, in order of mention, each entry
    once, joined by ``;``; empty for a query that cites nothing."""
    found = query_mentions(queries, query, text, index).withColumn("at", F.struct("pos", "unit", "sub"))
    joined = lambda rows, item: rows.groupBy(query, item).agg(F.min("at").alias("at")).groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", item))), lambda x: x[item]), ";").alias(item))
    pre = joined(found, "pre_citation")
    near = joined(found.select(query, F.posexplode("near").alias("k", "near_match"), F.struct("at.pos", "at.unit", "at.sub", "k").alias("at")), "near_match")
    out = queries.select(query).distinct().join(pre, query, "left").join(near, query, "left")
    return out.select(query, F.coalesce("pre_citation", F.lit("")).alias("pre_citations"), F.coalesce("near_match", F.lit("")).alias("pre_near_matches"))


def compare_generated(expected: DataFrame, generated: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key`` with, for each column, whether the generated value is the expected one (null equals null); a key that
    wasn't generated has ``generated`` false."""
    made = generated.select(key, F.lit(True).alias("generated"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = expected.select(key, *columns).join(made, key, "left")
    return both.select(key, F.coalesce("generated", F.lit(False)).alias("generated"), *[F.col(c).eqNullSafe(F.col(f"__{c}")).alias(f"same_{c}") for c in columns])
