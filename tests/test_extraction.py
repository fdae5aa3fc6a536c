from statuta.operators import extraction as ex

CORPUS = ["Art. 5 Abs. 1 BV", "Art. 5 Abs. 2 BV", "Art. 5 Abs. 3 BV", "Art. 9 BV", "Art. 41 OR", "Art. 1 Abs. 1 ZGB"]


def lookup(spark):
    return ex.citation_lookup(spark.createDataFrame([(c,) for c in CORPUS], "citation string"), "citation")


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string")


def test_lookup_makes_up_articles(spark):
    rows = {(r["book"], r["art"], r["abs"]): r["citation"] for r in lookup(spark).collect()}
    assert rows["BV", "5", ""] == "Art. 5 BV" and rows["BV", "9", ""] == "Art. 9 BV" and len(rows) == 8


def test_explicit_and_fallback(spark):
    found = ex.explicit_laws(docs(spark, "Nach Art. 5 Abs. 2 BV und Art. 9 Abs. 7 BV2 sowie Art. 99 BV", None, ""), ["id"], "t", lookup(spark))
    assert [r["citation"] for r in found.orderBy("pos", "unit", "sub").collect()] == ["Art. 5 Abs. 2 BV", "Art. 9 BV"]


def test_five_passes(spark):
    names = spark.createDataFrame([("Obligationenrecht", "OR", 1)], "title string, code string, o int")
    aliases = ex.name_aliases(names, "title", "code", "o")
    text = "Art. 9 i.V.m. Art. 1 BV; Art. 5 Abs. 1-3 BV; Art. 1 Abs. 1 ZGB; Art. 41 des Obligationenrechts."
    got = [r["citation"] for r in ex.all_laws(docs(spark, text), "id", "t", lookup(spark), aliases).orderBy("place").collect()]
    assert got[0] == "Art. 9 BV" and set(got) == {*CORPUS} - {"Art. 5 BV"}


def test_prefix_match_takes_the_longest(spark):
    al = spark.createDataFrame([("BUNDES", "X"), ("BUNDESGESETZ UEBER", "Y"), ("KURZ", "Z")], "alias string, book string")
    found = spark.createDataFrame([("BUNDESGESETZ UEBER ALLES",), ("KURZ",), ("KURZ UND GUT",)], "n string")
    assert {r["n"]: r["book"] for r in ex.prefix_match(found, "n", al).collect()} == {"BUNDESGESETZ UEBER ALLES": "Y", "KURZ": "Z"}


def test_court_references(spark):
    df = spark.createDataFrame([("1A_1/2000 E. 2", "vgl. BGE 120 II 3 E. 4a, 1A.1/2000 und 5B.7/1999 E. 1.2")], "doc string, t string")
    refs = [r["ref"] for r in ex.court_references(df, "doc", "t").orderBy("place").collect()]
    assert refs == ["BGE 120 II 3 E. 4a", "5B_7/1999", "5B_7/1999 E. 1.2"] or refs == ["BGE 120 II 3 E. 4a", "5B_7/1999 E. 1.2", "5B_7/1999"]
    known = spark.createDataFrame([("5B_7/1999",)], "c string")
    assert [r["ref"] for r in ex.court_references(df, "doc", "t", known).collect()] == ["5B_7/1999"]


def test_rebuild_prune_edges_hints(spark):
    df = spark.createDataFrame([("1A_1/2000", "Art. 9 BV und 1A_2/2000", 1), ("1A_2/2000", "Art. 41 OR", 2), ("1A_2/2000", "spätere Fassung", 3), ("1A_3/2000", "nichts", 4)], "doc string, t string, o int")
    out = {r["doc"]: (r["law_references"], r["court_references"]) for r in ex.rebuild_corpus(df, "doc", "t", lookup(spark), "o").collect()}
    assert out == {"1A_1/2000": ("Art. 9 BV", "1A_2/2000"), "1A_2/2000": ("Art. 41 OR", "")}
    refs = spark.createDataFrame([("d", "Art. 5 BV"), ("d", "Art. 5 Abs. 1 BV"), ("d", "Art. 9 BV")], "d string, c string")
    assert {r["c"] for r in ex.prune_articles(refs, ["d"], "c").collect()} == {"Art. 5 Abs. 1 BV", "Art. 9 BV"}
    laws = spark.createDataFrame([("Art. 9 BV", "Siehe Art. 41 OR und Art. 5 Abs. 1."), ("Art. 41 OR", "Siehe Art. 41 OR.")], "citation string, t string")
    assert {(r["source"], r["target"], r["kind"]) for r in ex.law_edges(laws, "citation", "t", lookup(spark)).collect()} == {("Art. 9 BV", "Art. 41 OR", "explicit"), ("Art. 9 BV", "Art. 5 Abs. 1 BV", "internal")}
    q = spark.createDataFrame([("q", "Art. 9 BV; Art. 77 X", "Art. 41 OR", "nach Art. 1 Abs. 1 ZGB und Art. 9 BV")], "q string, near string, pre string, t string")
    corpus = spark.createDataFrame([(c,) for c in CORPUS], "citation string")
    assert [r["citation"] for r in ex.query_hints(q, "q", "near", "pre", ["t"], corpus, "citation").orderBy("place").collect()] == ["Art. 9 BV", "Art. 41 OR", "Art. 1 Abs. 1 ZGB"]
    m = ex.query_mentions(q, "q", "t", ex.article_index(corpus, "citation")).orderBy("pos").collect()
    assert [(r["pre_citation"], r["near"]) for r in m] == [("Art. 1 Abs. 1 ZGB", ["Art. 1 Abs. 1 ZGB"]), ("Art. 9 BV", ["Art. 9 BV"])]


def test_edges_by_name(spark):
    titles = spark.createDataFrame([("Bundesgesetz über die Moorpflege (Moorgesetz, MoG) - Umwelt", "ZGB", 1)], "title string, code string, o int")
    aliases = ex.name_aliases(titles, "title", "code", "o", ex.FIXED_NAMES)
    assert {"MOORGESETZ", "MOORGESETZES"} <= {r["alias"] for r in aliases.collect()}
    laws = spark.createDataFrame([("Art. 9 BV", "Siehe Art. 41 des Obligationenrechts, Art. 1 Abs. 1 des Moorgesetzes, Art. 51 der Drachenverordnung.")], "citation string, t string")
    got = {(r["target"], r["kind"]) for r in ex.law_edges(laws, "citation", "t", lookup(spark), aliases).collect()}
    assert got == {("Art. 41 OR", "named"), ("Art. 1 Abs. 1 ZGB", "named")}


def test_forms_of_the_grammar(spark):
    """Lettered lists, any number of paragraphs, long and two-word and numbered books, ordinals, no-break spaces."""
    corpus = [(f"Art. {x}",) for x in ("5 Abs. 2 BV", "3 OR", "4 VO EU", "12 142.11", "8 Bundesgerichtsgesetz", "6 Abs. 2novies BV", "7 Abs. 1 BV", "19 BVG", "19a BVG", "20 BVG")] + [(f"Art. 9 Abs. {i} BV",) for i in range(1, 13)]
    look = ex.citation_lookup(spark.createDataFrame(corpus, "citation string"), "citation")
    many = "Art. 9 " + " und ".join(f"Abs. {i} lit. a" for i in range(1, 13)) + " BV"
    texts = ["Art. 5 Abs. 2 lit. a und b BV", "Art. 3 Ziff. 2 lit. a OR", "Art. 4 VO EU.", "Art. 12 142.11", "nach Art. 8 Bundesgerichtsgesetz", "Art. 6 Abs. 2novies BV", "Artikel\u00a07\u00a0Absatz 1 BV", many, "Artikel 19, 19a und 20 BVG", "Art. 5 Absatz", "Art. 5 Abs. 2 Das"]
    got = {}
    for r in ex.explicit_laws(docs(spark, *texts), ["id"], "t", look).orderBy("id", "pos", "unit", "sub").collect():
        got.setdefault(r["id"], []).append(r["citation"])
    assert [got.get(i) for i in range(7)] == [[c[0]] for c in corpus[:7]]
    assert got[7] == [c[0] for c in corpus[10:]] and got[8] == ["Art. 19 BVG", "Art. 19a BVG", "Art. 20 BVG"]
    assert 9 not in got and 10 not in got


def test_internal_and_foreign(spark):
    laws = spark.createDataFrame([("Art. 9 BV", "Nach Artikel 5 Gebühren; siehe Art. 41, 42 und 43 OR sowie Artikel 5 Absatz 2."), (None, "Art. 41 OR"), ("BGE 1 II 3", "Art. 41 OR, Art. 5.")], "citation string, t string")
    got = {(r["source"], r["target"], r["kind"], r["source_book"], r["target_book"]) for r in ex.law_edges(laws, "citation", "t", lookup(spark)).collect()}
    assert got == {("Art. 9 BV", "Art. 5 BV", "internal", "BV", "BV"), ("Art. 9 BV", "Art. 5 Abs. 2 BV", "internal", "BV", "BV"), ("Art. 9 BV", "Art. 41 OR", "explicit", "BV", "OR"), ("BGE 1 II 3", "Art. 41 OR", "explicit", None, "OR")}
    al = spark.createDataFrame([("DRACHENVERORDNUNG", "X")], "alias string, book string")
    df = docs(spark, "Art. 1 der Flussverordnung, Art. 2 der Flussverordnung; Art. 1 der Drachenverordnung; " + "Art. 3 des " + "w " * 30_000)
    assert [(r["alias"], r["n"]) for r in ex.unmatched_names(df, "t", al).collect() if len(r["alias"]) < 50] == [("FLUSSVERORDNUNG", 2)]


def test_hint_columns_and_comparison(spark):
    q = spark.createDataFrame([("q", "nach Art. 5 Abs. 1 lit. b BV, Art. 9 BV und Art. 9 BV"), ("r", None)], "q string, t string")
    made = ex.pre_citation_columns(q, "q", "t", ex.article_index(spark.createDataFrame([(c,) for c in CORPUS], "citation string"), "citation"))
    rows = {r["q"]: (r["pre_citations"], r["pre_near_matches"]) for r in made.collect()}
    assert rows == {"q": ("Art. 5 Abs. 1 lit. b BV;Art. 9 BV", "Art. 5 Abs. 1 BV;Art. 5 Abs. 2 BV;Art. 5 Abs. 3 BV;Art. 9 BV"), "r": ("", "")}
    expected = spark.createDataFrame([("q", "Art. 9 BV", None), ("r", "", ""), ("s", None, None)], "q string, pre_citations string, pre_near_matches string")
    got = {r["q"]: (r["generated"], r["same_pre_citations"], r["same_pre_near_matches"]) for r in ex.compare_generated(expected, made, "q", ["pre_citations", "pre_near_matches"]).collect()}
    assert got == {"q": (True, False, False), "r": (True, True, True), "s": (False, True, True)}
    books = spark.createDataFrame([("BV",), ("OR",)], "book string")
    hints = spark.createDataFrame([("q", "Art. 999 BV", "siehe Art. 1 cc und Art. 2 OR3")], "q string, a string, b string")
    assert {r["book"] for r in ex.hinted_books(hints, "q", ["a"], ["b"], books).collect()} == {"BV", "OR"}
