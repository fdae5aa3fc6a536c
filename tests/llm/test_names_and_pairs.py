import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statuta.llm import names as n
from statuta.llm import pairs as p
from statuta.llm.catalog import QUERIES

WORDS = {"de": {"die", "der", "das", "und", "nicht", "für", "ist"}, "en": {"the", "of", "and", "to", "is"}, "fr": {"la", "le", "de", "et", "pour"}, "it": {"la", "il", "di", "e", "per"}}


def osa(a, b):
    d = {(i, j): max(i, j) if 0 in (i, j) else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


word = st.text("abc", max_size=7)


@settings(max_examples=150, deadline=None)
@given(st.lists(word, max_size=8), word, st.integers(0, 3))
def test_automaton_against_edit_distance(entries, name, k):
    trie = n.Trie({e: {e} for e in entries})
    assert dict(trie.within(name, k)) == {e: osa(e, name) for e in set(entries) if osa(e, name) <= k}


def test_trie_is_small():
    """2,000 entries take under 30 MB, so 20,000 under 300; the search finds all entries in reach."""
    import sys

    r = random.Random(1)
    part = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(4, 7)))
    rows = [{"code": f"C{i}", "title": part() + part() + "gesetz", "name": f"{part()} {part()} Act"} for i in range(2_000)]
    trie = n._trie(rows)
    assert sum(sys.getsizeof(x) for x in (trie.edges, trie.begin, trie.low, trie.high, trie.ends, trie.values, *trie.values)) < 30e6
    twins = n._trie([{"code": "A", "title": "Bachufergesetz", "name": None}, {"code": "B", "title": "Dachufergesetz", "name": None}])
    assert dict(twins.within("bachufergesetz", 3)) == {"A": 0, "B": 1}


REFERENCE = [("TorV", "Torfabbauverordnung", "Peat Cutting Ordinance"), ("KäR", "Käselagerreglement", "Cheese Storage Regulation"), ("SchG", "Schneeräumungsgesetz", "Snow Clearance Act"), ("SchV", "Schneeräumungsverordnung", "Snow Clearance Ordinance"), (None, "Titel", "x"), ("Z", None, None)]
CASES = {
    "TorV": ["torv", "Tor.V.", "TorV12", "Torfabbau-VO", "Torfabbau Verordnung", "PEAT  CUTTING ORD.", "Federal Ordinance on Peat Cutting", "Ordinance, Peat Cutting", '"Peat Cutting" Ordinance', "Torfabbuaverordnung", "ganz falsch (TorV)", "Eidg. Torfabbauverordnung"],
    "KäR": ["Kaselagerreglement", "Kaeselager-Regl.", "Cheese Storrage Reg."],
    "SchV": ["Schneeräumungsverordnung", "Snow clearance ordinanec"],
    "unmatched": ["TorG", "Torfabbaugesetz", "Käselagerverordnung", "Drachenhortgesetz", "", None, "???", "Schneeräumungsreglement", "x" * 20_000],
}


def test_names(spark):
    rows = [(i, x, want) for i, (want, x) in enumerate((w, x) for w, xs in CASES.items() for x in xs)]
    df = spark.createDataFrame(rows + rows[:3], "id int, v string, want string").selectExpr("*", "'a' AS code", "'b' AS name")
    ref = spark.createDataFrame(REFERENCE, "code string, title string, name string")
    out = n.map_names(df, "v", ["id", "want"], ref).collect()
    assert len(out) == len(rows) + 3 and [(r["id"], r["code"]) for r in out if r["code"] != r["want"]] == []
    assert n.map_names(df.limit(0), "v", ["id"], ref).count() == 0
    assert {r["code"] for r in n.map_names(df, "v", ["id"], ref.limit(0)).collect()} == {"unmatched"}


MARKED = ["«{}»", "“{}”", "„{}“", '"{}"', "({})", "[{}]", "'{}'", "‘{}’", "‚{}‘", "‚{}’", "‹{}›"]


def test_statutes_named_in_queries(spark, tmp_path):
    """One row for the name in each kind of mark, matched or not; apostrophes set off nothing."""
    named = [(m, name, want) for m in MARKED for name, want in (("Torfabbuaverordnung", "TorV"), ("Drachenhortgesetz", "unmatched"))]
    queries = [f"The owner's deposit of CHF 1'781 can't follow from {m.format(name)}, say the buyers' heirs." for m, name, _ in named]
    queries += ["Does 'Loi sur l'eau' apply?", "Does ‘Loi sur l’eau’ apply?"]
    want = {(i, w) for i, w in enumerate([w for _, _, w in named] + ["EauL", "EauL"])}
    plain = ["The sum of CHF 1'781 and CHF 2'000'000 can't be disputed.", "The tenants' and the owner's claims, and the heirs' share.", "The tenants’ and the owner’s claims don’t end."]
    rows = [(i, q, None) for i, q in enumerate(queries + plain)]
    spark.createDataFrame(rows, "test_id long, query string, pre_citations string").write.parquet(f"{tmp_path}/test.parquet")
    ref = [(c, t, e) for c, t, e in REFERENCE if c and t] + [("EauL", "Loi sur l'eau", None)]
    spark.createDataFrame(ref, "book_code string, title string, book_description string").write.parquet(f"{tmp_path}/domains.parquet")
    out = QUERIES["p3_found"](spark, str(tmp_path)).collect()
    assert len(out) == len(want) and {(r["test_id"], r["book_code"]) for r in out} == want and {r["entry_no"] for r in out} == {0}


def test_reference_list_in_blocks(spark, monkeypatch):
    ref = spark.createDataFrame(REFERENCE, "code string, title string, name string")
    df = spark.createDataFrame([("Torfabbuaverordnung",), ("Snow Clearance Act",)], "v string")
    monkeypatch.setattr(n, "BLOCK", 2)
    assert sorted(r["code"] for r in n.map_names(df, "v", [], ref).collect()) == ["SchG", "TorV"]


QUERY = "The insurer relies on the act and the court is silent. May the owner revoke the permit within 70 days?"
GERMAN = "Die Versicherung stützt sich auf das Gesetz und das Gericht schweigt. Darf die Eigentümerin die Bewilligung innert 70 Tagen widerrufen?"
TEXTS = {
    "empty": [None, "", " \n", "null", "N/A", "```\n```", '""', "GERMAN LEGAL QUERY:", "-", "[]"],
    "truncated": [GERMAN[:60], GERMAN[:-1] + " der", GERMAN[:70] + " …", "Die Gebühr ist nicht geschuldet nach Abs.", "```\n" + GERMAN],
    "refusal": ["I'm sorry, but I cannot translate this.", "Leider kann ich diese Anfrage nicht bearbeiten.", "As a language model, I must decline to answer.", "Je ne peux pas traduire ce texte.", "Mi dispiace, non posso tradurre."],
    "copy": [QUERY, QUERY.lower(), '"' + QUERY + '"', "Deutsche Übersetzung: " + QUERY, QUERY[:55]],
    "language": ["La assurance et le tribunal, de la loi pour le permis.", "Москва не отвечает на вопросы суда."],
    None: [GERMAN, "```\n" + GERMAN + "\n```", "Deutsche Übersetzung: " + GERMAN, "«" + GERMAN + "»", GERMAN + " (act. 8)", "Das Amt schrieb, es bedaure, nicht helfen zu können. " + GERMAN, GERMAN.replace("Gesetz", "«Act on the Rights of the Owner»")],
}


def first(found):
    return next((x for x in p.ORDER if x in found), None)


@pytest.mark.parametrize("want", list(TEXTS))
def test_text_rules(want):
    assert [(x, first(p.text_defects(QUERY, x, WORDS, "de"))) for x in TEXTS[want]] == [(x, want) for x in TEXTS[want]]


def obj(*texts):
    import json

    return json.dumps({"sub_issues": [{"id": i, "search_query_de": x} for i, x in enumerate(texts)]}, ensure_ascii=False)


OBJECTS = {
    "empty": [None, "{}", "[]", obj(), obj(""), '{"sub_issues": null}'],
    "truncated": [obj("Haftung für die Kosten")[:-9], "```json\n" + obj("Haftung für die Kosten")[:40]],
    "refusal": ['{"error": "I cannot help with this."}', "I must decline to answer.", '{"sub_issues": "Leider kann ich das nicht beantworten."}'],
    "copy": [obj(QUERY), obj("GERMAN LEGAL QUERY: " + QUERY)],
    "language": [obj("Limites de la garantie pour le permis"), obj("Presupposti di la disdetta", "Revoca di il permesso")],
    None: [obj("Haftung für die Kosten"), "```json\n" + obj("Haftung für die Kosten") + "\n```", "Here is the JSON object:\n" + obj("Grenzen der Haftung") + "\n\n"],
}


@pytest.mark.parametrize("want", list(OBJECTS))
def test_object_rules(want):
    got = [(x, first(p.object_defects(QUERY, x, WORDS, "de", "sub_issues", "search_query_de"))) for x in OBJECTS[want]]
    assert got == [(x, want) for x in OBJECTS[want]]


def test_rules_over_tables(spark):
    words = spark.createDataFrame([(k, w) for k, v in WORDS.items() for w in v] + [(None, "x"), ("de", None)], "lang string, word string")
    rows = [(1, "g", QUERY, GERMAN, False), (1, "g", QUERY, GERMAN[:30], False), (2, "g", None, QUERY, False), (3, "d", QUERY, None, True), (4, "g", QUERY, GERMAN + " " + "wort " * 50_000 + ".", False)]
    df = spark.createDataFrame(rows + rows[1:2], "id long, fld string, query string, answer string, is_object boolean").selectExpr("*", "'x' AS defect")
    out = sorted((r["id"], r["defect"]) for r in p.find_defects(df, words).where("priority = 0").collect())
    assert out == [(1, "truncated"), (1, "truncated"), (2, "language"), (3, "empty")]
    assert p.find_defects(df.limit(0), words).count() == 0


def test_long_inputs_are_fast():
    import time

    r, begin = random.Random(1), time.time()
    for text in ("a " * 50_000, "x" + " " * 100_000 + "y", "ich kann " * 20_000, '{"a": ' * 2_000, "".join(r.choice("ab :«(") for _ in range(100_000))):
        p.text_defects(QUERY, text, WORDS, "de")
        p.object_defects(QUERY, text, WORDS, "de", "sub_issues", "search_query_de")
    assert time.time() - begin < 20
