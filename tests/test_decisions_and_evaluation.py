import pytest

from statuta.operators import decisions as d
from statuta.operators import evaluation as ev
from statuta.plans import rerank as rr


def test_reading_answers(spark):
    raw = [
        '```json\n[{"label": "a", "decision": "remove"}, {"label": "B", "decision": "MAYBE"}]\n```',
        '{"label": "B", "decision": "KEEP"}',
        '[{"label": "A", "decision": "KEEP"},',
        None,
        "7",
        '[{"label": "A", "decision": "KEEP"}, {"label": "A", "decision": "REMOVE"}]',
        'So: [1, {"label": " c ", "decision": "Keep"}, {"label": "", "decision": "KEEP"}, []] and so on',
        '{"label": "A", "why": "x", "decision": "MAYBE"}, {"label": "B", "decision": "REMOVE"}, {"label": "E", "decision": "KEEP"}',
        "",
        "``` ```",
        "[]",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string")
    got = [(dict(r["p"]["decisions"]), r["p"]["diagnostic"]) for r in df.select("i", d.parse_decisions(df["raw"]).alias("p")).orderBy("i").collect()]
    assert got[0] == ({"A": "REMOVE"}, "")
    assert got[1] == ({"B": "KEEP"}, "json_root_not_list_regex_fallback")
    assert got[2] == ({"A": "KEEP"}, "json_decode_error_regex_fallback")
    assert got[3] == ({}, "json_decode_error") and got[4] == ({}, "json_root_not_list")
    assert got[5] == ({"A": "REMOVE"}, "") and got[6] == ({"C": "KEEP"}, "")
    assert got[7] == ({"A": "REMOVE"}, "json_decode_error_regex_fallback")
    assert got[8][0] == got[9][0] == {} and got[10] == ({}, "")


def test_removals_need_two_votes(spark):
    first = spark.createDataFrame([("q", "a", "REMOVE"), ("q", "b", "REMOVE"), ("q", "c", "KEEP")], "query_id string, citation string, decision string")
    second = spark.createDataFrame([("q", "a", "REMOVE"), ("q", "c", "REMOVE"), ("q", "z", "REMOVE")], "query_id string, citation string, decision string")
    assert {r["citation"]: r["decision"] for r in d.confirm_removals(first, second, ["query_id", "citation"]).collect()} == {"a": "REMOVE", "b": "KEEP", "c": "KEEP"}


def test_quality(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, True), (None, None)], "gold boolean, removed boolean")
    r = d.removal_quality(rows, "gold", "removed").first()
    assert (r["gold"], r["noise"], r["removed"]) == (2, 3, 3) and r["gold_removal_rate"] == 0.5 and r["balance"] == pytest.approx(2 / 3 - 1.5)


def test_f1(spark):
    df = spark.createDataFrame([("1", ["a", "b", "c"], ["a", "b"]), ("2", [], ["a"]), ("3", [], []), ("4", None, None), ("5", ["x", "x"], ["x"])], "q string, predicted array<string>, gold array<string>")
    assert [r[0] for r in df.orderBy("q").select(ev.f1(df["predicted"], df["gold"])).collect()] == [pytest.approx(0.8), 0.0, 1.0, 1.0, 1.0]
    assert ev.score(df.where("q = '3'"), empty_both=0.0).first()["macro_f1"] == 0.0
    s = ev.score(df.where("q in ('1','2')")).first()
    assert s["macro_f1"] == pytest.approx(0.4) and s["micro_f1"] == pytest.approx(2 * 2 / 6) and s["hits"] == 2
    assert ev.score(df.limit(0)).first()["macro_f1"] == 0.0
    gold = spark.createDataFrame([("1", ["a"])], "q string, gold array<string>")
    assert ev.judge(df.drop("gold"), gold, "q").count() == 1 and ev.judge(df.drop("gold"), gold, "q", missing_gold="empty").count() == 5


def test_rerank_in_frozen_places(spark):
    rows = [("q", "a", 1, "P", "text", 0.1), ("q", "b", 2, "S", "text", 0.2), ("q", "c", 3, "S", "", 0.9), ("q", "d", 4, "S", "text", 0.8), ("q", "e", 5, "S", "text", 1.0)]
    cand = spark.createDataFrame(rows, "query_id string, citation string, rank int, book string, document string, tfidf double")
    cache = spark.createDataFrame([("q", "b", 0.1), ("q", "d", 0.9)], "query_id string, citation string, score double")
    out = rr.rerank(cand, cache, {"tfidf": 0.5, "cross_encoder": 0.5}, 4, procedural=spark.createDataFrame([("P",)], "book string"))
    assert {r["citation"]: r["final_rank"] for r in out.collect()} == {"a": 1, "d": 2, "c": 3, "b": 4, "e": 5}
    fresh = rr.rerank(cand, cache.limit(0), {"cross_encoder": 1.0}, 4, score_batch=lambda b: b.assign(score=b["citation"].map({"b": 1.0, "d": 0.0, "a": 5.0, "e": 0.0})))
    assert fresh.where("citation = 'e'").first()["combined"] is None and fresh.where("citation = 'a'").first()["final_rank"] == 1


def test_judge_keeps_what_is_not_answered(spark):
    rows = spark.createDataFrame([("q", 0, x, "Frage", f"Art. {i} A", "Text", ["c"]) for i, x in enumerate("ABC")], "query_id string, batch_id int, label string, query string, citation string, document string, contexts array<string>")
    asked = rr.prompts(rows, "Judge.")
    say = lambda answer: (lambda prompts: [answer] * len(prompts))
    yes = '[{"label": "A", "decision": "REMOVE"}, {"label": "B", "decision": "REMOVE"}]'
    one = rr.judge(asked, say(yes))
    two = rr.judge(asked, say(yes), say('[{"label": "A", "decision": "REMOVE"}]'))
    as_map = lambda df: {r["citation"]: r["decision"] for r in df.collect()}
    assert as_map(one) == {"Art. 0 A": "REMOVE", "Art. 1 A": "REMOVE", "Art. 2 A": "KEEP"}
    assert as_map(two) == {"Art. 0 A": "REMOVE", "Art. 1 A": "KEEP", "Art. 2 A": "KEEP"}
    ranked = spark.createDataFrame([("q", f"Art. {i} A", i + 1) for i in range(3)], "query_id string, citation string, rank int")
    assert [r["citation"] for r in rr.apply_decisions(ranked, two).orderBy("final_rank").collect()] == ["Art. 1 A", "Art. 2 A"]


def test_contexts(spark):
    cand = spark.createDataFrame([("q", "a")], "query_id string, citation string")
    refs = spark.createDataFrame([("k1", "a"), ("k2", "a"), ("k3", "b")], "court string, citation string")
    courts = spark.createDataFrame([("k1", "one", [1.0, 0.0]), ("k2", "two", [0.0, 1.0]), ("k3", "three", [1.0, 1.0])], "court string, document string, v array<double>")
    q = spark.createDataFrame([("q", [0.1, 1.0])], "query_id string, v array<double>")
    assert rr.contexts(cand, refs, courts, q, 1).first()["contexts"] == ["two"]
