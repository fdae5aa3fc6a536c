"""Packed fields: the split against a brute-force version, and the defined results of odd input."""

import re

import pytest

from statuta.operators.packed import SplitSpec, delimiter_scores, split_packed

ITEMS = ["Art. 1 Abs. 2 TorV", "Artikel 3 KäR", 'Art. 5 "Tunnel" Act', "Art. 7, Satz 2 WalV", "art. 9 torv", "Art.2 Abs.1 Act, Bee Keeping"]


def rows(spark, texts):
    return spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id long, src string, t string")


def got(df, **kw):
    out = {}
    for r in split_packed(df, "t", "src", ["id"], **kw).orderBy("id", "pos").collect():
        out.setdefault(r["id"], []).append(r["item"])
    return out


@pytest.mark.parametrize("sep", [";", "; ", "|", " | ", " / ", "\n", "\r\n", "\t", ", ", " ;", ";;", "| |"])
def test_round_trip_of_every_delimiter(spark, sep):
    quoted = ['"' + x.replace('"', '""') + '"' for x in ITEMS]
    assert got(rows(spark, [sep.join(quoted)]))[0] == ITEMS


def test_json_and_pads_and_mixed(spark):
    texts = ['["Art. 1 A", "Art. 2 B"]', "  ; Art. 1 A;;Art. 2 B ;", "Art. 1 A\nArt. 2 B / Art. 3 C, 'Art. 4 D'", "Art. 7, Satz 2 WalV;Art. 8 X"]
    assert list(got(rows(spark, texts)).values()) == [["Art. 1 A", "Art. 2 B"], ["Art. 1 A", "Art. 2 B"], ["Art. 1 A", "Art. 2 B", "Art. 3 C", "Art. 4 D"], ["Art. 7, Satz 2 WalV", "Art. 8 X"]]


def test_nothing_repeats_and_long(spark):
    long = ";".join(["Art. 1 A"] * 5000)
    out = got(rows(spark, [None, "", "  ", ";", "no citation", "Art. 1 A;Art. 1 A", long, "x" * 100_000]))
    assert set(out) == {5, 6} and out[5] == ["Art. 1 A"] * 2 and len(out[6]) == 5000


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "s", "Art. 1 A;Art. 2 B", "x", 7)], "id long, src string, t string, item string, pos int")
    assert got(df) == {1: ["Art. 1 A", "Art. 2 B"]}
    assert split_packed(df.limit(0), "t", "src", ["id"]).count() == 0
    assert delimiter_scores(df.limit(0), "t", "src").count() == 0


def test_inner_commas_are_no_delimiters(spark):
    df = rows(spark, ["Art. 1, Satz 2 A", "Art. 2, Satz 1 B;Art. 3, Satz 1 C"])
    scores = {(r["habit"], r["delimiter"]): r for r in delimiter_scores(df, "t", "src").collect()}
    assert not any(r["accepted"] for (_, name), r in scores.items() if name == "comma")
    assert got(df) == {0: ["Art. 1, Satz 2 A"], 1: ["Art. 2, Satz 1 B", "Art. 3, Satz 1 C"]}


def test_other_kinds_of_items(spark):
    spec = SplitSpec(item_start=r"[A-Z]{2}-\d")
    assert got(rows(spark, ["AB-1;CD-2", '"AB-1, x";CD-3']), spec=spec) == {0: ["AB-1", "CD-2"], 1: ["AB-1, x", "CD-3"]}


def test_whole_table_against_brute_force(spark, data):
    laws = spark.read.parquet(f"{data}/laws_db.parquet")
    mine = {(r["law_id"], r["pos"]): r["item"] for r in split_packed(laws.selectExpr("law_id", "`references` AS t", "'r' AS src"), "t", "src", ["law_id"]).collect()}
    start = re.compile(r"(?i)\bart(?:ikel)?\.?[\s\xa0]*\d")
    truth = {}
    for r in laws.select("law_id", "references").collect():
        at = [m.start() for m in start.finditer(r["references"] or "")]
        for n, (a, b) in enumerate(zip(at, [*at[1:], None]), 1):
            truth[r["law_id"], n] = r["references"][a:b].strip(" \t\r\n\xa0;|,/[]\"'")
    assert mine == truth
