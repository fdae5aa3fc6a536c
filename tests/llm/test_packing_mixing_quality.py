import random

import numpy as np
import pytest

from statuta.llm import packing, quality
from statuta.llm.mixing import mix
from statuta.llm.packing import fill, pack, steps
from statuta.llm.quality import SUMS, document_kind, text_statistics
from statuta.llm.tokens import count_tokens, encoder


def test_best_fit_against_brute_force():
    r = random.Random(2)
    for _ in range(30):
        caps = np.array([r.choice([8, 16]) for _ in range(25)])
        sizes = np.array([r.randint(0, 8) for _ in range(25)])
        where, opened = fill(sizes, caps)
        load = np.bincount(where, weights=sizes, minlength=len(opened))
        assert (load <= np.array(opened)).all()
        gaps, left = [], []
        for i in sorted(range(25), key=lambda i: (-sizes[i], i)):
            room = [g for g in gaps if g >= sizes[i]]
            if room:
                gaps.remove(min(room))
                gaps.append(min(room) - sizes[i])
            else:
                gaps.append(caps[i] - sizes[i])
        left = sorted(gaps)
        assert sorted((np.array(opened) - load).tolist()) == left


def test_step_groups_are_even():
    r = np.random.default_rng(1)
    fills, caps = r.integers(400, 512, 64).astype(float), np.full(64, 512)
    g = steps(fills, caps, 8)
    load = np.bincount(g, weights=fills)
    assert (np.bincount(g) == 8).all() and load.max() - load.min() < 30


def test_packing_keeps_everything(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 60)
    r = random.Random(3)
    rows = [(i, r.choice([0, None, 1, 100, 511, 512, 513, 700, 5000])) for i in range(300)] + [(None, 5), (1000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").selectExpr("*", "'x' AS plan", "1 AS share")
    out = pack(df, {"short": [512], "mixed": [512, 2048]}, len(rows)).toPandas()
    for plan, most in (("short", 512), ("mixed", 2048)):
        x = out[out.plan == plan]
        assert x.tokens.sum() == sum(t or 0 for _, t in rows)
        whole = x.groupby("doc_id", dropna=False)
        assert (x[x.piece > 0].doc_id.map(dict(rows)) > most).all() and whole.ngroups == 302
        load = x.groupby("container").agg(f=("tokens", "sum"), c=("capacity", "first"), s=("step", "nunique"))
        assert (load.f <= load.c).all() and (load.s == 1).all() and (x.first_token == x.piece * most).all()
    assert pack(df.limit(0), {"a": [8]}, 0).count() == 0
    with pytest.raises(ValueError):
        pack(df, {"a": [0]}, 1)


def test_shares_follow_the_pieces(spark, monkeypatch):
    """Few texts of many pieces each: no task gets more than about SHARE pieces."""
    monkeypatch.setattr(packing, "SHARE", 100)
    df = spark.createDataFrame([(i, 512 * 200) for i in range(10)] + [(10, None)], "doc_id long, tokens long")
    out = pack(df, {"short": [512], "long": [512 * 200]}).toPandas()
    share = out.container.to_numpy() >> 32
    short = (out.plan == "short").to_numpy()
    assert len(np.unique(share[short])) >= 19 and np.bincount(share[short]).max() <= 150
    assert short.sum() == 2_001 and (~short).sum() == 11 and (share[~short] == 0).all()
    assert pack(df.limit(0), {"a": [8]}).count() == 0


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, identity string, tokens long, weight double")


TARGETS = [("A", 0.5, 1), ("b_c", 0.3, 4), ("gone", 0.2, 4)]


def test_mix_meets_shares(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["A", "a ", "A"]), f"x{i}", r.randint(1, 50), r.random()) for i in range(3000)] + [(10_000 + i, r.choice(["B-C", "b_c", "b c"]), f"y{i}", r.randint(1, 50), r.random()) for i in range(200)]
    rows += [(50_000, "A", "x1", 30, 1.0), (50_001, None, "z", 9, 1.0), (50_002, "other", "w", 9, 1.0), (50_003, "A", "null", None, None)]
    t = spark.createDataFrame(TARGETS + [(None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mix(texts(spark, rows).selectExpr("*", "1 AS range", "'x' AS state"), t)
    got = {x["source"]: x for x in shares.collect()}
    assert abs(got["a"]["actual_share"] - 0.625) < 0.005 and abs(got["b_c"]["actual_share"] - 0.375) < 0.005 and got["gone"]["tokens"] == 0
    c = chosen.toPandas()
    assert c.doc_id.is_unique and (c[c.source == "a"].repeats <= 1).all() and (c[c.source == "b_c"].repeats <= 4).all()
    assert 50_000 not in set(c.doc_id) and c[c.source == "b_c"].repeats.max() - c[c.source == "b_c"].repeats.min() <= 1
    again, _ = mix(texts(spark, rows[::-1]).repartition(5), t)
    assert sorted(map(tuple, again.select("doc_id", "repeats").collect())) == sorted(map(tuple, chosen.select("doc_id", "repeats").collect()))
    small, report = mix(texts(spark, rows), t, total_tokens=1000)
    assert abs(sum(x["tokens"] for x in report.collect()) - 1000) <= 50


def test_mix_prefers_weight_and_handles_nothing(spark):
    rows = [(i, "A", f"x{i}", 10, 1.0 if i % 2 else 0.05) for i in range(1000)]
    chosen, _ = mix(texts(spark, rows), spark.createDataFrame([("A", 1.0, 1)], "source string, target_share double, max_repeats int"), total_tokens=2000)
    ids = [r["doc_id"] for r in chosen.collect()]
    assert len(ids) == 200 and sum(i % 2 for i in ids) > 160
    empty, report = mix(texts(spark, []), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    assert empty.count() == 0 and report.count() == 3
    with pytest.raises(ValueError):
        mix(texts(spark, rows), spark.createDataFrame([], "source string, target_share double, max_repeats int"))


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Die Gebühr beträgt CHF 5."), (2, ""), (3, None), (4, "wort " * 20_000)], "doc_id long, text string").selectExpr("*", "9 AS tokens")
    out = {r["doc_id"]: r["tokens"] for r in count_tokens(df, "text", ["doc_id"]).collect()}
    e = encoder()
    assert out == {1: len(e.encode_ordinary("Die Gebühr beträgt CHF 5.")), 2: 0, 3: 0, 4: len(e.encode_ordinary("wort " * 20_000))}
    assert e.decode(e.encode_ordinary("Gebühr «x»")) == "Gebühr «x»"


WORDS = ["the", "of", "and", "is", "die", "der", "und", "nicht", "für"]
PROSE = "The owner is liable for the damage of the house and the court is silent. May the insurer revoke the permit?"
KINDS = {
    "list": ["Index\n1. the fee\n2. Art. 5 TorV\n3. the court\n4. Seewil 1999", "• the fee\n• the cost\n• the levy\n• Rente", "the fee, 12, 14\nthe levy, 5\nRente, 7, 9", "Die Gebühr und der Betrag ist nicht für die Katze.\n\n- Rente\n- Abgabe\n- Busse\n- Kaution\n- Zufahrt"],
    "table": ["Ort\tJahr\tCHF\nA\t1\t2\nB\t3\t4", "| a | b |\n| --- | --- |\n| 1 | 2 |", "a;b;c\n1;2;3\n4;5;6", "Betrag: 5\nOrt: Bern\nJahr: 1999\nBetrag: 7", "<tr><td>1</td><td>2</td></tr>\n<tr><td>3</td><td>4</td></tr>"],
    "junk": ["qwrt zxcv bnmk lkjh gfds pqrt wrtz xcvb", "0a1b2c3d 4e5f6a7b 8c9d0e1f 2a3b4c5d", ". . . . . . . . . . . .", (PROSE[:74] + " ") * 12, "function f(a){return a;}\nfunction g(b){return b;}", '<div class="a"><a href="#1">x</a></div>\n<div class="b"><a href="#2">y</a></div>', "W§e ¬u¦l|^~ n§t ¦b¬ |~ r§d¦ ¬h^s§", "-" * 300],
    None: ["", None, "  \n", PROSE, PROSE.replace(" ", "\n", 6), "Facts\n" + PROSE, "1. " + PROSE + "\n2. " + PROSE.replace("house", "barn"), PROSE.upper(), PROSE + "\n- the fee\n- the cost\n" + PROSE.replace("owner", "tenant")],
}


def stats(spark, rows, **kw):
    return text_statistics(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS words", "'x' AS kind"), spark.createDataFrame([(w,) for w in WORDS] + [(None,)], "word string"), **kw)


def test_kinds(spark):
    cases = [(want, x) for want, xs in KINDS.items() for x in xs]
    out = {r["doc_id"]: r["k"] for r in stats(spark, [(i, x) for i, (_, x) in enumerate(cases)]).withColumn("k", document_kind()).collect()}
    assert [(cases[i][1], k) for i, k in sorted(out.items()) if k != cases[i][0]] == []


def test_ratios(spark):
    r = stats(spark, [(1, "The fee of 5%.\nNo end"), (2, None)]).orderBy("doc_id").collect()
    assert (r[0]["word_count"], r[0]["mean_word_length"], r[0]["ended_line_share"], r[0]["common_word_share"]) == (5, pytest.approx(13 / 5), 0.5, pytest.approx(2 / 5))
    assert r[0]["symbol_ratio"] == pytest.approx(2 / 16) and r[1]["word_count"] == 0 and r[1]["symbol_ratio"] == 0.0
    assert stats(spark, []).count() == 0


def test_chunks_give_the_same_counts(spark):
    """All counts, without tolerance: repeated words and sentences, cells, enumerations, blank lines and long lines."""
    r = random.Random(5)
    some = ["the", "owner", "pays", "CHF", "5'000", "Art.", "und", "Gebühr", "(a)", "of", "a,b", "x;y", "cafe01", "deadbeef", "....", ". . . .", "<td>", "<p", "class=1>", "=>", "{", "a\tb", "c |", "lit. b)", "x" * 45]
    line = lambda: r.choice(["", "", "1. ", "  a) ", "- ", "\t"]) + r.choice([" ", " ", "  ", "    "]).join(r.choice(some) for _ in range(r.randint(1, 14))) + r.choice([".", "?", "", ";", ".", " }", ".)"])
    same = "The owner of the house pays the fee. "
    rows = [(i, r.choice(["\n", " ", "\n\n", "\r\n", "\n   \n  "]).join(line() for _ in range(r.randint(30, 120)))) for i in range(60)]
    rows += [(100, same * 80), (101, (same + "\n") * 80), (102, "over and " * 300), (103, "word " * 500 + "\n" + same * 30), (104, "   " + "the  end  of\n" * 120)]
    whole = {x["doc_id"]: x.asDict() for x in stats(spark, rows).collect()}
    assert whole[100]["repeated"] == 79 and whole[103]["repeated_tokens"] == 499
    for chunk in (170, 400):
        for x in stats(spark, rows, chunk=chunk).collect():
            assert {n: x[n] for n in SUMS} == {n: whole[x["doc_id"]][n] for n in SUMS}, (chunk, x["doc_id"], {n: (x[n], whole[x["doc_id"]][n]) for n in SUMS if x[n] != whole[x["doc_id"]][n]})


def test_merge_is_associative():
    import pyarrow as pa

    texts = ["The owner pays. And", " the court is", " silent?\nYes it is", " so. so The end."]
    s = quality._measure(pa.array(texts), pa.array(WORDS), quality._char_classes(), True)[1]
    a = quality.finish(quality.merge(quality.merge(quality.merge(s[0], s[1]), s[2]), s[3]))
    b = quality.finish(quality.merge(quality.merge(s[0], s[1]), quality.merge(s[2], s[3])))
    c = quality.finish(quality.merge(s[0], quality.merge(s[1], quality.merge(s[2], s[3]))))
    assert (a == b).all() and (b == c).all()
