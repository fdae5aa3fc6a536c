import pytest
from pyspark.sql import functions as F

from statuta.functions import text as t
from statuta.operators import cooccurrence as co
from statuta.operators.dense import ask, embed, score_in_batches
from statuta.plans.runtime import require_columns
from statuta.sources import readers, sinks


def test_models_as_operators(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "id int, text string")
    good = embed(df, "id", "text", lambda xs: [[1.0, float(len(x))] for x in xs], 2, done=df.where("id = 3").select("id"))
    assert sorted((r["id"], r["embedding"], r["error"]) for r in good.collect()) == [(i, [1.0, 2.0], None) for i in range(3)]
    bad = embed(df, "id", "text", lambda xs: [[1.0]] * len(xs), 2).collect()
    assert len(bad) == 4 and all(r["embedding"] is None and "vectors of 2" in r["error"] for r in bad)

    def broken(b):
        raise RuntimeError("down")

    assert [(r["id"], r["score"], r["error"]) for r in score_in_batches(df, broken, "id int, score double").where("id = 1").collect()] == [(1, None, "down")]
    two = {r["id"]: (r["answer"], r["error"]) for r in ask(df, "id", "text", [str.upper, str.upper], valid=lambda a: a != "T2").collect()}
    assert two == {0: ("T0", None), 1: ("T1", None), 2: (None, "invalid answer"), 3: ("T3", None)}


def test_long_lists_in_blocks(spark):
    rows = [("d", f"{i:03}") for i in range(25)] + [("e", "000"), ("e", "024"), ("f", "007")]
    sets = spark.createDataFrame(rows, "doc string, item string")
    whole, cut = ({(r["src"], r["dst"]): r["n"] for r in co.pair_counts(sets, b).collect()} for b in (1_000, 4))
    assert whole == cut and len(cut) == 25 * 24 and cut["000", "024"] == 2


def test_files_and_columns(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "n int, x string"), str(tmp_path / "x.csv"))
    assert [r["x"] for r in readers.read_first(spark, str(tmp_path / "x.csv"), "n int, x string", "n", 2).collect()] == ["a", "b"]
    df = spark.createDataFrame([(1, "a - b - c")], "n int, x string")
    assert sinks.replace_column(df, "n", F.lit(7)).columns == ["n", "x"]
    assert df.select(t.split_title(F.col("x")).alias("p")).first()["p"] == ("a", "b - c")
    for f in (lambda: sinks.replace_column(df, "z", F.lit(1)), lambda: require_columns(df, "z")):
        with pytest.raises(ValueError):
            f()
    for n in (1, 2):
        sinks.publish(spark.range(n), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
