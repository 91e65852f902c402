from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import citations as K
from paperloom.functions import quality as Q
from paperloom.functions import text as T
from paperloom.operators import corpus as C

GOOD = ("We propose a method and present results of the evaluation on data, cf.x and more. " * 60).strip()


def judged(spark, rows):
    df = spark.createDataFrame(rows, "id int, text string, categories array<string>, names array<string>")
    return {r["id"]: r for r in C.with_quality(df, "text", "names", "categories").collect()}


def test_decisions(spark):
    out = judged(spark, [
        (1, GOOD, ["cs.AI"], ["abstract", "introduction", "results"]),
        (2, "too short", ["cs.AI"], None),
        (3, GOOD, ["physics.gen-ph", "q-bio"], None),
        (4, GOOD, [], None),
        (5, "Este es un texto en otro idioma que no tiene palabras. " * 60, ["cs.DB"], []),
        (6, "", ["cs.AI"], None),
        (7, None, None, None),
    ])
    assert out[1]["accepted"] and abs(out[1]["quality_metrics"]["structure_score"] - 1.0) < 1e-9
    assert out[2]["reason"] == "Critical issue: likely_incomplete" or not out[2]["accepted"]
    assert out[3]["reason"] == "Category filter: unrelated_categories_physics.gen-ph,q-bio"
    assert out[4]["accepted"]
    assert not out[5]["accepted"] or "possibly_non_english" in out[5]["quality_metrics"]["issues"]
    assert "empty_text" in out[6]["quality_metrics"]["issues"] and not out[6]["accepted"]
    assert not out[7]["accepted"]


def test_length_bounds(spark):
    rows = [(n, ("word " * 30000)[:n]) for n in (499, 500, 999, 1000, 50000, 50001, 100000, 100001)]
    df = spark.createDataFrame(rows, "n int, text string").withColumn("m", F.explode(F.array(Q.measures(F.col("text")))))
    score = {r["n"]: r["s"] for r in df.select("n", Q.length(F.col("m"))[0].alias("s")).collect()}
    assert score == {499: 0.0, 500: 0.4, 999: 0.4, 1000: 1.0, 50000: 1.0, 50001: 0.8, 100000: 0.8, 100001: 0.6}


def test_completeness(spark):
    rows = [("This ends.",), ("It goes on ... [truncated]",), ("word " * 300,), ("word " * 600 + ".",)]
    df = spark.createDataFrame(rows, "text string").withColumn("m", F.explode(F.array(Q.measures(F.col("text")))))
    got = [(round(r["s"], 6), r["i"]) for r in df.select(Q.completeness(F.col("m"))[0].alias("s"), Q.completeness(F.col("m"))[1].alias("i")).collect()]
    assert got[0] == (0.4, ["likely_incomplete"])
    assert got[1] == (round(0.8 * 0.3 * 0.3 * 0.4, 6), ["abrupt_ending", "truncation_indicator_...", "truncation_indicator_[truncated]", "likely_incomplete"])
    assert got[2] == (round(0.8 * 0.7, 6), ["abrupt_ending", "possibly_incomplete"])
    assert got[3] == (1.0, [])


def test_statistics(spark):
    df = C.with_quality(spark.createDataFrame([(GOOD,), ("x",), ("",)], "text string"))
    row = C.acceptance(df).first()
    assert (row["total"], row["accepted"], row["rejected"]) == (3, 1, 2)
    assert sum(r["papers"] for r in C.rejection_histogram(df).collect()) == 2


def test_long_runs(spark):
    """Thousands of short words in a row, or of parts of a mark, don't overflow a regex stack."""
    text = "ab cd " * 20000 + "end."
    df = spark.createDataFrame([(text, "http://x.org/" + "a%20" * 20000 + " b \\cite" + " {c}" * 20000 + " [1" + ", 2" * 20000 + "]")], "text string, marks string")
    assert df.select(Q.measures(F.col("text"))["short_runs"]).first()[0] == 1
    assert df.select(T.remove_artifacts(F.substring_index("marks", " [1", 1))).first()[0] == "[URL] b  "
    assert df.select(F.size(K.inline_citations(F.col("marks")))).first()[0] == 20001


def test_ratio_is_rounded_as_binary(spark):
    values = [k / 200 for k in range(200)] + [k / 8 for k in range(8)] + [a / 37 for a in range(37)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", Q._ratio(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in got] == [f"{r['v']:.2f}" for r in got]
