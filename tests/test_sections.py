from __future__ import annotations

import re

from pyspark.sql import functions as F

from paperloom.functions import citations as K
from paperloom.operators import sections as X


def body(n, word="alpha"):
    return " ".join(f"{word}{i}" for i in range(n)) + "."


PAPER = "\n".join(["Abstract", body(60), "1. Introduction", body(120), "Methods", body(250), "RESULTS", body(130), "Abstract", body(55), "Conclusion", body(20), "References", body(12)])


def found(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {r["name"]: r for r in X.extract_sections(df).collect()}


def test_sections(spark):
    out = found(spark, PAPER)
    assert set(out) == {"abstract", "introduction", "methodology", "results", "references"}  # the conclusion is too short
    assert out["results"]["content"].startswith(body(130)) and "Abstract" in out["results"]["content"]
    assert out["abstract"]["content"] == body(60) and out["abstract"]["start_pos"] == 0
    for row in out.values():
        assert PAPER[row["start_pos"] : row["end_pos"]].split("\n", 1)[1].strip() == row["content"]


def test_body_and_front(spark):
    assert found(spark, "no header here")["body"]["content"] == "no header here"
    front = body(80) + "\n" + PAPER
    assert found(spark, front)["introduction_unlabeled"]["content"] == body(80)
    assert found(spark, " \n ") == {} and found(spark, None) == {}


def test_header_confidence(spark):
    df = spark.createDataFrame([(1, "Abstract\n" + "x\n" * 20 + "Table of results\n1. Introduction\n" + "y" * 250)], "doc_id long, text string")
    rows = {r["name"]: round(r["confidence"], 6) for r in X.section_headers(df).collect()}
    assert rows == {"abstract": 0.9, "introduction": 0.6}


def packed(text, limit):
    out, now, n = [], [], 0
    if len(text) <= limit:
        return [text]
    for s in re.split(r"(?<=[.!?])\s+", text):
        if n + len(s) > limit and now:
            out.append(" ".join(now))
            now, n = [], 0
        now.append(s)
        n += len(s) + 1
    return [*out, " ".join(now)]


def test_chunks(spark):
    texts = ["", "a" * 1000, "b" * 1001, " ".join(f"Sentence number {i} goes here!" for i in range(200)), "Short. " + "c" * 1500 + ". End?"]
    df = spark.createDataFrame([(i, "body", t, 0.8) for i, t in enumerate(texts)], "doc_id int, name string, content string, confidence double")
    got = {}
    for r in X.chunk_sections(df).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert [got[i] for i in range(len(texts))] == [packed(t, 1000) for t in texts]


def test_batches(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_id"))
    out = X.number_batches(df.repartition(3), "doc_id", "chunk_id").groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("a")).orderBy("batch").collect()
    assert [(r["batch"], r["n"], r["a"]) for r in out] == [(k, 1000, 1000 * k) for k in range(5)]


REFS = """Text before.
References
[1] John Smith, Ann B. Lee (2021) "A study of many things". Journal of Data 12(3): 45-67. doi: 10.1000/xyz
[2] Mary Jones. Machine learning in 1998, vol. 4, pp. 10-20, arXiv: 2301.12345
[3] short one"""


def parsed(spark, text, **options):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(K.citations(K.reference_section(F.col("t")), **options).alias("c")).first()["c"]


def test_citations(spark):
    one, two = parsed(spark, REFS, per_entry=True)
    assert one["year"] == 2021 and one["doi"] == "10.1000/xyz" and one["title"] == "A study of many things"
    assert one["volume"] == "12" and one["pages"] == "45-67" and one["citation_type"] == "journal" and one["authors"][0] == "John Smith"
    assert two["year"] == 19 and two["arxiv_id"] == "2301.12345" and two["citation_type"] == "conference"  # "machine" holds "chi"
    assert parsed(spark, REFS, per_entry=True, fix_year=True)[1]["year"] == 1998
    assert len(parsed(spark, REFS)) == 1


def test_reference_fallback(spark):
    three = "[1] one (2001)\n[2] two (2002)\n[3] three (2003)"
    lines = f"Body text\n{three}\n[4] four"
    get = lambda t: spark.createDataFrame([(t,)], "t string").select(K.reference_section(F.col("t")).alias("r")).first()["r"]
    assert get(lines).split("\n")[0] == "[1] one (2001)" and get("Body\n[1] one\n[2] two") is None
    assert get(three) == three and get(f"Body\n{three}") is None  # three entries end the list only at its start
    assert get(None) is None
    assert get("x\nReferences\nlist here\nAppendix\nmore") == "list here"


def test_inline(spark):
    text = "As [1, 2] and (Smith et al., 2020) or (Lee 2019) say [3]."
    rows = spark.createDataFrame([(text,)], "t string").select(F.inline(K.inline_citations(F.col("t")))).collect()
    want = [(f"[{n}]", m.start()) for m in re.finditer(r"\[(\d+(?:,\s*\d+)*)\]", text) for n in m.group(1).replace(" ", "").split(",")]
    want += [(m.group(0), m.start()) for m in re.finditer(r"\(([A-Z][a-z]+(?:\s+et\s+al\.)?),?\s+(\d{4})\)", text)]
    assert [(r["citation"], r["position"]) for r in rows] == want


def test_statistics(spark):
    df = spark.createDataFrame([(REFS,), ("nothing",)], "t string").select(K.citations(K.reference_section(F.col("t")), True).alias("c"))
    a, b = df.select(K.statistics(F.col("c")).alias("s")).collect()
    assert a["s"]["total_citations"] == 2 and a["s"]["has_doi"] and a["s"]["types"] == {"journal": 1, "conference": 1}
    assert b["s"]["total_citations"] == 0 and b["s"]["years_range"] is None


def test_sections_stay_in_their_row(spark):
    """No text is exchanged to find sections, and batches read chunks that were made once."""
    df = spark.createDataFrame([(i, "Abstract\n" + "word " * 60 + "\n1. Introduction\n" + "more. " * 400) for i in range(5)], "doc_id long, text string")
    found = X.extract_sections(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    chunks = X.chunk_sections(found)
    numbered = X.number_batches(chunks, "doc_id", "chunk_id", 4)
    assert "split(" not in numbered._jdf.queryExecution().executedPlan().toString()
    order = [(r["doc_id"], r["chunk_id"]) for r in chunks.collect()]
    assert {(r["doc_id"], r["chunk_id"]): r["batch"] for r in numbered.collect()} == {x: n // 4 for n, x in enumerate(sorted(order))}
