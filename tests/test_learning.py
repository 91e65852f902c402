"""Topic words, neighbours in cells, models, results, reports and late changes against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from paperloom.operators import corpus as C
from paperloom.operators import evaluation as E
from paperloom.operators import learning as L
from paperloom.operators import sections as X
from paperloom.operators import tiles as X_TILES
from paperloom.operators import vectors as V
from paperloom.plans import learn as P
from paperloom.session import spread
from paperloom.sources import store
from paperloom.streaming.upsert import apply_changes, current_version

VECTORS = "vec_id int, embedding array<float>"


def test_topic_tokens(spark):
    text = "Café Straße the MODEL naïve x1 ab under_score extraordinarilylong words Ångström e\u0301te\u0301"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(L.topic_tokens(F.col("t")).alias("w")).collect()
    assert got[0]["w"] == ["cafe", "straße", "naive", "words", "angstrom", "ete"] and got[1]["w"] == [] and got[2]["w"] is None
    assert "model" in L.stop_words() and "the" in L.stop_words() and "zz" in L.stop_words(["zz"])


def test_near_pairs(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(3)]) for i in range(80)] + [(90, [0.0, 0.0, 0.0]), (91, [0.0, 0.0, 0.0]), (92, None)]
    df = spark.createDataFrame(rows, VECTORS)
    points = {r["vec_id"]: r["embedding"] for r in df.collect() if r["embedding"]}
    for eps in (0.05, 0.6, 5.0):
        want = {(a, b) for a, x in points.items() for b, y in points.items() if math.dist(x, y) <= eps}
        got = [(r["a"], r["b"]) for r in L.near_pairs(df, eps).collect()]
        assert set(got) == want and len(got) == len(want)
    labels = {r["vec_id"]: r["cluster"] for r in L.dbscan(df, 0.05, 2).collect()}
    assert labels[90] == labels[91] == 90 and labels[92] == -1 and len(labels) == len(rows)
    assert L.dbscan(df.limit(0), 1.0).count() == 0


def test_long_chain(spark):
    """A line of points is one cluster, however long."""
    chain = spark.range(5000).select(F.col("id").alias("vec_id"), F.array((F.col("id") * 0.4).cast("float"), F.lit(0.0).cast("float")).alias("embedding"))
    assert [tuple(r) for r in L.dbscan(chain, 0.5, 3).groupBy("cluster").count().collect()] == [(1, 5000)]


def test_silhouette_without_noise(spark):
    rows = [(0, [0.0], 0), (1, [0.1], 0), (2, [5.0], 1), (3, [5.1], 1), (4, [99.0], -1)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")
    real = V.silhouette(df, noise=-1).first()[0]
    assert real == pytest.approx(V.silhouette(df.where("label >= 0")).first()[0]) and real > V.silhouette(df).first()[0]


def test_neighbours_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], VECTORS)
    want = sorted(map(tuple, V.nearest(df, df, 3).collect()))
    monkeypatch.setattr(V, "QUERY_BYTES", 500)
    assert sorted(map(tuple, V.nearest(df, df, 3).collect())) == want and len(want) == 120


def test_tiles(spark, monkeypatch):
    """Neighbours, silhouette and clusters in tiles equal brute force, with copies, and list no pairs."""
    rng = random.Random(7)
    points = {i: [round(rng.uniform(-2, 2), 1) for _ in range(3)] for i in range(150)}
    points |= {200 + i: points[1] for i in range(40)}
    df = spark.createDataFrame([(i, p, i % 4 if i % 10 else None) for i, p in points.items()], "vec_id int, embedding array<double>, label int")
    monkeypatch.setattr(L, "near_pairs", None)
    monkeypatch.setattr(X_TILES, "ROWS", 32)
    near = {a: [b for b in points if math.dist(points[a], points[b]) <= 0.6] for a in points}
    core, want = {a for a in points if len(near[a]) >= 4}, {}
    for a in sorted(core):
        todo = [] if a in want else [a]
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = a
                todo += [b for b in near[x] if b in core]
    want = {a: want.get(a, min((want[b] for b in near[a] if b in core), default=-1)) for a in points}
    assert {r["vec_id"]: r["cluster"] for r in L.dbscan(df, 0.6, 4).collect()} == want

    order = lambda q: sorted(points, key=lambda b: (sum((x - y) ** 2 for x, y in zip(points[q], points[b], strict=True)), b))
    found = V.nearest(df, df.where("vec_id % 20 = 0"), 5)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found.collect()}
    assert got == {(q, r + 1): b for q in points if q % 20 == 0 for r, b in enumerate(order(q)[:5])}

    labels = {i: i % 4 if i % 10 else None for i in points}
    scores = []
    for a in points:
        means = {k: [math.dist(points[a], points[b]) for b in points if b != a and labels[b] == k] for k in range(4)}
        own = means.pop(labels[a], None)
        other = min(sum(m) / len(m) for m in means.values())
        scores.append(0.0 if own is None else (other - sum(own) / len(own)) / max(other, sum(own) / len(own)))
    assert V.silhouette(df).first()[0] == pytest.approx(sum(scores) / len(scores), abs=1e-9)


def test_terms_stay_with_their_document(spark):
    """Weights exchange documents once, not their terms."""
    docs = spark.createDataFrame([(i, "a b c".split() + ["a"] * i) for i in range(6)], "doc_id long, words array<string>")
    terms = E.document_terms(docs, F.col("words"))
    weights = E.tfidf(terms, E.vocabulary(terms, 6, 1, 1.0, 10), 6)
    assert weights._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r["doc_id"], r["term"]): r["weight"] for r in weights.collect()}
    assert got[2, "a"] == pytest.approx(3 / math.sqrt(11)) and got[2, "b"] == pytest.approx(1 / math.sqrt(11)) and len(got) == 18
    topics = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "topic string, term string, rank int")
    assert E.u_mass(topics, terms).first()["u_mass"] == pytest.approx(math.log(7 / 6))


def test_models(spark, tmp_path):
    rows = L.with_vectors(spark.createDataFrame([(i, [float(i % 2), float(i)], float(i % 2)) for i in range(20)], "vec_id int, embedding array<float>, label double"), "embedding")
    for model, kind in ((KMeans(k=2, seed=1).fit(rows), "KMeansModel"), (LogisticRegression().fit(rows), "LogisticRegressionModel")):
        L.save_model(model, str(tmp_path / kind))
        again = L.load_model(spark, str(tmp_path / kind))
        assert type(again).__name__ == kind and again.transform(rows).select("prediction").collect() == model.transform(rows).select("prediction").collect()
    out = L.predictions(again, rows, ["even", "odd"], "vec_id").orderBy("vec_id").collect()
    assert [r["predicted_category"] for r in out] == ["even", "odd"] * 10 and all(abs(sum(r["all_probabilities"].values()) - 1) < 1e-9 and r["confidence"] >= 0.5 for r in out)


def test_embedded(spark):
    def encoder():
        def encode(texts):
            assert len(texts) <= 4
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(10)], "id int, embedding_text string")
    assert {r["id"]: r["embedding"] for r in L.embedded(df, encoder, batch=4).collect()} == {i: [float(i), 1.0] for i in range(10)}


def test_lsa_variance(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 30))) for i in range(30)], "id int, text string")
    model = L.tfidf_pipeline(50, bigrams=False).fit(docs)
    found = L.lsa_topics(model.transform(docs), L.vocabulary_of(model), 3, 2).orderBy("component", "rank").collect()
    assert [(r["component"], r["rank"]) for r in found] == [(c, k) for c in range(3) for k in (1, 2)]
    shares = [found[2 * c]["explained"] for c in range(3)]
    assert shares == sorted(shares, reverse=True) and [found[2 * c]["cumulative"] for c in range(3)] == pytest.approx([sum(shares[: c + 1]) for c in range(3)])
    topics = L.lda_topics(docs, 2, 3, 50, 5)
    report = L.topic_report(topics, spark.createDataFrame([("a", -1.0), ("b", -3.0)], "topic string, u_mass double"), L.lsa_topics(model.transform(docs), L.vocabulary_of(model), 3, 2)).first()
    assert report["topics"] == 2 and report["u_mass"] == -2.0 and report["explained"] == pytest.approx(1.0)


def test_reports(spark, tmp_path):
    overall = spark.createDataFrame([(0.85, 0.7, 0.8, 3, 100, "Good", True)], "accuracy double, f1_macro double, f1_weighted double, classes int, rows int, verdict string, imbalanced boolean")
    judged = E.evaluate_clusterings(spark.createDataFrame([("kmeans", 0.2, 5), ("dbscan", 0.35, 2)], "method string, silhouette double, clusters int"))
    assert {r["method"]: (r["verdict"], r["best"]) for r in judged.collect()} == {"kmeans": ("Poor", False), "dbscan": ("Good", True)}
    text = store.evaluation_report(overall, judged, spark.createDataFrame([("x", 3), ("y", 9)], "category string, papers int"))
    assert "Overall Assessment: Good" in text and "DBSCAN: Good" in text and "(best)" in text and text.index("y: 9") < text.index("x: 3")
    assert "Address class imbalance" in text and "Good cluster separation" in text
    assert "No classification results" in store.evaluation_report()
    assert E.recommendations(overall.withColumn("accuracy", F.lit(0.5)), None) == ["Classification: Consider data augmentation or feature engineering"]
    store.save_results(str(tmp_path), clusters=judged)
    found = store.load_results(spark, str(tmp_path), "clusters", "topics")
    assert found["clusters"].count() == 2 and found["topics"] is None
    (tmp_path / "broken.json").write_text("{no json")
    assert store.read_json(spark, str(tmp_path / "broken.json")) is None and store.read_json(spark, str(tmp_path / "none.json")) is None
    rates = E.run_rates(spark.createDataFrame([("loaded", True), ("topics", False)], "step string, completed boolean"), ("loaded",)).first()
    assert (rates["steps"], rates["completed"], rates["success_rate"], rates["overall"]) == (2, 1, 0.5, True)


def test_learn_runs_what_it_can(spark, monkeypatch):
    rows = [(f"p{i}", f"T{i}", " ".join(f"w{(i * k) % 11}" for k in range(1, 40)), ["cs.AI" if i % 2 else "cs.LG"], 0.5) for i in range(24)] + [("none", "N", None, ["cs.AI"], 0.5)]
    papers = spark.createDataFrame(rows, "arxiv_id string, title string, text string, categories array<string>, quality_score double")

    def broken(*a, **k):
        raise RuntimeError("no topics today")

    monkeypatch.setattr(L, "lda_topics", broken)
    out = P.learn(papers, features=50, ks=range(3, 5))
    assert {r["step"]: r["completed"] for r in out["summary"].collect()} == {"loaded": True, "classified": True, "clustered": True, "topics": False}
    assert out["rates"].first()["overall"] and "topics" not in out and out["clusterings"].count() == 1
    assert P.usable_texts(papers.withColumnRenamed("text", "abstract")).count() == 24
    with pytest.raises(ValueError):
        P.usable_texts(papers.select("arxiv_id"))


def test_blank_papers_have_a_summary(spark):
    out = {r["doc_id"]: r for r in X.summaries(spark.createDataFrame([(1, " \n"), (2, None), (3, "Some text of a body. " * 20)], "doc_id int, text string")).collect()}
    assert out[1]["total_sections"] == out[2]["total_sections"] == 0 and out[1]["sections_found"] == [] and not out[1]["has_abstract"]
    assert out[3]["total_sections"] == 1 and out[3]["sections_found"] == ["body"]


def test_late_changes(spark, tmp_path):
    table = str(tmp_path / "t")
    for rows in ([("a", "new", 5), (None, "nobody", 9)], [("a", "old", 3), ("b", "first", 1)], [("a", "same", 5), ("b", None, 2)]):
        apply_changes(spark.createDataFrame(rows, "k string, t string, seq int"), table, "k", "seq")
    assert {r["k"]: (r["t"], r["seq"]) for r in spark.read.parquet(f"{table}/v={current_version(spark, table)}").collect()} == {"a": ("same", 5), "b": (None, 2)}
    stored = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    assert sorted(map(str, C.upsert(stored, spark.createDataFrame([("a", 3), (None, 4)], "k string, v int"), "k").collect())) == ["Row(k='a', v=3)", "Row(k=None, v=2)"]


def test_spread_leaves_large_tables(spark, monkeypatch):
    rows = spark.range(10)
    assert spread(rows).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr("paperloom.session.SPREAD_BYTES", 0)
    assert spread(rows) is rows
