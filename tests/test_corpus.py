from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from paperloom.operators import corpus as C
from paperloom.operators import evaluation as E
from paperloom.operators import learning as L
from paperloom.operators import vectors as V
from paperloom.plans import clean
from paperloom.plans.papers import papers
from paperloom.sources import feeds
from paperloom.sources.store import Store, report, read_json_dataset, write_json
from paperloom.streaming.upsert import current_version, upsert_stream

TINY = "/root/testdata/sf0.001"


def test_upsert_fields(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, t string, n int")
    new = spark.createDataFrame([("b", None), ("c", "z")], "k string, t string")
    rows = {r["k"]: (r["t"], r["n"]) for r in C.upsert(old, new, "k").collect()}
    assert rows == {"a": ("x", 1), "b": (None, 2), "c": ("z", None)}
    marked = spark.createDataFrame([("a", None, 5, ["n"])], "k string, t string, n int, present array<string>")
    assert {r["k"]: (r["t"], r["n"]) for r in C.upsert(old, marked, "k", "present").collect()}["a"] == ("x", 5)


def test_samples_and_limits(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"], i) for i in range(10)], "arxiv_id int, categories array<string>, published int")
    rows = C.balanced_sample(df, 3).collect()
    assert sorted((r["category"], r["arxiv_id"]) for r in rows) == [("a", 7), ("a", 8), ("a", 9), ("b", 5), ("b", 7), ("b", 9)]
    assert C.budgeted(df, 5, [F.col("arxiv_id")], existing=3).count() == 2
    labels = spark.createDataFrame([("x",)] * 5 + [("y",)] * 3 + [("z",)], "l string")
    assert C.enough_samples(labels, "l").count() == 8
    assert C.enough_samples(labels.where("l <> 'y'"), "l").count() == 6


def test_metrics(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "a")] + [("c", "a")]
    out = {r["label"]: r for r in E.class_metrics(E.confusion(spark.createDataFrame(rows, "label string, prediction string"))).collect()}
    assert out["a"]["precision"] == pytest.approx(3 / 5) and out["a"]["recall"] == pytest.approx(3 / 4)
    assert out["c"]["f1"] == 0.0 and out["c"]["support"] == 1
    grid = spark.createDataFrame([(3, 0.5), (4, 0.7), (5, 0.7)], "k int, s double")
    assert E.first_best(grid, "s", "k").first()["k"] == 4


def test_clusters(spark):
    rows = [(i, f"t{i}", ["x"] if i < 6 else ["y"], 0.5, -1 if i == 9 else i % 2) for i in range(10)]
    out = {r["cluster"]: r for r in V.cluster_profile(spark.createDataFrame(rows, "doc_id int, title string, categories array<string>, quality_score double, label int")).collect()}
    assert out["noise"]["size"] == 1 and out["0"]["sample_titles"] == ["t0", "t2", "t4"]
    vectors = spark.createDataFrame([(i, [float(i // 3 * 10), float(i % 3) / 10], i // 3) for i in range(6)] + [(6, [99.0, 99.0], 2)], "vec_id int, embedding array<float>, label int")
    found = {r["vec_id"]: r["cluster"] for r in L.dbscan(vectors, 0.5, 3).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: -1}
    assert [r["vec_id"] for r in V.nearest(vectors, vectors.where("vec_id = 1"), 3).orderBy("rank").collect()] == [1, 0, 2]


def test_dbscan_chain_and_sweep(spark):
    chain = spark.createDataFrame([(i, [i * 0.4, 0.0]) for i in range(120)] + [(500 + i, [0.0, 9.0 + i * 0.2]) for i in range(3)], "vec_id int, embedding array<float>")
    assert {r["vec_id"]: r["cluster"] for r in L.dbscan(chain, 0.5, 3).collect()} == {i: 1 for i in range(120)} | {500: 500, 501: 500, 502: 500}
    out = L.dbscan_sweep(chain).orderBy("eps").collect()
    assert [(r["eps"], r["clusters"], r["noise"]) for r in out] == [(0.5, 2, 0), (0.7, 2, 0), (1.0, 2, 0)]
    assert [r["best"] for r in out] == [True, False, False]


def test_knn_asks_all_due_queries(spark):
    import __spark_entry__ as entry

    where = "/root/testdata/sf0.001"
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()}
    got = {}
    for r in entry.queries()["knn_topk_due"](spark, where).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    far = lambda x, y: sum((float(p) - float(q)) ** 2 for p, q in zip(x, y))
    assert {q: [x[k] for k in sorted(x)] for q, x in got.items()} == {q: sorted(rows, key=lambda i: (far(rows[i], rows[q]), i))[:10] for q in rows if q % 20 == 0}


def test_learning_queries_take_the_whole_job(spark, monkeypatch):
    from paperloom.plans import corpus_queries as Q

    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    asked = {}
    for name in ("lda_topics", "contest", "kmeans_sweep", "lsa_topics"):
        monkeypatch.setattr(L, name, lambda rows, *a, name=name, **k: asked.setdefault(name, (rows.count(), a[: 2 if name == "contest" else 0], k)))
    for query in (Q.lda_topics, Q.classifier_contest, Q.kmeans_sweep, Q.lsa_topics):
        query(spark, where)
    assert asked["lda_topics"] == (docs.count(), (), {}) and asked["lsa_topics"] == (docs.count(), (), {})
    assert asked["contest"][1:] == (("category", "doc_id"), {})
    assert asked["kmeans_sweep"][2] == {"seeds": range(42, 52)}
    assert Q.tfidf_weights_all(spark, where).join(docs.where("lang <> 'en'"), "doc_id").count() > 0
    assert Q.vocabulary_all(spark, where).count() > Q.vocabulary(spark, where).count()
    assert Q.u_mass_coherence_all(spark, where).count() > 0


def test_feed(spark, tmp_path):
    entry = "<entry><id>http://x.org/abs/2301.00001v1</id><title>A\nB </title><summary> s </summary><published>2023-01-02T03:04:05Z</published><updated>2023-01-02T03:04:05Z</updated><category term='cs.AI'/><category term='cs.LG'/><author><name>N M</name></author></entry>"
    (tmp_path / "f.xml").write_text(f"<feed>{entry}</feed>")
    row = feeds.read_feed(spark, str(tmp_path / "f.xml")).first()
    assert row["arxiv_id"] == "2301.00001v1" and row["title"] == "A B" and row["categories"] == ["cs.AI", "cs.LG"]
    assert row["authors"] == ["N M"] and row["pdf_url"] == "http://x.org/pdf/2301.00001v1.pdf" and row["published"] == datetime(2023, 1, 2, 3, 4, 5)


def test_pdfs(spark, tmp_path):
    for name in ("2301.12345v2.pdf", "other.pdf", "note.txt"):
        (tmp_path / name).write_bytes(b"one|two" if name != "other.pdf" else b"bad")
    files = feeds.list_pdfs(spark, str(tmp_path))
    assert files.count() == 2 and [r["title"] for r in feeds.papers_from_pdfs(files).collect()] == ["Existing Paper 2301.12345v2"]

    def pages(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode().split("|")

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(str(tmp_path))
    texts = sorted(str(r["full_text"]) for r in feeds.extract_pdf_text(raw, pages).collect())
    assert texts == ["None", "one\ntwo"]


def test_pipeline_and_store(spark, tmp_path):
    result = clean.run(papers(spark, TINY).limit(40).drop("cleaned_text").withColumn("arxiv_id", F.col("arxiv_id").cast("string")))
    store = Store(spark, str(tmp_path / "s"))
    accepted = result.papers.persist()
    n = accepted.count()
    assert n > 0 and n + result.rejected.count() == 40 and result.stats.first()["total"] == 40
    assert store.save_papers(accepted.unionByName(accepted.limit(1).withColumn("arxiv_id", F.lit(None).cast("string")))) == {"saved": n, "failed": 1}
    some = accepted.first()["arxiv_id"]
    assert store.load_paper(some, text_only=True).columns == ["arxiv_id", "title", "cleaned_text", "categories", "quality_score"]
    assert store.load_paper(some).count() == 1
    chunks = result.chunks.withColumn("batch", F.lit(0))
    store.save_chunks(chunks, "r1")
    assert store.load_chunks("r1").count() == chunks.count() and store.load_chunks(limit=2).count() == 2 and store.load_chunks("r2").count() == 0
    assert store.load_dataset() is None
    store.save_dataset(result.dataset, result.chunks)
    assert store.load_dataset()[0].count() == result.dataset.count()
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "key string, embedding array<double>")
    store.add_embeddings(vectors)
    store.add_embeddings(vectors.union(spark.createDataFrame([("c", [3.0])], vectors.schema)))
    assert spark.read.parquet(str(tmp_path / "s/embeddings")).count() == 3
    assert {r["kind"] for r in store.stats().collect()} == {"papers", "chunks", "dataset_papers", "dataset_chunks", "embeddings"}
    assert store.cleanup(30) == 0 and store.cleanup(30, datetime.now(timezone.utc) + timedelta(days=40)) > 0
    write_json(accepted.select("arxiv_id", "title"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == n
    (tmp_path / "d.json").write_text('{"papers": [{"arxiv_id": "1"}], "chunks": []}')
    assert read_json_dataset(spark, str(tmp_path / "d.json"))[0].count() == 1
    assert "rows" in report("T", stats=store.stats())


def test_stream(spark, tmp_path):
    schema = "k string, t string, seq int"
    source, table = str(tmp_path / "in"), str(tmp_path / "t")
    for rows in ([("a", "1", 1), ("a", "2", 2)], [("a", "3", 3), ("b", "1", 1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        upsert_stream(spark, source, schema, table, "k", "seq", str(tmp_path / "c")).awaitTermination()
    rows = {r["k"]: r["t"] for r in spark.read.parquet(f"{table}/v={current_version(spark, table)}").collect()}
    assert rows == {"a": "3", "b": "1"}
