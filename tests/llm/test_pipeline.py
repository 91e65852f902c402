"""The pipeline stage by stage against the operators it is made of, and as a whole against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest
from paperloom.llm import decontaminate, langid, minhash, mixing
from pyspark.sql import functions as F

from tests.llm.test_native import DOCS, leaks, seeded, targets
from tests.llm.test_text_ops import groups

TINY = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    extra = spark.createDataFrame([(90001, "12 34 !!", "en", "src0", 8), (90002, None, "en", "src0", None), (90003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(extra).cache()
    steps = dict(P.STAGES)
    known = steps["language_id"](spark, docs, TINY).cache()
    assert known.columns == docs.columns
    assert {r["doc_id"] for r in docs.select("doc_id").exceptAll(known.select("doc_id")).collect()} == {r["doc_id"] for r in langid.identify(docs).where("lang_pred = 'und'").collect()} >= {90001, 90002, 90003}
    single = steps["minhash_near_dedup"](spark, known, TINY).cache()
    found = minhash.near_duplicates(known)
    assert single.count() == found.select("component_id").distinct().count() and single.columns == docs.columns
    clean = steps["benchmark_decontamination"](spark, single, TINY).cache()
    benchmark = spark.read.parquet(f"{TINY}/benchmark.parquet")
    assert single.count() - clean.count() == decontaminate.contaminated(single, benchmark).select("doc_id").distinct().count()
    mixed = steps["source_mixing"](spark, clean, TINY).cache()
    size = F.regexp_count("text", F.lit(mixing.WORD))
    drawn = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    goal = {r["source"]: r["t"] for r in mixing.mix(clean).groupBy("source").agg(F.max("target").alias("t")).collect()}
    assert mixed.columns == docs.columns and all(abs(drawn[s] - t) <= 0.5 for s, t in goal.items())
    final = steps["sharding"](spark, mixed, TINY).collect()
    sizes = Counter(r["shard"] for r in final)
    assert len(final) == mixed.count() and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in final if r["shard"] == s) == list(range(n)) for s, n in sizes.items())


def test_run(spark):
    rows = P.run(spark, TINY)
    assert rows.count() > 0 and rows.columns[-2:] == ["shard", "slot"]


def fixture():
    """Documents (doc_id, text, source) and benchmark items with what each stage has to act on."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 30)))) for k in range(8)]
    rows = []
    for i in range(0, 150, 3):
        text = [word() for _ in range(rng.randint(1, 90))]
        if i % 5 == 0:
            text[1:1] = items[i % 8][1].split()
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None])
        rows.append((i, " ".join(text), source))
        near = list(text)
        near[rng.randrange(len(near))] = word()
        rows.append((i + 1, " ".join(near), source))
        if i % 2:
            rows.append((i + 2, "  " + "\n ".join(text).upper() + " ", "s2"))
    rows += [(900, None, "s2"), (901, "", "s1"), (902, " \n ", None), (905, "12 34 !!", "s3"), (904, "many " * 3000 + "50% $5 #x", "s3"), (None, "no id here", "s1"), (906, "the same", "s2"), (906, "the same", "s2")]
    return rows, items


def whole_words(text):
    return list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))


def mixed_rows(rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(whole_words(t))
    out = []
    for source, target in targets(sizes).items():
        goal = math.floor(target + 0.5)
        epochs = goal // sizes[source] if sizes[source] else 0
        left = goal - epochs * sizes[source]

        def key(row):
            crc = zlib.crc32((row[1] or "").encode())
            quality = max(0.1, 1 - 4 * len(re.findall(mixing.SYMBOLS, row[1] or "")) / max(len(row[1] or ""), 1)) if row[1] is not None else 0.1
            return -math.log((seeded(mixing.SEED, row[0], crc) + 0.5) / 2**60) / quality, -1 if row[0] is None else row[0], crc

        for i, t, s in sorted((r for r in rows if r[2] == source), key=key):
            found = whole_words(t)
            out += [(i, t, s)] * (epochs if found else 0)
            taken = min(len(found), left)
            left -= taken
            if taken:
                out.append((i, t if taken == len(found) else t[found[0].start() : found[taken - 1].end()], s))
    return out


def sharded_rows(rows):
    by, out, starts = defaultdict(list), Counter(), Counter()
    for i, t, s in rows:
        crc = zlib.crc32(t.encode())
        by["~" if s is None else "s" + s].append((seeded("shards-1", i, crc), -1 if i is None else i, crc, len(t.encode()) + 8, t, s))
    placed = sorted(((r + 0.5) / len(part), key, x) for key, part in by.items() for r, x in enumerate(sorted(part)))
    for p, (_, _, x) in enumerate(placed):
        shard = p * 24 // len(placed)
        out[x[1], x[4], x[5], shard, starts[shard]] += 1
        starts[shard] += 1
    return out


def test_run_against_plain_python(spark, tmp_path):
    """All five stages over a small table, recomputed without Spark; extra columns with clashing names ride along."""
    rows, items = fixture()
    table = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    for name in ("size", "kept", "part", "bucket", "slot"):
        table = table.withColumn(name, F.lit("clash"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    known = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    found = groups([r[:2] for r in known if r[0] is not None])
    single = [r for r in known if r[0] is None or found[r[0]][1] == r[0]]
    leaked = {i for i, _ in leaks([r[:2] for r in single], items)}
    clean = [r for r in single if r[0] not in leaked]
    assert len(rows) > len(known) > len(single) > len(clean) > 20
    got = P.run(spark, str(tmp_path))
    assert got.columns == [*(c for c in table.columns if c != "slot"), "shard", "slot"]
    got = got.collect()
    assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["source"], r["shard"], r["slot"]) for r in got) == sharded_rows(mixed_rows(clean))
    assert all(r["n_chars"] == len(r["text"]) and r["size"] == r["kept"] == "clash" for r in got)


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_run_over_empty_tables(spark, tmp_path, empty):
    rows, items = fixture()
    tables = {"documents": spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows[:10]], DOCS), "benchmark": spark.createDataFrame(items, "item_id long, text string")}
    for name, table in tables.items():
        table.limit(0 if name == empty else 1000).write.parquet(f"{tmp_path}/{name}.parquet")
    assert (P.run(spark, str(tmp_path)).count() == 0) == (empty == "documents")
