"""Sharding, mixing, chat formatting and decontamination against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.llm import chat, decontaminate, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def corpus(n=240):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randint(1, 60))), rng.choice(["s1", "s1", "s1", "s2", "s3", None])) for i in range(n)]
    return [*rows, (900, None, "s2"), (901, "", "s1"), (902, " \n ", None), (None, "no id here", "s1"), (903, "same", "s2"), (903, "same", "s2"), (904, "word " * 5000, "s3")]


def seeded(seed, i, crc):
    text = f"{seed}|{'' if i is None else i}|{crc}"
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_sharding(spark):
    rows = corpus()
    got = sharding.interleave(docs(spark, rows), 24).collect()
    by = defaultdict(list)
    for i, t, s in rows:
        crc = zlib.crc32((t or "").encode())
        by["~" if s is None else "s" + s].append((seeded(sharding.SEED, i, crc), -1 if i is None else i, crc, len((t or "").encode()) + 8))
    placed = []
    for key, part in by.items():
        placed += [((r + 0.5) / len(part), key, *x) for r, x in enumerate(sorted(part))]
    n = len(placed)
    want, starts = Counter(), Counter()
    for p, x in enumerate(sorted(placed)):
        shard = p * 24 // n
        want[x[3], x[5], x[4], shard, starts[shard]] += 1
        starts[shard] += 1
    assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24
    assert sharding.interleave(docs(spark, rows).limit(0)).count() == 0
    out = sharding.shard_rows(docs(spark, rows).withColumn("shard", F.lit("x")).withColumn("size", F.lit("y")).withColumn("row", F.lit("z")))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "row", "shard", "slot"] and out.count() == n
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in out.collect()) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in got)


def targets(sizes, weights=(5, 2, 1), repeats=3):
    """The rule as stated: stop at the cap, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= repeats * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: repeats * sizes[s] for s in over})


@pytest.mark.parametrize("skew", [1, 40])
def test_mixing(spark, skew):
    rows = corpus() + [(5000 + k, "x y z", "s9") for k in range(skew * 5)]
    got = mixing.mix(docs(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["epochs"] * r["size"] <= r["taken"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5
    # the partial pass takes whole rows in the order of the exponential keys
    key = lambda r, q: -math.log((seeded(mixing.SEED, r[0], zlib.crc32((r[1] or "").encode())) + 0.5) / 2**60) / q
    part = {r["doc_id"]: (r["part"], r["size"]) for r in got if r["source"] == "s1" and r["size"]}
    order = sorted((r for r in rows if r[2] == "s1" and size(r[1])), key=lambda r: key(r, max(0.1, 1 - 4 * len(re.findall(mixing.SYMBOLS, r[1])) / len(r[1]))))
    states = [0 if part[r[0]][0] == part[r[0]][1] else 1 if part[r[0]][0] else 2 for r in order]
    assert states == sorted(states) and states.count(1) <= 1
    again = {(r["doc_id"], r["source"]): r["taken"] for r in mixing.mix(docs(spark, rows).repartition(7)).where("doc_id <> 903").collect()}
    assert again == {(r["doc_id"], r["source"]): r["taken"] for r in got if r["doc_id"] != 903 and r["doc_id"] is not None}


def test_draw_mix(spark):
    rows = corpus()
    base = docs(spark, rows).withColumn("size", F.lit("clash")).withColumn("epochs", F.lit("clash"))
    out = mixing.draw_mix(base)
    assert out.schema.names == base.schema.names
    drawn = Counter()
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(t)
    for r in out.collect():
        assert any((t or "").startswith(r["text"]) for t in texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) and r["size"] == "clash"
        drawn[r["source"]] += len(r["text"].split())
    taken = {r["source"]: r["taken"] for r in mixing.mix(docs(spark, rows)).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    assert {s: n for s, n in taken.items() if n} == dict(drawn)
    assert mixing.draw_mix(base.limit(0)).count() == 0


def rotated(rows, part_turns=64):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append(((turn is None, turn or 0, role or "unknown", (text or "").replace("<|", "< |"))))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        for who in {t[2] for t in turns} - {"system"}:
            for p in range(0, len(turns), part_turns):
                text, spans = "", []
                for _, _, role, said in turns[p : p + part_turns]:
                    text += {who: "<|assistant|>", "system": "<|system|>"}.get(role, f"<|user:{role}|>") + "\n"
                    if role == who:
                        spans.append((len(text), len(text) + len(said) + len(chat.END)))
                    text += said + chat.END + "\n"
                out[c, who, p // part_turns] = (text, spans)
    return out


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hé <|x"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (1, 3, "ann", None), (2, None, None, "?"), (2, 5, "a", "b"), (3, 0, "system", "alone"), (None, 0, "u", "no id")]
    rows += [(7, k // 2, "uv"[k % 2], f"turn {k}") for k in range(700)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))).collect()
    assert {(r["conv_id"], r["perspective"], r["part"]): (r["rendered"], [tuple(m) for m in r["masks"]]) for r in got} == rotated(rows)
    for r in got:
        assert r["n_chars"] == len(r["rendered"]) and r["own_chars"] == sum(b - a for a, b in r["masks"]) and r["n_own"] == len(r["masks"])
    whole = defaultdict(lambda: ("", []))
    for r in sorted(got, key=lambda r: r["part"]):
        text, masks = whole[r["conv_id"], r["perspective"]]
        assert r["offset"] == len(text)
        whole[r["conv_id"], r["perspective"]] = text + r["rendered"], [*masks, *((a + r["offset"], b + r["offset"]) for a, b in r["masks"])]
    assert {(c, who, 0): x for (c, who), x in whole.items()} == rotated(rows, 10**6)
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def leaks(rows, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    out = {}
    for i, t in rows:
        doc = runs(words(t))
        for j, u in items:
            item = runs(words(u))
            for a in range(len(doc)):
                if i is None or j is None or not item:
                    continue
                x, y = Counter(doc[a : a + len(item)]), Counter(item)
                s = sum((x & y).values()) / sum((x | y).values())
                if s >= 0.75:
                    out[i, j] = max(s, out.get((i, j), 0))
    return out


def test_decontamination_of_repeated_shingles(spark):
    """Copies behind more of their own shingles: every start is tried in plain Python."""
    items = [(1, "a a a a a a b c d e f g h"), (2, " ".join(f"w{k}" for k in range(20)))]
    rows = [(10, "x y " + "a " * 30 + "b c d e f g h z"), (11, " ".join(f"w{k}" for k in [*range(9, 16), *range(20)])), (12, " ".join(f"w{k}" for k in [*range(20), *range(20)]))]
    rows += [(13, items[0][1] + " " + items[0][1]), (14, "w1 w2 w3 w4 w5 " + items[1][1])]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs(spark, [(i, t, "s") for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = leaks(rows, items)
    assert want[10, 1] == 1 and got == pytest.approx(want, abs=1e-5)


def test_decontamination_against_many_items(spark, monkeypatch):
    """More item shingles than are broadcast: the same pairs, by a shuffled join."""
    rng = random.Random(17)
    items = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 25)))) for k in range(12)] + [(50, "a " * 50 + "b c d e f g h i j")]
    rows = [(i, " ".join(rng.choice("xyz") for _ in range(rng.randint(0, 9))) + " " + items[i % 13][1] + " " + items[(i * 5) % 13][1]) for i in range(26)]
    rows += [(5, "another text of the same id"), (80, "a " * 70 + "b c d e f g h i j")]
    table, bench = docs(spark, [(i, t, "s") for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")
    want = leaks(rows, items)
    few = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(table, bench).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 10)
    many = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(table, bench).collect()}
    assert few == many == pytest.approx(want, abs=1e-5) and want[80, 50] == 1


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(rng.randint(14, 60)))) for k in range(30)] + [(100, "two words"), (101, ""), (102, None), (None, "no id at all for this one"), (103, "to be or not to be or not to be or not to be")]
    rows = []
    for i in range(120):
        text = [word() for _ in range(rng.randint(5, 80))]
        if i % 3 == 0:
            leak = items[i % 30][1].split()
            if i % 2:
                leak[rng.randrange(len(leak))] = "CHANGED"
            if i % 4 == 0:
                leak.insert(len(leak) // 2, "extra")
            text[2:2] = [w.upper() + "," for w in leak]
        rows.append((i, " ".join(text)))
    rows += [(500, "Two words!"), (501, "two words and more"), (502, ""), (503, None), (None, items[0][1]), (504, items[3][1]), (504, items[3][1]), (505, items[5][1] + " x" * 40000), (506, "to be or not to be or not to be or not to be or")]
    table = docs(spark, [(i, t, "s") for i, t in rows]).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(table, bench).collect()}
    want = leaks([(i, (t or "")[:3000]) for i, t in rows], items)
    assert set(got) == set(want) and (500, 100) in got and (501, 100) not in got
    assert all(abs(got[k] - want[k]) < 1e-5 for k in got)
    kept = {r["doc_id"] for r in decontaminate.decontaminate(table, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}
    assert decontaminate.contaminated(table.limit(0), bench).count() == 0 and decontaminate.contaminated(table, bench.limit(0)).count() == 0
