"""MinHash, language ID, toxicity, token counts, spans and search against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import graph, langid, minhash, search, spans, tokencount, toxicity, vectext

DOCS = "doc_id long, text string, lang string, source string"
EDGES = [(9000, None), (9001, ""), (9002, " \n\t "), (9003, "one two"), (9004, "ONE two"), (None, "one two"), (9005, "!!! ??? 123"), (9006, "long " * 30000)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def near_copies(n=60, copies=6, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in text))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_words_and_shingles():
    texts = ["a b  c\nd e f", "", "Éa b", None, " x ", "a b c d e"]
    for first, last, data, offsets in vectext.text_blocks(pa.array(texts), 8):
        start, end, row = vectext.words(data, offsets)
        got = defaultdict(list)
        for a, b, r in zip(start, end, row):
            got[r + first].append(data[a:b].tobytes().decode())
        for k in range(first, last):
            assert got[k] == (texts[k] or "").split(), k
    sets = {}
    for first, _, h, b in vectext.shingle_sets(pa.array([t for _, t in near_copies(20)])):
        for k in range(len(b) - 1):
            sets[first + k] = h[b[k] : b[k + 1]]
    for k, (_, t) in enumerate(near_copies(20)):
        w = words(t)
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
        assert len(sets[k]) == len(want) and (np.diff(sets[k].astype(object)) > 0).all()


def groups(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_minhash(spark):
    rows = near_copies() + [r for r in EDGES if r[0] is not None]
    df = table(spark, [*rows, (None, "no id at all")]).withColumn("component", F.lit("clash")).withColumn("id", F.lit(0))
    got = minhash.near_duplicates(df).collect()
    want = groups(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    twice = minhash.near_duplicates(table(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in twice) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    kept = {r["doc_id"] for r in minhash.keep_one_of_each(df).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c} | {None}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_chains(spark):
    """Links that no bucket's least member sees: a chain, each like the next only."""
    base = [f"w{k}" for k in range(160)]
    rows = [(i, " ".join(base[i * 6 : i * 6 + 80])) for i in range(13)]
    rows += [(100 + i, " ".join(base[:60] + [f"x{i}_{k}" for k in range(6)])) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in groups(rows).items()}


def test_minhash_tiles_skip_only_shared_buckets():
    """A pair whose low bytes agree in an earlier band, by chance, has not met there."""
    sketch = np.random.default_rng(3).integers(0, 256, minhash.WIDE).astype(np.uint8).tobytes()
    bands = np.arange(2 * minhash.BANDS, dtype=np.int64).reshape(2, minhash.BANDS)
    bands[1, 7] = bands[0, 7]

    def pairs(bands):
        columns = {"id": [5, 3], "component": [5, 3], "side": [2, 2], "band": [7, 7], "value": [sketch, sketch], "bands": bands.tolist()}
        return minhash._tile_pairs(pa.table(columns)).to_pylist()

    assert pairs(bands) == [{"a": 3, "b": 5}]
    bands[1, 2] = bands[0, 2]
    assert pairs(bands) == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: c for x, c in least.items() if x in got} and set(got) >= {x for a, b in edges if a != b for x in (a, b)}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def languages(n=400):
    rng = random.Random(4)
    parts = {"en": "the and ing tion er on".split(), "fr": "eau que ré les ez oi".split(), "de": "sch ung keit der ich ü".split()}
    return [(i, lang, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 50)))) for i, lang in enumerate(rng.choices(list(parts), k=n))]


def naive_profile(texts, most):
    counts = Counter()
    for t in texts:
        for run in re.findall(r"[^\W\d_]+", t.lower()):
            counts.update(run)
            counts.update(a + b for a, b in zip(f" {run}", f"{run} "))
            counts.update(f" {run} "[k : k + 3] for k in range(len(run)))
    key = lambda g: sum((1 if c == " " else ord(c) + 2) << 21 * k for k, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))[:most]]


def test_long_texts_in_slices(monkeypatch):
    """What is counted or hashed piece by piece equals the whole."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé ,\n1Σ") for _ in range(n)) for n in (0, 1, 5, 49, 50, 51, 400)] + ["x" * 300, " " * 120, "ab" * 100 + " . " + "cd" * 90]
    whole = [(sorted(langid.ngrams(t).tolist()), langid.ranked(t, 20).tolist()) for t in texts]
    monkeypatch.setattr(langid, "SLICE", 50)
    assert [(sorted(langid.ngrams(t).tolist()), langid.ranked(t, 20).tolist()) for t in texts] == whole
    for t in texts[1:]:
        data = np.frombuffer(t.encode(), np.uint8)
        start, end, _ = vectext.words(data, np.array([0, len(data)]))
        if len(start):
            want = vectext.Hasher(data).ranges(start, end)
            for limit in (1, 7, 64):
                assert (vectext.word_hashes(data, start, end, limit) == want).all()


def test_a_text_of_many_megabytes():
    """Memory follows words and distinct n-grams: 100 MB in a row of its own."""
    text = "some words of a long text. " * 4_000_000
    assert len(text) > 100 << 20 and langid.Scorer({"en": langid.ranked("some words of a long text"), "xx": langid.ranked("zzz")}).predict(text)[0] == "en"
    [(_, _, sets, bounds)] = list(vectext.shingle_sets(pa.array([text[: 27 * 1_000_000]])))
    assert len(sets) == 6 and bounds.tolist() == [0, 6]


def test_langid(spark):
    rows = languages()
    df = spark.createDataFrame([(i, t, lang, None) for i, lang, t in rows] + [(i, t, None, None) for i, t in EDGES], DOCS).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    profiles = {lang: naive_profile([t for i, x, t in rows if x == lang and not held(i)], langid.PROFILE) for lang in ("de", "en", "fr")}
    right = 0
    for i, lang, t in rows:
        mine = naive_profile([t], langid.PROFILE)
        apart = {k: sum(abs(p.index(g) - r) if g in p else langid.PROFILE for r, g in enumerate(mine)) / (langid.PROFILE * len(mine)) for k, p in profiles.items()}
        best, second = sorted((d, k) for k, d in apart.items())[:2]
        assert got[i]["lang_pred"] == best[1] and math.isclose(got[i]["score"], (second[0] - best[0]) / second[0], abs_tol=1e-9) and got[i]["held_out"] == held(i)
        right += held(i) and got[i]["lang_pred"] == lang
    assert right >= 0.97 * sum(held(i) for i, _, _ in rows)
    for i in (9000, 9001, 9002, 9005):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert {r["doc_id"] for r in langid.keep_known(df).collect()} == set(got) - {9000, 9001, 9002, 9005}
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automaton():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 9)))
    terms = sorted({word() for _ in range(60)})
    lexicon, candidates = toxicity.Lexicon(terms, []), toxicity.Candidates(terms, [])
    for _ in range(4000):
        w = word()
        near = [t for t in terms if len(t) >= toxicity.EDIT_LETTERS and distance(w, t) <= 1]
        want = toxicity.Match(w, 0) if w in terms else toxicity.Match(min(near), 1) if near and len(w) >= toxicity.EDIT_LETTERS - 1 else None
        assert lexicon.find(w) == want
        if want:
            raw = np.frombuffer(w.encode(), np.uint8)
            assert candidates.mask(vectext.Hasher(raw), np.array([0]), np.array([len(raw)]))[0]
    assert toxicity.Lexicon(["ab"], ["xyz"]).find("xyzzy") == toxicity.Match("xyz", 2)


def test_toxicity(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(600):
        text = [word() for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(60), rng.choice(["zbadword", "zhorrible", "Zugly."]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += EDGES + [(9100, "aa bb zhorribel zhorrble cc"), (9101, 'he said "zhorrible" to me'), (9102, "mm zhorrible nn")]
    df, lab = table(spark, rows).withColumn("toxic", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(df, lab).collect()}
    unseen = [i for i, _, _ in labels if held(i)]
    wrong = [i for i in unseen if got[i]["predicted"] != int(i % 5 == 0)]
    assert len(wrong) <= 0.05 * len(unseen)
    for i, _ in EDGES:
        assert got[i]["score"] == 0.0 and got[i]["predicted"] == 0
    assert got[9100]["predicted"] == 1 and got[9102]["predicted"] == 1 and got[9101]["score"] < got[9102]["score"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"]) for r in got.values())
    assert {r["score"] for r in toxicity.score(df, lab.limit(0)).collect()} == {0.0}
    assert toxicity.score(df.limit(0), lab).count() == 0


def naive_tokens(word, pieces, lowest):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for e in range(1, len(word) + 1):
        found = [(best[e - 1][0] + lowest, -(-best[e - 1][1] - 1) * 1)]
        options = [(best[e - 1][0] + lowest, best[e - 1][1] + 1)]
        options += [(best[a][0] + pieces[word[a:e]], best[a][1] + 1) for a in range(e) if word[a:e] in pieces]
        best[e] = max(options, key=lambda x: (x[0], -x[1]))
        del found
    return best[-1][1]


def test_token_counts(spark):
    if not __import__("os").path.exists(tokencount.VOCABULARY):
        pytest.skip("no vocabulary file")
    loaded = tokencount.load_pieces()
    pieces = dict(zip(loaded.raw, loaded.scores))
    lowest = min(loaded.scores) - tokencount.BYTE_PENALTY
    rows = near_copies(12) + EDGES + [(9200, "naïve Ünïcode 漢字 \U0001f600 http://x.y/z?a=1"), (9201, "q" * 300 + " tail")]
    got = tokencount.count_tokens(table(spark, rows).withColumn("n_tokens", F.lit("clash"))).collect()
    known: dict[bytes, int] = {}
    for r, (i, t) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))):
        ws = [b" " + w for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        for w in set(ws):
            if w not in known:
                known[w] = naive_tokens(w, pieces, lowest)
        assert (r["doc_id"], r["n_tokens"], r["n_words"], r["n_bytes"]) == (i, sum(known[w] for w in ws), len(ws), len((t or "").encode()))
    from tokenizers import Tokenizer, models

    library = Tokenizer(models.Unigram([("<unk>", lowest), *((p.decode(), s) for p, s in pieces.items())], unk_id=0))
    plain = [w.decode() for w in known if w.isascii() and len(w) < 60]
    assert [len(library.encode(w, add_special_tokens=False).ids) for w in plain] == [known[w.encode()] for w in plain]


@pytest.mark.parametrize(("places", "narrow"), [(1, 0), (40, 0), (40, 1000), (1 << 19, 6)])
def test_token_trie_in_groups_of_levels(monkeypatch, places, narrow):
    """Words of any length share one trie, however many of its levels are made at once."""
    monkeypatch.setattr(tokencount, "PLACES", places)
    monkeypatch.setattr(tokencount, "NARROW", narrow)
    rng = random.Random(23)
    pieces = {b" ": -3.0, b" a": -2.5, **{bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))): -rng.randint(1, 40) / 8 for _ in range(60)}}
    counter = tokencount.Counter(tokencount.Pieces(list(pieces), list(pieces.values())))
    stem = [rng.choice(b"abcd") for _ in range(700)]
    texts = [b" " + bytes(stem[: rng.randint(0, 700)] + [rng.choice(b"abcd") for _ in range(rng.choice([0, 1, 3, 150]))]) for _ in range(60)]
    ends = np.cumsum([len(t) for t in texts])
    got = counter.many(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends)
    assert got.tolist() == [naive_tokens(t, pieces, counter.byte_score) for t in texts]


def naive_spans(rows):
    """Bytes to remove, by document: all runs that occur before, here or elsewhere."""
    runs, first = [], {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        raw = t.encode()
        found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        sentences, now = [], []
        for k, (a, b) in enumerate(found):
            now.append((a, b))
            if raw[b - 1 : b] in (b".", b"!", b"?") or k + 1 == len(found) or b"\n" in raw[b : found[k + 1][0]]:
                sentences.append(now)
                now = []
        for s in range(len(sentences)):
            e, n = s, 0
            while e < len(sentences) and (e - s < 3 or n < 20):
                n += len(sentences[e])
                e += 1
            if e - s >= 3 and n >= 20:
                key = tuple(raw[a:b].lower() if raw[a:b].isascii() else bytes(c + 32 if 65 <= c < 91 else c for c in raw[a:b]) for x in sentences[s:e] for a, b in x)
                runs.append((i, s, sentences[s][0][0], sentences[e - 1][-1][1], key))
                first.setdefault(key, (i, s))
    out = defaultdict(set)
    for i, s, a, b, key in runs:
        if first[key] != (i, s):
            out[i].update(range(a, b))
    return out


def test_spans(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 6)))
    sentence = lambda: (" ".join(word() for _ in range(rng.randint(2, 12)))).capitalize() + rng.choice(". ! ? . .".split())
    passages = [[sentence() for _ in range(9)] for _ in range(5)]
    rows = []
    for i in range(60):
        text = [sentence() for _ in range(rng.randint(1, 12))]
        if i % 2:
            text[1:1] = rng.choice(passages)
        if i == 7:
            text += text
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(200, rows[1][1]), *EDGES]
    got = defaultdict(set)
    df = table(spark, rows).withColumn("h1", F.lit("clash")).withColumn("cuts", F.lit(1))
    for r in spans.repeated_spans(df).collect():
        covered = set(range(r["span_start"], r["span_end"]))
        assert not covered & got[r["doc_id"]] and r["source_doc_id"] <= r["doc_id"]
        got[r["doc_id"]] |= covered
    want = naive_spans(rows)
    space = {i: {k for k, c in enumerate((t or "").encode()) if c in b" \t\n\r\x0b\x0c"} for i, t in rows}
    assert {i: x - space[i] for i, x in got.items() if x} == {i: x - space[i] for i, x in want.items() if x}
    clean = {r["doc_id"]: r["text"] for r in spans.remove_repeats(df).collect()}
    for i, t in rows:
        if i is not None and t is not None:
            assert clean[i].encode() == bytes(c for k, c in enumerate(t.encode()) if k not in got.get(i, ()))
    assert spans.repeated_spans(df.limit(0)).count() == 0


def test_spans_hold_every_repeated_passage(spark):
    """All words of 51-word passages that an earlier document has, whatever their sentences."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(4, 8)))
    some = lambda a, b: [word() + rng.choice(["", "", "", "", "", ","]) for _ in range(rng.randint(a, b))]
    passages = [some(51, 90) for _ in range(6)] + [some(40, 50) for _ in range(3)]
    passages[0][30] += "."  # one sentence ends inside; the others hold none
    rows = [(i, " ".join([*some(0, 40), *passages[i % 9], *some(0, 40)])) for i in range(36)]
    got = defaultdict(set)
    for r in spans.repeated_spans(table(spark, rows), passages=True).collect():
        covered = set(range(r["span_start"], r["span_end"]))
        assert not covered & got[r["doc_id"]] and r["source_doc_id"] < r["doc_id"] and r["n_sentences"] > 0
        got[r["doc_id"]] |= covered
    seen, want = set(), defaultdict(set)
    for i, t in rows:
        at = [m.span() for m in re.finditer(r"\S+", t)]
        windows = {k: tuple(t[a:b] for a, b in at[k : k + 51]) for k in range(len(at) - 50)}
        for k, w in windows.items():
            if w in seen:
                want[i].update(range(at[k][0], at[k + 50][1]))
        seen |= set(windows.values())
    assert len(want) == 18 and dict(got) == dict(want)


def test_spans_across_documents(spark):
    """The registered query's parameters: copies, edits, junk runs, ids out of order, repeated rows."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(3, 6))) + rng.choice(["", "", "", "."])
    passages = [[word() for _ in range(rng.randint(51, 200))] for _ in range(4)] + [["the"] * 90, ["x", "y"] * 60]
    rows = []
    for i in range(80):
        text = [*(word() for _ in range(rng.randint(0, 60))), *rng.choice(passages), *(word() for _ in range(rng.randint(0, 60)))]
        if i % 4 == 0 and rows:
            text = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
        rows.append((1000 - i * 7, " ".join(text)))
    rows += [rows[3], (2000, "own words. " * 30), *EDGES]
    got = defaultdict(set)
    for r in spans.repeated_spans(table(spark, rows), passages=True, within=False).collect():
        assert r["source_doc_id"] < r["doc_id"]
        got[r["doc_id"]].update(range(r["span_start"], r["span_end"]))
    first, want = {}, defaultdict(set)
    for i, t in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())]
        low = words(t)
        for k in range(len(at) - 50):
            if first.setdefault(tuple(low[k : k + 51]), i) != i:
                want[i].update(range(at[k][0], at[k + 50][1]))
    assert want and all(got[i] >= x for i, x in want.items())
    # what goes beyond the passages are sentence runs that another document has
    runs = naive_spans([r for r in rows if r[0] != 2000])
    assert all(got[i] - want[i] <= runs[i] for i in got) and 2000 not in got and got.keys() - {i for i, x in want.items() if x} <= runs.keys()


def test_spans_query_within_and_across_documents(spark, tmp_path):
    """The registered query: every 51 words and every sentence run that occur before, here or in a smaller doc_id."""
    from paperloom.llm.queries import op9_substring_dedup

    rng = random.Random(27)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(4, 7))) + rng.choice(["", "", "", "."])
    some = lambda a, b: [word() for _ in range(rng.randint(a, b))]
    passages = [some(51, 120) for _ in range(4)]
    rows = [(i, " ".join([*some(0, 30), *rng.choice(passages), *some(0, 30)])) for i in range(0, 40, 2)]
    for i in range(1, 30, 2):  # a passage twice, at times cut at its ends, or one that other documents have
        p = rng.choice([some(70, 160), some(70, 160), passages[i % 4]])
        rows.append((i, " ".join([*some(0, 30), *p, *some(1, 30), *p[rng.randint(0, 9) : len(p) - rng.randint(0, 9)], *some(0, 30)])))
    rows += [(50, "the " * 90), (51, "own words. " * 30), (52, rows[0][1])]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = defaultdict(set)
    for r in op9_substring_dedup(spark, str(tmp_path)).collect():
        assert r["source_doc_id"] <= r["doc_id"]
        got[r["doc_id"]].update(range(r["span_start"], r["span_end"]))
    seen, want = set(), naive_spans(rows)
    for i, t in sorted(rows):
        at = [m.span() for m in re.finditer(r"\S+", t)]
        for k in range(len(at) - 50):
            w = tuple(t[a:b] for a, b in at[k : k + 51])
            if w in seen:
                want[i].update(range(at[k][0], at[k + 50][1]))
            seen.add(w)
    space = {i: {k for k, c in enumerate(t) if c == " "} for i, t in rows}
    want = {i: x - space[i] for i, x in want.items() if x}
    assert {i: x - space[i] for i, x in got.items()} == want and 50 in want and sum(i % 2 for i in want) > 10


def naive_search(rows, asked, k, terms):
    docs = {i: Counter(words(t)) for i, t in rows if i is not None and words(t)}
    n, mean = len(docs), sum(sum(c.values()) for c in docs.values()) / max(1, len(docs))
    df = Counter(w for c in docs.values() for w in c)
    idf = {w: math.log(1 + (n - x + 0.5) / (x + 0.5)) for w, x in df.items()}
    out = {}
    for q in asked:
        best = sorted(docs[q].items(), key=lambda x: -x[1] * idf[x[0]])[:terms]
        scores = {}
        for i, c in docs.items():
            s = sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, _ in best if w in c)
            if s:
                scores[i] = s
        out[q] = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


def test_search(spark):
    rows = near_copies(50, 8, seed=9) + [r for r in EDGES if r[0] != 9006] + [(7000, "zz yy xx"), (7001, "zz yy xx")]
    df = table(spark, rows).withColumn("term", F.lit("clash"))
    asked = [i for i, t in rows if i is not None and i % 5 == 0 and words(t)]
    got = defaultdict(list)
    for r in search.search(df, df.where("doc_id % 5 = 0"), 10, query_terms=10_000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    want = naive_search(rows, asked, 10, 10_000)
    for q in asked:
        assert [round(s, 6) for _, s in got[q]] == [round(s, 6) for _, s in want[q]]
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]]
    assert set(got) == set(asked)
    assert search.search(df.limit(0), df).count() == 0 and search.search(df, df.limit(0)).count() == 0


def test_search_asks_with_the_whole_text(spark):
    """The registered query's own parameters against brute force over all words."""
    rows = near_copies(40, 6, seed=12)
    df = table(spark, rows)
    asked = [i for i, t in rows if i % 20 == 0]
    assert max(len(set(words(t))) for i, t in rows if i in asked) > 60
    got = defaultdict(list)
    for r in search.search(df, df.where("doc_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], round(r["score"], 6)))
    assert got == {q: [(d, round(s, 6)) for d, s in x] for q, x in naive_search(rows, asked, 10, None).items()}


def test_search_of_copies_and_repeated_ids(spark, monkeypatch):
    """Many copies, ids that several rows have, words that occur often, and shards of a few rows."""
    rng = random.Random(31)
    rows = near_copies(30, 5, seed=14)
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000 + i % 7, rows[5 + i][1]) for i in range(21)] + [(3000, "many " * 700 + "words"), (3020, "many words"), (3040, "")]
    rng.shuffle(rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    docs = [(i, Counter(words(t))) for i, x in texts.items() for t in x if words(t)]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    idf = {w: math.log(1 + (n - x + 0.5) / (x + 0.5)) for w, x in df.items()}
    want = {}
    for q in (i for i in texts if i % 20 == 0 and any(words(t) for t in texts[i])):
        asked = {w for t in texts[q] for w in words(t)}
        scores = defaultdict(float)
        for i, c in docs:
            scores[i] = max(scores[i], sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in asked if w in c))
        want[q] = [(i, round(s, 6)) for i, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0])) if s][:10]
    df = table(spark, rows).repartition(3)
    for size in (search.SHARD_BYTES, 3000):
        monkeypatch.setattr(search, "SHARD_BYTES", size)
        got = defaultdict(list)
        for r in search.search(df, df.where("doc_id % 20 = 0")).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["doc_id"], round(r["score"], 6)))
        assert got == want


def test_search_group_scores_what_all_shards_leave(monkeypatch):
    """Bounds of all shards first: of eight shards about k blocks a query are scored, not k of each."""
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(20, 120))) for _ in range(800)]
    docs = [Counter(words(t)) for t in texts]
    df = Counter(w for c in docs for w in c)
    idf = {w: math.log(1 + (800 - x + 0.5) / (x + 0.5)) for w, x in df.items()}
    mean = sum(sum(c.values()) for c in docs) / 800
    shards, hashes = [], {}
    for n in range(8):
        _, _, terms, row, times, lengths = next(search._term_counts(pa.array(texts[n * 100 : n * 100 + 100])))
        shards.append(search._shard(n, np.arange(n * 100, n * 100 + 100), terms, row, times, lengths, 10))
        for i in range(0, 100, 20):
            hashes[n * 100 + i] = terms[row == i]
    weight = {int(next(search._term_counts(pa.array([w])))[2][0]): x for w, x in idf.items()}
    asked = [(q, int(t)) for q, x in hashes.items() for t in x]
    pack = search._packed(pa.table({"pack": pa.array([0] * len(asked), pa.int32()), "query_id": [q for q, _ in asked], "term": pa.array(np.array([t for _, t in asked], np.uint64).view(np.int64)), "weight": [weight[t] for _, t in asked]}))
    scored, scores = [], search.ShardIndex.scores
    monkeypatch.setattr(search.ShardIndex, "scores", lambda self, blocks: scored.append(len(blocks)) or scores(self, blocks))
    found = search._search_group(pa.Table.from_batches(shards), pack, mean, 10).to_pylist()
    for q in hashes:
        want = sorted(((sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in docs[q] if w in c), i) for i, c in enumerate(docs)), key=lambda x: (-round(x[0], 9), x[1]))[:10]
        assert [(r["doc_id"], round(r["score"], 9)) for r in found if r["query_id"] == q] == [(i, round(s, 9)) for s, i in want]
    assert sum(scored) <= 12 * len(hashes)


def test_block_max_wand():
    rng = random.Random(10)
    for _ in range(30):
        lists = [sorted(rng.sample(range(3000), rng.choice([1, 5, 200, 1500]))) for _ in range(rng.randint(1, 8))]
        impacts = [[rng.choice([0.5, 1.0, 2.0, rng.random() * 3]) for _ in x] for x in lists]
        weights = [rng.random() * 4 for _ in lists]
        scores = Counter()
        for docs, values, w in zip(lists, impacts, weights):
            for d, v in zip(docs, values):
                scores[d] += w * v
        terms = np.arange(len(lists)) * 7
        index = search.ShardIndex(*(np.concatenate(x) for x in ([np.full(len(d), t) for t, d in zip(terms, lists)], lists, impacts)))
        found = search.wand(index, np.append(terms, 5), np.append(weights, 1.0), 10)
        assert [(d, round(s, 9)) for s, d in found] == [(d, round(s, 9)) for d, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]]
