"""Toxicity: Levenshtein automata over a lexicon trie, and scores of the context.

Three passes over bounded or distributed data.  Word counts of a bounded sample
of labelled documents give the lexicon (words, and stems that only toxic words
share).  All counted words are matched against it, which tells how far an exact
and a misspelled match of each term can be trusted.  Then every document is
scored by its matches and what stands around them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import vectext as V
from paperloom.llm.common import cut, held_out, small_batches

#: Labelled documents of each class that are learned from, about.
SAMPLE = 4000
#: Least log-likelihood ratio of a term against chance (a p-value of about one in ten million).
SIGNIFICANT = 28.0
#: Trust below which a kind of match says too little and is ignored.
LEAST_TRUST = 0.6
#: Share of a term's trust that a misspelling never seen in training gets, and from how many
#: letters on it gets the greater one (long terms have hardly any neighbours).
UNSEEN, UNSEEN_LONG, LONG_LETTERS = 0.65, 0.85, 8
#: Share of toxic documents, classes weighed alike, from which a term is in the lexicon.
PRECISION = 0.95
STEM_LETTERS = (4, 5, 6, 7)
#: Different words that a stem must have in toxic documents.
STEM_FORMS = 5
#: Marks a stem among counted words.
STEM = "*"
#: Letters from which one edit is allowed; fewer leave too many neighbours.
EDIT_LETTERS = 5
#: Words on either side that make up a match's context.
CONTEXT = 8
#: What a quoted or reported match counts for, and one beside another match.
QUOTED, COMPANY = 0.4, 1.25
PREDICT = 0.7
#: Words that report what someone else said.
REPORTING = frozenset("said says wrote called quote quoted quoting reported term word".split())
_OPENING, _CLOSING = ('"', "“", "«", "„", "‘"), ('"', "”", "»", "“", "’")
_EDGES = "".join({*".,;:!?()[]{}…*_~", *_OPENING, *_CLOSING, "'", "`", "|"})


class Match(NamedTuple):
    term: str
    kind: int  # 0: the word itself, 1: one edit away, 2: a word of the stem


class Lexicon:
    """A trie of terms and stems, searched with the Levenshtein automaton of a word."""

    def __init__(self, terms: list[str], stems: list[str]) -> None:
        self.root: dict = {}
        for kind, words in (("term", terms), ("stem", stems)):
            for word in words:
                node = self.root
                for letter in word:
                    node = node.setdefault(letter, {})
                node[kind] = word  # keys of more than one letter are marks

    def find(self, word: str, edits: int = 1) -> Match | None:
        """The best match: the word itself, a stem, then the least term one edit away."""
        node = self.root
        stem = None
        for letter in word:
            node = node.get(letter)
            if node is None:
                break
            stem = node.get("stem", stem)
        if node is not None and "term" in node:
            return Match(node["term"], 0)
        if stem is not None:
            return Match(stem, 2)
        return self._near(word, edits) if edits and len(word) >= EDIT_LETTERS - edits else None

    def _near(self, word: str, edits: int) -> Match | None:
        """Run the word's automaton down the trie.

        State: one bit set for each number of edits used; bit i means that i
        letters of the word are consumed.  A branch without states is left.
        """
        places: dict[str, int] = {}
        for i, letter in enumerate(word):
            places[letter] = places.get(letter, 0) | 1 << i
        end = 1 << len(word)
        whole = (end << 1) - 1
        first = [1]
        for _ in range(edits):  # a letter of the word that the term lacks
            first.append((first[-1] | first[-1] << 1) & whole)
        best: str | None = None
        stack = [(self.root, first)]
        while stack:
            node, states = stack.pop()
            term = node.get("term")
            if term is not None and len(term) >= EDIT_LETTERS and states[-1] & end and (best is None or term < best):
                best = term
            for letter, below in node.items():
                if len(letter) > 1:
                    continue
                here = places.get(letter, 0)
                after = [(states[0] & here) << 1]
                for e in range(1, edits + 1):
                    after.append((((states[e] & here) << 1) | states[e - 1] | (states[e - 1] << 1) | (after[e - 1] << 1)) & whole)
                if after[-1]:
                    stack.append((below, after))
        return None if best is None else Match(best, 1)


class Candidates:
    """Which words can match at all, by hashes: one edit leaves a word's first or last part whole."""

    def __init__(self, terms: list[str], stems: list[str]) -> None:
        heads, tails, whole = {}, {}, []
        for word in terms:
            raw = word.encode()
            whole.append(raw)
            if len(word) >= EDIT_LETTERS:
                half = len(raw) // 2
                heads.setdefault(half, []).append(raw[:half])
                tails.setdefault(len(raw) - half, []).append(raw[half:])
        for word in stems:
            raw = word.encode()
            heads.setdefault(len(raw), []).append(raw)
        self.heads = {n: self._hash(x) for n, x in heads.items()}
        self.tails = {n: self._hash(x) for n, x in tails.items()}
        self.whole = self._hash(whole)
        self.longest = max(map(len, whole), default=0) + 4

    @staticmethod
    def _hash(parts: list[bytes]) -> np.ndarray:
        if not parts:
            return np.zeros(0, np.uint64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        return np.unique(V.Hasher(data).ranges(np.concatenate(([0], ends[:-1])), ends))

    def mask(self, hasher: V.Hasher, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = np.isin(hasher.ranges(start, end), self.whole)
        for table, from_start in ((self.heads, True), (self.tails, False)):
            for n, known in table.items():
                fit = np.flatnonzero((size >= n) & (~out) & ((size <= self.longest) | from_start))
                a = start[fit] if from_start else end[fit] - n
                out[fit] = np.isin(hasher.ranges(a, a + n), known)
        return out


def clean_word(raw: str) -> str:
    return raw.strip(_EDGES).lower()


_EDGE_BYTES = np.zeros(256, dtype=bool)
_EDGE_BYTES[[b for c in _EDGES for b in c.encode() if len(c.encode()) == 1]] = True


def _trim(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges without ASCII punctuation at either edge."""
    start, end = start.copy(), end.copy()
    for _ in range(4):
        lead = (start < end) & _EDGE_BYTES[low[np.minimum(start, len(low) - 1)]]
        start[lead] += 1
        trail = (start < end) & _EDGE_BYTES[low[np.maximum(end - 1, 0)]]
        end[trail] -= 1
    return start, end


class Model(NamedTuple):
    terms: list[str]
    stems: list[str]
    trust: dict[tuple[str, int], float]


def context_score(words: list[str], at: int, hits: dict[int, float]) -> float:
    """The trust in the match at ``at``, after a look at the words around it."""
    trust = hits[at]
    lo, hi = max(0, at - CONTEXT), min(len(words), at + CONTEXT + 1)
    opened = any(w.startswith(_OPENING) for w in words[lo : at + 1])
    closed = any(w.rstrip(".,;:!?").endswith(_CLOSING) for w in words[at:hi])
    if (opened and closed) or any(clean_word(w) in REPORTING for w in words[lo:at]):
        return trust * QUOTED
    if any(k != at and lo <= k < hi for k in hits):
        return min(0.99, trust * COMPANY)
    return trust


def _scorer(model: Model):
    lexicon, candidates = Lexicon(model.terms, model.stems), Candidates(model.terms, model.stems)
    known: dict[str, Match | None] = {}

    def find(raw: str) -> Match | None:
        word = clean_word(raw)
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            known[word] = lexicon.find(word)
        return known[word]

    def scores(column) -> Iterator[tuple[int, int, list[float], list[int]]]:
        for first, last, data, offsets in V.text_blocks(column):
            low = V.LOWER[data]
            start, end, row = V.words(low, offsets)
            out, counts = [0.0] * (last - first), [0] * (last - first)
            if len(start):
                a, b = _trim(low, start, end)
                # letters beyond ASCII: upper case isn't folded in the bytes, so those words are looked up too
                wide = np.add.reduceat(np.append((low >= 0xC3) & (low < 0xE0), False).astype(np.int32), start) > 0
                possible = candidates.mask(V.Hasher(low), a, b) | (wide & (data[a.clip(max=len(low) - 1)] >= 0xC3))
                bounds = np.searchsorted(row, np.arange(last - first + 1))
                for r in np.unique(row[possible]).tolist():
                    lo, hi = int(bounds[r]), int(bounds[r + 1])
                    at = np.flatnonzero(possible[lo:hi])
                    raw = data[offsets[r] : offsets[r + 1]].tobytes()
                    base = int(offsets[r])
                    hits: dict[int, float] = {}
                    for k in at.tolist():
                        match = find(raw[start[lo + k] - base : end[lo + k] - base].decode("utf-8", "replace"))
                        trust = model.trust.get((match.term, match.kind), 0.0) if match is not None else 0.0
                        if trust:
                            hits[k] = trust
                    if hits:
                        near = {j for k in hits for j in range(max(0, k - CONTEXT), min(hi - lo, k + CONTEXT + 1))}
                        words = {j: raw[start[lo + j] - base : end[lo + j] - base].decode("utf-8", "replace") for j in near}
                        clear = 1.0
                        for k in hits:
                            window = range(max(0, k - CONTEXT), min(hi - lo, k + CONTEXT + 1))
                            clear *= 1.0 - context_score([words[j] for j in window], k - window[0], {j - window[0]: t for j, t in hits.items() if j in window})
                        out[r], counts[r] = 1.0 - clear, len(hits)
            yield first, last, out, counts

    return scores


def _without_copies(texts: DataFrame) -> DataFrame:
    """One of each class's near copies: else the words of an often copied text would pass for
    toxic.  A text stays if it has the least doc_id for each of three least hashes of its
    three-word runs."""
    split = texts.withColumn("w", F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))
    run = "xxhash64({0}, get(w, i), get(w, i + 1), get(w, i + 2))"
    for k in range(3):
        split = split.withColumn(f"m{k}", F.expr(f"array_min(transform(sequence(0, greatest(size(w) - 3, 0)), i -> {run.format(k)}))"))
    for k in range(3):
        split = split.withColumn(f"first{k}", F.min("doc_id").over(Window.partitionBy("toxic", f"m{k}")))
    return split.where(" and ".join(f"doc_id = first{k}" for k in range(3))).select("doc_id", "text", "toxic")


def _word_counts(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """word, toxic, clean: sampled training documents of each class that hold the word (or,
    with STEM behind it, a longer word that begins so)."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = usable.groupBy("toxic").agg(F.count("*").alias("of"))
    drawn = usable.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))).join(F.broadcast(sizes), "toxic").where(F.col("draw") * F.col("of") < F.lit(sample << 20))
    # two classes of about `sample` rows: small, whatever the tables
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn.select("doc_id", "toxic")), "doc_id")
    texts = _without_copies(cut(texts, "labelled"))
    edges = "[" + "".join("\\" + c for c in _EDGES) + "]+"
    tokens = F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, f"^{edges}|{edges}$", ""))
    tokens = F.array_distinct(tokens)
    stems = F.flatten(F.transform(tokens, lambda w: F.when(w.rlike(r"^\p{L}+$"), F.filter(F.array(*[F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit(STEM))) for n in STEM_LETTERS]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))))
    words = texts.select("toxic", F.explode(F.array_union(tokens, stems)).alias("word")).where("word <> ''")
    return cut(words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")), "words")


def _share(toxic, clean, weight: float):
    return toxic / (toxic + clean * weight)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and trust from labelled rows outside the held-out fold.

    Only the lexicon and the trust in each entry come to the driver: words that
    are significant in at most ``sample`` documents of each class.  Word counts
    stay distributed.
    """
    counts = _word_counts(docs, labels, sample)
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("toxic").agg(F.countDistinct("doc_id").alias("n"))
    sizes = {r["toxic"]: min(r["n"], sample) for r in usable.collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model([], [], {})
    weight = sizes[1] / sizes[0]  # clean documents count as if there were as many as toxic ones
    share = _share(F.col("toxic"), F.col("clean"), weight)
    base = sizes[1] / (sizes[0] + sizes[1])
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("toxic") + F.col("clean")) / p)).otherwise(F.lit(0.0))
    ratio = 2 * (part(F.col("toxic"), base) + part(F.col("clean"), 1 - base))

    def good(df: DataFrame) -> list[str]:
        return [r[0] for r in df.where((share >= PRECISION) & (ratio >= SIGNIFICANT)).orderBy(F.desc("toxic"), "word").collect()]

    letters = counts.where(F.col("word").rlike(r"^\p{L}+$"))
    forms = letters.where("toxic > 0").select(F.explode(F.array(*[F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit(STEM))) for n in STEM_LETTERS])).alias("word")).where("word is not null").groupBy("word").count().where(F.col("count") >= STEM_FORMS)
    stems = sorted(w[: -len(STEM)] for w in good(counts.where(F.col("word").rlike(r"^\p{L}+\*$")).join(forms, "word", "left_semi")))
    stems = [s for s in stems if not any(s != p and s.startswith(p) for p in stems)]
    terms = [w for w in good(letters) if not any(w.startswith(s) for s in stems)]

    lexicon = Lexicon(terms, stems)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.find(w) for w in batch.column(0).to_pylist()]
            keep = [i for i, m in enumerate(found) if m is not None]
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([found[i].term for i in keep], pa.string()), pa.array([found[i].kind for i in keep], pa.int32()), part.column(1), part.column(2)], names=["term", "kind", "toxic", "clean"])

    # a term's exact, misspelled and stem matches: three rows for each lexicon entry at most
    seen = counts.where(~F.col("word").endswith(STEM)).select("word", "toxic", "clean").mapInArrow(matched, "term string, kind int, toxic long, clean long").groupBy("term", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    trust = {}
    for r in seen.collect():
        t, c = r["toxic"], r["clean"] * weight
        sure = (t + 0.05) / (t + c + 0.1)
        trust[r["term"], r["kind"]] = sure if sure >= LEAST_TRUST else 0.0
    for term in terms:  # an edit never seen in training
        share_of = UNSEEN_LONG if len(term) >= LONG_LETTERS else UNSEEN
        trust.setdefault((term, 1), share_of * trust.get((term, 0), 0.5))
    return Model(terms, stems, trust)


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches of each row of ``docs``.

    A word that equals a lexicon term, lies one edit away from it or belongs to
    a toxic stem is a match, trusted as far as training allows; a match inside
    quotation marks or after a reporting word counts less, one beside another
    more.  score = 1 - product of (1 - trust); predicted: score >= 0.7.

    Null, empty and blank texts score 0; without labels of both classes all do.
    Whole texts are read.  Rows without doc_id are scored like others, repeated
    rows each give a row; other columns (labels too) never enter a score.
    """
    model = learn(docs, labels) if model is None else model
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in batches:
            for first, last, found, counts in scores(batch.column(2)):
                n = last - first
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(found, pa.float64()), pa.array([int(x >= PREDICT) for x in found], pa.int32()), pa.array(counts, pa.int32())], names=["doc_id", "held_out", "score", "predicted", "n_matches"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, n_matches int")
