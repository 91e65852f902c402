"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut, held_out, small_batches

#: Most frequent n-grams of a profile, and of a document.
PROFILE = 300
#: Labelled documents of a language that its profile is learned from, about.
SAMPLE = 2000
UNKNOWN = "und"
_BITS = 21
#: Characters of a text that are taken apart at once.
SLICE = 1 << 20

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of at most SLICE characters, cut behind white space where there is any."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):
            space = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = space + 1 if space >= at else end
        yield text[at:end]
        at = end


def _grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams that end in each piece of the text; two codes are carried over."""
    held = np.ones(1, np.int64)  # a word's edge
    left = len(text)
    for piece in _pieces(text):
        left -= len(piece)
        points = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_is_letter()[points], points.astype(np.int64) + 2, 1)
        if not left:
            codes = np.append(codes, 1)
        before = np.concatenate((held[-1:], codes[:-1]))
        codes = codes[(codes != 1) | (before != 1)]  # one edge between words
        if not len(codes):
            continue
        joined = np.concatenate((held, codes))
        first = len(held)
        two = joined[first - 1 : -1] | codes << _BITS
        one = codes[codes != 1]
        ends = codes if first > 1 else codes[1:]
        three = joined[: len(ends)] | joined[1 : len(ends) + 1] << _BITS | ends << 2 * _BITS
        yield np.concatenate((one, two, three[joined[1 : len(ends) + 1] != 1]))
        held = joined[-2:]


def ngrams(text: str | None) -> np.ndarray:
    """All letter n-grams of one to three characters, packed; 1 marks a word's edge."""
    return np.concatenate([*_grams(text or ""), np.zeros(0, np.int64)])


def ranked(text: str | None, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first (ties: by packed value).

    A long text is counted in slices: memory follows its distinct n-grams.
    """
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in _grams(text or ""):
        part.sort()
        heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        keys, times = part[heads], np.diff(heads, append=len(part))
        if len(grams):
            grams, at = np.unique(np.concatenate((grams, keys)), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate((counts, times)), minlength=len(grams)).astype(np.int64)
        else:
            grams, counts = keys, times
    if len(grams) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.argsort(-counts, kind="stable")[:most]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.setdefault(lang, []).append(ngrams(text))
        for lang, parts in texts.items():
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, sample: int = SAMPLE, most: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each non-null ``lang``, from rows outside the held-out fold.

    About ``sample`` documents of each language are read, chosen by a hash of
    the id; n-gram counts are summed over the cluster and only the ``most``
    frequent of each language come to the driver.
    """
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("draw"))
    # a row for each language, in a file: the planner sees its size, and no text is shuffled
    sizes = cut(labelled.groupBy("lang").agg(F.count("*").alias("of")), "languages")
    drawn = labelled.join(sizes, "lang").where(F.col("draw") * F.col("of") < F.lit(sample << 20)).select("lang", "text")
    grams = drawn.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = grams.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= most)
    found: dict[str, list] = {}
    for row in best.orderBy("lang", "r").collect():
        found.setdefault(row["lang"], []).append(row["gram"])
    return {lang: np.array(keys, np.int64) for lang, keys in found.items()}


class Scorer:
    """Out-of-place distances of a document to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], most: int = PROFILE) -> None:
        self.langs, self.most = sorted(profiles), most
        self.keys = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.places = np.full((len(self.langs), len(self.keys) + 1), -1, np.int64)  # the last column: in no profile
        for k, lang in enumerate(self.langs):
            self.places[k, np.searchsorted(self.keys, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ranked(text, self.most)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        at = np.where(self.keys[at] == grams, at, len(self.keys))
        there = self.places[:, at]
        apart = np.where(there < 0, self.most, np.abs(there - np.arange(len(grams))))
        distance = apart.sum(axis=1) / (self.most * len(grams))
        order = np.argsort(distance, kind="stable")
        best = float(distance[order[0]])
        second = float(distance[order[1]]) if len(order) > 1 else 1.0
        return self.langs[order[0]], (second - best) / second if second else 0.0


def identify(docs: DataFrame, profiles: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs``.

    The document's most frequent n-grams are compared with each profile: a gram
    costs the difference of its ranks, one that the profile lacks costs the
    most.  The nearest profile wins (ties: the first name); score is its lead
    over the second, as a share of the second's distance.

    ``und`` with score 0 if the text is null or holds no letter, or nothing
    could be learned.  Whole texts are read.  Rows without doc_id are predicted
    like others; repeated rows each give a row; other columns are ignored.
    """
    profiles = learn_profiles(docs) if profiles is None else profiles
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(profiles)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``docs`` without the rows whose language can't be told (``und``)."""
    profiles = learn_profiles(docs) if profiles is None else profiles
    small_batches(docs.sparkSession)
    names = docs.columns

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(profiles)
        for batch in batches:
            yield batch.filter(pa.array([scorer.predict(t.as_py())[0] != UNKNOWN for t in batch.column(names.index("text"))], pa.bool_()))

    return docs.mapInArrow(known, docs.schema)
