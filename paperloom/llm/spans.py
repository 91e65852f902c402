"""Substring dedup: runs of consecutive sentences, and passages of any words, that repeat anywhere in the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import vectext as V
from paperloom.llm.common import cut, small_batches
from paperloom.llm.search import _filter_words, _known

#: Sentences of a run at least, and words of it at least (a run grows until it has both).
RUN_SENTENCES = 3
RUN_WORDS = 20
#: Words of a passage that is found wherever in a sentence it starts and ends, and of its grams.
#: The least gram of a passage is the same in all its copies, so only passages are hashed
#: one by one whose least gram occurs in units that differ.
PASSAGE, GRAM = 51, 26
#: Mixes a doc_id into a hash.
_MULTIPLIER = 0x9E3779B97F4A7C15

_Q = (0xF1357AEA2E62A9C5, 0x9FB21C651E98DF25)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_RUNS = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("first_here", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("sentence", pa.int32()), ("sentences", pa.int32()), ("word", pa.int32()), ("words", pa.int32())])
_COLUMNS = "doc_id long, h1 long, h2 int, first_here boolean, start int, end int, sentence int, sentences int, word int, words int"


def sentences(low: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Index of the first word of every sentence.  A sentence ends with a word that ends
    in . ! or ?, before a line break, or with its row."""
    breaks = np.concatenate(([0], np.cumsum(low == 10)))
    closes = np.ones(len(start), dtype=bool)
    closes[:-1] = _ENDS[low[end[:-1] - 1]] | (breaks[start[1:]] > breaks[end[:-1]]) | (row[1:] != row[:-1])
    return np.concatenate(([0], np.flatnonzero(closes)[:-1] + 1)) if len(start) else np.zeros(0, np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _sums(tokens: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * _powers(_Q[which], len(tokens))[:-1], out=sums[1:])
    return sums, _powers(pow(_Q[which], -1, 1 << 64), len(tokens))


def _units(tokens: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges of the units of all rows, and the least gram of each.

    A passage is PASSAGE words inside a row.  Consecutive passages with the same
    least gram (the first of equal ones, so no unit holds a passage twice) form a unit: so many words that two rows share a unit inside
    whatever longer text they share, and only its ends are units of their own.
    """
    if len(tokens) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums, back = _sums(tokens, 0)
    least = at_start = V.mix64((sums[GRAM:] - sums[:-GRAM]) * back[: len(tokens) - GRAM + 1])
    grams, width = PASSAGE - GRAM + 1, 1
    while width < grams:
        step = min(width, grams - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    at = np.flatnonzero(row[: len(least)] == row[PASSAGE - 1 :])
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    least = least[at]
    left = at_start[at] == least  # the next passage doesn't hold this gram
    heads = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | left[:-1])))
    return at[heads], at[np.concatenate((heads[1:], [len(at)])) - 1] + PASSAGE, least[heads]


class Block:
    """The words and sentences of some rows, and hashes of any range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        low = V.LOWER[data]
        self.offsets = offsets
        self.start, self.end, self.row = V.words(low, offsets)
        if len(self.start):
            self.tokens = V.word_hashes(low, self.start, self.end)
            self.heads = sentences(low, self.start, self.end, self.row)
            self.tails = np.concatenate((self.heads[1:], [len(self.start)]))  # word after the sentence
            self.owner = self.row[self.heads]

    def sentence_runs(self, run_sentences: int, run_words: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.heads)
        last = np.arange(n) + run_sentences - 1
        grown = np.searchsorted(self.tails, self.heads + run_words)  # the first sentence with which the run has enough words
        last = np.maximum(last, grown)
        fits = last < n
        fits[fits] = self.owner[last[fits]] == self.owner[fits]
        at = np.flatnonzero(fits)
        return self.heads[at], self.tails[last[at]]

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _units(self.tokens, self.row)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the words a to b, as 64 and 32."""
        out = []
        for which in (0, 1):
            sums, back = _sums(self.tokens, which)
            out.append(V.mix64((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        return out[0], (out[1] >> np.uint64(33)).astype(np.int32)

    def places(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Start byte, end byte, number of the first sentence, sentences, number of the first word, words."""
        mine = self.row[a]
        head, tail = (np.searchsorted(self.heads, x, side="right") - 1 for x in (a, b - 1))
        begins = self.offsets[mine]
        return [self.start[a] - begins, self.end[b - 1] - begins, head - np.searchsorted(self.owner, mine), tail - head + 1, a - np.searchsorted(self.row, mine), b - a]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, np.ndarray]]:
    """Blocks of rows that have words, with the doc_id of every row."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, last, data, offsets in V.text_blocks(batch.column(1)):
            block = Block(data, offsets)
            if len(block.start):
                yield block, ids[first:last]


def _fresh(h1: np.ndarray, row: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Which ranges (from word a) are the first of their hash in their row."""
    out = np.ones(len(a), dtype=bool)
    order = np.lexsort((a, h1, row))
    out[order[1:]] = (h1[order][1:] != h1[order][:-1]) | (row[order][1:] != row[order][:-1])
    return out


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, unit): the least gram and the hash of each unit."""
    for block, _ in blocks(batches):
        a, b, least = block.units()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(block.hashes(a, b)[0].view(np.int64))], names=["term", "unit"])


def _with_doc(h1: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A term of the filter: a unit in a document."""
    return h1 ^ (ids.view(np.uint64) * np.uint64(_MULTIPLIER))


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h1, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(_with_doc(h1.view(np.uint64), ids).view(np.int64))], names=["term"])


def _hash_rows(batches: Iterator[pa.RecordBatch], grams: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id, edge) of all sentence runs, and of all units if there are ``grams``;
    edge: the unit's least gram is one of them."""
    for block, ids in blocks(batches):
        a, b = block.sentence_runs(RUN_SENTENCES, RUN_WORDS)
        edge = np.zeros(len(a), dtype=bool)
        if grams is not None:
            more_a, more_b, least = block.units()
            a, b, edge = np.concatenate((a, more_a)), np.concatenate((b, more_b)), np.concatenate((edge, _known(grams, least)))
        h1, h2 = block.hashes(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2), pa.array(ids[block.row[a]]), pa.array(edge)], names=["h1", "h2", "doc_id", "edge"])


def _run_rows(batches: Iterator[pa.RecordBatch], repeated: np.ndarray, units: bool) -> Iterator[pa.RecordBatch]:
    """The runs (and units) whose hash is in the filter, with their places."""
    for block, ids in blocks(batches):
        a, b = block.sentence_runs(RUN_SENTENCES, RUN_WORDS)
        n = len(a)
        if units:
            more_a, more_b, _ = block.units()
            a, b = np.concatenate((a, more_a)), np.concatenate((b, more_b))
        h1, h2 = block.hashes(a, b)
        row = block.row[a]
        fresh = np.concatenate([_fresh(h1[part], row[part], a[part]) for part in (slice(n), slice(n, None))])
        keep = np.flatnonzero(_known(repeated, h1))
        columns = [ids[row], h1.view(np.int64), h2, fresh, *[x.astype(np.int32) for x in block.places(a, b)]]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], schema=_RUNS)


def _passage_rows(batches: Iterator[pa.RecordBatch], grams: np.ndarray, firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every passage of the units that are first of their kind and have another kind's least gram."""
    for block, ids in blocks(batches):
        a, b, least = block.units()
        h1, _ = block.hashes(a, b)
        keep = _known(grams, least) & _known(firsts, _with_doc(h1, ids[block.row[a]]))
        a, size = a[keep], (b - a)[keep] - PASSAGE + 1
        if not len(a):
            continue
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        h1, h2 = block.hashes(at, at + PASSAGE)
        row = block.row[at]
        columns = [ids[row], h1.view(np.int64), h2, _fresh(h1, row, at), *[x.astype(np.int32) for x in block.places(at, at + PASSAGE)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_RUNS)


def repeated_spans(docs: DataFrame, passages: bool = False, within: bool = True) -> DataFrame:
    """The spans to remove: doc_id, span_start, span_end (bytes of the UTF-8 text),
    first_sentence, n_sentences, source_doc_id.

    A run is three or more consecutive sentences of twenty or more words (words
    split at white space, A-Z lower-cased; white space doesn't matter).  A run's
    first occurrence, by doc_id and then position, stays; every other one is
    removed.  ``within`` false leaves alone what repeats in one document only:
    a run goes if a smaller doc_id has it.  With ``passages`` the same holds for
    every passage of more than fifty words, wherever it starts and ends; the
    registered query asks for them.  Where occurrences overlap (a line over and
    over), the later ones go as a whole.  Overlapping and touching
    runs of a document are joined into one span; source_doc_id is the least id
    that any of them occurs in first, and n_sentences counts those it cuts into.

    Passages are compared by units (:func:`_units`): a unit that a smaller id or
    the document itself has before is a copy as a whole.  Passages one by one are compared only where different
    units share a least gram, and there only those of the first document of each
    unit, so a text of many copies is spelled out once.

    Rows of the same doc_id count as one document's: none is the other's copy.
    Rows without doc_id, null, blank and short texts give no spans.  A document
    is at most 2 GB.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    send = lambda terms: spark.sparkContext.broadcast(_filter_words(terms))  # noqa: E731  a fixed size; lets false ones through and loses none
    grams = None
    if passages:
        grams = send(usable.mapInArrow(_gram_rows, "term long, unit long").groupBy("term").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi")).where("lo <> hi").select("term"))
    hashed = usable.mapInArrow(lambda batches: _hash_rows(batches, grams and grams.value), "h1 long, h2 int, doc_id long, edge boolean")
    seen = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("source_doc_id"), (F.count("*") > 1 if within else F.min("doc_id") < F.max("doc_id")).alias("again"), F.max("edge").alias("edge"))
    seen = cut(seen.where("again or edge"), "repeats")  # with an exchange of its own, the join can split the rows of a hot run
    repeated = send(seen.where("again").select(F.col("h1").alias("term")))
    rows = usable.mapInArrow(lambda batches: _run_rows(batches, repeated.value, passages), _COLUMNS)
    copied = "doc_id <> source_doc_id or not first_here" if within else "doc_id <> source_doc_id"
    again = rows.join(seen.where("again").select("h1", "h2", "source_doc_id"), ["h1", "h2"]).where(copied)
    if passages:
        firsts = send(seen.where("edge").select("h1", "source_doc_id").mapInArrow(_first_rows, "term long"))
        spelled = cut(usable.mapInArrow(lambda batches: _passage_rows(batches, grams.value, firsts.value), _COLUMNS), "passages")
        twice = F.min("doc_id") < F.max("doc_id")
        others = spelled.groupBy("h1", "h2").agg(F.min("doc_id").alias("source_doc_id"), (twice | ~F.min("first_here") if within else twice).alias("_again")).where("_again").drop("_again")
        others = cut(others, "shared")
        again = again.unionByName(spelled.join(others, ["h1", "h2"]).where(copied))
    runs_out = again.select("doc_id", "start", "end", "sentence", (F.col("sentence") + F.col("sentences")).alias("after"), "word", (F.col("word") + F.col("words")).alias("last"), "source_doc_id")
    in_order = Window.partitionBy("doc_id").orderBy("word", "last")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    opened = runs_out.withColumn("opens", (F.col("word") > F.coalesce(F.max("last").over(earlier), F.lit(-1))).cast("int"))
    numbered = opened.withColumn("span", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("doc_id", "span").agg(F.min("start").alias("span_start"), F.max("end").alias("span_end"), F.min("sentence").alias("first_sentence"), F.max("after").alias("after"), F.min("source_doc_id").alias("source_doc_id"))
    return spans.select("doc_id", "span_start", "span_end", "first_sentence", (F.col("after") - F.col("first_sentence")).alias("n_sentences"), "source_doc_id")


def remove_repeats(docs: DataFrame, passages: bool = False, within: bool = True) -> DataFrame:
    """``docs`` with the repeated spans cut out of their texts (n_chars follows, if there)."""
    spans = repeated_spans(docs, passages, within).groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("cuts"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"))  # columns may have any name
    joined = packed.join(spans, "id", "left").withColumn("old", F.col("row.text"))
    raw = F.encode("old", "UTF-8")
    begins = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["span_end"]))
    ends = F.concat(F.transform("cuts", lambda c: c["span_start"]), F.array(F.octet_length("old")))
    pieces = F.zip_with(begins, ends, lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8"))
    whole = F.col("cuts").isNull()
    out = joined.withColumn("text", F.when(whole, F.col("old")).otherwise(F.array_join(pieces, "")))
    chosen = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        chosen["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[chosen.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
