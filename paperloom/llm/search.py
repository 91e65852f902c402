"""Exact top-k BM25 search: an inverted index for each shard, bounds from greatest impacts, exact merge.

A shard is some megabytes of text of one kind (a language, say).  Documents of
equal words form a block of the index; a block's bound is the sum of its impacts
in single precision, for a pack of queries at once: as a product of matrices for
words that many of their pairs have, posting by posting for the others.  The
bounds of all shards of a group come first; what they leave is scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import vectext as V
from paperloom.llm.common import cut, small_batches

K1, B = 1.2, 0.75
TOP = 10
#: Bytes of text and documents of a shard, at most (one longer text is a shard of its own).
SHARD_BYTES, SHARD_DOCS = 16 << 20, 60_000
#: Bytes of index that a task holds, about; and queries that meet the index at a time.
GROUP_BYTES, QUERY_BLOCK = 96 << 20, 20_000
#: Queries that travel as one row, in which their numbers are 16-bit words.
PACK = 1000
#: Share of the pairs of a query and a block that have a word, from which the word's impacts are a row of the
#: matrix; and postings of the other words that are added at a time.
DENSE, POSTINGS = 0.005, 1 << 17
#: What single precision may take off a bound.
SLACK = 1e-4
TINY = np.finfo(np.float32).tiny
#: Kinds of documents (of one language, say) that have shards and packs of their own, the commonest words that tell
#: them apart, and the queries that they are learned from, about.  They decide nothing but the cost.
KINDS, KIND_WORDS, KIND_SAMPLE = 6, 512, 2000
#: Bits of the filter of query terms that thins postings (16 MB).
FILTER_BITS = 1 << 27


def _term_counts(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows: (first, last, term hash, row, times, words of the row)."""
    for first, last, data, offsets in V.text_blocks(column):
        low = V.LOWER[data]
        start, end, row = V.words(low, offsets)
        rows = last - first
        lengths = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
        if not len(start):
            yield first, last, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), lengths
            continue
        h = V.word_hashes(low, start, end)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a > 1:
                h[a:b].sort()
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(fresh)
        yield first, last, h[at], row[at], np.diff(np.concatenate((at, [len(h)]))), lengths


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents, words): document frequencies, summed over blocks; term 0 with the totals."""
    total_docs, total_words = 0, 0
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        terms, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(np.zeros(len(terms), np.int64))], names=["term", "df", "words"])

    for batch in batches:
        for _, _, terms, _, _, lengths in _term_counts(batch.column(0)):
            total_docs += int((lengths > 0).sum())
            total_words += int(lengths.sum())
            held.append(terms)
            size += len(terms)
            if size > 4_000_000:
                yield flush()
                size = 0
    if held:
        yield flush()
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total_docs], pa.int64()), pa.array([total_words], pa.int64())], names=["term", "df", "words"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, term, tf, length) of each term of each row."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, _, terms, row, times, lengths in _term_counts(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(ids[first + row].astype(np.int64)), pa.array(terms.view(np.int64)), pa.array(times.astype(np.int32)), pa.array(lengths[row].astype(np.int32))], names=["id", "term", "tf", "length"])


def _filter_words(terms: DataFrame) -> np.ndarray:
    """A filter of terms, two bits each, of a fixed size; built on the executors."""
    bits = terms.select(F.explode(F.array(F.expr(f"term & {FILTER_BITS - 1}"), F.expr(f"shiftrightunsigned(term, 32) & {FILTER_BITS - 1}"))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 5).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 as int)))").alias("mask"))
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy().astype(np.uint32)
    return out


def _known(words: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Which terms the filter lets through."""
    keep = np.ones(len(terms), dtype=bool)
    for shift in (0, 32):
        g = (terms >> np.uint64(shift)) % np.uint64(FILTER_BITS)
        keep &= (words[(g >> np.uint64(5)).astype(np.int64)] >> (g & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return keep


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, start[1] .. and so on."""
    if not len(count):
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(ends[-1]) + np.repeat(start - ends + count, count)


class ShardIndex:
    """Postings lists of one shard.

    ``members`` of a block are the documents that share its words, the least
    ids first; ``repeats`` counts the ids that more than one block has.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> None:
        ids, place = np.unique(doc, return_inverse=True)
        order = np.lexsort((-impact, place, term))
        if len(order):
            order = order[np.concatenate(([True], (term[order][1:] != term[order][:-1]) | (place[order][1:] != place[order][:-1])))]
        terms, counts = np.unique(term[order], return_counts=True)
        self._set(terms, counts, place[order], impact[order], ids, np.arange(len(ids) + 1))

    @classmethod
    def load(cls, row: dict, mean: float) -> ShardIndex:
        """From a row that :func:`_shard` made."""
        terms, counts, block, times, many, more, lengths, members, edges = (np.frombuffer(row[c], t) for c, t in _SHARD_ARRAYS.items())
        tf = times.astype(np.float64)
        tf[many] = more
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[block] / mean))
        out = cls.__new__(cls)
        out._set(terms, counts.astype(np.int64), block.astype(np.int64), impact, members, edges.astype(np.int64))
        return out

    def _set(self, terms: np.ndarray, counts: np.ndarray, place: np.ndarray, impact: np.ndarray, members: np.ndarray, edges: np.ndarray) -> None:
        self.terms, self.counts, self.place = terms, counts, place.astype(np.int32)
        self.members, self.edges = members, edges
        self.blocks = len(edges) - 1
        self.repeats = len(members) - len(np.unique(members))
        self.first = np.cumsum(counts) - counts
        self.rough = impact.astype(np.float32)  # for bounds
        # the same postings by block, in the order of terms
        order = np.argsort(place.astype(np.uint16) if self.blocks <= 1 << 16 else place, kind="stable")
        self.block_term = np.repeat(np.arange(len(terms), dtype=np.int32), counts)[order]
        self.block_impact = impact[order]
        self.block_first = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=self.blocks))))
        self.weight, self.asked = np.zeros(len(terms)), np.zeros(len(terms), bool)  # of the query at work

    def find(self, known: np.ndarray) -> None:
        """Note the place in this index, or -1, of each of the terms that the packs number."""
        self.at = np.full(len(known), -1, np.int32)
        place = np.searchsorted(known, self.terms)
        there = np.flatnonzero(place < len(known))
        there = there[known[place[there]] == self.terms[there]]
        self.at[place[there]] = there

    def scores(self, blocks: np.ndarray) -> np.ndarray:
        """The exact scores of blocks for the query that asks; weights add up in the order of the terms."""
        first, last = self.block_first[blocks], self.block_first[blocks + 1]
        terms = np.concatenate([self.block_term[a:b] for a, b in zip(first.tolist(), last.tolist())])
        at = np.flatnonzero(self.asked[terms])
        ends = np.cumsum(last - first)
        block = np.searchsorted(ends, at, side="right")
        impact = self.block_impact[at + (last - ends)[block]]
        return np.bincount(block, weights=self.weight[terms[at]] * impact, minlength=len(blocks))


class Pack:
    """Some queries: each term once, in order, and the terms of every query in order."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, asked: np.ndarray, member: np.ndarray) -> None:
        self.ids, self.terms, self.weights = ids, terms, weights
        self.asked = asked.astype(np.int64)
        order = np.argsort(member, kind="stable")  # terms stay in order
        self.term = np.repeat(np.arange(len(terms), dtype=np.int32), self.asked)[order]
        self.query = member[order]
        self.edges = np.concatenate(([0], np.cumsum(np.bincount(member, minlength=len(ids)))))
        self.number(terms)

    def number(self, known: np.ndarray) -> None:
        """Number the terms by their places among all that are known."""
        self.numbers = np.searchsorted(known, self.terms).astype(np.int32)

    @classmethod
    def load(cls, row: dict) -> Pack:
        """From a row that :func:`_packed` made."""
        return cls(*(np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("terms", np.uint64), ("weights", np.float64), ("asked", np.uint32), ("members", np.uint16))))


class Best:
    """The k best (score, id) of each query of a pack so far; an id counts once."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores, self.ids = np.zeros((queries, k)), np.zeros((queries, k), np.int64)
        self.have = np.zeros(queries, np.int64)

    def floors(self) -> np.ndarray:
        return np.where(self.have == self.k, self.scores[:, -1], 0.0)

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        mine = np.unique(query)
        there = np.arange(self.k) < self.have[mine][:, None]
        q = np.concatenate((np.repeat(mine, self.have[mine]), query))
        s, d = np.concatenate((self.scores[mine][there], scores)), np.concatenate((self.ids[mine][there], ids))
        order = np.lexsort((-s, d, q))
        order = order[np.concatenate(([True], (q[order][1:] != q[order][:-1]) | (d[order][1:] != d[order][:-1])))[: len(order)]]  # the best score of each id
        q, s, d = q[order], s[order], d[order]
        order = np.lexsort((d, -s, q))
        q, s, d = q[order], s[order], d[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.scores[q[keep], rank[keep]], self.ids[q[keep], rank[keep]] = s[keep], d[keep]
        self.have[mine] = np.bincount(np.searchsorted(mine, q[keep]), minlength=len(mine))


def _bounds(index: ShardIndex, pack: Pack) -> np.ndarray:
    """The score of every block for every query, in single precision."""
    at = index.at[pack.numbers]
    queries, blocks = len(pack.ids), index.blocks
    counts = np.where(at >= 0, index.counts[at], 0)
    wide = np.flatnonzero(pack.asked * counts > DENSE * queries * blocks)
    use = (counts > 0).astype(np.uint8)
    use[wide] = 2
    row = np.zeros(len(at), np.int32)
    row[wide] = np.arange(len(wide))
    mine = use[pack.term]
    common, rare = np.flatnonzero(mine == 2), np.flatnonzero(mine == 1)
    terms = pack.term[common]
    left = np.zeros((queries, len(wide)), np.float32)
    left[pack.query[common], row[terms]] = pack.weights[terms]
    right = np.zeros((len(wide), blocks), np.float32)
    postings = _ranges(index.first[at[wide]], counts[wide])
    right[np.repeat(np.arange(len(wide)), counts[wide]), index.place[postings]] = index.rough[postings]
    out = left @ right
    flat = out.reshape(-1)
    terms, query = pack.term[rare], pack.query[rare]
    many, first, weights = counts[terms], index.first[at[terms]], pack.weights[terms].astype(np.float32)
    ends = np.cumsum(many)
    a = 0
    while a < len(rare):  # some postings at a time
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POSTINGS)))
        n = many[a:b]
        postings = _ranges(first[a:b], n)
        cells = index.place[postings] + np.repeat(query[a:b].astype(np.int64) * blocks, n)
        np.add.at(flat, cells, index.rough[postings] * np.repeat(weights[a:b], n))
        a = b
    return out


def candidates(index: ShardIndex, pack: Pack, rough: Best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, block, bound) of the blocks of a shard that may hold a result; ``rough`` keeps
    the least that the best known so far score."""
    if not index.blocks or not len(pack.terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    bounds = _bounds(index, pack)
    least = rough.floors()
    far = rough.k + index.repeats  # so many blocks hold k different ids
    new = np.flatnonzero(least == 0.0)
    if index.blocks > far and len(new):
        least[new] = np.partition(bounds[new], index.blocks - far, axis=1)[:, index.blocks - far] * (1 - SLACK)
    query, block = np.divmod(np.flatnonzero(bounds >= np.maximum(least * (1 - SLACK), TINY).astype(np.float32)[:, None]), index.blocks)
    bound = bounds[query, block]
    if len(query):
        many = index.edges[block + 1] - index.edges[block]
        rough.add(np.repeat(query, many), np.repeat(bound * (1 - SLACK), many), index.members[_ranges(index.edges[block], many)])
    keep = bound >= rough.floors()[query] * (1 - SLACK)
    return query[keep], block[keep], bound[keep]


def exact(index: ShardIndex, pack: Pack, query: np.ndarray, block: np.ndarray, best: Best) -> None:
    """Score blocks (for queries in order) exactly."""
    if not len(query):
        return
    at = index.at[pack.numbers]
    starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    found = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(query)]):
        terms = pack.term[pack.edges[query[a]] : pack.edges[query[a] + 1]]
        terms = terms[at[terms] >= 0]
        index.weight[at[terms]], index.asked[at[terms]] = pack.weights[terms], True
        found.append(index.scores(block[a:b]))
        index.asked[at[terms]] = False
    many = index.edges[block + 1] - index.edges[block]
    best.add(np.repeat(query, many), np.repeat(np.concatenate(found), many), index.members[_ranges(index.edges[block], many)])


def wand(index: ShardIndex, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The k documents of greatest score (ties: least id) for one query, best first."""
    order = np.argsort(terms)
    terms, weights = terms[order], weights[order]
    pack, best = Pack(np.zeros(1, np.int64), terms, weights, np.ones(len(terms)), np.zeros(len(terms), np.int64)), Best(1, k)
    index.find(pack.terms)
    query, block, _ = candidates(index, pack, Best(1, k))
    exact(index, pack, query, block, best)
    n = best.have[0]
    return list(zip(best.scores[0, :n].tolist(), best.ids[0, :n].tolist()))


#: Arrays of a shard's row: terms, postings of each; of each posting the block and the times the
#: word occurs (255: see many and more); words of each block, its ids and where they begin.
_SHARD_ARRAYS = {"terms": np.uint64, "counts": np.uint32, "block": np.uint16, "times": np.uint8, "many": np.uint32, "more": np.uint32, "lengths": np.uint32, "members": np.int64, "edges": np.uint32}
_SHARD = pa.schema([("shard", pa.int64()), ("bytes", pa.int64()), *[(c, pa.binary()) for c in _SHARD_ARRAYS]])


def _shard(number: int, ids: np.ndarray, terms: np.ndarray, row: np.ndarray, times: np.ndarray, lengths: np.ndarray, k: int) -> pa.RecordBatch:
    """One shard as a row.  Documents of equal words (a 128-bit sum of their hashes) are one block,
    of which the k least ids can be results."""
    sums = []
    for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        marks = np.concatenate((np.zeros(1, np.uint64), np.cumsum(V.mix64(terms * np.uint64(salt) + times.astype(np.uint64)))))
        sums.append(marks)
    edges = np.searchsorted(row, np.arange(len(ids) + 1))
    a, b = (m[edges[1:]] - m[edges[:-1]] for m in sums)
    full = np.flatnonzero(edges[1:] > edges[:-1])
    full = full[np.lexsort((ids[full], lengths[full], b[full], a[full]))]
    fresh = np.ones(len(full), dtype=bool)
    fresh[1:] = (a[full][1:] != a[full][:-1]) | (b[full][1:] != b[full][:-1]) | (lengths[full][1:] != lengths[full][:-1])
    block = np.full(len(ids), -1)
    heads = full[fresh]
    block[heads] = np.arange(len(heads))
    of = np.cumsum(fresh) - 1
    distinct = np.concatenate(([True], (of[1:] != of[:-1]) | (ids[full][1:] != ids[full][:-1]))) if len(full) else np.zeros(0, bool)
    of, members = of[distinct], ids[full][distinct]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    of, members = of[place < k], members[place < k]
    keep = np.flatnonzero(block[row] >= 0)
    keep = keep[np.argsort(terms[keep], kind="stable")]
    found, counts = np.unique(terms[keep], return_counts=True)
    times = times[keep]
    many = np.flatnonzero(times >= 255)
    values = [found, counts, block[row[keep]], np.minimum(times, 255), many, times[many], lengths[heads], members, np.searchsorted(of, np.arange(len(heads) + 1))]
    raw = [v.astype(t).tobytes() for v, t in zip(values, _SHARD_ARRAYS.values())]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sum(map(len, raw))], pa.int64()), *[pa.array([x], pa.binary()) for x in raw]], schema=_SHARD)


def _learn_kinds(query: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in order, and the centre of each kind over them: k-means on the words that texts have."""
    known, row = np.unique(query, return_inverse=True)
    words, column = np.unique(term, return_inverse=True)
    if len(known) < KINDS:
        return words, np.zeros((1, len(words)), np.float32)
    x = np.zeros((len(known), len(words)), np.float32)
    x[row, column] = 1
    x /= np.sqrt(x.sum(axis=1, keepdims=True))
    rng = np.random.default_rng(5)
    centres = x[:1]
    while len(centres) < KINDS:  # far from those so far
        away = np.maximum(1 - (x @ centres.T).max(axis=1), 0) ** 2 + 1e-9
        centres = np.concatenate((centres, x[rng.choice(len(x), 1, p=away / away.sum())]))
    for _ in range(10):
        kind = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[kind == n].sum(axis=0) for n in range(KINDS)])
        centres = sums / np.maximum(np.sqrt((sums**2).sum(axis=1, keepdims=True)), 1e-9)
    return words, centres.astype(np.float32)


def _kind(kinds: tuple[np.ndarray, np.ndarray], terms: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    words, centres = kinds
    out = np.zeros((rows, len(centres)))
    if len(words):
        at = np.minimum(np.searchsorted(words, terms), len(words) - 1)
        there = np.flatnonzero(words[at] == terms)
        for n, centre in enumerate(centres):
            out[:, n] = np.bincount(row[there], weights=centre[at[there]], minlength=rows)
    return out.argmax(axis=1)


def _shards(batches: Iterator[pa.RecordBatch], words: np.ndarray, k: int, most: int, kinds: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The shards of a task's documents, each of one kind; ``most`` bytes of text about are held at a
    time.  Only terms in the filter are kept."""
    number = TaskContext.get().partitionId() << 32
    held: list[list[tuple]] = [[] for _ in kinds[1]]
    size, docs = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)

    def flush(kind: int) -> pa.RecordBatch:
        nonlocal number
        some = held[kind]
        starts = np.concatenate(([0], np.cumsum([len(x[0]) for x in some])))
        ids, terms, row, times, lengths = ([x[n] for x in some] for n in range(5))
        out = _shard(number, np.concatenate(ids), np.concatenate(terms), np.concatenate([r + s for r, s in zip(row, starts)]), np.concatenate(times), np.concatenate(lengths), k)
        held[kind], size[kind], docs[kind], number = [], 0, 0, number + 1
        return out

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = batch.column(1)
        for first, last, terms, row, times, lengths in _term_counts(texts):
            bytes_here = int(lengths.sum()) * 6
            while size.any() and (size.sum() + bytes_here > most or docs.max() + last - first > SHARD_DOCS):
                yield flush(int(size.argmax() if docs.max() + last - first <= SHARD_DOCS else docs.argmax()))
            kind = _kind(kinds, terms, row, last - first)
            keep = np.flatnonzero(_known(words, terms))
            of = kind[row[keep]]
            for n in np.unique(kind).tolist():
                mine, rows = keep[of == n], np.flatnonzero(kind == n)
                place = np.cumsum(kind == n) - 1
                held[n].append((ids[first:last][rows], terms[mine], place[row[mine]].astype(np.int32), times[mine].astype(np.int32), lengths[rows]))
                size[n], docs[n] = size[n] + int(lengths[rows].sum()) * 6, docs[n] + len(rows)
    for n in range(len(held)):
        if held[n]:
            yield flush(n)


_PACK = pa.schema([("pack", pa.int32()), ("ids", pa.binary()), ("terms", pa.binary()), ("weights", pa.binary()), ("asked", pa.binary()), ("members", pa.binary())])


def _packed(table: pa.Table) -> pa.Table:
    """The queries of one pack as one row: each term once, with the queries that ask for it."""
    ids, terms, weights = (table.column(c).to_numpy() for c in ("query_id", "term", "weight"))
    known, member = np.unique(ids, return_inverse=True)
    if len(known) > 1 << 16:
        raise ValueError("a pack holds more than 65,536 queries")
    terms = terms.view(np.uint64)
    order = np.lexsort((member, terms))
    terms, weights, member = terms[order], weights[order], member[order]
    heads = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
    asked = np.diff(np.concatenate((heads, [len(terms)]))).astype(np.uint32)
    row = [known.astype(np.int64), terms[heads], weights[heads], asked, member.astype(np.uint16)]
    return pa.Table.from_arrays([pa.array([table.column("pack")[0].as_py()], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in row]], schema=_PACK)


def _search_group(shards: pa.Table, packs: pa.Table, mean: float, k: int) -> pa.Table:
    """query_id, doc_id, score: the k best of some shards for every query."""
    asked = [Pack.load({c: packs.column(c)[n].as_py() for c in _PACK.names}) for n in range(len(packs))]
    known = np.unique(np.concatenate([pack.terms for pack in asked])) if asked else np.zeros(0, np.uint64)
    for pack in asked:
        pack.number(known)
    rough = [Best(len(pack.ids), k) for pack in asked]
    opened: list[list] = []
    for n in range(len(shards)):
        index = ShardIndex.load({c: shards.column(c)[n].as_py() for c in _SHARD_ARRAYS}, mean)
        index.find(known)
        opened.append([candidates(index, pack, found) for pack, found in zip(asked, rough)])
    floors = [found.floors() * (1 - SLACK) for found in rough]
    best = [Best(len(pack.ids), k) for pack in asked]
    for n in range(len(shards)):  # scored when all shards have raised the floors
        index = ShardIndex.load({c: shards.column(c)[n].as_py() for c in _SHARD_ARRAYS}, mean)
        index.find(known)
        for pack, (query, block, bound), floor, found in zip(asked, opened[n], floors, best):
            keep = bound >= floor[query]
            exact(index, pack, query[keep], block[keep], found)
    q, d, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for pack, found in zip(asked, best):
        there = np.arange(k) < found.have[:, None]
        q.append(np.repeat(pack.ids, found.have))
        d.append(found.ids[there])
        s.append(found.scores[there])
    return pa.table([pa.array(np.concatenate(x)) for x in (q, d, s)], names=["query_id", "doc_id", "score"])


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, query_terms: int | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: the ``k`` best rows of ``docs`` for each row of ``queries``.

    Both are (doc_id, text).  Words split at white space, A-Z lower-cased.  A
    query is made of its whole text: all its distinct words, or, if the caller
    sets ``query_terms``, as many of the greatest tf * idf (ties: the word's
    hash); all their postings count.  BM25 with k1 = 1.2, b = 0.75 and
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); N, df and the mean length are
    those of all rows that have a word.  A score adds weights in the order of
    the words' hashes.  Ties go to the smaller doc_id.

    Every task makes shards of the documents it reads, in which the words of no
    query are left out, and packs hold queries of one kind, as texts of different
    kinds share few words; shards are dealt to groups, all queries visit every group,
    and a group returns its ``k`` best, so the merge of all groups is exact.
    Queries come in blocks of bounded number, one after the other.

    Null and blank texts, and rows without doc_id, are no results and ask
    nothing.  Rows that share a doc_id are one result, with the score of the best
    of them; as queries their words are put together.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = cut(usable.select("text").mapInArrow(_frequencies, "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "frequencies")
    totals = counted.where("term = 0").agg(F.sum("df").alias("n"), F.sum("words").alias("words")).first()
    n, mean = totals["n"] or 0, (totals["words"] or 0) / max(1, totals["n"] or 0)
    mean = mean or 1.0

    asked = queries.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms = asked.mapInArrow(_postings, "id long, term long, tf int, length int")
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    terms = terms.groupBy("id", "term").agg(F.sum("tf").alias("tf"))  # rows of one doc_id ask as one
    weighed = terms.join(counted.select("term", "df"), "term").withColumn("weight", idf)
    if query_terms is not None:
        best = Window.partitionBy("id").orderBy(F.desc(F.col("tf") * F.col("weight")), "term")
        weighed = weighed.withColumn("r", F.row_number().over(best)).where(F.col("r") <= query_terms)
    picked = cut(weighed.select(F.col("id").alias("query_id"), "term", "weight"), "queries")

    wanted = picked.select("term").distinct()
    shared = spark.sparkContext.broadcast(_filter_words(wanted))
    fields = ", ".join(["shard long", "bytes long", *[f"{c} binary" for c in _SHARD_ARRAYS]])
    most = SHARD_BYTES
    asking = picked.select("query_id").distinct().count()
    heads = counted.where("term <> 0").orderBy(F.desc("df"), "term").limit(KIND_WORDS).select("term")
    sample = picked.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, asking // KIND_SAMPLE))) == 0).select("query_id", "term").join(F.broadcast(heads), "term").toArrow()
    kinds = _learn_kinds(sample.column("query_id").to_numpy(), sample.column("term").to_numpy().view(np.uint64))
    shards = cut(usable.mapInArrow(lambda batches: _shards(batches, shared.value, k, most, kinds), fields), "shards")
    size = shards.agg(F.sum("bytes")).first()[0] or 0
    groups = max(2 * spark.sparkContext.defaultParallelism, math.ceil(size / GROUP_BYTES))
    dealt = shards.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int"))
    # all queries visit every group; packs keep the rows that are copied few
    centres = spark.createDataFrame([(int(t), [float(x) for x in c]) for t, c in zip(kinds[0].view(np.int64), kinds[1].T)], "term long, near array<double>")
    near = F.array(*[F.sum(F.coalesce(F.col("near")[n], F.lit(0.0))) for n in range(len(kinds[1]))])
    kind = cut(picked.join(F.broadcast(centres), "term", "left").groupBy("query_id").agg(near.alias("near")).selectExpr("query_id", "cast(array_position(near, array_max(near)) - 1 as int) as kind"), "kinds")
    packs, starts = 0, {}
    for r in sorted(kind.groupBy("kind").count().collect()):
        starts[r["kind"]] = packs, math.ceil(r["count"] / PACK)
        packs += starts[r["kind"]][1]
    first, many = (F.element_at(F.create_map(*[F.lit(x) for r, s in starts.items() for x in (r, s[n])]) if starts else F.expr("map(0, 1)"), F.col("kind")) for n in (0, 1))
    numbered = picked.join(kind, "query_id").select(*picked.columns, (first + F.pmod(F.xxhash64("query_id"), many)).cast("int").alias("pack"))
    packed = cut(numbered.groupBy("pack").applyInArrow(_packed, "pack int, ids binary, terms binary, weights binary, asked binary, members binary"), "packs")
    blocks = max(1, math.ceil(asking / QUERY_BLOCK))

    def group_search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search_group(left, right, mean, k)

    found = None
    for block in range(blocks):
        some = packed if blocks == 1 else packed.where(F.pmod("pack", F.lit(blocks)) == block)
        routed = some.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("place"), *_PACK.names)
        part = dealt.groupBy("group").cogroup(routed.groupBy("place")).applyInArrow(group_search, "query_id long, doc_id long, score double")
        part = part if blocks == 1 else cut(part, "found")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
