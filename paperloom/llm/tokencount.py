"""Token counts of a unigram model, with scores shared along a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import vectext as V
from paperloom.llm.common import small_batches

#: A public vocabulary; any SentencePiece model file will do.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Piece r of the vocabulary has the probability proportional to 1 / (r + SHIFT).
SHIFT = 2.7
#: A byte that no piece covers costs this much more than the rarest piece.
BYTE_PENALTY = 10.0
#: Places (word, depth) that go into the trie at once; levels of the trie are made in groups of about so many.
PLACES = 1 << 19
#: Levels of fewer nodes are scored node by node, as array calls would cost more than they save.
NARROW = 6
_SLOTS = 1 << 20
#: Distinct words whose counts a worker remembers between blocks (about 64 MB at most).
REMEMBERED = 1 << 22


class Pieces(NamedTuple):
    raw: list[bytes]  # the word mark is a space
    scores: list[float]


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """Pieces and their log probabilities, by their order in the file (read on the driver)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [model.id_to_piece(i).replace(MARK, " ") for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    weights = [1.0 / (r + SHIFT) for r in range(len(texts))]
    total = math.fsum(weights)
    return Pieces([t.encode() for t in texts], [math.log(w / total) for w in weights])


class Counter:
    """Best segmentations of many words at once."""

    def __init__(self, pieces: Pieces) -> None:
        data = np.frombuffer(b"".join(pieces.raw), np.uint8)
        ends = np.cumsum([len(p) for p in pieces.raw])
        hashes = V.Hasher(data).ranges(np.concatenate(([0], ends[:-1])), ends)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array(pieces.scores)[order]
        self.longest = max(map(len, pieces.raw))
        self.slots = np.zeros(_SLOTS, dtype=bool)
        self.slots[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.byte_score = min(pieces.scores) - BYTE_PENALTY

    def _piece_scores(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -np.inf)
        maybe = np.flatnonzero(self.slots[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[maybe]
        out[maybe[hit]] = self.scores[at[hit]]
        return out

    def many(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Token counts of the words data[start:end] (the mark in front included).

        Words go into a trie a group of levels at a time: the node of a word at
        depth d is the hash of its first d bytes.  A node's best score needs its
        ancestors and the pieces that end there, and is computed once for all
        words that share it; a word's count is its terminal node's.  Of the
        levels before a group only those that a piece reaches back to are kept,
        so memory follows neither the depth of the trie nor the longest word.
        """
        size = end - start
        out = np.zeros(len(start), np.int64)
        words = np.argsort(-size, kind="stable")
        if not len(words):
            return out
        hasher = V.Hasher(data)
        a, lengths = start[words], size[words]
        low, begin = 0, np.zeros(1, np.int64)  # first level kept; where each kept level begins in ``node``
        node = np.zeros(len(words), np.int64)  # of each word, level after level
        best, count = np.zeros(1), np.zeros(1, np.int64)  # of each node
        first = 1
        while first <= lengths[0]:
            alive = int(np.searchsorted(-lengths, -first, side="right"))  # words are sorted by length
            last = min(int(lengths[0]), first + max(PLACES // alive, 1) - 1)
            each = np.searchsorted(-lengths, -np.arange(first, last + 1), side="right")
            begins = np.cumsum(each) - each
            level = np.repeat(np.arange(first, last + 1), each)
            word = np.arange(len(level)) - np.repeat(begins, each)
            made, example = _nodes(level, hasher.ranges(a[word], a[word] + level))
            old = len(best)
            begin = np.concatenate((begin, len(node) + begins))
            node = np.concatenate((node, old + made))
            at, of = level[example], word[example]  # depth and one word of each new node, by depth
            up = node[begin[at - 1 - low] + of]
            to, back, gain = self._ending_pieces(hasher, a[of], at)
            source = node[begin[at[to] - back - low] + of[to]]
            best = np.concatenate((best, np.zeros(len(at))))
            count = np.concatenate((count, np.zeros(len(at), np.int64)))
            steps = np.searchsorted(at, np.arange(first, last + 2))
            pieces = np.searchsorted(to, steps)
            for x, y, p, q in zip(steps[:-1].tolist(), steps[1:].tolist(), pieces[:-1].tolist(), pieces[1:].tolist()):
                if y - x < NARROW:
                    for k in range(x, y):
                        score, fewest = best.item(up.item(k)) + self.byte_score, count.item(up.item(k))
                        while p < q and to.item(p) == k:
                            there = source.item(p)
                            other = best.item(there) + gain.item(p)
                            if other > score or (other == score and count.item(there) < fewest):
                                score, fewest = other, count.item(there)
                            p += 1
                        best[old + k], count[old + k] = score, fewest + 1
                    continue
                byte = best[up[x:y]] + self.byte_score
                top, fewest = byte, count[up[x:y]]
                if q > p:
                    here, there = to[p:q] - x, source[p:q]
                    score = best[there] + gain[p:q]
                    top = byte.copy()
                    np.maximum.at(top, here, score)
                    fewest = np.where(byte == top, fewest, np.iinfo(np.int64).max - 1)
                    good = score == top[here]
                    np.minimum.at(fewest, here[good], count[there[good]])
                best[old + x : old + y], count[old + x : old + y] = top, fewest + 1
            ended = np.arange(int(np.searchsorted(-lengths, -last)), alive)
            out[words[ended]] = count[node[begin[lengths[ended] - low] + ended]]
            keep = max(low, last + 1 - self.longest)
            skip, low = int(begin[keep - low]), keep
            node, begin = node[skip:], begin[-(last - keep + 1) :] - skip
            gone = int(node[: begin[1] if len(begin) > 1 else None].min())
            node, best, count = node - gone, best[gone:], count[gone:]
            first = last + 1
        return out

    def _ending_pieces(self, hasher: V.Hasher, begin: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that end at nodes: node, length of the piece, its score; by node.

        Nodes are given by the place where an example word begins, and their depth, ascending.
        """
        found = []
        for n in range(1, self.longest + 1):
            deep = int(np.searchsorted(depth, n))
            if deep == len(depth):
                break
            stop = begin[deep:] + depth[deep:]
            s = self._piece_scores(hasher.ranges(stop - n, stop))
            at = np.flatnonzero(s > -np.inf)
            found.append((at + deep, np.full(len(at), n), s[at]))
        to, back, gain = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(to, kind="stable")
        return to[order], back[order], gain[order]


def _nodes(level: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number the distinct (level, prefix hash): the number of each place, and a place of each number, by level."""
    order = np.lexsort((prefix, level))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(level[order]) != 0) | (prefix[order][1:] != prefix[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


class Memory:
    """Counts of words seen before, by hash."""

    def __init__(self, counter: Counter) -> None:
        self.counter = counter
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Token count of every word data[start:end]; only words not seen before go into a trie."""
        h, example, inverse = np.unique(V.Hasher(data).ranges(start, end), return_index=True, return_inverse=True)
        counts = np.zeros(len(h), np.int64)
        at = np.searchsorted(self.hashes, h)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == h[known]
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            counts[new] = self.counter.many(*_gather(data, start[example[new]], end[example[new]]))
            if len(self.hashes) + len(new) > REMEMBERED:
                self.hashes, self.counts = self.hashes[:0], self.counts[:0]
            keep = new[: REMEMBERED]
            at = np.searchsorted(self.hashes, h[keep])
            self.hashes, self.counts = np.insert(self.hashes, at, h[keep]), np.insert(self.counts, at, counts[keep].astype(np.int32))
        return counts[inverse]


_memories: dict[str, Memory] = {}  # of this Python worker, by vocabulary


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A new buffer of the given ranges, each behind one space; and their places."""
    size = end - start + 1
    ends = np.cumsum(size)
    begins = ends - size
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    source = np.arange(len(out)) - np.repeat(begins + 1 - start, size)
    out[:] = data[np.maximum(source, 0)]
    out[begins] = 32
    return out, begins, ends


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_words, n_bytes of each row of ``docs``.

    Pre-tokens are the words between ASCII white space, each behind the word
    mark.  A pre-token is segmented into the pieces with the greatest sum of log
    probabilities (ties: fewer pieces); a byte that no piece covers is a token.
    Probabilities fall with a piece's rank in the vocabulary file (nothing is
    trained).  In every block of text, distinct pre-tokens are inserted in a
    trie, so shared prefixes are scored once; a worker remembers the counts of
    a bounded number of words.  No row leaves its task.

    Null, empty and blank texts have 0 tokens.  Whole texts are counted; a
    single word may have any length.  Rows without doc_id are counted like
    others, repeated rows each give a row; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))  # one vocabulary: its size doesn't follow the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _memories:
            _memories[path] = Memory(Counter(shared.value))
        memory = _memories[path]
        for batch in batches:
            for first, last, data, offsets in V.text_blocks(batch.column(1)):
                rows = last - first
                start, end, row = V.words(data, offsets)
                tokens = np.zeros(rows, np.int64)
                if len(start):
                    tokens = np.bincount(row, weights=memory.count(data, start, end), minlength=rows).astype(np.int64)
                words = np.bincount(row, minlength=rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(tokens), pa.array(words), pa.array(np.diff(offsets).astype(np.int64))], names=["doc_id", "n_tokens", "n_words", "n_bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_words long, n_bytes long")
