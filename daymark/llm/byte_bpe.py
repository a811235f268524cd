"""Byte-level BPE encoding and decoding by merge replay.

A tokenizer's ranks say which two neighbouring tokens become one, and in which order. Here the
merges are replayed over a whole chunk of the corpus at once: the distinct words (matches of the
tokenizer's pattern) of a chunk are laid out one after another, an inverted index leads from a
merge to the positions of its token pair, and the merges are applied in rank order. Applying one
looks only at the positions under its entry and files the pairs that its two neighbours now form.
Each distinct word of a chunk is so merged once, however often it occurs, and a word of n bytes
costs in proportion to n, not to its square.

Chunks are slices of the table as Spark deals it, bounded in bytes; a task keeps the words it has
met up to a bound. There is no shuffle, so no word, however frequent, is a hot key. Only the
tokenizer's tables are broadcast, and their size is that of the vocabulary file.

Defined results: null text is empty and gives no ids; repeated rows are encoded each; an empty
table gives none; a long text is a chunk of its own and is encoded whole. Where two pairs of a
word have the same rank, the left one goes first. A word that is itself a token takes that token,
as the public library does. Columns named like the result are replaced, all others pass through.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bits of a token id in the key of a pair.
BITS = 21
WALL = (1 << BITS) - 1
#: Text bytes of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Distinct words a task remembers between chunks.
KNOWN_WORDS = 200_000
#: Symbols laid out for one replay; a longer word is replayed alone.
REPLAY_SYMBOLS = 1 << 20
#: From this many places on, the places of a merge are treated as arrays.
MANY_PLACES = 40


@dataclass
class Tokenizer:
    """Tables of a byte-level BPE tokenizer, in the form the tasks need."""

    pattern: str
    tokens: list[bytes | None]      # by id
    ids: dict[bytes, int]
    pairs: dict[int, int]           # left << BITS | right -> merged id
    byte_ids: np.ndarray            # id of each single byte
    byte_pairs: np.ndarray          # merged id of two bytes, WALL where there is none
    pair_keys: np.ndarray           # the keys of ``pairs``, ascending
    pair_ids: np.ndarray            # and their merged ids
    only_pair: dict[int, int]       # merged id -> its pair, where it has one with unlike sides


def load(path: str, pattern: str) -> Tokenizer:
    """Read a file of ``base64(token) rank`` lines; the id of a token is its rank."""
    ids = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ids[base64.b64decode(token)] = int(rank)
    return build(ids, pattern)


def build(ids: dict[bytes, int], pattern: str) -> Tokenizer:
    """Tables from token -> rank. All 256 single bytes must be tokens."""
    missing = [b for b in range(256) if bytes([b]) not in ids]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    if max(ids.values()) >= WALL:
        raise ValueError(f"ranks must be below {WALL}")
    tokens: list[bytes | None] = [None] * (max(ids.values()) + 1)
    pairs = {}
    for token, rank in ids.items():
        tokens[rank] = token
        for cut in range(1, len(token)):
            left, right = ids.get(token[:cut]), ids.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << BITS | right] = rank
    byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int64)
    byte_pairs = np.array([[pairs.get(int(a) << BITS | int(b), WALL) for b in byte_ids]
                           for a in byte_ids], np.int64)
    keys = np.array(sorted(pairs), np.int64)
    merged = np.array([pairs[k] for k in keys.tolist()], np.int64)
    once = {r for r, n in Counter(pairs.values()).items() if n == 1}
    only = {r: k for k, r in pairs.items() if r in once and k >> BITS != k & WALL
            and pairs.get(r << BITS | k >> BITS, WALL) > r}
    return Tokenizer(pattern, tokens, ids, pairs, byte_ids, byte_pairs, keys, merged, only)


def replay(words: list[bytes], tok: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each word has. Words are not empty."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    # Word i fills the places from starts[i]; the place before each word and the last one are walls.
    starts = np.cumsum(lengths + 1) - lengths
    place = np.arange(len(raw)) + np.repeat(np.arange(1, len(words) + 1), lengths)
    size = len(raw) + len(words) + 1
    laid = np.full(size, WALL, np.int64)
    laid[place] = tok.byte_ids[raw]
    # The inverted index: merge -> places of the left token of its pair.
    merge = np.full(len(raw), WALL, np.int64)
    if len(raw) > 1:
        merge[:-1] = tok.byte_pairs[raw[:-1], raw[1:]]
    merge[np.cumsum(lengths) - 1] = WALL
    filed = np.flatnonzero(merge != WALL)
    filed = filed[np.argsort(merge[filed], kind="stable")]
    ranks, firsts = np.unique(merge[filed], return_index=True)
    index = {int(r): part.tolist() for r, part in
             zip(ranks, np.split(place[filed], firsts[1:]), strict=True)} if len(ranks) else {}

    symbol = array("i", laid.astype(np.int32).tobytes())
    after = array("i", np.arange(1, size + 1, dtype=np.int32).tobytes())
    before = array("i", np.arange(-1, size - 1, dtype=np.int32).tobytes())
    whole = _Arrays(tok, np.frombuffer(symbol, np.int32), np.frombuffer(after, np.int32),
                    np.frombuffer(before, np.int32))
    merged_of = tok.pairs.get
    due = list(index)
    heapq.heapify(due)
    while due:
        rank = heapq.heappop(due)
        places = index.pop(rank)
        if len(places) >= MANY_PLACES and rank in tok.only_pair:
            formed = whole.merge(rank, places)
            if formed is not None:
                for found, spots in formed:
                    if found in index:
                        index[found].extend(spots)
                    else:
                        index[found] = spots
                        heapq.heappush(due, found)
                continue
        places.sort()
        for n, at in enumerate(places):
            gone = after[at]
            if merged_of(symbol[at] << BITS | symbol[gone]) != rank:
                continue  # a merge before this one took one of the two
            symbol[at], symbol[gone] = rank, -1
            right = after[gone]
            after[at], before[right] = right, at
            left, lowest = before[at], WALL
            for found, spot in ((merged_of(symbol[left] << BITS | rank), left),
                                (merged_of(rank << BITS | symbol[right]), at)):
                if found is None:
                    continue
                lowest = min(lowest, found)
                if found in index:
                    index[found].append(spot)
                else:
                    index[found] = [spot]
                    heapq.heappush(due, found)
            if lowest <= rank:  # an earlier merge became possible: it goes first
                if rank in index:
                    index[rank].extend(places[n + 1:])
                elif n + 1 < len(places):
                    index[rank] = places[n + 1:]
                    heapq.heappush(due, rank)
                break
    standing = (whole.symbol >= 0) & (whole.symbol != WALL)
    counts = np.add.reduceat(standing, starts).astype(np.int64) if len(words) else lengths
    return whole.symbol[standing], counts


@dataclass
class _Arrays:
    """The same merge step for many places at once; the arrays share memory with the caller's."""

    tok: Tokenizer
    symbol: np.ndarray
    after: np.ndarray
    before: np.ndarray

    def merge(self, rank: int, places: list[int]) -> list[tuple[int, list[int]]] | None:
        """Apply a merge with one pair of unlike tokens at all its places.

        Returns the merges that the touched neighbours now form, with their places; None, and
        nothing changed, if one of them would have to go before the rest of this one.
        """
        pair = self.tok.only_pair[rank]
        at = np.array(places, np.int64)
        at = np.sort(at[self.symbol[at] == pair >> BITS])
        at = at[np.concatenate([[True], np.diff(at) > 0])[:len(at)]]
        gone = self.after[at]
        at, gone = at[hit := self.symbol[gone] == pair & WALL], gone[hit]
        right, left = self.after[gone], self.before[at]
        self.symbol[at], self.symbol[gone] = rank, -1
        # A left neighbour that was itself merged just now stands further to the left.
        left = np.where(self.symbol[left] < 0, self.before[left], left)
        keys = np.concatenate([self.symbol[left].astype(np.int64) << BITS | rank,
                               rank << BITS | self.symbol[right].astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.tok.pair_keys, keys), len(self.tok.pair_keys) - 1)
        known = np.flatnonzero(self.tok.pair_keys[slot] == keys)
        found = self.tok.pair_ids[slot[known]]
        if len(found) and found.min() <= rank:
            self.symbol[at], self.symbol[gone] = pair >> BITS, pair & WALL
            return None
        self.after[at], self.before[right] = right, at
        if not len(found):
            return []
        order = np.argsort(found, kind="stable")
        found, spots = found[order], np.concatenate([left, at])[known[order]]
        cuts = np.flatnonzero(np.diff(found)) + 1
        return [(r, part.tolist()) for r, part in
                zip(found[np.concatenate([[0], cuts])].tolist(), np.split(spots, cuts),
                    strict=True)]


class Encoder:
    """Encodes chunks of texts and remembers the words it has met."""

    def __init__(self, tok: Tokenizer, known_words: int = KNOWN_WORDS):
        import regex

        self.tok, self.limit = tok, known_words
        self.split = regex.compile(tok.pattern).findall
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Replay words not met so far and keep their ids."""
        ids, counts, part, size = [self.ids], [self.counts], [], 0
        for n, word in enumerate(words, 1):
            part.append(word.encode("utf-8"))
            size += len(part[-1]) + 1
            if size >= REPLAY_SYMBOLS or n == len(words):
                made, many = replay(part, self.tok)
                made, many = self._whole(part, made, many)
                ids.append(made)
                counts.append(many)
                part, size = [], 0
        for word in words:
            self.known[word] = len(self.known)
        self.ids, self.counts = np.concatenate(ids), np.concatenate(counts)

    def _whole(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray):
        """A word that is a token but is not reached by its merges takes the token all the same."""
        odd = [i for i in np.flatnonzero(counts > 1).tolist() if words[i] in self.tok.ids]
        if not odd:
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in odd:
            parts[i] = np.array([self.tok.ids[words[i]]], np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        if len(self.known) > self.limit:
            self.clear()
        parts = [self.split(t) if t else [] for t in texts]
        known = self.known
        self.learn([w for w in dict.fromkeys(chain.from_iterable(parts)) if w not in known])
        spots = np.array(list(map(known.__getitem__, chain.from_iterable(parts))), np.int64)
        many = self.counts[spots]
        starts = (np.cumsum(self.counts) - self.counts)[spots]
        ends = np.cumsum(many)
        ids = self.ids[np.repeat(starts - (ends - many), many) + np.arange(many.sum())]
        ends = np.concatenate([[0], ends])
        bounds = np.cumsum([0] + [len(p) for p in parts])
        return ids, np.diff(ends[bounds])


def _slices(sizes: list[int | None], limit: int) -> Iterator[tuple[int, int]]:
    """(start, number) of runs of texts of about ``limit`` bytes."""
    start, size = 0, 0
    for i, more in enumerate(sizes):
        size += (more or 0) + 1
        if size >= limit or i + 1 == len(sizes):
            yield start, i + 1 - start
            start, size = i + 1, 0


def encode(docs: DataFrame, tok: Tokenizer, text_column: str = "text",
           result: str = "token_ids") -> DataFrame:
    """``docs`` without the text, with the ids of the whole text as an array."""
    shipped = docs.sparkSession.sparkContext.broadcast(tok)
    own = [c for c in docs.columns if c not in (text_column, result)]
    schema = T.StructType([docs.schema[c] for c in own]).add(result, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        for batch in batches:
            texts = batch.column(0)
            for start, n in _slices(pc.binary_length(texts).to_pylist(), CHUNK_BYTES):
                ids, counts = encoder.encode(texts.slice(start, n).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [c.slice(start, n) for c in batch.columns[1:]] + [made],
                    names=[*own, result])

    return docs.select(text_column, *own).mapInArrow(run, schema)


def decode(frame: DataFrame, tok: Tokenizer, ids_column: str = "token_ids",
           result: str = "decoded") -> DataFrame:
    """``frame`` with the bytes that the ids stand for. Null ids give empty bytes; an id that the
    tokenizer lacks is an error."""
    shipped = frame.sparkSession.sparkContext.broadcast(tok.tokens)
    own = [c for c in frame.columns if c != result]
    schema = T.StructType([frame.schema[c] for c in own]).add(result, T.BinaryType())
    at = own.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shipped.value
        sizes = np.array([-1 if t is None else len(t) for t in tokens], np.int64)
        pool = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        for batch in batches:
            lists = batch.column(at)
            counts = np.asarray(lists.value_lengths().fill_null(0))
            ids = np.asarray(lists.flatten(), np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or sizes[ids].min() < 0):
                raise ValueError("an id that the tokenizer does not have")
            text_ends = np.concatenate([[0], np.cumsum(counts)])
            made = []
            for a, b in zip(text_ends[:-1].tolist(), text_ends[1:].tolist(), strict=True):
                part = ids[a:b]
                many = sizes[part]
                ends = np.cumsum(many)
                made.append(pool[np.repeat(starts[part] - (ends - many), many)
                                 + np.arange(ends[-1] if b > a else 0)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(own))], pa.array(made, pa.binary())],
                names=[*own, result])

    return frame.select(own).mapInArrow(run, schema)
