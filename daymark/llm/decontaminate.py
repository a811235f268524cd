"""Benchmark decontamination by Wu-Manber search over words.

Every window of ``window`` consecutive words of a benchmark item is a pattern; an item with fewer
words is one pattern. Patterns of one length form a class. For a class of length m, the shift
table says for each pair of adjacent words how far the search may jump when it sees that pair at
the end of its window: 0 if a pattern ends with the pair, k if the pair occurs k words before the
end of some pattern, m - 1 if it occurs in none. Where the shift is 0, the bucket of patterns with
that last pair is compared word by word.

The benchmark side is cut into blocks of bounded size that are shipped to tasks; each block makes
one pass over the stream of documents within the same stage, so a benchmark of any size is
searched exactly and no document is shuffled.

Defined results: null text has no words and no hits; a document's repeated rows each get their
own result; items without words are ignored; several items with one text are all reported; null
item ids are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.words import add_columns, ascii_lower, masked, position, unmasked

WINDOW = 10
#: Bytes of benchmark text in a block that is shipped to every task.
BLOCK_BYTES = 16 << 20

TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def text_words(text: str | None) -> list[str]:
    return TOKEN.findall(ascii_lower(text)) if text else []


class WuManber:
    """Multi-pattern search over lists of words."""

    def __init__(self, patterns: dict[tuple[str, ...], set]):
        """patterns: words of a pattern -> the keys to report for it."""
        self.classes = []
        by_length: dict[int, dict] = {}
        for words, keys in patterns.items():
            by_length.setdefault(len(words), {})[words] = keys
        for m, group in sorted(by_length.items()):
            shift: dict = {}
            buckets: dict = {}
            if m == 1:
                self.classes.append((1, None, {w[0]: keys for w, keys in group.items()}))
                continue
            for words, keys in group.items():
                for end in range(1, m):
                    pair = (words[end - 1], words[end])
                    away = m - 1 - end
                    if away < shift.get(pair, m):
                        shift[pair] = away
                buckets.setdefault((words[-2], words[-1]), []).append((words, keys))
            self.classes.append((m, shift, buckets))

    def search(self, words: list[str]) -> Iterator[tuple[int, int, set]]:
        """(start, end, keys) of every occurrence."""
        n = len(words)
        for m, shift, buckets in self.classes:
            if m == 1:
                for i, w in enumerate(words):
                    if w in buckets:
                        yield i, i + 1, buckets[w]
                continue
            i, far = m - 1, m - 1
            while i < n:
                jump = shift.get((words[i - 1], words[i]), far)
                if jump:
                    i += jump
                    continue
                start = i - m + 1
                for pattern, keys in buckets[words[i - 1], words[i]]:
                    if all(words[start + k] == pattern[k] for k in range(m)):
                        yield start, i + 1, keys
                i += 1


def item_patterns(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict:
    """Windows of the items' words, each with the ids of the items that hold it."""
    found: dict[tuple[str, ...], set] = {}
    for item, text in items:
        words = text_words(text)
        if item is None or not words:
            continue
        for i in range(max(1, len(words) - window + 1)):
            found.setdefault(tuple(words[i:i + window]), set()).add(str(item))
    return found


def benchmark_blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of at most ``block_bytes`` (or one item), read one after another."""
    block: list[tuple[object, str]] = []
    held = 0
    for row in benchmark.select(id_column, text_column).toLocalIterator():
        if row[0] is None or row[1] is None:
            continue
        size = len(row[1].encode())
        if block and held + size > block_bytes:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += size
    if block:
        yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_column: str = "text",
                   item_column: str = "item_id", item_text: str = "text", window: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (merged word ranges [start, end)), n_hit and item_ids
    (sorted as strings). Columns of ``docs`` with these names are replaced."""
    spark = docs.sparkSession
    if text_column in ("n_words", "hit_spans", "n_hit", "item_ids"):
        raise ValueError(f"{text_column} is the name of a result column")
    made = ["n_words", "hit_spans", "n_hit", "item_ids"]
    out = docs.drop(*made).withColumns({
        "hit_spans": F.array().cast("array<array<bigint>>"),
        "item_ids": F.array().cast("array<string>")})
    passes = 0
    for block in benchmark_blocks(benchmark, item_column, item_text, block_bytes):
        out = _scan(out, spark.sparkContext.broadcast(pickle.dumps(item_patterns(block, window))),
                    text_column)
        passes += 1
    if not passes:
        out = _scan(out, spark.sparkContext.broadcast(pickle.dumps({})), text_column)
    return out.withColumn("n_hit", F.aggregate(
        "hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + (s[1] - s[0])))


def _scan(frame: DataFrame, shipped, text_column: str) -> DataFrame:
    """One pass of one benchmark block; hits are merged with those of earlier blocks."""

    def start():
        searcher = WuManber(pickle.loads(shipped.value))

        def scan(texts, old_spans, old_items):
            counts, spans, items = [], [], []
            for text, seen, keys in zip(texts, old_spans, old_items):
                words = text_words(text)
                found, keys = [tuple(s) for s in seen], set(keys)
                for begin, end, of in searcher.search(words):
                    found.append((begin, end))
                    keys |= of
                counts.append(len(words))
                spans.append(merged(found))
                items.append(sorted(keys))
            return counts, spans, items

        return scan

    return add_columns(
        frame, [text_column, "hit_spans", "item_ids"],
        {"n_words": "bigint", "hit_spans": "array<array<bigint>>", "item_ids": "array<string>"},
        start)


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text",
                      **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their own columns."""
    found = find_benchmark(masked(docs), benchmark, position(docs, text_column), **options)
    return unmasked(found.filter("n_hit = 0"), docs)
