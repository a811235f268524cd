"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z folded, digits to 0, white space to one space) and hashed. For every
host the number of distinct documents that hold a line is counted; lines above the limits are
boilerplate and are removed, and a document that is depleted by their removal is rejected.

Documents that are copies of one another must not turn their own content into boilerplate, so the
count goes by whole-text content: documents with the same normalised lines in the same order count
once. A line is boilerplate if at least ``min_documents`` such contents of the host hold it; how
many rows hold it besides does not matter, so copies neither make nor shield a boilerplate line.
Texts that differ anywhere are documents of their own.

Hot lines and hosts: pre-aggregated on (host, line, content), then on (host, line); the few lines
above the limit meet the documents' lines again under a salted key.

Defined results: null text has no words and fails the base rules; a null host is a host of its
own; repeated rows are judged each; empty input gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.words import WORD, add_columns, ascii_lower, masked, position, unmasked
from daymark.session import materialize

MIN_WORDS = 20
#: Percent of words in repeated windows above which a text fails.
MAX_REPEATED = 30
REPEAT_WINDOW = 8
#: A boilerplate line stands in at least so many distinct documents of a host.
MIN_DOCUMENTS = 10
#: A depleted document has lost more than this share of its words.
MAX_REMOVED = 0.5
SALTS = 16

_SYMBOL = re.compile(r"[#*$%&|<>]")
_DIGIT = re.compile("[0-9]")


def repeated_words(words: list[str], width: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice, the first included.

    Windows are named exactly by doubling: equal words get one number, then pairs, and so on.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    names: dict[str, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    if len(names) == len(words):
        return 0
    have = 1
    while have < width:
        step = min(have, width - have)
        pairs = ids[:len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        _, ids = np.unique(pairs, return_inverse=True)
        have += step
    twice = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def normal_line(line: str) -> str:
    return _DIGIT.sub("0", " ".join(WORD.findall(ascii_lower(line))))


def line_key(line: str) -> int:
    return int.from_bytes(hashlib.md5(line.encode("utf-8", "surrogatepass")).digest()[:8], "big",
                          signed=True)


def text_facts(text: str | None) -> dict:
    """Base counts of one text, and its distinct normalised lines with their words, and
    a key of its content. A line that occurs again adds its words to the first."""
    text = text or ""
    words: list[str] = []
    seen: set[str] = set()
    dup_lines = 0
    lines: dict[int, int] = {}
    order: list[int] = []
    for line in text.split("\n"):
        in_line = WORD.findall(line)
        if not in_line:
            continue
        if line in seen:
            dup_lines += 1
        seen.add(line)
        key = line_key(normal_line(line))
        order.append(key)
        lines[key] = lines.get(key, 0) + len(in_line)
        words += in_line
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)),
        "n_symbols": len(_SYMBOL.findall(text)), "n_dup_lines": dup_lines,
        "n_repeat_words": repeated_words(words),
        "line_keys": list(lines), "line_words": list(lines.values()),
        "content": line_key(",".join(map(str, order)))}


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FACTS = dict.fromkeys([*BASE, "content"], "bigint") | dict.fromkeys(
    ["line_keys", "line_words"], "array<bigint>")


def base_facts(docs: DataFrame, text_column: str) -> DataFrame:
    """``docs`` without its text, with the facts of every row."""

    def start():
        def compute(texts):
            facts = [text_facts(t) for t in texts]
            return [[f[name] for f in facts] for name in FACTS]
        return compute

    return add_columns(docs, [text_column], FACTS, start, drop=[text_column])


def frequent_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(host, line) above the limit, from ``lines`` (host, line, content)."""
    return (
        lines.select("host", "line", "content").distinct()
        .groupBy("host", "line").agg(F.count("*").alias("documents"))
        .filter(F.col("documents") >= min_documents))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          host_column: str = "source", min_documents: int = MIN_DOCUMENTS,
          max_removed: float = MAX_REMOVED) -> DataFrame:
    """One row per row of ``docs``: row_key, doc_id, host, the base counts, n_removed_words,
    base_failed and kept. ``row_key`` tells repeated rows apart."""
    slim = docs.select(F.monotonically_increasing_id().alias("row_key"),
                       F.col(id_column).cast("string").alias("doc_id"),
                       F.col(host_column).cast("string").alias("host"),
                       F.col(text_column).alias("body"))
    facts = materialize(base_facts(slim, "body"), "line-facts")
    kind = docs.schema[id_column].dataType
    return _verdict(facts, min_documents, max_removed).withColumn(
        "doc_id", F.col("doc_id").cast(kind))


def _verdict(facts: DataFrame, min_documents: int, max_removed: float) -> DataFrame:
    host = F.coalesce(F.concat(F.lit("h"), "host"), F.lit(""))
    lines = facts.select("row_key", host.alias("host"), "content", F.explode(F.arrays_zip(
        "line_keys", "line_words")).alias("l")).select(
        "row_key", "host", "content", F.col("l.line_keys").alias("line"),
        F.col("l.line_words").alias("words"))
    frequent = (frequent_lines(lines, min_documents).select("host", "line")
                .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    removed = (
        lines.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int"))
        .join(frequent, ["host", "line", "salt"])
        .groupBy("row_key").agg(F.sum("words").alias("n_removed_words")))
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    depleted = F.col("n_removed_words") > max_removed * F.col("n_words")
    return (
        facts.join(removed, "row_key", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("bigint")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~depleted)
        .select("row_key", "doc_id", "host", *BASE, "n_removed_words", "base_failed", "kept"))


def keep_good(docs: DataFrame, text_column: str = "text", host_column: str = "source",
              min_documents: int = MIN_DOCUMENTS,
              max_removed: float = MAX_REMOVED) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    A verdict depends on text and host alone, so rows find theirs by a digest of the two.
    """
    inner = masked(docs)
    text = F.col(position(docs, text_column))
    host = F.col(position(docs, host_column)).cast("string")
    digest = F.md5(F.concat_ws("\n", F.coalesce(F.concat(F.lit("h"), host), F.lit("")), text))
    slim = inner.select(F.monotonically_increasing_id().alias("row_key"),
                        digest.alias("doc_id"), host.alias("host"), text.alias("body"))
    facts = materialize(base_facts(slim, "body"), "line-facts")
    good = (_verdict(facts, min_documents, max_removed).filter("kept")
            .select("doc_id").distinct())
    return unmasked(inner.join(good, digest == F.col("doc_id"), "left_semi"), docs)
