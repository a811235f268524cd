"""Mixing sources to target weights by iterative proportional fitting.

Token weights are raked to three marginals: source, language and topic. The fitted weight of a
document is a product of one factor per margin. A sweep takes the three margins in turn. The table
of tokens by source, with an array of its languages and topics, is written once; a sweep is one
pass over it, in which a task adds up its sources to one sum for each pair of language and topic.
These sums are all that reaches the driver, and source factors follow from the others. A driver
holds some hundred bytes for each pair of language and topic, however many sources there are.

Documents are then sampled. Without a ``rate`` the probability is ``weight / largest weight``:
expected tokens of the sample have exactly the fitted shares, but the rarest cell sets its size.
With a ``rate`` the expected tokens of the sample are that share of all tokens, whatever cells
there are: probabilities are ``scale * weight`` clipped at 1, a cell that is clipped is kept
whole, and the scale is solved so that the others fill the rate in their fitted proportions. The
draw is a hash of the id: the same document gets the same draw in every run.

Targets: a tempered share ``share ** temperature`` (rescaled to one) for every margin, or a given
dictionary for languages and topics. Values a given dictionary does not name get weight zero.

Defined results: null source, language or topic is a value of its own, named ''; a document
without words has weight of its cell but adds no tokens; rows whose cell has no tokens get
probability 1; repeated rows share one draw; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.llm.words import masked, position, unmasked
from daymark.session import materialize

TEMPERATURE = 0.85
SWEEPS = 25
TOLERANCE = 1e-10
#: Words and the text patterns of the topics, first match first.
TOPICS = (("table", r" \| "), ("code", r'token = "'), ("notice", r"(?i)licen[sc]e|copyright"))
OTHER = "prose"


def token_count(text: Column) -> Column:
    """Words of a text: runs without ASCII white space."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.length(plain) - F.length(F.replace(plain, F.lit("w"), F.lit("")))


def topic_of(text: Column) -> Column:
    """Topic of a text by the first pattern it holds."""
    text = F.coalesce(text, F.lit(""))
    out = F.lit(OTHER)
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def unit_draw(key: Column) -> Column:
    """A number in [0, 1) from the md5 of the key as text."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _tempered(amounts: Mapping[str, float], temperature: float) -> dict[str, float]:
    total = sum(amounts.values())
    raw = {k: (v / total) ** temperature if v > 0 else 0.0 for k, v in amounts.items()}
    scale = sum(raw.values())
    return {k: v / scale for k, v in raw.items()}


def fit_factors(cells: DataFrame, lang_target: Mapping[str, float] | None = None,
                topic_target: Mapping[str, float] | None = None,
                temperature: float = TEMPERATURE, sweeps: int = SWEEPS,
                tolerance: float = TOLERANCE) -> DataFrame:
    """(source, lang, topic, weight) for every cell of ``cells`` (source, lang, topic, tokens)."""
    cells = cells.filter("tokens > 0").select(
        "source", "lang", "topic", F.col("tokens").cast("double").alias("tokens"))
    pairs = sorted((r[0], r[1], float(r[2])) for r in
                   cells.groupBy("lang", "topic").agg(F.sum("tokens")).collect())
    if not pairs:
        return cells.select("source", "lang", "topic", F.lit(1.0).alias("weight"))
    tokens = np.array([p[2] for p in pairs])
    total = float(tokens.sum())
    #: By margin: its values, the number of the value of each pair, and what is wanted of it.
    values, at, target = {}, {}, {}
    for margin, part, given in (("lang", 0, lang_target), ("topic", 1, topic_target)):
        values[margin], at[margin] = np.unique([p[part] for p in pairs], return_inverse=True)
        sums = np.bincount(at[margin], tokens)
        wanted = dict(given or _tempered(dict(zip(values[margin], sums, strict=True)), temperature))
        target[margin] = np.array([wanted.get(v, 0.0) for v in values[margin]])
    factor = {m: np.ones(len(v)) for m, v in values.items()}
    number = F.struct("lang", "topic", "tokens")
    by_source = cells.groupBy("source").agg(
        F.sum("tokens").alias("all_tokens"), F.sort_array(F.collect_list(number)).alias("cells"))
    by_source = materialize(by_source.select(
        "source", F.pow(F.col("all_tokens") / total, temperature).alias("power"),
        F.transform("cells", lambda c: c["lang"]).alias("langs"),
        F.transform("cells", lambda c: c["topic"]).alias("topics"),
        F.transform("cells", lambda c: c["tokens"]).alias("tokens")), "tokens-by-source")
    norm = float(by_source.agg(F.sum("power")).first()[0])
    place = by_source.sparkSession.sparkContext.broadcast(
        {(p[0], p[1]): i for i, p in enumerate(pairs)})

    def by_pair() -> np.ndarray:
        return factor["lang"][at["lang"]] * factor["topic"][at["topic"]]

    def rows_of(batches, known, weights):
        """(source, numbers of its pairs, their tokens, source factor)."""
        for batch in batches:
            for r in batch.to_pylist():
                own = np.array([known[p] for p in zip(r["langs"], r["topics"], strict=True)])
                held = np.array(r["tokens"])
                met = float(held @ weights[own])
                yield r, own, held, r["power"] / norm / met if met > 0 else 0.0

    def sums_by_pair(weights: np.ndarray) -> np.ndarray:
        n = len(pairs)

        def run(batches):
            out = np.zeros(n)
            for _, own, held, a in rows_of(batches, place.value, weights):
                out[own] += a * held
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["s"])

        parts = by_source.mapInArrow(run, "s binary").collect()  # one row a task
        return sum((np.frombuffer(r[0]) for r in parts), np.zeros(n))

    for _ in range(sweeps):
        held, moved = sums_by_pair(by_pair()), 0.0
        for margin in ("lang", "topic"):
            have = np.bincount(at[margin], held * by_pair(), len(values[margin]))
            moved = max(moved, float(np.abs(have - target[margin]).max()))
            factor[margin] = factor[margin] * np.where(
                have > 0, target[margin] / np.where(have > 0, have, 1.0), 1.0)
        if moved < tolerance:
            break
    weights = by_pair()

    def spread(batches):
        for r, own, _, a in rows_of(batches, place.value, weights):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["source"]] * len(own), pa.string()), pa.array(r["langs"], pa.string()),
                 pa.array(r["topics"], pa.string()), pa.array(a * weights[own] * total)],
                names=["source", "lang", "topic", "weight"])

    return by_source.mapInArrow(
        spread, "source string, lang string, topic string, weight double")


def scale_for(weights: DataFrame, rate: float) -> float:
    """The scale at which ``sum(tokens * min(1, scale * weight))`` is ``rate`` of all tokens, for
    ``weights`` (weight, tokens)."""
    if not 0 < rate <= 1:
        raise ValueError("the rate is a share of all tokens, above 0 and up to 1")
    total, top, least = weights.agg(
        F.sum("tokens"), F.max("weight"),
        F.min(F.when(F.col("weight") > 0, F.col("weight")))).first()
    if not total or not top:
        return 1.0
    low, high = 0.0, 1.0 / least
    # Thirty-two scales a pass over the cells; each pass narrows the range by as much.
    for _ in range(10):
        tries = [low + (high - low) * i / 32 for i in range(1, 33)]
        sums = weights.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * s))
                             for s in tries]).first()
        over = next((i for i, v in enumerate(sums) if v >= rate * total), 31)
        low, high = (tries[over - 1] if over else low), tries[over]
        if high - low <= 1e-12 * high:
            break
    return high


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source", lang_column: str = "lang", topic: Column | None = None,
        rate: float | None = None, **targets) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, n_tokens, weight, probability
    and sampled. ``rate`` is the share of tokens to keep; without it the largest weight decides.
    ``topic`` is an expression over ``docs``, by default ``topic_of`` the text."""
    facts = materialize(docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(topic if topic is not None else topic_of(F.col(text_column)),
                   F.lit("")).alias("topic"),
        token_count(F.col(text_column)).cast("bigint").alias("n_tokens")), "mix-facts")
    return _probabilities(facts, targets, rate)


def _weights(cells: DataFrame, targets: Mapping, rate: float | None) -> tuple[DataFrame, float, float]:
    """The cells' weights, the weight of cells without tokens and the weight from which on a
    document is kept for sure."""
    if rate is None:
        weights = materialize(fit_factors(cells, **targets), "mix-weights")
        top = float(weights.agg(F.max("weight")).first()[0] or 1.0)
        return weights, top, top
    cells = materialize(cells, "mix-cells")
    weights = materialize(fit_factors(cells, **targets).join(
        cells, ["source", "lang", "topic"]), "mix-weights")
    sure = 1.0 / scale_for(weights, rate)
    top = weights.agg(F.max("weight")).first()[0] or 1.0
    return weights.drop("tokens"), max(float(top), sure), sure


def _probabilities(facts: DataFrame, targets: Mapping, rate: float | None = None) -> DataFrame:
    cells = facts.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    weights, top, sure = _weights(cells, targets, rate)
    salted = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")
    return (
        facts.withColumn("salt", salt)
        .join(salted, ["source", "lang", "topic", "salt"], "left").drop("salt")
        .withColumn("weight", F.coalesce("weight", F.lit(top)))
        .withColumn("probability", F.least(F.col("weight") / sure, F.lit(1.0)))
        .withColumn("sampled", unit_draw(F.col("doc_id")) < F.col("probability")))


def sample_mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 source_column: str = "source", lang_column: str = "lang",
                 rate: float | None = None, **targets) -> DataFrame:
    """The sampled rows of ``docs``, with their own columns.

    A probability belongs to (source, language, topic), so rows look theirs up in the small table
    of cells and the text is not moved for it where that table is small.
    """
    inner = masked(docs)
    at = {c: position(docs, c) for c in (id_column, text_column, source_column, lang_column)}
    marked = inner.withColumns({
        "source": F.coalesce(F.col(at[source_column]).cast("string"), F.lit("")),
        "lang": F.coalesce(F.col(at[lang_column]).cast("string"), F.lit("")),
        "topic": topic_of(F.col(at[text_column]))})
    cells = (marked.withColumn("n_tokens", token_count(F.col(at[text_column])).cast("bigint"))
             .groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")))
    weights, top, sure = _weights(cells, targets, rate)
    key = F.col(at[id_column])
    salted = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    drawn = (
        marked.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(16)).cast("int"))
        .join(salted, ["source", "lang", "topic", "salt"], "left")
        .filter(unit_draw(key) < F.coalesce("weight", F.lit(top)) / sure))
    return unmasked(drawn, docs)
