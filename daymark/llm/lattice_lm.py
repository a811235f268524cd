"""Language-model scores from a subword lattice.

The vocabulary is given (a public tokenizer's pieces with their scores). A word, led by the word
mark, may be cut into pieces in many ways; the forward recursion in log space sums the weights of
all segmentations, which gives the word's marginal probability. No piece crosses a word mark, so a
document's marginal is the product over its words.

The file ranks its pieces; the ranks give the start weights, and rounds of expectation
maximisation over the training words, each a Spark job over all of them, fit the weights to their
counts. The pieces themselves stay as they are. Characters no piece covers take a fixed small probability.

A document's ``score`` is its marginal: the sum over its words of the log of the lattice's
probability, each times the chance that the document goes on, and the chance of its end. A second
column, ``blend``, also draws on what was counted: a word has
``(count + strength * lattice) / (tokens + strength)``, where the strength is the one of a fixed
grid that predicts the training words best when each leaves itself out.

Counts are pre-aggregated in each task. A bounded number of the most frequent words travels to the
tasks that read the documents; all other words of a document meet their counts in a join, which
holds no frequent word and so no hot key.

Defined results: null text has one token, the end; repeated rows are scored each; without training
documents all counts are zero and the lattice alone decides.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.llm.words import WORD, add_columns, ascii_lower
from daymark.session import materialize

MARK = "▁"
#: Rounds of re-estimation.
ROUNDS = 2
#: Most frequent words that are shipped to tasks.
SHIPPED = 80_000
#: Distinct words a task holds before it passes their counts on.
HELD_WORDS = 150_000
STRENGTHS = (1e2, 1e3, 1e4, 3e4, 1e5, 3e5, 1e6, 3e6, 1e7, 3e7, 1e8)
#: Log probability of a character that no piece covers.
UNKNOWN = -25.0
LOG10 = math.log(10.0)


def load_pieces(path: str) -> dict[str, float]:
    """Piece -> log weight from a sentencepiece file; start weights fall with the rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        if MARK in piece[1:]:
            continue
        found.append((-model.get_score(i), piece))
    found.sort()
    total = sum(1.0 / (rank + 10) for rank in range(len(found)))
    return {piece: -math.log((rank + 10) * total) for rank, (_, piece) in enumerate(found)}


class Lattice:
    """Forward and backward sums over all segmentations of a word.

    What leads up to a place depends only on the characters before it, so the sums of the last
    word are kept for the beginning it shares with the next one: words come in sorted order.
    """

    def __init__(self, weights: dict[str, float]):
        # Every beginning of a piece has an entry, None where it is no piece itself: a start
        # position is left as soon as no piece can go on.
        self.entries: dict[str, float | None] = {
            p[:k]: None for p in weights for k in range(1, len(p))} | weights
        self.word = ""
        #: By end position: starts that a piece may still go on from; (start, piece, log weight)
        #: of the pieces that end there; log of the summed weights of all segmentations.
        self.open: list[list[int]] = [[]]
        self.into: list[list[tuple[int, str | None, float]]] = [[]]
        self.sums: list[float] = [0.0]

    def advance(self, word: str) -> None:
        """Bring the sums to the end of ``word``."""
        last, same = self.word, 0
        for a, b in zip(last, word):
            if a != b:
                break
            same += 1
        del self.open[same + 1:], self.into[same + 1:], self.sums[same + 1:]
        self.word = word
        entries, exp, log, sums = self.entries, math.exp, math.log, self.sums
        starts = self.open[same]
        for j in range(same + 1, len(word) + 1):
            going, here, single = [], [], False
            for i in (*starts, j - 1):
                piece = word[i:j]
                if piece not in entries:
                    continue
                going.append(i)
                w = entries[piece]
                if w is not None:
                    here.append((i, piece, w))
                    single = i == j - 1
            if not single:
                here.append((j - 1, None, UNKNOWN))
            if len(here) == 1:
                sums.append(sums[here[0][0]] + here[0][2])
            else:
                terms = [sums[i] + w for i, _, w in here]
                top = max(terms)
                sums.append(top + log(sum([exp(t - top) for t in terms])))
            self.open.append(going)
            self.into.append(here)
            starts = going

    def log_prob(self, word: str) -> float:
        self.advance(MARK + word)
        return self.sums[-1]

    def expected(self, word: str, count: float, into_counts: dict) -> None:
        """Add the expected uses of each piece in ``count`` copies of the word."""
        self.advance(MARK + word)
        into, ahead, exp = self.into, self.sums, math.exp
        share = [0.0] * len(into)
        share[-1] = count
        for j in range(len(into) - 1, 0, -1):
            held = share[j]
            if held <= 0:
                continue
            edges = into[j]
            if len(edges) == 1:
                i, piece, _ = edges[0]
                share[i] += held
                if piece is not None:
                    into_counts[piece] += held
                continue
            for i, piece, w in edges:
                use = held * exp(ahead[i] + w - ahead[j])
                share[i] += use
                if piece is not None:
                    into_counts[piece] += use


def tokens_of(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text)) if text else []


def token_bytes(text: str | None) -> list[bytes]:
    """The words of ``tokens_of`` in UTF-8: bytes are folded and split at ASCII white space only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def count_words(docs: DataFrame, text_column: str, train: Column,
                held_words: int = HELD_WORDS) -> DataFrame:
    """(word, n, c): occurrences in all documents and in the training ones."""
    source = docs.select(F.col(text_column).alias("text"), train.alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others, trained = Counter(), Counter()

        def counts() -> pa.RecordBatch:
            words = list(trained) + [w for w in others if w not in trained]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()),
                 pa.array([trained[w] + others[w] for w in words], pa.int64()),
                 pa.array([trained[w] for w in words], pa.int64())], names=["word", "n", "c"])

        for batch in batches:
            for text, is_train in zip(batch["text"].to_pylist(), batch["train"].to_pylist()):
                (trained if is_train else others).update(token_bytes(text))
                if len(trained) + len(others) >= held_words:
                    yield counts()
                    trained.clear()
                    others.clear()
        yield counts()

    return source.mapInArrow(run, "word string, n bigint, c bigint").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c"))


def fit_pieces(words: DataFrame, weights: dict[str, float], rounds: int = ROUNDS
               ) -> dict[str, float]:
    """Piece weights after ``rounds`` of expectation maximisation over the training words, each as
    often as it was met. Words in sorted order share the sums of their common beginnings."""
    trained = words.filter("c > 0").select("word", "c")
    for _ in range(rounds):
        shipped = words.sparkSession.sparkContext.broadcast(pickle.dumps(weights))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(pickle.loads(shipped.value))
            uses: dict[str, float] = defaultdict(float)
            for batch in batches:
                for word, c in zip(batch["word"].to_pylist(), batch["c"].to_pylist()):
                    lattice.expected(word, float(c), uses)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(uses), pa.string()), pa.array(list(uses.values()), pa.float64())],
                names=["piece", "uses"])

        # One row for each piece of the vocabulary at most.
        uses = {r[0]: r[1] for r in trained.mapInArrow(run, "piece string, uses double")
                .groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}
        total = sum(uses.values()) + 0.1 * len(weights)
        if not uses:
            break
        weights = {p: math.log((uses.get(p, 0.0) + 0.1) / total) for p in weights}
    return weights


def word_table(words: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``words`` with lattice, the log10 marginal probability of the word."""
    shipped = words.sparkSession.sparkContext.broadcast(pickle.dumps(weights))

    def start():
        lattice = Lattice(pickle.loads(shipped.value))
        return lambda found: ([lattice.log_prob(w) / LOG10 for w in found],)

    return add_columns(words, ["word"], {"lattice": "double"}, start)


def best_strength(words: DataFrame, n_tokens: int, end_share: float) -> float:
    """The strength under which training words, each left out in turn, are most probable."""
    prior = F.pow(F.lit(10.0), F.col("lattice")) * (1 - end_share)
    sums = words.filter("c > 0").agg(*[
        F.sum(F.col("c") * F.log10((F.col("c") - 1 + s * prior + 1e-300)
                                   / (n_tokens - 1 + s))) for s in STRENGTHS]).first()
    ranked = [(v, s) for v, s in zip(sums, STRENGTHS) if v is not None]
    return max(ranked)[1] if ranked else STRENGTHS[0]


def score(docs: DataFrame, vocabulary: str, train: Column, text_column: str = "text",
          shipped_words: int = SHIPPED, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score, score, blend.

    ``vocabulary`` is the path of the tokenizer file, ``train`` marks the rows to learn from.
    Columns of ``docs`` under the result's names are replaced.
    """
    spark = docs.sparkSession
    counted = materialize(count_words(docs, text_column, train).orderBy("word"), "word-counts")
    weights = fit_pieces(counted, load_pieces(vocabulary), rounds)
    words = materialize(word_table(counted, weights), "word-lattice")
    facts = words.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0))).first()
    ends = docs.filter(train).count()
    n_tokens = int(facts[0] or 0) + ends
    distinct = int(facts[1] or 0) + (ends > 0)
    end_share = (ends + 0.5) / (n_tokens + 1)
    strength = best_strength(words, n_tokens, end_share) if n_tokens > 1 else STRENGTHS[0]
    base_total = n_tokens + 0.5 * (distinct + 1)

    def base_of(c: Column) -> Column:
        return F.log10((c + 0.5) / base_total)

    def blend_of(c: Column, lattice: Column) -> Column:
        # far below the smallest double the lattice's log is used directly
        prior = F.pow(F.lit(10.0), lattice) * (strength * (1 - end_share))
        direct = lattice + math.log10(strength * (1 - end_share))
        return F.when((c == 0) & (lattice < -290), direct).otherwise(
            F.log10(c + prior)) - math.log10(n_tokens + strength)

    words = words.select("word", "n", "c", base_of(F.col("c")).alias("base"),
                         (F.col("lattice") + math.log10(1 - end_share)).alias("model"),
                         blend_of(F.col("c"), F.col("lattice")).alias("blend"))
    top = {r[0].encode("utf-8", "surrogatepass"): tuple(r[1:]) for r in words.orderBy(
        F.col("n").desc(), "word").limit(shipped_words).select(
        "word", "c", "base", "model", "blend").collect()}
    held = spark.sparkContext.broadcast(pickle.dumps(top))
    end_base = math.log10((ends + 0.5) / base_total)
    end_model = math.log10(end_share)
    end_blend = math.log10((ends + strength * end_share) / (n_tokens + strength))
    end_known = int(ends > 0)

    def start():
        known = pickle.loads(held.value)

        def compute(texts):
            out = ([], [], [], [], [], [], [])
            for text in texts:
                counts = Counter(token_bytes(text))
                total, seen, base, model, blend = 1, end_known, end_base, end_model, end_blend
                rare, times = [], []
                for word, k in counts.items():
                    total += k
                    fact = known.get(word)
                    if fact is None:
                        rare.append(word)
                        times.append(k)
                        continue
                    seen += k if fact[0] else 0
                    base += k * fact[1]
                    model += k * fact[2]
                    blend += k * fact[3]
                for column, value in zip(out, (total, seen, base, model, blend, rare, times)):
                    column.append(value)
            return out

        return compute

    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "blend"]
    own = [c for c in docs.columns if c != text_column and c not in made]
    inner = docs.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(own)],
                        F.col(text_column).alias("body"))
    read = add_columns(inner, ["body"], {
        "n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double",
        "blend": "double", "rare": "array<string>", "times": "array<bigint>"}, start, drop=["body"]).withColumn(
        "row_key", F.monotonically_increasing_id())
    # One row for each rare word; the first also carries what the frequent words gave. Rows
    # without rare words get a key of their own, so they do not meet in one task.
    spread = read.select(
        "row_key", *[f"d{i}" for i in range(len(own))], "n_tokens", "n_known", "base_score",
        "score", "blend", F.posexplode_outer(F.arrays_zip("rare", "times")).alias("pos", "r"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    spread = spread.select(
        "row_key", F.when(first, F.struct(
            F.lit(1).alias("one"), *[f"d{i}" for i in range(len(own))],
            "n_tokens", "n_known", "base_score", "score", "blend")).alias("head"),
        F.coalesce("r.rare", F.concat(F.lit(" "), "row_key")).alias("word"),
        F.coalesce("r.times", F.lit(0)).alias("k"))
    joined = spread.join(words.select("word", "c", "base", "model", "blend"), "word", "left")
    k = F.col("k")
    summed = joined.groupBy("row_key").agg(
        F.max("head").alias("head"),
        F.sum(F.when(F.col("c") > 0, k).otherwise(0)).alias("known"),
        F.coalesce(F.sum(k * F.col("base")), F.lit(0.0)).alias("base"),
        F.coalesce(F.sum(k * F.col("model")), F.lit(0.0)).alias("model"),
        F.coalesce(F.sum(k * F.col("blend")), F.lit(0.0)).alias("blend"))
    return summed.select(
        *[F.col(f"head.d{i}").alias(c) for i, c in enumerate(own)],
        F.col("head.n_tokens").alias("n_tokens"),
        (F.col("head.n_known") + F.col("known")).alias("n_known"),
        F.lit(n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("head.base_score") + F.col("base")).alias("base_score"),
        (F.col("head.score") + F.col("model")).alias("score"),
        (F.col("head.blend") + F.col("blend")).alias("blend"))
