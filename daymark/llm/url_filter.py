"""URL filter: rules first, boosted trees on lexical features for the rest.

A rule ``host/path`` fits its host and all subdomains where the path begins with the rule's; the
longest fitting rule decides. The URLs that rules decide are the labelled ones; gradient-boosted
trees learn from them how blocked URLs look and judge the others.

Features: length, depth, digit ratio, character entropy, number of parameters, and suffix
statistics: the share of blocked URLs among the labelled ones with the same last host label, and
with the same file ending. Everything runs as DataFrame operations; the trees are Spark ML's.

The trees are fitted on about ``MAX_LABELLED`` labelled URLs at most, chosen by a hash. The suffix
statistics count all labelled URLs and all their suffixes; others get the overall share.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and is
judged by its features; where the labelled URLs are missing or all of one verdict, that verdict
(or allow) goes to all; repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.session import materialize

MAX_LABELLED = 20_000
SALTS = 16
TREES = 20
DEPTH = 4


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^/?#]*([^?#]*)", 1)


def apply_rules(frame: DataFrame, rules: list[Rule]) -> DataFrame:
    """``frame`` (host, path) with rule and rule_verdict of the longest fitting rule, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = (((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host))
                & F.col("path").startswith(rule.path))
        name = F.when(fits, F.lit(rule.pattern)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return frame.withColumns({"rule": name, "rule_verdict": verdict})


def entropy(text: Column) -> Column:
    """Bits per character of a text's character distribution."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def add(total: Column, c: Column) -> Column:
        share = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), add)


def top_of(host: Column) -> Column:
    """The last host label."""
    return F.element_at(F.split(host, r"\."), -1)


def ending_of(path: Column) -> Column:
    """The file ending, empty where there is none."""
    return F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})/?$", 1)


FEATURES = ["f_length", "f_host_length", "f_depth", "f_digits", "f_entropy", "f_parameters",
            "f_labels", "f_dashes", "f_top_share", "f_ending_share"]


def lexical(frame: DataFrame) -> DataFrame:
    """``frame`` (url_text, host, path) with the lexical features and the two suffixes."""
    url, length = F.col("url_text"), F.length("url_text")

    def count(c: str, of: Column = url) -> Column:
        return (F.length(of) - F.length(F.replace(of, F.lit(c), F.lit("")))).cast("double")

    digits = (length - F.length(F.regexp_replace(url, "[0-9]", ""))).cast("double")
    return frame.withColumns({
        "f_length": length.cast("double"), "f_host_length": F.length("host").cast("double"),
        "f_depth": count("/", F.col("path")),
        "f_digits": digits / F.greatest(length, F.lit(1)),
        "f_entropy": entropy(url),
        "f_parameters": count("&") + count("="),
        "f_labels": count(".", F.col("host")), "f_dashes": count("-"),
        "top": top_of(F.col("host")), "ending": ending_of(F.col("path"))})


def suffix_shares(labelled: DataFrame, column: str, prior: float) -> DataFrame:
    """(column, share) of blocked URLs, drawn towards the overall share for rare suffixes."""
    return (
        labelled.groupBy(column).agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
        .select(column, ((F.col("b") + 5 * prior) / (F.col("n") + 5)).alias(f"f_{column}_share")))


def with_shares(frame: DataFrame, shares: dict[str, DataFrame], prior: float) -> DataFrame:
    """``frame`` with the shares of its suffixes; keys are salted, as one suffix may have most
    rows."""
    frame = frame.withColumn("salt", F.pmod(F.xxhash64("url_text"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    for column, known in shares.items():
        frame = frame.join(known.select("*", salts), [column, "salt"], "left").withColumn(
            f"f_{column}_share", F.coalesce(f"f_{column}_share", F.lit(prior)))
    return frame.drop("salt")


@dataclass
class UrlModel:
    """Trees with the suffix shares they were trained on; without trees, one verdict for all."""

    trees: GBTClassificationModel | None
    shares: dict[str, DataFrame]
    prior: float

    def judge(self, frame: DataFrame) -> DataFrame:
        """``frame`` with p_blocked."""
        if self.trees is None:
            return frame.withColumn("p_blocked", F.lit(self.prior))
        ready = with_shares(lexical(frame), self.shares, self.prior)
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ready)
        return self.trees.transform(ready).withColumn(
            "p_blocked", vector_to_array("probability")[1])


def train(labelled: DataFrame, limit: int = MAX_LABELLED) -> UrlModel:
    """Trees from rows (url_text, host, path, blocked 0/1)."""
    size = labelled.agg(F.count("*"), F.sum("blocked")).first()
    n, blocked = int(size[0]), int(size[1] or 0)
    if not n or blocked in (0, n):
        return UrlModel(None, {}, float(bool(blocked)))
    prior = blocked / n
    share = min(1.0, limit / n)
    sample = labelled.filter(
        F.pmod(F.xxhash64("url_text", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = lexical(sample).persist()
    suffixes = labelled.select("blocked", top_of(F.col("host")).alias("top"),
                               ending_of(F.col("path")).alias("ending"))
    shares = {c: materialize(suffix_shares(suffixes, c, prior), f"shares-{c}")
              for c in ("top", "ending")}
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        with_shares(sample, shares, prior)).select("features", F.col("blocked").cast("double"))
    if ready.select("blocked").distinct().count() < 2:
        sample.unpersist()
        return UrlModel(None, {}, float(round(prior)))
    trees = GBTClassifier(labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, maxBins=32,
                          seed=1).fit(ready)
    sample.unpersist()
    return UrlModel(trees, shares, prior)


def judge_urls(pages: DataFrame, rules: list[Rule], url_column: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, p_blocked and verdict; columns of these names are
    replaced."""
    made = ["host", "path", "rule", "p_blocked", "verdict"]
    inner = pages.toDF(*[f"d{i}" for i in range(len(pages.columns))])
    url = F.col(f"d{pages.columns.index(url_column)}")
    ruled = apply_rules(inner.withColumns({
        "host": host_of(url), "path": path_of(url),
        "url_text": F.coalesce(url, F.lit(""))}), rules)
    labelled = ruled.filter("rule IS NOT NULL").select(
        "url_text", "host", "path",
        F.when(F.col("rule_verdict") == "block", 1).otherwise(0).alias("blocked"))
    judged = train(labelled).judge(ruled)
    verdict = F.coalesce("rule_verdict", F.when(F.col("p_blocked") >= 0.5, "block")
                         .otherwise("allow"))
    own = [(f"d{i}", c) for i, c in enumerate(pages.columns) if c not in made]
    return judged.withColumn("verdict", verdict).select(
        *[F.col(d).alias(c) for d, c in own], *made)
