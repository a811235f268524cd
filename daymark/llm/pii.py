"""Personal data by candidate boosting, in DataFrame operations only.

Strict patterns with checks (``base``) give certain spans. High-recall generators propose further,
overlapping spans: e-mail addresses written with spaces or words for the signs, and digit groups
that may be an address, a card or a phone number. Gradient-boosted trees score each proposal from
its format (length, digits, separators, brackets) and its context (neighbouring characters, words
before it).

They learn from all documents, which the hash of their text deals into two halves. Positives are
base spans rewritten, in their context, into the loose forms the generators are there for: worded or spaced signs, no plus,
other separators. Negatives are clear non-data: proposals that lie in a base span of another kind,
that cannot be one of their kind, that hang on a letter, or that a word before them names as some
other number. All other proposals are what the trees are to decide and are in neither class. The
trees are fitted on the first half; for every kind the threshold is the lowest probability from
which all examples of the second half reach ``PRECISION``; a kind that never does adds nothing.
The patterns run over the documents once: what examples need is stored with the proposals. Proposals above it that pass their kind's check
and overlap no base span are added, the likeliest first.

Patterns are written so that Java's matcher neither recurses nor restarts inside a run it has
already rejected; matches are those of the plain patterns.

Defined results: null text is empty; repeated rows are searched each; where no proposals or only
one class is seen in training, only base spans are returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.session import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns. A run is entered at its start or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of proposals.
WIDE = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++(?:\x20?(?:@|\(at\)|\[at\])\x20?)[A-Za-z0-9-]++"
              r"(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++"),
    "digits": r"(?<![0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
}
#: Words before a span that speak for a kind.
CONTEXT = {
    "email": r"mail|contact|write", "ip": r"\bip\b|server|host|addr",
    "card": r"card|visa|credit|pay", "phone": r"tel|phone|call|fax|mobil"}
#: Code points on each side of a base span that its examples keep.
AROUND = 40
#: Words before a number that name it as none of these.
OTHER_NUMBER = (r"order|invoice|\bid\b|\bref|number|\bno\b|isbn|version|\bdate|serial|ticket|total"
                r"|item|part")
BEFORE = 24
PRECISION = 0.99
#: Proposals of a kind that the second half must show before it gets a threshold.
MIN_SEEN = 50
TREES, DEPTH = 15, 4

_SPAN = "struct<s:int,e:int,m:string>"


def _found(cut: Column, hit: Column) -> Column:
    """Places of matches: the pieces between them and the matches themselves, added up."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def add(state: Column, part: Column) -> Column:
        s = state["pos"] + F.length(part["0"])
        e = s + F.coalesce(F.length(part["1"]), F.lit(0))
        span = F.struct(s.alias("s"), e.alias("e"), part["1"].alias("m"))
        return F.struct(e.alias("pos"), F.when(part["1"].isNull(), state["out"]).otherwise(
            F.concat(state["out"], F.array(span))).alias("out"))

    zipped = F.transform(F.arrays_zip(cut, hit), lambda z: F.struct(
        z["cut"].alias("0"), z["hit"].alias("1")))
    return F.aggregate(zipped, start, add, lambda state: state["out"])


def spans_of(frame: DataFrame, column: str, pattern: str, name: str) -> DataFrame:
    """``frame`` with the matches of a pattern, as (start, end, match) in code points."""
    text = F.col(column)
    cut = frame.withColumns({"cut": F.split(text, pattern, -1),
                             "hit": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))})
    return cut.withColumn(name, _found(F.col("cut"), F.col("hit"))).drop("cut", "hit")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def is_valid(kind: str, m: Column) -> Column:
    """The base check of a match."""
    digits = _digits(m)
    if kind == "ip":
        # a part of over 255 has a fourth digit after its leading zeros, or is 256 to 999
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(
            "^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def is_possible(kind: str, m: Column) -> Column:
    """The check of a loose form: its digits are those of a valid one."""
    if kind == "ip":
        parts = F.split(F.regexp_replace(m, r"^[+(]", ""), "[^0-9]+")
        return (F.size(parts) == 4) & F.forall(parts, lambda p: F.length(p).between(1, 3)
                                               & (p.cast("int") <= 255))
    return is_valid(kind, m)


def loose_form(kind: str, m: Column, draw: Column) -> Column:
    """A strict match written loosely, one of four ways by ``draw`` (0 to 3)."""
    digits = _digits(m)

    def one_of(*ways: Column) -> Column:
        out = ways[-1]
        for i, way in enumerate(ways[:-1]):
            out = F.when(draw == i, way).otherwise(out)
        return out

    def grouped(size: int, sign: str) -> Column:
        return F.regexp_replace(digits, rf"([0-9]{{{size}}})(?=[0-9])", f"$1{sign}")

    if kind == "email":
        local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)

        def signs(at: str, dot: str) -> Column:
            return F.concat(local, F.lit(at), F.replace(domain, F.lit("."), F.lit(dot)))

        return one_of(signs(" (at) ", " (dot) "), signs("[at]", "[dot]"), signs(" @ ", "."),
                      signs(" [at] ", " (dot) "))
    if kind == "phone":
        bare = F.regexp_replace(m, r"^\+", "")
        return one_of(bare, grouped(3, " "), grouped(3, "-"), grouped(3, "."))
    if kind == "card":
        return one_of(grouped(4, "."), grouped(4, "  "), grouped(4, "- "), grouped(4, " -"))
    return one_of(*[F.replace(m, F.lit("."), F.lit(sign)) for sign in (" .", ". ", "-", " ")])


def listing(spans: Column) -> Column:
    """kind:start:end of spans (s, k, e), by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


FORMAT = ["length", "digits", "spaces", "dots", "dashes", "brackets", "plus", "at", "at_word",
          "zero_first", "parts", "prev", "next", "near_other"]
FEATURES = [*FORMAT, *[f"near_{k}" for k in KINDS], *[f"is_{k}" for k in KINDS]]


def _features(text: Column, x: Column, kind: int) -> list[Column]:
    """Format and context of a span, as doubles in the order of FEATURES."""
    m = x["m"]

    def count(pattern: str) -> Column:
        return F.length(m) - F.length(F.regexp_replace(m, pattern, ""))

    def side(c: Column) -> Column:
        return (F.when(c == "", 0).when(c.rlike("^[0-9]$"), 1).when(c.rlike("^[A-Za-z]$"), 2)
                .when(c.rlike(r"^[\x20\n\t]$"), 3).otherwise(4))

    before = F.lower(F.substring(text, F.greatest(x["s"] - BEFORE, F.lit(0)) + 1,
                                 F.least(x["s"], F.lit(BEFORE))))
    values = [
        F.length(m), count("[0-9]"), count(r"\x20"), count(r"\."), count("-"), count("[()]"),
        m.startswith("+").cast("int"), count("@"), m.rlike(r"at[\])]").cast("int"),
        _digits(m).startswith("0").cast("int"), F.size(F.split(m, "[^0-9A-Za-z]+")),
        F.when(x["s"] == 0, 0).otherwise(side(F.substring(text, x["s"], F.lit(1)))),
        side(F.substring(text, x["e"] + 1, F.lit(1))),
        before.rlike(OTHER_NUMBER).cast("int"),
        *[before.rlike(CONTEXT[k]).cast("int") for k in KINDS],
        *[F.lit(int(i == kind)) for i in range(len(KINDS))]]
    return [v.cast("double") for v in values]


def _with_base(frame: DataFrame) -> DataFrame:
    """``frame`` (body) with base (spans s, k, e) and the matches of all patterns."""
    for kind in KINDS:
        frame = spans_of(frame, "body", PATTERNS[kind], f"base_{kind}")
    for name, pattern in WIDE.items():
        frame = spans_of(frame, "body", pattern, f"wide_{name}")

    def checked(i: int, kind: str) -> Column:
        return F.transform(
            F.filter(f"base_{kind}", lambda x: is_valid(kind, x["m"])),
            lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))

    return frame.withColumn("base", F.concat(*[checked(i, k) for i, k in enumerate(KINDS)]))


def _proposals() -> Column:
    """Proposals (s, k, e, taken, own, ok, hangs, f) of a frame with base: taken and own tell
    whether one overlaps a base span, of any kind and of its own, ok whether it can be of its kind,
    hangs whether a letter or digit touches it; f are its features."""
    sources = [("wide_email", 0), ("base_ip", 1), ("wide_digits", 1), ("wide_digits", 2),
               ("wide_digits", 3)]

    def proposal(i: int):
        def make(x: Column) -> Column:
            f = F.array(*_features(F.col("body"), x, i))
            sides = [F.get(f, F.lit(FEATURES.index(n))) for n in ("prev", "next")]
            return F.struct(
                x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"),
                F.exists("base", lambda b: _overlaps(b, x)).alias("taken"),
                F.exists("base", lambda b: (b["k"] == i) & _overlaps(b, x)).alias("own"),
                is_possible(KINDS[i], x["m"]).alias("ok"),
                (sides[0].isin(1.0, 2.0) | sides[1].isin(1.0, 2.0)).alias("hangs"), f.alias("f"))
        return make

    return F.concat(*[F.transform(c, proposal(i)) for c, i in sources])


_MATCHES = [f"base_{k}" for k in KINDS] + [f"wide_{k}" for k in WIDE]


def facts(docs: DataFrame, text_column: str) -> DataFrame:
    """``docs`` without its text, with base (spans s, k, e), the proposals that overlap no base
    span of their own kind, strict (base spans as k, before, m, after, the text and its
    surroundings) and first, whether the document is in the first half."""
    frame = docs.withColumn("body", F.coalesce(F.col(text_column), F.lit("")))
    if text_column != "body":
        frame = frame.drop(text_column)
    body = F.col("body")

    def around(b: Column) -> Column:
        return F.struct(
            b["k"].alias("k"), F.substring(body, F.greatest(b["s"] - AROUND, F.lit(0)) + 1,
                                           F.least(b["s"], F.lit(AROUND))).alias("before"),
            F.substring(body, b["s"] + 1, b["e"] - b["s"]).alias("m"),
            F.substring(body, b["e"] + 1, F.lit(AROUND)).alias("after"))

    million = 1_000_000
    frame = _with_base(frame).withColumns({
        "proposals": F.filter(_proposals(), lambda p: ~p["own"]),
        "strict": F.transform("base", around),
        "first": F.pmod(F.xxhash64("body", F.lit(5)), F.lit(million)) < million // 2})
    return frame.drop("body", *_MATCHES)


def examples(found: DataFrame) -> DataFrame:
    """(first, k, y, ok, f) from the facts of documents: loose forms and clear non-data."""
    near_other = FEATURES.index("near_other")
    negative = found.select("first", F.explode("proposals").alias("p")).select("first", "p.*").filter(
        (F.col("taken") & ~F.col("own"))
        | (~F.col("taken") & (~F.col("ok") | F.col("hangs") | (F.col("f")[near_other] > 0)))
    ).select("first", "k", F.lit(0).alias("y"), "ok", "f")
    strict = found.select("first", F.explode("strict").alias("b")).select("first", "b.*")
    draw = F.pmod(F.xxhash64("m", "before"), F.lit(4))
    form = reduce(lambda c, ik: c.when(F.col("k") == ik[0], loose_form(ik[1], F.col("m"), draw)),
                  enumerate(KINDS), F.when(F.lit(False), F.col("m")))
    loose = strict.withColumn("form", form).select(
        "first", F.col("k").alias("kind"), F.length("before").alias("from"),
        (F.length("before") + F.length("form")).alias("to"),
        F.concat("before", "form", "after").alias("body"))
    shown = _with_base(loose).select(
        "first", "kind", "from", "to", F.explode(_proposals()).alias("p")).select(
        "first", "kind", "from", "to", "p.*")
    # A form that is strict again, or found with more or less around it, is no example.
    planted = shown.filter((F.col("s") == F.col("from")) & (F.col("e") == F.col("to"))
                           & ((F.col("k") != F.col("kind")) | (F.col("ok") & ~F.col("own"))))
    return negative.unionByName(planted.select(
        "first", "k", (F.col("k") == F.col("kind")).cast("int").alias("y"), "ok", "f"))


def _vectors(proposals: DataFrame) -> DataFrame:
    named = proposals.select("*", *[F.col("f")[i].alias(n) for i, n in enumerate(FEATURES)])
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(named).drop(
        *FEATURES)


def train(found: DataFrame) -> tuple[GBTClassificationModel | None, dict[int, float]]:
    """Trees from the first half of the documents' facts and the threshold of each kind from the
    second; the halves share no text."""
    shown = _vectors(materialize(examples(found), "pii-examples")).persist()
    if shown.filter("first").select("y").distinct().count() < 2:
        shown.unpersist()
        return None, {}
    trees = GBTClassifier(labelCol="y", maxIter=TREES, maxDepth=DEPTH, seed=1).fit(
        shown.filter("first").select("features", F.col("y").cast("double")))
    # At most kinds times 101 rows.
    bins = (trees.transform(shown.filter("NOT first AND ok"))
            .select("k", F.floor(vector_to_array("probability")[1] * 100).alias("bin"), "y")
            .groupBy("k", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("good")).collect())
    shown.unpersist()
    return trees, {k: t for k in range(len(KINDS))
                   if (t := _threshold([(r["bin"], r["n"], r["good"]) for r in bins
                                        if r["k"] == k])) is not None}


def _threshold(bins: list[tuple[int, int, int]]) -> float | None:
    """Lowest bin from which on the precision holds at every higher bin too."""
    n = good = 0
    best = None
    for at, here, right in sorted(bins, reverse=True):
        n, good = n + here, good + right
        if good < PRECISION * n:
            break
        if n >= MIN_SEEN:
            best = at / 100
    return best


def added_spans(found: DataFrame, trees: GBTClassificationModel | None,
                thresholds: dict[int, float]) -> DataFrame:
    """(row_key, added) of rows with spans that the trees add."""
    open_ = found.select("row_key", F.explode("proposals").alias("p")).select(
        "row_key", "p.*").filter("ok AND NOT taken").select("row_key", "s", "k", "e", "f")
    if trees is None or not thresholds:
        return open_.select("row_key", F.array().cast("array<struct<s:int,k:int,e:int>>")
                            .alias("added")).limit(0)
    limit = reduce(lambda c, kt: c.when(F.col("k") == kt[0], F.lit(kt[1])),
                   thresholds.items(), F.when(F.lit(False), F.lit(2.0))).otherwise(2.0)
    scored = trees.transform(_vectors(open_)).withColumn(
        "p", vector_to_array("probability")[1]).filter(F.col("p") >= limit)
    ranked = scored.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("p")).alias("o"), "s", "k", "e"))).alias("ranked"))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return ranked.select("row_key", F.aggregate("ranked", none, lambda kept, x: F.when(
        F.exists(kept, lambda b: _overlaps(b, x)), kept).otherwise(F.concat(kept, F.array(F.struct(
            x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))))).alias("added"))


def find_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without its text, with base and spans: arrays of (s, k, e), k numbering KINDS.

    Columns of ``docs`` named like these are replaced.
    """
    own = [c for c in docs.columns if c not in (text_column, "base", "spans")]
    inner = docs.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(own)],
                        F.col(text_column).alias("text"))
    found = materialize(facts(inner, "text").withColumn(
        "row_key", F.monotonically_increasing_id()), "pii-facts")
    added = added_spans(found, *train(found))
    joined = found.drop("proposals", "strict", "first").join(added, "row_key", "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return joined.select(
        *[F.col(f"d{i}").alias(c) for i, c in enumerate(own)], "base",
        F.concat("base", F.coalesce("added", none)).alias("spans"))


def count_kind(spans: Column, kind: str) -> Column:
    at = KINDS.index(kind)
    return F.size(F.filter(spans, lambda x: x["k"] == at)).cast("bigint")
