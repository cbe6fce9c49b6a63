"""Quality rules as weak supervision: every rule votes good (1), bad (0) or abstains (null); expectation-maximisation
over the counts of vote patterns estimates how accurate each rule is and how common good documents are; a document is
kept by its posterior probability, not by passing all rules.

Only DataFrame functions. What EM iterates over is the table of vote patterns, at most 3**rules rows however many
documents there are; each iteration is one aggregation that returns one row of sums.

Nulls and empty texts have no words and fail the base rules. ``with_features`` and ``judged`` add columns by plain names,
which replace input columns of those names; ``keep_good`` packs its rows first, so that all columns come through. An
empty table gives an empty result (EM then keeps its starting values).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm._common import SPACE_CLASS, discard, let, stage, table

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Cut points of the rules: (feature, good when, bad when); between the two a rule abstains.
RULES = {
    "length": (lambda f: f("n_words") >= 50, lambda f: f("n_words") < MIN_WORDS),
    "word_size": (lambda f: f("word_chars").between(3 * f("n_words"), 6 * f("n_words")), lambda f: (f("word_chars") > 7 * f("n_words")) | (2 * f("word_chars") < 5 * f("n_words"))),
    "symbols": (lambda f: 50 * f("n_symbols") < f("n_words"), lambda f: 4 * f("n_symbols") > f("n_words")),
    "repeats": (lambda f: 20 * f("n_repeat_words") < f("n_words"), lambda f: 5 * f("n_repeat_words") > f("n_words")),
    "lines": (lambda f: 10 * f("n_dup_lines") < f("n_lines"), lambda f: 2 * f("n_dup_lines") > f("n_lines")),
    "capitals": (lambda f: 10 * f("n_caps") < f("word_chars"), lambda f: 2 * f("n_caps") > f("word_chars")),
    "variety": (lambda f: 2 * f("n_distinct") > f("n_words"), lambda f: 3 * f("n_distinct") < f("n_words")),
}
KEEP_AT, PRIOR, SETTLED = 0.5, 0.85, 1e-3
#: What is believed before any data of a rule's votes: P(vote | good), P(vote | bad) for votes bad (0) and good (1). It
#: weighs as much as this part of the rows: rules that speak of the same thing err together, and with less belief the
#: hidden class becomes what most of these share instead of quality.
BELIEVED = {name: {0: (0.02, 0.2), 1: (0.85, 0.7)} for name in RULES} | {"symbols": {0: (0.001, 0.5), 1: (0.9, 0.5)}}
WEIGHT = 0.1


def repeat_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of size words (a power of two) that an array holds twice or more, given the words' hashes."""
    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def union(at: Column) -> Column:
            return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("end")), lambda a, p: F.struct((a["n"] + size - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + size).alias("end")), lambda a: a["n"])
        def twice(s: Column) -> Column:
            same = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]))
            return let(F.sort_array(F.transform(same, lambda x: x["i"])), union)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, twice))

    def windows(hashes: Column, span: int) -> Column:  # hashes of span words each, doubled until they cover a window
        if span == size:
            return let(F.slice(hashes, 1, F.size(hashes) - (size - 1)), covered)
        return let(F.zip_with(hashes, F.slice(hashes, span + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b)), lambda h: windows(h, 2 * span))

    many = windows(words, 1)
    return F.when(F.size(words) > size, many).otherwise(F.lit(0))


def with_features(docs: DataFrame) -> DataFrame:
    """docs with the counts that the rules read, all over the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE_CLASS + "+"), "")
    with_words = docs.withColumn("_qwords", words).withColumn("_qlines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return with_words.withColumn("_qhash", F.transform("_qwords", lambda w: F.xxhash64(w))).withColumns({
        "n_words": F.size("_qwords").cast("long"),
        "word_chars": F.char_length(F.array_join("_qwords", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_caps": F.regexp_count(text, F.lit(r"[A-Z]")).cast("long"),
        "n_distinct": F.size(F.array_distinct("_qhash")).cast("long"),
        "n_lines": F.size("_qlines").cast("long"),
        "n_dup_lines": (F.size("_qlines") - F.size(F.array_distinct("_qlines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_qhash")).cast("long"),
    }).drop("_qwords", "_qhash", "_qlines")


def votes() -> dict[str, Column]:
    return {f"_qv_{name}": F.when(bad(F.col), F.lit(0)).when(good(F.col), F.lit(1)) for name, (good, bad) in RULES.items()}


def log_odds(prior: float, rates: list[dict], names: list[str]) -> Column:
    """Log odds of good given the votes; a rule that abstains says nothing. rates: for each rule P(vote | good) and
    P(vote | bad) of votes 0 and 1."""
    parts = [F.coalesce(*[F.when(F.col(v) == vote, F.lit(math.log(g / b))) for vote, (g, b) in rate.items()], F.lit(0.0)) for v, rate in zip(names, rates, strict=True)]
    return reduce(lambda a, b: a + b, parts, F.lit(math.log(prior / (1 - prior))))


def fit_votes(voted: DataFrame, names: list[str], believed: dict[str, dict]) -> tuple[float, list[dict]]:
    """Prior and rates by EM, until none moves by SETTLED; given the class, rules err independently. A rule may turn out
    to vote against itself."""
    patterns = stage(voted.groupBy(*names).agg(F.count("*").alias("n")), "votes")
    prior, rates = PRIOR, [believed[v] for v in names]
    moved = 1.0
    while moved >= SETTLED:
        good = 1 / (1 + F.exp(-log_odds(prior, rates, names)))
        sums = [F.coalesce(F.sum(F.when(F.col(v) == vote, F.col("n") * w)), F.lit(0.0)) for v in names for vote in (0, 1) for w in (F.col("p"), 1 - F.col("p"))]
        row = patterns.withColumn("p", good).agg(F.sum(F.col("n") * F.col("p")), F.sum("n"), *sums).first()
        if not row[1]:
            break
        of_good, all_rows, old, rates = row[0], row[1], rates, []
        extra = WEIGHT * all_rows
        before, prior = prior, (of_good + extra * PRIOR) / (all_rows + extra)
        for k in range(len(names)):
            rate = {}
            for vote in (0, 1):
                g, b = ((row[2 + 4 * k + 2 * vote + j] + extra * believed[names[k]][vote][j]) / (total + extra) for j, total in enumerate((of_good, all_rows - of_good)))
                rate[vote] = (g, b)
            rates.append(rate)
        moved = max([abs(prior - before), *(abs(x - y) for a, b in zip(old, rates, strict=True) for vote in a for x, y in zip(a[vote], b[vote], strict=True))])
    return prior, rates


def judged(features: DataFrame, model: tuple[float, list[dict]]) -> DataFrame:
    """base_failed, posterior and kept for rows with features."""
    cast = votes()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = features.withColumns(cast).withColumn("posterior", 1 / (1 + F.exp(-log_odds(*model, list(cast))))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_AT)).drop(*cast)


def fit(features: DataFrame) -> tuple[float, list[dict]]:
    return fit_votes(features.withColumns(votes()), list(votes()), {f"_qv_{k}": v for k, v in BELIEVED.items()})


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = stage(with_features(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "features")
    return judged(features, fit(features)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that the rules reject go. Features are made twice, to fit and to judge, which
    moves no text; a join of judgements with texts would move them all. The filter reads a column that has no fixed
    value, the partition, so that it stays above the features instead of repeating them for each use below. Columns of docs travel in one struct, so none clashes."""
    features = with_features(docs.select("doc_id", "text")).drop("text")
    features = stage(features, "features")
    model = fit(features)
    discard(features)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), F.col("text"))
    made = with_features(packed).withColumn("_qpart", F.spark_partition_id())
    return judged(made, model).where("kept AND _qpart >= 0").select("_row.*")
