"""Quality classifier: a generalised additive model with pairwise interactions.

Training is cyclic boosting: in turn, each feature gets a shallow tree over its histogram of residuals, whose leaves are
added, shrunk, to that feature's lookup table; then the pairs whose residuals still show a joint pattern get tables of
their own. A score is the sum of table entries at a document's bins through a logistic function.

Features come from whole texts in Arrow batches. The fit uses at most SAMPLE_ROWS labelled rows, those with the
smallest hash of doc_id, which is the one bounded sample (broadcast: SAMPLE_ROWS ids). Every document is scored.

Nulls and empty texts have all features 0 and a score like any other text. Labels with null quality are not used; of
several labels for one document the largest counts. Without usable labels every score is 0.5. Rows that repeat are
scored each on its own. Columns that the operator adds start with ``gam_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm._common import table
from helixmill.llm._text import PLAIN, gram_hashes, pieces, words_of

SAMPLE_ROWS = 20_000
BINS, ROUNDS, RATE, PAIRS, PAIR_ROUNDS, LEAF_ROWS = 32, 150, 0.1, 6, 60, 20
FEATURES = ["words", "word_bytes", "short_words", "long_words", "symbols", "capitals", "digits", "marks", "shouts", "distinct", "repeats", "lines", "other_bytes"]
REPEAT = 4
PREDICT_AT = 0.3


def byte_flags(chars: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars.encode())] = True
    return flags


KINDS = {"symbols": byte_flags("#*$%&|<>=_~^"), "capitals": byte_flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": byte_flags("0123456789"), "marks": byte_flags(".,;:"), "shouts": byte_flags("!?"), "lines": byte_flags("\n"), "other_bytes": np.arange(256) >= 128}


def distinct_in_rows(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    keys = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    return np.bincount((keys[np.concatenate([[True], keys[1:] != keys[:-1]])] >> np.uint64(40)).astype(np.int64), minlength=n) if len(keys) else np.zeros(n, np.int64)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    words, n = words_of(column, PLAIN), len(column)
    rows, lengths, hashes = words.rows(), words.ends - words.starts, words.hashes()
    count = words.counts()
    sums = lambda x: np.bincount(rows, x, minlength=n)
    per_word = lambda x: x / np.maximum(count, 1)
    out = {"words": np.log1p(count), "word_bytes": per_word(sums(lengths)), "short_words": per_word(sums(lengths <= 3)), "long_words": per_word(sums(lengths >= 12))}
    for name, flags in KINDS.items():
        upto = np.concatenate([[0], np.cumsum(flags[words.raw])])
        out[name] = per_word(np.diff(upto[words.offsets]))
    out["distinct"] = per_word(distinct_in_rows(hashes, rows, n))
    grams = gram_hashes(hashes, REPEAT)
    whole = rows[: len(grams)] == rows[REPEAT - 1 :]
    out["repeats"] = 1 - distinct_in_rows(grams[whole], rows[: len(grams)][whole], n) / np.maximum(count - REPEAT + 1, 1)
    out["repeats"][count < REPEAT] = 0
    return np.stack([out[x] for x in FEATURES], 1) if n else np.zeros((0, len(FEATURES)))


@dataclass
class Gam:
    bounds: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(b, x[:, j], "right") for j, b in enumerate(self.bounds)]

    def logits(self, bins: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(bins[0]), self.base)
        for values, at in zip(self.tables, bins, strict=True):
            total += values[at]
        for (a, b), values in self.pairs.items():
            total += values[bins[a], bins[b]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(self.bins(x))))


def cuts(grad: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int) -> list[int]:
    """Where a tree of so many leaves splits a histogram: always the cut that gains most."""
    g, w, n = (np.concatenate([[0], np.cumsum(v)]) for v in (grad, weight, rows))
    edges = [0, len(grad)]
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            c = np.arange(a + 1, b)
            c = c[(n[c] - n[a] >= LEAF_ROWS) & (n[b] - n[c] >= LEAF_ROWS)]
            if len(c):
                gains = gain_of(a, c) + gain_of(c, b) - gain_of(a, b)
                k = int(np.argmax(gains))
                best = max(best, (float(gains[k]), int(c[k])), key=lambda t: t[0])
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    return edges


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    n, k = x.shape
    rate = float(np.clip(y.mean(), 0.01, 0.99)) if n else 0.5
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    model = Gam(bounds, float(np.log(rate / (1 - rate))), [np.zeros(len(b) + 1) for b in bounds])
    if n == 0 or y.min() == y.max():
        return model
    bins = model.bins(x)
    logit = model.logits(bins)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    for _ in range(ROUNDS):
        for j in range(k):
            g, w = residuals()
            hist_g, hist_w = (np.bincount(bins[j], v, minlength=len(model.tables[j])) for v in (g, w))
            step = np.zeros(len(hist_g))
            for a, b in zip(*(lambda e: (e[:-1], e[1:]))(cuts(hist_g, hist_w, sizes[j], 3)), strict=True):
                step[a:b] = RATE * hist_g[a:b].sum() / (hist_w[a:b].sum() + 1)
            model.tables[j] += step
            logit += step[bins[j]]
    g, w = residuals()
    gains = []
    for a in range(k):
        for b in range(a):
            cell, shape = bins[a] * len(model.tables[b]) + bins[b], len(model.tables[a]) * len(model.tables[b])
            gains.append((float((np.bincount(cell, g, shape) ** 2 / (np.bincount(cell, w, shape) + 1)).sum()) / shape**0.5, a, b))
    for _, a, b in sorted(gains, reverse=True)[:PAIRS]:
        model.pairs[a, b] = np.zeros((len(model.tables[a]), len(model.tables[b])))
    for _ in range(PAIR_ROUNDS):
        for (a, b), values in model.pairs.items():
            g, w = residuals()
            cell = bins[a] * values.shape[1] + bins[b]
            grid_g, grid_w, grid_n = (np.bincount(cell, v, values.size).reshape(values.shape) for v in (g, w, np.ones(n)))
            step, rows = np.zeros(values.shape), cuts(grid_g.sum(1), grid_w.sum(1), grid_n.sum(1), 2)
            for r0, r1 in zip(rows[:-1], rows[1:], strict=True):
                cols = cuts(grid_g[r0:r1].sum(0), grid_w[r0:r1].sum(0), grid_n[r0:r1].sum(0), 2)
                for c0, c1 in zip(cols[:-1], cols[1:], strict=True):
                    step[r0:r1, c0:c1] = RATE * grid_g[r0:r1, c0:c1].sum() / (grid_w[r0:r1, c0:c1].sum() + 1)
            model.pairs[a, b] = values + step
            logit += step[bins[a], bins[b]]
    return model


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        x = features(piece.column("text"))
        yield pa.record_batch([piece.column("gam_label").cast(pa.float64()), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["gam_label", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Gam:
    """labels: doc_id and gam_label (0 or 1)."""
    usable = labels.where(F.col("gam_label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("gam_label").alias("gam_label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.col("gam_label").cast("double"))
    found = rows.mapInArrow(featurise, "gam_label double, " + ", ".join(f"{x} double" for x in FEATURES)).toArrow()
    data = np.stack([found.column(c).to_numpy() for c in found.column_names], 1) if found.num_rows else np.zeros((0, len(FEATURES) + 1))
    data = data[np.lexsort(data.T)]  # the order in which rows arrive must not matter
    return fit(data[:, 1:], data[:, 0])


def scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            keep = [n for n in piece.schema.names if n not in ("gam_score", "text")]
            yield pa.record_batch([*(piece.column(n) for n in keep), pa.array(model.value.scores(features(piece.column("text"))))], [*keep, "gam_score"])

    return run


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """docs, text left out, with gam_score."""
    rows = docs.drop("gam_score")
    out = rows.drop("text").withColumn("gam_score", F.lit(0.0))
    return rows.mapInArrow(scorer(docs.sparkSession.sparkContext.broadcast(model)), out.schema)


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("gam_label"))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("gam_score").alias("score"), (F.col("gam_score") >= PREDICT_AT).cast("int").alias("predicted"))
