"""Which rows, lines and words go: expectation-maximisation and the pipeline's stages against brute force."""

import math
import random
import re

import pytest

import corpus_pipeline
from helixmill.llm import quality_rules as qr

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS).repartition(3)


def plain_em(votes, believed):
    """EM row by row: votes are lists of 0, 1 or None."""
    prior, rates = qr.PRIOR, believed
    while True:
        odds = lambda v: math.log(prior / (1 - prior)) + sum(math.log(rates[k][x][0] / rates[k][x][1]) for k, x in enumerate(v) if x is not None)
        p = [1 / (1 + math.exp(-odds(v))) for v in votes]
        extra = qr.WEIGHT * len(votes)
        of_good = sum(p)
        new_prior = (of_good + extra * qr.PRIOR) / (len(votes) + extra)
        new = [{x: tuple((sum(w if j == 0 else 1 - w for w, v in zip(p, votes) if v[k] == x) + extra * believed[k][x][j]) / ((of_good if j == 0 else len(votes) - of_good) + extra) for j in (0, 1)) for x in (0, 1)} for k in range(len(believed))]
        moved = max([abs(new_prior - prior), *(abs(a - b) for o, n in zip(rates, new) for x in o for a, b in zip(o[x], n[x]))])
        prior, rates = new_prior, new
        if moved < qr.SETTLED:
            return prior, rates


def test_em_against_plain_rows(spark):
    rng = random.Random(8)
    believed = {"a": {0: (0.02, 0.2), 1: (0.85, 0.7)}, "b": {0: (0.001, 0.5), 1: (0.9, 0.5)}, "c": {0: (0.1, 0.3), 1: (0.5, 0.4)}}
    rows = []
    for _ in range(400):
        good = rng.random() < 0.7
        rows.append([rng.choice([None, 1]) if rng.random() < (0.9 if good else 0.3) else 0 for _ in believed])
    prior, rates = qr.fit_votes(spark.createDataFrame(rows, "a int, b int, c int"), list(believed), believed)
    want_prior, want = plain_em(rows, list(believed.values()))
    assert prior == pytest.approx(want_prior)
    for got, plain in zip(rates, want, strict=True):
        assert {x: pytest.approx(v) for x, v in plain.items()} == got


def test_posterior_and_verdict_follow_the_model(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["word", "Other", "#", "x9", "again again"]) for _ in range(rng.randint(0, 80))) for _ in range(80)] + ["fine words of a plain text that nobody would reject " * 4, "# $ % & " * 20]
    features = qr.with_features(docs_of(spark, texts).select("doc_id", "text"))
    model = qr.fit(features)
    cast = features.withColumns(qr.votes()).select("doc_id", *qr.votes()).collect()
    judged = {r.doc_id: r for r in qr.judged(features, model).collect()}
    for r in cast:
        odds = math.log(model[0] / (1 - model[0])) + sum(math.log(rate[x][0] / rate[x][1]) for x, rate in zip(r[1:], model[1], strict=True) if x is not None)
        got = judged[r.doc_id]
        assert got.posterior == pytest.approx(1 / (1 + math.exp(-odds))) and got.kept == (not got.base_failed and got.posterior >= qr.KEEP_AT)
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs_of(spark, texts), "").collect()}
    assert kept == {d for d, r in judged.items() if r.kept}


def test_lines_that_go(spark):
    rng = random.Random(4)
    shared = [f"License line number {k} of the many that all documents share." for k in range(4)]
    texts = ["\n".join(rng.choice([*shared, f"own line {k} {rng.random()}", " " + shared[0].upper() + " ", "short"]) for _ in range(8)) for k in range(40)]
    key = lambda line: line.strip(" \t\n\v\f\r").lower()
    holders: dict[str, set[int]] = {}
    for d, t in enumerate(texts):
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(d)
    goes = lambda d, line: len(key(line)) >= 40 and len(holders[key(line)]) >= 5 and d != max(holders[key(line)])
    want = {d: "\n".join(x for x in t.split("\n") if not goes(d, x)) for d, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs_of(spark, texts), "").collect()} == want


def test_near_copies_that_go(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randint(0, 10_000)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 5)):
            texts.append(" ".join(w if rng.random() > 0.02 else "changed" for w in words))
    texts += ["", "one", "one", "ONE"]
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(len(texts)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] > root[b]:
                    root[a], changed = root[b], True
    want = {d for d in range(len(texts)) if root[d] == d}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(spark, texts), "").collect()} == want


def test_benchmark_words_that_go(spark, tmp_path):
    rng = random.Random(6)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [" ".join(f"q{rng.randint(0, 60)}" for _ in range(n)) for n in (12, 10, 25, 3)]
    texts = ["before words " + rng.choice(items) + ", and after " + " ".join(f"q{rng.randint(0, 60)}" for _ in range(30)) for _ in range(30)] + ["clean text", "", items[2][:60].upper()]
    spark.createDataFrame([(str(k), t) for k, t in enumerate(items)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    windows = set()
    for t in items:
        w = word.findall(t.lower())
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)}
    for r in corpus_pipeline.leaks(spark, docs_of(spark, texts), str(tmp_path)).collect():
        w = word.findall(texts[r.doc_id].lower())
        hit = [False] * len(w)
        for x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit[k : k + len(x)] = [True] * len(x)
        assert word.findall((r.text or "").lower()) == [x for x, h in zip(w, hit) if not h], texts[r.doc_id]
        assert any(hit) or r.text == texts[r.doc_id]


def test_stages_with_clashing_columns(spark, tmp_path):
    """Columns of any name come through every stage as they were."""
    from pyspark.sql import functions as F

    names = ["_row", "_qpart", "_jk", "_jid", "jac_key", "jac_row", "line_key", "line_drop", "line_none", "leak_row", "fm_spans", "n_words", "kept", "posterior", "fm_words", "n", "key", "h"]
    docs = docs_of(spark, ["here is one text of many plain words that goes quietly along for some while so each rule should be content with what they find below", "another one quite unlike the first in all its parts and also long enough that it may pass whatever else gets asked from such pages"])
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    spark.createDataFrame([("1", "nothing of this kind")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, step in corpus_pipeline.STAGES[:4]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) == 2 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
