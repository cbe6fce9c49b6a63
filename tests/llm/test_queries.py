"""The registered queries on small tables of their own: contract columns against SQL or brute force, odd rows, no rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import texts

from helixmill.llm import pii, quality_gam, registry, sharding
from helixmill.llm.registry import ORACLE_SQL, QUERIES

#: Names that operators or their results use themselves.
CLASHING = ["shard", "slot", "curve", "size", "n_words", "n_hit", "kept", "text_crc32", "jac_key", "n", "cid", "a", "b", "key", "drop", "line_key", "rlz_key", "pii_key", "fm_words", "gam_label", "sp_ids", "posterior", "file"]
PII_TEXTS = ["mail x.y@z.org, 10.0.0.1 and host 10.0.0.2", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (202) 555-0123; 1.2.3.4.5 and 999.1.1.1", "a@b a@b.c @ +12 12 12 ++1234567890", "token = \"0123456789abcdef0123456789abcdef\""]


def long_text():
    rng = random.Random(11)
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(0, 400_000, 20)] + [f"w{k}" for k in range(400)]
    return "\n".join(" ".join(rng.choices(words, k=150)) for _ in range(12_000))[:10_000_000]


def vectors(n, seed):
    rng = random.Random(seed)
    few = [[rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)] for _ in range(5)]
    odd = [None, [], [1.0], [float("inf"), 1.0], [1.0, None], [3e38, 1.0]]
    return [(rng.choice([rng.randint(0, 900), 100 * rng.randint(0, 9)]), rng.choice([rng.choice(few), few[0], [rng.gauss(0, 1) for _ in range(5)], rng.choice(odd)]), rng.choice([0, 0, 1, 2, 9, None, -3])) for _ in range(n)]


def put(spark, rows, schema, path, clashing=True):
    df = spark.createDataFrame(rows, schema)
    df.select("*", *[F.lit("x").alias(c) for c in CLASHING if clashing and c not in df.columns]).repartition(3).write.parquet(path)


def tables(spark, folder, docs, pages, bench, labels, vectors=()):
    put(spark, list(vectors), "vec_id bigint, embedding array<float>, label int", f"{folder}/embeddings.parquet")
    put(spark, docs, "doc_id bigint, text string, lang string, source string, n_chars int", f"{folder}/documents.parquet")
    put(spark, pages, "page_id bigint, url string, html string", f"{folder}/pages.parquet")
    put(spark, bench, "item_id string, text string", f"{folder}/benchmark.parquet", False)
    put(spark, labels, "doc_id bigint, quality int, toxic int", f"{folder}/labels.parquet", False)
    return str(folder)


@pytest.fixture(scope="module")
def bodies():
    found = texts() + PII_TEXTS
    return [(k, t, ["en", "de", None][k % 3], f"https://host.example/{k % 9 // 4}", None) for k, t in enumerate(found)]


@pytest.fixture(scope="module")
def plain(spark, bodies, tmp_path_factory):
    html = [(k, f"http://u/{k}", None if k % 7 == 0 else ("<p>same é</p>" * 20 if k % 3 == 0 else f"<p>{'own ' * (k % 50)}{k % 20}</p>")) for k in range(60)]
    items = [(str(k), (bodies[k][1] or "")[30:300]) for k in range(20, 30)] + [("2", "w1 w2"), ("11", "w1 w2"), ("empty", "")]
    return tables(spark, tmp_path_factory.mktemp("plain"), bodies, html, items, [(k, k % 2, 0) for k in range(0, 60, 2)], vectors(400, 7))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    docs = [(None, "two words"), (None, None), (None, "two words"), (7, "a text"), (7, "another text\nof two lines"), (7, "a text"), (8, ""), (9, long_text()), (10, "z" * 1_000_000), (11, "é" * 3000), (12, None)]
    return tables(spark, tmp_path_factory.mktemp("odd"), [(i, t, None, None, 1) for i, t in docs], [(None, None, None), (None, "u v", "x" * 200), (1, None, "x" * 200), (1, "u", "x" * 200), (2, "u", "y" * 5_000_000)], [(None, "two words"), ("1", None)], [(7, None, None), (None, 1, 1), (8, 1, 0)], vectors(30, 1)[:3] + [(None, [1.0], 1), (100, None, 1), (100, [1.0], None), (200, [float("nan")], 1), (300, [], 2)])


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("none"), [], [], [], [])


def by_id(df):
    return {r[0]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, plain, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{plain}/{t}.parquet/*.parquet')")
    want = db.execute(ORACLE_SQL[name])
    names = sorted(x[0] for x in want.description)
    order = [[x[0] for x in want.description].index(n) for n in names]
    got = QUERIES[name](spark, plain)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows_and_no_rows(spark, odd, none, name):
    assert QUERIES[name](spark, none).count() == 0
    out = QUERIES[name](spark, odd)
    if name == "op11_hard_negatives":
        assert all(r.anchor_id % 100 == 0 for r in out.collect())
        return
    rows = out.collect()
    assert len(rows) == (5 if name == "op10_warc" else 11)
    assert sorted((r[0] is None, r[0] or 0) for r in rows) == (sorted([(True, 0)] * 2 + [(False, 1)] * 2 + [(False, 2)]) if name == "op10_warc" else sorted([(True, 0)] * 3 + [(False, k) for k in (7, 7, 7, 8, 9, 10, 11, 12)]))


def test_sharding_contract(spark, plain, bodies):
    got = by_id(sharding.op4_hilbert(spark, plain))
    counts = defaultdict(list)
    for d, t, *_ in bodies:
        r, raw = got[d], (t or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        counts[r.shard].append(r.slot)
    assert len(got) == len(bodies) and set(counts) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in counts.values()) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if good(m[0])] for k, (p, good) in rules.items()}


def test_pii_contract(spark, tmp_path):
    rng = random.Random(3)
    parts = ["a@b.co", "x+y@z", ".", "..", "1.2.3.4", "256.1.1.1", "+1 202", "555-0123", "(", ") ", " ", "-", "4111 1111", "1111 1111", "4111111111111111", "é", "\n", "@", "7", "000", "+", "word ", "call ", "日本 ", "1e5", "_"]
    body = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(400)] + [None, "", *PII_TEXTS]
    folder = tables(spark, tmp_path, [(k, t, None, None, 0) for k, t in enumerate(body)], [], [], [])
    got = by_id(pii.op5_pii(spark, folder))
    for d, t in enumerate(body):
        want, r = base_spans(t or ""), got[d]
        listed = [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS], t
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(spans) and len(spans) == r.n_spans == len(listed) + r.n_found
        assert spans == sorted(spans, key=lambda s: ([*pii.KINDS, pii.SECRET].index(s.split(":")[0]), int(s.split(":")[1])))
    assert "secret:9:41" in got[len(body) - 1].spans


def test_context_finds_short_and_far_tokens(spark):
    body = [f"server {k % 250}.1.2.3 up" for k in range(30)] + ["server 10.0.0.7.9 up"] + [f"{'x' * 100} mail p{k}@q.org" for k in range(3)]
    body += [f"{'kontonummer' * 10}: +1 202 555 01{k:02d} bitte" for k in range(12)] + [f"{'kontonummer' * 10}: 2025550199 bitte"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(body)], "doc_id bigint, text string")
    found = pii.found_in(df)
    at = found.join(pii.bootstrap(found), "pii_key").select("doc_id", "kind", "start", "end").collect()
    assert ("phone", 112, 122) in {tuple(r[1:]) for r in at if r.doc_id == len(body) - 1}


def test_quality_verdicts(spark, plain, bodies):
    got = by_id(QUERIES["op7_quality_rules"](spark, plain))
    for d, t, *_ in bodies:
        r = got[d]
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert r.n_words == n and r.base_failed == (n < 20 or 100 * r.n_repeat_words > 30 * n) and r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_gam_query(spark, plain, bodies):
    got = by_id(QUERIES["op8_quality_gam"](spark, plain))
    for d, *_ in bodies:
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_gam_features_against_brute_force():
    import pyarrow as pa

    bodies = [None, "", "one", "A b! c? 12,3 #x\nA b! c? 12,3", "żółć " * 30, "the same four words the same four words"]
    for t, x in zip(bodies, quality_gam.features(pa.array(bodies)).tolist(), strict=True):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, raw = max(len(w), 1), t.encode()
        grams = [tuple(w[k : k + 4]) for k in range(len(w) - 3)]
        kinds = {"symbols": "#*$%&|<>=_~^", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "marks": ".,;:", "shouts": "!?", "lines": "\n"}
        want = {"words": __import__("math").log1p(len(w)), "word_bytes": sum(len(y.encode()) for y in w) / n, "short_words": sum(len(y.encode()) <= 3 for y in w) / n, "long_words": sum(len(y.encode()) >= 12 for y in w) / n, **{k: sum(t.count(c) for c in cs) / n for k, cs in kinds.items()}, "other_bytes": sum(b >= 128 for b in raw) / n, "distinct": len(set(w)) / n, "repeats": 1 - len(set(grams)) / len(grams) if grams else 0}
        assert x == pytest.approx([want[f] for f in quality_gam.FEATURES])


def test_gam_on_held_out_labels(spark):
    """Accuracy and recall on rows whose labels the model never saw."""
    folder = "/root/testdata/sf0.01"
    scored = QUERIES["op8_quality_gam"](spark, folder).where("held_out")
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet").where("quality IS NOT NULL"), "doc_id").select("predicted", "quality").collect()
    right = sum(p == q for p, q in rows)
    good = [p for p, q in rows if q == 1]
    assert len(rows) > 20 and right / len(rows) >= 0.85 and sum(good) / len(good) >= 0.9


def regular(n, a, b):
    """Words of two letters that differ everywhere and whose positions hold equal sums of all low powers."""
    s = a
    while len(s) < n:
        s += "".join(b if c == a else a for c in s)
    return s


def test_regular_long_words_are_told_apart(spark, tmp_path):
    pairs = [(regular(n, "a", "b"), regular(n, "b", "a")) for n in (32, 64, 1024, 4096)]
    docs = [x for pair in pairs for x in pair]
    docs += [" ".join(x) for x in pairs[2]] + ["w x x w w x", "x w w x x w"]
    folder = tables(spark, tmp_path, [(k, t, "en", "s", 1) for k, t in enumerate(docs)], [], [("1", pairs[2][0]), ("2", pairs[3][1])], [])
    assert {r.doc_id: r.component_id for r in QUERIES["op3_jaccard_join"](spark, folder).collect() if r.doc_id < 8} == {k: k for k in range(8)}
    assert {r.doc_id for r in QUERIES["op1_decontaminate"](spark, folder).collect() if r.contaminated} == {4, 7}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    for name in ("op2_substring_dedup", "op3_jaccard_join"):
        got = QUERIES[name](spark, folder)
        want = db.execute(ORACLE_SQL[name])
        names = [x[0] for x in want.description]
        assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_every_operator_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES] == list(range(1, 14))
