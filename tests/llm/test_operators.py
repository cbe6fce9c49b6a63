"""Every operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.llm import decontaminate, graph, jaccard_join, line_dedup, pii, quality_gam, quality_rules, sentencepiece_viterbi, sharding, substring_dedup, warc
from helixmill.llm._common import shared_dir

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"


def texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ÜBER", "日本", "x#|", "a1", "-"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = say(60), say(14)
    out: list[str | None] = [None, "", " \n\t", "one", "one two three"]
    for k in range(60):
        body = say(rng.randint(5, 160))
        if k % 3 == 0:
            body += " " + passage + " " + say(30)
        if k % 4 == 0:
            body = body + "\n" + ("  " if k % 8 else "") + (line.upper() if k % 16 == 0 else line) + "\n" + say(6)
        out.append(body)
    base = say(120).split(" ")
    for k in range(12):
        near = list(base)
        near[7 * k] = "changed"
        out.append(" ".join(near))
    out += [base and " ".join(base)] * 4
    out += ["same words again and " * 40, "ab cd ef\n" * 50, say(3000), "z" * 5000]
    return out


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    return [*found, found[10]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_decontamination(spark, docs, rows, none):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    items = [(1, rows[5][1]), (2, "ONE, two-three"), (3, None), (4, "!!"), (None, "w1"), (5, (rows[8][1] or "")[20:400]), (11, rows[5][1]), (6, "absent")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wanted = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            wanted[tuple(w[k : k + 10])] |= set() if i is None else {str(i)}
    expected = []
    for d, t, *_ in rows:
        w, hit, own = words(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in wanted}:
                if (g := tuple(w[k : k + n])) in wanted and len(g) == n:
                    hit |= set(range(k, k + n))
                    own |= wanted[g]
        expected.append((d, len(w), len(hit), sorted(own)))
    out = decontaminate.contaminated(docs, bench)
    got = [(r.doc_id, r.fm_words, sum(s.end - s.first for s in r.fm_spans), r.fm_items) for r in out.collect()]
    assert sorted(got) == sorted(expected) and any(e[2] for e in expected)
    clean = decontaminate.remove_leaks(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    again = decontaminate.contaminated(clean, bench)
    assert again.where(F.size("fm_spans") > 0).count() == 0
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).where("fm_words > 0").count() > 0


def test_benchmark_in_blocks(spark, docs, rows, monkeypatch):
    bench = spark.createDataFrame([(k, rows[k][1]) for k in range(5, 25)], "item_id bigint, text string")
    whole = sorted(map(str, decontaminate.contaminated(docs, bench).drop("text").collect()))
    cut = sorted(map(str, decontaminate.remove_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert sorted(map(str, decontaminate.contaminated(docs, bench).drop("text").collect())) == whole
    assert len(cut) == len(rows) and decontaminate.contaminated(decontaminate.remove_leaks(docs, bench), bench).where(F.size("fm_spans") > 0).count() == 0


def test_cut_that_joins_a_window_of_an_earlier_block(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)
    first, second = "a b c d e f g h i j", "k l m n o p q r s t"
    bench = spark.createDataFrame([(1, first), (2, second), (3, "x y")], "item_id bigint, text string").coalesce(1)
    docs = spark.createDataFrame([(1, f"so a b c d e {second} f g h i j it is"), (2, "x x y y z"), (3, None)], "doc_id bigint, text string")
    assert {r.doc_id: (r.text or "").split() for r in decontaminate.remove_leaks(docs, bench).collect()} == {1: ["so", "it", "is"], 2: ["z"], 3: []}


def test_fm_index_against_search():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 400), 0)
    text[rng.integers(0, 400, 20)] = 0
    text[0] = 1
    index = decontaminate.FMIndex(text, 4)
    for n in (1, 2, 3):
        phrases = np.array([[a, b, c][:n] for a in range(1, 5) for b in range(1, 5) for c in range(1, 5)])
        low, high = index.search(phrases, np.full(len(phrases), n))
        for p, a, b in zip(phrases, low, high, strict=True):
            places = [k for k in range(len(text)) if list(text[k : k + n]) == list(p[::-1])]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def brute_repeats(rows):
    words = [re.findall(WORD, t or "") for _, t, *_ in rows]
    seen = defaultdict(list)
    for i, w in enumerate(words):
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])].append((i, k))
    gone = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i] |= set(range(k, k + 35))
    return sorted((r[0], len(w), len(gone[i]), sha(" ".join(x for k, x in enumerate(w) if k not in gone[i]))) for i, (r, w) in enumerate(zip(rows, words, strict=True)))


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 1])
def test_substring_dedup(docs, rows, none, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    out = substring_dedup.without_repeats(docs, digest=True)
    assert sorted((r.doc_id, r.rlz_words, r.rlz_removed, r.rlz_kept) for r in out.collect()) == brute_repeats(rows)
    assert substring_dedup.without_repeats(none).count() == 0


def test_further_dealings_shuffle_only_documents_with_hot_anchors(spark, monkeypatch):
    """Two hundred texts share one passage, and with it an anchor; two thousand share nothing."""
    word = lambda *of: f"concat_ws(' ', transform(sequence(0, 59), k -> md5(concat_ws('-', {', '.join(of)}, k))))"
    docs = spark.range(2200).selectExpr("id AS doc_id", f"concat_ws(' ', {word('id')}, IF(id < 200, {word(repr('x'))}, 'end'), {word('id + 10000')}) AS text")
    monkeypatch.setattr(substring_dedup, "HOT", 1)
    dealt, cut = [], substring_dedup.sifted
    monkeypatch.setattr(substring_dedup, "sifted", lambda d, keys: dealt.append((cut(d, keys), keys)) or dealt[-1][0])
    out = substring_dedup.without_repeats(docs, digest=True)
    assert out.where("rlz_removed > 0").count() == 200 and out.agg(F.min(F.when(F.col("rlz_removed") > 0, F.col("rlz_removed")))).first()[0] == 60
    kept = {r.rlz_key for r in dealt[0][0].collect()}
    wanted = {r.k for r in dealt[0][1].collect()}
    assert len(wanted) == 200 and wanted <= kept and len(kept) < 220
    monkeypatch.setattr(substring_dedup, "SIEVE", 64)  # a full sieve lets others through, and loses none
    assert wanted <= {r.rlz_key for r in cut(dealt[0][0], dealt[0][1]).collect()}


def test_jaccard_groups(docs, rows, none):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(WORD, lower(t or ""))
        sets.append({tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))} if w else set())
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(rows):
        least[find(i)] = min(least[find(i)], r[0])
    expected = sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))
    out = jaccard_join.similarity_groups(docs)
    assert sorted((r.doc_id, r.n, r.component_id) for r in out.collect()) == expected
    kept = jaccard_join.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({e[2] for e in expected}) and kept.columns == docs.columns
    assert jaccard_join.similarity_groups(none).count() == 0


def test_one_of_each_tells_texts_apart_not_ids(spark):
    say = lambda k: " ".join(f"{k}x{i}" for i in range(40))
    named, copied = say("named"), say("copied")
    rows = [(None, say("a")), (None, say("b")), (7, say("c")), (7, say("d")), (8, copied), (9, copied), (None, copied), (3, named), (3, named + " more"), (None, None), (None, None), (4, " \t"), (5, "one")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    got = jaccard_join.one_of_each(df).collect()
    named_rows = [r for r in got if r.doc_id == 3]
    assert len(named_rows) == 1 and named_rows[0].text in (named, named + " more")
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    expected = [(None, say("a")), (None, say("b")), (7, say("c")), (7, say("d")), (8, copied), (None, None), (None, None), (4, " \t"), (5, "one")]
    assert sorted(((r.doc_id, r.text) for r in got if r.doc_id != 3), key=key) == sorted(expected, key=key)


def test_long_chain_is_one_component(spark):
    links = spark.range(200).select((F.col("id") * 37 % 211).alias("a"), ((F.col("id") + 1) * 37 % 211).alias("b")).unionByName(spark.createDataFrame([(900, 901), (901, 900)], "a bigint, b bigint"))
    got = {r.node: r.label for r in graph.components(links).collect()}
    assert len(got) == 203 and {got[k] for k in got if k < 900} == {0} and got[901] == 900


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding(docs, rows, none, law):
    df = docs.select("doc_id", "lang", "source", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    out = sharding.hilbert_shards(df, ["source", "lang", "size"], ["doc_id"], 7, law, "size", 3).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append((r.slot, r.curve))
    assert len(out) == len(rows) and all([s for s, _ in sorted(x)] == list(range(len(x))) for x in slots.values())
    ordered = [c for k in sorted(slots) for _, c in sorted(slots[k])]
    assert ordered == sorted(ordered)
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.hilbert_shards(none, ["source", "n_chars"], ["doc_id"], 3).count() == 0


def test_strings_with_a_long_common_start_have_bins_of_their_own(spark):
    df = spark.range(800).select("id", F.concat(F.lit("https://one.host/"), F.lpad((F.col("id") * 37 % 100).cast("string"), 3, "0")).alias("v"), F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise("same").alias("w"))
    bins = sharding.quantise(df, ["v", "w"], 3)
    rows = df.select("v", bins[0].alias("b"), bins[1].alias("c")).collect()
    assert {r.c for r in rows} == {0} and {r.b for r in rows} == set(range(8))
    assert all((x.v <= y.v) or x.b >= y.b for x in rows[:90] for y in rows[:90])


def test_shards_prune_by_every_dimension(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("int").alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).cast("int").alias("y"))
    out = sharding.hilbert_shards(df, ["x", "y"], ["id"], 16)
    sharding.write_shards(out, f"file://{tmp_path}/s", ["slot"])
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 20_000
    boxes = out.groupBy("shard").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect()
    for low, high in (("x0", "x1"), ("y0", "y1")):
        assert sum(r[low] <= 30 and r[high] >= 20 for r in boxes) <= 8  # a tenth of either dimension reads half the shards at most


def test_curve_neighbours_touch():
    for n, bits in ((2, 3), (3, 2)):
        steps, seen = sharding.curve_steps(n), {}
        for point in np.ndindex(*[1 << bits] * n):
            h = s = 0
            for i in range(bits - 1, -1, -1):
                v = steps[s * (1 << n) + sum(((p >> i) & 1) << j for j, p in enumerate(point))]
                h, s = h << n | v >> 16, v & 0xFFFF
            seen[h] = point
        assert sorted(seen) == list(range(1 << n * bits))
        assert all(sum(abs(a - b) for a, b in zip(seen[k], seen[k + 1], strict=True)) == 1 for k in range(len(seen) - 1))


def test_pii(spark, none):
    body = ["mail a@b.co.uk, x", "a@b.c_d@e.f 1.2.3.4.5.6.7.8 300.1.1.1", "card 4111 1111 1111 1111 +1 (555) 123-4567é", None, "", "9" * 40 + " " + "@" * 30, "call +1 415 555 0100"]
    body += [f"phone: +1 (202) 555-01{k:02d} ok" for k in range(12)] + ["phone: 2025550199 now", "sum 2025550198 now"]
    df = spark.createDataFrame(list(enumerate(body)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in pii.found_in(df).collect()}
    spans = lambda r, k: [(s.start, s.end) for s in r[f"pii_{k}"]]
    assert spans(found[0], "email") == [(5, 14)]
    assert spans(found[1], "email") == [(0, 5), (5, 11)] and spans(found[1], "ip") == [(12, 19), (20, 27)]
    assert spans(found[2], "card") == [(5, 24)] and spans(found[2], "phone") == [(25, 42)]
    assert all(not spans(found[k], kind) for k in (3, 4, 5) for kind in pii.KINDS)
    more = {(r.kind, r.start, r.end) for r in pii.bootstrap(pii.found_in(df)).collect()}
    assert more == {("phone", 7, 17)}  # the word before twelve phones finds a thirteenth
    assert pii.bootstrap(pii.found_in(none)).count() == 0


def brute_viterbi(text, v):
    best, back = [0.0] + [None] * len(text), [0] * (len(text) + 1)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + v.longest) + 1):
            s = v.scores.get(text[i:j], v.unknown if j == i + 1 else None)
            if s is not None and (best[j] is None or best[i] + s > best[j]):
                best[j], back[j] = best[i] + s, i
    out, n = [], len(text)
    while n:
        piece = text[back[n] : n]
        out = ([v.ids[piece]] if piece in v.ids else [v.byte_ids[x] for x in piece.encode()]) + out
        n = back[n]
    return out


def test_sentencepiece(spark, docs, rows, none):
    import sentencepiece

    v = sentencepiece_viterbi.load()
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_viterbi.MODEL)
    out = {r.doc_id: r for r in sentencepiece_viterbi.encode(docs, check=True).collect()}
    for d, t, *_ in rows:
        if t is None:
            assert out[d].sp_ids is None
            continue
        assert out[d].sp_same and library.decode(out[d].sp_ids) == t
        if len(t) < 600:
            assert out[d].sp_ids == (brute_viterbi(" " + t, v) if t else [])
    odd = "▁ a▁b\U0001f600" + "no-space" * 30
    trie, rng = sentencepiece_viterbi.Trie(v), random.Random(7)
    longer = "".join(rng.choice(["ab", "the", "ing", "é", "日本", "x", "\U0001f600", "er", "\0", "a" * 30]) for _ in range(300))
    for reach in (1, 5, 64, 4096):  # committed bit by bit, the same ids
        for lane in (odd, longer, "a" * 700, "\U0001f600" * 40):
            assert np.frombuffer(sentencepiece_viterbi.encode_lanes([lane, "b", "", lane[::-1]], trie, reach)[0], np.int32).tolist() == brute_viterbi(lane, v)
    back = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(spark.createDataFrame([(1, odd), (2, None), (3, "")], "doc_id bigint, text string")))
    assert {r.doc_id: r.text for r in back.collect()} == {1: odd, 2: None, 3: ""}
    assert sentencepiece_viterbi.encode(none).count() == 0


def test_quality_rules(docs, rows, none):
    out = {r.doc_id: r for r in quality_rules.with_features(docs).collect()}
    for d, t, *_ in rows:
        w, seen, dup = re.findall(WORD, t or ""), set(), 0
        for x in (t or "").split("\n"):
            if re.search(WORD, x):
                dup += x in seen
                seen.add(x)
        windows = defaultdict(list)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].append(k)
        cover = {x for p in windows.values() if len(p) > 1 for k in p for x in range(k, k + 8)}
        r = out[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    assert quality_rules.keep_good(none).count() == 0


def test_gam_learns_on_held_out_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.3) | ((x[:, 1] > 0) & (x[:, 2] > 0))).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert quality_gam.fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]


def test_gam_scores_every_row(docs, rows, none):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("gam_label"))
    model = quality_gam.train(docs, labels)
    scored = quality_gam.score(docs, model)
    assert scored.count() == len(rows) and scored.where("gam_score IS NULL OR gam_score < 0 OR gam_score > 1").count() == 0
    assert quality_gam.score(none, model).count() == 0


def test_line_dedup(docs, rows, none):
    keys = defaultdict(set)
    key = lambda x: lower(re.sub(rf"^{SPACE}+|{SPACE}+$", "", x))
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            keys[key(x)].add(d)
    expected = []
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if not (len(key(x)) >= 40 and len(keys[key(x)]) >= 5 and d != max(keys[key(x)]))]
        expected.append((d, len(ls) - len(stay), "\n".join(stay)))
    dropped = F.coalesce(F.aggregate("line_drop", F.lit(0), lambda a, r: a + r["n"]), F.lit(0))
    out = line_dedup.with_drops(docs).select("doc_id", dropped.alias("n"), line_dedup.kept_text(F.col("text"), F.col("line_drop")).alias("kept"))
    assert sorted(map(tuple, out.collect())) == sorted(expected) and any(e[1] for e in expected)
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.dedup_lines(none).count() == 0
    clash = docs.select("*", *[F.lit(7).alias(c) for c in ("key", "line_key", "map_key", "line_row", "h", "p", "k")])
    got = line_dedup.dedup_lines(clash)
    assert got.columns == clash.columns and got.where(" OR ".join(f"{c} <> 7" for c in clash.columns[5:])).count() == 0
    assert sorted((r.doc_id, r.text) for r in got.where("text IS NOT NULL").collect()) == sorted((d, t) for (d, _, t), r in zip(expected, rows, strict=True) if r[1] is not None)


def test_first_occurrences_stream_over_a_secondary_sort(spark):
    lines = spark.range(2000).select((F.col("id") % 7).alias("h"), F.xxhash64(F.col("id") % 7).alias("g"), F.expr("nullif(id % 11, 3)").alias("doc_id"), F.col("id").alias("p"))
    out = line_dedup.first_occurrences(lines, ["h", "g"], 4)
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.index("window") < plan.index("sort [h") < plan.index("rangepartitioning(h") and plan.count("exchange") == 1 and "aggregate" not in plan
    got = defaultdict(list)
    for r in out.collect():
        got[r.h].append((r.k, r.doc_id, r.newest, r.p))
    ids = [10, 9, 8, 7]
    assert all([x[1] for x in sorted(v)] == ids and {x[2] for x in v} == {10} for v in got.values()) and len(got) == 7
    assert all(p == min(i for i in range(2000) if i % 7 == h and i % 11 == d) for h, v in got.items() for _, d, _, p in v)


def test_runs_of_many_lines(spark):
    at = spark.range(300_000).where("id % 3 < 2").agg(F.sort_array(F.collect_list(F.col("id").cast("int"))).alias("p"))
    runs = at.select(line_dedup.drop_runs(F.col("p")).alias("r")).first().r
    assert len(runs) == 100_000 and runs[5] == (15, 2)
    assert at.select(line_dedup.drop_runs(F.array().cast("array<int>")).alias("r")).first().r == []


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 64)
    big = "<p>é" * 60
    pages = [(3, "http://a\r\n", big), (1, None, big), (7, "u", "short"), (8, "u", "short"), (9, "u", None), (None, "u", big), (1, "u", big)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(2)
    source, target = shared_dir(spark), shared_dir(spark)
    records = warc.write_archives(df, source)
    index = warc.normalise(records, warc.revisits(records), source, target)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(index, target).collect())
    n, digest = len(big.encode()), sha(big)
    assert [g[3:] for g in got if g[2] == n].count((digest, "response", None)) == 1 and [g[5] for g in got if g[4] == "revisit"] == [1, 1, 1]
    assert sum(g[4] == "response" for g in got) == 4 and len(got) == len(pages)
    assert warc.read_archives(warc.normalise(warc.write_archives(df.limit(0), source), warc.revisits(records).limit(0), source, target), target).count() == 0


def test_members_of_the_rewritten_archive_stand_alone(spark):
    source, target = shared_dir(spark), shared_dir(spark)
    records = warc.write_archives(spark.createDataFrame([(1, "u", "x" * 500), (2, "u", "y")], "page_id bigint, url string, html string").coalesce(1), source)
    name = warc.normalise(records, warc.revisits(records), source, target).first().file
    path = target.removeprefix("file://") + "/" + name
    data = open(path, "rb").read()
    for place in open(path + ".idx"):
        at, size, _ = place.split("\t")
        assert zlib.decompress(data[int(at) : int(at) + int(size)], 31).startswith(b"WARC/1.1\r\n")
