"""Tree concatenation and alignment against the vocabularies' own libraries and brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixmill.llm import alignment, bpe_tree
from helixmill.llm.registry import QUERIES

LETTERS = list("aab  '\n1!é日<|") + ["'s", "'re", "<|endoftext|>", "<s>", "<0x41>", "  ", "the", " ing", "Ᲊ", "\x00", "\t", " ", "🎉"]
FIXED = ["", "a", "<|endoftext|>", "x <|endoftext|>  <|endoftext|>y <|endo", "a" * 1000, "x" + "a" * 3001, "ab" * 777, " " * 500 + "x", "日本語テキスト" * 50, "՘aᲉbꟋ", "'s't're'r 'll''s don't I'", "\x00\x1c\x85  ﻿", "=" * 100 + "-" * 333, "é" * 700, " ", "  ", "a ", " a", "\n"]


def texts(n=150, seed=5):
    rng = random.Random(seed)
    return FIXED + ["".join(rng.choices(LETTERS, k=rng.randint(1, 200))) for _ in range(n)] + ["".join(rng.choices("abcdefgh", k=rng.randint(100, 1500))) for _ in range(20)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_tree.MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe_tree.load()


@pytest.mark.parametrize("half", [2, 3, 32])
def test_halves_joined_are_the_whole(library, vocabulary, half):
    body = texts()
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe_tree.Encoder(vocabulary, half).texts(body)]
    assert got == [x.ids for x in library.encode_batch(body, add_special_tokens=False)]


@pytest.mark.parametrize("size", [1, 3, 7, 50])
def test_parts_joined_are_the_whole(library, vocabulary, size):
    encoder = bpe_tree.Encoder(vocabulary, 8)
    for text in texts(60):
        if text:
            run = bpe_tree.joined_tree(encoder, [bpe_tree.run_of(encoder, text[k : k + size]) for k in range(0, len(text), size)])
            assert run.text == text and run.ids.tolist() == library.encode(text, add_special_tokens=False).ids
            assert run.ends.tolist() == np.cumsum([len(w) for w in encoder.words(text)]).tolist()


def test_wide_windows_and_lanes_merge_alike(vocabulary):
    rng = random.Random(2)
    words = [bytes(rng.choices(b"aabcdeht ", k=rng.randint(1, 120))) for _ in range(200)]
    slow = [bpe_tree.merge_many([vocabulary.byte_ids[b] for b in w], vocabulary) for w in words]
    assert [x.tolist() for x in bpe_tree.Lanes(vocabulary).merge(words)] == slow


def test_encode_and_decode_on_spark(spark, library):
    body = texts(80) + [None, None, "long text of words " * 300, "long text of words " * 300, "z" * 5000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(body)], "id int, text string, bpe_key string").repartition(3)
    packed = bpe_tree.encode_packed(docs.drop("bpe_key"), long_chars=1000)
    got = {r.id: (r.bpe_ids, r.bpe_text) for r in bpe_tree.decode_packed(packed).collect()}
    for k, t in enumerate(body):
        ids = None if t is None else library.encode(t, add_special_tokens=False).ids
        assert (None if got[k][0] is None else np.frombuffer(got[k][0], "<u4").tolist()) == ids
        assert got[k][1] == (None if t is None else library.decode(ids, skip_special_tokens=False))
    lists = {r.id: r.bpe_ids for r in bpe_tree.encode(docs).collect()}
    assert all(lists[k] == (None if t is None else library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(body))


def test_bpe_query(spark, library):
    folder = "/root/testdata/sf0.001"
    body = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op12_bpe_tree"](spark, folder).collect()
    assert len(rows) == len(body)
    for r in rows:
        ids = library.encode(body[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def ends(parts):
    return np.cumsum([len(p) for p in parts]).tolist()


def aligned(docs):
    """Brute force: rows by id."""
    first = Tokenizer.from_file(alignment.MODEL_A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL_B)
    a_of, b_of = bpe_tree.load(specials=False).spelled, alignment.sentencepiece_viterbi.load(alignment.MODEL_B).spelled
    found, counts = {}, Counter()
    for d, t in docs:
        found[d] = None
        if t:
            a, b = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
            if b"".join(a_of[i] for i in a) == b"".join(b_of[i] for i in b) == (" " + t).encode():
                ea, eb = ends([a_of[i] for i in a]), ends([b_of[i] for i in b])
                links = [(x, y) for x, e, s in zip(a, ea, [0, *ea]) for y, f, g in zip(b, eb, [0, *eb]) if min(e, f) > max(s, g)] if len(a) * len(b) < 200_000 else []
                cuts = sorted(set(ea) & set(eb))
                side = lambda ids, e, lo, hi: ",".join(str(i) for i, x in zip(ids, e) if lo < x <= hi)
                groups = ";".join(f"{side(a, ea, lo, hi)}|{side(b, eb, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
                found[d] = len(a), len(b), len(cuts), links, groups
                counts.update(links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return {d: (0, 0, 0, 0, 0, 0, "") if x is None else (x[0], x[1], x[2], len(x[3]), sum(counts[k] == best[k[1]] for k in x[3]), sum(counts[k] for k in x[3]), hashlib.sha256(x[4].encode()).hexdigest()) for d, x in found.items()}


def test_alignment_against_brute_force(spark, tmp_path):
    body = [t for t in texts(120) if len(t) < 400] + [None, "▁", "a▁b", "same words here", "same words here"]
    docs = list(enumerate(body))
    spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("al_a", F.lit("clash")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_alignment"](spark, str(tmp_path)).collect()}
    assert got == aligned(docs)


def test_perfect_hash_is_minimal_and_verified():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 62, 20_000).astype(np.uint64))
    hashed = alignment.PerfectHash.of(keys)
    assert sorted(hashed.index(keys).tolist()) == list(range(len(keys)))
    again = alignment.PerfectHash.unpacked(hashed.packed())
    assert (again.index(keys) == hashed.index(keys)).all()
    other = again.index(keys + np.uint64(1 << 62))
    assert ((other >= -1) & (other < len(keys))).all()
    assert len(alignment.PerfectHash.of(keys[:0]).index(keys[:0])) == 0


def test_counts_over_many_parts(spark, monkeypatch):
    """Small bounds: several flushes a task, several parts a slice, sums up a tree of two levels."""
    monkeypatch.setattr(alignment, "PART_BYTES", 64)
    docs = [(k, t) for k, t in enumerate(texts(40)) if len(t) < 300]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: tuple(r[n] for n in alignment.RESULTS) for r in alignment.align(rows).collect()}
    assert got == {d: x[:6] for d, x in aligned(docs).items()}
