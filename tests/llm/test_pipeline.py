"""The five stages on a small table: what goes, what stays, and that every stage's decision is seen by the next."""

import sentencepiece

import corpus_pipeline
from helixmill.llm import sentencepiece_viterbi
from helixmill.plans import fixtures

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontaminate", "sentencepiece"]
    docs = fixtures.base(spark, SF, "documents")
    columns, seen = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SF), f"test-{name}")
        n = docs.count()
        assert 0 < n <= seen and (docs.columns == columns or name == "sentencepiece")
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} if name == "decontaminate" else (texts if name == "sentencepiece" else None)
        seen = n
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_viterbi.MODEL)
    assert all(library.decode(r.ids) == texts[r.doc_id] for r in docs.collect())


def test_near_copies_from_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    longer = [f"v{i}" for i in range(100)]
    texts = [words, words + [f"x{i}" for i in range(20)], longer, longer + [f"y{i}" for i in range(26)]]  # 96 of 116 shingles shared, 96 of 122
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [0, 2, 3]
