"""Substring deduplication by relative Lempel-Ziv parsing, exact to the word.

A stretch is repeated if a window of WINDOW words also starts elsewhere. Equal windows share their smallest 8-gram hash,
their anchor, so the corpus is dealt into reference blocks by anchor: a piece is a maximal run of windows of a document
with one anchor, and all that could equal one of its windows lies in the block of that anchor. Each block is indexed (a
suffix array with match lengths), every piece is factored greedily against it, and factors of WINDOW words or more
become duplicate spans; where two factors meet, the windows across their boundary are looked up too, for only there can
a repeated window hide from greedy factors.

Stages: anchors are counted (pre-aggregated); those met once end there. Pieces met word for word elsewhere are spans at
once, however many copies there are. Only one representative of each different piece goes, with its words, into a
block. The windows of an anchor with more than HOT different pieces are dealt again, by their smallest 8-gram in another
order, and what is still too much by the whole window, so no task meets an unbounded group; every dealing goes through
the same counting, indexing and parsing. Texts are shuffled once to spell the representatives and once to remove words;
for each further dealing, twice those of documents with hot anchors, which a sieve of fixed size finds.

A document is known by a 64-bit hash of (doc_id, text); rows that repeat both lose the same words, and as each repeats
the other, all their windows. Null texts and texts of fewer words lose nothing. Ties cannot occur; empty tables give
empty results. Columns added start with ``rlz_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm._common import partitions, row_key, stage, table
from helixmill.llm._text import PLAIN, Words, combine, gram_hashes, list_array, mix, pieces, range_hashes, words_of

WINDOW, ANCHOR = 35, 8
HOT = 4000
BLOCK_WORDS = 1 << 19
PIECES = "h long, fp long, rlz_key long, at int, n int"
TEXTS = "h long, fp long, body binary"
FOUND = "h long, fp long, first array<int>, many array<int>"
#: How windows are dealt: by their smallest 8-gram, by the smallest in another order, by all of their words.
DEALINGS = 3
#: Bits of the sieve through which documents are read for a further dealing.
SIEVE = 1 << 23


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each size neighbours, by doubling."""
    span = 1
    while span * 2 <= size:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    rest = size - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def cut_pieces(words: Words, dealing: int = 0, under: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Row, anchor, fingerprint, first window (word in the row) and number of windows of each piece. Where an 8-gram
    comes again within a window, as in periodic text, one piece could hold equal windows: there each window is one.
    under: for each window its anchor in the dealing before; 0 for windows that stay out."""
    hashes = words.hashes()
    if len(hashes) < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams, reach = gram_hashes(hashes, ANCHOR), WINDOW - ANCHOR + 1
    orders = (lambda: sliding_min(grams, reach), lambda: sliding_min(mix(grams ^ np.uint64(dealing)), reach), lambda: gram_hashes(hashes, WINDOW))
    anchors = orders[dealing]()
    rows = words.rows()
    whole = rows[: len(anchors)] == rows[WINDOW - 1 :]
    if under is not None:
        anchors, whole = combine(anchors, under[: len(anchors)]), whole & (under[: len(anchors)] != 0)
    opens = np.ones(len(anchors), bool)
    opens[1:] = (anchors[1:] != anchors[:-1]) | (rows[1 : len(anchors)] != rows[: len(anchors) - 1]) | ~whole[:-1]
    begin = np.flatnonzero(opens & whole)
    upto = np.cumsum(np.append(opens | ~whole, True))  # a run ends at the next opening or where windows stop
    edges = np.flatnonzero(np.append(opens | ~whole, True))
    end = edges[upto[begin]] if len(begin) else begin
    again = np.zeros(len(grams) + 1, np.int64)
    for d in range(1, min(reach, len(grams))):
        again[1 : len(grams) - d + 1] |= grams[d:] == grams[:-d]
    again = np.cumsum(again)
    single = (end - begin > reach) | (again[end + reach - 1] > again[begin])
    n = np.where(single, end - begin, 1)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin, end = np.repeat(begin, n) + inside, np.where(np.repeat(single, n), np.repeat(begin, n) + inside + 1, np.repeat(end, n))
    prints = range_hashes(mix(hashes), begin, end + WINDOW - 1)
    row = rows[begin]
    return row, anchors[begin].view(np.int64), prints.view(np.int64), begin - words.first[row], end - begin


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        row, anchor, prints, at, n = cut_pieces(words_of(piece.column("text"), PLAIN))
        keys = piece.column("rlz_key").to_numpy()[row]
        yield pa.record_batch([pa.array(anchor), pa.array(prints), pa.array(keys), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "fp", "rlz_key", "at", "n"])


def spell_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the pieces wanted of them: the words of each, one space between."""
    for piece in pieces(batches, "text"):
        words = words_of(piece.column("text"), PLAIN)
        out: list[tuple] = []
        for r, wanted in enumerate(piece.column("wanted").to_pylist()):
            base = words.first[r]
            for w in wanted:
                a, b = base + w["at"], base + w["at"] + w["n"] + WINDOW - 2
                body = words.raw[words.starts[a] : words.ends[b]].tobytes().split()
                out.append((w["h"], w["fp"], b" ".join(body)))
        yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["h", "fp", "body"])


def dealt_again(dealing: int):
    """Documents with pieces of hot anchors: the windows of these, cut into pieces of the next dealing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = words_of(piece.column("text"), PLAIN)
            lists = piece.column("wanted")
            row = np.repeat(np.arange(len(piece)), np.diff(lists.offsets.to_numpy()))
            h, at, n = (lists.flatten().field(c).to_numpy() for c in ("h", "at", "n"))
            under = np.zeros(len(words.starts), np.uint64)
            under[np.repeat(words.first[row] + at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.repeat(h.astype(np.int64).view(np.uint64) | np.uint64(1), n)
            row, anchor, prints, at, n = cut_pieces(words, dealing, under)
            keys = piece.column("rlz_key").to_numpy()[row]
            yield pa.record_batch([pa.array(anchor), pa.array(prints), pa.array(keys), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "fp", "rlz_key", "at", "n"])

    return run


class ReferenceBlock:
    """Suffix array over pieces; for each place the length, up to a power of two past WINDOW, of its longest match with
    another place."""

    def __init__(self, bodies: pa.Array):
        words = words_of(bodies, PLAIN)
        self.first, n = words.first, len(words.starts)
        gaps = self.first[1:] + np.arange(len(bodies))  # an own symbol closes each piece, so no match goes on
        symbols = np.unique(words.hashes(), return_inverse=True)[1] + len(bodies)
        text = np.insert(symbols, self.first[1:], np.arange(len(bodies)))
        ranks, levels, span = text.astype(np.int64), [], 1
        total = len(text)
        while True:
            levels.append((span, np.append(ranks, -np.arange(1, 2))))
            key = ranks * (total + len(bodies) + 1)
            if span < total:
                key[:-span] += ranks[span:] + 1
            order = np.argsort(key)
            if span > WINDOW:
                break
            step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            ranks = np.empty(total, np.int64)
            ranks[order] = step
            span *= 2
        a, b = order[:-1], order[1:]
        lengths = np.zeros(len(a), np.int64)
        for span, level in reversed(levels):
            x, y = np.minimum(a + lengths, total), np.minimum(b + lengths, total)
            same = (level[x] == level[y]) & (x != y)
            lengths += span * same
        best = np.zeros(total + 1, np.int64)
        best[order[:-1]] = lengths
        best[order[1:]] = np.maximum(best[order[1:]], lengths)
        keep = np.ones(total, bool)
        keep[gaps] = False
        self.longest = best[:total][keep][:n]  # by word


def repeated_windows(block: ReferenceBlock) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of all pieces at once, long ones and those at boundaries: places where repeated windows start."""
    longest, end = block.longest, block.first[1:]
    cursor = block.first[:-1].copy()
    before_start, before_len = np.full(len(cursor), -1), np.zeros(len(cursor), np.int64)
    marks = np.zeros(len(longest) + 1, np.int64)
    live = np.flatnonzero(cursor < end)
    while len(live):
        at = cursor[live]
        size = np.maximum(1, np.minimum(longest[at], end[live] - at))
        long = size >= WINDOW
        np.add.at(marks, at[long], 1)  # windows that start in a long factor and end in it
        np.add.at(marks, at[long] + size[long] - WINDOW + 1, -1)
        near = (before_start[live] >= 0) & (before_len[live] - 1 + size >= WINDOW)
        for a, b in zip(np.maximum(before_start[live][near] + 1, at[near] - WINDOW + 1).tolist(), at[near].tolist(), strict=True):
            hit = np.flatnonzero(longest[a:b] >= WINDOW) + a  # windows across the boundary, looked up one by one
            np.add.at(marks, hit, 1)
            np.add.at(marks, hit + 1, -1)
        before_start[live], before_len[live] = at, size
        cursor[live] = at + size
        live = live[cursor[live] < end[live]]
    return np.flatnonzero(np.cumsum(marks)[:-1] > 0), block.first


def parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; as many whole anchors as fit make a block."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        places, first = repeated_windows(ReferenceBlock(rows.column("body").combine_chunks()))
        row = np.searchsorted(first, places, "right") - 1
        opens = np.ones(len(places), bool)
        opens[1:] = (np.diff(places) != 1) | (np.diff(row) != 0)
        begin = np.flatnonzero(opens)
        count = np.diff(np.append(begin, len(places)))
        owner = row[begin]
        got, number = np.unique(owner, return_counts=True)
        take = pa.array(got)
        yield pa.record_batch([rows.column("h").combine_chunks().take(take), rows.column("fp").combine_chunks().take(take), list_array(pa.array((places[begin] - first[owner]).astype(np.int32)), number), list_array(pa.array(count.astype(np.int32)), number)], ["h", "fp", "first", "many"])

    for batch in batches:
        held.append(batch)
        size += batch.column("body").nbytes // 6
        if size >= BLOCK_WORDS:
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if last:
                yield from flush(rows.slice(0, last))
                held, size = rows.slice(last).to_batches(), rows.slice(last).nbytes // 6
    if held:
        yield from flush(pa.Table.from_batches(held))


def sifted(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs whose rlz_key is among keys (k), and a few others. The sieve, SIEVE bits in words of 64, goes to the documents, so
    that the rest is not shuffled; it does not grow with the keys."""
    at = lambda c: F.pmod(F.col(c), F.lit(SIEVE))
    word, bit = lambda c: F.shiftright(at(c), 6), lambda c: at(c).bitwiseAND(F.lit(63)).cast("int")
    sieve = stage(keys.groupBy(word("k").alias("rlz_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit("k"))).alias("rlz_bits")), "sieve")
    let_through = docs.join(F.broadcast(sieve), word("rlz_key") == F.col("rlz_w")).where(F.getbit("rlz_bits", bit("rlz_key")) == 1)
    return let_through.select(docs.columns)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs(rlz_key, text) -> rlz_key, at, n: windows at .. at + n - 1 of the document also start elsewhere."""
    n_parts = partitions(docs.sparkSession)
    dealt = docs.repartition(n_parts, "rlz_key")
    occurrences, found = docs.mapInArrow(piece_rows, PIECES), []
    for dealing in range(DEALINGS):
        shared = occurrences.groupBy("h").agg(F.count("*").alias("c"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("c > 1").select("h", (F.col("lo") == F.col("hi")).alias("alike"))
        met = stage(occurrences.join(stage(shared, "shared"), "h"), "met")  # written, so that Spark can split a hot anchor
        mixed = met.where("NOT alike")
        kinds = stage(mixed.groupBy("h", "fp").agg(F.count("*").alias("c"), F.min(F.struct("rlz_key", "at", "n")).alias("one")), "kinds")
        hot = stage(kinds.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("h"), "hot")
        # one representative of each different piece is spelled out and parsed
        wanted = kinds.join(hot, "h", "left_anti").select(F.col("one.rlz_key").alias("k"), F.struct("h", "fp", "one.at", "one.n").alias("w")).groupBy("k").agg(F.collect_list("w").alias("wanted"))
        bodies = dealt.join(wanted.hint("shuffle_hash"), F.col("rlz_key") == F.col("k")).select("text", "wanted").mapInArrow(spell_pieces, TEXTS)
        bodies = bodies.groupBy("h", "fp").agg(F.first("body").alias("body"))  # rows that repeat a document spell it twice
        parsed = stage(bodies.repartition(n_parts, "h").sortWithinPartitions("h").mapInArrow(parse_blocks, FOUND), "parsed")
        inner = F.explode(F.zip_with("first", "many", lambda a, b: F.struct((F.col("at") + a).alias("at"), b.alias("n"))))
        found.append(mixed.join(parsed, ["h", "fp"]).select("rlz_key", inner.alias("s")).select("rlz_key", "s.at", "s.n"))
        found.append(met.where("alike").select("rlz_key", "at", "n"))
        found.append(mixed.join(stage(kinds.where("c > 1").select("h", "fp"), "copied"), ["h", "fp"]).select("rlz_key", "at", "n"))
        if dealing == DEALINGS - 1 or hot.isEmpty():
            break
        lists = stage(mixed.join(hot, "h").groupBy(F.col("rlz_key").alias("k")).agg(F.collect_list(F.struct("h", "at", "n")).alias("wanted")), "lists")
        dealt = sifted(docs, lists.select("k")).repartition(n_parts, "rlz_key")  # all that the next dealings need
        again = dealt.join(lists.hint("shuffle_hash"), F.col("rlz_key") == F.col("k")).select("rlz_key", "text", "wanted")
        occurrences = stage(again.mapInArrow(dealt_again(dealing + 1), PIECES), "again")
    return reduce(DataFrame.unionByName, found)


def remover(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = words_of(piece.column("text"), PLAIN)
            spans = piece.column("rlz_spans")
            row = np.repeat(np.arange(len(piece)), np.diff(spans.offsets.to_numpy()))
            at, n = (spans.flatten().field(c).to_numpy() for c in ("at", "n"))  # flatten heeds that the piece is a slice
            begin = words.first[row] + at
            depth = np.bincount(begin, minlength=len(words.starts) + 1) - np.bincount(begin + n + WINDOW - 1, minlength=len(words.starts) + 1)
            gone = np.cumsum(depth)[: len(words.starts)] > 0
            lost = np.add.reduceat(np.append(gone, False), np.minimum(words.first[:-1], len(gone)), dtype=np.int64) * (words.counts() > 0)
            kept = []
            for r, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                if lost[r]:
                    stay = np.flatnonzero(~gone[a:b]) + a
                    kept.append(b" ".join([words.raw[s:e].tobytes() for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)]))
                else:
                    kept.append(b" ".join(words.raw[words.offsets[r] : words.offsets[r + 1]].tobytes().split()))
            keep = [c for c in piece.schema.names if c not in ("text", "rlz_spans", "rlz_key", "rlz_words", "rlz_removed", "rlz_kept")]
            last = pa.array([hashlib.sha256(x).hexdigest() for x in kept] if digest else [x.decode() for x in kept], pa.string())
            yield pa.record_batch([*(piece.column(c) for c in keep), pa.array(words.counts().astype(np.int64)), pa.array(lost), last], [*keep, "rlz_words", "rlz_removed", "rlz_kept"])

    return run


def without_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """docs, text replaced by rlz_kept (the words that stay, one space between; with digest their SHA-256), rlz_words and
    rlz_removed."""
    spark = docs.sparkSession
    rows = docs.drop("rlz_key", "rlz_spans", "rlz_words", "rlz_removed", "rlz_kept").withColumn("rlz_key", row_key())
    spans = repeated_spans(rows.select("rlz_key", "text")).groupBy(F.col("rlz_key").alias("k")).agg(F.collect_list(F.struct("at", "n")).alias("rlz_spans"))
    joined = rows.repartition(partitions(spark), "rlz_key").join(spans.hint("shuffle_hash"), F.col("rlz_key") == F.col("k"), "left").drop("k")
    joined = joined.withColumn("rlz_spans", F.coalesce("rlz_spans", F.array().cast("array<struct<at:int,n:int>>")))
    out = rows.drop("text", "rlz_key").withColumns({"rlz_words": F.lit(0).cast("long"), "rlz_removed": F.lit(0).cast("long"), "rlz_kept": F.lit("").cast("string")})
    return joined.mapInArrow(remover(digest), out.schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return docs.select("doc_id", F.col("rlz_words").alias("n_words"), F.col("rlz_removed").alias("n_removed"), F.col("rlz_kept").alias("kept_sha256"))


SQL = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE g IN (SELECT g FROM twice)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS k, count(*) AS n FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
""",
}
