"""Benchmark decontamination with an FM-index per training shard.

Documents are read in shards of bounded size. Each shard's words become symbols, its suffixes are sorted, and the
Burrows-Wheeler transform goes into a wavelet matrix. All benchmark windows are then searched backwards at once, each
step two ranks; the rows found are located by walking to sampled suffix positions; overlapping places merge into spans.
A stretch of words can hold a window only if all its words occur in the benchmark and it is as long as the shortest
window, so only such stretches enter the index: with everyday words in the benchmark that is most of the text.

The benchmark is the stated query set. It is cut into blocks of at most BLOCK_BYTES of text, each broadcast on its own;
a further block is one more pass over documents, and after PASSES of them what was found is written, so that neither
the driver nor a task holds more blocks than that. Nothing is shuffled. When passages are cut out, documents that lost
some are searched again by all blocks until nothing is found, as a cut can bring the halves of a window together.

Nulls and texts without words have no hits; items without words are skipped; windows of items without id count as hits,
but name no item; items with equal windows all count. Rows that repeat are judged each on its own. Columns that the
operator adds start with ``fm_`` and replace input columns of those names. Very long documents form a shard of their
own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.llm._common import stage, table
from helixmill.llm._text import ALNUM, Words, list_array, pieces, words_of

WINDOW = 10
BLOCK_BYTES, PASSES = 4 << 20, 4
SHARD_BYTES, SHARD_SYMBOLS = 16 << 20, 1 << 20
SAMPLE = 8
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@dataclass
class Phrases:
    vocabulary: np.ndarray  # sorted hashes of the words; symbol i + 1 stands for entry i
    sieve: np.ndarray  # by the low bits of a hash: may be in the vocabulary
    symbols: np.ndarray  # a row for each window, its words from the last to the first, then 0
    lengths: np.ndarray
    owners: list[np.ndarray]  # items of each window
    items: list[str | None]


def phrases(ids: list, texts: list[str], window: int = WINDOW) -> Phrases | None:
    words = words_of(pa.array(texts, pa.string()), ALNUM)
    hashes = words.hashes()
    vocabulary = np.unique(hashes)
    symbols = np.searchsorted(vocabulary, hashes) + 1
    owners: dict[tuple, set[int]] = {}
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        own = symbols[a:b].tolist()
        for k in range(max(len(own) - window, 0) + 1 if own else 0):
            owners.setdefault(tuple(own[k : k + window]), set()).add(i)
    if not owners:
        return None
    table_ = np.zeros((len(owners), window), np.int64)
    for row, key in zip(table_, owners, strict=True):
        row[: len(key)] = key[::-1]
    sieve = np.zeros(1 << 18, bool)
    sieve[(vocabulary & np.uint64(len(sieve) - 1)).astype(np.int64)] = True
    return Phrases(vocabulary, sieve, table_, (table_ > 0).sum(1), [np.array(sorted(x)) for x in owners.values()], [None if x is None else str(x) for x in ids])


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Phrases]:
    """The query set in blocks; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.where(F.col(text).isNotNull()).select(item_id, text).toLocalIterator():
        if texts and size + len(row[1]) * 2 > BLOCK_BYTES:
            if found := phrases(ids, texts):
                yield found
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1]) * 2
    if texts and (found := phrases(ids, texts)):
        yield found


def sort_suffixes(ranks: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the length on which they are sorted."""
    n, span = len(ranks), 1
    ranks = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    while True:
        key = ranks * (n + 1)
        key[:-span] += ranks[span:] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        ranks = np.empty(n, np.int64)
        ranks[order] = new
        span *= 2
        if new[-1] == n - 1 or span >= n:
            return order


class WaveletMatrix:
    """Rank and access over symbols, one bit vector with running counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.start = self.down(np.arange(size + 1), np.zeros(size + 1, np.int64))

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            before = ones[at]
            at = np.where((symbols >> b) & 1, zeros + before, at - before)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before at."""
        return self.down(symbols, at) - self.start[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places, and how often each stood before."""
        symbols = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[at]
            bit = ones[at + 1] - before
            symbols = 2 * symbols + bit
            at = np.where(bit, zeros + before, at - before)
        return symbols, at - self.start[symbols]


class FMIndex:
    """Over stretches of symbols, each closed by a separator (0) that sorts by its place."""

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE):
        gaps = text == 0
        ranks = text + np.count_nonzero(gaps)
        ranks[gaps] = np.arange(np.count_nonzero(gaps))
        order = sort_suffixes(ranks)
        self.bwt = WaveletMatrix(text[order - 1], size)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size + 1))])
        begins = np.flatnonzero(np.concatenate([[True], gaps[:-1]]))
        inside = np.arange(len(text)) - np.repeat(begins, np.diff(np.append(begins, len(text))))
        self.sampled = (inside % sample == 0)[order]  # each stretch's start is a sample, so no walk leaves it
        self.known = np.where(self.sampled, order, 0)

    def search(self, backwards: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the sorted suffixes that begin with each phrase."""
        low, high = self.less[backwards[:, 0]], self.less[backwards[:, 0] + 1]
        for k in range(1, backwards.shape[1]):
            on = np.flatnonzero((lengths > k) & (high > low))
            c = backwards[on, k]
            low[on] = self.less[c] + self.bwt.rank(c, low[on])
            high[on] = self.less[c] + self.bwt.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, on, walked = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(on):
            done = self.sampled[rows]
            out[on[done]] = self.known[rows[done]] + walked
            on, rows = on[~done], rows[~done]
            c, before = self.bwt.access(rows)
            rows, walked = self.less[c] + before, walked + 1
        return out


def stretches(words: Words, wanted: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the stretches that can hold a phrase, each closed by 0, and the place of each word (0's: -1)."""
    hashes = words.hashes()
    maybe = np.flatnonzero(wanted.sieve[(hashes & np.uint64(len(wanted.sieve) - 1)).astype(np.int64)])
    at = np.searchsorted(wanted.vocabulary, hashes[maybe])
    at[at == len(wanted.vocabulary)] = 0
    good = wanted.vocabulary[at] == hashes[maybe]
    places, symbols = maybe[good], at[good] + 1
    if not len(places):
        return places, places
    opens = np.concatenate([[True], (np.diff(places) > 1) | np.isin(places[1:], words.first)])
    run = np.cumsum(opens) - 1
    keep = (np.bincount(run) >= wanted.lengths.min())[run]
    places, symbols, run = places[keep], symbols[keep], run[keep]
    closes = np.flatnonzero(np.diff(run, append=-1) != 0) + 1
    return np.insert(symbols, closes, 0), np.insert(places, closes, -1)


def occurrences(symbols: np.ndarray, places: np.ndarray, wanted: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where phrases begin (as places), and which; in blocks."""
    if not len(symbols):
        return
    index = FMIndex(symbols, len(wanted.vocabulary))
    low, high = index.search(wanted.symbols, wanted.lengths)
    found = np.flatnonzero(high > low)
    counts = (high - low)[found]
    upto = np.cumsum(counts)
    at = 0
    while at < len(found):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SHARD_SYMBOLS, "right")))
        n = counts[at:end]
        rows = np.repeat(low[found[at:end]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield places[index.locate(rows)], np.repeat(found[at:end], n)
        at = end


def merged(words_in: int, row_first: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the union of the spans; rows never share one."""
    depth = np.cumsum(np.bincount(begins, minlength=words_in + 1) - np.bincount(ends, minlength=words_in + 1))[:words_in] > 0
    before = np.concatenate([[False], depth[:-1]])
    before[row_first[row_first < words_in]] = False
    after = np.concatenate([depth[1:], [False]])
    after[row_first[(row_first > 0)] - 1] = False
    return np.flatnonzero(depth & ~before), np.flatnonzero(depth & ~after) + 1


def judge_shard(shard: pa.RecordBatch, parts: list, wanted: Phrases, clean: bool) -> pa.RecordBatch:
    """One shard's rows with their spans and items; parts: number of words by row, stretches, and words if to clean."""
    counts = np.concatenate([p[0] for p in parts])
    first = np.concatenate([[0], np.cumsum(counts)])
    base = np.cumsum([0, *(int(p[0].sum()) for p in parts)])
    symbols = np.concatenate([p[1] for p in parts])
    places = np.concatenate([np.where(p[2] < 0, -1, p[2] + b) for p, b in zip(parts, base, strict=False)])
    begins, ends, owned = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], set()
    for where, which in occurrences(symbols, places, wanted):
        begins.append(where)
        ends.append(where + wanted.lengths[which])
        row = np.searchsorted(first, where, "right") - 1
        for r, w in np.unique(np.stack([row, which], 1), axis=0).tolist():
            owned.update((r, i) for i in wanted.owners[w].tolist())
    before = shard.column("fm_spans")
    if len(known := before.flatten()):
        of = np.repeat(np.arange(len(shard)), np.diff(before.offsets.to_numpy()))
        begins.append(known.field("first").to_numpy() + first[of])
        ends.append(known.field("end").to_numpy() + first[of])
    begin, end = merged(int(first[-1]), first, np.concatenate(begins), np.concatenate(ends))
    row = np.searchsorted(first, begin, "right") - 1
    names = [set(x) for x in shard.column("fm_items").to_pylist()]
    for r, i in owned:
        if wanted.items[i] is not None:
            names[r].add(wanted.items[i])
    columns = {n: shard.column(n) for n in shard.schema.names}
    spans = pa.StructArray.from_arrays([pa.array((x - first[row]).astype(np.int32)) for x in (begin, end)], ["first", "end"])
    columns["fm_words"] = pa.array(counts.astype(np.int64))
    columns["fm_spans"] = list_array(spans, np.bincount(row, minlength=len(counts)))
    columns["fm_items"] = pa.array([sorted(x) for x in names], pa.list_(pa.string()))
    if clean and len(begin):
        texts = shard.column("text").to_pylist()
        for r in np.unique(row).tolist():
            texts[r] = cut(texts[r], begin[row == r] - first[r], end[row == r] - first[r])
        columns["text"] = pa.array(texts, pa.string())
        columns["fm_cut"] = pa.array(np.isin(np.arange(len(texts)), row) | shard.column("fm_cut").to_numpy(zero_copy_only=False))
    return pa.record_batch(columns)


def cut(text: str, begins: np.ndarray, ends: np.ndarray) -> str:
    """The text without these words and what lies between the words of a span."""
    words = words_of(pa.array([text]), ALNUM)
    raw, out, at = text.encode(), [], 0
    for b, e in zip(words.starts[begins].tolist(), words.ends[ends - 1].tolist(), strict=True):
        out.append(raw[at:b])
        at = e
    return b"".join([*out, raw[at:]]).decode()


def searcher(wanted, clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = wanted.value
        held, parts, size, symbols = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            shard = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out = judge_shard(shard, parts, own, clean)
            if clean:  # a cut can bring the two halves of a window together
                while len(again := np.flatnonzero(pc.list_value_length(out.column("fm_spans")).to_numpy() > 0)):
                    rest = out.filter(pc.equal(pc.list_value_length(out.column("fm_spans")), 0))
                    if rest.num_rows:
                        yield rest
                    hit = out.take(pa.array(again))
                    hit = hit.set_column(hit.schema.get_field_index("fm_spans"), "fm_spans", list_array(hit.column("fm_spans").values.slice(0, 0), np.zeros(len(hit), np.int64)))
                    out = judge_shard(hit, [part(hit)], own, True)
            if out.num_rows:
                yield out

        def part(piece: pa.RecordBatch) -> tuple:
            words = words_of(piece.column("text"), ALNUM)
            return (words.counts(), *stretches(words, own))

        for piece in pieces(batches, "text"):
            held.append(piece)
            parts.append(part(piece))
            size, symbols = size + len(piece) * 64 + int(pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0), symbols + len(parts[-1][1])
            if size >= SHARD_BYTES or symbols >= SHARD_SYMBOLS:
                yield from flush()
                held, parts, size, symbols = [], [], 0, 0
        if held:
            yield from flush()

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", clean: bool = False) -> DataFrame:
    """docs with fm_words (number), fm_spans (merged, in words) and fm_items (ids as text, sorted). With clean, text has
    lost the spans and fm_spans is empty where that happened."""
    spark = docs.sparkSession
    none = phrases(["0"], ["0"])
    none.lengths = none.lengths + (1 << 30)  # an empty query set still counts words

    def passed(rows: DataFrame) -> tuple[DataFrame, int]:
        """rows after all blocks, and how many these were."""
        held, n = [], 0
        for n, found in enumerate(blocks(benchmark, item_id, text), 1):
            if len(held) == PASSES:
                rows = stage(rows, "passes")
                for x in held:
                    x.unpersist()
                held = []
            held.append(spark.sparkContext.broadcast(found))
            rows = rows.mapInArrow(searcher(held[-1], clean), rows.schema)
        return (rows, n) if n else (rows.mapInArrow(searcher(spark.sparkContext.broadcast(none), clean), rows.schema), 1)

    added = {"fm_words": F.lit(0).cast("long"), "fm_spans": F.array().cast(SPANS), "fm_items": F.array().cast("array<string>")}
    out, n = passed(docs.drop("fm_words", "fm_spans", "fm_items", "fm_cut").withColumns(added | ({"fm_cut": F.lit(False)} if clean else {})))
    settled = []
    while clean and n > 1:
        out = stage(out, "cut")
        settled.append(out.where("NOT fm_cut"))
        if (rest := out.where("fm_cut")).isEmpty():
            break
        out, n = passed(rest.withColumn("fm_cut", F.lit(False)))
    return reduce(DataFrame.unionByName, settled or [out]).drop("fm_cut")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("fm_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return docs.select("doc_id", F.col("fm_words").alias("n_words"), n_hit.alias("n_hit"), F.size("fm_items").cast("long").alias("n_items"), F.sha2(F.array_join("fm_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's stage: benchmark passages are cut out of the texts, all rows stay. Other columns travel in one struct,
    so none clashes."""
    others = [c for c in docs.columns if c != "text"]
    out = contaminated(docs.select(F.struct(*(others or [F.lit(0)])).alias("leak_row"), "text"), benchmark, clean=True)
    values = {c: F.col("leak_row")[c] for c in others} | {"text": F.col("text")}
    if "n_chars" in others:
        values["n_chars"] = F.when(F.size("fm_items") == 0, values["n_chars"]).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[values[c].alias(c) for c in docs.columns])


SQL = {
    "op1_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT item_id, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g, least(10, len(w)) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT grams.doc_id, grams.i, grams.n, win.item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
""",
}
