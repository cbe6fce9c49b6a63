"""N-gram Jaccard join by rare-first prefix filtering, as groups of linked documents.

A document's set is its distinct word shingles. Equal sets are one class, so copies never meet. Shingles are ordered
rare first, by the size class of their count in a sketch of fixed size over all documents, then by hash; two sets with
enough overlap share a shingle among the first few of each (the prefix). Prefix entries are range-partitioned by shingle
and sorted, so a shingle of any frequency streams through several tasks. Pairs pass the length and the positional
filter, are made distinct, pass a suffix filter on counts of their shingles by parts, and are verified once.

Only groups are asked for, so not all pairs of a group of near copies are needed: first every entry is paired with its
shingle's most central set, the one that shares the largest part of its own prefix, which is what copies were made of;
then, where classes are not yet in one group, with sets drawn by hash; such a set has then met all entries of its shingle
and leaves it. Then every remaining pair of entries whose classes are still apart is tested, shingle by shingle and size
class by size class, so that no link between groups is lost. A pair that was verified once is never verified again, whether it held or not.

Texts stay where they are: the filters read prefix entries and counts, and only for pairs that pass them are the
documents read once more, through a sieve of fixed size, and the shingles of the sets in question fetched.

Nulls and texts without words have empty sets and link with nothing. Rows that repeat a doc_id are documents of their
own with that id; a null doc_id has no place in component_id (null if a group has no other). Longer texts than 2**24
shingles are not told apart by size in the filters, only by verification. Columns added start with ``jac_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm._common import WORD_CLASS, discard, partitions, row_key, stage, table
from helixmill.llm._text import LOWERED, gram_hashes, list_array, mix, pieces, range_hashes, words_of
from helixmill.llm.graph import components

#: The query's contract; other callers name their own words a shingle and percent.
SHINGLE, PERCENT = 4, 85
SLOTS, CHUNKS = 1 << 18, 256
#: Parts into which a set's shingles are counted by hash, for the suffix filter: COARSE ones go along with entries, the
#: finer ones are compared once for each pair before its shingles are fetched.
PARTS, COARSE = 512, 64
#: Bits of the sieve through which documents are read again.
SIEVE = 1 << 23
SETS = "doc_id long, jac_key long, n long, f1 long, f2 long, shape array<tinyint>, scale int"
FETCHED = "jac_key long, tokens binary"
ENTRIES = "token long, cid long, info long"
MOST = (1 << 24) - 1
DRAW_ROUNDS = 1


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def least_overlap(x, y, percent: int):
    """Shingles that sets of these sizes must share."""
    return (percent * (x + y) + 100 + percent - 1) // (100 + percent)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (repeats too), and where each row's begin."""
    words = words_of(column, LOWERED)
    hashes, counts = words.hashes(), words.counts()
    grams = gram_hashes(hashes, size)
    n = np.where(counts >= size, counts - size + 1, counts > 0)
    first = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(counts)), n)
    at = words.first[row] + np.arange(first[-1]) - first[row]
    out = np.zeros(first[-1], np.uint64)
    long = counts[row] >= size
    out[long] = grams[at[long]]
    short = np.flatnonzero((counts > 0) & (counts < size))
    out[first[short]] = range_hashes(hashes, words.first[short], words.first[short + 1])
    return out, first


def sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for piece in pieces(batches, "text"):
            counts += np.bincount((shingles(piece.column("text"), size)[0] & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        parts = counts.reshape(CHUNKS, -1)
        yield pa.record_batch([pa.array(range(CHUNKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["chunk", "counts"])

    return run


def add_up(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist())
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def rarity(docs: DataFrame, size: int) -> np.ndarray:
    """Size class of the count in each slot of the sketch: SLOTS bytes, whatever the number of documents."""
    parts = docs.select("text").mapInArrow(sketch(size), "chunk int, counts binary").groupBy("chunk").applyInArrow(add_up, "chunk int, counts binary")
    levels = np.zeros((CHUNKS, SLOTS // CHUNKS), np.uint8)
    for chunk, counts in parts.collect():
        levels[chunk] = np.ceil(np.log2(np.frombuffer(counts, np.int64) + 1)).astype(np.uint8)
    return levels.reshape(-1)


def tokens(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles as numbers in rare-first order."""
    return (levels[(grams & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (grams >> np.uint64(7))


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def row_sets(column: pa.Array, levels: np.ndarray, size: int) -> list[np.ndarray]:
    grams, first = shingles(column, size)
    every = tokens(grams, levels)
    return [distinct_sorted(every[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def prints(own: np.ndarray) -> tuple[int, int]:
    one = mix(own)
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def set_rows(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            sets = row_sets(piece.column("text"), shared.value, size)
            marks = [prints(x) for x in sets]
            counts = np.stack([np.bincount((x & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) for x in sets])
            scales = 1 << np.ceil(np.log2(np.maximum(counts.max(1) / 127, 1))).astype(np.int64)
            shapes = list_array(pa.array(np.ceil(counts / scales[:, None]).astype(np.int8).reshape(-1)), np.full(len(sets), PARTS))
            yield pa.record_batch([piece.column("doc_id"), piece.column("jac_key"), pa.array([len(x) for x in sets], pa.int64()), *(pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1)), shapes, pa.array(scales.astype(np.int32))], ["doc_id", "jac_key", "n", "f1", "f2", "shape", "scale"])

    return run


def entry_rows(shared, size: int, percent: int):
    """Prefix entries; a task that meets a set again does not repeat them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for piece in pieces(batches, "text"):
            out, cids, infos = [], [], []
            for own in row_sets(piece.column("text"), shared.value, size):
                if not len(own) or (mark := prints(own)) in seen:
                    continue
                seen.add(mark)
                n, p = len(own), prefix_length(len(own), percent)
                out.append(own[:p])
                cids.append(np.full(p, mark[0], np.int64))
                infos.append((min(n, MOST) << 24) + np.minimum(np.arange(p), MOST))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(cids)), pa.array(np.concatenate(infos).astype(np.int64))], ["token", "cid", "info"])

    return run


def stream_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries: those of shingles that two sets have go on, repeated ones once. The next task may have more of
    the first and last shingle here, so theirs always go on. Holds one row back."""
    token = cid = info = np.zeros(0, np.int64)
    known, border = False, None  # whether the row held back follows one of its shingle; the first shingle
    for batch in batches:
        t, c, i = (np.concatenate([old, batch.column(k).to_numpy()]) for k, old in enumerate((token, cid, info)))
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c, i = t[new], c[new], i[new]
        border = t[0] if border is None else border
        same = np.append(known, t[1:] == t[:-1])
        keep = (same[:-1] | same[1:]) | (t[:-1] == border)
        yield pa.record_batch([pa.array(x[:-1][keep]) for x in (t, c, i)], ["token", "cid", "info"])
        known, (token, cid, info) = bool(same[-1]), (x[-1:] for x in (t, c, i))
    if len(token):
        yield pa.record_batch([pa.array(x) for x in (token, cid, info)], ["token", "cid", "info"])


def suffix_allows(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Bound on the overlap from how many shingles of each set fall between eight shingles of one."""
    cuts = b[np.arange(1, 8) * len(b) // 8]
    x, y = (np.diff(np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]])) for s in (a, b))
    return int(np.minimum(x, y).sum()) >= need


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    need = least_overlap(len(a), len(b), percent)
    if min(len(a), len(b)) < need or not suffix_allows(a, b, need):
        return False
    both = np.sort(np.concatenate([a, b]))
    return int(np.count_nonzero(both[1:] == both[:-1])) >= need


def sieve(keys: DataFrame) -> np.ndarray:
    """SIEVE bits, whatever the number of keys, in which a key's bit is set; other keys may have theirs set too."""
    at = F.pmod("key", F.lit(SIEVE)) + 1
    rows = keys.select(F.bitmap_bucket_number(at).alias("chunk"), F.bitmap_bit_position(at).alias("bit")).groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(SIEVE // 8, np.uint8)
    for chunk, bits in rows:
        out[(chunk - 1) * len(bits) : chunk * len(bits)] = np.frombuffer(bits, np.uint8)
    return np.unpackbits(out, bitorder="little").astype(bool)


def token_rows(levels, wanted, size: int):
    """Shingles of the documents that the sieve lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = wanted.value[batch.column("jac_key").to_numpy() % SIEVE]
            for piece in pieces(iter([batch.filter(pa.array(hit))]), "text"):
                sets = row_sets(piece.column("text"), levels.value, size)
                yield pa.record_batch([piece.column("jac_key"), pa.array([x.tobytes() for x in sets], pa.binary())], ["jac_key", "tokens"])

    return run


def verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("tokens_a", "tokens_b"))
            good = pa.array([linked(x, y, percent) for x, y in zip(one, two, strict=True)], pa.bool_())
            yield pa.record_batch([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    return run


def coarse(shape: Column) -> Column:
    """Counts by COARSE parts from those by PARTS."""
    return F.transform(F.sequence(F.lit(0), F.lit(COARSE - 1)), lambda i: reduce(Column.__add__, [F.get(shape, i + k).cast("int") for k in range(0, PARTS, COARSE)]).cast("smallint"))


def similarity_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row a document (doc_id, jac_key, n: size of its set, component_id, jac_group: label of its group of linked
    sets, whatever their ids; null where the set is empty)."""
    spark = docs.sparkSession
    n_parts = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("jac_key"), "text")
    levels = spark.sparkContext.broadcast(rarity(rows, shingle))
    sets = stage(rows.mapInArrow(set_rows(levels, shingle), SETS), "sets")
    classes = sets.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("least"), F.min("jac_key").alias("key"), F.min(F.struct("n", "shape", "scale")).alias("s"))
    classes = stage(classes.select("f1", "f2", "least", "key", "s.n", F.col("s.shape").alias("fine"), coarse(F.col("s.shape")).alias("shape"), "s.scale"), "classes")
    entries = rows.mapInArrow(entry_rows(levels, shingle, percent), ENTRIES)
    order = ["token", "info", "cid"]
    live = stage(entries.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(stream_entries, ENTRIES), "entries")
    tested: list[DataFrame] = []  # pairs that were verified, by round
    fetched: list[DataFrame] = []  # shingles of the sets in them

    def shaped(x: str, *shapes: str) -> DataFrame:
        return classes.select(F.col("f1").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in (*shapes, "n", "scale")])

    def overlap_allows(shape: str = "shape") -> Column:
        each = F.zip_with(f"{shape}_a", f"{shape}_b", lambda x, y: F.least(x * F.col("scale_a"), y * F.col("scale_b")))
        most = F.aggregate(each, F.lit(0).cast("long"), lambda total, x: total + x)
        return (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))

    def could_link(pairs: DataFrame) -> DataFrame:
        """Suffix filter: no more shingles can be shared than both sets have in each part."""
        return pairs.join(shaped("a", "fine"), "a").join(shaped("b", "fine"), "b").where(overlap_allows("fine")).select("a", "b")

    def fetch(pairs: DataFrame) -> None:
        """Shingles of the sets of these pairs, unless an earlier round fetched them."""
        ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        for known in fetched:
            ids = ids.join(known.select("cid"), "cid", "left_anti")
        keys = stage(ids.join(classes.select(F.col("f1").alias("cid"), "key"), "cid"), "wanted")
        through = spark.sparkContext.broadcast(sieve(keys))
        found = rows.select("jac_key", "text").mapInArrow(token_rows(levels, through, shingle), FETCHED)
        found = found.join(keys, F.col("jac_key") == F.col("key")).dropDuplicates(["cid"]).select("cid", "tokens")
        fetched.append(stage(found, "fetched"))

    def checked(pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) that link; of a pair in both directions one. Many b may be the same set."""
        lo, hi = F.least("a", "b"), F.greatest("a", "b")
        once = pairs.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.min("a").alias("a"))
        for old in tested:
            once = once.join(old.select(lo.alias("lo"), hi.alias("hi")), ["lo", "hi"], "left_anti")
        new = once.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))
        new = stage(could_link(new), "pairs")
        tested.append(new)
        if new.isEmpty():
            return new
        fetch(new)
        tokens = reduce(DataFrame.unionByName, fetched)
        with_a = new.join(tokens.select(F.col("cid").alias("a"), F.col("tokens").alias("tokens_a")), "a")
        both = with_a.join(tokens.select(F.col("cid").alias("b"), F.col("tokens").alias("tokens_b")), "b")
        return stage(both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(verify(percent), "a long, b long"), "links")

    size, place = (lambda c: F.shiftright(c, 24).bitwiseAND(F.lit(MOST))), (lambda c: F.col(c).bitwiseAND(F.lit(MOST)))

    def fits(a: str, b: str):
        """Length and positional filter on two entries of a shingle."""
        x, y, p, q = size(a), size(b), place(a), place(b)
        huge = F.greatest(x, y) >= MOST
        return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & ((100 + percent) * (1 + F.least(x - p - 1, y - q - 1)) >= percent * (x + y)) | huge

    def met(rows: DataFrame, draw) -> DataFrame:
        """Every entry with the entry of its shingle that comes first by draw (the lead, as b), and how many the shingle
        has. A lead meets all others of its shingle, so it need not stay in it."""
        first = F.max(F.struct(draw.alias("by"), F.col("cid").alias("b"), F.col("info").alias("b_info"), F.col("g").alias("b_g")))
        leads = stage(rows.groupBy("token").agg(first.alias("x"), F.count("*").alias("k")).where("k > 1").select("token", "x.b", "x.b_info", "x.b_g", "k"), "leads")
        out = stage(rows.join(leads, "token").where("cid <> b"), "met")
        discard(leads)
        return out

    def with_leads(rows: DataFrame) -> DataFrame:
        return checked(rows.where((F.col("g") != F.col("b_g")) & fits("info", "b_info")).select(F.col("cid").alias("a"), "b").distinct())

    def regrouped(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The groups so far, and the entries of shingles that more than one group still has without their leads."""
        groups = components(links)
        named = rows.where("k > 2").join(groups, F.col("cid") == F.col("node"), "left").select("token", "cid", "info", F.coalesce("label", "cid").alias("g"))
        named = stage(named, "grouped")
        split = stage(named.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("token"), "split")
        rest = stage(named.join(split, "token"), "apart")
        discard(named, split, rows)
        return groups, rest

    sizes = live.groupBy("cid").agg(F.count("*").alias("c"), F.max(size("info")).alias("n"))
    share = stage(sizes.select("cid", F.expr(f"c * 1000000 div greatest(n - ({percent} * n + 99) div 100 + 1, 1)").alias("share")), "share")
    central = stage(live.join(share, "cid").select("token", "cid", "info", F.col("cid").alias("g"), "share"), "central")
    discard(live, share)
    entered = met(central, F.col("share")).drop("share")
    discard(central)
    links = with_leads(entered)
    groups, rest = regrouped(entered, links)
    for k in range(DRAW_ROUNDS):
        if rest.isEmpty():
            break
        entered = met(rest, F.xxhash64("token", "cid", F.lit(k)))
        discard(rest)
        links = links.unionByName(with_leads(entered))
        groups, rest = regrouped(entered, links)
    if not rest.isEmpty():
        # the suffix filter is part of this join, the finer one where the coarse one allows a pair; else the join would
        # make all pairs of a family of texts not quite alike
        a, b = (rest.select("token", F.col("cid").alias(x), F.col("info").alias(f"info_{x}"), F.col("g").alias(f"g_{x}")).join(shaped(x, "shape", "fine"), x) for x in "ab")
        band = lambda n: F.floor(F.log2(n)).cast("int")
        a = a.withColumn("band", band(F.col("n_a")))
        b = b.withColumn("band", F.explode(F.sequence(band(F.col("n_b") * (percent / 101)), band(F.col("n_b")))))
        smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
        pairs = a.join(b, ["token", "band"]).where(smaller & (F.col("g_a") != F.col("g_b")) & fits("info_a", "info_b") & F.when(overlap_allows(), overlap_allows("fine")).otherwise(False)).select("a", "b").distinct()
        groups = components(links.unionByName(checked(pairs)))
    discard(*fetched)
    labelled = classes.join(groups, F.col("f1") == F.col("node"), "left").select("f1", "f2", "least", F.coalesce("label", "f1").alias("label"), F.col("label").isNull().alias("alone"))
    labelled = stage(labelled, "labelled")
    lowest = stage(labelled.where("NOT alone").groupBy("label").agg(F.min("least").alias("low")), "lowest")
    known = stage(labelled.join(lowest, "label", "left").select("f1", "f2", F.when(F.col("alone"), F.col("least")).otherwise(F.col("low")).alias("component"), F.col("label").alias("jac_group")), "known")
    return sets.join(known, ["f1", "f2"], "left").select("doc_id", "jac_key", "n", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.when(F.col("n") > 0, F.col("jac_group")).alias("jac_group"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pipeline's stage: of each group the document with the smallest doc_id stays (one row of it; a null id comes
    last). Texts without words link with nothing, so all of their rows stay."""
    keep = similarity_groups(docs, shingle, percent).where("n > 0").groupBy("jac_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "jac_key")).alias("x"))
    keep = stage(keep.select(F.col("x.doc_id").alias("jac_keep"), F.col("x.jac_key").alias("jac_keep_key")), "keep")
    packed = docs.select(F.struct(*docs.columns).alias("jac_row"), "doc_id", "text")  # so that no column of docs can clash
    wordy = F.coalesce(F.col("text").rlike(WORD_CLASS), F.lit(False))
    keyed = packed.where(wordy).withColumn("jac_key", row_key()).join(keep.hint("shuffle_hash"), F.col("jac_key") == F.col("jac_keep_key"))
    chosen = keyed.where(F.col("doc_id").eqNullSafe(F.col("jac_keep"))).dropDuplicates(["jac_key"])
    return chosen.select("jac_row.*").unionByName(packed.where(~wordy).select("jac_row.*"))


SQL = {
    "op3_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
c AS (SELECT s.doc_id, s.g FROM s JOIN common ON s.g = common.g),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM c x JOIN c y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON d.doc_id = r.a
""",
}
