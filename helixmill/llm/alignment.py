"""Cross-tokenizer alignment with corpus-wide counts of linked id pairs.

Each text, with a space before it, is encoded by a byte-level BPE vocabulary (A) and a SentencePiece one (B). Offsets at
which tokens of both end cut the text into groups; an A and a B token whose bytes overlap are linked.

1. Texts are encoded once; ids are written to the shared folder.
2. First pass: each task aligns its documents and counts its linked pairs. The key of a pair falls by hash into one of
   SLICES slices, so a slice holds at most (ids of A) * (ids of B) / SLICES pairs however large the corpus is. Of each
   slice's distinct pairs a task builds a minimal perfect hash: levels of bits, where keys that are alone at their place
   stay and the others go on to the next level; the rank of its bit is a key's index. Counts are then dense vectors by
   index: partial ones, then sums of FAN of them at a time up a tree, until each slice has one.
3. Second pass: tasks align again and look the counts up in the slices, which they read from the shared folder as they
   need them and hold up to HELD bytes of. The key stored at an index is compared with the one looked up.

The largest count of each B id (as many as the vocabulary has) is the only thing broadcast besides the vocabularies.

Null and empty texts, and texts whose tokens do not spell them (B reads U+2581 as a space), have no tokens: zeros and no
groups. Rows that repeat are aligned each on its own, and count each. Columns that the operator adds start with ``al_``;
columns of that name in the input are replaced.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.llm import bpe_tree, sentencepiece_viterbi
from helixmill.llm._common import discard, partitions, shared_dir, stage, table
from helixmill.llm._text import mix, pieces

MODEL_A, MODEL_B = bpe_tree.MODEL, sentencepiece_viterbi.MODEL
SLICES, FAN = 256, 64
#: Pairs of one task that are held before they are written, and bytes of partial counts that one task adds up.
PAIRS, PART_BYTES = 2_000_000, 64 << 20
#: Bytes of count tables that a task of the second pass holds.
HELD = 128 << 20


@dataclass
class Tokens:
    """Both vocabularies: how many bytes an id stands for, and what fits an id."""

    a: bpe_tree.Vocabulary
    b: sentencepiece_viterbi.Vocabulary
    path_b: str

    def __post_init__(self):
        self.size_a, self.size_b = (np.array([len(x) for x in v.spelled], np.int64) for v in (self.a, self.b))
        self.kind_a, self.kind_b = ("<u2" if len(s) <= 1 << 16 else "<u4" for s in (self.size_a, self.size_b))

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint64) * np.uint64(len(self.size_b)) + b.astype(np.uint64)

    def b_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys % np.uint64(len(self.size_b))).astype(np.int64)


def slice_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) % np.uint64(SLICES)).astype(np.int64)


class Pieces:
    """Ids of B by runs of spaces and what follows, which no piece spans; encoded by the vocabulary's own library, with
    a memo in two generations. None stands for a run that its pieces do not spell."""

    def __init__(self, tokens: Tokens):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=tokens.path_b)
        self.spelled, self.kind = tokens.b.spelled, tokens.kind_b
        self.split = sentencepiece_viterbi.words_split_here(tokens.b)
        self.space = [tokens.b.ids[" "]] if " " in tokens.b.ids else []
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.chars = 0

    def texts(self, texts: list[str]) -> list[bytes | None]:
        lanes = [sentencepiece_viterbi.WORD.findall(" " + t) if self.split else [" " + t] for t in texts]
        met = set().union(*lanes)
        found = {w: self.young[w] for w in met if w in self.young}
        new = {w: self.old[w] for w in met if w not in found and w in self.old}
        unmet = [w for w in met if w not in found and w not in new]
        for w, ids in zip(unmet, self.library.encode([w[1:] for w in unmet], num_threads=1), strict=True):
            if w == " " and not ids:  # the library sees an empty text here
                ids = self.space
            new[w] = np.array(ids, self.kind).tobytes() if b"".join(map(self.spelled.__getitem__, ids)) == w.encode() else None
        self.young.update(new)
        self.chars += sum(map(len, new))
        if len(self.young) >= bpe_tree.MEMO or self.chars >= bpe_tree.MEMO_CHARS:
            self.young, self.old, self.chars = {}, self.young, 0
        found |= new
        out = []
        for lane in lanes:
            own = [found[w] for w in lane]
            out.append(None if None in own else b"".join(own))
        return out


def _encoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        first, second = bpe_tree.Encoder(tokens.a), Pieces(tokens)
        for piece in pieces(batches, "text"):
            texts = piece.column("text").to_pylist()
            b = [x if t else None for t, x in zip(texts, second.texts([t or "" for t in texts]), strict=True)]
            a = first.texts([" " + t if x is not None else None for t, x in zip(texts, b, strict=True)])
            keep = [n for n in piece.schema.names if n != "text"]
            columns = [pa.array([np.frombuffer(x, "<u4").astype(tokens.kind_a).tobytes() for x in a], pa.binary()), pa.array([x or b"" for x in b], pa.binary())]
            yield pa.record_batch([*(piece.column(n) for n in keep), *columns], [*keep, "al_a", "al_b"])

    return run


class Aligned:
    """Alignment of all documents of a batch at once, as if they were one text."""

    def __init__(self, batch: pa.RecordBatch, tokens: Tokens):
        blobs = [batch.column(n).to_pylist() for n in ("al_a", "al_b")]
        self.a, self.b = (np.frombuffer(b"".join(x), k) for x, k in zip(blobs, (tokens.kind_a, tokens.kind_b), strict=True))
        self.at_a, self.at_b = (np.cumsum([0, *(len(y) // np.dtype(k).itemsize for y in x)]) for x, k in zip(blobs, (tokens.kind_a, tokens.kind_b), strict=True))
        end_a, end_b = np.cumsum(tokens.size_a[self.a]), np.cumsum(tokens.size_b[self.b])
        self.b_at_a = np.searchsorted(end_b, end_a)  # the B token in which each A token ends
        self.cut_a = end_b[self.b_at_a] == end_a if len(end_a) else np.zeros(0, bool)
        self.cut_b = np.zeros(len(end_b), bool)
        self.cut_b[self.b_at_a[self.cut_a]] = True
        self.alone = np.flatnonzero(~self.cut_b)  # B tokens that end inside an A token
        self.a_at_b = np.searchsorted(end_a, end_b[self.alone])

    def per_row(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[at])

    def keys(self, tokens: Tokens) -> np.ndarray:
        """One for each link: first those at ends of A tokens, then those at ends of B tokens alone."""
        return tokens.key(np.concatenate([self.a, self.a[self.a_at_b]]), np.concatenate([self.b[self.b_at_a], self.b[self.alone]]))

    def link_sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the links' values, by row."""
        rest = np.zeros(len(self.b), np.int64)
        rest[self.alone] = values[len(self.a) :]
        return self.per_row(values[: len(self.a)], self.at_a) + self.per_row(rest, self.at_b)

    def groups(self, spelling: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each row."""
        letters, width = spelling
        group_a, group_b = (np.cumsum(c) - c for c in (self.cut_a, self.cut_b))
        end_a, end_b = np.flatnonzero(self.cut_a) + 1, np.flatnonzero(self.cut_b) + 1
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + np.concatenate([[0], end_b])[group_a]] = 3 * self.a.astype(np.int64) + self.cut_a
        code[np.arange(len(self.b)) + end_a[group_b]] = 3 * self.b.astype(np.int64) + 2 * self.cut_b
        sizes = width[code]
        text = letters[code][np.arange(letters.shape[1]) < sizes[:, None]]
        at = np.concatenate([[0], np.cumsum(sizes)])[self.at_a + self.at_b].tolist()
        return [text[x : max(x, y - 1)].tobytes().decode() for x, y in zip(at[:-1], at[1:], strict=True)]


def spelling(ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each followed by each of `,|;`, as rows of letters and their lengths."""
    rows = [f"{i}{c}".encode() for i in range(ids) for c in ",|;"]
    width = max(map(len, rows), default=1)
    return np.frombuffer(b"".join(r.ljust(width) for r in rows), np.uint8).reshape(-1, width), np.array([len(r) for r in rows], np.int64)


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


PARTIAL = "slice int, part long, keys binary, counts binary"


def _partial_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, n, part = shared.value, [], 0, TaskContext.get().partitionId() << 20

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            return counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

        def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            own = slice_of(keys)
            order = np.argsort(own, kind="stable")
            keys, counts, own = keys[order], counts[order], own[order]
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            ends = np.append(cuts[1:], len(own))
            made = [[x[p:q].tobytes() for p, q in zip(cuts, ends, strict=True)] for x in (keys, counts)]
            return pa.record_batch([pa.array(own[cuts], pa.int32()), pa.array([part] * len(cuts), pa.int64()), *(pa.array(x, pa.binary()) for x in made)], ["slice", "part", "keys", "counts"])

        for piece in pieces(batches, "al_a"):
            found = np.unique(Aligned(piece, tokens).keys(tokens), return_counts=True)
            held.append(found)
            n += len(found[0])
            if n > 2 * PAIRS:
                held = [reduced()]
                n = len(held[0][0])
                if n > PAIRS:
                    yield rows(*held[0])
                    held, n, part = [], 0, part + 1
        if n:
            yield rows(*reduced())

    return run


class PerfectHash:
    """Minimal perfect hash of distinct keys: level by level, keys that are alone at their place set a bit there, and the
    others go on. A key's index is the number of bits set before its own."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.ranks, before = [], 0
        for b in bits:
            upto = np.cumsum(b, dtype=np.int64) + before
            self.ranks.append(upto - b)
            before = int(upto[-1]) if len(upto) else before

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        bits = []
        while len(keys):
            at = cls.places(keys, len(bits), 2 * len(keys))
            alone = np.bincount(at, minlength=2 * len(keys)) == 1
            bits.append(alone)
            keys = keys[~alone[at]]
        return cls(bits)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Of a key that is not one of them: any index, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = self.places(keys[left], level, len(bits))
            here = bits[at]
            out[left[here]] = ranks[at[here]]
            left = left[~here]
        return out

    def packed(self) -> dict[str, np.ndarray]:
        return {"sizes": np.array([len(b) for b in self.bits], np.int64), "bits": np.packbits(np.concatenate([*self.bits, np.zeros(0, bool)]))}

    @classmethod
    def unpacked(cls, found: dict[str, np.ndarray]) -> PerfectHash:
        ends = np.cumsum(found["sizes"])
        flat = np.unpackbits(found["bits"], count=int(ends[-1]) if len(ends) else 0).astype(bool)
        return cls([flat[e - s : e] for s, e in zip(found["sizes"], ends, strict=True)])


def blob(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unblob(raw: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(raw)))


def by_group(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that come sorted by names, group by group."""
    from itertools import groupby

    rows = (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist())
    return groupby(rows, key=lambda r: tuple(r[n] for n in names))


def _distinct(last: bool):
    """Task that unites key lists of a slice; the last one also builds the slice's hash and puts the keys in its order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (s, part), rows in by_group(batches, ["slice", "part"]):
            keys, held, n = np.zeros(0, np.uint64), [], 0
            for r in rows:
                held.append(np.frombuffer(r["keys"], np.uint64))
                n += len(held[-1])
                if n > PAIRS:
                    keys, held, n = np.unique(np.concatenate([keys, *held])), [], 0
            keys = np.unique(np.concatenate([keys, *held]))
            own = keys.tobytes()
            if last:
                hashed = PerfectHash.of(keys)
                ordered = np.empty(len(keys), np.uint64)
                ordered[hashed.index(keys)] = keys
                own = blob(hashed.packed() | {"keys": ordered})
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([part], pa.int64()), pa.array([own], pa.binary())], ["slice", "part", "keys"])

    return run


def _dense():
    """Task that adds partial counts into dense vectors: of a group's rows the hash comes first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (s, part), rows in by_group(batches, ["slice", "part"]):
            hashed = total = None
            for r in rows:
                if r["kind"] == 0:
                    found = unblob(r["keys"])
                    hashed, total = PerfectHash.unpacked(found), np.zeros(len(found["keys"]), np.int64)
                else:
                    total[hashed.index(np.frombuffer(r["keys"], np.uint64))] += np.frombuffer(r["counts"], np.int64)
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slice", "part", "counts"])

    return run


def _sum_vectors():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (s, part), rows in by_group(batches, ["slice", "part"]):
            total = 0
            for r in rows:
                total = total + np.frombuffer(r["counts"], np.int64)
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slice", "part", "counts"])

    return run


TABLES = "slice int, file string, b array<int>, top array<long>"


def _write_tables(shared, folder: str):
    """Task that writes hash, keys and counts of each slice to a file, named anew in each attempt, and tells the largest
    count of each B id in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        for (s,), rows in by_group(batches, ["slice"]):
            found = {}
            for r in rows:
                found |= unblob(r["keys"]) if r["kind"] == 0 else {"counts": np.frombuffer(r["counts"], np.int64)}
            name = uuid.uuid4().hex
            with store.open_output_stream(f"{top}/{name}", compression=None) as out:
                out.write(blob(found))
            b = shared.value.b_of(found["keys"])
            order = np.lexsort((found["counts"], b))
            last = order[np.flatnonzero(np.append(b[order][1:] != b[order][:-1], True))]
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([name]), pa.array([b[last]], pa.list_(pa.int32())), pa.array([found["counts"][last]], pa.list_(pa.int64()))], ["slice", "file", "b", "top"])

    return run


@dataclass
class Counts:
    folder: str
    files: dict[int, str]  # by slice
    top: np.ndarray  # largest count by B id

    def reader(self):
        return CountReader(self)


class CountReader:
    """Counts of keys, from the slices' files; the least lately used ones go when they take over HELD bytes."""

    def __init__(self, counts: Counts):
        self.counts = counts
        self.store, self.top = fs.FileSystem.from_uri(counts.folder)
        self.held: OrderedDict[int, tuple[PerfectHash, np.ndarray, np.ndarray, int]] = OrderedDict()
        self.bytes = 0

    def slice(self, s: int) -> tuple[PerfectHash, np.ndarray, np.ndarray, int]:
        if s in self.held:
            self.held.move_to_end(s)
            return self.held[s]
        with self.store.open_input_stream(f"{self.top}/{self.counts.files[s]}", compression=None) as f:
            found = unblob(f.read())
        hashed = PerfectHash.unpacked(found)
        size = found["keys"].nbytes + found["counts"].nbytes + 9 * int(found["sizes"].sum())
        self.held[s] = (hashed, found["keys"], found["counts"], size)
        self.bytes += size
        while self.bytes > HELD and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1][3]
        return self.held[s]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct keys; 0 for a pair that no document holds."""
        out, own = np.zeros(len(keys), np.int64), slice_of(keys)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1])) if len(keys) else []
        for part in np.split(order, cuts[1:]) if len(keys) else []:
            if (s := int(own[part[0]])) in self.counts.files:
                hashed, stored, counts, _ = self.slice(s)
                at = hashed.index(keys[part])
                same = (at >= 0) & (stored[at] == keys[part])
                out[part[same]] = counts[at[same]]
        return out


def count_pairs(encoded: DataFrame, shared) -> Counts:
    """First pass: corpus-wide counts of all linked pairs of (al_a, al_b)."""
    spark = encoded.sparkSession
    n = partitions(spark)
    partial = stage(encoded.select("al_a", "al_b").mapInArrow(_partial_counts(shared), PARTIAL), "partial")
    size = partial.agg(F.sum(F.octet_length("keys") + F.octet_length("counts"))).first()[0] or 0
    parts = max(2, -(-size // (SLICES * PART_BYTES)))
    tasks = lambda p: max(n, min(SLICES * p, -(-size // PART_BYTES)))
    salted = partial.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(parts)))
    dealt = lambda df, p, *order: df.repartition(tasks(p), "slice", "part").sortWithinPartitions("slice", "part", *order)
    up = lambda df: df.withColumn("part", F.expr(f"part div {FAN}"))
    united, k = dealt(salted.select("slice", "part", "keys"), parts).mapInArrow(_distinct(False), "slice int, part long, keys binary"), parts
    while k > FAN:
        k = -(-k // FAN)
        united = dealt(up(united), k).mapInArrow(_distinct(False), "slice int, part long, keys binary")
    hashes = stage(dealt(united.withColumn("part", F.lit(0).cast("long")), 1).mapInArrow(_distinct(True), "slice int, part long, keys binary"), "hashes")
    first = hashes.select("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(0).alias("kind"), "keys", F.lit(None).cast("binary").alias("counts"))
    both = first.join(salted.select("slice", "part").distinct(), ["slice", "part"], "left_semi").unionByName(salted.select("slice", "part", F.lit(1).alias("kind"), "keys", "counts"))
    vectors, k = dealt(both, parts, "kind").mapInArrow(_dense(), "slice int, part long, counts binary"), parts
    while k > 1:
        k = -(-k // FAN)
        vectors = dealt(up(vectors), k).mapInArrow(_sum_vectors(), "slice int, part long, counts binary")
    folder = shared_dir(spark)
    ready = hashes.select("slice", F.lit(0).alias("kind"), "keys", F.lit(None).cast("binary").alias("counts")).unionByName(vectors.select("slice", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("keys"), "counts"))
    tables = stage(ready.repartition(tasks(1), "slice").sortWithinPartitions("slice", "kind").mapInArrow(_write_tables(shared, folder), TABLES), "tables")
    best = tables.select(F.explode(F.arrays_zip("b", "top")).alias("x")).groupBy("x.b").agg(F.max("x.top").alias("top")).toArrow()  # a row a B id at most
    top = np.zeros(len(shared.value.size_b), np.int64)
    top[best.column("b").to_numpy()] = best.column("top").to_numpy()
    files = {r.slice: r.file for r in tables.select("slice", "file").collect()}  # SLICES rows at most
    discard(partial, hashes)
    return Counts(folder, files, top)


RESULTS = ["al_n_a", "al_n_b", "al_n_groups", "al_n_links", "al_n_best", "al_count_sum"]


def _looked_up(shared, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, reader = shared.value, counts.value.reader()
        spelled = spelling(max(len(tokens.size_a), len(tokens.size_b)))
        for piece in pieces(batches, "al_a"):
            x = Aligned(piece, tokens)
            keys, link = np.unique(x.keys(tokens), return_inverse=True)
            n = reader.of(keys)
            if len(n) and n.min() < 1:
                raise RuntimeError("a linked pair is missing in the count tables")
            best = (n == counts.value.top[tokens.b_of(keys)]).astype(np.int64)
            found = [np.diff(x.at_a), np.diff(x.at_b), x.per_row(x.cut_a, x.at_a), x.link_sums(np.ones(len(link), np.int64)), x.link_sums(best[link]), x.link_sums(n[link])]
            keep = [c for c in piece.schema.names if c not in ("al_a", "al_b")]
            yield pa.record_batch([*(piece.column(c) for c in keep), *(pa.array(v, pa.int64()) for v in found), pa.array(x.groups(spelled), pa.string())], [*keep, *RESULTS, "al_groups"])

    return run


def align(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """docs, text left out, with RESULTS and al_groups."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Tokens(bpe_tree.load(model_a, specials=False), sentencepiece_viterbi.load(model_b), model_b))
    rows = docs.drop("al_a", "al_b", "al_groups", *RESULTS)
    kept = rows.drop("text").schema.fields
    ids = [T.StructField(n, T.BinaryType()) for n in ("al_a", "al_b")]
    encoded = stage(rows.mapInArrow(_encoded(shared), T.StructType([*kept, *ids])), "ids")
    counts = spark.sparkContext.broadcast(count_pairs(encoded, shared))
    made = [*(T.StructField(n, T.LongType()) for n in RESULTS), T.StructField("al_groups", T.StringType())]
    return encoded.mapInArrow(_looked_up(shared, counts), T.StructType([*kept, *made]))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("al_n_a") == 0, "").otherwise(F.sha2("al_groups", 256))
    return found.select("doc_id", *(F.col(n).alias(n[3:]) for n in RESULTS), digest.alias("groups_sha256"))
