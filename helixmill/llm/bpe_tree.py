"""BPE encoding and decoding by tree concatenation.

A text is split by the vocabulary's pattern; each word's merges are looked up in a bounded memo. What is long is never
merged as a whole, on two levels:

- A word of more than HALF bytes is cut in halves down to HALF bytes, the halves are encoded, and joined pair by pair up
  the tree. At each join a window of tokens on both sides is encoded again; a side on which the window's outermost token
  is not the one that stood there widens the window. Once both sides agree, every two neighbours are tokens that merges
  leave apart, and a sequence with that property is what merging the whole word gives.
- A text of more than LONG_CHARS characters is cut into parts, which Spark deals to all tasks. Parts are joined pair by
  pair up a tree too: splitting starts again where the left part's words are still certain and goes on until it meets an
  end of a word of the right part; a word across the join is joined from its two halves as above.

The vocabulary file (byte-level BPE, the format of the tokenizers library) is a parameter; the driver reads it and
broadcasts its merges, whose number the file bounds. Ids and decoded texts equal that library's.

Null texts get null ids and an empty text none. Rows that repeat are encoded each on its own, but long equal texts only
once. Columns that the operator adds start with ``bpe_``; columns of that name in the input are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.llm._common import table
from helixmill.llm._text import pieces

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: The pattern that splits text before merges: fixed by the vocabulary.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters that the pattern looks at from where a word starts, or beyond its end.
LOOKS = 3
#: Most bytes of a word that is merged at once.
HALF = 32
#: Texts of more characters are cut into parts of so many.
LONG_CHARS = 1 << 15
#: Most words, and characters in them, of a generation of the memo.
MEMO, MEMO_CHARS = 400_000, 16_000_000
#: From here on characters may be newer than the library that a vocabulary was made with.
RARE = re.compile("[Ԁ-\U0010ffff]")
LETTER_OR_NUMBER = regex.compile(r"[\p{L}\p{N}]")
NOT_A_LETTER = "͸"  # stands, one for one, for characters that the library does not know as letters yet


@dataclass
class Vocabulary:
    path: str
    merges: dict[tuple[int, int], int]  # two ids -> rank
    made: list[int]  # merged id by rank
    byte_ids: list[int]
    spelled: list[bytes]  # by id
    specials: dict[str, int] = field(default_factory=dict)


def byte_letters() -> dict[str, int]:
    """Printable Latin-1 letters stand for their own byte, letters from U+0100 on for the others in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(path: str = MODEL, specials: bool = True) -> Vocabulary:
    """specials: whether strings of special tokens in a text become these tokens, or are plain text."""
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    before, model = stated["pre_tokenizer"], stated["model"]
    if stated["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True) or model["type"] != "BPE" or model.get("ignore_merges"):
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    letters = byte_letters()
    added = {x["content"]: x["id"] for x in stated["added_tokens"]}
    ids = model["vocab"]
    spelled = [b""] * (max([*ids.values(), *added.values()]) + 1)
    for token, i in ids.items():
        spelled[i] = bytes(letters[c] for c in token)
    for token, i in added.items():
        spelled[i] = token.encode()
    halves = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    merges = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(halves)}
    by_byte = {b: ids[c] for c, b in letters.items()}
    return Vocabulary(path, merges, [ids[a + b] for a, b in halves], [by_byte[b] for b in range(256)], spelled, added if specials else {})


class Lanes:
    """Merges of many short words in step: of every word, all pairs of its lowest rank at a time."""

    def __init__(self, v: Vocabulary):
        self.byte_ids, self.made = np.array(v.byte_ids, np.int64), np.array(v.made, np.int64)
        pairs = np.array(list(v.merges), np.int64).reshape(-1, 2)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], -1)
        self.none = len(keys)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys[:-1], key)
        found = self.keys[at] == key
        out = np.full(len(key), self.none, np.int64)
        out[found] = self.order[at[found]]
        return out

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; none is empty."""
        size = np.array([len(w) for w in words], np.int64)
        ids, word = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), size)
        done_ids, done_words = [], []
        while len(ids):
            first = np.append(True, word[1:] != word[:-1])
            rank = np.append(self.ranks(ids[:-1], ids[1:]), self.none)
            rank[:-1][first[1:]] = self.none
            starts = np.flatnonzero(first)
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            going = best < self.none
            done_ids.append(ids[~going])
            done_words.append(word[~going])
            take = going & (rank == best)
            inner = take & np.append(False, take[:-1])  # in a run of equal pairs every other one, from the left
            if inner.any():
                at = np.arange(len(take))
                begin = np.maximum.accumulate(np.where(take & ~inner, at, 0))
                take &= (at - begin) % 2 == 0
            ids = np.where(take, self.made[np.minimum(rank, self.none - 1)], ids)
            keep = going & ~np.append(False, take[:-1])
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        ids = ids[np.argsort(word, kind="stable")].astype("<u4")
        return np.split(ids, np.cumsum(np.bincount(word, minlength=len(words)))[:-1])


def merge_many(ids: list[int], v: Vocabulary) -> list[int]:
    """Merges of a wide window, lowest rank first, equal ones from the left: a queue of pairs over a linked list."""
    n, merges = len(ids), v.merges
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(merges[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in merges]
    heapq.heapify(queue)
    while queue:
        rank, k = heapq.heappop(queue)
        m = after[k]
        if ids[k] < 0 or m >= n or merges.get((ids[k], ids[m])) != rank:
            continue
        ids[k], ids[m], after[k] = v.made[rank], -1, after[m]
        if after[m] < n:
            before[after[m]] = k
        for a, b in ((before[k], k), (k, after[k])):
            if a >= 0 and b < n and (p := (ids[a], ids[b])) in merges:
                heapq.heappush(queue, (merges[p], a))
    return [i for i in ids if i >= 0]


class Encoder:
    """Words to ids, with a memo in two generations: when the young one is full it grows old, and what was old and not
    met since goes."""

    def __init__(self, v: Vocabulary, half: int = HALF):
        self.v, self.half, self.young, self.old, self.chars = v, half, {}, {}, 0
        self.lanes = Lanes(v)
        self.special = re.compile("|".join(re.escape(s) for s in sorted(v.specials, key=len, reverse=True))) if v.specials else None
        self.margin = LOOKS + max([0, *map(len, v.specials)])
        self.unlike: dict[str, bool] = {}
        self.splitter = None

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Merges of each without halving: short ones in step, wide windows one by one."""
        out: list = [None] * len(words)
        few = [k for k, w in enumerate(words) if len(w) <= 4 * self.half]
        for k, ids in zip(few, self.lanes.merge([words[k] for k in few]) if few else [], strict=True):
            out[k] = ids
        for k, w in enumerate(words):
            if out[k] is None:
                out[k] = np.array(merge_many([self.v.byte_ids[x] for x in w], self.v), "<u4")
        return out

    def from_bytes(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: of long ones from their halves, all words' halves in step, and then level by level."""
        cut = [[w[k : k + self.half] for k in range(0, len(w), self.half)] for w in words]
        blocks = iter(self.merged([x for c in cut for x in c]))
        level = [[next(blocks) for _ in c] for c in cut]
        while long := [k for k, c in enumerate(level) if len(c) > 1]:
            pairs = [(k, m) for k in long for m in range(0, len(level[k]) - 1, 2)]
            met = dict(zip(pairs, self.joined([(level[k][m], level[k][m + 1]) for k, m in pairs]), strict=True))
            for k in long:
                level[k] = [met.get((k, m), level[k][m]) for m in range(0, len(level[k]), 2)]
        return [c[0] for c in level]

    def joined(self, halves: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Ids of two halves of a word put together, for many words."""
        out: list = [None] * len(halves)
        live = [(k, min(2, len(x)), min(2, len(y))) for k, (x, y) in enumerate(halves)]
        while live:
            windows = [np.concatenate([halves[k][0][len(halves[k][0]) - a :], halves[k][1][:b]]).tolist() for k, a, b in live]
            wider = []
            for (k, a, b), window, again in zip(live, windows, self.merged([b"".join(map(self.v.spelled.__getitem__, w)) for w in windows]), strict=True):
                left, right = halves[k]
                more_left, more_right = a < len(left) and again[0] != window[0], b < len(right) and again[-1] != window[-1]
                if more_left or more_right:
                    wider.append((k, min(len(left), a * 2 if more_left else a), min(len(right), b * 2 if more_right else b)))
                else:
                    out[k] = np.concatenate([left[: len(left) - a], again, right[b:]])
            live = wider
        return out

    def known_as_letters(self, text: str) -> str:
        """Letters and numbers that this Python's pattern knows and the library does not, replaced one for one."""
        new = [c for c in set(text) if c > "Ԁ" and unicodedata.category(c) == "Cn" and LETTER_OR_NUMBER.match(c)]
        for c in new:
            if c not in self.unlike:
                if self.splitter is None:
                    from tokenizers import pre_tokenizers

                    self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
                self.unlike[c] = all(len(self.splitter.pre_tokenize_str(x + c)) > 1 for x in "a1")
        gone = {ord(c): NOT_A_LETTER for c in new if self.unlike[c]}
        return text.translate(gone) if gone else text

    def plain_words(self, text: str) -> list[str]:
        if RARE.search(text) and (seen := self.known_as_letters(text)) is not text:
            return [text[m.start() : m.end()] for m in PATTERN.finditer(seen)]
        return PATTERN.findall(text)

    def words(self, text: str) -> list[str]:
        """Words and special strings, in order."""
        if self.special is None or not self.special.search(text):
            return self.plain_words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.plain_words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.plain_words(text[at:])

    def lookup(self, words: set[str]) -> dict[str, bytes]:
        """Ids by word, as little-endian 32-bit integers."""
        found = {w: self.young[w] for w in words if w in self.young}
        new = {w: self.old[w] for w in words if w not in found and w in self.old}
        unmet = [w for w in words if w not in found and w not in new]
        plain = [w for w in unmet if w not in self.v.specials]
        new.update(zip(plain, (x.tobytes() for x in self.from_bytes([w.encode() for w in plain])), strict=True))
        new.update((w, np.array([self.v.specials[w]], "<u4").tobytes()) for w in unmet if w in self.v.specials)
        self.young.update(new)
        self.chars += sum(map(len, new))
        if len(self.young) >= MEMO or self.chars >= MEMO_CHARS:
            self.young, self.old, self.chars = {}, self.young, 0
        return found | new

    def texts(self, texts: list[str | None]) -> list[bytes]:
        split = [self.words(t) if t else [] for t in texts]
        known = self.lookup(set().union(*split))
        return [b"".join(map(known.__getitem__, x)) for x in split]


@dataclass
class Run:
    """An encoded part of a text: its words' ends in characters, and the ids up to each of them."""

    text: str
    ends: np.ndarray
    upto: np.ndarray
    ids: np.ndarray


def run_of(encoder: Encoder, text: str) -> Run:
    words = encoder.words(text)
    found = encoder.lookup(set(words))
    own = [found[w] for w in words]
    return Run(text, np.cumsum([len(w) for w in words]), np.cumsum([len(x) // 4 for x in own]), np.frombuffer(b"".join(own), "<u4"))


def joined_runs(encoder: Encoder, left: Run, right: Run) -> Run:
    """Two neighbouring parts as one."""
    cut = len(left.text)
    sure = int(np.searchsorted(left.ends, cut - encoder.margin, "right"))  # words that nothing to the right can change
    start = int(left.ends[sure - 1]) if sure else 0
    kept = int(left.upto[sure - 1]) if sure else 0
    reach = max(encoder.margin, 64)
    while True:  # split again from there on, so far to the right that a word's end there is certain and an end of right
        whole = left.text[start:] + right.text[:reach]
        words = encoder.words(whole)
        ends = start + np.cumsum([len(w) for w in words])
        certain = ends <= (cut + len(right.text) if reach >= len(right.text) else cut + reach - encoder.margin)
        met = np.flatnonzero(certain & (ends >= cut + encoder.margin - LOOKS) & np.isin(ends - cut, right.ends))
        if len(met) or reach >= len(right.text):
            break
        reach *= 2
    n = int(met[0]) + 1 if len(met) else len(words)
    words, ends = words[:n], ends[:n]
    own = []
    for w, end in zip(words, ends.tolist(), strict=True):
        begin = end - len(w)
        k, m = int(np.searchsorted(left.ends, begin, "right")), int(np.searchsorted(right.ends, end - cut))
        if begin < cut < end and w not in encoder.v.specials and k == len(left.ends) - 1 and (begin == 0 or left.ends[k - 1] == begin) and m == 0 and right.ends[0] == end - cut:
            ids = encoder.joined([(left.ids[left.upto[k - 1] if k else 0 :], right.ids[: right.upto[0]])])[0]
        else:
            ids = np.frombuffer(encoder.lookup({w})[w], "<u4")
        own.append(np.asarray(ids, "<u4"))
    rest = int(np.searchsorted(right.ends, ends[-1] - cut, "right")) if n else 0
    skipped = int(right.upto[rest - 1]) if rest else 0
    middle = kept + np.cumsum([len(x) for x in own], dtype=np.int64)
    before = int(middle[-1]) if n else kept
    return Run(
        left.text + right.text,
        np.concatenate([left.ends[:sure], ends, cut + right.ends[rest:]]).astype(np.int64),
        np.concatenate([left.upto[:sure], middle, before + right.upto[rest:] - skipped]).astype(np.int64),
        np.concatenate([left.ids[:kept], *own, right.ids[skipped:]]).astype("<u4"),
    )


def joined_tree(encoder: Encoder, runs: list[Run]) -> Run:
    while len(runs) > 1:
        runs = [joined_runs(encoder, *runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return runs[0]


def _encode_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for piece in pieces(batches, "text"):
            texts = piece.column("text").to_pylist()
            keep = [n for n in piece.schema.names if n != "text"]
            ids = [None if t is None else x for t, x in zip(texts, encoder.texts(texts), strict=True)]
            yield pa.record_batch([*(piece.column(n) for n in keep), pa.array(ids, pa.binary())], [*keep, "bpe_ids"])

    return run


def _cut_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            for key, text in zip(piece.column("bpe_key").to_pylist(), piece.column("text").to_pylist(), strict=True):
                cut = [text[k : k + size] for k in range(0, len(text), size)]
                yield pa.record_batch([pa.array([key] * len(cut)), pa.array(range(len(cut)), pa.int32()), pa.array(cut)], ["bpe_key", "bpe_part", "text"])

    return run


PARTS = "bpe_key string, bpe_part int, text string, bpe_ends binary, bpe_upto binary, bpe_ids binary"


def _encode_parts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for piece in pieces(batches, "text"):
            runs = [run_of(encoder, t) for t in piece.column("text").to_pylist()]
            made = [pa.array([x.tobytes() for x in y], pa.binary()) for y in ([r.ends.astype(np.int64) for r in runs], [r.upto.astype(np.int64) for r in runs], [r.ids for r in runs])]
            yield pa.record_batch([piece.column("bpe_key"), piece.column("bpe_part"), piece.column("text"), *made], [x.split()[0] for x in PARTS.split(", ")])

    return run


def _join_parts(shared):
    made: list[Encoder] = []  # one a task

    def run(parts: pa.Table) -> pa.Table:
        if not made:
            made.append(Encoder(shared.value))
        parts = parts.sort_by("bpe_part")
        read = lambda n, t: [np.frombuffer(x, t) for x in parts.column(n).to_pylist()]
        runs = list(map(Run, parts.column("text").to_pylist(), read("bpe_ends", np.int64), read("bpe_upto", np.int64), read("bpe_ids", "<u4")))
        return pa.table({"bpe_key": parts.column("bpe_key").slice(0, 1), "bpe_ids": pa.array([joined_tree(made[0], runs).ids.tobytes()], pa.binary())})

    return run


def encode_packed(docs: DataFrame, model: str = MODEL, specials: bool = True, long_chars: int = LONG_CHARS) -> DataFrame:
    """docs, text replaced by bpe_ids: ids as little-endian unsigned 32-bit integers, one after another."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model, specials))
    rows = docs.drop("bpe_ids", "bpe_key", "bpe_part")
    kept = T.StructType([*rows.drop("text").schema.fields, T.StructField("bpe_ids", T.BinaryType())])
    is_long = F.coalesce(F.char_length("text") > long_chars, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_encode_rows(shared), kept)
    long = rows.where(is_long).withColumn("bpe_key", F.sha2("text", 256))
    parts = long.select("bpe_key", "text").mapInArrow(_cut_rows(long_chars), "bpe_key string, bpe_part int, text string").dropDuplicates(["bpe_key", "bpe_part"])
    whole = parts.mapInArrow(_encode_parts(shared), PARTS).groupBy("bpe_key").applyInArrow(_join_parts(shared), "bpe_key string, bpe_ids binary")
    return short.unionByName(long.drop("text").join(whole, "bpe_key").select(*kept.names))


def encode(docs: DataFrame, model: str = MODEL, specials: bool = True) -> DataFrame:
    """docs, text replaced by bpe_ids, an array."""
    rows = encode_packed(docs, model, specials)
    fields = [*rows.drop("bpe_ids").schema.fields, T.StructField("bpe_ids", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [n for n in batch.schema.names if n != "bpe_ids"]
            lists = [None if x is None else np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("bpe_ids").to_pylist()]
            yield pa.record_batch([*(batch.column(n) for n in keep), pa.array(lists, pa.list_(pa.int64()))], [*keep, "bpe_ids"])

    return rows.mapInArrow(run, T.StructType(fields))


def decode_packed(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows with packed bpe_ids get bpe_text (null ids: null); bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = shared.value.spelled
        for batch in pieces(batches, "bpe_ids"):
            ids = [None if x is None else np.frombuffer(x, "<u4").tolist() for x in batch.column("bpe_ids").to_pylist()]
            texts = [None if x is None else b"".join(map(spelled.__getitem__, x)).decode("utf-8", "replace") for x in ids]
            keep = [n for n in batch.schema.names if n != "bpe_text"]
            yield pa.record_batch([*(batch.column(n) for n in keep), pa.array(texts, pa.string())], [*keep, "bpe_text"])

    rows = encoded.drop("bpe_text")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("bpe_text", T.StringType())]))


def op12_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decode_packed(encode_packed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ids, text = F.coalesce("bpe_ids", F.lit(b"")), F.coalesce("bpe_text", F.lit(""))
    return docs.select("doc_id", F.expr("coalesce(octet_length(bpe_ids), 0) div 4").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(text, 256).alias("decoded_sha256"))
