"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is read from left to right in lanes. Where no piece can cross, as before a space for the usual vocabularies, all
paths run through one boundary, so a new lane begins there. Many lanes are searched in step, one place of all lanes at a
time. Of a lane only a window is held: REACH bytes and the longest piece beyond. When the window ends before the lane,
the backpointer paths of all places that a path may still go on from, no further than the longest piece, are followed
back to the last boundary they share; the ids up to there are committed and the search goes on from it. Only if they
share none does the window grow. A lane always gets the same ids, so lanes met before come from a bounded memo.

The vocabulary file is a parameter; the driver reads it and broadcasts its pieces and scores. The public model at hand
was made for merges (BPE) but has a score for every piece; this search maximises their sum, as for a unigram model, so
ids can differ from a merge encoder's, while decoding gives back the text exactly, also with that library.
Characters without a piece become byte pieces; so does U+2581, which else would come back as a space.

Null texts get null ids and an empty text none. Rows that repeat are encoded each on its own. Columns that the
operator adds start with ``sp_``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.llm._common import table
from helixmill.llm._text import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # stands for a space in the vocabulary file
#: Most lanes, and characters in them, of a generation of the memo.
MEMO, MEMO_CHARS = 200_000, 8_000_000
#: Bytes of a lane that are searched before its ids are committed as far as all paths agree.
REACH = 4096
WORD = re.compile(" +[^ ]*")


@dataclass
class Vocabulary:
    ids: dict[str, int]  # by piece, with spaces as spaces
    scores: dict[str, float]
    byte_ids: list[int]
    unknown: float  # score of a character without piece
    spelled: list[bytes]  # by id
    longest: int


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, byte_ids, spelled = {}, {}, [0] * 256, []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            spelled.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            own = piece.replace(MARK, " ")
            ids[own], scores[own] = i, model.get_score(i)
            spelled.append(own.encode())
    return Vocabulary(ids, scores, byte_ids, min(scores.values()) - 10, spelled, max(map(len, ids)))


class Trie:
    """All pieces by their UTF-8 bytes: rows of next nodes for nodes that go on, a piece or -1 for every node."""

    def __init__(self, v: Vocabulary):
        following: list[dict[int, int]] = [{}]
        piece = [-1]
        for text, i in v.ids.items():
            node = 0
            for x in text.encode():
                if x not in following[node]:
                    following[node][x] = len(following)
                    following.append({})
                    piece.append(-1)
                node = following[node][x]
            piece[node] = i
        self.piece, self.row = np.array(piece), np.zeros(len(piece), np.int64)
        inner = [n for n, f in enumerate(following) if f]
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.next = np.zeros((len(inner) + 1, 256), np.int32)  # row 0: a node that ends here; entry 0: no such node
        for n in inner:
            self.next[self.row[n], list(following[n])] = list(following[n].values())
        self.scores = np.zeros(len(v.spelled))
        for text, i in v.ids.items():
            self.scores[i] = v.scores[text]
        self.byte_ids, self.unknown = np.array(v.byte_ids), v.unknown
        self.deep = max([4, *(len(x.encode()) for x in v.ids)])  # bytes of the longest piece, or character


def step(lanes: list[bytes], limits: np.ndarray, trie: Trie) -> tuple[list[bytes], list[int]]:
    """Search the lanes in step, pieces that begin before each one's limit. A lane that ends there is committed whole,
    another one up to the last boundary that all its living paths share. Ids, and how many bytes they stand for."""
    sizes = np.array([len(x) for x in lanes], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(lanes), np.uint8)
    stop, begin_of = np.repeat(ends, sizes), np.repeat(begins, sizes)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.append(heads, len(data)))
    before_limit = heads - begin_of[heads] < np.repeat(limits, sizes)[heads]
    heads, width = heads[before_limit], width[before_limit]
    # edges: pieces that begin at a character, and characters without a piece
    at, node, span = heads, np.zeros(len(heads), np.int64), 0
    starts, stops, found = [], [], []
    while len(at):
        inside = at + span < stop[at]
        at, node = at[inside], node[inside]
        node = trie.next[trie.row[node], data[at + span]].astype(np.int64)
        alive = node > 0
        at, node, span = at[alive], node[alive], span + 1
        i = trie.piece[node]
        good = i >= 0
        starts.append(at[good])
        stops.append(at[good] + span)
        found.append(i[good])
    edge_start, edge_stop, edge_id = np.concatenate(starts), np.concatenate(stops), np.concatenate(found)
    alone, after = np.zeros(len(data), bool), np.zeros(len(data), np.int64)
    after[heads] = heads + width
    alone[edge_start[after[edge_start] == edge_stop]] = True
    lost = heads[~alone[heads]]
    edge_start, edge_stop, edge_id = np.concatenate([edge_start, lost]), np.concatenate([edge_stop, after[lost]]), np.concatenate([edge_id, np.full(len(lost), -1)])
    offset = edge_start - begin_of[edge_start]
    order = np.argsort(offset, kind="stable")
    edge_start, edge_stop, edge_id, offset = (x[order] for x in (edge_start, edge_stop, edge_id, offset))
    score = np.where(edge_id >= 0, trie.scores[edge_id], trie.unknown)
    shift = np.arange(len(lanes))  # each lane has one place more than bytes
    edge_from, edge_to = (x + np.repeat(shift, sizes)[edge_start] for x in (edge_start, edge_stop))
    best = np.full(len(data) + len(lanes), -np.inf)
    first = begins + shift
    best[first] = 0
    back = np.full(len(best), -1, np.int64)
    bounds = np.append(np.flatnonzero(np.append(True, offset[1:] != offset[:-1])), len(offset))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):  # edges that begin together never end together
        total, to = best[edge_from[a:b]] + score[a:b], edge_to[a:b]
        better = np.flatnonzero(total > best[to])  # of equal paths the one with the longer last piece stays
        best[to[better]] = total[better]
        back[to[better]] = a + better
    upto = sizes.copy()
    for k in np.flatnonzero(limits < sizes).tolist():
        living = {p for p in range(first[k] + limits[k], first[k] + sizes[k] + 1) if best[p] > -np.inf}
        while len(living) > 1:
            last = max(living)
            living.remove(last)
            living.add(int(edge_from[back[last]]))
        upto[k] = living.pop() - first[k]
    path, here, low = [], (first + upto)[upto > 0], first[upto > 0]
    while len(here):
        edge = back[here]
        path.append(edge)
        here = edge_from[edge]
        going = here > low
        here, low = here[going], low[going]
    path = np.concatenate(path) if path else np.zeros(0, np.int64)
    path = path[np.argsort(edge_start[path])]
    begin, n = edge_start[path], np.where(edge_id[path] >= 0, 1, edge_stop[path] - edge_start[path])
    total_ids = np.cumsum(n)
    ids = np.repeat(edge_id[path], n)
    inner = np.arange(len(ids)) - np.repeat(total_ids - n, n)
    ids = np.where(ids >= 0, ids, trie.byte_ids[data[np.minimum(np.repeat(begin, n) + inner, len(data) - 1)]]).astype(np.int32)
    cuts = (np.append(0, total_ids)[np.searchsorted(begin, np.append(begins, len(data)))] * 4).tolist()
    blob = ids.tobytes()
    return [blob[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], upto.tolist()


def encode_lanes(lanes: list[str], trie: Trie, reach: int = REACH) -> list[bytes]:
    """Ids of each lane."""
    raw = [x.encode() for x in lanes]
    out: list[list[bytes]] = [[] for _ in raw]
    done, window, live = [0] * len(raw), [reach] * len(raw), [k for k, x in enumerate(raw) if x]
    while live:
        parts = [raw[k][done[k] : done[k] + window[k] + trie.deep] for k in live]
        limits = np.array([window[k] if done[k] + window[k] + trie.deep < len(raw[k]) else len(p) for k, p in zip(live, parts, strict=True)])
        for k, ids, n in zip(live, *step(parts, limits, trie), strict=True):
            out[k].append(ids)
            done[k] += n
            window[k] = reach if n else 2 * window[k]
        live = [k for k in live if done[k] < len(raw[k])]
    return [b"".join(x) for x in out]


class Memo:
    """Ids of lanes met before, in two generations: when the young one is full it grows old, and what was old and not met
    since goes."""

    def __init__(self, v: Vocabulary):
        self.trie, self.young, self.old, self.chars = Trie(v), {}, {}, 0

    def lookup(self, lanes: set[str]) -> dict[str, bytes]:
        """Ids by lane; those not met yet are searched together."""
        found = {w: self.young[w] for w in lanes if w in self.young}
        new = {w: self.old[w] for w in lanes if w not in found and w in self.old}
        unmet = [w for w in lanes if w not in found and w not in new]
        new.update(zip(unmet, encode_lanes(unmet, self.trie), strict=True))
        self.young.update(new)
        self.chars += sum(map(len, new))
        if len(self.young) >= MEMO or self.chars >= MEMO_CHARS:
            self.young, self.old, self.chars = {}, self.young, 0
        return found | new


def words_split_here(v: Vocabulary) -> bool:
    """Whether no piece has a space after another character: then a space that ends a word is always a boundary."""
    return not any(" " in p.lstrip(" ") for p in v.ids)


def encode_texts(texts: list[str | None], memo: Memo, split: bool) -> list[bytes]:
    lanes = [(WORD.findall(" " + t) if split else [" " + t]) if t else [] for t in texts]
    known = memo.lookup(set().union(*lanes))
    return [b"".join(map(known.__getitem__, x)) for x in lanes]


class Decoder:
    """Texts of many id lists at once, by copying spelled pieces."""

    def __init__(self, v: Vocabulary):
        self.sizes = np.array([len(x) for x in v.spelled], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(v.spelled), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, each still with the space that encoding put before it, and where each begins."""
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        where = np.repeat(self.begins[ids] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        return self.blob[where], np.concatenate([[0], upto])[first]

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        data, at = self.decode(ids, counts)
        return [data[a + 1 : b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def encoder(shared, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        memo, split, decoder = Memo(v), words_split_here(v), Decoder(v)
        for piece in pieces(batches, "text"):
            texts = piece.column("text").to_pylist()
            found = encode_texts(texts, memo, split)
            counts = np.array([len(x) // 4 for x in found])
            ids = np.frombuffer(b"".join(found), np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append([t is None for t in texts], False))
            keep = [n for n in piece.schema.names if n not in ("text", "sp_ids", "sp_same")]
            columns = [*(piece.column(n) for n in keep), pa.ListArray.from_arrays(offsets, pa.array(ids))]
            if check:
                data, at = decoder.decode(ids, counts)
                columns.append(pa.array([t is None or data[a + 1 : b].tobytes() == t.encode() for t, a, b in zip(texts, at[:-1], at[1:], strict=True)]))
            yield pa.record_batch(columns, [*keep, "sp_ids", *["sp_same"] * check])

    return run


def encode(docs: DataFrame, model: str = MODEL, check: bool = False) -> DataFrame:
    """docs, text replaced by sp_ids; with check also sp_same: whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    rows = docs.drop("sp_ids", "sp_same")
    fields = [*rows.drop("text").schema.fields, T.StructField("sp_ids", T.ArrayType(T.IntegerType())), *[T.StructField("sp_same", T.BooleanType())] * check]
    return rows.mapInArrow(encoder(shared, check), T.StructType(fields))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows with sp_ids get text back (null ids: null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column("sp_ids").to_pylist()
            flat = np.array([i for x in lists for i in x or ()], np.int64)
            texts = decoder.texts(flat, np.array([len(x or ()) for x in lists], np.int64))
            keep = [n for n in batch.schema.names if n not in ("sp_ids", "text")]
            yield pa.record_batch([*(batch.column(n) for n in keep), pa.array([None if x is None else t for x, t in zip(lists, texts, strict=True)], pa.string())], [*keep, "text"])

    fields = [*encoded.drop("sp_ids", "text").schema.fields, T.StructField("text", T.StringType())]
    return encoded.mapInArrow(run, T.StructType(fields))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return docs.select("doc_id", F.coalesce(F.size("sp_ids"), F.lit(0)).cast("long").alias("n_ids"), F.col("sp_ids").alias("ids"), F.col("sp_same").alias("round_trip"))
