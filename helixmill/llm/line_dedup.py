"""Line deduplication that ships bitmaps, not text.

Lines are hashed once. The hashes are range-partitioned, with a secondary sort by document, newest first, and position,
and a window streams over each sorted run: it lets the first occurrence of every document through, of as many documents
as are needed to call a line repeated. A hash is split by document into SPLITS ranges for that, so that a line of a
third of all rows is no task of its own; the few rows that pass are ranged and sorted again, by hash alone, and the
window's row number min_docs says that a line is repeated, its first row which document keeps it. What comes back per
document is a keep bitmap compressed by run lengths: the runs of dropped line numbers, nothing for documents that keep
every line. Texts are shuffled once, to meet their bitmaps.

Only DataFrame functions. Nulls: a null text is one empty line; a null doc_id sorts lowest and counts as one document.
Rows that repeat a doc_id count as one document; the largest doc_id keeps a line in all its rows. Ties of position
cannot occur. An empty table gives an empty result; other columns pass through untouched, whatever their names, but for
``line_drop``, which the operator adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixmill.llm._common import discard, let, lower_ascii, partitions, row_key, stage, table

SPACES = "\t\n\x0b\x0c\r "
#: Ranges into which one hash may be split, by document.
SPLITS = 64


def line_keys(text: Column, min_chars: int) -> Column:
    """Array of (position, 128 bits of the line's key) of lines whose key has min_chars code points or more."""
    def keyed(line: Column, i: Column) -> Column:
        return let(lower_ascii(F.btrim(line, F.lit(SPACES))), lambda k: F.struct(i.alias("p"), F.xxhash64(k).alias("h"), F.xxhash64(F.lit("second"), k).alias("g"), F.char_length(k).alias("n")))

    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(F.transform(lines, keyed), lambda x: x["n"] >= min_chars)


def drop_runs(positions: Column) -> Column:
    """Sorted, distinct line numbers as runs (first, n)."""
    def runs(s: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1) != x - 1))
        last = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1) != x + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n")))

    return let(positions, runs)


def first_occurrences(lines: DataFrame, ranges: list[str], most: int) -> DataFrame:
    """Of each hash in its ranges the first line of every document, of the most newest documents at most, with the
    newest document and a running number. The window reads the ranged partitions in their secondary order."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("p")]
    ranged = lines.repartitionByRange(partitions(lines.sparkSession), *ranges).sortWithinPartitions(*ranges, *order)
    by, by_document = W.partitionBy(*ranges).orderBy(*order), W.partitionBy(*ranges).orderBy(order[0])
    seen = ranged.select("*", F.lag(F.struct("doc_id")).over(by).alias("before"), F.first("doc_id").over(by).alias("newest"))
    seen = seen.withColumn("k", F.dense_rank().over(by_document))
    return seen.where((F.col("k") <= most) & ~F.col("before").eqNullSafe(F.struct("doc_id"))).drop("before")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row (key, drop) for each document that loses lines: drop holds runs (first, n) of line numbers from 0."""
    lines = docs.select("doc_id", row_key().alias("key"), F.explode(line_keys(F.col("text"), min_chars)).alias("l"))
    lines = stage(lines.select("doc_id", "key", "l.p", "l.h", "l.g"), "lines")
    split = lines.select("h", "g", "doc_id", "p", F.pmod(F.xxhash64("doc_id"), F.lit(SPLITS)).alias("part"))
    some = first_occurrences(split, ["h", "g", "part"], min_docs).select("h", "g", "doc_id", "p")
    heads = first_occurrences(some, ["h", "g"], min_docs).where(F.col("k") == min_docs).select("h", "g", F.col("newest").alias("keeper"))
    # written, so that the join below has two plain shuffles and Spark can split the one with a hot line
    dropped = lines.join(stage(heads, "heads"), ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    out = stage(dropped.groupBy("key").agg(drop_runs(F.sort_array(F.collect_set("p"))).alias("drop")), "bitmaps")
    discard(lines)
    return out


def kept_text(text: Column, drop: Column) -> Column:
    """The text without the dropped lines; whole slices between the runs are put together."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    def cut(ls: Column) -> Column:
        bounds = F.concat(F.transform(drop, lambda r: F.struct(r["first"].alias("at"), (r["first"] + r["n"]).alias("to"))), F.array(F.struct(F.size(ls).alias("at"), F.size(ls).alias("to"))))
        starts = F.concat(F.array(F.lit(0)), F.transform(drop, lambda r: r["first"] + r["n"]))
        return F.array_join(F.flatten(F.zip_with(starts, bounds, lambda s, b: F.slice(ls, s + 1, b["at"] - s))), "\n")

    return F.when(drop.isNull(), F.coalesce(text, F.lit(""))).otherwise(let(lines, cut))


def with_drops(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with line_drop, the runs of lines to drop (null: none)."""
    maps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("key").alias("map_key"), F.col("drop").alias("map_drop"))
    packed = docs.drop("line_drop").select(F.struct("*").alias("line_row"), row_key().alias("line_key"))
    return packed.join(maps.hint("shuffle_hash"), F.col("line_key") == F.col("map_key"), "left").select("line_row.*", F.col("map_drop").alias("line_drop"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_drops(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_dropped = F.coalesce(F.aggregate("line_drop", F.lit(0), lambda a, r: a + r["n"]), F.lit(0))
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), F.sha2(kept_text(F.col("text"), F.col("line_drop")), 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: the same rows and columns with repeated lines gone from text, n_chars brought up to date. Other
    columns travel in one struct, so none clashes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = with_drops(docs.select("doc_id", "text", F.struct(*(others or [F.lit(0)])).alias("line_rest")))
    same = F.col("line_drop").isNull()
    text = F.when(same, F.col("text")).otherwise(kept_text(F.col("text"), F.col("line_drop")))
    values = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col("line_rest")[c] for c in others}
    if "n_chars" in others:
        values["n_chars"] = F.when(same, values["n_chars"]).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[values[c].alias(c) for c in docs.columns])


SQL = {
    "op9_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p
  FROM documents),
keyed AS (
  SELECT doc_id, p, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
heads AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT a.doc_id, a.p, a.line, (h.k IS NOT NULL AND a.doc_id <> h.keeper) AS gone FROM keyed a LEFT JOIN heads h ON a.k = h.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
