"""Joins and unions of closed intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bases of a bin on each level. A span stands on the first level where a bin is longer than it, so it touches two bins at
#: most; only on the last one may it touch more, a contig's length over that bin's.
BINS = (10_000, 640_000, 40_960_000)


def _placed(df: DataFrame, start: str, end: str, side: str) -> DataFrame:
    """Rows once for each bin in which they may meet the other side; _tag is the bin's level and whose level it is.

    Two spans meet on the longer one's level. A row therefore goes to the bins of its own level, where it is the longer
    one, and to those of the levels above, where the other one is. Spans of one level meet as if right were the longer."""
    long = F.abs(F.col(end) - F.col(start))
    level = F.when(long < BINS[0], 0).when(long < BINS[1], 1).when(long.isNotNull(), 2)
    levels = range(len(BINS))

    def tags(own: int) -> list[int]:
        """_tag is odd where right is the longer one, or neither."""
        if side == "r":
            return [2 * own + 1] + [2 * k for k in levels if k > own]
        return [2 * k + 1 for k in levels if k >= own] + ([2 * own] if own else [])

    # literal lists and sequences alone, which are compiled; functions of their elements would not be
    placed = df.withColumn("_tag", F.explode(reduce(lambda a, k: a.when(level == k, F.array(*map(F.lit, tags(k)))), levels[1:], F.when(level == 0, F.array(*map(F.lit, tags(0)))))))
    size = f"element_at(array({', '.join(map(str, BINS))}), cast(_tag div 2 + 1 as int))"
    return placed.withColumn("_bin", F.explode(F.expr(f"sequence({start} div {size}, {end} div {size})"))).withColumn(f"_{side}", F.col(start))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], spans: tuple[str, str, str, str]) -> DataFrame:
    """Pairs of equal keys whose closed intervals meet; spans names start and end of left, then right. Both sides are
    dealt by bins of the longer span's level, and a pair counts in the first bin that both touch, so no pair comes twice.
    Long spans cost their own pairs and no more: nothing short is compared with anything short in a long bin. Rows with a
    null bound meet nothing."""
    ls, le, rs, re_ = spans
    meets = (F.col(ls) <= F.col(re_)) & (F.col(le) >= F.col(rs))
    first = F.expr(f"_bin = greatest(_l, _r) div element_at(array({', '.join(map(str, BINS))}), cast(_tag div 2 + 1 as int))")
    both = _placed(left, ls, le, "l").join(_placed(right, rs, re_, "r"), [*keys, "_tag", "_bin"])
    return both.where(meets & first).drop("_tag", "_bin", "_l", "_r")


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unions of overlapping or adjacent closed intervals by keys; reversed ends are put right. Equal intervals are peers
    in the running sum, so their order cannot matter."""
    plain = df.select(*keys, F.least(start, end).alias(start), F.greatest(start, end).alias(end))
    by = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    islands = plain.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0)).withColumn("_i", F.sum("_new").over(by.rangeBetween(W.unboundedPreceding, W.currentRow)))
    return islands.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def covered_bins(spans: DataFrame, keys: list[str], size: int = BINS[0]) -> DataFrame:
    """Disjoint spans (start, end) by bin: keys, _bin, and the spans that touch it, of which a bin holds half its size at
    most."""
    bins = spans.select(*keys, "start", "end", F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"end div {size}"))).alias("_bin"))
    return bins.groupBy(*keys, "_bin").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))


def inside(df: DataFrame, bins: DataFrame, contig: Column, pos: Column, name: str, size: int = BINS[0]) -> DataFrame:
    """df with whether the point (contig, pos) lies in a span. bins: what covered_bins gives for contig. A point asks its
    own bin only, so df goes through one join and keeps its rows. bins grow with the spans and, packed in files, look small
    to the planner, which must not send them through the driver."""
    named = bins.select(F.col("contig").alias("_k0"), F.col("_bin").alias("_k1"), "_spans").hint("shuffle_merge")
    asked = df.withColumns({"_k0": contig, "_p": pos, "_k1": F.floor(pos / size).cast("bigint")}).join(named, ["_k0", "_k1"], "left")
    hit = F.exists("_spans", lambda s: (s["start"] <= F.col("_p")) & (F.col("_p") <= s["end"]))
    return asked.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_k0", "_k1", "_p", "_spans")
