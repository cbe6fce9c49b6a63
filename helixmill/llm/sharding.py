"""Hilbert-curve ordering: rows get a curve index from several quantised metadata columns, are sorted by it, and the
sorted sequence is cut into shards, so that each shard covers a compact box of every dimension and the min/max figures
of its files prune reads on any of them.

Only DataFrame functions. The texts themselves never move unless the caller passes them along.

Nulls: a null dimension is in the lowest bin; a null text counts no bytes and has checksum 0. Equal rows keep one
place each. An empty table gives an empty result. ``curve``, ``shard`` and ``slot`` are added and replace input columns
of those names; all others come through (helpers start with ``_h``). Rows of a group, as equal texts are, take the smallest
curve index among them and follow each other, so that only a shard's edge can part them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.llm._common import partitions, stage, table


def curve_steps(n: int) -> list[int]:
    """State table of the n-dimensional Hilbert curve: for state s (entry corner e and direction d, s = e * n + d) and
    the corner l that a point lies in, entry s * 2**n + l holds (position along the curve) << 16 | (next state)."""
    full = (1 << n) - 1
    rotate = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & full
    gray = lambda i: i ^ (i >> 1)
    place = {gray(i): i for i in range(1 << n)}
    ones = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  trailing one bits
    out = []
    for s in range(n << n):
        e, d = divmod(s, n)
        for corner in range(1 << n):
            w = place[rotate(corner ^ e, n - (d + 1) % n)]
            start = gray(2 * ((w - 1) // 2)) if w else 0
            turn = 0 if w == 0 else ones(w if w % 2 else w - 1) % n
            out.append(w << 16 | (e ^ rotate(start, d + 1)) * n + (d + turn + 1) % n)
    return out


def hilbert_index(bins: list[Column], bits: int) -> Column:
    """Curve index of a point whose coordinates are ints below 2**bits."""
    n = len(bins)
    steps = F.array(*[F.lit(x) for x in curve_steps(n)])

    def step(acc: Column, i: Column) -> Column:
        corner = reduce(lambda a, b: a + b, [F.call_function("shiftright", b, i).bitwiseAND(F.lit(1)) * (1 << j) for j, b in enumerate(bins)])
        found = F.get(steps, acc["s"] * (1 << n) + corner)
        return F.struct((acc["h"] * (1 << n) + F.shiftright(found, 16)).alias("h"), found.bitwiseAND(F.lit(0xFFFF)).alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["h"]


def places_before(parts: DataFrame, *sums: str) -> DataFrame:
    """parts: one row a range partition (_hpart) with sums; each sum over the partitions before, and over all."""
    before = W.orderBy("_hpart").rowsBetween(W.unboundedPreceding, -1)
    return parts.select("_hpart", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in sums], *[F.sum(c).over(W.partitionBy()).alias(f"{c}_all") for c in sums])


def string_bounds(df: DataFrame, name: str, bins: int) -> list[str]:
    """Whole values, bins - 1 at most, that part the rows into bins of about equal counts: from the counts of all
    different values, in their order."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("_hn"))
    dealt = stage(counts.repartitionByRange(partitions(df.sparkSession), "v").withColumn("_hpart", F.spark_partition_id()), "values")
    offsets = places_before(dealt.groupBy("_hpart").agg(F.sum("_hn").alias("_hn")), "_hn")
    upto = F.sum("_hn").over(W.partitionBy("_hpart").orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + F.col("_hn0")
    placed = dealt.join(F.broadcast(offsets), "_hpart").select("v", F.floor((upto - 1) * bins / F.col("_hn_all")).alias("bin"))
    return [r.v for r in placed.groupBy("bin").agg(F.max("v").alias("v")).orderBy("bin").collect()][:-1]


def quantise(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """For each dimension its bin of about equal row counts; the bounds, 2**bits - 1 a dimension, come from all rows."""
    steps = [(i + 1) / (1 << bits) for i in range((1 << bits) - 1)]
    strings = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    numbers = [d for d in dims if d not in strings]
    row = df.agg(*[F.percentile_approx(F.col(d).cast("double"), steps, 10_000).alias(f"_h{d}") for d in numbers]).first() if numbers else {}
    bounds = {d: row[f"_h{d}"] or [] for d in numbers} | {d: string_bounds(df, d, 1 << bits) for d in strings}
    bins = []
    for d in dims:
        value = F.col(d) if d in strings else F.col(d).cast("double")
        bins.append(reduce(lambda a, b: a + b, [F.coalesce((value > b).cast("int"), F.lit(0)) for b in sorted(set(bounds[d]))], F.lit(0)))
    return bins


def hilbert_shards(df: DataFrame, dims: list[str], ties: list[str], shards: int, law: str = "rows", size: str | None = None, bits: int = 4, group: tuple[str, ...] = ()) -> DataFrame:
    """df with curve, shard and slot (from 0, without gaps in each shard). law "rows": shards differ by one row at most;
    "bytes": the running sum of column size is cut into equal parts. Rows on the same curve index are in the order of
    group, then ties; the groups' common index comes from a pre-aggregated join. No step sees more than one range partition: places come from counts of the partitions before."""
    spark = df.sparkSession
    curved = df.withColumn("_hcurve", hilbert_index(quantise(df, dims, bits), bits))
    if group:
        firsts = stage(curved.groupBy(*group).agg(F.min("_hcurve").alias("_hleast"), F.count("*").alias("_hn")).where("_hn > 1").drop("_hn"), "groups")
        curved = curved.join(firsts, list(group), "left").withColumn("_hcurve", F.coalesce("_hleast", "_hcurve")).drop("_hleast").select(*curved.columns)
    order = ["_hcurve", *group, *ties]
    weight = F.col(size).cast("long") if law == "bytes" else F.lit(1).cast("long")
    dealt = stage(curved.repartitionByRange(partitions(spark), *order).withColumn("_hpart", F.spark_partition_id()).withColumn("_hweight", weight), "hilbert")
    parts = dealt.groupBy("_hpart").agg(F.count("*").alias("_hn"), F.sum("_hweight").alias("_hsum"))
    offsets = places_before(parts, "_hn", "_hsum")
    inside = W.partitionBy("_hpart").orderBy(*order)
    placed = dealt.join(F.broadcast(offsets), "_hpart").withColumn("_hrank", F.row_number().over(inside) - 1 + F.col("_hn0"))
    if law == "rows":
        q, more = F.expr("_hn_all div %d" % shards), F.col("_hn_all") % shards
        cut = more * (q + 1)
        shard = F.when(F.col("_hrank") < cut, F.expr("_hrank") / (q + 1)).otherwise(more + (F.col("_hrank") - cut) / q).cast("int")
        first = F.col("shard") * q + F.least(F.col("shard").cast("long"), more)
        out = placed.withColumn("shard", shard).withColumn("slot", (F.col("_hrank") - first).cast("long"))
    else:
        upto = F.sum("_hweight").over(inside.rowsBetween(W.unboundedPreceding, 0)) + F.col("_hsum0")
        out = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor((upto - F.col("_hweight") / 2) * shards / F.greatest(F.col("_hsum_all"), F.lit(1)))).cast("int"))
        firsts = out.groupBy("shard").agg(F.min("_hrank").alias("_hfirst"))  # one row a shard
        out = out.join(F.broadcast(firsts), "shard").withColumn("slot", (F.col("_hrank") - F.col("_hfirst")).cast("long"))
    return out.drop("curve").withColumnRenamed("_hcurve", "curve").drop("_hpart", "_hweight", "_hn0", "_hsum0", "_hn_all", "_hsum_all", "_hrank", "_hfirst")


def write_shards(sharded: DataFrame, path: str, order: list[str]) -> None:
    """One folder a shard, rows in curve order."""
    sharded.repartitionByRange(partitions(sharded.sparkSession), "shard", "slot").sortWithinPartitions("shard", *order).write.partitionBy("shard").parquet(path)


SHARDS = 24


def op4_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = hilbert_shards(docs, ["source", "lang", "size"], ["doc_id"], SHARDS, "rows", group=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
