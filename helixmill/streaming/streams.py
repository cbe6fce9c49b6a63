"""The same flow on arriving files: parse, match against static genes, deduplicate, keep a cache, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import evidence, match
from helixmill.sources import vcf


def stream_vcf(spark: SparkSession, folder: str, bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """Lines of new files as records. Their order in a file is not known; line_no is a hash of the line. A batch is bounded
    by bytes: with a bound on files, many small ones would each cost a batch's fixed share."""
    lines = spark.readStream.option("maxBytesPerTrigger", bytes_per_trigger).text(folder)
    named = lines.select(F.regexp_extract("_metadata.file_path", r"upload=([^/]+)", 1).alias("upload_id"), F.xxhash64("value").alias("line_no"), F.col("value").alias("line"))
    return vcf.parse_records(named)


def stream_match(records: DataFrame, genes: DataFrame) -> DataFrame:
    """Streaming alleles joined with the static gene envelopes, by bins."""
    return match.match_envelopes(vcf.observed_alleles(records), genes)


def dedup_writer(path: str, keys: tuple[str, ...] = ("upload_id", "variant_key")):
    """For foreachBatch: append below path the rows whose keys no batch before has written, one a key. What is written is
    the state: it outlives delays, watermarks and restarts, and a batch that runs again replaces its own part only."""
    def write(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates(list(keys))
        if epoch:
            before = batch.sparkSession.read.option("basePath", path).parquet(path).where(F.col("part") < epoch)
            new = new.join(before.select(*keys), list(keys), "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/part={epoch}")

    return write


def stream_dedup(alleles: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there now, each physical variant of an upload once below path, and read all of it."""
    query = alleles.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(dedup_writer(path)).start()
    query.awaitTermination()
    return alleles.sparkSession.read.parquet(path).drop("part")


def stream_progress(records: DataFrame) -> DataFrame:
    return records.groupBy("upload_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("filter") == "PASS", 1)).alias("passed"))


def cache_writer(path: str):
    """For foreachBatch: append a batch's writes, its own latest only, below path. A batch that runs again replaces its
    part; the cache is what read_cache makes of all parts, and compact_cache shortens them."""
    def write(batch: DataFrame, epoch: int) -> None:
        evidence.merge_cache(batch).write.mode("overwrite").parquet(f"{path}/part={epoch}")

    return write


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The latest write of each (assembly, variant, source) over all parts."""
    return evidence.merge_cache(spark.read.parquet(path).drop("part"))


def compact_cache(spark: SparkSession, path: str, to: str) -> None:
    """The cache as one part of a new folder, now and then; readers and the writer then go on there."""
    read_cache(spark, path).write.parquet(f"{to}/part=-1")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read what it wrote (complete mode: its last state)."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(path)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/v{epoch}")).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(path)
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(f"{path}/v{last}")
