"""Tables, sheets, payloads and file figures from files, and sinks with fixed columns."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import genotype as g

#: Bytes of a file that are held at once.
PIECE = 1 << 20
MOST_TASKS = 2000


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir, which driver and executors share. Only where all of them are one process
    on one machine may the session name none; then a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what several jobs or branches read is worked out once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_encoding(spark: SparkSession, path: str | list[str]) -> str:
    """UTF-8 if every line is, else windows-1252 unless a byte is one of its five gaps, else ISO-8859-1."""
    raw = F.hex(F.col("value").cast("binary"))
    odd = spark.read.text(path).agg(F.max((~F.is_valid_utf8("value")).cast("int")).alias("broken"), F.max(raw.rlike("^(..)*(81|8D|8F|90|9D)").cast("int")).alias("gap")).first()
    return "UTF-8" if not odd.broken else "ISO-8859-1" if odd.gap else "windows-1252"


def read_table(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """CSV with a header, every column text; a byte order mark before the first name is dropped. Without encoding, the
    one that the bytes allow. The reader has no windows-1252, which is ISO-8859-1 with letters for most control codes."""
    encoding = encoding or table_encoding(spark, path)
    windows = encoding == "windows-1252"
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="ISO-8859-1" if windows else encoding)
    codes = [k for k in range(0x80, 0xA0) if bytes([k]).decode("cp1252", "ignore")] if windows else []
    plain, letters = "".join(map(chr, codes)), bytes(codes).decode("cp1252")
    names = [c.lstrip("\ufeff").translate(str.maketrans(plain, letters)) for c in df.columns]
    return df.select(*[F.translate(F.col(f"`{c}`"), plain, letters).alias(n) if codes else F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)])


def read_canon(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """A sheet without trusted header: cells _c0, _c1, ... with blanks collapsed."""
    df = spark.read.csv(path, header=False, sep=sep, multiLine=True, escape='"')
    return df.select(*[F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")).alias(c) for c in df.columns])


def read_payloads(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _opened(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store.open_input_stream(at, compression=None)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first two bytes of each file."""
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            with _opened(path) as source:
                found.append(source.read(2))
        yield batch.append_column("head", pa.array(found, pa.binary()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file, read in pieces."""
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            with _opened(path) as source:
                while piece := source.read(PIECE):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield batch.append_column("sha256", pa.array(found))


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and length of files, empty ones too (which file readers leave out); their content is not read."""
    found = []
    for pattern in [paths] if isinstance(paths, str) else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []:
            if x.isFile():
                found.append((x.getPath().toString(), x.getLen()))
    return spark.createDataFrame(found, "path string, length long").repartition(max(1, min(len(found), MOST_TASKS)))


def file_profile(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per file its size, whether it is gzip by content and by name, and messages."""
    files = listed(spark, paths).mapInArrow(_heads, "path string, length long, head binary")
    magic, named = F.hex("head") == "1F8B", F.col("path").endswith(".gz")
    known = F.col("path").rlike(r"\.(vcf|vcf\.gz)$")
    errors = F.array_compact(F.array(F.when(F.col("length") == 0, F.lit("empty_file")), F.when(named & ~magic & (F.col("length") > 0), F.lit("gzip_magic_missing"))))
    warnings = F.array_compact(F.array(F.when(magic & ~named, F.lit("gzip_without_extension")), F.when(~known, F.lit("unknown_extension"))))
    return files.select("path", "length", magic.alias("is_gzip"), F.when(magic, "vcf.gz").otherwise("vcf").alias("format"), F.array_join(errors, "|").alias("errors"), F.array_join(warnings, "|").alias("warnings"))


def file_checksums(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SHA-256 of each file, of any size."""
    return listed(spark, paths).mapInArrow(_digests, "path string, length long, sha256 string")


def write_table(df: DataFrame, path: str, fields: list[str], gzip: bool = False) -> None:
    """CSV with these columns in this order; other columns are left out."""
    df.select(*fields).write.csv(path, header=True, compression="gzip" if gzip else "none")


def write_by_status(df: DataFrame, path: str, column: str = "match_status") -> None:
    df.write.partitionBy(column).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


ENVELOPE = "struct<gene_id:string,approved_symbol:string,start:string,end:string,strand:string>"


def read_interval_index(spark: SparkSession, paths: str | list[str], whole: bool = True, entry: str = ENVELOPE) -> DataFrame:
    """Entries of nested interval indexes, {"chromosomes": {contig: [entry, ..] or one entry, ..}}: contig, the fields of
    entry as text, i_start and i_end as numbers, and ``reason``: why an entry is of no use, or ''. A contig's value may be
    a list or a single object; another value is one entry that is none. whole: a file is one payload, else a line is."""
    text = spark.read.text(paths, wholetext=whole)
    contigs = text.select(F.explode(F.from_json("value", "struct<chromosomes:map<string,string>>")["chromosomes"]).alias("label", "j"))
    listed = F.when(F.ltrim("j").startswith("["), F.from_json("j", "array<string>")).otherwise(F.array("j"))
    rows = contigs.select(g.norm_chrom(F.col("label")).alias("contig"), F.explode(listed).alias("j"))
    is_object = F.coalesce(F.ltrim("j").startswith("{"), F.lit(False))
    rows = rows.select("contig", is_object.alias("_o"), F.from_json(F.when(is_object, F.col("j")), entry).alias("e")).select("contig", "_o", "e.*")
    rows = rows.withColumns({"i_start": F.col("start").try_cast("bigint"), "i_end": F.col("end").try_cast("bigint")})
    reason = F.when(~F.col("contig").isin(g.SUPPORTED), "unsupported_contig").when(~F.col("_o"), "not_an_object").when(F.col("i_start").isNull() | F.col("i_end").isNull(), "bad_coordinates").otherwise("")
    return rows.withColumn("reason", reason).drop("_o")


def usable_intervals(index: DataFrame) -> DataFrame:
    """contig, start, end of an index's good entries; an index without any is an error when the rows are read."""
    good = index.where("reason = ''").select("contig", F.col("i_start").alias("start"), F.col("i_end").alias("end"))
    empty = index.agg(F.count(F.when(F.col("reason") == "", 1)).alias("n")).where("n = 0")
    return good.unionByName(empty.select(F.raise_error(F.lit("the interval index has no usable regions")).cast("string").alias("contig"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end")))
