"""Variant-call text: reading files, records, headers, per-upload figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixmill.functions import genotype as g
from helixmill.sources.files import staged

FIELDS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")


def read_vcf(spark: SparkSession, paths: str | list[str], spread: bool = False) -> DataFrame:
    """Lines of .vcf and .vcf.gz files: upload_id (the file's path), line_no, line. line_no grows along the file, over
    the splits of a plain file too: first by where the split begins, then by the line's place in its task, of 33 bits, as
    many as Spark counts. A split of n bytes has n lines at most and the next one begins n / 4096 * 2**31 later. spread
    deals the lines to all tasks, which only compressed files need, as each is one task."""
    lines = spark.read.option("wholetext", False).option("lineSep", "\n").text(paths)
    place = F.shiftleft(F.expr("_metadata.file_block_start div 4096"), 31) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    named = lines.select(F.col("_metadata.file_path").alias("upload_id"), place.alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("line"))
    return named.repartition("upload_id", F.expr("line_no div 100000")) if spread else named


def parse_records(lines: DataFrame) -> DataFrame:
    """One row a data line with eight fields or more; format and sample may be empty. Fields are a generated column, so each
    line is made and cut once: the planner would move tests on a plain column below it, where each repeats that work."""
    parts = lines.select("upload_id", "line_no", F.explode(F.array(F.split("line", "\t"))).alias("_f"))
    picked = [F.get("_f", F.lit(k)).alias(n) for k, n in enumerate(FIELDS)]
    data = parts.where((F.size("_f") >= 8) & ~F.startswith(F.get("_f", F.lit(0)), F.lit("#")))
    return data.select("upload_id", "line_no", *picked, g.text(F.get("_f", F.lit(8))).alias("format"), g.text(F.get("_f", F.lit(9))).alias("sample"))


def parse_headers(lines: DataFrame) -> DataFrame:
    """Per upload: file format, number of metadata lines, header columns, samples."""
    line = F.col("line")
    columns = F.split(F.max(F.when(line.startswith("#CHROM"), line)), "\t")
    out = lines.groupBy("upload_id").agg(F.max(F.when(line.startswith("##fileformat="), F.expr("substring(line, 14)"))).alias("fileformat"), F.count(F.when(line.startswith("##"), 1)).alias("n_metadata"), columns.alias("_c"))
    return out.select("upload_id", g.text(F.col("fileformat")).alias("fileformat"), "n_metadata", F.coalesce(F.size("_c"), F.lit(0)).cast("bigint").alias("n_columns"), F.array_join(F.slice("_c", F.lit(10), F.greatest(F.size("_c"), F.lit(0))), ",").alias("samples"), F.greatest(F.size("_c") - 9, F.lit(0)).cast("bigint").alias("n_samples"))


def with_genotype(records: DataFrame) -> DataFrame:
    return records.withColumn("gt", g.extract_gt(F.col("format"), F.col("sample")))


def explode_alleles(records: DataFrame) -> DataFrame:
    """One row for each ALT allele, counted from 1, with contig, position, dosage and end worked out."""
    alts = F.filter(F.transform(F.split("alt", ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = with_genotype(records).select("*", F.posexplode(alts).alias("_k", "allele"))
    out = rows.withColumns({"alt_index": F.col("_k") + 1, "start": F.col("pos").try_cast("bigint"), "contig": g.norm_chrom(F.col("chrom"))}).drop("_k")
    return out.withColumns({"dosage": g.dosage(F.col("gt"), F.col("alt_index")), "end": g.variant_end(F.col("start"), F.col("ref"), F.col("info"))})


def observed_alleles(records: DataFrame, assembly: str = "GRCh38") -> DataFrame:
    """Alleles of supported contigs that the sample carries and that are not symbolic, each with its key."""
    seen = explode_alleles(records).where((F.col("dosage") > 0) & F.col("contig").isin(g.SUPPORTED) & ~g.is_symbolic(F.col("allele")))
    return seen.withColumn("variant_key", g.variant_key(F.lit(assembly), F.col("contig"), F.col("start"), F.col("ref"), F.col("allele")))


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


GT_CLASSES = ("missing_or_partial", "non_diploid", "hom_ref", "hom_alt", "heterozygous")


def vcf_stats(lines: DataFrame) -> DataFrame:
    """Thirteen counts an upload; lines that are no records count as malformed only. Each line is cut once and each class
    is a column before anything is counted, so that the counts do not repeat the work."""
    cut = lines.where(~F.col("line").startswith("#")).select("upload_id", F.split("line", "\t").alias("f"))
    data = cut.select("upload_id", (F.size("f") >= 8).alias("ok"), *[g.text(F.get("f", F.lit(k))).alias(n) for k, n in enumerate((*FIELDS, "format", "sample"))])
    classed = data.select("upload_id", "ok", "id", "filter", "alt", g.is_snv(F.col("ref"), F.col("alt")).alias("snv"), g.extract_gt(F.col("format"), F.col("sample")).alias("gt"))
    classed = classed.select("upload_id", "ok", "id", "filter", "alt", "snv", g.classify_gt(F.col("gt")).alias("kind"))
    ok, snv = F.col("ok"), F.col("snv")
    counts = {"total": ok, "with_id": ok & ~F.col("id").isin("", "."), "with_rsid": ok & F.col("id").rlike("(?i)rs[0-9]+"), "pass": ok & (F.col("filter") == "PASS"), "multiallelic": ok & F.contains("alt", F.lit(",")), "snv": ok & snv, "non_snv": ok & ~snv, **{f"gt_{k}": ok & (F.col("kind") == k) for k in GT_CLASSES}, "malformed": ~ok}
    return classed.groupBy("upload_id").agg(*[count_if(c).alias(n) for n, c in counts.items()])


def top_contigs(records: DataFrame, n: int = 15) -> DataFrame:
    counted = records.groupBy("upload_id", "chrom").agg(F.count("*").alias("n"), F.min("line_no").alias("_first"))
    rank = F.row_number().over(W.partitionBy("upload_id").orderBy(F.desc("n"), "_first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n).select("upload_id", "chrom", "n", "rank")


def contig_labels(records: DataFrame) -> DataFrame:
    """Canonical contig -> the label that the file used first. Each label's first line is found and written before labels are
    looked at, so that the rules run once a label; the planner would else move them, line by line, below the grouping."""
    first = staged(records.groupBy("upload_id", "chrom").agg(F.min("line_no").alias("line_no")))
    plain = first.where(F.col("chrom").rlike(r"^[A-Za-z0-9_.-]+$")).withColumn("contig", g.norm_chrom(F.col("chrom"))).where(F.col("contig").isin(g.SUPPORTED))
    return plain.groupBy("upload_id", "contig").agg(F.min_by("chrom", "line_no").alias("label"))


def detect_assembly(headers: DataFrame) -> DataFrame:
    """Assembly an upload's header names: by reference, else by the length of chromosome 1."""
    line = F.lower("line")
    ref = line.startswith("##reference")
    has = lambda *tokens: F.max(F.when(ref & line.rlike("|".join(tokens)), 1).otherwise(0)) == 1
    long = lambda n: F.max(F.when(line.rlike(f"^##contig=.*id=(chr)?1,.*length={n}"), 1).otherwise(0)) == 1
    named = F.when(has("grch38", "hg38", "b38"), "GRCh38").when(has("grch37", "hg19", "b37"), "GRCh37").when(long(248956422), "GRCh38").when(long(249250621), "GRCh37").otherwise("unknown")
    return headers.groupBy("upload_id").agg(named.alias("assembly"))


def assembly_gate(uploads: DataFrame, canon: str) -> DataFrame:
    """uploads: upload_id, assembly (header), selected. Whether the upload may meet a canon of that assembly."""
    known = F.col("assembly") != "unknown"
    gate = F.when(known & (F.col("selected") != "") & (F.col("assembly") != F.col("selected")), "selection_conflict").when(~known & (F.col("selected") == ""), "confirmation_required").when(F.when(known, F.col("assembly")).otherwise(F.col("selected")) != canon, "canon_mismatch").otherwise("ok")
    return uploads.withColumn("gate", gate)


def integrity(lines: DataFrame, n: int = 20) -> DataFrame:
    """Per upload, messages of the header and of its first n data lines, and a status: any error is invalid."""
    line = F.col("line")
    header = lines.groupBy("upload_id").agg(F.max(F.when(line.startswith("##fileformat="), line)).alias("ff"), F.max(F.when(line.startswith("#CHROM"), line)).alias("h"), F.min(F.when(line.startswith("#CHROM"), F.col("line_no"))).alias("h_no"), F.min(F.when(~line.startswith("#"), F.col("line_no"))).alias("first"))
    cols = F.size(F.split("h", "\t"))
    head_errors = F.array_compact(F.array(F.when(F.col("h").isNull(), F.lit("missing_chrom_header")), F.when(cols < 8, F.lit("too_few_columns")), F.when(F.col("h_no") > F.col("first"), F.lit("variant_before_header"))))
    head_warnings = F.array_compact(F.array(F.when(F.col("ff").isNull(), F.lit("missing_fileformat")), F.when(~F.substring("ff", 14, 4).eqNullSafe("VCFv") & F.col("ff").isNotNull(), F.lit("unknown_fileformat")), F.when(cols == 8, F.lit("no_sample")), F.when(cols > 10, F.lit("several_samples"))))
    first = lines.where(~line.startswith("#")).withColumn("_k", F.row_number().over(W.partitionBy("upload_id").orderBy("line_no"))).where(F.col("_k") <= n).withColumn("f", F.split("line", "\t"))
    bad = lambda k: g.text(F.get("f", F.lit(k))) == ""
    pos = F.get("f", F.lit(1)).try_cast("bigint")
    row_errors = F.array_compact(F.array(F.when(F.size("f") < 8, F.lit("short_row")), F.when(pos.isNull() | (pos <= 0), F.lit("bad_pos")), F.when(bad(0) | bad(3) | bad(4), F.lit("empty_field"))))
    rows = first.groupBy("upload_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(row_errors)))).alias("row_errors"))
    out = header.join(rows, "upload_id", "left").select("upload_id", F.concat(head_errors, F.coalesce("row_errors", F.array().cast("array<string>"))).alias("e"), head_warnings.alias("w"))
    return out.select("upload_id", F.array_join("e", "|").alias("errors"), F.array_join("w", "|").alias("warnings"), F.when(F.size("e") > 0, "invalid").when(F.size("w") > 0, "warning").otherwise("valid").alias("status"))
