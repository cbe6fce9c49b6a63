"""Matching observed alleles with curated genes and identifiers, region classes, triage, deliverables, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixmill.functions import genotype as g
from helixmill.functions.genotype import text
from helixmill.operators.intervals import merge_intervals, overlap_join
from helixmill.sources import files

# Union types from the strongest down, with the class, priority, annotation need and background flag.
REGIONS = (
    ("mane_cds_union", "mane_cds_overlap", "high", "true", "false"),
    ("splice_window_union", "splice_region_candidate", "high", "true", "false"),
    ("protein_coding_cds_union", "alternative_protein_coding_cds_overlap", "medium_high", "true", "false"),
    ("protein_coding_exon_union", "protein_coding_exon_non_cds_overlap", "medium", "true", "false"),
    ("utr_union", "utr_overlap", "medium", "optional", "false"),
    ("noncoding_exon_union", "noncoding_exon_overlap", "exploratory", "optional", "false"),
    ("transcript_body_union", "intronic_transcript_overlap", "low", "false", "true"),
    ("gene_envelope_only", "gene_envelope_only", "background", "false", "true"),
)
REGION_COLUMNS = ("overlap_feature_types", "local_region_class", "local_feature_priority", "annotation_needed", "background_only")


def match_envelopes(alleles: DataFrame, genes: DataFrame) -> DataFrame:
    """One row for each gene whose envelope an allele's span meets."""
    places = genes.select("gene_id", "approved_symbol", F.col("chrom").alias("contig"), "g_start", "g_end")
    return overlap_join(alleles, places, ["contig"], ("start", "end", "g_start", "g_end"))


def prefilter(alleles: DataFrame, regions: DataFrame, flank: int = 500) -> DataFrame:
    """Alleles whose position (not span) lies in a merged region or its flanks. regions: contig, start, end."""
    wide = merge_intervals(regions.select("contig", (F.col("start") - flank).alias("r_start"), (F.col("end") + flank).alias("r_end")), ["contig"], "r_start", "r_end")
    return overlap_join(alleles.withColumn("_pos", F.col("start")), wide, ["contig"], ("start", "_pos", "r_start", "r_end")).select(*alleles.columns)


def rank_column(kind: Column) -> Column:
    return reduce(lambda a, b: a.when(kind == b[1][0], F.lit(b[0])), list(enumerate(REGIONS))[1:], F.when(kind == REGIONS[0][0], F.lit(0)))


def region_columns(rank: Column) -> dict[str, Column]:
    """The five columns of a region class, from its place in the list."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, REGION_COLUMNS, strict=True)]) for r in REGIONS])
    return {n: F.get(rows, rank)[n] for n in REGION_COLUMNS}


def classify_features(matches: DataFrame, merged: DataFrame) -> DataFrame:
    """matches with the class of the strongest union of its gene that the span meets. A gene's unions, of which there are as
    many as its exons make, go to its matches as one list, so that matches are dealt by gene once and never joined back;
    the lists are written first, as a gene may be hot."""
    kinds = merged.where(F.col("merged_feature_type").isin([r[0] for r in REGIONS])).select("gene_id", F.struct(rank_column(F.col("merged_feature_type")).alias("rank"), "start", "end").alias("f"))
    lists = files.staged(kinds.groupBy("gene_id").agg(F.collect_list("f").alias("_f"))).hint("shuffle_merge")
    met = F.filter("_f", lambda f: (F.col("start") <= f["end"]) & (F.col("end") >= f["start"]))
    rank = F.coalesce(F.array_min(F.transform(met, lambda f: f["rank"])), F.lit(len(REGIONS) - 1))
    return matches.join(lists, "gene_id", "left").withColumn("_rank", rank).drop("_f").withColumns(region_columns(F.col("_rank"))).drop("_rank")


def fan_out_modules(matches: DataFrame, rows: DataFrame) -> DataFrame:
    """Every match once for each curated row of its gene."""
    return matches.join(rows.drop("approved_symbol"), "gene_id")


def triage(df: DataFrame) -> DataFrame:
    region, status = text(F.col("local_region_class")), text(F.col("module_status"))
    named = F.when(region == "", "candidate").otherwise(region)
    strong = (region == "utr_overlap") & (status == "Approved") & F.col("tier").isin("Tier 1", "Tier 2") & F.col("evidence_tier").isin("High", "Medium")
    weak = (F.col("annotation_needed") == "optional") & (region == "utr_overlap")
    said = lambda a, b="": F.concat(F.lit(a), named, F.lit(b))
    rules = [
        (F.col("annotation_needed") == "true", "include_ai", said("Included for AI: strong region class ", ".")),
        (F.lower("background_only").isin("true", "1", "yes", "y"), "exclude_background", said("Excluded from AI: background-only ", ".")),
        (status == "Draft", "exclude_draft_optional", said("Excluded from AI: Draft optional ", ".")),
        (region == "noncoding_exon_overlap", "exclude_optional_noncoding", F.lit("Excluded from AI: optional noncoding exon overlap.")),
        (strong, "include_ai", F.lit("Included for AI: strong UTR in Approved Tier 1/2 module with Medium/High evidence.")),
        (weak, "exclude_utr_weak", F.lit("Excluded from AI: UTR did not meet Approved Tier 1/2 and Medium/High evidence gate.")),
    ]
    decision = reduce(lambda a, r: a.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1]))).otherwise("exclude_optional_noncoding")
    reason = reduce(lambda a, r: a.when(r[0], r[2]), rules[1:], F.when(rules[0][0], rules[0][2])).otherwise(said("Excluded from AI: optional low-priority region ", "."))
    return df.withColumns({"triage_decision": decision, "triage_reason": reason})


def triage_summary(triaged: DataFrame) -> DataFrame:
    """Counts in long form, from one pass: rows by decision, region, module status, tier and evidence, included rows by their
    reason, and under 'count' the nine named figures. Blank values are left out."""
    c = F.col
    included, region = c("triage_decision") == "include_ai", text(c("local_region_class"))
    sets = ["triage_decision", "local_region_class", "module_status", "tier", "evidence_tier"]
    decisions = {"included_for_ai": "include_ai", "excluded_background": "exclude_background", "excluded_utr_weak": "exclude_utr_weak", "excluded_optional_noncoding": "exclude_optional_noncoding", "excluded_draft_optional": "exclude_draft_optional"}
    figures = {"rows_total": F.lit(True), "rows_with_genotype": text(c("gt")) != "", **{n: c("triage_decision") == d for n, d in decisions.items()}, "included_strong_region": included & (text(c("annotation_needed")) == "true"), "included_strong_utr": included & (region == "utr_overlap")}
    pairs = [(d, c(d)) for d in sets] + [("include_reason", F.when(included, c("triage_reason")))] + [("count", F.when(v, F.lit(n))) for n, v in figures.items()]
    long = triaged.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in pairs])).alias("x"), included.alias("_in")).where("x.value <> ''")
    return long.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"), F.count(F.when(c("_in"), 1)).alias("included"))


def scan_targets(records: DataFrame, ready: DataFrame) -> DataFrame:
    """Records whose label and position, as written, are those of a target of their upload."""
    return records.join(ready.select("upload_id", "chrom", "pos").distinct(), ["upload_id", "chrom", "pos"], "left_semi")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Running numbers from 1 within by, in order. A group may be any size: a row's number is its place in its range
    partition after the rows of its group in the partitions before, whose counts are joined (by broadcast where Spark finds
    them small)."""
    dealt = files.staged(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*by, "_part").orderBy(*order)
    return dealt.join(offsets, [*by, "_part"]).withColumn(name, F.row_number().over(inside) + F.col("_before")).drop("_part", "_before")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as an aggregate, so that tasks send one row a key. order tells a key's rows apart."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def match_status(rsid: Column, has_place: Column, has_vcf: Column, ref: Column, alt: Column) -> Column:
    exact = (ref == "ref_match") & (alt == "alt_exact_match")
    loose = (ref == "ref_match") & alt.isin("alt_partial_overlap", "missing_expected_alt")
    return F.when(text(rsid) == "", "no_rsid_detected").when(~has_place, "rsid_without_coordinates").when(~has_vcf, "no_vcf_match_by_chr_pos").when(exact, "match_strict").when(loose, "match_likely_needs_alt_review").otherwise("match_by_position_needs_review")


def consolidate(canon: DataFrame, ready: DataFrame, vcf: DataFrame) -> DataFrame:
    """canon: upload_id, row_id, rsid, source_group. ready: upload_id, rsid, chrom, pos, exp_ref, exp_alt, seq. vcf: called
    records. The first row of each key counts, within an upload; every canon row stays. A blank identifier names nothing and
    a row without a place has none to look up: such rows, which may be most, get a key of their own in place of one that
    all of them share. It begins with a tab, which no field of a sheet or a record holds."""
    own = F.concat_ws("\t", F.lit(""), F.col("row_id").cast("string"))
    blank, placed = text(F.col("rsid")) == "", F.col("chrom").isNotNull() & F.col("pos").isNotNull()
    one = first_by(ready, ["upload_id", "rsid"], ["seq"]).drop("seq")
    called = first_by(vcf.select("upload_id", "chrom", "pos", F.col("ref").alias("vcf_ref"), F.col("alt").alias("vcf_alt"), "gt", "line_no"), ["upload_id", "chrom", "pos"], ["line_no"])
    keyed = canon.withColumn("_id", F.when(blank, own).otherwise(F.col("rsid")))
    found = keyed.join(one.withColumnRenamed("rsid", "_id"), ["upload_id", "_id"], "left").drop("_id")
    found = found.withColumns({"_chrom": F.when(placed, F.col("chrom")).otherwise(own), "_pos": F.when(placed, F.col("pos")).otherwise("")})
    out = found.join(called.withColumnsRenamed({"chrom": "_chrom", "pos": "_pos"}), ["upload_id", "_chrom", "_pos"], "left").drop("_chrom", "_pos")
    out = out.withColumns({"has_place": F.col("pos").isNotNull(), "has_vcf": F.col("line_no").isNotNull(), "has_genotype": text(F.col("gt")) != "", "ref_status": g.compare_ref(F.col("exp_ref"), F.col("vcf_ref")), "alt_status": g.compare_alt(F.col("exp_alt"), F.col("vcf_alt")), "zygosity": g.zygosity(F.col("gt"))})
    return out.withColumn("match_status", match_status(F.col("rsid"), F.col("has_place"), F.col("has_vcf"), F.col("ref_status"), F.col("alt_status")))


def candidates_joined(vcf: DataFrame, ready: DataFrame) -> DataFrame:
    """Each candidate record with what all ready rows of its upload at its place say, in order of those rows."""
    hit = vcf.select("upload_id", "line_no", "chrom", "pos").join(ready, ["upload_id", "chrom", "pos"])
    listed = F.array_sort(F.collect_list(F.struct("seq", "rsid")))
    return hit.groupBy("upload_id", "line_no").agg(F.array_join(F.array_distinct(F.transform(listed, lambda x: x["rsid"])), "|").alias("rsids"), F.count("*").alias("n_source_rows"), F.min_by("exp_ref", "seq").alias("exp_ref"))


def confidence_legacy(status: Column, group: Column, zygosity: Column, has_genotype: Column) -> Column:
    careful = (group == "revision_manual") | (zygosity == "non_diploid_or_complex")
    return F.when((status == "match_strict") & has_genotype, F.when(careful, "Moderate").otherwise("High")).when((status == "match_likely_needs_alt_review") & has_genotype, "Moderate").otherwise("Low")


def review_legacy(df: DataFrame) -> DataFrame:
    status, manual = F.col("match_status"), F.col("source_group") == "revision_manual"
    review = F.when(status == "match_strict", F.when(manual, "ready_but_manual_row_review").otherwise("ready_for_interpretation")).when(status == "match_likely_needs_alt_review", "interpretable_with_alt_review").when(status == "no_vcf_match_by_chr_pos", "no_variant_observed_in_vcf_at_locus").when(status == "rsid_without_coordinates", "technical_resolution_pending").when(status == "no_rsid_detected", "missing_rsid").otherwise("review_needed")
    notes = F.when(manual, "Original sheet row needs manual structural review.").when(status == "match_likely_needs_alt_review", "Position-level match found; ALT representation should be reviewed before final biological interpretation.").when(status == "no_vcf_match_by_chr_pos", "Queried locus was not observed in the current VCF by CHROM+POS.").when(status == "no_rsid_detected", "No usable rsID detected in the original row.").otherwise("")
    at = F.when(text(F.col("rsid")) == "", "this locus").otherwise(F.col("rsid"))
    sentence = F.when(F.col("has_genotype"), F.concat(F.lit("Observed genotype at "), at, F.lit("; functional interpretation pending review."))).otherwise("No genotype was observed at this queried locus in the current VCF; no genotype-specific interpretation assigned.")
    return df.withColumns({"review_status": review, "notes": notes, "sentence": sentence})


def review_v2(df: DataFrame) -> DataFrame:
    background = F.col("background_only") == "true"
    review = F.when(background, "background_only").when(F.col("annotation_needed") == "true", "ready_for_annotation").when(F.col("annotation_needed") == "optional", "optional_annotation").otherwise("local_review_only")
    overlap = F.col("overlap_feature_types")
    notes = F.concat_ws(" ", F.when(F.lower("module_status") == "draft", F.lit("Draft module included with explicit flag.")), F.when(text(overlap) != "", F.concat(F.lit("Matched via "), overlap, F.lit("."))), F.when(background, F.lit("Kept for audit but classified as background-only.")))
    tail = F.when(background, " and currently background-only.").otherwise(" and may require downstream annotation.")
    sentence = F.concat(F.lit("Observed variant in "), "approved_symbol", F.lit("; local classification is "), "local_region_class", tail)
    return df.withColumns({"review_status": review, "notes": notes, "sentence": sentence})


def physical_variants(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row for each variant, its first, with the number of module rows: one aggregate, so that tasks send one row a
    variant."""
    keys = ["upload_id", "variant_key"]
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.count("*").alias("module_row_count"))
    return out.select(*keys, "_r.*", "module_row_count").select(*rows.columns, "module_row_count")


def normalization_gate(counts: DataFrame) -> DataFrame:
    """counts: observed, matched, outside."""
    rate = F.when(F.col("observed") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("matched") / F.col("observed")))
    status = F.when(F.col("observed") == 0, "invalid").when((rate >= 0.99) & (F.col("outside") == 0), "pass").otherwise("fail")
    return counts.withColumns({"valid_rate": rate, "gate": status})
