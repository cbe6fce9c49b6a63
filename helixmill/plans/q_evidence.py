"""Queries over evidence, groups and interpretation rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions import text as t
from helixmill.operators import evidence as e
from helixmill.plans.fixtures import view
from helixmill.sources import files

C = F.col


def v(name):
    return lambda s, d: view(s, d, name)


def scored(s, d):
    """Annotations with the columns that scoring reads; groups from the sequence number."""
    a = view(s, d, "annotations")
    k = C("ann_seq")
    cols = {"local_region_class": F.when(k % 6 == 0, "mane_cds_overlap").when(k % 6 == 1, "splice_region_candidate").when(k % 6 == 2, "utr_overlap").when(k % 6 == 3, "").otherwise("intronic_transcript_overlap"), "clinvar_normalized_classification": t.clinvar_class(C("clinvar_significance")), "pharmgkb_variant_annotation_count": F.when(k % 4 == 0, "2").otherwise(""), "vep_spliceai": F.when(k % 5 == 0, "0.9").otherwise(""), "vep_hgvsp": F.when(k % 3 == 0, "p.1").otherwise(""), "vep_cadd_phred": C("cadd_phred"), "vep_revel_score": C("revel_score"), "vep_alphamissense_pred": F.when(k % 7 == 0, "Likely_Pathogenic").otherwise(""), "population_max_frequency": F.when(k % 8 == 0, "0.06").otherwise("0.01"), "start": k, "ref_alt": F.lit("A>G"), "grp": k % 40 * 3}
    return e.attention(a.withColumns(cols))


GROUP = ["grp"]


def ranked(s, d):
    return e.attention_rank(scored(s, d), GROUP, [])


def report_rows(s, d):
    """Interpretation rows with the texts that reports look into."""
    k = C("row_id")
    texts = {"technical_interpretation_es": F.when(k % 11 == 0, "Hgvsp"), "confidence_rationale_en": F.when(k % 5 == 0, "Clinical ").otherwise(" "), "recommended_next_review_step_en": F.when(k % 7 == 0, "Ask about Medication"), "evidence_used": F.when(k % 13 == 0, '["risk factor"]')}
    return view(s, d, "interp").withColumns({n: F.lit(None).cast("string") for n in e.MIX_TEXTS if n != "technical_notes_en"}).withColumns(texts)


def axis_rows(s, d, rows=None):
    rows = view(s, d, "interp") if rows is None else rows
    return rows.join(e.map_axis(rows, view(s, d, "axis_patterns")), "category")


def flag(name):
    return t.as_bool(C(name))


def priority():
    return e.review_priority(C("final_confidence_level"), flag("evidence_conflict_flag"), flag("requires_professional_review"), flag("gene_or_locus_ambiguity_flag"))


DOCUMENT = ["size", "bin_120", "bin_100", "bin_80", "bin_low", "pgx_signal_rows", "clinvar_conflict_rows", "population_common_rows", "max_score", "mean_score", "focus_count", "summarized_count", "focus_refs", "remaining_refs", "remaining_pgx_signal_rows", "remaining_hgvsp_rows", "remaining_spliceai_rows", "remaining_cadd_gte_20_rows", "remaining_revel_gte_0_75_rows"]
DOCUMENT += [f"{left}{name}" for left in ("", "remaining_") for name in e.COUNTED.values()]


def documents(s, d):
    rows = scored(s, d).withColumn("zygosity", F.when(C("ann_seq") % 9 == 0, "").when(C("ann_seq") % 2 == 0, "heterozygous").otherwise("homozygous"))
    return e.group_documents(rows, GROUP, C("rsid"), [])


def confidence():
    return F.when(C("ann_seq") % 5 < 3, "High").otherwise("Moderate")


def readiness_columns():
    """Evidence columns of scored rows under the names that readiness reads."""
    k = C("ann_seq")
    return {"canon_effect": F.when(k % 4 == 1, "raises"), "vep_hgvsp": C("vep_hgvsp"), "vep_hgvsc": F.when(k % 9 == 1, "c.1"), "vep_cadd_phred": C("vep_cadd_phred"), "vep_revel_score": C("vep_revel_score"), "clinvar_normalized_classification": C("clinvar_normalized_classification"), "gwas_association_count": C("gwas_association_count"), "pharmgkb_clinical_annotation_count": C("pharmgkb_clinical_annotation_count"), "pharmgkb_variant_annotation_count": C("pharmgkb_variant_annotation_count"), "population_frequency_summary": F.when(k % 6 != 2, "max_freq=0.01")}


def jsonl(s, df):
    """df written as lines of JSON, read back as text."""
    path = files.shared_dir(s)
    files.write_jsonl(df, path)
    return s.read.text(path).select(C("value").alias("line"))


NOW = "2024-06-01 00:00:00"
QUERIES = {
    "json_vep": lambda s, d: e.parse_vep(view(s, d, "vep_payloads")).drop("payload"),
    "win_transcript_pick": lambda s, d: e.parse_vep(view(s, d, "vep_payloads")).select("line_no", "vep_gene", "vep_transcript"),
    "cls_rsid_resolution": lambda s, d: e.resolve_rsid(view(s, d, "vep_payloads")).select("line_no", "resolved_rsid", "rsid_status", "rsid_reason", "colocated_count", "colocated_rsid_count"),
    "json_gwas": lambda s, d: e.parse_gwas(view(s, d, "gwas_payloads")).select("rsid", "n", "traits", (C("min_p") <= 5e-8).alias("strong"), "genes", F.regexp_replace("top_associations", "p=[^; ]*", "p").alias("associations")),
    "json_clinvar": lambda s, d: e.parse_clinvar(view(s, d, "clinvar_payloads")).drop("payload"),
    "json_pgx": lambda s, d: e.parse_pgx(view(s, d, "pgx_payloads"), notes="notes").drop("payload", "notes"),
    "win_cache_latest": lambda s, d: e.merge_cache(view(s, d, "cache_writes")).select("variant_key", "source", "event_id", "status"),
    "join_cache_miss": lambda s, d: e.cache_misses(view(s, d, "cache_writes").select("assembly", "variant_key", "source", "fingerprint").distinct(), e.merge_cache(view(s, d, "cache_writes")), NOW).drop("assembly"),
    "agg_source_metrics": lambda s, d: view(s, d, "cache_writes").groupBy("source").agg(F.count("*").alias("completed"), F.count(F.when(C("status") == "source_error", 1)).alias("errors"), F.count(F.when(C("status") == "not_found", 1)).alias("not_found"), F.count(F.when(C("fingerprint") == "f0", 1)).alias("cache_hits")),
    "cls_source_status": lambda s, d: view(s, d, "annotations").select("rsid", e.source_status(C("ann_seq") % 11 == 0, t.as_int(C("gwas_association_count")), F.lit(True), C("ann_seq") % 5 == 0, C("ann_seq") % 13 > 0).alias("status")),
    "agg_enrichment_gate": lambda s, d: e.parse_vep(view(s, d, "vep_payloads")).agg(F.count("*").alias("physical"), F.count(F.when(C("vep_status") == "direct_target_transcript", 1)).alias("success")).select("physical", "success", (C("success") / C("physical") >= 0.95).alias("passed")),
    "join_annotations": lambda s, d: view(s, d, "interp").select("row_id", C("rsid").alias("id")).join(view(s, d, "annotations").select("rsid", "cadd_phred", "clinvar_significance"), C("id") == C("rsid"), "left").select("row_id", "id", "cadd_phred", "clinvar_significance"),
    "cls_attention_score": lambda s, d: scored(s, d).select("rsid", C("attention_score").cast("bigint").alias("attention_score"), F.array_join("attention_reasons", "|").alias("reasons")),
    "cls_vep_flags": lambda s, d: scored(s, d).select("rsid", F.concat_ws("|", F.when(C("vep_hgvsp") != "", "hgvsp"), F.when(C("vep_spliceai") != "", "spliceai"), F.when(t.as_float(C("vep_cadd_phred")) >= 20, "cadd_gte_20"), F.when(t.as_float(C("vep_revel_score")) >= 0.75, "revel_gte_0_75")).alias("flags"), ((t.as_int(C("pharmgkb_clinical_annotation_count")) > 0) | (t.as_int(C("pharmgkb_variant_annotation_count")) > 0)).alias("pgx")),
    "win_attention_rank": lambda s, d: ranked(s, d).select("rsid", "grp", C("attention_rank").cast("bigint").alias("attention_rank"), "group_size"),
    "win_focus_topk": lambda s, d: e.focus_rows(ranked(s, d), GROUP).select("rsid", "grp"),
    "agg_group_payload": lambda s, d: documents(s, d).select("grp", *DOCUMENT),
    "agg_grouping_summary": lambda s, d: e.grouping_summary(documents(s, d)),
    "win_largest_groups": lambda s, d: e.group_payloads(scored(s, d), GROUP).orderBy(F.desc("size"), "grp").limit(10).select("grp", "size"),
    "snk_jsonl": lambda s, d: jsonl(s, e.group_payloads(scored(s, d), GROUP).select("grp", "size", C("max_score").cast("bigint").alias("max_score"))),
    "agg_duplicate_confidence": lambda s, d: e.duplicate_confidence(view(s, d, "interp")),
    "join_category_axis": lambda s, d: e.map_axis(view(s, d, "interp"), view(s, d, "axis_patterns")),
    "agg_axis_groups": lambda s, d: e.report_groups(axis_rows(s, d, report_rows(s, d)), ["axis_id"]),
    "agg_axis_members": lambda s, d: e.group_members(axis_rows(s, d), ["axis_id"]),
    "agg_category_groups": lambda s, d: e.report_groups(report_rows(s, d), ["category"]),
    "agg_dominant_confidence": lambda s, d: e.distribution(view(s, d, "interp"), ["gene"]).select("gene", "suggested_confidence"),
    "agg_axis_strength": lambda s, d: e.distribution(view(s, d, "interp"), ["rsid"]).select("rsid", "strength"),
    "agg_evidence_mix": lambda s, d: e.evidence_mix(report_rows(s, d), ["gene"]),
    "agg_interpretation_totals": lambda s, d: view(s, d, "interp").agg(F.count("*").alias("n_rows"), F.count_distinct(F.lower("rsid")).alias("rsids"), F.count_distinct(F.upper("gene")).alias("genes"), *[F.count(F.when(C("final_confidence_level") == x, 1)).alias(x.lower()) for x in ("High", "Moderate", "Low", "Conflicting")]),
    "agg_repeated_rsids": lambda s, d: e.repeated_rsids(view(s, d, "interp")),
    "agg_multi_variant_genes": lambda s, d: view(s, d, "interp").groupBy("gene").agg(F.count_distinct("rsid").alias("n"), F.array_join(F.array_sort(F.collect_set("rsid")), "|").alias("rsids")).where("n > 1"),
    "cls_review_priority": lambda s, d: view(s, d, "interp").select("row_id", priority().alias("priority")),
    "cls_flag_lists": lambda s, d: e.flag_lists(report_rows(s, d)),
    "win_top_findings": lambda s, d: view(s, d, "interp").select("row_id", "gene", "rsid", "final_confidence_level", priority().alias("p")).orderBy(F.when(C("p") == "high", 0).when(C("p") == "medium", 1).otherwise(2), F.when(C("final_confidence_level") == "High", 0).when(C("final_confidence_level") == "Moderate", 1).when(C("final_confidence_level") == "Conflicting", 2).otherwise(3), F.desc("gene"), F.desc("rsid"), "row_id").limit(20).where("NOT (p = 'low' AND final_confidence_level = 'Low')").select("row_id", "p"),
    "cls_report_readiness": lambda s, d: e.report_readiness(axis_rows(s, d)),
    "agg_qa_warnings": lambda s, d: view(s, d, "interp").select(F.explode(F.split(F.concat_ws("|", F.when(flag("evidence_conflict_flag"), "conflict"), F.when(flag("requires_professional_review"), "review"), F.when(C("row_id") % 3 == 0, "third")), r"\|")).alias("warning")).where("warning <> ''").groupBy("warning").agg(F.count("*").alias("n")),
    "cls_association_raise": lambda s, d: view(s, d, "interp").select("row_id", F.when((C("final_confidence_level") == "Low") & t.any_of(C("technical_notes_en"), t.NONCODING) & t.gwas_strong(C("technical_notes_en")) & t.any_of(C("technical_notes_en"), t.BIOMARKERS), "Moderate").otherwise(C("final_confidence_level")).alias("confidence")),
    "cls_calibrated_scope": lambda s, d: view(s, d, "interp").select("row_id", F.when(C("final_confidence_level") == "Conflicting", "conflicting_review_needed").when((C("final_confidence_level") == "Low") & t.any_of(C("technical_notes_en"), t.NONCODING), "association_only").when(C("final_confidence_level") == "Low", "limited_evidence").when(F.contains("technical_notes_en", F.lit("pharmgkb")), "pharmacogenomic").otherwise("benign_contextual").alias("scope")),
    "cls_readiness": lambda s, d: scored(s, d).select("rsid", e.interpretation_readiness(readiness_columns(), t.text(confidence())).alias("readiness")),
    "set_subset_check": lambda s, d: view(s, d, "interp").select("row_id", F.split("ref_alt", "/").alias("a"), F.when(C("row_id") % 3 == 0, F.array(F.lit("A"), F.lit("G"), F.lit("T"))).when(C("row_id") % 3 == 1, F.array(F.lit("G"))).otherwise(F.array(F.lit("X"))).alias("b")).select("row_id", F.when(F.size(F.array_except("a", "b")) == 0, "subset").when(F.arrays_overlap("a", "b"), "overlap").otherwise("disjoint").alias("status")),
}

R = {n: f"{n} = 'true'" for n in ("gene_or_locus_ambiguity_flag", "evidence_conflict_flag", "requires_professional_review")}
PRI = f"CASE WHEN final_confidence_level = 'Conflicting' OR {R['evidence_conflict_flag']} THEN 'high' WHEN {R['requires_professional_review']} OR {R['gene_or_locus_ambiguity_flag']} THEN 'medium' ELSE 'low' END"
RSID = """ra AS (SELECT *, 'rs' || CAST(line_no AS VARCHAR) AS r1, CASE WHEN id <> '.' AND line_no % 2 = 0 THEN id ELSE 'rs' || CAST(line_no + 1 AS VARCHAR) END AS r2, line_no % 7 NOT IN (1, 2) AS near, line_no % 7 > 3 AS placed FROM vep_payloads),
rh AS (SELECT *, CASE WHEN line_no % 5 IN (1, 3) AND near OR line_no % 5 = 2 AND line_no % 2 = 0 AND placed THEN r1 END AS h1, CASE WHEN line_no % 5 = 3 AND near THEN r2 END AS h2, CASE line_no % 5 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS n FROM ra),
rk AS (SELECT *, CASE WHEN id = h1 OR id = h2 THEN 'own' WHEN h2 IS NOT NULL AND h1 <> h2 THEN 'many' WHEN h1 IS NOT NULL THEN CASE WHEN line_no % 5 = 2 THEN 'indel' ELSE 'one' END WHEN line_no % 5 IN (1, 2, 3) THEN 'mismatch' ELSE 'none' END AS k FROM rh),
rr AS (SELECT *, CASE k WHEN 'own' THEN id WHEN 'one' THEN h1 WHEN 'indel' THEN h1 ELSE '' END AS resolved_rsid,
 CASE k WHEN 'own' THEN 'vcf_id_confirmed_by_vep_exact_allele' WHEN 'many' THEN 'ambiguous_multiple_exact_rsids' WHEN 'indel' THEN 'vep_colocated_normalized_indel' WHEN 'one' THEN 'vep_colocated_exact_allele' WHEN 'mismatch' THEN 'vep_colocated_allele_mismatch' ELSE 'unresolved_no_exact_rsid' END AS rsid_status,
 CASE k WHEN 'own' THEN 'vcf_id_and_vep_allele_match' WHEN 'many' THEN 'multiple_vep_colocated_allele_matches' WHEN 'mismatch' THEN 'colocated_rsid_requires_coordinate_allele_reconciliation' WHEN 'none' THEN 'vep_response_has_no_colocated_rsid' ELSE 'unique_vep_colocated_allele_match' END AS rsid_reason,
 CAST(n AS BIGINT) AS colocated_count, CAST(CASE WHEN line_no % 5 = 3 AND r1 = r2 THEN 1 WHEN line_no % 5 = 4 THEN 0 ELSE n END AS BIGINT) AS colocated_rsid_count FROM rk)"""
NO = "''"
OWN_LINE = "'gene=' || g2 || '; tx=' || own_t || '; consequence=missense_variant|splice_region_variant; impact=MODERATE; biotype=protein_coding; hgvsc=c.' || CAST(line_no % 77 AS VARCHAR) || '; hgvsp=p.' || CAST(line_no % 99 AS VARCHAR) || '; cadd_phred=' || CAST(line_no % 35 AS VARCHAR) || CASE line_no % 4 WHEN 1 THEN '; revel=0.7' WHEN 2 THEN '; revel=0.8' ELSE '' END || CASE WHEN line_no % 6 = 0 THEN '; spliceai={\"DS_AG\":0.1}' ELSE '' END"
BEST = lambda v: f"CASE WHEN direct OR mane THEN {v} ELSE '' END"  # noqa: E731  else the other gene's, whose fields are few
VEP_SQL = {
    "most_severe_consequence": "CASE line_no % 3 WHEN 0 THEN 'missense_variant' WHEN 1 THEN 'intron_variant' ELSE 'synonymous_variant' END", "variant_class": "'SNV'", "status": "CASE WHEN direct THEN 'direct_target_transcript' ELSE 'other_gene_only' END",
    "genes": "'OTHER|' || g2", "impacts": "CASE WHEN direct THEN 'MODERATE' ELSE 'LOW|MODERATE' END", "terms": "CASE WHEN direct THEN '' ELSE 'intron_variant|' END || 'missense_variant|splice_region_variant'",
    "transcript_summary": f"CASE WHEN direct THEN '' ELSE 'gene=OTHER; tx=T0; consequence=intron_variant; impact=LOW; biotype=lncRNA|' END || {OWN_LINE}", "gene": "CASE WHEN direct OR mane THEN g2 ELSE 'OTHER' END", "transcript": "CASE WHEN direct OR mane THEN own_t ELSE 'T0' END", "impact": "CASE WHEN direct OR mane THEN 'MODERATE' ELSE 'LOW' END",
    "canonical": "CASE WHEN direct OR mane THEN '' ELSE '1' END", "mane_select": BEST("CASE WHEN mane THEN 'NM_' || substr(target_gene, 2) || '.1' ELSE '' END"), "hgvsc": BEST("'c.' || CAST(line_no % 77 AS VARCHAR)"), "hgvsp": BEST("'p.' || CAST(line_no % 99 AS VARCHAR)"), "protein_id": NO, "exon": BEST("'2/5'"), "intron": NO, "amino_acids": BEST("'A/V'"),
    "sift_prediction": BEST("CASE line_no % 3 WHEN 0 THEN 'tolerated' WHEN 1 THEN 'D' ELSE '' END"), "sift_score": BEST("CASE line_no % 3 WHEN 0 THEN '0.5' ELSE '' END"), "polyphen_prediction": NO, "polyphen_score": NO, "cadd_phred": BEST("CAST(line_no % 35 AS VARCHAR)"), "revel_score": BEST("CASE line_no % 4 WHEN 1 THEN '0.7' WHEN 2 THEN '0.8' ELSE '' END"),
    "alphamissense_score": NO, "alphamissense_pred": NO, "mutationtaster_pred": NO, "metasvm_pred": NO, "spliceai": BEST("CASE WHEN line_no % 6 = 0 THEN '{\"DS_AG\":0.1}' ELSE '' END"), "cdna": BEST("CAST(line_no % 500 AS VARCHAR) || '-' || CAST(line_no % 500 + 1 AS VARCHAR)"), "cds": BEST("CAST(line_no % 300 AS VARCHAR)"), "protein_position": BEST("'7-9'"),
    "uniprot": BEST("'P' || CAST(line_no % 9 AS VARCHAR) || '|UPI1'"), "domains_summary": BEST("'Pfam:PF' || CAST(line_no % 5 AS VARCHAR) || '|Gene3D:g'"),
    "colocated_variants": "CASE line_no % 5 WHEN 0 THEN '' WHEN 2 THEN 'id=RS' || CAST(line_no AS VARCHAR) || '; alleles=' || CASE WHEN line_no % 2 = 0 THEN 'C' || alt || '/C' || ref ELSE ref || '/CCC' END WHEN 4 THEN 'id=COSV' || CAST(line_no AS VARCHAR) || '; alleles=' || ref || '/' || alt ELSE 'id=rs' || CAST(line_no AS VARCHAR) || '; alleles=' || ref || '/' || alt || CASE WHEN line_no % 5 = 3 AND NOT (id <> '.' AND line_no % 2 = 0 AND id = 'rs' || CAST(line_no AS VARCHAR)) THEN '|id=' || CASE WHEN id <> '.' AND line_no % 2 = 0 THEN id ELSE 'rs' || CAST(line_no + 1 AS VARCHAR) END || '; alleles=' || ref || '/' || alt ELSE '' END END",
}
RAWJ = """jv AS (SELECT v.*, 'T' || substr(target_gene, 2) || '_1' AS own_t, line_no % 4 <> 0 AS direct, line_no % 2 = 0 AS mane, CASE WHEN line_no % 4 = 0 THEN 'X' ELSE target_gene END AS g2 FROM vep_payloads v)"""
CL = "CASE WHEN clinvar_significance IS NULL THEN 'not_reported' WHEN lower(clinvar_significance) LIKE '%conflicting%pathogenic%' THEN 'conflicting_pathogenicity' WHEN lower(clinvar_significance) LIKE '%pathogenic%' THEN 'pathogenic_or_likely_pathogenic' WHEN lower(clinvar_significance) LIKE '%uncertain%' THEN 'uncertain_significance' WHEN clinvar_significance LIKE '%drug response%' THEN 'drug_response' WHEN clinvar_significance LIKE '%risk factor%' THEN 'risk_factor' WHEN lower(clinvar_significance) LIKE '%benign%' THEN 'benign_or_likely_benign' ELSE 'other_reported' END"
NUM = lambda c: f"coalesce(TRY_CAST({c} AS DOUBLE), 0)"
SC = f"""s0 AS (SELECT *, {CL} AS cl, ann_seq % 6 AS r6, {NUM('cadd_phred')} AS cadd, {NUM('revel_score')} AS revel, coalesce(TRY_CAST(gwas_min_pvalue AS DOUBLE), 1.0) AS p, {NUM('pharmgkb_clinical_annotation_count')} AS pc, {NUM('gwas_association_count')} AS gc, ann_seq % 40 * 3 AS grp FROM annotations),
s1 AS (SELECT *, CASE r6 WHEN 0 THEN 100 WHEN 1 THEN 95 WHEN 2 THEN 60 ELSE 40 END AS base, CASE r6 WHEN 0 THEN 'mane_cds_overlap' WHEN 1 THEN 'splice_region_candidate' WHEN 2 THEN 'utr_overlap' WHEN 3 THEN 'other' ELSE 'intronic_transcript_overlap' END AS rn FROM s0),
sc AS (SELECT *, CAST(base + CASE cl WHEN 'conflicting_pathogenicity' THEN 40 WHEN 'pathogenic_or_likely_pathogenic' THEN 35 WHEN 'drug_response' THEN 30 WHEN 'risk_factor' THEN 20 WHEN 'benign_or_likely_benign' THEN 5 ELSE 0 END + CASE WHEN pc > 0 THEN 25 ELSE 0 END + CASE WHEN ann_seq % 4 = 0 THEN 10 ELSE 0 END + CASE WHEN ann_seq % 5 = 0 THEN 20 ELSE 0 END + CASE WHEN ann_seq % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN cadd >= 20 THEN 15 WHEN cadd >= 10 THEN 8 ELSE 0 END + CASE WHEN revel >= 0.75 THEN 15 WHEN revel >= 0.5 THEN 8 ELSE 0 END + CASE WHEN ann_seq % 7 = 0 THEN 10 ELSE 0 END + CASE WHEN gc > 0 THEN 5 ELSE 0 END + CASE WHEN p > 0 AND p <= 5e-8 THEN 5 ELSE 0 END - CASE WHEN ann_seq % 8 = 0 THEN 10 ELSE 0 END AS BIGINT) AS attention_score,
 concat_ws('|', 'base:' || rn || '=' || CAST(base AS VARCHAR), CASE WHEN cl IN ('conflicting_pathogenicity', 'pathogenic_or_likely_pathogenic', 'drug_response', 'risk_factor', 'benign_or_likely_benign') THEN 'clinvar_' || cl END, CASE WHEN pc > 0 THEN 'pharmgkb_clinical_annotation_count' END, CASE WHEN ann_seq % 4 = 0 THEN 'pharmgkb_variant_annotation_count' END, CASE WHEN ann_seq % 5 = 0 THEN 'vep_spliceai' END, CASE WHEN ann_seq % 3 = 0 THEN 'vep_hgvsp' END, CASE WHEN cadd >= 20 THEN 'vep_cadd_phred_gte_20' WHEN cadd >= 10 THEN 'vep_cadd_phred_gte_10' END, CASE WHEN revel >= 0.75 THEN 'vep_revel_score_gte_0_75' WHEN revel >= 0.5 THEN 'vep_revel_score_gte_0_50' END, CASE WHEN ann_seq % 7 = 0 THEN 'vep_alphamissense_pred' END, CASE WHEN gc > 0 THEN 'gwas_association_count' END, CASE WHEN p > 0 AND p <= 5e-8 THEN 'gwas_min_pvalue_lte_5e_8' END, CASE WHEN ann_seq % 8 = 0 THEN 'population_max_frequency_gte_0_05' END) AS reasons FROM s1),
rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY attention_score DESC, ann_seq, rsid) AS attention_rank, count(*) OVER (PARTITION BY grp) AS group_size FROM sc),
gp AS (SELECT grp, count(*) AS size, count(*) FILTER (WHERE attention_score >= 120) AS bin_120, count(*) FILTER (WHERE attention_score BETWEEN 100 AND 119) AS bin_100, count(*) FILTER (WHERE attention_score BETWEEN 80 AND 99) AS bin_80, count(*) FILTER (WHERE attention_score < 80) AS bin_low, max(attention_score) AS max_score FROM sc GROUP BY grp)"""

def counts_of(value, where):
    """Counts by value as JSON in a group, blank values left out."""
    return f"coalesce((SELECT '{{{{' || string_agg('\"' || v || '\":' || CAST(n AS VARCHAR), ',' ORDER BY v) || '}}}}' FROM (SELECT {value} AS v, count(*) AS n FROM fo x WHERE x.grp = g.grp AND {where} AND {value} <> '' GROUP BY 1)), '{{{{}}}}')".replace("{{", "{").replace("}}", "}")


REGION_SQL, ZYG_SQL = "CASE r6 WHEN 3 THEN '' ELSE rn END", "CASE WHEN ann_seq % 9 = 0 THEN '' WHEN ann_seq % 2 = 0 THEN 'heterozygous' ELSE 'homozygous' END"
SIGNALS = {"pgx_signal_rows": "(pc > 0 OR ann_seq % 4 = 0)", "hgvsp_rows": "ann_seq % 3 = 0", "spliceai_rows": "ann_seq % 5 = 0", "cadd_gte_20_rows": "cadd >= 20", "revel_gte_0_75_rows": "revel >= 0.75"}
DOCS = SC + f""", tw AS (SELECT grp AS g12, attention_score AS s12 FROM rk WHERE attention_rank = 12), fo AS MATERIALIZED (SELECT rk.*, group_size <= 25 OR attention_rank <= 12 OR coalesce(attention_rank <= 20 AND attention_score = s12, FALSE) AS focus FROM rk LEFT JOIN tw ON grp = g12),
ga AS (SELECT grp, count(*) AS size, count(*) FILTER (WHERE attention_score >= 120) AS bin_120, count(*) FILTER (WHERE attention_score BETWEEN 100 AND 119) AS bin_100, count(*) FILTER (WHERE attention_score BETWEEN 80 AND 99) AS bin_80, count(*) FILTER (WHERE attention_score < 80) AS bin_low, count(*) FILTER (WHERE {SIGNALS["pgx_signal_rows"]}) AS pgx_signal_rows, count(*) FILTER (WHERE cl = 'conflicting_pathogenicity') AS clinvar_conflict_rows, count(*) FILTER (WHERE ann_seq % 8 = 0) AS population_common_rows, max(attention_score) AS max_score, round(avg(attention_score), 2) AS mean_score, count(*) FILTER (WHERE focus) AS focus_count, count(*) FILTER (WHERE NOT focus) AS summarized_count,
 coalesce(string_agg(rsid, '|' ORDER BY attention_rank) FILTER (WHERE focus), '') AS focus_refs, array_to_string((list(rsid ORDER BY attention_rank) FILTER (WHERE NOT focus))[1:40], '|') AS rest, {", ".join(f"count(*) FILTER (WHERE NOT focus AND {v}) AS remaining_{k}" for k, v in SIGNALS.items())} FROM fo GROUP BY grp),
gd AS (SELECT g.*, coalesce(rest, '') AS remaining_refs, {", ".join(f"{counts_of(v, w)} AS {left}{k}" for left, w in (("", "TRUE"), ("remaining_", "NOT focus")) for k, v in (("region_counts", REGION_SQL), ("clinvar_counts", "cl"), ("zygosity_counts", ZYG_SQL)))} FROM ga g)"""


def dist(by, source="interp"):
    return f"""SELECT *, CASE WHEN conflicting > 0 THEN 'Conflicting' WHEN high >= 2 OR (high >= 1 AND moderate >= 2) THEN 'High' WHEN high > 0 OR moderate >= 2 THEN 'Moderate' ELSE 'Low' END AS suggested_confidence, CASE WHEN conflicting > 0 THEN 'review_with_caution' WHEN rsids >= 5 AND genes >= 4 AND low < rows THEN 'strong' WHEN rsids >= 2 AND genes >= 2 THEN 'moderate' ELSE 'limited' END AS strength
 FROM (SELECT {by}, count(*) AS rows, count(*) FILTER (WHERE final_confidence_level = 'High') AS high, count(*) FILTER (WHERE final_confidence_level = 'Moderate') AS moderate, count(*) FILTER (WHERE final_confidence_level = 'Low') AS low, count(*) FILTER (WHERE final_confidence_level = 'Conflicting') AS conflicting, count(DISTINCT rsid) AS rsids, count(DISTINCT gene) AS genes FROM {source} GROUP BY {by})"""


AX = """ca AS (SELECT DISTINCT category, trim(regexp_replace(translate(lower(category), '_/&', '   '), '\\s+', ' ', 'g')) AS n FROM interp),
ax AS (SELECT category, coalesce(arg_min(axis_id, axis_order), 'uncategorized_context') AS axis_id FROM (SELECT ca.category, a.axis_id, a.axis_order FROM ca LEFT JOIN axis_patterns a ON contains(ca.n, a.pattern)) GROUP BY category),
ar AS (SELECT interp.*, ax.axis_id FROM interp JOIN ax ON interp.category = ax.category)"""
REPORT_BLOB = "lower(concat_ws(' ', CASE WHEN row_id % 11 = 0 THEN 'Hgvsp' END, CASE WHEN row_id % 5 = 0 THEN 'Clinical' END, technical_notes_en, CASE WHEN row_id % 7 = 0 THEN 'Ask about Medication' END, CASE WHEN row_id % 13 = 0 THEN 'risk factor' END))"
MIX_SQL = ", ".join(f"count(*) FILTER (WHERE regexp_matches(blob, '{p}')) AS {n}" for n, p in e.MIX.items()) + f", count(*) FILTER (WHERE {R['requires_professional_review']} OR {R['gene_or_locus_ambiguity_flag']}) AS technical_review_flags"
STRONG = "contains(technical_notes_en, 'gwas')"
SQL = {
    "snk_jsonl": f"""WITH {SC} SELECT '{{"grp":' || grp || ',"size":' || size || ',"max_score":' || CAST(max_score AS BIGINT) || '}}' AS line FROM gp""",
    "json_vep": f"WITH {RAWJ} SELECT line_no, target_gene, contig, pos, id, ref, alt, {', '.join(f'{v} AS vep_{k}' for k, v in VEP_SQL.items())} FROM jv",
    "win_transcript_pick": f"WITH {RAWJ} SELECT line_no, CASE WHEN direct THEN target_gene ELSE 'X' END AS vep_gene, own_t AS vep_transcript FROM jv",
    "cls_rsid_resolution": f"WITH {RSID} SELECT line_no, resolved_rsid, rsid_status, rsid_reason, colocated_count, colocated_rsid_count FROM rr",
    "json_gwas": "SELECT rsid, CAST(2 AS BIGINT) AS n, CASE WHEN ann_seq % 5 = ann_seq % 3 THEN 't' || CAST(ann_seq % 5 AS VARCHAR) ELSE 't' || CAST(ann_seq % 5 AS VARCHAR) || '|t' || CAST(ann_seq % 3 AS VARCHAR) END AS traits, least(CAST(CAST(ann_seq % 9 + 1 AS VARCHAR) || 'e-' || CAST(ann_seq % 12 + 3 AS VARCHAR) AS DOUBLE), CAST(CAST(ann_seq % 7 + 1 AS VARCHAR) || 'e-' || CAST(ann_seq % 10 + 2 AS VARCHAR) AS DOUBLE)) <= 5e-8 AS strong, CASE WHEN rsid IS NOT NULL THEN 'H' || CAST(ann_seq % 4 AS VARCHAR) || '|H9' END AS genes, 'trait=t' || CAST(ann_seq % 5 AS VARCHAR) || '; p || trait=t' || CAST(ann_seq % 3 AS VARCHAR) || '; p; ' || CASE WHEN ann_seq % 2 = 0 THEN 'beta=0.25 increase' ELSE 'OR=1.5' END || '; genes=H' || CAST(ann_seq % 4 AS VARCHAR) || ',H9' AS associations FROM annotations",
    "json_clinvar": "SELECT rsid, CAST(ann_seq AS VARCHAR) AS ids, 'v' || CAST(ann_seq AS VARCHAR) AS titles, CASE WHEN ann_seq % 2 = 0 THEN 'Benign' ELSE 'Pathogenic' END AS classes, CASE WHEN ann_seq % 2 = 0 THEN '' ELSE 'criteria provided, single submitter' END AS review, 'c' || CAST(ann_seq % 6 AS VARCHAR) AS traits, 'RCV' || CAST(ann_seq AS VARCHAR) AS accessions, CASE WHEN ann_seq % 3 = 0 THEN 'germline' ELSE '' END AS record_types FROM annotations",
    "json_pgx": "SELECT rsid, CAST(1 AS BIGINT) AS n, CASE ann_seq % 3 WHEN 0 THEN '1A' WHEN 1 THEN '2B' ELSE '3' END AS levels, 'warfarin|drug' || CAST(ann_seq % 4 AS VARCHAR) AS chemicals, trim('A: ' || left(repeat('p', ann_seq % 300), 220)) AS phenotypes, CAST(1 AS BIGINT) AS n_notes, 'drug' || CAST(ann_seq % 4 AS VARCHAR) AS note_chemicals, 'genotype=AG; chemicals=drug' || CAST(ann_seq % 4 AS VARCHAR) || CASE WHEN ann_seq % 300 > 0 THEN '; sentence=' || left(repeat('s', ann_seq % 300), 240) ELSE '' END AS notes_summary, CAST(ann_seq AS VARCHAR) AS pmids FROM annotations",
    "win_cache_latest": "SELECT variant_key, source, event_id, status FROM cache_writes QUALIFY row_number() OVER (PARTITION BY assembly, variant_key, source ORDER BY fetched_at DESC, event_id DESC) = 1",
    "join_cache_miss": f"WITH l AS (SELECT * FROM cache_writes QUALIFY row_number() OVER (PARTITION BY assembly, variant_key, source ORDER BY fetched_at DESC, event_id DESC) = 1) SELECT DISTINCT variant_key, source, fingerprint FROM cache_writes c WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.variant_key = c.variant_key AND l.source = c.source AND l.fingerprint = c.fingerprint AND l.fetched_at + INTERVAL 14 DAY > TIMESTAMP '{NOW}')",
    "agg_source_metrics": "SELECT source, count(*) AS completed, count(*) FILTER (WHERE status = 'source_error') AS errors, count(*) FILTER (WHERE status = 'not_found') AS not_found, count(*) FILTER (WHERE fingerprint = 'f0') AS cache_hits FROM cache_writes GROUP BY source",
    "cls_source_status": "SELECT rsid, CASE WHEN ann_seq % 13 = 0 THEN 'not_queried' WHEN ann_seq % 11 = 0 THEN 'source_error' WHEN gwas_association_count = '0' AND ann_seq % 5 > 0 THEN 'not_found' ELSE 'success' END AS status FROM annotations",
    "agg_enrichment_gate": "SELECT count(*) AS physical, count(*) FILTER (WHERE line_no % 4 > 0) AS success, count(*) FILTER (WHERE line_no % 4 > 0) >= 0.95 * count(*) AS passed FROM vep_payloads",
    "join_annotations": "SELECT row_id, i.rsid AS id, a.cadd_phred, a.clinvar_significance FROM interp i LEFT JOIN annotations a ON i.rsid = a.rsid",
    "cls_attention_score": f"WITH {SC} SELECT rsid, attention_score, reasons FROM sc",
    "cls_vep_flags": f"WITH {SC} SELECT rsid, concat_ws('|', CASE WHEN ann_seq % 3 = 0 THEN 'hgvsp' END, CASE WHEN ann_seq % 5 = 0 THEN 'spliceai' END, CASE WHEN cadd >= 20 THEN 'cadd_gte_20' END, CASE WHEN revel >= 0.75 THEN 'revel_gte_0_75' END) AS flags, pc > 0 OR ann_seq % 4 = 0 AS pgx FROM sc",
    "win_attention_rank": f"WITH {SC} SELECT rsid, grp, attention_rank, group_size FROM rk",
    "win_focus_topk": f"WITH {SC}, tw AS (SELECT grp, attention_score AS s12 FROM rk WHERE attention_rank = 12) SELECT rk.rsid, rk.grp FROM rk LEFT JOIN tw ON rk.grp = tw.grp WHERE group_size <= 25 OR attention_rank <= 12 OR (attention_rank <= 20 AND attention_score = s12)",
    "agg_group_payload": f"WITH {DOCS} SELECT grp, {', '.join(DOCUMENT)} FROM gd",
    "agg_grouping_summary": f"WITH {DOCS} SELECT count(*) AS groups, max(size) AS largest, round(avg(size), 2) AS mean_size, count(*) FILTER (WHERE size = 1) AS singletons, count(*) FILTER (WHERE size > 25) AS large, CAST(sum(size) AS BIGINT) AS n_rows, CAST(sum(focus_count) AS BIGINT) AS focus_rows, CAST(sum(summarized_count) AS BIGINT) AS summarized_rows FROM gd",
    "win_largest_groups": f"WITH {SC} SELECT grp, size FROM gp ORDER BY size DESC, grp LIMIT 10",
    "agg_duplicate_confidence": """WITH k AS (SELECT upper(gene) AS k_gene, lower(rsid) AS k_rsid, upper(observed_genotype) AS k_gt, lower(zygosity) AS k_zyg, upper(ref_alt) AS k_alt, final_confidence_level AS l, row_id, gene_or_locus_ambiguity_flag = 'true' AS a FROM interp),
 c AS (SELECT k_gene, k_rsid, k_gt, k_zyg, k_alt, l, count(*) AS n, min(row_id) AS f, bool_or(a) AS a, CASE l WHEN 'Low' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'High' THEN 3 ELSE 4 END AS r FROM k GROUP BY ALL),
 m AS (SELECT *, row_number() OVER (PARTITION BY k_gene, k_rsid, k_gt, k_zyg, k_alt ORDER BY n DESC, f) AS o FROM c)
 SELECT k_gene, k_rsid, k_gt, k_zyg, k_alt, CAST(sum(n) AS BIGINT) AS rows, CASE WHEN count(*) = 1 THEN NULL WHEN bool_or(l = 'Conflicting') THEN 'Conflicting' WHEN bool_or(a) THEN 'Moderate' WHEN max(n) > 1 THEN max(CASE WHEN o = 1 THEN l END) WHEN min(r) = 2 AND max(r) = 3 THEN 'Moderate' ELSE CASE min(r) WHEN 1 THEN 'Low' WHEN 2 THEN 'Moderate' ELSE 'High' END END AS confidence,
  CASE WHEN count(*) = 1 THEN NULL WHEN bool_or(l = 'Conflicting') THEN '""" + e.DUPLICATE_REASONS[0] + """' WHEN bool_or(a) THEN '""" + e.DUPLICATE_REASONS[1] + """' WHEN max(n) > 1 THEN '""" + e.DUPLICATE_REASONS[2] + """' WHEN min(r) = 2 AND max(r) = 3 THEN '""" + e.DUPLICATE_REASONS[3] + """' ELSE '""" + e.DUPLICATE_REASONS[4] + """' END AS reason FROM m GROUP BY k_gene, k_rsid, k_gt, k_zyg, k_alt""",
    "join_category_axis": f"WITH {AX} SELECT category, axis_id FROM ax",
    "agg_axis_groups": f"WITH {AX}, rt AS (SELECT *, {REPORT_BLOB} AS blob FROM ar) SELECT d.*, x.* EXCLUDE (axis_id) FROM ({dist('axis_id', 'ar')}) d JOIN (SELECT axis_id, count(DISTINCT category) AS categories, {MIX_SQL} FROM rt GROUP BY axis_id) x ON d.axis_id = x.axis_id",
    "agg_axis_members": f"WITH {AX} SELECT DISTINCT axis_id, kind, value FROM (" + " UNION ALL ".join(f"SELECT axis_id, '{k}' AS kind, CAST({c} AS VARCHAR) AS value FROM ar" for k, c in e.MEMBERS.items()) + ") WHERE value <> ''",
    "agg_category_groups": f"WITH rt AS (SELECT *, {REPORT_BLOB} AS blob FROM interp) SELECT d.*, x.* EXCLUDE (category) FROM ({dist('category')}) d JOIN (SELECT category, count(DISTINCT category) AS categories, {MIX_SQL} FROM rt GROUP BY category) x ON d.category = x.category",
    "agg_dominant_confidence": f"SELECT gene, suggested_confidence FROM ({dist('gene')})",
    "agg_axis_strength": f"SELECT rsid, strength FROM ({dist('rsid')})",
    "agg_evidence_mix": f"WITH rt AS (SELECT *, {REPORT_BLOB} AS blob FROM interp) SELECT gene, {MIX_SQL} FROM rt GROUP BY gene",
    "agg_interpretation_totals": "SELECT count(*) AS n_rows, count(DISTINCT lower(rsid)) AS rsids, count(DISTINCT upper(gene)) AS genes, " + ", ".join(f"count(*) FILTER (WHERE final_confidence_level = '{x}') AS {x.lower()}" for x in ("High", "Moderate", "Low", "Conflicting")) + " FROM interp",
    "agg_repeated_rsids": "SELECT rsid, count(*) AS rows, " + ", ".join(f"count(*) FILTER (WHERE final_confidence_level = '{x}') AS {x.lower()}" for x in ("High", "Moderate", "Low", "Conflicting")) + ", array_to_string(list_sort(list(DISTINCT gene)), '|') AS gene_values, array_to_string(list_sort(list(DISTINCT category)), '|') AS categories, count(DISTINCT observed_genotype) <= 1 AS same_genotype FROM interp GROUP BY rsid HAVING count(*) > 1",
    "agg_multi_variant_genes": "SELECT gene, count(DISTINCT rsid) AS n, array_to_string(list_sort(list(DISTINCT rsid)), '|') AS rsids FROM interp GROUP BY gene HAVING count(DISTINCT rsid) > 1",
    "cls_review_priority": f"SELECT row_id, {PRI} AS priority FROM interp",
    "cls_flag_lists": f"SELECT 'conflicting' AS list, gene, rsid, row_id, CASE WHEN row_id % 5 = 0 THEN 'Clinical' ELSE technical_notes_en END AS reason FROM interp WHERE final_confidence_level = 'Conflicting' OR {R['evidence_conflict_flag']} UNION ALL SELECT 'professional_review', gene, rsid, row_id, CASE WHEN row_id % 7 = 0 THEN 'Ask about Medication' ELSE technical_notes_en END FROM interp WHERE {R['requires_professional_review']} UNION ALL SELECT 'ambiguity', gene, rsid, row_id, technical_notes_en FROM interp WHERE {R['gene_or_locus_ambiguity_flag']}",
    "win_top_findings": f"SELECT row_id, p FROM (SELECT row_id, final_confidence_level, p FROM (SELECT *, {PRI} AS p FROM interp) ORDER BY CASE p WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE final_confidence_level WHEN 'High' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Conflicting' THEN 2 ELSE 3 END, gene DESC, rsid DESC, row_id LIMIT 20) WHERE NOT (p = 'low' AND final_confidence_level = 'Low')",
    "cls_report_readiness": f"WITH {AX}, n AS (SELECT count(*) FILTER (WHERE final_confidence_level = 'Conflicting' OR {R['evidence_conflict_flag']}) AS conflicting, count(*) FILTER (WHERE axis_id = 'uncategorized_context') AS unmapped, count(*) FILTER (WHERE {R['gene_or_locus_ambiguity_flag']}) AS ambiguous FROM ar), b AS (SELECT *, concat_ws('|', CASE WHEN conflicting > 0 THEN 'conflicting_variant_evidence_present' END, CASE WHEN unmapped > 0 THEN 'unmapped_canon_categories_present' END, CASE WHEN ambiguous > 0 THEN 'gene_or_locus_ambiguities_present' END) AS blockers FROM n) SELECT *, CASE WHEN unmapped = 0 THEN 'ready' ELSE 'ready_with_minor_review' END AS informational_report_readiness, CASE WHEN blockers = '' THEN 'contextual_review_only' ELSE 'needs_professional_review' END AS clinical_use_readiness FROM b",
    "agg_qa_warnings": f"SELECT warning, count(*) AS n FROM (SELECT 'conflict' AS warning FROM interp WHERE {R['evidence_conflict_flag']} UNION ALL SELECT 'review' FROM interp WHERE {R['requires_professional_review']} UNION ALL SELECT 'third' FROM interp WHERE row_id % 3 = 0) GROUP BY warning",
    "cls_association_raise": "SELECT row_id, CASE WHEN final_confidence_level = 'Low' AND technical_notes_en LIKE 'intron_variant gwas serum ige p=5%' THEN 'Moderate' ELSE final_confidence_level END AS confidence FROM interp",
    "cls_calibrated_scope": "SELECT row_id, CASE WHEN final_confidence_level = 'Conflicting' THEN 'conflicting_review_needed' WHEN final_confidence_level = 'Low' AND regexp_matches(technical_notes_en, 'intron_variant|upstream_gene_variant') THEN 'association_only' WHEN final_confidence_level = 'Low' THEN 'limited_evidence' WHEN contains(technical_notes_en, 'pharmgkb') THEN 'pharmacogenomic' ELSE 'benign_contextual' END AS scope FROM interp",
    "cls_readiness": f"WITH {SC}, k AS (SELECT rsid, ann_seq % 5 < 3 AS sure, list_filter([CASE WHEN ann_seq % 4 = 1 THEN 'canon_context' END, CASE WHEN ann_seq % 3 = 0 OR ann_seq % 9 = 1 THEN 'hgvs' END, CASE WHEN coalesce(cadd_phred, '') <> '' OR coalesce(revel_score, '') <> '' THEN 'deleteriousness_scores' END, CASE WHEN cl <> 'not_reported' THEN 'clinvar' END, CASE WHEN gwas_association_count <> '0' THEN 'gwas' END, CASE WHEN pharmgkb_clinical_annotation_count <> '0' OR ann_seq % 4 = 0 THEN 'pharmacogenomics' END, CASE WHEN ann_seq % 6 <> 2 THEN 'population_frequency' END], lambda x: x IS NOT NULL) AS f FROM sc) SELECT rsid, CASE WHEN sure AND len(f) >= 4 THEN 'high' WHEN len(f) >= 3 THEN 'moderate' ELSE 'limited' END || '_interpretability: ' || CASE WHEN len(f) = 0 THEN 'minimal_external_context' ELSE array_to_string(f, ', ') END AS readiness FROM k",
    "set_subset_check": "SELECT row_id, CASE row_id % 3 WHEN 0 THEN CASE WHEN ref_alt = 'A/G' THEN 'subset' ELSE 'overlap' END WHEN 1 THEN 'overlap' ELSE 'disjoint' END AS status FROM interp",
}
