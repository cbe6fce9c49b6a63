"""Queries over matching, classes and triage, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixmill.functions import genotype as g
from helixmill.operators import match as m
from helixmill.operators import projections as pr
from helixmill.plans import q_canon, q_vcf
from helixmill.plans.fixtures import view
from helixmill.sources import files, vcf

C = F.col
KEYS = ["upload_id", "line_no", "alt_index"]


def alleles(s, d):
    return vcf.observed_alleles(q_vcf.records(s, d)).select(*KEYS, "id", "contig", "start", "end", "ref", "alt", "allele", "dosage", "gt", "filter", "variant_key")


def envelopes(s, d):
    return m.match_envelopes(alleles(s, d), view(s, d, "genes"))


def classified(s, d):
    return m.classify_features(envelopes(s, d), q_canon.merged(s, d))


def modules(s, d):
    return m.fan_out_modules(classified(s, d), view(s, d, "canon_rows"))


def deliverable_rows(s, d):
    bases = g.gt_alleles(C("gt"), C("ref"), C("alt"))
    return m.review_v2(modules(s, d)).withColumns({"gt_alleles": bases, "genotype_display": g.genotype_display(bases), "zygosity": g.zygosity_alt(C("gt"), C("dosage")), "ref_alt_display": g.ref_alt_display(C("ref"), C("allele"), F.lit(None), F.lit(None)), "gene_envelope_match": F.lit("true"), "has_genotype": (C("gt") != "").cast("string")})


def legacy_rows(s, d):
    """Consolidated rows with what the deliverable shows of them."""
    bases = F.when(C("has_genotype"), g.gt_alleles(C("gt"), C("vcf_ref"), C("vcf_alt")))
    rows = m.review_legacy(consolidated(s, d)).withColumn("confidence", m.confidence_legacy(C("match_status"), C("source_group"), C("zygosity"), C("has_genotype")))
    return rows.withColumns({"gt_alleles": bases, "genotype_display": g.genotype_display(bases), "ref_alt_display": g.ref_alt_display(C("vcf_ref"), C("vcf_alt"), C("exp_ref"), C("exp_alt"))})


def triaged(s, d):
    return m.triage(modules(s, d))


def flagship(s, d):
    """Alleles by region class: the whole way from text lines to classes in one plan."""
    return classified(s, d).groupBy("local_region_class").agg(F.count("*").alias("n"), F.count_distinct("gene_id").alias("genes"))


def ready(s, d, records=None):
    """Identifiers with coordinates and expected alleles, from the annotated records; every third sits elsewhere."""
    r = (q_vcf.records(s, d) if records is None else records).where("id <> '.'")
    return r.select("upload_id", C("id").alias("rsid"), "chrom", F.when(C("line_no") % 3 == 0, F.concat("pos", F.lit("9"))).otherwise(C("pos")).alias("pos"), F.when(C("line_no") % 5 == 0, "").otherwise(C("ref")).alias("exp_ref"), F.when(C("line_no") % 7 == 0, "").when(C("line_no") % 7 == 1, "G").otherwise(C("alt")).alias("exp_alt"), C("line_no").alias("seq"))


def canon_ids(s, d, records=None):
    """Every record's identifier; every seventh has one that is not known."""
    r = q_vcf.records(s, d) if records is None else records
    return r.select("upload_id", C("line_no").alias("row_id"), F.when(C("id") == ".", "").when(C("line_no") % 7 == 3, F.concat("id", F.lit("0"))).otherwise(C("id")).alias("rsid"), F.when(C("line_no") % 4 == 0, "revision_manual").otherwise("df_ok").alias("source_group"))


def consolidated(s, d):
    """All three sides come from the records, which are cut from their lines once."""
    records = files.staged(vcf.with_genotype(q_vcf.records(s, d)).select("upload_id", "line_no", "chrom", "pos", "id", "ref", "alt", "gt"))
    return m.consolidate(canon_ids(s, d, records), ready(s, d, records), records)


#: Bases on both sides of a gene that still count as its target region. The fixture's genes stand close to each other.
FLANK = 97


def regions(s, d):
    """Target regions: all genes."""
    return view(s, d, "genes").select(C("chrom").alias("contig"), C("g_start").alias("start"), C("g_end").alias("end"))


def annotation_folder(s, d):
    """Module rows written by what annotation they need, and read back."""
    path = files.shared_dir(s)
    part = F.when(C("background_only") == "true", "background").when(C("annotation_needed") == "true", "annotation_needed").otherwise("annotation_optional")
    files.write_by_status(modules(s, d).withColumn("part", part), path, "part")
    return s.read.parquet(path)


QUERIES = {
    "join_gene_envelope": lambda s, d: envelopes(s, d).select(*KEYS, "gene_id", "start", "end"),
    "join_region_prefilter": lambda s, d: m.prefilter(alleles(s, d), regions(s, d), FLANK).select(*KEYS, "start"),
    "join_feature_class": lambda s, d: classified(s, d).select(*KEYS, "gene_id", *m.REGION_COLUMNS),
    "cls_local_region": flagship,
    "join_gene_modules": lambda s, d: modules(s, d).select(*KEYS, "gene_id", "canon_row_id", "module_id", "tier"),
    "cls_triage": lambda s, d: triaged(s, d).select(*KEYS, "canon_row_id", "triage_decision", "triage_reason"),
    "agg_triage_summary": lambda s, d: m.triage_summary(triaged(s, d)),
    "set_triage_split": lambda s, d: (lambda t: t.where("triage_decision = 'include_ai'").select(*KEYS, "canon_row_id", F.lit("include").alias("side")).unionByName(t.where("triage_decision <> 'include_ai'").select(*KEYS, "canon_row_id", F.lit("exclude").alias("side"))))(files.staged(triaged(s, d).select(*KEYS, "canon_row_id", "triage_decision"))),
    "snk_annotation_partitions": lambda s, d: annotation_folder(s, d).select(*KEYS, "canon_row_id", "part"),
    "agg_match_summary": lambda s, d: modules(s, d).agg(F.count_distinct(*[C(k) for k in KEYS]).alias("candidates"), F.count("*").alias("n_rows"), F.count_distinct("gene_id").alias("genes"), F.count(F.when(C("background_only") == "true", 1)).alias("background"), F.count(F.when(C("annotation_needed") == "true", 1)).alias("needed"), F.count(F.when(C("annotation_needed") == "optional", 1)).alias("optional")),
    "cls_review_v2": lambda s, d: m.review_v2(modules(s, d)).select(*KEYS, "canon_row_id", "review_status", "notes", "sentence"),
    "flt_minimal_rows": lambda s, d: m.review_v2(modules(s, d)).where("review_status <> 'background_only'").select(*KEYS, "canon_row_id"),
    "agg_physical_variants": lambda s, d: m.physical_variants(modules(s, d).select("upload_id", "variant_key", "line_no", "gene_id", "canon_row_id"), ["line_no", "gene_id", "canon_row_id"]).select("upload_id", "variant_key", "line_no", "canon_row_id", "module_row_count"),
    "flt_observed_rows": lambda s, d: modules(s, d).where((C("gt") != "") & (C("variant_key") != "")).select(*KEYS, "canon_row_id"),
    "win_sequence_ids": lambda s, d: m.numbered(envelopes(s, d), ["upload_id"], ["line_no", "alt_index", "gene_id"], "k").select(*KEYS, "gene_id", F.concat(F.lit("variant-gene-"), F.lpad(C("k").cast("string"), 6, "0")).alias("variant_gene_id")),
    "ord_consolidated": lambda s, d: modules(s, d).orderBy("contig", "start", "approved_symbol", "module_id", *KEYS, "canon_row_id").select(*KEYS, "canon_row_id", "contig", "start"),
    "ord_limit_rows": lambda s, d: modules(s, d).orderBy(*KEYS, "canon_row_id").select(*KEYS, "canon_row_id").limit(100),
    "win_first_wins": lambda s, d: m.first_by(q_vcf.records(s, d).where("id <> '.'").select("upload_id", "chrom", "pos", "line_no"), ["upload_id", "chrom", "pos"], ["line_no"]),
    "win_duplicate_count": lambda s, d: alleles(s, d).withColumn("k", F.row_number().over(W.partitionBy("upload_id", "variant_key").orderBy("line_no", "alt_index"))).groupBy("upload_id").agg(F.count(F.when(C("k") > 1, 1)).alias("n")),
    "join_target_scan": lambda s, d: m.scan_targets(q_vcf.records(s, d), ready(s, d)).select("upload_id", "line_no"),
    "join_canon_consolidated": lambda s, d: consolidated(s, d).select("row_id", "rsid", "line_no", "has_place", "has_vcf", "has_genotype", "ref_status", "alt_status", "match_status"),
    "cls_match_status": lambda s, d: consolidated(s, d).select("row_id", "match_status"),
    "agg_status_counts": lambda s, d: consolidated(s, d).groupBy("match_status", "source_group").agg(F.count("*").alias("n")),
    "join_candidates_back": lambda s, d: m.candidates_joined(q_vcf.records(s, d), ready(s, d)),
    "cls_confidence_legacy": lambda s, d: consolidated(s, d).select("row_id", m.confidence_legacy(C("match_status"), C("source_group"), C("zygosity"), C("has_genotype")).alias("confidence")),
    "cls_review_legacy": lambda s, d: m.review_legacy(consolidated(s, d)).select("row_id", "review_status", "notes", "sentence"),
    "join_rsid_coordinates": lambda s, d: canon_ids(s, d).where("rsid <> ''").join(m.first_by(ready(s, d), ["upload_id", "rsid"], ["seq"]), ["upload_id", "rsid"], "left").select("row_id", "rsid", g.joined_key(":", C("chrom"), C("pos")).alias("match_key_chr_pos"), g.joined_key("|", C("chrom"), C("pos"), C("exp_ref"), C("exp_alt")).alias("match_key_full"), C("pos").isNotNull().alias("has_chr_pos"), ((F.coalesce("exp_ref", F.lit("")) != "") & (F.coalesce("exp_alt", F.lit("")) != "")).alias("has_full_match_fields")),
    "cls_gate_block": lambda s, d: triaged(s, d).agg(F.count(F.when(C("triage_decision") == "include_ai", 1)).alias("included")).select("included", (C("included") == 0).alias("blocked")),
    "cls_deliverable": lambda s, d: pr.project(deliverable_rows(s, d).withColumn("minimal", C("background_only") != "true"), pr.V2_AUDIT, *KEYS, "minimal"),
    "cls_deliverable_legacy": lambda s, d: pr.deliverables(legacy_rows(s, d), "legacy"),
}

ALS = q_vcf.ALL + f""", ob AS MATERIALIZED (SELECT upload_id, line_no, alt_index, id, contig, start, "end", ref, alt, allele, dosage, gt, p, filter, {q_vcf.KEYED} AS variant_key FROM al WHERE dosage > 0 AND contig IN {q_vcf.OK} AND NOT {q_vcf.SYM})"""
ENV = ALS + """, en AS (SELECT ob.*, g.gene_id, g.approved_symbol FROM ob JOIN genes g ON g.chrom = ob.contig AND ob.start <= g.g_end AND ob."end" >= g.g_start)"""
RANKS = ", ".join(f"({k}, '" + "', '".join(r) + "')" for k, r in enumerate(m.REGIONS))
CLS = ENV + ", " + q_canon.UNIONS + f""", rk(rank, {', '.join(m.REGION_COLUMNS)}) AS (VALUES {RANKS}),
be AS (SELECT en.upload_id, en.line_no, en.alt_index, en.gene_id, min(rk.rank) AS rank FROM en JOIN mf ON mf.gene_id = en.gene_id AND en.start <= mf."end" AND en."end" >= mf.start JOIN rk ON rk.overlap_feature_types = mf.merged_feature_type GROUP BY ALL),
cl AS (SELECT en.*, rk.* EXCLUDE (rank) FROM en LEFT JOIN be ON en.upload_id = be.upload_id AND en.line_no = be.line_no AND en.alt_index = be.alt_index AND en.gene_id = be.gene_id JOIN rk ON rk.rank = coalesce(be.rank, 7))"""
MOD = CLS + ", mo AS (SELECT cl.*, c.canon_row_id, c.module_id, c.module_name, c.tier, c.module_status, c.evidence_tier FROM cl JOIN canon_rows c ON c.gene_id = cl.gene_id)"
STRONG = "local_region_class = 'utr_overlap' AND module_status = 'Approved' AND tier IN ('Tier 1', 'Tier 2') AND evidence_tier IN ('High', 'Medium')"
TRI = MOD + f""", tr AS (SELECT *, CASE WHEN annotation_needed = 'true' THEN 'include_ai' WHEN background_only = 'true' THEN 'exclude_background' WHEN module_status = 'Draft' THEN 'exclude_draft_optional' WHEN local_region_class = 'noncoding_exon_overlap' THEN 'exclude_optional_noncoding' WHEN {STRONG} THEN 'include_ai' WHEN annotation_needed = 'optional' AND local_region_class = 'utr_overlap' THEN 'exclude_utr_weak' ELSE 'exclude_optional_noncoding' END AS triage_decision,
 CASE WHEN annotation_needed = 'true' THEN 'Included for AI: strong region class ' || local_region_class || '.' WHEN background_only = 'true' THEN 'Excluded from AI: background-only ' || local_region_class || '.' WHEN module_status = 'Draft' THEN 'Excluded from AI: Draft optional ' || local_region_class || '.' WHEN local_region_class = 'noncoding_exon_overlap' THEN 'Excluded from AI: optional noncoding exon overlap.' WHEN {STRONG} THEN 'Included for AI: strong UTR in Approved Tier 1/2 module with Medium/High evidence.' ELSE 'Excluded from AI: UTR did not meet Approved Tier 1/2 and Medium/High evidence gate.' END AS triage_reason FROM mo)"""
K = "upload_id, line_no, alt_index"
REG = """re AS (SELECT chrom AS contig, g_start AS start, g_end AS "end" FROM genes)"""
RDY = "rd AS MATERIALIZED (SELECT upload_id, id AS rsid, chrom, CASE WHEN line_no % 3 = 0 THEN pos || '9' ELSE pos END AS pos, CASE WHEN line_no % 5 = 0 THEN '' ELSE ref END AS exp_ref, CASE line_no % 7 WHEN 0 THEN '' WHEN 1 THEN 'G' ELSE alt END AS exp_alt, line_no AS seq FROM rec WHERE id <> '.')"
CON = q_vcf.CALL + ", " + RDY + f""", ci AS (SELECT upload_id, line_no AS row_id, CASE WHEN id = '.' THEN '' WHEN line_no % 7 = 3 THEN id || '0' ELSE id END AS rsid, CASE WHEN line_no % 4 = 0 THEN 'revision_manual' ELSE 'df_ok' END AS source_group FROM rec),
r1 AS (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY upload_id, rsid ORDER BY seq) = 1), v1 AS (SELECT * FROM call QUALIFY row_number() OVER (PARTITION BY upload_id, chrom, pos ORDER BY line_no) = 1),
c1 AS (SELECT ci.*, r1.chrom, r1.pos, exp_ref, exp_alt, v1.ref AS vcf_ref, v1.alt AS vcf_alt, v1.gt, v1.p, v1.line_no, r1.pos IS NOT NULL AS has_place, v1.line_no IS NOT NULL AS has_vcf, coalesce(v1.gt, '') <> '' AS has_genotype FROM ci LEFT JOIN r1 ON ci.upload_id = r1.upload_id AND ci.rsid = r1.rsid LEFT JOIN v1 ON ci.upload_id = v1.upload_id AND r1.chrom = v1.chrom AND r1.pos = v1.pos),
c2 AS (SELECT *, CASE WHEN coalesce(exp_ref, '') = '' THEN 'missing_expected_ref' WHEN coalesce(vcf_ref, '') = '' THEN 'missing_vcf_ref' WHEN exp_ref = vcf_ref THEN 'ref_match' ELSE 'ref_mismatch' END AS ref_status, {q_vcf.alt_status("coalesce(exp_alt, '')", "coalesce(vcf_alt, '')")} AS alt_status, CASE WHEN gt IS NULL OR {q_vcf.PART} THEN 'unknown' WHEN len(p) <> 2 THEN 'non_diploid_or_complex' WHEN p[1] = p[2] THEN 'homozygous' ELSE 'heterozygous' END AS zygosity FROM c1),
co AS (SELECT *, CASE WHEN rsid = '' THEN 'no_rsid_detected' WHEN NOT has_place THEN 'rsid_without_coordinates' WHEN NOT has_vcf THEN 'no_vcf_match_by_chr_pos' WHEN ref_status = 'ref_match' AND alt_status = 'alt_exact_match' THEN 'match_strict' WHEN ref_status = 'ref_match' AND alt_status IN ('alt_partial_overlap', 'missing_expected_alt') THEN 'match_likely_needs_alt_review' ELSE 'match_by_position_needs_review' END AS match_status FROM c2)"""
REVIEW = "CASE WHEN background_only = 'true' THEN 'background_only' WHEN annotation_needed = 'true' THEN 'ready_for_annotation' WHEN annotation_needed = 'optional' THEN 'optional_annotation' ELSE 'local_review_only' END"
NOTES = "concat_ws(' ', CASE WHEN lower(module_status) = 'draft' THEN 'Draft module included with explicit flag.' END, 'Matched via ' || overlap_feature_types || '.', CASE WHEN background_only = 'true' THEN 'Kept for audit but classified as background-only.' END)"
LEGACY_CONFIDENCE = "SELECT row_id, CASE WHEN match_status = 'match_strict' AND has_genotype THEN CASE WHEN source_group = 'revision_manual' OR zygosity = 'non_diploid_or_complex' THEN 'Moderate' ELSE 'High' END WHEN match_status = 'match_likely_needs_alt_review' AND has_genotype THEN 'Moderate' ELSE 'Low' END AS confidence FROM co"
LEGACY_REVIEW = "SELECT row_id, CASE match_status WHEN 'match_strict' THEN CASE WHEN source_group = 'revision_manual' THEN 'ready_but_manual_row_review' ELSE 'ready_for_interpretation' END WHEN 'match_likely_needs_alt_review' THEN 'interpretable_with_alt_review' WHEN 'no_vcf_match_by_chr_pos' THEN 'no_variant_observed_in_vcf_at_locus' WHEN 'rsid_without_coordinates' THEN 'technical_resolution_pending' WHEN 'no_rsid_detected' THEN 'missing_rsid' ELSE 'review_needed' END AS review_status, CASE WHEN source_group = 'revision_manual' THEN 'Original sheet row needs manual structural review.' WHEN match_status = 'match_likely_needs_alt_review' THEN 'Position-level match found; ALT representation should be reviewed before final biological interpretation.' WHEN match_status = 'no_vcf_match_by_chr_pos' THEN 'Queried locus was not observed in the current VCF by CHROM+POS.' WHEN match_status = 'no_rsid_detected' THEN 'No usable rsID detected in the original row.' ELSE '' END AS notes, CASE WHEN has_genotype THEN 'Observed genotype at ' || CASE WHEN rsid = '' THEN 'this locus' ELSE rsid END || '; functional interpretation pending review.' ELSE 'No genotype was observed at this queried locus in the current VCF; no genotype-specific interpretation assigned.' END AS sentence FROM co"
FIGURES = {"rows_total": "TRUE", "rows_with_genotype": "gt <> ''", "included_for_ai": "triage_decision = 'include_ai'", "excluded_background": "triage_decision = 'exclude_background'", "excluded_utr_weak": "triage_decision = 'exclude_utr_weak'", "excluded_optional_noncoding": "triage_decision = 'exclude_optional_noncoding'", "excluded_draft_optional": "triage_decision = 'exclude_draft_optional'", "included_strong_region": "triage_decision = 'include_ai' AND annotation_needed = 'true'", "included_strong_utr": "triage_decision = 'include_ai' AND local_region_class = 'utr_overlap'"}
SHOWN = "CASE WHEN trim(bases) = '' THEN 'NA' WHEN len(list_filter(string_split(bases, '/'), lambda x: length(x) <> 1)) = 0 THEN replace(bases, '/', '') ELSE bases END"
ZYG_ALT = f"CASE WHEN {q_vcf.PART} THEN 'unknown' WHEN len(p) <> 2 THEN 'non_diploid_or_complex' WHEN dosage = 2 THEN 'homozygous' WHEN dosage = 1 THEN 'heterozygous' ELSE 'reference_only' END"
SENTENCE = "'Observed variant in ' || approved_symbol || '; local classification is ' || local_region_class || CASE WHEN background_only = 'true' THEN ' and currently background-only.' ELSE ' and may require downstream annotation.' END"
V2_SQL = ["approved_symbol", "module_id", "module_name", "''", SHOWN, ZYG_ALT, "ref || '/' || allele", "local_region_class", "local_feature_priority", SENTENCE, "evidence_tier", "module_status", "'false'", "annotation_needed", "background_only", REVIEW, NOTES, "CAST(gene_id AS VARCHAR)", "canon_row_id", "CAST(start AS VARCHAR)", 'CAST("end" AS VARCHAR)', "contig", "CAST(start AS VARCHAR)", "id", "gt", "trim(bases)", "'true'", "overlap_feature_types", "CASE WHEN gt <> '' THEN 'true' ELSE 'false' END"]
PAIR = "CASE WHEN coalesce(vcf_ref, '') <> '' AND coalesce(vcf_alt, '') <> '' THEN vcf_ref || '/' || vcf_alt WHEN coalesce(exp_ref, '') <> '' AND coalesce(exp_alt, '') <> '' THEN exp_ref || '/' || exp_alt ELSE 'NA' END"
LEGACY_SQL = ["''", "rsid", SHOWN, "zygosity", PAIR, "''", "sentence", "confidence", "''", "review_status", "notes", "CAST(row_id AS VARCHAR)", "source_group", "match_status", "bases", "coalesce(gt, '')", "coalesce(exp_ref, '')", "coalesce(exp_alt, '')", "coalesce(vcf_ref, '')", "coalesce(vcf_alt, '')", "CASE WHEN has_genotype THEN 'true' ELSE 'false' END", "CASE WHEN has_vcf THEN 'true' ELSE 'false' END"]
SQL = {
    "join_gene_envelope": f'WITH {ENV} SELECT {K}, gene_id, start, "end" FROM en',
    "join_region_prefilter": f'WITH {ALS}, {REG} SELECT DISTINCT {K}, ob.start FROM ob JOIN (SELECT *, unnest(range((start - {FLANK}) // 10000, ("end" + {FLANK}) // 10000 + 1)) AS bin FROM re) re ON re.contig = ob.contig AND ob.start // 10000 = re.bin AND ob.start BETWEEN re.start - {FLANK} AND re."end" + {FLANK}',
    "join_feature_class": f"WITH {CLS} SELECT {K}, gene_id, {', '.join(m.REGION_COLUMNS)} FROM cl",
    "cls_local_region": f"WITH {CLS} SELECT local_region_class, count(*) AS n, count(DISTINCT gene_id) AS genes FROM cl GROUP BY local_region_class",
    "join_gene_modules": f"WITH {MOD} SELECT {K}, gene_id, canon_row_id, module_id, tier FROM mo",
    "cls_triage": f"WITH {TRI} SELECT {K}, canon_row_id, triage_decision, triage_reason FROM tr",
    "agg_triage_summary": f"WITH {TRI} SELECT dimension, value, count(*) AS n, count(*) FILTER (WHERE triage_decision = 'include_ai') AS included FROM (" + " UNION ALL ".join([*(f"SELECT '{x}' AS dimension, {x} AS value, triage_decision FROM tr" for x in ("triage_decision", "local_region_class", "module_status", "tier", "evidence_tier")), "SELECT 'include_reason', triage_reason, triage_decision FROM tr WHERE triage_decision = 'include_ai'", *(f"SELECT 'count', '{k}', triage_decision FROM tr WHERE {v}" for k, v in FIGURES.items())]) + ") WHERE value <> '' GROUP BY dimension, value",
    "set_triage_split": f"WITH {TRI} SELECT {K}, canon_row_id, CASE WHEN triage_decision = 'include_ai' THEN 'include' ELSE 'exclude' END AS side FROM tr",
    "snk_annotation_partitions": f"WITH {MOD} SELECT {K}, canon_row_id, CASE WHEN background_only = 'true' THEN 'background' WHEN annotation_needed = 'true' THEN 'annotation_needed' ELSE 'annotation_optional' END AS part FROM mo",
    "agg_match_summary": f"WITH {MOD} SELECT count(DISTINCT ({K})) AS candidates, count(*) AS n_rows, count(DISTINCT gene_id) AS genes, count(*) FILTER (WHERE background_only = 'true') AS background, count(*) FILTER (WHERE annotation_needed = 'true') AS needed, count(*) FILTER (WHERE annotation_needed = 'optional') AS optional FROM mo",
    "cls_review_v2": f"WITH {MOD} SELECT {K}, canon_row_id, {REVIEW} AS review_status, {NOTES} AS notes, 'Observed variant in ' || approved_symbol || '; local classification is ' || local_region_class || CASE WHEN background_only = 'true' THEN ' and currently background-only.' ELSE ' and may require downstream annotation.' END AS sentence FROM mo",
    "flt_minimal_rows": f"WITH {MOD} SELECT {K}, canon_row_id FROM mo WHERE background_only <> 'true'",
    "agg_physical_variants": f"WITH {MOD} SELECT upload_id, variant_key, line_no, canon_row_id, module_row_count FROM (SELECT *, count(*) OVER (PARTITION BY upload_id, variant_key) AS module_row_count, row_number() OVER (PARTITION BY upload_id, variant_key ORDER BY line_no, gene_id, canon_row_id) AS k FROM mo) WHERE k = 1",
    "flt_observed_rows": f"WITH {MOD} SELECT {K}, canon_row_id FROM mo",
    "win_sequence_ids": f"WITH {ENV} SELECT {K}, gene_id, 'variant-gene-' || lpad(CAST(row_number() OVER (PARTITION BY upload_id ORDER BY line_no, alt_index, gene_id) AS VARCHAR), 6, '0') AS variant_gene_id FROM en",
    "ord_consolidated": f"WITH {MOD} SELECT {K}, canon_row_id, contig, start FROM mo ORDER BY contig, start, approved_symbol, module_id, {K}, canon_row_id",
    "ord_limit_rows": f"WITH {MOD} SELECT {K}, canon_row_id FROM mo ORDER BY {K}, canon_row_id LIMIT 100",
    "win_first_wins": f"WITH {q_vcf.REC} SELECT upload_id, chrom, pos, min(line_no) AS line_no FROM rec WHERE id <> '.' GROUP BY upload_id, chrom, pos",
    "win_duplicate_count": f"WITH {ALS} SELECT upload_id, count(*) - count(DISTINCT variant_key) AS n FROM ob GROUP BY upload_id",
    "join_target_scan": f"WITH {q_vcf.REC}, {RDY} SELECT upload_id, line_no FROM rec SEMI JOIN rd ON rec.upload_id = rd.upload_id AND rec.chrom = rd.chrom AND rec.pos = rd.pos",
    "join_canon_consolidated": f"WITH {CON} SELECT row_id, rsid, line_no, has_place, has_vcf, has_genotype, ref_status, alt_status, match_status FROM co",
    "cls_match_status": f"WITH {CON} SELECT row_id, match_status FROM co",
    "agg_status_counts": f"WITH {CON} SELECT match_status, source_group, count(*) AS n FROM co GROUP BY ALL",
    "join_candidates_back": f"WITH {q_vcf.REC}, {RDY}, h AS (SELECT rec.upload_id, rec.line_no, rd.rsid, rd.exp_ref, rd.seq FROM rec JOIN rd ON rec.upload_id = rd.upload_id AND rec.chrom = rd.chrom AND rec.pos = rd.pos), f AS (SELECT upload_id, line_no, rsid, min(seq) AS s FROM h GROUP BY ALL) SELECT a.*, b.n_source_rows, b.exp_ref FROM (SELECT upload_id, line_no, string_agg(rsid, '|' ORDER BY s) AS rsids FROM f GROUP BY ALL) a JOIN (SELECT upload_id, line_no, count(*) AS n_source_rows, arg_min(exp_ref, seq) AS exp_ref FROM h GROUP BY ALL) b ON a.upload_id = b.upload_id AND a.line_no = b.line_no",
    "cls_confidence_legacy": f"WITH {CON} {LEGACY_CONFIDENCE}",
    "cls_review_legacy": f"WITH {CON} {LEGACY_REVIEW}",
    "join_rsid_coordinates": f"WITH {CON} SELECT row_id, ci.rsid, CASE WHEN pos IS NULL THEN '' ELSE chrom || ':' || pos END AS match_key_chr_pos, CASE WHEN pos IS NULL OR exp_ref = '' OR exp_alt = '' THEN '' ELSE chrom || '|' || pos || '|' || exp_ref || '|' || exp_alt END AS match_key_full, pos IS NOT NULL AS has_chr_pos, coalesce(exp_ref, '') <> '' AND coalesce(exp_alt, '') <> '' AS has_full_match_fields FROM ci LEFT JOIN r1 ON ci.upload_id = r1.upload_id AND ci.rsid = r1.rsid WHERE ci.rsid <> ''",
    "cls_gate_block": f"WITH {TRI} SELECT count(*) FILTER (WHERE triage_decision = 'include_ai') AS included, count(*) FILTER (WHERE triage_decision = 'include_ai') = 0 AS blocked FROM tr",
    "cls_deliverable": f"WITH {MOD}, x AS (SELECT *, {q_vcf.BASES} AS bases FROM mo) SELECT {K}, background_only <> 'true' AS minimal, " + ", ".join(f'{v} AS "{f.name}"' for f, v in zip(pr.V2_AUDIT, V2_SQL, strict=True)) + " FROM x",
    "cls_deliverable_legacy": f"WITH {CON}, y AS (SELECT co.*, CASE WHEN has_genotype THEN {q_vcf.BASES.replace('[ref]', '[vcf_ref]').replace('(alt,', '(vcf_alt,')} ELSE '' END AS bases, r.review_status, r.notes, r.sentence, f.confidence FROM co JOIN ({LEGACY_REVIEW}) r ON r.row_id = co.row_id JOIN ({LEGACY_CONFIDENCE}) f ON f.row_id = co.row_id) SELECT TRUE AS minimal, " + ", ".join(f'{v} AS "{f.name}"' for f, v in zip(pr.LEGACY_AUDIT, LEGACY_SQL, strict=True)) + " FROM y",
}
