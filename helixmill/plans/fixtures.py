"""The test projection: variant-call text, genes, curated rows and annotation payloads, derived from the base tables.

Each view is one SELECT that means the same to Spark and to DuckDB. ``view`` gives it as a DataFrame, ``with_views``
puts the ones a query needs in front of it as common table expressions. Spark works out one view, fx_line, in another
way, and another, interp, with a hint, both with the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

#: In order of dependency.
VIEWS = {
    "fx_line": r"""
SELECT (row_number() OVER (PARTITION BY l_suppkey % 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1) * 16
         + l_suppkey % 16 + 1 AS line_no,
       'u' || CAST(l_suppkey % 4 AS STRING) AS upload_id,
       l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_partkey % 25 < 22 THEN CAST(l_partkey % 25 + 1 AS STRING)
            WHEN l_partkey % 25 = 22 THEN 'X' WHEN l_partkey % 25 = 23 THEN 'Y' ELSE 'MT' END AS contig,
       1 + l_partkey * 1000 + (l_orderkey * 7 + l_linenumber * 131) % 1000 AS pos,
       CASE WHEN l_orderkey % 3 = 0 THEN 'rs' || CAST(l_orderkey * 10 + l_linenumber AS STRING) ELSE '.' END AS id,
       CASE l_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'GA' ELSE 'T' END AS ref,
       CASE WHEN l_linenumber % 4 = 0 THEN 'G,TC'
            WHEN l_linenumber % 7 = 6 THEN '<DEL>'
            WHEN l_orderkey % 4 = 1 THEN 'T' WHEN l_orderkey % 4 = 3 THEN 'TA' ELSE 'G' END AS alt,
       CASE WHEN l_linestatus = 'O' THEN 'PASS' WHEN l_linenumber % 3 = 0 THEN '.' ELSE 'LowQual' END AS filter_vcf,
       CASE WHEN l_linenumber % 7 = 6 THEN 'SVTYPE=DEL;END=' || CAST(1 + l_partkey * 1000 + 900 AS STRING)
            WHEN l_orderkey % 11 = 0 THEN 'DB;DP=' || CAST(l_linenumber AS STRING) ELSE '.' END AS info,
       CASE WHEN l_quantity >= 48 THEN './.' WHEN l_quantity <= 2 THEN '0/0'
            WHEN l_quantity = 25 THEN '1' WHEN l_returnflag = 'R' THEN '1/1'
            WHEN l_returnflag = 'A' AND l_linenumber % 4 = 0 THEN '1/2' ELSE '0|1' END AS gt
FROM lineitem""",
    "vcf_lines": r"""
SELECT upload_id, line_no,
       CASE WHEN l_orderkey % 97 = 0 THEN concat_ws(chr(9), contig, CAST(pos AS STRING), id, ref)
            ELSE concat_ws(chr(9),
              CASE WHEN l_partkey % 50 = 7 THEN 'HLA-A*01:01' WHEN l_linenumber % 2 = 0 THEN contig ELSE 'chr' || contig END,
              CAST(pos AS STRING), id, ref, alt, '.', filter_vcf, info, 'DP:GT', '10:' || gt) END AS line
FROM fx_line""",
    "vcf_headers": r"""
SELECT 'u' || CAST(s_suppkey % 4 AS STRING) AS upload_id, s_suppkey * 3 AS line_no,
       CASE WHEN s_suppkey < 4 AND s_suppkey > 0 THEN '##fileformat=VCFv4.' || CAST(s_nationkey % 3 AS STRING)
            WHEN s_suppkey % 7 = 3 AND s_suppkey % 4 = 1 THEN '##reference=file:///' || CASE WHEN s_nationkey % 2 = 0 THEN 'hg19' ELSE 'b37' END || '.fa'
            WHEN s_suppkey % 7 = 3 AND s_suppkey % 4 = 2 THEN '##contig=<ID=' || CASE WHEN s_nationkey % 2 = 0 THEN 'chr1' ELSE '1' END || ',length=248956422>'
            WHEN s_suppkey % 7 = 3 AND s_suppkey % 4 = 0 THEN '##reference=GRCh38'
            ELSE '##source=' || s_name END AS line
FROM supplier
UNION ALL
SELECT h.upload_id, (SELECT max(s_suppkey) FROM supplier) * 3 + 1,
       concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', h.samples)
FROM (SELECT 'u' || CAST(s_suppkey % 4 AS STRING) AS upload_id, min(s_name) || chr(9) || max(s_name) AS samples FROM supplier WHERE s_suppkey % 4 < 3 GROUP BY 1) h""",
    "genes": r"""
SELECT p_partkey AS gene_id, 'G' || CAST(p_partkey AS STRING) AS approved_symbol,
       'chr' || CASE WHEN p_partkey % 25 < 22 THEN CAST(p_partkey % 25 + 1 AS STRING)
                     WHEN p_partkey % 25 = 22 THEN 'X' WHEN p_partkey % 25 = 23 THEN 'Y' ELSE 'M' END AS chrom,
       1 + p_partkey * 1000 AS g_start,
       1 + p_partkey * 1000 + p_size * 15 + CASE WHEN p_partkey % 197 = 5 THEN 2000000 WHEN p_partkey % 97 = 3 THEN 700000 ELSE 0 END AS g_end,
       CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS strand, p_size
FROM part""",
    "transcripts": r"""
SELECT g.gene_id, g.approved_symbol, g.chrom, g.strand, g.p_size,
       'T' || CAST(g.gene_id AS STRING) || '_' || CAST(t.k AS STRING) AS transcript_id,
       g.g_start + (t.k - 1) * g.p_size AS t_start, g.g_start + g.p_size * (11 + t.k) AS t_end,
       CASE (g.gene_id + t.k) % 4 WHEN 2 THEN 'lncRNA' WHEN 3 THEN 'retained_intron' ELSE 'protein_coding' END AS biotype,
       CASE WHEN (g.gene_id + t.k) % 4 = 0 THEN 1 ELSE 0 END AS is_mane_select,
       CASE WHEN (g.gene_id + t.k) % 4 IN (0, 1) THEN g.g_start + g.p_size * 4 END AS cds_start,
       CASE WHEN (g.gene_id + t.k) % 4 IN (0, 1) THEN g.g_start + g.p_size * 10 END AS cds_end
FROM genes g CROSS JOIN (VALUES (1), (2)) AS t(k)""",
    "exons": r"""
SELECT tr.gene_id, tr.transcript_id, e.n AS exon_number,
       tr.t_start + e.n * tr.p_size * 3 - tr.p_size * 2 AS e_start,
       tr.t_start + e.n * tr.p_size * 3 AS e_end
FROM transcripts tr CROSS JOIN (VALUES (1), (2), (3)) AS e(n)""",
    "overlap_meta": r"""
SELECT transcript_id, CASE WHEN is_mane_select = 1 AND gene_id % 3 > 0 THEN 'basic|MANE_Select' WHEN gene_id % 5 = 1 THEN 'basic|MANE_Plus_Clinical' ELSE 'basic' END AS tags,
       CASE WHEN gene_id % 2 = 0 THEN biotype END AS overlap_biotype, CASE WHEN t_start % 4 = 1 THEN 1 ELSE 0 END AS overlap_canonical
FROM transcripts WHERE p_size > 5""",
    "gene_mane": r"""
SELECT gene_id, transcript_id || CASE WHEN gene_id % 2 = 0 THEN '.2' ELSE '' END AS mane_id FROM transcripts WHERE is_mane_select = 1 AND gene_id % 3 = 0""",
    "canon_rows": r"""
SELECT 'canon-row-' || CAST(k.l_partkey AS STRING) || '-' || CAST(k.l_suppkey AS STRING) AS canon_row_id,
       k.l_partkey AS gene_id, 'M' || CAST(k.l_suppkey % 12 AS STRING) AS module_id,
       CASE k.l_suppkey % 6 WHEN 0 THEN 'Sleep & circadian biology' WHEN 1 THEN 'Detox Pathways' WHEN 2 THEN 'Nutrient_absorption & metabolism'
            WHEN 3 THEN 'Immune Function & Autoimmunity' WHEN 4 THEN 'Mitochondria & Energy' ELSE 'Bone density' END AS module_name,
       'Tier ' || CAST(k.l_suppkey % 3 + 1 AS STRING) AS tier,
       CASE WHEN s.s_nationkey % 5 = 0 THEN 'Draft' ELSE 'Approved' END AS module_status,
       CASE k.l_partkey % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS evidence_tier
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1) k
JOIN supplier s ON s.s_suppkey = k.l_suppkey""",
    "annotations": r"""
SELECT id AS rsid, min(line_no) AS ann_seq,
       min(CASE line_no % 8 WHEN 0 THEN 'Conflicting classifications of pathogenicity' WHEN 1 THEN 'Likely pathogenic'
           WHEN 2 THEN 'Uncertain significance' WHEN 3 THEN 'drug response' WHEN 4 THEN 'risk factor' WHEN 5 THEN 'Benign' WHEN 6 THEN 'association' END) AS clinvar_significance,
       min(CASE line_no % 7 WHEN 0 THEN 'practice guideline' WHEN 1 THEN 'reviewed by expert panel' WHEN 2 THEN 'criteria provided, multiple submitters, no conflicts'
           WHEN 3 THEN 'criteria provided, conflicting classifications' WHEN 4 THEN 'criteria provided, single submitter' WHEN 5 THEN 'no assertion criteria provided' END) AS clinvar_review_status,
       min(CAST(line_no % 35 AS STRING)) AS cadd_phred,
       min(CASE WHEN line_no % 3 = 0 THEN '0.80' WHEN line_no % 3 = 1 THEN '0.55' ELSE '' END) AS revel_score,
       min(CAST(line_no % 3 AS STRING)) AS gwas_association_count,
       min(CASE WHEN line_no % 3 = 1 THEN '1.000e-08' WHEN line_no % 3 = 2 THEN '3.000e-05' ELSE '' END) AS gwas_min_pvalue,
       min(CAST(line_no % 2 AS STRING)) AS pharmgkb_clinical_annotation_count,
       min('pop=AFR; allele=G; freq=0.0' || CAST(line_no % 9 + 1 AS STRING) || '|pop=EUR; allele=G; freq=0.00' || CAST(line_no % 7 + 1 AS STRING)) AS populations
FROM fx_line WHERE id <> '.' GROUP BY id""",
    "interp": r"""
SELECT f.line_no AS row_id, 'G' || CAST(f.l_partkey - f.l_partkey % 3 AS STRING) AS gene, 'rs' || CAST(f.l_partkey AS STRING) AS rsid,
       c.module_name AS category, CASE WHEN f.l_linenumber % 2 = 0 THEN 'AG' ELSE 'GG' END AS observed_genotype,
       CASE WHEN f.l_linenumber % 2 = 0 THEN 'heterozygous' ELSE 'homozygous' END AS zygosity, CASE WHEN f.l_suppkey % 2 = 0 THEN 'A/G' ELSE 'C/G' END AS ref_alt,
       CASE WHEN f.l_orderkey % 50 = 0 THEN 'Conflicting' WHEN f.l_orderkey % 3 = 0 THEN 'High' WHEN f.l_orderkey % 3 = 1 THEN 'Moderate' ELSE 'Low' END AS final_confidence_level,
       CASE WHEN f.l_orderkey % 29 = 0 THEN 'true' ELSE 'false' END AS gene_or_locus_ambiguity_flag,
       CASE WHEN f.l_orderkey % 50 = 0 THEN 'true' ELSE 'false' END AS evidence_conflict_flag,
       CASE WHEN f.l_orderkey % 13 = 0 THEN 'true' ELSE 'false' END AS requires_professional_review,
       CASE f.l_orderkey % 4 WHEN 0 THEN 'missense_variant clinvar benign' WHEN 1 THEN 'intron_variant gwas serum ige p=5.000e-26'
            WHEN 2 THEN 'upstream_gene_variant association' ELSE 'pharmgkb drug level 1A' END AS technical_notes_en,
       d.text AS interpretation_one_sentence_en
FROM fx_line f
JOIN (SELECT module_name, row_number() OVER (ORDER BY module_name) AS mn FROM (SELECT DISTINCT module_name FROM canon_rows) q) c ON c.mn = f.l_suppkey % 6 + 1
JOIN (SELECT count(*) AS n FROM documents) nd ON TRUE
JOIN documents d ON d.doc_id = f.line_no % nd.n""",
    "vep_payloads": r"""
SELECT line_no, 'G' || CAST(l_partkey AS STRING) AS target_gene, contig, pos, id, ref, alt,
  '{"input":"' || CAST(line_no AS STRING) || '","variant_class":"SNV","most_severe_consequence":"' || CASE line_no % 3 WHEN 0 THEN 'missense_variant' WHEN 1 THEN 'intron_variant' ELSE 'synonymous_variant' END
  || '","colocated_variants":[' ||
  CASE line_no % 5 WHEN 0 THEN '' WHEN 1 THEN '{"id":"rs' || CAST(line_no AS STRING) || '","allele_string":"' || ref || '/' || alt || '"' || CASE line_no % 7 WHEN 0 THEN '' WHEN 1 THEN ',"seq_region_name":"other","start":' || CAST(pos AS STRING) || ',"end":' || CAST(pos AS STRING) WHEN 2 THEN ',"seq_region_name":"' || contig || '","start":' || CAST(pos + 5000 AS STRING) WHEN 3 THEN ',"start":"unknown"' ELSE ',"seq_region_name":"' || contig || '","start":' || CAST(pos AS STRING) || ',"end":' || CAST(pos + 1 AS STRING) END || '}'
   WHEN 2 THEN '{"id":"RS' || CAST(line_no AS STRING) || '","allele_string":"' || CASE WHEN line_no % 2 = 0 THEN 'C' || alt || '/C' || ref ELSE ref || '/CCC' END || '"' || CASE line_no % 7 WHEN 0 THEN '' WHEN 1 THEN ',"seq_region_name":"other","start":' || CAST(pos AS STRING) || ',"end":' || CAST(pos AS STRING) WHEN 2 THEN ',"seq_region_name":"' || contig || '","start":' || CAST(pos + 5000 AS STRING) WHEN 3 THEN ',"start":"unknown"' ELSE ',"seq_region_name":"' || contig || '","start":' || CAST(pos AS STRING) || ',"end":' || CAST(pos + 1 AS STRING) END || '}'
   WHEN 3 THEN '{"id":"rs' || CAST(line_no AS STRING) || '","allele_string":"' || ref || '/' || alt || '"' || CASE line_no % 7 WHEN 0 THEN '' WHEN 1 THEN ',"seq_region_name":"other","start":' || CAST(pos AS STRING) || ',"end":' || CAST(pos AS STRING) WHEN 2 THEN ',"seq_region_name":"' || contig || '","start":' || CAST(pos + 5000 AS STRING) WHEN 3 THEN ',"start":"unknown"' ELSE ',"seq_region_name":"' || contig || '","start":' || CAST(pos AS STRING) || ',"end":' || CAST(pos + 1 AS STRING) END || '},{"id":"' || CASE WHEN id <> '.' AND line_no % 2 = 0 THEN id ELSE 'rs' || CAST(line_no + 1 AS STRING) END || '","allele_string":"' || ref || '/' || alt || '"' || CASE line_no % 7 WHEN 0 THEN '' WHEN 1 THEN ',"seq_region_name":"other","start":' || CAST(pos AS STRING) || ',"end":' || CAST(pos AS STRING) WHEN 2 THEN ',"seq_region_name":"' || contig || '","start":' || CAST(pos + 5000 AS STRING) WHEN 3 THEN ',"start":"unknown"' ELSE ',"seq_region_name":"' || contig || '","start":' || CAST(pos AS STRING) || ',"end":' || CAST(pos + 1 AS STRING) END || '}'
   ELSE '{"id":"COSV' || CAST(line_no AS STRING) || '","allele_string":"' || ref || '/' || alt || '"' || CASE line_no % 7 WHEN 0 THEN '' WHEN 1 THEN ',"seq_region_name":"other","start":' || CAST(pos AS STRING) || ',"end":' || CAST(pos AS STRING) WHEN 2 THEN ',"seq_region_name":"' || contig || '","start":' || CAST(pos + 5000 AS STRING) WHEN 3 THEN ',"start":"unknown"' ELSE ',"seq_region_name":"' || contig || '","start":' || CAST(pos AS STRING) || ',"end":' || CAST(pos + 1 AS STRING) END || '}' END
  || '],"transcript_consequences":[{"gene_symbol":"OTHER","canonical":1,"transcript_id":"T0","impact":"LOW","biotype":"lncRNA","consequence_terms":["intron_variant"]},{"gene_symbol":"'
  || CASE WHEN line_no % 4 = 0 THEN 'X' ELSE 'G' || CAST(l_partkey AS STRING) END || '","transcript_id":"T' || CAST(l_partkey AS STRING) || '_1"'
  || CASE WHEN line_no % 2 = 0 THEN ',"mane_select":"NM_' || CAST(l_partkey AS STRING) || '.1"' ELSE '' END
  || ',"hgvsc":"c.' || CAST(line_no % 77 AS STRING) || '","exon":"2/5","cdna_start":' || CAST(line_no % 500 AS STRING) || ',"cdna_end":' || CAST(line_no % 500 + 1 AS STRING) || ',"cds_start":' || CAST(line_no % 300 AS STRING) || ',"protein_start":7,"protein_end":9,"amino_acids":"A/V","swissprot":"P' || CAST(line_no % 9 AS STRING) || '","uniparc":"UPI1","domains":[{"db":"Pfam","name":"PF' || CAST(line_no % 5 AS STRING) || '"},{"db":"Gene3D","name":"g"}]'
  || CASE line_no % 3 WHEN 0 THEN ',"sift_prediction":"tolerated","sift_score":0.5' WHEN 1 THEN ',"sift_pred":"D"' ELSE '' END || CASE line_no % 4 WHEN 1 THEN ',"revel":0.7' WHEN 2 THEN ',"revel_score":"0.8","revel":0.1' ELSE '' END || CASE WHEN line_no % 6 = 0 THEN ',"spliceai":{"DS_AG":0.1}' ELSE '' END
  || ',"impact":"MODERATE","biotype":"protein_coding","hgvsp":"p.' || CAST(line_no % 99 AS STRING) || '","cadd_phred":' || CAST(line_no % 35 AS STRING) || ',"consequence_terms":["missense_variant","splice_region_variant"]}]}' AS payload
FROM fx_line WHERE alt NOT LIKE '%,%' AND alt NOT LIKE '<%'""",
    "gwas_payloads": r"""
SELECT rsid, '{"_embedded":{"associations":[{"pvalue":' || CAST(ann_seq % 9 + 1 AS STRING) || 'e-' || CAST(ann_seq % 12 + 3 AS STRING)
  || ',"efoTraits":[{"trait":"t' || CAST(ann_seq % 5 AS STRING) || '"}]},{"pvalueMantissa":' || CAST(ann_seq % 7 + 1 AS STRING) || ',"pvalueExponent":-' || CAST(ann_seq % 10 + 2 AS STRING)
  || ',"efoTraits":[{"trait":"t' || CAST(ann_seq % 3 AS STRING) || '"}],"loci":[{"authorReportedGenes":[{"geneName":"H' || CAST(ann_seq % 4 AS STRING) || '"},{"geneName":"H9"}]}]' || CASE WHEN ann_seq % 2 = 0 THEN ',"betaNum":0.25,"betaDirection":"increase"' ELSE ',"orPerCopyNum":1.5' END || '}]}}' AS payload
FROM annotations""",
    "clinvar_payloads": r"""
SELECT rsid, '{"result":{"items":[{"uid":"' || CAST(ann_seq AS STRING) || '",' || CASE WHEN ann_seq % 2 = 0 THEN '"clinical_significance":"Benign"' ELSE '"germline_classification":{"description":"Pathogenic","review_status":"criteria provided, single submitter"}' END
  || ',"accession":"RCV' || CAST(ann_seq AS STRING) || '","record_type":"' || CASE WHEN ann_seq % 3 = 0 THEN 'germline' ELSE '' END || '","title":"v' || CAST(ann_seq AS STRING) || '","trait_set":[{"trait_name":"c' || CAST(ann_seq % 6 AS STRING) || '"}]}]}}' AS payload
FROM annotations""",
    "pgx_payloads": r"""
SELECT rsid, '{"data":[{"name":"n' || CAST(ann_seq AS STRING) || '","levelOfEvidence":{"term":"' || CASE ann_seq % 3 WHEN 0 THEN '1A' WHEN 1 THEN '2B' ELSE '3' END
  || '"},"relatedChemicals":[{"name":"warfarin"},{"name":"drug' || CAST(ann_seq % 4 AS STRING) || '"}],"allelePhenotypes":[{"allele":"A","phenotype":"' || repeat('p', CAST(ann_seq % 300 AS INT)) || '"}]}]}' AS payload,
  '{"data":[{"alleleGenotype":"AG","sentence":"' || repeat('s', CAST(ann_seq % 300 AS INT)) || '","relatedChemicals":[{"name":"drug' || CAST(ann_seq % 4 AS STRING) || '"}],"literature":{"crossReferences":[{"resource":"PubMed","resourceId":"' || CAST(ann_seq AS STRING) || '"},{"resource":"DOI","resourceId":"x"}]}}]}' AS notes
FROM annotations""",
    "cache_writes": r"""
SELECT 'GRCh38' AS assembly, 'v' || CAST(user_id AS STRING) AS variant_key, event_type AS source, 'f' || CAST(event_id % 3 AS STRING) AS fingerprint,
       CASE WHEN value > 150 THEN 'source_error' WHEN value < 10 THEN 'not_found' ELSE 'success' END AS status, ts AS fetched_at, event_id
FROM events""",
    "symbols_approved": r"""
SELECT 'G' || CAST(p_partkey AS STRING) AS symbol, p_partkey AS gene_id FROM part WHERE p_partkey % 5 <> 0""",
    "symbols_alias": r"""
SELECT 'G' || CAST(p_partkey AS STRING) AS symbol, p_partkey AS gene_id FROM part WHERE p_partkey % 15 = 0
UNION ALL SELECT 'G' || CAST(p_partkey AS STRING), p_partkey + 1 FROM part WHERE p_partkey % 45 = 0""",
    "symbols_prev": r"""
SELECT 'G' || CAST(p_partkey AS STRING) AS symbol, p_partkey AS gene_id FROM part WHERE p_partkey % 15 = 5""",
    "axis_patterns": r"""
SELECT axis_order, axis_id, pattern FROM (VALUES
 (1, 'neurotransmission_neurodevelopment', 'adhd'), (2, 'immune_inflammatory', 'immune'), (2, 'immune_inflammatory', 'autoimmun'),
 (3, 'metabolic_nutrient_methylation', 'metabolic'), (3, 'metabolic_nutrient_methylation', 'nutrient'), (4, 'gut_brain_microbiome', 'gut brain'),
 (5, 'detox_xenobiotic_pharmacogenomics', 'detox'), (6, 'sleep_circadian', 'sleep'), (6, 'sleep_circadian', 'circadian'),
 (7, 'mitochondrial_redox_repair', 'mitochondria'), (7, 'mitochondrial_redox_repair', 'energy')) AS a(axis_order, axis_id, pattern)""",
}

#: Order keys a block of ``dealt_lines`` holds.
BLOCK = 1 << 14


def needed(sql: str) -> list[str]:
    """Views that sql names, with what these need, in order."""
    found: set[str] = set()

    def look(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                look(VIEWS[name])

    look(sql)
    return [name for name in VIEWS if name in found]


def dealt_lines(lineitem: DataFrame) -> DataFrame:
    """fx_line, row for row. Its window has 16 groups, hence 16 tasks for all that follows; here each group is cut into
    blocks of order keys, which lead its order, and a row's number is its place in its block after the blocks before."""
    spark = lineitem.sparkSession
    group, block = "coalesce(l_suppkey % 16, -16)", f"coalesce(l_orderkey div {BLOCK}, {-(1 << 62)})"  # null is a group too, and comes first
    rows = lineitem.withColumns({"_g": F.expr(group), "_b": F.expr(block)})
    before = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("_g", "_b").agg(F.count("*").alias("_n")).select("_g", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = re.compile(r"row_number\(\) OVER \(PARTITION BY l_suppkey % 16 (ORDER BY [^)]*)\)")
    inside = F.expr(f"row_number() OVER (PARTITION BY _g, _b {number.search(VIEWS['fx_line'])[1]})")
    # as many tasks as named: what follows costs more than its few bytes let Spark expect
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_g", "_b")
    dealt.withColumn("_k", inside).join(offsets, ["_g", "_b"]).createOrReplaceTempView("fx_placed")
    return spark.sql(number.sub("(_k + _before)", VIEWS["fx_line"]).replace("FROM lineitem", "FROM fx_placed"))


#: For Spark alone: the six module names go to the lines, which else are dealt by six keys or, if they look small, are
#: broadcast to the one task that numbered the names.
HINTED = {"interp": VIEWS["interp"].replace("SELECT", "SELECT /*+ BROADCAST(c) */", 1)}
#: interp with what names its text in place of the text.
NAMED = HINTED["interp"].replace("d.text AS interpretation_one_sentence_en", "d.doc_id, d.text_hash").replace("JOIN documents d", "JOIN (SELECT doc_id, xxhash64(text) AS text_hash FROM documents) d")
#: Ids should be unique; should one have two texts, the hash tells them apart.
TEXT = ["doc_id", "text_hash"]


def with_views(sql: str, known: tuple[str, ...] = (), forms: dict[str, str] = VIEWS) -> str:
    """sql with its views, but for known ones, as common table expressions; sql may begin with WITH itself."""
    parts = [f"{name} AS ({forms[name]})" for name in needed(sql) if name not in known]
    if not parts:
        return sql
    body = sql.strip()
    more = re.match(r"(?i)WITH\s(RECURSIVE\s)?", body)
    return ("WITH RECURSIVE " if more and more[1] else "WITH ") + ",\n".join(parts) + (",\n" + body[more.end() :] if more else "\n" + body)


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, forms: dict[str, str] = VIEWS | HINTED) -> DataFrame:
    query = f"SELECT * FROM {name}"
    sql = with_views(query)
    for table in BASE:
        if re.search(rf"\b{table}\b", sql):
            base(spark, sf_dir, table).createOrReplaceTempView(table)
    if "fx_line" in needed(query):
        dealt_lines(base(spark, sf_dir, "lineitem")).createOrReplaceTempView("fx_line")
    return spark.sql(with_views(query, ("fx_line",), forms))


def interp_and_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """interp without its texts, and the texts, once each, by the columns in TEXT. A text has many lines, so what is worked
    out of it alone is worked out here, before it meets them."""
    texts = base(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").alias("interpretation_one_sentence_en"))
    return view(spark, sf_dir, "interp", VIEWS | {"interp": NAMED}), texts.dropDuplicates(TEXT)
