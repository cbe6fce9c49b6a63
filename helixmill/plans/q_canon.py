"""Queries over the curated side, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.operators import canon as c
from helixmill.operators import canon_tables
from helixmill.operators.intervals import merge_intervals
from helixmill.plans.fixtures import view
from helixmill.sources import files

C = F.col


def exons(s, d):
    return view(s, d, "exons")


def transcripts(s, d):
    return view(s, d, "transcripts")


def features(s, d):
    return c.build_features(transcripts(s, d), exons(s, d))


def merged(s, d):
    return c.merged_features(files.staged(c.feature_unions(features(s, d), transcripts(s, d))))


def with_strand(s, d):
    return c.number_exons(exons(s, d)).join(transcripts(s, d).select("transcript_id", "strand"), "transcript_id")


def curated(s, d):
    """Curated rows as resolution leaves them: some without a gene, some open, some with several candidates."""
    k = C("gene_id")
    status = F.when(k % 11 == 0, "unresolved_symbol").when(k % 13 == 0, "resolved_multiple_candidates").otherwise("resolved_exact_symbol")
    name = F.when(k % 17 == 0, "GSTM1").when(k % 17 == 1, "GSTT1").otherwise(F.concat(F.lit("G"), k.cast("string")))
    rows = view(s, d, "canon_rows").select("canon_row_id", F.when(k % 7 == 0, "").otherwise(name).alias("symbol"), status.alias("resolution_status"), F.concat(F.lit("About "), name).alias("resolution_notes"), F.when(status == "resolved_exact_symbol", k).alias("gene_id"), name.alias("approved_symbol"))
    return rows


def spread_transcripts(s, d):
    """Every fifth gene has each transcript eleven times."""
    return transcripts(s, d).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(C("gene_id") % 5 == 0, 11).otherwise(1))))


def sheet(s, d):
    """Curated rows as a four-column sheet."""
    k = C("gene_id")
    return view(s, d, "canon_rows").select(C("canon_row_id").alias("row_id"), C("module_name").alias("a"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("G"), k.cast("string"))).alias("b"), F.when(k % 5 == 0, "no id").otherwise(F.concat(F.lit("rs"), (k % 400).cast("string"), F.when(k % 3 == 0, F.concat(F.lit(" RS"), (k % 90).cast("string"))).otherwise(""))).alias("c"), F.when(k % 2 == 0, "effect").otherwise("").alias("d"))


def structured(s, d):
    return c.canon_structure(sheet(s, d))


def symbols(s, d):
    return view(s, d, "canon_rows").select(F.concat(F.lit("G"), C("gene_id").cast("string")).alias("symbol"))


def metadata(s, d):
    rows = structured(s, d)
    dup = c.flag_duplicate_rsids(rows).agg(F.count(F.when(C("reason") == "duplicate_rsid", 1)).alias("repeated"))
    one = rows.agg(F.count("*").alias("n_rows"), F.count(F.when(C("rsids") != "", 1)).alias("with_rsid"), F.count_distinct("gene").alias("genes"), F.count_distinct("category").alias("categories"), F.count(F.when(C("source_group") == "revision_manual", 1)).alias("manual"))
    return one.crossJoin(dup)


def tagged(s, d):
    k = C("gene_id")
    own = transcripts(s, d).select("transcript_id", "gene_id", F.when(k % 3 != 1, C("biotype")).alias("biotype"), F.when(k % 7 == 0, 1).alias("is_canonical"))
    return c.tag_transcripts(own, view(s, d, "overlap_meta").withColumn("tags", F.split("tags", r"\|")), view(s, d, "gene_mane"))


def written(df):
    """df written as a sink does and read back."""
    return files.staged(df)


def tables(s, d):
    """All canon tables, written and read back."""
    path = files.shared_dir(s)
    known = view(s, d, "genes")
    f = files.staged(features(s, d))
    union = c.merged_features(files.staged(c.feature_unions(f, transcripts(s, d))))
    mine = lambda df: df.join(known.select("gene_id"), "gene_id", "left_semi").join(view(s, d, "canon_rows").select("gene_id"), "gene_id", "left_semi")
    canon_tables.write_canon(canon_tables.canon_tables("v1", "GRCh38", view(s, d, "canon_rows"), known, transcripts(s, d), mine(f), mine(union)), path)
    return canon_tables.read_canon_tables(s, path)


QUERIES = {
    "win_exon_number": lambda s, d: c.number_exons(exons(s, d)).select("transcript_id", "e_start", "e_end", C("number").cast("bigint").alias("number")),
    "win_splice_windows": lambda s, d: c.splice_windows(with_strand(s, d)),
    "cls_transcript_tier": lambda s, d: transcripts(s, d).select("transcript_id", c.transcript_tier(C("is_mane_select"), F.when(C("gene_id") % 10 == 3, 1).otherwise(0), F.when(C("gene_id") % 10 == 4, 1).otherwise(0), C("biotype")).alias("tier")),
    "cls_features": features,
    "agg_merge_intervals": lambda s, d: merge_intervals(features(s, d).where("feature_type <> 'transcript_body'"), ["gene_id"]),
    "agg_merged_features": merged,
    "agg_gene_master": lambda s, d: c.gene_master(view(s, d, "genes"), view(s, d, "canon_rows"), transcripts(s, d), merged(s, d)),
    "snk_interval_index": lambda s, d: written(c.export_envelope_index(view(s, d, "genes"))).select("chrom", "block", F.size("genes").cast("bigint").alias("n"), F.array_join(F.transform("genes", lambda g: g["symbol"]), ",").alias("symbols")),
    "snk_feature_index": lambda s, d: written(c.export_feature_index(merged(s, d))).select("gene_id", F.explode("features").alias("merged_feature_type", "v")).select("gene_id", "merged_feature_type", F.array_join(F.transform("v", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("intervals")),
    "cls_canon_structure": structured,
    "agg_rsid_long": lambda s, d: c.rsid_long(structured(s, d)),
    "agg_rsid_master": lambda s, d: c.rsid_master(c.rsid_long(structured(s, d))),
    "agg_rsid_duplicates": lambda s, d: c.flag_duplicate_rsids(structured(s, d)).select("row_id", "first_rsid", "n_same", "source_group", "reason"),
    "agg_exact_duplicates": lambda s, d: c.exact_duplicates(structured(s, d)),
    "agg_canon_metadata": lambda s, d: metadata(s, d).crossJoin(c.module_metadata(view(s, d, "canon_rows").select(F.when(C("gene_id") % 7 == 0, "").otherwise(F.concat(F.lit("G"), C("gene_id").cast("string"))).alias("symbol"), "module_id", "module_status"))),  # one row by one row
    "cls_canon_status": lambda s, d: metadata(s, d).select(c.canon_status(C("n_rows"), C("with_rsid"), C("manual"), C("repeated"), F.lit(4)).alias("status"), c.canon_status(C("n_rows"), F.lit(0), C("manual"), C("repeated"), F.lit(4)).alias("no_ids"), c.canon_status(C("n_rows"), C("with_rsid"), F.lit(0), F.lit(0), F.lit(4)).alias("clean")),
    "cls_canon_warnings": lambda s, d: c.canon_warnings(curated(s, d), spread_transcripts(s, d)),
    "join_symbol_cascade": lambda s, d: c.resolve_symbols(symbols(s, d), view(s, d, "symbols_approved"), view(s, d, "symbols_alias"), view(s, d, "symbols_prev")).select("symbol", "gene_id", "status"),
    "cls_resolution_status": lambda s, d: c.resolve_symbols(symbols(s, d), view(s, d, "symbols_approved"), view(s, d, "symbols_alias"), view(s, d, "symbols_prev")).select("symbol", "resolution"),
    "agg_resolution_counts": lambda s, d: c.resolve_symbols(symbols(s, d), view(s, d, "symbols_approved"), view(s, d, "symbols_alias"), view(s, d, "symbols_prev")).groupBy("resolution").agg(F.count("*").alias("n")),
    "prj_preview": lambda s, d: structured(s, d).orderBy("row_id").limit(200).select("row_id", "gene", "rsids"),
    "snk_canon_tables": lambda s, d: canon_tables.key_report(tables(s, d)),
    "join_transcript_tags": tagged,
    "cls_module_rows": lambda s, d: view(s, d, "canon_rows").select("canon_row_id", F.when(C("gene_id").isNotNull(), "active_gene_row").otherwise("non_gene_module").alias("row_kind"), (F.lower("module_status") == "draft").alias("is_draft"), "module_id", "tier", "evidence_tier"),
}

NUMBERED = "ex AS (SELECT e.gene_id, e.transcript_id, e.e_start, e.e_end, row_number() OVER (PARTITION BY e.transcript_id ORDER BY e_start, e_end) AS number, t.strand, t.cds_start, t.cds_end FROM exons e JOIN transcripts t ON e.transcript_id = t.transcript_id WHERE e_start > 0 AND e_end > 0)"
SPLICE = """sp0 AS (SELECT *, lead(e_start) OVER w AS nx, CAST(number AS VARCHAR) || '->' || CAST(lead(number) OVER w AS VARCHAR) AS label FROM ex WINDOW w AS (PARTITION BY transcript_id ORDER BY number)),
sp1 AS (SELECT *, CASE WHEN strand >= 0 THEN e_end ELSE nx END AS donor, CASE WHEN strand >= 0 THEN nx ELSE e_end END AS acceptor FROM sp0 WHERE nx IS NOT NULL),
sp AS (SELECT gene_id, transcript_id, k AS feature_type, label AS feature_number, CAST(greatest(1, CASE WHEN a THEN acceptor ELSE donor END - 2) AS BIGINT) AS start, CAST(CASE WHEN a THEN acceptor ELSE donor END + 2 AS BIGINT) AS "end" FROM sp1 CROSS JOIN (VALUES ('splice_donor_window', FALSE), ('splice_acceptor_window', TRUE), ('splice_boundary_window', FALSE), ('splice_boundary_window', TRUE)) AS v(k, a))"""
FEATURES = NUMBERED + ", " + SPLICE + """, cd AS (SELECT *, greatest(e_start, least(cds_start, cds_end)) AS a, least(e_end, greatest(cds_start, cds_end)) AS b FROM ex WHERE cds_start IS NOT NULL AND cds_end IS NOT NULL),
cs AS (SELECT *, bool_or(a <= b) OVER (PARTITION BY transcript_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS seen FROM cd),
ut AS (SELECT *, e_start AS s, a - 1 AS e FROM cs WHERE seen AND e_start < a UNION ALL SELECT *, b + 1, e_end FROM cs WHERE seen AND b < e_end UNION ALL SELECT *, e_start, e_end FROM cs WHERE NOT seen),
ft AS (SELECT gene_id, transcript_id, 'transcript_body' AS feature_type, '' AS feature_number, CAST(t_start AS BIGINT) AS start, CAST(t_end AS BIGINT) AS "end" FROM transcripts
 UNION ALL SELECT gene_id, transcript_id, 'exon_interval', CAST(number AS VARCHAR), e_start, e_end FROM ex UNION ALL SELECT gene_id, transcript_id, 'cds_interval', CAST(number AS VARCHAR), a, b FROM cd WHERE a <= b
 UNION ALL SELECT gene_id, transcript_id, CASE WHEN (strand >= 0) = (e < cds_start) THEN 'utr_5_interval' ELSE 'utr_3_interval' END, CAST(number AS VARCHAR), s, e FROM ut WHERE s <= e
 UNION ALL SELECT gene_id, transcript_id, feature_type, feature_number, start, "end" FROM sp)"""


def union_of(source, keys):
    return f"""m1 AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {source}),
m2 AS (SELECT *, sum(CASE WHEN prev IS NULL OR start > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start, "end" RANGE UNBOUNDED PRECEDING) AS i FROM m1),
mm AS (SELECT {keys}, min(start) AS start, max("end") AS "end" FROM m2 GROUP BY {keys}, i)"""


TIER = "CASE WHEN is_mane_select = 1 THEN 'mane_select' WHEN biotype = 'protein_coding' THEN 'protein_coding' WHEN biotype = 'retained_intron' THEN 'retained_intron_low_priority' ELSE 'noncoding_relevant' END"
UNIONS = FEATURES + f""", ty AS (SELECT ft.*, t.biotype, {TIER} AS tier, CASE WHEN is_mane_select = 1 THEN 1 ELSE 0 END AS mane FROM ft JOIN transcripts t ON ft.transcript_id = t.transcript_id),
un AS (SELECT ty.*, u AS merged_feature_type FROM ty CROSS JOIN (VALUES ('transcript_body_union'), ('retained_intron_body_union'), ('mane_exon_union'), ('protein_coding_exon_union'), ('noncoding_exon_union'), ('mane_cds_union'), ('protein_coding_cds_union'), ('utr_union'), ('splice_window_union')) AS v(u)
 WHERE CASE u WHEN 'transcript_body_union' THEN feature_type = 'transcript_body' WHEN 'retained_intron_body_union' THEN feature_type = 'transcript_body' AND biotype = 'retained_intron' WHEN 'mane_exon_union' THEN feature_type = 'exon_interval' AND mane = 1 WHEN 'protein_coding_exon_union' THEN feature_type = 'exon_interval' AND biotype = 'protein_coding' WHEN 'noncoding_exon_union' THEN feature_type = 'exon_interval' AND biotype <> 'protein_coding'
 WHEN 'mane_cds_union' THEN feature_type = 'cds_interval' AND mane = 1 WHEN 'protein_coding_cds_union' THEN feature_type = 'cds_interval' AND biotype = 'protein_coding' WHEN 'utr_union' THEN feature_type LIKE 'utr!_%' ESCAPE '!' ELSE feature_type LIKE 'splice!_%' ESCAPE '!' END), """ + union_of("un", "gene_id, merged_feature_type") + """,
fig AS (SELECT gene_id, merged_feature_type, count(*) AS source_feature_count, count(DISTINCT transcript_id) AS source_transcript_count, array_to_string(list_sort(list(DISTINCT tier)), ' | ') AS transcript_set_scope FROM un GROUP BY gene_id, merged_feature_type),
mf AS (SELECT mm.*, source_feature_count, source_transcript_count, transcript_set_scope FROM mm JOIN fig ON mm.gene_id = fig.gene_id AND mm.merged_feature_type = fig.merged_feature_type)"""
SHEET = """sh AS (SELECT canon_row_id AS row_id, module_name AS category, CASE WHEN gene_id % 7 = 0 THEN '' ELSE 'G' || CAST(gene_id AS VARCHAR) END AS gene,
 CASE WHEN gene_id % 5 = 0 THEN '' ELSE 'rs' || CAST(gene_id % 400 AS VARCHAR) || CASE WHEN gene_id % 3 = 0 AND gene_id % 90 <> gene_id % 400 THEN ',rs' || CAST(gene_id % 90 AS VARCHAR) ELSE '' END END AS rsids,
 CASE WHEN gene_id % 2 = 0 THEN 'effect' WHEN gene_id % 5 = 0 THEN 'no id' WHEN gene_id % 3 = 0 THEN 'rs' || CAST(gene_id % 400 AS VARCHAR) || ' RS' || CAST(gene_id % 90 AS VARCHAR) ELSE '' END AS effect FROM canon_rows),
hi AS (SELECT *, category AS cell FROM sh),
st AS (SELECT row_id, CASE WHEN (rsids <> '' AND gene <> '') OR len(list_filter(%s, lambda h: contains(lower(cell), h) OR contains(h, lower(cell)))) > 0 THEN cell ELSE '' END AS category, gene, rsids, effect FROM hi),
cs2 AS (SELECT *, CASE WHEN rsids <> '' AND category <> '' AND gene <> '' THEN 'df_ok' ELSE 'revision_manual' END AS source_group, CASE WHEN rsids = '' THEN 'no_rsid_detected' WHEN category = '' OR gene = '' THEN 'needs_column_review' ELSE '' END AS reason FROM st)"""
from helixmill.plans.q_text import HINTS  # noqa: E402

SHEET = SHEET.replace("%s", HINTS)
LONG = SHEET + ", lo AS (SELECT row_id, category, gene, source_group, unnest(string_split(rsids, ',')) AS rsid FROM cs2 WHERE rsids <> '')"
DUP = SHEET + ", fr AS (SELECT *, CASE WHEN rsids = '' THEN '' ELSE list_min(string_split(rsids, ',')) END AS first_rsid FROM cs2), fd AS (SELECT *, count(*) OVER (PARTITION BY first_rsid) AS n_same FROM fr)"
TWICE = "source_group = 'df_ok' AND first_rsid <> '' AND n_same > 1"
META = DUP + f", md AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE rsids <> '') AS with_rsid, count(DISTINCT gene) AS genes, count(DISTINCT category) AS categories, count(*) FILTER (WHERE source_group = 'revision_manual') AS manual, count(*) FILTER (WHERE {TWICE}) AS repeated FROM fd)"
CASCADE = """sy AS (SELECT DISTINCT 'G' || CAST(gene_id AS VARCHAR) AS symbol FROM canon_rows),
rs AS (SELECT symbol, (SELECT min(gene_id) FROM symbols_approved a WHERE a.symbol = sy.symbol) AS a, (SELECT min(gene_id) FROM symbols_alias a WHERE a.symbol = sy.symbol) AS l, (SELECT count(DISTINCT gene_id) FROM symbols_alias a WHERE a.symbol = sy.symbol) AS ln, (SELECT min(gene_id) FROM symbols_prev a WHERE a.symbol = sy.symbol) AS p, (SELECT count(DISTINCT gene_id) FROM symbols_prev a WHERE a.symbol = sy.symbol) AS pn FROM sy),
rr AS (SELECT symbol, CASE WHEN a IS NOT NULL THEN a WHEN ln = 1 THEN l WHEN ln = 0 AND pn = 1 THEN p END AS gene_id, CASE WHEN a IS NOT NULL THEN 'resolved' WHEN ln > 1 THEN 'multiple_candidates' WHEN ln = 1 THEN 'resolved' WHEN pn > 1 THEN 'multiple_candidates' WHEN pn = 1 THEN 'resolved' ELSE 'not_found' END AS status,
 CASE WHEN a IS NOT NULL THEN 'resolved_exact_symbol' WHEN ln > 1 THEN 'multiple_candidates' WHEN ln = 1 THEN 'resolved_alias' WHEN pn > 1 THEN 'multiple_candidates' WHEN pn = 1 THEN 'deprecated_symbol' ELSE 'unresolved' END AS resolution FROM rs)"""
HAS = "name || ' has ' || CAST(n AS VARCHAR)"
WARNED = """WITH n0 AS (SELECT canon_row_id, gene_id, CASE WHEN gene_id % 17 = 0 THEN 'GSTM1' WHEN gene_id % 17 = 1 THEN 'GSTT1' ELSE 'G' || CAST(gene_id AS VARCHAR) END AS name, gene_id % 7 = 0 AS bare, CASE WHEN gene_id % 11 = 0 THEN 'unresolved_symbol' WHEN gene_id % 13 = 0 THEN 'multiple_gene_candidates' ELSE '' END AS open FROM canon_rows),
 rw AS (SELECT canon_row_id, CASE WHEN bare THEN 'non_gene_module' ELSE open END AS warning, CASE WHEN bare THEN 'Row ' || canon_row_id || ' has no gene symbol and is kept as a non-gene module.' ELSE 'About ' || name END AS message FROM n0 WHERE bare OR open <> ''),
 tx AS (SELECT gene_id, max(is_mane_select) AS mane, count(*) FILTER (WHERE biotype = 'protein_coding') AS coding, count(*) * CASE WHEN gene_id % 5 = 0 THEN 11 ELSE 1 END AS n FROM transcripts GROUP BY gene_id),
 gn AS (SELECT DISTINCT n0.gene_id, name, coalesce(mane, 0) AS mane, coalesce(coding, 0) AS coding, coalesce(n, 0) AS n FROM n0 LEFT JOIN tx ON tx.gene_id = n0.gene_id WHERE NOT bare AND open = ''),
 gw AS (""" + " UNION ALL ".join(f"SELECT gene_id, '{k}' AS warning, '{v[0]}' AS severity, {HAS if k == 'many_transcripts' else 'name'} || '{v[2]}' AS message, '{v[3]}' AS action FROM gn WHERE {w}" for (k, v), w in zip(c.GENE_WARNINGS.items(), ("mane = 0", "coding = 0", "n > 20", "name IN ('GSTM1', 'GSTT1')"), strict=True)) + """)
 SELECT canon_row_id, CAST(NULL AS BIGINT) AS gene_id, warning, CASE warning WHEN 'non_gene_module' THEN 'info' ELSE 'warning' END AS severity, message, CASE warning WHEN 'non_gene_module' THEN 'No VCF matching will be performed for this row.' ELSE 'Review the gene symbol or curate the canon row.' END AS action FROM rw UNION ALL SELECT NULL, * FROM gw"""
SQL = {
    "win_exon_number": f"WITH {NUMBERED} SELECT transcript_id, e_start, e_end, number FROM ex",
    "win_splice_windows": f"WITH {NUMBERED}, {SPLICE} SELECT * FROM sp",
    "cls_transcript_tier": "SELECT transcript_id, CASE WHEN is_mane_select = 1 THEN 'mane_select' WHEN gene_id % 10 = 3 THEN 'mane_plus_clinical' WHEN gene_id % 10 = 4 THEN 'ensembl_canonical' WHEN biotype = 'protein_coding' THEN 'protein_coding' WHEN biotype = 'retained_intron' THEN 'retained_intron_low_priority' ELSE 'noncoding_relevant' END AS tier FROM transcripts",
    "cls_features": f"WITH {FEATURES} SELECT * FROM ft",
    "agg_merge_intervals": f"WITH {FEATURES}, src AS (SELECT * FROM ft WHERE feature_type <> 'transcript_body'), {union_of('src', 'gene_id')} SELECT * FROM mm",
    "agg_merged_features": f"WITH {UNIONS} SELECT * FROM mf",
    "agg_gene_master": f"""WITH {UNIONS}, r AS (SELECT gene_id, array_to_string(list_sort(list(DISTINCT module_id)), ' | ') AS module_ids, array_to_string(list_sort(list(DISTINCT module_name)), ' | ') AS module_names, array_to_string(list_sort(list(canon_row_id)), ' | ') AS row_ids, count(*) AS n_rows, count(*) FILTER (WHERE module_status = 'Draft') AS n_draft FROM canon_rows GROUP BY gene_id),
 t AS (SELECT gene_id, count(*) AS n_transcripts, max(is_mane_select) AS has_mane FROM transcripts GROUP BY gene_id), m AS (SELECT gene_id, count(*) AS n_merged FROM mf GROUP BY gene_id)
 SELECT g.gene_id, g.approved_symbol, module_ids, module_names, row_ids, n_rows, n_draft, coalesce(n_transcripts, 0) AS n_transcripts, coalesce(has_mane, 0) AS has_mane, coalesce(n_merged, 0) AS n_merged FROM genes g JOIN r ON g.gene_id = r.gene_id LEFT JOIN t ON g.gene_id = t.gene_id LEFT JOIN m ON g.gene_id = m.gene_id""",
    "snk_interval_index": "SELECT chrom, g_start // 1000000 AS block, count(*) AS n, string_agg(approved_symbol, ',' ORDER BY g_start, g_end, approved_symbol) AS symbols FROM genes GROUP BY chrom, g_start // 1000000",
    "snk_feature_index": f"""WITH {UNIONS} SELECT gene_id, merged_feature_type, string_agg(start || '-' || "end", ',' ORDER BY start, "end") AS intervals FROM mf GROUP BY gene_id, merged_feature_type""",
    "cls_module_rows": "SELECT canon_row_id, CASE WHEN gene_id IS NULL THEN 'non_gene_module' ELSE 'active_gene_row' END AS row_kind, lower(module_status) = 'draft' AS is_draft, module_id, tier, evidence_tier FROM canon_rows",
    "join_transcript_tags": """WITH x AS (SELECT t.transcript_id, t.gene_id, CASE WHEN t.gene_id % 3 <> 1 THEN t.biotype ELSE coalesce(o.overlap_biotype, '') END AS biotype, CASE WHEN t.gene_id % 7 = 0 THEN 1 END AS is_canonical,
 contains(coalesce(o.tags, ''), 'MANE_Select') OR t.transcript_id IN (SELECT split_part(mane_id, '.', 1) FROM gene_mane) AS s, contains(coalesce(o.tags, ''), 'MANE_Plus_Clinical') AS p, t.gene_id % 7 = 0 OR coalesce(o.overlap_canonical, 0) = 1 AS k FROM transcripts t LEFT JOIN overlap_meta o ON t.transcript_id = o.transcript_id)
 SELECT transcript_id, gene_id, biotype, is_canonical, CAST(s AS INTEGER) AS is_mane_select, CAST(p AS INTEGER) AS is_mane_plus_clinical, CAST(k AS INTEGER) AS is_ensembl_canonical, CAST(s OR p OR k AS INTEGER) AS is_primary,
 CASE WHEN s THEN 'mane_select' WHEN p THEN 'mane_plus_clinical' WHEN k THEN 'ensembl_canonical' WHEN biotype = 'protein_coding' THEN 'protein_coding' WHEN biotype = 'retained_intron' THEN 'retained_intron_low_priority' ELSE 'noncoding_relevant' END AS inclusion_tier FROM x""",
    "snk_canon_tables": f"""WITH {UNIONS}, cg AS (SELECT DISTINCT gene_id FROM canon_rows), og AS (SELECT g.* FROM genes g SEMI JOIN cg ON g.gene_id = cg.gene_id), tt AS (SELECT t.* FROM transcripts t SEMI JOIN og ON t.gene_id = og.gene_id), fi AS (SELECT ft.* FROM ft SEMI JOIN og ON ft.gene_id = og.gene_id), mi AS (SELECT mf.* FROM mf SEMI JOIN og ON mf.gene_id = og.gene_id),
 w AS (SELECT gene_id, unnest(list_filter([CASE WHEN coalesce(mane, 0) = 0 THEN 'no_mane_select' END, CASE WHEN coalesce(coding, 0) = 0 THEN 'no_protein_coding' END], lambda x: x IS NOT NULL)) AS warning FROM (SELECT cg.gene_id, max(is_mane_select) AS mane, count(*) FILTER (WHERE biotype = 'protein_coding') AS coding FROM cg LEFT JOIN transcripts t ON cg.gene_id = t.gene_id GROUP BY cg.gene_id)),
 gm AS (SELECT gene_id, canon_row_id FROM canon_rows c SEMI JOIN og ON c.gene_id = og.gene_id),
 r(table_name, n, keys, orphans) AS (SELECT 'canon_versions', 1, 1, 0 UNION ALL SELECT 'canon_rows', count(*), count(DISTINCT canon_row_id), 0 FROM canon_rows UNION ALL SELECT 'genes', count(*), count(DISTINCT gene_id), 0 FROM og UNION ALL SELECT 'gene_modules', count(*), count(DISTINCT (gene_id, canon_row_id)), 0 FROM gm
 UNION ALL SELECT 'gene_envelopes', count(*), count(DISTINCT gene_id), 0 FROM og UNION ALL SELECT 'transcripts', count(*), count(DISTINCT transcript_id), 0 FROM tt UNION ALL SELECT 'feature_intervals', count(*), count(DISTINCT (transcript_id, feature_type, feature_number, start, "end")), 0 FROM fi
 UNION ALL SELECT 'merged_feature_intervals', count(*), count(DISTINCT (gene_id, merged_feature_type, start)), 0 FROM mi UNION ALL SELECT 'local_priority_rules', 8, 8, 0 UNION ALL SELECT 'preprocessing_warnings', count(*), count(DISTINCT (gene_id, warning)), 0 FROM w)
 SELECT table_name, CAST(n AS BIGINT) AS n, CAST(keys AS BIGINT) AS keys, CAST(orphans AS BIGINT) AS orphans FROM r""",
    "cls_canon_structure": f"WITH {SHEET} SELECT row_id, category, gene, rsids, effect, source_group, reason FROM cs2",
    "agg_rsid_long": f"WITH {LONG} SELECT * FROM lo",
    "agg_rsid_master": f"WITH {LONG} SELECT rsid, count(*) AS n_source_rows, array_to_string(list_sort(list(row_id)), ',') AS source_rows, array_to_string(list_sort(list(DISTINCT source_group)), ' | ') AS source_tables, coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (WHERE category <> '')), ' | '), '') AS categories, coalesce(array_to_string(list_sort(list(DISTINCT gene) FILTER (WHERE gene <> '')), ' | '), '') AS genes FROM lo GROUP BY rsid",
    "agg_rsid_duplicates": f"WITH {DUP} SELECT row_id, first_rsid, n_same, CASE WHEN {TWICE} THEN 'rsids_repetidos' ELSE source_group END AS source_group, CASE WHEN {TWICE} THEN 'duplicate_rsid' ELSE reason END AS reason FROM fd",
    "agg_exact_duplicates": f"WITH {SHEET} SELECT lower(category) AS category, lower(gene) AS gene, lower(rsids) AS rsids, lower(effect) AS effect, count(*) AS n FROM cs2 GROUP BY ALL HAVING count(*) > 1",
    "agg_canon_metadata": f"WITH {META}, v AS (SELECT count(*) AS rows_total, count(*) FILTER (WHERE gene_id % 7 <> 0) AS rows_with_gene, count(*) FILTER (WHERE gene_id % 7 = 0) AS rows_non_gene_module, count(*) FILTER (WHERE lower(module_status) = 'draft') AS draft_rows, count(DISTINCT module_id) AS module_count, count(DISTINCT gene_id) FILTER (WHERE gene_id % 7 <> 0) AS unique_gene_symbols, (SELECT count(*) FROM (SELECT gene_id FROM canon_rows WHERE gene_id % 7 <> 0 GROUP BY gene_id HAVING count(*) > 1)) AS duplicate_gene_symbols FROM canon_rows) SELECT * FROM md, v",
    "cls_canon_status": f"WITH {META} SELECT CASE WHEN n_rows = 0 OR with_rsid = 0 THEN 'invalid' WHEN manual > 0 OR repeated > 0 THEN 'warning' ELSE 'valid' END AS status, 'invalid' AS no_ids, 'valid' AS clean FROM md",
    "cls_canon_warnings": WARNED,
    "join_symbol_cascade": f"WITH {CASCADE} SELECT symbol, gene_id, status FROM rr",
    "cls_resolution_status": f"WITH {CASCADE} SELECT symbol, resolution FROM rr",
    "agg_resolution_counts": f"WITH {CASCADE} SELECT resolution, count(*) AS n FROM rr GROUP BY resolution",
    "prj_preview": f"WITH {SHEET} SELECT row_id, gene, rsids FROM cs2 ORDER BY row_id LIMIT 200",
}
