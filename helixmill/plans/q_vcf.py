"""Queries over records, headers and genotype functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions import genotype as g
from helixmill.plans.fixtures import view
from helixmill.sources import vcf

C = F.col
KEY = ("upload_id", "line_no")


def lines(spark, d):
    return view(spark, d, "vcf_lines")


def records(spark, d):
    return vcf.parse_records(lines(spark, d))


def called(spark, d):
    return vcf.with_genotype(records(spark, d))


def alleles(spark, d):
    return vcf.explode_alleles(records(spark, d))


def on(source, columns):
    """Query that adds columns to the key of source's rows. columns() names them once there is a session."""
    return lambda spark, d: source(spark, d).select(*[c for c in (*KEY, "alt_index") if c in KEY or source is alleles], *[c.alias(n) for n, c in columns().items()])


def header_lines(spark, d):
    return view(spark, d, "vcf_headers")


def all_lines(spark, d):
    """Header lines before data lines."""
    return header_lines(spark, d).withColumn("line_no", C("line_no") - F.lit(1 << 40)).unionByName(lines(spark, d))


def uploads(spark, d):
    return vcf.detect_assembly(header_lines(spark, d)).withColumn("selected", F.when(C("upload_id") == "u3", "").when(C("upload_id") == "u2", "GRCh37").otherwise(C("assembly")))


QUERIES = {
    "src_vcf_records": lambda s, d: records(s, d),
    "src_vcf_headers": lambda s, d: vcf.parse_headers(header_lines(s, d)),
    "flt_supported_contig": on(records, lambda: dict(contig=g.norm_chrom(C("chrom")), supported=g.is_supported_contig(C("chrom")))),
    "flt_symbolic_alt": on(alleles, lambda: dict(allele=C("allele"), symbolic=g.is_symbolic(C("allele")))),
    "flt_observed_alleles": lambda s, d: alleles(s, d).where("dosage > 0").select(*KEY, "alt_index", "allele", "dosage"),
    "fn_norm_chrom": on(records, lambda: dict(chrom=C("chrom"), norm=g.norm_chrom(C("chrom")))),
    "fn_norm_chrom_legacy": on(records, lambda: dict(chrom=C("chrom"), norm=g.norm_chrom_legacy(C("chrom")))),
    "fn_extract_gt": on(called, lambda: dict(gt=C("gt"))),
    "fn_split_gt": on(called, lambda: dict(parts=F.array_join(g.split_gt(C("gt")), ","), n=F.size(g.split_gt(C("gt"))).cast("bigint"))),
    "fn_classify_gt": on(called, lambda: dict(gt_class=g.classify_gt(C("gt")))),
    "fn_zygosity": on(called, lambda: dict(zygosity=g.zygosity(C("gt")))),
    "fn_zygosity_alt": on(alleles, lambda: dict(zygosity=g.zygosity_alt(C("gt"), C("dosage")))),
    "fn_dosage": on(alleles, lambda: dict(dosage=C("dosage").cast("bigint"))),
    "fn_gt_alleles": on(called, lambda: dict(alleles=g.gt_alleles(C("gt"), C("ref"), C("alt")))),
    "fn_explode_alleles": on(alleles, lambda: dict(allele=C("allele"), start=C("start"))),
    "fn_variant_key": on(alleles, lambda: dict(variant_key=g.variant_key(F.lit("GRCh38"), C("contig"), C("start"), C("ref"), C("allele")))),
    "fn_parse_info": on(records, lambda: dict(end=F.try_element_at(g.parse_info(C("info")), F.lit("END")), svtype=F.try_element_at(g.parse_info(C("info")), F.lit("SVTYPE")), db=F.try_element_at(g.parse_info(C("info")), F.lit("DB")), n=F.size(g.parse_info(C("info"))).cast("bigint"))),
    "fn_variant_interval": on(alleles, lambda: dict(start=C("start"), end=C("end"), warning=g.interval_warning(C("info"), C("allele")))),
    "fn_overlap": on(alleles, lambda: dict(hit=g.overlaps(C("start"), C("end"), F.lit(1001), F.lit(150000)))),
    "fn_parse_orig": lambda s, d: alleles(s, d).withColumn("note", F.when(C("line_no") % 2 == 0, F.concat(F.lit("ORIG="), C("contig"), F.lit("|"), (C("start") - 1).cast("string"), F.lit("|"), C("ref"), F.lit("|"), C("allele"), F.when(C("line_no") % 4 == 0, F.concat(F.lit("|"), C("alt_index").cast("string"))).otherwise(""))).when(C("line_no") % 3 == 0, "ORIG=chr1|5").otherwise(C("info"))).select(*KEY, "alt_index", g.orig_part(C("note"), 0, C("contig")).alias("source_chrom"), g.orig_part(C("note"), 1, C("start").cast("string")).alias("source_pos"), g.orig_part(C("note"), 2, C("ref")).alias("source_ref"), g.orig_part(C("note"), 3, C("allele")).alias("source_alt"), g.orig_part(C("note"), 4, F.lit("1")).alias("source_index"), g.orig_part(C("note"), 4, F.lit("")).alias("source_index_plain")),
    "fn_quality_flag": on(records, lambda: dict(flag=g.quality_flag(C("filter")))),
    "fn_is_snv": on(records, lambda: dict(snv=g.is_snv(C("ref"), C("alt")))),
    "fn_compare_ref": on(records, lambda: dict(status=g.compare_ref(F.when(C("line_no") % 3 == 0, "").when(C("line_no") % 3 == 1, "a").otherwise("GA"), F.when(C("line_no") % 7 == 0, "").otherwise(C("ref"))))),
    "fn_compare_alt": on(records, lambda: dict(status=g.compare_alt(F.when(C("line_no") % 4 == 0, "").when(C("line_no") % 4 == 1, "TC,G").when(C("line_no") % 4 == 2, "g, A").otherwise("T"), F.when(C("line_no") % 7 == 0, "").otherwise(C("alt"))))),
    "set_allele_compare": on(records, lambda: dict(same=(F.size(F.array_except(g.allele_set(C("alt")), g.allele_set(F.lit("TC,G")))) == 0) & (F.size(F.array_except(g.allele_set(F.lit("TC,G")), g.allele_set(C("alt")))) == 0), shared=F.array_join(F.array_sort(F.array_intersect(g.allele_set(C("alt")), g.allele_set(F.lit("TC,G")))), ","))),
    "fn_match_keys": on(records, lambda: dict(key_pos=g.joined_key(":", C("chrom"), C("pos")), key_full=g.joined_key("|", C("chrom"), C("pos"), C("ref"), F.when(C("line_no") % 5 == 0, "").otherwise(C("alt"))))),
    "fn_rsids": on(records, lambda: dict(rsids=F.array_join(g.extract_rsids(F.concat(C("id"), F.lit(" RS5, xrs7 rs12;"), C("id"))), ","), first=g.first_rsid(F.concat(C("id"), F.lit(" rs12"))), whole=g.normalize_rsid(F.upper("id")))),
    "fn_allele_signature": lambda s, d: alleles(s, d).withColumn("sig", g.allele_signature(F.concat(F.lit("CA"), C("ref"), F.lit("T")), F.concat(F.lit("CA"), C("allele"), F.lit("GT")))).select(*KEY, "alt_index", C("sig.ref").alias("ref"), C("sig.alt").alias("alt"), C("sig.prefix").cast("bigint").alias("prefix")),
    "fn_exact_allele": on(alleles, lambda: dict(exact=g.exact_allele(F.lit("a/G|T,TA"), C("ref"), C("allele")))),
    "fn_observed_alts": on(called, lambda: dict(alts=g.observed_alts(g.gt_alleles(C("gt"), C("ref"), C("alt")), C("ref")))),
    "fn_genotype_display": on(called, lambda: dict(shown=g.genotype_display(g.gt_alleles(C("gt"), C("ref"), C("alt"))))),
    "fn_ref_alt_display": on(records, lambda: dict(shown=g.ref_alt_display(F.when(C("line_no") % 2 == 0, C("ref")), C("alt"), F.when(C("line_no") % 3 == 0, F.lit("N")), F.lit("M")))),
    "fn_variant_ref": on(alleles, lambda: dict(ref=g.variant_ref(C("id"), C("contig"), C("start"), C("ref"), F.when(C("line_no") % 5 > 0, C("allele")), F.concat(F.lit("own"), C("line_no").cast("string"))))),
    "agg_vcf_stats": lambda s, d: vcf.vcf_stats(lines(s, d)),
    "agg_top_contigs": lambda s, d: vcf.top_contigs(records(s, d)).select("upload_id", "chrom", "n", C("rank").cast("bigint").alias("rank")),
    "agg_contig_labels": lambda s, d: vcf.contig_labels(records(s, d)),
    "cls_assembly": lambda s, d: vcf.detect_assembly(header_lines(s, d)),
    "join_assembly_gate": lambda s, d: vcf.assembly_gate(uploads(s, d), "GRCh38"),
    "cls_integrity": lambda s, d: vcf.integrity(all_lines(s, d)),
}

REC = """rec AS (SELECT upload_id, line_no, f[1] AS chrom, f[2] AS pos, f[3] AS id, f[4] AS ref, f[5] AS alt, f[6] AS qual, f[7] AS filter, f[8] AS info, coalesce(f[9], '') AS format, coalesce(f[10], '') AS sample
 FROM (SELECT upload_id, line_no, string_split(line, chr(9)) AS f FROM vcf_lines WHERE line NOT LIKE '#%') WHERE len(f) >= 8)"""
CALL = REC + """, call AS (SELECT *, CASE WHEN gt = '' THEN [] ELSE regexp_split_to_array(gt, '[/|]') END AS p FROM (SELECT *, CASE WHEN list_contains(string_split(format, ':'), 'GT') THEN coalesce(string_split(sample, ':')[list_position(string_split(format, ':'), 'GT')], '') ELSE '' END AS gt FROM rec))"""


def norm(c, mito="M"):
    bare = f"regexp_replace(upper(trim({c})), '^CHR', '')"
    other = "MT" if mito == "M" else "M"
    return f"CASE WHEN {bare} = '' THEN '' WHEN {bare} = '{other}' THEN 'chr{mito}' ELSE 'chr' || {bare} END"


ALL = CALL + f""", al0 AS (SELECT *, unnest(string_split(alt, ',')) AS allele, CAST(generate_subscripts(string_split(alt, ','), 1) AS INTEGER) AS alt_index, TRY_CAST(pos AS BIGINT) AS start, {norm('chrom')} AS contig FROM call),
 al AS (SELECT *, len(list_filter(p, lambda x: TRY_CAST(x AS INTEGER) = alt_index)) AS dosage, coalesce(TRY_CAST(nullif(regexp_extract(';' || info || ';', ';END=([^;]*);', 1), '') AS BIGINT), start + greatest(1, length(ref)) - 1) AS "end" FROM al0)"""
OK = "(" + ",".join(f"'{x}'" for x in g.SUPPORTED) + ")"
PART = "(len(p) = 0 OR list_contains(p, '') OR list_contains(p, '.'))"
SYM = "(allele IN ('', '*', '.') OR (allele LIKE '<%' AND allele LIKE '%>') OR contains(allele, '[') OR contains(allele, ']'))"
CLASS = f"CASE WHEN {PART} THEN 'missing_or_partial' WHEN len(p) <> 2 THEN 'non_diploid' WHEN p[1] = '0' AND p[2] = '0' THEN 'hom_ref' WHEN p[1] = p[2] THEN 'hom_alt' ELSE 'heterozygous' END"
BASES = "array_to_string(list_transform(p, lambda x: CASE WHEN x = '.' THEN '.' ELSE coalesce(list_concat([ref], string_split(alt, ','))[TRY_CAST(x AS INTEGER) + 1], '?') END), '/')"
SNV = "(length(ref) = 1 AND len(list_filter(string_split(alt, ','), lambda x: x <> '' AND length(x) <> 1)) = 0)"
KEYED = "'v2_' || substr(sha256('GRCh38|' || contig || '|' || CAST(start AS VARCHAR) || '|' || upper(ref) || '|' || upper(allele)), 1, 24)"


def rec(columns):
    return f"WITH {REC} SELECT upload_id, line_no, {columns} FROM rec"


def call(columns):
    return f"WITH {CALL} SELECT upload_id, line_no, {columns} FROM call"


def al(columns, where=""):
    return f"WITH {ALL} SELECT upload_id, line_no, alt_index, {columns} FROM al {where}"


def aset(c):
    return f"list_distinct(list_filter(list_transform(string_split(upper({c}), ','), lambda x: trim(x)), lambda x: x <> ''))"


def alt_status(e, o):
    e, o = aset(e), aset(o)
    return f"CASE WHEN len({e}) = 0 THEN 'missing_expected_alt' WHEN len({o}) = 0 THEN 'missing_vcf_alt' WHEN len({e}) = len({o}) AND len(list_intersect({e}, {o})) = len({e}) THEN 'alt_exact_match' WHEN len(list_intersect({e}, {o})) > 0 THEN 'alt_partial_overlap' ELSE 'alt_mismatch' END"


ASSEMBLY = """WITH h AS (SELECT upload_id, lower(line) AS l FROM vcf_headers),
 a AS (SELECT upload_id, CASE WHEN bool_or(l LIKE '##reference%' AND regexp_matches(l, 'grch38|hg38|b38')) THEN 'GRCh38' WHEN bool_or(l LIKE '##reference%' AND regexp_matches(l, 'grch37|hg19|b37')) THEN 'GRCh37' WHEN bool_or(regexp_matches(l, '^##contig=.*id=(chr)?1,.*length=248956422')) THEN 'GRCh38' WHEN bool_or(regexp_matches(l, '^##contig=.*id=(chr)?1,.*length=249250621')) THEN 'GRCh37' ELSE 'unknown' END AS assembly FROM h GROUP BY upload_id)"""
NOTE = "CASE WHEN line_no % 2 = 0 THEN contig || '|' || CAST(start - 1 AS VARCHAR) || '|' || ref || '|' || allele || CASE WHEN line_no % 4 = 0 THEN '|' || CAST(alt_index AS VARCHAR) ELSE '' END WHEN line_no % 3 = 0 THEN 'chr1|5' ELSE '' END"
SQL = {
    "src_vcf_records": f"WITH {REC} SELECT * FROM rec",
    "src_vcf_headers": """SELECT upload_id, coalesce(max(CASE WHEN line LIKE '##fileformat=%' THEN substr(line, 14) END), '') AS fileformat, count(*) FILTER (WHERE line LIKE '##%') AS n_metadata,
 CAST(coalesce(max(CASE WHEN line LIKE '#CHROM%' THEN len(string_split(line, chr(9))) END), 0) AS BIGINT) AS n_columns, max(CASE WHEN line LIKE '#CHROM%' THEN array_to_string(string_split(line, chr(9))[10:], ',') END) AS samples,
 CAST(coalesce(max(CASE WHEN line LIKE '#CHROM%' THEN len(string_split(line, chr(9))) - 9 END), 0) AS BIGINT) AS n_samples FROM vcf_headers GROUP BY upload_id""",
    "flt_supported_contig": rec(f"{norm('chrom')} AS contig, {norm('chrom')} IN {OK} AS supported"),
    "flt_symbolic_alt": al(f"allele, {SYM} AS symbolic"),
    "flt_observed_alleles": al("allele, CAST(dosage AS INTEGER) AS dosage", "WHERE dosage > 0"),
    "fn_norm_chrom": rec(f"chrom, {norm('chrom')} AS norm"),
    "fn_norm_chrom_legacy": rec(f"chrom, {norm('chrom', 'MT')} AS norm"),
    "fn_extract_gt": call("gt"),
    "fn_split_gt": call("array_to_string(p, ',') AS parts, CAST(len(p) AS BIGINT) AS n"),
    "fn_classify_gt": call(f"{CLASS} AS gt_class"),
    "fn_zygosity": call(f"CASE WHEN {PART} THEN 'unknown' WHEN len(p) <> 2 THEN 'non_diploid_or_complex' WHEN p[1] = p[2] THEN 'homozygous' ELSE 'heterozygous' END AS zygosity"),
    "fn_zygosity_alt": al(f"CASE WHEN {PART} THEN 'unknown' WHEN len(p) <> 2 THEN 'non_diploid_or_complex' WHEN dosage = 2 THEN 'homozygous' WHEN dosage = 1 THEN 'heterozygous' ELSE 'reference_only' END AS zygosity"),
    "fn_dosage": al("CAST(dosage AS BIGINT) AS dosage"),
    "fn_gt_alleles": call(f"{BASES} AS alleles"),
    "fn_explode_alleles": al("allele, start"),
    "fn_variant_key": al(f"{KEYED} AS variant_key"),
    "fn_parse_info": rec("""nullif(regexp_extract(';' || info || ';', ';END=([^;]*);', 1), '') AS "end", nullif(regexp_extract(';' || info || ';', ';SVTYPE=([^;]*);', 1), '') AS svtype, CASE WHEN contains(';' || info || ';', ';DB;') THEN 'true' END AS db, CAST(len(list_filter(string_split(info, ';'), lambda x: x NOT IN ('', '.'))) AS BIGINT) AS n"""),
    "fn_variant_interval": al(f"""start, "end", CASE WHEN {SYM} THEN 'symbolic_alt' ELSE '' END AS warning"""),
    "fn_overlap": al('''least("end", 150000) >= greatest(start, 1001) AS hit'''),
    "fn_parse_orig": f"""WITH {ALL}, n AS (SELECT *, string_split({NOTE}, '|') AS o FROM al)
 SELECT upload_id, line_no, alt_index, CASE WHEN len(o) >= 4 THEN o[1] ELSE contig END AS source_chrom, CASE WHEN len(o) >= 4 THEN o[2] ELSE CAST(start AS VARCHAR) END AS source_pos, CASE WHEN len(o) >= 4 THEN o[3] ELSE ref END AS source_ref, CASE WHEN len(o) >= 4 THEN o[4] ELSE allele END AS source_alt, coalesce(CASE WHEN len(o) >= 4 THEN o[5] END, '1') AS source_index, coalesce(CASE WHEN len(o) >= 4 THEN o[5] END, '') AS source_index_plain FROM n""",
    "fn_quality_flag": rec("CASE WHEN filter IN ('', '.', 'PASS') THEN 'pass' ELSE 'filtered' END AS flag"),
    "fn_is_snv": rec(f"{SNV} AS snv"),
    "fn_compare_ref": rec("CASE WHEN line_no % 3 = 0 THEN 'missing_expected_ref' WHEN line_no % 7 = 0 THEN 'missing_vcf_ref' WHEN ref = CASE WHEN line_no % 3 = 1 THEN 'A' ELSE 'GA' END THEN 'ref_match' ELSE 'ref_mismatch' END AS status"),
    "fn_compare_alt": rec(alt_status("CASE line_no % 4 WHEN 0 THEN '' WHEN 1 THEN 'TC,G' WHEN 2 THEN 'g, A' ELSE 'T' END", "CASE WHEN line_no % 7 = 0 THEN '' ELSE alt END") + " AS status"),
    "set_allele_compare": rec(f"list_sort({aset('alt')}) = ['G', 'TC'] AS same, array_to_string(list_sort(list_intersect({aset('alt')}, ['TC', 'G'])), ',') AS shared"),
    "fn_match_keys": rec("chrom || ':' || pos AS key_pos, CASE WHEN line_no % 5 = 0 THEN '' ELSE chrom || '|' || pos || '|' || ref || '|' || alt END AS key_full"),
    "fn_rsids": rec("CASE WHEN id = '.' THEN 'rs5,rs12' ELSE id || ',rs5,rs12' END AS rsids, CASE WHEN id = '.' OR id > 'rs12' THEN 'rs12' ELSE id END AS first, CASE WHEN id = '.' THEN '' ELSE id END AS whole"),
    "fn_exact_allele": al("ref IN ('A', 'G', 'T', 'TA') AND allele IN ('A', 'G', 'T', 'TA') AS exact"),
    "fn_allele_signature": f"""WITH {ALL}, s AS (SELECT *, 'CA' || ref || 'T' AS r, 'CA' || allele || 'GT' AS a FROM al),
 t AS (SELECT *, upper(r) AS ur, upper(a) AS ua FROM s),
 k AS (SELECT *, len(list_filter(range(1, least(length(ur), length(ua))), lambda i: left(ur, i) = left(ua, i))) AS k FROM t),
 c AS (SELECT *, substr(ur, k + 1) AS r2, substr(ua, k + 1) AS a2 FROM k),
 x AS (SELECT *, len(list_filter(range(1, least(length(r2), length(a2))), lambda i: right(r2, i) = right(a2, i))) AS m FROM c)
 SELECT upload_id, line_no, alt_index, left(r2, length(r2) - m) AS ref, left(a2, length(a2) - m) AS alt, CAST(k AS BIGINT) AS prefix FROM x""",
    "fn_observed_alts": call(f"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(upper({BASES}), '[/|,]'), lambda x: x NOT IN ('', '.', '?') AND x <> upper(ref)))), ',') AS alts"),
    "fn_genotype_display": call(f"CASE WHEN {BASES} = '' THEN 'NA' WHEN len(list_filter(string_split({BASES}, '/'), lambda x: length(x) <> 1)) = 0 THEN replace({BASES}, '/', '') ELSE {BASES} END AS shown"),
    "fn_ref_alt_display": rec("CASE WHEN line_no % 2 = 0 THEN ref || '/' || alt WHEN line_no % 3 = 0 THEN 'N/M' ELSE 'NA' END AS shown"),
    "fn_variant_ref": al("CASE WHEN id NOT IN ('', '.') THEN id WHEN line_no % 5 > 0 THEN contig || ':' || CAST(start AS VARCHAR) || ':' || ref || '>' || allele ELSE 'own' || CAST(line_no AS VARCHAR) END AS ref"),
    "agg_vcf_stats": f"""WITH {CALL}, m AS (SELECT upload_id, count(*) AS malformed FROM vcf_lines WHERE len(string_split(line, chr(9))) < 8 GROUP BY upload_id), c AS (SELECT *, {CLASS} AS k FROM call)
 SELECT c.upload_id, count(*) AS total, count(*) FILTER (WHERE id NOT IN ('', '.')) AS with_id, count(*) FILTER (WHERE regexp_matches(id, '(?i)rs[0-9]+')) AS with_rsid, count(*) FILTER (WHERE filter = 'PASS') AS pass, count(*) FILTER (WHERE contains(alt, ',')) AS multiallelic,
 count(*) FILTER (WHERE {SNV}) AS snv, count(*) FILTER (WHERE NOT {SNV}) AS non_snv, """ + ", ".join(f"count(*) FILTER (WHERE k = '{k}') AS gt_{k}" for k in vcf.GT_CLASSES) + ", coalesce(max(m.malformed), 0) AS malformed FROM c LEFT JOIN m ON c.upload_id = m.upload_id GROUP BY c.upload_id",
    "agg_top_contigs": f"WITH {REC} SELECT * FROM (SELECT upload_id, chrom, n, row_number() OVER (PARTITION BY upload_id ORDER BY n DESC, f) AS rank FROM (SELECT upload_id, chrom, count(*) AS n, min(line_no) AS f FROM rec GROUP BY upload_id, chrom)) WHERE rank <= 15",
    "agg_contig_labels": f"WITH {REC} SELECT upload_id, contig, arg_min(chrom, line_no) AS label FROM (SELECT *, {norm('chrom')} AS contig FROM rec WHERE regexp_full_match(chrom, '[A-Za-z0-9_.-]+')) WHERE contig IN {OK} GROUP BY upload_id, contig",
    "cls_assembly": f"{ASSEMBLY} SELECT * FROM a",
    "join_assembly_gate": f"""{ASSEMBLY}, u AS (SELECT *, CASE upload_id WHEN 'u3' THEN '' WHEN 'u2' THEN 'GRCh37' ELSE assembly END AS selected FROM a)
 SELECT *, CASE WHEN assembly <> 'unknown' AND selected <> '' AND assembly <> selected THEN 'selection_conflict' WHEN assembly = 'unknown' AND selected = '' THEN 'confirmation_required' WHEN CASE WHEN assembly <> 'unknown' THEN assembly ELSE selected END <> 'GRCh38' THEN 'canon_mismatch' ELSE 'ok' END AS gate FROM u""",
    "cls_integrity": """WITH f AS (SELECT upload_id, line_no, string_split(line, chr(9)) AS f, row_number() OVER (PARTITION BY upload_id ORDER BY line_no) AS k FROM vcf_lines),
 e AS (SELECT upload_id, bool_or(TRY_CAST(f[2] AS BIGINT) IS NULL OR TRY_CAST(f[2] AS BIGINT) <= 0) AS p, bool_or(len(f) < 8) AS s, bool_or(coalesce(f[1], '') = '' OR coalesce(f[4], '') = '' OR coalesce(f[5], '') = '') AS m FROM f WHERE k <= 20 GROUP BY upload_id),
 h AS (SELECT upload_id, bool_or(line LIKE '##fileformat=%') AS ff, bool_or(line LIKE '#CHROM%') AS hc FROM vcf_headers GROUP BY upload_id)
 SELECT h.upload_id, concat_ws('|', CASE WHEN NOT hc THEN 'missing_chrom_header' END, CASE WHEN p THEN 'bad_pos' END, CASE WHEN m THEN 'empty_field' END, CASE WHEN s THEN 'short_row' END) AS errors, concat_ws('|', CASE WHEN NOT ff THEN 'missing_fileformat' END, CASE WHEN hc THEN 'several_samples' END) AS warnings, CASE WHEN p OR m OR s OR NOT hc THEN 'invalid' WHEN NOT ff OR hc THEN 'warning' ELSE 'valid' END AS status FROM h LEFT JOIN e ON h.upload_id = e.upload_id""",
}
