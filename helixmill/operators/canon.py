"""The curated side: transcript features, their unions, gene summaries, sheets, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixmill.functions.genotype import extract_rsids, text
from helixmill.functions.text import clean_str, extract_category, extract_gene
from helixmill.operators.intervals import merge_intervals


def transcript_tier(mane: Column, clinical: Column, canonical: Column, biotype: Column) -> Column:
    return F.when(mane == 1, "mane_select").when(clinical == 1, "mane_plus_clinical").when(canonical == 1, "ensembl_canonical").when(biotype == "protein_coding", "protein_coding").when(biotype == "retained_intron", "retained_intron_low_priority").otherwise("noncoding_relevant")


def tag_transcripts(transcripts: DataFrame, overlap: DataFrame, mane: DataFrame) -> DataFrame:
    """transcripts (transcript_id, gene_id, biotype, is_canonical) with the tags of their overlap metadata (transcript_id,
    tags as a list, overlap_biotype, overlap_canonical) and the gene's MANE transcripts (gene_id, mane_id, with or
    without version): three flags, the biotype, own before overlap, and the tier. What is missing on one side is taken
    from the other; every transcript stays."""
    ids = mane.groupBy("gene_id").agg(F.collect_set(F.substring_index("mane_id", ".", 1)).alias("_mane"))
    tagged = lambda tag: F.coalesce(F.array_contains("tags", tag), F.lit(False))
    listed = F.coalesce(F.array_contains("_mane", F.col("transcript_id")), F.lit(False))
    rows = transcripts.join(overlap, "transcript_id", "left").join(ids, "gene_id", "left")
    flags = {"is_mane_select": tagged("MANE_Select") | listed, "is_mane_plus_clinical": tagged("MANE_Plus_Clinical"), "is_ensembl_canonical": (F.coalesce("is_canonical", F.lit(0)) == 1) | (F.coalesce("overlap_canonical", F.lit(0)) == 1)}
    rows = rows.withColumns({n: c.cast("int") for n, c in flags.items()} | {"biotype": F.coalesce(F.nullif(text(F.col("biotype")), F.lit("")), text(F.col("overlap_biotype")))})
    primary = F.greatest(*flags)
    return rows.withColumns({"is_primary": primary, "inclusion_tier": transcript_tier(*[F.col(c) for c in flags], F.col("biotype"))}).drop("_mane", "tags", "overlap_biotype", "overlap_canonical")


def number_exons(exons: DataFrame) -> DataFrame:
    """Exons with real ends, numbered along the chromosome."""
    by = W.partitionBy("transcript_id").orderBy("e_start", "e_end")
    return exons.where("e_start > 0 AND e_end > 0").withColumn("number", F.row_number().over(by))


def _feature(kind: str | Column, number: Column, start: Column, end: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("feature_type"), number.alias("feature_number"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))


def _splice_features(following: Column) -> Column:
    """Donor, acceptor and two boundary windows between an exon and the start of the following one."""
    forward = F.col("strand") >= 0
    donor, acceptor = F.when(forward, F.col("e_end")).otherwise(following), F.when(forward, following).otherwise(F.col("e_end"))
    label = F.concat_ws("->", F.col("number").cast("string"), (F.col("number") + 1).cast("string"))
    window = lambda kind, at: _feature(kind, label, F.greatest(F.lit(1), at - 2), at + 2)
    return F.array(window("splice_donor_window", donor), window("splice_acceptor_window", acceptor), window("splice_boundary_window", donor), window("splice_boundary_window", acceptor))


def splice_windows(exons: DataFrame) -> DataFrame:
    """exons: numbered, with strand. Donor, acceptor and two boundary windows for each neighbouring pair."""
    by = W.partitionBy("transcript_id").orderBy("number")
    pairs = exons.withColumn("_next", F.lead("e_start").over(by)).where(F.col("_next").isNotNull())
    return pairs.select("gene_id", "transcript_id", F.inline(_splice_features(F.col("_next"))))


def build_features(transcripts: DataFrame, exons: DataFrame, clip_to_exon: bool = False) -> DataFrame:
    """Typed features of every transcript, all of an exon's from one row. The part of an exon before or after the coding
    range runs, as in the source tables, up to the coding range itself unless it is clipped to the exon."""
    bodies = transcripts.select("gene_id", "transcript_id", F.inline(F.array(_feature("transcript_body", F.lit(""), F.col("t_start"), F.col("t_end")))))
    by = W.partitionBy("transcript_id").orderBy("number")
    coding = F.col("cds_start").isNotNull() & F.col("cds_end").isNotNull()
    low, high = F.least("cds_start", "cds_end"), F.greatest("cds_start", "cds_end")
    rows = number_exons(exons).join(transcripts.select("transcript_id", "strand", "cds_start", "cds_end"), "transcript_id")
    rows = rows.withColumns({"_a": F.greatest("e_start", low), "_b": F.least("e_end", high)}).withColumn("_in", coding & (F.col("_a") <= F.col("_b")))
    rows = rows.withColumns({"_seen": F.max(F.col("_in").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)) == 1, "_next": F.lead("e_start").over(by)})
    n = F.col("number").cast("string")
    part = lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
    before, after = part(F.col("e_start"), F.col("_a") - 1), part(F.col("_b") + 1, F.col("e_end"))
    if clip_to_exon:
        before, after = part(F.col("e_start"), F.least("e_end", F.col("_a") - 1)), part(F.greatest("e_start", F.col("_b") + 1), F.col("e_end"))
    both = F.array(F.when(F.col("e_start") < F.col("_a"), before), F.when(F.col("_b") < F.col("e_end"), after))
    parts = F.when(F.col("_seen"), both).otherwise(F.array(part(F.col("e_start"), F.col("e_end"))))
    parts = F.filter(F.when(coding, F.array_compact(parts)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda u: u["start"] <= u["end"])
    five = lambda u: F.when(F.col("strand") >= 0, u["end"] < F.col("cds_start")).otherwise(u["end"] >= F.col("cds_start"))
    utr = F.transform(parts, lambda u: _feature(F.when(five(u), "utr_5_interval").otherwise("utr_3_interval"), n, u["start"], u["end"]))
    single = F.array_compact(F.array(_feature("exon_interval", n, F.col("e_start"), F.col("e_end")), F.when(F.col("_in"), _feature("cds_interval", n, F.col("_a"), F.col("_b")))))
    splice = F.when(F.col("_next").isNotNull(), _splice_features(F.col("_next"))).otherwise(F.slice(single, 1, 0))
    return bodies.unionByName(rows.select("gene_id", "transcript_id", F.inline(F.concat(single, utr, splice))))


def feature_unions(features: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Features with the union type (or types) that each belongs to."""
    kind, bio, mane = F.col("feature_type"), F.col("biotype"), F.col("is_mane_select") == 1
    types = F.array_compact(F.array(
        F.when(kind == "transcript_body", "transcript_body_union"), F.when((kind == "transcript_body") & (bio == "retained_intron"), "retained_intron_body_union"),
        F.when((kind == "exon_interval") & mane, "mane_exon_union"), F.when((kind == "exon_interval") & (bio == "protein_coding"), "protein_coding_exon_union"), F.when((kind == "exon_interval") & (bio != "protein_coding"), "noncoding_exon_union"),
        F.when((kind == "cds_interval") & mane, "mane_cds_union"), F.when((kind == "cds_interval") & (bio == "protein_coding"), "protein_coding_cds_union"),
        F.when(kind.startswith("utr_"), "utr_union"), F.when(kind.startswith("splice_"), "splice_window_union")))
    flag = lambda c: F.col(c) if c in transcripts.columns else F.lit(0)
    tier = transcript_tier(F.col("is_mane_select"), flag("is_mane_plus_clinical"), flag("is_ensembl_canonical"), F.col("biotype"))
    known = transcripts.select("transcript_id", "biotype", "is_mane_select", tier.alias("tier"))
    return features.join(known, "transcript_id").withColumn("merged_feature_type", F.explode(types))


def merged_features(typed: DataFrame) -> DataFrame:
    """Unions of features with their types (feature_unions), which are read twice and so best written first."""
    figures = typed.groupBy("gene_id", "merged_feature_type").agg(F.count("*").alias("source_feature_count"), F.count_distinct("transcript_id").alias("source_transcript_count"), F.array_join(F.array_sort(F.collect_set("tier")), " | ").alias("transcript_set_scope"))
    return merge_intervals(typed, ["gene_id", "merged_feature_type"]).join(figures, ["gene_id", "merged_feature_type"])


def gene_master(genes: DataFrame, rows: DataFrame, transcripts: DataFrame, merged: DataFrame) -> DataFrame:
    """One row a gene; every side is summed up before it is joined."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    modules = rows.groupBy("gene_id").agg(joined("module_id").alias("module_ids"), joined("module_name").alias("module_names"), F.array_join(F.array_sort(F.collect_list("canon_row_id")), " | ").alias("row_ids"), F.count("*").alias("n_rows"), F.count(F.when(F.col("module_status") == "Draft", 1)).alias("n_draft"))
    tx = transcripts.groupBy("gene_id").agg(F.count("*").alias("n_transcripts"), F.max("is_mane_select").alias("has_mane"))
    m = merged.groupBy("gene_id").agg(F.count("*").alias("n_merged"))
    return genes.select("gene_id", "approved_symbol").join(modules, "gene_id").join(tx, "gene_id", "left").join(m, "gene_id", "left").na.fill(0, ["n_transcripts", "has_mane", "n_merged"])


def canon_structure(sheet: DataFrame) -> DataFrame:
    """sheet: row_id and cells a, b, c, d. Category, gene, rsIDs, effect, and where the row belongs."""
    cells = [clean_str(F.col(x), "collapse") for x in "abcd"]
    rsids = extract_rsids(F.concat_ws(" ", *cells))
    out = sheet.select("row_id", *[c.alias(n) for c, n in zip(cells, "abcd", strict=True)], rsids.alias("_r"))
    out = out.withColumns({"category": extract_category(F.col("a"), F.col("b"), F.size("_r")), "gene": extract_gene(F.col("b")), "rsids": F.array_join("_r", ","), "effect": F.when(F.col("d") != "", F.col("d")).when(~F.lower("c").rlike("^rs[0-9]+$"), F.col("c")).otherwise("")})
    fits = (F.col("category") != "") & (F.col("gene") != "")
    group = F.when((F.size("_r") > 0) & fits, "df_ok").otherwise("revision_manual")
    reason = F.when(F.size("_r") == 0, "no_rsid_detected").when(~fits, "needs_column_review").otherwise("")
    return out.withColumns({"source_group": group, "reason": reason}).drop("_r", *"abcd")


def canon_status(rows: Column, with_rsid: Column, manual: Column, repeated: Column, columns: Column) -> Column:
    return F.when((rows == 0) | (with_rsid == 0), "invalid").when((manual > 0) | (repeated > 0) | (columns > 4), "warning").otherwise("valid")


def module_metadata(rows: DataFrame) -> DataFrame:
    """One row of figures of a canon of modules. rows: symbol ('' for a module without a gene), module_id, module_status."""
    c = F.col
    per_symbol = rows.where("symbol <> ''").groupBy("symbol").agg(F.count("*").alias("n")).agg(F.count("*").alias("unique_gene_symbols"), F.count(F.when(c("n") > 1, 1)).alias("duplicate_gene_symbols"))
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    one = rows.agg(F.count("*").alias("rows_total"), n(c("symbol") != "", "rows_with_gene"), n(c("symbol") == "", "rows_non_gene_module"), n(F.lower("module_status") == "draft", "draft_rows"), F.count_distinct(F.nullif("module_id", F.lit(""))).alias("module_count"))
    return one.crossJoin(per_symbol)  # one row by one row


# Kind, severity, what is said before and after a name, and what to do.
ROW_WARNINGS = {
    "non_gene_module": ("info", "Row ", " has no gene symbol and is kept as a non-gene module.", "No VCF matching will be performed for this row."),
    "multiple_gene_candidates": ("warning", "", "", "Review the gene symbol or curate the canon row."),
    "unresolved_symbol": ("warning", "", "", "Review the gene symbol or curate the canon row."),
}
GENE_WARNINGS = {
    "no_mane_select": ("warning", "", " resolved without MANE Select transcript.", "Review if transcript coverage is acceptable for this gene."),
    "no_protein_coding_transcript": ("warning", "", " resolved without protein-coding transcripts.", "Review whether this gene should participate in this canon."),
    "many_transcripts": ("info", "", " included transcripts.", "Review transcript spread during QA if needed."),
    "cnv_sensitive_gene": ("warning", "", " may be deletion/CNV-sensitive.", "Do not infer normality from absence of SNVs in a standard VCF."),
}
CNV_SENSITIVE, MANY_TRANSCRIPTS = ("GSTM1", "GSTT1"), 20


def canon_warnings(rows: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One row a warning: canon_row_id (of a row) or gene_id (of a gene), warning, severity, message, action. rows:
    canon_row_id, symbol ('' for a module without a gene), resolution_status, resolution_notes, and gene_id and
    approved_symbol where the symbol was resolved. transcripts: of all genes."""
    c = F.col
    def warned(df: DataFrame, rules: dict, tests: dict[str, Column], said: dict[str, Column], keys: list[str]) -> DataFrame:
        each = [F.when(tests[n], F.struct(F.lit(n).alias("warning"), F.lit(rules[n][0]).alias("severity"), said[n].alias("message"), F.lit(rules[n][3]).alias("action"))) for n in rules]
        return df.select(*keys, F.explode(F.array_compact(F.array(*each))).alias("x")).select(*keys, "x.*")

    status, bare = c("resolution_status"), c("symbol") == ""
    row_tests = {"non_gene_module": bare, "multiple_gene_candidates": ~bare & (status == "resolved_multiple_candidates"), "unresolved_symbol": ~bare & c("gene_id").isNull() & (status != "resolved_multiple_candidates")}
    notes = F.coalesce("resolution_notes", F.lit(""))
    around = lambda rule, name: F.concat(F.lit(rule[1]), name, F.lit(rule[2]))
    of_rows = warned(rows, ROW_WARNINGS, row_tests, {"non_gene_module": around(ROW_WARNINGS["non_gene_module"], c("canon_row_id")), "multiple_gene_candidates": notes, "unresolved_symbol": notes}, ["canon_row_id"])
    tx = transcripts.groupBy("gene_id").agg(F.count("*").alias("n"), F.max("is_mane_select").alias("mane"), F.count(F.when(c("biotype") == "protein_coding", 1)).alias("coding"))
    genes = rows.where(~bare & c("gene_id").isNotNull() & (status != "resolved_multiple_candidates")).groupBy("gene_id").agg(F.min("approved_symbol").alias("approved_symbol")).join(tx, "gene_id", "left")
    n, name = F.coalesce("n", F.lit(0)), c("approved_symbol")
    gene_tests = {"no_mane_select": F.coalesce("mane", F.lit(0)) == 0, "no_protein_coding_transcript": F.coalesce("coding", F.lit(0)) == 0, "many_transcripts": n > MANY_TRANSCRIPTS, "cnv_sensitive_gene": name.isin(*CNV_SENSITIVE)}
    said = {k: around(v, F.concat(name, F.lit(" has "), n.cast("string")) if k == "many_transcripts" else name) for k, v in GENE_WARNINGS.items()}
    of_genes = warned(genes, GENE_WARNINGS, gene_tests, said, ["gene_id"])
    return of_rows.unionByName(of_genes, allowMissingColumns=True)


def resolution_status(n: Column, how: Column) -> Column:
    return F.when(n > 1, "multiple_candidates").when(how == "approved", "resolved_exact_symbol").when(how == "alias", "resolved_alias").when(how == "previous", "deprecated_symbol").otherwise("unresolved")


def resolve_symbols(symbols: DataFrame, approved: DataFrame, alias: DataFrame, previous: DataFrame) -> DataFrame:
    """Approved symbol first (its first gene), else a single alias, else a single previous symbol."""
    side = lambda df, name: df.groupBy("symbol").agg(F.min("gene_id").alias(f"{name}_id"), F.count_distinct("gene_id").alias(f"{name}_n"))
    out = symbols.select("symbol").distinct()
    for df, name in ((approved, "approved"), (alias, "alias"), (previous, "previous")):
        out = out.join(side(df, name), "symbol", "left")
    n = F.when(F.col("approved_n") > 0, F.lit(1)).when(F.col("alias_n") > 0, F.col("alias_n")).when(F.col("previous_n") > 0, F.col("previous_n")).otherwise(0)
    how = F.when(F.col("approved_n") > 0, "approved").when(F.col("alias_n") > 0, "alias").when(F.col("previous_n") > 0, "previous").otherwise("none")
    gene = F.when(n == 1, F.coalesce("approved_id", "alias_id", "previous_id"))
    return out.select("symbol", gene.alias("gene_id"), how.alias("how"), F.when(n > 1, "multiple_candidates").when(n == 0, "not_found").otherwise("resolved").alias("status"), resolution_status(n, how).alias("resolution"))


def export_envelope_index(genes: DataFrame, block: int = 1_000_000) -> DataFrame:
    """Per chromosome and block of bases the genes that begin there by start, end, symbol; rows without place are left
    out. A block bounds a row of the index, however many genes a chromosome has."""
    kept = genes.where((text(F.col("chrom")) != "") & F.col("g_start").isNotNull() & F.col("g_end").isNotNull())
    return kept.groupBy("chrom", F.expr(f"g_start div {block}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("g_start", "g_end", F.col("approved_symbol").alias("symbol"), "gene_id", "strand"))).alias("genes"))


def export_feature_index(merged: DataFrame) -> DataFrame:
    """Per gene a map from union type to its intervals."""
    by_type = merged.groupBy("gene_id", "merged_feature_type").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("intervals"))
    return by_type.groupBy("gene_id").agg(F.map_from_entries(F.collect_list(F.struct("merged_feature_type", "intervals"))).alias("features"))


def rsid_long(canon: DataFrame) -> DataFrame:
    return canon.where("rsids <> ''").select("row_id", "category", "gene", "source_group", F.explode(F.split("rsids", ",")).alias("rsid"))


def rsid_master(long: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), " | ")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list("row_id")), lambda x: x.cast("string")), ",")
    return long.groupBy("rsid").agg(F.count("*").alias("n_source_rows"), rows.alias("source_rows"), joined("source_group").alias("source_tables"), joined("category").alias("categories"), joined("gene").alias("genes"))


def flag_duplicate_rsids(canon: DataFrame) -> DataFrame:
    """n_same: rows with the same first identifier. The many rows without one are counted apart, as a window over them
    would be one task."""
    from helixmill.functions.genotype import first_rsid

    first = canon.withColumn("first_rsid", first_rsid(F.col("rsids")))
    n = first.groupBy("first_rsid").agg(F.count("*").alias("n_same"))
    named = first.where("first_rsid <> ''").join(n, "first_rsid")
    none = first.where("first_rsid = ''").join(F.broadcast(n.where("first_rsid = ''")), "first_rsid")
    both = named.unionByName(none).select(*canon.columns, "first_rsid", "n_same")
    twice = (F.col("source_group") == "df_ok") & (F.col("first_rsid") != "") & (F.col("n_same") > 1)
    return both.withColumns({"source_group": F.when(twice, "rsids_repetidos").otherwise(F.col("source_group")), "reason": F.when(twice, "duplicate_rsid").otherwise(F.col("reason"))})


def exact_duplicates(canon: DataFrame) -> DataFrame:
    keys = [F.lower(c).alias(c) for c in ("category", "gene", "rsids", "effect")]
    return canon.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
