"""Annotation evidence: payload parsing, identifier resolution, caches, gates, scores, groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixmill.functions import text as t
from helixmill.functions.genotype import allele_signature, exact_allele, let, norm_chrom, normalize_rsid, text

#: Fields of a transcript that are read, all as text.
TRANSCRIPT_TEXTS = (
    "gene_symbol", "transcript_id", "canonical", "mane_select", "mane_plus_clinical", "impact", "biotype", "hgvsc", "hgvsp", "protein_id", "exon", "intron", "cdna_start", "cdna_end", "cds_start", "cds_end", "amino_acids", "protein_start", "protein_end",
    "sift_prediction", "sift_pred", "sift_score", "polyphen_prediction", "polyphen2_hdiv_pred", "polyphen_score", "cadd_phred", "revel_score", "revel", "alphamissense_score", "alphamissense", "alphamissense_pred", "mutationtaster_pred", "metasvm_pred", "spliceai", "swissprot", "trembl", "uniparc", "uniprot_isoform",
)
TRANSCRIPT = "struct<" + ",".join(f"{n}:string" for n in TRANSCRIPT_TEXTS) + ",consequence_terms:array<string>,domains:array<struct<db:string,name:string>>>"
COLOCATED = "struct<id:string,allele_string:string,seq_region_name:string,start:string,end:string,minor_allele_freq:string>"
VEP = f"struct<input:string,most_severe_consequence:string,variant_class:string,colocated_variants:array<{COLOCATED}>,transcript_consequences:array<{TRANSCRIPT}>,vrs:string>"
#: Columns of the picked transcript: the first field that has a value, or two places with a dash between.
PICKED = {
    "canonical": ("canonical",), "mane_select": ("mane_select",), "hgvsc": ("hgvsc",), "hgvsp": ("hgvsp",), "protein_id": ("protein_id",), "exon": ("exon",), "intron": ("intron",), "amino_acids": ("amino_acids",), "sift_prediction": ("sift_prediction", "sift_pred"), "sift_score": ("sift_score",),
    "polyphen_prediction": ("polyphen_prediction", "polyphen2_hdiv_pred"), "polyphen_score": ("polyphen_score",), "cadd_phred": ("cadd_phred",), "revel_score": ("revel_score", "revel"), "alphamissense_score": ("alphamissense_score", "alphamissense"), "alphamissense_pred": ("alphamissense_pred",), "mutationtaster_pred": ("mutationtaster_pred",), "metasvm_pred": ("metasvm_pred",), "spliceai": ("spliceai",),
}
PLACES = {"cdna": ("cdna_start", "cdna_end"), "cds": ("cds_start", "cds_end"), "protein_position": ("protein_start", "protein_end")}
GWAS = "struct<_embedded:struct<associations:array<struct<pvalue:double,pvalueMantissa:double,pvalueExponent:int,efoTraits:array<struct<trait:string>>,loci:array<struct<authorReportedGenes:array<struct<geneName:string>>>>,betaNum:double,betaDirection:string,orPerCopyNum:double>>>>"
CLINVAR = "struct<result:struct<items:array<struct<uid:string,title:string,accession:string,record_type:string,review_status:string,clinical_significance:string,germline_classification:struct<description:string,review_status:string>,trait_set:array<struct<trait_name:string>>>>>>"
PGX = "struct<data:array<struct<name:string,allelePhenotypes:array<struct<allele:string,phenotype:string>>,levelOfEvidence:struct<term:string>,relatedChemicals:array<struct<name:string>>>>>"


def pick_transcript(transcripts: Column) -> Column:
    """The best transcript: MANE select, MANE plus clinical, canonical, protein coding, then by id."""
    flag = lambda c, n: F.when(c, 0).otherwise(1).alias(n)
    order = lambda x: F.struct(flag(text(x["mane_select"]) != "", "a"), flag(text(x["mane_plus_clinical"]) != "", "b"), flag(x["canonical"] == "1", "c"), flag(x["biotype"] == "protein_coding", "d"), text(x["transcript_id"]).alias("e"), x.alias("x"))
    return F.array_min(F.transform(transcripts, lambda x: order(x).cast(f"struct<a:int,b:int,c:int,d:int,e:string,x:{TRANSCRIPT}>")))["x"]


def transcript_summary(x: Column) -> Column:
    first = lambda *names: F.coalesce(*[F.nullif(text(x[n]), F.lit("")) for n in names], F.lit(""))
    terms = t.unique_join(F.coalesce(x["consequence_terms"], F.array().cast("array<string>")), 6)
    return told(gene=x["gene_symbol"], tx=x["transcript_id"], consequence=terms, impact=x["impact"], biotype=x["biotype"], hgvsc=x["hgvsc"], hgvsp=x["hgvsp"], cadd_phred=x["cadd_phred"], revel=first("revel_score", "revel"), spliceai=x["spliceai"])


def answer(df: DataFrame, payload: str) -> Column:
    """The parsed payload: what ``with_answer`` left in df, else parsed here."""
    return F.col("_answer") if "_answer" in df.columns else F.from_json(payload, VEP)


def with_answer(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with its payload parsed, for several readers of it."""
    return df.withColumn("_answer", F.from_json(payload, VEP))


def parse_vep(df: DataFrame, payload: str = "payload", gene: str = "target_gene") -> DataFrame:
    """Flat columns of a payload, parsed once: status, the target gene's best transcript (else that of any gene) by PICKED
    and PLACES, summaries of the gene's first ten transcripts (else of the first five of any), colocated records, domains."""
    c = F.col
    none = F.array().cast(f"array<{TRANSCRIPT}>")
    parsed = df.withColumn("_v", answer(df, payload)).withColumn("_t", F.coalesce("_v.transcript_consequences", none))
    parsed = parsed.withColumn("_own", F.filter("_t", lambda x: F.upper(F.trim(text(x["gene_symbol"]))) == F.upper(F.trim(text(c(gene))))))
    parsed = parsed.withColumn("_some", F.when(F.size("_own") > 0, c("_own")).otherwise(c("_t"))).withColumn("_best", pick_transcript(c("_some")))
    best = c("_best")
    value = lambda *names: F.coalesce(*[F.nullif(text(best[n]), F.lit("")) for n in names], F.lit(""))
    each = lambda rows, name: F.transform(rows, lambda x: x[name])
    told_rows = lambda rows, most: F.filter(F.transform(F.slice(rows, 1, most), transcript_summary), lambda x: x != "")
    own = told_rows(c("_own"), 10)
    records = F.transform(F.slice(F.coalesce("_v.colocated_variants", F.array().cast(f"array<{COLOCATED}>")), 1, 10), lambda x: told(id=x["id"], alleles=x["allele_string"], maf=x["minor_allele_freq"]))
    domains = F.transform(F.coalesce(best["domains"], F.array().cast("array<struct<db:string,name:string>>")), lambda x: F.concat(text(x["db"]), F.lit(":"), text(x["name"])))
    columns = {
        "most_severe_consequence": text(c("_v.most_severe_consequence")), "variant_class": text(c("_v.variant_class")), "status": F.when(F.size("_t") == 0, "no_transcript_consequence").when(F.size("_own") > 0, "direct_target_transcript").otherwise("other_gene_only"),
        "genes": t.unique_join(each("_t", "gene_symbol")), "impacts": t.unique_join(each("_some", "impact")), "terms": t.unique_join(F.flatten(F.transform("_some", lambda x: F.coalesce(x["consequence_terms"], F.array().cast("array<string>")))), 12),
        "transcript_summary": t.unique_join(let(own, lambda o: F.when(F.size(o) > 0, o).otherwise(told_rows(c("_t"), 5))), 10), "gene": value("gene_symbol"), "transcript": value("transcript_id"), "impact": value("impact"),
        **{n: value(*names) for n, names in PICKED.items()}, **{n: F.concat_ws("-", *[F.nullif(text(best[x]), F.lit("")) for x in pair]) for n, pair in PLACES.items()},
        "uniprot": t.unique_join(F.array(*[best[n] for n in ("swissprot", "trembl", "uniparc", "uniprot_isoform")])), "domains_summary": t.unique_join(domains), "colocated_variants": t.unique_join(records, 10),
    }
    return parsed.select(*df.columns, *[v.alias(f"vep_{n}") for n, v in columns.items()])


def colocated_match(entry: Column, chrom: Column, start: Column, ref: Column, alt: Column) -> Column:
    """How a colocated record (allele_string, seq_region_name, start, end: texts) is the variant: 'exact_allele',
    'normalized_indel_allele' or ''. It must be of the variant's contig, unless one is unknown, and its span must meet the
    variant's. Where a place is no number, only its very alleles count. Else any two of its alleles, either way round,
    may be the variant's once both are trimmed."""
    there, here = norm_chrom(entry["seq_region_name"]), norm_chrom(chrom)
    first = entry["start"].try_cast("bigint")
    last = F.coalesce(F.nullif(entry["end"].try_cast("bigint"), F.lit(0)), first)
    bad = start.isNull() | first.isNull() | ((text(entry["end"]) != "") & entry["end"].try_cast("bigint").isNull())
    meets = F.least(start + F.greatest(F.length(ref), F.lit(1)) - 1, last) >= F.greatest(start, first)
    exact = exact_allele(entry["allele_string"], ref, alt)
    trimmed = lambda r, a: let(allele_signature(r, a), lambda x: F.struct(x["ref"].alias("ref"), x["alt"].alias("alt")))
    alleles = F.filter(F.transform(F.split(text(entry["allele_string"]), "[|/,]"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = lambda own: F.exists(F.transform(alleles, lambda r, i: F.exists(F.transform(alleles, lambda a, j: (i != j) & (trimmed(r, a) == own)), lambda hit: hit)), lambda hit: hit)
    other = (there != "") & (here != "") & (there != here)
    return F.when(other, "").when(bad, F.when(exact, "exact_allele").otherwise("")).when(~meets, "").when(exact, "exact_allele").when(let(trimmed(ref, alt), pairs), "normalized_indel_allele").otherwise("")


def resolve_rsid(df: DataFrame, payload: str = "payload", chrom: str = "contig", pos: str = "pos") -> DataFrame:
    """Identifier of a variant from the records at its place that are the variant, with its status, the reason for it, and
    how many records and identifiers the place has."""
    c = F.col
    none = F.array().cast(f"array<{COLOCATED}>")
    out = df.withColumn("_all", F.coalesce(answer(df, payload)["colocated_variants"], none))
    out = out.withColumn("_all", F.transform("_all", lambda x: F.struct(normalize_rsid(x["id"]).alias("id"), colocated_match(x, c(chrom), c(pos).try_cast("bigint"), c("ref"), c("alt")).alias("kind"))))
    out = out.withColumn("_ids", F.array_distinct(F.filter(F.transform("_all", lambda x: x["id"]), lambda x: x != "")))
    out = out.withColumn("_hits", F.filter("_all", lambda x: (x["id"] != "") & (x["kind"] != "")))
    out = out.withColumns({"_exact": F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x["id"]))), "_indel": F.exists("_hits", lambda x: x["kind"] == "normalized_indel_allele")})
    own, one, many = (normalize_rsid(c("id")) != "") & F.array_contains("_exact", normalize_rsid(c("id"))), F.size("_exact") == 1, F.size("_exact") > 1
    status = F.when(own, "vcf_id_confirmed_by_vep_exact_allele").when(many, "ambiguous_multiple_exact_rsids").when(one & c("_indel"), "vep_colocated_normalized_indel").when(one, "vep_colocated_exact_allele").when(F.size("_ids") > 0, "vep_colocated_allele_mismatch").otherwise("unresolved_no_exact_rsid")
    reason = F.when(own, "vcf_id_and_vep_allele_match").when(many, "multiple_vep_colocated_allele_matches").when(one, "unique_vep_colocated_allele_match").when(F.size("_ids") > 0, "colocated_rsid_requires_coordinate_allele_reconciliation").otherwise("vep_response_has_no_colocated_rsid")
    rsid = F.when(own, normalize_rsid(c("id"))).when(one, F.element_at("_exact", 1)).otherwise("")
    return out.withColumns({"resolved_rsid": rsid, "rsid_status": status, "rsid_reason": reason, "colocated_count": F.size("_all").cast("bigint"), "colocated_rsid_count": F.size("_ids").cast("bigint")}).drop("_all", "_ids", "_hits", "_exact", "_indel")


def vep_only_class(error: Column, status: Column, functional: Column) -> Column:
    return F.when(error, "vep_error").when(status == "vep_colocated_allele_mismatch", "colocated_rsid_allele_mismatch").when(status == "ambiguous_multiple_exact_rsids", status).when(functional, "functional_annotation_without_exact_rsid").otherwise("no_usable_vep_annotation")


def variant_master(variants: DataFrame, *facts: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """One audit row a variant: key, place and alleles, how its identifier was resolved, what class it has without one, the
    main consequence and scores. variants: variant_key, assembly, contig, pos, ref, alt, id, target_gene, payload,
    module_row_count, populations, errors (names of sources that failed). The payload is parsed once. What variants lack of
    these may come from facts, frames whose first column is a column of variants and has each value once, with what their
    other columns are where a variant is not in them: they are joined when the payloads are gone, so that no payload goes
    through a shuffle."""
    c = F.col
    rows = parse_vep(resolve_rsid(with_answer(variants)))
    functional = (c("vep_hgvsc") != "") | (c("vep_hgvsp") != "") | (text(c("_answer.vrs")) != "")
    kept = ["variant_key", "assembly", "contig", "pos", "ref", "alt", "id", "target_gene", "errors", *[n for n in ("module_row_count", "populations") if n in variants.columns]]
    found = ["resolved_rsid", "rsid_status", "rsid_reason", "colocated_count", "colocated_rsid_count", "vep_status", "vep_most_severe_consequence", "vep_genes", "vep_hgvsc", "vep_hgvsp", "vep_cadd_phred", "vep_revel_score", "vep_spliceai"]
    rows = rows.select(*kept, *found, functional.alias("_functional"))
    for fact, absent in facts:
        rows = join_fact(rows, fact, absent)
    functional = c("_functional")
    fixed = {"chrom_vcf": c("contig"), "pos_vcf": c("pos"), "ref_vcf": c("ref"), "alt_vcf": c("alt"), "id_vcf": text(c("id"))}
    resolved = {
        "resolved_rsid": c("resolved_rsid"), "rsid_resolution_status": c("rsid_status"), "resolution_reason": c("rsid_reason"), "vep_only_class": vep_only_class(F.array_contains("errors", "vep"), c("rsid_status"), functional),
        "vep_only_fallback_query_mode": F.when(functional, "vrs_or_hgvs_available").otherwise("coordinate_only"), "vep_colocated_count": c("colocated_count"), "vep_colocated_rsid_count": c("colocated_rsid_count"),
    }
    told_by = {"vep_gene_symbols": c("vep_genes"), "ensembl_population_summary": text(c("populations")), "source_error_sources": F.array_join(F.array_sort("errors"), "|")}
    scores = ["vep_hgvsc", "vep_hgvsp", "vep_cadd_phred", "vep_revel_score", "vep_spliceai"]
    return rows.select("variant_key", "assembly", *[v.alias(n) for n, v in {**fixed, **resolved}.items()], "module_row_count", "vep_status", "vep_most_severe_consequence", *scores, *[v.alias(n) for n, v in told_by.items()])


def join_fact(rows: DataFrame, fact: DataFrame, absent: dict[str, Column]) -> DataFrame:
    """rows with the columns of fact, whose first column is their key. Identifiers of no meaning ('' and '.') and nulls,
    which most rows may have, name nothing: each such row has a key of its own, so they are dealt to all tasks."""
    key = fact.columns[0]
    named = fact.where(~text(F.col(key)).isin("", ".")).withColumnRenamed(key, "_key")
    own = F.when(text(F.col(key)).isin("", "."), F.concat(F.lit("\t"), "variant_key")).otherwise(F.col(key))
    out = rows.withColumn("_key", own).join(named, "_key", "left").drop("_key")
    return out.withColumns({n: F.coalesce(n, v) for n, v in absent.items()})


PGX_NOTES = "struct<data:array<struct<alleleGenotype:string,sentence:string,score:double,relatedChemicals:array<struct<name:string>>,literature:struct<crossReferences:array<struct<resource:string,resourceId:string>>>>>>"


def rows_of(payload: Column, schema: str, *path: str, most: int) -> Column:
    """The first most entries of a list inside a JSON text; no list gives an empty one."""
    found = F.from_json(payload, schema)
    for name in path:
        found = found[name]
    none = F.from_json(F.lit("".join(f'{{"{name}":' for name in path) + "[]" + "}" * len(path)), schema)
    for name in path:
        none = none[name]
    return F.coalesce(F.slice(found, 1, most), none)


def told(**parts: Column) -> Column:
    """name=value of the parts that have one, a semicolon between."""
    return F.concat_ws("; ", *[F.when(text(value) != "", F.concat(F.lit(f"{name}="), value)) for name, value in parts.items()])


def names_in(rows: Column, field: str) -> Column:
    return F.coalesce(F.transform(rows, lambda x: x[field]), F.array().cast("array<string>"))


def parse_gwas(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The first 20 associations: number, lowest p, traits, reported genes, and the eight first as text."""
    out = df.withColumn("_g", rows_of(F.col(payload), GWAS, "_embedded", "associations", most=20))
    p = lambda x: F.coalesce(x["pvalue"], x["pvalueMantissa"] * F.pow(F.lit(10.0), x["pvalueExponent"]))
    traits = lambda x: names_in(x["efoTraits"], "trait")
    genes = lambda x: F.flatten(F.transform(F.coalesce(x["loci"], F.array().cast("array<struct<authorReportedGenes:array<struct<geneName:string>>>>")), lambda y: names_in(y["authorReportedGenes"], "geneName")))
    number = lambda x: t.compact_number(x.cast("string"))
    effect = lambda x: F.when(x["betaNum"].isNotNull(), F.concat_ws(" ", F.concat(F.lit("beta="), number(x["betaNum"])), F.nullif(text(x["betaDirection"]), F.lit("")))).when(x["orPerCopyNum"].isNotNull(), F.concat(F.lit("OR="), number(x["orPerCopyNum"])))
    line = lambda x: F.concat_ws("; ", F.nullif(told(trait=t.unique_join(traits(x), 3, ","), p=number(p(x))), F.lit("")), effect(x), F.nullif(told(genes=t.unique_join(genes(x), 4, ",")), F.lit("")))
    return out.select(*df.columns, F.size("_g").cast("bigint").alias("n"), F.array_min(F.transform("_g", p)).alias("min_p"), t.unique_join(F.flatten(F.transform("_g", traits)), 12).alias("traits"), t.unique_join(F.flatten(F.transform("_g", genes)), 12).alias("genes"), t.unique_join(F.transform("_g", line), 8, " || ").alias("top_associations"))


def parse_clinvar(df: DataFrame, payload: str = "payload") -> DataFrame:
    out = df.withColumn("_c", F.from_json(payload, CLINVAR)["result"]["items"])
    each = lambda f: F.transform("_c", f)
    own = lambda x, old, new: F.coalesce(F.nullif(text(x[old]), F.lit("")), x["germline_classification"][new])
    columns = {
        "ids": t.unique_join(each(lambda x: x["uid"])), "titles": t.unique_join(each(lambda x: x["title"]), 3), "accessions": t.unique_join(each(lambda x: x["accession"]), 3, " | "),
        "classes": t.unique_join(each(lambda x: own(x, "clinical_significance", "description"))), "review": t.unique_join(each(lambda x: own(x, "review_status", "review_status"))),
        "record_types": t.unique_join(each(lambda x: x["record_type"]), 5, " | "), "traits": t.unique_join(F.flatten(each(lambda x: names_in(x["trait_set"], "trait_name")))),
    }
    return out.select(*df.columns, *[c.alias(n) for n, c in columns.items()])


def parse_pgx(df: DataFrame, payload: str = "payload", notes: str | None = None) -> DataFrame:
    """Clinical annotations (the first 12): levels, chemicals, phenotypes of alleles. With notes, the payload of variant
    annotations (the first 15): chemicals, sentences, literature."""
    out = df.withColumn("_p", rows_of(F.col(payload), PGX, "data", most=12))
    said = F.flatten(F.transform("_p", lambda x: F.transform(F.coalesce(x["allelePhenotypes"], F.array().cast("array<struct<allele:string,phenotype:string>>")), lambda y: F.concat(text(y["allele"]), F.lit(": "), F.left(text(y["phenotype"]), F.lit(220))))))
    columns = {"n": F.size("_p").cast("bigint"), "levels": t.unique_join(F.transform("_p", lambda x: x["levelOfEvidence"]["term"])), "chemicals": t.unique_join(F.flatten(F.transform("_p", lambda x: names_in(x["relatedChemicals"], "name")))), "phenotypes": t.unique_join(said, 8, " || ")}
    if notes:
        out = out.withColumn("_n", rows_of(F.col(notes), PGX_NOTES, "data", most=15))
        chemicals = lambda x: names_in(x["relatedChemicals"], "name")
        line = lambda x: told(genotype=x["alleleGenotype"], chemicals=t.unique_join(chemicals(x), 3, ","), sentence=F.left(x["sentence"], F.lit(240)), score=t.compact_number(x["score"].cast("string")))
        papers = lambda x: F.transform(F.filter(F.coalesce(x["literature"]["crossReferences"], F.array().cast("array<struct<resource:string,resourceId:string>>")), lambda y: y["resource"] == "PubMed"), lambda y: y["resourceId"])
        columns |= {"n_notes": F.size("_n").cast("bigint"), "note_chemicals": t.unique_join(F.flatten(F.transform("_n", chemicals)), 15, " | "), "notes_summary": t.unique_join(F.transform("_n", line), 10, " || "), "pmids": t.unique_join(F.flatten(F.transform("_n", papers)), 12, " | ")}
    return out.select(*df.columns, *[c.alias(n) for n, c in columns.items()])


VARIATION = "struct<name:string,var_class:string,most_severe_consequence:string,MAF:double,phenotypes:array<struct<trait:string>>,populations:array<struct<population:string,allele:string,frequency:double>>,mappings:array<struct<seq_region_name:string,start:bigint,end:bigint,allele_string:string>>>"
MYVARIANT = "struct<total:int,hits:array<struct<_id:string,_score:double,cadd:struct<phred:double>,dbsnp:struct<gene:struct<symbol:string>>,dbnsfp:struct<genename:string>,clinvar:struct<rcv:array<struct<accession:string,clinical_significance:string,review_status:string>>>>>>"


def parse_variation(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Class, consequence, eight phenotypes, twelve populations and the places of a variation record."""
    out = df.withColumn("_v", F.from_json(payload, VARIATION))
    people = F.transform(F.slice("_v.populations", 1, 12), lambda x: F.concat(F.lit("pop="), x["population"], F.lit("; allele="), x["allele"], F.lit("; freq="), x["frequency"].cast("string")))
    places = F.transform("_v.mappings", lambda x: F.concat(x["seq_region_name"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    return out.select(*[c for c in df.columns if c != payload], F.col("_v.var_class").alias("var_class"), F.col("_v.most_severe_consequence").alias("consequence"), F.col("_v.MAF").alias("maf"), t.unique_join(F.transform("_v.phenotypes", lambda x: x["trait"])).alias("phenotypes"), F.array_join(people, "|").alias("populations"), t.unique_join(places).alias("places"))


def parse_myvariant(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Number of hits and the best one: id, score, CADD, first accession."""
    out = df.withColumn("_m", F.from_json(payload, MYVARIANT)).withColumn("_h", F.get("_m.hits", F.lit(0)))
    return out.select(*[c for c in df.columns if c != payload], F.coalesce("_m.total", F.lit(0)).alias("hits"), text(F.col("_h._id")).alias("best_id"), F.col("_h._score").alias("score"), F.col("_h.cadd.phred").alias("cadd"), text(F.get("_h.clinvar.rcv", F.lit(0))["accession"]).alias("accession"), text(F.get("_h.clinvar.rcv", F.lit(0))["clinical_significance"]).alias("significance"), text(F.get("_h.clinvar.rcv", F.lit(0))["review_status"]).alias("review"), text(F.col("_h.dbsnp.gene.symbol")).alias("dbsnp_gene"), text(F.col("_h.dbnsfp.genename")).alias("dbnsfp_gene"))


def pick_transcript_legacy(transcripts: DataFrame) -> DataFrame:
    """Per gene the first MANE transcript, else the first canonical, else the first listed."""
    by = W.partitionBy("gene_id").orderBy(F.when(F.col("is_mane_select") == 1, 0).when(F.col("is_canonical") == 1, 1).otherwise(2), "transcript_id")
    return transcripts.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def merge_cache(writes: DataFrame) -> DataFrame:
    """The latest write of each (assembly, variant, source)."""
    by = W.partitionBy("assembly", "variant_key", "source").orderBy(F.desc("fetched_at"), F.desc("event_id"))
    return writes.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def cache_misses(variants: DataFrame, cache: DataFrame, now: str, days: int = 14) -> DataFrame:
    """variants (assembly, variant_key, source, fingerprint) without a fresh cache row of their fingerprint."""
    fresh = cache.where(F.col("fetched_at") + F.make_interval(days=F.lit(days)) > F.lit(now).cast("timestamp"))
    return variants.join(fresh, ["assembly", "variant_key", "source", "fingerprint"], "left_anti")


def source_status(error: Column, count: Column, counted: Column, has_id: Column, queried: Column) -> Column:
    return F.when(~queried, "not_queried").when(error, "source_error").when(counted & (count == 0) & ~has_id, "not_found").otherwise("success")


BASE_SCORES = {"mane_cds_overlap": 100, "splice_region_candidate": 95, "alternative_protein_coding_cds_overlap": 90, "protein_coding_exon_non_cds_overlap": 80, "utr_overlap": 60}
CLINVAR_SCORES = {"conflicting_pathogenicity": 40, "pathogenic_or_likely_pathogenic": 35, "drug_response": 30, "risk_factor": 20, "benign_or_likely_benign": 5}


def attention(df: DataFrame) -> DataFrame:
    """Adds attention_score and attention_reasons. Reads the region class and evidence columns by their names."""
    c = F.col
    region, clinvar = text(c("local_region_class")), text(c("clinvar_normalized_classification"))
    chosen = lambda value, scores, default: reduce(lambda a, kv: a.when(value == kv[0], F.lit(kv[1])), list(scores.items())[1:], F.when(value == list(scores)[0], F.lit(scores[list(scores)[0]]))).otherwise(default)
    base = chosen(region, BASE_SCORES, F.lit(40))
    cadd, revel, p = t.as_float(c("vep_cadd_phred")), t.as_float(c("vep_revel_score")), t.as_float(c("gwas_min_pvalue"), 1.0)
    rules = [
        (clinvar.isin(list(CLINVAR_SCORES)), chosen(clinvar, CLINVAR_SCORES, F.lit(0)), F.concat(F.lit("clinvar_"), clinvar)),
        (t.as_int(c("pharmgkb_clinical_annotation_count")) > 0, F.lit(25), F.lit("pharmgkb_clinical_annotation_count")),
        (t.as_int(c("pharmgkb_variant_annotation_count")) > 0, F.lit(10), F.lit("pharmgkb_variant_annotation_count")),
        (text(c("vep_spliceai")) != "", F.lit(20), F.lit("vep_spliceai")),
        (text(c("vep_hgvsp")) != "", F.lit(15), F.lit("vep_hgvsp")),
        (cadd >= 20, F.lit(15), F.lit("vep_cadd_phred_gte_20")),
        ((cadd >= 10) & (cadd < 20), F.lit(8), F.lit("vep_cadd_phred_gte_10")),
        (revel >= 0.75, F.lit(15), F.lit("vep_revel_score_gte_0_75")),
        ((revel >= 0.5) & (revel < 0.75), F.lit(8), F.lit("vep_revel_score_gte_0_50")),
        (F.lower(text(c("vep_alphamissense_pred"))).rlike("pathogenic|damaging"), F.lit(10), F.lit("vep_alphamissense_pred")),
        (t.as_int(c("gwas_association_count")) > 0, F.lit(5), F.lit("gwas_association_count")),
        ((p > 0) & (p <= 5e-8), F.lit(5), F.lit("gwas_min_pvalue_lte_5e_8")),
        (t.as_float(c("population_max_frequency")) >= 0.05, F.lit(-10), F.lit("population_max_frequency_gte_0_05")),
    ]
    score = reduce(lambda a, r: a + F.when(r[0], r[1]).otherwise(0), rules, base)
    first = F.concat(F.lit("base:"), F.when(region == "", "other").otherwise(region), F.lit("="), base.cast("string"))
    return df.withColumns({"attention_score": score, "attention_reasons": F.array_compact(F.array(first, *[F.when(r[0], r[2]) for r in rules]))})


def attention_rank(scored: DataFrame, group: list[str], last: list[str]) -> DataFrame:
    by = W.partitionBy(*group).orderBy(F.desc("attention_score"), F.coalesce("start", F.lit(10**15)), F.coalesce(F.nullif("rsid", F.lit("")), F.lit("~")), "ref_alt", *last)
    return scored.withColumn("attention_rank", F.row_number().over(by)).withColumn("group_size", F.count("*").over(W.partitionBy(*group)))


def focus_rows(ranked: DataFrame, group: list[str]) -> DataFrame:
    """Small groups whole; of larger ones the first twelve and those level with the twelfth, twenty at most."""
    twelfth = F.max(F.when(F.col("attention_rank") == 12, F.col("attention_score"))).over(W.partitionBy(*group))
    level = (F.col("attention_rank") <= 20) & (F.col("attention_score") == F.col("_twelfth"))
    return ranked.withColumn("_twelfth", twelfth).where((F.col("group_size") <= 25) | (F.col("attention_rank") <= 12) | level).drop("_twelfth")


def group_payloads(scored: DataFrame, group: list[str]) -> DataFrame:
    n = lambda cond: F.count(F.when(cond, 1))
    s = F.col("attention_score")
    return scored.groupBy(*group).agg(F.count("*").alias("size"), n(s >= 120).alias("bin_120"), n((s >= 100) & (s < 120)).alias("bin_100"), n((s >= 80) & (s < 100)).alias("bin_80"), n(s < 80).alias("bin_low"), F.max(s).alias("max_score"), F.bround(F.avg(s), 2).alias("mean_score"))


#: Of a group's rows in order: so many at most can be in focus, and so many of the others are named.
FOCUS_MOST, NAMED, SALTS = 25, 40, 64
COUNTED = {"local_region_class": "region_counts", "clinvar_normalized_classification": "clinvar_counts", "zygosity": "zygosity_counts"}


def first_rows(scored: DataFrame, group: list[str], last: list[str]) -> DataFrame:
    """The first rows of each group in attention order, enough for focus and names, with attention_rank. Rows are ranked
    within salts first, so no task sees a whole group."""
    order = [F.desc("attention_score"), F.coalesce("start", F.lit(10**15)), F.coalesce(F.nullif("rsid", F.lit("")), F.lit("~")), "ref_alt", *last]
    most = FOCUS_MOST + NAMED
    rank = lambda by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("rsid", "start", "ref_alt", *last), F.lit(SALTS)))
    near = salted.withColumn("_r", rank([*group, "_salt"])).where(F.col("_r") <= most).drop("_r", "_salt")
    return near.withColumn("attention_rank", rank(group)).where(F.col("attention_rank") <= most)


def group_documents(scored: DataFrame, group: list[str], ref: Column, last: list[str]) -> DataFrame:
    """One row a group: counts of all rows by class, ClinVar and zygosity (JSON, values in order, blank ones left out), score
    bins, signals, mean and maximum, the rows in focus, and of those outside it (remaining_*) the counts, signals and the
    first references. Counts come from pre-aggregated long rows; what remains is the total less the focus."""
    c = F.col
    pgx = (t.as_int(c("pharmgkb_clinical_annotation_count")) > 0) | (t.as_int(c("pharmgkb_variant_annotation_count")) > 0)
    signals = {"pgx_signal_rows": pgx, "hgvsp_rows": text(c("vep_hgvsp")) != "", "spliceai_rows": text(c("vep_spliceai")) != "", "cadd_gte_20_rows": t.as_float(c("vep_cadd_phred")) >= 20, "revel_gte_0_75_rows": t.as_float(c("vep_revel_score")) >= 0.75}
    whole = {"clinvar_conflict_rows": c("clinvar_normalized_classification") == "conflicting_pathogenicity", "population_common_rows": t.as_float(c("population_max_frequency")) >= 0.05}
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    s = c("attention_score")
    bins = {"bin_120": s >= 120, "bin_100": (s >= 100) & (s < 120), "bin_80": (s >= 80) & (s < 100), "bin_low": s < 80}
    totals = scored.groupBy(*group).agg(F.count("*").alias("size"), *[n(v, k) for k, v in {**bins, **signals, **whole}.items()], F.max(s).cast("bigint").alias("max_score"), F.round(F.avg(s), 2).alias("mean_score"))
    first = first_rows(scored, group, last).join(totals.select(*group, "size"), group)
    level = F.max(F.when(c("attention_rank") == 12, s)).over(W.partitionBy(*group))
    first = first.withColumn("_focus", (c("size") <= FOCUS_MOST) | (c("attention_rank") <= 12) | ((c("attention_rank") <= 20) & (s == level)))
    focus = first.where("_focus")
    listed = lambda cond, most: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(cond, F.struct(c("attention_rank").alias("k"), ref.alias("ref"))))), 1, most), lambda x: x["ref"]), "|")
    named = first.groupBy(*group).agg(n(c("_focus"), "focus_count"), listed(c("_focus"), FOCUS_MOST).alias("focus_refs"), listed(~c("_focus"), NAMED).alias("remaining_refs"), *[n(c("_focus") & v, f"_{k}") for k, v in signals.items()])
    long = lambda df, sign: df.select(*group, F.explode(F.array(*[F.struct(F.lit(v).alias("of"), text(c(k)).alias("value")) for k, v in COUNTED.items()])).alias("x")).where("x.value <> ''").groupBy(*group, "x.of", "x.value").agg(F.count("*").alias("n")).withColumn("sign", F.lit(sign))
    by_value = long(scored, 1).unionByName(long(focus, -1)).groupBy(*group, "of", "value").agg(F.sum(F.when(c("sign") == 1, c("n"))).alias("n"), F.sum(c("n") * c("sign")).alias("left"))
    as_json = lambda of, name: F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when((c("of") == of) & (c(name) > 0), F.struct(c("value"), c(name)))))))
    maps = by_value.groupBy(*group).agg(*[as_json(v, "n").alias(v) for v in COUNTED.values()], *[as_json(v, "left").alias(f"remaining_{v}") for v in COUNTED.values()])
    out = totals.join(named, group).join(maps, group, "left")
    gone = {f"remaining_{k}": c(k) - c(f"_{k}") for k in signals}
    return out.withColumns({**gone, "summarized_count": c("size") - c("focus_count"), **{m: F.coalesce(m, F.lit("{}")) for m in maps.columns if m not in group}}).drop(*[f"_{k}" for k in signals])


def grouping_summary(documents: DataFrame) -> DataFrame:
    """Totals over all groups: sizes, mean size, rows in focus and only summarised."""
    n = lambda cond: F.count(F.when(cond, 1))
    c = F.col
    return documents.agg(F.count("*").alias("groups"), F.max("size").alias("largest"), F.round(F.avg("size"), 2).alias("mean_size"), n(c("size") == 1).alias("singletons"), n(c("size") > FOCUS_MOST).alias("large"), F.sum("size").alias("n_rows"), F.sum("focus_count").alias("focus_rows"), F.sum("summarized_count").alias("summarized_rows"))


def interpretation_readiness(columns: dict[str, Column], confidence: Column) -> Column:
    """How well a row can be interpreted, with the kinds of evidence that it has. A column that is not given has none."""
    has = lambda name, *none: ~text(columns.get(name, F.lit(""))).isin("", *none)
    kinds = {
        "canon_context": has("canon_effect"), "hgvs": has("vep_hgvsp") | has("vep_hgvsc"), "deleteriousness_scores": has("vep_cadd_phred") | has("vep_revel_score") | has("vep_alphamissense_score"),
        "clinvar": has("clinvar_normalized_classification", "not_reported"), "gwas": has("gwas_association_count", "0"), "pharmacogenomics": has("pharmgkb_clinical_annotation_count", "0") | has("pharmgkb_variant_annotation_count", "0"), "population_frequency": has("population_frequency_summary"),
    }
    def said(flags: Column) -> Column:
        level = F.when((confidence == "High") & (F.size(flags) >= 4), "high").when(F.size(flags) >= 3, "moderate").otherwise("limited")
        return F.concat(level, F.lit("_interpretability: "), F.when(F.size(flags) == 0, "minimal_external_context").otherwise(F.array_join(flags, ", ")))

    return let(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in kinds.items()])), said)


# ---- interpretation rows


# Why a duplicate group got its confidence.
DUPLICATE_REASONS = (
    "Duplicate group normalized to Conflicting because one row has material evidence conflict.",
    "Duplicate group normalized to Moderate because the same observed variant has locus/gene ambiguity.",
    "Duplicate group normalized to the majority confidence across repeated module rows.",
    "Duplicate group normalized to Moderate because repeated module rows disagreed without a majority.",
    "Duplicate group normalized conservatively because repeated module rows disagreed.",
)


def duplicate_keys() -> dict[str, Column]:
    return {"k_gene": F.upper("gene"), "k_rsid": F.lower("rsid"), "k_gt": F.upper("observed_genotype"), "k_zyg": F.lower("zygosity"), "k_alt": F.upper("ref_alt")}


def duplicate_confidence(df: DataFrame) -> DataFrame:
    """One row a duplicate group: what its repeated rows agree on and why, null where they never differed."""
    keys = duplicate_keys()
    rows = df.withColumns(keys)
    by = [*keys]
    level = F.col("final_confidence_level")
    counts = rows.groupBy(*by, "final_confidence_level").agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max(t.as_bool(F.col("gene_or_locus_ambiguity_flag")).cast("int")).alias("amb"))
    top = F.max_by("final_confidence_level", F.struct(F.col("n"), (-F.col("first")).alias("f")))
    rank = F.when(level == "Low", 1).when(level == "Moderate", 2).when(level == "High", 3).otherwise(4)
    g = counts.groupBy(*by).agg(F.count("*").alias("levels"), F.sum("n").alias("rows"), F.max(F.when(level == "Conflicting", 1).otherwise(0)).alias("conf"), F.max("amb").alias("amb"), top.alias("mode"), F.max("n").alias("mode_n"), F.min(rank).alias("lo"), F.max(rank).alias("hi"))
    two = (F.col("lo") == 2) & (F.col("hi") == 3)
    lowest = F.when(F.col("lo") == 1, "Low").when(F.col("lo") == 2, "Moderate").otherwise("High")
    new = F.when(F.col("levels") <= 1, F.lit(None)).when(F.col("conf") == 1, "Conflicting").when(F.col("amb") == 1, "Moderate").when(F.col("mode_n") > 1, F.col("mode")).when(two, "Moderate").otherwise(lowest)
    why = F.when(F.col("levels") <= 1, F.lit(None)).when(F.col("conf") == 1, DUPLICATE_REASONS[0]).when(F.col("amb") == 1, DUPLICATE_REASONS[1]).when(F.col("mode_n") > 1, DUPLICATE_REASONS[2]).when(two, DUPLICATE_REASONS[3]).otherwise(DUPLICATE_REASONS[4])
    return g.select(*by, "rows", new.alias("confidence"), why.alias("reason"))


def map_axis(categories: DataFrame, patterns: DataFrame, unknown: str = "uncategorized_context") -> DataFrame:
    """Each different category's first axis with a pattern that it contains. patterns: a small fixed list."""
    norm = categories.select("category").distinct().withColumn("_n", t.match_text(F.col("category")))
    hit = norm.join(F.broadcast(patterns), F.contains("_n", F.col("pattern")), "left")
    return hit.groupBy("category").agg(F.coalesce(F.min_by("axis_id", "axis_order"), F.lit(unknown)).alias("axis_id"))


def dominant_confidence(high: Column, moderate: Column, conflicting: Column) -> Column:
    return F.when(conflicting > 0, "Conflicting").when((high >= 2) | ((high >= 1) & (moderate >= 2)), "High").when((high > 0) | (moderate >= 2), "Moderate").otherwise("Low")


def axis_strength(conflicting: Column, rsids: Column, genes: Column, low: Column, rows: Column) -> Column:
    return F.when(conflicting > 0, "review_with_caution").when((rsids >= 5) & (genes >= 4) & (low < rows), "strong").when((rsids >= 2) & (genes >= 2), "moderate").otherwise("limited")


def distribution(rows: DataFrame, by: list[str]) -> DataFrame:
    level = F.col("final_confidence_level")
    n = lambda name: F.count(F.when(level == name, 1))
    out = rows.groupBy(*by).agg(F.count("*").alias("rows"), n("High").alias("high"), n("Moderate").alias("moderate"), n("Low").alias("low"), n("Conflicting").alias("conflicting"), F.count_distinct("rsid").alias("rsids"), F.count_distinct("gene").alias("genes"))
    return out.withColumns({"suggested_confidence": dominant_confidence(F.col("high"), F.col("moderate"), F.col("conflicting")), "strength": axis_strength(F.col("conflicting"), F.col("rsids"), F.col("genes"), F.col("low"), F.col("rows"))})


def review_priority(level: Column, conflict: Column, review: Column, ambiguity: Column) -> Column:
    return F.when((level == "Conflicting") | conflict, "high").when(review | ambiguity, "medium").otherwise("low")


MIX = {"functional_or_coding": "missense|coding|protein|synonymous|hgvsp", "regulatory_or_intronic": "intron|upstream|downstream|regulatory|modifier", "pharmacogenomic": "pharmgkb|pharmacogen|drug|medication|pgx", "gwas_or_associative": "gwas|association|associative|risk factor", "clinvar_or_clinical_database": "clinvar|clinical|benign|pathogenic|conflicting"}


#: Texts of an interpretation row in which kinds of evidence are looked for.
MIX_TEXTS = ("technical_interpretation_en", "technical_interpretation_es", "confidence_rationale_en", "confidence_rationale_es", "technical_notes_en", "technical_notes_es", "recommended_next_review_step_en", "recommended_next_review_step_es", "evidence_used")


def mix_counts(columns: list[str]) -> list[Column]:
    """Rows of a group by the kinds of evidence that any of MIX_TEXTS speaks of, and those that are flagged."""
    blob = F.lower(F.concat_ws(" ", *[text(F.col(n)) for n in MIX_TEXTS if n in columns]))
    flagged = t.as_bool(F.col("requires_professional_review")) | t.as_bool(F.col("gene_or_locus_ambiguity_flag"))
    return [*[F.count(F.when(blob.rlike(p), 1)).alias(n) for n, p in MIX.items()], F.count(F.when(flagged, 1)).alias("technical_review_flags")]


def evidence_mix(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*mix_counts(rows.columns))


#: Lists of a report group, by the column that they come from.
MEMBERS = {"category": "category", "gene": "gene", "rsid": "rsid", "row_id": "row_id"}


def report_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """distribution() of each group with the number of its categories and its evidence mix."""
    mix = rows.groupBy(*by).agg(F.count_distinct("category").alias("categories"), *mix_counts(rows.columns))
    return distribution(rows, by).join(mix, by)


def group_members(rows: DataFrame, by: list[str]) -> DataFrame:
    """The lists of each group in long form, one row a different value: a group may hold most of all rows, so no list is
    ever put together in one place."""
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in MEMBERS.items() if c not in by]))
    return rows.select(*by, long.alias("x")).select(*by, "x.kind", "x.value").where("value <> ''").distinct()


def repeated_rsids(rows: DataFrame) -> DataFrame:
    """Identifiers in more than one row: their genes and categories in order, whether all genotypes are one, distribution. Row
    ids are in group_members(rows, ["rsid"])."""
    listed = lambda name: F.array_join(F.array_sort(F.collect_set(name)), "|")
    lists = rows.groupBy("rsid").agg(listed("gene").alias("gene_values"), listed("category").alias("categories"), (F.count_distinct("observed_genotype") <= 1).alias("same_genotype"))
    return distribution(rows, ["rsid"]).where("rows > 1").select("rsid", "rows", "high", "moderate", "low", "conflicting").join(lists, "rsid")


def flag_lists(rows: DataFrame) -> DataFrame:
    """Conflicting, professional-review and ambiguous rows, each with its reason: the list's own text, else the notes."""
    c = F.col
    own = lambda *names: F.coalesce(*[F.nullif(t.clean_str(c(n), "nbsp"), F.lit("")) for n in names], F.lit(""))
    lists = {
        "conflicting": ((c("final_confidence_level") == "Conflicting") | t.as_bool(c("evidence_conflict_flag")), own("confidence_rationale_en", "technical_notes_en")),
        "professional_review": (t.as_bool(c("requires_professional_review")), own("recommended_next_review_step_en", "technical_notes_en")), "ambiguity": (t.as_bool(c("gene_or_locus_ambiguity_flag")), own("technical_notes_en")),
    }
    each = F.explode(F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(n).alias("list"), why.alias("reason"))) for n, (cond, why) in lists.items()])))
    return rows.select("gene", "rsid", "row_id", each.alias("x")).select("x.list", "gene", "rsid", "row_id", "x.reason")


def report_readiness(rows: DataFrame, unknown: str = "uncategorized_context") -> DataFrame:
    """What stands in the way of a report, from rows with their axis: blockers in order, and the two readiness values."""
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    c = F.col
    counts = rows.agg(n((c("final_confidence_level") == "Conflicting") | t.as_bool(c("evidence_conflict_flag")), "conflicting"), n(c("axis_id") == unknown, "unmapped"), n(t.as_bool(c("gene_or_locus_ambiguity_flag")), "ambiguous"))
    blockers = F.concat_ws("|", F.when(c("conflicting") > 0, F.lit("conflicting_variant_evidence_present")), F.when(c("unmapped") > 0, F.lit("unmapped_canon_categories_present")), F.when(c("ambiguous") > 0, F.lit("gene_or_locus_ambiguities_present")))
    out = counts.withColumn("blockers", blockers)
    return out.withColumns({"informational_report_readiness": F.when(c("unmapped") == 0, "ready").otherwise("ready_with_minor_review"), "clinical_use_readiness": F.when(c("blockers") == "", "contextual_review_only").otherwise("needs_professional_review")})

