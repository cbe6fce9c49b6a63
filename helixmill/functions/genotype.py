"""Column functions over variant-call fields: contigs, genotypes, alleles, intervals, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Contigs that the engine takes.
SUPPORTED = [*(f"chr{i}" for i in range(1, 23)), "chrX", "chrY", "chrM"]


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def norm_chrom(c: Column, mito: str = "M") -> Column:
    """chr1 .. chrX, chrM whatever the label's case and prefix; empty stays empty."""
    bare = F.regexp_replace(F.upper(F.trim(text(c))), "^CHR", "")
    other = "MT" if mito == "M" else "M"
    named = F.when(bare == other, F.lit(mito)).otherwise(bare)
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit("chr"), named))


def norm_chrom_legacy(c: Column) -> Column:
    return norm_chrom(c, "MT")


def is_supported_contig(c: Column) -> Column:
    return norm_chrom(c).isin(SUPPORTED)


def is_symbolic(alt: Column) -> Column:
    alt = text(alt)
    return alt.isin("", "*", ".") | (alt.startswith("<") & alt.endswith(">")) | F.contains(alt, F.lit("[")) | F.contains(alt, F.lit("]"))


def extract_gt(fmt: Column, sample: Column) -> Column:
    at = F.array_position(F.split(text(fmt), ":"), "GT").cast("int")
    return F.when(at > 0, text(F.get(F.split(text(sample), ":"), at - 1))).otherwise("")


def split_gt(gt: Column) -> Column:
    """The called indexes; an empty call has none."""
    return F.when(text(gt) == "", F.array().cast("array<string>")).otherwise(F.split(gt, "[/|]"))


def is_partial(gt: Column) -> Column:
    parts = split_gt(gt)
    return (F.size(parts) == 0) | F.exists(parts, lambda x: x.isin("", "."))


def classify_gt(gt: Column) -> Column:
    parts = split_gt(gt)
    return F.when(is_partial(gt), "missing_or_partial").when(F.size(parts) != 2, "non_diploid").when(F.forall(parts, lambda x: x == "0"), "hom_ref").when(parts[0] == parts[1], "hom_alt").otherwise("heterozygous")


def zygosity(gt: Column) -> Column:
    parts = split_gt(gt)
    return F.when(is_partial(gt), "unknown").when(F.size(parts) != 2, "non_diploid_or_complex").when(parts[0] == parts[1], "homozygous").otherwise("heterozygous")


def zygosity_alt(gt: Column, copies: Column) -> Column:
    return F.when(is_partial(gt), "unknown").when(F.size(split_gt(gt)) != 2, "non_diploid_or_complex").when(copies == 2, "homozygous").when(copies == 1, "heterozygous").otherwise("reference_only")


def dosage(gt: Column, alt_index: Column) -> Column:
    return F.size(F.filter(split_gt(gt), lambda x: x.try_cast("int") == alt_index))


def gt_alleles(gt: Column, ref: Column, alt: Column) -> Column:
    bases = F.concat(F.array(ref), F.split(alt, ","))
    named = lambda x: F.when(x == ".", F.lit(".")).otherwise(F.coalesce(F.get(bases, F.when(x.try_cast("int") >= 0, x.try_cast("int")).otherwise(F.lit(1 << 20))), F.lit("?")))
    return F.array_join(F.transform(split_gt(gt), named), "/")


def variant_key(assembly: Column, chrom: Column, start: Column, ref: Column, alt: Column) -> Column:
    plain = F.concat_ws("|", assembly, chrom, start.cast("string"), F.upper(ref), F.upper(alt))
    return F.concat(F.lit("v2_"), F.substring(F.sha2(plain, 256), 1, 24))


def parse_info(c: Column) -> Column:
    """Keys and values as a map; a flag is "true"; of a key given twice the last value counts."""
    def pairs(parts: Column) -> Column:
        entries = F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.contains(x, F.lit("=")), F.substr(x, F.instr(x, "=") + 1)).otherwise("true").alias("value")))
        return let(entries, lambda e: F.map_from_entries(F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda later: later["key"] == x["key"]))))

    return let(F.filter(F.split(text(c), ";"), lambda x: ~x.isin("", ".")), pairs)


def variant_end(pos: Column, ref: Column, info: Column) -> Column:
    # most records have no END, and only those that may are cut into keys
    end = F.when(F.contains(text(info), F.lit("END=")), F.try_element_at(parse_info(info), F.lit("END")).try_cast("bigint"))
    return F.coalesce(end, pos + F.greatest(F.lit(1), F.length(ref)) - 1)


def interval_warning(info: Column, alt: Column) -> Column:
    end = F.try_element_at(parse_info(info), F.lit("END"))
    return F.concat_ws("|", F.when(end.isNotNull() & end.try_cast("bigint").isNull(), F.lit("invalid_end")), F.when(is_symbolic(alt), F.lit("symbolic_alt")))


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.least(b, d) >= F.greatest(a, c)


def orig_part(info: Column, k: int, own: Column) -> Column:
    """Field k of the normaliser's ORIG note, or the row's own value where the note is missing or short."""
    parts = F.split(text(F.try_element_at(parse_info(info), F.lit("ORIG"))), r"\|")
    return F.when(F.size(parts) >= 4, F.coalesce(F.get(parts, F.lit(k)), own)).otherwise(own)


def quality_flag(c: Column) -> Column:
    return F.when(text(c).isin("", ".", "PASS"), "pass").otherwise("filtered")


def is_snv(ref: Column, alt: Column) -> Column:
    alts = F.filter(F.split(text(alt), ","), lambda x: x != "")
    return (F.length(ref) == 1) & F.forall(alts, lambda x: F.length(x) == 1)


def compare_ref(expected: Column, observed: Column) -> Column:
    return F.when(text(expected) == "", "missing_expected_ref").when(text(observed) == "", "missing_vcf_ref").when(F.upper(expected) == F.upper(observed), "ref_match").otherwise("ref_mismatch")


def allele_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.upper(text(c)), ","), lambda x: F.trim(x)), lambda x: x != ""))


def compare_alt(expected: Column, observed: Column) -> Column:
    e, o = allele_set(expected), allele_set(observed)
    return F.when(F.size(e) == 0, "missing_expected_alt").when(F.size(o) == 0, "missing_vcf_alt").when((F.size(F.array_except(e, o)) == 0) & (F.size(F.array_except(o, e)) == 0), "alt_exact_match").when(F.arrays_overlap(e, o), "alt_partial_overlap").otherwise("alt_mismatch")


def joined_key(sep: str, *parts: Column) -> Column:
    """Parts with sep between, empty if a part is missing."""
    missing = None
    for p in parts:
        missing = (text(p) == "") if missing is None else missing | (text(p) == "")
    return F.when(missing, "").otherwise(F.concat_ws(sep, *parts))


def extract_rsids(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(r"(?i)\b(rs[0-9]+)\b"), F.lit(1)), F.lower))


def first_rsid(c: Column) -> Column:
    return text(F.array_min(extract_rsids(c)))


def normalize_rsid(c: Column) -> Column:
    t = F.lower(F.trim(text(c)))
    return F.when(t.rlike("^rs[0-9]+$"), t).otherwise("")


def allele_signature(ref: Column, alt: Column) -> Column:
    """ref and alt without common prefix, then suffix, each at least one base long: prefix length, ref, alt."""
    def common(r: Column, a: Column, side) -> Column:
        most = F.least(F.length(r), F.length(a)) - 1
        return F.when(most > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: side(r, i) == side(a, i)))).otherwise(0)

    left = lambda s, i: F.substr(s, F.lit(1), i)
    right = lambda s, i: F.substr(s, F.length(s) - i + 1, i)
    def trimmed(x: Column) -> Column:
        r, a = F.substr(x["r"], x["k"] + 1), F.substr(x["a"], x["k"] + 1)
        return let(F.struct(x["k"].alias("k"), r.alias("r"), a.alias("a"), common(r, a, right).alias("s")), lambda y: F.struct(y["k"].alias("prefix"), F.substr(y["r"], F.lit(1), F.length(y["r"]) - y["s"]).alias("ref"), F.substr(y["a"], F.lit(1), F.length(y["a"]) - y["s"]).alias("alt")))

    r, a = F.upper(text(ref)), F.upper(text(alt))
    return let(F.struct(r.alias("r"), a.alias("a"), common(r, a, left).alias("k")), trimmed)


def exact_allele(allele_string: Column, ref: Column, alt: Column) -> Column:
    parts = F.split(F.upper(text(allele_string)), r"[|/,]")
    return F.array_contains(parts, F.upper(ref)) & F.array_contains(parts, F.upper(alt))


def observed_alts(alleles: Column, ref: Column) -> Column:
    parts = F.filter(F.split(F.upper(text(alleles)), "[/|,]"), lambda x: ~x.isin("", ".", "?"))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != F.upper(ref)))), ",")


def genotype_display(alleles: Column) -> Column:
    parts = F.split(text(alleles), "/")
    return F.when(F.trim(text(alleles)) == "", "NA").when(F.forall(parts, lambda x: F.length(x) == 1), F.array_join(parts, "")).otherwise(alleles)


def ref_alt_display(vcf_ref: Column, vcf_alt: Column, ref: Column, alt: Column) -> Column:
    pair = lambda r, a: F.when((text(r) != "") & (text(a) != ""), F.concat_ws("/", r, a))
    return F.coalesce(pair(vcf_ref, vcf_alt), pair(ref, alt), F.lit("NA"))


def variant_ref(rsid: Column, chrom: Column, start: Column, ref: Column, alt: Column, own_id: Column) -> Column:
    place = F.concat(chrom, F.lit(":"), start.cast("string"), F.lit(":"), ref, F.lit(">"), alt)
    return F.when(~text(rsid).isin("", "."), rsid).when((text(chrom) != "") & start.isNotNull() & (text(ref) != "") & (text(alt) != ""), place).otherwise(own_id)
