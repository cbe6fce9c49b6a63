"""Column functions over text, numbers and small lists."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.functions.genotype import let, text

# What plain text uses for typographic characters.
ASCII_FORMS = {
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "–": "-",
    "—": "-",
    "…": "...",
    "µ": "u",
    "μ": "u",
    "β": "beta",
}
# Hints that a cell names a category.
CATEGORY_HINTS = (
    "adhd",
    "detox pathways",
    "detox / toxin load / emf sensitivity",
    "foundational systems resilience",
    "gut brain & microbiome resiliance",
    "gut-brain axis",
    "gut microbiome-neuroimmune interaction",
    "histamine & mast cell regulation",
    "immune & autoimmune risks",
    "immune function & autoimmunity",
    "language/cognition",
    "metabolic health & insulin sensitivity",
    "methylation, folate, & nutrient",
    "mitochondria & energy",
    "neurodevelopment foundations",
    "neurotransmitter",
    "nutrient processing",
    "nutrient_absorption & metabolism",
    "sensory processing",
    "sleep",
    "sleep & circadian biology",
    "sleep & circadian rhythm",
    "social processing",
    "stress reactivity & regulation",
)
# Phrases that name a measured substance, consequences outside coding sequence, and what parts of a sentence
# stand between, by language.
BIOMARKERS = ("serum ige", "ige amount", "ige level", "ige levels", "plasma metabolite", "serum metabolite", "blood metabolite", "enzyme activity", "biomarker concentration")
NONCODING = ("intron_variant", "intergenic_variant", "upstream_gene_variant", "downstream_gene_variant", "5_prime_utr_variant", "3_prime_utr_variant", "regulatory_region_variant")
SEPARATORS = {"en": ("; ", " but ", " and that ", " and should ", ", but "), "es": ("; ", " pero ", " y que ", " y debe ", ", pero ")}


#: Characters that count as blank at the ends of a value.
BLANK = " \t\n\r\x0b\x0c\u00a0"
#: Of ASCII, those that Python takes off the ends of a text.
ASCII_BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def strip(c: Column) -> Column:
    return F.btrim(text(c), F.lit(BLANK))


def clean_str(c: Column, mode: str = "trim") -> Column:
    t = strip(c)
    if mode == "null_words":
        return F.when(F.lower(t).isin("nan", "none", "<na>"), "").otherwise(t)
    if mode == "collapse":
        return F.regexp_replace(t, r"\s+", " ")
    if mode == "nbsp":
        return strip(F.replace(t, F.lit("\u00a0"), F.lit(" ")))
    return t


def first_present(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(clean_str(c, "null_words"), F.lit("")) for c in columns], F.lit(""))


def as_bool(c: Column, option: bool = False) -> Column:
    return F.lower(F.trim(text(c))).isin("true", "1", "yes", "y", *["on"] * option)


def as_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(text(c)).try_cast("double"), F.lit(default))


def as_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(text(c)).try_cast("double").cast("bigint"), F.lit(default).cast("bigint"))


def unique_list(values: Column, limit: int = 8) -> Column:
    """Different cleaned values in order, so many at most."""
    cleaned = F.transform(values, lambda x: clean_str(x, "null_words"))
    return F.slice(F.array_distinct(F.filter(cleaned, lambda x: x != "")), 1, limit)


def unique_join(values: Column, limit: int = 8, sep: str = "|") -> Column:
    return F.array_join(unique_list(values, limit), sep)


def pipe_display(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(text(c), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(parts, " | ")


def compact_number(c: Column) -> Column:
    """Six significant digits without trailing zeros; scientific when tiny or large; text that is no number as it is."""
    t = F.trim(text(c))
    x = t.try_cast("double")
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.abs(x))).cast("int"))
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", F.bround(x * F.pow(F.lit(10.0), digits), 0) / F.pow(F.lit(10.0), digits)), "0+$", ""), r"\.$", "")
    small = (F.abs(x) < 0.001) | (F.abs(x) >= 1e5)
    return F.when(x.isNull(), t).when(x == 0, "0").when(small, scientific(x)).otherwise(fixed)


def scientific(x: Column) -> Column:
    """x as C's %.3e has it: the exact binary value decides, and a tie goes to the even digit. format_string would round the
    shortest decimal form, and ties up. format_number is exact but for whole numbers, whose ties are set right before."""
    whole = F.when((F.abs(x) >= 1e5) & (F.abs(x) < float(1 << 63)) & (x == F.rint(x)), F.abs(x).cast("bigint"))
    step = F.pow(F.lit(10.0), F.length(whole.cast("string")) - 4).cast("bigint")
    even = F.floor(whole / step) % 2 == 0
    aside = F.when(whole % step * 2 == step, F.signum(x) * F.when(even, -step / 4).otherwise(step / 4)).otherwise(0.0)
    exact = F.call_function("format_number", x + aside, F.lit("0.000E00"))
    return F.when(F.abs(x) < float("inf"), F.replace(F.replace(exact, F.lit("E"), F.lit("e+")), F.lit("e+-"), F.lit("e-"))).otherwise(F.format_string("%.3e", x))


def sorted_json(values: dict[str, Column]) -> Column:
    """JSON of named values, keys in order, so that the same values always give the same text."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))


def compact_json(values: dict[str, Column], most: int = 12000) -> Column:
    out = sorted_json(values)
    return F.when(F.length(out) > most, F.concat(F.left(out, F.lit(most)), F.lit("...[truncated]"))).otherwise(out)


def fingerprint(values: dict[str, Column]) -> Column:
    return F.sha2(sorted_json(values), 256)


def population_max(c: Column) -> Column:
    """(population, allele, frequency, n) of the chunk with the highest frequency, the first on ties."""
    chunks = F.filter(F.split(text(c), r"\|"), lambda x: F.contains(x, F.lit("freq=")))
    field = lambda x, name: F.regexp_extract(x, rf"(?:^|;)\s*{name}=([^;]*)", 1)
    rows = F.filter(F.transform(chunks, lambda x, i: F.struct(F.trim(field(x, "freq")).try_cast("double").alias("freq"), (-i).alias("order"), F.trim(field(x, "pop")).alias("pop"), F.trim(field(x, "allele")).alias("allele"))), lambda r: r["freq"].isNotNull())
    return let(rows, lambda r: F.struct(F.array_max(r)["pop"].alias("pop"), F.array_max(r)["allele"].alias("allele"), F.array_max(r)["freq"].alias("freq"), F.size(r).alias("n")))


def clinvar_class(c: Column) -> Column:
    t = F.lower(F.trim(text(c)))
    has = lambda w: F.contains(t, F.lit(w))
    return F.when(t == "", "not_reported").when(has("pathogenic") & has("conflicting"), "conflicting_pathogenicity").when(has("pathogenic"), "pathogenic_or_likely_pathogenic").when(has("uncertain") | has("vus"), "uncertain_significance").when(has("drug response"), "drug_response").when(has("risk factor"), "risk_factor").when(has("benign"), "benign_or_likely_benign").otherwise("other_reported")


def clinvar_strength(c: Column) -> Column:
    t = F.lower(F.trim(text(c)))
    has = lambda w: F.contains(t, F.lit(w))
    return F.when(t == "", "not_reported").when(has("practice guideline"), "practice_guideline").when(has("expert panel"), "expert_panel").when(has("multiple submitters") & has("no conflicts"), "multiple_submitters_no_conflicts").when(has("conflicting"), "conflicting").when(has("single submitter"), "single_submitter").otherwise("limited")


def clinvar_conflict(classification: Column, review: Column) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", text(classification), text(review))), F.lit("conflict"))


def norm_gene_symbol(c: Column) -> Column:
    t = F.replace(F.replace(F.upper(text(c)), F.lit(" "), F.lit("")), F.lit("Β"), F.lit("BETA"))
    return F.regexp_replace(t, "[^A-Z0-9._-]", "")


def extract_gene(c: Column) -> Column:
    token = norm_gene_symbol(F.regexp_extract(F.trim(text(c)), r"^([^\s(/]*)", 1))
    return F.when(token.rlike("^[A-Z0-9][A-Z0-9._-]{1,24}$") & ~token.startswith("RS"), token).otherwise("")


def extract_category(cell: Column, after: Column, n_rsids: Column) -> Column:
    t = clean_str(cell, "collapse")
    low = F.lower(t)
    hinted = F.exists(F.array(*[F.lit(h) for h in CATEGORY_HINTS]), lambda h: F.contains(low, h) | F.contains(h, low))
    return F.when((t == "") | low.rlike("^rs[0-9]+$"), "").when((n_rsids > 0) & (extract_gene(after) != ""), t).when(hinted, t).otherwise("")


def slug(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(t == "", "unknown").otherwise(t)


def _plain():
    """A function that goes to tasks whole, as they may not have this module."""
    def plain(x: str) -> str:
        """Typographic forms replaced, then accents taken off: what no built-in function gives."""
        x = x.replace("\u00a0", " ").strip()
        for a, b in ASCII_FORMS.items():
            x = x.replace(a, b)
        return unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()

    return plain


plain = _plain()


@F.pandas_udf(T.StringType())
def plain_letters(values: pd.Series) -> pd.Series:
    return values.map(plain, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def plain_lists(values: pd.Series) -> pd.Series:
    return values.map(lambda xs: [plain(x) for x in xs], na_action="ignore")


def ascii_text(c: Column | str) -> Column:
    """Plain ASCII of a column or the column of a name. Most text is that already and only loses blanks at its ends; Python
    sees the rest alone."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.octet_length(text(c)) == F.char_length(text(c))
    bare = F.regexp_replace(text(c), r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.when(plain, bare).otherwise(plain_letters(F.when(~plain, c)))


def ascii_texts(columns: list[Column]) -> Column:
    """Plain ASCII of several columns, as a list. Python sees the rows alone of which a column is not plain, and one value of
    each."""
    together = F.concat_ws("", *columns)
    plain = F.octet_length(together) == F.char_length(together)
    bare = [F.btrim(text(c), F.lit(ASCII_BLANK)) for c in columns]
    return F.when(plain, F.array(*bare)).otherwise(plain_lists(F.when(~plain, F.array(*[text(c) for c in columns]))))


def word_list(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\w+"), F.lit(0))


def shorten_sentence(c: Column, language: str = "en") -> Column:
    """At most 45 words and 300 letters as it is; else what stands before a separator, if that is 18 to 42 words; else the
    first 42 words. No more than the first 46 words of a longer text are looked at, as they decide all of it: a separator
    that leaves 42 words before it is over before the 46th begins."""
    def dotted(t: Column) -> Column:
        return F.when(t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))

    def short(x: Column) -> Column:
        heads = [F.when(F.contains(x["o"], F.lit(s)), F.trim(F.substring_index(x["o"], s, 1))) for s in SEPARATORS[language]]
        fitting = [let(h, lambda t: F.when(F.size(word_list(t)).between(18, 42), dotted(t))) for h in heads]
        cut = dotted(F.array_join(F.slice(x["w"], 1, 42), " "))
        return F.when((F.size(x["w"]) <= 45) & (x["n"] <= 300), x["o"]).otherwise(F.coalesce(*fitting, F.when(F.size(x["w"]) == 0, x["o"]), cut))

    def upto(o: Column) -> Column:
        head = F.regexp_extract(o, r"^(?:\W*+\w++){0,46}+", 0)
        return let(F.struct(head.alias("o"), word_list(head).alias("w")), lambda h: F.struct(F.when(F.size(h["w"]) < 46, o).otherwise(h["o"]).alias("o"), h["w"].alias("w"), F.length(o).alias("n")))

    original = clean_str(c, "nbsp")
    return let(original, lambda o: let(upto(o), short))


def lower_blob(*columns: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.lower(clean_str(c, "nbsp")), F.lit("")) for c in columns])


def gwas_support(blob: Column) -> Column:
    has = lambda w: F.contains(blob, F.lit(w))
    return has("gwas") & ~has("no gwas") & ~has("gwas_association_count=0")


def gwas_significant(blob: Column) -> Column:
    """Whether a p-value at genome-wide significance, or several associations, are spoken of."""
    values = F.regexp_extract_all(blob, F.lit(r"(?:p(?:-?value)?|min p)\s*[=:]\s*([0-9]+(?:\.[0-9]+)?e[-+]?[0-9]+)"), F.lit(1))
    return F.exists(values, lambda v: v.try_cast("double") <= 5e-8) | F.contains(blob, F.lit("multiple associations"))


def gwas_strong(blob: Column) -> Column:
    return gwas_support(blob) & gwas_significant(blob)


def any_of(blob: Column, words: tuple[str, ...]) -> Column:
    return blob.rlike("|".join(words))


def match_text(c: Column) -> Column:
    """Lower case with _ / & as spaces, runs of space as one; for text that is ASCII already."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text(c)), "_/&", "   "), r"\s+", " "))


def json_list(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
