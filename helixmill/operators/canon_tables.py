"""The curated side as ten related tables: versions, rows, genes, modules, places, transcripts, features, unions, rules
and warnings. Each has a key of its own and names its parents by theirs, so any of them can be read alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators.canon import canon_warnings, transcript_tier
from helixmill.operators.match import REGION_COLUMNS, REGIONS

#: Key of each table, and the parents it names: (column, parent).
KEYS = {
    "canon_versions": ("canon_version_id", ()),
    "canon_rows": ("canon_row_id", (("canon_version_id", "canon_versions"),)),
    "genes": ("gene_id", (("canon_version_id", "canon_versions"),)),
    "gene_modules": ("gene_module_id", (("gene_id", "genes"), ("canon_row_id", "canon_rows"))),
    "gene_envelopes": ("gene_id", (("gene_id", "genes"),)),
    "transcripts": ("transcript_db_id", (("gene_id", "genes"),)),
    "feature_intervals": ("feature_id", (("gene_id", "genes"), ("transcript_db_id", "transcripts"))),
    "merged_feature_intervals": ("merged_feature_id", (("gene_id", "genes"),)),
    "local_priority_rules": ("rule_id", ()),
    "preprocessing_warnings": ("warning_id", (("canon_version_id", "canon_versions"), ("gene_id", "genes"))),
}


def priority_rules(spark: SparkSession) -> DataFrame:
    """The region classes as a table, strongest first; background classes need no annotation."""
    rows = [(f"rule-{k}", k, *r) for k, r in enumerate(REGIONS, 1)]
    return spark.createDataFrame(rows, "rule_id string, rule_order int, " + ", ".join(f"{c} string" for c in REGION_COLUMNS))


def canon_tables(version: str, assembly: str, rows: DataFrame, genes: DataFrame, transcripts: DataFrame, features: DataFrame, merged: DataFrame) -> dict[str, DataFrame]:
    """rows: curated rows with canon_row_id and gene_id. genes: every known gene with its place. Only curated genes are
    kept, and of the other tables what belongs to them."""
    spark, of = rows.sparkSession, F.lit(version)
    curated = rows.select("gene_id").distinct()
    own = genes.join(curated, "gene_id", "left_semi")
    kept = transcripts.join(own.select("gene_id"), "gene_id", "left_semi")
    named = own.select("gene_id", "approved_symbol", "chrom", "strand")
    flag = lambda c: F.col(c) if c in transcripts.columns else F.lit(0)
    tier = transcript_tier(flag("is_mane_select"), flag("is_mane_plus_clinical"), flag("is_ensembl_canonical"), F.col("biotype"))
    known = rows.join(genes.select("gene_id", "approved_symbol"), "gene_id", "left")
    found = F.col("approved_symbol").isNotNull()
    symbol = F.when(F.col("gene_id").isNull(), "").otherwise(F.coalesce("approved_symbol", F.col("gene_id").cast("string")))
    status = F.when(found, "resolved_exact_symbol").otherwise("unresolved_symbol")
    warned = canon_warnings(known.select("canon_row_id", symbol.alias("symbol"), status.alias("resolution_status"), F.lit("").alias("resolution_notes"), F.when(found, F.col("gene_id")).alias("gene_id"), "approved_symbol"), kept)
    return {
        "canon_versions": spark.createDataFrame([(version, assembly)], "canon_version_id string, assembly string"),
        "canon_rows": rows.withColumns({"canon_version_id": of, "row_status": F.when(F.col("gene_id").isNull(), "non_gene_module").otherwise("active_gene_row"), "is_draft": (F.lower("module_status") == "draft").cast("int")}),
        "genes": own.select("gene_id", of.alias("canon_version_id"), "approved_symbol"),
        "gene_modules": rows.join(own.select("gene_id"), "gene_id", "left_semi").withColumn("gene_module_id", F.concat_ws(":", F.col("gene_id").cast("string"), "canon_row_id")),
        "gene_envelopes": own.select("gene_id", "approved_symbol", "chrom", F.col("g_start").alias("start"), F.col("g_end").alias("end"), "strand", F.lit(assembly).alias("assembly")),
        "transcripts": kept.withColumnRenamed("transcript_id", "transcript_db_id").withColumns({"inclusion_tier": tier, "include_for_matching": F.lit(1)}),
        "feature_intervals": features.join(named, "gene_id").withColumnRenamed("transcript_id", "transcript_db_id").withColumns({"feature_id": F.concat_ws(":", "transcript_db_id", "feature_type", "feature_number", F.col("start").cast("string"), F.col("end").cast("string")), "derived_feature": (~F.col("feature_type").isin("transcript_body", "exon_interval")).cast("int")}),
        "merged_feature_intervals": merged.join(named, "gene_id").withColumn("merged_feature_id", F.concat_ws(":", F.col("gene_id").cast("string"), "merged_feature_type", F.col("start").cast("string"))),
        "local_priority_rules": priority_rules(spark),
        "preprocessing_warnings": warned.select(F.concat_ws(":", F.coalesce(F.col("gene_id").cast("string"), "canon_row_id"), "warning").alias("warning_id"), of.alias("canon_version_id"), "canon_row_id", "gene_id", F.col("warning").alias("warning_type"), "severity", "message", "action"),
    }


def write_canon(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def read_canon_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in KEYS}


def key_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a table: rows, different keys, and rows that name a parent which is not there."""
    out = None
    for name, (key, parents) in KEYS.items():
        df = tables[name]
        lost = None
        for column, parent in parents:
            known = tables[parent].select(F.col(KEYS[parent][0]).alias(column)).distinct()
            n = df.where(F.col(column).isNotNull()).join(known, column, "left_anti").agg(F.count("*").alias("orphans"))
            lost = n if lost is None else lost.unionByName(n)
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.count_distinct(key).alias("keys"))
        orphans = lost.agg(F.sum("orphans").alias("orphans")) if lost is not None else one.select(F.lit(0).cast("bigint").alias("orphans"))
        row = one.join(orphans, F.lit(True))  # one row by one row
        out = row if out is None else out.unionByName(row)
    return out
