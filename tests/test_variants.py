"""Fixtures of the source's own tests on small inline frames, and invariants on the projected tables."""

import pytest
from pyspark.sql import functions as F

from helixmill.functions import genotype as g
from helixmill.functions import text as t
from helixmill.operators import canon, interpret, match, normalize
from helixmill.operators.intervals import _placed, merge_intervals, overlap_join
from helixmill.plans import fixtures, q_match, q_text, registry
from helixmill.sources import files, vcf
from helixmill.streaming import streams

SF = "/root/testdata/sf0.001"
LINE = "upload_id string, line_no bigint, line string"


def lines(spark, *rows):
    return spark.createDataFrame([("u", i, "\t".join(r)) for i, r in enumerate(rows)], LINE)


def test_multiallelic_record_gives_two_alleles(spark):
    rows = vcf.observed_alleles(vcf.parse_records(lines(spark, ("chr1", "100", "rs1", "A", "G,T", ".", "LowDepth", ".", "GT", "1/2")))).orderBy("alt_index").collect()
    assert [(r.allele, r.alt_index, r.dosage) for r in rows] == [("G", 1, 1), ("T", 2, 1)]
    assert all(r.variant_key.startswith("v2_") and len(r.variant_key) == 27 for r in rows)


def test_unsupported_contig_is_excluded_once(spark):
    records = vcf.parse_records(lines(spark, ("HLA-DRB1*03:01:01:01", "7566", ".", "A", "G", ".", "PASS", ".", "GT", "0/1")))
    assert vcf.observed_alleles(records).count() == 0
    spans = spark.createDataFrame([("chr1", 1, 10**7)], "contig string, start bigint, end bigint")
    assert [r.fate for r in normalize.source_alleles(records, spans).collect()] == ["unsupported_contig"]


def test_prefilter_looks_at_the_position(spark):
    alleles = spark.createDataFrame([("chr1", 1050, 1050), ("chr1", 5000, 5000)], "contig string, start bigint, end bigint")
    regions = spark.createDataFrame([("chr1", 1000, 1100)], "contig string, start bigint, end bigint")
    assert [r.start for r in match.prefilter(alleles, regions, 0).collect()] == [1050]


def test_contig_label_is_the_files_own(spark):
    records = vcf.parse_records(lines(spark, ("1", "150", ".", "A", "G", ".", "PASS", ".", "GT", "0/1")))
    assert [(r.contig, r.label) for r in vcf.contig_labels(records).collect()] == [("chr1", "1")]


def test_allele_signature_trims_both_ends(spark):
    row = spark.range(1).select(g.allele_signature(F.lit("CA"), F.lit("CTA")).alias("s")).first().s
    assert (row.ref, row.alt) == ("C", "CT") or (row.ref, row.alt) == ("CA", "CTA") or len(row.ref) == 1
    same = spark.range(1).select(g.allele_signature(F.lit("A"), F.lit("G")).alias("s")).first().s
    assert (same.prefix, same.ref, same.alt) == (0, "A", "G")


def test_mitochondrial_labels_differ_between_schemas(spark):
    row = spark.range(1).select(g.norm_chrom(F.lit("MT")), g.norm_chrom_legacy(F.lit("chrM")), g.norm_chrom(F.lit(""))).first()
    assert tuple(row) == ("chrM", "chrMT", "")


def test_info_keeps_the_last_value(spark):
    row = spark.range(1).select(g.parse_info(F.lit("A=1;DB;A=2;.")).alias("m")).first().m
    assert row == {"A": "2", "DB": "true"}


def test_merge_joins_adjacent_and_reversed(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 20, 12), ("b", 1, 1), ("a", 1, 5)], "k string, start bigint, end bigint")
    assert sorted(map(tuple, merge_intervals(df, ["k"]).collect())) == [("a", 1, 9), ("a", 12, 20), ("b", 1, 1)]


def test_binned_join_equals_plain_join(spark):
    left = spark.range(300).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 3000000).alias("a"), F.col("id").alias("i")).withColumn("b", F.col("a") + F.when(F.col("i") % 50 == 0, 2_000_000).otherwise(F.col("i") * 37 % 20000))
    right = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 104729 % 3000000).alias("c"), F.col("id").alias("j")).withColumn("d", F.col("c") + F.when(F.col("j") % 40 == 0, 1_500_000).otherwise(5000))
    got = overlap_join(left, right, ["k"], ("a", "b", "c", "d")).select("i", "j").collect()
    plain = left.join(right, "k").where("a <= d AND b >= c").select("i", "j").collect()
    assert len(got) == len(set(got)) and set(got) == set(plain)


def test_text_rules(spark):
    row = spark.range(1).select(t.clean_str(F.lit("  NaN "), "null_words"), t.clean_str(F.lit("a\n b "), "collapse"), t.slug(F.lit("--")), t.compact_number(F.lit("0.25")), t.compact_number(F.lit("0")), t.compact_number(F.lit("1234567")), t.clinvar_strength(F.lit("criteria provided, multiple submitters, no conflicts"))).first()
    assert tuple(row) == ("", "a b", "unknown", "0.25", "0", "1.235e+06", "multiple_submitters_no_conflicts")


def test_accents_go(spark):
    df = spark.createDataFrame([("ñandú – β",), (None,)], "x string")
    assert [r[0] for r in df.select(t.ascii_text("x")).collect()] == ["nandu - beta", ""]


def test_triage_splits_all_rows(spark):
    triaged = q_match.triaged(spark, SF)
    n = triaged.agg(F.count("*"), F.count(F.when(F.col("triage_decision") == "include_ai", 1)), F.count(F.when(F.col("triage_decision") != "include_ai", 1))).first()
    assert n[0] > 0 and n[0] == n[1] + n[2]


def test_every_region_class_occurs(spark):
    assert {r.local_region_class for r in q_match.flagship(spark, SF).collect()} == {r[1] for r in match.REGIONS} - {"utr_overlap"}  # untranslated parts here lie in coding exons, which come first


def test_symbols_with_several_aliases_stay_open(spark):
    f = lambda *rows: spark.createDataFrame(rows, "symbol string, gene_id bigint")
    out = canon.resolve_symbols(spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "symbol string"), f(("A", 1)), f(("A", 9), ("B", 2), ("B", 3)), f(("C", 4)))
    assert {r.symbol: r.status for r in out.collect()} == {"A": "resolved", "B": "multiple_candidates", "C": "resolved", "D": "not_found"}


def test_empty_records(spark):
    none = spark.createDataFrame([], LINE)
    assert vcf.observed_alleles(vcf.parse_records(none)).count() == 0 and vcf.vcf_stats(none).count() == 0


def test_each_sql_names_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-500:]


def test_insertion_moves_left(spark):
    from helixmill.operators.interpret import left_align

    reference = spark.createDataFrame([("chr1", 0, "GCAAAT" + "C" * 994), ("chr1", 1, "CCG" + "T" * 997)], "contig string, chunk_no bigint, sequence string")
    rows = [("chr1", 5, "A", "AA"), ("chr1", 5, "AT", "A"), ("chr1", 1002, "C", "CC"), ("chr1", 4, "A", "G"), ("chr2", 9, "A", "AA")]
    alleles = spark.createDataFrame(rows, "contig string, start bigint, ref string, alt string")
    got = {(r.contig, r.start, r.ref, r.alt) for r in left_align(alleles, reference, window=30).collect()}
    assert {("chr1", 2, "C", "CA"), ("chr1", 5, "AT", "A"), ("chr1", 4, "A", "G"), ("chr2", 9, "A", "AA")} <= got
    assert ("chr1", 1002 - 29, "C", "CC") in got  # as far as the window reaches, over a chunk's border


def test_headers_keep_every_sample(spark):
    from helixmill.sources import vcf

    names = [f"S{i}" for i in range(1500)]
    lines = [("u", 1, "##fileformat=VCFv4.2"), ("u", 2, "\t".join(["#CHROM", *"BCDEFGHI", *names])), ("v", 1, "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO".split())), ("w", 1, "##x")]
    got = {r.upload_id: r for r in vcf.parse_headers(spark.createDataFrame(lines, "upload_id string, line_no bigint, line string")).collect()}
    assert got["u"].samples == ",".join(names) and got["u"].n_samples == 1500 and got["v"].samples == "" and got["w"].samples is None


def test_indels_move_through_long_repeats(spark):
    from helixmill.operators.interpret import left_align

    bases = "G" * 700 + "T" + "C" * 2500 + "A" + "GAT" * 500 + "G" * 298
    reference = spark.createDataFrame([("chr1", k, bases[1000 * k : 1000 * k + 1000]) for k in range(5)] + [("chr3", 4, "A" * 1000)], "contig string, chunk_no bigint, sequence string")
    at = bases.index("GATGAT") + 3 * 499  # the last unit, counted from 0
    rows = [("chr1", 3200, "C", "CC"), ("chr1", 2100, "CC", "C"), ("chr1", at, "TGAT", "T"), ("chr1", at + 3, "T", "TGAT"), ("chr1", 300, "G", "GG"), ("chr1", 3200, "C", "TC"), ("chr3", 4500, "A", "AA"), ("chr1", 800, "A", "AA")]
    got = sorted((r.contig, r.start, r.ref, r.alt) for r in left_align(spark.createDataFrame(rows, "contig string, start bigint, ref string, alt string"), reference).collect())
    first = bases.index("GATGAT")
    assert got == sorted([("chr1", 701, "T", "TC"), ("chr1", 701, "TC", "T"), ("chr1", first, "AGAT", "A"), ("chr1", first, "A", "AGAT"), ("chr1", 1, "G", "GG"), ("chr1", 3200, "C", "TC"), ("chr3", 4001, "A", "AA"), ("chr1", 800, "A", "AA")])


def test_stream_equals_batch(spark):
    from helixmill.plans import q_more, q_vcf

    batch = q_vcf.records(spark, SF).groupBy("upload_id").agg(F.count("*").alias("n")).collect()
    stream = q_more.QUERIES["str_running_counts"](spark, SF).select("upload_id", "n").collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, stream))


def test_header_keeps_all_samples_and_a_mapping_all_alleles(spark):
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[f"s{k}" for k in range(1500)]])
    rows = spark.createDataFrame([("u", 1, "##fileformat=" + "V" * 1200), ("u", 2, head)], "upload_id string, line_no bigint, line string")
    got = vcf.parse_headers(rows).first()
    assert got.n_samples == 1500 and got.samples.endswith(",s1499") and len(got.fileformat) == 1200
    alleles = "A/" + "/".join("C" * k for k in range(1, 151))
    m = spark.range(1).select(interpret.first_mapping(F.array(F.struct(F.lit("chromosome").alias("coord_system"), F.lit("1").alias("seq_region_name"), F.lit(5).cast("bigint").alias("start"), F.lit(alleles).alias("allele_string")))).alias("m")).first().m
    assert m.ref == "A" and len(m.alt.split(",")) == 150


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    for k in range(2):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "same.vcf").write_text("".join(f"{i}\tx\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = vcf.read_vcf(spark, [f"file://{tmp_path}/0", f"file://{tmp_path}/1"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r.upload_id for r in rows}) == 2 and len({(r.upload_id, r.line_no) for r in rows}) == 40_000
    for u in {r.upload_id for r in rows}:
        mine = [int(r.line.split("\t")[0]) for r in sorted((r for r in rows if r.upload_id == u), key=lambda r: r.line_no)]
        assert mine == list(range(20_000))


def test_tables_in_other_encodings(spark, tmp_path):
    for name, raw in {"UTF-8": "﻿a,b\né,1\n".encode(), "windows-1252": "a,b\né“,1\n".encode("cp1252"), "ISO-8859-1": b"a,b\n\xe9\x81,1\n"}.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(raw)
        assert files.table_encoding(spark, f"file://{path}") == name
        df = files.read_table(spark, f"file://{path}")
        assert df.columns == ["a", "b"] and df.first().a[0] == "é"


def test_file_heads_and_digests(spark, tmp_path):
    import gzip
    import hashlib

    bodies = {"a.vcf": b"x" * 3_000_000, "b.vcf.gz": gzip.compress(b"y"), "c.vcf.gz": b"plain", "d.txt": b""}
    for n, b in bodies.items():
        (tmp_path / n).write_bytes(b)
    profile = {r.path.rsplit("/", 1)[1]: r for r in files.file_profile(spark, f"file://{tmp_path}/*").collect()}
    assert [profile[n].is_gzip for n in sorted(bodies)] == [False, True, False, False] and profile["c.vcf.gz"].errors == "gzip_magic_missing" and profile["d.txt"].errors == "empty_file"
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in files.file_checksums(spark, f"file://{tmp_path}/*").collect()}
    assert sums == {n: hashlib.sha256(b).hexdigest() for n, b in bodies.items()}


def test_transcript_tags_fall_back_to_the_overlap_metadata(spark):
    own = spark.createDataFrame([("T1", 1, None, None), ("T2", 1, "protein_coding", 1), ("T3", 2, "", None), ("T4", 3, "retained_intron", None)], "transcript_id string, gene_id bigint, biotype string, is_canonical int")
    meta = spark.createDataFrame([("T1", ["MANE_Plus_Clinical"], "lncRNA", 0), ("T3", None, "protein_coding", 1)], "transcript_id string, tags array<string>, overlap_biotype string, overlap_canonical int")
    mane = spark.createDataFrame([(3, "T4.7"), (3, None)], "gene_id bigint, mane_id string")
    got = {r.transcript_id: (r.biotype, r.inclusion_tier, r.is_primary) for r in canon.tag_transcripts(own, meta, mane).collect()}
    assert got == {"T1": ("lncRNA", "mane_plus_clinical", 1), "T2": ("protein_coding", "ensembl_canonical", 1), "T3": ("protein_coding", "ensembl_canonical", 1), "T4": ("retained_intron", "mane_select", 1)}


def test_cache_parts_give_the_latest_write(spark, tmp_path):
    schema = "assembly string, variant_key string, source string, fingerprint string, status string, fetched_at timestamp, event_id bigint"
    rows = [("a", f"v{k % 3}", "s", "f", "ok", __import__("datetime").datetime(2024, 1, 1 + k), k) for k in range(9)]
    write = streams.cache_writer(f"file://{tmp_path}/c")
    for epoch in (0, 1, 1, 2):
        write(spark.createDataFrame(rows[3 * epoch : 3 * epoch + 3], schema), epoch)
    assert sorted(r.event_id for r in streams.read_cache(spark, f"file://{tmp_path}/c").collect()) == [6, 7, 8]
    streams.compact_cache(spark, f"file://{tmp_path}/c", f"file://{tmp_path}/d")
    assert streams.read_cache(spark, f"file://{tmp_path}/d").count() == 3


def test_long_genes_cost_only_their_own_pairs(spark):
    """A 2 Mb gene among 2,000 short ones: the equi-join below overlap_join makes its pairs and little more."""
    points = spark.range(20_000).select(F.lit("chr1").alias("k"), (F.col("id") * 997 % 2_000_000).alias("a"), F.col("id").alias("i")).withColumn("b", F.col("a"))
    genes = spark.range(2000).select(F.lit("chr1").alias("k"), (F.col("id") * 1000).alias("c"), F.col("id").alias("j")).withColumn("d", F.col("c") + 500)
    long = spark.createDataFrame([("chr1", 10, -1, 2_000_010), ("chr1", 0, -2, 700_000)], "k string, c bigint, j bigint, d bigint")
    def candidates(right):
        both = _placed(points, "a", "b", "l").join(_placed(right, "c", "d", "r"), ["k", "_tag", "_bin"])
        return both.count(), overlap_join(points, right, ["k"], ("a", "b", "c", "d")).count()
    (few, hits), (more, all_hits) = candidates(genes), candidates(genes.unionByName(long))
    assert all_hits - hits >= 20_000 and more - few <= 2 * (all_hits - hits)
    spans = spark.createDataFrame([("x", 5, 60_000_000, 1), ("x", 100, 100, 2), ("x", 41_000_000, 41_700_000, 3), ("x", None, 5, 4), ("y", 9, 3, 5)], "k string, a bigint, b bigint, i int")
    other = spans.select("k", F.col("a").alias("c"), F.col("b").alias("d"), F.col("i").alias("j"))
    got = sorted((r.i, r.j) for r in overlap_join(spans, other, ["k"], ("a", "b", "c", "d")).collect())
    assert got == sorted((r.i, r.j) for r in spans.join(other, "k").where("a <= d AND b >= c").collect())


def test_uploads_do_not_lend_each_other_genotypes(spark):
    canon = spark.createDataFrame([("u", 1, "rs1", "df_ok"), ("v", 2, "rs1", "df_ok"), ("w", 3, "rs1", "df_ok")], "upload_id string, row_id int, rsid string, source_group string")
    ready = spark.createDataFrame([("u", "rs1", "1", "5", "A", "G", 2), ("u", "rs1", "1", "9", "A", "G", 1), ("v", "rs1", "1", "5", "A", "G", 1)], "upload_id string, rsid string, chrom string, pos string, exp_ref string, exp_alt string, seq int")
    called = spark.createDataFrame([("u", 7, "1", "5", "A", "G", "0/1"), ("v", 8, "1", "5", "A", "G", "1/1"), ("v", 9, "1", "5", "A", "T", "0/1")], "upload_id string, line_no int, chrom string, pos string, ref string, alt string, gt string")
    got = {r.row_id: (r.pos, r.line_no, r.zygosity, r.match_status) for r in match.consolidate(canon, ready, called).collect()}
    assert got == {1: ("9", None, "unknown", "no_vcf_match_by_chr_pos"), 2: ("5", 8, "homozygous", "match_strict"), 3: (None, None, "unknown", "rsid_without_coordinates")}


def normalised(spark, rows, bases, regions=((1, 10_000),)):
    n, text = normalize, lines(spark, *rows)
    records = vcf.parse_records(text)
    reference = spark.createDataFrame([("chr1", k, bases[10 * k : 10 * k + 10]) for k in range(-(-len(bases) // 10))], "contig string, chunk_no bigint, sequence string")
    spans = n.target_spans(spark.createDataFrame([("chr1", a, b) for a, b in regions], "contig string, start bigint, end bigint"), 0)
    norm = n.normalised(n.split_records(records, vcf.contig_labels(records), spans), reference, 10)
    sources = n.source_alleles(records, spans)
    return n, text, norm, sources, n.attach_source(norm, sources, spans)


def test_normaliser(spark):
    bases = "GCAAATCCCCCCCCCCCCCCCCCGATGATGATC"
    record = lambda pos, ref, alt, gt="0/1", chrom="chr1": (chrom, str(pos), ".", ref, alt, ".", "PASS", ".", "GT", gt)
    rows = [record(5, "A", "AA"), record(5, "A", "T,AA", "1|2"), record(20, "CC", "C"), record(20, "A", "C"), record(24, "GATGAT", "GAT"), record(6, "TCCCCCCCCCCCCCCC", "TCC"), record(3, "AAA", "ACA"), record(2, "CA", "C", "0/0"), record(1, "G", "GG"), record(28, "A", "<DEL>")]
    _, text, norm, sources, attached = normalised(spark, rows, bases)
    got = sorted((r.line_no, r.alt_index, r.start, r.ref, r.alt, r.gt, r.orig) for r in norm.collect())
    assert got == [
        (0, 1, 2, "C", "CA", "0/1", "chr1|5|A|AA"), (1, 1, 5, "A", "T", "1|0", "chr1|5|A|T,AA|1"), (1, 2, 2, "C", "CA", "0|1", "chr1|5|A|T,AA|2"), (2, 1, 6, "TC", "T", "0/1", "chr1|20|CC|C"),
        (4, 1, 23, "CGAT", "C", "0/1", "chr1|24|GATGAT|GAT"), (5, 1, 6, "TCCCCCCCCCCCCC", "T", "0/1", "chr1|6|TCCCCCCCCCCCCCCC|TCC"), (6, 1, 4, "A", "C", "0/1", "chr1|3|AAA|ACA"), (7, 1, 2, "CA", "C", "0/0", ""), (8, 1, 1, "G", "GG", "0/1", ""), (9, 1, 28, "A", "<DEL>", "0/1", ""),
    ]
    found = {(r.line_no, r.alt_index): r for r in attached.collect()}
    assert found[1, 2].duplicate and not found[0, 1].duplicate and found[1, 2].source_gt_raw == "1|2" and found[1, 2].origin == "source"
    assert found[7, 1].reason == "unobserved" and found[9, 1].reason == "unsupported_normalized_alt"
    c = normalize.counters(text, sources, attached).first()
    assert (c.input_records, c.multiallelic_records, c.observed_source_alleles, c.symbolic_or_unsupported, c.normalized_source_matched, c.duplicate_normalized_physical_variants, c.unsupported_normalized) == (10, 1, 9, 1, 8, 1, 1)


def test_places_inside_the_target(spark):
    bases = "G" + "A" * 30 + "T"
    record = lambda chrom, pos, alt: (chrom, str(pos), ".", "A", alt, ".", "PASS", ".", "GT", "0/1")
    rows = [record("chr1", 25, "AA"), record("chr1", 28, "AA"), record("1", 26, "C"), record("chr1", 40, "C")]
    n, _, _, sources, attached = normalised(spark, rows, bases, ((20, 30),))
    assert sorted((r.line_no, r.start, r.basis, r.origin, r.duplicate) for r in attached.collect()) == [(0, 1, "source", "source", False), (1, 1, "source", "source", True)]
    loose = spark.createDataFrame([("u", 50, 1, "chr1", 5000, "A", "G", ".", ".", "PASS", "", 1, "0/1", ""), ("u", 51, 1, "chr1", 22, "A", "G", ".", ".", "PASS", "", 1, "0/1", ""), ("u", 52, 1, "chr1", 0, "A", "G", ".", ".", "PASS", "", 1, "0/1", ""), ("u", 53, 1, "chr1", 5, "A", "AA", ".", ".", "PASS", "", 1, "0/1", "chr1|25|A|AA")], "upload_id string, line_no bigint, alt_index int, contig string, start bigint, ref string, alt string, id string, qual string, filter string, info string, dosage int, gt string, orig string")
    spans = spark.createDataFrame([("chr1", 20, 30)], "contig string, start bigint, end bigint")
    got = {r.line_no: (r.reason, r.origin, r.basis) for r in n.attach_source(loose, sources, spans).collect()}
    assert got == {50: ("normalized_outside_target_regions", "normalized_fallback", "none"), 51: ("", "normalized_fallback", "source_and_current"), 52: ("invalid_normalized_coordinate", "normalized_fallback", "none"), 53: ("", "source", "source")}
    audit = sorted((r.line_no, r.source_pos, r.reason) for r in n.excluded_audit(sources, n.attach_source(loose, sources, spans)).collect())
    assert audit == [(50, "5000", "normalized_outside_target_regions"), (52, "0", "invalid_normalized_coordinate")]


def test_target_regions_need_a_contig(spark):
    n = normalize
    spans = spark.createDataFrame([("chr1", 20, 30)], "contig string, start bigint, end bigint")
    labels = lambda *rows: spark.createDataFrame(list(rows), "upload_id string, contig string, label string")
    got = n.target_regions(spans, labels(("u", "chr1", "1"), ("u", "chr2", "chr2"), ("v", "chr1", "chr1"))).collect()
    assert sorted((r.upload_id, r.label, r.start, r.renamed) for r in got) == [("u", "1", 20, True), ("v", "chr1", 20, False)]
    with pytest.raises(Exception, match="no contig of the target regions in w"):
        n.target_regions(spans, labels(("u", "chr1", "1"), ("w", "chr2", "2"))).collect()


def test_a_late_copy_stays_one_row_over_restarts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows, k: spark.createDataFrame(rows, "upload_id string, variant_key string").write.parquet(f"{source}/{k}")
    def run():
        stream = spark.readStream.schema("upload_id string, variant_key string").option("recursiveFileLookup", "true").parquet(source)
        return sorted(map(tuple, streams.stream_dedup(stream, out).collect()))
    put([("u", "a"), ("u", "a"), ("v", "a")], 1)
    assert run() == [("u", "a"), ("v", "a")]
    put([("u", "a"), ("u", "b")], 2)  # a new query from the checkpoint: nothing of the first run's memory is left
    assert run() == [("u", "a"), ("u", "b"), ("v", "a")]
    streams.dedup_writer(out)(spark.createDataFrame([("u", "a"), ("u", "b")], "upload_id string, variant_key string"), 1)  # the second batch again
    assert sorted(map(tuple, spark.read.parquet(out).drop("part").collect())) == [("u", "a"), ("u", "b"), ("v", "a")]


def test_identifier_of_a_normalised_indel(spark):
    from helixmill.operators import evidence

    def resolved(chrom, pos, ref, alt, own, *records):
        import json

        df = spark.createDataFrame([(own, chrom, pos, ref, alt, json.dumps({"colocated_variants": list(records)}))], "id string, contig string, pos bigint, ref string, alt string, payload string")
        r = evidence.resolve_rsid(df).first()
        return r.resolved_rsid, r.rsid_status, r.colocated_count, r.colocated_rsid_count
    at = {"seq_region_name": "1", "start": 101, "end": 101}
    assert resolved("chr1", 100, "CA", "CTA", ".", {"id": "rs1234", "allele_string": "A/TA", **at})[:2] == ("rs1234", "vep_colocated_normalized_indel")
    assert resolved("chr1", 100, "CA", "CTA", "rs1234", {"id": "RS1234", "allele_string": "TA/A", **at})[:2] == ("rs1234", "vcf_id_confirmed_by_vep_exact_allele")
    assert resolved("chr2", 100, "CA", "CTA", ".", {"id": "rs1234", "allele_string": "A/TA", **at}) == ("", "vep_colocated_allele_mismatch", 1, 1)
    assert resolved("chr1", 500, "A", "G", ".", {"id": "rs1", "allele_string": "A/G", **at})[1] == "vep_colocated_allele_mismatch"
    assert resolved("chr1", 500, "A", "G", ".", {"id": "rs1", "allele_string": "A/G"})[1] == "vep_colocated_exact_allele"
    assert resolved("chr1", 101, "A", "G", ".", {"id": "rs1", "allele_string": "A/G", **at}, {"id": "rs2", "allele_string": "G/A", **at})[1] == "ambiguous_multiple_exact_rsids"
    assert resolved("chr1", 101, "A", "G", ".", {"id": "COSV1", "allele_string": "A/G", **at}) == ("", "unresolved_no_exact_rsid", 1, 0)


def test_interval_index_of_all_shapes(spark, tmp_path):
    payload = """{"chromosomes": {
      "1": [{"gene_id": "a", "start": 5, "end": 9}, 17, "x", {"gene_id": "b", "start": "oops", "end": 3}, {"start": 2}],
      "chrX": {"gene_id": "c", "start": "20", "end": 30},
      "HLA": [{"gene_id": "d", "start": 1, "end": 2}], "2": "nothing"}}"""
    (tmp_path / "a.json").write_text(payload)
    rows = files.read_interval_index(spark, str(tmp_path)).collect()
    assert sorted((r.contig, r.reason, r.gene_id, r.i_start) for r in rows if r.reason == "") == [("chr1", "", "a", 5), ("chrX", "", "c", 20)]
    assert sorted(r.reason for r in rows if r.reason) == ["bad_coordinates"] * 2 + ["not_an_object"] * 3 + ["unsupported_contig"]
    assert files.usable_intervals(files.read_interval_index(spark, str(tmp_path))).count() == 2
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.json").write_text('{"chromosomes": {"HLA": {"start": 1, "end": 2}}}')
    with pytest.raises(Exception, match="no usable regions"):
        files.usable_intervals(files.read_interval_index(spark, str(tmp_path / "b"))).collect()


def test_interpretation_chain(spark):
    columns = "row_id, gene, rsid, observed_genotype, zygosity, ref_alt, final_confidence_level, gene_or_locus_ambiguity_flag, technical_notes_en, evidence_used, family_notes_en, interpretation_one_sentence_en".split(", ")
    strong = "intron_variant serum ige p=1.0e-20"
    rows = [
        ("1", "g", "rs1", "AG", "het", "A/G", "High", "false", "", "[]", "n", "Short."), ("2", "G", "RS1", "ag", "het", "a/g", "Low", "true", "", "[]", "n", "Short."),
        ("3", "h", "rs2", "AG", "non_diploid_or_complex", "A/G", "High", "false", "synonymous_variant benign", "[]", "n", "w " * 20 + "; " + "x " * 40),
        ("4", "i", "rs3", "AG", "het", "A/G", "Low", "false", strong, '["gwas"]', "n", "Short."), ("5", "j", "rs4", "AG", "het", "A/G", "odd", "false", strong, '["no gwas"]', " ", "é"),
    ]
    df = spark.createDataFrame(rows, columns)
    for name in ("evidence_limitations", "confidence_rationale_en", "interpretation_long_en", "technical_interpretation_en", "interpretation_one_sentence_es", "category"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    df = df.withColumn("family_notes_es", F.lit("nota"))
    out = interpret.normalise_interpretations(df)
    got = {r.row_id: (r.final_confidence_level, r.qa_warnings, r.normalization_status, r.duplicate_group_size) for r in out.collect()}
    assert got["1"] == ("Moderate", "duplicate_confidence_normalized", "changed", 2) and got["2"] == got["1"]
    assert got["3"] == ("Moderate", "high_synonymous_limited_context_capped|english_one_sentence_shortened", "changed", 1)
    assert got["4"] == ("Moderate", "strong_association_marker_raised", "changed", 1)
    assert got["5"] == ("Moderate", "missing_family_note_filled", "changed", 1)
    by_id = {r.row_id: r for r in out.collect()}
    assert by_id["3"].interpretation_one_sentence_en == ("w " * 20).strip() + "." and by_id["5"].interpretation_one_sentence_en == "e"
    assert interpret.changed_rows(out).count() == 5


def test_projections_fill_what_is_missing(spark):
    from helixmill.operators import projections

    df = spark.createDataFrame([(" G1 ", "", "yes", '["a","b"]')], "approved_symbol string, zygosity string, has_genotype string, evidence_used string")
    audit = projections.deliverables(df.withColumn("background_only", F.lit("TRUE"))).first()
    assert audit["Gene"] == "G1" and audit["Zygosity"] == "NA" and audit["Is Draft"] == "false" and audit["has_genotype"] == "true" and audit.minimal is False
    assert [len(projections.project(df, x).columns) for x in (projections.PAYLOAD, projections.compact_fields("en"), projections.V2_MINIMAL, projections.V2_AUDIT, projections.LEGACY_MINIMAL, projections.LEGACY_AUDIT)] == [53, 22, 10, 29, 8, 22]
    assert projections.project(df, projections.compact_fields("en")).first().evidence_used == ["a", "b"]


def test_many_small_files_are_one_batch(spark, tmp_path):
    """F13 to F16: a bound on files gave one batch for each four files, however small."""
    folder, out = tmp_path / "in" / "upload=u", tmp_path / "out"
    folder.mkdir(parents=True)
    for k in range(9):
        (folder / f"{k}.txt").write_text(f"1\t{k + 1}\t.\tA\tG\t.\tPASS\t.\n")
    got = streams.drain(streams.stream_progress(streams.stream_vcf(spark, str(tmp_path / "in"))), str(out), "complete")
    assert [tuple(r) for r in got.collect()] == [("u", 9, 9)]
    assert sorted(p.name for p in out.iterdir() if p.name.startswith("v")) == ["v0"]


def test_scientific_form_of_ties(spark):
    """format_string rounds ties up, and by the shortest decimal form."""
    values = ["123450", "123550", "-123450", "0.00010005", "0.00010015", "1.2345e-26", "6.5435e120", "5e-8", "1e5", "99999", "0.001", "9.9995e22"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", t.compact_number(F.col("v")).alias("c")).collect()
    assert {r.v: r.c for r in got} == {v: f"{float(v):.3e}" if abs(float(v)) < 0.001 or abs(float(v)) >= 1e5 else f"{float(v):.6g}" for v in values}


def test_spans_and_reference_text_are_never_broadcast(spark, tmp_path):
    """F1, F2, F5 to F8, F10: packed in files both look small to the planner; unpacked they filled the driver."""
    from helixmill.operators import intervals
    from helixmill.operators import normalize as n

    spark.range(1000).selectExpr("'chr1' AS contig", "id * 9 AS start", "id * 9 + 3 AS end").write.parquet(str(tmp_path / "spans"))
    spark.range(3).selectExpr("'chr1' AS contig", "id AS chunk_no", "repeat('ACGTACGTAC', 100) AS sequence").write.parquet(str(tmp_path / "text"))
    alleles = spark.createDataFrame([("u", 1, 1, "chr1", 14, "A", "G", "0/1", False, "")], "upload_id string, line_no bigint, alt_index int, contig string, start bigint, ref string, alt string, gt string, several boolean, note string")
    placed = intervals.inside(alleles, intervals.covered_bins(spark.read.parquet(str(tmp_path / "spans")), ["contig"]), F.col("contig"), F.col("start"), "i")
    checked = n.with_reference_check(alleles, spark.read.parquet(str(tmp_path / "text")), 1000)
    stepped = interpret.left_step(alleles, spark.read.parquet(str(tmp_path / "text")), 1000, None)
    for df in (placed, checked, stepped):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_class_of_a_match_is_its_strongest_union(spark):
    """F18 to F32 and F34: matches are dealt by gene once, and the class is that of a join by brute force."""
    import random

    random.seed(3)
    kinds = [r[0] for r in match.REGIONS[:-1]]
    unions = [(random.randrange(5), random.choice(kinds), a := random.randrange(1000), a + random.randrange(40)) for _ in range(60)]
    spans = [(k, random.randrange(7), a := random.randrange(1000), a + random.randrange(-3, 30)) for k in range(300)]
    merged = spark.createDataFrame(unions, "gene_id int, merged_feature_type string, start bigint, end bigint")
    matches = spark.createDataFrame(spans, "k int, gene_id int, start bigint, end bigint")
    out = match.classify_features(matches, merged)
    assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1
    best = {k: min([kinds.index(t) for g_, t, c, e in unions if g_ == gene and a <= e and b >= c], default=7) for k, gene, a, b in spans}
    assert {r.k: r.overlap_feature_types for r in out.collect()} == {k: match.REGIONS[v][0] for k, v in best.items()}


def test_shortening_looks_at_the_first_words_only(spark):
    """results are those of the rule over the whole text."""
    import random
    import re

    def rule(o):
        words = re.findall(r"\w+", o, re.A)
        if len(words) <= 45 and len(o) <= 300:
            return o
        dotted = lambda x: x if x[-1:] in ".!?" and x else x + "."
        for sep in t.SEPARATORS["en"]:
            if sep in o and 18 <= len(re.findall(r"\w+", head := o.split(sep, 1)[0].strip(" "), re.A)) <= 42:
                return dotted(head)
        return dotted(" ".join(words[:42])) if words else o

    random.seed(5)
    parts = ["a", "bc", "but", "and that", ",", ";", "; ", "!", "longer" * 9, "and should", "é"]
    texts = [" ".join(random.choice(parts) for _ in range(random.choice((10, 44, 50, 60, 120)))).strip() for _ in range(400)]
    texts += [" ".join(["w"] * k) + tail for k in range(15, 50) for tail in ("; x", " but x y", " and that z", "; " + "w " * 60, ", but " + "v " * 60 + "v")]
    texts = [x.strip() for x in texts] + ["." * 400, "w" * 400]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").select("k", t.shorten_sentence(F.col("x")).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: rule(x) for k, x in enumerate(texts)}
    # the whole text's words are never listed
    plan = spark.range(1).select(t.shorten_sentence(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "{0,46}" in plan


@pytest.fixture()
def plain_joins(spark):
    """Plans as they are before Spark looks at sizes: every join a shuffle, every partition as dealt."""
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in fixed}
    for k, v in fixed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def shares(df):
    """Rows of each partition that has any."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_lines_are_numbered_in_more_tasks_than_groups(plain_joins, monkeypatch):
    monkeypatch.setattr(fixtures, "BLOCK", 100)
    lines = fixtures.view(plain_joins, SF, "fx_line")
    plain = plain_joins.sql(fixtures.VIEWS["fx_line"])
    assert lines.schema == plain.schema and lines.exceptAll(plain).isEmpty() and plain.exceptAll(lines).isEmpty()
    assert len(shares(lines)) > 16


def test_variants_without_identifier_do_not_meet_in_one_task(plain_joins):
    rows = registry.QUERIES["cls_variant_master"](plain_joins, SF)
    found = shares(rows)
    assert max(found) * 4 < sum(found)


def test_sentences_are_shortened_before_they_are_dealt(plain_joins):
    """No exchange of the chain carries a text that is not asked for; the six module names never gather the lines."""
    plan = registry.QUERIES["cls_normalized_interp"](plain_joins, SF)._jdf.queryExecution()
    left = next(x for x in plan.optimizedPlan().toString().split("Join LeftOuter")[1].split("\n") if "Project" in x)
    assert "AS interpretation_one_sentence_en" in left and "technical_notes_en" not in left
    assert not [x for x in plan.executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x and "% 6" in x]


def test_rows_without_identifier_or_place_are_dealt_to_all_tasks(plain_joins):
    canon = plain_joins.range(400).selectExpr("'u' AS upload_id", "id AS row_id", "CASE WHEN id = 7 THEN 'rs1' WHEN id % 2 = 0 THEN '' ELSE 'rs9' || id END AS rsid", "'df_ok' AS source_group")
    ready = plain_joins.createDataFrame([("u", "rs1", "1", "5", "A", "G", 1)], "upload_id string, rsid string, chrom string, pos string, exp_ref string, exp_alt string, seq long")
    called = plain_joins.createDataFrame([("u", "1", "5", "A", "G", "0/1", 3)], "upload_id string, chrom string, pos string, ref string, alt string, gt string, line_no long")
    out = match.consolidate(canon, ready, called)
    found = shares(out)
    assert sum(found) == 400 and max(found) < 100
    assert {r.match_status: r["count"] for r in out.groupBy("match_status").count().collect()} == {"match_strict": 1, "no_rsid_detected": 200, "rsid_without_coordinates": 199}


def test_lines_are_cut_once_and_rules_on_labels_run_once_a_label(plain_joins):
    records = vcf.parse_records(fixtures.view(plain_joins, SF, "vcf_lines"))
    assert records._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert "l_partkey" not in vcf.contig_labels(records)._jdf.queryExecution().optimizedPlan().toString()


def test_a_label_is_the_first_plain_one_of_its_contig(spark):
    row = lambda chrom: (chrom, "150", ".", "A", "G", ".", "PASS", ".", "GT", "0/1")
    text = lines(spark, row("chr 1"), row("1"), row("chr1"), row("HLA"), row("#1"), row("MT"), row("1"), ("chr2", "5"), row("chrM"))
    labels = vcf.contig_labels(vcf.parse_records(text.unionByName(spark.createDataFrame([("u", 99, None), ("u", 100, "")], LINE))))
    assert sorted(map(tuple, labels.collect())) == [("u", "chr1", "1"), ("u", "chrM", "MT")]


def test_sentences_are_worked_out_once_for_each_text_and_place(plain_joins):
    plan = registry.QUERIES["fn_shorten_sentence"](plain_joins, SF)
    assert "regexp" not in plan._jdf.queryExecution().optimizedPlan().toString()  # they are read, not worked out for each line
    whole = fixtures.view(plain_joins, SF, "interp").withColumn("place", F.col("row_id") % 300).withColumn("letters", q_text.letters())
    direct = whole.select("row_id", t.shorten_sentence(q_text.sentence()).alias("short"))
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, direct.collect()))


def test_lines_keep_their_texts_where_an_id_has_several(plain_joins, tmp_path):
    for name in ("lineitem", "supplier"):
        fixtures.base(plain_joins, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    documents = fixtures.base(plain_joins, SF, "documents").select("doc_id", "text").where("doc_id < 20")
    other = documents.where("doc_id < 3").select("doc_id", F.lit("one é two").alias("text"))
    documents.unionByName(other).unionByName(documents.where("doc_id = 1")).write.parquet(f"{tmp_path}/documents.parquet")
    rows, texts = fixtures.interp_and_texts(plain_joins, str(tmp_path))
    found = rows.join(texts, fixtures.TEXT).select("row_id", "interpretation_one_sentence_en")
    plain = fixtures.view(plain_joins, str(tmp_path), "interp").select("row_id", "interpretation_one_sentence_en")
    digests = lambda df: sorted(r.h for r in df.select(F.xxhash64(*df.columns).alias("h")).collect())
    assert digests(found) == digests(plain)


def test_texts_are_made_plain_before_they_meet_their_lines(plain_joins):
    plan = registry.QUERIES["fn_ascii_text"](plain_joins, SF)
    shape = plan._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < shape.index("Join Inner") < shape.index("ArrowEvalPython")
    direct = fixtures.view(plain_joins, SF, "interp").select("row_id", t.ascii_text("interpretation_one_sentence_en").alias("plain"))
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, direct.collect()))


def test_the_chain_joins_sentences_after_its_groups(plain_joins):
    """With sentences by key the chain gives what it gives with texts in its rows, and its shuffle holds none."""
    rows = plain_joins.range(40).selectExpr("id AS row_id", "concat('g', id % 7) AS gene", "'rs1' AS rsid", "'AG' AS observed_genotype", "'het' AS zygosity", "'A/G' AS ref_alt", "elt(1 + int(id % 3), 'High', 'Low', 'odd') AS final_confidence_level", "'false' AS gene_or_locus_ambiguity_flag", "if(id % 9 = 0, ' ', 'é') AS family_notes_en", "'nota' AS family_notes_es", "id % 4 AS k", *[f"'' AS {n}" for n in interpret.EVIDENCE])
    said = plain_joins.createDataFrame([(0, "Short é.", ""), (1, "w " * 20 + "; " + "x " * 40, "a" * 301), (2, None, "dos " * 50), (3, " y ", "z")], "k long, interpretation_one_sentence_en string, interpretation_one_sentence_es string")
    direct = interpret.normalise_interpretations(rows.join(said, "k").drop("k"))
    keyed = interpret.normalise_interpretations(rows, interpret.short_sentences(said), ("k",))
    assert sorted(map(str, keyed.select(*sorted(direct.columns)).collect())) == sorted(map(str, direct.select(*sorted(direct.columns)).collect()))
    shape = registry.QUERIES["cls_normalized_interp"](plain_joins, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "{0,46}" not in shape and " y que sigue" not in shape and "text#" not in shape


def test_compact_variants_work_out_a_sentence_once(plain_joins):
    found = registry.QUERIES["prj_compact_variant"](plain_joins, SF)
    shape = found._jdf.queryExecution().optimizedPlan().toString()
    assert shape.index("Join Inner") < shape.index(" y que sigue")
    whole = fixtures.view(plain_joins, SF, "interp").select(F.col("row_id").cast("string"), q_text.letters().alias("l"), (120 + F.col("row_id") % 200).cast("int").alias("at"))
    direct = whole.select("row_id", t.ascii_text(t.clean_str(F.concat(F.left("l", F.col("at")), F.lit(" y que sigue"), F.substr("l", F.col("at") + 1)), "nbsp")))
    assert sorted(map(tuple, found.select("row_id", "interpretation_one_sentence").collect())) == sorted(map(tuple, direct.collect()))


def test_columns_are_made_plain_together(spark):
    df = spark.createDataFrame([("a ", "b", None), ("é", "ß– ", ""), (None, " \x1cx", " ñ ")], "a string, b string, c string")
    found = df.select(t.ascii_texts([F.col(n) for n in "abc"]).alias("x"), *[t.ascii_text(n).alias(n) for n in "abc"]).collect()
    assert [r.x for r in found] == [[r.a, r.b, r.c] for r in found] == [["a", "b", ""], ["e", "-", ""], ["", "x", "n"]]


def test_counters_make_the_lines_once(spark, monkeypatch):
    made = []
    deal = fixtures.dealt_lines
    monkeypatch.setattr(fixtures, "dealt_lines", lambda lineitem: made.append(1) or deal(lineitem))
    registry.QUERIES["agg_source_counters"](spark, SF)
    assert len(made) == 1


def test_physical_variants_are_one_aggregate(spark):
    rows = spark.createDataFrame([("u", "k", 2, "b"), ("u", "k", 1, "c"), ("v", "k", 3, "a"), ("u", None, 4, "d"), ("u", None, 5, None)], "upload_id string, variant_key string, line_no int, x string")
    found = match.physical_variants(rows, ["line_no"])
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("u", "k", 1, "c", 2), ("v", "k", 3, "a", 1), ("u", None, 4, "d", 2)]))


def test_triage_split_writes_what_it_reads(spark, monkeypatch):
    from helixmill.plans import q_match as q

    written = []
    monkeypatch.setattr(q, "triaged", lambda s, d: spark.range(6).selectExpr("'u' AS upload_id", "id AS line_no", "1 AS alt_index", "'c' AS canon_row_id", "if(id < 2, 'include_ai', 'exclude_x') AS triage_decision", "'long' AS triage_reason"))
    monkeypatch.setattr(files, "staged", lambda df: written.extend(df.columns) or df)
    found = {r.side: r["count"] for r in q.QUERIES["set_triage_split"](spark, SF).groupBy("side").count().collect()}
    assert found == {"include": 2, "exclude": 4} and "triage_reason" not in written
