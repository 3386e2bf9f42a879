"""Readers and writers over small files, against values worked out by hand."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from typeloom.sources import text as T


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(content.encode()) if name.endswith(".gz") else content.encode())
    return f"file://{path}"


def test_blast_files_to_calls(spark, tmp_path):
    from typeloom.operators.calling import best_hits, call_loci

    put(tmp_path, "b/s1.tsv", "# x\n\nabc_1\tc1\t95\t480\t480\t1\t480\t10\t489\t0\t700\tACGT\nabc_2\tc1\t99\t480\t480\t1\t480\t900\t421\t0\t700\nabc_2\tc1\t99\t460\t480\t1\t460\t1\t460\t0\t700\nzzz_1\tc\t100\t5\t5\t1\t5\t1\t5\t0\t1\nshort\tline\n")
    put(tmp_path, "b/s2.tsv", "def-7\tc2\t100\t300\t300\t1\t300\t5\t304\t0\t500\ndef-8\tc2\t100\t300\t0\t1\t300\t5\t304\t0\t500\n")
    hits = T.read_blast(spark, f"file://{tmp_path}/b", spark.createDataFrame([("abc",), ("def",)], "locus string"))
    rows = hits.orderBy("sample_id", "hit_ordinal").collect()
    assert [(r.sample_id, r.locus, r.allele_id, r.coverage, r.strand, r.query_start, r.query_end, r.depth) for r in rows] == [("s1", "abc", "1", 1.0, "+", 10, 489, None), ("s1", "abc", "2", 1.0, "-", 421, 900, None), ("s1", "abc", "2", 460 / 480, "+", 1, 460, None), ("s2", "def", "7", 1.0, "+", 5, 304, None), ("s2", "def", "8", 0.0, "+", 5, 304, None)]
    assert {(r.sample_id, r.locus, r.allele_id): r.coverage for r in best_hits(hits).collect()}["s1", "abc", "2"] == 1.0
    assert {(r.sample_id, r.locus): (r.allele_id, r.call_type) for r in call_loci(hits).collect()} == {("s1", "abc"): ("2", "closest"), ("s2", "def"): ("7", "exact")}


def test_res_files(spark, tmp_path):
    put(tmp_path, "k/s1.res", "#Template\tScore\tExpected\tTemplate_length\tTemplate_Identity\tTemplate_Coverage\tQuery_Identity\tQuery_Coverage\tDepth\tq_value\tp_value\nabc_12\t 350\t1\t450\t  99.8\t100.0\t99.8\t100.0\t42.0\t0\t1e-9\nxyz_1\t1\t1\t1\t1\t1\t1\t1\t1\t1\t1\nabc\t5\t1\t10\t50\t20\t1\t1\t3\t1\t1\n")
    loci = spark.createDataFrame([("abc",)], "locus string")
    for reads, depth in ((True, 42.0), (False, None)):
        got = T.read_res(spark, f"file://{tmp_path}/k", loci, reads=reads).orderBy("hit_ordinal").collect()
        assert [(r.sample_id, r.locus, r.allele_id, r.identity, r.coverage, r.score, r.depth, r.alignment_length) for r in got] == [("s1", "abc", "12", 99.8, 1.0, 350.0, depth, 450), ("s1", "abc", "", 50.0, 0.2, 5.0, reads and 3.0 or None, 10)]


def test_paf_and_coords(spark, tmp_path):
    put(tmp_path, "p/s1.paf", "abc_1\t100\t0\t90\t-\tctg\t5000\t10\t100\t88\t90\t60\ttp:A:P\tNM:i:2\nabc_2\t0\t0\t0\t+\tctg\t5\t0\t0\t0\t0\t0\nbad\n")
    got = T.read_paf(spark, f"file://{tmp_path}/p").orderBy("hit_ordinal").collect()
    assert [(r.sample_id, r.allele_id, r.identity, r.coverage, r.strand, r.query_contig_length, r.alignment_length) for r in got] == [("s1", "1", 100.0 * 88 / 90, 0.9, "-", 5000, 90), ("s1", "2", 0.0, 0.0, "+", 5, 0)]
    put(tmp_path, "c/s2.coords", "NUCMER\n1\t9\t1\t9\t9\t9\t99.00\t100\t10\t9\t90.00\tctg\tabc_3\n1\t9\t1\t9\t9\t9\t69.90\t100\t10\t9\t90.00\tctg\tabc_4\n1\t2\n")
    got = T.read_coords(spark, f"file://{tmp_path}/c").collect()
    assert [(r.sample_id, r.locus, r.allele_id, r.identity, r.coverage, r.alignment_length) for r in got] == [("s2", "abc", "3", 99.0, 0.9, 9)]


def test_fastq(spark, tmp_path):
    put(tmp_path, "q/a.fastq", "".join(f"@r{i} x\nACGT{'A' * i}\n+\nIIII{'I' * i}\n" for i in range(50)) + "@cut\nAC\n")
    put(tmp_path, "q/b.fq.gz", "".join(f"@g{i}\nTT\n+\nII\n" for i in range(3)))
    got = {(r.file.rsplit("/", 1)[1], r.read_ordinal): (r.read_id, r.seq, r.quality) for r in T.read_fastq(spark, f"file://{tmp_path}/q").collect()}
    want = {("a.fastq", i): (f"r{i}", "ACGT" + "A" * i, "IIII" + "I" * i) for i in range(50)} | {("b.fq.gz", i): (f"g{i}", "TT", "II") for i in range(3)}
    assert got == want
    assert T.read_fastq(spark, f"file://{tmp_path}/q", most_reads=2).count() == 4


def test_schemes(spark, tmp_path):
    for name in ("x.tfa", "x.fasta", "b.fasta", "a.tfa", "one.tsv", "two.txt"):
        put(tmp_path, f"db/pub/s/{name}", ">x\nA\n")
    r = T.scheme_files(spark, f"file://{tmp_path}/db/pub/s").first()
    assert (r.loci, r.files, r.profile_file) == (["a", "x", "b"], {"a": "a.tfa", "x": "x.tfa", "b": "b.fasta"}, "two.txt")
    put(tmp_path, "db/pub/s/.meta.json", json.dumps({"loci": ["gone", "b"]}))
    put(tmp_path, "db/_catalog/s/.meta.json", "{}")
    assert T.scheme_files(spark, f"file://{tmp_path}/db/pub/s").first().loci == ["gone", "b", "a", "x"]
    assert [(r.provider, r.scheme) for r in T.cached_schemes(spark, f"file://{tmp_path}/db").collect()] == [("pub", "s")]
    put(tmp_path, "cat/p1.json", json.dumps({"schemes": [{"name": "n1", "organism": "o"}, {"name": "n2", "organism": None}]}))
    assert [(r.provider, r.row_ordinal, r.name) for r in T.read_catalog(spark, f"file://{tmp_path}/cat").orderBy("row_ordinal").collect()] == [("p1", 0, "n1"), ("p1", 1, "n2")]


def test_profiles_and_metadata(spark, tmp_path):
    path = put(tmp_path, "st.txt", "st\tdnaN\tgyrB\n1\t1\n2\t1\t5\n3\t1\t5\nx\t9\t9\n4\t \t2\n")
    assert [(r.profile, r.st) for r in T.read_st_profiles(spark, path, ["dnaN", "gyrB"]).collect()] == [(["1", "5"], 3)]
    path = put(tmp_path, "m.csv", "name,ID,year\nx,s1, 1999 \n,s2,\ny,,2000\nz,s1,2001\n")
    assert {r["sample"]: r.fields for r in T.read_metadata(spark, path).collect()} == {"s1": {"name": "z", "year": "2001"}, "s2": {}}
    path = put(tmp_path, "p.tsv", "FILE\tSCHEME\tST\ta\tb\ns1\tx\t1\t2\t~3\n\tx\t1\t2\t3\ns2\tx\t1\t\t4\n")
    m = T.check_matrix(T.read_profile_matrix(spark, path))
    assert [(r["sample"], r.locus, r.locus_ordinal, r.value) for r in m.orderBy("sample_ordinal", "locus_ordinal").collect()] == [("s1", "a", 1, "2"), ("s1", "b", 2, "~3"), ("s2", "a", 1, ""), ("s2", "b", 2, "4")]
    with pytest.raises(ValueError, match="duplicate"):
        T.check_matrix(T.read_profile_matrix(spark, put(tmp_path, "d.tsv", "FILE\ta\ns1\t1\ns1\t2\n")))
    with pytest.raises(ValueError, match="no sample"):
        T.check_matrix(T.read_profile_matrix(spark, put(tmp_path, "e.tsv", "FILE\ta\n")))
    rows = spark.createDataFrame([(["1", "a", "b"],), (["2", "c"],), (["3", "d", "e", "f"],)], "cells array<string>")
    assert [(r.ST, r.profile) for r in T.project_profiles(rows, ["ST", "x", "y"], ["y", "q", "x"]).collect()] == [("1", ["b", "-", "a"]), ("3", ["e", "-", "d"])]
    wide = spark.createDataFrame([("s", "1", "2", 5), ("s", "3", "4", 2), ("t", "5", "6", 1)], "FILE string, a string, b string, o int")
    assert {r.locus: r.value for r in T.first_sample_cells(wide, "FILE", "s", "o").collect()} == {"a": "3", "b": "4"}


def test_novel_files(spark, tmp_path):
    put(tmp_path, "n/dnaN_novel.fasta", ">dnaN_n1 sample=iso_A iso_B\nac\ngt\n>dnaN_x_n2\nTT\n")
    got = {r.allele_id: (r.locus, r.samples, r.seq) for r in T.read_novel_fasta(spark, f"file://{tmp_path}/n").collect()}
    assert got == {"n1": ("dnaN", ["iso_A", "iso_B"], "ACGT"), "x_n2": ("dnaN", [], "TT")}
    path = put(tmp_path, "profiles_novel.txt", "ST\tsample\ta\tb\nN1\ts\t1\t\n")
    assert [(r.st, r["sample"], r.profile) for r in T.read_novel_profiles(spark, path).collect()] == [("N1", "s", {"a": "1"})]
    path = put(tmp_path, "typing.json", json.dumps([{"sample_id": "s", "scheme": "x", "st": None, "allele_calls": {"a": {"allele_id": "n1", "call_type": "novel", "novel_sequence": "AC"}}}]))
    assert [(r.sample_id, r.locus, r.call_type, r.novel_sequence) for r in T.read_typing_json(spark, path).collect()] == [("s", "a", "novel", "AC")]
    path = put(tmp_path, "g.fna", ">c1_1 # 5 # 40 # -1 # ID=1;partial=01;x\n" + "A" * 120 + "\n>c1_2 # x # 9\nACGT\n>c2\n" + "C" * 100 + "\n")
    got = [(r.sample_id, r.gene_id, r.contig_id, r.start, r.end, r.strand, r.partial_begin, r.partial_end, len(r.seq)) for r in T.read_predicted_genes(spark, path).orderBy("gene_id").collect()]
    assert got == [("g", "gene_1", "c1_1", 5, 40, "-", False, True, 120), ("g", "gene_3", "c2", None, None, None, None, None, 100)]
    path = put(tmp_path, "cluster.tsv", "r2\tm1\nr1\tm2\nr2\tm3\n")
    assert {r.member: r.locus for r in T.read_clusters(spark, path).collect()} == {"m1": "locus_1", "m2": "locus_2", "m3": "locus_1"}
    records = spark.createDataFrame([("a", "1", 1), ("a", "2", 3), ("b", "4", 2)], "contig_id string, seq string, ordinal int")
    assert {r.contig_id: r.seq for r in T.last_records(records).collect()} == {"a": "2", "b": "4"}


def test_writers(spark, tmp_path):
    from typeloom.sinks import tables as S

    alleles = spark.createDataFrame([("a", "n10", "A" * 61, ["s2", "s1"]), ("a", "n2", "CC", ["s3"]), ("b", "n1", "GG", [])], "locus string, allele_id string, seq string, samples array<string>")
    S.write_novel_fasta(alleles, f"file://{tmp_path}/n")
    text = {f.parent.name: f.read_text() for f in (tmp_path / "n").glob("locus=*/part-*")}
    assert text == {"locus=a": ">a_n2 sample=s3\nCC\n>a_n10 sample=s2 s1\n" + "A" * 60 + "\nA\n", "locus=b": ">b_n1 sample=\nGG\n"}
    for st in ("N1", "N2"):
        S.append_novel_profiles(spark.createDataFrame([(st, "s", {"a": "1"})], "st string, sample string, profile map<string,string>"), ["a", "b"], f"file://{tmp_path}/p")
    assert {(r.st, tuple(sorted(r.profile.items()))) for r in T.read_novel_profiles(spark, f"file://{tmp_path}/p").collect()} == {("N1", (("a", "1"), ("b", "-"))), ("N2", (("a", "1"), ("b", "-")))}
    genes = spark.createDataFrame([("s", "gene_1", None, 0, 9, "+", True, None, "ACGT")], "sample_id string, gene_id string, contig_id string, start int, end int, strand string, partial_begin boolean, partial_end boolean, seq string")
    assert [tuple(r) for r in S.cds_coordinates(genes, "meta", None, True).collect()] == [("s", "gene_1", "", "", "9", "+", 4, 1, 0, "meta", "", 1)]
    records = spark.createDataFrame([("b", 1, "h2", "CC"), ("a", 2, "h1", "GG"), ("a", 1, "h0", "T")], "file string, ordinal int, header string, seq string")
    assert [r.value for r in S.merged_fasta(records).collect()] == [">h0\nT", ">h1\nGG", ">h2\nCC"]
    rows = spark.createDataFrame([(2, "s2", 5), (1, "s1", None)], "o int, sample string, n int")
    assert S.text_table(rows, "o").first().text == "sample | n\n-------+--\ns1     |  \ns2     | 5"
    assert S.text_table(rows.limit(0), "o").first().text == "(no rows)"
    assert json.loads(S.json_payload(rows, "o", ["two"]).first()[0]) == {"rows": [{"sample": "s1"}, {"sample": "s2", "n": 5}], "summary": ["two"]}
    meta = spark.createDataFrame([("s1", {"year": "1999"})], "sample string, fields map<string,string>")
    assert {tuple(r) for r in S.projected(rows, ["sample"], meta, ("year",)).collect()} == {("s1", "1999"), ("s2", "")}
    with pytest.raises(ValueError, match="unknown columns q"):
        S.projected(rows, ["sample", "q"])
    long = spark.createDataFrame([("x", "x", 0), ("x", "y", 3), ("y", "x", 3), ("y", "y", 0)], "row string, column string, value int")
    labels = spark.createDataFrame([("y", 1), ("x", 0)], "column string, ordinal int")
    assert sorted(r.line for r in S.matrix_rows(long, labels).collect()) == ["sample_id\tx\ty", "x\t0\t3", "y\t3\t0"]
    errors = spark.createDataFrame([("input",), ("input",), ("typing",)], "stage string")
    assert json.loads(S.error_report(errors).first()[0]) == {"total": 3, "by_stage": {"input": 2, "typing": 1}}


def test_custom_scheme(spark, tmp_path):
    from typeloom.operators.inputs import with_novel
    from typeloom.sinks import tables as S

    source = spark.createDataFrame([("a", "1", "AC", 0), ("b", "1", "GG", 0)], "locus string, allele_id string, seq string, ordinal int")
    novel = spark.createDataFrame([("a", "n1", "TT", ["s1", "s2"], 0), ("zz", "n1", "A", ["s"], 0)], "locus string, allele_id string, seq string, samples array<string>, ordinal int")
    profiles = with_novel(spark.createDataFrame([("1", {"a": "1", "b": "1"}, 0)], "st string, profile map<string,string>, ordinal int"), spark.createDataFrame([("N1", {"a": "n1"}, 0)], "st string, profile map<string,string>, ordinal int"))
    S.write_scheme(spark, f"file://{tmp_path}/s", "custom_1", with_novel(source, novel), profiles, ["a", "b"], {"source": "x"})
    text = {f.parent.name: f.read_text() for f in (tmp_path / "s").glob("alleles/locus=*/part-*")}
    assert text == {"locus=a": ">a_1\nAC\n>a_n1 sample=s1 s2\nTT\n", "locus=b": ">b_1\nGG\n"}
    rows = spark.read.option("header", True).option("sep", "\t").csv(f"file://{tmp_path}/s/custom_1").collect()
    assert {(r.ST, r.a, r.b) for r in rows} == {("1", "1", "1"), ("N1", "n1", "-")}
    assert json.loads(spark.read.text(f"file://{tmp_path}/s/meta").first()[0]) == {"scheme": "custom_1", "loci": ["a", "b"], "source": "x"}


def test_registries(spark, tmp_path):
    from typeloom.functions import sequences as Q
    from typeloom.operators import catalog, compare
    from typeloom.sources import backends as B

    put(tmp_path, "k/s1.res", "#Template\tScore\tExpected\tTemplate_length\tTemplate_Identity\tTemplate_Coverage\tQ\tC\tDepth\nabc_12\t350\t1\t450\t99.8\t100.0\t9\t9\t42.0\n")
    assert B.hits_of(spark, "KMA", f"file://{tmp_path}/k", reads=True).first().depth == 42.0
    with pytest.raises(ValueError, match="unknown backend 'x'; one of blastn, kma, minimap2, nucmer"):
        B.hits_of(spark, "x", "")
    with pytest.raises(ValueError, match="takes no reads"):
        B.hits_of(spark, "blastn", "", reads=True)
    B.register_backend(B.Backend("mine", lambda s, path, loci, sample: s.range(3), True))
    assert B.hits_of(spark, "mine", "").count() == 3
    with pytest.raises(ValueError, match="unknown provider"):
        B.catalog_of(spark, "q", "")
    Q.register_strategy("Length", F.length)
    rows = spark.createDataFrame([("ac-gt",)], "s string")
    assert rows.select(Q.fingerprint(F.col("s"), "length")).first()[0] == 4
    with pytest.raises(ValueError, match="unknown strategy"):
        Q.fingerprint(F.col("s"), "none")
    blocked = spark.createDataFrame([("p", "d1")], "provider string, name string")
    catalog.reject_blocked("x", "p", "d2", blocked)
    with pytest.raises(ValueError, match="blocked"):
        catalog.reject_blocked("x", "p", "d1", blocked)
    with pytest.raises(ValueError, match="duplicate sample 's'"):
        compare.one_row_each(spark.createDataFrame([("s",), ("s",)], "sample_id string"))
