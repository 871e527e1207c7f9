"""Readers and writers on small files."""

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from isoweave.functions.seq import fixed3, weight_of
from isoweave.operators import convert, votes
from isoweave.plans import correct
from isoweave.sources import alignments, annotations, sequences, text


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return f"file://{p}"


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">one first\nACGT\nAC\n>two__3\nGG\n")
    got = {r.id: r.seq for r in sequences.read_fasta(spark, path).collect()}
    assert got == {"one first": "ACGTAC", "two__3": "GG"}


def test_fastq(spark, tmp_path):
    path = put(tmp_path, "a.fq", "@r1\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n")
    assert sorted((r.id, r.seq, r.qual) for r in sequences.read_fastq(spark, path).collect()) == [("r1", "ACGT", "IIII"), ("r2", "GG", "II")]


def test_lines_keep_their_order_over_files_and_splits(spark, tmp_path):
    """Small splits of several files: records stay whole and numbers follow the files."""
    want = []
    for f, n in (("a.fq", 500), ("b.fq", 37), ("c.fq", 663)):
        rows = [(f"{f}{i}", "ACGT" * (1 + i % 9), "I" * 4 * (1 + i % 9)) for i in range(n)]
        (tmp_path / f).write_text("".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in rows))
        want += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [(r.id, r.seq, r.qual) for r in sequences.read_fastq(spark, f"file://{tmp_path}/*.fq").collect()]
        rows = text.lines(spark, f"file://{tmp_path}/*.fq").orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(want)
    assert [r.line_no for r in rows] == list(range(4800)) and [r.value for r in rows[::4]] == [f"@{a}" for a, _, _ in want]


def golden_folder():
    """A folder of corrected.mod, .fa, .cov and .cov1: the one that ISOWEAVE_GOLDEN names, or one that lies beside the repository."""
    beside = pathlib.Path(__file__).resolve().parents[2].glob("*/output/*/corrected.mod")
    folder = os.environ.get("ISOWEAVE_GOLDEN") or next((str(p.parent) for p in sorted(beside)), None)
    if not folder:
        pytest.skip("no golden folder is named")
    return folder


def test_correction_of_the_example_gives_its_reads(spark):
    """Long and short reads of the example, aligned and tallied: as many bases covered, and nearly all called alike."""
    results = pathlib.Path(golden_folder())
    data = results.parents[1] / "data"
    long_, listed = next(data.glob("*.fa"), None), next(data.glob("*list*"), None)
    if not long_ or not listed:
        pytest.skip("the golden folder has no inputs")
    shards = [sequences.read_fasta(spark, f"file://{data}/{os.path.basename(x)}").withColumn("weight", weight_of(F.col("id"))) for x in listed.read_text().split()]
    (got,) = correct.correct(sequences.read_fasta(spark, f"file://{long_}"), shards).collect()
    want = (results / "corrected.fa").read_text().split("\n")[1]
    covered = int((results / "corrected.cov1").read_text().split("\t")[1])
    assert abs(got.covered - covered) <= 3 and abs(got.len - len(want)) <= 3
    pieces = [want[i : i + 20] in got.seq for i in range(0, len(want) - 20, 5)]
    assert sum(pieces) >= 0.99 * len(pieces)


def test_shipped_votes_give_the_shipped_reads(spark):
    """Votes replayed from the golden folder give the same texts."""
    folder = golden_folder()
    read = lambda ending: open(f"{folder}/corrected.{ending}").read()
    tallied = annotations.read_votes(spark, f"file://{folder}/corrected.mod")
    piled = votes.pileup(tallied)
    called = votes.consensus(piled)
    (r,) = called.collect()
    assert f">{r.id}\n{r.seq}\n" == read("fa") and r["mask"] == read("cov").split("\n")[1]
    assert annotations.coverage_report(called).first().value == read("cov1").rstrip("\n")
    first = lambda line: line.split("\t")[:5] + [sorted(line.split("\t")[5].split(";"))]
    assert [first(x.value) for x in annotations.vote_report(piled).collect()] == [first(x) for x in read("mod").rstrip("\n").split("\n")]


def test_settings_run(spark, tmp_path):
    import random

    rng = random.Random(3)
    true = "".join(rng.choice("ACGT") for _ in range(400))
    raw = true[:200] + true[201:]  # one base is missing
    long_ = put(tmp_path, "long.fa", f">r one\n{raw}\n")
    shards = [put(tmp_path, f"s{k}.fa", "".join(f">n{i}__3\n{true[i : i + 90]}\n" for i in range(k, 300, 20))) for k in (0, 10)]
    listed = put(tmp_path, "list.txt", "\n".join([*shards, shards[0]]) + "\n")
    out = f"file://{tmp_path}/out"
    got = correct.run_settings(spark, f"PacBio_fasta\t{long_}\nIllumina_fasta_list\t{listed}\nOutput_folder\t{out}\n").collect()
    assert [(r.id, r.seq) for r in got] == [("r one", true)]
    assert sequences.read_fasta(spark, f"{out}/fa").first().seq == true
    assert spark.read.text(f"{out}/cov1").first().value.split("\t")[0] == "r one"
    with pytest.raises(ValueError):
        correct.run_settings(spark, "Output_folder\tx\n")


def test_sam_to_refflat(spark, tmp_path):
    path = put(tmp_path, "a.sam", "@HD\tx\nr1\t16\tchr1\t101\t0\t10M5N4M\t*\t0\t0\tACGTACGTACACGT\t*\tNM:i:0\tMD:Z:14\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    sam = alignments.read_sam(spark, path)
    assert [r.md for r in sam.where("qname = 'r1'").collect()] == ["14"]
    (r,) = convert.sam_to_refflat(sam).collect()
    assert (r.chr, r.strand, r.exon_starts, r.exon_ends) == ("chr1", "-", [100, 115], [110, 119])


def test_gff3(spark, tmp_path):
    body = "chr1\tx\tmRNA\t11\t100\t.\t+\t.\tID=iso1.mrna1;Name=iso1;coverage=99.0;identity=98.0;matches=50;\nchr1\tx\texon\t11\t30\t99\t+\t.\tID=e1;Parent=iso1.mrna1;Target=iso1 1 20 +;\nchr1\tx\texon\t61\t100\t99\t+\t.\tID=e2;Parent=iso1.mrna1;Target=iso1 21 60 +;\n"
    other = body.replace("mrna1", "mrna2").replace("matches=50", "matches=40").replace("chr1", "chr2")
    gff = alignments.read_gff3(spark, put(tmp_path, "a.gff", other + body))
    flat, cov = convert.gff3_to_refflat(gff, spark.createDataFrame([("iso1", 60)], "id string, len long"))
    (f,), (c,) = flat.collect(), cov.collect()
    assert (f.chr, f.tx_start, f.tx_end, f.exon_starts, f.exon_ends) == ("chr1", 10, 100, [10, 60], [30, 100])
    assert (c.read_start, c.read_end, c.covered, c.pct) == (1, 60, 60, 98.3)


def test_gff3_lines_are_shuffled_once_and_wells_settled(spark, tmp_path):
    line = lambda kind, s, e, more: f"chr1\tx\t{kind}\t{s}\t{e}\t90\t+\t.\t{more}"
    body = []
    # matches of the paths of each read, in file order: the second, third and fifth are bettered
    for k, paths in enumerate([[9], [5, 9], [5, 5, 9], [9, 5, 9], [5, 4, 6], [0], [3], [2, 2]]):
        for n, m in enumerate(paths):
            path = f"sub_w{k // 2}_1_r{k}.mrna{n + 1}"
            body += [line("mRNA", 11 + n, 100, f"ID={path};coverage=99;identity=98;matches={m};")]
            body += [line("CDS", 21, 90, f"ID=c;Parent={path};Target=t 1 2 +;"), line("exon", 61, 100, f"ID=e;Parent={path};Target=t 51 90 +;"), line("exon", 11 + n, 40, f"ID=e;Parent={path};Target=t 1 30 +;")]
    body.append(line("mRNA", 1, 9, "ID=sub_w9_1_empty.mrna1;coverage=99;identity=98;matches=1;"))
    gff = alignments.read_gff3(spark, put(tmp_path, "w.gff", "\n".join(body) + "\n"))
    lengths = spark.createDataFrame([(f"sub_w{k // 2}_1_r{k}", 100) for k in range(8)], "id string, len long")
    start = lambda flat: {r.tx[-1]: (r.tx_start, r.cds_start, r.exon_ends) for r in flat.collect()}
    all_ = {str(k): (10 + n, 20, [40, 100]) for k, n in enumerate([0, 1, 2, 0, 2, 0, 0, 0])}
    flat, cov = convert.gff3_to_refflat(gff, lengths)
    assert start(flat) == all_ and {(r.read_start, r.read_end, tuple(r.exon_scores)) for r in cov.collect()} == {(1, 90, (90.0, 90.0))} and cov.count() == 8
    assert start(convert.gff3_to_refflat(gff, lengths, use_best=False)[0]) == {k: all_[k] for k in "03567"}
    assert start(convert.gff3_to_refflat(gff, lengths, use_best=False, pacbio=True)[0]) == {k: all_[k] for k in "67"}
    for rows in (flat, cov):
        text = rows.select("*")._jdf.queryExecution().executedPlan().toString()
        assert text.count("Scan text") <= 4 and text.count("hashpartitioning(path#") <= 2 and text.count("hashpartitioning(file#") <= 4


def test_gtf_runs(spark, tmp_path):
    line = lambda t, s, e: f'1\tc\texon\t{s}\t{e}\t.\t+\t.\tgene_id "G"; transcript_id "{t}"; gene_name "N";\n'
    gtf = alignments.read_gtf(spark, put(tmp_path, "a.gtf", line("t1", 1, 10) + line("t1", 21, 30) + line("t2", 5, 9)))
    assert [(r.tx, r.chr, r.exon_starts) for r in convert.gtf_to_refflat(gtf).collect()] == [("t1", "chr1", [0, 20])]
    assert len(convert.gtf_to_refflat(gtf, compat=False).collect()) == 2


def test_refflat_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.txt", "#x\nG\tT\t6\t+\t0\t90\t0\t0\t2\t0,60,\t30,90,\n")
    t = annotations.read_refflat(spark, path)
    (r,) = t.collect()
    assert (r.chr, r.exon_starts, r.members) == ("chr6", [0, 60], None)
    out = f"file://{tmp_path}/out"
    annotations.write_refflat(t.drop("members"), out)
    assert spark.read.text(out).first().value == "G\tT\tchr6\t+\t0\t90\t0\t0\t2\t0,60\t30,90"


def test_junction_bed(spark, tmp_path):
    path = put(tmp_path, "j.bed", "track x\n1\t4482658\t4483189\tJ\t1\t-\t4482658\t4483189\t255,0,0\t2\t91,9\t0,522\n2\t5\t50\tK\t3\t+\n")
    assert sorted((r.chr, r.left, r.right) for r in annotations.read_junction_bed(spark, path).collect()) == [("chr1", 4482749, 4483180), ("chr2", 5, 50)]


def test_bedgraph_strand_by_file(spark, tmp_path):
    a, b, c = put(tmp_path, "a.bg", "track plus\nchr1\t0\t5\t2\n"), put(tmp_path, "b.bg", "track minus\nchr1\t5\t9\t1\n"), put(tmp_path, "c.bg", "chr1\t5\t9\t1\n")
    assert sorted((r.start, r.strand) for r in annotations.read_bedgraph(spark, [a, b, c]).collect()) == [(0, "-"), (5, "+")]


def test_vote_report_round_trip(spark, tmp_path):
    v = spark.createDataFrame([("r", 0, "A", 4.5), ("r", 0, "Del", 3.0), ("r", 1, "", 2.0)], "id string, pos int, allele string, weight double")
    lines = [r.value for r in annotations.vote_report(votes.pileup(v)).collect()]
    assert lines == ["r\t0\t4.5\t7.5\t0.600\tA=4.5;Del=3", "r\t1\t2\t2\t1.000\t=2"]
    back = annotations.read_votes(spark, put(tmp_path, "x.mod", "\n".join(lines) + "\n"))
    assert sorted((r.pos, r.allele, r.weight) for r in back.collect()) == [(0, "A", 4.5), (0, "Del", 3.0), (1, "", 2.0)]


def test_wells_side_tables_and_settings(spark, tmp_path):
    w = annotations.read_wells(spark, put(tmp_path, "s.csv", "Zmw,b,c,d,e,f,g,h,i,Productive\n7,,,,,,,,, 1 \n8,,,,,,,,,0\n"))
    assert sorted((r.zmw, r.productive) for r in w.collect()) == [("7", 1), ("8", 0)]
    t = annotations.read_side_table(spark, put(tmp_path, "l.txt", "a\t1\na\t2\nb\t3\n"), "id", "len")
    assert sorted((r.id, r.len) for r in t.collect()) == [("a", "2"), ("b", "3")]
    assert annotations.read_spec("a\tb\n\nc\n")["a"] == "b"


def test_numbers_as_text(spark):
    df = spark.createDataFrame([("x__30", 0.0625), ("x", 0.0635), ("x__y", 1.0)], "id string, v double")
    assert [(r.w, r.t) for r in df.select(weight_of(F.col("id")).alias("w"), fixed3("v").alias("t")).collect()] == [(30.0, "0.062"), (1.0, "0.064"), (0.0, "1.000")]
