"""Registered queries of the readers and writers: tables written as text files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoweave.functions.seq import exon_lengths
from isoweave.operators import convert, junctions, votes
from isoweave.plans.registry import query, transcripts
from isoweave.sources import alignments, annotations, sequences
from isoweave.sources.scratch import new_path, written

CLEAN = "regexp_replace(seq, '[^ACGTN]', '', 'g')"


def clean(get):
    return get("sequences").select(F.col("id").cast("string").alias("id"), F.regexp_replace("seq", "[^ACGTN]", "").alias("seq"))


def put(df, name: str, compression: str = "none") -> str:
    """Writes lines and returns where."""
    path = new_path(df.sparkSession, name)
    df.write.text(path, compression=compression)
    return path


def tabs(*columns) -> F.Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]).alias("value")


@query(f"SELECT 'read ' || CAST(id AS VARCHAR) || ' of x' AS id, {CLEAN} AS seq FROM {{sequences}}")
def fasta_scan(get):
    rows = clean(get).select(F.concat(F.lit("read "), "id", F.lit(" of x")).alias("id"), F.regexp_replace("seq", "(.{60})", "$1\n").alias("seq"))
    path = new_path(rows.sparkSession, "fasta")
    sequences.write_fasta(rows, path)
    return sequences.read_fasta(rows.sparkSession, path)


@query(f"SELECT CAST(id AS VARCHAR) AS id, {CLEAN} AS seq, repeat('I', length({CLEAN})) AS qual FROM {{sequences}}")
def fastq_scan(get):
    rows = clean(get).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    path = new_path(rows.sparkSession, "fastq")
    sequences.write_fastq(rows, path)
    return sequences.read_fastq(rows.sparkSession, path)


@query("SELECT CAST(tx AS VARCHAR) AS qname, CAST(tx % 64 AS INT) AS flag, 'chr' || CAST(chr AS VARCHAR) AS rname, tx_start + 1 AS pos, CAST(tx_end - tx_start AS VARCHAR) || 'M' AS cigar, CAST(tx_end - tx_start AS VARCHAR) AS md, CAST(2 AS INT) AS n_tags FROM {spans}")
def sam_scan(get):
    size = F.col("tx_end") - F.col("tx_start")
    rows = get("spans").select(tabs("tx", F.col("tx") % 64, F.concat(F.lit("chr"), "chr"), F.col("tx_start") + 1, F.lit(60), F.concat(size.cast("string"), F.lit("M")), F.lit("*"), F.lit(0), F.lit(0), F.lit("ACGT"), F.lit("*"), F.lit("NM:i:0"), F.concat(F.lit("MD:Z:"), size.cast("string"))))
    head = rows.sparkSession.createDataFrame([("@HD\tVN:1.6",), ("# comment",)], "value string")
    got = alignments.read_sam(rows.sparkSession, put(head.unionByName(rows), "sam"))
    return got.select("qname", "flag", "rname", "pos", "cigar", "md", F.size("tags").alias("n_tags"))


def _gff(get, name=None, of=None):
    """mRNA and exon lines; every third transcript has a second, worse path on another chr, half of them in front.

    Transcripts are sorted, not their lines, which are made in order from each.
    """
    name = F.concat(F.lit("t"), F.col("tx").cast("string")) if name is None else name
    copies = F.when(F.col("tx") % 6 == 0, F.array(F.lit(1), F.lit(2))).when(F.col("tx") % 3 == 0, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1)))
    t = transcripts(get) if of is None else of
    t = t.select("tx", "chr", "strand", "tx_start", "tx_end", "exon_starts", "exon_ends").orderBy("tx").withColumn("copy", F.explode(copies))
    t = t.withColumn("path", F.concat(name, F.lit(".mrna"), F.col("copy").cast("string"))).withColumn("chrom", F.concat(F.lit("chr"), (F.col("chr") + 10 * (F.col("copy") - 1)).cast("string")))
    matches = exon_lengths(F.col("exon_starts"), F.col("exon_ends")) - 5 * (F.col("copy") - 1)
    mrna = tabs("chrom", F.lit("x"), F.lit("mRNA"), F.col("tx_start") + 1, "tx_end", F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID="), "path", F.lit(";Name=n;coverage=99.5;identity=98.5;matches="), matches.cast("string"), F.lit(";")))

    def exon(x, k):
        first = k * 100 + 1
        # one exon in fifty lies on the other strand than its path
        strand = F.when((F.col("tx") + k) % 50 == 0, F.when(F.col("strand") == "+", "-").otherwise("+")).otherwise(F.col("strand"))
        return tabs("chrom", F.lit("x"), F.lit("exon"), x["exon_starts"] + 1, x["exon_ends"], 90 + k % 10, strand, F.lit("."), F.concat(F.lit("ID=e;Parent="), F.col("path"), F.lit(";Target=t "), first.cast("string"), F.lit(" "), (first + 79).cast("string"), F.lit(" +;")))

    cds = tabs("chrom", F.lit("x"), F.lit("CDS"), F.col("tx_start") + 11, F.col("tx_end") - 10, F.lit("."), "strand", F.lit("0"), F.concat(F.lit("ID=c;Parent="), "path", F.lit(";Target=t 1 9 +;")))
    own = F.concat(F.array(mrna), F.transform(F.arrays_zip("exon_starts", "exon_ends"), exon), F.when(F.col("tx") % 4 == 0, F.array(cds)).otherwise(F.array().cast("array<string>")))
    lines = t.select(F.explode(own).alias("value"))
    return alignments.read_gff3(lines.sparkSession, put(lines, "gff3", "gzip"))


@query("""SELECT 't' || CAST(tx AS VARCHAR) AS tx, 't' || CAST(tx AS VARCHAR) AS gene, 'chr' || CAST(chr AS VARCHAR) AS chr, strand, tx_start, tx_end, CASE WHEN tx % 4 = 0 THEN tx_start + 10 ELSE tx_start END AS cds_start, CASE WHEN tx % 4 = 0 THEN tx_end - 10 ELSE tx_start END AS cds_end, CAST(n_exon AS INT) AS n_exon, starts, ends
    FROM {spans} JOIN (SELECT tx, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS starts, string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) AS ends FROM {exons} GROUP BY tx) x USING (tx)""")
def gff3_to_refflat(get):
    lengths = transcripts(get).select(F.concat(F.lit("t"), F.col("tx").cast("string")).alias("id"), F.lit(1000).alias("len"))
    flat, _ = convert.gff3_to_refflat(_gff(get), lengths)
    csv = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return flat.select("tx", "gene", "chr", "strand", "tx_start", "tx_end", "cds_start", "cds_end", "n_exon", csv("exon_starts").alias("starts"), csv("exon_ends").alias("ends"))


@query("""SELECT 't' || CAST(tx AS VARCHAR) AS tx, CAST(1 AS BIGINT) AS read_start, CAST((n - 1) * 100 + 80 AS BIGINT) AS read_end, covered, round(100 * (CAST((n - 1) * 100 + 80 AS BIGINT) - 1) / 1000.0, 1) AS pct, CAST(98.5 AS DOUBLE) AS identity,
    read_strand, scores FROM (SELECT tx, string_agg(CAST(90 + k % 10 AS VARCHAR), ',' ORDER BY k) AS scores, count(*) AS n, sum(e - s) AS covered, CASE WHEN tx % 50 = 0 THEN CASE WHEN min(strand) = '+' THEN '-' ELSE '+' END ELSE min(strand) END AS read_strand FROM (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY s) - 1 AS k FROM {exons}) e GROUP BY tx) x""")
def gff3_coverage(get):
    t = written(transcripts(get), "transcripts")
    cov = convert.gff3_to_refflat(_gff(get, of=t), t.select(F.concat(F.lit("t"), F.col("tx").cast("string")).alias("id"), F.lit(1000).alias("len")))[1]
    return cov.select("tx", "read_start", "read_end", "covered", "pct", "identity", "read_strand", F.array_join(F.col("exon_scores").cast("array<int>").cast("array<string>"), ",").alias("scores"))


@query("SELECT 't' || CAST(tx AS VARCHAR) AS tx, 'chr' || CAST(chr AS VARCHAR) AS chr, tx_start, tx_end FROM {spans} WHERE tx % 6 <> 3")
def gff3_settled_paths(get):
    """Without transcripts of which a later line betters the path: the better path of some comes first, and they stay."""
    lengths = get("spans").select(F.concat(F.lit("t"), F.col("tx").cast("string")).alias("id"), F.lit(1000).alias("len"))
    return convert.gff3_to_refflat(_gff(get), lengths, use_best=False)[0].select("tx", "chr", "tx_start", "tx_end")


@query("""WITH named AS (SELECT *, 'sub_' || CAST(tx // 4 AS VARCHAR) || '_1' AS well FROM {spans}) SELECT well || '_' || CAST(tx AS VARCHAR) AS tx, tx_start, tx_end FROM named
    WHERE well NOT IN (SELECT well FROM named WHERE tx % 6 = 3)""")
def gff3_settled_wells(get):
    """The same for reads of wells: all reads of a well with such a read go."""
    name = F.concat(F.lit("sub_"), F.floor(F.col("tx") / 4).cast("string"), F.lit("_1_"), F.col("tx").cast("string"))
    lengths = get("spans").select(name.alias("id"), F.lit(1000).alias("len"))
    return convert.gff3_to_refflat(_gff(get, name), lengths, use_best=False, pacbio=True)[0].select("tx", "tx_start", "tx_end")


@query("""SELECT 't' || CAST(tx AS VARCHAR) || '.mrna' || CAST(copy AS VARCHAR) AS path, 'chr' || CAST(chr + 10 * (copy - 1) AS VARCHAR) AS chr, CASE WHEN strand = '+' THEN '-' ELSE '+' END AS strand, strand AS path_strand
    FROM (SELECT DISTINCT tx, chr, strand FROM (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY s) - 1 AS k FROM {exons}) x WHERE (tx + k) % 50 = 0) y JOIN (VALUES (1), (2)) c(copy) ON copy = 1 OR tx % 3 = 0""")
def gff3_errors(get):
    return convert.gff3_problems(_gff(get))[0].select("path", "chr", "strand", "path_strand")


@query("SELECT 't' || CAST(tx AS VARCHAR) AS tx FROM {spans} WHERE tx % 3 = 0")
def gff3_multi(get):
    return convert.gff3_problems(_gff(get))[1]


@query("""SELECT 't' || CAST(tx AS VARCHAR) AS tx, 'g' || CAST(tx_start // 2000 AS VARCHAR) AS gene, 'N' || CAST(tx AS VARCHAR) AS gene_name, 'chr' || CAST(chr AS VARCHAR) AS chr, strand, tx_start, tx_end, CAST(n_exon AS INT) AS n_exon, starts, ends
    FROM {spans} JOIN (SELECT tx, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS starts, string_agg(CAST(e AS VARCHAR), ',' ORDER BY s) AS ends FROM {exons} GROUP BY tx) x USING (tx) WHERE tx < (SELECT max(tx) FROM {spans})""")
def gtf_to_refflat(get):
    """Lines of a transcript follow each other over several files; the last run is left out as in older tables."""
    t = transcripts(get)
    x = t.select("tx", "chr", "strand", "gene", F.explode(F.arrays_zip("exon_starts", "exon_ends")).alias("x"))
    text = F.concat(F.lit('gene_id "'), "gene", F.lit('"; transcript_id "t'), F.col("tx").cast("string"), F.lit('"; gene_name "N'), F.col("tx").cast("string"), F.lit('";'))
    lines = x.orderBy("tx", "x.exon_starts").select(tabs("chr", F.lit("c"), F.lit("exon"), F.col("x.exon_starts") + 1, "x.exon_ends", F.lit("."), "strand", F.lit("."), text))
    flat = convert.gtf_to_refflat(alignments.read_gtf(t.sparkSession, put(lines, "gtf")))
    csv = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return flat.select("tx", "gene", "gene_name", "chr", "strand", "tx_start", "tx_end", "n_exon", csv("exon_starts").alias("starts"), csv("exon_ends").alias("ends"))


@query("""SELECT CAST(tx AS VARCHAR) AS tx, 'g' || CAST(tx_start // 2000 AS VARCHAR) AS gene, 'chr' || CAST(chr AS VARCHAR) AS chr, strand, tx_start, tx_end, CAST(n_exon AS INT) AS n_exon, starts, CAST(CASE WHEN tx % 2 = 0 THEN tx % 5 + 1 ELSE 1 END AS INT) AS n_members
    FROM {spans} JOIN (SELECT tx, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS starts FROM {exons} GROUP BY tx) x USING (tx)""")
def refflat_scan(get):
    t = transcripts(get).withColumn("cds_start", F.col("tx_start")).withColumn("cds_end", F.col("tx_start"))
    members = F.transform(F.sequence(F.lit(0), F.when(F.col("tx") % 2 == 0, F.col("tx") % 5).otherwise(F.lit(0)).cast("int")), lambda i: F.concat(F.lit("m"), i.cast("string")))
    path = new_path(t.sparkSession, "refflat")
    annotations.write_refflat(t.withColumn("members", members), path, trailing_comma=True)
    back = annotations.read_refflat(t.sparkSession, path)
    return back.select("tx", "gene", "chr", "strand", "tx_start", "tx_end", "n_exon", F.array_join(F.col("exon_starts").cast("array<string>"), ",").alias("starts"), F.size("members").alias("n_members"))


@query('SELECT \'chr\' || CAST(chr AS VARCHAR) AS chr, strand, "left", "right", score FROM {known}')
def junction_bed_scan(get):
    """Every second junction as BED12 with flanks of 7 and 9 bases, the others as BED6."""
    k = get("known")
    six = k.where("left % 2 = 0").select(tabs("chr", "left", "right", F.lit("J"), "score", "strand"))
    start, end = F.col("left") - 7, F.col("right") + 9
    twelve = k.where("left % 2 <> 0").select(tabs("chr", start, end, F.lit("J"), "score", "strand", start, end, F.lit("255,0,0"), F.lit(2), F.lit("7,9"), F.concat(F.lit("0,"), (F.col("right") - start).cast("string"))))
    head = k.sparkSession.createDataFrame([("track name=x",), ("Junctions of x",)], "value string")
    return annotations.read_junction_bed(k.sparkSession, put(head.unionByName(six).unionByName(twelve), "junction-bed")).drop("line_no")


@query('SELECT \'chr\' || CAST(chr AS VARCHAR) AS chr, "start", "end", \'p\' || CAST(line_no AS VARCHAR) AS name, score, strand FROM {peaks}')
def bed6_scan(get):
    p = get("peaks").select(tabs(F.concat(F.lit("chr"), "chr"), "start", "end", F.concat(F.lit("p"), "line_no"), "score", "strand"))
    return annotations.read_bed6(p.sparkSession, put(p, "bed6")).drop("line_no")


@query('SELECT \'chr\' || CAST(chr AS VARCHAR) AS chr, "start", "end", value, CASE WHEN chr % 3 = 0 THEN \'-\' ELSE \'+\' END AS strand FROM {coverage} WHERE chr % 3 < 2')
def bedgraph_scan(get):
    """Three files: a track of each strand and one that has no track line and is left out."""
    c = get("coverage")
    paths = []
    for k, head in enumerate(("track type=bedGraph name=plus", "track type=bedGraph name=minus", None)):
        body = c.where(F.col("chr") % 3 == k).select(F.concat_ws(" ", F.concat(F.lit("chr"), "chr"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("value").cast("string")).alias("value"))
        lines = c.sparkSession.createDataFrame([(head,)], "value string").unionByName(body).coalesce(1) if head else body  # a track is one file
        paths.append(put(lines, "bedgraph"))
    return annotations.read_bedgraph(c.sparkSession, paths).drop("line_no")


@query('SELECT \'chr\' || CAST(chr AS VARCHAR) AS chr, strand, "start", max("end") AS "end", max("end") + 5 AS "right" FROM {peaks} GROUP BY chr, strand, "start"')
def borders_scan(get):
    """Of lines with one chr, strand and start the last counts."""
    p = get("peaks").orderBy("end").select(tabs(F.concat(F.lit("chr"), "chr"), "start", F.col("end") + 5, F.lit("GL.1"), "strand", "start", "end"))
    return annotations.read_borders(p.sparkSession, put(p, "borders")).select("chr", "strand", "start", "end", "right")


@query("SELECT CAST(zmw AS VARCHAR) AS zmw, productive, CAST(zmw % 900 AS VARCHAR) AS read_len FROM {wells}")
def wells_scan(get):
    w = get("wells")
    rows = w.select(F.concat_ws(",", F.col("zmw").cast("string"), *[F.lit("x")] * 8, F.concat(F.lit(" "), (F.col("zmw") % 900).cast("string"), F.lit(" ")), F.concat(F.col("productive").cast("string"), F.lit(" ")), F.lit("77")).alias("value"))
    head = w.sparkSession.createDataFrame([("Zmw,a,b,c,d,e,f,g,h,ReadLen,Productive,Insert",)], "value string")
    return annotations.read_wells(w.sparkSession, put(head.unionByName(rows), "wells"), version=2).select("zmw", "productive", "read_len")


@query("SELECT CAST(id AS VARCHAR) AS id, CAST(max(pos) AS VARCHAR) AS len FROM {votes} GROUP BY id")
def side_table_scan(get):
    """The last line of a key counts, over all files of the table."""
    rows = get("votes").orderBy("pos", "id").select(tabs("id", "pos"))
    return annotations.read_side_table(rows.sparkSession, put(rows, "side"), "id", "len")


@query("SELECT CAST(id AS VARCHAR) AS id, pos, allele, weight FROM {tallied}")
def vote_report_scan(get):
    piled = votes.pileup(votes.tally(get("votes"), get("backbone"))).withColumn("id", F.col("id").cast("string"))
    return annotations.read_votes(piled.sparkSession, put(annotations.vote_report(piled), "mod"))


RANKED = "SELECT id, pos, allele, weight, row_number() OVER (PARTITION BY id, pos ORDER BY weight DESC, allele) AS rn, sum(weight) OVER (PARTITION BY id, pos) AS total FROM {tallied}"
CALLED = f"SELECT id, string_agg(out, '' ORDER BY pos) AS seq, string_agg(repeat(CASE WHEN total = 1.5 THEN '0' ELSE '1' END, length(out)), '' ORDER BY pos) AS mask FROM (SELECT id, pos, total, CASE WHEN allele = 'Del' THEN '' ELSE allele END AS out FROM ({RANKED}) r WHERE rn = 1) b GROUP BY id"


@query(f"SELECT CAST(id AS VARCHAR) || chr(9) || CAST(length(replace(mask, '0', '')) AS VARCHAR) || chr(9) || CAST(length(seq) AS VARCHAR) || chr(9) || printf('%.2f', CAST(length(replace(mask, '0', '')) AS DOUBLE) / length(seq)) AS value FROM ({CALLED}) c")
def coverage_report_lines(get):
    called = votes.consensus(votes.pileup(votes.tally(get("votes"), get("backbone"))))
    return called.sparkSession.read.text(put(annotations.coverage_report(called.withColumn("id", F.col("id").cast("string"))), "cov1"))


@query(f"SELECT CAST(id AS VARCHAR) AS id, mask AS seq FROM ({CALLED}) c")
def mask_scan(get):
    called = votes.consensus(votes.pileup(votes.tally(get("votes"), get("backbone"))))
    path = new_path(called.sparkSession, "cov")
    annotations.write_mask(called, path)
    return sequences.read_fasta(called.sparkSession, path)


@query("""SELECT 'track name="x" description="x"' AS value UNION ALL SELECT concat_ws(chr(9), CAST(chr AS VARCHAR), CAST(m AS VARCHAR), CAST(z AS VARCHAR), 'g' || CAST(m // 2000 AS VARCHAR) || '|' || CAST(tx AS VARCHAR), '0', strand, CAST(m AS VARCHAR), CAST(z AS VARCHAR), '0', CAST(n AS VARCHAR), sizes, starts)
    FROM (SELECT tx, chr, strand, min(s) AS m, max(e) AS z, count(*) AS n, string_agg(CAST(e - s AS VARCHAR), ',' ORDER BY s) AS sizes, string_agg(CAST(s - first AS VARCHAR), ',' ORDER BY s) AS starts FROM (SELECT *, min(s) OVER (PARTITION BY tx) AS first FROM {exons}) x GROUP BY tx, chr, strand) y""")
def bed12_lines(get):
    t = transcripts(get).withColumn("tx", F.col("tx").cast("string")).withColumn("cds_start", F.col("tx_start")).withColumn("cds_end", F.col("tx_start"))
    path = new_path(t.sparkSession, "bed12")
    annotations.write_bed12(convert.refflat_to_bed12(t, erase_cds=True), path, "x")
    return t.sparkSession.read.text(path)


@query("""SELECT concat_ws(chr(9), CAST(chr AS VARCHAR), strand, CAST("left" AS VARCHAR), CAST("right" AS VARCHAR), CAST(CAST(sum(score) AS BIGINT) AS VARCHAR)) AS value FROM {known} GROUP BY chr, strand, "left", "right\"""")
def known_junction_lines(get):
    k = get("known")
    return k.sparkSession.read.text(put(junctions.known_report(k), "known"))


@query("SELECT CAST(tx AS VARCHAR) AS qname, 'chr' || CAST(chr AS VARCHAR) AS rname FROM {spans} WHERE tx % 64 <> 4")
def unmapped_reads_are_skipped(get):
    """Alignments with a flag of exactly 4 are left out."""
    s = get("spans")
    rows = s.select(tabs("tx", F.col("tx") % 64, F.concat(F.lit("chr"), "chr"), F.col("tx_start") + 1, F.lit(60), F.lit("10M"), F.lit("*"), F.lit(0), F.lit(0), F.lit("ACGT"), F.lit("*")))
    return convert.sam_to_refflat(alignments.read_sam(s.sparkSession, put(rows, "sam"))).select(F.col("tx").alias("qname"), F.col("chr").alias("rname"))
