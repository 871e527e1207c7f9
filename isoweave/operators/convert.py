"""Between alignment and annotation formats: exon arrays from SAM, GFF3 and GTF, BED12 from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoweave.operators.intervals import first_by
from isoweave.operators.runs import run_lengths
from isoweave.sources.text import renamed, with_chr


def best_path(paths: DataFrame) -> DataFrame:
    """For each transcript the path with most matches; of equal ones the first line."""
    return first_by(paths, ["tx"], F.desc("matches"), F.col("line_no"))


def chosen_paths(paths: DataFrame) -> DataFrame:
    """best_path() by aggregation, and _moved: whether a later line betters the first path of a transcript."""
    best = F.max_by(F.struct(*[F.col(c) for c in paths.columns if c != "tx"]), F.struct("matches", -F.col("line_no"))).alias("_best")
    moved = (F.max("matches") > F.min_by("matches", "line_no")).alias("_moved")
    return paths.groupBy("tx").agg(best, moved).select("_best.*", "tx", "_moved")


def with_cds_by_strand(tx: DataFrame) -> DataFrame:
    """Both CDS borders at the 5' end: the start on +, the end on -; transcripts of unknown strand go."""
    site = F.when(F.col("strand") == "+", F.col("tx_start")).otherwise(F.col("tx_end"))
    return tx.where("strand in ('+', '-')").withColumn("cds_start", site).withColumn("cds_end", site)


def collect_exons(exons: DataFrame, *keys: str) -> DataFrame:
    """Starts and ends, each sorted by itself, their number and the outer borders."""
    out = exons.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("exon_starts"), F.array_sort(F.collect_list("e")).alias("exon_ends"))
    return out.withColumns({"n_exon": F.size("exon_starts"), "tx_start": F.array_min("exon_starts"), "tx_end": F.array_max("exon_ends")})


def gff3_to_refflat(gff: DataFrame, lengths: DataFrame, use_best: bool = True, pacbio: bool = False, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(refFlat, coverage) of `read_gff3` rows from a cDNA aligner.

    A transcript is the id before `.mrna`; starts become 0-based. Without `use_best` transcripts whose
    first path is bettered by a later line are left out, with `pacbio` all reads of their wells too;
    with it, `pacbio` makes no difference. Coverage has the aligned share of the read in
    per cent, one decimal, the strand of the first exon line and the scores of all exons in file order.
    """
    a = lambda k: F.col("attrs")[k]
    named = renamed(gff.withColumn("chr", F.regexp_replace("chr", "_", "|")), names)
    mrna = named.where("feature = 'mRNA'").where(F.regexp_extract("attr_text", r"^ID=([\w.|]+);", 1) != "").select(
        "line_no", "chr", "strand", F.regexp_extract("attr_text", r"^ID=([\w.|]+);", 1).alias("path"), a("coverage").cast("double").alias("coverage"),
        a("identity").cast("double").alias("identity"), F.coalesce(a("matches").cast("long"), F.lit(0)).alias("matches")).withColumn("tx", F.substring_index("path", ".mrna", 1))
    chosen = chosen_paths(mrna)
    if not use_best:
        if pacbio:
            well = F.regexp_extract("tx", r"^(.*?_?(?:ccs|sub)_[^_]+_[^_]+)", 1)
            chosen = chosen.withColumn("_well", F.when(well != "", well).otherwise(F.col("tx")))
            chosen = chosen.withColumn("_moved", F.max("_moved").over(W.partitionBy("_well")))
        chosen = chosen.where("not _moved")
    target = F.split(a("Target"), " ")
    parts = named.where("feature in ('exon', 'CDS')").select(
        "line_no", "feature", "strand", "score", (F.col("start") - 1).alias("s"), F.col("end").alias("e"), F.coalesce(a("Parent"), F.regexp_extract("attr_text", "Parent=([^;]+)", 1)).alias("path"),
        F.get(target, F.lit(1)).cast("long").alias("t1"), F.get(target, F.lit(2)).cast("long").alias("t2"))
    # lines are gathered by path before they meet the chosen ones; a transcript has one path then
    is_exon, is_cds = F.col("feature") == "exon", F.col("feature") == "CDS"
    exon, cds = lambda c: F.when(is_exon, F.col(c)), lambda c: F.when(is_cds, F.col(c))
    scores = F.transform(F.array_sort(F.collect_list(F.when(is_exon, F.struct("line_no", "score")))), lambda x: x["score"])
    by_path = parts.groupBy("path").agg(
        F.array_sort(F.collect_list(exon("s"))).alias("exon_starts"), F.array_sort(F.collect_list(exon("e"))).alias("exon_ends"), F.min(cds("s")).alias("cds_start"), F.max(cds("e")).alias("cds_end"),
        F.min(F.least(exon("t1"), exon("t2"))).alias("read_start"), F.max(F.greatest(exon("t1"), exon("t2"))).alias("read_end"), F.min_by("strand", exon("line_no")).alias("read_strand"),
        scores.alias("exon_scores"), F.sum(exon("e") - exon("s")).alias("covered"), F.count_if(is_exon).cast("int").alias("_exons")).where("_exons > 0")
    own = chosen.join(by_path, "path")
    group = F.regexp_extract("tx", r"^(Isogroup_\d+)", 1)
    gene = F.when(group != "", group).otherwise(F.col("tx"))
    outer = own.withColumns({"n_exon": F.size("exon_starts"), "tx_start": F.array_min("exon_starts"), "tx_end": F.array_max("exon_ends")})
    flat = outer.select(
        F.regexp_replace(gene, r"\|", "_").alias("gene"), "tx", "chr", "strand", "tx_start", "tx_end", F.coalesce("cds_start", "tx_start").alias("cds_start"), F.coalesce("cds_end", "tx_start").alias("cds_end"), "n_exon", "exon_starts", "exon_ends")
    share = 100 * (F.col("read_end") - F.col("read_start")) / F.col("len")
    cov = own.join(lengths.select(F.col("id").alias("tx"), "len"), "tx").select("tx", F.round(share, 1).alias("pct"), "identity", "read_start", "read_end", "read_strand", "len", "covered", "coverage", "exon_scores")
    return flat, cov


def gff3_problems(gff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(errors, multi) of `read_gff3` rows.

    An error is an exon whose chr or strand differs from that of its path: path, feature, chr, strand
    and those of the path. multi lists the transcripts that map to more than one place.
    """
    path = F.regexp_extract("attr_text", r"^ID=([\w.|]+);", 1)
    mrna = gff.where("feature = 'mRNA'").where(path != "").select(path.alias("path"), F.col("chr").alias("path_chr"), F.col("strand").alias("path_strand"))
    parts = gff.where("feature in ('exon', 'CDS')").select("chr", "strand", "feature", F.regexp_extract("attr_text", "Parent=([^;]+)", 1).alias("path"))
    errors = parts.join(mrna, "path").where("chr <> path_chr or strand <> path_strand").distinct()
    multi = mrna.groupBy(F.substring_index("path", ".mrna", 1).alias("tx")).count().where("count > 1").select("tx")
    return errors, multi


def gtf_to_refflat(gtf: DataFrame, compat: bool = True) -> DataFrame:
    """One row for each run of consecutive lines of a transcript; col 12 is the gene name.

    With `compat` the last run of the file is left out, as older tables lack it.
    """
    found = run_lengths(gtf.select("line_no", "transcript_id"), "line_no", "transcript_id")
    if compat:
        found = found.join(found.agg(F.max("run").alias("run")), "run", "left_anti")
    runs = gtf.join(found.select("run", "transcript_id", "first", "last"), "transcript_id").where(F.col("line_no").between(F.col("first"), F.col("last")))
    rows = runs.groupBy("run").agg(
        F.min_by("gene_id", "line_no").alias("gene"), F.min_by("transcript_id", "line_no").alias("tx"), F.min_by("chr", "line_no").alias("chr"), F.min_by("strand", "line_no").alias("strand"),
        F.min_by("gene_name", "line_no").alias("gene_name"), F.array_sort(F.collect_list(F.struct("line_no", (F.col("start") - 1).alias("s"), F.col("end").alias("e")))).alias("x"))
    flat = rows.withColumn("exon_starts", F.transform("x", lambda v: v["s"])).withColumn("exon_ends", F.transform("x", lambda v: v["e"]))
    return flat.select(
        "gene", "tx", with_chr(F.col("chr"), prefix_only=False).alias("chr"), "strand", F.array_min("exon_starts").alias("tx_start"), F.array_max("exon_ends").alias("tx_end"),
        F.array_min("exon_starts").alias("cds_start"), F.array_min("exon_starts").alias("cds_end"), F.size("exon_starts").alias("n_exon"), "exon_starts", "exon_ends", "gene_name")


def cigar_exons(cigar, pos, compat: bool = True):
    """struct(cur, starts, ends): exons of a spliced alignment that begins at `pos` (from 0).

    M moves on and ends the exon, D moves on, N opens the next exon. With `compat` every M starts the
    exon anew, so after a gap inside an exon the start is that of its last block.
    """
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MSNID])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))
    empty = F.array().cast("array<bigint>")
    start = F.struct(pos.cast("long").alias("cur"), F.lit(True).alias("fresh"), empty.alias("starts"), empty.alias("ends"))
    put = lambda a, v, fresh: F.when(fresh, F.array_append(a, v)).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(v)))

    def step(s, x):
        on = s["cur"] + x["n"]
        m = F.struct(on.alias("cur"), F.lit(False).alias("fresh"), (put(s["starts"], s["cur"], s["fresh"]) if compat else F.when(s["fresh"], F.array_append(s["starts"], s["cur"])).otherwise(s["starts"])).alias("starts"), put(s["ends"], on, s["fresh"]).alias("ends"))
        d = F.struct(on.alias("cur"), s["fresh"].alias("fresh"), s["starts"].alias("starts"), F.when(s["fresh"], s["ends"]).otherwise(put(s["ends"], on, F.lit(False))).alias("ends"))
        n = F.struct(on.alias("cur"), F.lit(True).alias("fresh"), s["starts"].alias("starts"), s["ends"].alias("ends"))
        return F.when(x["op"] == "M", m).when(x["op"] == "D", d).when(x["op"] == "N", n).otherwise(s)

    return F.aggregate(ops, start, step)


def sam_to_refflat(sam: DataFrame, names: DataFrame | None = None, compat: bool = True) -> DataFrame:
    """refFlat rows of mapped spliced alignments; strand from flag bit 0x10."""
    mapped = renamed(sam.where("flag <> 4").withColumn("chr", F.col("rname")), names)
    rows = mapped.withColumn("x", cigar_exons(F.col("cigar"), F.col("pos") - 1, compat)).where(F.size("x.starts") > 0)
    first = F.get("x.starts", F.lit(0))
    return rows.select(
        F.col("qname").alias("gene"), F.col("qname").alias("tx"), "chr", F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+").alias("strand"), first.alias("tx_start"),
        F.element_at("x.ends", -1).alias("tx_end"), first.alias("cds_start"), first.alias("cds_end"), F.size("x.starts").alias("n_exon"), F.col("x.starts").alias("exon_starts"), F.col("x.ends").alias("exon_ends"))


def refflat_to_bed12(tx: DataFrame, erase_cds: bool = False, add_chr: bool = False) -> DataFrame:
    """BED12; with members the score is their number and the name ends in it."""
    members = F.size("members") if "members" in tx.columns else F.lit(-1)
    has = members > 0
    name = F.when(F.col("gene") == F.col("tx"), F.col("gene")).otherwise(F.concat_ws("|", "gene", "tx"))
    text = F.col("chr").cast("string")
    chrom = F.when(text == "chrMT", "chrM").otherwise(text)
    return tx.select(
        (with_chr(chrom) if add_chr else chrom).alias("chr"), F.col("tx_start").alias("start"), F.col("tx_end").alias("end"),
        F.when(has, F.concat(name, F.lit("|"), members.cast("string"))).otherwise(name).alias("name"), F.when(has, members).otherwise(0).alias("score"), "strand",
        (F.col("tx_start") if erase_cds else F.col("cds_start")).alias("thick_start"), (F.col("tx_end") if erase_cds else F.col("cds_end")).alias("thick_end"), F.lit("0").alias("rgb"), F.col("n_exon").alias("n_blocks"),
        F.zip_with("exon_ends", "exon_starts", lambda e, s: e - s).alias("sizes"), F.transform("exon_starts", lambda s: s - F.col("tx_start")).alias("starts"))


def junction_bed(tx: DataFrame, flank: int = 10) -> DataFrame:
    """BED12 rows that span each transcript with more than one exon, with flanks of ten bases."""
    return tx.where("n_exon > 1").select("chr", (F.col("tx_start") - flank).alias("start"), (F.col("tx_end") + flank).alias("end"), F.col("tx").alias("name"), F.lit(1).alias("score"), "strand", F.lit(2).alias("n_blocks"), F.array(F.lit(flank), F.lit(flank)).alias("sizes"), F.array(F.lit(0), F.col("tx_end") - F.col("tx_start") + flank).alias("starts"))
