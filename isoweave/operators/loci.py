"""Loci from reads, and which locus each read belongs to."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.functions.seq import exon_lengths, max_intron
from isoweave.operators.intervals import first_by, islands, merge, range_join

ROUND = 100
FUZZY = 10
KEYS = ["chr", "strand"]


def route(tx: DataFrame, lengths: DataFrame, coverage: DataFrame | None = None, least: int = 300, longest_intron: int = 100_000, min_fraction: float = 0.9, max_fraction: float = 1.05, min_coverage: float = 85) -> DataFrame:
    """Adds size, raw_len, fraction, longest and status: lowcov, short, long or used, in that order.

    Reads without a length, or without a coverage where one is asked for, are left out. Fractions
    are compared after rounding to three decimals.
    """
    rows = tx.join(lengths.select(F.col("id").alias("tx"), F.col("len").alias("raw_len")), "tx")
    low = F.lit(False)
    if coverage is not None:
        rows = rows.join(coverage.select(F.col("id").alias("tx"), "pct"), "tx")
        low = F.col("pct") < min_coverage
    size = exon_lengths(F.col("exon_starts"), F.col("exon_ends"))
    rows = rows.withColumn("size", size).withColumn("fraction", F.round(F.col("size") / F.col("raw_len"), 3)).withColumn("longest", max_intron(F.col("exon_starts"), F.col("exon_ends")))
    short = (F.col("size") < least) | (F.col("fraction") < min_fraction) | (F.col("fraction") > max_fraction)
    return rows.withColumn("status", F.when(low, "lowcov").when(short, "short").when(F.col("longest") > longest_intron, "long").otherwise("used"))


def build(reads: DataFrame) -> DataFrame:
    """chr, strand, start, end, n: unions of reads, each widened to whole hundreds."""
    wide = reads.select(*KEYS, (F.floor(F.col("tx_start") / ROUND) * ROUND).alias("start"), ((F.floor(F.col("tx_end") / ROUND) + 1) * ROUND).alias("end"))
    return merge(wide, KEYS, "start", "end")


def assign_contained(reads: DataFrame, loci: DataFrame, width: int = 10_000) -> DataFrame:
    """Reads with the locus that holds them whole; loci of a strand are disjoint, so one at most."""
    inside = (F.col("start") <= F.col("tx_start")) & (F.col("tx_end") <= F.col("end"))
    return range_join(reads, loci.select(*KEYS, "start", "end"), KEYS, inside, (F.col("tx_start"), F.col("tx_end")), (F.col("start"), F.col("end")), width)


def assign_overlap(reads: DataFrame, loci: DataFrame, strand: str, width: int = 10_000) -> DataFrame:
    """tx, start, end: the first locus of `strand` that comes within FUZZY of each read."""
    side = loci.where(F.col("strand") == strand).select("chr", "start", "end")
    near = range_join(reads.select("tx", "chr", "tx_start", "tx_end"), side, ["chr"], F.lit(True), (F.col("tx_start"), F.col("tx_end")), (F.col("start") - FUZZY, F.col("end") + FUZZY), width)
    return first_by(near, ["tx"], F.col("start")).select("tx", "start", "end")


def rare_reads(junctions: DataFrame, judged: DataFrame) -> DataFrame:
    """tx and is_rare for each read of `junctions`: rare if one of its junctions isn't good."""
    return junctions.join(judged, ["chr", "strand", "left", "right"]).groupBy("tx").agg((~F.bool_and("is_good")).alias("is_rare"))


def drop_rare_loci(assigned: DataFrame, rare: DataFrame) -> DataFrame:
    """Assigned reads with is_rare, without loci in which every read is rare."""
    marked = assigned.join(rare, "tx", "left").withColumn("is_rare", F.coalesce("is_rare", F.lit(False)))
    dead = marked.groupBy(*KEYS, "start", "end").agg(F.bool_and("is_rare").alias("dead")).where("dead")
    return marked.join(dead.drop("dead"), [*KEYS, "start", "end"], "left_anti")


def assign_unstranded(reads: DataFrame, loci: DataFrame) -> DataFrame:
    """tx, chr, strand, start, end for single-exon reads of unknown strand.

    A read near loci of one strand alone joins the first of them. Others go to neutral loci (strand
    null), which grow in the order start, end, id: a read near both strands first looks for a neutral
    locus that holds it, every read then for one within reach, else it opens one. Reads that lie more
    than 200 apart, and so can't meet in a neutral locus, are worked on apart.
    """
    plus = assign_overlap(reads, loci, "+").select("tx", F.struct("start", "end").alias("plus"))
    minus = assign_overlap(reads, loci, "-").select("tx", F.struct("start", "end").alias("minus"))
    both = reads.select("tx", "chr", "tx_start", "tx_end").join(plus, "tx", "left").join(minus, "tx", "left")
    one = F.col("plus").isNull() != F.col("minus").isNull()
    at = F.coalesce("plus", "minus")
    settled = both.where(one).select("tx", "chr", F.when(F.col("plus").isNotNull(), "+").otherwise("-").alias("strand"), at["start"].alias("start"), at["end"].alias("end"))
    open_ = both.where(~one).withColumn("both", F.col("plus").isNotNull()).withColumn("_s", F.col("tx_start") - ROUND).withColumn("_e", F.col("tx_end") + ROUND + FUZZY)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("island"):
            neutral: dict[int, int] = {}
            for r in part.sort_values(["tx_start", "tx_end", "tx"]).itertuples():
                ordered = sorted(neutral.items())
                held = [x for x in ordered if x[0] <= r.tx_start and r.tx_end <= x[1]] if r.both else []
                near = held or [x for x in ordered if r.tx_end >= x[0] - FUZZY and r.tx_start <= x[1] + FUZZY]
                if not near:
                    near = [(r.tx_start // ROUND * ROUND, r.tx_end // ROUND * ROUND + ROUND)]
                    neutral[near[0][0]] = near[0][1]
                out.append((r.tx, r.chr, None, *near[0]))
        return pd.DataFrame(out, columns=["tx", "chr", "strand", "start", "end"])

    kinds = dict(reads.dtypes)
    grown = islands(open_, ["chr"], "_s", "_e").select("tx", "chr", "tx_start", "tx_end", "both", "island").groupBy("chr", F.floor(F.col("island") / 256).alias("cell")).applyInPandas(grow, f"tx {kinds['tx']}, chr {kinds['chr']}, strand string, start long, end long")
    return settled.unionByName(grown)


def split_loci(tx: DataFrame) -> DataFrame:
    """Transcripts with gene renamed to `gene.n` where the transcripts of a gene don't all overlap.

    Of transcripts with one gene and the same outer borders the last line counts; touching
    transcripts are apart. `tx` has line_no.
    """
    one = first_by(tx, ["gene", "tx_start", "tx_end"], F.desc("line_no"))
    cut = islands(one, ["gene"], "tx_start", "tx_end", touching=False)
    parts = cut.groupBy("gene").agg(F.max("island").alias("parts"))
    return cut.join(parts, "gene").withColumn("gene", F.when(F.col("parts") > 1, F.concat_ws(".", "gene", F.col("island").cast("string"))).otherwise(F.col("gene"))).drop("island", "parts")


def loci_report(tx: DataFrame) -> DataFrame:
    return tx.groupBy("gene").agg(F.min("chr").alias("chr"), F.min("tx_start").alias("start"), F.max("tx_end").alias("end"), F.count("*").alias("n_tx"), F.min("strand").alias("strand"))


def modal_ends(reads: DataFrame, keys: list[str], width: int = 50) -> DataFrame:
    """keys, left_bin, right_bin, left_most, right_most: most frequent bins of the read ends.

    Of equally frequent bins the smaller counts.
    """
    binned = reads.withColumn("lb", F.floor(F.col("tx_start") / width)).withColumn("rb", F.floor(F.col("tx_end") / width))
    top = lambda c, name: first_by(binned.groupBy(*keys, c).agg(F.count("*").alias("n")), keys, F.desc("n"), F.col(c)).select(*keys, F.col(c).alias(name))
    hull = reads.groupBy(*keys).agg(F.min("tx_start").alias("left_most"), F.max("tx_end").alias("right_most"))
    return top("lb", "left_bin").join(top("rb", "right_bin"), keys).join(hull, keys)
