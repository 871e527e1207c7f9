"""The isoform plan: from routed transcripts to loci, isoforms, rejects and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.operators import cluster, junctions, loci, support
from isoweave.sources.annotations import write_refflat
from isoweave.sources.scratch import written

STRUCTURE = "array<struct<left:bigint,right:bigint>>"


@dataclass
class Options:
    """Fixed values are those of the tables that users have."""

    min_length: int = 300
    min_fraction: float = 0.9
    max_fraction: float = 1.05
    min_coverage: float = 85
    min_intron: int = 50
    max_intron: int = 100_000
    min_junc: int = 2
    force: float = 0
    fuzzy: int = 10
    peak_distance: int = 100
    compat: bool = True


@dataclass
class Isoforms:
    """`reads` has a status for each read that was routed away (lowcov, short, long) or used; `clusters`
    has one row for each isoform and each read that is none (single, truncated, rare, negative_exon)."""

    reads: DataFrame
    clusters: DataFrame
    loci: DataFrame
    junctions: DataFrame
    exons: DataFrame

    def write(self, folder: str) -> None:
        """One folder for each status, as refFlat rows with members where they are isoforms, and the reports."""
        rows = self.clusters.withColumn("gene", F.col("gl")).withColumn("cds_start", F.col("tx_start")).withColumn("cds_end", F.col("tx_start")).withColumn("n_exon", F.size("exon_starts"))
        write_refflat(rows.where("status = 'cluster'"), f"{folder}/cluster")
        for status in ("single", "truncated", "rare", "negative_exon"):
            write_refflat(rows.where(F.col("status") == status).drop("members"), f"{folder}/{status}")
        for status in ("lowcov", "short", "long"):
            write_refflat(self.reads.where(F.col("status") == status), f"{folder}/{status}")
        for name, table in (("loci", self.loci), ("junctions", self.junctions), ("exons", self.exons)):
            table.write.option("sep", "\t").option("header", True).csv(f"{folder}/{name}")


def place(tx: DataFrame, known: DataFrame, annotated: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reads in their loci, snapped junctions of all reads, loci) of stranded transcripts.

    Reads get start, end (the locus) and is_rare. Loci are built from reads without a rare junction;
    those in which every read is rare go.
    """
    j = junctions.read_junctions(tx)
    borders = junctions.border_scores(known)
    moved = written(junctions.snapped(j, junctions.snap(junctions.support(j), borders, options.fuzzy)), "snapped")
    judged = junctions.good(junctions.support(moved), borders, annotated, options.min_junc, options.force)
    rare = written(loci.rare_reads(moved, judged), "rare-reads")
    built = written(loci.build(tx.join(rare.where("is_rare"), "tx", "left_anti")), "loci")
    return loci.drop_rare_loci(loci.assign_contained(tx, built), rare), moved, built


def with_evidence(placed: DataFrame, moved: DataFrame, peaks: DataFrame, options: Options) -> DataFrame:
    """The columns that clustering takes: snapped junctions and whether a peak is near the 5' end."""
    own = moved.groupBy("tx").agg(F.array_sort(F.collect_list(F.struct("left", "right"))).alias("junctions"))
    placed = written(placed.select("chr", "strand", "start", "end", "tx", "tx_start", "tx_end", "size", "is_rare"), "reads-in-loci")
    near = support.near_peak(placed, peaks, options.peak_distance, compat=options.compat)
    return near.join(own, "tx", "left").select("chr", "strand", "start", "end", F.col("tx").cast("string").alias("tx"), "tx_start", "tx_end", "size", "is_rare", "cage", F.coalesce("junctions", F.array().cast(STRUCTURE)).alias("junctions"))


def cluster_isoforms(
    tx: DataFrame, lengths: DataFrame, known: DataFrame, annotated: DataFrame, peaks: DataFrame, coverage: DataFrame | None = None, strands: DataFrame | None = None,
    options: Options | None = None, samples: list[str] | None = None,
) -> Isoforms:
    """Isoforms of `tx` (refFlat rows).

    `lengths(id, len)` are the raw read lengths, `known` scored junctions whose borders hold, `annotated`
    junctions that hold as they are, `peaks` 5' ends; `coverage(id, pct)` routes badly covered reads
    away, `strands(id, strand)` overrides the strand of reads (`na`: unknown). Reads with one exon and
    an unknown strand join loci of one strand near them or make neutral ones. `samples` names the
    samples (first part of a read id) and saves the job that finds them.
    """
    o = options or Options()
    routed = loci.route(tx, lengths, coverage, o.min_length, o.max_intron, o.min_fraction, o.max_fraction, o.min_coverage)
    if strands is not None:
        named = strands.groupBy(F.col("id").alias("tx")).agg(F.max("strand").alias("_strand"))
        routed = routed.join(named, "tx", "left").withColumn("strand", F.coalesce("_strand", "strand")).drop("_strand")
    routed = written(routed, "routed-reads")
    used = routed.where("status = 'used'")
    spliced = junctions.length_between(annotated, o.min_intron, o.max_intron)
    scored = known.where(F.abs(F.col("right") - F.col("left")) >= o.min_intron)
    placed, moved, built = place(used.where("strand in ('+', '-')"), scored, spliced, o)
    free = used.where("(strand is null or strand not in ('+', '-')) and n_exon = 1")
    found = loci.assign_unstranded(free, built).select("tx", "strand", "start", "end")
    also = free.drop("strand").join(found, "tx").withColumn("is_rare", F.lit(False))
    columns = ["chr", "strand", "start", "end", "tx", "tx_start", "tx_end", "size", "is_rare"]
    everyone = written(with_evidence(placed.select(*columns).unionByName(also.select(*columns)), moved, peaks, o), "placed-reads")
    clusters = written(cluster.number_loci(cluster.cluster(everyone, o.compat)), "isoforms")
    named = cluster.loci_report(clusters).join(clusters.select("chr", "strand", "start", "end", "gl").distinct().withColumnRenamed("strand", "_s"), ["chr", "start", "end"]).where(F.col("strand").eqNullSafe(F.col("_s"))).drop("_s")
    sample = F.substring_index(F.col("tx").cast("string"), "_", 1)
    by_sample = used.withColumn("sample", sample)
    return Isoforms(routed, clusters, named, junctions.junction_report(moved.withColumn("sample", sample), junctions.border_scores(scored), samples=samples), junctions.exon_report(by_sample, samples))
