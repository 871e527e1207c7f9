"""The correction plan: short reads are aligned to long ones and vote on every base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.functions.align import align_reads
from isoweave.functions.pileup import pile
from isoweave.functions.seq import weight_of
from isoweave.operators import votes
from isoweave.sources import annotations, sequences
from isoweave.sources.scratch import written

#: The settings a run can't do without.
REQUIRED = ("PacBio_fasta", "Illumina_fasta_list")


def tallied(long_reads: DataFrame, shards: list[DataFrame]) -> DataFrame:
    """Summed votes of all shards, with the prior of the long reads once."""
    voted = [pile(align_reads(s, long_reads)).groupBy("id", "pos", "allele").agg(F.sum("weight").alias("weight")) for s in shards]
    return votes.merge_shards(voted, votes.backbone(long_reads))


def correct(long_reads: DataFrame, shards: list[DataFrame]) -> DataFrame:
    """id, seq, mask, covered, len, ratio of each of `long_reads(id, seq)`.

    Each shard is `(id, seq, weight)`. Votes are additive, so shards may be tallied one by one.
    """
    return votes.consensus(votes.pileup(tallied(long_reads, shards)))


def run_settings(spark: SparkSession, settings: str) -> DataFrame:
    """Runs the correction that a settings text describes and writes its reports to the output folder.

    The list of short-read files has one path for each line; each is a shard. Written are the vote
    report (mod), the corrected reads (fa), their masks (cov) and coverage (cov1). Thread and
    clean-up settings have no meaning here.
    """
    spec = annotations.read_spec(settings, REQUIRED)
    long_reads = sequences.read_fasta(spark, spec["PacBio_fasta"])
    paths = [r["value"].strip() for r in spark.read.text(spec["Illumina_fasta_list"]).distinct().collect() if r["value"].strip()]  # one line for each file
    shards = [sequences.read_fasta(spark, p).withColumn("weight", weight_of(F.col("id"))) for p in sorted(paths)]
    piled = written(votes.pileup(tallied(long_reads, shards)), "piled-votes")
    called = votes.consensus(piled)
    out = spec["Output_folder"].rstrip("/")
    annotations.vote_report(piled).write.text(f"{out}/mod")
    sequences.write_fasta(called, f"{out}/fa")
    annotations.write_mask(called, f"{out}/cov")
    annotations.coverage_report(called).write.text(f"{out}/cov1")
    return called
