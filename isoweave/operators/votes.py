"""Weighted votes for each position of a long read, and the consensus they give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIOR = 1.5  # weight of the long read's own base


def backbone(reads: DataFrame) -> DataFrame:
    """id, pos, allele, weight: one prior vote for each base of `reads(id, seq)`."""
    bases = reads.where(F.length("seq") > 0).select("id", F.posexplode(F.split("seq", "")).alias("pos", "allele"))
    return bases.select("id", "pos", "allele", F.lit(PRIOR).alias("weight"))


def tally(votes: DataFrame, prior: DataFrame) -> DataFrame:
    """Summed weight by (id, pos, allele); the prior is counted once."""
    cols = ["id", "pos", "allele", "weight"]
    return votes.select(*cols).unionByName(prior.select(*cols)).groupBy("id", "pos", "allele").agg(F.sum("weight").alias("weight"))


def merge_shards(shards: list[DataFrame], prior: DataFrame) -> DataFrame:
    """Votes are additive: the union of all shards, with the prior once, is the merged vote."""
    return tally(reduce(DataFrame.unionByName, [s.select("id", "pos", "allele", "weight") for s in shards]), prior)


def pileup(tallied: DataFrame) -> DataFrame:
    """id, pos, best, max, sum, frac, alleles; the heaviest allele wins, then the smaller string."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "allele")))
    grouped = tallied.groupBy("id", "pos").agg(F.max("weight").alias("max"), F.sum("weight").alias("sum"), ranked.alias("r"))
    return grouped.select(
        "id", "pos", F.get("r", F.lit(0))["allele"].alias("best"), "max", "sum", (F.col("max") / F.col("sum")).alias("frac"),
        F.transform("r", lambda x: F.struct(x["allele"].alias("allele"), (-x["w"]).alias("w"))).alias("alleles"),
    )


def emitted(best):
    """The string that a position adds to the consensus; deletions add none."""
    return F.when(best.isin("Del", "_"), F.lit("")).otherwise(best)


def consensus(piled: DataFrame) -> DataFrame:
    """id, seq, mask, covered, len, ratio: the best alleles joined by position.

    The mask has one digit for each emitted base: 0 where only the prior voted.
    """
    digit = F.when(F.col("sum") == PRIOR, F.lit("0")).otherwise(F.lit("1"))
    out = piled.select("id", F.struct("pos", emitted(F.col("best")).alias("s"), F.repeat(digit, F.length(emitted(F.col("best")))).alias("m")).alias("x"))
    joined = out.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    text = lambda f: F.array_join(F.transform("x", lambda v: v[f]), "")
    full = joined.select("id", text("s").alias("seq"), text("m").alias("mask"))
    covered = F.length(F.replace("mask", F.lit("0"), F.lit("")))
    return full.select("id", "seq", "mask", covered.alias("covered"), F.length("seq").alias("len"), (covered / F.length("seq")).alias("ratio"))


def weighted_reads(reads: DataFrame) -> DataFrame:
    """Collapses identical reads of `reads(seq)`: seq and the number of copies as weight."""
    return reads.groupBy("seq").agg(F.count("*").cast("double").alias("weight"))
