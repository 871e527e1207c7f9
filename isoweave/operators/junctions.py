"""Splice junctions: support, snapping to better supported ones, expression and exon roles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.functions.seq import introns, plain_number
from isoweave.operators.intervals import islands

JUNCTION = ["chr", "strand", "left", "right"]


def read_junctions(tx: DataFrame) -> DataFrame:
    """tx, chr, strand, k, left, right: the introns of each transcript, k from 0."""
    return tx.select("tx", "chr", "strand", F.posexplode(introns(F.col("exon_starts"), F.col("exon_ends"))).alias("k", "j")).select("tx", "chr", "strand", "k", "j.left", "j.right")


def support(junctions: DataFrame) -> DataFrame:
    return junctions.groupBy(*JUNCTION).agg(F.count("*").alias("n"))


def border_scores(known: DataFrame) -> DataFrame:
    """chr, strand, pos, score: summed score of every exon border of `known(…, score)` junctions."""
    return known.select("chr", "strand", "score", F.explode(F.array("left", "right")).alias("pos")).groupBy("chr", "strand", "pos").agg(F.sum("score").alias("score"))


def length_between(junctions: DataFrame, least: int = 50, most: int = 100_000) -> DataFrame:
    size = F.abs(F.col("right") - F.col("left"))
    return junctions.where((size >= least) & (size <= most))


def good(counted: DataFrame, borders: DataFrame, annotated: DataFrame, min_junc: int = 2, force: float = 0) -> DataFrame:
    """Adds is_good. Without `force`: enough support, both borders known, or annotated as it is.
    With it: both borders known with at least that score.
    """
    side = lambda name: borders.select("chr", "strand", F.col("pos").alias(name), F.col("score").alias(f"{name}_score"))
    known = annotated.select(*JUNCTION).distinct().withColumn("_known", F.lit(True))
    joined = counted.join(side("left"), ["chr", "strand", "left"], "left").join(side("right"), ["chr", "strand", "right"], "left").join(known, JUNCTION, "left")
    both = F.col("left_score").isNotNull() & F.col("right_score").isNotNull()
    if force > 0:
        rule = both & (F.col("left_score") >= force) & (F.col("right_score") >= force)
    else:
        rule = (F.col("n") >= min_junc) | both | F.coalesce("_known", F.lit(False))
    return joined.select(*JUNCTION, "n", F.coalesce(rule, F.lit(False)).alias("is_good"))


def snap(counted: DataFrame, borders: DataFrame, fuzzy: int = 10) -> DataFrame:
    """chr, strand, left, right, n, new_left, new_right.

    Junctions are visited by descending support, then left, then right. One with two known borders
    stays; another moves to the first kept junction within `fuzzy` on both sides, looking at the left
    shift from small to large, then at the right shift; else it stays itself. Junctions whose lefts
    are more than `fuzzy` apart in an unbroken row can't touch, so each such island is a group.
    """
    side = lambda name: borders.select("chr", "strand", F.col("pos").alias(name), F.lit(True).alias(f"_{name}"))
    marked = counted.join(side("left"), ["chr", "strand", "left"], "left").join(side("right"), ["chr", "strand", "right"], "left")
    flagged = marked.withColumn("known", F.coalesce("_left", F.lit(False)) & F.coalesce("_right", F.lit(False))).select(*JUNCTION, "n", "known")
    reach = islands(flagged.withColumn("_s", F.col("left")).withColumn("_e", F.col("left") + fuzzy), ["chr", "strand"], "_s", "_e").drop("_s", "_e")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "left", "right"], ascending=[False, True, True])
        kept: dict[int, list[int]] = {}
        to = []
        for left, right, known in zip(pdf["left"], pdf["right"], pdf["known"]):
            target = None
            if not known:
                near = ((x, y) for x in range(left - fuzzy, left + fuzzy + 1) for y in kept.get(x, ()) if abs(y - right) <= fuzzy)
                target = min(near, default=None)
            if target is None:
                target = (left, right)
                kept.setdefault(left, []).append(right)
            to.append(target)
        return pdf.assign(new_left=[x for x, _ in to], new_right=[y for _, y in to])[[*JUNCTION, "n", "new_left", "new_right"]]

    kinds = dict(counted.dtypes)
    schema = f"chr {kinds['chr']}, strand string, left {kinds['left']}, right {kinds['right']}, n long, new_left {kinds['left']}, new_right {kinds['right']}"
    # islands don't touch each other, so a group may hold several
    return reach.groupBy("chr", "strand", F.floor(F.col("island") / 256).alias("cell")).applyInPandas(one, schema)


def expression(junctions: DataFrame, sample: str = "sample", samples: list[str] | None = None) -> DataFrame:
    """Junctions by sample, zeros filled. Naming the samples saves the extra job that finds them."""
    return junctions.groupBy(*JUNCTION).pivot(sample, samples).count().na.fill(0)


def exons_with_roles(tx: DataFrame, compat: bool = True) -> DataFrame:
    """tx, chr, strand, role, s, e for the exons of transcripts with two exons or more.

    The outer exons are tss and end by strand. With `compat` the last exon of a minus transcript ends
    at the left border of its intron, as in the tool whose tables users may have.
    """
    n = F.size("exon_starts")
    parts = tx.where(n > 1).select("tx", "chr", "strand", n.alias("n"), "exon_ends", F.posexplode(F.arrays_zip("exon_starts", "exon_ends")).alias("k", "x"))
    plus = F.col("strand") == "+"
    last = F.col("k") == F.col("n") - 1
    role = F.when(F.col("k") == 0, F.when(plus, "tss").otherwise("end")).when(last, F.when(plus, "end").otherwise("tss")).otherwise("mid")
    end = F.when(last & ~plus, F.get("exon_ends", F.col("k") - 1)).otherwise(F.col("x.exon_ends")) if compat else F.col("x.exon_ends")
    return parts.select("tx", "chr", "strand", role.alias("role"), F.col("x.exon_starts").alias("s"), end.alias("e"))


def snapped(junctions: DataFrame, moves: DataFrame) -> DataFrame:
    """Junction rows with the borders that snap() gave them."""
    return junctions.join(moves.select(*JUNCTION, "new_left", "new_right"), JUNCTION).drop("left", "right").withColumnsRenamed({"new_left": "left", "new_right": "right"})


def known_report(known: DataFrame) -> DataFrame:
    """Lines of the known junctions: chr, strand, left, right and the summed score."""
    one = known.groupBy(*JUNCTION).agg(F.sum("score").alias("score"))
    return one.select(F.concat_ws("\t", F.col("chr").cast("string"), "strand", F.col("left").cast("string"), F.col("right").cast("string"), plain_number(F.col("score"))).alias("value"))


def junction_report(junctions: DataFrame, borders: DataFrame, sample: str = "sample", samples: list[str] | None = None) -> DataFrame:
    """Junctions by sample with left_score, right_score (0 without a known border) and score, their sum."""
    side = lambda name: borders.select("chr", "strand", F.col("pos").alias(name), F.col("score").alias(f"{name}_score"))
    wide = expression(junctions, sample, samples)
    scored = wide.join(side("left"), ["chr", "strand", "left"], "left").join(side("right"), ["chr", "strand", "right"], "left").na.fill(0.0, ["left_score", "right_score"])
    return scored.withColumn("score", F.col("left_score") + F.col("right_score"))


def exon_report(tx: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """Exons by role and sample, zeros filled; `tx` has sample."""
    roles = exons_with_roles(tx).join(tx.select("tx", "sample"), "tx")
    return roles.groupBy("chr", "strand", "role", "s", "e").pivot("sample", samples).count().na.fill(0)
