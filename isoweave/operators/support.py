"""Evidence at transcript ends: peaks near the 5' end, coverage beyond the 3' end and around loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoweave.functions.seq import fixed3, overlap_length
from isoweave.operators.coverage import overlay, totals
from isoweave.operators.intervals import merge, neighbour_window, range_join
from isoweave.sources.scratch import written

KEYS = ["chr", "strand"]


def tss(strand: Column, start: Column, end: Column) -> Column:
    return F.when(strand == "+", start).otherwise(end)


def signed_distance(strand: Column, site: Column, start: Column, end: Column) -> Column:
    """0 inside the peak, else the distance to its nearer edge; negative upstream of it on +."""
    before = -(start - site)
    after = site - end
    d = F.when((site - start) * (site - end) <= 0, F.lit(0)).when(site < start, before).otherwise(after)
    return F.when(strand == "+", d).otherwise(-d)


def _spread(peaks: DataFrame, window: int) -> DataFrame:
    """chr, strand, peak_start, peak_end, peak_score and bin of the peaks that count, a row for each bin of `window`."""
    last = F.max_by(F.struct(F.col("end").alias("peak_end"), F.col("score").alias("peak_score")), "line_no").alias("_p")
    p = peaks.groupBy(*KEYS, F.col("start").alias("peak_start")).agg(last).select(*KEYS, "peak_start", "_p.*")
    return p.withColumn("bin", F.explode(F.sequence(F.floor(F.col("peak_start") / window), F.floor(F.col("peak_end") / window) + 1)))


def _distance() -> Column:
    return signed_distance(F.col("strand"), F.col("_at"), F.col("peak_start"), F.col("peak_end"))


def _bins_with_hits(sites: DataFrame, spread: DataFrame, window: int) -> DataFrame:
    """chr, strand, _at, bin of the `sites(chr, strand, _at)` with a peak in reach: the first bin that has one."""
    own = F.floor(F.col("_at") / window)
    looked = sites.withColumn("_look", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (own + d).alias("bin")) for k, d in ((0, 0), (1, -1), (2, 1))]))).select(*KEYS, "_at", "_look", "_look.bin")
    near = looked.join(spread, [*KEYS, "bin"]).where(F.abs(_distance()) <= window)
    first = near.groupBy(*KEYS, "_at").agg(F.min("_look.k").alias("_k"))
    return first.select(*KEYS, "_at", (own + F.when(F.col("_k") == 0, 0).when(F.col("_k") == 1, -1).otherwise(1)).alias("bin"))


def _ends(tx: DataFrame) -> DataFrame:
    return tx.withColumn("_at", tss(F.col("strand"), F.col("tx_start"), F.col("tx_end")))


def cage_support(tx: DataFrame, peaks: DataFrame, window: int = 50) -> DataFrame:
    """One row for each transcript and peak within `window` of its 5' end: adds peak_start, peak_end,
    peak_score and dist.

    Peaks lie in bins of `window`, from the bin of their start to the one behind that of their end. A
    site takes the peaks of its own bin; only without a hit there those of the bin before, then of
    the bin behind. Of peaks with one chr, strand, bin and start the last line counts. Which bin it is
    is asked once for each site, so the rows found are not shuffled.
    """
    spread = _spread(peaks, window)
    ends = _ends(tx)
    found = _bins_with_hits(ends.select(*KEYS, "_at").distinct(), spread, window)
    near = ends.join(found, [*KEYS, "_at"]).join(spread, [*KEYS, "bin"]).withColumn("dist", _distance()).where(F.abs("dist") <= window)
    return near.select(*tx.columns, "peak_start", "peak_end", "peak_score", "dist")


def cage_nearest(tx: DataFrame, peaks: DataFrame, width: int = 1_000_000) -> DataFrame:
    """tx, dist, peak_start: the nearest peak on the strand, however far; then the smaller start.

    Both tables are put in one order of position; the nearest peaks are the last one that starts at
    or before the site and the next one behind it, so no pair table is made. The order is taken in
    bins of `width`; what bins without a peak need comes from one row for each bin. Peaks must not
    overlap.
    """
    t = tx.select(*KEYS, "tx", tss(F.col("strand"), F.col("tx_start"), F.col("tx_end")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<s:bigint,e:bigint>").alias("peak"))
    p = peaks.select(*KEYS, F.lit(None).cast(dict(tx.dtypes)["tx"]).alias("tx"), F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e")).alias("peak"))
    both = t.unionByName(p).withColumn("_bin", F.floor(F.col("at") / width))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    last = lambda c, w: F.last(c, ignorenulls=True).over(earlier(w))
    own, bins = W.partitionBy(*KEYS, "_bin"), W.partitionBy(*KEYS)
    ends = both.groupBy(*KEYS, "_bin").agg(F.min("peak").alias("_low"), F.max("peak").alias("_high"))
    far = ends.select(*KEYS, "_bin", last("_high", bins.orderBy("_bin")).alias("_left"), last("_low", bins.orderBy(F.desc("_bin"))).alias("_right"))
    near = both.withColumn("before", last("peak", own.orderBy("at", "kind", "peak"))).withColumn("behind", last("peak", own.orderBy(F.desc("at"), F.desc("kind"), F.desc("peak"))))
    out = near.where("kind = 1").join(far, [*KEYS, "_bin"]).withColumn("before", F.coalesce("before", "_left")).withColumn("behind", F.coalesce("behind", "_right"))
    d = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(signed_distance(F.col("strand"), F.col("at"), F.col(c)["s"], F.col(c)["e"])).alias("d"), F.col(c)["s"].alias("s"), F.col(c)["e"].alias("e")))
    best = F.array_min(F.filter(F.array(d("before"), d("behind")), lambda x: x.isNotNull()))
    out = out.withColumn("best", best).where("best is not null")
    return out.select("tx", signed_distance(F.col("strand"), F.col("at"), F.col("best.s"), F.col("best.e")).alias("dist"), F.col("best.s").alias("peak_start"))


def cage_or_nearest(tx: DataFrame, peaks: DataFrame, window: int = 50) -> DataFrame:
    """tx, peak_start, dist, supported: the peaks within `window`, or the nearest one where there is none.

    The nearest peak is sought among the unions of overlapping peaks. Sites are judged once, however
    many transcripts begin there.
    """
    spread = _spread(peaks, window)
    ends = written(_ends(tx).select("tx", *KEYS, "_at"), "ends")
    sites = written(ends.select(*KEYS, "_at").distinct(), "sites")
    found = written(_bins_with_hits(sites, spread, window), "sites-with-peaks")
    unions = merge(peaks.select(*KEYS, "start", "end"), KEYS, "start", "end").drop("n")
    rest = sites.join(found, [*KEYS, "_at"], "left_anti").select(F.struct(*KEYS, "_at").alias("tx"), *KEYS, F.col("_at").alias("tx_start"), F.col("_at").alias("tx_end"))
    far = cage_nearest(rest, unions).select("tx.*", F.floor(F.col("tx._at") / window).alias("bin"), F.lit(False).alias("supported"), F.struct("peak_start", "dist").alias("_far"))
    judged = found.withColumn("supported", F.lit(True)).unionByName(far, allowMissingColumns=True)
    met = ends.join(judged, [*KEYS, "_at"]).join(spread.withColumn("supported", F.lit(True)), [*KEYS, "bin", "supported"], "left").withColumn("dist", _distance())
    kept = met.where(~F.col("supported") | (F.abs("dist") <= window))
    return kept.select("tx", F.coalesce("peak_start", "_far.peak_start").alias("peak_start"), F.coalesce("dist", "_far.dist").alias("dist"), "supported")


def last_exons(tx: DataFrame) -> DataFrame:
    """chr, strand, gene, s, e of each locus: on + the largest last start and end, on - the smallest
    first start and end."""
    plus = F.col("strand") == "+"
    start = F.when(plus, F.element_at("exon_starts", -1)).otherwise(-F.get("exon_starts", F.lit(0)))
    end = F.when(plus, F.element_at("exon_ends", -1)).otherwise(-F.get("exon_ends", F.lit(0)))
    return tx.groupBy(*KEYS, "gene").agg(F.abs(F.max(start)).alias("s"), F.abs(F.max(end)).alias("e"))


def covered(ranges: DataFrame, coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Adds total: the sum of the values of the bases in [s, e) of each range; the last row over a base counts."""
    sums = totals(overlay(coverage.select(*keys, *_spans(coverage)), keys), keys, ranges.select(*keys, "s", "e").distinct(), F.col("s"), F.col("e"))
    return ranges.join(sums, [*keys, "s", "e"], "left").select(*ranges.columns, F.coalesce("total", F.lit(0)).alias("total"))


def _spans(coverage: DataFrame) -> list[str]:
    return [c for c in ("start", "end", "value", "line_no") if c in coverage.columns]


def full_3end(exons: DataFrame, coverage: DataFrame, window: int = 100, cutoff: float = 0.05, mincov: float = 1, steps: int = 16) -> DataFrame:
    """Adds means (of the exon, then of windows beyond it), ext and is_full to the last exons.

    Windows of `window` bases follow the 3' end in steps of half a window as long as their mean is
    above `cutoff` of the exon's; the locus is complete if coverage falls below `mincov` within two
    steps. Coverage values count as int(1 + value), of rows over one base the last, and means as three
    decimals. Coverage becomes a step function once; windows are rows, and a mean is the
    difference of two of its sums. `steps` windows of each locus are looked at first; loci whose
    coverage goes on go on from there with four times as many. Loci on a chr without any coverage
    are left out. Exons must differ by chr, strand and gene.
    """
    names = exons.columns
    known = exons.join(coverage.select("chr").distinct(), "chr", "left_semi")
    step = written(overlay(coverage.select(*KEYS, *_spans(coverage)).withColumn("value", F.floor(1 + F.col("value"))), KEYS), "coverage-steps")
    size = F.col("e") - F.col("s")
    level = F.when(size != 0, fixed3(F.col("total") / size).cast("double")).otherwise(0.0)
    far = totals(step, KEYS, known.select(*KEYS, "gene", "s", "e"), F.col("s"), F.col("e") + 1).select(*KEYS, "gene", level.alias("level"))
    left = written(known.join(far, [*KEYS, "gene"]).withColumn("means", F.array("level")), "coverage-levels")
    done, at = left.where(F.col("level") <= cutoff * F.col("level")), 0
    left = left.where(F.col("level") > cutoff * F.col("level"))
    while not left.isEmpty():
        n = F.explode(F.sequence(F.lit(at + 1), F.lit(at + steps)))
        begin = F.when(F.col("strand") == "+", F.col("e") - window // 2 + window // 2 * F.col("n")).otherwise(F.col("s") + window // 2 - window // 2 * F.col("n") - window + 1)
        windows = left.select(*KEYS, "gene", "s", "e", n.alias("n")).withColumn("begin", begin).select(*KEYS, "gene", "n", "begin")
        means = totals(step, KEYS, windows, F.col("begin"), F.col("begin") + window).withColumn("mean", fixed3(F.col("total") / window).cast("double"))
        listed = means.groupBy(*KEYS, "gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "mean"))), lambda x: x["mean"]).alias("_more"))
        low = F.array_position(F.transform("_more", lambda m: (m <= cutoff * F.col("level")).cast("int")), 1)
        found = left.join(listed, [*KEYS, "gene"]).withColumn("_low", low.cast("int")).withColumn("means", F.concat("means", F.slice("_more", F.lit(1), F.when(F.col("_low") > 0, F.col("_low")).otherwise(F.size("_more")))))
        found = written(found.select(*names, "level", "means", (F.col("_low") == 0).alias("_open")), "coverage-windows")
        done = done.unionByName(found.where("not _open").drop("_open"))
        left = found.where("_open").drop("_open")
        at, steps = at + steps, 4 * steps
    drop = F.array_position(F.transform("means", lambda m: (m < mincov).cast("int")), 1)
    return done.select(*names, "means", (F.size("means") - 1).alias("ext"), (drop <= 3).alias("is_full"))


def route_by_3end(tx: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Transcripts with status FLT or nonflt: the verdict on a locus holds for all its transcripts.

    `verdicts` has chr, strand, gene and is_full, as full_3end() gives them; transcripts of loci
    without a verdict are left out.
    """
    v = verdicts.select(*KEYS, "gene", "is_full")
    return tx.join(v, [*KEYS, "gene"]).withColumn("status", F.when(F.col("is_full"), "FLT").otherwise("nonflt")).drop("is_full")


def end_report(verdicts: DataFrame) -> DataFrame:
    """Lines of the 3' end report: gene, chr, strand, s, e, extent, verdict and the means."""
    means = F.array_join(F.transform("means", lambda m: F.format_string("%.3f", m)), ",")
    return verdicts.select(F.concat_ws("\t", "gene", F.col("chr").cast("string"), "strand", *[F.col(c).cast("string") for c in ("s", "e", "ext")], F.when(F.col("is_full"), "FLT").otherwise("nonflt"), means).alias("value"))


def flt_windows(borders: DataFrame, coverage: DataFrame, window: int = 1000, share: float = 0.05, compat: bool = True) -> DataFrame:
    """Coverage inside each locus and in the window around it, and where it passes `share` of its peak.

    `borders` has chr, left, right, gl, strand, start, end and differs by chr, strand, gl and start;
    `coverage` has chr, start, end, value and line_no, which says what row over a base is the last.
    Counts weigh the length of a coverage row by its overlap plus one. A locus alone on its strand has
    no neighbour: with `compat` its window shrinks into it by a third of its length.
    """
    s, e = F.col("start"), F.col("end")
    wide = neighbour_window(borders, KEYS, window, "start", "end")
    alone = F.col("prev_gap").isNull() & F.col("next_gap").isNull()
    if compat:
        wide = wide.withColumn("win", F.when(alone, ((s - e) / 3).cast("long")).otherwise(F.col("win")))
    wide = wide.withColumn("win_start", s - F.col("win")).withColumn("win_end", e + F.col("win")).drop("prev_gap", "next_gap")
    c = coverage.select("chr", F.col("start").alias("cs"), F.col("end").alias("ce"), *_spans(coverage)[2:])
    outer = (F.least("left", "win_start"), F.greatest("right", "win_end"))
    inside = overlap_length(F.col("cs"), F.col("ce"), F.col("left"), F.col("right"))
    around = overlap_length(F.col("cs"), F.col("ce"), F.col("win_start"), F.col("win_end"))
    met = range_join(wide, c, ["chr"], F.lit(True), outer, (F.col("cs"), F.col("ce")), 10_000)
    met = written(met.withColumn("o1", inside).withColumn("o2", around).where((F.col("o1") > 0) | (F.col("o2") > 0)), "locus-coverage")
    is_in, size = F.col("o1") > 0, F.col("ce") - F.col("cs")
    keys = wide.columns
    sums = met.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(is_in, F.col("value"))), F.lit(1.0)).alias("cov_in"), F.coalesce(F.max(F.when(~is_in, F.col("value"))), F.lit(0.0)).alias("cov_out"),
        F.coalesce(F.sum(F.when(is_in, size * F.col("o1"))), F.lit(1)).alias("cnt_in"), F.coalesce(F.sum(F.when(~is_in, size * F.col("o2"))), F.lit(0)).alias("cnt_out"))
    # a base has the value of the last row over it that meets the locus; whole rows count, not their overlap
    own = ["chr", "strand", "gl", "start"]
    pieces = overlay(met.select(*own[:-1], F.col("start").alias("_locus"), F.col("cs").alias("start"), F.col("ce").alias("end"), "value", *(["line_no"] if "line_no" in met.columns else [])), [*own[:-1], "_locus"])
    limit = sums.select(*own[:-1], F.col("start").alias("_locus"), (share * F.greatest("cov_in", "cov_out")).alias("_limit"))
    strong = pieces.join(limit, [*own[:-1], "_locus"]).where(F.col("value") > F.col("_limit")).groupBy(*own[:-1], "_locus").agg(F.min("s").alias("_l"), F.max(F.col("e") - 1).alias("_r")).withColumnRenamed("_locus", "start")
    return sums.join(strong, own, "left").select(
        *keys, "cov_in", "cov_out", (F.col("cov_out") / F.col("cov_in")).alias("cov_ratio"), "cnt_in", "cnt_out", (F.col("cnt_out") / F.col("cnt_in")).alias("cnt_ratio"),
        F.coalesce("_l", F.lit(-1)).alias("new_left"), F.coalesce("_r", F.lit(-1)).alias("new_right"))


def near_peak(reads: DataFrame, peaks: DataFrame, near: int = 100, width: int = 1000, compat: bool = True) -> DataFrame:
    """Adds cage: whether a peak starts within `near` of the 5' end of each read; asked once for each such end.

    With `compat` the bin is that of tx_start on both strands, so long minus reads look in vain.
    """
    five = tss(F.col("strand"), F.col("tx_start"), F.col("tx_end"))
    own = reads.withColumn("_five", five).withColumn("_bin", F.floor((F.col("tx_start") if compat else five) / width))
    sites = own.select(*KEYS, "_five", "_bin").distinct()
    low, high = F.greatest(F.col("_five") - near + 1, (F.col("_bin") - 1) * width), F.least(F.col("_five") + near - 1, (F.col("_bin") + 2) * width - 1)
    sites = sites.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    # a range has parts of two cells at most; what a cell holds doesn't grow with the peaks
    cell = lambda x: F.floor(x / (2 * near))
    looked = sites.withColumn("_cell", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high")))))
    p = peaks.groupBy(*KEYS, cell(F.col("start")).alias("_cell")).agg(F.collect_set("start").alias("_starts"))
    met = looked.join(p, [*KEYS, "_cell"]).where(F.exists("_starts", lambda x: x.between(F.col("_low"), F.col("_high"))))
    hit = met.select(*KEYS, "_five", "_bin").distinct().withColumn("cage", F.lit(True))
    return own.join(hit, [*KEYS, "_five", "_bin"], "left").select(*reads.columns, F.coalesce("cage", F.lit(False)).alias("cage"))
