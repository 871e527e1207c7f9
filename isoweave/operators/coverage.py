"""Coverage as a step function: later rows over earlier ones, and sums over any range as two lookups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bases of a bin: what one call paints, and one order of a lookup holds.
WIDTH = 10_000


def overlay(rows: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """keys, bin, s, e, value: disjoint pieces on which the last of `rows(keys, start, end, value)` counts.

    The order is that of `line_no`; without such a column, of start, end and value (cut at bins). Rows are cut at bins of `width`,
    and of pieces with the same borders only the last is dealt to the bin, where all are painted in
    their order. Rows without bases, and null keys, have no piece.
    """
    numbered = "line_no" in rows.columns
    order = F.col("line_no" if numbered else "start")
    b = rows.where("start < end").withColumn("_o", order).withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    s, e = F.greatest(F.col("start") - F.col("bin") * width, F.lit(0)).cast("int"), F.least(F.col("end") - F.col("bin") * width, F.lit(width)).cast("int")
    last = b.groupBy(*keys, "bin", s.alias("s"), e.alias("e")).agg(F.max(F.struct("_o", "end", "value")).alias("_v")).select(*keys, "bin", "s", "e", "_v._o", "_v.value")
    spread = last.groupBy(*keys, "bin").agg(F.count("*").alias("_n"))
    # bins with one piece are done; the others are painted
    alone = last.join(spread.where("_n = 1").select(*keys, "bin"), [*keys, "bin"], "left_semi").drop("_o")
    several = last.join(spread.where("_n > 1").select(*keys, "bin"), [*keys, "bin"], "left_semi")
    names = [*keys, "bin", "s", "e", "value"]

    def paint(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o" if numbered else ["_o", "s", "e", "value"], kind="stable")
        top = np.full(width, -1, np.int32)
        for k, (a, z) in enumerate(zip(pdf["s"].tolist(), pdf["e"].tolist())):
            top[a:z] = k
        cuts = np.r_[0, np.flatnonzero(top[1:] != top[:-1]) + 1]
        ends = np.r_[cuts[1:], width]
        held = top[cuts] >= 0
        out = pdf.iloc[top[cuts][held]].copy()
        out["s"], out["e"] = cuts[held].astype(np.int32), ends[held].astype(np.int32)
        return out[names]

    kinds = dict(last.dtypes)
    painted = several.groupBy(*keys, "bin").applyInPandas(paint, ", ".join(f"`{c}` {kinds[c]}" for c in names))
    at = F.col("bin") * width
    return alone.select(*names).unionByName(painted).select(*keys, "bin", (at + F.col("s")).alias("s"), (at + F.col("e")).alias("e"), "value")


def summed(steps: DataFrame, keys: list[str], points: DataFrame, at: str, width: int = WIDTH) -> DataFrame:
    """Adds upto to `points(keys, at, ...)`: the sum of the values of all bases in front of `at`.

    Points and pieces pass one order in each bin; what lies in front of a bin comes from one row for
    each bin. Pieces of bins that no point needs are not sorted.
    """
    own = [c for c in points.columns if c not in keys]
    size = F.col("value") * (F.col("e") - F.col("s"))
    totals = steps.groupBy(*keys, "bin").agg(F.sum(size).alias("_sum"))
    asked = points.select(*keys, F.floor(F.col(at) / width).alias("bin"), F.struct(*own).alias("_p"))
    needed = asked.select(*keys, "bin").distinct()
    line = W.partitionBy(*keys).orderBy("bin")
    front = needed.join(totals, [*keys, "bin"], "full_outer").withColumn("_front", F.coalesce(F.sum("_sum").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    pieces = steps.join(needed, [*keys, "bin"], "left_semi")
    pieces = pieces.withColumn("_pre", F.sum(size).over(W.partitionBy(*keys, "bin").orderBy("s")) - size)
    kind = asked.schema["_p"].dataType
    both = pieces.select(*keys, "bin", F.col("s").alias("_at"), F.lit(0).alias("_kind"), F.struct("s", "e", "value", "_pre").alias("_step"), F.lit(None).cast(kind).alias("_p")).unionByName(
        asked.select(*keys, "bin", F.col(f"_p.{at}").cast("long").alias("_at"), F.lit(1).alias("_kind"), "_p"), allowMissingColumns=True
    )
    seen = F.last("_step", ignorenulls=True).over(W.partitionBy(*keys, "bin").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("_step", seen).where("_kind = 1").join(front, [*keys, "bin"], "left")
    step = F.col("_step")
    inside = step["_pre"] + step["value"] * (F.least(F.col("_at"), step["e"]) - step["s"])
    return found.select(*keys, "_p.*", (F.col("_front") + F.coalesce(inside, F.lit(0))).alias("upto")).select(*points.columns, "upto")


def totals(steps: DataFrame, keys: list[str], ranges: DataFrame, start: Column, end: Column, width: int = WIDTH) -> DataFrame:
    """Adds total to `ranges`, whose rows must differ: the sum of the values of the bases in [start, end)."""
    ends = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), start.alias("at")), F.struct(F.lit(1).alias("sign"), end.alias("at"))))
    own = [c for c in ranges.columns if c not in keys]
    points = ranges.select(*keys, F.struct(*own).alias("_r"), ends.alias("_x")).select(*keys, "_r", "_x.sign", "_x.at")
    got = summed(steps, keys, points, "at", width)
    return got.groupBy(*keys, "_r").agg(F.sum(F.col("sign") * F.col("upto")).alias("total")).select(*keys, "_r.*", "total").select(*ranges.columns, "total")
