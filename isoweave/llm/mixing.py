"""Operator 7: mixing sources to target weights by Pfair scheduling, DataFrame functions only.

The target of a source is what an ideal mix would have taken from it: each slot is shared by weight
among the sources that still have full blocks, so a source that ends leaves its share to the others.
Measured in virtual time v, a source of weight a with n full blocks has had min(n, a * v), and the
slot reached is the sum of that over all sources: a piecewise linear t(v). Block k of a source is
released at floor(t(k / a)) and due at ceil(t((k + 1) / a)). In every slot the released block with
the earliest deadline runs, so at every slot each source has received its target to within less than
one block, and all full blocks are in the mix. Release and deadline come from the weights themselves,
as whole numbers of a total that is as fine as 64 bits allow for the number of blocks (`fine_weights`).

Stretches of slots are scheduled apart from each other. Blocks with a deadline up to d are served as
if there were no others, so how many of them wait doesn't depend on which of them ran before. Two
schedules that have run equally many blocks by some slot are therefore the same from the last deadline
of the blocks then released. A stretch begins that much earlier, with any such state, and its own
slots are those of one schedule from slot 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoweave.llm.shared import masked, staged


def whole_weights(weights: DataFrame, cycle: int) -> DataFrame:
    """Slots by source: largest remainders to `cycle` slots, one slot at least.

    `weights(source, weight)` has one row for each source, a bounded table: the number of sources
    must be well below `cycle`. Null, negative and non-finite weights count as 0.
    """
    w = F.coalesce(F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight").cast("double")), F.lit(0.0))
    everyone = W.partitionBy(F.lit(0))
    spare = F.lit(cycle) - F.count("*").over(everyone)
    exact = (
        weights.select("source", w.alias("w")).where("w > 0")
        .withColumn("exact", F.col("w") / F.sum("w").over(everyone) * spare)
        .withColumn("base", F.floor("exact"))
    )
    order = everyone.orderBy((F.col("exact") - F.col("base")).desc(), F.col("source").asc_nulls_first())
    return exact.withColumn("left", spare - F.sum("base").over(everyone)).select("source", (F.col("base") + 1 + F.when(F.row_number().over(order) <= F.col("left"), 1).otherwise(0)).cast("int").alias("slots"))


def fine_weights(weights: DataFrame, blocks: int) -> DataFrame:
    """source, a, total: the share a/total of each source with a positive weight, as whole numbers.

    `blocks` is the number of all blocks. `total` times that number stays below 2**62, so over the
    whole mix rounding moves a share by blocks**2 / 2**61 of a block at most (4e-7 for a million
    blocks). Equal weights stay equal.
    """
    w = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight").cast("double"))
    everyone = W.partitionBy(F.lit(0))  # one row for each source
    # a divisor first: the sum of large weights stays finite
    shares = weights.select("source", w.alias("w")).where("w > 0").withColumn("w", F.col("w") / F.max("w").over(everyone))
    finest = min(float(1 << 50), float(1 << 61) / (blocks + 2))
    whole = shares.select("source", F.greatest(F.lit(1), F.round(F.col("w") / F.sum("w").over(everyone) * F.lit(finest))).cast("long").alias("a"))
    return whole.withColumn("total", F.sum("a").over(everyone))


#: Later than any slot.
NEVER = 1 << 62


def _let(value: Column, body) -> Column:
    """body(value), which evaluates the value once."""
    return F.get(F.transform(F.array(value), body), 0)


def _div(x: Column, by: Column) -> Column:
    return F.call_function("div", x, by)


def _phases(s: Column) -> Column:
    """The stretches of virtual time between the ends of sources, of an array of (source, a, full).

    Each has the `full` and `a` of the source that ends it, the blocks `gone` of sources that ended
    before, and the weight `live` of the others: at virtual time v the slot is gone + v * live.
    """
    by_end = F.array_sort(s, lambda x, y: F.when(x["full"] * y["a"] < y["full"] * x["a"], -1).when(x["full"] * y["a"] > y["full"] * x["a"], 1).otherwise(0))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("gone"), F.aggregate(s, zero, lambda n, x: n + x["a"]).alias("live"), F.array().cast("array<struct<full:bigint,a:bigint,gone:bigint,live:bigint>>").alias("all"))
    step = lambda n, x: F.struct((n["gone"] + x["full"]).alias("gone"), (n["live"] - x["a"]).alias("live"), F.array_append(n["all"], F.struct(x["full"].alias("full"), x["a"].alias("a"), n["gone"].alias("gone"), n["live"].alias("live"))).alias("all"))
    return F.aggregate(by_end, start, step, lambda n: n["all"])


def _slot(k: Column, a: Column, phases: Column, up: bool) -> Column:
    """The slot at virtual time k / a, rounded down or up."""
    found = F.get(F.filter(phases, lambda p: k * p["a"] <= p["full"] * a), 0)
    return _let(found, lambda p: p["gone"] + _div(k * p["live"] + (a - 1 if up else F.lit(0)), a))


def _next(k: Column, x: Column, phases: Column) -> Column:
    """Block k of a source (i, a, full); struct order is deadline, then source."""
    fields = [x["i"].alias("i"), k.alias("k"), x["a"].alias("a"), x["full"].alias("full")]
    never = F.lit(NEVER)
    return F.when(k < x["full"], F.struct(_slot(k + 1, x["a"], phases, True).alias("deadline"), *fields, _slot(k, x["a"], phases, False).alias("release"))).otherwise(F.struct(never.alias("deadline"), *fields, never.alias("release")))


RAN = "struct<i:bigint,k:bigint,at:bigint,release:bigint,deadline:bigint>"


def _stretch(s: Column, phases: Column, begin: Column, first: Column, end: Column, part: int = 64) -> Column:
    """Array of (i, k, at, release, deadline) for the slots from `first` up to `end`, by a schedule that starts at `begin`.

    By `begin` each source has run its target rounded down; the blocks that lack are those with the
    earliest deadlines.
    """
    now = F.get(F.filter(phases, lambda p: (begin - p["gone"]) * p["a"] <= p["live"] * p["full"]), 0)

    def started(p: Column) -> Column:
        had = lambda x: (begin - p["gone"]) * x["a"]
        floors = F.transform(s, lambda x, i: F.struct(F.least(x["full"], _div(had(x), p["live"])).alias("k"), x["a"].alias("a"), x["full"].alias("full"), i.cast("long").alias("i"), (had(x) % p["live"] > 0).alias("split")))
        lack = begin - F.aggregate(floors, F.lit(0).cast("long"), lambda n, x: n + x["k"])
        split = F.array_sort(F.transform(F.filter(floors, lambda x: x["split"] & (x["k"] < x["full"])), lambda x: _next(x["k"], x, phases)))
        early = F.transform(F.slice(split, F.lit(1), lack.cast("int")), lambda x: x["i"])
        return _let(early, lambda e: F.transform(floors, lambda x: _next(x["k"] + F.when(F.array_contains(e, x["i"]), 1).otherwise(0).cast("long"), x, phases)))

    def step(state: Column, t: Column) -> Column:
        pick = F.array_min(F.filter(state["ahead"], lambda x: x["release"] <= t))
        return _let(pick, lambda p: F.struct(
            F.transform(state["ahead"], lambda x: F.when(x["i"] == p["i"], _next(x["k"] + 1, x, phases)).otherwise(x)).alias("ahead"),
            F.concat(state["ran"], F.array(F.struct(p["i"].alias("i"), p["k"].alias("k"), t.alias("at"), p["release"].alias("release"), p["deadline"].alias("deadline")))).alias("ran")))

    def steps(state: Column, t: Column) -> Column:
        # parts keep the lists that grow by one short
        to = F.least(t + part, end) - 1
        run = F.aggregate(F.sequence(t, to), F.struct(state["ahead"].alias("ahead"), F.array().cast(f"array<{RAN}>").alias("ran")), step)
        return _let(run, lambda r: F.struct(r["ahead"].alias("ahead"), F.concat(state["parts"], F.array(F.filter(r["ran"], lambda x: x["at"] >= first))).alias("parts")))

    return F.aggregate(F.sequence(begin, end - 1, F.lit(part).cast("long")), F.struct(_let(now, started).alias("ahead"), F.array().cast(f"array<array<{RAN}>>").alias("parts")), steps, lambda s: F.flatten(s["parts"]))


def schedule(shares: DataFrame, length: int = 2048) -> DataFrame:
    """source, k, at, release and deadline: which block of which source runs in slot `at`.

    `shares(source, a, full)` has one row for each source that has a weight `a` and `full` blocks, one or
    more; every block has a slot. Stretches have `length` slots, or twice the longest window of a block
    if that is more.
    """
    one = shares.agg(F.array_sort(F.collect_list(F.struct("source", "a", "full"))).alias("s"), F.sum("full").alias("last"), _div(F.sum("a"), F.min("a")).alias("window")).where(F.size("s") > 0)
    cut = one.withColumn("window", F.col("window") + 2).withColumn("length", F.greatest(F.lit(length).cast("long"), F.least(2 * F.col("window"), "last"))).withColumn("phases", _phases(F.col("s")))
    # each stretch is a task of its own, however few bytes it has
    dealt = cut.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1, F.col("length")))).repartition("first")
    begin = F.greatest(F.lit(0).cast("long"), F.col("first") - F.col("window"))
    ran = dealt.select("s", F.explode(_stretch(F.col("s"), F.col("phases"), begin, F.col("first"), F.least(F.col("first") + F.col("length"), "last"))).alias("b"))
    return ran.select(F.get("s", F.col("b")["i"].cast("int"))["source"].alias("source"), *[F.col("b")[c].alias(c) for c in ("k", "at", "release", "deadline")])


def flattened_weights(docs: DataFrame, power: float = 0.5) -> DataFrame:
    """Target weights that favour small sources: number of documents to the given power."""
    return docs.groupBy("source").agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def mix(docs: DataFrame, weights: DataFrame, block: int = 4, cycle: int | None = None, cell_rows: int = 8192) -> DataFrame:
    """Orders `docs` so that every prefix of it holds the target weights.

    Adds source_rank, mix_slot, release, deadline, mix_pos and in_mix; a column of `docs` with one of
    these names stays as `<name>_given`, all other columns as they are. Blocks of `block` documents of a
    source are taken in an order that a digest of doc_id and source fixes. All full blocks are in the
    mix: in every slot each source is within one block of its target, where a source that has ended
    leaves its share to the others. What is less than a block follows behind, a slot for each source,
    with in_mix false; rows of sources without a positive weight are kept with mix_slot null. Both have
    no release and deadline. With `cycle` the targets are `whole_weights(weights, cycle)`.

    A null source is a source. Repeated rows are documents of their own, rows with a null id too.
    Texts are not looked at. No source is collected into a task: rows are numbered inside cells of a
    source with about `cell_rows` rows, whose starts come from their counts, and stretches of slots
    are scheduled apart; each holds one row of all sources. Nothing is broadcast by force. An empty
    table gives an empty one.
    """
    own = ["source_rank", "mix_slot", "release", "deadline", "mix_pos", "in_mix"]
    docs = docs.withColumnsRenamed({c: f"{c}_given" for c in own if c in docs.columns})
    order = docs.columns
    base, names = masked(docs, "doc_id", "source")
    cells = max(16, docs.count() // cell_rows)
    key = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))).cast("binary"))
    cell = F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.lit(cells)).cast("int")
    celled = base.withColumn("_key", key).withColumn("_cell", cell).withColumn("_src", F.struct("source"))
    counts = celled.groupBy("_src", "_cell").agg(F.count("*").alias("_n"))
    starts = counts.select("_src", "_cell", "_n", (F.sum("_n").over(W.partitionBy("_src").orderBy("_cell")) - F.col("_n")).alias("_start"))
    inside = W.partitionBy("_src", "_cell").orderBy("_key", F.col("doc_id").asc_nulls_first())
    totals = staged(counts.groupBy("_src").agg(F.sum("_n").alias("_n")), "mix-totals")
    targets = weights if cycle is None else whole_weights(weights, cycle).select("source", F.col("slots").alias("weight"))
    # one row for each source from here on
    blocks = totals.agg(F.coalesce(F.sum(F.ceil(F.col("_n") / block)), F.lit(0))).first()[0]
    shares = fine_weights(targets, int(blocks)).select(F.struct("source").alias("_src"), "a")
    by_source = staged(totals.join(shares, "_src").select("_src", "a", F.floor(F.col("_n") / block).alias("full"), (F.col("_n") % block > 0).alias("_over")), "mix-sources")
    last = by_source.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    plan = staged(schedule(by_source.where("full > 0").select(F.col("_src.source").alias("source"), "a", "full")).select(F.struct("source").alias("_src"), F.col("k").alias("_k"), "at", "release", "deadline"), "mix-slots")
    tails = by_source.where("_over").select("_src", (F.lit(last) + F.row_number().over(W.orderBy("_src")) - 1).alias("_tail"))
    # each cell gets the slots of its blocks, so that whole rows are shuffled to their cells and nowhere else
    block_of = lambda rank: F.floor(rank / block)
    spans = starts.withColumn("_k", F.explode(F.sequence(block_of(F.col("_start")), block_of(F.col("_start") + F.col("_n") - 1))))
    slots = spans.join(plan, ["_src", "_k"], "left").groupBy("_src", "_cell", "_start").agg(F.array_sort(F.collect_list(F.struct("_k", "at", "release", "deadline"))).alias("_slots")).join(tails, "_src", "left")
    numbered = celled.withColumn("_in", F.row_number().over(inside)).join(slots.hint("merge"), ["_src", "_cell"]).withColumn("source_rank", F.col("_start") + F.col("_in") - 1)
    placed = (
        numbered.withColumn("_slot", F.get("_slots", (block_of(F.col("source_rank")) - block_of(F.col("_start"))).cast("int")))
        .withColumn("release", F.col("_slot")["release"]).withColumn("deadline", F.col("_slot")["deadline"])
        .withColumn("in_mix", F.col("_slot")["at"].isNotNull())
        .withColumn("mix_slot", F.coalesce(F.col("_slot")["at"], "_tail"))
        .withColumn("mix_pos", F.col("mix_slot") * block + F.pmod("source_rank", F.lit(block)))
    )
    return placed.select(*[F.col(names.get(c, c)).alias(c) for c in order], *own)
