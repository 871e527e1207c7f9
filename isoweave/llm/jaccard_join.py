"""Operator 5: n-gram Jaccard join along chosen paths.

Every text is the set of its word shingles. A path samples shared tokens: at each step a set moves
on to the smallest of its tokens under a hash, so two sets take the same step with the probability
of their similarity. Sets that meet in a small bucket, or in one whose members are alike anyway,
are compared one by one; other large buckets are split by further steps, under hashes that the path
chooses, so that runs stay independent of each other. They are repeated until a pair at the
threshold is found with the target recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoweave.llm.shared import Coder, components, hot_join, list_array, mix64, one_text_by_id, roots, sorted_groups, staged

PIECE = 1 << 22
STEP = np.uint64(0x9E3779B97F4A7C15)
SOME, LOOKED_AT = 16, 12
POOL = 31  # hashes that the later steps of all paths choose from; a prime


def shingles(text: str, size: int, code: Coder) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a whole text, lower-cased, cut at white space.

    A text with fewer words than `size` is one shingle, one without words has none.
    """
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and not text[end].isspace():
            end += 1
        words = text[at:end].lower().split()
        parts.append(np.fromiter(map(code, words), dtype=np.uint64, count=len(words)))
        at = end
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n = min(size, len(codes))
    if not n:
        return codes
    h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = h * STEP + codes[k : k + len(h)]
    return np.unique(mix64(h))


def _sketches(docs: DataFrame, size: int, steps: int, seed: int) -> DataFrame:
    """doc_id, same (fingerprint of the set, null without words) and steps (smallest token under each hash)."""
    keys = np.random.default_rng(seed).integers(1, 1 << 63, (2, steps), dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                same, low = [], np.zeros((b.num_rows, steps), dtype=np.int64)
                for i, text in enumerate(b.column(1).to_pylist()):
                    s = shingles(text, size, code)
                    same.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                    wide = max(1, (1 << 18) // max(1, len(s)))
                    for k in range(0, steps if len(s) else 0, wide):
                        h = (s[None, :] ^ keys[0, k : k + wide, None]) * keys[1, k : k + wide, None]
                        low[i, k : k + wide] = s[(h >> np.uint64(20)).argmin(axis=1)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.string()), list_array(low.reshape(-1), np.full(b.num_rows, steps), pa.int64())], ["doc_id", "same", "steps"])

    return docs.mapInArrow(run, "doc_id long, same string, steps array<long>")


def runs_needed(threshold: float, recall: float, branch: int, levels: int) -> int:
    """Runs that find a pair at the threshold with the target recall.

    A run keeps the pair if both sets take its first step and, at every further split, one of `branch`.
    """
    kept = threshold * (1 - (1 - threshold) ** branch) ** (levels - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - kept))) if kept < 1 else 1


def _steps(runs: int, branch: int) -> Column:
    """The next steps of a set on a path: which of its POOL hashes are used depends on the path."""
    h, stride = F.pmod(F.xxhash64("path"), F.lit(POOL)), F.pmod(F.xxhash64(F.lit(1), "path"), F.lit(POOL - 1)) + 1
    at = lambda j: (F.lit(runs) + F.pmod(h + j * stride, F.lit(POOL))).cast("int")
    return F.array(*[F.get("steps", at(j)) for j in range(branch)])


def _agreement(now: DataFrame, large: DataFrame, sketch: DataFrame, runs: int, small: int) -> DataFrame:
    """path, agree: how often two sets of a large bucket take the same step, for each row of `large(path, m)`.

    Estimated from about SOME to 2 * SOME of its sets, which decides on the work, not on the result. One set in a
    power of two is taken, so that those no large bucket takes are left out before the join.
    """
    every = lambda m: F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1.0), m / SOME)))).cast("long")
    drawn = F.xxhash64("path", "rep")
    some = hot_join(now.where(F.pmod(drawn, every(F.lit(small + 1))) == 0), large, ["path"], ["rep"]).where(F.pmod(drawn, every(F.col("m"))) == 0)
    # written first, so that its size is known and the sketches need no shuffle where it is small
    taken = staged(some.select("path", "rep"), "large-paths").join(sketch, "rep").select("path", F.posexplode(F.slice("steps", runs + 1, LOOKED_AT)).alias("k", "t"))
    c = F.col("c")
    by_step = taken.groupBy("path", "k", "t").agg(F.count("*").alias("c")).groupBy("path", "k").agg((F.sum(c * (c - 1)) / F.greatest(F.lit(1), F.sum("c") * (F.sum("c") - 1))).alias("agree"))
    return by_step.groupBy("path").agg(F.avg("agree").alias("agree"))


def _leaves(sketch: DataFrame, runs: int, branch: int, levels: int, small: int, alike: float) -> DataFrame:
    """path, rep, m: the buckets that are compared, with their sizes (2 or more)."""
    now = sketch.select("rep", F.posexplode(F.slice("steps", 1, runs)).alias("k", "t")).select("rep", F.xxhash64("k", "t").alias("path"))
    found = []
    for level in range(1, levels + 1):
        now = staged(now, "next-paths")
        sizes = staged(now.groupBy("path").agg(F.count("*").alias("m")).where("m > 1"), "path-sizes")
        if level == levels:
            found.append(staged(hot_join(now, sizes, ["path"], ["rep"]), "paths"))
            break
        # how much buckets agree is known before their members are looked up, so that one join gives both
        judged = sizes.join(_agreement(now, sizes.where(F.col("m") > small), sketch, runs, small), "path", "left").na.fill(0.0, ["agree"])
        # one path may hold a third of all sets
        met = staged(hot_join(now, judged, ["path"], ["rep"]), "paths")
        # sets of a large bucket that mostly take the same steps aren't parted by more of them
        split = (F.col("m") > small) & (F.col("agree") < alike)
        found.append(met.where(~split))
        rest = met.where(split)
        if rest.isEmpty():
            break
        now = rest.join(sketch, "rep").select("rep", "path", F.posexplode(_steps(runs, branch)).alias("k", "t")).select("rep", F.xxhash64("path", "k", "t").alias("path"))
    out = found[0].select("path", "rep", "m")
    for f in found[1:]:
        out = out.unionByName(f.select("path", "rep", "m"))
    return out


def _cells(leaves: DataFrame, own: DataFrame, block: int) -> DataFrame:
    """path, i, j, own, rep: the pairs of blocks in which the members of a bucket are compared.

    Members whose smallest path is the same, and not this one, meet there already. Where they are many
    they have blocks of their own, which are held against the other blocks but not among themselves;
    so the buckets of a large group of near copies are compared once, and not in each run again.
    """
    low = own.select("rep", F.element_at("paths", 1).alias("low"))
    rows = staged(leaves.join(low, "rep").select("path", "rep", "m", F.when(F.col("low") < F.col("path"), F.col("low")).alias("g")), "bucket-rows")
    # only a bucket of `block` or more can have a settled group
    wide = rows.where(F.col("m") >= block)
    settled = wide.where("g is not null").groupBy("path", "g").agg(F.count("*").alias("c")).where(F.col("c") >= block)
    shape = settled.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("g", F.ceil(F.col("c") / block).cast("int").alias("n")))).alias("groups"), F.sum("c").alias("c"))
    # large paths alone have settled groups: one row for each
    known = hot_join(wide, staged(shape, "bucket-shapes"), ["path"], ["rep"], "left")
    known = known.unionByName(rows.where(F.col("m") < block), allowMissingColumns=True)
    groups = F.coalesce("groups", F.array().cast("array<struct<g:bigint,n:int>>"))
    mixed = F.greatest(F.lit(1), F.ceil((F.col("m") - F.coalesce("c", F.lit(0))) / block)).cast("int")
    before = lambda at: F.aggregate(F.slice(groups, F.lit(1), at), F.lit(0), lambda n, x: n + x["n"])
    at = F.array_position(F.transform(groups, lambda x: x["g"]), F.coalesce("g", F.lit(0))).cast("int")
    one = known.withColumn("at", F.when(F.col("g").isNull(), 0).otherwise(at)).withColumn("mixed", mixed).withColumn("all", mixed + before(F.size(groups)))
    # blocks 0 to mixed - 1 hold the others, then come those of each settled group
    first = F.when(F.col("at") > 0, F.col("mixed") + before(F.greatest(F.lit(0), F.col("at") - 1))).otherwise(0)
    many = F.when(F.col("at") > 0, F.get(groups, F.col("at") - 1)["n"]).otherwise(F.col("mixed"))
    dealt = one.withColumn("first", first).withColumn("many", many).withColumn("own", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("many")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda k: (F.col("at") == 0) | (k < F.col("first")) | (k >= F.col("first") + F.col("many")))
    placed = dealt.withColumn("other", F.explode(others))
    return placed.select("path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep")


def _first_here(path: int, lists: list[list[int]]) -> np.ndarray:
    """Pairs whose smallest common path is this one: each pair is compared in one bucket only."""
    n = len(lists)
    if n == 2:
        return np.full((2, 2), min(set(lists[0]) & set(lists[1])) == path)
    number: dict[int, int] = {}
    at = [(i, number.setdefault(p, len(number))) for i, own in enumerate(lists) for p in own if p < path]
    has = np.zeros((n, max(1, len(number))), dtype=np.float32)
    for i, k in at:
        has[i, k] = 1
    return has @ has.T == 0


def _common(sets: list[np.ndarray], want: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the wanted pairs."""
    n = len(sets)
    out = np.zeros((n, n))
    pairs = np.argwhere(np.triu(want, 1))
    if len(pairs) <= 64:
        for i, j in pairs:
            a, b = sets[i], sets[j]
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(b, a)
            out[i, j] = out[j, i] = (b[np.minimum(at, len(b) - 1)] == a).sum()
        return out
    token, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count[number] > 1
    number, owner = (np.cumsum(count > 1) - 1)[number[shared]], owner[shared]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    width = 4096
    for k in range(0, int((count > 1).sum()), width):
        a, b = np.searchsorted(number, [k, k + width])
        has = np.zeros((n, width), dtype=np.float32)
        has[owner[a:b], number[a:b] - k] = 1
        out += has @ has.T
    return out


def join(docs: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 0.9999, branch: int = 3, levels: int = 7, small: int = 64, alike: float = 0.5, block: int = 256, seed: int = 5) -> DataFrame:
    """doc_id, n_links, class_id and kept for each document of `docs(doc_id, text)`.

    Two documents are linked if the Jaccard similarity of their sets of `size`-word shingles, taken
    exactly, is `threshold` or more. n_links counts the other documents linked directly, class_id is
    the smallest doc_id that links lead to, and kept says that it is the document's own.

    Equal sets are compared once and counted as often as they occur. A pair at the threshold is in
    one bucket with probability `recall` or more. Buckets above `small` sets are split; where their
    members agree in `alike` of the next steps, or after `levels` steps, they are compared whole, in
    pairs of blocks of about `block` sets, so no bucket has to fit into a task.

    A text without words (null, empty) links with nothing. Rows that repeat an id are one document,
    with the smallest of its texts; rows with a null id are left out. Long texts are read whole.
    Other columns are ignored; an empty table gives an empty one.
    """
    rows = one_text_by_id(docs)
    runs = runs_needed(threshold, recall, branch, levels)
    sketched = staged(_sketches(rows, size, runs + POOL, seed), "sketches")
    member = sketched.select("doc_id", "same").where("same is not null")
    reps = member.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    sketch = staged(sketched.select(F.col("doc_id").alias("rep"), "steps").join(reps.select("rep", "copies"), "rep"), "sets")

    leaves = staged(_leaves(sketch.select("rep", "steps"), runs, branch, levels, small, alike).distinct(), "buckets")
    own = staged(leaves.groupBy("rep").agg(F.array_sort(F.collect_set("path")).alias("paths")), "own-paths")  # at most one for each run and branch
    cells = _cells(leaves, own, block).join(own, "rep")
    key = ["path", "i", "j"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs_here(t: pa.Table) -> np.ndarray:
        want = _first_here(t.column("path")[0].as_py(), t.column("paths").to_pylist())
        block_of = np.asarray(t.column("own"))
        if t.column("i")[0].as_py() != t.column("j")[0].as_py():
            want = want & (block_of[:, None] != block_of[None, :])
        np.fill_diagonal(want, False)
        return want

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, key):
            if t.num_rows > 1 and (use := pairs_here(t).any(axis=1)).any():
                yield from t.filter(pa.array(use)).combine_chunks().to_batches()

    schema = "path long, i int, j int, own int, rep long, paths array<long>"
    cells = cells.select("path", "i", "j", "own", "rep", "paths")
    todo = cells.repartition(parts, *key).sortWithinPartitions(*key, "rep").mapInArrow(needed, schema)
    full = todo.join(sketch.select("rep", "copies"), "rep").join(rows.withColumnRenamed("doc_id", "rep"), "rep").select("path", "i", "j", "own", "rep", "paths", "copies", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["rep", "n", "root"])
        for t in sorted_groups(batches, key):
            if t.num_rows < 2:
                continue
            want = pairs_here(t)
            sets = [shingles(x, size, code) for x in t.column("text").to_pylist()]
            common = _common(sets, want)
            length = np.array([len(s) for s in sets], dtype=np.float64)
            near = want & (common >= threshold * (length[:, None] + length[None, :] - common) - 1e-9)
            linked = np.flatnonzero(near.any(axis=1))
            if len(linked):
                rep = np.asarray(t.column("rep"))  # sorted: the smallest index is the smallest id
                root = roots(t.num_rows, *np.nonzero(near))
                count = near @ np.asarray(t.column("copies"))
                out.append((rep[linked], count[linked], rep[root[linked]]))
                held += len(linked)
            if held > 10_000:
                yield flush()
                out.clear()
                held = 0
        if out:
            yield flush()

    hits = staged(full.repartition(parts, *key).sortWithinPartitions(*key, "rep").mapInArrow(compare, "rep long, n long, root long"), "links")
    found = components(hits.select(F.col("rep").alias("a"), F.col("root").alias("b")), "jaccard").withColumnRenamed("node", "rep")
    counted = hits.groupBy("rep").agg(F.sum("n").alias("n"))
    by_set = reps.join(found, "rep", "left").join(counted, "rep", "left").select("same", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("class_id"))
    out = sketched.select("doc_id", "same").join(by_set, "same", "left")
    return out.select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id")).withColumn("kept", F.col("doc_id") == F.col("class_id"))
