"""Column functions on nucleotide strings and numbers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def revcomp(seq: Column) -> Column:
    """Reverse complement; only upper-case bases are complemented."""
    return F.reverse(F.translate(seq, "ATCG", "TAGC"))


def edit_distance(a: Column, b: Column) -> Column:
    """Case-insensitive Levenshtein distance with unit costs."""
    return F.levenshtein(F.lower(a), F.lower(b))


def unknown_bases(seq: Column) -> Column:
    """Number of n or . in the sequence: the discount of a primer distance."""
    return F.length(seq) - F.length(F.regexp_replace(F.lower(seq), "[n.]", ""))


def best_primer_offset(seq: Column, primer: Column | str, max_error: float, last: int = 100) -> Column:
    """First offset 0..last with the smallest error rate below max_error; null without one.

    Windows shorter than the primer are not tried.
    """
    p = F.lit(primer.lower()) if isinstance(primer, str) else F.lower(primer)
    size = F.length(p)
    # distances that can't win need not be exact
    far = (max(0, math.ceil(max_error * len(primer)) - 1),) if isinstance(primer, str) else ()

    def search(head: Column) -> Column:
        places = F.when(F.length(head) >= size, F.sequence(F.lit(0), F.least(F.lit(last), F.length(head) - size)))
        tried = F.transform(places, lambda j: F.struct(F.levenshtein(F.substr(head, j + 1, size), p, *far).alias("d"), j.alias("j")))
        return F.array_min(F.filter(tried, lambda x: (x["d"] >= 0) & (x["d"] / size < max_error)))["j"]

    # the part that is searched is cut out and lower-cased once
    return F.get(F.transform(F.array(F.lower(F.substr(seq, F.lit(1), size + last))), search), F.lit(0))


def anchor_hits(seq: Column, anchor: str) -> Column:
    """0-based places of all occurrences, overlapping ones too.

    The sequence is cut in front of every occurrence once; the places are running sums of the pieces.
    """
    pieces = F.split(seq, f"(?={anchor})")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))

    def step(state: Column, piece: Column) -> Column:
        hit = (state["at"] > 0) | seq.startswith(anchor)  # every piece but the first begins with the anchor
        hits = F.when(hit, F.array_append(state["hits"], state["at"])).otherwise(state["hits"])
        return F.struct((state["at"] + F.length(piece)).alias("at"), hits.alias("hits"))

    return F.aggregate(pieces, start, step, lambda s: s["hits"])


def weight_of(read_id: Column) -> Column:
    """Number after the last `__` of an id; 1 without one, 0 if it is no number."""
    number = F.coalesce(F.substring_index(read_id, "__", -1).try_cast("double"), F.lit(0.0))
    return F.when(F.contains(read_id, F.lit("__")), number).otherwise(F.lit(1.0))


@F.pandas_udf(T.StringType())
def fixed3(x: pd.Series) -> pd.Series:
    """%.3f of the exact binary value, half to even."""
    return x.map(lambda v: None if pd.isna(v) else "%.3f" % v)


@F.pandas_udf(T.StringType())
def fixed2(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else "%.2f" % v)


def plain_number(x: Column) -> Column:
    """A weight without trailing zeros: 3 and 4.5."""
    return F.regexp_replace(F.call_function("format_number", x, F.lit("0.######")), r"\.$", "")


def exon_lengths(starts: Column, ends: Column) -> Column:
    """Sum of end - start over the exons."""
    return F.aggregate(F.zip_with(ends, starts, lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def introns(starts: Column, ends: Column) -> Column:
    """(left, right) of each pair of neighbouring exons; empty for one exon."""
    n = F.size(starts)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.get(ends, i - 1).alias("left"), F.get(starts, i).alias("right")))
    return F.when(n > 1, pairs).otherwise(F.slice(pairs, 1, 0))


def max_intron(starts: Column, ends: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(introns(starts, ends), lambda x: F.abs(x["right"] - x["left"]))), F.lit(0))


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap plus one, or -1 for disjoint and touching intervals."""
    both = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(both > 0, both + 1).otherwise(-1)
