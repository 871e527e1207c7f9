"""Coverage as a step function against painted arrays."""

import random

import pytest
from pyspark.sql import functions as F

from isoweave.operators import support
from isoweave.operators.coverage import overlay, summed, totals


def painted(rows, size):
    """Value of every base by key: later rows over earlier ones."""
    bases = {}
    for chr_, s, e, v, _ in sorted(rows, key=lambda r: r[4]):
        line = bases.setdefault(chr_, [0.0] * size)
        line[s:e] = [v] * max(0, e - s)
    return bases


@pytest.fixture
def coverage(spark):
    rng = random.Random(6)
    rows = []
    for k in range(400):
        s = rng.randrange(900)
        rows.append((rng.choice("ab"), s, min(1000, s + rng.choice([0, 1, 7, 40, 300])), float(rng.randrange(9)), k))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "chr string, start long, end long, value double, line_no long")


def test_the_last_row_over_a_base_counts(coverage):
    rows, df = coverage
    got = {}
    for r in overlay(df, ["chr"], width=64).collect():
        line = got.setdefault(r.chr, [0.0] * 1000)
        assert r.s < r.e and r.s // 64 == r.bin == (r.e - 1) // 64
        assert not any(line[r.s : r.e])
        line[r.s : r.e] = [r.value] * (r.e - r.s)
    assert got == painted(rows, 1000)


def test_sums_of_ranges_are_differences_of_lookups(spark, coverage):
    rows, df = coverage
    bases = painted(rows, 1000)
    rng = random.Random(8)
    ranges = sorted({(rng.choice("abc"), a, a + rng.randrange(400)) for a in (rng.randrange(-50, 1100) for _ in range(200))})
    steps = overlay(df, ["chr"], width=64)
    r = spark.createDataFrame(ranges, "chr string, s long, e long")
    value = lambda c, a, z: sum(bases.get(c, [])[max(a, 0) : max(z, 0)])
    got = sorted(map(tuple, totals(steps, ["chr"], r, F.col("s"), F.col("e"), width=64).collect()))
    assert got == [(c, a, z, value(c, a, z)) for c, a, z in ranges]
    up = summed(steps, ["chr"], r.select("chr", "s").distinct(), "s", width=64).collect()
    assert all(x.upto == value(x.chr, 0, x.s) for x in up)


def test_order_without_line_numbers_and_empty_tables(spark):
    kind = "chr string, start long, end long, value double"
    df = spark.createDataFrame([("a", 0, 10, 1.0), ("a", 5, 8, 2.0), ("a", 5, 8, 3.0), (None, 1, 2, 1.0), ("a", 9, 9, 7.0)], kind)
    assert sorted((r.s, r.e, r.value) for r in overlay(df.where("chr is not null"), ["chr"]).collect()) == [(0, 5, 1.0), (5, 8, 3.0), (8, 10, 1.0)]
    none = spark.createDataFrame([], kind)
    assert overlay(none, ["chr"]).count() == 0
    got = support.covered(spark.createDataFrame([("a", 1, 5, "x")] * 2, "chr string, s long, e long, extra string"), none, ["chr"]).collect()
    assert [(r.extra, r.total) for r in got] == [("x", 0.0)] * 2


def test_repeated_coverage_rows_count_once(spark):
    x = spark.createDataFrame([("c", "+", "g", 100, 200)], "chr string, strand string, gene string, s long, e long")
    cov = spark.createDataFrame([("c", "+", 100, 205, 9.0, k) for k in range(2)], "chr string, strand string, start long, end long, value double, line_no long")
    (once,), (twice,) = support.full_3end(x, cov.where("line_no = 0")).collect(), support.full_3end(x, cov).collect()
    assert once == twice and once.means[0] == 10.1


@pytest.mark.parametrize("steps", [1, 3, 64])
def test_decay_equals_a_walk_over_bases(spark, steps):
    rng = random.Random(12)
    loci, rows, n = [], [], 0
    for k in range(40):
        strand = rng.choice("+-")
        s = 3000 * k + 1000
        loci.append(("c", strand, f"g{k}", s, s + rng.randrange(1, 90)))
        for _ in range(rng.randrange(0, 12)):
            a = s + rng.randrange(-700, 700)
            rows.append(("c", strand, a, a + rng.randrange(1, 400), float(rng.choice([0, 1, 5, 30])), n))
            n += 1
    cov = {}
    for chr_, strand, a, z, v, _ in rows:
        cov.setdefault(strand, {}).update({i: int(1 + v) for i in range(a, z)})
    want = {}
    for _, strand, gene, s, e in loci:
        at = cov.get(strand, {})
        means = [float("%.3f" % (sum(at.get(i, 0) for i in range(s, e + 1)) / (e - s)))]
        while means[-1] > 0.05 * means[0]:
            k = len(means)
            begin = e - 50 + 50 * k if strand == "+" else s + 50 - 50 * k - 99
            means.append(float("%.3f" % (sum(at.get(i, 0) for i in range(begin, begin + 100)) / 100)))
        drop = next((i for i, m in enumerate(means) if m < 1), 0)
        want[gene] = (means, len(means) - 1, drop <= 2)
    x = spark.createDataFrame(loci, "chr string, strand string, gene string, s long, e long")
    c = spark.createDataFrame(rows, "chr string, strand string, start long, end long, value double, line_no long")
    assert {r.gene: (r.means, r.ext, r.is_full) for r in support.full_3end(x, c, steps=steps).collect()} == want
