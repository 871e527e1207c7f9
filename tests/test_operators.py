"""Operators on small tables."""

from pyspark.sql import functions as F

from isoweave.functions import seq
from isoweave.operators import cluster, convert, intervals, junctions, loci, reads, runs, support, votes
from isoweave.plans import cluster_isoforms


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_votes_to_consensus(spark):
    v = spark.createDataFrame([("r", 0, "A", 2.0), ("r", 1, "Del", 3.0), ("r", 2, "GT", 5.0)], "id string, pos int, allele string, weight double")
    prior = votes.backbone(spark.createDataFrame([("r", "ACGT")], "id string, seq string"))
    got = votes.consensus(votes.pileup(votes.tally(v, prior))).first()
    assert (got.seq, got["mask"], got.covered, got.len) == ("AGTT", "1110", 3, 4)


def test_vote_merge_counts_the_prior_once(spark):
    kind = "id string, pos int, allele string, weight double"
    one, two = spark.createDataFrame([("r", 0, "A", 3.0), ("r", 0, "Del", 2.0)], kind), spark.createDataFrame([("r", 0, "A", 1.0), ("r", 0, "C", 3.0)], kind)
    prior = spark.createDataFrame([("r", 0, "A", 1.5)], kind)
    assert rows(votes.merge_shards([one, two], prior), "allele", "weight") == [("A", 5.5), ("C", 3.0), ("Del", 2.0)]


def test_closed_and_open_merge(spark):
    iv = spark.createDataFrame([(1, 0, 100), (1, 100, 200), (1, 300, 400), (1, 310, 320), (1, 390, 500)], "chr int, s long, e long")
    assert rows(intervals.merge(iv, ["chr"]), "s", "e", "n") == [(0, 200, 2), (300, 500, 3)]
    assert len(rows(intervals.merge(iv, ["chr"], touching=False), "s")) == 3


def test_overlap_length(spark):
    got = spark.createDataFrame([(0, 10, 5, 20), (0, 10, 10, 20), (0, 10, 2, 4)], "a long, b long, c long, d long").select(seq.overlap_length(*map(F.col, "abcd")).alias("o"))
    assert [r.o for r in got.collect()] == [6, -1, 3]


def test_range_join_gives_each_pair_once(spark):
    a = spark.createDataFrame([(1, "a", 0, 95), (1, "b", 30, 31), (2, "c", 0, 9)], "k int, x string, s long, e long")
    b = spark.createDataFrame([(1, "p", 0, 50), (1, "q", 90, 200), (3, "r", 0, 9)], "k int, y string, u long, v long")
    args = (F.lit(True), (F.col("s"), F.col("e")), (F.col("u"), F.col("v")), 10)
    assert rows(intervals.range_join(a, b, ["k"], *args), "x", "y") == [("a", "p"), ("a", "q"), ("b", "p")]
    assert rows(intervals.range_join(a, b, ["k"], *args, how="left"), "x", "y") == [("a", "p"), ("a", "q"), ("b", "p"), ("c", None)]


def test_snap_goes_to_the_first_kept_junction(spark):
    j = spark.createDataFrame([("c", "+", 100, 200, 9), ("c", "+", 104, 196, 5), ("c", "+", 111, 200, 2), ("c", "+", 500, 600, 1)], "chr string, strand string, left long, right long, n long")
    none = spark.createDataFrame([], "chr string, strand string, pos long, score double")
    got = rows(junctions.snap(j, none), "left", "new_left", "new_right")
    # 111 is within reach of neither what 104 was nor of 100: it stays
    assert got == [(100, 100, 200), (104, 100, 200), (111, 111, 200), (500, 500, 600)]


def test_snap_equals_one_greedy_pass_over_all(spark):
    import random

    rng = random.Random(5)
    table = {(rng.randrange(400), 1000 + rng.randrange(60)): rng.randrange(1, 9) for _ in range(300)}
    kept, moved = {}, {}
    for (left, right), n in sorted(table.items(), key=lambda x: (-x[1], x[0])):
        near = sorted(k for k in kept if abs(k[0] - left) <= 10 and abs(k[1] - right) <= 10)
        moved[left, right] = near[0] if near else (left, right)
        if not near:
            kept[left, right] = n
    j = spark.createDataFrame([("c", "+", l, r, n) for (l, r), n in table.items()], "chr string, strand string, left long, right long, n long")
    none = spark.createDataFrame([], "chr string, strand string, pos long, score double")
    got = {(r.left, r.right): (r.new_left, r.new_right) for r in junctions.snap(j, none).collect()}
    assert got == moved


def test_last_exon(spark):
    kind = "gene string, chr string, strand string, exon_starts array<long>, exon_ends array<long>"
    t = spark.createDataFrame([("p", "c", "+", [1, 10], [5, 30]), ("p", "c", "+", [1, 12], [5, 25]), ("m", "c", "-", [10, 90], [30, 99]), ("m", "c", "-", [12, 90], [25, 99])], kind)
    assert rows(support.last_exons(t), "gene", "s", "e") == [("m", 10, 25), ("p", 12, 30)]


def test_cigar_exons(spark):
    df = spark.createDataFrame([("2S10M5N4M2D3M1I2M",)], "c string")
    got = df.select(convert.cigar_exons(F.col("c"), F.lit(100)).alias("x"), convert.cigar_exons(F.col("c"), F.lit(100), compat=False).alias("y")).first()
    assert got.x.ends == [110, 126] and got.y.starts == [100, 115] and got.y.ends == [110, 126]
    assert got.x.starts == [100, 124]


def test_bed12_of_an_annotation_row(spark):
    kind = "gene string, tx string, chr string, strand string, tx_start long, tx_end long, cds_start long, cds_end long, n_exon int, exon_starts array<long>, exon_ends array<long>"
    s, e = [171030441, 171037018, 171044838], [171030573, 171037146, 171044890]
    b = convert.refflat_to_bed12(spark.createDataFrame([("X", "T", "chr6", "+", s[0], e[-1], s[0], s[0], 3, s, e)], kind)).first()
    assert b["sizes"] == [132, 128, 52] and b["starts"] == [0, 6577, 14397] and b["name"] == "X|T"


def test_consensus_wins_over_subreads_of_later_movies(spark):
    subs = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "d", 1)], "movie int, zmw string, read_id int").unionByName(spark.createDataFrame([(3, "b", 4)], "movie int, zmw string, read_id int"))
    ccs = spark.createDataFrame([(2, "b"), (1, "c")], "movie int, zmw string")
    wells = spark.createDataFrame([(m, z, 1) for m in (1, 2, 3) for z in "abc"] + [(1, "d", 0)], "movie int, zmw string, productive int")
    assert rows(reads.extract_subreads(subs, ccs, wells), "read_id") == [(1,), (2,)]


def test_unstranded_reads(spark):
    l = spark.createDataFrame([("c", "+", 0, 1000), ("c", "-", 5000, 6000), ("c", "+", 5000, 6000)], "chr string, strand string, start long, end long")
    r = spark.createDataFrame([("a", "c", 100, 200), ("b", "c", 5100, 5200), ("d", "c", 9000, 9050), ("e", "c", 9090, 9150)], "tx string, chr string, tx_start long, tx_end long")
    assert rows(loci.assign_unstranded(r, l), "tx", "strand", "start", "end") == [("a", "+", 0, 1000), ("b", None, 5100, 5300), ("d", None, 9000, 9100), ("e", None, 9000, 9100)]


def test_unstranded_reads_against_one_greedy_pass(spark):
    import random

    rng = random.Random(17)
    loci_ = [("c", s, k * 4000 + (0 if s == "+" else rng.choice((0, 1500))), k * 4000 + 1500) for k in range(12) for s in rng.choice((["+"], ["-"], ["+", "-"]))]
    loci_ = [(c, s, a, b + 700) for c, s, a, b in loci_]
    reads_ = [(f"r{i:03}", "c", a, a + rng.randrange(40, 900)) for i, a in enumerate(rng.randrange(0, 50_000) for _ in range(250))]
    want, neutral = {}, {}
    for tx, _, a, b in sorted(reads_, key=lambda r: (r[2], r[3], r[0])):
        near = {s: sorted((x, y) for _, ss, x, y in loci_ if ss == s and b >= x - 10 and a <= y + 10) for s in "+-"}
        if bool(near["+"]) != bool(near["-"]):
            s = "+" if near["+"] else "-"
            want[tx] = (s, *near[s][0])
            continue
        held = [x for x in sorted(neutral.items()) if near["+"] and x[0] <= a and b <= x[1]]
        found = held or [x for x in sorted(neutral.items()) if b >= x[0] - 10 and a <= x[1] + 10]
        if not found:
            found = [(a // 100 * 100, b // 100 * 100 + 100)]
            neutral[found[0][0]] = found[0][1]
        want[tx] = (None, *found[0])
    got = loci.assign_unstranded(spark.createDataFrame(reads_, "tx string, chr string, tx_start long, tx_end long"), spark.createDataFrame(loci_, "chr string, strand string, start long, end long"))
    assert {r.tx: (r.strand, r.start, r.end) for r in got.collect()} == want


def test_split_loci_renumbers(spark):
    t = spark.createDataFrame([("g", "a", 0, 10, 1), ("g", "b", 10, 20, 2), ("h", "c", 0, 10, 3), ("g", "d", 5, 8, 4)], "gene string, tx string, tx_start long, tx_end long, line_no long")
    assert rows(loci.split_loci(t), "tx", "gene") == [("a", "g.1"), ("b", "g.2"), ("c", "h"), ("d", "g.1")]


READS = "chr string, strand string, start long, end long, tx string, tx_start long, tx_end long, size long, is_rare boolean, cage boolean, junctions array<struct<left:long,right:long>>"


def test_isoforms_join_by_what_they_span(spark):
    read = lambda tx, s, e, *j: ("c", "+", 0, 1000, tx, s, e, e - s, False, False, list(j))
    table = [read("a", 0, 1000, (100, 200), (300, 400), (500, 600)), read("b", 310, 990, (500, 600)), read("c", 0, 1000, (100, 200), (500, 600)), read("d", 0, 90)]
    got = {r.tx: (r.status, r.members, r.exon_starts, r.exon_ends) for r in cluster.cluster(spark.createDataFrame(table, READS)).collect()}
    # b begins inside the second intron of a, so it is a piece of c alone
    assert got == {"a": ("cluster", ["a"], [0, 200, 400, 600], [100, 300, 500, 1000]), "c": ("cluster", ["c", "b"], [0, 200, 600], [100, 500, 1000]), "d": ("truncated", ["d"], [0], [90])}


def test_peak_search_prefers_its_own_bin(spark):
    t = spark.createDataFrame([("a", "c", "+", 120, 900), ("b", "c", "-", 0, 470)], "tx string, chr string, strand string, tx_start long, tx_end long")
    p = spark.createDataFrame([("c", "+", 80, 90, 1.0, 1), ("c", "+", 130, 140, 1.0, 2), ("c", "-", 480, 490, 1.0, 3)], "chr string, strand string, start long, end long, score double, line_no long")
    assert rows(support.cage_support(t, p), "tx", "peak_start", "dist") == [("a", 130, -10), ("a", 80, 30), ("b", 480, 10)]


def test_decay_beyond_the_exon(spark):
    x = spark.createDataFrame([("c", "+", "g", 0, 1000), ("c", "+", "h", 5000, 6000)], "chr string, strand string, gene string, s long, e long")
    cov = spark.createDataFrame([("c", "+", 0, 1000, 9.0), ("c", "+", 5000, 8000, 9.0)], "chr string, strand string, start long, end long, value double")
    assert rows(support.full_3end(x, cov), "gene", "is_full") == [("g", True), ("h", False)]


def test_runs_cross_stretches(spark):
    r = spark.createDataFrame([(i, "a" if i < 25 else "b") for i in range(30)] + [(30, "a")], "line_no long, k string")
    assert rows(runs.run_lengths(r, "line_no", "k", width=7), "k", "n") == [("a", 1), ("a", 25), ("b", 5)]


def test_primer_offset_and_anchor_places(spark):
    df = spark.createDataFrame([("TTACGTACGTACTT",), ("AC",)], "s string")
    got = df.select(seq.anchor_hits(F.col("s"), "ACGTAC").alias("h"), seq.best_primer_offset(F.col("s"), "ACGTAC", 0.2).alias("o")).collect()
    assert (got[0].h, got[0].o) == ([2, 6], 2) and (got[1].h, got[1].o) == ([], None)


def test_left_range_join_keeps_equal_rows(spark):
    a = spark.createDataFrame([(1, 0, 9), (1, 0, 9), (2, 0, 9), (2, 0, 9)], "k int, s long, e long")
    b = spark.createDataFrame([(1, "p", 5, 6)], "k int, y string, u long, v long")
    got = intervals.range_join(a, b, ["k"], F.lit(True), (F.col("s"), F.col("e")), (F.col("u"), F.col("v")), 10, how="left")
    assert rows(got, "k", "y") == [(1, "p"), (1, "p"), (2, None), (2, None)]


def test_islands_over_many_cells(spark):
    import random

    rng = random.Random(8)
    iv = [(k, s, s + rng.choice((0, 5, 40, 300))) for k in "ab" for s in (rng.randrange(4000) for _ in range(120))]
    for touching in (True, False):
        want = set()
        for k in "ab":
            reach, island = None, 0
            for s, e in sorted((s, e) for kk, s, e in iv if kk == k):
                if reach is None or (s > reach if touching else s >= reach):
                    island += 1
                want.add((k, s, e, island))
                reach = e if reach is None else max(reach, e)
        d = spark.createDataFrame(iv, "k string, s long, e long")
        got = intervals.islands(d, ["k"], touching=touching, width=50)
        assert got.count() == len(iv) and {tuple(r) for r in got.select("k", "s", "e", "island").collect()} == want


def test_decay_goes_on_to_the_end_of_coverage(spark):
    x = spark.createDataFrame([("c", s, "g", 100_000, 101_000) for s in "+-"], "chr string, strand string, gene string, s long, e long")
    cov = spark.createDataFrame([("c", "+", 100_000, 190_000, 9.0), ("c", "-", 20_000, 101_000, 9.0)], "chr string, strand string, start long, end long, value double")
    got = {r.strand: r for r in support.full_3end(x, cov, steps=4).collect()}
    assert not got["+"].is_full and not got["-"].is_full
    # 89 000 bases in steps of 50, then windows that reach beyond the end by half
    assert abs(got["+"].ext - 89_000 / 50) <= 3 and abs(got["-"].ext - 80_000 / 50) <= 3 and got["+"].means[-1] == 0.0


def test_found_peaks_are_not_shuffled_and_equal_a_plain_search(spark):
    import random
    import re

    rng = random.Random(8)
    tx = [(f"t{i}", rng.choice("ab"), rng.choice("+-"), s, s + rng.randint(0, 300)) for i in range(200) for s in [rng.choice([rng.randrange(3000), 777])]]
    peaks = [(rng.choice("abc"), rng.choice("+-"), s, s + rng.randint(0, 120), 1.0, i) for i in range(120) for s in [rng.randrange(40) * 60]]
    t = spark.createDataFrame(tx, "tx string, chr string, strand string, tx_start long, tx_end long")
    p = spark.createDataFrame(peaks, "chr string, strand string, start long, end long, score double, line_no long")
    last = {x[:3]: x for x in sorted(peaks, key=lambda x: x[5])}

    def away(strand, site, s, e):
        return (0 if s <= site <= e else site - s if site < s else site - e) * (1 if strand == "+" else -1)

    found = set()
    for name, c, strand, a, z in tx:
        site = a if strand == "+" else z
        own = [(x, away(strand, site, x[2], x[3])) for x in last.values() if x[:2] == (c, strand)]
        tried = [{(name, x[2], d) for x, d in own if abs(d) <= 50 and x[2] // 50 <= site // 50 + k <= x[3] // 50 + 1} for k in (0, -1, 1)]
        found |= next(filter(None, tried), set())
    near = support.cage_support(t, p)
    assert set(rows(near, "tx", "peak_start", "dist")) == found and near.count() == len(found) > 100
    assert re.search(r"Join \[([^\]]*)\]", near._jdf.queryExecution().executedPlan().toString())[1].count("bin#") == 1
    both = support.cage_or_nearest(t, p)
    assert set(rows(both.where("supported"), "tx", "peak_start", "dist")) == found
    unions = intervals.merge(p.select("chr", "strand", "start", "end"), ["chr", "strand"], "start", "end").drop("n")
    expected = [r for r in rows(support.cage_nearest(t, unions), "tx", "peak_start", "dist") if r[0] not in {f[0] for f in found}]
    assert rows(both.where("not supported"), "tx", "peak_start", "dist") == expected != []


def test_ids_are_renamed_one_to_one(spark):
    d = spark.createDataFrame([(f"r{i % 50}", "kept" if i % 3 else "discard") for i in range(200)], "id string, status string")
    got = reads.renamed_ids(d, "N", cell_rows=10).collect()
    assert sorted(r.id for r in got) == sorted({f"r{i % 50}" for i in range(200) if i % 3}) and sorted(int(r.new_id[1:]) for r in got) == list(range(1, len(got) + 1))


def test_new_ids_follow_the_order_of_the_ids_over_several_ranges(spark):
    d = spark.createDataFrame([(f"m{i % 3}/{i}", "kept") for i in range(500)], "id string, status string")
    got = {r.id: r.new_id for r in reads.renamed_ids(d, "N", cell_rows=20).collect()}
    assert got == {x: f"N{k + 1}" for k, x in enumerate(sorted(got))} and len(got) == 500


def test_peaks_near_5end_equal_a_plain_search_by_cells(spark):
    import random

    rng = random.Random(6)
    tx = [(f"t{i}", rng.choice("ab"), rng.choice("+-"), s, s + rng.choice([50, 900, 2500])) for i in range(300) for s in [rng.randrange(12_000)]]
    peaks = [(rng.choice("abc"), rng.choice("+-"), rng.choice([4000 + rng.randrange(40), rng.randrange(12_000)])) for _ in range(250)]
    t = spark.createDataFrame(tx, "tx string, chr string, strand string, tx_start long, tx_end long")
    p = spark.createDataFrame(peaks, "chr string, strand string, start long")
    for compat in (True, False):
        expected = set()
        for name, c, strand, a, z in tx:
            five = a if strand == "+" else z
            bin_ = (a if compat else five) // 1000
            expected.add((name, any(q[:2] == (c, strand) and abs(q[2] - five) < 100 and abs(q[2] // 1000 - bin_) < 2 for q in peaks)))
        near = support.near_peak(t, p, compat=compat)
        assert set(rows(near, "tx", "cage")) == expected and len({x for _, x in expected}) == 2
        # peaks are gathered by cell before they are joined
        assert "_starts" in near._jdf.queryExecution().executedPlan().toString()


def test_many_classes_of_one_pattern_are_placed_in_proportional_time():
    import time

    began = time.process_time()
    locus, n = cluster.Locus("+", 3), 30_000
    for k in range(n):
        assert locus.place({"uses": [0, 1], "first": 0, "end": 2, "three": k * 7, "cage": True, "lead": f"a{k}"})[0] == "each"
    found = [locus.place({"uses": [0, 1, 2][: 2 + k % 2], "first": 0, "end": 2, "three": n * 7 + k, "cage": False, "lead": f"b{k}"}) for k in range(0, 300, 50)]
    # the first isoform in reach, then those of the classes themselves
    assert found == [("join", "a29986"), ("join", "a29993"), ("join", "b100"), ("join", "b100"), ("join", "b200"), ("join", "b200")]
    assert time.process_time() - began < 10


def test_groups_of_one_class_are_placed_together():
    one, two = ((100, 200),), ((100, 200), (300, 400))
    groups = [(one, 50, 500, False, "a", -90), (one, 52, 500, False, "b", -95), (two, 50, 550, False, "c", -80), (one, 51, 500, True, "d", -70)]
    assert list(cluster.placed_classes("+", groups)) == [("c", "join", "c", 0), ("b", "join", "b", 1), ("a", "join", "b", 1), ("d", "each", "d", 1)]


def greedy_isoforms(reads_, plus):
    """Isoforms of one locus as plain lists: what each read spans, compared one by one."""
    slots = sorted({j for r in reads_ for j in r["junctions"]})
    n, spans, bits = len(slots), {}, {}
    for r in reads_:
        five, three = (r["s"] + 10, r["e"]) if plus else (r["s"], r["e"] - 10)
        before = [k for k, (_, right) in enumerate(slots) if five > right]
        beyond = [k for k, (left, _) in enumerate(slots) if three < left]
        spans[r["tx"]] = (before[-1] + 1 if before else 0, beyond[0] if beyond else n)
        bits[r["tx"]] = [j in r["junctions"] for j in slots]
    weight = lambda r: sum(2**k for k, b in enumerate(bits[r["tx"]] if plus else bits[r["tx"]][::-1]) if b)
    order = sorted(reads_, key=lambda r: (spans[r["tx"]][0] - spans[r["tx"]][1], -weight(r), -r["size"], r["tx"]))
    three = lambda r: r["e"] if plus else r["s"]
    found, short = [], []
    for r in order:
        if not any(bits[r["tx"]]):
            short.append(r["tx"])
            continue
        a, b = spans[r["tx"]]
        cut = slice(a, b) if b >= a else slice(a, max(a, n + b - a))
        own = bits[r["tx"]][cut]
        alike = [c for c in found if bits[c[0]["tx"]][cut] == own]
        if alike and not plus and own in ([], [False]):
            short.append(r["tx"])
            continue
        near = [c for c in alike if abs(three(c[0]) - three(r)) < 100 and not r["cage"]]
        if near:
            near[0].append(r)
        else:
            found.append([r])
    return sorted(tuple(m["tx"] for m in c) for c in found), sorted(short)


def random_locus(rng, locus, n, slots=6):
    every = [(100 + 200 * k, 200 + 200 * k) for k in range(slots)]
    out = []
    for i in range(n):
        a, b = sorted(rng.sample(range(slots + 1), 2))
        j = [x for x in every[a:b] if rng.random() < 0.8]
        s, e = (j[0][0] if j else every[a][0]) - rng.choice((30, 45, 60)), (j[-1][1] if j else every[b - 1][1]) + rng.choice((30, 60, 90))
        if rng.random() < 0.1:  # a read that lies inside one intron
            s, e = every[a][0] + 20, every[a][0] + 60
        out.append({"tx": f"l{locus}r{i:04}", "s": s, "e": e, "junctions": j, "size": (e - s) // rng.choice((1, 2)), "cage": rng.random() < 0.15})
    return out


def test_isoforms_against_plain_lists(spark):
    import random

    rng = random.Random(12)
    table, want = [], {}
    for locus in range(40):
        strand = "+-"[locus % 2]
        reads_ = random_locus(rng, locus, 4 + locus)
        want[locus * 10_000] = greedy_isoforms(reads_, strand == "+")
        table += [("c", strand, locus * 10_000, locus * 10_000 + 5000, r["tx"], r["s"], r["e"], r["size"], False, r["cage"], r["junctions"]) for r in reads_]
    got = {}
    for r in cluster.cluster(spark.createDataFrame(table, READS)).collect():
        isoforms, short = got.setdefault(r.start, ([], []))
        if r.status == "truncated":
            short.append(r.tx)
        else:
            isoforms.append(tuple(r.members))
    assert {k: (sorted(a), sorted(b)) for k, (a, b) in got.items()} == want


def test_a_locus_of_many_reads_is_placed_by_its_classes(spark, monkeypatch):
    import random

    rng = random.Random(5)
    few = random_locus(rng, 0, 25)
    reads_ = [r | {"tx": f"r{i:05}", "size": 500 + i % 700, "cage": False} for i, r in enumerate(few * 400)]
    table = [("c", "-", 0, 5000, r["tx"], r["s"], r["e"], r["size"], False, False, r["junctions"]) for r in reads_]
    placed = cluster._classes
    sizes = []
    monkeypatch.setattr(cluster, "_classes", lambda rows: (sizes.append(placed(rows).count()), placed(rows))[1])
    got = cluster.cluster(spark.createDataFrame(table, READS)).collect()
    assert sizes[0] <= 25 < 10_000 == sum(len(r.members) for r in got)
    assert (sorted(tuple(r.members) for r in got if r.status != "truncated"), sorted(r.tx for r in got if r.status == "truncated")) == greedy_isoforms(reads_, False)


def test_unstranded_rare_and_single_reads_of_loci(spark):
    read = lambda strand, start, tx, s, e, rare=False: ("c", strand, start, start + 900, tx, s, e, e - s, rare, False, [])
    table = [read(None, 0, "a", 0, 100), read(None, 0, "b", 60, 210), read(None, 0, "c", 70, 220), read(None, 0, "d", 300, 390), read(None, 2000, "e", 2000, 2100), read("+", 4000, "f", 4000, 4100, True), read("+", 4000, "g", 4000, 4100)]
    got = {r.tx: (r.status, r.tx_start, r.tx_end, r.members) for r in cluster.cluster(spark.createDataFrame(table, READS)).collect()}
    assert got == {"b": ("cluster", 0, 390, ["b", "a", "c", "d"]), "e": ("single", 2000, 2100, ["e"]), "f": ("rare", 4000, 4100, ["f"]), "g": ("truncated", 4000, 4100, ["g"])}
    assert cluster.cluster(spark.createDataFrame([], READS)).count() == 0


def test_isoform_plan_routes_and_reports(spark, tmp_path):
    def tx(name, strand, *exons):
        return ("g", name, "c", strand, exons[0][0], exons[-1][1], len(exons), [s for s, _ in exons], [e for _, e in exons])

    e = [(1000, 1200), (1300, 1500), (1600, 1900)]
    rows_ = [tx("a_1", "+", *e), tx("a_2", "+", *e), tx("b_3", "+", (1000, 1200), (1305, 1500), (1600, 1900)), tx("b_4", "+", (1000, 1080)), tx("b_5", "+", (1000, 1200), (300_000, 300_400)), tx("c_6", None, (1100, 1400)), tx("c_7", None, (90_000, 90_400)), tx("c_8", "+", *e)]
    t = spark.createDataFrame(rows_, "gene string, tx string, chr string, strand string, tx_start long, tx_end long, n_exon int, exon_starts array<long>, exon_ends array<long>").withColumn("cds_start", F.col("tx_start")).withColumn("cds_end", F.col("tx_start"))
    lengths = t.select(F.col("tx").alias("id"), seq.exon_lengths(F.col("exon_starts"), F.col("exon_ends")).alias("len"))
    known = spark.createDataFrame([("c", "+", 1200, 1300, 5.0), ("c", "+", 1500, 1600, 5.0)], "chr string, strand string, left long, right long, score double")
    peaks = spark.createDataFrame([("c", "-", 5, 9, 1.0, 1)], "chr string, strand string, start long, end long, score double, line_no long")
    coverage = t.select(F.col("tx").alias("id"), F.when(F.col("tx") == "c_8", 20.0).otherwise(99.0).alias("pct"))
    got = cluster_isoforms.cluster_isoforms(t, lengths, known, known, peaks, coverage)
    assert {r.tx: r.status for r in got.reads.collect()} == {"a_1": "used", "a_2": "used", "b_3": "used", "b_4": "short", "b_5": "long", "c_6": "used", "c_7": "used", "c_8": "lowcov"}
    # b_3 snaps to the known junction; c_6 lies near the plus locus, c_7 near none
    by = {r.tx: r for r in got.clusters.collect()}
    assert by["a_1"].members == ["a_1", "a_2", "b_3"] and (by["a_1"].strand, by["a_1"].exon_starts) == ("+", [1000, 1300, 1600])
    assert by["c_6"].status == "truncated" and (by["c_7"].status, by["c_7"].strand) == ("single", None)
    assert {(r["left"], r["a"], r["b"], r["score"]) for r in got.junctions.collect()} == {(1200, 2, 1, 10.0), (1500, 2, 1, 10.0)}
    got.write(f"file://{tmp_path}/out")
    assert "a_1,a_2,b_3" in spark.read.text(f"file://{tmp_path}/out/cluster").first().value
    assert [r.n_isoforms for r in got.loci.collect()] == [1]
