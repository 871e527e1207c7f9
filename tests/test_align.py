import random
import tracemalloc

import numpy as np

from isoweave.functions.align import align_batch, align_reads, least_places, seed_codes, whole_hits
from isoweave.functions.trim import revcomp
from isoweave.plans.correct import correct


def plain(a, b):
    """Best local alignment with affine gaps from one full table of scores and two of gap scores."""
    none = -(10**6)
    h, e, f = ([[v] * (len(b) + 1) for _ in range(len(a) + 1)] for v in (0, none, none))
    best = (0, 0, 0)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i - 1][j] - 6, e[i - 1][j] - 3)
            f[i][j] = max(h[i][j - 1] - 6, f[i][j - 1] - 3)
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -6), e[i][j], f[i][j])
            if h[i][j] > best[0]:
                best = (h[i][j], i, j)
    score, i, j = best
    end, ops = i, ""
    while h[i][j] > 0:
        if h[i][j] == h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -6):
            ops, i, j = "M" + ops, i - 1, j - 1
        elif h[i][j] == e[i][j]:
            n = next(g for g in range(1, i + 1) if h[i - g][j] - 3 - 3 * g == h[i][j])
            ops, i = "I" * n + ops, i - n
        else:
            n = next(g for g in range(1, j + 1) if h[i][j - g] - 3 - 3 * g == h[i][j])
            ops, j = "D" * n + ops, j - n
    ops = "S" * i + ops + "S" * (len(a) - end)
    cigar, last = "", 0
    for k in range(1, len(ops) + 1):
        if k == len(ops) or ops[k] != ops[last]:
            cigar, last = cigar + f"{k - last}{ops[last]}", k
    md, run, x, y, gone = "", 0, 0, j, False
    for op in ops:
        if op == "M":
            if a[x] == b[y]:
                run += 1
            else:
                md, run = md + f"{run}{b[y]}", 0
        elif op == "D":
            md, run = md + (b[y] if gone else f"{run}^{b[y]}"), 0
        gone = op == "D"
        x, y = x + (op != "D"), y + (op in "MD")
    return score, j, cigar, md + str(run)


def changed(rng, s, rate):
    out = []
    for c in s:
        x = rng.random()
        out += [] if x < rate / 3 else [c, rng.choice("ACGT")] if x < 2 * rate / 3 else [rng.choice("ACGT")] if x < rate else [c]
    return "".join(out)


def test_alignment_of_one_gap_each_way():
    ref = "ACGTTGCAGGCTTAACCGTATCGATTCGAGGCTA"
    got = align_batch([ref[2:30], ref[2:15] + "GG" + ref[15:30], ref[2:14] + ref[15:30], "AAAA" + ref[5:30], ref[2:16] + ("A" if ref[16] != "A" else "C") + ref[17:32]], [ref] * 5)
    assert [g[1:3] for g in got[:1]] == [(2, "28M")] and got[0][0] == 56 and got[0][3] == "28"
    assert got[1][2].count("I") == 1 and got[2][2].count("D") == 1 and "^" in got[2][3]
    assert got[3][2] == "4S25M" and got[3][1] == 5
    assert got[4][2] == "30M" and got[4][3] == f"14{ref[16]}15"


def test_band_and_full_table_equal_a_plain_table():
    rng = random.Random(3)
    pairs = []
    for _ in range(60):
        b = "".join(rng.choices("ACGT" if rng.random() < 0.7 else "AC", k=rng.randint(1, 90)))
        at = rng.randrange(len(b))
        pairs.append((changed(rng, b[at : at + rng.randint(1, 60)], rng.choice([0, 0.1, 0.3])) or "A", b))
    pairs.append(("ACGT", "TTTTT" * 3))
    expected = [plain(a, b) for a, b in pairs]
    full = align_batch([a for a, _ in pairs], [b for _, b in pairs])
    assert [g if g[0] else 0 for g in full] == [e if e[0] else 0 for e in expected]
    wide = max(len(a) + len(b) for a, b in pairs)
    assert [g if g[0] else 0 for g in align_batch([a for a, _ in pairs], [b for _, b in pairs], -wide, 2 * wide)] == [e if e[0] else 0 for e in expected]


def test_long_read_in_bounded_memory():
    rng = random.Random(5)
    window = "".join(rng.choices("ACGT", k=5100))
    read = window[40:2000] + window[2010:4000] + "ACG" + window[4000:5040]
    tracemalloc.start()
    ((score, start, cigar, _),) = align_batch([read], [window], 0, 96)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (start, score) == (40, 2 * (len(read) - 3) - 33 - 12) and "10D" in cigar and "3I" in cigar
    assert peak < 8 * 96 * len(read)


def test_seed_codes_leave_out_other_letters():
    assert seed_codes("A" * 21).tolist() == [0, 0] and seed_codes("A" * 19).tolist() == [] and seed_codes("N" + "T" * 20).tolist() == [-1, 4**20 - 1]


def hits(spark, reads, refs, **options):
    r = spark.createDataFrame([(k, s, 1.0) for k, s in reads.items()], "id string, seq string, weight double")
    t = spark.createDataFrame(list(refs.items()), "id string, seq string")
    return sorted((x.qname, x.rname, x.flag, x.pos, x.cigar, x.score) for x in align_reads(r, t, **options).collect())


def test_all_copies_get_hits_and_two_places_give_two(spark):
    rng = random.Random(1)
    piece, other = ("".join(rng.choices("ACGT", k=300)) for _ in range(2))
    copies = {f"c{i}": piece for i in range(12)}
    got = hits(spark, {"r": piece[100:180]}, copies)
    assert got == sorted(("r", c, 0, 101, "80M", 160) for c in copies)
    got = hits(spark, {"r": revcomp(piece[:80])}, {"two": piece[:80] + other + piece[:80]})
    assert got == [("r", "two", 16, 1, "80M", 160), ("r", "two", 16, 381, "80M", 160)]


def test_hits_of_a_read_are_limited_but_all_long_reads_are_met(spark):
    rng = random.Random(9)
    piece = "".join(rng.choices("ACGT", k=200))
    copies = {f"c{i}": piece for i in range(30)}
    reads = {f"r{i}": piece[i : i + 100] for i in range(60)}
    got = hits(spark, reads, copies, hits=5)
    each = {r: sum(g[0] == r for g in got) for r in reads}
    assert max(each.values()) <= 5 and {g[1] for g in got} == set(copies)


def test_seeds_with_one_mismatch_find_what_plain_alignment_finds(spark):
    rng = random.Random(11)
    refs = {f"l{i}": "".join(rng.choices("ACGT", k=400)) for i in range(3)}
    reads = {}
    for k in range(40):
        ref = refs[f"l{k % 3}"]
        at = rng.randrange(300)
        s = ref[at : at + 100]
        reads[f"r{k}"] = "".join(("ACGT"[("ACGT".index(c) + 1) % 4] if x % 17 == k % 17 else c) for x, c in enumerate(s)) if k % 2 else s
    for k in range(5):
        reads[f"n{k}"] = "".join(rng.choices("ACGT", k=100))
    expected = set()
    for k, s in reads.items():
        for name, ref in refs.items():
            for flag, x in ((0, s), (16, revcomp(s))):
                score, start, cigar, _ = plain(x, ref)
                if score >= 57:
                    expected.add((k, name, flag, start + 1, cigar, score))
    assert len(expected) >= 40 and set(hits(spark, reads, refs)) == expected


def test_whole_hits_equal_a_plain_search(spark):
    rng = random.Random(4)
    line = "".join(rng.choices("ACGT", k=70))
    texts = ["".join(rng.choices("ACGT", k=rng.randint(0, 300))) + (line * rng.randint(0, 4)) + "A" * rng.randint(0, 90) for _ in range(30)]
    refs = {f"l{i}": t for i, t in enumerate([*texts, *texts[:5], "", "ACGT" * 60, "xé" + line + "Nñ" + texts[0], None])}
    reads = {f"r{i}": t[at : at + rng.choice([50, 60, 100])] for i, t in enumerate(texts) for at in [rng.randrange(len(t) // 2 + 1)] if len(t) - at > 49}
    reads |= {"same": line[:50], "turned": revcomp(line)[5:65], "a": "A" * 50, "palindrome": "ACGT" * 15, "none": "".join(rng.choices("ACGT", k=80)), "null": None, "short": line[:20]}
    expected = {(q, r, f) for q, s in reads.items() for r, t in refs.items() for f, x in ((0, s), (16, s and revcomp(s))) if x and t and len(x) > 22 and x in t}
    a = spark.createDataFrame(list(reads.items()), "id string, seq string")
    b = spark.createDataFrame(list(refs.items()), "id string, seq string")
    got = [tuple(x) for x in whole_hits(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len({q for q, _, _ in got}) > 20


def test_least_places_of_windows_over_several_blocks():
    codes = np.random.default_rng(3).integers(0, 40, 300).astype(np.uint64) << np.uint64(50)
    for width in (1, 7, 40, 300, 301):
        assert least_places(codes, width, block=64).tolist() == sorted({a + int(codes[a : a + width].argmin()) for a in range(len(codes) - width + 1)})


def test_odd_sequences_have_no_hit(spark):
    assert hits(spark, {"a": "", "b": None, "c": "N" * 50, "d": "ACGTACGT"}, {"x": "ACGT" * 30, "y": None, "z": ""}) == []


def test_noisy_long_read_is_corrected(spark):
    rng = random.Random(2)
    truth = "".join(rng.choices("ACGT", k=600))
    noisy = []
    for i, c in enumerate(truth):  # one error in about 25 bases
        x = rng.random() if i % 5 == 2 else 1
        noisy += [] if x < 0.07 else [c, rng.choice("ACGT")] if x < 0.14 else [rng.choice("ACGT")] if x < 0.2 else [c]
    pieces = [truth[i : i + 100] for i in range(0, 501, 10)]
    reads = [(f"r{i}", revcomp(p) if i % 2 else p, 2.0) for i, p in enumerate(pieces)]
    long_ = spark.createDataFrame([("long", "".join(noisy))], "id string, seq string")
    shards = [spark.createDataFrame(reads[k::2], "id string, seq string, weight double") for k in (0, 1)]
    (got,) = correct(long_, shards).collect()
    inner = sum(got.seq[i : i + 12] in truth for i in range(0, len(got.seq) - 12))
    raw = "".join(noisy)
    before = sum(raw[i : i + 12] in truth for i in range(0, len(raw) - 12))
    assert inner > 0.97 * (len(got.seq) - 12) > before
