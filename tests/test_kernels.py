"""Kernels without Spark: hand cases for every rule that changes values."""

import random

import pytest

from isoweave.functions.pileup import Alleles, coded_votes, expand, overlay, pile, piled, votes
from isoweave.functions.trim import Trimmer, distance, poly_a, revcomp

PILEUPS = [
    ("4M", "4", "ACGT", "MMMM", [(0, "A"), (1, "C"), (2, "G"), (3, "T")]),
    ("4M", "1T2", "ACGT", "MCMM", [(0, "A"), (1, "C"), (2, "G"), (3, "T")]),
    ("2M1I2M", "4", "ACGTA", "MMIMM", [(0, "A"), (1, "CG"), (2, "T"), (3, "A")]),
    ("2M1D2M", "2^G2", "ACGT", "MMDMM", [(0, "A"), (1, "C"), (2, "Del"), (3, "G"), (4, "T")]),
    ("2M1D1I2M", "2^G2", "ACTGT", "MMDIMM", [(0, "A"), (1, "C"), (2, "T"), (3, "G"), (4, "T")]),
    ("3M1D", "3^G0", "ACG", "MMMD", [(0, "A"), (1, "C"), (2, "G"), (3, "")]),
    ("2S4M", "4", "TTACGT", "SSMMMM", [(0, "A"), (1, "C"), (2, "G"), (3, "T")]),
    ("4S3M", "3", "TTTTACG", "SSSSMMM", []),
    ("3M1I3M", "3T2", "ACGTAAC", "MMMTMMM", [(0, "A"), (1, "C"), (2, "G"), (3, "T"), (4, "A"), (5, "A"), (6, "C")]),
    ("1S4M", "0A3", "TACGT", "TMMMM", [(0, "T"), (1, "A"), (2, "C"), (3, "G"), (4, "T")]),
]


@pytest.mark.parametrize("cigar,md,seq,master,expected", PILEUPS)
def test_pileup(cigar, md, seq, master, expected):
    assert overlay(*expand(cigar, seq), md) == master
    assert votes(cigar, md, seq, 0) == expected


TAILS = [("", 0), ("A" * 5, 0), ("A" * 7, 0), ("A" * 8, 8), ("A" * 12, 12), ("A" * 20, 20), ("A" * 40, 40), ("A" * 8 + "GGG", 11), ("A" * 10 + "G" + "A" * 10, 20), ("A" * 20 + "G", 21), ("A" * 12 + "GG" + "A" * 5, 19), ("A" * 5 + "C" * 6 + "A" * 10, 10), ("A" * 30 + "TT", 32)]


@pytest.mark.parametrize("tail,expected", TAILS)
def test_poly_a(tail, expected):
    assert poly_a("C" * 400 + tail) == expected


def test_poly_a_of_short_and_empty_reads():
    assert poly_a("") == 0
    assert isinstance(poly_a("AAA"), int)


def test_distance_is_the_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("acgt", k=rng.randrange(9))) for _ in range(2))
        assert distance(a, b) == plain(a, b) == distance(b.upper(), a)


def test_revcomp_twice_is_itself():
    assert revcomp(revcomp("ACGTTGnA")) == "ACGTTGnA"


TRIM = Trimmer(adapter3="AAGCAGTGGTATCAACGCAGAGTAC", adapter5="ACGTTGCATTGCAC", error=0.1, least=50)
BODY = "".join(random.Random(3).choices("CGT", k=200))


def test_read_with_primer_and_tail():
    ((id_, seq, code, tail, status),) = TRIM.read("r", TRIM.adapter5 + BODY + "C" + "A" * 30)
    assert (code, tail, status) == ("pNAp", 30, "kept") and seq == BODY + "C" and id_ == "r_SUB0_pNAp_30"


def test_read_of_the_other_strand():
    ((_, seq, code, tail, _),) = TRIM.read("r", "T" * 30 + BODY)
    assert code == "uTNu" and tail == 30 and revcomp(seq) == BODY


def test_adapter_cuts_the_read():
    got = TRIM.read("r", BODY + "A" * 20 + TRIM.rc3 + BODY)
    assert [r[4] for r in got][0] == "kept" and len(got) == 2


def test_short_reads_are_discarded():
    assert TRIM.read("r", "ACGT") == [("r", "ACGT", None, None, "discard")]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a.lower(), 1):
        row, before = [i], row
        for j, y in enumerate(b.lower(), 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_segments_and_primers_against_plain_loops():
    import random

    rng = random.Random(21)
    t = Trimmer(adapter3="AAGCAGTGGTATCAACGCAGAGTAC", adapter5="ACGTTGCATTGCAC", error=0.25, least=50)
    back = t.adapter3[::-1].translate(str.maketrans("ACGT", "TGCA"))
    grams = [(i, back[i : i + 6]) for i in range(0, 20, 3)]
    grams = [(i, g) for i, g in grams if [h for _, h in grams].count(g) == 1]

    def noisy(x):
        return "".join(rng.choice("ACGTn") if rng.random() < 0.08 else c for c in x)

    for _ in range(60):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 30)))
        for _ in range(rng.randrange(5)):
            seq += noisy(rng.choice([back, t.adapter5, t.adapter3, "A" * 20])) + "".join(rng.choice("ACGT") for _ in range(rng.randrange(90)))
        hits = []
        for i, g in grams:
            for at in (k for k in range(len(seq) - 5) if seq[k : k + 6] == g):
                if not any(abs((at - i) - (f - a)) <= 6 for f, a in hits):
                    hits.append((at, i))
        want, place = [], 0
        for f, a in sorted(hits):
            start = max(0, f - a)
            window = seq[start : start + 25]
            unknown = sum(c in "nN." for c in window)
            if place < len(seq) and (plain_distance(window, back[: len(window)]) - unknown) / len(window) < 0.25:
                stop = start - place
                want.append((seq[place : place + stop] if stop >= 0 else seq[place : len(seq) + stop], 1))
                place = place + start + 25
        if place < len(seq):
            want.append((seq[place:], 0))
        assert t.segments(seq) == want
        rates = [plain_distance(seq[j : j + 14], t.adapter5) / 14 for j in range(min(101, len(seq) - 13))]
        assert t.primer(seq, t.adapter5) == (rates.index(min(rates)) if rates and min(rates) < 0.25 else None)


def test_distances_of_words_of_any_length():
    import random

    import numpy as np

    from isoweave.functions.trim import distances

    rng = random.Random(2)
    for size in (1, 5, 25, 63, 64, 70):
        a = "".join(rng.choice("ACGTN") for _ in range(size))
        for width in (0, 1, 9, 40):
            rows = ["".join(rng.choice("acgtn") for _ in range(width)) for _ in range(4)]
            codes = np.array([[ord(c) for c in r] for r in rows], np.uint8).reshape(4, width)
            assert distances(a, codes).tolist() == [plain_distance(a, r) for r in rows]


def test_many_reads_at_once_and_a_read_of_adapters_alone():
    import random
    import time

    rng = random.Random(8)
    t = Trimmer(adapter3="AAGCAGTGGTATCAACGCAGAGTAC", adapter5="ACGTTGCATTGCAC", error=0.2, least=40)
    back = t.rc3
    rows = [("none", ""), ("short", "ACGT")]
    for k in range(60):
        parts = [t.adapter5 + "".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 200))) + "A" * rng.choice((0, 9, 25)) for _ in range(rng.randrange(1, 4))]
        rows.append((f"r{k}", back.join(parts)))
    assert t.reads(rows) == [x for i, s in rows for x in t.read(i, s)]
    begun = time.time()
    t.read("adapters", back * 2000)
    assert time.time() - begun < 2


def odd_alignments(n):
    """CIGARs, MD tags that need not fit them, and reads that may be longer."""
    import random

    rng = random.Random(12)
    for _ in range(n):
        ops = [(rng.randint(1, 12), rng.choice("MMMMIDSN")) for _ in range(rng.randint(0, 7))]
        size = sum(k for k, op in ops if op != "D") + rng.choice([0, 0, 0, 2])
        md = "".join(rng.choice([str(rng.randint(0, 9)), str(rng.randint(0, 30)), rng.choice("ACGT"), "^" + "ACGT"[: rng.randint(1, 4)]]) for _ in range(rng.randint(0, 6)))
        yield "".join(f"{k}{op}" for k, op in ops), md, "".join(rng.choices("ACGTNSDIM" if rng.random() < 0.2 else "ACGT", k=max(0, size))) + rng.choice([""] * 9 + ["é"])


def test_votes_as_arrays_equal_plain_votes():
    alleles, some = Alleles(), 0
    for cigar, md, seq in odd_alignments(4000):
        expected = votes(cigar, md, seq, 5)
        got = coded_votes(cigar, md, seq, alleles)
        assert [(5 + i, alleles.names[c]) for i, c in enumerate(got)] == expected, (cigar, md, seq)
        some += bool(expected)
    assert some > 1000


def test_votes_are_summed_without_a_shuffle_of_votes(spark):
    rows = [(f"r{k % 40 if k % 3 else 7}", 0, 1 + k % 5, cigar, md, seq, float(k % 4)) for k, (cigar, md, seq) in enumerate(odd_alignments(1500))]
    a = spark.createDataFrame(rows, "rname string, flag int, pos int, cigar string, md string, seq string, weight double")
    expected = {}
    for r, _, pos, cigar, md, seq, w in rows:
        for p, allele in votes(cigar, md, seq, pos - 1):
            expected[r, p, allele] = expected.get((r, p, allele), 0.0) + w
    for held, least in ((100, 10_000), (1 << 19, 100)):  # with the second, one long read is large
        got = piled(a, least=least, share=1 << 20, held=held)
        assert {(x.id, x.pos, x.allele): x.weight for x in got.collect()} == expected and got.count() == len(expected)
    assert "hashpartitioning(id" not in piled(a)._jdf.queryExecution().executedPlan().toString()
    assert sum(x.weight for x in pile(a).collect()) == sum(expected.values())
