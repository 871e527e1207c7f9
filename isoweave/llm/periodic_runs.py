"""Operator 13: runs of periodically repeated words, by internal pattern matching.

A run of period q and length 4q or more contains a block of 2^k words, q <= 2^k < 2q, that begins
at a multiple of 2^k and occurs again q words behind or before. So every dyadic block asks for its
next and its last occurrence in the windows of one block length beside it: a range successor and
predecessor over its interval of the suffix array, answered by a wavelet tree. Occurrences of a
block in such a window are one arithmetic progression, so the nearest one is its difference and the
only candidate period. Candidates are extended to maximal runs by the block classes of the suffix
sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that one call orders together; a longer text is a call of its own.
CALL_WORDS = 1 << 18


def block_classes(codes: np.ndarray, longest: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Classes of the blocks of 2^k words at every position, for k = 0, 1, ... while 2^k <= longest.

    The class of a block is the number of suffixes that sort before all suffixes that begin with it,
    so it's also the begin of the block's interval in the suffix array; the second list has the
    interval's length. The suffix array comes last; suffixes that agree in the longest blocks are in
    text order. Only positions whose class has others in it are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    sorted_codes = codes[order]
    first = np.r_[True, sorted_codes[1:] != sorted_codes[:-1]]
    starts = np.flatnonzero(first)
    lengths = np.diff(np.r_[starts, n])
    rank, count = np.empty(n, np.int32), np.empty(n, np.int32)
    rank[order] = np.repeat(starts, lengths)
    count[order] = np.repeat(lengths, lengths)
    ranks, counts = [rank], [count]
    width = 1
    while 2 * width <= longest:
        open_ = np.flatnonzero(count[order] > 1)  # places of the suffix array that are not settled
        if not len(open_):
            break
        at = order[open_]
        behind = np.full(len(at), -1, np.int64)
        inside = at + width < n
        behind[inside] = rank[at[inside] + width]
        key = rank[at].astype(np.int64) * (n + 1) + behind + 1
        turn = np.argsort(key, kind="stable")
        key, at = key[turn], at[turn]
        order[open_] = at
        fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[fresh, len(key)])
        rank, count = rank.copy(), count.copy()
        rank[at] = np.repeat(open_[fresh], sizes)
        count[at] = np.repeat(sizes, sizes)
        ranks.append(rank)
        counts.append(count)
        width *= 2
    return ranks, counts, order


class WaveletTree:
    """Bits of the values of a sequence, from the highest, each level with zeros before ones."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []  # ones before each place, and the number of zeros
        now = values.astype(np.int32)
        for bit in range(self.bits - 1, -1, -1):
            ones = (now >> bit) & 1
            before = np.zeros(len(now) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((before, len(now) - int(before[-1])))
            now = np.concatenate([now[ones == 0], now[ones == 1]])

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of sequence[left:right] are smaller than the bound."""
        left, right = left.astype(np.int64), right.astype(np.int64)
        total = np.zeros(len(left), np.int64)
        for k, (before, zeros) in enumerate(self.levels):
            one = ((bound >> (self.bits - 1 - k)) & 1).astype(bool)
            l1, r1 = before[left], before[right]
            total += np.where(one, (right - r1) - (left - l1), 0)
            left, right = np.where(one, zeros + l1, left - l1), np.where(one, zeros + r1, right - r1)
        return total

    def smallest(self, left: np.ndarray, right: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth smallest (from 0) value of sequence[left:right]."""
        left, right, nth = left.astype(np.int64), right.astype(np.int64), nth.astype(np.int64)
        value = np.zeros(len(left), np.int64)
        for before, zeros in self.levels:
            l1, r1 = before[left], before[right]
            none = (right - r1) - (left - l1)
            one = nth >= none
            nth = np.where(one, nth - none, nth)
            value = 2 * value + one
            left, right = np.where(one, zeros + l1, left - l1), np.where(one, zeros + r1, right - r1)
        return value


def agreement(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from each a and b on (or before them, if `back`); a < b."""
    n = len(ranks[0])
    done = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        width, rank = 1 << k, ranks[k]
        going = np.arange(len(a))
        while len(going):
            x, y = (a[going] - done[going] - width, b[going] - done[going] - width) if back else (a[going] + done[going], b[going] + done[going])
            fits = (x >= 0) & (y + width <= n)
            going, x, y = going[fits], x[fits], y[fits]
            going = going[rank[x] == rank[y]]
            done[going] += width
            if k < len(ranks) - 1:
                break
    return done


def find_runs(words: np.ndarray, lengths: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of several texts at once: text number, start, length and period, sorted by text, start, period.

    `words` has the word codes of all texts one after the other, `lengths` the number of words of
    each. A run has max(least, times * period) words or more; `times` must be 4 or more.
    """
    if times < 4:
        raise ValueError("blocks of a run are only sure to occur again from four periods on")
    empty = np.zeros(0, np.int64)
    n_texts, n = len(lengths), int(lengths.sum())
    if not n or lengths.max(initial=0) < least:
        return empty, empty, empty, empty
    # Words of two texts are never equal, and neither is a mark behind each text.
    text = np.repeat(np.arange(n_texts), lengths)
    place = np.arange(n) + text
    codes = np.empty(n + n_texts, np.int64)
    wide = int(words.max()) + 2
    codes[place] = text * wide + words + 1
    codes[np.cumsum(lengths) + np.arange(n_texts)] = np.arange(n_texts) * wide
    ranks, counts, order = block_classes(codes, int(lengths.max()) // 2)
    begins = np.r_[0, np.cumsum(lengths + 1)]
    # A block can only occur again within its length if its first word does.
    by_word = np.argsort(codes, kind="stable")
    gap = np.diff(by_word)
    same = codes[by_word[1:]] == codes[by_word[:-1]]
    ahead, behind = np.full(len(codes), len(codes)), np.full(len(codes), len(codes))
    ahead[by_word[:-1][same]] = gap[same]
    behind[by_word[1:][same]] = gap[same]
    nearest = np.minimum(ahead, behind)
    starts, lefts, rights, widths = [], [], [], []
    local = np.arange(len(codes)) - np.repeat(begins[:-1], lengths + 1)
    for k, (rank, count) in enumerate(zip(ranks, counts)):
        asked = np.flatnonzero(((local & ((1 << k) - 1)) == 0) & (count > 1) & (nearest <= (1 << k)))
        starts.append(asked)
        lefts.append(rank[asked])
        rights.append(rank[asked] + count[asked])
        widths.append(np.full(len(asked), 1 << k))
    start, left, right, width = map(np.concatenate, (starts, lefts, rights, widths))
    if not len(start):
        return empty, empty, empty, empty
    tree = WaveletTree(order)
    smaller = tree.below(left, right, start)
    found = []
    has = np.flatnonzero(smaller + 1 < right - left)  # the block itself is the value at `smaller`
    after = tree.smallest(left[has], right[has], smaller[has] + 1)
    near = after - start[has] <= width[has]
    found.append((start[has][near], after[near]))
    has = np.flatnonzero(smaller > 0)
    before = tree.smallest(left[has], right[has], smaller[has] - 1)
    near = start[has] - before <= width[has]
    found.append((before[near], start[has][near]))
    a, b = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    period = b - a
    first = a - agreement(ranks, a, b, back=True)
    size = b + agreement(ranks, a, b, back=False) - first
    good = size >= np.maximum(least, times * period)
    runs = np.unique(np.stack([first[good], period[good], size[good]]), axis=1)
    of = np.searchsorted(begins, runs[0], "right") - 1
    return of, runs[0] - begins[of], runs[2], runs[1]


def word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts, and the number of words of each."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    flat = pa.array([w for t in texts for w in t], pa.binary())
    return np.asarray(flat.dictionary_encode().indices, dtype=np.int64), lengths


def stretched(n: int, h: int) -> np.ndarray | None:
    """For a text of n words and the hash h of its id: which original word stands at each place; None: its own."""
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """True for words that no run contains behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) == 0


def strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    best = 0
    for k in range(1, len(start)):
        more = int(length[k]) * int(period[best]) - int(length[best]) * int(period[k])
        if more > 0 or (more == 0 and (start[k], period[k]) < (start[best], period[best])):
            best = k
    return best


def calls(rows: Iterator[tuple[int | None, str | None, int]], most: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Ids and words of texts, in lists of about `most` words; a hash that asks for it repeats words."""
    held: list[tuple[int | None, list[bytes]]] = []
    total = 0
    for key, text, h in rows:
        words = (text or "").encode().split()  # of bytes: exactly at 0x20 and 0x09 to 0x0D
        picked = stretched(len(words), h)
        if picked is not None:
            words = [words[i] for i in picked.tolist()]
        if held and total + len(words) > most:
            yield held
            held, total = [], 0
        held.append((key, words))
        total += len(words)
    if held:
        yield held


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def detect(docs: DataFrame, repeat_by: Column | None = None, least: int = 6, times: int = 4, spans: bool = False) -> DataFrame:
    """Runs of every text of `docs(doc_id, text)`: a run has max(least, times * period) words or more.

    One row for each document: doc_id, n_runs, the strongest run (start, length, period,
    exponent_milli; nulls without a run) and SHA-256 digests of all runs and of the text without
    repeated words. With `spans`, columns `runs` (array of start, length, period) and `collapsed` (the
    text without repeated words) come too. `repeat_by` is a hash column by which some texts are
    made periodic first. Null and empty texts have no words and no run; repeated rows and null ids have
    a row each; long texts are read whole; further columns are ignored; an empty table gives an empty
    one. Texts are read where they lie: nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(1) if repeat_by is None else repeat_by).cast("long").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (b.slice(at, 16) for b in batches for at in range(0, b.num_rows, 16))
        lines = (row for b in pieces for row in zip(*[c.to_pylist() for c in b.columns]))
        for held in calls(lines, CALL_WORDS):
            codes, lengths = word_ids([w for _, w in held])
            of, start, length, period = find_runs(codes, lengths, least, times)
            cuts = np.searchsorted(of, np.arange(len(held) + 1))
            out: dict[str, list] = {name: [] for name in names}
            for (key, words), a, b in zip(held, cuts[:-1], cuts[1:]):
                s, m, q = start[a:b], length[a:b], period[a:b]
                told = list(zip(s.tolist(), m.tolist(), q.tolist()))
                top = told[strongest(s, m, q)] if told else (None, None, None)
                keep = kept_words(len(words), s, m, q) if told else None
                short = b" ".join(words if keep is None else [words[i] for i in np.flatnonzero(keep).tolist()])
                values = [key, len(told), *top, 1000 * top[1] // top[2] if told else None, hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in told).encode()).hexdigest(), hashlib.sha256(short).hexdigest()]
                if spans:
                    values += [[{"start": x, "length": y, "period": z} for x, y, z in told], short.decode()]
                for name, v in zip(names, values):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    result = RESULT + (", runs array<struct<start: long, length: long, period: long>>, collapsed string" if spans else "")
    names = [c.split()[0] for c in RESULT.split(", ")] + (["runs", "collapsed"] if spans else [])
    run_kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    kinds = pa.schema([(n, pa.string() if n in ("runs_sha256", "collapsed_sha256", "collapsed") else run_kind if n == "runs" else pa.int64()) for n in names])
    return rows.mapInArrow(run, result)
