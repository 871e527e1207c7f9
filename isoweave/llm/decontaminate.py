"""Operator 9: benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, one for a run of words of one kind, so a question
that was asked again with other values has the same template. Template windows of documents and
benchmark items meet in a hash join; a hit counts only if, along one alignment, every slot value of the
item always went to the same value of the document. An alignment may move to near diagonals, where a
word was put in or left out. Names need a capital, so both sides are also held against each other with
their names as plain words in lower case: a copy in other case is found by those.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.llm.shared import mix64, sorted_groups, staged

#: Unit words and number words that become placeholders.
UNITS = frozenset("km m cm mm kg g mg t l ml mph mile miles foot feet inch inches meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros pound pounds cent cents percent degree degrees".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LETTERS = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)
PIECE = 1 << 18  # bytes that are looked at together
NUMBER, NAME, UNIT = 1, 2, 3
SLOTS = np.array([0, *(xxhash.xxh64_intdigest(k) for k in ("<number>", "<name>", "<unit>"))], dtype=np.uint64)

_byte = np.arange(256)
_digit = (_byte >= 48) & (_byte <= 57)
_word = _digit | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte == 95) | (_byte >= 128)
_ender = np.isin(_byte, [ord(c) for c in ".!?\n"])
_symbol = np.isin(_byte, [ord(c) for c in "%$"])


def lower(text: str) -> tuple[bytes, bytes]:
    """UTF-8 of a text and of its lower case, byte by byte alike. Currency signs count as one."""
    text = text.replace("€", "$").replace("£", "$")
    raw, low = text.encode("utf-8", "replace"), text.lower().encode("utf-8", "replace")
    if len(raw) != len(low):  # a letter whose lower case has another length stays as it is
        keep = lambda c: c.lower() if len(c.lower().encode("utf-8", "replace")) == len(c.encode("utf-8", "replace")) else c
        low = "".join(map(keep, text)).encode("utf-8", "replace")
    return raw, low


#: Ways to write a template: runs of one kind as one placeholder, each word by itself, names as plain words.
JOINED, PLAIN, FOLDED = 0, 1, 2


@dataclass
class Words:
    """The words of joined texts: codes, slot kinds, byte ranges and the text of each; which open a sentence."""

    codes: np.ndarray
    kinds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    opens: np.ndarray
    low: bytes

    def value(self, i: int) -> str:
        value = b" ".join(self.low[self.start[i] : self.end[i]].split())
        return value.decode("utf-8", "replace") if len(value) <= 256 else xxhash.xxh3_128_hexdigest(value)

    def template(self, way: int) -> Words:
        """Placeholders for codes; but for PLAIN a run of numbers or names inside a sentence is one word."""
        kind = np.where(self.kinds == NAME, 0, self.kinds) if way == FOLDED else self.kinds
        codes, start, end, text, opens = self.codes, self.start, self.end, self.text, self.opens
        if way != PLAIN and len(kind):
            first = ~(np.r_[False, (kind[1:] == kind[:-1]) & (kind[1:] > 0)] & ~opens)
            if not first.all():
                end = end[np.r_[np.flatnonzero(first)[1:], len(first)] - 1]
                start, kind, codes, text, opens = start[first], kind[first], codes[first], text[first], opens[first]
        return Words(np.where(kind > 0, SLOTS[kind], codes), kind, start, end, text, opens, self.low)


class Canon:
    """Cuts texts into words and says which are numbers, names and units, for all texts at once.

    Words are runs of letters, digits and `_`; a `.` or `,` between digits belongs to its number; `%`
    and `$` are words. A capitalised word is a name unless it opens a sentence (or its text); a unit
    counts after a number.
    """

    def __init__(self) -> None:
        self.power = self.back = np.ones(1, np.uint64)
        self.units, self.numbers = (np.sort(np.array([self._code(w) for w in words], dtype=np.uint64)) for words in (UNITS, NUMBERS))

    def _powers(self, n: int) -> None:
        if len(self.power) < n + 1:
            grow = lambda x: np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x, np.uint64)])
            self.power, self.back = grow(MULTIPLY), grow(INVERSE)

    def _hash(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._powers(len(low))
        total = np.r_[np.uint64(0), np.cumsum(LETTERS[low] * self.power[: len(low)], dtype=np.uint64)]
        return mix64((total[end] - total[start]) * self.back[start])

    def _code(self, word: str) -> np.uint64:
        low = np.frombuffer(word.encode(), np.uint8)
        return self._hash(low, np.array([0]), np.array([len(low)]))[0]

    def words(self, raw: bytes, low: bytes, ends: np.ndarray) -> Words:
        """Words of the texts that end at `ends` in the joined bytes; no word crosses an end."""
        b, lb = np.frombuffer(raw, np.uint8), np.frombuffer(low, np.uint8)
        n = len(b)
        if not n:
            none = np.zeros(0, np.int64)
            return Words(none.astype(np.uint64), none, none, none, none, none.astype(bool), low)
        digit, word = _digit[b], _word[b]
        # general and Latin-1 punctuation is made of bytes that letters have too
        for at, size in ((np.flatnonzero(b == 0xC2), 2), (np.flatnonzero((b[:-1] == 0xE2) & (b[1:] >> 1 == 0x40)), 3)):
            for k in range(size):
                word[np.minimum(at + k, n - 1)] = False
        joint = np.flatnonzero((b == 44) | (b == 46))
        joint = joint[(joint > 0) & (joint < n - 1)]
        joint = joint[digit[joint - 1] & digit[joint + 1]]
        firsts = np.r_[0, ends[:-1]]
        word[joint] = True
        symbol = _symbol[b]
        edge = np.zeros(n + 1, dtype=bool)
        edge[1:-1] = word[1:] != word[:-1]
        edge[[0, n]] = True
        edge[firsts] = True
        edge[ends] = True
        at = np.flatnonzero(symbol)
        edge[at] = edge[at + 1] = True
        cuts = np.flatnonzero(edge)
        start, end = cuts[:-1], cuts[1:]
        keep = word[start] | symbol[start]
        start, end = start[keep], end[keep]
        text = np.searchsorted(ends, start, side="right")
        code = self._hash(lb, start, end)
        ender = _ender[b]
        ender[joint] = False
        stops, other = np.r_[0, np.cumsum(ender)], np.r_[0, np.cumsum(~digit)]
        joints = np.zeros(n + 1, dtype=np.int64)
        joints[joint + 1] = 1
        other = other - np.cumsum(joints)
        new_text = np.r_[True, text[1:] != text[:-1]]
        opens = new_text | (stops[start] > np.r_[0, stops[end[:-1]]])
        find = lambda table: table[np.minimum(np.searchsorted(table, code), len(table) - 1)] == code
        number = ((other[end] == other[start]) & digit[start]) | find(self.numbers)
        after = np.r_[False, number[:-1]] & ~new_text
        unit = ~number & (symbol[start] | (find(self.units) & after))
        second = np.minimum(start + 1, n - 1)
        capital = (b[start] != lb[start]) | ((b[start] >= 0xC0) & (b[second] != lb[second]))
        name = ~number & ~unit & capital & ~opens
        kind = np.select([number, name, unit], [NUMBER, NAME, UNIT], 0)
        return Words(code, kind, start, end, text, opens, low)


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(max(0, len(codes) - size + 1), dtype=np.uint64)
    for k in range(size):
        h = h * MULTIPLY + codes[k : k + len(h)]
    return mix64(h ^ np.uint64(size))


def _pieces(texts: list[str | None], canon: Canon, ways: list[int], overlap: int) -> Iterator[tuple[int, Words, int, int, bool]]:
    """(way, its template, number of the first text, number of the first word in it, whether it goes
    on) of whole texts: short texts together, long ones in overlapping parts.

    The first word of a later part lacks what stands before it; it is there for context only.
    """
    held, first, size = [], 0, 0

    def short() -> Iterator[tuple[int, Words, int, int, bool]]:
        if held:
            found = _joined(held, canon)
            yield from ((way, found.template(way), first, 0, False) for way in ways)

    for i, text in enumerate(texts):
        pair = lower(text or "")
        if len(pair[0]) > PIECE:
            yield from short()
            for way in ways:
                yield from _parts(pair, i, canon, way, overlap)
            held, first, size = [], i + 1, 0
            continue
        held.append(pair)
        size += len(pair[0])
        if size > PIECE:
            yield from short()
            held, first, size = [], i + 1, 0
    yield from short()


def _joined(held: list[tuple[bytes, bytes]], canon: Canon) -> Words:
    return canon.words(b"".join(r for r, _ in held), b"".join(x for _, x in held), np.cumsum([len(r) for r, _ in held]))


def _parts(pair: tuple[bytes, bytes], i: int, canon: Canon, way: int, overlap: int) -> Iterator[tuple[int, Words, int, int, bool]]:
    raw, low = pair
    at = word = 0
    while True:
        size = PIECE
        while True:
            end = min(len(raw), at + size)
            while end < len(raw) and raw[end] not in b" \n\t\r":
                end += 1
            found = canon.words(raw[at:end], low[at:end], np.array([end - at])).template(way)
            if way == PLAIN or len(found.start) > overlap + 2 or end >= len(raw):
                break
            size *= 2  # a run of one kind fills the part
        yield way, found, i, word, at > 0
        if end >= len(raw):
            return
        # a part begins at a plain word: there nothing depends on what stands before
        at_word = max(0, len(found.start) - overlap - 2)
        plain = np.flatnonzero(found.kinds[: at_word + 1] == 0)
        keep = len(found.start) - (int(plain[-1]) if len(plain) and plain[-1] > 0 else at_word)
        step = int(found.start[-keep]) if 0 < keep < len(found.start) else end - at
        word += len(found.start) - (keep if step < end - at else 0)
        at += step


def benchmark_windows(benchmark: DataFrame, size: int, least: int) -> DataFrame:
    """item_id, way, h, at, n (windows of the item), size, kinds and slots for each window.

    An item with fewer than `size` template words is one window, if it has `least` or more. One that
    has `least` words only if runs of a kind aren't joined keeps them apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = _joined([lower(text or "")], canon)
                for ways in ((JOINED, PLAIN), (FOLDED,)):
                    for way in ways:
                        found = words.template(way)
                        w = min(size, len(found.codes))
                        if w >= least:
                            break
                    if w < least:
                        continue
                    h, kind, values = windows(found.codes, w), found.kinds, [found.value(i) for i in range(len(found.codes))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(h), b.schema.field(0).type), pa.array(np.full(len(h), way, dtype=np.int32)), pa.array(h.astype(np.int64)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(np.full(len(h), len(h), dtype=np.int32)), pa.array(np.full(len(h), w, dtype=np.int32)),
                         pa.array([kind[i : i + w].tolist() for i in range(len(h))], pa.list_(pa.int32())), pa.array([values[i : i + w] for i in range(len(h))], pa.list_(pa.string()))],
                        ["item_id", "way", "h", "at", "n", "size", "kinds", "slots"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, way int, h long, at int, n int, size int, kinds array<int>, slots array<string>")


def document_windows(docs: DataFrame, sizes: dict[int, list[int]], wanted: dict[int, np.ndarray] | None) -> DataFrame:
    """doc_id, way, h, doc_at and doc_slots of the windows of whole texts, of the sizes of each way.

    `wanted` (sorted, for each way) leaves out the windows that can't join; without it all are returned.
    """
    overlap = max((w for own in sizes.values() for w in own), default=1) - 1
    low_bits = np.uint64((1 << 20) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, bits = Canon(), {}
        for way, own in (wanted or {}).items():
            bits[way] = np.zeros(1 << 20, dtype=bool)
            bits[way][own & low_bits] = True
        for b in batches:
            ids = np.asarray(b.column(0))
            for way, found, first, word, goes_on in _pieces(b.column(1).to_pylist(), canon, list(sizes), overlap):
                begins = np.searchsorted(found.text, np.arange(found.text[-1] + 1)) if len(found.text) else found.text
                for w in sizes[way]:
                    h = windows(found.codes, w)
                    at = np.flatnonzero(found.text[: len(h)] == found.text[w - 1 :])[1 if goes_on else 0 :]
                    if wanted is not None:
                        own = wanted[way]
                        at = at[bits[way][h[at] & low_bits]]
                        at = at[own[np.minimum(np.searchsorted(own, h[at]), len(own) - 1)] == h[at]]
                    for k in range(0, len(at), 1 << 14):
                        x = at[k : k + (1 << 14)]
                        slots = pa.array([[found.value(j) for j in range(i, i + w)] for i in x.tolist()], pa.list_(pa.string()))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[first + found.text[x]]), pa.array(np.full(len(x), way, dtype=np.int32)), pa.array(h[x].astype(np.int64)), pa.array(x - begins[found.text[x]] + word), slots], ["doc_id", "way", "h", "doc_at", "doc_slots"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, way int, h long, doc_at long, doc_slots array<string>")


def _chain(diagonals: list[tuple[int, list[int], list[tuple]]]) -> tuple[int, bool]:
    """Most windows on an ordered chain over (shift, windows, (kind, item's value, document's value)),
    and whether values differ along it. A diagonal whose values contradict the chain adds nothing."""
    best = (0, True)
    by_size = sorted(diagonals, key=lambda d: (-len(d[1]), d[0]))
    for base in by_size:
        place, values, ats = {}, {}, []
        for shift, windows_, pairs in [base, *(d for d in by_size if d is not base)]:
            new = []
            for at in windows_:
                k = bisect_left(ats, at)
                if at not in place and (k == 0 or place[ats[k - 1]] < at + shift) and (k == len(ats) or at + shift < place[ats[k]]):
                    new.append(at)
            if not new or any(values.get((kind, own), other) != other for kind, own, other in pairs):
                continue
            place.update((at, at + shift) for at in new)
            values.update(((kind, own), other) for kind, own, other in pairs)
            ats = sorted(place)
        best = max(best, (len(ats), any(own != other for (_, own), other in values.items())), key=lambda b: (b[0], not b[1]))
    return best


def _chained(diagonals: DataFrame, coverage: float, band: int) -> DataFrame:
    """doc_id, item_id, hits, n and reworded of chains over diagonals at most 2 `band` shifts apart.

    Diagonals meet in overlapping cells of shifts, so that a group is no larger than an item allows,
    however often a document repeats it.
    """
    width = F.greatest(F.lit(1), F.least(F.lit(band), F.floor(F.col("n") / 2)))
    cell = F.floor(F.col("shift") / width)
    keys = ["doc_id", "item_id", "way", "cell"]
    dealt = diagonals.withColumn("cell", F.explode(F.array(cell, cell - 1)))
    enough = dealt.groupBy(*keys).agg(F.count("*").alias("c"), F.sum(F.size("ats")).alias("most"), F.first("n").alias("n")).where((F.col("c") > 1) & (F.col("most") >= F.col("n") * coverage)).select(*keys)
    rows = dealt.join(enough, keys).select(*keys, "shift", "n", "ats", "pairs").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, keys):
            group = [(r["shift"], r["ats"], [(x["kinds"], x["slots"], x["doc_slots"]) for x in r["pairs"]]) for r in t.select(["shift", "ats", "pairs"]).to_pylist()]
            hits, reworded = _chain(group)
            head = t.slice(0, 1)
            yield pa.RecordBatch.from_arrays([head.column("doc_id").combine_chunks(), head.column("item_id").combine_chunks(), pa.array([hits], pa.int32()), head.column("n").combine_chunks(), pa.array([reworded])], ["doc_id", "item_id", "hits", "n", "reworded"])

    return rows.mapInArrow(run, "doc_id long, item_id long, hits int, n int, reworded boolean")


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 8, least: int = 4, coverage: float = 0.5, local_index: int = 1_000_000, band: int = 16) -> DataFrame:
    """doc_id, item_id, hits, coverage, reworded for each document that holds a benchmark item.

    A document holds an item if, along one alignment, `coverage` of the item's windows of `size`
    template tokens occur in it with consistent slots; `reworded` says that slot values differ on the
    alignment that covers most. Names count by their capitals, or as plain words whatever their case.
    Where words were put in or left out an alignment goes on, in order, on diagonals up to `band`
    shifts away (half of the item's windows, if that is less).
    The benchmark's window hashes are given to the tasks that read documents, if there are at most
    `local_index` of them, to leave out other windows early; beyond that all windows are joined.

    Null and empty texts hold nothing; items below `least` tokens can't be found; long texts are
    read whole, in pieces; repeated document ids are taken as one document; null ids are left out;
    empty tables give no rows; other columns are ignored.
    """
    bench = staged(benchmark_windows(benchmark, size, least), "benchmark-windows")
    shapes = bench.groupBy("way", "size").count().orderBy("way", "size").collect()  # a few for each way
    if not shapes:
        shapes = [{"way": JOINED, "size": size}]
    sizes: dict[int, list[int]] = {}
    for r in shapes:
        sizes.setdefault(r["way"], []).append(r["size"])
    hashes = bench.select("way", "h").distinct()
    wanted = None
    if hashes.count() <= local_index:
        got = hashes.toArrow()
        way, h = np.asarray(got.column("way")), np.asarray(got.column("h")).astype(np.uint64)
        wanted = {k: np.sort(h[way == k]) if (way == k).any() else np.zeros(1, np.uint64) for k in sizes}
    hits = document_windows(docs.where("doc_id is not null"), sizes, wanted).join(bench, ["way", "h"]).distinct()
    differing = F.filter(F.arrays_zip("kinds", "slots", "doc_slots"), lambda x: x["kinds"] > 0)
    # one row for each diagonal: a second value of the document for a slot value breaks it
    diagonals = (
        hits.groupBy("doc_id", "item_id", "way", (F.col("doc_at") - F.col("at")).alias("shift"))
        .agg(F.first("n").alias("n"), F.sort_array(F.collect_set("at")).alias("ats"), F.array_distinct(F.flatten(F.collect_set(differing))).alias("pairs"))
        .where(F.size(F.array_distinct(F.transform("pairs", lambda x: F.struct(x["kinds"], x["slots"])))) == F.size("pairs"))
    )
    straight = diagonals.select("doc_id", "item_id", F.size("ats").alias("hits"), "n", F.exists("pairs", lambda x: x["slots"] != x["doc_slots"]).alias("reworded"))
    good = straight.unionByName(_chained(diagonals, coverage, band)).withColumn("coverage", F.col("hits") / F.col("n")).where(F.col("coverage") >= coverage)
    return good.groupBy("doc_id", "item_id").agg(F.max("hits").cast("int").alias("hits"), F.max("coverage").alias("coverage"), F.max_by("reworded", F.struct("coverage", ~F.col("reworded"))).alias("reworded"))
