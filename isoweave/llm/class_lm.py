"""Operator 6: a Brown class-based bigram language model.

Exchange clustering assigns words to classes; a text's probability is the product of class
transitions and word emissions. Words are counted over all training rows. The units that are
exchanged are the most frequent words, one by one, and all other words in groups of equal endings,
so that every word, however rare or new, has a class that was learned from all training rows.
Frequent words outside the first list then leave their group for the class that fits their own
left neighbours best. Emissions depend on each word's own count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoweave.llm.shared import staged, utf8

END = b"\n"  # no word holds white space
SPOOL = 400_000
PIECE = 1 << 22


ENDING = 3


def ending(word: bytes, groups: int) -> int:
    """Group of a word that is no unit of its own, by its last bytes."""
    return crc32(word[-ENDING:]) % groups


def words(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the words of a whole text, in order; A-Z lower-cased, the end mark last.

    bytes.lower() changes A-Z alone and bytes.split() cuts at 0x20 and 0x09 to 0x0D alone.
    """
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and text[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        yield text[at:cut].lower().split()
        at = cut
    yield [*text[at:].lower().split(), END]


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary) and c over all rows of `texts(text binary)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(n.values(), pa.int64())], ["word", "c"])
        for b in batches:
            for text in b.column(0).to_pylist():
                for part in words(text):
                    n.update(part)
                if len(n) > SPOOL:
                    yield out()
                    n.clear()
        yield out()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def coder(known: dict[bytes, int], groups: list[int]):
    """Codes of a list of words: their own, or that of the group of their ending."""
    n = len(groups)

    def code(part: list[bytes]) -> np.ndarray:
        got = np.fromiter(map(known.get, part, repeat(-1)), dtype=np.int64, count=len(part))
        for i in np.flatnonzero(got < 0).tolist():
            got[i] = groups[crc32(part[i][-ENDING:]) % n]
        return got

    return code


def pair_counts(texts: DataFrame, left: dict[bytes, int], right: dict[bytes, int], groups_left: list[int], groups_right: list[int], end: int, lefts: int, rights: int) -> np.ndarray:
    """Matrix of neighbours over all texts, by the codes of the first and the second word.

    Words without a code of their own have that of their ending's group. The end mark, `end` on the
    left, also stands before the first word. Each task adds up its own matrix before it is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(lefts * rights, dtype=np.int64)
        held, size = [], 0
        code_left, code_right = coder(left, groups_left), coder(right, groups_right)

        def add() -> None:
            nonlocal total
            if held:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                before = end
                for part in words(text):
                    if not part:
                        continue
                    two = code_right(part)
                    one = two if left is right else code_left(part)
                    held.append(np.concatenate([[before], one[:-1]]) * rights + two)
                    before, size = one[-1], size + len(part)
                if size > 1 << 20:
                    add()
                    size = 0
        add()
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["at", "n"])

    got = texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(lefts * rights, dtype=np.int64)
    out[np.asarray(got.column("at"))] = np.asarray(got.column("n"))
    return out.reshape(lefts, rights)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Class of each word: words move, one after the other, to where the likelihood is highest.

    The last row, the end mark, keeps a class of its own.
    """
    k = len(bigrams) - 1
    label = np.r_[np.arange(k) % classes, classes]
    b = bigrams.astype(np.float64)
    member = np.zeros((k + 1, classes + 1))
    member[np.arange(k + 1), label] = 1
    t = member.T @ b @ member
    for _ in range(sweeps):
        moved = 0
        for w in range(k):
            a, own = label[w], b[w, w]
            out = np.bincount(label, weights=b[w], minlength=classes + 1)
            into = np.bincount(label, weights=b[:, w], minlength=classes + 1)
            out[a] -= own
            into[a] -= own
            t[a] -= out
            t[:, a] -= into
            t[a, a] -= own
            rows, cols = t.sum(axis=1), t.sum(axis=0)
            c = np.arange(classes)
            gain = (_f(t[c] + out) - _f(t[c])).sum(axis=1) + (_f(t[:, c] + into[:, None]) - _f(t[:, c])).sum(axis=0)
            d = t[c, c]
            gain += _f(d + out[c] + into[c] + own) - _f(d + out[c]) - _f(d + into[c]) + _f(d)
            gain -= _f(rows[c] + out.sum() + own) - _f(rows[c]) + _f(cols[c] + into.sum() + own) - _f(cols[c])
            best = int(gain.argmax())
            if gain[best] <= gain[a] + 1e-9:
                best = a
            moved += best != a
            label[w] = best
            t[best] += out
            t[:, best] += into
            t[best, best] += own
        if not moved:
            break
    return label


def score(docs: DataFrame, held_out: Column, classes: int = 48, clustered: int = 1000, groups: int = 256, classed: int = 16_000, head: int = 50_000, smooth: float = 0.1) -> DataFrame:
    """Scores every whole text of `docs(doc_id, text)` after learning from those not held out.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigram) and
    score (class model), both log10 probabilities, and perplexity by token. Tables of bounded size
    go to the driver and to all tasks: the `head` most frequent words with their counts, and the
    neighbour matrix of the units that exchange clustering sorts into `classes`, which are the
    `clustered` most frequent words and `groups` groups of all others by their endings. The `classed`
    most frequent words move to the class that fits their left neighbours best. All counts are over
    all training rows; words outside the head are joined with their counts, and none of them makes
    up more than one in `head` of all training tokens.

    Each class keeps room for one word that no training row has. Null and empty texts are the end
    mark alone; long texts are read whole, in pieces; repeated rows are rows of their own; without a
    training row every count is 0. Other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", held_out.alias("held_out"), utf8("text").alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    counts = staged(word_counts(train), "word-counts")
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))).first()
    top = [(bytes(r["word"]), r["c"]) for r in counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(head).collect()]
    if ends:
        top.append((END, ends))  # whatever its rank
    known = dict(top)
    order = [w for w, _ in top if w != END]

    small = order[:clustered]
    units = len(small) + groups
    code = {w: i for i, w in enumerate(small)} | {END: units}
    own_groups = list(range(len(small), units))
    bigrams = pair_counts(train, code, code, own_groups, own_groups, units, units + 1, units + 1)
    classes = max(1, min(classes, units))
    label = exchange(bigrams, classes)
    end = classes
    group = {w: int(label[i]) for w, i in code.items()}
    of_ending = [int(label[i]) for i in own_groups]
    more = order[len(small) : classed]
    if more:
        place = {w: i for i, w in enumerate(more)} | {END: len(more)} | dict.fromkeys(small, len(more))
        left = pair_counts(train, group, place, of_ending, [len(more)] * groups, end, classes + 1, len(more) + 1)
        member = np.zeros((len(label), classes + 1))
        member[np.arange(len(label)), label] = 1
        given = member.T @ bigrams @ member + 0.5
        follow = np.log(given / given.sum(axis=1, keepdims=True))[:, :classes] - np.log(given.sum(axis=0) / given.sum())[None, :classes]
        nearest = (left[:, : len(more)].T @ follow).argmax(axis=1)
        group |= {w: int(nearest[i]) for i, w in enumerate(more)}
    links = pair_counts(train, group, group, of_ending, of_ending, end, classes + 1, classes + 1).astype(np.float64)

    # counts and numbers of the words of each class; those outside the table of classes by their endings
    size, mass = np.ones(classes + 1), np.zeros(classes + 1)
    for w, g in group.items():
        size[g] += w != END
        mass[g] += known.get(w, 0)
    tail = F.crc32(F.substring("word", -ENDING, ENDING)) % groups
    for r in counts.groupBy(tail.alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # one row for each group
        size[of_ending[r["g"]]] += r["n"]
        mass[of_ending[r["g"]]] += r["c"]
    for w in group:  # they were counted with their ending too
        if w in known:
            size[of_ending[ending(w, groups)]] -= 1
            mass[of_ending[ending(w, groups)]] -= known[w]
    step = np.log10((links + smooth) / (links + smooth).sum(axis=1, keepdims=True))
    total = np.log10(np.maximum(mass + smooth * size, 1e-300))
    # log10 of count plus smoothing
    ids = {w: i for i, (w, _) in enumerate(top)}
    log_count = np.log10(np.array([c for _, c in top] + [1]) + smooth)
    of = np.array([group[w] if w in group else of_ending[ending(w, groups)] for w, _ in top] + [0], dtype=np.int64)
    log_emit = log_count - total[of]
    if END in ids:
        log_emit[ids[END]] = 0.0  # the end mark is the only word of its class
    base_total = float(np.log10(n + smooth * (v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId() << 40, 0
        none, by_ending = len(ids), np.array(of_ending)
        for b in batches:
            out: dict[str, list] = {x: [] for x in ("row", "n_tokens", "head_known", "head_base", "head_score", "words", "times")}
            for text in b.column(2).to_pylist():
                tokens = in_head = 0
                base = model = 0.0
                before, tail = end, Counter()
                for words_ in words(text):
                    if not words_:
                        continue
                    at = np.fromiter(map(ids.get, words_, repeat(none)), dtype=np.int64, count=len(words_))
                    c = of[at]
                    inside = at < none
                    new = np.flatnonzero(~inside)
                    if len(new):
                        rare = [words_[i] for i in new.tolist()]
                        c[new] = by_ending[[crc32(w[-ENDING:]) % groups for w in rare]]
                        if rare[-1] == END:
                            c[new[-1]] = end
                        model -= total[c[new]].sum()
                        tail.update(rare)
                    model += step[np.r_[before, c[:-1]], c].sum() + log_emit[at[inside]].sum()
                    base += log_count[at[inside]].sum()
                    tokens += len(words_)
                    in_head += int(inside.sum())
                    before = c[-1]
                if tail.pop(END, 0):  # only where no training row exists
                    base += np.log10(smooth)
                    model += total[end]
                for name, x in zip(out, (part + k, tokens, in_head, base, model, list(tail), list(tail.values()))):
                    out[name].append(x)
                k += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(out.values(), kinds))], ["doc_id", "held_out", *out])

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = staged(rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, row long, n_tokens long, head_known long, head_base double, head_score double, words array<binary>, times array<long>"), "lm-rows")
    tail = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times")).join(counts, "word", "left")
    summed = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("tail_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(smooth))).alias("tail_base"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    full = parts.drop("words", "times").join(summed, "row", "left")
    scored = full.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + zero("tail_known")).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("tail_base") - F.col("n_tokens") * F.lit(base_total)).alias("base_score"),
        (F.col("head_score") + zero("tail_base")).alias("score"))
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
