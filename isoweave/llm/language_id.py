"""Operator 3: language ID with string kernels.

The kernel of two texts is the cosine of their blended-spectrum presence sets: all distinct
character n-grams of length 1 to 3, in lower case, with one symbol for all that is no letter. Landmark texts give a Nystroem
feature map; one ridge regression for each language against the rest is fitted in it. Kernel and
regression are linear in the landmarks' n-grams, so scoring is one matrix product for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
CHUNK = 1 << 20
#: N-grams of the landmarks that are multiplied at once.
BLOCK = 1 << 14
BITS = np.uint64(21)  # a code point and the symbol of all non-letters fit
LETTER = regex.compile(r"\p{L}")
LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters, made once in a process."""
    if not LETTERS:
        LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return LETTERS[0]


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def spectrum(text: str) -> np.ndarray:
    """Sorted distinct n-grams of a whole text: every letter is a symbol of its own, all else is one symbol."""
    parts = []
    for at in range(0, max(1, len(text)), CHUNK):
        code = np.frombuffer(text[at : at + CHUNK + ORDERS[-1] - 1].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        s = np.where(letters()[np.minimum(code, 0x10FFFF)], code + np.uint32(2), np.uint32(1)).astype(np.uint64)
        gram, found = s, [distinct(s)]
        for n in ORDERS[1:]:
            if len(s) < n:
                break
            gram = (gram[:-1] << BITS) | s[n - 1 :]
            found.append(distinct(gram))
        parts.append(np.concatenate(found))
    return parts[0] if len(parts) == 1 else distinct(np.concatenate(parts))


def known(text: str, keep: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of a text's n-grams among `keep`, and the number of its distinct n-grams."""
    ids = spectrum(text)
    at = np.minimum(np.searchsorted(keep, ids), len(keep) - 1)
    return at[keep[at] == ids], len(ids)


def presence(texts: list[str | None], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Presence of the `keep` n-grams by text, and each text's number of distinct n-grams."""
    out, sizes = np.zeros((len(texts), len(keep)), dtype=np.float32), np.zeros(len(texts))
    for k, t in enumerate(texts):
        if t:
            at, sizes[k] = known(t, keep)
            out[k, at] = 1
    return out, sizes


@dataclass
class Model:
    langs: list[str]
    keep: np.ndarray
    weights: np.ndarray  # by n-gram and language

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x, sizes = presence(texts, self.keep)
        return (x @ self.weights) / np.sqrt(np.maximum(sizes, 1))[:, None]


def _drawn(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.length("text"))


def _sample(train: DataFrame, counts: dict[str, tuple[int, dict[int, int]]], each: int, seed: int) -> DataFrame:
    """About `each` rows for each language, chosen by a hash of id and text length alone.

    The row with the smallest hash of a language always belongs to them. Rows with one hash, as repeated
    rows have, count once.
    """
    by_lang = lambda values: F.element_at(F.create_map(*[F.lit(v) for pair in values for v in pair]), F.col("lang"))
    share = by_lang([(k, float(min(1.0, 1.2 * each / n))) for k, (n, _) in counts.items()])
    least = by_lang([(k, first[seed]) for k, (_, first) in counts.items()])
    rows = train.withColumn("_h", _drawn(seed))
    draw = F.pmod("_h", F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.where((draw < share) | (F.col("_h") == least)).groupBy("lang", "_h").agg(F.min("text").alias("text"))


def fit(train: DataFrame, landmarks: int = 48, rows: int = 1500, ridge: float = 1e-3, seed: int = 3) -> Model | None:
    """Learns from `train(doc_id, text, lang)`; rows without text or lang are left out.

    Bounds: about `landmarks` landmark texts and about `rows` training texts for each language,
    both chosen by hash. Returns None when nothing can be learned from.
    """
    train = train.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counted = train.groupBy("lang").agg(F.count("*").alias("n"), *[F.min(_drawn(x)).alias(f"first{x}") for x in (seed, seed + 1)]).collect()  # one row for each language
    counts = {r["lang"]: (r["n"], {x: r[f"first{x}"] for x in (seed, seed + 1)}) for r in counted}
    if not counts:
        return None
    langs = sorted(counts)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict({"lang": [lang], "ids": pa.array([spectrum(text).astype(np.int64)], pa.list_(pa.int64()))})

    marks = _sample(train, counts, landmarks, seed)
    found = sorted(marks.select("text", "lang").mapInArrow(grams, "lang string, ids array<long>").collect(), key=lambda r: (r["lang"], r["ids"]))
    if not found:
        return None
    keep = np.unique(np.concatenate([np.asarray(r["ids"], dtype=np.uint64) for r in found]))
    held = np.zeros((len(keep), len(found)), dtype=np.uint8)  # which landmark has which n-gram
    for k, r in enumerate(found):
        held[np.searchsorted(keep, np.asarray(r["ids"], dtype=np.uint64)), k] = 1
    blocks = [slice(x, x + BLOCK) for x in range(0, len(keep), BLOCK)]
    common = sum(held[x].astype(np.float32).T @ held[x].astype(np.float32) for x in blocks).astype(np.float64)
    length = np.sqrt(np.diag(common))
    value, vector = np.linalg.eigh(common / np.outer(length, length))
    large = value > 1e-6 * value.max()
    project = vector[:, large] / np.sqrt(value[large]) / length[:, None]  # common n-grams with each landmark to Nystroem features

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = project.shape[1]
        total = np.zeros((d, d + len(langs)))
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                z = np.empty((part.num_rows, d))
                for k, text in enumerate(part.column(0).to_pylist()):
                    at_, size = known(text, keep)
                    z[k] = held[at_].sum(axis=0, dtype=np.int64) @ project / np.sqrt(max(size, 1))
                y = np.array([[lang == k for k in langs] for lang in part.column(1).to_pylist()], dtype=np.float64)
                total += z.T @ np.hstack([z, y])
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    parts = _sample(train, counts, rows, seed + 1).select("text", "lang").repartition(8).mapInArrow(sums, "total binary").collect()
    d = project.shape[1]
    total = sum(np.frombuffer(r["total"]).reshape(d, d + len(langs)) for r in parts)
    gram, aim = total[:, :d], total[:, d:]
    solved = np.linalg.solve(gram + ridge * np.trace(gram) / d * np.eye(d), aim)
    return Model(langs, keep, np.concatenate([held[x].astype(np.float64) @ (project @ solved) for x in blocks]).astype(np.float32))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred (`und` for null or letterless texts) and score in 0 to 1, from `text` alone.

    Any further columns stay; columns of these two names are replaced (mask them to keep them). Equal scores go to the
    language that sorts first.
    """
    base = docs.drop("lang_pred", "score")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in base.schema.fields)}"
    if model is None:
        return base.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    at = base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                b = whole.slice(start, 64)
                texts = b.column(at).to_pylist()
                s = model.scores(texts)
                best = s.argmax(axis=1)
                known = np.array([bool(t and LETTER.search(t)) for t in texts])
                pred = [model.langs[k] if ok else "und" for k, ok in zip(best, known)]
                score = np.where(known, np.clip(s[np.arange(len(s)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, held_out: Column, **bounds: int) -> DataFrame:
    """Learns from the rows of `docs` that are not held out and predicts every row from its text.

    Null, empty and letterless texts are `und` with score 0; very long texts are read whole, in
    pieces; repeated rows get equal results; on an empty table or without a labelled row nothing
    is learned and all is `und`. A null lang is never learned from.
    """
    return predict(docs.withColumn("held_out", held_out), fit(docs.where(~held_out), **bounds))
