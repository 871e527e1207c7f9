"""Operator 10: toxicity by weak supervision.

Many lexicon and pattern voters look at a text. A generative label model estimates, by
expectation-maximisation, how often each voter fires on toxic and on clean texts and how voters
depend on each other; the given labels are one more, fallible voter. A linear classifier is then
trained on the posterior labels and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoweave.llm.shared import staged

WORD = re.compile(r"\w+")
#: Pattern voters, beside the lexicon voters that are found in the training rows.
PATTERNS = {
    "x:shout": re.compile(r"\b[A-Z]{3,}\s+[A-Z]{3,}\s+[A-Z]{3,}"),
    "x:bangs": re.compile(r"!{2,}"),
    "x:masked": re.compile(r"\b\w+[*@$#]+\w+\b"),
    "x:address": re.compile(r"\byou(?:\s+\w+){0,3}\s+(?:are|re|is)\b|\byou're\b", re.I),
    "x:suchas": re.compile(r"\bsuch\s+an?\b|\bwhat\s+an?\b", re.I),
    "x:symbols": re.compile(r"\b(?:\w+[#$%&*]{3}[\s,.]+){3}"),  # from the begin of a word, so that each is read once
}
PREFIX = 5
SPOOL = 200_000


def features(text: str) -> set[str]:
    """Distinct words, prefixes of longer words, and patterns of a whole text."""
    words = set(WORD.findall(text.lower()))
    found = {f"w:{w}" for w in words}
    found |= {f"p:{w[:PREFIX]}" for w in words if len(w) > PREFIX}
    return found | {k for k, p in PATTERNS.items() if p.search(text)}


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        at = {n: k for k, n in enumerate(self.names)}
        words, parts = {n[2:]: k for n, k in at.items() if n[0] == "w"}, {n[2:]: k for n, k in at.items() if n[0] == "p"}
        shapes = [(PATTERNS[n], k) for n, k in at.items() if n[0] == "x"]
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            t = t or ""
            seen = set(WORD.findall(t.lower()))
            hit = {words[w] for w in seen & words.keys()}
            if parts:
                hit |= {k for w in seen if len(w) > PREFIX and (k := parts.get(w[:PREFIX])) is not None}
            hit |= {k for p, k in shapes if p.search(t)}
            out[i] = self.bias + sum(self.weights[k] for k in hit)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def label_model(votes: np.ndarray, gold: np.ndarray, weight: np.ndarray | None = None, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic, and of each voter (the label last) its firing rates and its dependence.

    A voter that fires or stays silent together with others, more than the class explains, counts
    for less: its log odds are divided by one plus the sum of its clear correlations. `weight` says
    how many rows a row stands for.
    """
    of = np.ones(len(gold)) if weight is None else weight
    v = np.hstack([votes, gold[:, None]]).astype(np.float64)
    p = np.where(gold > 0, 0.95, 0.05)
    share = np.ones(v.shape[1])
    for step in range(rounds):
        prior = np.clip((of * p).sum() / of.sum(), 1e-3, 1 - 1e-3)
        on = ((of * p) @ v + 0.5) / ((of * p).sum() + 1)
        off = ((of * (1 - p)) @ v + 0.5) / ((of * (1 - p)).sum() + 1)
        if step in (rounds // 3, 2 * rounds // 3):
            mean = p[:, None] * on + (1 - p)[:, None] * off
            rest = v - mean
            size = np.sqrt(of @ rest**2 / of.sum()) + 1e-9
            tie = (rest.T @ (of[:, None] * rest)) / of.sum() / np.outer(size, size)
            np.fill_diagonal(tie, 0)
            share = 1 / (1 + np.where(tie > 0.2, tie, 0).sum(axis=1))
        odds = np.log(prior / (1 - prior)) + v @ (share * np.log(on / off)) + (1 - v) @ (share * np.log((1 - on) / (1 - off)))
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return p, np.vstack([on, off]), share


def logistic(x: np.ndarray, p: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Newton steps on the expected log likelihood of the posterior labels; a row counts `weight` times."""
    z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(z.shape[1])
    keep = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        step = np.linalg.solve((z * (weight * (q * (1 - q) + 1e-6))[:, None]).T @ z + np.diag(keep), z.T @ (weight * (p - q)) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """same, text and toxic: one document for each distinct text of `docs(doc_id, text)` that has a label.

    Digests decide which documents these are, so texts are joined once, with a table of ids that is
    written first: Spark sends it to all tasks if its size allows and shuffles otherwise. A row that
    repeats both id and text counts as often as it occurs.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text)).alias("same")
    given = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    slim = docs.where("doc_id is not null").select("doc_id", same)
    chosen = staged(slim.join(given, "doc_id").groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.max((F.col("toxic") > 0).cast("int")).alias("toxic")), "labelled-ids")
    return staged(docs.select("doc_id", text.alias("text"), same).join(chosen, ["doc_id", "same"]).select("same", "text", "toxic"), "labelled-texts")


def fit(docs: DataFrame, labels: DataFrame, rows: int = 12_000, voters: int = 192, least: int = 8, seed: int = 10) -> Model | None:
    """Learns from `docs(doc_id, text)` and `labels(doc_id, toxic)`; null labels are left out.

    Features are counted by label over all labelled rows, one for each distinct text. `voters` of
    them become lexicon voters: those with the strongest association with the labels that occur in
    `least` texts or more. Bound: the models are fitted on about `rows` rows, half of each label where
    there are enough, chosen by hash and weighted back. None if there is no labelled row.
    """
    distinct = labelled_texts(docs, labels)
    sizes = {r["toxic"]: r["count"] for r in distinct.groupBy("toxic").count().collect()}
    all_n, all_k = sum(sizes.values()), sizes.get(1, 0)
    if not all_n:
        return None
    clean, toxic = sizes.get(0, 0), all_k
    half = min(toxic, max(rows // 2, rows - clean))
    drawn = {1: half / max(toxic, 1), 0: min(1.0, (rows - half) / max(clean, 1))}
    bound = F.when(F.col("toxic") == 1, F.lit(int(drawn[1] * (1 << 20)))).otherwise(F.lit(int(drawn[0] * (1 << 20))))
    sample = distinct.where(F.pmod(F.xxhash64(F.lit(seed), "same"), F.lit(1 << 20)) < bound)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, on = Counter(), Counter()
        def flush() -> pa.RecordBatch:  # noqa: E306
            out = pa.RecordBatch.from_pydict({"f": list(n), "n": pa.array(n.values(), pa.int64()), "k": pa.array([on[f] for f in n], pa.int64())})
            n.clear()
            on.clear()
            return out
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = features(text)
                n.update(found)
                if toxic:
                    on.update(found)
                if len(n) > SPOOL:
                    yield flush()
        yield flush()

    n, k = F.col("n"), F.col("k")
    # signed root of the log-likelihood ratio between the feature's share of toxic texts and all texts' share
    share, base = (k + 0.5) / (n + 1), (all_k + 0.5) / (all_n + 1)
    gain = n * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))
    best = (
        distinct.select("text", "toxic").mapInArrow(counted, "f string, n long, k long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        .where((F.col("n") >= least) & (F.col("n") < all_n)).withColumn("gain", gain).orderBy(F.desc("gain"), "f").limit(voters).collect()
    )
    names = sorted({r["f"] for r in best} | set(PATTERNS))
    at = {f: i for i, f in enumerate(names)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [sorted(at[f] for f in features(t) & at.keys()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.list_(pa.int32())), b.column(2)], ["same", "hits", "toxic"])

    got = sorted(sample.select(F.xxhash64("same").alias("same"), "text", "toxic").mapInArrow(sparse, "same long, hits array<int>, toxic int").collect(), key=lambda r: (r["same"], r["hits"]))
    x = np.zeros((len(got), len(names)), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, r["hits"]] = 1
    gold = np.array([r["toxic"] for r in got], dtype=np.float64)
    strong = [at[r["f"]] for r in best[: voters // 4]] + [at[f] for f in PATTERNS if f not in {r["f"] for r in best[: voters // 4]}]
    weight = 1 / np.where(gold > 0, max(drawn[1], 1e-9), max(drawn[0], 1e-9))
    posterior, _, _ = label_model(x[:, strong], gold, weight)
    weights, bias = logistic(x, posterior, weight)
    return Model(names, weights, bias)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted for every row, from the whole text alone."""
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if model is None:
        return base.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def rate(docs: DataFrame, labels: DataFrame, held_out: Column, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`, after learning from the others.

    A null or empty text has the score of a text in which no voter fires; without labels all
    scores are 0. A document with several label rows counts as toxic if one says so. Long texts are
    read whole. Repeated rows get equal results, null ids match no label, an empty table gives an
    empty one, further columns are ignored.
    """
    slim = docs.select("doc_id", "text")
    model = fit(slim.where(~held_out), labels.select("doc_id", "toxic"), **bounds)
    return predict(slim, model).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted")
