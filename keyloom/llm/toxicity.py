"""Toxicity from two class-conditional Kneser-Ney models of words.

A class's model is interpolated Kneser-Ney of single words: a word counts by the number of different words that stand
before it in the class's training texts, less DISCOUNT, and what the discounts free goes to one shared distribution,
whose counts are those of the word in all documents. What neither class has seen often enough weighs alike in both, so
a rare expression's ratio is that of the classes' backoff weights. A toxic text is mostly ordinary words, so the
toxic class draws a word from the ordinary model but for a share SHARE of them, for which it draws from its own. A
text's score is the difference of its two log-likelihoods, each divided by its length in letters, and put through a
logistic that is shaped on training texts that the models were not fitted on. (Without that share the mix of languages
in the two classes decides: the README has figures, also for word pairs, which bring nothing.)

What depends on labels is fitted on at most about `fit_rows` toxic and ORDINARY times as many ordinary documents,
picked by a 64-bit hash of the id (a class that has rows always has some). The shared counts cover every word of every
document, stay distributed, and grow with the input; only the counts of words that the classes have seen more than
DISCOUNT times are fetched, so what is sent to the tasks is bounded by the fitted texts.

Cases: null and empty texts, and texts without letters, have ratio 0 and so the score that the shape gives it; rows
with a null label, text or id are not learned from; null ids are held out; without labelled rows of both classes all
scores are 0; a document with both labels counts in both classes; rows that repeat an id are learned from once, by
their least text; repeated rows each keep a row; very long words are scored but not remembered; other columns, whatever
their names, are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, hash_bound, kept_by_worker, texts
from .language_id import held_out

WORD = re.compile(r"[^\W\d_]+")
DISCOUNT = 1.5
#: Of a toxic text's words, the share that its class's own model draws.
SHARE = 0.001
#: Ordinary documents fitted for each toxic one, and one in SHAPE fitted documents shapes the logistic.
ORDINARY, SHAPE = 3, 4
#: Words that a Python worker remembers or counts at once, and letters from which a word isn't remembered.
MEMO, LONG = 500_000, 64


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Weights(dict):
    """Log-ratio and letters of whatever stands between blanks, remembered; the two come as one complex number, so
    that a text's sums are one call."""

    def __init__(self, table: dict[str, float], unseen: float):
        self.table, self.unseen = table, unseen

    def __missing__(self, key: str) -> complex:
        found = WORD.findall(key)
        value = complex(sum(self.table.get(w, self.unseen) for w in found), sum(map(len, found)))
        if len(key) < LONG:
            if len(self) >= MEMO:
                self.clear()
            self[key] = value
        return value


class Scorer:
    """Difference of the length-normalised log-likelihoods of texts."""

    def __init__(self, table: dict[str, float], unseen: float):
        self.weights = Weights(table, unseen)

    def __call__(self, values: list[str | None]) -> np.ndarray:
        get = self.weights.__getitem__
        sums = np.array([sum(map(get, (t or "").lower().split()), 0j) for t in values], np.complex128)
        return np.divide(sums.real, sums.imag, out=np.zeros(len(values)), where=sums.imag > 0)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic regression in which both classes weigh alike, held back a little so that
    separable data stay finite."""
    mean, spread = x.mean(), x.std() or 1.0
    weight = np.where(y == 1, 1 / max(y.sum(), 1), 1 / max((1 - y).sum(), 1)) * len(y) / 2
    design, w, held = np.c_[(x - mean) / spread, np.ones(len(x))], np.zeros(2), np.diag([0.01, 0.0])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + w @ held @ w / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = design.T @ (design * (weight * p * (1 - p))[:, None]) + held + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (weight * (y - p)) - held @ w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


class Model:
    """Scores of texts in a task: the words' ratios and the shape of the logistic."""

    def __init__(self, table: dict[str, float] | None, unseen: float = 0.0, noise: float = 1.0, slope: float = 0.0, offset: float = 0.0):
        self.table, self.unseen, self.noise, self.slope, self.offset = table, unseen, noise, slope, offset

    def scorer(self) -> Callable[[list], np.ndarray]:
        if self.table is None:
            return lambda values: np.zeros(len(values))
        # the model that tasks of one broadcast share tells their memo from another's
        _, ratio = kept_by_worker(("toxicity", id(self)), lambda: (self, Scorer(self.table, self.unseen)))
        return lambda values: 1 / (1 + np.exp(-np.clip(self.slope * scaled(ratio(values), self.noise) + self.offset, -30, 30)))


def scaled(ratio: np.ndarray, noise: float) -> np.ndarray:
    """Ratios on a scale on which ordinary texts lie near 0 and evidence counts by its order of size."""
    return np.log1p(np.maximum(ratio, 0) / noise)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word and n over all documents; the row of the null word has the number of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            found: Counter = Counter()
            for key, n in seen.items():
                for w in WORD.findall(key):
                    found[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([None, *found], pa.string()), pa.array([sum(found.values()), *found.values()], pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update((text or "").lower().split())
                if len(seen) > MEMO:
                    yield flush()
        yield flush()

    return texts(docs, F.col(text_col)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_counts(rows: DataFrame) -> DataFrame:
    """word, all0, all1, fit0, fit1: how many words each word follows in each class (y), in all texts and in those that
    don't shape."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set = set()
            for y, shaping, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ws = words_of(text)
                seen.update((y, shaping, v, w) for v, w in zip(["", *ws], ws, strict=False))
            cols = list(zip(*seen, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.bool_(), pa.string(), pa.string()], strict=True)], ["y", "shaping", "before", "word"])

    found = rows.select("y", "shaping", "text").mapInArrow(pairs, "y int, shaping boolean, before string, word string")
    found = found.groupBy("word", "before", "y").agg(F.min("shaping").alias("shaping"))
    return found.groupBy("word").agg(*[F.count(F.when((F.col("y") == y) & (~F.col("shaping") if part == "fit" else F.lit(True)), 1)).alias(f"{part}{y}") for part in ("all", "fit") for y in (0, 1)])


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 3000) -> Model:
    """The model from labelled rows where train holds (a condition on the id) and from all documents' words."""
    sc = docs.sparkSession.sparkContext
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).where(F.col(id_col).isNotNull() & F.col("y").isin(0, 1) & train)
    known = known.select(F.col(id_col).alias("id"), "y", F.xxhash64(F.col(id_col).cast("string")).alias("place"))
    sizes = {r[0]: r[1:] for r in known.groupBy("y").agg(F.count("*"), F.min("place")).collect()}
    if len(sizes) < 2:
        return Model(None)
    bounds = {y: hash_bound(n, least, fit_rows * (1 if y else ORDINARY)) for y, (n, least) in sizes.items()}
    picked = known.where(F.col("place") <= F.when(F.col("y") == 1, F.lit(bounds[1])).otherwise(F.lit(bounds[0]))).select("id", "y").distinct()
    # at most about fit_rows * (1 + ORDINARY) ids, whatever the size of the tables
    rows = texts(docs.where(F.col(text_col).isNotNull()), F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    shaping = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("shape")), F.lit(SHAPE)) == 0
    rows = durable(rows.groupBy("id", "y").agg(F.min("text").alias("text")).select("y", shaping.alias("shaping"), "text").repartition(24))
    counts = durable(class_counts(rows))
    parts = [f"{part}{y}" for part in ("all", "fit") for y in (0, 1)]
    sums = counts.agg(*[F.coalesce(F.sum(p), F.lit(0)).alias(p) for p in parts], *[F.coalesce(F.sum(F.least(F.col(p), F.lit(DISCOUNT))), F.lit(0.0)).alias(f"free_{p}") for p in parts]).first()
    if not all(sums[p] for p in parts):
        return Model(None)
    backoff = {p: sums[f"free_{p}"] / sums[p] for p in parts}
    # made in the JVM: rows of Python objects would start further Python workers, of which executors keep the memory
    no_word = counts.sparkSession.range(1).select(F.lit(None).cast("string").alias("word"), *[F.lit(0).cast("long").alias(p) for p in counts.columns[1:]])
    told = counts.where(" or ".join(f"{p} > {DISCOUNT}" for p in parts)).unionByName(no_word)
    everywhere = word_counts(docs, text_col).withColumnRenamed("word", "w")
    got = everywhere.join(F.broadcast(told), F.col("w").eqNullSafe(F.col("word"))).select("word", "n", *parts).toArrow()
    word, n = got.column("word").to_pylist(), got.column("n").to_numpy()
    shared = n / max(1, n[word.index(None)])

    def table(part: str) -> tuple[dict[str, float], float]:
        toxic, plain = (np.maximum(got.column(p).to_numpy() - DISCOUNT, 0) / sums[p] + backoff[p] * shared for p in (f"{part}1", f"{part}0"))
        weight = np.log1p(SHARE * (toxic / plain - 1))
        unseen = math.log1p(SHARE * (backoff[f"{part}1"] / backoff[f"{part}0"] - 1))
        return {w: x for w, x in zip(word, weight.tolist(), strict=True) if w is not None}, unseen

    bare = sc.broadcast(table("fit"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = Scorer(*bare.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ratio(b.column(1).to_pylist()))], ["y", "s"])

    shape = rows.where("shaping").select("y", "text").mapInArrow(measure, "y int, s double").toArrow()
    bare.unpersist()
    y, ratio = shape.column(0).to_numpy(), shape.column(1).to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(None)
    noise = float(np.quantile(np.abs(ratio[y == 0]), 0.9)) or 1e-9
    # the shape found, the models take all fitted documents
    return Model(*table("all"), noise, *logistic(scaled(ratio, noise), y))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 3000, threshold: float = 0.7) -> DataFrame:
    """id, held_out, score, predicted of each document; learned from labelled rows that are not held out."""
    held = held_out(id_col, 3, 1)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, ~held, id_col, text_col, label_col, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.scorer()
        for b in batches:
            found = score(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts(docs, F.col(id_col), held.alias("held_out"), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
