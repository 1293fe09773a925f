"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1s and -1s, drawn from its code point. A three-gram's vector binds (multiplies)
its letters' vectors, permuted by their distance from its end; a text's vector bundles (adds) its three-grams', each
weighed by the root of its count; a language's prototype bundles the unit vectors of its training texts. A text has
the language whose prototype is nearest by cosine. Words are delimited by one blank; case and all but letters drop out.

The prototypes are fitted on at most about `fit_rows` texts of each language, picked by a 64-bit hash of the id (a
language that has rows always has some), so that what the driver gathers (partial bundles of few tasks) and sends out
(one vector a language) stays the same at every size. Scoring is one narrow pass over whole texts.

Cases: null texts and texts without letters are `und` with score 0, as are all texts when nothing can be learned; rows
with a null language, null text or null id are not learned from; rows that repeat an id are learned from once for each
language that they have, by their least text; null ids are held out; repeated rows each keep a row; of languages with
the same cosine the first by name is taken; a long text's three-grams are bundled a bounded number at a time; other
columns, whatever their names, are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_bound, kept_by_worker, slices, texts

DIM = 512
SEED = 20
GRAM = 3
UNKNOWN = "und"
#: Three-grams whose vectors a Python worker keeps (a byte a component), and those that are bundled at once.
KEPT, AT_ONCE = 50_000, 8_000


class Space:
    """Vectors of letters, three-grams and texts."""

    def __init__(self):
        # a small number for each letter met so far; 0 for what is no letter, -1 for letters not met
        self.number = np.array([-chr(c).isalpha() for c in range(0x110000)], np.int32)
        self.letters = np.array([0x20], np.int64)
        self.vectors: dict[int, np.ndarray] = {}
        self.keys, self.grams = np.zeros(0, np.int64), np.zeros((0, DIM), np.int8)
        self.room = np.zeros((AT_ONCE, DIM), np.float32)

    def letter_vector(self, c: int) -> np.ndarray:
        if c not in self.vectors:
            self.vectors[c] = np.random.default_rng((SEED, c)).choice(np.array([-1, 1], np.int8), DIM)
        return self.vectors[c]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Three-grams (code points, packed) and their counts; none without a letter."""
        c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        n = self.number[c]
        if (new := n < 0).any():
            met = np.unique(c[new])
            self.number[met] = np.arange(len(self.letters), len(self.letters) + len(met))
            self.letters = np.r_[self.letters, met]
            n = self.number[c]
        if not n.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = np.r_[np.int32(0), n, np.int32(0)]
        kept = n != 0
        n = n[np.r_[True, kept[1:] | kept[:-1]]]
        bits = 10 if len(self.letters) <= 1 << 10 else 21
        if bits == 21:
            n = n.astype(np.int64)
        found, count = np.unique(n[:-2] << 2 * bits | n[1:-1] << bits | n[2:], return_counts=True)
        a, b, c = (self.letters[found >> at & (1 << bits) - 1] for at in (2 * bits, bits, 0))
        return a << 42 | b << 21 | c, count

    def _learn(self, keys: np.ndarray) -> None:
        new = keys[self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys] if len(self.keys) else keys
        if not len(new):
            return
        if len(self.keys) + len(new) > KEPT:
            self.keys, self.grams, new = np.zeros(0, np.int64), np.zeros((0, DIM), np.int8), keys
        new = np.unique(new)
        made = np.array([np.roll(self.letter_vector(k >> 42), 2) * np.roll(self.letter_vector(k >> 21 & 0x1FFFFF), 1) * self.letter_vector(k & 0x1FFFFF) for k in new.tolist()], np.int8)
        order = np.argsort(np.r_[self.keys, new], kind="stable")
        self.keys, self.grams = np.r_[self.keys, new][order], np.r_[self.grams, made][order]

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """A unit vector for each text; zeros without a letter."""
        out = np.zeros((len(texts), DIM), np.float32)
        for row, text in zip(out, texts, strict=True):
            keys, count = self.counts(text)
            weight = np.sqrt(count).astype(np.float32)
            for at in range(0, len(keys), AT_ONCE):
                part = keys[at : at + AT_ONCE]
                self._learn(part)
                grams = self.room[: len(part)]
                grams[:] = np.take(self.grams, np.searchsorted(self.keys, part), axis=0, mode="clip")
                row += weight[at : at + AT_ONCE] @ grams
            row /= np.linalg.norm(row) or 1
        return out


def space() -> Space:
    return kept_by_worker("language space", Space)


def held_out(id_col: str, parts: int = 4, part: int = 2) -> Column:
    """Whether the crc32 of the id's text leaves that remainder; null ids do."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(True))


def fit(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 2000) -> dict[str, np.ndarray]:
    """Prototype of each language, from about fit_rows of the rows where train holds."""
    rows = df.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).withColumn("place", F.xxhash64("id"))
    bound = F.lit(None).cast("bigint")
    for lang, n, least in rows.groupBy("lang").agg(F.count("*"), F.min("place")).collect():
        bound = F.when(F.col("lang") == lang, F.lit(hash_bound(n, least, fit_rows))).otherwise(bound)
    picked = rows.where(F.col("place") <= bound).groupBy("lang", "id").agg(F.min("text").alias("text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            vectors = space().bundles(b.column(1).to_pylist())
            for lang in set(langs.tolist()):
                total[lang] = total.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = texts(picked, "lang", "text").repartition(24).mapInArrow(add, "lang string, v array<double>").collect()
    model: dict[str, np.ndarray] = {}
    for lang, v in sorted(map(tuple, parts)):
        model[lang] = model.get(lang, 0) + np.array(v)
    return {k: v / n for k, v in model.items() if (n := np.linalg.norm(v)) > 0}


def scorer(model: dict[str, np.ndarray]) -> Callable[[list], list[tuple[str, float]]]:
    """Language and cosine of each of a list of texts."""
    names = np.array([*model, UNKNOWN], dtype=object)
    protos = np.array([*model.values()], np.float32).reshape(-1, DIM)

    def score(values: list) -> list[tuple[str, float]]:
        v = space().bundles(values)
        cos = v @ protos.T if len(protos) else np.zeros((len(v), 1), np.float32)
        some = v.any(axis=1) & bool(len(protos))
        best = np.where(some, cos.argmax(axis=1), len(names) - 1)
        return list(zip(names[best].tolist(), np.where(some, np.clip(cos.max(axis=1), 0, 1), 0).astype(float).tolist(), strict=True))

    return score


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 2000) -> DataFrame:
    """id, held_out, lang_pred, score of each document, learned from the rows that are not held out."""
    model = df.sparkSession.sparkContext.broadcast(fit(df, ~held_out(id_col), id_col, text_col, lang_col, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for b in batches:
            values = b.column(2).to_pylist()
            found = [x for lo, hi in slices(values, lambda t: len(t or ""), 4_000_000) for x in score(values[lo:hi])]
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return texts(df, F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
