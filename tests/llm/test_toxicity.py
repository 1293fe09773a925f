import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from keyloom.llm import toxicity as X

DIR = "/root/testdata/sf0.1"


class Slow:
    """A class's model, written out."""

    def __init__(self, class_texts, everything):
        pairs = {(v, w) for t in class_texts for ws in [X.words_of(t)] for v, w in zip(["", *ws], ws)}
        self.n = Counter(w for _, w in pairs)
        self.all = Counter(w for t in everything for w in X.words_of(t))
        self.free = sum(min(n, X.DISCOUNT) for n in self.n.values())

    def p(self, w):
        return (max(self.n[w] - X.DISCOUNT, 0) + self.free * self.all[w] / sum(self.all.values())) / sum(self.n.values())


def test_model_matches_the_definition(spark):
    rng = np.random.default_rng(1)
    usual, bad = [f"w{chr(97 + i)}" for i in range(20)], ["scum", "clown"]
    said = lambda more: " ".join(rng.permutation([*rng.choice(usual, 30), *rng.choice(bad, more)]))
    docs = [(i, said(4 * (i % 2))) for i in range(80)] + [(i, said(0) + f" rare{chr(97 + i % 9)}, x") for i in range(80, 100)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = X.fit(d, y, X.F.lit(True))
    toxic, plain = (Slow([t for i, t in docs if i < 80 and i % 2 == k], [t for _, t in docs]) for k in (1, 0))
    get = X.Scorer(model.table, model.unseen)
    for _, t in docs:
        ws = X.words_of(t)
        ratio = sum(math.log((1 - X.SHARE) * plain.p(w) + X.SHARE * toxic.p(w)) - math.log(plain.p(w)) for w in ws) / sum(map(len, ws))
        assert math.isclose(get([t])[0], ratio, rel_tol=1e-6, abs_tol=1e-12)
    score = model.scorer()([t for _, t in docs])
    want = 1 / (1 + np.exp(-np.clip(model.slope * np.log1p(np.maximum(get([t for _, t in docs]), 0) / model.noise) + model.offset, -30, 30)))
    assert np.allclose(score, want) and model.slope > 0


def test_shared_counts_cover_and_grow(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    slow = Counter(w for r in docs.collect() for w in X.words_of(r.text))
    got = {r.word: r.n for r in X.word_counts(docs).collect()}
    assert got.pop(None) == sum(slow.values()) and got == slow
    half = X.word_counts(docs.where("doc_id % 2 = 0")).count()
    assert half < len(got)


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = X.toxicity(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.toxic is not None]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    tp = sum(r.predicted and r.toxic for r in held)
    precision, recall = tp / sum(r.predicted for r in held), tp / sum(r.toxic for r in held)
    print("held out", len(held), "precision", precision, "recall", recall)
    # 300 toxic rows to learn four languages' expressions from
    assert precision > 0.8 and recall > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_cases(spark):
    docs = [(i, "you are an idiot and scum my friend" if i % 2 else "the day is fine and warm my friend", 0.1) for i in range(60)]
    docs += [(100, None, 0.1), (101, "", 0.1), (None, "idiot", 0.1), (102, "% 1", 0.1), (103, "fine day " * 40_000, 0.1), (104, "x" * 300_000, 0.1), (1, docs[1][1], 0.1)]
    # word order differs, so that words follow several others
    docs = [(i, None if t is None else " ".join(sorted(t.split(), key=lambda w: zlib.crc32(f"{i}{w}".encode()))) if i is not None and i < 60 else t, s) for i, t, s in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    y = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (100, 1), (999, 0)], "doc_id long, toxic int")
    got = defaultdict(list)
    for r in X.toxicity(d, y).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(docs) and len(got[1]) == 2
    assert got[100][0].score == got[101][0].score == got[102][0].score
    assert got[1][0].score > 0.7 > got[2][0].score
    assert {r.score for r in X.toxicity(d, y.where("toxic = 1")).collect()} == {0.0}
    assert X.toxicity(d.limit(0), y).count() == 0 and X.toxicity(d, y.limit(0)).count() == len(docs)


def test_fit_starts_no_further_workers(spark, monkeypatch):
    """Rows of Python objects go through workers of their own, which stay beside those that score."""
    docs = spark.createDataFrame([(i, "you vile fool" if i % 2 else "a fine day out") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    assert X.toxicity(docs, labels).count() == 60
