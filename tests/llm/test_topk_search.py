import math
import random

from pyspark.sql import functions as F

from keyloom.llm import topk_search
from keyloom.llm.topk_search import top_k


def brute(rows, k, step):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in {i: v for i, v in sorted(ok, reverse=True) if i % step == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(w, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(w))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, k=5, step=10, parts=6):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as v").repartition(parts)
    return sorted(map(tuple, top_k(df, F.col("vec_id") % step == 0, k).collect()))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    f = lambda: round(rng.uniform(-1, 1) * 64) / 64
    rows = [(i, [f() for _ in range(8)]) for i in range(300)]
    rows += [(400 + i, rows[10][1]) for i in range(80)]  # ties
    rows += [(900, None), (901, [float("nan")] + [0.0] * 7), (910, [None] + [1.0] * 7), (None, [1.0] * 8), (911, [float("inf")] * 8), (13, rows[13][1])]
    assert run(spark, rows) == brute(rows, 5, 10)
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 640)
    assert run(spark, rows) == brute(rows, 5, 10)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (7, [0.5, 0.5]), (10, [3.0, -2.0])]
    assert run(spark, rows) == brute(rows, 5, 10) and len(run(spark, rows)) == 4
    assert run(spark, [(7, [1.0])]) == []
    assert run(spark, rows[:0], parts=1) == []


def test_large_components(spark):
    rows = [(i, [1e5 * (i + 1), -3e5 * i, 2.5]) for i in range(25)]
    assert run(spark, rows) == brute([(i, [float(__import__("numpy").float32(x)) for x in v]) for i, v in rows], 5, 10)
