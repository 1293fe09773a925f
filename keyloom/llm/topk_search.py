"""Exact top-k by distributed histogram selection.

Queries go out in blocks of bounded size. For a block, every task scores all its vectors and counts, per query, the
scores by histogram bin; the counts are added up over all tasks, the bin with the k-th highest score is found, and the
next pass counts again inside that bin, until a bin is one score wide. A last pass keeps the scores from the k-th
value up; ties at it are broken by the smaller id. A task reports no bin below its own k-th highest score, as the
global one can't be lower, and keeps no more than its own k best rows in (score, id) order, as no other can be in the
result; so what is shuffled follows queries x tasks, however many vectors tie.

Scores are integers. Products run in float64 while every sum is below 2**53, else in Python's integers; a score of 62 bits or more is an error.

Cases: null vectors, vectors with null or non-finite components and rows without an id take no part, neither do
vectors of another length than the query's; a query's own id is never its candidate; repeated candidate rows count as
often as they occur, repeated query ids are one query (their least vector); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Bins of a histogram, and bytes of queries that are broadcast at once.
BINS = 1024
BLOCK_BYTES = 1 << 20
#: Rows that a task scores at once.
ROWS = 1000
#: Bound of a score's size.
LARGEST = 1 << 62


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """id and whole-number components floor(scale * x), of rows that have both in full."""
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).cast("array<double>").alias("v"))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(column.offsets.to_numpy())
    fit = lengths == dim
    if not fit.all():
        column = column.filter(pa.array(fit))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), fit


def _scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products, exact."""
    if not rows.size:
        return np.zeros((len(rows), len(queries)), np.int64)
    if np.abs(rows).max() * np.abs(queries).max() * rows.shape[1] < 2.0**53:
        return (rows @ queries.T).astype(np.int64)
    whole = [[int(x) for x in q] for q in queries]
    out = [[sum(a * b for a, b in zip(r, q, strict=True)) for q in whole] for r in ([int(x) for x in row] for row in rows)]
    if any(abs(x) >= LARGEST for row in out for x in row):
        raise OverflowError("a score needs more than 62 bits")
    return np.array(out, dtype=np.int64)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row for which is_query holds."""
    spark = df.sparkSession
    vectors = quantised(df, id_col, vector_col, scale)
    queries = quantised(df.where(is_query), id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    schema = "query_id long, rank int, vec_id long, score long"
    shape = durable(queries.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))).collect()
    out = [_block(vectors, queries.where((F.size("v") == r.dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)), r.dim, k) for r in shape for blocks in [max(1, math.ceil(r.n * r.dim * 8 / BLOCK_BYTES))] for i in range(blocks)]
    result = spark.createDataFrame([], schema)
    for x in out:
        result = result.unionByName(x)
    return result


def _block(vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """The result of one block of queries, whose vectors all tasks get."""
    spark = vectors.sparkSession
    rows = sorted(queries.collect())
    ids = np.array([r.vec_id for r in rows], np.int64)
    q = np.array([r.v for r in rows], np.float64).reshape(-1, dim)
    sent = spark.sparkContext.broadcast((ids, q))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, scores, and which scores count: not those of a query with its own id."""
        ids, q = sent.value
        for b in batches:
            v, fit = _matrix(b.column(1), dim)
            own = b.column(0).to_numpy()[fit]
            for at in range(0, len(own), ROWS):
                part = own[at : at + ROWS]
                yield part, _scores(v[at : at + ROWS], q), part[:, None] != ids[None, :]

    bound = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    peak = vectors.agg(F.max(bound)).first()[0] or 0.0
    reach = min(LARGEST, int(peak * (np.abs(q).sum(axis=1).max() if len(q) else 0)) + 1)
    # per query, the range [low, low + span) that holds its k-th value, and its rank among the scores there
    low, span = np.full(len(ids), -reach, np.int64), 2 * reach - 1 if reach == LARGEST else 2 * reach + 1
    width = -(-span // BINS)
    need = np.full(len(ids), k, np.int64)
    while True:
        here = (low.copy(), span, width, need.copy())

        def count(batches: Iterator[pa.RecordBatch], here=here) -> Iterator[pa.RecordBatch]:
            low, span, width, need = here
            bins = np.zeros((len(low), BINS), np.int64)
            for _, s, counts in scored(batches):
                off = s - low[None, :]
                inside = counts & (off >= 0) & (off < span)
                bin_of = off // width
                flat = (bin_of + np.arange(len(low))[None, :] * BINS)[inside]
                bins += np.bincount(flat, minlength=bins.size).reshape(bins.shape)
            over = bins[:, ::-1].cumsum(axis=1)[:, ::-1] - bins  # scores in higher bins of this task
            at, bin_ = np.nonzero((bins > 0) & (over < need[:, None]))
            yield pa.RecordBatch.from_pydict({"q": pa.array(at, pa.int32()), "bin": pa.array(bin_, pa.int32()), "n": pa.array(bins[at, bin_], pa.int64())})

        bins = vectors.mapInArrow(count, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        over = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))) - F.col("n")
        found = bins.withColumn("over", over).where(F.col("over") < k).groupBy("q").agg(F.collect_list(F.struct("bin", "over")).alias("top")).collect()
        for r in found:
            # the lowest bin whose higher bins hold fewer than are still needed
            bin_, over_n = min((t.bin, t.over) for t in r.top if t.over < need[r.q])
            low[r.q] += bin_ * width
            need[r.q] -= over_n
        if width == 1 or not len(ids):
            break
        span, width = width, -(-width // BINS)
    floor = low

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for own, s, counts in scored(batches):
            at, col = np.nonzero(counts & (s >= floor[None, :]))
            score, ident = s[at, col], own[at]
            order = np.lexsort((ident, -score, col))
            col, score, ident = col[order], score[order], ident[order]
            first = np.r_[0, np.flatnonzero(np.diff(col)) + 1] if len(col) else np.zeros(0, int)
            nth = np.arange(len(col)) - np.repeat(first, np.diff(np.r_[first, len(col)]))
            for c, x, i in zip(col[nth < k].tolist(), score[nth < k].tolist(), ident[nth < k].tolist(), strict=True):
                best.setdefault(c, []).append((-x, i))
            best = {c: sorted(v)[:k] for c, v in best.items()}
        ids = sent.value[0]
        out = [(int(ids[c]), i, -x) for c, v in best.items() for x, i in v]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kept = vectors.mapInArrow(keep, "query_id long, vec_id long, score long")
    return kept.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
