"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are turned into integers first, so scores are exact. Each task takes its
candidates in blocks of `block_rows`. A block has one list per dimension, sorted by
component. For a query all lists are read downwards side by side, in the direction
that its sign makes best; whatever comes up is scored in full. The sum of the
products at the current depth bounds every vector not yet seen, and reading stops
when it is below the k-th best score so far, which the query carries from block to
block. Tasks report k rows per query, and a ranked window merges them.

Queries come to the workers in blocks of at most `query_bytes`, all rows are the
candidates of each.

Defined results: vectors that are null or hold a null or a value that isn't finite
take no part; shorter vectors count as padded with zeros; a vector is no candidate
for a query with its own id; equal scores go to the smaller id; a repeated query id
gives one result per row; no queries, no rows; components so large that a score may
need more than 64 bits are an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from webstrata.llm._io import renamed


def _matrix(vectors: pa.Array, scale: int, dims: int) -> np.ndarray:
    lengths = np.asarray(vectors.value_lengths())
    values = np.asarray(vectors.flatten()).astype(np.float64)
    out = np.zeros((len(lengths), dims), np.int64)
    scaled = np.floor(values * scale)
    if np.abs(scaled).max(initial=0) >= 1 << 62:
        raise OverflowError("a component is too large for 64-bit scores")
    scaled = scaled.astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = scaled
    return out


class Block:
    """Candidates with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.lists = np.argsort(vectors, axis=0, kind="stable")
        # products in float64 are exact below 2**53
        self.top = float(np.abs(vectors).max(initial=0))
        self.exact_float = self.top < 1 << 22 and vectors.shape[1] < 512
        self.fast = vectors.astype(np.float64) if self.exact_float else None

    def search(self, query: np.ndarray, own: int, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best of (scores, ids) and this block; and how many rows were scored."""
        n, used = len(self.ids), np.flatnonzero(query)
        if float(np.abs(query).max(initial=0)) * self.top * max(1, len(query)) >= float(1 << 63):
            raise OverflowError("scores may need more than 64 bits")
        seen = np.zeros(n, bool)
        depth, scored = 0, 0
        q = query.astype(np.float64) if self.exact_float and np.abs(query).max(initial=0) < 1 << 22 else None
        up = query[used] > 0
        while depth < n:
            step = min(n, max(8, 2 * depth))
            if len(used):
                best = np.concatenate([self.lists[n - step : n - depth, used[up]].ravel(), self.lists[depth:step, used[~up]].ravel()])
                mark = np.zeros(n, bool)
                mark[best] = True
                new = np.flatnonzero(mark & ~seen)
                seen |= mark
            else:
                new, step = np.arange(n), n
            depth = step
            scored += len(new)
            got = (self.fast[new] @ q).astype(np.int64) if q is not None else self.vectors[new] @ query
            ok = self.ids[new] != own
            if len(scores) == k:
                ok &= got >= scores[-1]
            if ok.any():
                scores, ids = np.concatenate([scores, got[ok]]), np.concatenate([ids, self.ids[new][ok]])
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
            if depth < n and len(scores) == k:
                next_up = self.vectors[self.lists[n - depth - 1, used[up]], used[up]]
                next_down = self.vectors[self.lists[depth, used[~up]], used[~up]]
                bound = int((next_up * query[used[up]]).sum() + (next_down * query[used[~up]]).sum())
                if bound < scores[-1]:
                    break
        return scores, ids, scored


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, block_rows: int = 4096, query_bytes: int = 32 << 20) -> DataFrame:
    """`query_id`, `rank` from 1, `vec_id`, `score` of each query's k best."""
    spark = vectors.sparkSession
    rows = renamed(vectors.withColumn(key, F.col(f"`{key}`").cast("long")), [key, vector]).toDF("vec_id", "v")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad)
    queries = vectors.where(is_query).select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    queries = queries.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad)
    n, dims = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dims = max(dims or 0, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    per = max(1, query_bytes // (8 * max(1, dims)))
    blocks = 1 + n // per
    parts = []
    for b in range(blocks if n else 0):
        some = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).toArrow().combine_chunks().sort_by("vec_id")
        if not some.num_rows:
            continue
        ids = np.asarray(some.column("vec_id"))
        shared = spark.sparkContext.broadcast((b, ids, _matrix(some.column("v").combine_chunks(), scale, dims)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, own, qs = shared.value
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own]
            for batch in batches:
                for at in range(0, batch.num_rows, block_rows):
                    part = batch.slice(at, block_rows)
                    held = Block(np.asarray(part.column(0)), _matrix(part.column(1), scale, qs.shape[1]))
                    for i in range(len(own)):
                        s, v, _ = held.search(qs[i], int(own[i]), k, *best[i])
                        best[i] = (s, v)
            for at in range(0, len(own), 4096):
                got = best[at : at + 4096]
                n_each = [len(s) for s, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.arange(at, at + len(got)), n_each) + (block << 40), pa.int64()),
                        pa.array(np.repeat(own[at : at + len(got)], n_each), pa.int64()),
                        pa.array(np.concatenate([v for _, v in got]), pa.int64()),
                        pa.array(np.concatenate([s for s, _ in got]), pa.int64()),
                    ],
                    ["q", "query_id", "vec_id", "score"],
                )

        parts.append(rows.mapInArrow(scan, "q long, query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
