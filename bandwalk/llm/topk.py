"""Exact top-k by integer inner product: tiled matrix products and a merge of per-tile top lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

QUERY_TILE = 4096
SHARD = 16384
CHUNK = 2048
NO_SCORE = -(2**62)  # its negative is a number too


def quantised(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component as double. Rows whose vector is null, empty or has a
    null or non-finite component are left out, and so are rows without an id."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & F.col(id_col).isNotNull()).filter(~bad).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def top_k(rows: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row that ``queries`` selects.

    ``rows``: (vec_id, v) from ``quantised``. Queries are dealt into tiles and rows into
    shards of bounded size; every tile meets every shard in one task, which multiplies them
    in chunks as doubles (exact: products of numbers below 2^26 and their sums; larger ones
    are multiplied as integers), keeps the k best per query, and ties go to the smaller id.
    The lists of a query's shards are merged in a tree: per group of shards, then over groups.

    Equal ids: each row is a candidate of its own, but no row is a candidate for a query of
    its own id; equal query ids give one list, that of the smallest of their vectors. Vectors of
    another length than the query's do not take part for it. Fewer than k candidates give all of
    them; an empty table none. Other columns of ``rows`` are ignored.
    """
    spark = rows.sparkSession
    n_rows, n_queries = rows.agg(F.count("*"), F.count(F.when(queries, 1))).first()
    tiles = max(1, -(-n_queries // QUERY_TILE))
    shards = max(1, -(-n_rows // SHARD), min(-(-n_rows // CHUNK), spark.sparkContext.defaultParallelism))
    asked = (
        rows.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
        .select(F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int").alias("tile"),
                F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "v")
    )
    given = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"),
        F.pmod(F.xxhash64(F.struct("vec_id", "v"), F.lit(1)), F.lit(shards)).cast("int").alias("shard"),
        F.col("vec_id").alias("given_id"), F.col("v").alias("given_v"))  # own names: both sides come from one frame

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [best for batch in _by_length(left, "vec_id", "v") for other in _by_length(right, "given_id", "given_v")
               if batch[1].shape[1] == other[1].shape[1] for best in [_best(*batch, *other, k)]]
        shard = right.column("shard")[0].as_py() if right.num_rows else 0
        q, v, s = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
        return pa.table({"query_id": q, "shard": np.full(len(q), shard, np.int32), "vec_id": v, "score": s})

    lists = asked.groupBy("tile", "shard").cogroup(given.groupBy("tile", "shard")).applyInArrow(
        run, "query_id bigint, shard int, vec_id bigint, score bigint")
    order = [F.desc("score"), "vec_id"]
    for level in ("branch", None):
        by = ["query_id"]
        if level:
            lists, by = lists.withColumn("branch", F.floor(F.col("shard") / 64)), ["query_id", "branch"]
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        lists = lists.withColumn("rank", rank).filter(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")


def _by_length(table: pa.Table, id_col: str, vector_col: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if not table.num_rows:
        return
    table = table.combine_chunks()
    ids = table.column(id_col).to_numpy()
    lists = table.column(vector_col).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(size)])
    for n in np.unique(size):
        chosen = np.flatnonzero(size == n)
        yield ids[chosen], flat[at[chosen][:, None] + np.arange(n)]


def _best(query_id, query, vec_id, vector, k):
    """The k best of the shard for every query, ties to the smaller id."""
    order = np.argsort(vec_id, kind="stable")
    vec_id, vector = vec_id[order], vector[order]
    limit = max(np.abs(query).max(initial=0), 1) * max(np.abs(vector).max(initial=0), 1)
    kind = np.float64 if float(limit) * query.shape[1] < 2**53 else np.int64
    vector = vector.astype(kind)
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(query_id), CHUNK):
        block = query[at : at + CHUNK].astype(kind)
        best_s = np.zeros((len(block), 0), np.int64)
        best_v = np.zeros((len(block), 0), np.int64)
        for to in range(0, len(vec_id), CHUNK):
            score = (block @ vector[to : to + CHUNK].T).astype(np.int64)
            name = np.broadcast_to(vec_id[to : to + CHUNK], score.shape)
            score = np.where(name == query_id[at : at + CHUNK, None], NO_SCORE, score)
            if score.shape[1] > k:
                # everything at or above the k-th best score; ties are settled below
                floor = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
                above = np.argsort(~(score > floor[:, None]), axis=1, kind="stable")[:, :k]
                equal = np.argsort(~(score == floor[:, None]), axis=1, kind="stable")[:, :k]
                pick = np.concatenate([above, equal], axis=1)
                wanted = np.concatenate([np.take_along_axis(score, above, 1) > floor[:, None],
                                         np.take_along_axis(score, equal, 1) == floor[:, None]], axis=1)
                score = np.where(wanted, np.take_along_axis(score, pick, 1), NO_SCORE)
                name = np.take_along_axis(np.ascontiguousarray(name), pick, 1)
            best_s, best_v = np.concatenate([best_s, score], 1), np.concatenate([best_v, name], 1)
            keep = np.lexsort((best_v, -best_s), axis=1)[:, :k] if best_s.shape[1] else None
            best_s, best_v = np.take_along_axis(best_s, keep, 1), np.take_along_axis(best_v, keep, 1)
        real = best_s > NO_SCORE
        out_q.append(np.repeat(query_id[at : at + CHUNK], real.sum(1)))
        out_v.append(best_v[real])
        out_s.append(best_s[real])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(out_q), join(out_v), join(out_s)
