"""Nearest neighbours by a block matrix join over int8 product tiles.

Queries and candidates are dealt to blocks by a hash of their id; every pair of blocks
is one tile, joined in a task of its own. Vectors are quantised to int8 with a scale
each. For q = s_q a + e_q and v = s_v b + e_v the product q.v differs from s_q s_v
(a.b) by at most |e_q||v| + |s_q a||e_v|, so the int8 product of a tile gives lower and upper bounds
for every pair. Pairs whose upper bound reaches the query's k-th best lower bound
survive; they are computed again in double precision from the original vectors, and a heap per query
keeps the k best. Tiles send k rows a query; their heaps are merged by rank.

Defined cases: vectors that are null, empty, zero, of another length than the most
frequent, or with null or non-finite components take no part; ties go to the smaller
id; rows sharing an id are candidates each, and never of a query with that id; a null id
takes no part; fewer candidates than k: all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
SLACK = 1e-9  # relative; covers the rounding of the bounds themselves


def quantise(x: np.ndarray):
    """int8 codes (as float32, exact in products), scales, code norms and error norms of the rows."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None])
    back = codes * scale[:, None]
    return codes.astype(np.float32), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def tile(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int):
    """(query, candidate, product) of the k best candidates of each query in the tile."""
    qc, qs, qn, qe = quantise(q)
    vc, vs, _, ve = quantise(v)
    vn = np.linalg.norm(v, axis=1)
    for lo in range(0, len(qid), 64):
        own = slice(lo, lo + 64)
        near = (qc[own] @ vc.T).astype(np.float64) * (qs[own, None] * vs[None, :])
        err = (qe[own, None] * vn[None, :] + qn[own, None] * ve[None, :]) * (1 + SLACK) + SLACK * np.abs(near)
        self_pair = qid[own, None] == vid[None, :]
        low = np.where(self_pair, -np.inf, near - err)
        kk = min(k, low.shape[1])
        bar = np.partition(low, low.shape[1] - kk, axis=1)[:, low.shape[1] - kk]
        r, c = np.nonzero((near + err >= bar[:, None]) & ~self_pair)
        score = np.einsum("ij,ij->i", q[own][r], v[c])
        edge = np.searchsorted(r, np.arange(near.shape[0] + 1))
        for i in range(near.shape[0]):
            a, b = edge[i], edge[i + 1]
            best = heapq.nsmallest(k, zip((-score[a:b]).tolist(), vid[c[a:b]].tolist()))
            for s, x in best:
                yield int(qid[lo + i]), x, -s


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _tile_rows(k: int):
    def work(table: pa.Table) -> pa.Table:
        is_query = table["is_query"].to_numpy()
        ids = table["id"].to_numpy()
        x = _matrix(table["vector"], len(table["vector"][0]))
        if not is_query.any() or is_query.all():
            rows = []
        else:
            rows = list(tile(ids[is_query], x[is_query], ids[~is_query], x[~is_query], k))
        return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()),
                         "vec_id": pa.array([r[1] for r in rows], pa.int64()),
                         "score": pa.array([r[2] for r in rows], pa.float64())})
    return work


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    return (vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
            .filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
            .filter(F.forall("vector", finite) & F.exists("vector", lambda e: e != 0)))


def block_search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``is_query``: id column -> condition."""
    rows = usable(vectors, vec_id, embedding)
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(
        F.count("*").alias("n"), F.count(F.when(is_query(F.col("id")), 1)).alias("q"))
    top = sizes.orderBy(F.desc("n"), "dim").first()  # one number per vector length
    dim, n, nq = (top["dim"], top["n"], top["q"]) if top else (0, 0, 0)
    rows = rows.filter(F.size("vector") == dim)
    cands, queries = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    spread = F.xxhash64("id", "vector")  # rows sharing an id still spread
    right = rows.select(F.lit(False).alias("is_query"), "id", "vector", F.pmod(spread, F.lit(cands)).alias("cb"),
                        F.explode(F.expr(f"sequence(0L, {queries - 1}L)")).alias("qb"))
    left = (rows.filter(is_query(F.col("id"))).dropDuplicates(["id"])
            .select(F.lit(True).alias("is_query"), "id", "vector", F.explode(F.expr(f"sequence(0L, {cands - 1}L)")).alias("cb"),
                    F.pmod(F.xxhash64("id"), F.lit(queries)).alias("qb")))
    best = (left.unionByName(right).groupBy("qb", "cb")
            .applyInArrow(_tile_rows(k), "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark, sf_dir: str) -> DataFrame:
    return block_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
