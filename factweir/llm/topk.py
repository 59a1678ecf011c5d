"""Exact top-k search by inner product: tiled matrix products, partial selection and tree merging.

Vectors are dealt into shards and queries into blocks, both of bounded size. Every (block, shard) tile is one
matrix product, of which each query keeps its k best; the lists of a query are then merged level by level.
Tiles are made by giving each query block to every shard, so nothing is collected or broadcast, and a lost
tile is computed again alone.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take
no part; vectors only meet vectors of their own dimension; ties go to the smaller id; of repeated rows of a
query id the smallest vector asks; repeated rows of a candidate id count once, with their best score;
components and scores beyond 64-bit integers become the nearest of those.

A tile moves its queries and its vectors once. With a budget of bytes for each side, N vectors and Q queries are
moved in Q and N over that budget copies, the least that tiles of this memory allow.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweir.llm.common import pick, prepare

#: Bytes of a shard's vectors and of a block's queries, as 64-bit components, on average.
TILE_BYTES = 64 << 20
#: Lists of a query that one merging step takes.
FAN_IN = 16


def scaled(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """id and v: floor(scale * x) of every component, as integers, for the vectors that take part."""
    base = pick(vectors, id_column, vector_column).toDF("id", "x")
    base = base.withColumn("x", F.transform("x", lambda x: x.cast("double"))).where("id IS NOT NULL AND x IS NOT NULL")
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return base.where(~bad).select("id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every sum is exact there, else in integers."""
    most = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    if most < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2.0**63:
        return q @ c.T
    wide = q.astype(object) @ c.astype(object).T
    return np.clip(wide, np.iinfo(np.int64).min, np.iinfo(np.int64).max).astype(np.int64)


def _best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, step: int = 256) -> pd.DataFrame:
    """The k best candidates of each query in one tile."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    out = []
    lowest = np.iinfo(np.int64).min
    again = np.concatenate(([False], c_ids[1:] == c_ids[:-1]))
    starts = np.flatnonzero(~again)
    for at in range(0, len(q_ids), step):
        scores = _products(q[at : at + step], c)
        ids = c_ids
        if again.any():
            scores, ids = np.maximum.reduceat(scores, starts, axis=1), c_ids[starts]
        own = ids[None, :] == q_ids[at : at + step, None]
        many = min(k + 1, len(ids))
        for row, mine, qid in zip(scores, own, q_ids[at : at + step], strict=True):
            cut = np.partition(row, len(row) - many)[len(row) - many]
            near = np.flatnonzero((row >= cut) & ~mine)
            near = near[np.lexsort((ids[near], -np.maximum(row[near], lowest + 1)))][:k]
            out.append((np.full(len(near), qid), ids[near], row[near]))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pd.DataFrame(dict(zip(("query_id", "id", "score"), cols, strict=True)))


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), id and score of each query's k best vectors with another id."""
    spark = vectors.sparkSession
    prepare(spark, 4000)
    asked, held = scaled(queries, id_column, vector_column, scale), scaled(vectors, id_column, vector_column, scale)
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    tiles = lambda df: max(1, math.ceil(8 * (df.select(F.sum(F.size("v"))).first()[0] or 0) / TILE_BYTES))
    shards, blocks = tiles(held), tiles(asked)
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles_held = held.select("id", "v", F.size("v").alias("dim"), part(shards).alias("shard"), every(blocks).alias("block"))
    tiles_asked = asked.select("id", "v", F.size("v").alias("dim"), part(blocks).alias("block"), every(shards).alias("shard"))

    def tile(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "id": [], "score": [], "shard": []}, dtype="int64")
        wide = lambda x: np.stack(x["v"].to_list()).astype(np.int64).reshape(len(x), -1)
        found = _best(q["id"].to_numpy(), wide(q), c["id"].to_numpy(), wide(c), k)
        return found.assign(shard=int(key[1]))

    by = ["block", "shard", "dim"]
    lists = tiles_asked.groupBy(*by).cogroup(tiles_held.groupBy(*by)).applyInPandas(tile, "query_id long, id long, score long, shard long")
    best = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "id"))
    while shards > 1:
        shards = math.ceil(shards / FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN)).withColumn("rank", best).where(F.col("rank") <= k).drop("rank")
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return lists.select("query_id", "id", "score").withColumn("rank", final).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
