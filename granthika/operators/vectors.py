"""Exact nearest neighbours of a stated query set.

Queries of a checked size are handed to every task, and the vectors are read where they lie: each task multiplies
its batches with all queries and keeps the k best of each, so that only k rows for each query and task are
shuffled. More queries than that are packed into blocks, which travel to blocks of vectors instead; both ways
give the same rows. Nothing of the size of the corpus reaches the driver or a single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthika.operators.index import ranked

#: Vectors of a block, and the bytes of queries that are handed to every task.
BLOCK, HELD_BYTES = 4096, 32_000_000

_OUT = "qid bigint, doc_id bigint, distance double"


def _best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest vectors of each query, nearest first, equal ones by id."""
    order = np.argsort(ids, kind="stable")
    v, ids = v[order], ids[order]
    near = np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * q @ v.T, 0).round(6)
    return _kept(near, np.broadcast_to(ids, near.shape), k)


def _kept(near: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if near.shape[1] > 4 * k:  # all that are as near as the k-th, so that ties stay exact
        edge = np.partition(near, k - 1, axis=1)[:, k - 1]
        some = (near <= edge[:, None]).any(axis=0)
        near, ids = near[:, some], ids[:, some]
    top = np.lexsort((ids, near), axis=1)[:, :k]
    return np.take_along_axis(near, top, 1), np.take_along_axis(ids, top, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _clean(df: DataFrame, id_: str, vector: str) -> DataFrame:
    return df.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col(vector).isNotNull())


def _where_they_lie(vectors: DataFrame, queries: list, k: int) -> DataFrame:
    asked = vectors.sparkSession.sparkContext.broadcast((np.array([r.id for r in queries]), np.array([r.v for r in queries])))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi, q = asked.value
        near, ids = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                n, i = _best(q, _matrix(batch.column(1)), batch.column(0).to_numpy(), k)
                near, ids = _kept(np.hstack([near, n]), np.hstack([ids, i]), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, near.shape[1])), pa.array(ids.ravel()), pa.array(near.ravel())], ["qid", "doc_id", "distance"])

    return vectors.mapInArrow(best, _OUT)


def _blocks(x: DataFrame, name: str, parts: int) -> DataFrame:
    """Rows of about BLOCK vectors: <name> and <name>_rows."""
    return x.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(name)).agg(F.collect_list(F.struct("id", "v")).alias(f"{name}_rows"))


def _by_blocks(vectors: DataFrame, queries: DataFrame, n_queries: int, k: int) -> DataFrame:
    """Every block of queries visits every block of vectors; the vectors are shuffled once."""
    n_vectors = vectors.count()
    parts = max(1, -(-n_vectors // BLOCK))
    asked = _blocks(queries, "qb", max(1, -(-n_queries // BLOCK))).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = _blocks(vectors, "vb", parts).join(asked, "vb")

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for left, right in zip(frame["vb_rows"], frame["qb_rows"], strict=True):
                near, ids = _best(np.array([r["v"] for r in right]), np.array([r["v"] for r in left]), np.array([r["id"] for r in left]), k)
                yield pd.DataFrame({"qid": np.repeat([r["id"] for r in right], near.shape[1]), "doc_id": ids.ravel(), "distance": near.ravel()})

    return pairs.select("vb_rows", "qb_rows").mapInPandas(best, _OUT)


def nearest(vectors: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, held_bytes: int = HELD_BYTES) -> DataFrame:
    """qid, doc_id, distance (squared), similarity 1 / (1 + distance) and rank of the k nearest of each query.

    Rows without a vector are left out; equal distances go to the smaller id; no queries give no rows.
    """
    v, q = _clean(vectors, id_, vector), _clean(queries, id_, vector)
    size = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v") * 8), F.lit(0)).alias("bytes")).first()
    found = _where_they_lie(v, q.collect(), k) if 0 < size.bytes <= held_bytes else _by_blocks(v, q, size.n, k)
    top = ranked(found, F.col("distance").asc(), k)
    return top.withColumn("similarity", F.round(1 / (1 + F.greatest("distance", F.lit(0.0))), 6))
