"""Exact top-k search by tiled matrix products.

Queries are packed into tiles, broadcast in rounds of bounded size, and every task multiplies its candidates, shard by
shard, with the tiles - a stated query set against all rows, in blocks. Partial selection keeps the best per query and tile;
lists are merged in the task, and then by query. Sums of products of integers are exact in floating point while below
2 ** 53 (2 ** 24 in single precision); the bound is checked against the largest component of each block, and beyond it Python's
integers are used; scores that no long holds stay at its ends.

Edge cases: rows whose id or vector is null, or that hold a null or non-finite component, take no part, nor do empty
vectors; an empty table gives an empty result; very long vectors take more rounds; shorter vectors count as padded with zeros; a query with fewer candidates than k gets all; equal scores go to
the smaller id; repeated rows each count, except those with the query's own id; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewarden.llm.common import folder_of, released, table, written

TILE, SHARD = 1024, 4096
#: Bytes of queries that are broadcast at once.
ROUND = 64 << 20


def integral(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): each component x as floor(scale * x), x as double, of the rows that take part."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * scale).cast("double"))
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == math.inf))
    rows = df.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0))
    return rows.filter(~bad).select(F.col(vec_id).cast("long").alias("id"), x.alias("v"))


def _matrix(vectors: np.ndarray) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros."""
    width = max(map(len, vectors), default=0)
    if len(vectors) and min(map(len, vectors)) == width:
        return np.stack(vectors)
    m = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    return m


def _tiles(queries: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of about TILE queries each."""
    ids, vectors = queries["id"].to_numpy(), queries["v"].to_numpy()
    return [(ids[a : a + TILE], _matrix(vectors[a : a + TILE])) for a in range(0, len(ids), TILE)]


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integral matrices."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (q, c))
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width
    if most < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(whole, 1 - 2**63, 2**63 - 1).astype(np.int64)


def _best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries, ids and scores of the best k candidates (in order of id) of each query."""
    s = _product(q, c)
    same = qid[:, None] == cid[None, :] if len(np.intersect1d(qid, cid)) else None
    if same is not None:
        s[same] = np.iinfo(np.int64).min
    kth = min(k, s.shape[1])
    edge = np.partition(s, s.shape[1] - kth, axis=1)[:, s.shape[1] - kth]
    row, hit = np.nonzero(s >= edge[:, None])
    if same is not None:
        other = ~same[row, hit]
        row, hit = row[other], hit[other]
    return _first(row, cid[hit], s[row, hit], k)


def _first(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == np.iinfo(np.int64).min else -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], ids[place < k], scores[place < k]


def _scanned(batches: Iterator[pa.RecordBatch], tiles: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The best k candidates (id, v) of each query in one task: a shard is multiplied with every tile, and its lists are
    merged with those of the shards before."""
    best: list[tuple | None] = [None] * len(tiles)
    for batch in batches:
        for at in range(0, len(batch), SHARD):
            part = batch.slice(at, SHARD)
            cid = part.column(0).to_numpy()
            order = np.argsort(cid, kind="stable")
            c = _matrix(part.column(1).to_numpy(zero_copy_only=False)[order])
            for t, (qid, q) in enumerate(tiles):
                new = _best(qid, q, cid[order], c, k)
                best[t] = new if best[t] is None else _first(*[np.concatenate(x) for x in zip(best[t], new, strict=True)], k)
    for (qid, _), found in zip(tiles, best, strict=True):
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (qid[found[0]], found[1], found[2])], names=["query_id", "vec_id", "score"])


def _merged(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best k rows of each group; partial lists of k are kept by Spark's own limit below the exchange."""
    from pyspark.sql import Window

    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "copy")
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates, its own id excluded. Both sides (id, v).

    Candidates stay where they are. Queries go round by round: tiles of ROUND bytes at most are broadcast, each task keeps its
    k best of every query over all its candidates, and only these lists move.
    """
    spark = candidates.sparkSession
    # A query that stands in several rows is one query.
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n, widest = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    rounds = max(1, -(-n * 8 * (widest or 1) // ROUND))
    dealt = written(queries.withColumn("round", F.pmod(F.xxhash64("id"), F.lit(rounds)).cast("int")), "queries") if rounds > 1 else queries.withColumn("round", F.lit(0))
    parts = []
    for number in range(rounds):
        found = dealt.filter(F.col("round") == number).select("id", "v").toArrow().sort_by("id")
        shared = spark.sparkContext.broadcast(_tiles(found))
        lists = candidates.mapInArrow(lambda b, s=shared: _scanned(b, s.value, k), "query_id bigint, vec_id bigint, score bigint")
        merged = _merged(lists.withColumn("copy", F.monotonically_increasing_id()), ["query_id"], k)
        parts.append(written(merged, "best") if rounds > 1 else merged)
    if rounds > 1:
        released(dealt)
    out = parts[0] if rounds == 1 else spark.read.schema(parts[0].schema).parquet(*[folder_of(p) for p in parts])
    return out.select("query_id", "rank", "vec_id", "score")


def op6(spark, sf_dir: str) -> DataFrame:
    rows = integral(table(spark, sf_dir, "embeddings"))
    return search(rows.filter(F.col("id") % 50 == 0), rows)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
