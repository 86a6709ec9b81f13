"""Exact top-k search by tiled integer matrix products (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import cut, table, tidy

#: Bytes of quantised queries that one pass broadcasts, and rows of a candidate tile.
QUERY_BYTES, TILE_ROWS, TILE_QUERIES = 32 << 20, 2048, 512
LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


def quantise(vectors: list, scale: float = 256.0) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each component, x as double, and which vectors take part.

    Null vectors and vectors that hold a null or non-finite component take no part. The matrix is float64 (whole numbers);
    rows that are shorter than the longest are padded with zeros, which add nothing to a product.
    """
    ok = np.zeros(len(vectors), bool)
    rows, at = [], []
    for i, v in enumerate(vectors):
        if v is None or len(v) == 0:
            continue
        x = np.array([np.nan if y is None else y for y in v], np.float64) if not isinstance(v, np.ndarray) else v.astype(np.float64)
        if np.isfinite(x).all():
            ok[i] = True
            rows.append(x)
            at.append(i)
    width = max((len(x) for x in rows), default=0)
    out = np.zeros((len(vectors), width))
    for i, x in zip(at, rows, strict=True):
        out[i, : len(x)] = np.floor(scale * x)
    return out, ok


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact whole-number inner products, as float64 where they fit in 53 bits, else int64, else Python integers held to 64 bits."""
    w = min(q.shape[1], c.shape[1])
    q, c = q[:, :w], c[:, :w]
    bound = w * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    if bound < 2**53:
        return q @ c.T
    if bound < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    qi, ci = [[int(x) for x in r] for r in q], [[int(x) for x in r] for r in c]
    return np.array([[max(LONG_MIN, min(LONG_MAX, sum(a * b for a, b in zip(x, y, strict=True)))) for y in ci] for x in qi], object).reshape(len(q), len(c))


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row: higher score first, ties to the smaller id. ``ids`` ascend along the columns; score -inf or LONG_MIN-1 never wins.

    Partial selection on one exact composite key (score, place) where it fits in 53 bits, else a stable sort.
    """
    n, m = scores.shape
    take = min(k, m)
    if scores.dtype == np.float64:
        finite = scores[np.isfinite(scores)]
        if not finite.size or np.abs(finite).max() * m < 2**51:
            key = scores * m - np.arange(m)
            part = np.argpartition(-key, take - 1, axis=1)[:, :take] if take < m else np.tile(np.arange(m), (n, 1))
            order = np.argsort(-np.take_along_axis(key, part, 1), axis=1, kind="stable")
            at = np.take_along_axis(part, order, 1)
            return np.take_along_axis(scores, at, 1), ids[at] if ids.ndim == 1 else np.take_along_axis(ids, at, 1)
    at = np.array([sorted(range(m), key=lambda j, r=r: (-r[j], j))[:take] for r in scores], int).reshape(n, take)
    return np.take_along_axis(scores, at, 1), ids[at]


class TopLists:
    """Running top lists of a block of queries; merging two of them is one more partial selection."""

    def __init__(self, qids: np.ndarray, copies: np.ndarray, k: int):
        self.k, self.qids, self.copies = k, qids, copies
        self.best: list[list[tuple]] = [[] for _ in qids]

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        floor = [b[-1] if len(b) == self.k else None for b in self.best[first : first + len(scores)]]
        for i, (s, d) in enumerate(zip(scores.tolist(), ids.tolist(), strict=True)):
            new = [(-x, y) for x, y in zip(s, d, strict=True) if x != -np.inf and x is not None]
            if floor[i] is None or (new and new[0] < floor[i]):
                self.best[first + i] = sorted(self.best[first + i] + new)[: self.k]

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        for q, c, b in zip(self.qids.tolist(), self.copies.tolist(), self.best, strict=True):
            for s, d in b:
                yield q, c, d, int(-s)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k best candidates of every query by integer inner product of the quantised vectors: ``query_id, query_copy, rank, vec_id, score``.

    Queries are taken in blocks whose packed size is at most ``query_bytes``; each block is broadcast once (its size is
    proven) and meets every candidate partition as tiles of a matrix product. Each tile gives a partial selection, each task one
    merged list per query, and a two-level tree of shuffles merges the tasks' lists. A candidate with the query's own id is left out;
    repeated ids are candidates each. Query rows that repeat an id and a vector are one query; unequal vectors of one id are queries each, numbered from 1 by
    ``query_copy`` in the order of their vectors. Rows with a null id, a null vector or a null or non-finite component take no part. With
    fewer candidates than k, all are returned; empty tables give no rows. Ties go to the smaller id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    cand = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    asked = asked.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
    if asked.groupBy("vec_id").count().where("count > 1").isEmpty():
        asked = asked.withColumn("copy", F.lit(1))
    else:
        asked = asked.distinct().withColumn("copy", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")))
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    per = max(1, query_bytes // (8 * max(1, width or 1)))
    blocks = max(1, -(-n // per))
    if blocks > 1:  # sorted by block, so that each pass reads its own rows
        asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "copy"), F.lit(blocks))).repartitionByRange("block").sortWithinPartitions("block"))
    out = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.col("block") == block)
        got = part.select("vec_id", "copy", "v").toPandas()
        q, _ = quantise(list(got["v"]), scale)
        ids, copies = got["vec_id"].to_numpy(np.int64), got["copy"].to_numpy(np.int64)
        order = np.lexsort((copies, ids))
        held = spark.sparkContext.broadcast((ids[order], copies[order], q[order]))
        lists = _merge(cand.mapInArrow(tidy(_search(held, k, scale)), "query_id long, query_copy int, part long, vec_id long, score long"), k)
        if blocks > 1:
            lists = cut(lists)
            held.unpersist()
        out = lists if out is None else out.unionByName(lists)
    return out


def _search(held, k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        qids, copies, q = held.value
        lists = TopLists(qids, copies, k)
        for batch in batches:
            if not len(qids):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            c, ok = quantise(batch.column(1).to_numpy(zero_copy_only=False).tolist() if batch.num_rows else [], scale)
            ids, c = ids[ok], c[ok]
            order = np.argsort(ids, kind="stable")
            ids, c = ids[order], c[order]
            for lo in range(0, len(ids), TILE_ROWS):
                tile, tile_ids = c[lo : lo + TILE_ROWS], ids[lo : lo + TILE_ROWS]
                for first in range(0, len(qids), TILE_QUERIES):
                    own = qids[first : first + TILE_QUERIES]
                    s = products(q[first : first + TILE_QUERIES], tile)
                    same = own[:, None] == tile_ids[None, :]
                    if same.any():
                        s = s.astype(np.float64) if np.abs(s).max() < 2**53 else s.astype(object)
                        s[same] = -np.inf
                    lists.add(first, *select(s, tile_ids, k))
        got = list(lists.rows())
        a = np.array(got, np.int64).reshape(-1, 4)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1].astype(np.int32)), pa.array(np.full(len(a), part)), pa.array(a[:, 2]), pa.array(a[:, 3])], ["query_id", "query_copy", "part", "vec_id", "score"])

    return run


def _merge(lists: DataFrame, k: int, fan: int = 64) -> DataFrame:
    """Tree of merges: lists of ``fan`` tasks first, then the rest, so that no group holds more than a few thousand entries."""
    best = lambda c: F.slice(F.array_sort(F.collect_list(c)), 1, k)
    entry = F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), "vec_id", "score")
    first = lists.groupBy("query_id", "query_copy", F.floor(F.col("part") / fan).alias("node")).agg(best(entry).alias("top"))
    merged = first.groupBy("query_id", "query_copy").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return merged.select("query_id", "query_copy", F.posexplode("top").alias("at", "e")).select("query_id", "query_copy", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose vec_id is divisible by 50; candidates: every other row."""
    e = table(spark, sf_dir, "embeddings")
    return top_k(e, e.where("vec_id % 50 = 0"), 5, 256.0)


OP1_SQL = """
with v as (select row_number() over () rn, vec_id, embedding from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
c as (select vec_id, rn, list_transform(embedding, lambda x: floor(256 * x::double)) e from v),
d as (select distinct vec_id, embedding from v where vec_id % 50 = 0),
q as (select vec_id, row_number() over (partition by vec_id order by embedding) query_copy, list_transform(embedding, lambda x: floor(256 * x::double)) e from d),
s as (select a.vec_id query_id, a.query_copy, b.vec_id vec_id, b.rn, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::bigint score from q a join c b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id, query_copy order by score desc, vec_id, rn) rk from s)
select query_id, query_copy::integer as query_copy, rk::integer as rank, vec_id, score from r where rk <= 5
"""
