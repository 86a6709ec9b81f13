"""Toxicity by a factorization machine over hashed terms (operator 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import crc_fold, cut, small_batches, table, texts, tidy
from brindle.llm.licenses import LOWER

PREFIXES = (3, 4, 5)
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Hash buckets; labelled documents learned from at most (toxic and other); standard errors from which an association is no chance (one in a thousand).
BUCKETS, TOXIC, OTHER, CHANCE, MEMO = 1 << 22, 4000, 5000, 3.3, 300_000


@dataclass
class Machine:
    """bias + sum of weights + pairwise products of the factors of the terms that a text holds."""

    at: dict[int, int]
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of texts whose distinct term numbers are concatenated in ``flat``."""
        if not len(flat):
            return np.full(len(ends), self.bias)
        starts = np.concatenate([[0], ends[:-1]])

        def sums(x: np.ndarray) -> np.ndarray:
            c = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])
            return c[ends] - c[starts]

        v = self.factor[flat]
        return self.bias + sums(self.weight[flat]) + 0.5 * (sums(v) ** 2 - sums(v * v)).sum(1)


def buckets_of(token: bytes) -> list[int]:
    """Hash buckets of the token's terms: its words, and their first three, four and five characters, which inflected and derived forms share."""
    out = []
    for t in TERM.findall(token.translate(LOWER)):
        out.append(crc32(t) % BUCKETS)
        w = t.decode("utf-8", "ignore")
        out += [crc32(b"^%d " % n + w[:n].encode()) % BUCKETS for n in PREFIXES if len(w) > n]
    return out


def fit(rows: list[np.ndarray], label: np.ndarray, prior: float, factors: int = 6, epochs: int = 30, rate: float = 0.05, decay: float = 2e-4, seed: int = 5) -> Machine:
    """AdaGrad on the log loss over the distinct terms of each row. ``prior`` is the share of label 1
    among all labelled rows, to which the bias is set back after learning on a sample with another share."""
    n, pos = len(rows), int(label.sum())
    p = min(max(prior, 1e-3), 1 - 1e-3)
    if not n or pos in (0, n) or not any(len(r) for r in rows):
        return Machine({}, float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, factors)))
    size = np.array([len(r) for r in rows])
    terms, col = np.unique(np.concatenate([np.asarray(r, np.int64) for r in rows]), return_inverse=True)
    begin = np.cumsum(size) - size
    d, rng = len(terms), np.random.default_rng(seed)
    w, v, b = np.zeros(d), rng.normal(0, 0.02, (d, factors)), float(np.log(pos / (n - pos)))
    gw, gv, gb = np.full(d, 1e-6), np.full((d, factors), 1e-6), 1e-6

    def sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        c = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])
        return np.diff(c[np.concatenate([[0], ends])], axis=0)

    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            part = order[lo : lo + 256]
            ends = np.cumsum(size[part])
            row = np.repeat(np.arange(len(part)), size[part])
            f = col[begin[part][row] + np.arange(len(row)) - np.repeat(ends - size[part], size[part])]
            xv = sums(v[f], ends)
            s = b + sums(w[f], ends) + 0.5 * ((xv**2).sum(1) - sums((v[f] ** 2).sum(1), ends))
            e = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - label[part]) / len(part)
            db = e.sum()
            gb += db * db
            b -= rate * db / np.sqrt(gb)
            if len(f):
                u, at = np.unique(f, return_inverse=True)
                by = np.argsort(at, kind="stable")
                heads = np.cumsum(np.bincount(at)) - np.bincount(at)
                own = np.bincount(at, weights=e[row])
                dw = own + decay * w[u]
                dv = np.add.reduceat((e[row][:, None] * xv[row])[by], heads, 0) - v[u] * own[:, None] + decay * v[u]
                gw[u] += dw**2
                gv[u] += dv**2
                w[u] -= rate * dw / np.sqrt(gw[u])
                v[u] -= rate * dv / np.sqrt(gv[u])
    b += np.log(p / (1 - p)) - np.log(pos / (n - pos))
    return Machine(dict(zip(terms.tolist(), range(d), strict=True)), float(b), w, v)


def associations(rows: DataFrame) -> DataFrame:
    """``t, ratio, z`` of each term of ``rows`` (y, terms): the logarithm of how much more often it occurs with label 1, and the same in standard errors."""
    n, pos = rows.agg(F.count("*"), F.sum("y")).first()
    n, pos = n or 0, pos or 0
    by = rows.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.sum("y").alias("p"), F.count("*").alias("c"))
    other = F.col("c") - F.col("p") + 0.5
    ratio = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log(other / (n - pos + 1.0))
    return by.select("t", ratio.alias("ratio"), (ratio / F.sqrt(1 / (F.col("p") + 0.5) + 1 / other)).alias("z"))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", toxic: int = TOXIC, other: int = OTHER) -> Machine:
    """A machine from at most about ``toxic`` and ``other`` labelled documents of either class (the documented bound of the sample; a hash of the id
    chooses). Rows whose id or label is null do not count; of repeated labels of an id the largest counts.

    Every term of the sample is tested: those whose association with the label is beyond chance are in the model, and those whose association is beyond chance among the documents with
    some term that speaks for label 1, which may tell nothing but in such pairs. A weaker term is in neither part; where no term passes, every text gets the share of label 1.
    The tests run over the sample in Spark; only the terms of the model come to the driver.
    """
    lab = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    prior = n1 / max(1, n0 + n1)
    u = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1_000_000)) / 1e6
    picked = lab.where(u < F.when(F.col("y") == 1, min(1.0, toxic / max(1, n1))).otherwise(min(1.0, other / max(1, n0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [sorted({b for t in set(x.split()) for b in buckets_of(t)}) for x in texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int32())), part.column(2)], ["y", "terms", "id"])

    # the picked labels are at most toxic + other rows of 12 bytes
    joined = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "id")
    sample = cut(joined.select("y", "text", "id").mapInArrow(tidy(run), "y int, terms array<int>, id long").withColumn("row", F.monotonically_increasing_id()))
    alone = associations(sample)
    speaks = alone.where((F.col("z") > CHANCE) & (F.col("ratio") > 0)).select("t")
    company = sample.join(sample.select("row", F.explode("terms").alias("t")).join(speaks, "t").select("row").distinct(), "row", "left_semi")
    kept = alone.where(F.abs("z") > CHANCE).select("t").unionByName(associations(company).where(F.abs("z") > CHANCE).select("t")).distinct()
    terms = np.sort(kept.toPandas()["t"].to_numpy(np.int32))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.intersect1d(np.asarray(t, np.int32), terms, assume_unique=True) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32())), batch.column(2)], ["y", "terms", "id"])

    got = sample.select("y", "terms", "id").mapInArrow(tidy(choose), "y int, terms array<int>, id long").toPandas()
    rows = [np.asarray(t, np.int32) for t in got["terms"]]
    order = sorted(range(len(rows)), key=lambda i: (got["id"][i], rows[i].tobytes()))  # the same order at any partitioning
    return fit([rows[i] for i in order], got["y"].to_numpy(float)[order] if order else np.zeros(0), prior)


def score(docs: DataFrame, model: Machine, text_col: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` (probability of label 1) and ``predicted`` of every whole text; only the text is an input.

    A null or empty text gets the score of the bias alone. Repeated rows score alike; other columns are ignored. No shuffle.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = held.value, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                if len(memo) > MEMO:
                    memo.clear()
                flat, ends = [], []
                for x in texts(part.column(part.num_columns - 1)):
                    own = set(x.split())
                    for t in own.difference(memo):
                        memo[t] = tuple(m.at[b] for b in buckets_of(t) if b in m.at)
                    flat.extend(sorted({i for t in own for i in memo[t]}))
                    ends.append(len(flat))
                s = 1 / (1 + np.exp(-np.clip(m.raw(np.array(flat, np.int64), np.array(ends, np.int64)), -40, 40)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*part.schema.names[:-1], "score", "predicted"])

    return src.mapInArrow(tidy(run), schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled documents whose crc32(doc_id) mod 5 is not 0; those with remainder 0 are held out. A null id is not held out."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = learn(d, labels.where(crc_fold("doc_id", 5) != 0))
    return score(d, model, keep=("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")))
