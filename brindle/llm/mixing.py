"""Mixing sources to target weights by the cube method (operator 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut, table

#: Documents of one flight; a source with more is dealt over several.
BLOCK = 4096
EPS = 1e-9


def source_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes split by the repeating ``weights`` over the sources by code point, null last.

    A target stops at ``most`` times the source's size; what is above goes to the others by weight until none is above.
    """
    names = sorted((x for x in sizes if x is not None)) + [x for x in sizes if x is None]
    size = np.array([sizes[x] for x in names], float)
    w = np.array([weights[i % len(weights)] for i in range(len(names))], float)
    out, free, rest = np.zeros(len(names)), np.ones(len(names), bool), share * size.sum()
    while free.any():
        part = rest * w / w[free].sum()
        over = free & (part > most * size)
        if not over.any():
            out[free] = part[free]
            break
        out[over] = most * size[over]
        rest -= out[over].sum()
        free &= ~over
    return dict(zip(names, out.tolist(), strict=True))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: moves inclusion probabilities along the null space of the balancing equations (sum of sizes, number of documents).

    Three undecided documents have a direction that keeps both totals, the cross product of their sizes and ones; one random
    step along it decides at least one of them and keeps every expectation. At most two stay undecided.
    """
    pi, size = pi.astype(float).tolist(), size.astype(float).tolist()
    todo = [i for i, p in enumerate(pi) if EPS < p < 1 - EPS]
    draw = iter(rng.random(len(todo) + 1).tolist())
    todo.reverse()
    hand: list[int] = []
    while True:
        while len(hand) < 3 and todo:
            hand.append(todo.pop())
        if len(hand) < 3:
            break
        a, b, c = hand
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, d in zip(hand, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - pi[i]) / d), min(down, pi[i] / d)
            elif d < 0:
                up, down = min(up, pi[i] / -d), min(down, (1 - pi[i]) / -d)
        step = up if next(draw) < down / (up + down) else -down
        rest = []
        for i, d in zip(hand, u, strict=True):
            p = pi[i] + step * d
            p = 0.0 if p < EPS else 1.0 if p > 1 - EPS else p
            pi[i] = p
            if EPS < p < 1 - EPS:
                rest.append(i)
        hand = rest
    return np.array(pi)


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Landing phase for the few documents left of a source: the choice whose total size comes nearest, the smaller total of equals."""
    out = pi.copy()
    left = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    want = float((pi[left] * size[left]).sum())
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(left) if m >> k & 1) - want), m))
    for k, i in enumerate(left):
        out[i] = float(best >> k & 1)
    return out


def _fly(level: int, last: bool, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "h", "doc_key", "twin"], ascending=[False, True, True, True], kind="stable")  # large documents first: what stays undecided is small
        name = f"{seed}|{key[0]}|{key[1]}|{level}"
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
        pi, size = rows["pi"].to_numpy(), rows["size"].to_numpy()
        pi = flight(pi, size, rng)
        return rows.assign(pi=land(pi, size) if last else pi)

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """How often each document is taken: ``doc_id, source, size, source_size, target, copies, taken, key``.

    Each source's target is as in :func:`source_targets`. A document's expected number of copies is target / source size, so it is the whole part
    of that number, plus one with the fractional part as probability; the cube method decides those, balancing the words
    and the number of documents of each source. A source's documents are dealt by a hash over flights of about
    ``block`` rows, so a hot source is many tasks; each flight leaves at most two undecided, which meet in the next
    level of flights (a tree), until one flight per source is left, where the landing picks the nearest total.

    A null text has size 0, a null source is a source of its own (last), a document of size 0 is taken with 0 words. Repeated rows are documents each; they
    are told apart by a running number among equal rows, and dealt over several flights where they are more than a quarter of one. ``key`` is a hash of id, source and text. An empty table gives no rows. Decisions follow from
    the hash of each row and the seed, so reruns agree. Other columns are ignored but for those named in ``carry``, which come along.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", "source", "text").alias("key"), *carry,
    )
    base = cut(base)
    sums = {r["source"]: (r["s"], r["n"]) for r in base.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    target = source_targets({k: v[0] for k, v in sums.items()}, weights, share, most)
    rows = [(i, k, int(sums[k][0]), float(t), t / sums[k][0] if sums[k][0] else 0.0, max(1, -(-sums[k][1] // block))) for i, (k, t) in enumerate(target.items())]
    facts = spark.createDataFrame(rows, "source_no int, s_name string, source_size long, target double, rate double, blocks long")
    df = base.join(F.broadcast(facts) if len(rows) <= 100_000 else facts, F.col("source").eqNullSafe(F.col("s_name"))).drop("s_name")
    df = df.select("*", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("pi"), F.xxhash64("key", F.lit(seed)).alias("h"), F.coalesce("doc_id", F.lit(-1)).alias("doc_key"))
    # equal rows differ by a number only; rows of one key are few and alike, so any order among them gives the same decisions
    df = df.withColumn("twin", F.monotonically_increasing_id())
    cols = ["doc_id", "source", "size", "source_size", "target", "whole", "pi", "h", "doc_key", "twin", "key", "source_no", "blocks", "block", *carry]
    # keys of which so many rows are equal that they would crowd a flight: at most 4 / block of all rows
    crowds = base.groupBy("key").count().where(F.col("count") > block // 4).select("key", F.ceil(F.col("count") / (block // 4)).alias("salts"))
    df = df.join(crowds, "key", "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod("twin", "salts")).otherwise(0))
    df = df.withColumn("block", F.pmod(F.when(F.col("salt") == 0, F.shiftright("h", 1)).otherwise(F.xxhash64("h", "salt")), "blocks")).select(*cols)
    schema = df.schema
    done = []
    level, most_blocks = 0, max((r[5] for r in rows), default=1)
    while True:
        last = most_blocks == 1
        flown = cut(df.groupBy("source_no", "block").applyInPandas(_fly(level, last, seed), schema))
        if last:
            done.append(flown)
            break
        open_ = (F.col("pi") > EPS) & (F.col("pi") < 1 - EPS)
        done.append(flown.where(~open_))
        most_blocks = max(1, -(-most_blocks // (block // 2)))
        df = flown.where(open_).withColumn("block", F.pmod("block", F.lit(most_blocks)))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("whole") + F.round("pi")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key", *carry)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row in its files (``__file``, ``__at``), which is the same at each reading. What is no plain scan of files is written first."""
    place = [F.xxhash64(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__at")]
    try:
        return docs.select("*", *place)
    except AnalysisException:
        return cut(docs).select("*", *place)


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``; ``options`` are those of :func:`mix`.

    Copies go by row, not by id or content: rows that are equal, or differ in other columns only, are taken each by its own decision. An empty table gives no rows.
    """
    own = located(docs)
    taken = mix(own, carry=("__file", "__at"), **options).where("copies > 0").select("__file", "__at", "copies")
    return own.join(taken, ["__file", "__at"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
