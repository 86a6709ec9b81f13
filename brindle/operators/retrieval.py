"""Nearest rows by inner product of unit vectors, inside parts (market and brand, say), exact or by an inverted file whose visits are set by measured recall.

Index rows are packed into tiles of a part's cell and queries into blocks; a tile and a block meet by an equi-join on (part, cell), one matrix product gives their best ``k``, and a query's short lists are merged. A large part or a
crowded cell is many tiles, each a task's row of its own, so no group is ever held as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.models.tables import written

#: Rows of a tile and of a block of queries; blocks that a tile meets at once; rows of a sample for each cell; most bytes of all centres that go to every task.
TILE, BLOCK, AT_ONCE, EACH, MOST_BYTES = 2048, 1024, 4, 40, 64 << 20


def combined(blocks: Sequence[str], mask: dict[str, str] | None = None) -> Column:
    """Unit blocks one after another; made unit as a whole by the search, their inner products are means of the blocks' cosines. A block that is zero, or whose ``mask`` column isn't true, adds zeros; a null block makes the row null."""
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    out = []
    for b in blocks:
        v = F.transform(F.col(b), lambda x: x.cast("double"))
        n = F.sqrt(square(v))
        keep = F.coalesce(F.col(mask[b]).cast("boolean"), F.lit(False)) if mask and b in mask else F.lit(True)
        scale = F.when(keep & (n > 0), 1 / n).otherwise(0.0)
        out.append(F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(scale, F.size(v)).alias("s")), lambda p: p["x"] * p["s"]))
    return F.concat(*out)


def _clean(df: DataFrame, width: int | None = None) -> tuple[DataFrame, int]:
    """Rows with a whole vector of the common width: nulls, zeros, components that are null or not finite and other widths take no part."""
    fine = df.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    if width is None:
        top = fine.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
        width = top.w if top else 0
    return fine.where(F.size("v") == width), width


def _rows(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _standard(df: DataFrame, ident: str, vector: str, part: str | None, group: str | None) -> DataFrame:
    part_of = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")
    group_of = F.col(group).cast("string") if group else F.lit(None).cast("string")
    return df.select(F.col(ident).cast("long").alias("id"), part_of.alias("part"), group_of.alias("grp"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))


def _placed(df: DataFrame, width: int, centres: dict[str, np.ndarray], visits: dict[str, int] | None) -> DataFrame:
    """``part, cell, id, grp, v`` (unit, bytes): each row in the cell of its nearest centre, or with ``visits`` in its part's number of nearest cells. A part without centres is one cell."""
    held = df.sparkSession.sparkContext.broadcast((centres, visits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = held.value
        for batch in batches:
            x, parts = _rows(batch.column(3), width), np.array(batch.column(1).to_pylist(), object)
            at, cell = [np.flatnonzero([p not in own for p in parts])], []
            cell.append(np.zeros(len(at[0]), np.int64))
            for p in sorted(set(parts) & set(own)):
                rows = np.flatnonzero(parts == p)
                near = x[rows] @ own[p].T
                take = seen[p] if seen else 1
                best = near.argmax(1)[:, None] if take == 1 else np.argsort(-near, axis=1, kind="stable")[:, :take]
                at.append(np.repeat(rows, best.shape[1]))
                cell.append(best.ravel())
            at, cell = np.concatenate(at), np.concatenate(cell)
            for lo in range(0, len(at), 4096):
                i = pa.array(at[lo : lo + 4096])
                yield pa.RecordBatch.from_arrays([batch.column(1).take(i), pa.array(cell[lo : lo + 4096], pa.int32()), batch.column(0).take(i), batch.column(2).take(i), pa.array([x[j].tobytes() for j in at[lo : lo + 4096]], pa.binary())], ["part", "cell", "id", "grp", "v"])

    return df.select("id", "part", "grp", "v").mapInArrow(run, "part string, cell int, id long, grp string, v binary")


def _packed(rows: DataFrame, size: int, number: str) -> DataFrame:
    """Rows of each (part, cell) in packs of about ``size``: a cell with more is dealt over as many packs as it needs."""
    rows = written(rows)
    crowded = rows.groupBy("part", "cell").agg(F.count("*").alias("n")).where(F.col("n") > size).withColumn("packs", F.ceil(F.col("n") / size).cast("int")).drop("n")
    dealt = rows.join(crowded, ["part", "cell"], "left").withColumn(number, F.pmod(F.xxhash64("id", F.lit(number)), F.coalesce("packs", F.lit(1))).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "cell": pdf["cell"].iloc[:1], number: pdf[number].iloc[:1], "ids": [list(pdf["id"])], "grps": [list(pdf["grp"])], "m": [b"".join(pdf["v"])]})

    return dealt.groupBy("part", "cell", number).applyInPandas(pack, f"part string, cell int, {number} int, ids array<long>, grps array<string>, m binary")


def _best(width: int, k: int):
    """The best ``k`` of one tile for each query of the blocks that it meets; a task holds one tile and at most AT_ONCE blocks at a time."""

    def run(tile: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for r in tile.to_pylist():  # one row
            x, ids, groups = np.frombuffer(r["m"], "<f8").reshape(-1, width), np.array(r["ids"]), np.array(r["grps"], object)
            for i in range(blocks.num_rows):
                b = blocks.slice(i, 1).to_pylist()[0]
                q, asked, own = np.frombuffer(b["q_m"], "<f8").reshape(-1, width), np.array(b["q_ids"]), np.array(b["q_grps"], object)
                for lo in range(0, len(q), 256):
                    sim = q[lo : lo + 256] @ x.T
                    bar = asked[lo : lo + 256, None] == ids[None, :]
                    if any(g is not None for g in own[lo : lo + 256]):
                        bar |= (own[lo : lo + 256, None] == groups[None, :]) & np.array([g is not None for g in groups])[None, :]
                    sim[bar] = -np.inf
                    rounded = np.round(sim, 9)
                    if len(ids) > 4 * k:  # all that tie with the k-th stay, so that ids decide
                        edge = np.partition(rounded, len(ids) - k, axis=1)[:, len(ids) - k]
                    else:
                        edge = np.full(len(sim), -np.inf)
                    for j in range(len(sim)):
                        at = np.flatnonzero((rounded[j] >= edge[j]) & (rounded[j] > -np.inf))
                        at = at[np.lexsort((ids[at], -rounded[j][at]))][:k]
                        out.append((np.full(len(at), asked[lo + j]), ids[at], sim[j][at]))
        q, v, sim = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        part = tile.column("part")[0].as_py() if tile.num_rows else ""
        return pa.table([pa.array([part] * len(q), pa.string()), pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64())], ["part", "q", "v", "sim"])

    return run


def _searched(index: DataFrame, queries: DataFrame, width: int, k: int, centres: dict, visits: dict) -> DataFrame:
    cell, pair = ["part", "cell"], ["part", "cell", "tile", "some"]
    tiles = written(_packed(_placed(index, width, centres, None), TILE, "tile"))
    blocks = written(_packed(_placed(queries, width, centres, visits), BLOCK, "block").withColumn("some", F.floor(F.col("block") / AT_ONCE).cast("int")))
    # each tile meets a few blocks of its cell in a group of its own: what a task holds at a time doesn't depend on the size of a part
    left = tiles.join(blocks.select(*cell, "some").distinct().hint("merge"), cell)
    right = blocks.join(tiles.select(*cell, "tile").hint("merge"), cell).select(*[F.col(c).alias(f"q_{c}") for c in (*pair, "ids", "grps", "m")])
    lists = left.groupBy(*pair).cogroup(right.groupBy(*[f"q_{c}" for c in pair])).applyInArrow(_best(width, k), "part string, q long, v long, sim double")
    rank = F.row_number().over(Window.partitionBy("part", "q").orderBy(F.desc(F.bround("sim", 9)), "v"))
    return lists.withColumn("r", rank).where(F.col("r") <= k)


def _share(c: str, wanted: dict[str, float]) -> Column:
    """Whether a row is in the sample: by the hash of its id, a share for each part."""
    out = F.lit(0.0)
    for p, share in wanted.items():
        out = F.when(F.col("part") == p, share).otherwise(out)
    return F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1 << 20)) < out * (1 << 20)


def _firsts(df: DataFrame, count: dict[str, int], salt: str) -> dict[str, np.ndarray]:
    """Unit vectors of the given number of rows with the smallest hashes of each part; the caller bounds the number."""
    w = Window.partitionBy("part").orderBy(F.xxhash64("id", F.lit(salt)), "id")
    limit = F.lit(0)
    for p, n in count.items():
        limit = F.when(F.col("part") == p, n).otherwise(limit)
    rows = df.withColumn("at", F.row_number().over(w)).where(F.col("at") <= limit).select("part", "at", "id", "v").orderBy("part", "at").collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r.part, []).append((r.id, r.v))
    return out


def fit_cells(index: DataFrame, width: int, sizes: dict[str, int], k: int, recall: float, rounds: int = 6) -> tuple[dict, dict]:
    """Centres of each of the given parts by k-means on directions over a sample (EACH rows a cell), and the cells a query must visit so that they hold the share ``recall`` of its ``k`` nearest rows, measured with up to 300 rows
    of a part against its sample. Sums are added up in Spark; centres, 300 rows a part and their neighbours come to the driver."""
    spare = max(2, MOST_BYTES // (8 * width * max(1, len(sizes))))
    cells = {p: min(int(4 * math.sqrt(n)), spare, max(2, n // 4)) for p, n in sizes.items()}
    sample = written(index.where(_share("fit", {p: min(1.0, EACH * cells[p] / n) for p, n in sizes.items()})))
    unit = lambda x: x / np.maximum(1e-12, np.sqrt((x * x).sum(1)))[:, None]
    centres = {p: unit(np.array([v for _, v in rows])) for p, rows in _firsts(sample, cells, "start").items()}
    for _ in range(rounds):
        held = sample.sparkSession.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                x, parts = _rows(batch.column(1), width), np.array(batch.column(0).to_pylist(), object)
                for p in sorted(set(parts)):
                    own = x[parts == p]
                    total = sums.setdefault(p, np.zeros_like(held.value[p]))
                    np.add.at(total, (own @ held.value[p].T).argmax(1), own)
            for p, total in sorted(sums.items()):
                used = np.flatnonzero(total.any(1))
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array([total[c].tobytes() for c in used], pa.binary())], ["part", "cell", "total"])

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "cell": pdf["cell"].iloc[:1], "total": [sum(np.frombuffer(t, "<f8") for t in sorted(pdf["total"])).tobytes()]})

        moved = {p: c.copy() for p, c in centres.items()}
        for r in sample.select("part", "v").mapInArrow(run, "part string, cell int, total binary").groupBy("part", "cell").applyInPandas(merge, "part string, cell int, total binary").toLocalIterator():
            moved[r.part][r.cell] = np.frombuffer(r.total, "<f8")
        centres = {p: unit(c) for p, c in moved.items()}
        held.unpersist()
    asked = _firsts(sample, dict.fromkeys(sizes, 300), "ask")
    ids = [i for rows in asked.values() for i, _ in rows]
    found = _searched(sample, sample.where(F.col("id").isin(ids)), width, k, {}, {})
    pairs = found.join(sample.select("part", F.col("id").alias("v"), F.col("v").alias("x")).hint("merge"), ["part", "v"]).select("part", "q", "x").collect()  # at most 300 k rows a part
    visits = {}
    for p, c in centres.items():
        ranks = {i: np.argsort(np.argsort(-(np.array(v) @ c.T), kind="stable")) for i, v in asked.get(p, [])}
        seen = [ranks[r.q][(np.array(r.x) @ c.T).argmax()] for r in pairs if r.part == p and r.q in ranks]
        visits[p] = int(np.quantile(seen, recall, method="higher")) + 1 if seen else len(c)
    return centres, visits


def nearest(index: DataFrame, queries: DataFrame | None = None, k: int = 10, ident: str = "id", vector: str = "v", part: str | None = None, group: str | None = None, exact_below: int | None = None, recall: float = 0.97) -> DataFrame:
    """``part, q, v, r, sim``: the ``k`` nearest index rows of each query in its part, never itself nor a row of its own ``group``; ties (to nine digits) go to the smaller id.

    Without ``exact_below`` the result is exact. With it, parts of at least so many rows get an inverted file: every row is indexed, and cells are visited until the measured share ``recall`` of neighbours is expected.
    Vectors that are null, zero, of another width than most, or with null or non-finite components take no part, as queries or answers. A null part is the part named by the empty string; a null group bars nothing.
    """
    rows, width = _clean(_standard(index, ident, vector, part, group))
    asked = rows if queries is None else _clean(_standard(queries, ident, vector, part, group), width)[0]
    if not width:
        return rows.sparkSession.createDataFrame([], "part string, q long, v long, sim double, r int")
    centres, visits = {}, {}
    if exact_below is not None:
        rows = written(rows)
        sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= max(8, exact_below)).collect()}  # large parts only
        if sizes:
            centres, visits = fit_cells(rows.where(F.col("part").isin(list(sizes))), width, sizes, k, recall)
    return _searched(rows, asked, width, k, centres, visits)


def neighbour_features(found: DataFrame, targets: DataFrame, sharpness: float = 20.0) -> DataFrame:
    """``part, q``, the softmax-weighted mean of the neighbours' ``y``, the best and the mean of the five best similarities, and ln(1 + neighbours). ``targets`` has ``v, y``; neighbours without a target don't count."""
    w = F.exp((F.col("sim") - 1) * sharpness)
    met = found.join(targets, "v").where(F.col("y").isNotNull())
    return met.groupBy("part", "q").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("y"), F.max("sim").alias("best"), F.avg(F.when(F.col("r") <= 5, F.col("sim"))).alias("mean5"), F.log1p(F.count("*")).alias("n"))
