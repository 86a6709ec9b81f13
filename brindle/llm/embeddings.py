"""Embedding near-dedup by an epsilon grid order join (operator 2)."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import MB, components, cut, partitions, table, tidy
from brindle.llm.neardup import LINKS, star_edges

#: Vectors of a tile; bytes of a segment; segments of which the driver holds bounds; leading principal dimensions; vectors that the axes are fitted on; dimensions of the order.
TILE, SEGMENT, MOST_SEGMENTS, AXES, SAMPLE, ORDERED = 512, 24 * MB, 20_000, 12, 4096, 4
SLACK = 1e-9


def principal_axes(sample: np.ndarray, count: int = AXES) -> np.ndarray:
    """Orthonormal leading principal directions of unit vectors. Any orthonormal rows are right for the join; good ones skip more."""
    width = sample.shape[1]
    if len(sample) < 2:
        return np.eye(width)[:count]
    _, _, vt = np.linalg.svd(sample - sample.mean(0), full_matrices=len(sample) < width)
    return vt[:count]


def interval_pairs(lo: np.ndarray, hi: np.ndarray, eps: float, other: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """Recursive join of a sequence of boxes with itself (pairs i <= j) or with another sequence.

    Two intervals whose bounding boxes on the principal dimensions are more than ``eps`` apart are skipped whole; else the
    longer one is halved, down to single boxes.
    """
    lo2, hi2 = (lo, hi) if other is None else other
    box: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def bounds(side: int, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        at = (side, s, e)
        if at not in box:
            box[at] = (lo[s:e].min(0), hi[s:e].max(0)) if side == 0 else (lo2[s:e].min(0), hi2[s:e].max(0))
        return box[at]

    todo = [(0, len(lo), 0, len(lo2))] if len(lo) and len(lo2) else []
    while todo:
        s1, e1, s2, e2 = todo.pop()
        if other is None and e2 <= s1:
            continue
        (l1, h1), (l2, h2) = bounds(0, s1, e1), bounds(int(other is not None), s2, e2)
        gap = np.maximum(0, np.maximum(l1 - h2, l2 - h1))
        if float(gap @ gap) > eps * eps + SLACK:
            continue
        if e1 - s1 == 1 and e2 - s2 == 1:
            if other is not None or s1 <= s2:
                yield s1, s2
        elif other is None and (s1, e1) == (s2, e2):
            m = (s1 + e1) // 2
            todo += [(s1, m, s1, m), (m, e1, m, e1), (s1, m, m, e1)]
        elif e1 - s1 >= e2 - s2:
            m = (s1 + e1) // 2
            todo += [(s1, m, s2, e2), (m, e1, s2, e2)]
        else:
            m = (s2 + e2) // 2
            todo += [(s1, e1, s2, m), (s1, e1, m, e2)]


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows as double, brought near 1 by a power of two, which is exact, so that tiny and huge vectors have a length."""
    v = v.astype(np.float64)
    _, e = np.frexp(np.abs(v).max(1, initial=0.0))
    half = e // 2  # in two steps: one power of two alone could overflow
    return np.ldexp(np.ldexp(v, -half[:, None]), -(e - half)[:, None])


def links_between(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows have a cosine of at least the threshold, in double precision; values next to it are computed again with exact sums."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    cos = (a @ b.T) / na[:, None] / nb[None, :]
    link = cos >= threshold
    for i, j in np.argwhere(np.abs(cos - threshold) < 1e-12):
        x, y = a[i], b[j]
        link[i, j] = math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y))) >= threshold
    return link


def tiles(p: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of tiles of consecutive rows and the bounds of each on the principal dimensions."""
    starts = np.arange(0, len(p), size)
    return starts, np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)


@dataclass
class Rows:
    """Classes of one label in epsilon grid order: smallest id, copies, vectors (scaled), principal coordinates."""

    ids: np.ndarray
    copies: np.ndarray
    v: np.ndarray
    p: np.ndarray


def join_rows(a: Rows, b: Rows | None, eps: float, threshold: float, tile: int) -> Iterator[tuple[int, int, int | None]]:
    """Links of ``a`` with itself or with ``b``, tile by tile, without tiles that are provably distant: counts of each row, weighed by copies, and star edges."""
    sa, la, ha = tiles(a.p, tile)
    other = b if b is not None else a
    sb, lb, hb = (sa, la, ha) if b is None else tiles(b.p, tile)
    na, nb = np.zeros(len(a.ids), np.int64), np.zeros(len(other.ids), np.int64)
    for i, j in interval_pairs(la, ha, eps, None if b is None else (lb, hb)):
        x, y = slice(sa[i], sa[i] + tile), slice(sb[j], sb[j] + tile)
        link = links_between(a.v[x], other.v[y], threshold)
        if b is None and i == j:
            np.fill_diagonal(link, False)
            na[x] += link @ a.copies[x]
        else:
            na[x] += link @ other.copies[y]
            (na if b is None else nb)[y] += link.T @ a.copies[x]
        for one, two in star_edges(link, a.ids[x], other.ids[y]):
            yield one, 0, two
    for ids, n in ((a.ids, na),) if b is None else ((a.ids, na), (b.ids, nb)):
        for at in np.flatnonzero(n):
            yield int(ids[at]), int(n[at]), None


def _order(axes: np.ndarray, eps: float):
    """Cells of the leading principal dimensions of each vector, which order the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = project(padded(batch.column(2), axes.shape[1]), axes)
            cells = [pa.array(np.floor(p[:, d] / eps).astype(np.int32)) if d < p.shape[1] else pa.array(np.zeros(len(p), np.int32)) for d in range(ORDERED)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], [*batch.schema.names, *(f"g{d}" for d in range(ORDERED))])

    return run


def padded(lists: pa.Array, width: int) -> np.ndarray:
    """A matrix of the lists, shorter ones padded with zeros, of at least ``width`` columns."""
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))), flat.dtype)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out


def project(v: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Principal coordinates of the unit vectors; components beyond the axes' width do not count, which only makes distances smaller."""
    x = scaled(v)
    return (x[:, : axes.shape[1]] / np.sqrt((x * x).sum(1))[:, None]) @ axes.T


#: Rows of the joined table: links, members of a class beyond its first, and segments (their vectors, and the bounds of their first and last label).
PIECES = "kind int, id long, n_links long, other long, label string, blob binary, lo array<double>, hi array<double>"
LINK, MEMBER, SEGMENT_ROW = 0, 1, 2
NAMES = [x.split()[0] for x in PIECES.split(", ")]


def _pieces(kind: int, id: list, n_links: list, other: list, label: list, blob: list, lo: list, hi: list) -> pa.RecordBatch:
    n = len(id)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), *(pa.array(c or [None] * n, t) for c, t in zip((id, n_links, other, label, blob, lo, hi), kinds, strict=True))], NAMES)


def link_rows(found: Iterator[tuple[int, int, int | None]]) -> Iterator[pa.RecordBatch]:
    rows = []
    for r in found:
        rows.append(r)
        if len(rows) >= 20_000:
            yield _pieces(LINK, *map(list, zip(*rows, strict=True)), [], [], [], [])
            rows = []
    if rows:
        yield _pieces(LINK, *map(list, zip(*rows, strict=True)), [], [], [], [])


def _segments(axes: np.ndarray, eps: float, threshold: float, size: int, tile: int):
    """Sorted vectors of a partition, segment by segment. Equal neighbours of a label become one class. Each label of a segment is joined with itself at once; vectors leave the
    task only for the first and the last label of a segment, which may go on in other segments."""

    def one(seq: int, batches: list[pa.RecordBatch], edge: bool) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        label, ids = t.column(1), t.column(0).to_numpy()
        v = padded(t.column(2), axes.shape[1])
        code = label.dictionary_encode().indices.to_numpy()
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (v[1:] != v[:-1]).any(1)])
        first = np.flatnonzero(new)
        rep = np.minimum.reduceat(ids, first)
        group = np.cumsum(new) - 1
        more = np.flatnonzero(ids != rep[group])
        for lo in range(0, len(more), 100_000):
            x = more[lo : lo + 100_000]
            yield _pieces(MEMBER, ids[x].tolist(), [], rep[group[x]].tolist(), [], [], [], [])
        copies, raw, code = np.diff(np.concatenate([first, [len(ids)]])), v[first], code[first]
        rows = Rows(rep, copies, scaled(raw), project(raw, axes))
        starts = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]])
        for k, (s, e) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            part = Rows(rows.ids[s:e], rows.copies[s:e], rows.v[s:e], rows.p[s:e])
            yield _pieces(MEMBER, part.ids.tolist(), [], part.ids.tolist(), [], [], [], [])
            yield from link_rows(join_rows(part, None, eps, threshold, tile))
            for at in range(0, e - s, 8 * tile):
                yield from link_rows(((int(i), int(c) - 1, None) for i, c in zip(part.ids[at : at + 8 * tile], part.copies[at : at + 8 * tile], strict=True) if c > 1))
            if edge and k in (0, len(starts) - 2):
                blob = pickle.dumps((part.ids, part.copies, raw[s:e]), protocol=5)
                number = (TaskContext.get().partitionId() << 32) + 2 * seq + int(k > 0)
                yield _pieces(SEGMENT_ROW, [number], [], [], [label[int(first[s])].as_py()], [blob], [part.p.min(0).tolist()], [part.p.max(0).tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_rows, seq = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - held_rows)
                held.append(part)
                held_rows += part.num_rows
                at += part.num_rows
                if held_rows >= size:
                    yield from one(seq, held, True)
                    held, held_rows, seq = [], 0, seq + 1
        if held:
            yield from one(seq, held, True)

    return run


PARTS = "a long, b long, side int, blob binary"


def _send(held, axes: np.ndarray, eps: float):
    """Each segment to the segments of its label that may be near, found by the recursion against the bounds of all; only rows within ``eps`` of the other's bounds go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = held.value
        for batch in batches:
            for number, label, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                numbers, lo, hi = bounds[label]
                if len(numbers) < 2:
                    continue
                ids, copies, v = pickle.loads(blob)
                p = project(v, axes)
                for _, j in interval_pairs(p.min(0)[None], p.max(0)[None], eps, (lo, hi)):
                    to = int(numbers[j])
                    if to == number:
                        continue
                    gap = np.maximum(0, np.maximum(lo[j] - p, p - hi[j]))
                    near = np.flatnonzero((gap * gap).sum(1) <= eps * eps + SLACK)
                    if len(near):
                        part = pickle.dumps((ids[near], copies[near], v[near]), protocol=5)
                        yield pa.RecordBatch.from_arrays([pa.array([min(number, to)]), pa.array([max(number, to)]), pa.array([int(number > to)], pa.int32()), pa.array([part], pa.binary())], ["a", "b", "side", "blob"])

    return run


def _meet(axes: np.ndarray, eps: float, threshold: float, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, None
        for batch in batches:
            for a, b, side, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, copies, v = pickle.loads(blob)
                rows = Rows(ids, copies, scaled(v), project(v, axes))
                if side == 0:
                    now, first = (a, b), rows
                elif now == (a, b):  # a side without rows near the other is not sent
                    w = max(first.v.shape[1], rows.v.shape[1])
                    wide = [Rows(r.ids, r.copies, np.pad(r.v, ((0, 0), (0, w - r.v.shape[1]))), r.p) for r in (first, rows)]
                    for out in link_rows(join_rows(*wide, eps, threshold, tile)):
                        yield out.select(["id", "n_links", "other"])

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", tile: int = TILE, segment: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: links are pairs of equal label (not null) with a cosine of at least ``threshold``.

    Unit vectors at that cosine are at most eps = sqrt(2 - 2 threshold) apart, in any orthonormal projection too. Rows are sorted by label and by the eps-cells of their
    leading principal dimensions (axes fitted on a sample of at most SAMPLE vectors; any axes give the same links); equal vectors, which then are neighbours, become classes. A
    task cuts its rows into segments (of ``segment`` rows, else of at most SEGMENT bytes), small labels together, and joins each with itself by recursion over tiles, skipping intervals
    whose bounds are farther apart than eps. What a label's segments have near each other's bounds is sent once for each such pair and joined in the same way. Links are counted there and never written as
    pairs; the driver holds the bounds of at most about MOST_SEGMENTS segments, and each segment finds its partners in its own task.

    ``n_links`` counts other vectors, equal ones included. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, like rows whose
    label or id is null; shorter vectors count as padded with zeros. Rows that repeat an id count as vectors of their own. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    v = F.col(vec_col).cast("array<float>" if single else "array<double>")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    base = base.withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = base.where("fine").select("id", "label", "v")
    unique = rows.groupBy("id").count().where("count > 1").isEmpty()
    if not unique:  # vectors get numbers that ascend with the id
        numbered = cut(rows.orderBy("id", "label", "v").select(F.monotonically_increasing_id().alias("number"), "id", "label", "v"))
        rows = numbered.select(F.col("number").alias("id"), "label", "v")
    number, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    share = min(1.0, 2 * SAMPLE / max(1, number))
    sample = rows.where(F.pmod(F.xxhash64("v", F.lit("axes")), F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").toPandas()["v"].tolist()
    fit = np.zeros((len(sample), width or 1))
    for i, x in enumerate(sample):
        fit[i, : len(x)] = np.asarray(x, float)
    fit = scaled(fit)
    axes = principal_axes(fit / np.sqrt((fit * fit).sum(1))[:, None] if len(fit) else fit)
    cells = [f"g{d}" for d in range(ORDERED)]
    ordered = rows.mapInArrow(tidy(_order(axes, max(eps, 1e-6))), f"id long, label string, v {'array<float>' if single else 'array<double>'}, " + ", ".join(f"{c} int" for c in cells))
    size = segment or max(tile, SEGMENT // ((4 if single else 8) * (width or 1)), -(-number // MOST_SEGMENTS))
    key = ["label", *cells, "v", "id"]
    dealt = ordered.repartitionByRange(partitions(spark), *key).sortWithinPartitions(*key).select("id", "label", "v")
    pieces = cut(dealt.mapInArrow(tidy(_segments(axes, eps, threshold, size, tile)), PIECES))
    segments = pieces.where(F.col("kind") == SEGMENT_ROW)
    bounds: dict[str, list] = {}
    for r in segments.select("id", "label", "lo", "hi").orderBy("id").toLocalIterator():
        bounds.setdefault(r["label"], []).append((r["id"], r["lo"], r["hi"]))
    table_of = {k: (np.array([x[0] for x in b], np.int64), np.array([x[1] for x in b]), np.array([x[2] for x in b])) for k, b in bounds.items()}
    held = spark.sparkContext.broadcast(table_of)
    again = [k for k, b in bounds.items() if len(b) > 1]
    links = pieces.where(F.col("kind") == LINK).select("id", "n_links", "other")
    if again:
        sent = segments.select("id", "label", "blob").mapInArrow(tidy(_send(held, axes, eps)), PARTS).repartition(partitions(spark), "a", "b").sortWithinPartitions("a", "b", "side")
        links = links.unionByName(cut(sent.mapInArrow(tidy(_meet(axes, eps, threshold, tile)), LINKS)))
    joined = components(links.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    per = links.groupBy("id").agg(F.sum("n_links").alias("links")).join(joined.withColumnRenamed("v", "id"), "id", "left")
    members = pieces.where(F.col("kind") == MEMBER).select(F.col("id").alias("vec_id"), F.col("other").alias("id"))
    out = members.join(per, "id", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    if not unique:
        names = numbered.select("number", "id")
        out = out.withColumnRenamed("vec_id", "number").join(names.withColumnRenamed("id", "vec_id"), "number").drop("number")
        out = out.withColumnRenamed("component_id", "number").join(names.withColumnRenamed("id", "component_id"), "number").select("vec_id", "n_links", "component_id")
    rest = base.where("not fine").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
