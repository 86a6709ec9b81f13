"""N-gram Jaccard join by a MinHash LSH forest with exact verification (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import components, cut, mix, partitions, small_batches, table, texts, tidy
from brindle.llm.licenses import LOWER

#: Trees, levels of a tree at most, bits of a path, company at a prefix that every text puts up with, documents of a block of exact verification, shingles of a block, columns of a tile.
TREES, LONGEST, PATH_BITS, COMPANY, BLOCK_DOCS, BLOCK_SHINGLES, TILE = 32, 8, 64, 32, 1024, 1 << 20, 4096
MEMO = 300_000
_RNG = np.random.default_rng(20240501)
MULTIPLY = _RNG.integers(1, 1 << 31, TREES * LONGEST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FLIP = _RNG.integers(0, 1 << 32, TREES * LONGEST, dtype=np.uint32)
#: The hash functions that each tree reads, one level after another: none is read twice, so that trees are independent.
PATHS = np.arange(TREES * LONGEST).reshape(TREES, LONGEST)


def evidence(threshold: float) -> np.ndarray:
    """For each depth, the logarithm of 1 / (chance that a pair at the threshold does not share that prefix of one tree). Trees add up."""
    return -np.log1p(-(min(threshold, 1 - 1e-9) ** np.arange(LONGEST + 1, dtype=float).clip(1e-9)))


def shortest_prefix(threshold: float, target: float) -> int:
    """Depth to which a prefix may be shortened: one level less than the depth at which all trees together reach the target, so that crowded trees can keep more."""
    whole = np.flatnonzero(TREES * evidence(threshold) >= -np.log1p(-target)).max(initial=1)
    return max(1, min(LONGEST, int(whole)) - 1)


def shape(threshold: float, target: float) -> tuple[int, int, int]:
    """Shortest prefix, levels and bits of a level: the shortest prefix has 32 bits or more."""
    least = shortest_prefix(threshold, target)
    levels = min(LONGEST, 2 * least)
    return least, levels, PATH_BITS // levels


class _Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        import xxhash

        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of n words; all words make one run where there are fewer; none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j]
    return np.unique(mix(h))


def word_hashes(memo: _Hashes, raw: bytes) -> np.ndarray:
    """Words are runs without ASCII white space; A-Z is lowered."""
    if len(memo) > MEMO:
        memo.clear()
    w = raw.translate(LOWER).split()
    return np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))


def signatures(sets: list[np.ndarray], functions: np.ndarray) -> np.ndarray:
    """MinHash signatures (32 bits a function) of sets that are not empty, by one pass over their concatenation for each function."""
    out = np.empty((len(sets), len(functions)), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= 1 << 16):
            size += len(sets[hi])
            hi += 1
        flat = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        for k, f in enumerate(functions):
            out[lo:hi, k] = np.minimum.reduceat((flat ^ FLIP[f]) * MULTIPLY[f], starts)
        lo = hi
    return out


SKETCH = "row long, doc_id long, h1 long, h2 long, n int, paths array<long>"


def paths_of(sets: list[np.ndarray], levels: int, bits: int) -> np.ndarray:
    """Of each set that is not empty its path in each tree: some bits of one MinHash value a level, the first level highest, so that the order of
    the numbers is the order of the trie."""
    sig = signatures(sets, PATHS[:, :levels].ravel()).reshape(len(sets), TREES, levels)
    out = np.zeros((len(sets), TREES), np.uint64)
    for level in range(levels):
        out = (out << np.uint64(bits)) | (mix(sig[:, :, level].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
    return out << np.uint64(PATH_BITS - levels * bits)


def _sketch(words: int, levels: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(word_hashes(memo, x), words) for x in texts(part.column(1))]
                full = [i for i, s in enumerate(sets) if len(s)]
                paths: list = [[] for _ in sets]
                if full:
                    for i, k in zip(full, paths_of([sets[i] for i in full], levels, bits).view(np.int64), strict=True):
                        paths[i] = k
                one = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
                two = np.array([int(mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(0), pa.array(one), pa.array(two), pa.array([len(s) for s in sets], pa.int32()), pa.array(paths, pa.list_(pa.int64()))], ["row", "doc_id", "h1", "h2", "n", "paths"])

    return run


def crowds(tree: np.ndarray, path: np.ndarray, least: int, levels: int, bits: int) -> np.ndarray:
    """For entries of tries in sorted order (tree, path): how many share each prefix of ``least`` to ``levels`` levels, by the common prefixes of neighbours."""
    out = np.zeros((len(path), levels - least + 1), np.int64)
    for k, depth in enumerate(range(least, levels + 1)):
        p = path >> np.uint64(PATH_BITS - depth * bits)
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (tree[1:] != tree[:-1])])) if len(p) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(p)]]))
        out[:, k] = np.repeat(size, size)
    return out


def _crowd(least: int, levels: int, bits: int):
    """Sorted entries of the tries, batch by batch; a run that goes on in the next batch counts less, which only makes its prefix look cheaper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, path = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            size = np.minimum(crowds(tree, path.view(np.uint64), least, levels, bits), (1 << 31) - 1).astype(np.int32)
            flat = pa.array(size.ravel(), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(np.arange(0, size.size + 1, size.shape[1], dtype=np.int32), flat)], ["id", "tree", "path", "crowd"])

    return run


def depths(crowd: np.ndarray, least: int, threshold: float, target: float) -> np.ndarray:
    """Depth to which a text shortens its prefix in each tree, from its crowds (texts x trees x depths from ``least``).

    Every tree starts with its whole path. The crowd that a text puts up with starts at COMPANY and doubles until the recall of its search reaches the target: each tree then goes up to the
    shortest prefix that no larger crowd shares. Uncrowded trees go up at once, crowded ones only where the others do not suffice. One partner more or less
    does not change a choice (but where the crowd is just at the limit), so that the choice does not shun the very pairs that are searched for.
    """
    levels = least + crowd.shape[2] - 1
    gain, want = evidence(threshold), -np.log1p(-target)
    out = np.full(crowd.shape[:2], levels)
    open_ = np.ones(len(crowd), bool)
    most = COMPANY
    while open_.any():
        fits = crowd[open_] <= most
        depth = np.where(fits.any(2), least + fits.argmax(2), levels)
        out[open_] = depth
        reached = (gain[depth].sum(1) >= want) | fits[:, :, 0].all(1)
        open_[np.flatnonzero(open_)[reached]] = False
        most *= 2
    return out


NODES = "id long, tree int, depth int, prefix long, searches boolean"


def _search(least: int, levels: int, bits: int, threshold: float, target: float):
    """Each text's searches, and its entries at the shorter prefixes where others may search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                ids, at = part.column(0).to_numpy(), part.column(1)
                row = np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy()))
                flat = at.flatten()
                tree, path = flat.field("tree").to_numpy(), flat.field("path").to_numpy().view(np.uint64)
                size = flat.field("crowd").flatten().to_numpy().reshape(len(tree), -1)
                crowd = np.ones((part.num_rows, TREES, levels - least + 1), np.int64)
                crowd[row, tree] = size
                depth = depths(crowd, least, threshold, target)[row, tree]
                rows = np.repeat(np.arange(len(row)), depth - least + 1)
                d = least + np.arange(len(rows)) - np.repeat(np.cumsum(depth - least + 1) - (depth - least + 1), depth - least + 1)
                prefix = (path[rows] >> (np.uint64(PATH_BITS) - (d * bits).astype(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[rows]]), pa.array(tree[rows].astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(prefix), pa.array(d == depth[rows])], ["id", "tree", "depth", "prefix", "searches"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(word_hashes(memo, x), words).tobytes() for x in texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(sets, pa.binary())], ["id", *part.schema.names[2:], "shingles"])

    return run


def jaccard(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarities of two lists of sets, by products of tiles of 0/1 matrices over the shingles that occur in both lists."""
    fa, fb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    common = np.intersect1d(fa, fb)
    if a is b:
        values, count = np.unique(fa, return_counts=True)
        common = values[count > 1]
    ka, kb = np.searchsorted(common, fa), np.searchsorted(common, fb)
    oa, ob = (ka < len(common)), (kb < len(common))
    oa[oa] = common[ka[oa]] == fa[oa]
    ob[ob] = common[kb[ob]] == fb[ob]
    ra, ka, rb, kb = ra[oa], ka[oa], rb[ob], kb[ob]
    both = np.zeros((len(a), len(b)), np.float32)
    tile = max(256, min(TILE, (1 << 24) // max(1, len(a) + len(b))))
    if len(common):
        order_a, order_b = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        ra, ka, rb, kb = ra[order_a], ka[order_a], rb[order_b], kb[order_b]
    for lo in range(0, len(common), tile):
        w = min(tile, len(common) - lo)
        x, y = np.zeros((len(a), w), np.float32), np.zeros((len(b), w), np.float32)
        s, e = np.searchsorted(ka, [lo, lo + w])
        x[ra[s:e], ka[s:e] - lo] = 1
        s, e = np.searchsorted(kb, [lo, lo + w])
        y[rb[s:e], kb[s:e] - lo] = 1
        both += x @ y.T
    na, nb = np.array([len(x) for x in a], float), np.array([len(x) for x in b], float)
    if a is b:
        both[np.arange(len(a)), np.arange(len(a))] = na
    return both / (na[:, None] + nb[None, :] - both)


def star_edges(link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """For each vertex of a block of links one edge to the smallest vertex of its component in the block."""
    li, lj = rows.copy(), cols.copy()
    big = np.int64((1 << 63) - 1)
    r, c = np.nonzero(link)
    if not len(r):
        return []
    while True:
        ni, nj = li.copy(), lj.copy()
        np.minimum.at(ni, r, lj[c])
        np.minimum.at(nj, c, ni[r])
        if (ni == li).all() and (nj == lj).all():
            break
        li, lj = ni, nj
    seen_r, seen_c = np.unique(r), np.unique(c)
    pairs = {(int(rows[i]), int(li[i])) for i in seen_r} | {(int(cols[j]), int(lj[j])) for j in seen_c}
    return [(a, b) for a, b in pairs if a != b and b != big]


LINKS = "id long, n_links long, other long"


def _verify(threshold: float):
    """Members of two blocks of a cluster (or one): links of each member, weighed by copies, and star edges of the links."""

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block").to_numpy()
        first, second = t.column("b1")[0].as_py(), t.column("b2")[0].as_py()
        ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        one = np.flatnonzero(block == first)
        two = one if first == second else np.flatnonzero(block == second)
        out: list[tuple] = []
        if len(one) and len(two):
            a = [sets[i] for i in one]
            b = a if first == second else [sets[i] for i in two]
            link = jaccard(a, b) >= threshold
            if first == second:
                link[np.arange(len(one)), np.arange(len(one))] = False
            for own, n in ((one, link @ copies[two]),) if first == second else ((one, link @ copies[two]), (two, link.T @ copies[one])):
                out += [(int(ids[i]), int(x), None) for i, x in zip(own, n, strict=True) if x]
            out += [(x, 0, y) for x, y in star_edges(link, ids[one], ids[two])]
        return pa.table({"id": pa.array([x[0] for x in out], pa.int64()), "n_links": pa.array([x[1] for x in out], pa.int64()), "other": pa.array([x[2] for x in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, target: float = 0.99999, id_col: str = "doc_id", text_col: str = "text", hashes: bool = False) -> DataFrame:
    """``doc_id, n_links, component_id, kept`` of every document: links are pairs of documents whose sets of word n-grams have a Jaccard
    similarity of at least ``threshold``.

    1. Documents with one set of shingles are a class; its smallest id stands for it. 2. Each class has a path in each tree of a forest, one MinHash value a level. 3. The paths that share their
    shortest prefix with another are sorted tree by tree, where common prefixes of neighbours tell how many texts share each prefix. 4. Each class shortens its prefixes, the
    uncrowded ones first, until its search finds a pair at the threshold with probability ``target``. A pair is a candidate if either finds the other. 5. Connected candidates make a cluster, dealt by
    path into blocks; blocks that share a searched prefix (and each with itself) are verified exactly, by products of 0/1 matrices. Links are
    counted there and never written as pairs.

    ``n_links`` counts other documents, copies included; ``component_id`` is the smallest id reachable by links, itself included; ``kept`` says that
    the document is the first of them. Texts with fewer words than n have one shingle of all words; texts without words (null, empty) link with
    nothing. Rows that repeat an id and a text are one document; each gets its row. Rows of one id with unequal texts are documents each, of which the smaller
    text comes first. ``hashes`` adds ``th``, which tells the documents of an id apart: xxhash64 of the text, or 0 where no id repeats. Rows with a null id take no part: 0 links, null component,
    kept. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    least, levels, bits = shape(threshold, target)
    parts = partitions(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = base.where("id is not null")
    unique = known.groupBy("id").count().where("count > 1").isEmpty()
    if not unique:  # documents get numbers that ascend with the id
        rows = known.select(F.col("id").alias("doc_id"), F.xxhash64("text").alias("th"))
        known = cut(known.distinct().orderBy("id", "text").select(F.monotonically_increasing_id().alias("v"), "id", "text"))
        names = known.select("v", F.col("id").alias("doc_id"), F.xxhash64("text").alias("th"))
        known = known.select(F.col("v").alias("id"), "text")
    sketch = cut(known.mapInArrow(tidy(_sketch(words, levels, bits)), SKETCH))
    real = sketch.where("n > 0")
    classes = cut(real.groupBy("h1", "h2").agg(F.min_by(F.struct("doc_id", "n", "paths"), "doc_id").alias("r"), F.count("*").alias("copies")).select("h1", "h2", F.col("r.doc_id").alias("id"), F.col("r.n").alias("n"), F.col("r.paths").alias("paths"), "copies"))
    entries = classes.select("id", F.posexplode("paths").alias("tree", "path")).withColumn("p", F.shiftrightunsigned("path", PATH_BITS - least * bits))
    shared = entries.groupBy("tree", "p").agg(F.count("*").alias("c")).where("c > 1").select("tree", "p")
    tries = entries.join(shared, ["tree", "p"], "left_semi").select("id", "tree", "path").repartitionByRange(parts, "tree", "path", "id").sortWithinPartitions("tree", "path")
    seen = tries.mapInArrow(tidy(_crowd(least, levels, bits)), "id long, tree int, path long, crowd array<int>")
    own = seen.groupBy("id").agg(F.collect_list(F.struct("tree", "path", "crowd")).alias("at"))
    nodes = cut(own.mapInArrow(tidy(_search(least, levels, bits, threshold, target)), NODES))
    node = ["tree", "depth", "prefix"]
    low = nodes.groupBy(*node).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("searches").alias("s")).where("s and low < high").select(*node, "low")
    # a text links to the smallest of all its prefixes, and that one to the others' smallest, which are few
    lows = nodes.join(low, node).groupBy("id").agg(F.collect_set("low").alias("lows")).withColumn("b", F.array_min("lows"))
    met = lows.select(F.col("id").alias("a"), "b").unionByName(lows.select(F.explode("lows").alias("a"), "b").distinct())
    cluster = components(met).select(F.col("v").alias("id"), F.col("component").alias("cluster"))
    # a cluster of several blocks is dealt by the shortest prefix of the first tree, so that likely partners share a block; a crowded prefix over several
    lead = F.shiftrightunsigned(F.col("paths")[0], PATH_BITS - least * bits).alias("lead")
    members = cluster.join(classes.select("id", lead, "n", "copies"), "id")
    groups = members.groupBy("cluster", "lead").agg(F.count("*").alias("docs"), F.sum("n").alias("all"))
    share = lambda part: F.greatest(F.ceil(F.col("docs") * part / BLOCK_DOCS), F.ceil(F.col("all") * part / BLOCK_SHINGLES))
    many = groups.groupBy("cluster").agg(F.sum("docs").alias("docs"), F.sum("all").alias("all")).select("cluster", share(1).alias("blocks")).where("blocks > 1")
    dealt = groups.join(many, "cluster").select("cluster", "lead", "blocks", share(8).alias("salts"))
    number = F.pmod(F.xxhash64("lead", F.pmod(F.xxhash64("id"), "salts")), "blocks")
    members = cut(members.join(dealt, ["cluster", "lead"], "left").select("id", "copies", F.col("blocks").isNotNull().alias("large"), F.when(F.col("blocks").isNull(), F.xxhash64("cluster")).otherwise(F.xxhash64("cluster", number)).alias("block")))
    searched = nodes.join(members.where("large").select("id", "block"), "id").join(low, node, "left_semi").select(*node, "block").distinct()
    sets = searched.groupBy(*node).agg(F.sort_array(F.collect_set("block")).alias("of")).where(F.size("of") > 1).select("of").distinct()
    across = sets.select("of", F.explode("of").alias("b1")).select("b1", F.explode("of").alias("b2")).where("b1 < b2").distinct()
    both = cut(across.unionByName(members.select(F.col("block").alias("b1"), F.col("block").alias("b2")).distinct()))
    asked = both.select(F.col("b1").alias("block"), "b1", "b2").unionByName(both.where("b1 < b2").select(F.col("b2").alias("block"), "b1", "b2"))
    with_sets = known.join(members.select("id", "copies", "block").hint("shuffle_hash"), "id").mapInArrow(tidy(_sets(words)), "id long, copies long, block long, shingles binary")
    pairs = with_sets.join(asked, "block")
    links = cut(pairs.groupBy("b1", "b2").applyInArrow(_verify(threshold), LINKS))
    joined = components(links.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    per = links.groupBy("id").agg(F.sum("n_links").alias("links")).join(joined.withColumnRenamed("v", "id"), "id", "left")
    whole = classes.select("h1", "h2", "id", "copies").join(per, "id", "left").select("h1", "h2", F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = real.select("doc_id", "h1", "h2").join(whole, ["h1", "h2"]).select("doc_id", "n_links", "component_id")
    alone = sketch.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    out = out.unionByName(alone)
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if unique:
        out = out.withColumn("th", F.lit(0).cast("long"))
    else:
        first = names.select(F.col("v").alias("component_id"), F.col("doc_id").alias("first"))
        out = out.withColumnRenamed("doc_id", "v").join(names, "v").join(first, "component_id").drop("component_id").withColumnRenamed("first", "component_id")
        out = rows.join(out.drop("v"), ["doc_id", "th"])
    lost = base.where("id is null").select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("th"))
    return out.unionByName(lost).select("doc_id", "n_links", "component_id", "kept", *["th"] * hashes)


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
