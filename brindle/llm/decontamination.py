"""Benchmark decontamination by a prefix-filtered set join (operator 11).

A benchmark item's windows are sets of shingles. Shingles are ordered by how often the documents hold them; a window that stands whole in a document shares each of its shingles, so joining
its rarest one (the necessary prefix at full containment) finds every place. Where the shingle stands in the window and how long the window is say where the window would have to start and end; what fits is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import Memo, cut, drop_cut, mix, small_batches, table, texts, tidy, word_stream

#: Bits of the filter of shingles for each of them, and the most altogether (32 MB).
BITS_EACH, MOST_BITS = 32, 1 << 28
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hasher() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words, given by their hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * MULTIPLIER + words[j : j + n]
    return mix(out)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """``item`` (id as text) and ``window`` (its words joined by spaces) for each place of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(texts(batch.column(1))):
                low, at, _, _ = word_stream([x], Memo(len), np.uint64)
                n = len(at)
                if not n:
                    continue
                size = min(n, window)
                for lo in range(0, n - size + 1, 10_000):  # a long item goes out piece by piece
                    stop = min(lo + 10_000, n - size + 1)
                    words = low[at[lo] : at[stop + size - 1] if stop + size - 1 < n else len(low)].split()
                    own = [b" ".join(words[j : j + size]) for j in range(stop - lo)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(own)), pa.array(own, pa.binary()).cast(pa.string())], ["item", "window"])

    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "item string, window string")


def window_shingles(windows: DataFrame, k: int) -> DataFrame:
    """``window, size, k, offset, token``: all shingles of each window; one of fewer than ``k`` words is a shingle as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _hasher()
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.column(0).slice(lo, 4000)
                _, _, values, first = word_stream(texts(part), memo, np.uint64)
                which, offset, token, own = [], [], [], []
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    t = shingles(values[a:b], min(k, b - a))
                    which.append(np.full(len(t), i))
                    offset.append(np.arange(len(t)))
                    token.append(t)
                    own.append(np.full(len(t), b - a))
                which, offset, token, own = (np.concatenate(x) for x in (which, offset, token, own))
                yield pa.RecordBatch.from_arrays([part.take(pa.array(which)), pa.array(own, pa.int32()), pa.array(np.minimum(own, k), pa.int32()), pa.array(offset, pa.int32()), _signed(token)], ["window", "size", "k", "offset", "token"])

    return windows.mapInArrow(tidy(run), "window string, size int, k int, offset int, token long")


def token_filter(tokens: DataFrame) -> np.ndarray:
    """Bits of two hashes of every token: a Bloom filter of at most ``MOST_BITS`` bits, whatever the number of tokens. More tokens only let more places through, which the join drops."""
    n = tokens.count()
    bits = 1 << 10
    while bits < min(MOST_BITS, BITS_EACH * n):
        bits *= 2
    at = tokens.select(F.explode(F.array(F.col("token").bitwiseAND(bits - 1), F.shiftrightunsigned("token", 32).bitwiseAND(bits - 1))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    last = np.uint64(len(bits) * 64 - 1)
    out = np.ones(len(tokens), bool)
    for shift in (0, 32):
        at = (tokens >> np.uint64(shift)) & last
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return out


def _places(values: np.ndarray, first: np.ndarray, kinds: list[int], bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of shingles: the words at which those of the filter start, their texts and their hashes. No shingle reaches over two texts."""
    for k in kinds:
        tokens = shingles(values, k)
        at = np.flatnonzero(_passes(tokens, bits))
        of = np.searchsorted(first, at, "right") - 1
        fits = at + k <= first[of + 1]
        yield k, at[fits], of[fits], tokens[at[fits]]


def shingle_counts(docs: DataFrame, tokens: DataFrame, kinds: list[int]) -> DataFrame:
    """How often all texts together hold each of the given shingles (``token, n``; other tokens that pass the filter come along)."""
    bits = docs.sparkSession.sparkContext.broadcast(token_filter(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _hasher()
        for batch in batches:
            _, _, values, first = word_stream(texts(batch.column(0)), memo, np.uint64)
            got, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for *_, t in _places(values, first, kinds, bits.value))]), return_counts=True)
            if len(got):
                yield pa.RecordBatch.from_arrays([_signed(got), pa.array(n)], ["token", "n"])

    return docs.select("text").mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def candidate_places(docs: DataFrame, tokens: DataFrame, kinds: list[int], window: int) -> DataFrame:
    """One row per text (``row, doc_id, n_words``, no token) and one per place of a token of the filter: ``row, token, at`` (the word where it starts), ``before`` and the words around it, as far as a window can reach."""
    bits = docs.sparkSession.sparkContext.broadcast(token_filter(tokens))
    shortest = min(kinds, default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _hasher()
        for batch in batches:
            raw = texts(batch.column(2))
            low, starts, values, first = word_stream(raw, memo, np.uint64)
            rows, nothing = batch.column(0), pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([rows, batch.column(1), pa.array(np.diff(first)), nothing.cast(pa.int64()), nothing.cast(pa.int64()), nothing.cast(pa.int64()), nothing.cast(pa.string())], NAMES)
            ends = np.append(starts, len(low) + 1)
            for _k, at, of, token in _places(values, first, kinds, bits.value):
                lo, hi = np.maximum(first[of], at - (window - shortest)), np.minimum(first[of + 1], at + window)
                for a in range(0, len(at), 20_000):
                    b = slice(a, a + 20_000)
                    around = [b" ".join(low[x:y].split()) for x, y in zip(starts[lo[b]].tolist(), ends[hi[b]].tolist(), strict=True)]
                    null = pa.nulls(len(around), pa.int64())
                    yield pa.RecordBatch.from_arrays([rows.take(pa.array(of[b])), null, null, _signed(token[b]), pa.array(at[b] - first[of[b]]), pa.array(at[b] - lo[b]), pa.array(around, pa.binary()).cast(pa.string())], NAMES)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(tidy(run), "row long, doc_id long, n_words long, token long, at long, before long, around string")


NAMES = ["row", "doc_id", "n_words", "token", "at", "before", "around"]


def contaminated_places(places: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``row, start, size, window`` of every place where a window stands, exactly compared: the token joins, its position must leave room for the window on both sides, then the words must be the window's."""
    met = places.where("token is not null").join(prefixes, "token")
    words = F.split("around", " ")
    room = (F.col("before") >= F.col("offset")) & (F.size(words) - F.col("before") >= F.col("size") - F.col("offset"))
    same = F.array_join(F.slice(words, (F.col("before") - F.col("offset") + 1).cast("int"), F.col("size")), " ") == F.col("window")
    return met.where(F.when(room, same).otherwise(False)).select("row", (F.col("at") - F.col("offset")).alias("start"), "size", "window")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words of each document that lie in a place where ``window`` consecutive words of an item stand (an item of fewer words: all of them), and the items found.

    One row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256`` (of the found ids as text, sorted and joined by commas), ``contaminated``. Words: runs of ASCII letters, digits and characters above 127, A-Z lowered.
    Null and empty texts have no words; items without words match nothing; an item without an id hits words but isn't listed; items of one id count once. Rows of one id are documents each. Empty tables give an empty
    table, or documents without hits. Only ids and texts are read, so other columns can't clash. The work on documents is two scans; only places of needed shingles move. ``shingle`` may be any length up to ``window``.
    """
    if not 0 < shingle <= window:
        raise ValueError("a shingle is at least one word and at most a window")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    owners = cut(item_windows(items, window, item_id, item_text).distinct())
    grams = cut(window_shingles(owners.select("window").distinct(), shingle))
    kinds = sorted(r.k for r in grams.select("k").distinct().collect())  # at most ``shingle`` lengths
    # rarest first; a window with a shingle that no document holds stands nowhere
    counts = shingle_counts(docs, grams.select("token").distinct(), kinds)
    rated = grams.join(counts, "token", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest"))
    prefixes = cut(rated.where("rarest.n > 0").select("rarest.token", "rarest.offset", "size", "window"))
    places = cut(candidate_places(docs, prefixes.select("token").distinct(), kinds, window))
    found = cut(contaminated_places(places, prefixes))
    drop_cut(grams)
    # words covered: each place adds what lies beyond the places before it
    before = F.max(F.col("start") + F.col("size")).over(Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    own = found.select("row", "start", "size").distinct().withColumn("reach", before)
    hit = own.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", F.coalesce("reach", "start")))).alias("n_hit"))
    # windows of the same items are one kind, and documents of the same kinds share one list of items
    kind = owners.where("item is not null").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("kind", F.sha2(F.array_join("items", ","), 256))
    kind = cut(kind.join(found.select("window").distinct(), "window", "left_semi"))
    sets = found.select("row", "window").distinct().join(kind.select("window", "kind"), "window").groupBy("row").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).withColumn("list", F.sha2(F.array_join("kinds", ","), 256))
    sets = cut(sets)
    lists = sets.groupBy("list").agg(F.first("kinds").alias("kinds")).select("list", F.explode("kinds").alias("kind")).join(kind.groupBy("kind").agg(F.first("items").alias("items")), "kind")
    lists = lists.select("list", F.explode("items").alias("item")).groupBy("list").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lists = lists.select("list", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    listed = sets.select("row", "list").join(lists, "list").drop("list")
    out = places.where("token is null").select("row", "doc_id", "n_words").join(hit.join(listed, "row", "left"), "row", "left")
    none = F.sha2(F.lit(""), 256)
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""with docs as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
sized as (select item_id, ws, least(len(ws), 10) n from items where len(ws) > 0),
windows as (select item_id, n, array_to_string(ws[i:i + n - 1], ' ') w from (select *, unnest(range(1, len(ws) - n + 2)) i from sized)),
sizes as (select distinct n from windows), known as (select distinct n, w from windows),
grams as (select r, n, i, array_to_string(ws[i:i + n - 1], ' ') w from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) i from docs, sizes)),
found as (select r, n, i, w from grams join known using (n, w)),
hits as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from found) group by r),
owned as (select distinct r, item_id::varchar item from (select distinct r, n, w from found) join windows using (n, w) where item_id is not null),
lists as (select r, count(*) n_items, sha256(string_agg(item, ',' order by item)) items_sha256 from owned group by r)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from docs left join hits using (r) left join lists using (r)"""
