"""Importance resampling towards a target distribution by external sort-count (operator 12)."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import Memo, cut, drop_cut, small_batches, steady_scans, table, texts, tidy, word_stream

#: Features of one row of the stream table, if no single text has more.
ROW = 1 << 20
STREAM = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("offsets", pa.binary()), ("stream", pa.binary())])


def _runs(words: list[bytes], longest: int, buckets: int) -> Iterator[int]:
    """Buckets of all runs of 1 to ``longest`` words; the checksum of a run grows word by word."""
    for i in range(len(words)):
        crc = zlib.crc32(words[i])
        yield crc % buckets
        for w in words[i + 1 : i + longest]:
            crc = zlib.crc32(w, zlib.crc32(b" ", crc))
            yield crc % buckets


def bucket_streams(docs: DataFrame, longest: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs each block of texts into one row: ids, numbers of words, where each text's features start (int64, one more at the end) and their buckets (uint16).

    Features are all runs of 1 to ``longest`` words joined by a space; the bucket is the crc32 of their bytes modulo ``buckets`` (at most 65,536). A null or empty text has no features, but a place.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket must fit in 16 bits")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda w: zlib.crc32(w) % buckets)
        for batch in batches:
            ids, raw = batch.column(0), texts(batch.column(1))
            low, at, values, first = word_stream(raw, memo, np.uint16)
            n_words = np.diff(first)
            if longest > 1:
                ends = np.cumsum([len(x) + 1 for x in raw]) - 1
                own = [np.fromiter(_runs(low[e - len(x) : e].split(), longest, buckets), np.uint16) for x, e in zip(raw, ends.tolist(), strict=True)]
                first, values = np.cumsum([0, *map(len, own)]), np.concatenate([np.zeros(0, np.uint16), *own])
            lo = 0
            while lo < len(raw):
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + ROW, "right")) - 1)
                hi = min(hi, len(raw))
                row = {
                    "doc_ids": [ids.slice(lo, hi - lo).to_pylist()], "n_words": [n_words[lo:hi].tolist()], "offsets": [(first[lo : hi + 1] - first[lo]).astype("<i8").tobytes()],
                    "stream": [values[first[lo] : first[hi]].astype("<u2").tobytes()],
                }
                yield pa.RecordBatch.from_pydict(row, schema=STREAM)
                lo = hi

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_ids array<long>, n_words array<long>, offsets binary, stream binary")


def count_buckets(streams: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Features of each bucket: every row's stream is sorted and run-length encoded, the runs of a task are added up, those of all tasks by one aggregation with a row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                stream = np.sort(np.frombuffer(packed.as_buffer(), "<u2"), kind="stable")
                heads = np.flatnonzero(np.diff(stream, prepend=stream[:1] ^ 1)) if len(stream) else np.zeros(0, np.int64)
                total[stream[heads]] += np.diff(heads, append=len(stream))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], ["bucket", "n"])

    sums = streams.select("stream").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row per bucket
    out = np.zeros(buckets, np.int64)
    for r in sums:
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of B buckets: how much likelier a feature is in the target than in the source, with one added to each bucket."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 G) of a Gumbel variable G drawn from the hash of seed and id; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least: int = 20, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Draws ``percent`` percent of the documents with at least ``least`` words by weight, without replacement (the highest of weight plus Gumbel noise).

    One row per input row: ``doc_id, n_words, n_features, weight, score, rank`` (null if not drawn). ``weight`` is the floored mean gain of a document's features, 0 without features. Ties in score go to the
    smaller id (null last), then to fewer features, then to the smaller weight; rows of one id are documents each. Null and empty texts have no words. An empty table gives an empty table; with an empty target
    all gains come from the added ones. Only id and text are read, so other columns can't clash. Texts are taken whole: the stream holds two bytes a feature.
    """
    spark = docs.sparkSession
    steady_scans(spark)
    streams = cut(bucket_streams(docs, longest, buckets, id_col, text_col))
    gains = bucket_gains(count_buckets(streams, buckets), count_buckets(bucket_streams(target.withColumn("__none", F.lit(None).cast("long")), longest, buckets, "__none", target_text), buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                offsets = np.frombuffer(batch.column(2)[i].as_buffer(), "<i8")
                stream = np.frombuffer(batch.column(3)[i].as_buffer(), "<u2")
                n = np.diff(offsets)
                weight = np.zeros(len(n), np.int64)
                some = np.flatnonzero(n)
                if len(some):
                    weight[some] = np.add.reduceat(gains[stream], offsets[some]) // n[some]
                score = weight + np.array([noise(d, seed) for d in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(n), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    scored = cut(streams.mapInArrow(tidy(weigh), "doc_id long, n_words long, n_features long, weight long, score long").withColumn("able", F.col("n_words") >= least))
    drop_cut(streams)
    drawn = scored.where("able").count() * percent // 100
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    parts = cut(scored.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    drop_cut(scored)
    before, at = [], 0
    for r, n in sorted((r.range, r.n) for r in parts.groupBy("range").agg(F.count("*").alias("n")).collect()):  # a row per range
        before.append((r, at))
        at += n
    before = spark.createDataFrame(before, "range int, before long").coalesce(1)
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    return parts.join(F.broadcast(before), "range").withColumn("rank", rank).select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Word buckets by a bitwise crc32 over the bytes of each distinct word.
OP12_SQL = r"""with docs as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
bench as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w from benchmark),
words as (select r, unnest(ws) w from docs),
known as (select distinct w from (select w from words union all select w from bench)),
hashed as (select w, xor(list_reduce(list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(w), 2 * i - 1, 2))::bigint), lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::bigint), 4294967295::bigint) % 10000 b from known),
own as (select r, b from words join hashed using (w)),
s as (select b, count(*) n from own group by b), t as (select b, count(*) n from bench join hashed using (w) group by b),
sums as (select (select coalesce(sum(n), 0) from s)::double s, (select coalesce(sum(n), 0) from t)::double t),
gains as (select b, floor(1000 * ln((coalesce(t.n, 0)::double + 1) * (sums.s + 10000) / ((s.n::double + 1) * (sums.t + 10000))))::bigint g from s left join t using (b), sums),
weights as (select r, floor(sum(g)::double / count(*))::bigint w from own join gains using (b) group by r),
scored as (select r, doc_id, len(ws)::bigint n, coalesce(w, 0) w, coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score from docs left join weights using (r)),
ranked as (select r, row_number() over (order by score desc, doc_id nulls last, n, w) rank, count(*) over () n_able from scored where n >= 20)
select doc_id, scored.n n_words, scored.n n_features, w weight, score, case when rank <= n_able * 10 // 100 then rank end rank from scored left join ranked using (r)"""
