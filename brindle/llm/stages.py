"""Corpus pipeline: language, near duplicates, repeated passages, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and keeps the columns of documents (the last one gives piece ids instead). An empty table gives an empty table; repeated rows are
documents each; texts are judged whole, however long; other columns than those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import language, mixing, neardup, pieces, suffixes
from brindle.llm.common import cut, default_tokenizer, table

#: Below this score a text is in no learned language.
LEAST_LANGUAGE_SCORE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and texts whose language is not clear; a null ``lang`` becomes the predicted one. Learns from the documents
    that name a language; where none does, every text is rejected. Rows with a null id or source are judged like others."""
    model = language.learn(docs)
    seen = language.identify(docs, model, keep=tuple(COLUMNS))
    kept = seen.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; of rows that repeat an id and a text one stays (the smallest row). Texts of one id are
    judged each. Rows without an id stay, and so do texts without words (null, empty) under ids of their own."""
    repeated = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    key = ["doc_id", "th"] if repeated else ["doc_id"]
    dropped = neardup.near_duplicates(docs, hashes=True).where("doc_id is not null and not kept").select(key).distinct()
    out = docs.withColumn("th", F.xxhash64("text")).join(dropped.hint("shuffle_hash"), key, "left_anti")
    if repeated:
        one = out.where("doc_id is not null").groupBy(key).agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
        out = out.where("doc_id is null").select(COLUMNS).unionByName(one)
    return out.select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes away bytes of 50-byte strings that also start in a document with a smaller id; a character that loses a byte goes whole. Every row stays, if
    with an empty text; a null text becomes empty. A null id counts as the largest."""

    def text(batches):
        import pyarrow as pa

        for b in batches:
            kept = [x.decode("utf-8", "ignore") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), *b.columns[2:]], ["doc_id", "text", "lang", "source"])

    out = suffixes.remove_repeats(docs, carry=("lang", "source")).select("doc_id", "kept", "carry_lang", "carry_source")
    return out.mapInArrow(text, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (0, 1 or 2 times). A null source is a source of its own; a text without words has size 0 and, with the fraction
    of its source as probability, stays. Rows that are equal or share an id are taken by their own decisions."""
    return mixing.repeat(docs).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, one row for each row (``doc_id, n_tokens, ids`` and digests); a null text encodes like an empty one, to no ids."""
    return pieces.encode_texts(docs, default_tokenizer("piece_bpe_32k.model")).drop("decoded")


STAGES = [
    ("language", by_language),
    ("near_duplicates", without_near_duplicates),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: SQL can't express learned languages, sampling and piece encoding; tests compare the operators of the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
