"""Audit of how filters interact: what each removes in every order of applying them (operator 13)."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut, steady_scans, table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def word_totals(rows: DataFrame, key: str = "row", text: str = "text") -> DataFrame:
    """Words and distinct words of each row that has words (``n_words, n_distinct``): one row per word, added up per (row, word), then per row.

    The texts move once, by row; both aggregations stay in the task that holds the row. Words are runs of characters other than ASCII white space.
    """
    words = rows.select(key, text).repartition(key).select(key, F.explode(F.split(text, r"[ \t-\r]+")).alias("word")).where("word != ''")
    return words.groupBy(key, "word").agg(F.count("*").alias("times")).groupBy(key).agg(F.sum("times").alias("n_words"), F.count("*").alias("n_distinct"))


def repeated_rows(flags: DataFrame, key: str = "row") -> DataFrame:
    """Rows whose text also stands under a smaller id. The first id of each text comes from a partial aggregation; only rows of repeated texts meet it, in a join that splits large groups."""
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    return flags.select(key, "doc_id", "digest").join(first, "digest").where("doc_id > first").select(key, F.lit(_bit("E")).alias("e"))


def failures(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, part, mask``; bit k of ``mask`` says that the document fails filter k of ABCDE.

    A: under 100 words; B: 100 times the distinct words below 80 times the words; C: A-Z above a tenth of the characters; D: holds one of # $ % & * |; E: equal to the text of a smaller id.
    """
    steady_scans(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    marks = F.col("text").rlike(r"[#$%&*|]")
    flags = cut(rows.select("row", "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), (F.when(100 * capitals > 10 * F.length("text"), _bit("C")).otherwise(0) + F.when(marks, _bit("D")).otherwise(0)).alias("cd")))
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    ab = F.when(n < 100, _bit("A")).otherwise(0) + F.when(100 * distinct < 80 * n, _bit("B")).otherwise(0)
    joined = flags.drop("digest").join(word_totals(rows), "row", "left").join(repeated_rows(flags), "row", "left")
    return joined.select("doc_id", "part", (ab + F.col("cd") + F.coalesce("e", F.lit(0))).alias("mask"))


def _sum(counts: str, cond) -> Column:
    """Sum of the counts of those masks for which ``cond`` holds."""
    masks = F.sequence(F.lit(0), F.lit(MASKS - 1))
    return F.aggregate(masks, F.lit(0).cast("long"), lambda acc, m: acc + F.when(cond(m), F.get(F.col(counts), m)).otherwise(F.lit(0).cast("long")))


def interactions(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """From ``doc_id, part, mask`` to one row per part, order of the filters and step (600 a part): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Every part is first aggregated to 32 conditional counts, and as many of good and of toxic documents; the rest works on these. A document is good (toxic) if any of its labels says so. A document that fails
    the filters of a set S is removed by each filter of S in 120 / |S| of the 120 orders: that is ``shapley``.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masks.join(marks, "doc_id", "left")
    kinds = {"n": F.lit(True), "good": F.col("good") == 1, "bad": F.col("toxic") == 1}
    counts = [F.count_if((F.col("mask") == m) & kind).alias(f"{name}_{m}") for name, kind in kinds.items() for m in range(MASKS)]
    by_part = rows.groupBy("part").agg(*counts).select("part", *[F.array(*[f"{name}_{m}" for m in range(MASKS)]).alias(name) for name in kinds])
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = by_part.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda at: f"shiftleft(1, locate(substr(filter_order, {at}, 1), '{FILTERS}') - 1)"
    before = F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (acc, i) -> acc + if(i < step, {bit('i')}, 0))")
    steps = steps.withColumn("bit", F.expr(bit("step"))).withColumn("before", before)
    own, earlier = F.col("bit"), F.col("before")
    removed = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(earlier) == 0)
    shares = F.array(*[F.lit(120 // max(1, m.bit_count())) for m in range(MASKS)])
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(m.bitwiseAND(own) != 0, F.get(F.col("n"), m) * F.get(shares, m)).otherwise(F.lit(0).cast("long")))
    return steps.select(
        "part", "filter_order", "step", _sum("n", lambda m: m.bitwiseAND(own.bitwiseOR(earlier)) == 0).alias("kept"), _sum("n", removed).alias("removed"),
        _sum("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(earlier) != 0)).alias("redundant"), F.get(F.col("n"), own).alias("unique_fails"),
        _sum("good", removed).alias("good_lost"), _sum("bad", removed).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Applies the five filters in all 120 orders within each language; see :func:`failures` and :func:`interactions`.

    Null texts count as empty (no words: A fails, B, C and D don't) and equal to empty ones; a null language is the part named by the empty string. Rows of one id are documents each; a row without an id is no
    copy (E) and has no labels. An empty table has no parts and so no rows. Only the named columns are read, so others can't clash. Texts of any length are counted whole.
    """
    return interactions(failures(docs), labels)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""with docs as (select row_number() over () r, doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
counted as (select r, len(list_filter(string_split_regex(t, '[ \t-\r]+'), lambda w: w <> '')) n, len(list_distinct(list_filter(string_split_regex(t, '[ \t-\r]+'), lambda w: w <> ''))) d from docs),
firsts as (select t, min(doc_id) first from docs group by t),
marks as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) bad from labels where doc_id is not null group by doc_id),
flagged as (select part, n < 100 a, 100 * d < 80 * n b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) c, regexp_matches(t, '[#$%&*|]') d, coalesce(doc_id > first, false) e, coalesce(good, false) good, coalesce(bad, false) bad
 from docs join counted using (r) join firsts using (t) left join marks using (doc_id)),
cells as (select part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} f, count(*) n, count(*) filter (good) g, count(*) filter (bad) x from flagged group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) l),
orders as (select [p1.l, p2.l, p3.l, p4.l, p5.l] o from letters p1, letters p2, letters p3, letters p4, letters p5 where len(list_distinct([p1.l, p2.l, p3.l, p4.l, p5.l])) = 5),
steps as (select o, unnest(range(1, 6)) step from orders),
seen as (select part, o, step, n, g, x, f[o[step]] own, len(list_filter(o[1:step - 1], lambda l: f[l])) > 0 earlier, (select count(*) from letters where f[l]) fails from cells, steps),
sums as (select part, o, step, sum(n) filter (not own and not earlier) kept, sum(n) filter (own and not earlier) removed, sum(n) filter (own and earlier) redundant, sum(n) filter (own and fails = 1) unique_fails, sum(g) filter (own and not earlier) good_lost, sum(x) filter (own and not earlier) toxic_lost from seen group by all),
shares as (select part, o[step] l, sum(removed) shapley from sums group by all)
select part, array_to_string(o, '') filter_order, step::int step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant, coalesce(unique_fails, 0)::bigint unique_fails, coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost, coalesce(shapley, 0)::bigint shapley
from sums join shares using (part) where l = o[step]"""
