"""Registered queries on the smallest tables, and the pipeline stage by stage."""

import zlib

import duckdb
import pytest
from conftest import SF

import corpus_pipeline
from brindle.llm import catalogue, mixing, stages
from brindle.llm.common import cut, table


def test_names():
    assert sorted(catalogue.queries()) == sorted([*(n for n in catalogue.queries() if n.startswith("op")), "pipeline"]) and len(catalogue.queries()) == 14


def test_topk_oracle(spark):
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(db.sql(catalogue.oracle_sql()["op1_topk"]).fetchall())
    assert sorted((r.query_id, r.query_copy, r.rank, r.vec_id, r.score) for r in catalogue.queries()["op1_topk"](spark, SF).collect()) == want


@pytest.mark.parametrize("name,folds,held", [("op5_language", 3, 1), ("op7_lm", 5, 1), ("op9_toxicity", 5, 0)])
def test_folds(spark, name, folds, held):
    rows = catalogue.queries()[name](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)
    if name == "op5_language":
        lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
        own = [r for r in rows if r.held_out]
        assert sum(lang[r.doc_id] == r.lang_pred for r in own) >= 0.9 * len(own)
    if name == "op7_lm":
        own = [r for r in rows if r.held_out]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)  # the mixed model is better on texts that it has not seen


def test_pipeline(spark):
    assert corpus_pipeline.STAGES is stages.STAGES and corpus_pipeline.run is stages.run
    docs = table(spark, SF, "documents")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
        n.append(docs.count())
        if name != "encoding":
            assert docs.columns == stages.COLUMNS, name
    assert n[1] >= 0.95 * n[0] and n[2] <= n[1] and n[3] == n[2] and n[5] == n[4]
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "mixing", "encoding"]


@pytest.mark.parametrize("block", [8, 4096])
def test_mix_meets_targets(spark, block):
    """Also over several levels of flights: each source's words come within half of its largest document of the target."""
    rows = mixing.mix(table(spark, SF, "documents"), block=block).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1
        assert sum(r.size for r in own) == own[0].source_size and all(r.copies in (0, 1, 2) for r in own)
    assert abs(sum(own[0].target for own in by.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6 * sum(r.size for r in rows)
