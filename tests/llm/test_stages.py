"""Stages of the pipeline and the mix on nulls, ties, repeated rows, very long texts and clashing columns, each against plain Python."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_edges import DOCS, EXTRA, long_text

from brindle.llm import mixing, pieces, stages
from brindle.llm.common import default_tokenizer

EN = "the quick brown fox jumps over the lazy dog and then it runs far away from the angry bear of the north"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann weit weg von dem bösen bären im norden"


@pytest.fixture(scope="module")
def rows():
    passage = " ".join(f"shared{i}" for i in range(20))
    out = [(i, f"{EN} {i} {EN.split()[i % 20]}", "en", "a") for i in range(30)] + [(100 + i, f"{DE} {i} {DE.split()[i % 15]}", "de", "b") for i in range(30)]
    out += [(200, None, None, None), (201, "", "en", "a"), (202, "12 34 !!", None, "a"), (203, long_text(8000), "en", "a"), (204, passage + " the end of the one", "en", "a"), (205, "and before " + passage + " the other end", "en", None)]
    out += [(206, "é" * 60 + " the fox", "en", "a"), (207, "the é" + "é" * 60, "en", "a"), (None, f"{EN} no id", "en", "a"), (5, f"{EN} 5 {EN.split()[5]}", "en", "a"), (208, f"{EN} {DE}", None, "c"), (209, "the", None, "c")]
    return [(*r, len(r[1] or "")) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def kept(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_language_stage(spark, docs, rows, empty):
    """What has no letter goes; clear texts stay whole with their columns, each row by itself; a missing language is filled in."""
    out = stages.by_language(spark, docs, "")
    assert out.columns == stages.COLUMNS
    got = kept(out)
    clear = [r for r in rows if r[1] and r[0] is not None and (r[0] < 200) and r[0] != 5]
    assert all(r in got for r in clear) and sum(r[0] == 5 for r in got) == 2 and any(r[0] is None for r in got)
    assert not [r for r in got if r[0] in (200, 201, 202)]
    assert {r[2] for r in got if r[0] == 209} <= {"en"} and {(r[0], r[1]) for r in got} <= {(r[0], r[1]) for r in rows}
    assert stages.by_language(spark, empty, "").count() == 0


def plain_without_repeats(rows):
    out = []
    whole = [(r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    big = 1 << 62
    for i, t in whole:
        for k in range(len(t) - 49):
            s = t[k : k + 50]
            first[s] = min(first.get(s, big + 1), big if i is None else i)
    for (i, t), r in zip(whole, rows, strict=True):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < (big if i is None else i):
                gone[k : k + 50] = True
        text = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
        out.append((r[0], text, r[2], r[3], len(text)))
    return sorted(out, key=str)


def test_repeats_stage(spark, docs, rows, empty):
    assert kept(stages.without_repeats(spark, docs, "")) == plain_without_repeats(rows)
    assert stages.without_repeats(spark, empty, "").count() == 0


def test_mixing_stage(spark, docs, rows, empty):
    """Each row comes as often as the mix takes it; a rerun takes the same."""
    got = stages.mixed(spark, docs, "")
    assert got.columns == stages.COLUMNS
    one, two = kept(got), kept(stages.mixed(spark, docs, ""))
    assert one == two and set(one) <= set(rows)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    assert {i: sum(r[0] == i for r in one) for i in taken} == taken
    assert stages.mixed(spark, empty, "").count() == 0


def test_encoding_stage(spark, docs, rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=default_tokenizer("piece_bpe_32k.model"))
    got = sorted(((r.doc_id, list(r.ids)) for r in stages.encoded(spark, docs, "").collect()), key=str)
    assert got == sorted(((r[0], sp.encode(r[1] or "")) for r in rows), key=str)
    assert stages.encoded(spark, empty, "").count() == 0 and pieces.encode_texts(empty, default_tokenizer("piece_bpe_32k.model")).count() == 0


# the mix against plain rules


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by giving out the total in small shares: sources fill up by weight until each stands at its bound or all is given."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    level_lo, level_hi, total = 0.0, 1e9, share * sum(sizes.values())
    for _ in range(200):  # the level at which sources min(weight * level, bound) hold the total
        level = (level_lo + level_hi) / 2
        if sum(min(w[s] * level, most * sizes[s]) for s in names) < total:
            level_lo = level
        else:
            level_hi = level
    return {s: min(w[s] * level_hi, most * sizes[s]) for s in names}


def mixed_rows(seed, n=40):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(["w"] * int(rng.integers(0, 30))), "en", [None, "a", "b", "c", "d"][int(rng.integers(0, 5))], 0) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_mix_is_its_rule(spark, seed):
    rows = mixed_rows(seed)
    size = {r[0]: len(r[1].split()) for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    want = plain_targets(sizes)
    out = mixing.mix(spark.createDataFrame(rows, DOCS), block=8).collect()
    assert len(out) == len(rows)
    for source, target in want.items():
        own = [r for r in out if r.source == source]
        assert all(r.size == size[r.doc_id] and r.source_size == sizes[source] and abs(r.target - target) < 1e-6 * max(1, target) for r in own)
        rate = target / sizes[source] if sizes[source] else 0
        assert all(r.copies in (int(rate), int(rate) + 1) and r.taken == r.copies * r.size <= 2 * r.size for r in own)
        # nearest total: no choice of copies for two documents alone would come much nearer than half the smallest difference allows
        assert abs(sum(r.taken for r in own) - target) <= max((r.size for r in own), default=0) / 2 + 1e-6


def test_chances_are_the_rates(spark):
    """Over many seeds each document is taken at the rate of its source, whatever its size."""
    rows = mixed_rows(7, 12)
    df = spark.createDataFrame(rows, DOCS)
    facts = {r.doc_id: r for r in mixing.mix(df).collect()}
    rate = {i: r.target / r.source_size if r.source_size else 0.0 for i, r in facts.items()}
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r[0])
    for own in by_source.values():
        p, size = np.array([rate[i] % 1 for i in own]), np.array([len(rows[i][1].split()) for i in own], float)
        if len(own) < 3 or not p.any():
            continue
        taken = np.zeros(len(own))
        n = 3000
        for seed in range(n):
            flown = mixing.flight(p, size, np.random.default_rng(seed))
            assert abs(flown @ size - p @ size) < 1e-6 and abs(flown.sum() - p.sum()) < 1e-6  # both totals stay until the landing
            assert ((flown > mixing.EPS) & (flown < 1 - mixing.EPS)).sum() <= 2
            taken += flown
        assert np.abs(taken / n - p).max() < 4 * 0.5 / np.sqrt(n)


def test_landing_is_the_nearest_choice():
    rng = np.random.default_rng(1)
    for _ in range(50):
        pi, size = rng.random(3), rng.integers(1, 50, 3).astype(float)
        got = mixing.land(pi, size)
        best = min(abs(np.array(c) @ size - pi @ size) for c in itertools.product((0, 1), repeat=3))
        assert abs(abs(got @ size - pi @ size) - best) < 1e-9
