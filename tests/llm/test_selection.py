"""Decontamination, importance resampling and filter audit: against SQL on the smallest tables, and against plain Python on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from brindle.llm import audit, catalogue, decontamination, resampling
from brindle.llm.common import Memo, word_stream

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(low(text))


def frame(spark, texts, langs=None):
    """Documents with ids from 0, one null id, one repeated id, and columns of all kinds of names."""
    rows = [(i, t, (langs or {}).get(i, "en"), "s", 0) for i, t in enumerate(texts)] + [(None, texts[0], None, "s", 0), (0, texts[0], "en", "s", 0), (1, texts[-1], "de", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("row", "token", "at", "before", "around", "digest", "part", "mask", "good", "toxic", "quality", "n", "range", "stream", "window", "size", "item", "kind", "score", "able", "word", "first", "__none"):
        df = df.withColumn(c, F.lit("clash"))
    return df, [(r[0], r[1], r[2]) for r in rows]


def some_texts(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ß9", "A", "The", "$", "#x"]
    out = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 40, 130]))) for _ in range(60)]
    out += [None, "", "  \t\n", out[3], out[3], "a" * 5000, " ".join(f"Q{i % 900}" for i in range(20_000)), "UPPER CASE TEXT " * 9, "one" + "\x00" + "two\x1fthree\x0bfour"]
    return out


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_resampling", "op13_audit"])
def test_queries_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalogue.queries()[name](spark, SF), db.sql(catalogue.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str)
    assert rows and rows == sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_word_stream(piece):
    raw = [(t or "").encode() for t in some_texts()[:30]] + [b"", b"last Word", b""]
    memo = Memo(zlib.crc32, most=5)
    text, at, values, first = word_stream(raw, memo, np.uint32, piece)
    own = [[zlib.crc32(w.encode()) for w in words(x.decode())] for x in raw]
    assert values.tolist() == [v for x in own for v in x]
    assert np.diff(first).tolist() == [len(x) for x in own] and len(at) == len(values) and len(memo) <= 5
    assert text[at[-1] :].split()[0] == b"word"


# decontamination


def plain_hits(rows, items, window):
    listed = []
    for item, text in items:
        ws = words(text)
        n = min(len(ws), window)
        listed += [(item, tuple(ws[i : i + n])) for i in range(len(ws) - n + 1) if n]
    out = []
    for d, text, _ in rows:
        ws, hit, found = words(text), set(), set()
        for item, w in listed:
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(item)
        names = sorted({str(i) for i in found if i is not None})
        out.append((d, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,shingle", [(10, 5), (10, 1), (4, 4), (3, 2)])
def test_decontamination_is_plain_search(spark, window, shingle):
    rng = random.Random(window)
    vocabulary = [f"v{i}" for i in range(6)]  # few words: windows overlap, repeat and share shingles
    passage = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, passage(rng.choice([0, 1, 2, 9, 10, 11, 25]))) for i in range(20)] + [(3, passage(12)), (None, passage(12)), (100, None), (101, ""), (10, "v1 v1 v1 v1 v1 v1 v1 v1 v1 v1 v1 v1"), (11, "Ünique, V3!")]
    texts = [passage(rng.choice([0, 5, 30, 60])) + f" x{i} " + (rng.choice(items)[1] or "").upper() + rng.choice(["", " tail"]) for i in range(25)] + [None, "", "v1 " * 40, "ünique v3", "ünique v3x", passage(3000)]
    df, rows = frame(spark, texts)
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("clash")).withColumn("doc_id", F.lit(1))
    got = sorted((tuple(r) for r in decontamination.decontaminate(df, it, window, shingle).collect()), key=str)
    assert got == plain_hits(rows, items, window)


def test_decontamination_of_nothing(spark):
    df, rows = frame(spark, ["some text", "other"])
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.decontaminate(df, none).collect()
    assert len(got) == len(rows) and not any(r.contaminated or r.n_items or r.n_hit for r in got)
    assert decontamination.decontaminate(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        decontamination.decontaminate(df, none, window=3, shingle=4)


def test_the_filter_only_lets_more_through(spark, monkeypatch):
    """A filter that is much too small lets nearly every place through; the result stays."""
    items = [(1, " ".join(f"k{i}" for i in range(60)))]
    texts = [" ".join(f"k{i}" for i in range(5, 30)), " ".join(f"z{i}" for i in range(500))]
    df, rows = frame(spark, texts)
    monkeypatch.setattr(decontamination, "MOST_BITS", 1 << 7)
    it = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in decontamination.decontaminate(df, it).collect()), key=str) == plain_hits(rows, items, 10)


# importance resampling


def plain_draw(rows, target, longest, buckets, least, percent):
    def own(text):
        ws = words(text)
        return [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, text, _ in rows:
        for b in own(text):
            s[b] += 1
    for text in target:
        for b in own(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for d, text, _ in rows:
        f = own(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for i, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = i
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (2, 500, 50), (3, 65_536, 100)])
def test_resampling_is_plain_arithmetic(spark, monkeypatch, longest, buckets, percent):
    monkeypatch.setattr(resampling, "ROW", 64)
    texts = some_texts(longest)
    df, rows = frame(spark, texts)
    target = [t for t in some_texts(9)[:20]]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string").withColumn("stream", F.lit("clash"))
    got = sorted((tuple(r) for r in resampling.resample(df, t, longest, buckets, percent=percent).collect()), key=str)
    assert got == plain_draw(rows, target, longest, buckets, 20, percent)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(spark.createDataFrame([], DOCS), none).count() == 0
    df, rows = frame(spark, some_texts())
    assert sorted((tuple(r) for r in resampling.resample(df, none).collect()), key=str) == plain_draw(rows, [], 1, 10_000, 20, 10)
    with pytest.raises(ValueError):
        resampling.bucket_streams(df, buckets=70_000)


def test_ranks_reach_over_ranges(spark):
    """Many equal scores: ranks are 1 to the number drawn, whatever ranges the rows were dealt to."""
    rows = [(i % 7, "same words " * 15, "en", "s", 0) for i in range(400)]
    got = resampling.resample(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("same",)], "text string")).where("rank is not null").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 41)) and len({r.doc_id for r in got}) == 1


# filter audit


def plain_audit(rows, labels):
    marked = {}
    for d, q, t in labels:
        if d is not None:
            good, bad = marked.get(d, (False, False))
            marked[d] = (good or q == 1, bad or t == 1)
    facts = []
    for d, text, lang in rows:
        text = text or ""
        ws = [w for w in re.split("[ \t-\r]+", text) if w]
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        fails["E"] = d is not None and any(o is not None and o < d and (x or "") == text for o, x, _ in rows)
        facts.append((lang or "", fails, *marked.get(d, (False, False))))
    out = []
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        shares = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, kept = [x for x in left if x[1][f]], [x for x in left if not x[1][f]]
                shares[f] += len(gone)
                failing = [x for x in own if x[1][f]]
                unique = [x for x in failing if sum(x[1].values()) == 1]
                lines.append(["".join(order), step, len(kept), len(gone), len(failing) - len(gone), len(unique), sum(x[2] for x in gone), sum(x[3] for x in gone), f])
                left = kept
        out += [(part, *x[:-1], shares[x[-1]]) for x in lines]
    return sorted(out)


def test_audit_is_filtering(spark):
    texts = some_texts(5)
    df, rows = frame(spark, texts, {i: ["en", "de", "", None][i % 4] for i in range(len(texts))})
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (6, None, None), (None, 1, 1), (9999, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash")).withColumn("mask", F.lit(3))
    got = sorted(tuple(r) for r in audit.audit(df, lab).collect())
    assert got == plain_audit(rows, labels) and len(got) % 600 == 0
    # in every order the same documents are left at the end, and the shares of the filters add up to all removals
    for part in {r[0] for r in got}:
        assert len({r[3] for r in got if r[0] == part and r[2] == 5}) == 1
        assert sum(r[9] for r in got if r[0] == part and r[1] == "ABCDE") == sum(r[4] for r in got if r[0] == part)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    got = audit.audit(one, labels).collect()
    assert len(got) == 600 and all(r.part == "" and r.shapley == (120 if r.filter_order[r.step - 1] == "A" else 0) for r in got)
