"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for each operator."""

import hashlib
import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from brindle.llm import embeddings, language, licenses, lm, mixing, neardup, pieces, stages, suffixes, topk, toxicity
from brindle.llm.common import components, default_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["id", "th", "at", "n", "key", "size", "block", "h", "a", "kind", "score", "count", "label", "tree", "cluster"]


def long_text(words: int = 30_000) -> str:
    return " ".join(f"w{i * 7919 % 5003}" for i in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the angry bear today"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " again", "en", None), (4, None, None, "b"), (5, "", "de", "b"), (6, "   \n", None, "b"), (7, long_text(), "en", "a"),
        (8, "über straße ähnlich größe ▁ \x00 日本", "de", "c"), (None, base, "en", "a"), (9, "idiot " * 3, "en", "c"), (9, "idiot " * 3, "en", "c"), (10, "short", None, None), (11, "ein und der die das nicht", "de", "c"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_pieces(spark, docs, empty):
    import sentencepiece

    path = default_tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encode_texts(docs, path).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == 14 - 2  # the null id does not join
    for r in got:
        ids = sp.encode(r.text or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
    assert pieces.encode_texts(docs, path).count() == docs.count()
    assert pieces.encode_texts(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_agenda_is_the_library(seed):
    import random

    import sentencepiece

    path = default_tokenizer("piece_bpe_32k.model")
    sp, enc, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.encoder(path), random.Random(seed)
    alphabet = "ab e.,!?#  \n\t▁日éÅﬁ0'\")(-_🙂\x00" + "thein"
    batch = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for t, (ids, text) in zip(batch, enc.encode(batch), strict=True):
        assert ids == sp.encode(t), t
        assert text == ",".join(map(str, ids))
        assert enc.agenda(" " + t if t else "") == ids  # the parts add nothing to the plain agenda


def test_topk(spark):
    rows = [(i, [float(i % 5), 1.0, -0.5], 1) for i in range(40)] + [(40, None, 1), (41, [float("nan"), 1.0, 1.0], 1), (42, [None, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (10, [9.0, 9.0, 9.0], 1), (50, [], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").withColumn("part", F.lit("clash")).withColumn("query_copy", F.lit("clash"))
    # an id with two vectors is two queries, a repeated row is one
    asked = [(i, x) for i, x, _ in rows if i is not None and i % 10 == 0] + [(0, [0.0, 1.0]), (0, [1.0, 0.0]), (0, [1.0, 0.0])]
    q = spark.createDataFrame(asked, "vec_id long, embedding array<double>")
    fine = [(i, [math.floor(256 * y) for y in x]) for i, x, _ in rows if i is not None and x and all(y is not None and math.isfinite(y) for y in x)]
    want = []
    for i in {i for i, x in asked if x}:
        for copy, x in enumerate(sorted({tuple(x) for j, x in asked if j == i}), 1):
            scores = sorted((-sum(math.floor(256 * a) * b for a, b in zip(x, y, strict=False)), j) for j, y in fine if j != i)
            want += [(i, copy, rank, j, -s) for rank, (s, j) in enumerate(scores[:3], 1)]
    for qb in (1 << 20, 64):  # one block of queries and many
        assert sorted(tuple(r) for r in topk.top_k(v, q, 3, query_bytes=qb).collect()) == sorted(want)
    assert topk.top_k(v.where("false"), q, 3).count() == 0 and topk.top_k(v, q.where("false"), 3).count() == 0
    assert topk.top_k(v.where("vec_id < 2"), v.where("vec_id = 0"), 5).count() == 1


def test_topk_large_numbers():
    q, ok = topk.quantise([[1e18, 1.0], [1e30, -1e30]], 256.0)
    assert ok.all()
    s = topk.products(q, q)
    assert s[0, 0] == topk.LONG_MAX and topk.products(np.array([[3.0, 4.0]]), np.array([[1.0, 2.0]]))[0, 0] == 11


def brute_vectors(rows, threshold=0.98):
    """Links and smallest reachable id of each row, in the order of ``rows`` (id, vector, label)."""
    from fractions import Fraction

    fine = [i for i, (k, v, lab) in enumerate(rows) if k is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, low = {i: set() for i in fine}, {i: rows[i][0] for i in fine}
    exact = {i: [Fraction(x) for x in rows[i][1]] for i in fine}
    for x in fine:
        for y in fine:
            if x < y and rows[x][2] == rows[y][2]:
                a, b = exact[x], exact[y]
                dot = sum(p * q for p, q in zip(a, b, strict=False))
                if dot > 0 and dot * dot >= Fraction(threshold) ** 2 * sum(p * p for p in a) * sum(q * q for q in b):
                    links[x].add(y)
                    links[y].add(x)
    for _ in range(len(fine)):
        new = {i: min([low[i], *(low[j] for j in links[i])]) for i in fine}
        if new == low:
            break
        low = new
    return [(k, len(links.get(i, ())), low.get(i, k), low.get(i, k) == k) for i, (k, _, _) in enumerate(rows)]


@pytest.mark.parametrize("kind", ["double", "float"])
def test_embeddings(spark, kind):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8)).astype(np.float32).astype(float)
    rows = [(i, (base[i % 30] + (rng.normal(size=8) * 0.02 * (i >= 30)).astype(np.float32)).astype(np.float32).astype(float).tolist(), i % 2) for i in range(90)]
    rows += [(90, base[0].tolist(), 0), (91, (2 * base[0]).tolist(), 0), (92, None, 0), (93, [0.0] * 8, 0), (94, [float("inf")] * 8, 0), (95, base[0].tolist(), None), (None, base[0].tolist(), 0), (96, [1.0, None], 0), (97, [], 0)]
    rows += [(100, [1.0, 2.0], 0), (101, [1.0, 2.0, 0.0], 0), (102, [2.0**-100, 2.0**-99], 0), (103, [2.0**100, 2.0**101], 0), (104, [2.0**-100, 2.0**-99], 0)]
    if kind == "double":
        rows += [(105, [1e-300, 2e-300], 0), (106, [1e300, 2e300], 0), (107, [5e-324, 1e-323], 0)]
    for extra in ([], [(0, base[0].tolist(), 0), (0, base[1].tolist(), 0), (1, base[7].tolist(), 1), (107, base[3].tolist(), 1)]):
        own = rows + extra
        df = spark.createDataFrame(own, f"vec_id long, embedding array<{kind}>, label int").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
        want = sorted(brute_vectors(own), key=str)
        for tile, segment in ((4, 7), (512, None)):
            got = embeddings.near_duplicate_vectors(df, tile=tile, segment=segment).collect()
            assert sorted(((r.vec_id, r.n_links, r.component_id if r.vec_id is not None else None, r.kept if r.vec_id is not None else None == r.vec_id) for r in got), key=str) == want
    assert embeddings.near_duplicate_vectors(df.where("false")).count() == 0


def test_embeddings_many_segments(spark):
    """A crowded label over many segments and partitions, and many small labels that share one: as brute force says, and what is sent stays small."""
    rng = np.random.default_rng(12)
    centre = rng.normal(size=(40, 16))
    v = centre[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16)) * 0.05
    label = np.where(np.arange(1500) < 1100, 0, np.arange(1500) // 3)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicate_vectors(df, tile=16, segment=90).collect()}
    assert [got[i] for i in range(1500)] == link.sum(1).tolist() and link.sum() > 5000


def test_interval_pairs_skip_and_keep():
    rng = np.random.default_rng(1)
    p = rng.random((40, 3))
    lo, hi = p, p + 0.02
    got = set(embeddings.interval_pairs(lo, hi, 0.2))
    gap = np.maximum(0, np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None]))
    want = {(i, j) for i in range(40) for j in range(i, 40) if (gap[i, j] ** 2).sum() <= 0.04 + 1e-9}
    assert got == want and len(got) < 40 * 41 / 2
    both = set(embeddings.interval_pairs(lo[:15], hi[:15], 0.2, (lo[15:], hi[15:])))
    assert both == {(i, j - 15) for i, j in want if i < 15 <= j}


def test_neardup_edges(spark, docs, empty):
    got = {}
    for r in neardup.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(2, 1, True)] and got[2] == [(2, 1, False)] and got[3] == [(2, 1, False)]
    assert got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)] and got[6] == [(0, 6, True)] and got[7] == [(0, 7, True)]
    assert got[9] == [(0, 9, True)] * 2 and got[None] == [(0, None, True)]
    assert neardup.near_duplicates(empty).count() == 0


def test_neardup_against_brute_force(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(6):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = t.split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    link = [[i != j and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    assert sum(map(sum, link)) > 50
    assert [got[i].n_links for i in range(len(texts))] == [sum(row) for row in link]


def test_texts_of_one_id_are_judged_each(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the angry bear today"
    clean = [f"{w} text number {w} that nobody else has written {w} so far" for w in ("zebra", "apple", "mango")]
    rows = [(1, base), (1, clean[0]), (2, base + " again"), (2, clean[1]), (2, clean[1]), (3, clean[2]), (4, clean[2]), (None, base)]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    got = sorted((r.doc_id, r.th, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df, hashes=True).where("doc_id is not null").collect())
    th = {r.text: r.th for r in df.select("text", F.xxhash64("text").alias("th")).collect()}
    assert got == sorted([(1, th[base], 1, 1, True), (1, th[clean[0]], 0, 1, True), (2, th[base + " again"], 1, 1, False), *[(2, th[clean[1]], 0, 2, True)] * 2, (3, th[clean[2]], 1, 3, True), (4, th[clean[2]], 1, 3, False)])
    left = stages.without_near_duplicates(spark, df, "")
    assert left.columns == stages.COLUMNS
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(0, base), (1, base), (1, clean[0]), (2, clean[1]), (3, clean[2])])


def test_recall_of_planted_pairs():
    """Pairs at 0.80 to 0.82 meet in some tree as often as the formula says, at the depth that all trees can afford: no hash function serves two trees."""
    least, levels, bits = neardup.shape(0.8, 0.99999)
    used = neardup.PATHS[:, :levels].ravel()
    assert (least, levels, bits) == (4, 8, 8) and len(set(used.tolist())) == len(used)
    rng = np.random.default_rng(7)
    missed, pairs = 0, 0
    for shared, apart in ((80, 20), (81, 19), (82, 18)):
        for _ in range(10):
            x = rng.integers(0, 1 << 63, (2500, shared + apart), dtype=np.uint64)
            half = apart // 2
            a, b = x[:, : shared + half], np.concatenate([x[:, :shared], x[:, shared + half :]], axis=1)
            one, two = (neardup.paths_of(list(neardup.mix(y)), levels, bits) >> np.uint64(64 - (least + 1) * bits) for y in (a, b))
            missed += int((~(one == two).any(1)).sum())
            pairs += len(x)
    assert pairs == 75_000 and missed <= 2  # the formula: fewer than 0.1 of them


def test_prefixes_shorten_until_the_recall_is_met():
    """Trees without company go up to the shortest prefix; crowded ones keep more, as far as the others carry the recall."""
    least, levels, bits = neardup.shape(0.8, 0.99999)
    gain = neardup.evidence(0.8)
    rng = np.random.default_rng(1)
    crowd = np.sort(rng.integers(1, 2000, (300, neardup.TREES, levels - least + 1)), axis=2)[:, :, ::-1]
    crowd[0] = neardup.COMPANY
    crowd[1] = 1
    crowd[1, :5] = 10**6
    got = neardup.depths(crowd, least, 0.8, 0.99999)
    assert (gain[got].sum(1) >= -np.log(1e-5) - 1e-9).all() and (got[0] == least).all()
    assert (got[1, :5] == levels).all() and got.max() == levels and got.min() == least
    tree, path = np.array([0, 0, 0, 1]), np.array([0x0102030405060708, 0x01020304FF060708, 0x0202030405060708, 0x0202030405060708], np.uint64)
    assert neardup.crowds(tree, path, 4, 8, 8).tolist() == [[2, 1, 1, 1, 1], [2, 1, 1, 1, 1], [1] * 5, [1] * 5]


def test_neardup_recall_on_many_texts(spark):
    """Pairs with a Jaccard similarity of 0.80 to 0.86 planted among 24,000 texts: every one is found, pairs just below 0.8 are not, and blocks don't change it."""
    import random

    rng = random.Random(9)
    texts, want = [], {}
    for i in range(12_000):
        w = [f"{i}_{j}" for j in range(104)]  # 100 runs of five words
        v = list(w)
        kind = i % 4
        if kind < 2:  # words changed at one end: 100 - n shared of 100 + n
            n = rng.randint(8, 11) if kind == 0 else rng.randint(12, 14)
            v[:n] = [f"x{i}_{j}" for j in range(n)]
            want[i] = int((100 - n) / (100 + n) >= 0.8)
        else:
            v = [f"y{i}_{j}" for j in range(104)]
            want[i] = 0
        texts += [(i, " ".join(w)), (100_000 + i, " ".join(v))]
    rng.shuffle(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_links for r in neardup.near_duplicates(df).collect()}
    assert len(got) == 24_000 and sum(want.values()) == 3000
    assert {i for i in want if got[i] != want[i]} == set() and all(got[100_000 + i] == got[i] for i in want)


def test_neardup_hub_over_blocks(spark, monkeypatch):
    """One group of near copies over many blocks: every link is counted once."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 16)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"t{i}"])) for i in range(150)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert all(r.n_links == 149 and r.component_id == 0 and r.kept == (r.doc_id == 0) for r in got) and len(got) == 150


def test_jaccard_tiles_and_prefix(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 500, 200).astype(np.uint64)) for _ in range(20)]
    want = [[len(set(a) & set(b)) / len(set(a) | set(b)) for b in sets] for a in sets]
    monkeypatch.setattr(neardup, "TILE", 64)
    assert np.allclose(neardup.jaccard(sets, sets), want)
    assert np.allclose(neardup.jaccard(sets[:7], sets[7:]), np.array(want)[:7, 7:])
    assert neardup.shortest_prefix(0.8, 0.99999) >= neardup.shortest_prefix(0.5, 0.99999)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (700, 700), (900, 800), (850, 900)] + [(1000, i) for i in range(1001, 1100)]
    got = {r.v: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500 and got[900] == got[850] == 800 and got[1050] == 1000 and 700 not in got


def test_language(spark, docs, empty):
    model = language.learn(docs)
    assert model.langs == ["de", "en"]
    got = language.identify(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (4, 5, 6))
    assert all(r.lang_pred == "en" for r in got if r.doc_id in (1, 2, 3, 7))
    nothing = language.learn(empty)
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


def test_language_keeps_words_of_small_languages(spark):
    """A large language does not push the words of a small one out of the model, whose words come last in code point order."""
    import itertools

    large = " ".join(itertools.islice(map("".join, itertools.product("abcdefghijkl", repeat=5)), 61_000))
    small = [f"ž{c}ů" for c in "abcdefghij"]
    rows = [(i, large, "xx") for i in range(4)] + [(10 + i, " ".join(small), "yy") for i in range(3)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert (model.find(0, language.keys_of(small)) >= 0).all() and len(model.tables[0][0]) == 61_010


def brute_language(rows, asked):
    """Word-first backoff by plain counts: language and probability of each text."""
    import re
    from collections import Counter

    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    langs = sorted({la for _, la in rows if la is not None})
    tables = []
    for n in range(5):
        c = {la: Counter() for la in langs}
        for t, la in rows:
            if la is not None:
                for w, k in Counter(words(t)).items():
                    for g in [w] if n == 0 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]:
                        c[la][g] += 1 + int(math.log2(k))
        keys = set().union(*c.values()) if c else set()
        total = {la: sum(c[la].values()) for la in langs}
        logs = {k: [math.log((c[la][k] + 0.1) / (total[la] + 0.1 * len(keys))) for la in langs] for k in keys}
        tables.append({k: [x - sum(v) / len(v) for x in v] for k, v in logs.items()})

    def score(w):
        if w in tables[0]:
            return tables[0][w]
        for n in (4, 3, 2, 1):
            known = [tables[n][g] for g in [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if g in tables[n]]
            if known:
                return [sum(x) / len(known) for x in zip(*known, strict=True)]
        return [0.0] * len(langs)

    out = []
    for t in asked:
        w = words(t)
        if not any(c.isalpha() for x in w for c in x) or not langs:
            out.append(("und", 0.0))
            continue
        mean = [sum(x) / len(w) * min(len(w), 24) for x in zip(*map(score, w), strict=True)]
        e = [math.exp(x - max(mean)) for x in mean]
        out.append((langs[e.index(max(e))], max(e) / sum(e)))
    return out


def test_language_against_plain_counts(spark, docs):
    """All documents of the smallest table and odd texts, learned from two thirds: as plain counts say. Ties go to the language that sorts first; very long texts count whole."""
    import zlib

    from brindle.llm import catalogue
    from brindle.llm.common import table

    d = table(spark, SF, "documents").select("doc_id", "text", "lang").collect()
    want = brute_language([(r.text, r.lang) for r in d if zlib.crc32(str(r.doc_id).encode()) % 3 != 1], [r.text for r in d])
    got = {r.doc_id: r for r in catalogue.queries()["op5_language"](spark, SF).collect()}
    for r, (lang, score) in zip(d, want, strict=True):
        assert (got[r.doc_id].lang_pred, round(got[r.doc_id].score, 4)) == (lang, round(score, 4))
    rows = [("der die das und", "de"), ("the and of", "en"), ("same", "de"), ("same", "en"), (None, "de"), ("nur", None)]
    ask = ["same", "und the", "UND die", "12 3", None, "", "the " * 40_000 + "und", "unbekannt", "ß", "andthe"]
    model = language.learn(spark.createDataFrame([(i, t, la) for i, (t, la) in enumerate(rows)], "doc_id long, text string, lang string"))
    got = language.identify(spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [(r.lang_pred, round(r.score, 4)) for r in got] == [(la, round(s, 4)) for la, s in brute_language(rows, ask)]


def test_backoff_reaches_shorter_grams():
    m = language.Backoff(["x", "y"], {0: {"abc": np.array([5, 1]), "def": np.array([5, 9])}, 2: {" q": np.array([1, 9]), "ab": np.array([5, 5])}, 1: {"z": np.array([9, 1]), "a": np.array([5, 9])}})
    assert m.word("abc")[0] > m.word("abc")[1] and m.word("qqq")[1] > m.word("qqq")[0] and m.word("zz")[0] > m.word("zz")[1]
    assert (m.word("k") == 0).all()


def test_licenses(spark, docs, empty):
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == docs.count() and all(r.n_base == 0 and r.first_word is None and r.labels == "" for r in got)
    rows = [
        (1, "Released UNDER the  MIT-license. x under/the mit license"), (2, "Licensed under the Apache License, Version 2.0."), (3, "CC BY-NC 4.0 cc by nd cc by nc"), (4, "under the mit licensed"),
        (5, "licensed under the terms of the GNU General Public License, version 3"), (6, "under the mit\x80 license"),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 6, "mit") and got[1].score > 0.75
    assert (got[2].base_labels, got[2].labels) == ("apache-2", "apache-2") and (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 0, 8)
    assert got[4].n_base == 0 and got[4].labels == "" and got[5].labels == "gpl-3" and got[5].n_base == 0 and got[6].n_base == 0
    assert licenses.scan_licenses(empty).count() == 0


def test_template_regions():
    a = licenses.compile_template("all <<o>>of the<</o>> text by <<v 2>> here <<mit|x y>> end")
    run = lambda s: a.match([w.encode() for w in s.split()], 0)
    assert run("all text by here mit end") == 6 and run("all of the text by a b here x y end z") == 11
    assert run("all of text by here mit end") is None and run("all text by a b c here mit end") is None


def test_lm(spark, docs, empty):
    fold = F.pmod(F.col("doc_id"), F.lit(5))
    got = lm.score_texts(docs, fold).collect()
    assert len(got) == docs.count()
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (4, 5, 6)) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_texts(empty, fold).count() == 0
    one = lm.score_texts(docs.where("doc_id = 1"), fold).first()  # nothing to learn from
    assert one.train_tokens == 0 and one.n_known == 0 and one.base_score == 0


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 0.02, 1.0])
def test_lm_counts_pairs_of_all_words(spark, frequent, monkeypatch):
    """Also rare words are contexts of their own: scores are those of a plain count of all bigrams, whatever is broadcast."""
    import random
    from collections import Counter

    monkeypatch.setattr(lm, "GROUP", 2000)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = [rng.choice(words)]
        while len(w) < 40:
            w.append(words[(words.index(w[-1]) * 7 + 1) % 120] if rng.random() < 0.7 else rng.choice(words[: rng.randint(1, 120)]))
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5, frequent=frequent).collect()}
    one, two = {}, {}
    for part in ("all", "fit"):
        own = [["<s>", *t.split(), "\n"] for i, t in rows if i % 5 != 1 and (part == "all" or i % 5 != 0)]
        one[part] = Counter(w for t in own for w in t)
        two[part] = Counter(p for t in own for p in zip(t, t[1:], strict=False))
    tokens = {k: sum(n for w, n in c.items() if w != "<s>") for k, c in one.items()}
    estimates = lambda k, a, b: (two[k][a, b] / max(1, one[k][a]), one[k][b] / tokens[k])
    held = [(int(lm.context_bucket(np.array([one["fit"][a]]))[0]), *estimates("fit", a, b)) for i, t in rows if i % 5 == 0 for w in [["<s>", *t.split(), "\n"]] for a, b in zip(w, w[1:], strict=False)]
    n = len(one["all"]) - 1
    lam = {}
    for bucket in {h[0] for h in held}:  # plain EM, token by token
        own, weight = np.array([[p2, p1, 1 / (n + 1)] for k, p2, p1 in held if k == bucket]), np.array([0.6, 0.3, 0.1])
        for _ in range(200):
            part = own * weight
            weight = np.maximum((part / part.sum(1, keepdims=True)).mean(0), 1e-6)
            weight /= weight.sum()
        lam[bucket] = weight
    lam = {k: lam[min(lam, key=lambda x: (abs(x - k), x))] for k in range(64)}
    for i, t in rows:
        w, s = ["<s>", *t.split(), "\n"], 0.0
        for a, b in zip(w, w[1:], strict=False):
            s += math.log10(lam[int(lm.context_bucket(np.array([one["all"][a]]))[0])] @ [*estimates("all", a, b), 1 / (n + 1)])
        assert got[i].score == pytest.approx(s, rel=2e-3) and got[i].n_tokens == len(w) - 1


def test_em_prefers_the_better_estimate():
    w = lm.expectation_maximisation(np.array([5, 5]), np.array([0.5, 0.4]), np.array([0.01, 0.02]), np.array([100, 50]), 1 / 13)
    assert w[5, 0] > 0.9 and np.allclose(w.sum(1), 1) and np.allclose(w[9], w[5])


def test_lm_base_columns(spark, docs):
    """Counts and the base score of every document of the smallest table and of odd texts, by a plain count."""
    import re
    import zlib
    from collections import Counter

    from brindle.llm import catalogue
    from brindle.llm.common import crc_fold, table

    def check(df, got):
        rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))) for r in df.select("doc_id", "text").collect()]
        train = Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for w in [*t, None])
        n, v = sum(train.values()), len(train)
        want = [(i, len(t) + 1, sum(train[w] > 0 for w in [*t, None]), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t, None]), 5)) for i, t in rows]
        assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == sorted(want, key=str)

    check(docs, lm.score_texts(docs, crc_fold("doc_id", 5)).collect())
    check(table(spark, SF, "documents"), catalogue.queries()["op7_lm"](spark, SF).collect())


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rows: sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    assert len(got) == docs.count() and key(got) == key(again)
    assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in got) and all(r.size == 0 for r in got if r.doc_id in (4, 5, 6))
    assert mixing.mix(empty).count() == 0
    out = mixing.repeat(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_mixing_keeps_rows_apart(spark, tmp_path):
    """Rows that differ in another column only, or in nothing, are taken each by its own decision; a crowd of equal rows is dealt over flights."""
    rows = [(1, "a b c", lang, "s") for lang in ("en", "de", "fr")] + [(2, "x " * 7, "en", "s")] * 300 + [(3, "y", "en", "t"), (None, "z z", None, None)] + [(i, "w " * (i % 9), "en", "t") for i in range(10, 60)]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, la, so, len(t)) for i, t, la, so in rows], DOCS).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    got = mixing.mix(docs, block=64).collect()
    assert len(got) == len(rows)
    for source in ("s", "t", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    out = [tuple(r) for r in mixing.repeat(docs, block=64).collect()]
    assert len(out) == sum(r.copies for r in got) and out and set(out) <= {tuple(r) for r in docs.collect()}
    most = 2
    assert all(sum(r[:3] == (1, "a b c", lang) for r in out) <= most for lang in ("en", "de", "fr"))
    assert sorted(map(str, out)) == sorted(str(tuple(r)) for r in mixing.repeat(docs, block=64).collect())


def test_targets():
    t = mixing.source_targets({"a": 100, "b": 10, None: 100})
    assert t["b"] == 20 - 0 or t["b"] < 20
    assert abs(sum(t.values()) - 315) < 1e-9 and all(t[k] <= 2 * s + 1e-9 for k, s in (("a", 100), ("b", 10), (None, 100)))
    assert mixing.source_targets({}) == {} and mixing.source_targets({"a": 0}) == {"a": 0.0}


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 500, 3000).astype(float)
    pi = np.full(3000, 0.37)
    out = mixing.flight(pi, size, np.random.default_rng(1))
    assert abs((out * size).sum() - (pi * size).sum()) < 1e-3 and abs(out.sum() - pi.sum()) < 1e-6
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    share = np.mean([mixing.flight(pi[:40], size[:40], np.random.default_rng(s)) for s in range(400)], 0)
    assert abs(share - 0.37).max() < 0.12  # each document keeps its own probability


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (9, 1), (9, None), (10, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = toxicity.learn(empty, labels.where("false"))
    assert toxicity.score(docs, none).count() == docs.count() and toxicity.score(empty, model).count() == 0


def test_machine_learns_a_pair():
    rng = np.random.default_rng(8)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append([t for t, on in ((1, a), (2, b)) if on] + [int(x) for x in rng.integers(10, 30, 3)])
        y.append(float(a and b))
    m = toxicity.fit([sorted(set(r)) for r in rows], np.array(y), 0.25, epochs=60)
    s = [m.raw(np.array([m.at[t] for t in r if t in m.at], int), np.array([sum(t in m.at for t in r)]))[0] for r in ([1], [2], [1, 2])]
    assert s[2] > 0 > max(s[:2])


def test_toxic_only_in_company(spark):
    """A word that is as frequent in clean documents as in toxic ones is in the model if it tells in company; with it a pair is found that no sum of weights finds. Scores are those of a plain evaluation."""
    import random

    rng = random.Random(3)
    filler = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(3000):
        insult = rng.random() < 0.3
        group = rng.random() < (0.5 if insult else 0.4)
        rows.append((i, " ".join([*rng.sample(filler, 12), *["dolt"] * insult, *["zorbs"] * group])))
        toxic = insult and group
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    ask = ["dolt " + " ".join(filler[:12]), "zorbs " + " ".join(filler[:12]), "dolt zorbs " + " ".join(filler[:12]), "Dolt, ZORBS!", "", None, "x " * 50_000 + "dolt zorbs"]
    got = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert got[2] > 0.5 > max(got[:2]) and got[3] > 0.5 and got[6] > 0.5 and got[4] == got[5] < 0.5
    for text, score in zip(ask, got, strict=True):
        own = sorted({model.at[b] for t in (text or "").split() for b in toxicity.buckets_of(t.encode()) if b in model.at})
        raw = model.bias + sum(model.weight[i] for i in own) + sum(model.factor[i] @ model.factor[j] for x, i in enumerate(own) for j in own[:x])
        assert score == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9)


def brute_repeats(rows, least=50):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    big = 1 << 62
    for i, b in raw:
        for p in range(len(b) - least + 1):
            k = b[p : p + least]
            seen[k] = min(seen.get(k, big * 2), big if i is None else i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - least + 1):
            if seen[b[p : p + least]] < (big if i is None else i):
                gone[p : p + least] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats(df, **kw):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, **kw).collect()), key=str)


def test_suffix_edges(spark, docs, empty):
    assert repeats(docs) == brute_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert suffixes.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot,small", [(False, False), (True, False), (False, True), (True, True)])
def test_suffix_against_brute_force(spark, hot, small, monkeypatch):
    """Passages of many lengths, low-entropy texts and one line that nearly all documents share; with small batches of mixed lengths and few places for copies, also in crowded anchors."""
    import random

    if small:
        for name, value in (("BATCH", 400), ("HOT", 3), ("HOT_IN_BATCH", 2), ("BLOCK", 2000), ("SALTS", 4)):
            monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(11)
    letters = "abcdefghij é"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 60, 120, 400)] + ["a" * 130, "ab" * 60]
    rows = []
    for i in range(160 if hot else 80):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            lo = rng.randint(0, len(p) // 3)
            parts += [p[lo : lo + rng.randint(40, 400)], text(rng.randint(0, 40))]
        if hot:
            parts.insert(rng.randint(0, len(parts)), passages[4])
        rows.append((rng.randint(0, 5000) if i % 20 else 7, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert repeats(df) == brute_repeats(rows)


def test_anchors_in_pieces(monkeypatch):
    """A text longer than the places of a hash is taken in pieces: each window has one anchor still, and equal windows have equal ones in any batch."""
    rng = np.random.default_rng(0)
    t = rng.integers(97, 101, 5000).astype(np.uint8)
    t[3000:3600] = t[200:800]
    ends = np.array([1500, 1500, 1530, 5000])
    monkeypatch.setattr(suffixes, "PLACE_BITS", 10)
    got = [x.tolist() for x in suffixes.anchors(t, ends, 50, 20)]
    of = {w: (a, w) for a, _, f, e in zip(*got, strict=True) for w in range(f, e + 1)}
    assert len(of) == sum(e - f + 1 for _, _, f, e in zip(*got, strict=True)) == 1451 + 3421
    assert all(of[3000 + i][0] == of[200 + i][0] for i in range(551))
    alone = [x.tolist() for x in suffixes.anchors(t[200:800], np.array([600]), 50, 20)]
    assert all(of[200 + w][0] == a for a, _, f, e in zip(*alone, strict=True) for w in range(f, e + 1))


def test_equal_bytes():
    t = np.frombuffer(b"abcabdabc", np.uint8)
    assert suffixes.equal_bytes(t, np.array([0, 0, 3]), np.array([3, 6, 6]), np.array([2, 3, 3]), most=1).tolist() == [True, True, False]


def test_two_stage_sort():
    import random

    rng = random.Random(2)
    for _ in range(60):
        alphabet = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        t = bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 200)))
        sa, key = suffixes.two_stage_sort(np.frombuffer(t, np.uint8), 256)
        pad = [(t[i:] + b"\0" * 300)[:264] for i in sa]
        assert sorted(sa.tolist()) == list(range(len(t))) and pad == sorted(pad)
        for x, y, n in zip(pad, pad[1:], suffixes.common_prefixes(key, sa, 50)[1:], strict=False):
            assert n == next((i for i in range(50) if x[i] != y[i]), 50)
