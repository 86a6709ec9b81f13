"""Language identification by word-first backoff (operator 5)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import crc_fold, cut, give_back, small_batches, table, texts, tidy

WORD = re.compile(r"[^\W\d_]+")
#: Documents of each language that are learned from at most, entries of a worker's memo.
SAMPLE_PER_LANG, MEMO = 4000, 300_000
LONGEST_GRAM = 4


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Backoff:
    """Log frequencies of words and of character n-grams by language.

    A known word scores by its own log frequencies. An unseen word falls back to its character 4-grams, then 3-, 2- and
    1-grams: the first length of which a gram is known decides, by the mean of the known ones.
    """

    def __init__(self, langs: list[str], entries: dict[int, dict[str, np.ndarray]] | None = None):
        self.langs = langs
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for kind, rows in (entries or {}).items():
            if rows:
                self.add(kind, keys_of(list(rows)), np.array(list(rows.values()), np.float64))

    def add(self, kind: int, keys: np.ndarray, counts: np.ndarray) -> None:
        """Words (kind 0) or n-grams (kind n) by their hashes with their counts, a column a language; what is equally frequent in all languages says nothing."""
        order = np.argsort(keys)
        logs = np.log(counts[order] + 0.1)
        logs -= np.log(counts.sum(0) + 0.1 * len(keys))
        logs -= logs.mean(1, keepdims=True)
        self.tables[kind] = (keys[order], logs.astype(np.float32))

    def find(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Row of each hash in the table of a kind, -1 where it is unknown."""
        if kind not in self.tables or not len(keys):
            return np.full(len(keys), -1)
        own = self.tables[kind][0]
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return np.where(own[at] == keys, at, -1)

    def rows(self, words: list[str]) -> np.ndarray:
        """Scores of words, a column a language; zeros where nothing of a word is known."""
        out = np.zeros((len(words), len(self.langs)))
        at = self.find(0, keys_of(words))
        known = at >= 0
        if known.any():
            out[known] = self.tables[0][1][at[known]]
        left = np.flatnonzero(~known)
        for n in range(LONGEST_GRAM, 0, -1):
            if not len(left):
                break
            grams = [grams_of(words[i], n) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            at = self.find(n, keys_of(list(chain.from_iterable(grams))))
            owner, at = owner[at >= 0], at[at >= 0]
            if len(at):
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                out[left[owner[first]]] = np.add.reduceat(self.tables[n][1][at], first, 0) / np.diff(np.concatenate([first, [len(at)]]))[:, None]
                left = np.delete(left, owner[first])
        return out

    def word(self, w: str) -> np.ndarray:
        return self.rows([w])[0]


def keys_of(grams: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, map(str.encode, grams)), np.uint64, len(grams))


class _Rows(dict):
    """Row number of each word's scores."""

    def __init__(self, model: Backoff):
        super().__init__()
        self.model, self.rows = model, np.zeros((1024, len(model.langs)), np.float32)

    def fill(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self]
        if new:
            first = len(self)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(new)] = self.model.rows(new)
            self.update(zip(new, range(first, first + len(new)), strict=True))


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", per_lang: int = SAMPLE_PER_LANG) -> Backoff:
    """A model from rows whose label is not null: at most about ``per_lang`` of each language, chosen by a hash of the key (a bounded
    sample of labelled rows; rows that share a key are chosen together). The model has every word and every gram of the sample with its frequency, in which repeats within a document are damped to the logarithm, so that its size follows the sample, not the input."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull())
    count = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    langs = sorted(count)
    if not langs:
        return Backoff([], {})
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, per_lang / v))) for k, v in count.items()))
    lang = F.col(lang_col).cast("string")
    u = F.pmod(F.xxhash64(F.col(key_col), F.lit("language")), F.lit(1_000_000)) / 1e6
    sample = rows.where(u < F.element_at(share, lang)).select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = total.setdefault(lang, Counter())
                for w, c in Counter(words_of(raw.decode())).items():
                    own[w] += c.bit_length()  # 1, 2 for two and three, 3 for four to seven: one repetitive text must not outweigh the others
        for lang, words in total.items():
            grams = [words, *(Counter() for _ in range(LONGEST_GRAM))]
            for w, c in words.items():
                for n in range(1, LONGEST_GRAM + 1):
                    for g in grams_of(w, n):
                        grams[n][g] += c
            for kind, counts in enumerate(grams):
                rows = list(counts.items())
                for lo in range(0, len(rows), 50_000):
                    part = rows[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([langs.index(lang)] * len(part), pa.int32()), pa.array([kind] * len(part), pa.int32()), pa.array(keys_of([p[0] for p in part]).view(np.int64)), pa.array([p[1] for p in part], pa.int64())], ["lang", "kind", "key", "n"])

    sums = [F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(langs))]
    counts = cut(sample.mapInArrow(tidy(run), "lang int, kind int, key long, n long").groupBy("kind", "key").agg(*sums))
    model = Backoff(langs)
    for kind in range(LONGEST_GRAM + 1):
        own = counts.where(F.col("kind") == kind).drop("kind").toArrow()
        if own.num_rows:
            model.add(kind, own.column(0).to_numpy().view(np.uint64), np.column_stack([c.to_numpy() for c in own.columns[1:]]))
        del own
    give_back()
    return model


def score_batch(model: Backoff, memo: _Rows, raw: list[bytes]) -> tuple[list[str], list[float]]:
    if len(memo) > MEMO:
        memo.clear()
    words: list[str] = []
    ends, real = [0], []
    for x in raw:
        w = words_of(x.decode())
        real.append(bool(w) and (w[0][0].isalpha() or any(c.isalpha() for y in w for c in y)))
        words.extend(w)
        ends.append(len(words))
    if not model.langs:
        return ["und"] * len(raw), [0.0] * len(raw)
    memo.fill(words)
    at = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
    scores = memo.rows[at].astype(float) if len(at) else np.zeros((0, len(model.langs)))
    sums = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(scores, 0)])
    total = sums[ends[1:]] - sums[ends[:-1]]
    n = np.diff(ends)[:, None]
    # the mean over words, weighed as a few dozen independent words at most, so that a score tells clear texts from mixed ones
    z = total / np.maximum(n, 1) * np.minimum(n, 24)
    z = np.exp(z - z.max(1, keepdims=True))
    p = z / z.sum(1, keepdims=True)
    best = p.argmax(1)
    return [model.langs[b] if r else "und" for b, r in zip(best, real, strict=True)], [float(p[i, b]) if r else 0.0 for i, (b, r) in enumerate(zip(best, real, strict=True))]


def identify(docs: DataFrame, model: Backoff, text_col: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (0 to 1) of every whole text; only the text is an input.

    The languages' mean log frequencies over all words of a text count as the evidence of as many independent words as it has, at most 24: words of a text depend on each other, and longer texts would all score 0 or 1. The predicted
    language doesn't depend on it. A text that is null or has no letter gets ``und`` and 0; so does every text if no language was learned. Ties go to the language that sorts first. Each row is judged alone
    (repeats alike); other columns are ignored.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = text_col in [k for k in keep if isinstance(k, str)]  # then the text travels once
    ids = docs.select(*keep) if own else docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    at, fields = (list(keep).index(text_col), ids.schema.fields) if own else (len(keep), ids.schema.fields[:-1])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Rows(held.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                lang, score = score_batch(held.value, memo, texts(part.column(at)))
                n = len(fields)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names[:n], "lang_pred", "score"])

    return ids.mapInArrow(tidy(run), schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod 3 is not 1; those with remainder 1 are held out. A null id is not held out and not learned from."""
    d = table(spark, sf_dir, "documents")
    fold = crc_fold("doc_id", 3)
    model = learn(d.where(fold != 1))
    return identify(d, model, keep=("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out")))
