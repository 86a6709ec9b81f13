"""License scans by template-markup matching (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import small_batches, table, texts, tidy
from brindle.llm.license_texts import TEMPLATES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
IS_WORD = np.array([i >= 128 or chr(i).isascii() and chr(i).isalnum() for i in range(256)])
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))

# The three base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

@dataclass
class Automaton:
    """States 0..n over tokens: ``step[s]`` maps a word to next states, ``free[s]`` to next states on any word, ``skip[s]`` needs no word. ``anchor``
    is a mandatory word, null if there is none."""

    step: list[dict[bytes, list[int]]]
    free: list[list[int]]
    skip: list[list[int]]
    last: int
    anchor: bytes | None
    size: int

    def close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[bytes], at: int) -> int | None:
        """End (exclusive) of the longest text from ``at`` that the automaton accepts."""
        states, end = self.close({0}), None
        for i in range(at, min(len(words), at + self.size) + 1):
            if self.last in states:
                end = i
            if i >= len(words):
                break
            new: set[int] = set()
            for s in states:
                new.update(self.step[s].get(words[i], ()))
                new.update(self.free[s])
            if not new:
                break
            states = self.close(new)
        return end


def template_words(text: str) -> list[bytes]:
    return WORD.findall(text.encode().translate(LOWER))


def compile_template(text: str) -> Automaton:
    """Token automaton of a template with optional (``<<o>>``), replaceable (``<<v N>>``) and alternative (``<<a|b>>``) regions. Its words are taken like those of a text."""
    step: list[dict] = [{}]
    free: list[list[int]] = [[]]
    skip: list[list[int]] = [[]]
    fixed: list[bytes] = []
    size = 0

    def state() -> int:
        step.append({})
        free.append([])
        skip.append([])
        return len(step) - 1

    def words(start: int, run: str) -> int:
        for w in template_words(run):
            new = state()
            step[start].setdefault(w, []).append(new)
            start = new
        return start

    at, opened = 0, []
    for part in re.split(r"(<<[^>]*>>)", text):
        if part == "<<o>>":
            opened.append(at)
        elif part == "<</o>>":
            skip[opened.pop()].append(at)
        elif part.startswith("<<v "):
            n = int(part[4:-2])
            ends = [at]
            for _ in range(n):
                new = state()
                free[at].append(new)
                ends.append(new)
                at = new
            for e in ends[:-1]:
                skip[e].append(at)
            size += n
        elif part.startswith("<<"):
            ends = [words(at, alt) for alt in part[2:-2].split("|")]
            at = state()
            for e in ends:
                skip[e].append(at)
            size += max(len(template_words(a)) for a in part[2:-2].split("|"))
        else:
            at = words(at, part)
            own = template_words(part)
            size += len(own)
            if not opened:
                fixed += own
    return Automaton(step, free, skip, at, max(fixed, key=len, default=None), size)


class Scanner:
    """All automata; a text is tokenised only if it holds a mandatory word of one of them."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.base = [(compile_template(p), label) for p, label in phrases.items()]
        self.more = [(compile_template(t), label) for label, ts in templates.items() for t in ts]
        self.anchors = sorted({a.anchor for a, _ in self.base + self.more if a.anchor})
        self.always = any(a.anchor is None for a, _ in self.base + self.more)

    def scan(self, low: bytes) -> tuple[int, int | None, int | None, str, str, float, list]:
        if not self.always and not any(a in low for a in self.anchors):
            return 0, None, None, "", "", 0.0, []
        found = list(WORD.finditer(low))
        words = [m.group() for m in found]
        where: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            where.setdefault(w, []).append(i)

        def runs(auto: Automaton) -> Iterator[tuple[int, int]]:
            if auto.anchor is None or auto.anchor in where:
                starts = set()
                for s in auto.close({0}):
                    for w in auto.step[s]:
                        starts.update(where.get(w, ()))
                    if auto.free[s]:
                        starts.update(range(len(words)))
                for i in sorted(starts):
                    end = auto.match(words, i)
                    if end is not None and end > i:
                        yield i, end

        base, spans, labels, covered = [], [], set(), 0
        base_labels = set()
        for auto, label in self.base:
            for i, _ in runs(auto):
                base.append(i)
                base_labels.add(label)
        for auto, label in self.more:
            for i, end in runs(auto):
                labels.add(label)
                covered += end - i
                spans.append((label, found[i].start(), found[end - 1].end()))
        score = min(1.0, 0.75 + covered / max(1, len(words)) / 4) if labels else 0.5 if base else 0.0
        return len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), score, spans


def count_words(raw: list[bytes]) -> np.ndarray:
    """Words of each text: places where a word byte follows another kind of byte."""
    if not raw:
        return np.zeros(0, np.int64)
    is_word = IS_WORD[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    start = is_word.copy()
    start[1:] &= ~is_word[:-1]
    ends = np.cumsum([len(x) + 1 for x in raw])
    return np.diff(np.concatenate([[0], np.cumsum(start)[ends - 1]])).astype(np.int64)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: word count, base places, base labels, all labels, a score and the matched byte spans of the templates.

    Words are maximal runs of ASCII letters and digits and of bytes above 127, after A-Z is lowered. ``score`` is 0 without a place, 0.5 with base phrases only and
    0.75 to 1 where a template accepts a run of words (more where it covers more of the text). A null text counts as empty: 0 words,
    empty labels, null places. Repeated rows give repeated rows; other columns are ignored. No shuffle; very long texts are scanned whole.
    """
    small_batches(docs.sparkSession)
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates  # label: templates, see license_texts
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long>>"
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                raw = texts(part.column(1))
                got = [scanner.scan(x.translate(LOWER)) for x in raw]
                col = lambda k, t, got=got: pa.array([g[k] for g in got], t)
                spans = pa.array([[{"label": a, "start": b, "stop": c} for a, b, c in g[6]] for g in got], span)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count_words(raw)), col(0, pa.int64()), col(1, pa.int64()), col(2, pa.int64()), col(3, pa.string()), col(4, pa.string()), col(5, pa.float64()), spans],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
