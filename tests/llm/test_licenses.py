"""License scan: base columns and templates against plain regular expressions, one changed word, whole texts."""

import random
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from brindle.llm import catalogue, licenses
from brindle.llm.common import table
from brindle.llm.license_texts import TEMPLATES

ALL = [(label, i) for label, ts in TEMPLATES.items() for i in range(len(ts))]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def parts(template: str):
    for p in re.split(r"(<<[^>]*>>)", template):
        if p.startswith("<<"):
            inner = p[2:-2]
            yield ("open", None) if inner == "o" else ("close", None) if inner == "/o" else ("any", int(inner[2:])) if re.fullmatch(r"v \d+", inner) else ("or", inner.split("|"))
        else:
            yield "fixed", words_of(p)


def expand(template: str, rng: random.Random, full: bool | None = None) -> tuple[list[str], list[bool]]:
    """A text that the template accepts, and which of its words are mandatory."""
    out, must, skip = [], [], []
    for kind, x in parts(template):
        if kind == "open":
            skip.append(rng.random() < 0.5 if full is None else not full)
        elif kind == "close":
            skip.pop()
        elif not any(skip):
            own = x if kind == "fixed" else words_of(rng.choice(x)) if kind == "or" else [f"zz{k}" for k in range(rng.randint(0, x))]
            out += own
            must += [kind == "fixed" and not skip] * len(own)
    return out, must


def pattern(template: str) -> re.Pattern:
    """The template as a regular expression over words that are followed by a space each."""
    out = []
    for kind, x in parts(template):
        out.append({"open": "(?:", "close": ")?"}.get(kind) or ("".join(f"{w} " for w in x) if kind == "fixed" else "(?:" + "|".join("".join(f"{w} " for w in words_of(a)) for a in x) + ")" if kind == "or" else r"(?:\S+ ){0,%d}" % x))
    return re.compile(r"(?<!\S)" + "".join(out))


@pytest.mark.parametrize("label,i", ALL)
def test_templates_accept_their_texts_only(label, i):
    template, rng = TEMPLATES[label][i], random.Random(f"{label}{i}")
    scanner = licenses.Scanner({}, {label: [template]})
    scan = lambda words: scanner.scan(" ".join(words).encode())[4]
    for full in (True, False, None, None):
        words, must = expand(template, rng, full)
        assert scan(["before", *words, "after"]) == label
        # one changed, missing or doubled mandatory word and the text is another
        for at in rng.sample([k for k, m in enumerate(must) if m], min(8, sum(must))):
            for other in (["changed"], []):
                bad = words[:at] + other + words[at + 1 :]
                assert bool(scan(bad)) == bool(pattern(template).search("".join(f"{w} " for w in bad))), bad
            if len(words) > 12 and 3 < at < len(words) - 3:
                assert scan(words[:at] + ["changed"] + words[at + 1 :]) == ""


def test_against_regular_expressions():
    """Random mixtures of pieces of all templates: the labels are those of plain regular expressions."""
    rng = random.Random(4)
    scanner = licenses.Scanner(licenses.PHRASES, TEMPLATES)
    patterns = [(label, pattern(t)) for label, ts in TEMPLATES.items() for t in ts]
    found = 0
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 3)):
            label, i = rng.choice(ALL)
            own, _ = expand(TEMPLATES[label][i], rng)
            lo = rng.choice([0, 0, 0, rng.randint(0, len(own))])
            words += own[lo:] + [rng.choice(["and", "the", "license", "under"]) for _ in range(rng.randint(0, 3))]
        text = "".join(f"{w} " for w in words)
        want = {label for label, p in patterns if p.search(text)}
        want |= {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in f" {text}"}
        got = scanner.scan(text.encode())[4]
        assert got == ",".join(sorted(want)), text
        found += bool(want)
    assert found > 100


def test_template_without_mandatory_word():
    scanner = licenses.Scanner({}, {"x": ["<<a|b c>> <<o>>d<</o>>"], "any": ["<<v 2>>"]})
    assert scanner.scan(b"b c d")[4] == "any,x" and scanner.scan(b"q")[4] == "any" and scanner.scan(b"")[4] == ""


def brute_base(text: str) -> tuple:
    words = words_of(text)
    at = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_base_columns(spark):
    """All documents of the smallest table, and texts with odd characters and ties."""
    odd = [(-1, None), (-2, ""), (-3, "UNDER THE MIT LICENSE " * 3 + "cc by nc"), (-4, "under the mit license"), (-5, "Ünder the mit license cc-by/nc by nc"), (-6, "w " * 40_000 + "apache license version 2"), (-6, "cc by nc"), (None, "cc by nc")]
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(docs).collect()]
    assert sorted(got, key=str) == sorted(((r.doc_id, *brute_base(r.text or "")) for r in docs.collect()), key=str)
    full = catalogue.queries()["op6_licenses"](spark, SF)
    assert full.where("score < 0 or score > 1 or (n_base = 0) <> (base_labels = '') or first_word > last_word").count() == 0
    assert full.where(F.size(F.array_except(F.split("base_labels", ","), F.split("labels", ","))) > 0).count() == 0
