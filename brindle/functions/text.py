"""Text rules as column expressions, driven by rule tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: A character outside ASCII: only such texts are sent to Python to be decomposed.
WIDE = r"[^\x00-\x7F]"


def _plain_of(chars: pd.Series) -> pd.Series:
    """Of each character of a text that a compatibility decomposition without combining marks changes: itself, followed by what becomes of it."""
    plain = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    return chars.map(lambda t: [c + plain(c) for c in t if plain(c) != c], na_action="ignore")


_changes = F.pandas_udf(_plain_of, ArrayType(StringType()))
#: The same, but what is made of it is worked out where it stands: no condition on it is moved below it or repeated on other tables.
_changes_here = F.pandas_udf(_plain_of, ArrayType(StringType())).asNondeterministic()


def strip_accents(c: Column, here: bool = False) -> Column:
    """Compatibility decomposition without the combining marks, character by character (marks alone depend on their order, and they go). ASCII texts stay in the JVM; of others Python sees each
    character once, never the text, so that its memory does not depend on the length of texts. With ``here`` conditions on the result stay above it."""
    wide = F.array_join(F.array_distinct(F.regexp_extract_all(c, F.lit(WIDE), 0)), "")
    changes = (_changes_here if here else _changes)(F.when(c.rlike(WIDE), wide))
    return F.aggregate(F.coalesce(changes, F.array().cast("array<string>")), c, lambda s, x: F.replace(s, F.substring(x, 1, 1), F.substr(x, F.lit(2))))


def norm(c: Column, here: bool = False) -> Column:
    """Platform form: lower case, no accents, only word characters of any script and . , / × - ' \" kept, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(F.replace(c, F.lit("\u00a0"), F.lit(" "))), here), "(?U)[^\\w\\s.,/×'\"-]", " "), r"(?U)\s+", " "))


def legacy_norm(c: Column) -> Column:
    """Older form that keeps punctuation; the two are not interchangeable."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(F.replace(c, F.lit("\u00a0"), F.lit(" ")))), r"(?U)\s+", " "))


def tokens(c: Column, here: bool = False) -> Column:
    return F.array_distinct(F.regexp_extract_all(norm(c, here), F.lit("[a-z]{3,}"), 0))


def first_match(c: Column, rules: Sequence[tuple], default: str | None = None) -> Column:
    """Code of the first rule of an ordered list whose pattern occurs; a rule (code, pattern, exclusion) doesn't hold where the exclusion occurs too, so that a later rule may."""
    out = F.lit(default)
    for code, pattern, *exclusion in reversed(rules):
        holds = c.rlike(pattern) & ~c.rlike(exclusion[0]) if exclusion and exclusion[0] else c.rlike(pattern)
        out = F.when(holds, code).otherwise(out)
    return out


def all_matches(c: Column, rules: Sequence[tuple[str, str]], most: int = 3) -> Column:
    return F.concat_ws(", ", F.slice(F.array_compact(F.array(*[F.when(c.rlike(p), code) for code, p in rules])), 1, most))


def dedup_key(title: Column, seller: Column) -> Column:
    """A run of digits becomes one #, what is neither a to z, # nor a space goes; the set of tokens is sorted, the seller added, the first 16 hex digits of sha1 kept. A null title counts as empty."""
    t = F.regexp_replace(F.regexp_replace(norm(F.coalesce(title, F.lit(""))), r"(?U)\d+", "#"), "[^a-z# ]", "")
    words = F.array_sort(F.array_distinct(F.filter(F.split(t, " "), lambda x: x != "")))
    return F.substring(F.sha1(F.concat(F.concat_ws(" ", words), F.lit("|"), F.coalesce(seller, F.lit("")))), 1, 16)


def sku_key(brand: Column, form: Column, pattern: Column) -> Column:
    return F.when(form.isNotNull(), F.concat_ws("|", brand, form, F.coalesce(pattern, F.lit("-"))))
