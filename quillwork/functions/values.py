"""Numbers, arrays, maps, JSON and similarities."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import NUMBER_WORDS
from .text import col, fold

def number(c: Column | str, words: Mapping[str, int] = NUMBER_WORDS) -> Column:
    """The number in a text: its digits, else its first number word, else null."""
    digits = F.regexp_extract(col(c), r"(\d{1,9})", 1)
    word = F.regexp_extract(fold(c), rf"\b({'|'.join(words)})\b", 1)
    known = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.when(digits != "", digits.cast("int")).when(word != "", known[word])


def level(score: Column | str, high: float = 0.62, medium: float = 0.55) -> Column:
    """high, medium or low; empty for a missing score."""
    s = col(score)
    return F.when(s.isNull() | F.isnan(s), "").when(s >= high, "high").when(s >= medium, "medium").otherwise("low")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared share of two sets; 0 if both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, F.size(F.array_intersect(col(a), col(b))) / union).otherwise(0.0)


def overlap(a: Column | str, b: Column | str) -> Column:
    """Shared share of the smaller set."""
    least = F.least(F.size(F.array_distinct(col(a))), F.size(F.array_distinct(col(b))))
    return F.when(least > 0, F.size(F.array_intersect(col(a), col(b))) / least).otherwise(0.0)


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings (F23); no built-in computes it, so this is Arrow-batched."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def prepend_if_absent(values: Column | str, value: Column) -> Column:
    """The array with a value in front, unless it holds it."""
    return F.when(F.array_contains(col(values), value), col(values)).otherwise(F.array_prepend(col(values), value))


def tagged(tags: Column | str, tag: Column, separator: str = r"\|", every: str = "all") -> Column:
    """Whether a delimited list names a tag, or the tag for everything."""
    held = F.transform(F.split(col(tags), separator), F.trim)
    return F.array_contains(held, tag) | F.array_contains(held, F.lit(every))


def merged_maps(first: Column, second: Column) -> Column:
    """Both maps' entries, the second's values where both have a key."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def changed(before: Column | str, after: Column | str) -> Column:
    """Whether a text differs, where null and empty are the same."""
    return ~F.nullif(col(before).cast("string"), F.lit("")).eqNullSafe(F.nullif(col(after).cast("string"), F.lit("")))
