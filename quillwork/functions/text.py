"""Text functions: column in, column out, all inside the JVM unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ACCENTED = "áàâäãåāăąçćčďđéèêëēėęěğíìîïīįłñńňóòôöõøōőřśšşťúùûüūůűýÿžźż"
_BARE = "aaaaaaaaacccddeeeeeeeegiiiiiilnnnoooooooorssstuuuuuuuyyzzz"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def fold(c: Column | str) -> Column:
    """Lower case, accents off, white space collapsed: the form in which texts are compared (F1)."""
    return collapse(F.translate(F.lower(col(c)), _ACCENTED, _BARE))


def fold_words(c: Column | str) -> Column:
    """`fold`, and punctuation becomes space (F2)."""
    return collapse(F.regexp_replace(fold(c), r"[^\p{L}\p{N}\s]+", " "))


def words(c: Column | str, least: int = 1) -> Column:
    """The words of a folded text with at least so many letters, in order."""
    return F.filter(F.split(fold_words(c), " "), lambda w: F.length(w) >= least)


def distinct_words(c: Column | str, least: int = 1) -> Column:
    return F.array_sort(F.array_distinct(words(c, least)))


def html_text(c: Column | str) -> Column:
    """Text of an HTML page: scripts, styles and comments go, blocks end lines, entities are read."""
    out = F.regexp_replace(col(c), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|ul|ol|table|article|section)\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for name, char in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\x0B\f\r ]+", " ")
    return F.trim(F.regexp_replace(out, r" *\n[ \n]*", "\n"))


@F.pandas_udf(T.StringType())
def repair_encoding(c: pd.Series) -> pd.Series:
    """UTF-8 that was read as Windows-1252 becomes itself again; other texts stay.

    The JVM offers no Windows-1252 codec to expressions, so this is an Arrow-batched pandas UDF.
    """

    def repair(s: str | None) -> str | None:
        if s is None or not ("Ã" in s or "Â" in s or "â" in s):
            return s
        try:
            return s.encode("cp1252").decode("utf-8")
        except UnicodeError:
            return s

    return c.map(repair)


def clean_title(c: Column | str, prefixes: Sequence[str] = (), suffixes: Sequence[str] = ()) -> Column:
    """A title without its list marker, boilerplate prefix and source suffix (F5); the parts are regular expressions."""
    out = F.regexp_replace(collapse(c), r"^(?:\d+[.)]|[-*•])\s+", "")
    if prefixes:
        out = F.regexp_replace(out, f"(?i)^(?:{'|'.join(prefixes)})[\\s:,-]*", "")
    if suffixes:
        out = F.regexp_replace(out, f"(?i)\\s*[-|–]\\s*(?:{'|'.join(suffixes)})\\s*$", "")
    return out


def title_kernel(c: Column | str, boilerplate: Sequence[str]) -> Column:
    """A folded title without any leading boilerplate, however often, and trailing numbers in brackets."""
    head = F.regexp_replace(fold(c), f"^(?:(?:{'|'.join(boilerplate)})\\b[\\s:,]*)+", "")
    return F.trim(F.regexp_replace(head, r"(?:\s*\(\d+\))+\s*$", ""))


def before(c: Column | str, marks: Sequence[str]) -> Column:
    """The text up to the first of several marks; all of it if there is none."""
    return F.trim(F.regexp_extract(col(c), rf"(?s)^(.*?)(?:{'|'.join(marks)}|$)", 1))


def first_label(c: Column | str, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that the text matches (F8)."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(col(c).rlike(pattern), F.lit(label)).otherwise(out)
    return out


def references(c: Column | str, low: int = 1, high: int = 30_000) -> Column:
    """Numbers of the references `N/YYYY` or `N/YYYY-XX` in a text, distinct, in order of appearance, in range."""
    found = F.regexp_extract_all(col(c), F.lit(r"\b0*(\d{1,9})/(?:19|20)\d\d(?:-[A-Z]{1,4})?\b"), F.lit(1))
    numbers = F.transform(found, lambda n: n.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n.between(low, high)))


def with_short_numbers(c: Column | str) -> Column:
    """The text with its zero-padded numbers added without zeros, so that either form is found (F16)."""
    padded = F.regexp_extract_all(col(c), F.lit(r"\b0+([1-9]\d*)\b"), F.lit(1))
    return F.when(F.size(padded) > 0, F.concat_ws(" ", col(c), F.array_join(F.array_distinct(padded), " "))).otherwise(col(c))


def people(c: Column | str) -> Column:
    """`NAME(TYPE)/NAME(TYPE)` as array<struct<name, type>>; entries without a name are dropped."""
    parts = F.transform(
        F.split(col(c), "/"),
        lambda p: F.struct(
            F.trim(F.regexp_replace(p, r"\([^)]*\)", "")).alias("name"), F.nullif(F.trim(F.regexp_extract(p, r"\(([^)]*)\)", 1)), F.lit("")).alias("type")
        ),
    )
    return F.filter(parts, lambda p: p["name"] != "")


def first_type(c: Column | str) -> Column:
    return F.get(F.filter(people(c), lambda p: p["type"].isNotNull()), F.lit(0))["type"]


def corrected(c: Column | str, fixes: Mapping[str, str]) -> Column:
    """Exact replacements of known misspellings."""
    if not fixes:
        return col(c)
    known = F.create_map(*[F.lit(x) for kv in sorted(fixes.items()) for x in kv])
    return F.coalesce(known[col(c)], col(c))


def content_id(c: Column | str, read: int = 2000, length: int = 16) -> Column:
    """Prefix of the SHA-1 of a text's first characters."""
    return F.substring(F.sha1(F.substring(col(c), 1, read)), 1, length)


def negative_id(c: Column | str) -> Column:
    """A stable id below zero, apart from all assigned ones: 48 bits of the MD5."""
    return -F.conv(F.substring(F.md5(col(c)), 1, 12), 16, 10).cast("long") - 1


def section(c: Column | str, heading: str) -> Column:
    """The lines from a heading, "# ..." that begins so, to the next one; lines of a page number alone go; null without it."""
    form = rf"(?is)(?:^|\n)#\s*\Q{heading}\E[^\n]*\n(.*?)(?=\n#|$)"
    lines = F.regexp_replace(F.regexp_extract(col(c), form, 1), r"(?m)^\s*\d+\s*$\n?", "")
    return F.when(col(c).rlike(form), F.trim(F.regexp_replace(lines, r"\n+$", "")))


def shortened(c: Column | str, most: int = 300) -> Column:
    """At most so many characters, cut at a space, with an ellipsis."""
    cut = F.regexp_replace(F.substring(col(c), 1, most), r"\s+\S*$", "")
    return F.when(F.length(col(c)) > most, F.concat(cut, F.lit("…"))).otherwise(col(c))


def contains_folded(c: Column | str, part: Column | str) -> Column:
    """Whether a text holds another, whatever their accents and case (P5)."""
    return F.contains(fold(c), fold(part))


def snippet(c: Column | str, at: Column, size: Column, margin: int = 80) -> Column:
    """The characters about a match at a position from one."""
    start = F.greatest(F.lit(1), at - margin)
    return F.substring(col(c), start, at + size + margin - start)


def has_all_tokens(query: str, *fields: Column | str) -> Column:
    """Whether every word of a query stands in the fields, accents and case aside."""
    import re
    import unicodedata

    plain = "".join(ch for ch in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(ch))
    body = fold(F.concat_ws(" ", *[col(f) for f in fields]))
    out = F.lit(True)
    for token in re.findall(r"\S+", plain):
        out = out & F.contains(body, F.lit(token))
    return out


def natural_key(c: Column | str, width: int = 12) -> Column:
    """Sort key in which numbers compare by value: every number is padded with zeros; blanks become null."""
    padded = F.array_join(
        F.transform(
            F.regexp_extract_all(fold(c), F.lit(r"(\d+|\D+)"), F.lit(1)),
            lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p),
        ),
        "",
    )
    return F.when(F.trim(col(c)) == "", F.lit(None)).otherwise(padded)
