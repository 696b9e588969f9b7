"""Parsers from raw documents to rows.  Each takes (key, text) rows and returns (key, ...) rows.

They read whole documents in Arrow batches (mapInPandas): a document is one row in, its items are rows out, nothing is
shuffled.  A document that can't be parsed gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.constants import NUMBER_WORDS
from quillwork.session import bounded_batches

#: Items that leave a parser at a time, however many the documents of a batch hold.
PIECE = 2_000


def parsed(df: DataFrame, key: str, text: str, parse: Callable[[str], Iterator[tuple]], fields: str) -> DataFrame:
    """key, position and the fields of every item that `parse` yields from a row's text."""
    names = [f.strip().split()[0] for f in fields.split(", ")]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = ((k, i, *item) for k, t in zip(batch["key"], batch["text"], strict=True) if t for i, item in enumerate(parse(t)))
            while out := list(islice(found, PIECE)):
                yield pd.DataFrame(out, columns=["key", "position", *names], dtype=object)

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, position int, {fields}").withColumnRenamed("key", key)


def feed_items(xml: str) -> Iterator[tuple]:
    """url, title, summary (500 characters), date, author, tags (10, `|`-joined) of RSS items and Atom entries."""
    try:
        root = ElementTree.fromstring(xml.strip())
    except ElementTree.ParseError:
        return
    for node in root.iter():
        if node.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        found: dict[str, list] = {}
        for child in node:
            found.setdefault(child.tag.rpartition("}")[2].lower(), []).append(child)
        said = lambda *names: next((c.text.strip() for n in names for c in found.get(n, []) if c.text and c.text.strip()), None)  # noqa: E731, B023
        link = said("link") or next((c.get("href") for c in found.get("link", []) if c.get("href")), None) or said("guid", "id")
        author = said("creator", "author") or next((x.text for c in found.get("author", []) for x in c if x.text), None)
        tags = [c.text or c.get("term") for c in found.get("category", [])]
        summary = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", said("description", "summary", "content") or "")).strip()
        yield link, said("title"), summary[:500], said("pubdate", "published", "updated", "date"), author, "|".join(t.strip() for t in tags if t)[:500]


FEED_FIELDS = "url string, title string, summary string, date string, author string, tags string"


class _Links(HTMLParser):
    """Anchors with the heading they stand in and the nearest <time> before them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, bool, str | None]] = []
        self.depth, self.href, self.said, self.time, self.heads = 0, None, [], None, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if re.fullmatch("h[1-6]", tag):
            self.heads += 1
        elif tag == "time":
            self.time = named.get("datetime")
        elif tag == "a" and named.get("href"):
            self.href, self.said = named["href"], []

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.said.append(data)

    def handle_endtag(self, tag: str) -> None:
        if re.fullmatch("h[1-6]", tag):
            self.heads = max(0, self.heads - 1)
        elif tag == "a" and self.href is not None:
            self.found.append((self.href, re.sub(r"\s+", " ", "".join(self.said)).strip(), self.heads > 0, self.time))
            self.href = None


NAVIGATION = ("login", "contact", "subscribe", "privacy", "about", "home")


def listing_items(html: str, least: int = 25, navigation: Sequence[str] = NAVIGATION) -> Iterator[tuple]:
    """url, title, date of a listing page: linked headings first, then anchors with long words of a slug."""
    reader = _Links()
    reader.feed(html)
    seen: set[str] = set()
    for heading in (True, False):
        for href, title, inside, time in reader.found:
            slug = href.rstrip("/").rpartition("/")[2]
            good = inside if heading else len(title) >= least and slug.count("-") >= 3
            if good and title and href not in seen and not any(n in href.lower() for n in navigation):
                seen.add(href)
                yield href, title, time


LISTING_FIELDS = "url string, title string, date string"


def links(html: str) -> Iterator[tuple]:
    """href and text of every anchor."""
    reader = _Links()
    reader.feed(html)
    for href, title, _, _ in reader.found:
        yield href, title


LINK_FIELDS = "href string, anchor string"


def by_pattern(pattern: str) -> Callable[[str], Iterator[tuple]]:
    """A site's own parser: the named groups of a pattern, in order, for every match."""
    compiled = re.compile(pattern, re.S | re.I)
    return lambda text: (tuple(m.groupdict().values()) for m in compiled.finditer(text))


def calendar_events(ics: str) -> Iterator[tuple]:
    """uid, summary, start, end, zone, location, status of the top-level events of a calendar."""
    lines = re.sub(r"\r?\n[ \t]", "", ics).splitlines()
    event, nested = None, 0
    for line in lines:
        head, _, value = line.partition(":")
        name, *params = head.split(";")
        name = name.upper()
        if name == "BEGIN":
            if value.upper() == "VEVENT" and event is None:
                event = {}
            elif event is not None:
                nested += 1
        elif name == "END":
            if value.upper() == "VEVENT" and event is not None and not nested:
                yield tuple(event.get(k) for k in ("UID", "SUMMARY", "DTSTART", "DTEND", "TZID", "LOCATION", "STATUS"))
                event = None
            elif nested:
                nested -= 1
        elif event is not None and not nested:
            event[name] = re.sub(r"\\([nN,;\\])", lambda m: "\n" if m[1] in "nN" else m[1], value)
            zone = next((p.partition("=")[2] for p in params if p.upper().startswith("TZID=")), None)
            if zone:
                event["TZID"] = zone


CALENDAR_FIELDS = "uid string, summary string, start string, end string, zone string, location string, status string"


def caption_lines(vtt: str) -> Iterator[tuple]:
    """second, text of roll-up captions: the last line of each block, repeats dropped."""
    last = None
    for block in re.split(r"\n\s*\n", vtt.replace("\r", "")):
        m = re.search(r"(?:(\d+):)?(\d+):(\d+)[.,](\d+)\s*-->[^\n]*\n?", block)
        if not m:
            continue
        said = [re.sub(r"<[^>]*>", "", x).strip() for x in block[m.end() :].split("\n")]
        said = [x for x in said if x]
        if said and said[-1] != last:
            last = said[-1]
            yield int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3]) + int(m[4]) / 10 ** len(m[4]), last


CAPTION_FIELDS = "second double, said string"


def caption_events(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, second, said) of caption events in JSON: {"events": [{"tStartMs": .., "segs": [{"utf8": ..}]}]}."""
    schema = "events array<struct<tStartMs:long, segs:array<struct<utf8:string>>>>"
    rows = df.select(key, F.explode(F.from_json(json, schema)["events"]).alias("e"))
    said = F.trim(F.array_join(F.transform(F.coalesce(F.col("e.segs.utf8"), F.array()), lambda s: F.coalesce(s, F.lit(""))), ""))
    return rows.select(key, (F.col("e.tStartMs") / 1000).alias("second"), said.alias("said")).where("said <> ''")


def table_lines(words: DataFrame, page: str, tolerance: float = 3.0) -> DataFrame:
    """Positioned words (page, x, y, text) as lines: words whose y follow within the tolerance share one."""
    from pyspark.sql import Window

    w = Window.partitionBy(page).orderBy("y", "x", "text")
    new = F.when(F.col("y") - F.lag("y").over(w) <= tolerance, 0).otherwise(1)
    rows = words.withColumn("_new", new).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = F.array_sort(F.collect_list(F.struct("x", "text")))
    return rows.groupBy(page, "line").agg(F.min("y").alias("y"), cells.alias("words"))


def columns_of(words: DataFrame, page: str, width: float, least: int) -> DataFrame:
    """The x positions (in steps of `width`) that at least so many words of a page share."""
    rows = words.groupBy(page, (F.floor(F.col("x") / width) * width).alias("column")).agg(F.count("*").alias("n"))
    return rows.where(F.col("n") >= least)


def reconciled(votes: DataFrame, totals: DataFrame, key: str, position: str, n: str) -> DataFrame:
    """Whether a roll call's parsed votes add up to its printed totals, position by position."""
    counts = votes.groupBy(key, position).agg(F.count("*").alias("_counted"))
    both = totals.join(counts, [key, position], "full")
    same = F.coalesce(F.col(n), F.lit(0)) == F.coalesce(F.col("_counted"), F.lit(0))
    return both.groupBy(key).agg(F.bool_and(same).alias("reconciles"))


#: Characters that scans confuse, and what votes look like without them.
LOOKALIKES = (("0", "O"), ("1", "I"), ("5", "S"), ("|", "I"), ("l", "I"))


def vote_token(c, names: Sequence[str] = ("SI", "NO", "ABST", "AUS")):
    """A scanned token as a vote: look-alikes replaced, glued or cut spellings completed; null for anything else."""
    from functools import reduce

    plain = reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), LOOKALIKES, F.trim(c))
    plain = F.regexp_replace(F.upper(F.translate(plain, "íÍáÁóÓ", "iIaAoO")), "[^A-Z]", "")
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(plain.startswith(name), name).otherwise(out)
    return out


def prose_votes(text: str) -> Iterator[tuple]:
    """position, count, names (`|`-joined) of sentences like "in favour: 3 (A, B and C)"; counts must match the names."""
    kinds = {"SI": r"in favou?r|a favor", "NO": r"against|en contra", "ABST": r"abstentions?|abstenciones?"}
    for kind, words in kinds.items():
        m = re.search(rf"(?i)(?:{words})\s*:?\s*(\d+|[a-zé]+)\s*(?:\(([^)]*)\))?", text)
        if not m:
            continue
        count = int(m[1]) if m[1].isdigit() else NUMBER_WORDS.get(m[1].lower())
        names = [x.strip() for x in re.split(r",| and | y ", m[2] or "") if x.strip()]
        if count is not None:
            yield kind, count, "|".join(names) if len(names) == count else None


PROSE_FIELDS = "position_said string, count int, names string"
