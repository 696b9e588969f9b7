"""Benchmark decontamination with a generalised suffix automaton (operator 5).

The automaton of all normalised test items is built on every worker from the item texts.  A document's words stream
through it; at each word the state and its matched length tell whether the last `window` words, or a whole shorter
item, occur in an item.  Runs of words whose neighbouring pairs do not all occur in some item cannot hold a match and
are skipped before the automaton, which changes no result.

Items of more than `block_chars` characters are dealt into blocks, each of which is broadcast and scanned for by itself.
The first block's pass gives a row for each document; of the others only documents with hits are written, once for each
text, and joined to it by 128 bits of the text.  With one block nothing is shuffled.

`clean` drops documents that the coverage limit calls contaminated, and cuts longer spans out of the others.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, arrow_append, table, texts, written
from .oracles import OP5

WINDOW = 13
#: Words of a span that is cut out of a document which is otherwise kept.
LONG_SPAN = 50
BLOCK_CHARS = 2_000_000


class Automaton:
    """Generalised suffix automaton of word-id sequences, with the items behind each window state."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        own: list[set] = [set()]
        whole: dict[int, set] = {}
        pairs, self.least = set(), window
        for item, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab)) for w in text.translate(FOLD).split()]
            if not words:
                continue
            pairs.update(zip(words, words[1:], strict=False))
            last, name = 0, {item}
            for w in words:
                last = self._extend(last, w, own)
                own[last] |= name
            if len(words) < window:
                whole.setdefault(last, set()).update(name)
                self.least = min(self.least, len(words))
        self.pairs = np.sort(np.array([a * len(self.vocab) + b for a, b in pairs], np.int64))
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        for s in reversed(order):  # windows of a state also end where its longer extensions end
            if (p := self.link[s]) > 0 and self.len[p] >= window:
                own[p] |= own[s]
        self.top, self.short = [0] * len(self.len), [()] * len(self.len)
        for s in order:
            p = self.link[s]
            self.top[s] = self.top[p] if self.len[p] >= window else s
            self.short[s] = (((self.len[s], frozenset(whole[s])),) if s in whole else ()) + self.short[p]
        self.items = [frozenset(x) for x in own]

    def _extend(self, last: int, w: int, own: list[set]) -> int:
        nexts, link, length = self.next, self.link, self.len
        if (q := nexts[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q, own)
        new = self._state(length[last] + 1, {}, 0, own)
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q, own)
        return new

    def _state(self, length: int, nexts: dict[int, int], link: int, own: list[set]) -> int:
        self.len.append(length)
        self.next.append(nexts)
        self.link.append(link)
        own.append(set())
        return len(self.len) - 1

    def _clone(self, p: int, w: int, q: int, own: list[set]) -> int:
        new = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q], own)
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Matched spans (start, end), in order of their ends, and the items with occurring windows."""
        n, size = len(words), len(self.vocab)
        spans: list[tuple[int, int]] = []
        found: set = set()
        if n < self.least or not size:
            return spans, found
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, n)
        joined = np.zeros(n + 1, bool)  # joined[i]: words i-1 and i may be neighbours in an item
        if n > 1 and len(self.pairs):
            code = ids[:-1] * size + ids[1:]
            code[(ids[:-1] < 0) | (ids[1:] < 0)] = -1
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[1:n] = self.pairs[at] == code
        starts = np.flatnonzero(~joined[:n] & (ids >= 0))
        ends = np.flatnonzero(~joined[1:] & (ids >= 0)) + 1
        long = ends - starts >= self.least
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            self._stream(ids[a:b].tolist(), a, spans, found)
        return spans, found

    def _stream(self, ids: list[int], at: int, spans: list, found: set) -> None:
        nexts, link, length, window = self.next, self.link, self.len, self.window
        state = matched = 0
        for i, w in enumerate(ids, at + 1):
            while state and w not in nexts[state]:
                state = link[state]
                matched = length[state]
            if (to := nexts[state].get(w)) is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                top = self.top[state]
                found |= self.items[top]
                spans.append((i - window, i))
            whole = self.short[state if length[state] <= matched else link[state]]
            for k, names in whole:
                found |= names
                spans.append((i - k, i))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_BUILT: dict = {}


def _automaton(items: list, window: int) -> Automaton:
    """The block's automaton, built once a worker process."""
    key = hashlib.sha256(repr((items, window)).encode()).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, window)
    return _BUILT[key]


def blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> tuple[DataFrame, int]:
    """The items (i, t) with words, dealt into blocks b that fit a worker, and the number of blocks."""
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    count = max(1, -(-total // block_chars))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(count)))
    return (written(rows, "items"), count) if count > 1 else (rows, 1)


_SPANS = "array<struct<start:long,end:long>>"
_FOUND = f"n_words long, spans {_SPANS}, items array<string>"


def _scanned(docs: DataFrame, text_col: str, items: DataFrame, window: int, keep: list[str]) -> DataFrame:
    """The kept columns with what one block's automaton finds.  A block is collected: it has a bounded size."""
    block = sorted(((r.i, r.t.encode()) for r in items.select("i", "t").collect()), key=repr)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def start():
        automaton = _automaton(shared.value, window)

        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            n_words, spans, ids = [], [], []
            for text in texts(batch.column(0)):
                words = (text or b"").translate(FOLD).split()
                found, names = automaton.scan(words)
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged(found)])
                ids.append(sorted(x for x in names if x is not None))
            return _columns(spans, ids) | {"n_words": pa.array(n_words, pa.int64())}

        return each

    return arrow_append(docs, [text_col], start, _FOUND, keep)


def _columns(spans: list, ids: list) -> dict[str, pa.Array]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return {"spans": pa.array(spans, kind), "items": pa.array(ids, pa.list_(pa.string()))}


def find(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
    keep: list[str] | None = None,
) -> DataFrame:
    """`docs` (its kept columns) with n_words, spans (array of word ranges hit, ends exclusive) and items (ids as text).

    Null or wordless texts have no words and no hits; items that are null or have no words are ignored; items with a
    null id hit words but are not listed; repeated items count once by id; empty tables give no hits or no rows.
    """
    kept = docs.columns if keep is None else keep
    dealt, count = blocks(items, item_id, item_text, block_chars)
    if count == 1:
        return _scanned(docs, text_col, dealt, window, kept)
    width = len(kept)
    said = F.col(text_col)
    name = {"t1": F.xxhash64(said, said.isNull()), "t2": F.xxhash64(F.lit(1), said, said.isNull())}
    plain = docs.select(*(F.col(c).alias(f"d{i}") for i, c in enumerate(kept)), said.alias("text"), *(v.alias(k) for k, v in name.items()))
    out = _scanned(plain, "text", dealt.where("b = 0"), window, [*(f"d{i}" for i in range(width)), "t1", "t2"])
    more: DataFrame | None = None
    for k in range(1, count):  # only documents with hits leave a pass, each text once
        found = _scanned(plain, "text", dealt.where(F.col("b") == k), window, ["t1", "t2"]).where("size(spans) > 0")
        found = written(found.groupBy("t1", "t2").agg(F.first("spans").alias("s"), F.first("items").alias("i")), "hits")
        more = found if more is None else more.union(found)
    more = more.groupBy("t1", "t2").agg(F.flatten(F.collect_list("s")).alias("more"), F.flatten(F.collect_list("i")).alias("names"))
    out = out.join(written(more, "hits"), ["t1", "t2"], "left")

    def start():
        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            spans, ids = [], []
            for a, b, i, j in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                both = merged([(s["start"], s["end"]) for s in [*a, *(b or ())]])
                spans.append([{"start": x, "end": y} for x, y in both])
                ids.append(sorted({*i, *(j or ())}))
            return _columns(spans, ids)

        return each

    joined = arrow_append(out, ["spans", "more", "items", "names"], start, f"spans {_SPANS}, items array<string>", [*(f"d{i}" for i in range(width)), "n_words"])
    return joined.toDF(*kept, "n_words", "spans", "items")


def hits(spans: str = "spans") -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_hit, n_words, share: int = 20) -> F.Column:
    """Some word is hit, and at least one word in `share`."""
    return (n_hit > 0) & (F.lit(share) * n_hit >= n_words)


def _without(text: bytes, spans: list[dict], long_span: int) -> bytes:
    """The text without the words of its longer spans; what stands on their two sides is kept apart by a space."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(FOLD))]
    out, at = [], 0
    for s in spans:
        if s["end"] - s["start"] >= long_span:
            out.append(text[at : places[s["start"]][0]].rstrip())
            at = places[s["end"] - 1][1]
    return b" ".join([*out, text[at:].lstrip()]) if out else text


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", *, long_span: int | None = None, **options) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their own columns; their spans of `long_span` words or more are cut.

    Null and wordless texts are not contaminated; repeated rows are judged alike; an empty table gives no rows; columns
    may have any names.  Without `long_span` no text changes.
    """
    width, at = len(docs.columns), docs.columns.index(text_col)
    plain = docs.toDF(*(f"d{i}" for i in range(width)))
    found = find(plain, items, text_col=f"d{at}", **options)
    kept = found.where(~contaminated(hits(), F.col("n_words")))
    if long_span is None:
        return kept.select(*(f"d{i}" for i in range(width))).toDF(*docs.columns)

    def start():
        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            rows = zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True)
            return {"text": pa.array([None if t is None else _without(t, s, long_span).decode() for t, s in rows], pa.string())}

        return each

    cut = arrow_append(kept, [f"d{at}", "spans"], start, "text string", [f"d{i}" for i in range(width)])
    return cut.select(*("text" if i == at else f"d{i}" for i in range(width))).toDF(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    rows = found.select("doc_id", "n_words", hits().alias("n_hit"), "items")
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES = {"op5_decontamination": OP5}
