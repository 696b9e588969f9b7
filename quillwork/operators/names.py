"""Names and terms in running text and captions: one automaton over all spellings, rules of context, windows of mentions.

A catalogue row is a label with a pattern.  A tolerant pattern stands for the spellings that captions make of it: doubled
letters written once, b for v and v for b.  All spellings of a catalogue go into one automaton, so a text is read once,
whatever the catalogue's size; automata are built once a worker process.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.text import _ACCENTED, _BARE

#: Characters of patterns in one automaton; a larger catalogue is dealt to several, each a pass over the texts.
BLOCK = 4_000_000
#: Bytes and rows of one Arrow batch of texts.
BATCH_BYTES, BATCH_ROWS = "8m", "2000"
CATALOGUE = "label string, pattern string, tolerant boolean, open boolean, context boolean"

_MACHINES: dict[int, list] = {}


def plain(text: str | Column) -> Column:
    """Lower case without accents, character by character, so that positions stay."""
    return F.translate(F.lower(text), _ACCENTED, _BARE)


def people(names: DataFrame, label: str, ambiguous: Sequence[str] = (), roles: Sequence[str] = (), context: Sequence[str] = ()) -> DataFrame:
    """The catalogue of people: by tolerant surname; a surname that is also a word needs the whole name or a role before it."""
    whole = F.trim(F.regexp_replace(plain(label), r"\s+", " "))
    surname = F.element_at(F.split(whole, " "), -1)
    homonym = surname.isin(*ambiguous) if ambiguous else F.lit(False)
    said = F.when(homonym, F.concat(F.array(whole), *[F.array(F.concat(F.lit(f"{r} "), surname)) for r in roles])).otherwise(F.array(surname))
    only = F.col(label).isin(*context) if context else F.lit(False)
    return names.select(F.col(label).alias("label"), F.explode(said).alias("pattern"), (~homonym).alias("tolerant"), F.lit(False).alias("open"), only.alias("context"))


def terms(df: DataFrame, term: str) -> DataFrame:
    """The catalogue of terms: a term stands at a word's start and may go on ("biometri")."""
    return df.select(F.col(term).alias("label"), plain(term).alias("pattern"), F.lit(False).alias("tolerant"), F.lit(True).alias("open"), F.lit(False).alias("context"))


def spellings(pattern: str, tolerant: bool) -> list[str]:
    """The spellings of a pattern; v is written as b where it is tolerant, as in the text that they meet."""
    if not tolerant:
        return [pattern]
    parts = [[m[0], m[0][0]] if len(m[0]) == 2 else [m[0]] for m in re.finditer(r"(\w)\1|[\s\S]", pattern)]
    return sorted({"".join(p).replace("v", "b") for p in product(*parts)})


def _machine(key: int, rows: list[tuple]):
    """Two automata, over texts as they are and with v as b; each value lists (row, length)."""
    if key not in _MACHINES:
        import ahocorasick

        found: list[dict[str, list[int]]] = [{}, {}]
        for i, (_, pattern, tolerant, *_) in enumerate(rows):
            for s in spellings(pattern, tolerant):
                found[bool(tolerant)].setdefault(s, []).append(i)
        machines = []
        for spelled in found:
            machine = ahocorasick.Automaton()
            for s, at in spelled.items():
                machine.add_word(s, (len(s), at))
            if spelled:
                machine.make_automaton()
            machines.append(machine if spelled else None)
        _MACHINES.clear()  # one catalogue a process
        _MACHINES[key] = machines
    return _MACHINES[key]


def _wordy(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


def hits(text: str, machines, rows: list[tuple]) -> list[tuple[int, int, int]]:
    """(start, end, catalogue row) of all places of one plain text, in order."""
    out = set()
    for machine, said in zip(machines, (text, text.replace("v", "b")), strict=True):
        if machine is None:
            continue
        for last, (n, at) in machine.iter(said):
            start, end = last + 1 - n, last + 1
            if _wordy(text, start - 1) and _wordy(text, start):
                continue
            inside = _wordy(text, end - 1) and _wordy(text, end)
            out.update((start, end, i) for i in at if rows[i][3] or not inside)
    return sorted(out)


def spotted(texts: DataFrame, catalogue: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, label, context, start, end): every place of every catalogue pattern, positions in code points from 0.

    Null and empty texts and patterns have no places; a label with several patterns may stand twice at one place; repeated
    rows of the catalogue count once.
    """
    wanted = catalogue.select("label", plain("pattern").alias("pattern"), "tolerant", "open", "context").where("pattern <> '' and label is not null").distinct()
    rows = sorted(tuple(r) for r in wanted.collect())  # a catalogue: its blocks are bounded below
    blocks: list[list[tuple]] = [[]]
    size = 0
    for row in rows:
        if size > BLOCK:
            blocks.append([])
            size = 0
        blocks[-1].append(row)
        size += len(row[1])
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    said = texts.where(F.length(text) > 0).select(*keys, plain(text).alias("_text"))
    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)  # at most BLOCK characters and one pattern

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            machines = _machine(hash(tuple(rows)), rows)
            for batch in batches:
                at, found = [], []
                for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                    new = hits(t, machines, rows)
                    at += [i] * len(new)
                    found += new
                kept = [batch.column(j).take(pa.array(at, pa.int32())) for j in range(len(keys))]
                made = [pa.array([rows[r][0] for *_, r in found], pa.string()), pa.array([bool(rows[r][4]) for *_, r in found], pa.bool_())]
                made += [pa.array([f[j] for f in found], pa.int32()) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*keys, "label", "context", "start", "end"])

        part = said.mapInArrow(run, f"{kinds}, label string, context boolean, start int, end int")
        out = part if out is None else out.unionByName(part)
    return out


def mentions(lines: DataFrame, found: DataFrame, stream: str, at: str, text: str, within: int = 25, skip: int = 5, last: int = 25) -> DataFrame:
    """(stream, start, end, labels, said): passages about mentions in captions (stream, at in seconds, text), once each.

    Mentions at most `within` apart are one passage, which reaches so far on either side; passages with context-only
    labels alone are left out; of passages of one stream with the same words `skip` to `last` (a repeated advert) the
    first stays.  Lines meet passages in time cells, so nothing is compared that is far apart.
    """
    w = Window.partitionBy(stream).orderBy(at, "label")
    rows = found.select(stream, at, "label", "context").distinct().withColumn("_new", F.coalesce((F.col(at) - F.lag(at).over(w) > within).cast("int"), F.lit(0)))
    rows = rows.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    groups = rows.groupBy(stream, "_n").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.array_sort(F.collect_set("label")).alias("labels"), F.bool_and("context").alias("_only")).where("not _only")
    cell = lambda c: F.floor(F.col(c) / (4 * within)) if isinstance(c, str) else F.floor(c / (4 * within))
    reach = groups.withColumn("_c", F.explode(F.sequence(cell(F.col("start") - within), cell(F.col("end") + within))))
    near = reach.join(lines.select(stream, F.col(at).alias("_t"), F.col(text).alias("_said"), cell(at).alias("_c")), [stream, "_c"])
    near = near.where((F.col("_t") >= F.col("start") - within) & (F.col("_t") <= F.col("end") + within))
    told = near.groupBy(stream, "start", "end", "labels").agg(F.array_sort(F.collect_list(F.struct("_t", "_said"))).alias("_p"))
    told = told.withColumn("said", F.array_join(F.transform("_p", lambda x: x["_said"]), " "))
    words = F.slice(F.filter(F.split(plain("said"), r"\s+"), lambda x: x != ""), skip + 1, last - skip)
    first = Window.partitionBy(stream, F.sha2(F.array_join(words, " "), 256)).orderBy("start")
    return told.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(stream, "start", "end", "labels", "said")


#: What announces the result of a vote or a recess: a tally in figures, or the recess itself.
VOTES = r"(?i)votad[oa]s? a favor,? \d+|\d+ votos? (?:a favor|en contra|afirmativos|negativos)|cuarto intermedio"


def vote_events(lines: DataFrame, stream: str, at: str, text: str, pattern: str = VOTES, before: int = 900, after: int = 350) -> DataFrame:
    """(stream, at, matched, said): lines that announce a vote, with the text about the match.

    A line's text is joined to that before it by a blank; `said` begins `before` characters ahead of the match's end and
    ends `after` behind it, or at the line's end.  Lines meet in cells of the running text, so the work is linear.
    """
    w = Window.partitionBy(stream).orderBy(at, "_line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(F.length(text) > 0).select(stream, at, F.col(text).alias("_line"))
    rows = rows.withColumn("_end", F.sum(F.length("_line") + 1).over(w) - 1)
    rows = rows.withColumn("_from", F.col("_end") - F.length("_line"))
    matched = F.regexp_extract("_line", pattern, 0)
    events = rows.select(stream, at, "_from", "_end", "_line", matched.alias("matched")).where("matched <> ''")
    stop = F.col("_from") + F.instr("_line", F.col("matched")) - 1 + F.length("matched")
    events = events.withColumn("_m", stop).withColumns({"_lo": F.greatest(F.col("_m") - before, F.lit(0)), "_hi": F.least(F.col("_m") + after, F.col("_end"))})
    size = before + after
    cells = events.select(stream, at, "matched", "_from", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size))).alias("_c"))
    held = rows.select(stream, F.col("_from").alias("_f"), "_end", "_line", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor(F.col("_end") / size))).alias("_c"))
    met = cells.join(held, [stream, "_c"]).where((F.col("_f") < F.col("_hi")) & (F.col("_end") > F.col("_lo")) & (F.col("_c") == F.greatest(F.floor(F.col("_f") / size), F.floor(F.col("_lo") / size))))
    cut = F.substring("_line", F.greatest(F.col("_lo") - F.col("_f"), F.lit(0)) + 1, F.least("_hi", "_end") - F.greatest("_lo", "_f"))
    said = met.select(stream, at, "matched", "_from", F.struct("_f", cut.alias("x")).alias("_p"))
    out = said.groupBy(stream, at, "_from", "matched").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return out.select(stream, at, "matched", F.trim(F.array_join(F.transform("_p", lambda x: x["x"]), " ")).alias("said"))


def mentions_outside_lists(texts: DataFrame, key: str, text: str, pattern: str, listing: str, margin: int = 150, least: int = 3) -> DataFrame:
    """(key, start, end, said): matches with fewer than `least` listing words within `margin` characters of them.

    Positions are code points from 0; a listing word begins and ends in the surroundings, which `said` is.  One pass finds
    all matches and listing words, and each match looks up its surroundings by position: linear but for a logarithm.
    """
    kind = texts.schema[key].dataType.simpleString()
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, listed = re.compile(pattern), re.compile(listing)
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                spans = [m.span() for m in listed.finditer(t)]
                starts, ends = [a for a, _ in spans], [b for _, b in spans]
                for m in match.finditer(t):
                    lo, hi = max(0, m.start() - margin), min(len(t), m.end() + margin)
                    n = bisect_left(ends, hi + 1) - bisect_left(starts, lo)
                    if n < least:
                        at.append(i)
                        rows.append((m.start(), m.end(), t[lo:hi]))
            kept = batch.column(0).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [kept, *(pa.array([r[j] for r in rows], pa.int32()) for j in (0, 1)), pa.array([r[2] for r in rows], pa.string())], ["k", "start", "end", "said"]
            )

    rows = texts.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {kind}, start int, end int, said string").withColumnRenamed("k", key)
