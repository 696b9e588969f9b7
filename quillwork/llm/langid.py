"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 2).

Texts are lower-cased; characters that are neither letters nor combining marks count as spaces.  Every window of one to
three characters that holds a letter is hashed into one of `buckets` features.  Counts by language are summed by Spark
over a sample of whole labelled texts; the log-probability matrix (buckets x languages, of at most CELLS numbers) is
broadcast, and batches are scored in numpy by gathering its rows and adding them up document by document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_append, arrow_map, held_out, table

BUCKETS = 1 << 15
#: Labelled rows of each language that are learned from, about: the bound of the training sample.
PER_LANGUAGE = 4_000
#: The bound of the broadcast matrix: more languages share fewer buckets, of which there are LEAST_BUCKETS at least.
CELLS, LEAST_BUCKETS = 6_553_600, 256
SMOOTHING = 0.5
_SLICE = 400_000


@cache
def _kinds() -> np.ndarray:
    """By code point: 2 for a letter, 1 for a combining mark, else 0."""
    return np.array([2 if chr(c).isalpha() else unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)], np.uint8)


def grams(pieces: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the pieces, and where each piece's n-grams begin (with the total at the end).

    Orders 1, 2 and 3 lie one after the other for each piece, so a piece's sum never depends on its neighbours.
    """
    out, at = [], [0]
    for piece in pieces:
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[c]
        letter = kind == 2
        c = np.where(kind > 0, c, np.uint32(32)).astype(np.uint64)
        with np.errstate(over="ignore"):
            two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] + np.uint64(1 << 40)
            three = two[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] + np.uint64(1 << 41)
            codes = np.concatenate([c[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])
            codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((codes >> np.uint64(40)) % np.uint64(buckets))
        at.append(at[-1] + len(codes))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)).astype(np.int64), np.array(at)


def slices(text: str) -> Iterator[str]:
    """Pieces of a lower-cased text, each long enough to work on; a long text is cut, never shortened."""
    low = text.lower()
    for a in range(0, max(1, len(low)), _SLICE):
        yield low[a : a + _SLICE]


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # buckets x languages
    prior: np.ndarray
    buckets: int = BUCKETS

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        totals = np.tile(self.prior, (len(texts), 1))
        pieces, owner, held = [], [], 0

        def flush() -> None:
            codes, at = grams(pieces, self.buckets)
            begin, end = at[:-1], at[1:]
            full = np.flatnonzero(end > begin)
            if len(full):
                sums = np.add.reduceat(self.logs[codes], begin[full], axis=0)
                np.add.at(totals, np.array(owner)[full], sums)

        for i, text in enumerate(texts):
            for piece in slices(text or ""):
                pieces.append(piece)
                owner.append(i)
                held += len(piece)
                if held >= _SLICE:
                    flush()
                    pieces, owner, held = [], [], 0
        if pieces:
            flush()
        names, scores = [], []
        for i, text in enumerate(texts):
            if not self.languages or text is None or not any(map(str.isalpha, text)):
                names.append("und")
                scores.append(0.0)
                continue
            row = totals[i] - totals[i].max()
            p = np.exp(row)
            k = int(np.argmax(row))
            names.append(self.languages[k])
            scores.append(float(min(1.0, p[k] / p.sum())))
        return names, scores


def train(
    docs: DataFrame,
    usable: F.Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    buckets: int = BUCKETS,
    per_language: int = PER_LANGUAGE,
) -> Model:
    """Learn from about `per_language` rows of each language among the usable ones, chosen by a hash of id and text length.

    Rows with a null text or language teach nothing; repeated rows teach once each; without any row the model knows no
    language and predicts `und`.  Only the three named columns are read.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    buckets = min(buckets, max(LEAST_BUCKETS, CELLS // max(1, len(counts))))
    if not counts:
        return Model([], np.zeros((buckets, 0)), np.zeros(0), buckets)
    share = F.create_map(F.lit(""), F.lit(1.0), *[F.lit(x) for l, n in counts.items() if l and n > per_language for x in (l, per_language / n)])
    draw = F.pmod(F.xxhash64(F.col("i"), F.length("t"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < F.coalesce(share[F.col("l")], F.lit(1.0))).select("t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = sums.setdefault(lang, np.zeros(buckets, np.int64))
                for piece in slices(text):
                    mine += np.bincount(grams([piece], buckets)[0], minlength=buckets)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["l", "b", "n"])

    summed = arrow_map(sample, count, "l string, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts)
    found = np.zeros((buckets, len(languages)))
    if len(summed):
        place = {x: i for i, x in enumerate(languages)}
        found[summed["b"].to_numpy(), [place[x] for x in summed["l"]]] = summed["n"].to_numpy()
    smooth = found + SMOOTHING
    prior = np.log(np.array([counts[x] for x in languages]) / sum(counts.values()))
    return Model(languages, np.log(smooth / smooth.sum(axis=0)), prior, buckets)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of `docs` with lang_pred and score; `und` and 0 for a null text or one without letters.

    Repeated rows are judged alike; an empty table gives no rows; kept columns may have the new columns' names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            names, scores = model.predict(batch.column(0).to_pylist())
            return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

        return each

    return arrow_append(docs, [text_col], start, "lang_pred string, score double", keep)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return predict(docs, model, keep=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
