"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

quality (rejected documents go), near-duplicates (one document of each group stays), decontamination (contaminated
documents go, long spans are cut out of the others), secrets (their characters are replaced by a mark), packing (pieces of power-of-two lengths).  All stages
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import decontaminate, jaccard, packing, quality, secrets
from quillwork.llm.common import held_out, table, written


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under column names that clash with none that a stage adds, and the new name of each column."""
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with the threshold of the operator's query.

    Null and empty texts are scored as empty ones; repeated rows fare alike; an empty table gives no rows; the columns
    of `docs` may have any names besides doc_id and text.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    plain, names = _numbered(docs)
    scored = quality.score(plain, model, text_col=names["text"], out="score")
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*names.values()).toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five-word shingles, the one with the smallest id.

    Null ids come last; of repeated rows one stays; null, empty and wordless texts all stay.
    """
    return jaccard.distinct_documents(docs, shingle=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than one word in twenty.

    Null, empty and wordless texts stay, and repeated rows fare alike.  Spans of LONG_SPAN words or more are cut out of
    the documents that stay, whose n_chars follows the text.
    """
    plain, names = _numbered(docs)
    out = decontaminate.clean(plain, table(spark, sf_dir, "benchmark"), names["text"], long_span=decontaminate.LONG_SPAN)
    return _counted(out, names).toDF(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text.  Null and empty texts stay as they are."""
    plain, names = _numbered(docs)
    text = names["text"]
    found = secrets.scan(plain, text, out="spans")
    clean = found.withColumn(text, secrets.redacted(F.col(text), F.col("spans"))).drop("spans")
    return _counted(clean, names).toDF(*docs.columns)


def _counted(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """n_chars, if there is such a column, is the number of the text's characters; null stays null."""
    if "n_chars" not in names:
        return docs
    at = names["n_chars"]
    kind = docs.schema[at].dataType
    return docs.withColumn(at, F.when(F.col(at).isNotNull(), F.coalesce(F.length(names["text"]).cast(kind), F.col(at))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents; a null or empty text is one piece of its end id; repeated rows are packed once each."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Models, components and tokenizers are not SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
