"""Topic models and evaluation on Spark ML (M1 to M4)."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.values import cosine

from .retrieval import discard, exploded, written


def topic_features(text: str, features: int = 1 << 12) -> PipelineModel:
    """Counts of hashed word n-grams (1, 2) and character n-grams (4); nothing is fitted (M1)."""
    words = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}\p{N}]+", minTokenLength=1)
    chars = RegexTokenizer(inputCol=text, outputCol="_ch", pattern=r".", gaps=False, minTokenLength=1)
    stages = [words, NGram(n=2, inputCol="_w", outputCol="_w2"), chars, NGram(n=4, inputCol="_ch", outputCol="_c4")]
    stages += [HashingTF(numFeatures=features, inputCol=name, outputCol=f"{name}_tf") for name in ("_w", "_w2", "_c4")]
    return PipelineModel([*stages, VectorAssembler(inputCols=["_w_tf", "_w2_tf", "_c4_tf"], outputCol="_tf")])


def topic_learner(label: str, c: float = 4.0, rounds: int = 20) -> Pipeline:
    """A balanced logistic regression on the TF-IDF of counts (M1)."""
    stages = [IDF(inputCol="_tf", outputCol="_x"), StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip")]
    return Pipeline(stages=[*stages, LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_weight", regParam=1 / (1000 * c), maxIter=rounds)])


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Rows weighted so that all labels count alike."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("_weight"))  # one row
    return df.join(weights, label)


def train_topics(df: DataFrame, text: str, label: str, features: int = 1 << 12, **options) -> PipelineModel:
    """The topic model of texts; their counts are written, so that the passes of the fit do not split them again."""
    rows = df.where(F.col(label).isNotNull() & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")).select(text, label)
    counts = topic_features(text, features)
    model = topic_learner(label, **options).fit(balanced(written(counts.transform(rows).select(label, "_tf"), "topic-counts"), label))
    return PipelineModel([*counts.stages, *model.stages])


def predicted(model: PipelineModel, df: DataFrame, text: str, out: str = "topic") -> DataFrame:
    """The rows with the likeliest label and its probability (M3)."""
    names = model.stages[-2].labels
    scoring = PipelineModel([s for s in model.stages if s.uid != model.stages[-2].uid])
    rows = scoring.transform(df.withColumn("_weight", F.lit(1.0)))
    p = vector_to_array("probability")
    best = F.array_max(p)
    label = F.array(*map(F.lit, names))[(F.array_position(p, best) - 1).cast("int")]
    return rows.select(*df.columns, label.alias(out), best.alias("confidence"))


def cascade(manual: Column, model: Column, confidence: Column, keywords: Column, least: float = 0.5) -> Column:
    """The manual label, else the model's if it is sure enough, else the keywords' (M4)."""
    return F.coalesce(manual, F.when(confidence >= least, model), keywords)


def folds(df: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """Rows with a fold number, dealt in turn within each label (M2)."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.col(key)), F.col(key))
    return df.withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(k)).cast("int"))


def ranked(model: PipelineModel, df: DataFrame, text: str, k: int = 5, fallback: str | None = None) -> DataFrame:
    """The rows with `top`, the k likeliest labels with their probabilities, likeliest first, ties to the lesser label (M3).

    A null or blank text gets the fallback alone, with certainty, or nothing.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    rows, top = _likeliest(model, df.withColumns({"_said": F.col(text), text: plain}), k)
    alone = F.array(F.struct(F.lit(fallback).alias("label"), F.lit(1.0).alias("p"))) if fallback is not None else F.slice(top, 1, 0)
    kept = [F.col("_said").alias(text) if c == text else F.col(c) for c in df.columns]
    return rows.select(*kept, F.when(F.trim(plain) == "", alone).otherwise(top).alias("top"))


def _likeliest(model: PipelineModel, df: DataFrame, k: int) -> tuple[DataFrame, Column]:
    """The rows scored by a model's stages, and their k likeliest labels."""
    names = model.stages[-2].labels
    rows = PipelineModel([s for s in model.stages if s.uid != model.stages[-2].uid]).transform(df.withColumn("_weight", F.lit(1.0)))
    said = F.arrays_zip(vector_to_array("probability").alias("p"), F.array(*map(F.lit, names)).alias("label"))
    best = F.slice(F.array_sort(F.transform(said, lambda x: F.struct((-x["p"]).alias("n"), x["label"].alias("label")))), 1, k)
    return rows, F.transform(best, lambda x: F.struct(x["label"].alias("label"), (-x["n"]).alias("p")))


def validated(df: DataFrame, text: str, label: str, key: str, k: int = 5, most: int = 5, side_by_side: int = 2, features: int = 1 << 12, **options) -> DataFrame:
    """(key, label, fold, top): every labelled row judged by a model that has not seen its fold (M2).

    Folds are dealt within each label, so all models know all labels that have at least two rows; `side_by_side` models
    are fitted at a time.  Rows without a label or a text take no part.  Texts are split and counted once for all models,
    which learn from and judge the written counts.
    """
    rows = df.where(F.col(label).isNotNull() & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")).select(key, text, label)
    counts = written(topic_features(text, features).transform(rows).select(key, label, "_tf"), "topic-counts")
    dealt = written(folds(counts.select(key, label), label, key, k), "folds")
    counted = written(counts.join(dealt.select(key, "fold"), key), "topic-folds")
    discard(counts)

    def judged(fold: int) -> DataFrame:
        model = topic_learner(label, **options).fit(balanced(counted.where(F.col("fold") != fold), label))
        rows, top = _likeliest(model, counted.where(F.col("fold") == fold), most)
        return rows.select(key, label, "fold", top.alias("top"))

    with ThreadPool(side_by_side) as pool:  # the driver only waits: each fit is Spark jobs
        parts = pool.map(judged, range(k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report(df: DataFrame, truth: str, said: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, support) of every label, and of `macro` and `weighted` means.

    Counts of (truth, said) pairs come first, so what is summed is as many rows as labels squared.  A null truth takes no
    part; a null answer is a miss.  Shares without a case are 0; labels that are only answered have no support, and
    count in the macro mean.
    """
    pairs = df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(said).alias("s")).agg(F.count("*").alias("n"))
    hit = F.col("t").eqNullSafe(F.col("s"))
    sides = F.array(
        F.struct(F.col("t").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("s").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )
    each = pairs.select(F.explode(sides).alias("x")).select("x.*").where("label is not null").groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    each = each.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "support": tp + fn})
    counts = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    means = ("precision", "recall", "f1")
    macro = each.groupBy(F.lit("macro").alias("label")).agg(*counts, *(F.avg(c).alias(c) for c in means), F.sum("support").alias("support"))
    weighted = each.groupBy(F.lit("weighted").alias("label")).agg(*counts, *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in means), F.sum("support").alias("support"))
    return each.unionByName(macro).unionByName(weighted)


def pair_features(pairs: DataFrame, items: DataFrame, key: str, text: str, vector: str, at: str) -> DataFrame:
    """The pairs (a, b, ...) with what tells events apart: overlap, cosine, idf of the rarest shared word, days apart (M6).

    Items are joined on their keys; a pair of unknown items goes.  Missing texts, vectors and times say 0.  The pairs meet
    the items once and are written with the words that they share, and so is the result, which learning and judging read.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4))
    told = written(items.select(F.col(key).alias("k"), words.alias("w"), F.col(vector).cast("array<double>").alias("v"), F.col(at).cast("double").alias("t")), "pair-items")
    df = told.select(F.explode("w").alias("x")).groupBy("x").agg(F.count("*").alias("f"))
    total = told.agg(F.count("*").alias("n"))
    side = lambda c: told.select(F.col("k").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in "wvt"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("_shared", F.array_intersect("w_a", "w_b"))
    shared, union = F.size("_shared"), F.size("w_a") + F.size("w_b") - F.size("_shared")
    met = written(
        both.select(
            *pairs.columns,
            "_shared",
            F.when(union > 0, shared / union).otherwise(0.0).alias("overlap"),
            F.coalesce(cosine("v_a", "v_b"), F.lit(0.0)).alias("cosine"),
            F.coalesce(F.abs(F.col("t_a") - F.col("t_b")), F.lit(0.0)).alias("apart"),
        ),
        "pair-words",
    )
    rare = exploded(met, F.col("_shared"), "x", "a", "b").join(df, "x").groupBy("a", "b").agg(F.min("f").alias("f"))
    rare = rare.crossJoin(F.broadcast(total)).select("a", "b", F.log((F.col("n") + 1) / (F.col("f") + 1)).alias("rarest"))  # one row
    out = met.join(rare, ["a", "b"], "left").select(*pairs.columns, "overlap", "cosine", F.coalesce("rarest", F.lit(0.0)).alias("rarest"), "apart")
    out = written(out, "pair-features")
    discard(told, met)
    return out


FEATURES = ("overlap", "cosine", "rarest", "apart")


def train_judge(pairs: DataFrame, label: str, features: Sequence[str] = FEATURES, threshold: float = 0.82, rounds: int = 50) -> tuple[PipelineModel, dict[str, float | bool]]:
    """A pair judge on labelled pairs with features, and whether it is of use (M6).

    Four fifths of the pairs, by a hash of their keys, are learned from; on the others the judge's F1 is held against that
    of the cosine threshold, and `useful` says whether it is greater.  Fewer than ten pairs to hold out are no test.
    """
    held = F.pmod(F.crc32(F.concat_ws(":", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string"))), F.lit(5)) == 0
    rows = written(pairs.where(F.col(label).isNotNull()).withColumns({"_y": F.col(label).cast("double"), "_held": held}), "judged-pairs")
    stages = [VectorAssembler(inputCols=list(features), outputCol="_f"), StandardScaler(inputCol="_f", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=rounds, regParam=1e-3)]
    model = Pipeline(stages=stages).fit(rows.where("not _held"))
    tested = model.transform(rows.where("_held")).select("_y", F.col("prediction").alias("m"), (F.col("cosine") >= threshold).cast("double").alias("c"))
    f1 = lambda p: (2 * F.sum(F.col("_y") * F.col(p)) / F.nullif(F.sum(F.col("_y") + F.col(p)), F.lit(0.0))).alias(p)
    found = tested.agg(f1("m"), f1("c"), F.count("*").alias("n")).first()
    said = {"model_f1": found.m or 0.0, "threshold_f1": found.c or 0.0, "held_out": found.n}
    return model, said | {"useful": found.n >= 10 and said["model_f1"] > said["threshold_f1"]}


def judged_pairs(pairs: DataFrame, model: PipelineModel | None, useful: bool, threshold: float = 0.82) -> DataFrame:
    """The pairs with `same` and `by`: the model's answer if it has beaten the threshold, else the threshold's (M6)."""
    if model is None or not useful:
        return pairs.withColumns({"same": F.col("cosine") >= threshold, "by": F.lit("threshold")})
    return model.transform(pairs).select(*pairs.columns, (F.col("prediction") == 1).alias("same"), F.lit("model").alias("by"))
