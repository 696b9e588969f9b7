"""Table, text and document sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def optional_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, or no rows of the schema if it is absent; missing columns are null."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], wanted)
    return with_columns_of(found, wanted)


def with_columns_of(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns; those that `df` lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def assembled(base: DataFrame, parts: Sequence[DataFrame], keys: DataFrame | None = None, key: Sequence[str] = ()) -> DataFrame:
    """A table put together from its owners' parts, restricted to some keys."""
    out = base
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return out if keys is None else out.join(keys.select(*key).distinct(), list(key), "left_semi")


def delimited(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str], separator: str = ";", null: str = "null") -> DataFrame:
    """Delimited text with quotes, a byte order mark, a literal for null and rejection of rows without required values."""
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    options = {"sep": separator, "header": True, "quote": '"', "nullValue": null, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "multiLine": True, "encoding": "UTF-8"}
    rows = spark.read.schema(whole).options(**options).csv(path).where("_bad is null").drop("_bad")
    text = {f.name: F.nullif(F.trim(F.regexp_replace(F.col(f.name), "^﻿", "")), F.lit("")) for f in schema.fields if isinstance(f.dataType, T.StringType)}
    rows = rows.withColumns(text) if text else rows
    return rows.dropna(subset=list(required)) if required else rows


def sheet(rows: DataFrame, header: Mapping[str, Sequence[str]], codes: str | None = None) -> DataFrame:
    """Columns found under any of their names (trimmed, case aside); a cell of several codes becomes rows."""
    have = {c.strip().lower(): c for c in rows.columns}
    picked = []
    for name, aliases in header.items():
        found = next((have[a.strip().lower()] for a in [name, *aliases] if a.strip().lower() in have), None)
        picked.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    out = rows.select(*picked)
    if codes:
        out = out.withColumn(codes, F.explode_outer(F.filter(F.split(F.col(codes).cast("string"), r"[\s,;/]+"), lambda c: c != "")))
    return out


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str, empty: bool = True) -> DataFrame:
    """JSON documents, or no rows if the file is absent."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as error:
        if not empty or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def seeded(catalogue: Sequence[DataFrame], explicit: str, by_name: DataFrame, by_category: DataFrame, name: str, category: str, out: str) -> DataFrame:
    """The union of source lists; a value given explicitly, else by the name, else by the category."""
    rows = catalogue[0]
    for more in catalogue[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.join(by_name.withColumnRenamed(out, "_n"), name, "left").join(by_category.withColumnRenamed(out, "_c"), category, "left")
    return rows.withColumn(out, F.coalesce(F.col(explicit), "_n", "_c")).drop("_n", "_c")


def canonical(views: Mapping[str, DataFrame], columns: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Differently shaped sources under one set of columns, with the source's name."""
    out = None
    for source, df in views.items():
        one = df.select(F.lit(source).alias("source"), *[c.alias(n) for n, c in columns[source].items()])
        out = one if out is None else out.unionByName(one)
    return out
