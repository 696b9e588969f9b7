"""Sinks: versioned publishing, nested export, message packing, delivery (K1 to K9)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.streaming.folds import folded


class Conflict(RuntimeError):
    """Another writer has published since the version was read."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def version(spark: SparkSession, root: str) -> int:
    """The published version, 0 if there is none: the highest manifest.  Works on any Hadoop file system."""
    fs, path = _fs(spark, root)
    folder = path(f"{root}/_manifest")
    if not fs.exists(folder):
        return 0
    return max((int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)


def read_published(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    at = version(spark, root) if at is None else at
    return spark.read.parquet(f"{root}/v={at}")


def publish(df: DataFrame, root: str, expected: int) -> int:
    """Writes the next version aside and makes it current by creating its manifest, which only one writer can (K1, K2, K3)."""
    spark = df.sparkSession
    new = expected + 1
    aside = f"{root}/_aside-{spark.sparkContext.applicationId}-{new}"
    df.write.mode("overwrite").parquet(aside)
    fs, path = _fs(spark, root)
    fs.mkdirs(path(f"{root}/_manifest"))
    try:
        fs.create(path(f"{root}/_manifest/{new}.claim"), False).close()
    except Exception as error:
        fs.delete(path(aside), True)
        raise Conflict(f"version {new} is taken") from error
    if not fs.rename(path(aside), path(f"{root}/v={new}")):
        raise Conflict(f"version {new} has data")
    fs.create(path(f"{root}/_manifest/{new}"), True).close()
    return new


def publish_merged(spark: SparkSession, root: str, merge: Callable[[DataFrame | None], DataFrame], tries: int = 6) -> int:
    """Reads, merges and publishes, again with a fresh read if another writer was faster (K3)."""
    for _ in range(tries):
        at = version(spark, root)
        try:
            return publish(merge(read_published(spark, root, at) if at else None), root, at)
        except Conflict:
            continue
    raise Conflict(f"{tries} tries lost against other writers")


def nested(parents: DataFrame, children: dict[str, tuple[DataFrame, Sequence[str]]], key: Sequence[str]) -> DataFrame:
    """Parents with sorted arrays of their children, empty if they have none (K4)."""
    out = parents
    for name, (rows, order) in children.items():
        rest = [c for c in rows.columns if c not in key and c not in order]
        grouped = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(grouped, list(key), "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def packed_messages(blocks: DataFrame, recipient: str, section: str, text: str, order: Sequence[str], most: int = 4000) -> DataFrame:
    """Messages of at most `most` characters from whole blocks; a section's header opens it and every message it goes on in (K6).

    A sequential fold by recipient: rows arrive sorted and stream through, so a task holds one message.  A block that is
    too long by itself is a message of its own.
    """

    def step(state: list | None, row: dict) -> tuple[list, list[tuple]]:
        n, now, last = state or (1, "", None)
        head = row["section"]
        title = f"{head}\n" if head is not None else ""
        piece = row["text"] if head == last and now else title + row["text"]
        if now and len(now) + 1 + len(piece) > most:
            return [n + 1, title + row["text"], head], [(n, now)]
        return [n, f"{now}\n{piece}" if now else piece, head], []

    names = [f"o{i}" for i in range(len(order))]
    plain = blocks.select(
        F.col(recipient), F.col(section).alias("section"), F.coalesce(text, F.lit("")).alias("text"), *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)]
    )
    out = folded(plain, [recipient], names, step, "part int, message string", lambda state: [(state[0], state[1])] if state and state[1] else [])
    parts = out.groupBy(recipient).agg(F.max("part").alias("parts"))
    return out.join(parts, recipient)


def digest(rows: DataFrame, group: str, title: Column, order: Sequence[str]) -> DataFrame:
    """One HTML section by group with its escaped titles in order (K7)."""
    safe = F.replace(F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    items = F.array_sort(F.collect_list(F.struct(*order, F.concat(F.lit("<li>"), safe, F.lit("</li>")).alias("li"))))
    out = rows.groupBy(group).agg(items.alias("items"), F.count("*").alias("n"))
    return out.select(group, "n", F.concat(F.lit("<h2>"), F.col(group).cast("string"), F.lit("</h2><ul>"), F.array_join("items.li", ""), F.lit("</ul>")).alias("html"))


def encrypted(c: Column, key: Column) -> Column:
    """Authenticated encryption with a key of the caller (K8)."""
    return F.base64(F.aes_encrypt(c, key, F.lit("GCM")))


def delivering(send: Callable[[list[dict]], None], most: int = 500) -> Callable[[DataFrame, int], None]:
    """A foreachBatch callback that hands bounded lists of rows to `send` on the executors (K9)."""

    def deliver(df: DataFrame, epoch: int) -> None:
        def each(rows) -> None:
            held: list[dict] = []
            for row in rows:
                held.append(row.asDict(recursive=True))
                if len(held) >= most:
                    send(held)
                    held = []
            if held:
                send(held)

        df.foreachPartition(each)

    return deliver


def exported_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(df: DataFrame, columns: Sequence[str], width: int = 24) -> DataFrame:
    """Fixed-width lines, as a command line prints them (K5)."""
    cells = [F.rpad(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("-")), 1, width), width, " ") for c in columns]
    return df.select(*columns, F.rtrim(F.concat_ws(" ", *cells)).alias("line"))


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def state_json(rows: DataFrame, key: str) -> DataFrame:
    """Each row as a JSON document under its key, nulls left out."""
    return rows.select(key, F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("document"))
