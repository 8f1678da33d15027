"""Reading corpora, role tuples and legacy files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, text: str = "text", key: str | None = None) -> DataFrame:
    """Only the id and text columns reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*([key] if key else []), F.col(text).alias("text"))


def after(df: DataFrame, key: str, last: int | None) -> DataFrame:
    """Rows not yet seen: the filter reaches the files' statistics."""
    return df if last is None else df.filter(F.col(key) > last)


def shuffled(df: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """A fixed order that looks random: by a seeded hash of the key."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key)


def read_shards(spark: SparkSession, folder: str, columns: list[str] | None = None, pattern: str = "part-*.parquet") -> DataFrame:
    """The folder's Parquet shards; an empty folder is an error."""
    df = spark.read.option("pathGlobFilter", pattern).parquet(folder)
    return df.select(*columns) if columns else df


def tuple_elements(text: Column, n: int | None = None) -> Column:
    """The strings of a printed tuple, quoted either way (an apostrophe inside changes the quotes)."""
    quoted = F.regexp_extract_all(text, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    bare = F.transform(quoted, lambda x: F.regexp_replace(F.substring(x, 2, F.length(x) - 2), r"\\(.)", "$1"))
    return F.slice(bare, 1, n) if n else bare


def naive_elements(text: Column) -> Column:
    """Elements of a printed tuple whose strings hold no quotes or commas."""
    return F.split(F.translate(text, "()'", ""), ", ")


def read_legacy(spark: SparkSession, path: str, roles: list[str]) -> DataFrame:
    """(sent_id, roles..., sentence_text) of a CSV whose column vector holds printed tuples."""
    df = spark.read.csv(path, schema="sent_id long, vector string, sentence_text string", header=True, quote='"', escape='"', multiLine=True)
    elements = tuple_elements(F.col("vector"), len(roles))
    rows = df.withColumn("e", elements).filter(F.size("e") == len(roles))
    return rows.select("sent_id", *[F.col("e")[j].alias(r) for j, r in enumerate(roles)], "sentence_text")


def distinct_tuples(rows: DataFrame, roles: list[str]) -> DataFrame:
    return rows.select(*roles).dropna().dropDuplicates()
