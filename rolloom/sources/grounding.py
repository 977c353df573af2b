"""Grounding items: (source_id, body, metadata), from files, topics or a table."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.functions.columns import stable_id

BODY_CHARS = 12_000
SUFFIXES = ("txt", "md", "json")
SCHEMA = "source_id string, body string, metadata map<string,string>"


def from_files(spark: SparkSession, folder: str, glob: str | None = None, suffixes: tuple[str, ...] = SUFFIXES, max_chars: int = BODY_CHARS) -> DataFrame:
    """Text files below the folder, each as one item of at most max_chars characters; bytes that aren't UTF-8 are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(folder).filter(F.col("path").rlike(r"(?i)\.(" + "|".join(suffixes) + r")$"))
    path = F.regexp_replace("path", "^file:/*", "/")
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return files.select(
        stable_id(path).alias("source_id"), F.substring(text, 1, max_chars).alias("body"),
        F.create_map(F.lit("path"), path, F.lit("name"), F.element_at(F.split(path, "/"), -1)).alias("metadata"),
    ).orderBy(F.element_at("metadata", "path"))


def from_table(df: DataFrame, key: str, text: str, max_chars: int = BODY_CHARS, tag: str = "doc") -> DataFrame:
    """A table with a text column; blank texts are no items; all other columns are metadata, as text."""
    rest = [c for c in df.columns if c != text]
    meta = F.map_from_entries(F.array(*(F.struct(F.lit(c), F.col(c).cast("string")) for c in rest)))
    return df.filter(F.length(F.trim(text)) > 0).select(stable_id(tag, F.col(key)).alias("source_id"), F.substring(text, 1, max_chars).alias("body"), meta.alias("metadata"))


TOPICS = (
    {"topic": "ratios and mixtures", "difficulty": "school"},
    {"topic": "remainders", "difficulty": "contest"},
    {"topic": "conditional probability", "difficulty": "school"},
    {"topic": "areas and extremes", "difficulty": "contest"},
    {"topic": "pairs of linear equations", "difficulty": "school"},
)


def from_topics(spark: SparkSession, topics: list[dict[str, Any]] | tuple = TOPICS) -> DataFrame:
    rows = [(t["topic"], t.get("difficulty"), json.dumps(t), {k: str(v) for k, v in t.items()}) for t in topics]
    df = spark.createDataFrame(rows, "topic string, difficulty string, body string, metadata map<string,string>")
    return df.select(stable_id("math", F.col("topic"), F.coalesce("difficulty", F.lit("?"))).alias("source_id"), "body", "metadata")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(value: variant) of the lines that are JSON; blank and malformed ones are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.try_parse_json("value").alias("value")).filter("value is not null")
