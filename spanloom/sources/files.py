"""Texts, evaluation sets and results in files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.operators.dataset import SQUAD, flatten_squad

FRAME = "source string, target string, idx_start array<int>"


def is_text(content: Column, sample: int = 1024) -> Column:
    """No NUL in the first bytes, and they are UTF-8; a character that the end of the sample cuts does not count against it."""
    head = F.substring(content, 1, sample)
    valid = F.lit(False)
    for spare in range(4):
        part = F.substring(content, 1, F.least(F.octet_length(content), F.lit(sample)) - spare)
        cut = F.lit(spare == 0) | (F.octet_length(content) > sample)
        valid = valid | (cut & F.is_valid_utf8(part.cast("string")))
    return ~F.regexp_like(F.hex(head), F.lit("^(..)*00")) & valid


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """(path, is_text) of every file under a path; Spark lists no empty files."""
    return spark.read.format("binaryFile").load(path).select("path", is_text(F.col("content")).alias("is_text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files, each whole; a binary file is an error."""
    found = spark.read.format("binaryFile").load(path)
    text = F.when(is_text(F.col("content")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("appears to be binary, not text: "), F.col("path"))))
    return found.select("path", text.alias("text"))


def load_text(value: str) -> str:
    """The content of a file of that name, else the value itself."""
    if not os.path.isfile(value):
        return value
    with open(value, "rb") as f:
        data = f.read()
    head = data[:1024]
    try:
        if b"\0" in head:
            raise ValueError
        data.decode("utf-8")
    except ValueError as e:
        raise ValueError(f"{value} appears to be binary, not text") from e
    return data.decode("utf-8")


def read_squad(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Records of a question-answering file; with ``split`` the path is a folder that holds that split's file."""
    if split is not None and split not in ("train", "dev"):
        raise ValueError(f"unknown split {split!r}: train or dev")
    where = path if split is None else f"{path}/{split}-v2.0.json"
    return flatten_squad(spark.read.schema(SQUAD).json(where, multiLine=True))


def read_frame(spark: SparkSession, *paths: str) -> DataFrame:
    """Pairs from JSON arrays or lines."""
    return spark.read.schema(FRAME).json(list(paths), multiLine=True)


def write_frames(frames: DataFrame, path: str) -> None:
    """Pairs with sorted starts, a folder for each value of ``split``."""
    frames.withColumn("idx_start", F.sort_array("idx_start")).write.partitionBy("split").mode("overwrite").json(path)


def write_alignments(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def as_json(alignments: Column) -> Column:
    return F.to_json(alignments, {"pretty": "true"})


def write_text(rendered: DataFrame, column: str, path: str) -> None:
    rendered.select(F.col(column).cast(T.StringType()).alias("value")).write.mode("overwrite").text(path)
