"""Texts and images to lines."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenfold.functions import text as norm
from evenfold.schema import Profile


def _numbered(texts: DataFrame, lines, keep: list[str]) -> DataFrame:
    return texts.select(*keep, F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line") + 1)


def to_lines(texts: DataFrame, keep: list[str], column: str = "text") -> DataFrame:
    """keep, line, text: lines trimmed, empty ones left out before they are numbered. Null texts have none."""
    lines = F.filter(F.transform(F.split(column, "\r?\n"), norm.trim), lambda x: x != "")
    return _numbered(texts, lines, keep)


def to_lines_keep_blank(texts: DataFrame, keep: list[str], column: str = "text") -> DataFrame:
    """The same with empty lines kept, except the one after a last line end."""
    parts = F.transform(F.split(column, "\r?\n"), norm.trim)
    last = F.regexp_like(F.col(column), F.lit("(^|\n)$"))
    return _numbered(texts, F.when(last, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), keep)


def normalize(lines: DataFrame, profile: Profile) -> DataFrame:
    """Lines by a profile: uncertain ones dropped, texts normalized, empty ones dropped, the rest numbered anew within its reading's page. Without
    confidence a line stays; a confidence is compared as the double that its float is."""
    rows = lines.where("text is not null")
    if profile.min_confidence > 0:
        c = F.col("confidence")
        rows = rows.where(c.isNull() | (c.cast("double") >= profile.min_confidence))
    rows = rows.withColumn("text", norm.by_profile(F.col("text"), profile)).where("text <> ''")
    from pyspark.sql import Window

    order = [F.col("line"), F.col("line_id")] if "line_id" in rows.columns else [F.col("line"), F.col("text")]
    return rows.withColumn("line", F.row_number().over(Window.partitionBy("group_id", "variant", "page").orderBy(*order)))


def to_text(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, text: all lines of a document in order of page and line, joined by line ends. One document's lines meet, as its text is one value."""
    got = F.array_sort(F.collect_list(F.struct("page", "line", "text")))
    return lines.groupBy(*by).agg(F.array_join(F.transform(got, lambda x: x["text"]), "\n").alias("text"))


def tesseract(image: bytes, lang: str, variant: str) -> str:
    """Runs the tesseract command on an image, through its standard input and output; fails as the command fails."""
    return subprocess.run(["tesseract", "stdin", "stdout", "-l", lang], input=image, check=True, capture_output=True).stdout.decode()


def read_images(images: DataFrame, lang: str = "ita", provider: Callable[[bytes, str, str], str] = tesseract) -> DataFrame:
    """(source, variant, text) of rows (source, variant, content binary); provider is any function of bytes, language and variant."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["source", "variant"]].assign(text=[provider(bytes(c), lang, v) for c, v in zip(b["content"], b["variant"], strict=True)])

    return images.select("source", "variant", "content").mapInPandas(run, "source string, variant string, text string")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, content) of all files under a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "content")
