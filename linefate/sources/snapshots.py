"""Normalized file versions: each distinct content is lexed once, however many versions hold it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexers import normalize
from ..operators.compare import LINES


def with_lines(tree: DataFrame, blobs: DataFrame) -> DataFrame:
    """``tree`` (…, path, content_id) of tracked paths and their lines, from ``blobs`` (content_id, content binary).

    Generated paths, other languages, contents over the size limit and those that aren't UTF-8 are left out.
    """
    tracked = tree.withColumn("language", text.tracked_language(F.col("path"))).where("language is not null")
    return attach(tracked, blobs.where(text.tracked_source(F.col("content"))))


def plain_lines(tree: DataFrame, blobs: DataFrame) -> DataFrame:
    """All paths as plain text."""
    return attach(tree.withColumn("language", F.lit("text")), blobs)


def attach(tree: DataFrame, blobs: DataFrame) -> DataFrame:
    wanted = tree.select("content_id", "language").distinct().join(blobs.select("content_id", F.col("content").cast("binary").alias("content")), "content_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content_id, language, content in pdf.itertuples(index=False):
                lines = normalize(bytes(content).decode("utf-8", "replace"), language)
                rows.append((content_id, language, [{"number": x.number, "kind": x.kind, "role": x.role, "content": x.content, "tokens": list(x.tokens), "matched": list(x.matched)} for x in lines]))
            yield pd.DataFrame(rows, columns=["content_id", "language", "lines"])

    lexed = wanted.select("content_id", "language", "content").mapInPandas(run, f"content_id string, language string, lines {LINES}")
    return tree.join(lexed, ["content_id", "language"])
