"""Training corpus from documents: language ID, line dedup, near-copy join, decontamination, tokens."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefate.llm import byte_bpe, decontaminate, jaccard_join, language_id, line_dedup
from linefate.llm.common import Bits, Folder, materialized, read, scratch

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those without a letter go."""
    return language_id.keep(docs, language_id.fit(docs, scratch(spark, "languages")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; what is nothing else goes."""
    return line_dedup.dedup(docs)


def by_bits(docs: DataFrame, bits: str, member: bool) -> DataFrame:
    """The rows whose doc_id the set says yes to, or no, found where they are read."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(Bits.has(bits, batch.column(0).to_numpy()) == member)
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=schema.names).filter(keep)

    return docs.select(F.xxhash64("doc_id"), *docs.columns).mapInArrow(run, schema)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies; of repeated rows one. Documents without words stay.

    Texts of which a bit table of the ids to leave out is sure stay where they are read; the others meet the ids that stay.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    decided = materialized(jaccard_join.join(docs).groupBy("doc_id").agg(F.count_if(stays).alias("n")), "kept")
    kept = decided.where("n > 0")
    gone = Bits.write(decided.where("n = 0").select(F.xxhash64("doc_id").alias("hash")), Folder(spark, "copies"), "gone")
    unsure = by_bits(docs, gone, True).join(kept.select(F.col("doc_id").alias("kept_id")), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*docs.columns)
    out = by_bits(docs, gone, False).unionByName(unsure)
    if kept.where("n > 1").isEmpty():
        return out
    return out.dropDuplicates(["doc_id", "text"])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate; those stay to the byte."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), drop=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return byte_bpe.round_trip(docs, MULTI, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_boilerplate),
    ("jaccard_join", one_of_each_group),
    ("decontamination", decontaminated),
    ("byte_bpe", tokens),
]

#: The stages are models, a tokenizer and a connected-components search, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
