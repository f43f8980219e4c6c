"""From raw documents to token ids: STAGES in order, each reading what the one before has written.

Each stage works on all rows that its predecessor kept, takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns of any name, and, but for the last, returns the columns that it was given.
What becomes of such rows is said at each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, mixing, quality, sentencepiece_codec, simhash
from plumbline.llm._shared import drop_paths, drop_written, written, written_now


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects. It is fitted on labels of the documents that are there; a null text goes, an empty one is judged by its statistics, equal texts are judged alike,
    and where labels of either class are too few, every document with a text stays."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text: the least doc_id, null ids last. Null texts equal nothing and stay; empty texts equal each other; of rows that repeat id and text one stays."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the least doc_id. Documents with a null id, a null text or no word are in no group and stay, as do rows that repeat a kept id."""
    return simhash.near_dedup(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws each source's budget, in as many epochs as it takes: a row for each draw. Texts without a token, null ones among them, are never drawn; a null source is a source of its own; the text at the cut ends with the last token that counts."""
    return mixing.mix_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_ids, round_trip): token ids in place of the text; null for a null text, none for an empty one. Rows are encoded one by one, so ties and repeated rows need no rule."""
    return sentencepiece_codec.encode_documents(docs, keep=["doc_id", "lang", "source"])


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("source mixing", mix_stage), ("sentencepiece", encode_stage)]
#: The classifier and the signatures can't be written in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the tables that stages write on the way, only the one that these rows are read from is left; it goes when the process ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before = written_now()
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        made = written(out, f"pipeline-{k}-{name.replace(' ', '-')}")
        # what this stage needed on its way, and what it read
        drop_paths(written_now() - before - {made._plumbline_path})
        drop_written(docs)
        docs = made
    return docs
