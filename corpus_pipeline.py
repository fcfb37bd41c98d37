"""From documents to packed training sequences, stage by stage.

Each stage works on all that the one before it kept, written as Parquet and read again. All but the last
return the columns of ``documents``.

Defined results: null and empty texts are scored, fingerprinted and packed as empty texts; ids that are null or repeat are rows of their
own, as near copies are told apart by rows and not by ids; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import packing, quality, simhash_dedup, substring_dedup, toxicity
from millrace.llm._common import drop_stash, make_importable, stash, table
from millrace.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose nothing stay as they are; of the others the kept words stay, joined by one space."""
    out = substring_dedup.without_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*(c.alias(name) for name, c in columns.items()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("simhash_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's table is deleted once the next one has been written whole."""
    make_importable(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop_stash(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
