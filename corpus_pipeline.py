"""A corpus pipeline over documents: each stage is one operator, its result written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, decontaminate, similarity, suffixarray, toxicity
from brindle.llm.common import CARRIED, discard, scratch, table

#: Words of a repeat that is cut from documents.
LONG_REPEAT = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on labels, doesn't reject."""
    model = toxicity.train(toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, model, carry=True).filter("predicted = 0").select(f"{CARRIED}.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts."""
    return similarity.keep_one(docs)


def cut_long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of LONG_REPEAT words or more that stand elsewhere too; n_chars follows. Null text becomes empty."""
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")}
    cut = suffixarray.remove_long_repeats(docs, window=LONG_REPEAT, words=True, carry=True)
    return cut.select(*(new.get(c, F.col(f"{CARRIED}.`{c}`")).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.filter("not contaminated").select(f"{CARRIED}.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of these and of the decoded text."""
    return bpe.encode_documents(docs, bpe.vocabulary, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("long_repeats", cut_long_repeats), ("decontamination", drop_contaminated), ("bpe", encode)]

#: SQL can express neither the trained scores nor the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
        if before is not None:  # no later step reads it
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
