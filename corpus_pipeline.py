"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.

Every stage takes null ids and texts, empty texts (null counts as empty), texts of any length, which it reads whole, repeated rows,
other columns of any name, and an empty table, which gives an empty result. What each makes of them stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontamination, exact_dedup, jaccard_join, packing, toxicity
from tideline.llm.bpe import public_file
from tideline.llm.common import documents, materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the factorization machine, fitted on the labelled ones, scores at one half or more.

    Empty texts score the model's bias, below one half where clean labels prevail, and stay; repeated rows stay or go together; without
    labels all stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is equal but for white space: the longest, then that of the smallest id, null last.

    Empty texts are one group, and so are repeated rows: one of each stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component linked by a Jaccard similarity of 0.8 over five-word shingles: that of
    the smallest id, null last.

    Texts without words link with nothing and stay; shorter texts than five words are one shingle."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Empty texts hold none and stay; without items all stay."""
    return decontamination.keep_clean(docs, decontamination.build(table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a sequence of at most 2048 tokens.

    An empty text is one piece, its end token; repeated rows are packed each; longer texts are cut, the first piece taking what is over."""
    return packing.best_fit_packing(docs, public_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
