"""Operator 1, token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, public_file
from .common import documents, lengths, release, rows_of, ship


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, batch_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, whole texts, without special tokens added.

    No shuffle: each task streams its rows in batches balanced by bytes; a text longer than a batch
    is cut at boundaries that no token crosses, so its memory is bounded too. Null and empty texts
    have 0 bytes and tokens; null ids are kept; repeated rows are counted each; other columns of the
    input are not read; an empty table gives an empty one.
    """
    ship(docs.sparkSession)

    def count(batches):
        enc = encoder(tokenizer_file, False)
        for b in rows_of(batches, batch_bytes):
            n, _ = enc.encode(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths(b.column(1))), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        release()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_file("word_bpe_49k.json"))
