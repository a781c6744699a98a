"""Operator 8, binary token output: sorted-string-table shards of token ids keyed by document."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, public_file
from .common import documents, materialize, release, rows_of, scratch, ship, task_id
from .sstable import Reader, Writer

MANIFEST = "shard int, part int, file string, n_docs long, n_tokens long, n_bytes long"


def _fs(uri: str):
    """The file system and path of a folder that all executors reach (a local or any Hadoop, S3 or GCS address)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:///", "/", 1) if uri.startswith("file:///") else uri.removeprefix("file:"))


def write_token_tables(docs: DataFrame, tokenizer_file: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, width: int = 2, file_bytes: int = 256 << 20) -> DataFrame:
    """Encodes whole texts and writes them as table files in ascending order of the identifier.

    One range shuffle of (id, text); ids are made after it, and never shuffled. Each range becomes
    one or more files of about file_bytes, written under a name of the attempt and renamed when
    complete, so a repeated or speculative task replaces its own files by equal ones. Returns the
    manifest (shard, part, file, n_docs, n_tokens, n_bytes), itself a table in the shared folder.

    Null text: empty. Very long texts are encoded whole, piece by piece. Null ids come first. Rows of equal id are ordered by text, and all are kept.
    Other columns are ignored. No rows: no file and an empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)

    def write(batches):
        enc, shard, made, out = encoder(tokenizer_file, True), task_id(), [], None
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)

        def close():
            sink, table, temporary, final = out
            table.close()
            sink.close()
            fs.move(temporary, final)
            made.append((shard, len(made), final, table.docs, table.tokens, table.offset))

        for b in rows_of(batches, 4 << 20):
            _, ids = enc.encode(b.column(1))
            for doc, x in zip(b.column(0).to_pylist(), ids):
                if out is None:
                    final = f"{root}/shard-{shard:06d}-{len(made):04d}.sst"
                    temporary = f"{final}.{_attempt()}"
                    sink = fs.open_output_stream(temporary)
                    out = (sink, Writer(sink, width), temporary, final)
                if width < 4 and len(x) and int(x.max()) >> 8 * width:
                    raise ValueError(f"an id needs more than {width} bytes")
                out[1].add(doc, x if end_id is None else np.append(x, np.uint32(end_id)))
                if out[1].offset >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        release()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "part", "file", "n_docs", "n_tokens", "n_bytes"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = slim.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(dealt.mapInArrow(write, MANIFEST), "manifest")


def _attempt() -> str:
    from pyspark import TaskContext

    at = TaskContext.get()
    return f"attempt-{at.taskAttemptId() if at else 0}"


def read_token_tables(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files: start counts the
    ids of all documents before it. One task streams a file block by block. The running sum over
    files is over the manifest alone, a row for each file."""
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))

    def read(batches):
        fs, _ = _fs(folder)

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        for b in batches:
            for path, base, size in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows, at = [], base
                with fs.open_input_file(path) as f:
                    for doc, ids in Reader(f, size).scan():
                        rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4"))))
                        at += len(ids)
                        if len(rows) == 4096:
                            yield made(rows)
                            rows = []
                yield made(rows)
        release()

    # a number of its own, which adaptive execution keeps: the manifest is tiny, the files are not
    files = files.select("file", "base", "n_bytes").repartition(max(1, min(manifest.count(), 10_000)), "file")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-tables")
    manifest = write_token_tables(documents(spark, sf_dir), public_file("byte_bpe_50k.json"), folder)
    return read_token_tables(manifest, folder)
