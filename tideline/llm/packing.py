"""Operator 10, best-fit packing: vector best-fit decreasing over residual tokens, documents and attention cost.

A piece is known to the packer by its length L alone: its demand is the vector (L, 1, L * L). So the
number of pieces of each length is all that a plan needs, at most max_tokens numbers however large the
corpus is. The driver plans on these numbers, bins of equal residual and filling together, exactly as
if the pieces came one by one, longest first; executors then look up each piece's place by its rank
among the pieces of its length. No piece's data pass the driver, and the plan covers all of them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, public_file
from .common import documents, materialize, release, rows_of, ship, task_id

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, nth long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most. attention: sum of squared lengths; its default, like that of
    documents, is what a sequence of max_tokens can reach, so that only tokens bind."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.float64)


def plan(histogram: dict[int, int], capacity: Capacity, select: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Vector best-fit decreasing on counts by length.

    A piece goes into the open bin that has room in every dimension and, by select, either the least
    weighted norm of what would remain ("norm"), or the greatest weighted dot product of demand and
    residual ("dot"); a new bin opens only if none has room. Ties go to the bin opened first.
    Returns runs (length, first rank, past rank, first sequence, offset): the pieces of that length
    with these ranks go to consecutive sequences at one offset; and the number of sequences.
    """
    full = capacity.vector()
    w = np.asarray(weights, np.float64)
    res = np.empty((0, 3))
    count, first = np.empty(0, np.int64), np.empty(0, np.int64)
    runs, opened = [], 0

    def put(length, rank, times, sequence, used, each):
        """times bins from sequence on get each pieces after used tokens."""
        for j in range(each):
            runs.append((length, rank + j * times, rank + (j + 1) * times, sequence, used + j * length))
        return rank + each * times

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = np.array([length, 1, length * length], np.float64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while left:
            fits = np.flatnonzero((res >= need).all(axis=1) & (count > 0))
            fit = None
            if len(fits):
                r = res[fits] / full
                score = (w * ((res[fits] - need) / full) ** 2).sum(axis=1) if select == "norm" else -(w * r * (need / full)).sum(axis=1)
                fit = int(fits[np.lexsort((first[fits], score))[0]])
                room, many = res[fit], int(count[fit])
            else:
                room, many = full, left
            # by the norm a bin just filled stays the best for the same length; by the product it does not
            most = int(np.floor((room / need).min())) if select == "norm" or fit is None else 1
            each = min(most, left)
            times = min(many, left // each)
            if fit is None:
                sequence, used, opened = opened, 0, opened + times
            else:
                sequence, used = int(first[fit]), int(full[0] - room[0])
                first[fit] += times
                count[fit] -= times
            rank = put(length, rank, times, sequence, used, each)
            left -= each * times
            after = room - each * need
            if after[0] > 0 and after[1] > 0:
                res, count, first = np.vstack([res, after]), np.append(count, times), np.append(first, sequence)
        keep = count > 0
        res, count, first = res[keep], count[keep], first[keep]
    return runs, opened


def cut(docs: DataFrame, tokenizer_file: str, max_tokens: int, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> DataFrame:
    """Pieces of at most max_tokens of each encoded text; of a longer one the first piece takes what
    is over. chunk and nth number the pieces of a length within the task that made them."""
    ship(docs.sparkSession)

    def encode(batches):
        enc, chunk, seen = encoder(tokenizer_file, True), task_id(), np.zeros(max_tokens + 1, np.int64)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for b in rows_of(batches, 4 << 20):
            n, ids = enc.encode(b.column(1))
            n = n + (end_id is not None)
            # a text's pieces: the first takes what is over, the others are whole; an empty text is one piece
            pieces = np.maximum(1, -(-n // max_tokens))
            of = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = n - (pieces - 1) * max_tokens
            length = np.where(piece == 0, head[of], max_tokens)
            start = np.where(piece == 0, 0, head[of] + (piece - 1) * max_tokens)
            crc = np.empty(len(of), np.int64)
            for k, (i, begin, size) in enumerate(zip(of.tolist(), start.tolist(), length.tolist())):
                x = ids[i][begin : begin + size].astype("<u4")
                c = zlib.crc32(x)
                crc[k] = c if len(x) == size else zlib.crc32(end, c)
            # nth: how many pieces of that length the task made before
            order = np.argsort(length, kind="stable")
            kinds, first, times = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(of), np.int64)
            nth[order] = np.arange(len(of)) - np.repeat(first, times) + seen[length[order]]
            seen[kinds] += times
            ids_of = b.column(0).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(of), chunk, np.int32)), pa.array(nth)], ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"])
        release()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(encode, PIECES)


def pack(pieces: DataFrame, capacity: Capacity, select: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to pieces with a length, chunk and nth, as cut() gives them.

    Ranks by length: the pieces before a task's are summed over (chunk, length) counts, a small table.
    The driver gets one count for each length (capacity.tokens at most) and sends back the plan's runs.
    Pieces of length 0 (empty documents without an end id) are placed at offset 0 of sequence 0.
    """
    counts = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect() if r["length"]}
    runs, _ = plan(histogram, capacity, select)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    shift = int(table[:, 2].max()).bit_length() if len(table) else 1
    keys = (table[:, 0] << shift) | table[:, 1]

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            some = length > 0
            at = np.searchsorted(keys, (length << shift) | rank, "right") - 1 if len(keys) else np.zeros(len(length), np.int64)
            run = table[np.maximum(at, 0)] if len(keys) else np.zeros((len(length), 5), np.int64)
            seq, off = np.where(some, run[:, 3] + rank - run[:, 1], 0), np.where(some, run[:, 4], 0)
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["chunk", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_file: str, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, select: str = "norm") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of at most capacity.tokens; documents and attention costs are bounded too. Texts of any length
    are encoded whole. Null text is empty (its piece is the end id); null ids are kept; repeated rows are packed each; other columns
    are ignored; an empty table gives an empty one.
    """
    most = min(capacity.tokens, int(np.floor(np.sqrt(capacity.vector()[2]))))
    pieces = materialize(cut(docs, tokenizer_file, most, id_col, text_col, end_id), "pieces")
    return pack(pieces, capacity, select)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir), public_file("byte_bpe_50k.json"))
