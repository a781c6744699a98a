"""Operator 4, exact dedup: counting quotient filters of fingerprints, merged without loss; only rows
whose fingerprint counts above one are compared byte by byte."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, documents, materialize, ship


class QuotientFilter:
    """A counting quotient filter over one segment of the 64-bit fingerprints, in compact form.

    The top `segment_bits` of a fingerprint name the segment, the next `quotient_bits` are its
    quotient, the rest is its remainder. `occupieds` has a bit for each quotient that has a run;
    the runs follow one another in `slots`, in order of quotient and, within a run, of remainder.
    A remainder that counts above one is followed by counter slots, the digits of count - 1;
    `counters` marks them and `runends` the last slot of each run. Nothing is lost: decode() gives
    back every fingerprint and count.
    """

    def __init__(self, segment_bits: int, quotient_bits: int, occupieds: bytes, runends: bytes, counters: bytes, slots: bytes, n_slots: int):
        self.segment_bits, self.quotient_bits = segment_bits, quotient_bits
        self.occupieds, self.runends, self.counters, self.slots, self.n_slots = occupieds, runends, counters, slots, n_slots

    @staticmethod
    def width(segment_bits: int, quotient_bits: int) -> int:
        return -(-(64 - segment_bits - quotient_bits) // 8)

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, segment_bits: int, quotient_bits: int) -> QuotientFilter:
        """prints: sorted, distinct, of one segment (unsigned)."""
        r = 64 - segment_bits - quotient_bits
        w = cls.width(segment_bits, quotient_bits)
        remainder = prints & np.uint64((1 << r) - 1)
        quotient = (prints >> np.uint64(r)) & np.uint64((1 << quotient_bits) - 1)
        occupied = np.zeros(1 << quotient_bits, np.uint8)
        occupied[quotient.astype(np.int64)] = 1
        more = counts.astype(np.uint64) - np.uint64(1)
        digits, rest = np.zeros(len(prints), np.int64), more.copy()
        while rest.any():
            digits += rest > 0
            rest = rest >> np.uint64(8 * w) if 8 * w < 64 else np.zeros_like(rest)
        size = 1 + digits
        at = np.cumsum(size) - size
        n = int(size.sum())
        slots, counters, runends = np.zeros(n, np.uint64), np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        slots[at] = remainder
        for k in range(int(digits.max(initial=0))):
            has = digits > k
            slots[at[has] + 1 + k] = (more[has] >> np.uint64(8 * w * k)) & np.uint64((1 << 8 * w) - 1 if 8 * w < 64 else 2**64 - 1)
            counters[at[has] + 1 + k] = 1
        last = np.append(quotient[1:] != quotient[:-1], True) if len(prints) else np.empty(0, bool)
        runends[(at + size - 1)[last]] = 1
        packed = slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].tobytes()
        return cls(segment_bits, quotient_bits, np.packbits(occupied).tobytes(), np.packbits(runends).tobytes(), np.packbits(counters).tobytes(), packed, n)

    def decode(self, segment: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts."""
        w, r, n = self.width(self.segment_bits, self.quotient_bits), 64 - self.segment_bits - self.quotient_bits, self.n_slots
        bits = lambda b, k: np.unpackbits(np.frombuffer(b, np.uint8), count=k)
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :w] = np.frombuffer(self.slots, np.uint8).reshape(n, w)
        slots = slots.view("<u8").ravel()
        counter, runend = bits(self.counters, n).astype(bool), bits(self.runends, n)
        quotients = np.flatnonzero(bits(self.occupieds, 1 << self.quotient_bits)).astype(np.uint64)
        run = np.cumsum(runend) - runend
        head = np.flatnonzero(~counter)
        prints = (quotients[run[head]] << np.uint64(r)) | slots[head]
        if self.segment_bits:
            prints |= np.uint64(segment << (64 - self.segment_bits))
        counts = np.ones(len(head), np.uint64)
        of = np.cumsum(~counter) - 1
        digit = np.arange(n) - head[of]
        for k in range(1, int(digit.max(initial=0)) + 1):
            at = np.flatnonzero(digit == k)
            counts[of[at]] += slots[at] << np.uint64(8 * w * (k - 1))
        return prints, counts.astype(np.int64)

    FIELDS = "segment int, quotient_bits int, n_slots int, occupieds binary, runends binary, counters binary, slots binary"

    def row(self, segment: int) -> tuple:
        return segment, self.quotient_bits, self.n_slots, self.occupieds, self.runends, self.counters, self.slots


def merge_sorted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints with summed counts, of sorted parts that are merged two by two: each finds its places among the
    other's by binary search, so that nothing is sorted anew."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [_merge_two(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _merge_two(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each part's fingerprints are distinct; those in both add their counts."""
    (x, n), (y, m) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    at = np.searchsorted(x, y)
    both = (x[np.minimum(at, len(x) - 1)] == y) & (at < len(x)) if len(x) else np.zeros(len(y), bool)
    n = n.copy()
    n[at[both]] += m[both]
    return np.insert(x, at[~both], y[~both]), np.insert(n, at[~both], m[~both])


def repeated_fingerprints(prints: DataFrame, segment_bits: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once among all rows of the column fp."""
    ship(prints.sparkSession)

    def build(batches):
        def filters(held):
            fps, n = np.unique(np.concatenate(held), return_counts=True)
            segment = fps >> np.uint64(64 - segment_bits) if segment_bits else np.zeros(len(fps), np.uint64)
            ends = np.append(np.flatnonzero(segment[1:] != segment[:-1]) + 1, len(fps))
            rows, at = [], 0
            for to in ends.tolist():
                q = min(20, max(3, (to - at).bit_length()))
                rows.append(QuotientFilter.build(fps[at:to], n[at:to], segment_bits, q).row(int(segment[at])))
                at = to
            kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [f.split()[0] for f in QuotientFilter.FIELDS.split(", ")])

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy().astype(np.int64).view(np.uint64))
                n += b.num_rows
            if n >= 1 << 21:  # a filter holds about so many at most
                yield filters(held)
                held, n = [], 0
        if n:
            yield filters(held)

    def merge(t: pa.Table) -> pa.Table:
        parts = [QuotientFilter(segment_bits, q, o, e, c, s, n).decode(k) for k, q, n, o, e, c, s in zip(*(t.column(i).to_pylist() for i in range(7)))]
        fps, n = merge_sorted(parts)
        return pa.table({"fp": fps[n > 1].view(np.int64), "n": n[n > 1]})

    return prints.select("fp").mapInArrow(build, QuotientFilter.FIELDS).groupBy("segment").applyInArrow(merge, "fp long, n long")


#: Deleted before texts are compared.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def squeezed(text: Column) -> Column:
    """The text without the characters in SPACES; null: empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def segment_bits_for(rows: int, parallel: int) -> int:
    """Segments of some 2**18 rows, and a few for each task."""
    return min(24, max((4 * parallel).bit_length(), (rows >> 18).bit_length()))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(labelled rows, groups): rows (doc_id, n_cp, fp, text_sha256) of all documents, and
    (fp, text_sha256, keep_cp, keep_id, group_size) of each group of two or more equal texts."""
    spark = docs.sparkSession
    norm = squeezed(F.col(text_col))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_cp"), norm.alias("norm"))
    hashed = base.withColumn("fp", F.xxhash64("norm"))
    rows = materialize(hashed.select("doc_id", "n_cp", "fp", F.sha2(F.encode("norm", "utf-8"), 256).alias("text_sha256")), "fingerprints")
    bits = segment_bits_for(rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    repeated = materialize(repeated_fingerprints(rows, bits), "repeated")
    suspects = F.broadcast(repeated.select("fp")) if repeated.count() * 16 <= BROADCAST_BYTES else repeated.select("fp")
    # byte verification: whole texts are the key, so each task sends one row for each text it has
    best = F.max(F.struct("n_cp", F.coalesce(-F.col("doc_id"), F.lit(-(2**63))).alias("minus"), "doc_id"))
    verified = hashed.join(suspects, "fp", "left_semi").groupBy("fp", "norm").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = verified.where("group_size > 1").select("fp", F.sha2(F.encode("norm", "utf-8"), 256).alias("text_sha256"), F.col("best.n_cp").alias("keep_cp"), F.col("best.doc_id").alias("keep_id"), "group_size")
    return rows, materialize(groups, "groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when identical without white space. Of equal ones the row of most code points in
    its original text, then of the smallest id, stays; a null id comes last. Null text is empty, and
    empty texts are equal. Rows that repeat the id and length of the row that stays are all marked
    kept (keep_first() leaves one). Texts of any length are compared whole. Other columns are ignored; an empty table gives an empty one.

    Texts are read twice and shuffled only where their fingerprint repeats, one copy for each task;
    a group of any size costs one row for each task. Labels join by (fp, digest), where adaptive
    execution splits a group that holds many rows.
    """
    rows, groups = duplicate_groups(docs, id_col, text_col)
    kept = F.col("keep_cp").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp")))
    joined = rows.join(groups, ["fp", "text_sha256"], "left")
    return joined.select("doc_id", F.when(F.col("keep_cp").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one for each group of equal texts, with their columns.

    Null texts count as empty, and empty texts are one group; a null id comes last; of rows that repeat the id and length
    of the one that stays, one remains; texts of any length are compared whole; an empty table stays empty."""
    _, groups = duplicate_groups(docs, id_col, text_col)
    columns = [F.col(f"_row.`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_cp"), squeezed(F.col(text_col)).alias("_norm"))
    named = named.select("_row", "_id", "_cp", F.xxhash64("_norm").alias("fp"), F.sha2(F.encode("_norm", "utf-8"), 256).alias("text_sha256"))
    small = groups.count() * 128 <= BROADCAST_BYTES
    joined = named.join(F.broadcast(groups) if small else groups, ["fp", "text_sha256"], "left")
    single = joined.where(F.col("keep_cp").isNull()).select(*columns)
    chosen = joined.where(F.col("keep_cp").isNotNull() & F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_cp") == F.col("keep_cp")))
    one = chosen.groupBy("fp", "text_sha256").agg(F.first("_row").alias("_row")).select(*columns)
    return single.unionByName(one)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, max(cp) AS keep_cp FROM n GROUP BY norm
), k AS (
  SELECT n.norm, min(n.doc_id) AS keep_id FROM n JOIN g ON g.norm = n.norm AND g.keep_cp = n.cp GROUP BY n.norm
)
SELECT n.doc_id, k.keep_id, g.group_size, n.doc_id = k.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON g.norm = n.norm JOIN k ON k.norm = n.norm
"""
