"""Operator 6, sharding: a hierarchical weighted hash tree of regions, racks and shards. DataFrame functions only.

Law `key`: the identifier and the tree decide, and the tree follows from the number of shards; one more shard
takes rows only into itself, from any number of shards on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def regular_tree(shards: int, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """The tree that a number of shards decides, of weight 1 each: racks of per_rack shards, regions of racks. The
    tree of more shards holds that of fewer, so one more shard regroups none of the others."""
    return [Leaf(s // (racks * per_rack), s // per_rack, s) for s in range(shards)]


def _draw(key: Column, shard: Column, weight: Column) -> Column:
    """An exponential draw of rate weight, decided by key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard.cast("long")), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / weight


def descend(key: Column, tree: list[Leaf]) -> Column:
    """The shard that key reaches: region, rack and shard levels are descended to the child of least draw.

    A shard draws by its weight; a rack's or region's draw is the least of those below it, which is again an exponential
    draw, of the rate of its subtree's weight, so each child wins with a chance in proportion to that.
    A change of one shard's weight changes draws on the path to it alone: rows move into that shard if it
    gains or joins, and out of it if it loses or goes, wherever it stands, and no row moves between others.
    """

    def grouped(name, leaves, below):
        return F.array(*[below([x for x in leaves if getattr(x, name) == k]) for k in sorted({getattr(x, name) for x in leaves})])

    live = [x for x in tree if x.weight > 0]
    rack = lambda b: F.array(*[F.struct(F.lit(x.shard).alias("shard"), F.lit(float(x.weight)).alias("weight")) for x in sorted(b, key=lambda x: x.shard)])
    root = grouped("region", live, lambda a: grouped("rack", a, rack))

    def least(children, below):
        return F.array_min(F.transform(children, below))

    shard = lambda c: F.struct(_draw(key, c["shard"], c["weight"]).alias("draw"), c["shard"].alias("shard"))
    return least(root, lambda region: least(region, lambda rack: least(rack, shard)))["shard"].cast("int")


def assign(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard of every row.

    The identifier alone decides the shard (null ids: one shard). size is the text's UTF-8 bytes plus
    1, null text counting as empty. slot numbers a shard's rows from 0 without gaps: rows are dealt
    to buckets of about bucket_rows by a hash, numbered there, and shifted by the counts of the
    shard's buckets before, a small table; no task gets a whole shard. grown_shard: by the tree grown.
    Texts of any length stay where they are read. Repeated rows take a slot each; other columns are ignored; an
    empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col("doc_id")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    grown_shard = descend(key, grown) if grown else F.lit(None).cast("int")
    placed = materialize(slim.select("*", descend(key, tree).alias("shard"), grown_shard.alias("grown_shard")), "placed")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), placed.count() // bucket_rows)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("nth", F.row_number().over(within).cast("long") - 1)
    return numbered.join(base, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth")).alias("slot"), "grown_shard")


def op6_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(documents(spark, sf_dir), regular_tree(8), regular_tree(9))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
