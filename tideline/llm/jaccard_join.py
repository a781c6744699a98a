"""Operator 5, n-gram Jaccard join: a T-occurrence search with DivideSkip over sets of word shingles.

x and y link when |x & y| >= J |x | y|, so their difference has at most d = (1 - J) / (1 + J) (|x| + |y|)
members. The join is exact; its steps:

1. Each text becomes its set of 64-bit shingle hashes; equal sets become one node.
2. Cells. Sets are cut by hash range into d + 1 + e parts, d being the most for a size band; of two that
   link, at least e + 1 parts are equal. Parts are ordered by how many sets have them, and each set leaves its e
   commonest out, as in a prefix filter: the rarest of the parts that two linked sets share is left out by
   neither. Passages that many texts share make common parts, so they do not join cells. A part
   meets the least node of its kind, never all others.
3. Search. Within a cell an inverted index lists the nodes of each shingle. For a query x, T is the least
   overlap that any partner needs. DivideSkip sets the L longest lists apart, merges the short ones,
   keeps the nodes met T - L times, and probes these in the long lists by binary search. A node that is
   in x's component already need not be probed.
4. A cell of more than a block's nodes is searched in blocks: first by one node, the one that shares
   most parts. All that link with it are one component. Of the rest only those matter that have T
   shingles which are not theirs alone in the cell; these are the queries that every block answers.
5. Components of the links give each document its class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, documents, materialize, release, rows_of, ship
from .components import components

BLOCK_NODES, BLOCK_SHINGLES = 128, 2_000_000


class _Words(dict):
    """Hash of each word met; emptied when it has grown to 200,000."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], width: int = 3) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a shorter text is one; without words, none.
    Words are lower-cased for A-Z alone and parted by the six ASCII white-space characters."""
    words = [(t or "").encode().lower().split() for t in texts]
    n = [len(w) for w in words]
    h = np.fromiter((_words[w] for x in words for w in x), np.uint64, sum(n))
    out, at = [], 0
    with np.errstate(over="ignore"):
        if len(h) >= width:
            rolled = np.zeros(len(h) - width + 1, np.uint64)
            for k in range(width):
                rolled = rolled * _A + _mix(h[k : len(h) - width + 1 + k] + _B)
            rolled = _mix(rolled)
        for k in n:
            if k >= width:
                out.append(np.unique(rolled[at : at + k - width + 1]))
            elif k:
                x = np.uint64(k)
                for v in h[at : at + k]:
                    x = _mix(np.array([x * _A + v + _C]))[0]
                out.append(np.array([x], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
            at += k
    return out


class Threshold:
    """Jaccard of at least num / den, in whole numbers."""

    def __init__(self, num: int = 9, den: int = 10):
        self.num, self.den = num, den
        edges = [den]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * 1.4)))
        self.edges = np.array(edges)  # first sizes of the bands

    def overlap(self, a, b):
        """Least overlap of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def linked(self, overlap, a, b):
        return (self.num + self.den) * overlap >= self.num * (a + b)

    def differ(self, size):
        """Most members in the difference of linked sets whose larger has this size."""
        return 2 * size * (self.den - self.num) // (self.num + self.den)

    def levels(self, size: int) -> list[int]:
        """Bands of the larger partner's size."""
        top = size * self.den // self.num
        return sorted({int(np.searchsorted(self.edges, s, "right")) for s in (size, top)})

    def parts(self, level: int) -> tuple[int, int]:
        """(parts, e) of a level; no parts: only equal sets link there."""
        d = self.differ(int(self.edges[level]) - 1)
        e = max(2, d // 4)
        return (d + 1 + e, e) if d else (0, 0)


def parts_of(s: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a set's parts at its levels, and for each its tag: the level, and how many of the level's commonest
    the set may leave out. Empty parts count as the commonest: e of them are left out here."""
    out, tags = [], []
    with np.errstate(over="ignore"):
        for level in t.levels(len(s)):
            m, e = t.parts(level)
            if not m:
                continue
            part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            sums, which = np.add.reduceat(_mix(s ^ _C), first), part[first]
            none = m - len(first)
            if none > e:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), which)[e:]
                sums, which = np.append(sums, np.zeros(len(empty), np.uint64)), np.append(which, empty)
            out.append(_mix(sums * _A + which * _B + np.uint64(level) * _C))
            tags.append(np.full(len(which), level << 24 | max(0, e - none), np.int32))
    return (np.concatenate(out), np.concatenate(tags)) if out else (np.empty(0, np.uint64), np.empty(0, np.int32))


PROFILE = "doc_id long, text_key long, n long, node long, check long, parts array<long>, tags array<int>"


def profiles(docs: DataFrame, t: Threshold, width: int, id_col: str, text_col: str) -> DataFrame:
    """Of each row: its set's size, 128-bit hash (node, check; 0 for an empty set) and parts."""
    ship(docs.sparkSession)

    def run(batches):
        seen: set[tuple] = set()  # sets that this task has cut lately: copies send no parts
        for b in rows_of(batches, 4 << 20):
            sets = shingle_sets(b.column(1).to_pylist(), width)
            with np.errstate(over="ignore"):
                sums = [(_mix(s).sum(dtype=np.uint64), _mix(s ^ _B).sum(dtype=np.uint64)) if len(s) else (np.uint64(0), np.uint64(0)) for s in sets]
            parts, tags = [], []
            for s, pair in zip(sets, sums):
                pair = tuple(map(int, pair))
                new = pair not in seen
                p, g = parts_of(s if new else s[:0], t)
                parts.append(p.view(np.int64))
                tags.append(g)
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(pair)
            ends = pa.array(np.cumsum([0] + [len(p) for p in parts]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (parts, tags)]
            node, check = (np.array([x[i] for x in sums], np.uint64).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(node), pa.array(check), *lists], ["doc_id", "text_key", "n", "node", "check", "parts", "tags"])
        _words.clear()
        release()

    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return part_collisions(materialize(slim.mapInArrow(run, PROFILE), "profiles"))


def part_collisions(profile: DataFrame) -> DataFrame:
    """Nodes that sets of different checks share get numbers of both hashes, so that 128 bits tell sets apart."""
    shared = profile.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b")
    shared = materialize(shared.select(F.col("node").alias("_node")), "shared-nodes")
    if not shared.limit(1).count():
        return profile
    parted = profile.join(_small(shared, 16), F.col("node") == F.col("_node"), "left")
    node = F.when(F.col("_node").isNotNull(), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return materialize(parted.withColumn("node", node).select(*profile.columns), "profiles")


class BlockIndex:
    """Inverted lists of a block's sets, and the T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray], t: Threshold):
        self.sets, self.t = sets, t
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        tokens = tokens[order]
        self.begin = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, np.int64)
        self.tokens, self.owner = tokens[self.begin], owner
        self.length = np.diff(np.append(self.begin, len(tokens)))

    def search(self, x: np.ndarray, skip: np.ndarray) -> list[int]:
        """Sets of the block that link with x, but for those that skip marks; skip may be changed
        meanwhile by whoever takes the answers, so it is asked again before each probe."""
        t, n = self.t, len(x)
        fit = (self.sizes * t.den >= n * t.num) & (self.sizes * t.num <= n * t.den) & ~skip
        if not fit.any():
            return
        need = int(t.overlap(n, int(self.sizes[fit].min())))
        at = np.searchsorted(self.tokens, x)
        at[at == len(self.tokens)] = 0
        hit = self.tokens[at] == x
        if hit.sum() < need:
            return
        lists, own = at[hit], x[hit]
        size = self.length[lists]
        order = np.argsort(size, kind="stable")
        longest = int(size.max())
        apart = min(need - 1, int(need / (0.0085 * np.log2(longest + 1) + 1)))
        short, long_tokens = lists[order[: len(order) - apart]], np.sort(own[order[len(order) - apart :]])
        count = self.length[short]
        where = np.repeat(self.begin[short] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        met = np.bincount(self.owner[where], minlength=len(self.sets))
        for y in np.flatnonzero((met >= need - apart) & fit).tolist():
            if skip[y]:
                continue
            s = self.sets[y]
            place = np.searchsorted(s, long_tokens)
            place[place == len(s)] = 0
            if t.linked(int(met[y]) + int((s[place] == long_tokens).sum()), n, len(s)):
                yield y


class _Union:
    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = self.of[a], self.of[b]
        if x == y:
            return False
        self.of[self.of == y] = x
        return True


def block_links(nodes: np.ndarray, sets: list[np.ndarray], index: np.ndarray, query: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """Links that join the components of a block: pairs of a query and an indexed set."""
    where = np.flatnonzero(index)
    if not len(where):
        return []
    found, block, union = [], BlockIndex([sets[i] for i in where], t), _Union(len(nodes))
    for q in np.flatnonzero(query).tolist():
        skip = union.of[where] == union.of[q]
        for k in block.search(sets[q], skip):
            y = int(where[k])
            if nodes[y] != nodes[q] and union.join(q, y):
                found.append((int(nodes[q]), int(nodes[y])))
                skip |= union.of[where] == union.of[q]
    return found


def search(blocks: DataFrame, t: Threshold) -> DataFrame:
    """Links (a, b) of blocks given as rows (cell, block, node, in_index, in_query, shingles). A task streams its
    blocks one by one."""

    def run(batches):
        key, held = None, []

        def links():
            # a node may come twice: as indexed and as query; each copy is a row of its own
            nodes = np.array([r[0] for r in held])
            sets = [r[3] for r in held]
            return block_links(nodes, sets, np.array([r[1] for r in held]), np.array([r[2] for r in held]), t)

        for b in batches:
            made = []
            cells, parts = b.column(0).to_pylist(), b.column(1).to_pylist()
            col = b.column(5)
            flat, ends = col.values.to_numpy().view(np.uint64), col.offsets.to_numpy()
            rows = zip(cells, parts, b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), ends[:-1].tolist(), ends[1:].tolist())
            for cell, part, node, i, q, lo, hi in rows:
                if (cell, part) != key:
                    made += links() if held else []
                    key, held = (cell, part), []
                held.append((node, i, q, flat[lo:hi].copy()))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)], ["a", "b"])
        made = links() if held else []
        held = []
        release()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = blocks.select("cell", "block", "node", "in_index", "in_query", "shingles").repartition("cell", "block").sortWithinPartitions("cell", "block", "node")
    return rows.mapInArrow(run, "a long, b long")


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def links(docs: DataFrame, profile: DataFrame, t: Threshold, width: int, id_col: str, text_col: str) -> DataFrame:
    """Links between nodes of different sets that span the components."""
    filled = profile.where("n > 0")
    posted = filled.select("node", F.explode(F.arrays_zip("parts", "tags")).alias("x")).select("node", "x.parts", "x.tags").withColumnRenamed("parts", "part").withColumnRenamed("tags", "tag")
    # what is known of a part combines before its shuffle; a part of any number of sets then meets them in a join,
    # which adaptive execution splits
    many = materialize(posted.groupBy("part").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count("*").alias("df")).where("hub <> top").select("part", "df"), "shared-parts")
    met = posted.join(_small(many, 24), "part")
    place = F.dense_rank().over(Window.partitionBy("node", "tag").orderBy(F.desc("df"), "part"))
    kept = met.withColumn("place", place).where(F.col("place") > F.col("tag").bitwiseAND((1 << 24) - 1)).select("node", "part")
    kept = materialize(kept, "rare-parts")
    hubs = kept.groupBy("part").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("part", "hub")
    met = kept.join(_small(materialize(hubs, "part-hubs"), 24), "part")
    met = materialize(met.groupBy("node", "hub").agg(F.count("*").alias("shared")), "shared-parts")
    cells = components(met.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    members = materialize(met.groupBy("node").agg(F.sum("shared").alias("shared")).join(cells.withColumnRenamed("root", "cell"), "node"), "members")
    reps = filled.groupBy("node", "n").agg(F.min(F.struct("doc_id", "text_key")).alias("rep")).select("node", "n", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("text_key"))
    slim, members = members, materialize(members.join(reps, "node"), "cell-members")
    discard(kept, met, slim)

    # the sets of these nodes, from one text of each
    wanted = members.select("node", "cell", "n", "shared", F.col("rep_id").alias("_id"), F.col("text_key").alias("_key"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    picked = keyed.join(_small(wanted, 48), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text", "cell", "n", "shared")

    def shingles(batches):
        for b in rows_of(batches, 4 << 20):
            made = [s.view(np.int64) for s in shingle_sets(b.column(1).to_pylist(), width)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(s) for s in made]), pa.int32()), pa.array(np.concatenate(made)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), lists], ["node", "cell", "n", "shared", "shingles"])
        _words.clear()
        release()

    held = materialize(picked.mapInArrow(shingles, "node long, cell long, n long, shared long, shingles array<long>"), "cell-sets")
    sizes = held.groupBy("cell").agg(F.count("*").alias("nodes"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max(F.struct("shared", "node")).alias("hub"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int"))
    sizes = materialize(sizes.select("cell", "least", F.col("hub.node").alias("hub"), "blocks"), "cells")
    large = materialize(sizes.where("blocks > 1"), "large-cells")
    yes, no = F.lit(True), F.lit(False)
    if not large.limit(1).count():
        return search(held.select("cell", F.lit(0).alias("block"), "node", yes.alias("in_index"), yes.alias("in_query"), "shingles"), t)
    few = _small(large, 32)
    small = held.join(few.select("cell"), "cell", "left_anti").select("cell", F.lit(0).alias("block"), "node", yes.alias("in_index"), yes.alias("in_query"), "shingles")
    big = held.join(few, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    big = materialize(big.select("cell", "block", "blocks", "hub", "least", "node", "n", "shingles"), "large-sets")
    indexed = big.select("cell", "block", "node", yes.alias("in_index"), no.alias("in_query"), "shingles")

    def to_all_blocks(rows: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        return rows.select("cell", every, "node", no.alias("in_index"), yes.alias("in_query"), "shingles")

    by_hub = materialize(search(small.unionByName(indexed).unionByName(to_all_blocks(big.where("node = hub"))), t), "links")
    done = by_hub.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rest = big.where("node <> hub").join(done, "node", "left_anti")
    # shingles that one node of the cell has alone: none of them is the hub's
    hubs = big.where("node = hub").select("cell", F.col("shingles").alias("hub_set"))
    held = big.where("node = hub").agg(F.sum("n")).first()[0] * 8
    apart = big.join(F.broadcast(hubs) if held <= BROADCAST_BYTES else hubs, "cell").select("cell", "blocks", "node", F.array_except("shingles", "hub_set").alias("apart"))
    alone = alone_in_cell(apart)
    partner = F.greatest(F.ceil(F.col("n") * t.num / F.lit(float(t.den))), F.col("least"))
    need = F.ceil((F.col("n") + partner) * t.num / F.lit(float(t.num + t.den)))
    rest = rest.join(alone, "node", "left").where(F.col("n") - F.coalesce("alone", F.lit(0)) >= need)
    rest = materialize(rest.select("cell", "blocks", "node", "shingles"), "large-queries")
    if not rest.limit(1).count():
        return by_hub
    # queries in chunks, so that a block stays bounded whatever their number
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    chunks = rest.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("chunks"))
    asked = to_all_blocks(rest).join(chunks, "cell").withColumn("chunk", chunk)
    answering = indexed.join(chunks, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    both = asked.unionByName(answering).withColumn("block", F.col("chunk") * F.lit(1 << 16) + F.col("block")).drop("chunk", "chunks")
    return by_hub.unionByName(search(both, t))


def alone_in_cell(sets: DataFrame) -> DataFrame:
    """(node, alone): how many of each node's shingles no other node of its cell has, of rows (cell, blocks, node, shingles).

    Each shingle of a node is sent once, packed in one row for each batch, cell and range of hashes, of which a cell has as many as
    it has blocks; a task counts one range at a time."""

    def pack(batches):
        for b in batches:
            size = pc.list_value_length(b.column(3)).to_numpy()
            s = b.column(3).flatten().to_numpy().view(np.uint64)
            if not len(s):
                continue
            cell, blocks, node = (np.repeat(b.column(k).to_numpy(), size) for k in range(3))
            part = ((s >> np.uint64(32)) * blocks.astype(np.uint64) >> np.uint64(32)).astype(np.int32)
            order = np.lexsort((part, cell))
            cell, part, node, s = cell[order], part[order], node[order], s[order].view(np.int64)
            first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])))
            ends = pa.array(np.append(first, len(s)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array(part[first]), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (node, s))], ["cell", "part", "nodes", "shingles"])
        release()

    def count(batches):
        key, held = None, []

        def counted():
            node, s = (np.concatenate(x) for x in zip(*held))
            _, at, times = np.unique(s, return_index=True, return_counts=True)
            node, alone = np.unique(node[at[times == 1]], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(alone.astype(np.int64))], ["node", "alone"])

        for b in batches:
            for i, now in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if now != key:
                    if held:
                        yield counted()
                    key, held = now, []
                held.append(tuple(b.column(k)[i].values.to_numpy() for k in (2, 3)))
        if held:
            yield counted()
        release()

    packed = sets.mapInArrow(pack, "cell long, part int, nodes array<long>, shingles array<long>")
    each = packed.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(count, "node long, alone long")
    return each.groupBy("node").agg(F.sum("alone").alias("alone"))


def rooted_rows(docs: DataFrame, threshold: tuple[int, int], width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n, root) of every row; root: the least node of its component, NULL for an empty set."""
    t = Threshold(*threshold)
    profile = profiles(docs, t, width, id_col, text_col)
    roots = components(materialize(links(docs, profile, t, width, id_col, text_col), "links"))
    rows = profile.select("doc_id", "text_key", "n", "node").join(roots, "node", "left")
    return materialize(rows.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root")), "rooted")


def jaccard_classes(docs: DataFrame, threshold: tuple[int, int] = (9, 10), width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row, component_id being the smallest doc_id that links reach.

    Null text is empty; an empty set links with nothing, and its row is its own class. Equal sets
    link at any size. Null ids never name a class that has another id; repeated rows are equal sets;
    texts of any length are taken whole; other columns are ignored; an empty table gives an empty one. Sets
    are told apart by 128 bits of hashes of their shingles, shingles by 64.
    """
    rows = rooted_rows(docs, threshold, width, id_col, text_col)
    least = materialize(rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    some = rows.where("root IS NOT NULL").join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(rows.where("root IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, threshold: tuple[int, int] = (4, 5), width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns: of each component the one of smallest id, then of the
    least text hash; null ids come last. Rows that repeat its id and text are the same document and stay too;
    rows without words all stay."""
    rows = rooted_rows(docs, threshold, width, id_col, text_col).where("root IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    groups = rows.groupBy("root").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last")
    groups = materialize(groups.select("root", "first"), "near-groups")
    gone = rows.join(groups, "root").where(order != F.col("first")).select(F.col("doc_id").alias("__near_id"), F.col("text_key").alias("__near_key")).distinct()
    gone = materialize(gone, "near-copies")
    key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    on = (key == F.col("__near_key")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__near_id"))
    return docs.join(_small(gone, 32), on, "left_anti")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o >= 90 * (x.n + y.n - o)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""
