"""Operators 2, 4, 5, 6 and 9 against brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import components as cc
from tideline.llm import decontamination as dc
from tideline.llm import exact_dedup as ex
from tideline.llm import jaccard_join as jj
from tideline.llm import line_dedup as ld
from tideline.llm import sharding as sh
from tideline.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


# --- exact dedup ------------------------------------------------------------------------------


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup(make, edge_rows):
    rows = [*edge_rows, *[(1000 + i, "same  text" + " " * (i % 3)) for i in range(50)], (None, "same text   ")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[squeeze(t)].append((i, len(t or "")))
    want = []
    for text, members in groups.items():
        cp = max(n for _, n in members)
        keep = min((i for i, n in members if n == cp), key=lambda i: (i is None, i or 0))
        want += [(i, keep, len(members), i == keep and n == cp, hashlib.sha256(text.encode()).hexdigest()) for i, n in members]
    got = [tuple(r) for r in ex.exact_dedup(make(rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = ex.keep_first(make(rows))
    assert kept.count() == len(groups) and kept.columns == make(rows).columns
    assert sorted(squeeze(r["text"]) for r in kept.collect()) == sorted(groups)


def test_exact_dedup_of_nothing(make):
    assert ex.exact_dedup(make([(1, "a")]).limit(0)).count() == 0 and ex.keep_first(make([(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 3])
def test_quotient_filter_is_lossless(bits):
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 2**64, 500, np.uint64, endpoint=False))
    segment = 5 if bits else 0
    if bits:
        fps = np.unique(fps >> np.uint64(bits) | np.uint64(segment << (64 - bits)))
    counts = rng.integers(1, 4, len(fps))
    counts[::50] = 10**12
    for q in (3, 6, 10):
        f = ex.QuotientFilter.build(fps, counts, bits, q)
        a, b = f.decode(segment)
        assert (a == fps).all() and (b == counts).all()
    a, b = ex.merge_sorted([(fps, counts), (fps[::2], counts[::2])])
    assert (a == fps).all() and b[0] == 2 * counts[0] and b[1] == counts[1]


# --- n-gram Jaccard join ----------------------------------------------------------------------------


def brute_sets(texts, width):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(lower)) if x]
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute_classes(rows, num, den, width):
    sets, root = brute_sets([t for _, t in rows], width), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None) if sets[i] else rows[i][0]) for i in range(len(rows))]


def varied(prose, n, seed):
    """Groups of near copies at all distances around the threshold, of many sizes."""
    rng, rows = random.Random(seed), []
    for g in range(n):
        base = prose(rng.choice([1, 2, 3, 5, 11, 12, 20, 40, 80, 200, 400]), (seed, g).__hash__()).split()
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(w) // 60, len(w) // 40, len(w) // 25])):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([["new" + str(rng.random())], [], [w[k], "in" + str(rng.random())]])
                w = w or ["x"]
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(w)))
    return rows


@pytest.mark.parametrize(("num", "den", "width"), [(9, 10, 3), (4, 5, 5)])
def test_jaccard_classes(make, prose, edge_rows, num, den, width):
    rows = [*edge_rows, *[(100 + i, t) for i, t in varied(prose, 60, num)]]
    got = [tuple(r) for r in jj.jaccard_classes(make(rows), (num, den), width).collect()]
    want = brute_classes(rows, num, den, width)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len({w[2] for w in want}) < len(want) - 20


def test_large_cells_are_searched_whole(make, prose, monkeypatch):
    """Cells beyond a block, with nodes that do not link with the cell's hub but with one another."""
    monkeypatch.setattr(jj, "BLOCK_NODES", 8)
    rng, rows = random.Random(1), []
    base = prose(300, 77).split()
    for k in range(70):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 5, 6, 8, 12])):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        rows.append((k, " ".join(w)))
        if k % 5 == 0:
            w[rng.randrange(len(w))] = "twin"
            rows.append((1000 + k, " ".join(w)))
    got = sorted(tuple(r) for r in jj.jaccard_classes(make(rows)).collect())
    want = sorted(brute_classes(rows, 9, 10, 3))
    assert got == want
    assert 3 < len({w[2] for w in want}) < 60


def test_keep_one(make, prose):
    rows = [(i, t) for i, t in varied(prose, 25, 8)] + [(None, "lonely text without an identifier"), (500, None), (501, "")]
    classes = {i: c for i, _, c in brute_classes(rows, 4, 5, 5)}
    want = {i for i, c in classes.items() if i is not None and i == c}
    got = jj.keep_one(make(rows).withColumnRenamed("fp", "_key").withColumnRenamed("node", "_id"))
    ids = [r["doc_id"] for r in got.collect()]
    assert set(ids) - {None} == want and len(ids) == len(set(ids)) and None in ids
    assert jj.keep_one(make(rows).limit(0)).count() == 0


@pytest.mark.parametrize("task_edges", [0, 1000])
def test_components(spark, monkeypatch, task_edges):
    monkeypatch.setattr(cc, "TASK_EDGES", task_edges)
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}
    for a, b in edges:
        ra, rb = root.setdefault(a, a), root.setdefault(b, b)
        if ra != rb:
            root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    got = dict(tuple(r) for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect())
    alone = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in root.items() if k not in alone}


def test_shingles_alone_in_their_cell(spark):
    rng = random.Random(3)
    rows = [(c, b, 100 * c + k, sorted({rng.randrange(-(1 << 63), 1 << 63) if rng.random() < 0.5 else (1 << 40) * rng.randrange(-40, 40) for _ in range(rng.randint(0, 30))})) for c, b in ((1, 1), (2, 7)) for k in range(25)]
    got = {r["node"]: r["alone"] for r in jj.alone_in_cell(spark.createDataFrame(rows, "cell long, blocks int, node long, shingles array<long>").repartition(5)).collect()}
    for c, _, node, own in rows:
        others = {x for d, _, other, s in rows if d == c and other != node for x in s}
        assert got.get(node, 0) == len(set(own) - others)


def test_sets_of_one_node_are_parted(spark, make):
    """Forced collisions of the first hash: the second tells the sets apart, equal sets stay one node."""
    rows = [(1, 5, 7), (2, 5, 8), (3, 5, 7), (4, 6, 9), (5, 0, 0)]
    df = spark.createDataFrame([(i, i, 3, n, c, [n], [0]) for i, n, c in rows], jj.PROFILE)
    got = {r["doc_id"]: r["node"] for r in jj.part_collisions(df).collect()}
    assert got[1] == got[3] != got[2] and got[4] == 6 and got[5] == 0


# --- line dedup -----------------------------------------------------------------------------------------


def brute_lines(rows, window, long_words=50):
    """Windows of lines, and single lines of many words; in order of id and line, a null id first."""
    docs = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        bare = [re.sub(r"^[ \t\x0b\f\r]+|[ \t\x0b\f\r]+$", "", x) for x in lines]
        docs[(i, t)] = (lines, [k for k, x in enumerate(bare) if x], [x for x in bare if x])
    seen, gone = {}, defaultdict(set)
    for key in sorted(docs, key=lambda k: (k[0] is not None, k[0] or 0, str(k[1]))):
        b = docs[key][2]
        for at in range(max(1, len(b) - window + 1) if b else 0):
            w = tuple(b[at : at + window])
            if w in seen:
                gone[key] |= set(range(at, min(at + window, len(b))))
            else:
                seen[w] = key
        for at in range(len(b) if len(b) > 1 and window > 1 else 0):
            if len(re.findall(r"[^ \t\x0b\f\r]+", b[at])) >= long_words:
                if (b[at],) in seen:
                    gone[key].add(at)
                else:
                    seen[(b[at],)] = key
    out = []
    for i, t in rows:
        lines, places, b = docs[(i, t)]
        drop = {places[k] for k in gone[(i, t)]}
        out.append((i, len(b), len(drop), "\n".join(x for k, x in enumerate(lines) if k not in drop)))
    return out


@pytest.mark.parametrize("window", [1, 2, 3])
def test_line_dedup(make, edge_rows, window):
    rng = random.Random(window)
    pool = [f"line {k} " for k in range(14)]
    rows = [r for r in edge_rows] + [(100 + i, "\n".join(rng.choice([*pool, "", " "]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    got = [tuple(r) for r in ld.line_dedup(make(rows), window).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows, window)))


@pytest.mark.parametrize("window", [1, 2, 3])
def test_long_lines_are_found_between_any_neighbours(make, window):
    """A line of five words or more is a window by itself: alone in a text, between other lines, twice in one text; shorter ones are not."""
    long = ["one two three four five", "a  b\tc d e f", "one two three four"]
    rows = [(3, f"x\n{long[0]}\ny"), (1, long[0]), (2, f" {long[1]}\r\nz"), (4, f"q\n{long[1]}"), (5, long[1]), (6, f"u\n{long[0]}\nv\n{long[0]}"), (7, f"k\n{long[2]}"), (8, f"{long[2]}\nl"), (9, long[2])]
    got = [tuple(r) for r in ld.line_dedup(make(rows), window, long_words=5).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows, window, 5)))
    if window == 2:
        assert {r[0]: r[2] for r in got} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2, 7: 0, 8: 0, 9: 0}


def test_windows_of_one_hash_are_told_apart(make, monkeypatch):
    """Lines whose first hashes are all equal: the second hash decides."""
    monkeypatch.setattr(ld, "_hashes", lambda x: (F.length(x).cast("long") * 0, F.xxhash64(F.lit(1), x)))
    rows = [(1, "a\nb\nc"), (2, "d\ne\nf"), (3, "q\nb\nc"), (4, "a\nb")]
    assert ld.windows(make(rows), 2, "doc_id", "text").select("match").distinct().count() == 1
    got = [tuple(r) for r in ld.line_dedup(make(rows), 2).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows, 2)))


def test_line_runs_and_nulls(make):
    text = "a\nb\nc\nd\ne"
    rows = [(1, text), (2, "x\n" + text + "\ny"), (3, None), (None, "q\nr\ns"), (None, None)]
    runs = [tuple(r) for r in ld.runs(make(rows), 3).collect()]
    assert runs == [(2, 1, 5, 1, 0)]
    assert sorted(r["n_removed"] for r in ld.line_dedup(make(rows), 3).collect()) == [0, 0, 0, 0, 5]
    assert ld.line_dedup(make(rows).limit(0)).count() == 0


def test_windows_are_sent_once_and_alike_at_any_size(make, monkeypatch):
    """No join changes its kind with the tables' size, and all windows are read for one of them alone."""
    plans, write = [], ld.materialize
    plan = lambda df: (df._jdf.queryExecution().executedPlan().toString(), any("line-windows" in f for f in df.inputFiles()))
    monkeypatch.setattr(ld, "materialize", lambda df, name: plans.append(plan(df)) or write(df, name))
    found = ld.repeats(make([(1, "a\nb\nc"), (2, "x\na\nb\nc")]))
    plans.append(plan(found))
    assert not [p for p, _ in plans if "Broadcast" in p]
    assert sum(reads and "Join" in p for p, reads in plans) == 1
    assert sorted(r["at"] for r in found.collect()) == [1, 2]


# --- sharding -----------------------------------------------------------------------------------------------


def python_shard(doc_id, tree):
    def draw(leaf):
        seed = 42
        if doc_id is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed)
        seed = xxhash.xxh64_intdigest(struct.pack("<q", leaf.shard), seed)
        return -np.log(((seed >> 11) + 0.5) / 2**53) / leaf.weight

    leaves = [x for x in tree if x.weight > 0]
    for name in ("region", "rack", "shard"):
        best = min(leaves, key=lambda x: (draw(x), x.shard))
        leaves = [x for x in leaves if getattr(x, name) == getattr(best, name)]
    return leaves[0].shard


def test_sharding(make, edge_rows):
    rows = [*edge_rows, *[(k, "t" * (k % 7)) for k in range(20, 2500)]]
    tree, grown = sh.regular_tree(8), sh.regular_tree(9)
    got = sh.assign(make(rows), tree, grown, bucket_rows=50).collect()
    assert len(got) == len(rows)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        assert r["shard"] == python_shard(r["doc_id"], tree) and r["grown_shard"] == python_shard(r["doc_id"], grown)
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len(sizes) == 8 and max(sizes.values()) < 1.4 * min(sizes.values())
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert sh.assign(make(rows).limit(0), tree).count() == 0


def test_weights_move_rows_within_their_subtree(make):
    rows = [(k, "") for k in range(4000)]
    tree = sh.regular_tree(8)
    heavier = [sh.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in tree]
    gone = [sh.Leaf(x.region, x.rack, x.shard, 0.0 if x.shard == 5 else 1.0) for x in tree]
    got = sh.assign(make(rows), tree, heavier).collect()
    assert {r["grown_shard"] for r in got if r["shard"] != r["grown_shard"]} == {5}
    assert 0.18 < np.mean([r["grown_shard"] == 5 for r in got]) < 0.27  # two of nine
    for r in sh.assign(make(rows), tree, gone).collect():
        assert r["shard"] == r["grown_shard"] if r["shard"] != 5 else r["grown_shard"] != 5


def test_each_further_shard_takes_rows_only_into_itself(spark):
    """Law `key`, at every number of shards; shares stay in proportion."""
    ids = spark.range(6000)
    got = ids.select(*[sh.descend(F.col("id"), sh.regular_tree(n)).alias(str(n)) for n in range(1, 18)]).toPandas()
    for n in range(1, 17):
        moved = got[str(n)] != got[str(n + 1)]
        assert (got[str(n + 1)][moved] == n).all() and moved.any()
        assert got[str(n + 1)].value_counts().min() > 0.75 * 6000 / (n + 1)


# --- benchmark decontamination ---------------------------------------------------------------------------------


def brute_leaks(items, text, similarity=0.8):
    words = dc.words_of(text)
    out = set()
    for k, t in items:
        q, a = dc.question_and_answer(t or "")
        qw, aw = dc.words_of(q), dc.words_of(a)
        own = dc.shingles(qw or aw)
        if not own:
            continue
        n = len(next(iter(own)))
        have = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        answered = not (qw and aw) or len(set(aw) & set(words)) / len(set(aw)) >= similarity - 1e-9
        if len(own & have) / len(own) >= similarity - 1e-9 and answered:
            out.add(k)
    return out


def test_decontamination(spark, make, prose, edge_rows):
    rng = random.Random(12)
    items = [(k, prose(rng.choice([3, 6, 12, 30, 50]), 900 + k)) for k in range(120)] + [(500, None), (501, ""), (502, "What is the colour of the clear sky? It is blue today")]
    rows = list(edge_rows)
    for i in range(150):
        t = prose(rng.randint(20, 300), 5000 + i).split()
        if i % 3 == 0:
            w = (items[rng.randrange(120)][1] or "").split()
            if i % 2:
                w[rng.randrange(len(w))] = "changed"
            at = rng.randrange(len(t))
            t[at:at] = [x.upper() if i % 4 else x for x in w]
        rows.append((200 + i, " ".join(t)))
    rows += [(900, "say what is the colour of the clear sky? today it is blue"), (901, "say what is the colour of the clear sky?")]
    index = dc.build(spark.createDataFrame(items, "item_id long, text string"), block_items=50)
    assert len(index) == 3
    got = defaultdict(set)
    for r in dc.contaminated(make(rows), index).collect():
        got[r["doc_id"]].add(r["item_id"])
    want = {i: x for i, t in rows if (x := brute_leaks(items, t))}
    assert dict(got) == want and 900 in want and 901 not in want and len(want) > 30
    clean = dc.keep_clean(make(rows), index)
    assert clean.columns == make(rows).columns
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(i) for i, _ in rows if i not in want)


def test_wand_finds_what_a_scan_finds(prose):
    items = [(k, prose(random.Random(k).randint(4, 40), k), None) for k in range(200)]
    index = dc.Index(items, block=4)
    for s in range(60):
        words = {index.vocabulary.get(w, 0) for w in (prose(30, 3000 + s) + " " + items[s][1]).split()}
        scan = defaultdict(float)
        for w in words - {0}:
            for i, x in zip(index.items_of[w].tolist(), index.impacts_of[w].tolist()):
                scan[i] += x
        assert {i for i, _ in index.search(words)} == {i for i, x in scan.items() if x >= 1 - 1e-6}


def test_no_benchmark(spark, make):
    empty = dc.build(spark.createDataFrame([], "item_id long, text string"))
    assert dc.contaminated(make([(1, "a b c d e f")]), empty).count() == 0
    assert dc.keep_clean(make([(1, "a b c d e f"), (None, None)]), empty).count() == 2
    assert dc.contaminated(make([(1, "a")]).limit(0), empty).count() == 0


def test_screen_against_brute_force(monkeypatch):
    """The screen's sums, in runs of a few pairs, against a dense table of passages and items; items of common words too."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    index = dc.Index([(k, " ".join(rng.choice(words[: 300 if k % 3 else 40]) for _ in range(rng.randint(1, 20))), None) for k in range(150)])
    index.always = False
    of = np.array([rng.randrange(40) for _ in range(3000)])
    numbers = np.array([rng.randrange(0, len(index.vocabulary) + 1) for _ in of])
    reach = np.zeros((40, len(index.ids)))
    for p, w in zip(of, numbers):
        for k in range(index.rare_begin[w], index.rare_begin[w] + index.rare_count[w]):
            reach[p, index.rare_items[k]] += index.rare_share[k]
    want = np.flatnonzero((reach >= 1 - 1e-6).any(axis=1)).tolist()
    for pairs in (1, 50, 1 << 20):
        monkeypatch.setattr(dc, "PAIRS", pairs)
        assert index.screen(of, numbers, 40).tolist() == want and want
    assert not len(index.screen(np.empty(0, np.int64), np.empty(0, np.int64), 0))
