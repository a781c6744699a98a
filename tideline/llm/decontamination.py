"""Operator 9, benchmark decontamination: a BM25 inverted index of test items, searched with block-max
WAND by every passage of every training text; what it retrieves is verified on words in order.

Items are the indexed documents, a passage is the query (each of its distinct words counts once):

    score(passage, item) = sum over shared words of idf(word) * tf (k1 + 1) / (tf + k1 (1 - b + b len / mean len))

An item is verified when at least `similarity` of its five-word shingles stand in the passage. If all
but u of an item's n shingles do, at most u of its words' places are uncovered, so the passage keeps at
least the item's full score less its u greatest word impacts: that is the item's threshold, and
no verified match can score below it. Impacts are divided by the item's threshold, so that all
items are searched for with the one threshold 1. Passages overlap by half and are twice as long as
the longest item, so a match lies whole in one of them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, release, rows_of, ship, table

_WORD = re.compile(r"\w+")
EPS = 1e-9
#: Pairs of passage and item that a screen sums at once.
PAIRS = 1 << 20


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list, n: int = 5) -> set[tuple]:
    """Distinct n-word shingles; a shorter sequence is one; no words, none."""
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def question_and_answer(text: str) -> tuple[str, str]:
    """Up to the last question mark, and what follows it; without one, all is the question."""
    head, mark, tail = text.rpartition("?")
    return (head + mark, tail) if mark else (text, "")


class Index:
    """Postings of each word in blocks of ascending item numbers, with the greatest impact of each block."""

    def __init__(self, items: list[tuple[int, str, str | None]], similarity: float = 0.8, block: int = 32, k1: float = 1.2, b: float = 0.75, shingle: int = 5):
        """items: (identifier, text, answer or None). Items without words are left out: nothing matches them."""
        self.similarity, self.shingle = similarity, shingle
        self.ids, self.question, self.answer, docs = [], [], [], []
        for item, text, answer in items:
            q, a = (text, answer) if answer else question_and_answer(text or "")
            words = words_of(q) + words_of(a)
            if words:
                self.ids.append(item)
                self.question.append(words_of(q))
                self.answer.append(words_of(a))
                docs.append(words)
        self.longest = max((len(w) for w in docs), default=0)
        df = Counter(w for d in docs for w in set(d))
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted(df))}  # 0: not in any item
        mean = sum(map(len, docs)) / max(1, len(docs))
        postings: dict[int, list[tuple[int, float]]] = {}
        for i, d in enumerate(docs):
            impact = {w: math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean)) for w, tf in Counter(d).items()}
            full = sum(impact.values())
            # a verified match covers the required share of the question's shingles; the answer may be elsewhere
            q = self.question[i] or d
            miss = math.floor((1 - similarity) * max(1, len(q) - shingle + 1) + EPS)
            lost = sorted((impact[w] for w in q), reverse=True)[:miss] + [impact[w] for w in set(self.answer[i]) - set(q)]
            threshold = max(full - sum(lost), EPS)
            for w, x in impact.items():
                postings.setdefault(self.vocabulary[w], []).append((i, x / threshold))
        self.items_of = {w: np.array([i for i, _ in p], np.int64) for w, p in postings.items()}
        self.impacts_of = {w: np.array([x for _, x in p]) for w, p in postings.items()}
        self.blocks = {w: [(p[k : k + block][-1][0], max(x for _, x in p[k : k + block])) for k in range(0, len(p), block)] for w, p in postings.items()}
        self.lasts = {w: [last for last, _ in bl] for w, bl in self.blocks.items()}
        self.greatest = {w: max(x for _, x in bl) for w, bl in self.blocks.items()}
        self.numbers = [[self.vocabulary[w] for w in q + a] for q, a in zip(self.question, self.answer)]
        self._screens()

    def _screens(self) -> None:
        """For screening passages before the search: words in many items are taken as present, at
        their impact; an item needs the rest of its threshold from its rarer words."""
        n, size = len(self.ids), len(self.vocabulary) + 1
        common = [w for w, p in self.items_of.items() if len(p) * 20 > n + 20]
        need = np.ones(n)
        for w in common:
            need[self.items_of[w]] -= self.impacts_of[w]
        rare = [w for w in self.items_of if w not in set(common)]
        count = np.zeros(size, np.int64)
        for w in rare:
            count[w] = len(self.items_of[w])
        self.rare_begin = np.cumsum(count) - count
        self.rare_count = count
        self.rare_items, self.rare_share = np.zeros(count.sum(), np.int64), np.zeros(count.sum())
        for w in rare:
            a = self.rare_begin[w]
            self.rare_items[a : a + count[w]] = self.items_of[w]
            # share of what the item still needs; an item that common words alone may reach passes by any word
            self.rare_share[a : a + count[w]] = self.impacts_of[w] / np.maximum(need[self.items_of[w]], EPS)
        self.always = bool((need <= EPS).any())

    def screen(self, of: np.ndarray, words: np.ndarray, passages: int) -> np.ndarray:
        """Passages that may reach an item. of, words: passage and number of each word met (0: none);
        a word counts as often as it is met, which only raises the bound."""
        if self.always:
            return np.arange(passages)
        n = self.rare_count[words]
        some = np.flatnonzero(n)
        some = some[np.argsort(of[some], kind="stable")]
        of, words, n = of[some], words[some], n[some]
        # pairs of passage and item are summed in runs of whole passages, so that memory follows the pairs met and not
        # passages times items
        ends, out, at = np.cumsum(n), [np.empty(0, np.int64)], 0
        last = np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(of) else np.empty(0, np.int64)
        while at < len(of):
            past = ends[at - 1] if at else 0
            within = last[(last >= at) & (ends[last] <= past + PAIRS)]
            to = int(within[-1] if len(within) else last[last >= at][0]) + 1
            m, first = n[at:to], self.rare_begin[words[at:to]]
            total = int(m.sum())
            where = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(total)
            pair = np.repeat(of[at:to], m) * len(self.ids) + self.rare_items[where]
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            reach = np.add.reduceat(self.rare_share[where][order], begin)
            out.append(np.unique(pair[begin[reach >= 1 - 1e-6]] // len(self.ids)))
            at = to
        return np.concatenate(out)

    def search(self, words: set[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose normalised score reaches 1."""
        lists = [[0, w, self.items_of[w].tolist(), self.impacts_of[w].tolist()] for w in words if w]
        found = []
        limit = 1 - 1e-6
        while lists:
            lists.sort(key=lambda x: x[2][x[0]])
            bound, pivot = 0.0, None
            for k, x in enumerate(lists):
                bound += self.greatest[x[1]]
                if bound >= limit:
                    pivot = k
                    break
            if pivot is None:
                break
            item = lists[pivot][2][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][2][lists[pivot + 1][0]] == item:
                pivot += 1
            # the blocks that would hold the item
            bound, until = 0.0, None
            for x in lists[: pivot + 1]:
                k = bisect_left(self.lasts[x[1]], item)
                if k < len(self.blocks[x[1]]):
                    last, most = self.blocks[x[1]][k]
                    bound += most
                    until = last if until is None else min(until, last)
            if bound < limit:
                # nothing up to the end of the nearest block, or the next list's item, can reach it
                to = (until if until is not None else item) + 1
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][2][lists[pivot + 1][0]])
                to = max(to, item + 1)
                moved = lists[: pivot + 1]
            elif lists[0][2][lists[0][0]] == item:
                score = sum(x[3][x[0]] for x in lists[: pivot + 1])
                if score >= limit:
                    found.append((item, score))
                to, moved = item + 1, lists[: pivot + 1]
            else:
                to, moved = item, lists[:pivot]
            for x in moved:
                if x[2][x[0]] < to:
                    x[0] = bisect_left(x[2], to, x[0])
            lists = [x for x in lists if x[0] < len(x[2])]
        return found

    def verify(self, item: int, passage: list[int], seen: set[tuple], doc_words: set[int]) -> tuple[float, float] | None:
        """(question overlap, answer overlap) if the question's shingles stand in the passage, and the
        answer's words, where there is one, in the text."""
        n = len(self.question[item])
        q, a = self.numbers[item][:n], self.numbers[item][n:]
        own = shingles(q or a, self.shingle)
        if len(q or a) < self.shingle:
            k = len(q or a)
            seen = {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}
        question = len(own & seen) / len(own)
        answer = len(set(a) & doc_words) / len(set(a)) if q and a else 1.0
        return (question, answer) if question >= self.similarity - EPS and answer >= self.similarity - EPS else None

    def leaks(self, texts: list[list[int]]) -> list[dict[int, tuple]]:
        """For each text, given as word numbers: item -> (score, first word of the passage, question, answer overlap)."""
        step = max(self.longest, self.shingle)
        texts = [np.asarray(t, np.int64) for t in texts]
        # blocks of step words; a passage is two neighbouring ones
        blocks = [max(1, -(-len(t) // step)) for t in texts]
        passages = [max(1, b - 1) for b in blocks]
        base = np.cumsum(passages) - passages
        of, words = [], []
        for t, b, p, first in zip(texts, blocks, passages, base):
            where = np.flatnonzero(t)
            block = where // step
            for shift in (0, 1):
                k = block - shift
                ok = (k >= 0) & (k < p)
                of.append(first + k[ok])
                words.append(t[where[ok]])
        found: list[dict[int, tuple]] = [{} for _ in texts]
        if not of or not self.ids:
            return found
        owner = np.repeat(np.arange(len(texts)), passages)
        for p in self.screen(np.concatenate(of), np.concatenate(words), int(sum(passages))).tolist():
            i = int(owner[p])
            begin = int(p - base[i]) * step
            passage = texts[i][begin : begin + 2 * step].tolist()
            hits = self.search(set(passage))
            if hits:
                seen, all_words = shingles(passage, self.shingle), set(texts[i].tolist())
                for item, score in hits:
                    ok = self.verify(item, passage, seen, all_words)
                    if ok and (item not in found[i] or score > found[i][item][0]):
                        found[i][item] = (score, begin, *ok)
        return found


def build(benchmark: DataFrame, similarity: float = 0.8, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None, block_items: int = 20_000) -> list[Index]:
    """Indexes of the test items, in blocks of at most block_items, so that each has a bounded size
    to broadcast whatever the benchmark's. Items are a stated query set; null texts match nothing."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), answer.alias("a")).where(F.col("t").isNotNull())
    out, part = [], []
    for r in rows.orderBy("i", "t").toLocalIterator():
        part.append((r["i"], r["t"], r["a"]))
        if len(part) == block_items:
            out.append(Index(part, similarity))
            part = []
    return out + ([Index(part, similarity)] if part or not out else [])


def _numbers(index: Index):
    get = index.vocabulary.get
    return lambda text: [get(w, 0) for w in _WORD.findall(text.lower())] if text else []


HITS = "doc_id long, item_id long, score double, first_word long, question_overlap double, answer_overlap double"


#: Blocks of items that one scan of the documents tries: what a worker holds at most.
BLOCKS_A_SCAN = 4


def contaminated(docs: DataFrame, indexes: list[Index], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and test item it holds: the passage of greatest normalised score.

    Null and empty texts hold nothing; null ids are kept; repeated rows answer each; texts of any length are searched
    whole, passage by passage; other columns are ignored; without items or rows the result is empty. No
    shuffle: indexes are broadcast and meet every passage once, up to BLOCKS_A_SCAN blocks of items in a scan."""
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run_with(sent):
        def run(batches):
            for b in rows_of(batches, 2 << 20):
                rows, ids, texts = [], b.column(0).to_pylist(), b.column(1).to_pylist()
                for index in (x.value for x in sent):
                    number = _numbers(index)
                    for doc, hits in zip(ids, index.leaks([number(t) for t in texts])):
                        rows += [(doc, index.ids[k], s, w, q, a) for k, (s, w, q, a) in sorted(hits.items())]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [f.split()[0] for f in HITS.split(", ")])
            release()

        return run

    sent = [spark.sparkContext.broadcast(x) for x in indexes]
    out = [slim.mapInArrow(run_with(sent[i : i + BLOCKS_A_SCAN]), HITS) for i in range(0, len(sent), BLOCKS_A_SCAN)]
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def keep_clean(docs: DataFrame, indexes: list[Index], text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no test item, with their columns; one pass, no join. Rows of null or empty text
    and null ids stay, as do repeated rows; texts of any length are searched whole; an empty table stays empty."""
    spark = docs.sparkSession
    ship(spark)
    names = docs.columns
    sent = [spark.sparkContext.broadcast(x) for x in indexes]

    def run(batches):
        at = names.index(text_col)
        for b in rows_of(batches, 2 << 20, at):
            for index in (x.value for x in sent):
                number = _numbers(index)
                b = b.filter(pa.array([not x for x in index.leaks([number(t) for t in b.column(at).to_pylist()])], pa.bool_()))
            yield b
        release()

    return docs.mapInArrow(run, docs.schema)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), build(table(spark, sf_dir, "benchmark")))
