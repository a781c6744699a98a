"""Operator 7, language identification: interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lower-cased, each run of other characters than letters becomes one space, and a text begins
after three marks. A model of order 4 is kept for each language:

    P4(c | abx) = (n(abxc) - D4)+ / n(abx.) + D4 N1+(abx.) / n(abx.) * P3(c | bx)

where P3 and P2 are alike over continuation counts (in how many left contexts a gram occurs), and P1
is the share of continuation counts mixed with a uniform one. D = n1 / (n1 + 2 n2). The language of
least mean -log2 P over the text's characters is predicted; its confidence is a softmax of these
means at a temperature, and a limit on the mean itself flags texts like none of the languages.

Counts, continuation counts and discounts are taken over all grams, and no gram is dropped: tables of
any size are sorted files in the shared folder, of which a lookup maps the blocks it needs.
"""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, release, rows_of, scratch, ship
from .token_tables import _attempt, _fs

ORDER = 4
_OTHER = re.compile(r"[\W\d_]+")
_MARK = "\x02" * (ORDER - 1)


def letters(text: str | None) -> str:
    """Lower-case letters with single spaces; empty if there is no letter."""
    s = _OTHER.sub(" ", text.lower()) if text else ""
    return s if any(map(str.isalpha, s)) else ""


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The order-4 gram that ends at each character, four 16-bit units in one number, and the characters of each text."""
    units = np.frombuffer("".join(_MARK + t for t in texts).encode("utf-16-le"), np.uint16)
    n = np.array([len(t) if t.isascii() else len(t.encode("utf-16-le")) // 2 for t in texts], np.int64)
    u = units.astype(np.uint64)
    keys = (u[:-3] << np.uint64(48)) | (u[1:-2] << np.uint64(32)) | (u[2:-1] << np.uint64(16)) | u[3:] if len(u) > 3 else np.empty(0, np.uint64)
    begin = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
    keep = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return keys[keep], n


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with counts. Where the units are of few kinds, as in most languages, the grams are
    counted in a table of all possible ones, which spares the sort."""
    if len(keys) < 1 << 16:
        return np.unique(keys, return_counts=True)
    kinds = np.unique((keys & np.uint64(0xFFFF)).astype(np.uint16))
    kinds = np.union1d(kinds, np.array([2], np.uint16))
    if len(kinds) > 64:
        return np.unique(keys, return_counts=True)
    code = np.zeros(1 << 16, np.int32)
    code[kinds] = np.arange(len(kinds))
    flat = np.zeros(len(keys), np.int32)
    for shift in (48, 32, 16, 0):
        flat = flat * len(kinds) + code[((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)]
    counts = np.bincount(flat, minlength=1)
    some = np.flatnonzero(counts)
    out, rest = np.zeros(len(some), np.uint64), some.copy()
    for shift in (0, 16, 32, 48):
        out |= kinds[rest % len(kinds)].astype(np.uint64) << np.uint64(shift)
        rest //= len(kinds)
    return out, counts[some]


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, wanted), max(0, len(sorted_keys) - 1))
    return at, (sorted_keys[at] == wanted) if len(sorted_keys) else np.zeros(len(wanted), bool)


class Table:
    """Sorted keys, each with two numbers, in blocks: arrays, or files (path, rows) that are mapped when first needed."""

    def __init__(self, first: np.ndarray, blocks: list, folder: str | None = None):
        self.first, self.blocks, self.folder, self.open = first, blocks, folder, {}

    def __getstate__(self):
        return {**self.__dict__, "open": {}}

    def _block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if self.folder is None:
            return self.blocks[b]
        if b not in self.open:
            path, n = self.blocks[b]
            fs, _ = _fs(self.folder)
            if fs.type_name == "local":
                raw = np.memmap(path, np.uint8, "r")
            else:  # a copy in the worker's own folder, which needs no name once it is mapped
                at, local = tempfile.mkstemp()
                with fs.open_input_stream(path) as f, os.fdopen(at, "wb") as out:
                    while part := f.read(8 << 20):
                        out.write(part)
                raw = np.memmap(local, np.uint8, "r")
                os.remove(local)
            self.open[b] = raw[: 8 * n].view(np.uint64), raw[8 * n :].view(np.float64).reshape(n, 2)
        return self.open[b]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The two numbers of each wanted key; zeros for others."""
        out = np.zeros((len(wanted), 2))
        which = np.searchsorted(self.first, wanted, "right") - 1
        for b in np.unique(which[which >= 0]).tolist():
            some = np.flatnonzero(which == b)
            keys, values = self._block(b)
            at, found = _find(keys, wanted[some])
            out[some[found]] = values[at[found]]
        return out


_NONE = Table(np.empty(0, np.uint64), [])
_MASK = [np.uint64((1 << 16 * k) - 1) for k in range(ORDER + 1)]


def discount(n1: float, n2: float) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


class Models:
    """All languages' models: tables of grams (their counts) and of contexts (sum and number of their
    grams' counts) for each order and language. The costs of grams met are stored, up to `most` grams."""

    def __init__(self, langs: list[str], lang: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        """lang (index), keys and counts: order-4 grams of the training texts."""
        tables, discounts = {}, {}
        for i in range(len(langs)):
            own = lang == i
            order = np.argsort(keys[own])
            k, n = keys[own][order], counts[own][order].astype(np.float64)
            for o in range(ORDER, 0, -1):  # below the highest, continuation counts: a row for each distinct longer gram
                if o < ORDER:
                    k, n = np.unique(k & _MASK[o], return_counts=True)
                if not len(k):
                    continue
                n = n.astype(np.float64)
                discounts[o, i] = discount(float((n == 1).sum()), float((n == 2).sum()))
                c = k >> np.uint64(16)
                first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                totals = np.column_stack([np.add.reduceat(n, first), np.diff(np.append(first, len(c)))])
                tables[o, 0, i] = Table(k[:1], [(k, np.column_stack([n, n]))])
                tables[o, 1, i] = Table(c[:1], [(c[first], totals)])
        self._set(langs, tables, discounts, len(np.unique(keys & _MASK[1])))

    @classmethod
    def of(cls, langs: list[str], tables: dict, discounts: dict, units: int) -> Models:
        """Of tables by (order, 0 for grams or 1 for contexts, language), discounts by (order, language)."""
        models = cls.__new__(cls)
        models._set(langs, tables, discounts, units)
        return models

    def _set(self, langs, tables, discounts, units, most=1 << 20) -> None:
        self.langs, self.tables, self.discounts, self.most = langs, tables, discounts, most
        self.temperature, self.limits = 1.0, np.full(len(langs), np.inf)
        self.uniform = 1.0 / (units + 1)
        self.seal()

    def _prob(self, keys: np.ndarray, order: int) -> np.ndarray:
        """P of each gram's last character after those before it, for each language."""
        p = np.full((len(keys), len(self.langs)), self.uniform)
        for o in range(1, order + 1):
            k = keys & _MASK[o]
            for i in range(len(self.langs)):
                n = self.tables.get((o, 0, i), _NONE).find(k)[:, 0]
                total, kinds = self.tables.get((o, 1, i), _NONE).find(k >> np.uint64(16)).T
                d, known = self.discounts.get((o, i), 0.5), total > 0  # an unknown context says nothing
                p[known, i] = (np.maximum(n - d, 0) + d * kinds * p[:, i])[known] / total[known]
        return p

    def seal(self) -> None:
        """Empties the store of -log2 P of the order-4 grams met, so that scoring is one lookup for most characters."""
        self.keys, self.cost = np.empty(0, np.uint64), np.empty((0, len(self.langs)), np.float32)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where the store holds each gram; those not met before are computed and join it."""
        at, found = _find(self.keys, keys)
        if found.all():
            return at
        new = np.unique(keys[~found])
        if len(self.keys) and len(self.keys) + len(new) > self.most:
            self.seal()
            return self._places(keys)
        merged = np.concatenate([self.keys, new])
        order = np.argsort(merged, kind="stable")
        if len(self.keys):
            at = at + np.searchsorted(new, self.keys)[at]
        cost = np.concatenate([self.cost, -np.log2(self._prob(new, ORDER)).astype(np.float32)])
        self.keys, self.cost = merged[order], cost[order]
        at[~found] = np.searchsorted(self.keys, keys[~found])
        return at

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Mean -log2 P of each text's characters, for each language; 0 for empty texts.

        Each distinct gram is looked up once; texts then sum what their grams cost."""
        keys, n = grams(texts)
        at = self._places(keys)
        ends = np.cumsum(n)
        out = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(n)
        if len(some):
            for i in range(len(self.langs)):
                out[some, i] = np.add.reduceat(self.cost[:, i][at], (ends - n)[some], dtype=np.float64) / n[some]
        return out

    def calibrate(self, texts: list[str], langs: np.ndarray, quantile: float, weight: np.ndarray | None = None) -> None:
        """The temperature of least weighted log loss, and each language's limit: a quantile of its own texts' means."""
        h = self.entropies(texts)
        best = np.inf
        for t in np.geomspace(0.5, 64, 40):
            z = -h * t
            each = z[np.arange(len(h)), langs] - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) - z.max(axis=1)
            loss = -np.average(each, weights=weight) if len(h) else 0.0
            if loss < best - 1e-9:
                best, self.temperature = loss, float(t)
        for i in range(len(self.langs)):
            own = h[langs == i, i]
            if len(own):
                self.limits[i] = 1.05 * np.quantile(own, quantile)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, confidence, and whether the text is rejected."""
        h = self.entropies(texts)
        best = h.argmin(axis=1)
        z = -self.temperature * (h - h.min(axis=1, keepdims=True))
        return best, 1 / np.exp(z).sum(axis=1), h[np.arange(len(h)), best] > self.limits[best]


def train(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", calibrate_rows: int = 2000, quantile: float = 0.999, few: int = 64) -> Models:
    """Counts the grams of all usable rows with a text and a language (usable: a condition on doc_id).

    Each task counts its own rows and sends one row for each gram and language; the sums are one
    shuffle of those, and all tables follow from them by aggregation. The driver sees the discounts and the
    first key of each block of the tables, and the texts used to calibrate: calibrate_rows in all, in equal shares for
    each language, drawn by a hash of the identifier, and at most one in four of its rows. These are kept out of
    counting, so that limits are those of texts not learned from; a language of fewer than `few` rows is counted
    and calibrated on all of them.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna(subset=["text", "lang"])
    if usable is not None:
        rows = rows.where(usable)

    def count(batches):
        held: dict[str, list] = {}

        def fold(lang):
            parts = held[lang]
            k = np.concatenate([p[0] for p in parts])
            order = np.argsort(k, kind="stable")
            k, n = k[order], np.concatenate([p[1] for p in parts])[order]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
            held[lang] = [(k[first], np.add.reduceat(n, first) if len(first) else n)]

        for b in rows_of(batches, 2 << 20):
            by: dict[str, list[str]] = {}
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                by.setdefault(lang, []).append(letters(text))
            for lang, texts in by.items():
                held.setdefault(lang, []).append(distinct(grams(texts)[0]))
                if len(held[lang]) > 16:
                    fold(lang)
        for lang in held:
            fold(lang)
            k, n = held[lang][0]
            if len(k):
                for at in range(0, len(k), 100_000):
                    some = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k[some])), pa.array(k[some].view(np.int64)), pa.array(n[some])], ["lang", "gram", "n"])
            held[lang] = []
        release()

    # a row for each language: how many of its rows to draw
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("size")), "languages")
    share = -(-calibrate_rows // max(1, sizes.count()))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 11) / F.lit(float(1 << 53))
    small = F.col("size") < few
    drawn = F.coalesce(draw < F.least(F.lit(0.25), F.lit(float(share)) / F.col("size")), F.lit(False))
    rows = rows.join(F.broadcast(sizes), "lang").select("doc_id", "text", "lang", "size", (drawn | small).alias("drawn"), (~drawn | small).alias("counted"))
    counted = rows.where("counted").select("doc_id", "text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "grams")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    models = _tabulate(counted, langs)
    if langs:
        at = {x: i for i, x in enumerate(langs)}
        # at most the share of each language, or its few rows, in expectation
        some = rows.where("drawn").where(F.col("text").rlike(r"\p{L}")).select("text", "lang", "size").toArrow()
        use = [(letters(t), at[x], n) for t, x, n in zip(*(some.column(k).to_pylist() for k in range(3))) if letters(t) and x in at]
        names = np.array([u[1] for u in use], np.int64)
        # each language counts for the temperature by its share of all rows
        weight = np.array([u[2] for u in use], np.float64) / np.maximum(1, np.bincount(names, minlength=len(langs))[names])
        models.calibrate([u[0] for u in use], names, quantile, weight)
    return models


def _tabulate(counted: DataFrame, langs: list[str], block_rows: int = 1 << 20) -> Models:
    """The models of all counted grams (lang, gram, n), their tables in files."""
    spark = counted.sparkSession
    if not langs:
        return Models(langs, np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
    level = counted.select((F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int").alias("lang"), "gram", F.col("n").cast("double").alias("n"))
    made = []
    for o in range(ORDER, 0, -1):
        if o < ORDER:  # continuation counts: a row for each distinct longer gram
            level = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit(int(_MASK[o]))).alias("gram")).agg(F.count("*").cast("double").alias("n"))
            level = materialize(level, f"grams-{o}") if o > 1 else level
        contexts = level.groupBy("lang", F.shiftrightunsigned("gram", 16).alias("gram")).agg(F.sum("n").alias("a"), F.count("*").cast("double").alias("b"))
        for kind, rows in enumerate((level.select("lang", "gram", F.col("n").alias("a"), F.col("n").alias("b")), contexts)):
            made.append(rows.select(F.lit(o).alias("level"), F.lit(kind).alias("kind"), "lang", "gram", "a", "b"))
    every = made[0]
    for rows in made[1:]:
        every = every.unionByName(rows)
    every = materialize(every, "gram-tables")
    own = every.where("kind = 0").groupBy("level", "lang").agg(F.count_if(F.col("a") == 1).alias("n1"), F.count_if(F.col("a") == 2).alias("n2")).collect()
    discounts = {(r["level"], r["lang"]): discount(r["n1"], r["n2"]) for r in own}
    units = every.where("kind = 0 AND level = 1").select("gram").distinct().count()
    folder = scratch(spark, "gram-blocks")

    def write(batches):
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        made, held, rows, at = [], [], 0, None

        def close():
            path = f"{root}/{'-'.join(map(str, at))}-{held[0][0][0]:016x}.{_attempt()}"
            with fs.open_output_stream(path) as f:
                for k in range(2):
                    for part in held:
                        f.write(part[k].tobytes())
            made.append((*at, int(held[0][0][:1].view(np.int64)[0]), path, rows))

        for b in batches:
            ids = np.column_stack([b.column(k).to_numpy() for k in range(3)])
            keys = b.column(3).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            values = np.column_stack([b.column(k).to_numpy() for k in (4, 5)])
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if begin == end:
                    continue
                if held and (at != tuple(ids[begin].tolist()) or rows >= block_rows):
                    close()
                    held, rows = [], 0
                at = tuple(ids[begin].tolist())
                held.append((keys[begin:end], values[begin:end]))
                rows += end - begin
        if held:
            close()
        columns = list(zip(*made)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.int64(), pa.string(), pa.int64()])], ["level", "kind", "lang", "first", "path", "n"])

    # grams are unsigned: with the first bit flipped they sort as signed numbers do
    flipped = every.withColumn("gram", F.col("gram").bitwiseXOR(F.lit(-(1 << 63))))
    parts = flipped.repartitionByRange("level", "kind", "lang", "gram").sortWithinPartitions("level", "kind", "lang", "gram")
    listed = materialize(parts.mapInArrow(write, "level int, kind int, lang int, first long, path string, n long"), "gram-index")
    found: dict[tuple, list] = {}
    for r in listed.collect():  # a row for each block
        found.setdefault((r["level"], r["kind"], r["lang"]), []).append((r["first"] % (1 << 64), (r["path"], r["n"])))
    tables = {}
    for at, blocks in found.items():
        blocks.sort()
        tables[at] = Table(np.array([x for x, _ in blocks], np.uint64), [x for _, x in blocks], folder)
    return Models.of(langs, tables, discounts, units)


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text. Null texts and texts without a letter
    are `und` with score 0; so is every text where no language was learned. Ties go to the language
    that sorts first. Texts of any length are scored whole. Null ids are kept; repeated rows answer alike; other columns are ignored."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        models = sent.value
        for b in rows_of(batches, 2 << 20):
            texts = [letters(t) for t in b.column(1).to_pylist()]
            some = [i for i, t in enumerate(texts) if t and models.langs]
            lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if some:
                best, confidence, far = models.predict([texts[i] for i in some])
                for i, k, c, r in zip(some, best.tolist(), confidence.tolist(), far.tolist()):
                    lang[i], score[i], rejected[i] = models.langs[k], c, r
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])
        release()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def fold() -> Column:
    """crc32 of the identifier as text, modulo 4; 2 names the held-out rows."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4


def op7_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, train(docs, usable=fold() != 2))
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
