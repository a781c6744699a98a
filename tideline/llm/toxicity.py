"""Operator 3, toxicity: a factorization machine over hashed terms, with pairwise interactions.

    logit(x) = b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i ]

x_i is 1 if a term of bucket i occurs in the text. Terms are lower-case words and, for longer words,
their first four and five letters, so that unseen endings of a known stem count too.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, materialize, release, rows_of, ship, table

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """train_rows bounds the labelled rows that the model is fitted on (the least hashes of their
    identifiers; all, where there are fewer); features bounds the buckets it knows: first those that toxic
    texts have more often than chance, by at least min_z standard deviations, then, whatever their sign
    and significance, those of most texts, since a pair's member may say nothing by itself."""

    buckets: int = 1 << 18
    train_rows: int = 40_000
    features: int = 4096
    min_documents: int = 3
    min_z: float = 4.0
    factors: int = 8
    epochs: int = 60
    rate: float = 0.02
    decay: float = 1e-5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    buckets: int
    known: np.ndarray  # sorted buckets
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, flat: np.ndarray, ends: np.ndarray, most: int = 1 << 17) -> np.ndarray:
        """In slices of about `most` terms, which bounds the memory of their factors."""
        ends, out, at = np.asarray(ends, np.int64), [np.empty(0)], 0
        while at < len(ends):
            past = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, past + most, "right")))
            out.append(_logits(self.bias, self.linear, self.factors, flat[past : ends[to - 1]], ends[at:to] - past))
            at = to
        return np.concatenate(out)


def _terms(word: str, buckets: int) -> tuple[int, ...]:
    out = [word]
    if len(word) > 4:
        out.append("4:" + word[:4])
    if len(word) > 5:
        out.append("5:" + word[:5])
    return tuple(zlib.crc32(t.encode()) % buckets for t in out)


class Terms:
    """The distinct buckets of a text, by a store of the words met; keep: a lookup of the wanted ones."""

    def __init__(self, buckets: int, known: np.ndarray | None = None, most: int = 150_000):
        self.buckets, self.most, self.store = buckets, most, {}
        self.place = None if known is None else {int(b): i for i, b in enumerate(known)}

    def of(self, text: str) -> set[int]:
        words = set(_WORD.findall(text.lower()))
        store = self.store
        if len(store) > self.most:
            store.clear()
        found: set[int] = set()
        for w in words:
            t = store.get(w)
            if t is None:
                t = _terms(w, self.buckets)
                if self.place is not None:
                    t = tuple(self.place[b] for b in t if b in self.place)
                store[w] = t
            if t:
                found.update(t)
        return found


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of values up to each end; empty ranges give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def _logits(bias, linear, factors, flat, ends):
    v = factors[flat]
    s = _sums(v, ends)
    return bias + _sums(linear[flat], ends) + 0.5 * (s**2 - _sums(v**2, ends)).sum(axis=1)


def fit(rows: list[np.ndarray], labels: np.ndarray, known: np.ndarray, settings: Settings) -> Model:
    """Adam on the log loss, minibatches of 256; on the driver, over at most train_rows rows of known buckets.

    A minibatch is a dense matrix of its rows and the known buckets, so that sums over terms are matrix products."""
    rng = np.random.default_rng(settings.seed)
    n, k = len(known), settings.factors
    params = [np.zeros(1), np.zeros(n), rng.normal(0, 0.02, (n, k))]
    rate = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-4, 1 - 1e-4))
    params[0][0] = np.log(rate / (1 - rate))
    m, s, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    size = np.array([len(x) for x in rows], np.int64)
    begin, every = np.cumsum(size) - size, np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int64)
    for _ in range(settings.epochs if n else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            each, ends = size[some], np.cumsum(size[some])
            x = np.zeros((len(some), n), np.float32)
            x[np.repeat(np.arange(len(some)), each), every[np.repeat(begin[some] - (ends - each), each) + np.arange(ends[-1])]] = 1
            sums = x @ np.column_stack([params[1], params[2], (params[2] ** 2).sum(axis=1)]).astype(np.float32)
            total = sums[:, 1:-1]
            z = params[0][0] + sums[:, 0] + 0.5 * ((total**2).sum(axis=1) - sums[:, -1])
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
            pull = x.T @ np.column_stack([err, err[:, None] * total]).astype(np.float32)
            grads = [np.array([err.sum()]), pull[:, 0] + settings.decay * params[1], pull[:, 1:] - params[2] * pull[:, :1] + settings.decay * params[2]]
            t += 1
            for p, g, a, b in zip(params, grads, m, s):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= settings.rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return Model(settings.buckets, known, float(params[0][0]), params[1], params[2])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on documents with a label for which usable holds (a condition on the column doc_id).

    What reaches the driver is bounded: the counts of the chosen buckets (settings.features), then the
    known buckets of at most settings.train_rows texts, each read whole. Nulls of id, text or label take no part;
    an id with several labels counts as toxic if one of them says so; of rows that repeat an id the least text is
    taken; other columns are ignored. Without labelled rows, or with labels of one kind, the model says that kind
    of every text (without any: clean).
    """
    ship(docs.sparkSession)
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    named = named.groupBy("doc_id").agg(F.max("label").alias("label"))
    if usable is not None:
        named = named.where(usable)
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # at most train_rows pairs of two numbers: a bounded broadcast; one text for each
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = materialize(sample, "labelled-texts")

    def count(batches):
        terms, total = Terms(settings.buckets), np.zeros((2, settings.buckets), np.int64)
        rows = [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows[int(y > 0)] += 1
                found = terms.of(text)
                total[int(y > 0), np.fromiter(found, np.int64, len(found))] += 1
        some = np.flatnonzero(total.sum(axis=0))
        # bucket -1: the rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[0][some], rows[0])), pa.array(np.append(total[1][some], rows[1]))], ["bucket", "clean", "toxic"])
        terms.store.clear()
        release()

    stats = materialize(sample.select("text", "label").mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "term-stats")
    rows = stats.where("bucket < 0").agg(F.sum("clean"), F.sum("toxic")).first()
    clean, toxic = float(rows[0] or 0), float(rows[1] or 0)
    if not clean or not toxic:
        discard(sample, stats)
        return Model(settings.buckets, np.empty(0, np.int64), -6.0 if not toxic else 6.0, np.empty(0), np.empty((0, settings.factors)))
    share = toxic / (clean + toxic)
    seen = F.col("clean") + F.col("toxic")
    z = (F.col("toxic") - seen * share) / F.sqrt(seen * share * (1 - share))
    # strong terms first; then the commonest of all others: neutral and mitigating ones are members of pairs
    strong = F.when(z >= settings.min_z, z)
    best = stats.where((F.col("bucket") >= 0) & (seen >= settings.min_documents)).orderBy(strong.desc_nulls_last(), seen.desc(), "bucket").limit(settings.features)
    known = np.sort(np.array([r["bucket"] for r in best.select("bucket").collect()], np.int64))

    def pick(batches):
        terms = Terms(settings.buckets, known)
        for b in batches:
            found = [sorted(terms.of(x)) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "label", "known"])
        terms.store.clear()
        release()

    got = sample.select("text", "label", "doc_id").mapInArrow(pick, "doc_id long, label int, known array<int>").toArrow().sort_by("doc_id")
    discard(sample, stats)
    flat = got.column("known").combine_chunks()
    ends = flat.value_lengths().to_numpy().cumsum()[:-1]
    return fit(np.split(flat.flatten().to_numpy(), ends) if len(flat) else [], (got.column("label").to_numpy() > 0).astype(np.float64), known, settings)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every whole text; null text is empty and scores what no term
    says, the model's bias. Texts of any length are scored whole. Null ids are kept, repeated rows scored each, other columns
    ignored; an empty table gives an empty one."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        terms = Terms(model.buckets, model.known)
        for b in rows_of(batches):
            found = [sorted(terms.of(x)) if x else [] for x in b.column(1).to_pylist()]
            flat = np.array([i for x in found for i in x], np.int64)
            z = model.logits(flat, np.cumsum([len(x) for x in found]))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])
        terms.store.clear()
        release()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject, with their columns, in one pass without a join. Null and empty
    texts score the model's bias; null ids and repeated rows are kept by their texts alone; very long texts are scored whole,
    in slices of terms; columns of any name pass through; an empty table stays empty."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        model = sent.value
        terms = Terms(model.buckets, model.known)
        for b in rows_of(batches, text=names.index(text_col)):
            found = [sorted(terms.of(x)) if x else [] for x in b.column(names.index(text_col)).to_pylist()]
            z = model.logits(np.array([i for x in found for i in x], np.int64), np.cumsum([len(x) for x in found]))
            yield b.filter(pa.array(z < 0))
        terms.store.clear()
        release()

    return docs.mapInArrow(run, docs.schema)


def fold() -> Column:
    """crc32 of the identifier as text, modulo 5; 0 names the held-out rows."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5


def op3_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels"), usable=fold() != 0)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
