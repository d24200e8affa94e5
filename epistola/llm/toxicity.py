"""Toxicity by a factorization machine over hashed terms.

The machine adds to a linear sum a product of learned vectors for each pair of terms in a text, so that a pair, such as an
insult with the name of a group, can weigh more than its two terms alone, or less. Terms get their vectors for what they
tell alone or for what a pair of them tells: two terms of which neither tells anything alone are found by their pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epistola.llm._store import Cache, among, texts, worker_cache
from epistola.llm.language_id import held_out

BUCKETS = 1 << 19
#: Terms that the machine has at most for what they tell alone, and for what a pair tells: the strongest.
TERMS, PAIRED = 1024, 512
#: Terms whose pairs are all looked at: those that tell something alone, then the most frequent.
CANDIDATES = 2048
#: Least chi-square of one term, and least standard score of a pair.
ALONE, TOGETHER = 15.0, 8.0
#: Most rows of either label that the machine is fitted on: those of the smallest hash of the id.
SAMPLE = 10_000
THRESHOLD = 0.7


class Codes(Cache):
    """The terms of each stretch of text without white space, taken as its letters and digits in lower case: the bucket of the word plus BUCKETS times that of its first four letters; -1 if it has none."""

    def __missing__(self, chunk: str) -> int:
        word = chunk.lower()
        if not word.isalnum():
            word = "".join(filter(str.isalnum, word))
        return self.put(chunk, _bucket(word) + BUCKETS * _bucket(f"{word[:4]}*") if word else -1)

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return codes[codes >= 0]


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % BUCKETS


def _twice(own: np.ndarray) -> np.ndarray:
    """The buckets of words that a text has twice or more."""
    return (own * 40503 + 12345) % BUCKETS


def terms_of(codes: np.ndarray) -> np.ndarray:
    """The buckets of all terms of a text, ascending."""
    own, n = np.unique(codes % BUCKETS, return_counts=True)
    return np.unique(np.concatenate([own, np.unique(codes // BUCKETS), _twice(own[n > 1])])).astype(np.int32)


def choose(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Terms that tell the label: alone by chi-square, or with another term by the score of their product.

    The product of two standardized terms is summed over rows with what the label is above its mean; by chance that is of the
    size of a root of the number of rows.
    """
    n, positive = len(rows), labels > 0.5
    count = lambda some: np.bincount(np.concatenate([rows[i] for i in some]) if len(some) else np.empty(0, np.int64), minlength=BUCKETS).astype(float)
    a, b = count(np.flatnonzero(positive)), count(np.flatnonzero(~positive))
    all1, all0 = float(positive.sum()), float(n - positive.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num((a * (all0 - b) - b * (all1 - a)) ** 2 * n / ((a + b) * (n - a - b) * all0 * all1))
    strong = lambda score, terms, most: terms[np.lexsort((terms, -score[terms]))][:most]
    alone = strong(chi, np.flatnonzero((chi > ALONE) & (a + b >= 3)), TERMS)
    often = a + b
    often[alone] = 0
    others = strong(often, np.flatnonzero((often >= 5) & (often < n)), CANDIDATES - len(alone))
    looked = np.sort(np.concatenate([alone, others]))
    if len(looked) < 2:
        return np.sort(alone)
    place = np.full(BUCKETS, -1, np.int32)
    place[looked] = np.arange(len(looked))
    mean = ((a + b)[looked] / n).astype(np.float32)
    scale = 1 / np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    above = (labels - labels.mean()).astype(np.float32)
    product = np.zeros((len(looked), len(looked)), np.float32)
    for start in range(0, n, 512):  # memory is bounded by CANDIDATES
        some = rows[start : start + 512]
        dense = np.zeros((len(some), len(looked)), np.float32)
        for i, x in enumerate(some):
            dense[i, (at := place[x])[at >= 0]] = 1
        dense = (dense - mean) * scale
        product += (dense * above[start : start + 512, None]).T @ dense
    product = np.abs(product) / max(float(np.sqrt(n) * above.std()), 1e-9)
    np.fill_diagonal(product, 0)
    best = np.zeros(BUCKETS)
    best[looked] = product.max(axis=1)
    best[alone] = 0
    paired = strong(best, np.flatnonzero(best > TOGETHER), PAIRED)
    return np.sort(np.concatenate([alone, paired]))


class Machine:
    """A bias, and for each chosen term a linear weight and `rank` factors."""

    def __init__(self, terms: np.ndarray, rank: int = 8, seed: int = 7):
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[terms] = np.arange(len(terms))
        # Words of which the bucket, or that of having it twice, is a chosen one.
        every = np.arange(BUCKETS)
        self.single = (self.place >= 0) | (self.place[_twice(every)] >= 0)
        self.bias, self.linear = 0.0, np.zeros(len(terms))
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (len(terms), rank))

    def features(self, codes: np.ndarray) -> np.ndarray:
        """The places of the chosen terms of a text; those that are not chosen are left out before any sorting."""
        own = codes % BUCKETS
        own, n = np.unique(own[self.single[own]], return_counts=True)
        at = np.concatenate([self.place[own], self.place[codes // BUCKETS], self.place[_twice(own[n > 1])]])
        return np.unique(at[at >= 0])

    def raw(self, at: np.ndarray) -> float:
        v = self.factors[at]
        return float(self.bias + self.linear[at].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum())

    def score(self, codes: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(self.features(codes)), -30, 30))))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, rounds: int = 12, step: float = 0.1, decay: float = 1e-4, seed: int = 7) -> None:
        """Adaptive gradient descent on the logistic loss, one row of places at a time."""
        rng = np.random.default_rng(seed)
        square_w, square_v, square_b = np.full(len(self.linear), 1e-2), np.full(self.factors.shape, 1e-2), 1e-2
        for _ in range(rounds):
            for i in rng.permutation(len(rows)):
                at = rows[i]
                g = 1 / (1 + np.exp(-np.clip(self.raw(at), -30, 30))) - labels[i]
                if abs(g) < 1e-3:
                    continue
                square_b += g * g
                self.bias -= step * g / np.sqrt(square_b)
                if not len(at):
                    continue
                gw = g + decay * self.linear[at]
                square_w[at] += gw * gw
                self.linear[at] -= step * gw / np.sqrt(square_w[at])
                v = self.factors[at]
                gv = g * (v.sum(axis=0) - v) + decay * v
                square_v[at] += gv * gv
                self.factors[at] = v - step * gv / np.sqrt(square_v[at])


def learn(rows: list[np.ndarray], labels: np.ndarray, share: float) -> Machine:
    """A machine from the terms of some rows. share: of label 1 among all rows, where the rows given have another one."""
    own = float(labels.mean()) if len(labels) else 0.0
    if own in (0.0, 1.0):
        machine = Machine(np.empty(0, np.int64))
        machine.bias = float(np.log(share / (1 - share)))
        return machine
    machine = Machine(choose(rows, labels))
    machine.bias = float(np.log(own / (1 - own)))
    machine.fit([(at := machine.place[x])[at >= 0] for x in rows], labels)
    machine.bias += float(np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return machine


def train(docs: DataFrame, labelled: DataFrame) -> Machine:
    """Learns from the texts of docs (doc_id, text) and the labels 0 and 1 of their ids (doc_id, label); other labels and null ids are left out.

    Which rows are taken is decided from ids and labels alone: at most SAMPLE of a label, those of the smallest hash, so
    texts are read once and never dealt out. A bias for the share of either label among all labelled rows is put in
    afterwards. With no rows, or of one label alone, there are no terms and the score is the smoothed share of label 1.
    Ids that have more than one text are learned with each.
    """
    labelled = labelled.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    own = docs.select("doc_id").join(labelled, "doc_id")
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    key = F.xxhash64(F.col("doc_id").cast("string"))
    taken = {}
    for label, n in counts.items():
        some = own.where(F.col("label") == label).select("doc_id").distinct()
        if n > SAMPLE:  # by a bound on the hash first, so that few ids are sorted
            some = some.where(F.shiftrightunsigned(key, 1) <= F.lit(min(2**63 - 1, int(1.2 * SAMPLE / n * 2**63))))
        taken |= {r["doc_id"]: label for r in some.orderBy(key, "doc_id").limit(SAMPLE).collect()}  # SAMPLE ids of a label at most

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_cache("toxicity", Codes)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([terms_of(own.of(t)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "terms"])

    rows, labels = [], []
    if taken:
        found = docs.where(among(F.col("doc_id").cast("long"), list(taken))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        for r in found.mapInArrow(pick, "doc_id long, terms binary").toLocalIterator():  # the sample
            rows.append(np.frombuffer(r["terms"], np.int32))
            labels.append(taken[r["doc_id"]])
    order = np.argsort(np.array([zlib.crc32(x.tobytes()) for x in rows]), kind="stable")  # not as partitions come
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    return learn([rows[i] for i in order], np.array(labels, float)[order], (n1 + 0.5) / (n0 + n1 + 1))


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """Adds score and predicted (score of at least THRESHOLD) to the rows, replacing columns of these names.

    A null or empty text, and one without a letter or digit, has the score of the bias alone; very long texts are scored
    whole. Rows that repeat have equal scores, and a score of exactly THRESHOLD is predicted.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by BUCKETS and TERMS
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codes = shared.value, worker_cache("toxicity", Codes)
        for batch in batches:
            scores = [own.score(codes.of(t)) for t in texts(batch.column(batch.schema.get_field_index(text_col)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(tell, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from labelled rows that are not held out.

    Labels of ids that repeat count once, the largest; labels without a document, of null ids, or other than 0 and 1 are
    left out. Null, empty and very long texts, and ties, are as `score` says; a null doc_id is not held out and not learned
    from. Rows that repeat give a row each; no documents give no rows, and no labels a score of one half.
    """
    out = held_out(F.col("doc_id"), 3, 1)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~out).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    machine = train(docs.select("doc_id", "text"), known)
    return score(docs.select("doc_id", out.alias("held_out"), "text"), machine).select("doc_id", "held_out", "score", "predicted")
