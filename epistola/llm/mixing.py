"""Mixing documents to target weights of domains they belong to in part, in SQL functions alone.

A naive Bayes classifier learned from a labelled table gives each document a probability for each domain. Nonnegative rates
of the documents are then fitted by least squares, so that the expected tokens of each domain meet its target, in projected
gradient steps. The gradient of the squared misses lies, for a document, along its probabilities times the misses. A step
moves all rates against it, scaled by the inverse of the tokens that domains share in the documents still free to move (a
small matrix, which makes these steps Newton's on the dual problem), and projects them to the least rate. What a document
has moved is its probabilities times one cost a domain, so rates need not be kept: a step is one aggregate over a narrow
table, and nothing but sums of domains comes to the driver.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from epistola.llm._store import keep

BUCKETS = 4096
#: Most labelled documents of a domain that the classifier is fitted on: those of the smallest hash.
SAMPLE = 4000
#: Domains up to which the sample is broadcast: 16 bytes a row.
FEW = 64
#: Counts that each bucket is given beforehand.
PRIOR = 50.0
#: Steps after which a fit that has not settled raises, the part of a target that may be missed, what weight rates near 1 have, and the part of all tokens that is warned of.
STEPS, EXACT, RIDGE, MISSED = 60, 1e-4, 1e-6, 0.001
_BLANKS = "\t\n\x0b\x0c\r"


def words(text: str) -> Column:
    """The words of a text: none if it is null or blank."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _BLANKS, " " * len(_BLANKS)), " "), "")


def bucket(word: Column) -> Column:
    """A number below BUCKETS for the letters and digits of a word in lower case."""
    return F.pmod(F.xxhash64(F.rtrim(F.lower(word), F.lit(".,;:!?"))), F.lit(BUCKETS)).cast("int")


def numbers(values: list[float]) -> Column:
    """A constant array that is folded into the plan once."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


@dataclass
class Classifier:
    """Names of the domains, the logarithm of each one's prior, and its weight of each bucket, both less those of the first domain."""

    names: list[str]
    priors: list[float]
    weights: list[list[float]] = field(repr=False)

    def add(self, rows: DataFrame, text: str) -> DataFrame:
        """Adds n_tokens and posteriors, in the order of the names; a text without words has the priors."""
        if len(self.names) < 2:
            return rows.withColumn("n_tokens", F.size(words(text)).cast("long")).withColumn("posteriors", F.array(*[F.lit(1.0)] * len(self.names)).cast("array<double>"))
        rows = rows.withColumn("_at", F.transform(words(text), bucket)).withColumn("n_tokens", F.size("_at").cast("long"))
        tables = [numbers(w) for w in self.weights[1:]]
        start = F.struct(*[F.lit(p).alias(f"d{d}") for d, p in enumerate(self.priors[1:])])
        add = lambda acc, i: F.struct(*[(acc[f"d{d}"] + F.get(t, i)).alias(f"d{d}") for d, t in enumerate(tables)])
        rows = rows.withColumn("_sum", F.aggregate("_at", start, add))
        logits = [F.lit(0.0), *[F.col("_sum")[f"d{d}"] for d in range(len(tables))]]
        rows = rows.withColumn("_top", F.greatest(*logits)).withColumn("_e", F.array(*[F.exp(x - F.col("_top")) for x in logits]))
        total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
        return rows.withColumn("_t", total).withColumn("posteriors", F.transform("_e", lambda x: x / F.col("_t"))).drop("_at", "_sum", "_top", "_e", "_t")


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Learns from a table (id, domain). Rows without id, domain or document are left out; an id with more than one domain counts for each.

    Priors are shares of all labelled rows; words are counted in at most SAMPLE documents of a domain.
    """
    labelled = labelled.select(F.col(id_col).alias("_id"), F.col("domain").cast("string").alias("domain")).dropna().distinct()
    shares = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # one a domain
    names = sorted(shares)
    if not names:
        return Classifier(["all"], [0.0], [[]])
    # The smallest hashes of each domain, by a bound on the hash first, so that few rows are put in order.
    key = F.xxhash64(F.col("_id").cast("string"))
    most = F.create_map(*[F.lit(x) for n, rows in shares.items() for x in (n, min(2**63 - 1, int(1.2 * SAMPLE / rows * 2**63)) if rows > SAMPLE else 2**63 - 1)])
    near = labelled.where(F.shiftrightunsigned(key, 1) <= F.element_at(most, F.col("domain")))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(key, "_id"))
    sample = near.withColumn("_place", place).where(F.col("_place") <= SAMPLE).select("_id", "domain")
    # At most SAMPLE rows a domain; with many domains both sides are dealt out.
    taken = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample) if len(names) <= FEW else sample, "_id")
    counts = taken.select("domain", F.explode(F.transform(words("_text"), bucket)).alias("b")).groupBy("domain", "b").agg(F.count(F.lit(1)).alias("n"))
    table = {n: [PRIOR] * BUCKETS for n in names}
    for r in counts.collect():  # BUCKETS a domain at most
        table[r["domain"]][r["b"]] += r["n"]
    logs = {n: [math.log(x / sum(table[n])) for x in table[n]] for n in names}
    weights = [[x - y for x, y in zip(logs[n], logs[names[0]])] for n in names]
    return Classifier(names, [math.log(shares[n] / shares[names[0]]) for n in names], weights)


def rate(posteriors: Column, costs: list[float], least: float) -> Column:
    """A document's rate: 1 less the mean of the domains' costs under its posteriors, but not below `least`."""
    return F.greatest(F.lit(float(least)), F.lit(1.0) - sum((F.get(posteriors, F.lit(d)) * F.lit(float(c)) for d, c in enumerate(costs)), F.lit(0.0)))


@dataclass
class Mix:
    classifier: Classifier
    costs: list[float]
    least: float
    targets: dict[str, float]
    reached: dict[str, float]
    scored: DataFrame

    @property
    def gap(self) -> dict[str, float]:
        """Expected tokens of each domain less its target, as a share of all targets."""
        total = sum(self.targets.values()) or 1.0
        return {d: (self.reached[d] - t) / total for d, t in self.targets.items()}

    def add_rates(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """Adds n_tokens, posteriors, rate and copies to rows with a text."""
        return self.add_copies(self.classifier.add(rows, text))

    def add_copies(self, rows: DataFrame) -> DataFrame:
        """Adds the rate, and copies: the rate rounded up or down by a hash of the id, so that its expectation is the rate."""
        rows = rows.withColumn("rate", rate(F.col("posteriors"), self.costs, self.least))
        chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens")), F.lit(1 << 20)) / F.lit(float(1 << 20))
        return rows.withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def fit(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> Mix:
    """Fits rates of at least `least`. weights: a share for each domain that labelled names; others are 0.

    total: expected tokens of the mix; None for the fewest with which no domain of a weight has to shrink. A target below
    what `least` leaves of a domain counts as what it leaves, and a domain that has more than its target may keep EXACT of
    it more. The sum over domains of (expected tokens - target)**2 / tokens now, plus RIDGE times that over documents of
    tokens * (rate - 1)**2, is made least. Rates that do so are 1 less the mean cost of the domains, with a cost of
    (expected tokens - target) / (RIDGE * tokens now): as many unknowns as domains, found by Newton's method. What targets cannot be met is told by Mix.gap, and warned of from MISSED on. Without tokens,
    rates stay at 1.
    """
    classifier = train(docs, labelled, id_col, text_col)
    scored, _ = keep(classifier.add(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").select("doc_id", "n_tokens", "posteriors"), "mixing")
    size, n = len(classifier.names), F.col("n_tokens")
    p = [F.get("posteriors", F.lit(d)) for d in range(size)]
    pairs = [(d, e) for d in range(size) for e in range(d + 1)]

    def measure(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected tokens of the domains, how they fall with the costs, and the sum over documents that the costs make most."""
        r, free = F.col("r"), F.when(F.col("u") < 1.0 - least, n).otherwise(0)
        rows = scored.withColumn("u", sum((x * F.lit(float(c)) for x, c in zip(p, costs)), F.lit(0.0))).withColumn("r", rate(F.col("posteriors"), list(costs), least))
        gain = F.sum(n * (F.pow(r - 1.0, F.lit(2)) / 2 + r * F.col("u")))
        row = rows.agg(*[F.sum(n * r * x) for x in p], *[F.sum(free * p[d] * p[e]) for d, e in pairs], gain).first()
        row = [float(x or 0) for x in row]
        fall = np.zeros((size, size))
        for (d, e), x in zip(pairs, row[size:-1]):
            fall[d, e] = fall[e, d] = x
        return np.array(row[:size]), fall, row[-1]

    costs = np.zeros(size)
    now, fall, gain = measure(costs)
    own = now / max(1.0, least)  # the tokens at rates of 1
    share = [max(0.0, weights.get(x, 0.0)) for x in classifier.names]
    share = np.array([x / sum(share) for x in share] if sum(share) else [1 / size] * size)
    if total is None:
        total = max(s / w if w else 0.0 for s, w in zip(own, share))
    targets = total * share
    if own.sum():
        scale, aim = np.where(own > 0, own, 1.0), np.maximum(targets, least * own)
        aim = np.where(aim <= own, aim * (1 + EXACT), aim)
        root = np.sqrt(scale)
        value = lambda gain, costs: gain - aim @ costs - RIDGE / 2 * (scale * costs) @ costs
        for _ in range(STEPS):
            off = now - aim - RIDGE * scale * costs
            if max(abs(off) / np.maximum(aim, scale)) < EXACT / 100:
                break
            step = np.linalg.solve(fall / np.outer(root, root) + RIDGE * np.eye(size), off / root) / root
            pace, before = 1.0, value(gain, costs)
            while True:  # the value is concave, so a short enough step raises it
                now, fall, gain = measure(costs + pace * step)
                if value(gain, costs + pace * step) >= before + 1e-4 * pace * (off @ step) - 1e-12 * abs(before) or pace < 1e-6:
                    break
                pace /= 2
            costs = costs + pace * step
        else:
            raise ArithmeticError(f"rates are not settled after {STEPS} steps: {dict(zip(classifier.names, now))} expected, {dict(zip(classifier.names, aim))} wanted")
    mix = Mix(classifier, costs.tolist(), least, dict(zip(classifier.names, targets.tolist())), dict(zip(classifier.names, now.tolist())), scored)
    missed = {d: round(x, 4) for d, x in mix.gap.items() if abs(x) > MISSED}
    if missed:
        warnings.warn(f"targets are missed by these shares of all tokens: {missed}", stacklevel=2)
    return mix


#: What the registered query and the pipeline mix: shares of languages nearer to each other than the corpus has them.
DOMAINS = {"en": 0.50, "de": 0.19, "fr": 0.19, "es": 0.12}


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, a probability of each domain, rate and copies of every document; the domains are the languages of the rows that have one."""
    mix = fit(docs, docs.select("doc_id", F.col("lang").alias("domain")), DOMAINS)
    rows = mix.add_copies(mix.scored)
    return rows.select("doc_id", "n_tokens", *[F.get("posteriors", F.lit(d)).alias(f"p_{x}") for d, x in enumerate(mix.classifier.names)], "rate", "copies")


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The documents, each as many times as its copies, with rates of 1 or more: the mix is reached by repeating, so none is lost."""
    columns = docs.columns
    mix = fit(docs, docs.select("doc_id", F.col("lang").alias("domain")), DOMAINS, least=1.0)
    own = docs.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(columns)], F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    rows = mix.add_rates(own).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(columns)])
