"""Near-duplicate groups, ranked search and collocations against brute force; odd rows, ties, repeats, empty tables and clashing columns."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from epistola.llm import collocations, lexical, minhash
from epistola.llm.collocations import Block, build_hash
from epistola.llm.ngram_join import Likeness, gram_set
from tests.llm.test_llm import SF, brute_links, docs, odd  # noqa: F401

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Circulant MinHash.


def test_coordinates_are_two_permutations():
    grams = np.unique(np.random.default_rng(1).integers(0, 2**63, 700).astype(np.uint64))
    ranks = minhash.ring()[:, 0]
    assert sorted(ranks.tolist()) == list(range(1 << minhash.RING))
    at, own = minhash.places(grams), minhash.coordinates(grams)
    for k in (0, 1, 77, minhash.COORDINATES - 1):
        assert own[k] == ranks[(at + k) % (1 << minhash.RING)].min()
    near = grams[: len(grams) * 9 // 10]  # a likeness of 0.9
    assert abs((minhash.coordinates(near) == own).mean() - 0.9) < 0.08


def test_links_of_planted_pairs_are_all_found():
    """Of 3,000 pairs at the limit none is lost: 1.2e-7 are expected to be."""
    rng = np.random.default_rng(4)
    for size in (4, 40, 400):
        for _ in range(1000):
            both = rng.integers(0, 2**63, size + size // 4).astype(np.uint64)
            assert set(minhash.bands(np.unique(both[:size]))) & set(minhash.bands(np.unique(both)))


@pytest.mark.parametrize("like", [minhash.NEAR, Likeness(5, 80, 100)])
def test_near_duplicates(spark, docs, odd, like, monkeypatch):  # noqa: F811
    random.seed(5)
    base = [f"w{random.randrange(400)}" for _ in range(150)]
    chain, rows = list(base), []
    for i in range(40):  # each like the one before, the ends not like one another
        chain[random.randrange(150)] = f"c{i}"
        rows.append((2000 + i, " ".join(chain), "en", 1, 1, 1))
    rows += [(3000 - i, " ".join(w if random.random() > 0.03 else f"z{i}" for w in base), "en", 1, 1, 1) for i in range(60)]
    rows += [(4000 + i, " ".join(random.choice(["alpha beta", "gamma delta", "one two three", "red green", "up down left", "so on"]) for _ in range(6)), "en", 1, 1, 1) for i in range(80)]
    table = odd.unionByName(spark.createDataFrame(rows, odd.schema)).unionByName(docs.select("doc_id", "text", "lang", F.lit(1).cast("long").alias("cid"), F.lit(1).cast("long").alias("size"), F.lit(1).alias("piece")))
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    monkeypatch.setattr(minhash, "GROUP", 8)  # read by the driver alone
    got = minhash.near_duplicates(table, like).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_links(rows, like)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({r["component_id"] for r in got if r["doc_id"] is not None and 2000 <= r["doc_id"] < 2040}) == 1


def test_no_rows(spark, odd):  # noqa: F811
    none = odd.limit(0)
    assert minhash.near_duplicates(none).collect() == []
    assert collocations.collocations(none).collect() == []
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.rank_documents(none, items).collect() == []
    assert lexical.rank_documents(odd, items.limit(0)).collect() == []


# Ranked search.


def brute_ranks(docs, items, k):
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    own = [(d, collections.Counter(t), len(t)) for d, t in ((d, cut(text)) for d, text in docs)]
    n, words = sum(size > 0 for *_, size in own), sum(size for *_, size in own)
    df = collections.Counter(t for _, counts, _ in own for t in counts)
    out = []
    for item, text in items:
        scores = []
        for d, counts, size in own:
            score = 0
            for t in cut(text):
                if counts[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * (25 + 75 * size * n // words)))
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_ranked_search(spark, docs, odd):  # noqa: F811
    ties = [(i, "tie word tie", "en", 1, 1, 1) for i in (905, 903, 904, 901, 902, 906, 907, 908, 909, 910, 911, 912, 900)]
    table = odd.unionByName(spark.createDataFrame(ties, odd.schema)).unionByName(docs.select("doc_id", "text", "lang", F.lit(1).cast("long").alias("cid"), F.lit(1).cast("long").alias("size"), F.lit(1).alias("piece"))).withColumn("score", F.lit(1)).withColumn("number", F.lit(2))
    items = [(1, "tie tie Word"), (2, None), (3, ""), (4, "nothing-of-this-is-anywhere zzqx"), (None, "the old river; the BANK"), (5, "x y"), (5, "x y"), (6, "日本語 naïve word")] + [(100 + r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute_ranks([(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()], items, 10)
    for shard, block in ((lexical.SHARD, lexical.BLOCK), (2000, 30)):
        got = lexical.search(lexical.build(table, shard=shard), asked, block=block).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert [r[2] for r in sorted((r for r in want if r[0] == 1), key=lambda r: r[1])] == list(range(900, 910))


def test_best_of_equal_scores():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores, ids = rng.integers(0, 4, 60), rng.permutation(60)
        known = rng.random(60) > 0.05
        got = lexical.best(scores, ids, known, 7)
        assert got.tolist() == sorted(np.flatnonzero(scores > 0).tolist(), key=lambda i: (-scores[i], known[i], ids[i]))[:7]


# Collocations.


def brute_collocations(rows, least, most):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        own = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        hidden = {part for p, a in own.items() if len(p) == 3 for part in (p[:2], p[1:]) if part in own and 100 * a >= 50 * own[part]}
        found = []
        for p, a in own.items():
            if p not in hidden:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [collocations.BLOCK, 100])
def test_collocations(spark, docs, odd, block):  # noqa: F811
    rows = [(100 + i, "New York City is big. New York, New\nYork; new york state\x0b\tZürich ZÜRICH zürich é", None, 1, 1, 1) for i in range(12)]
    table = odd.unionByName(spark.createDataFrame(rows, odd.schema)).unionByName(docs.select("doc_id", "text", "lang", F.lit(1).cast("long").alias("cid"), F.lit(1).cast("long").alias("size"), F.lit(1).alias("piece"))).withColumn("hash", F.lit(1)).withColumn("phrase", F.lit("x")).withColumn("n", F.lit(0))
    want = brute_collocations([(r["lang"], r["text"]) for r in table.select("lang", "text").collect()], 10, 40)
    got = collocations.collocations(table, rows=40, block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {"und", "en"} <= {r["lang"] for r in got}


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 50_000).astype(np.uint64))
    block = Block.of(Block(*build_hash(keys[::2])).data())
    assert sorted(block.slots(keys[::2]).tolist()) == list(range(len(keys[::2])))
    assert (block.slots(keys[1::2]) == -1).all()
    with pytest.raises(ValueError, match="not different"):
        build_hash(np.array([5, 5], np.uint64))


def test_least_count_is_bounded(odd):  # noqa: F811
    with pytest.raises(ValueError, match="1 to 255"):
        collocations.collocations(odd, least=256)


def test_shingle_sets_have_no_order():
    assert len(gram_set("a b a b", 2)) == 2
