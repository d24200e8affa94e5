"""Operators against brute force, exact round trips and held-out accuracy; nulls, empty and long texts, ties, repeats, empty tables."""

import array
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from epistola.llm import decontamination, fingerprints, language_id, mixing, ngram_join, sharding, token_counts, token_ids, toxicity, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, cid long, size long, piece int"
ODD = [(1, "The quick brown fox jumps over the lazy dog near the old river bank", "en", 7, 7, 7), (2, None, "en", 1, 1, 1), (3, "", None, 1, 1, 1), (None, "x y", "de", 1, 1, 1), (5, "  \t\n ", "de", 1, 1, 1), (5, "日本語 ﬁ naïve it's <|endoftext|>", "fr", 1, 1, 1), (6, "word " * 40000, "en", 1, 1, 1), (7, "a\x1cb ΣΑΣ", "en", 1, 1, 1), (8, "The quick brown fox jumps over the lazy dog near the old river bank", "en", 1, 1, 1), (8, "The quick brown fox jumps over the lazy dog near the old river bank", "en", 1, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_links(rows, like):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(w[i : i + like.n]) for i in range(len(w) - like.n + 1)} if len(w) >= like.n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and like.den * len(sets[i] & sets[j]) >= like.num * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return sorted(((d, len(sets[i]), names.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("like", [ngram_join.Likeness(), ngram_join.NEAR])
def test_ngram_join(spark, docs, odd, like):
    random.seed(3)
    base = [f"w{random.randrange(500)}" for _ in range(120)]
    near = [(1000 + i, " ".join(w if random.random() > 0.015 else f"z{i}" for w in base), None, None, None, None) for i in range(60)]
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(near, SCHEMA).select("doc_id", "text"))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(rows, like).collect()), key=str)
    assert got == brute_links([tuple(r) for r in rows.collect()], like)


def test_ngram_join_split_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 2)
    like = ngram_join.Likeness()
    rank = np.full(ngram_join.CELLS, 80, np.uint8)
    rows = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(100)) + f" end{i}") for i in range(12)], "doc_id long, text string")
    parts = ngram_join._postings(rows, rank, {}, like)
    assert parts.where("part >= 0").count() == parts.count()
    assert {r["component_id"] for r in ngram_join.link_documents(rows, like).collect()} == {0}


@pytest.mark.parametrize("like", [ngram_join.Likeness(), ngram_join.NEAR])
def test_sketches_never_lose_a_link(like):
    rng = np.random.default_rng(4)
    told = 0
    for size in (1, 2, 60, 64, 65, 1000, 4100):
        for changed in (0, 0.02, 0.05, 0.1, 0.2, 1):
            x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            y = np.unique(np.concatenate([x[int(changed * size) :], rng.integers(0, 1 << 63, int(changed * size / 2)).astype(np.uint64)]))
            alike = ngram_join.sets_alike(x.tobytes(), y.tobytes(), like)
            passed = ngram_join.sketches_alike(ngram_join.sketch(x), ngram_join.sketch(y), like)
            assert passed or not alike
            told += not passed
    assert told > 5
    x, y = (np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64)) for _ in range(2))
    assert not ngram_join.sketches_alike(ngram_join.sketch(x), ngram_join.sketch(y), like)


def test_keep_one(odd):
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == 8 and [d for d, t in rows if t and t.startswith("The quick")] == [1]
    assert ngram_join.keep_one(odd.limit(0)).count() == 0
    assert ngram_join.keep_one(odd.where("doc_id = 8")).count() == 1


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70)], "a long, b long")
    got = {r["cid"]: r["root"] for r in ngram_join.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 70: 50, 100: 50}


def test_token_ids(odd, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for rows in (odd, docs, odd.limit(0)):
        got = token_ids.encode_documents(rows, public_tokenizers.path("word_bpe_49k.json"), with_ids=True).orderBy("start").collect()
        want = [(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in rows.collect()]
        assert sorted(((g["doc_id"], g["ids"]) for g in got), key=str) == sorted(want, key=str)
        at = 0
        for g in got:
            assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(g["ids"]), zlib.crc32(array.array("I", g["ids"]).tobytes()))
            at += g["n_tokens"]
        ids = [g["doc_id"] for g in got]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_codes():
    rng = np.random.default_rng(1)
    for counts, limit in ((rng.integers(1, 10**9, 3000) ** 2 % 10**7 + 1, 12), (np.array([5]), 4), (2 ** np.arange(30), 6), (np.array([0, 3, 0, 1]), 16)):
        lengths = token_ids.code_lengths(counts, limit)
        used = lengths[counts > 0].astype(float)
        assert lengths.max() <= limit and (lengths[counts == 0] == 0).all() and (2.0**-used).sum() <= 1
        ids = np.repeat(np.flatnonzero(counts), 3).astype(np.uint32)
        data, points = token_ids.pack(ids, lengths, token_ids.canonical_codes(lengths))
        left = np.minimum(token_ids.STEP, len(ids) - np.arange(len(points)) * token_ids.STEP)
        assert (token_ids.unpack(data, points.astype(np.int64), left, np.arange(len(points)) * token_ids.STEP, token_ids.decode_table(lengths)) == ids).all()
    # Of all codes within the limit none is shorter: against the unlimited code where the limit does not bind.
    import heapq

    counts = [int(x) for x in rng.integers(1, 1000, 200)]
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert int((token_ids.code_lengths(np.array(counts), 32) * np.array(counts)).sum()) == cost


def test_damaged_file_is_told(spark, odd, tmp_path):
    token_ids.write(odd, f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"))
    file = next(tmp_path.glob("t/part-*"))
    data = bytearray(file.read_bytes())
    data[-1] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="differs from the manifest"):
        token_ids.read(spark, f"file://{tmp_path}/t").collect()


def test_fingerprints(odd, docs):
    for rows in (docs, odd, odd.limit(0), odd.where("doc_id = 1")):
        texts = sorted(((r["doc_id"], r["text"] or "") for r in rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        want = []
        for i, (d, t) in enumerate(texts):
            other, half = texts[(i + 1) % len(texts)][1], len(t) // 2
            want.append((d, len(t), hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest()))
        got = fingerprints.fingerprint_edits(rows).collect()
        assert sorted(((g["doc_id"], g["n_chars"], g["edited_sha256"]) for g in got), key=str) == sorted(want, key=str)
        assert all(0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1 for g in got)


def test_likeness_tells_copies(spark, docs):
    rows = docs.where("n_chars > 800").limit(40).select("doc_id", "text")
    shifted = rows.select("doc_id", F.concat(F.lit("some words before "), "text").alias("shifted"), "text")
    both = fingerprints.add_likeness(fingerprints.add_anchors(fingerprints.add_anchors(shifted, "text", "a"), "shifted", "b"), "a", "b", "near")
    assert both.agg(F.min("near")).first()[0] > 0.85


def test_language(docs, odd):
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    odd_rows = language_id.identify(odd).collect()
    assert len(odd_rows) == len(ODD) and {r["lang_pred"] for r in odd_rows if r["doc_id"] in (2, 3)} == {"und"}
    assert language_id.keep_known(odd).columns == odd.columns
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(odd.limit(0)).count() == 0


def test_bundle_is_the_sum_of_bound_vectors():
    space = language_id.space()
    codes = space.trigrams("Abé")
    one = [space.symbols[ord(c)] for c in "abé"]
    want = sum(np.roll(space.third[a], 2).astype(int) * np.roll(space.third[b], 1) * space.third[c] for a, b, c in ((0, one[0], one[1]), tuple(one), (one[1], one[2], 0)))
    assert (space.bundle([np.unique(codes, return_counts=True)])[0] == want).all()


def test_toxicity(spark):
    random.seed(5)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        words = random.sample(plain, 30)
        # Neither word tells alone; the pair does.
        kind = i % 4
        words += ["grob"] * (kind in (1, 3)) + ["gruppe"] * (kind in (2, 3))
        rows.append((i, " ".join(words), None, 1, 1, 1))
        labels.append((i, 1, int(kind == 3)))
    docs = spark.createDataFrame(rows + [(None, None, None, 1, 1, 1)], SCHEMA)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() > 0.95 * got.count()
    assert toxicity.score_documents(docs, labels).count() == 901
    assert toxicity.score_documents(docs, labels.limit(0)).where("score between 0 and 1").count() == 901


def test_decontamination(spark, odd):
    random.seed(9)
    words = lambda n: [f"t{random.randrange(10**6)}" for _ in range(n)]
    items = {i: words(40) for i in range(4)} | {9: words(5)}
    changed = [w if k % 8 else "other" for k, w in enumerate(items[1])]
    rows = [(1, words(50) + items[0] + words(20)), (2, words(9) + changed), (3, words(80)), (4, items[9]), (5, items[2][:10] + words(60)), (6, [w.upper() + "," for w in items[3]])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows] + [(7, None), (8, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_matched"]) for r in decontamination.find_overlaps(docs, bench).collect()}
    assert got == {(1, 0, 40), (2, 1, 35), (4, 9, 5), (6, 3, 40)}
    assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(docs, bench).collect()) == [3, 5, 7, 8]
    assert decontamination.drop_contaminated(odd, bench).columns == odd.columns
    assert decontamination.find_overlaps(docs, bench.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontamination.find_overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)
    assert sorted(map(tuple, decontamination.find_overlaps(docs, bench).collect())) == whole and whole


def test_mixing(docs, odd):
    got = mixing.mix_documents(docs)
    sums = got.agg(*[(F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{x}")) / F.sum(F.col("n_tokens") * F.col("rate"))).alias(x) for x in mixing.DOMAINS]).first()
    assert all(abs(sums[x] - w) < 0.01 for x, w in mixing.DOMAINS.items()) and got.count() == docs.count()
    repeated = mixing.repeat_documents(odd)
    assert repeated.columns == odd.columns and repeated.select("doc_id", "text").distinct().count() == 9
    assert mixing.mix_documents(odd).count() == len(ODD) and mixing.mix_documents(odd.limit(0)).count() == 0


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, odd):
    rows = spark.createDataFrame([(i * 977,) for i in range(-50, 300)] + [(2**63 - 1,), (-(2**63),)], "doc_id long")
    got = sharding.assign_shards(rows.withColumn("text", F.lit("é"))).collect()
    assert all((r["shard"], r["grown_shard"], r["size"]) == (jump(r["doc_id"], 24), jump(r["doc_id"], 25), 10) for r in got)
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got)
    for rows in (got, sharding.assign_shards(odd).collect()):
        by = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.assign_shards(odd.limit(0)).count() == 0


def test_token_counts(odd, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for rows in (odd, docs, odd.limit(0)):
        want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows.collect()), key=str)
        got = token_counts.count_tokens(rows, public_tokenizers.path("byte_bpe_50k.json")).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)


def test_warc(spark):
    long = "<p>" + "ü" * 200
    pages = spark.createDataFrame([(1, "u", "short"), (2, "u", "short"), (3, "v\r\nx: y", long), (4, None, long), (5, "w", None), (6, "w", ""), (None, "w", long), (4, None, long)], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()), key=str)
    assert got == sorted([(1, 5, "response", None), (2, 5, "response", None), (3, 403, "response", None), (4, 403, "revisit", 3), (4, 403, "revisit", 3), (5, 0, "response", None), (6, 0, "response", None), (None, 403, "revisit", 3)], key=str)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontamination", "mixing", "token_ids"] and "text" in columns
