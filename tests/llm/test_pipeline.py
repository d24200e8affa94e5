"""Every stage of the pipeline against a brute-force version on the rows that the stage before it kept."""

import array
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from epistola.llm import decontamination, language_id, mixing
from epistola.llm._store import keep
from tests.llm.test_llm import brute_links
from epistola.llm.ngram_join import NEAR

SF = "/root/testdata/sf0.001"


def brute_language(rows, least):
    """The ids kept: vectors of trigrams are multiplied and added one at a time."""
    own = language_id.space()

    def vector(text):
        total, found = np.zeros(language_id.DIMENSIONS), False
        s = re.sub("\0+", "\0", "\0" + "".join(chr(own.symbols[ord(c)]) for c in (text or "").lower()) + "\0")
        for trigram, n in Counter(zip(s, s[1:], s[2:])).items():
            a, b, c = (own.third[ord(x)].astype(float) for x in trigram)
            total += n * np.roll(a, 2) * np.roll(b, 1) * c
            found = True
        return total if found else None

    vectors = {r["doc_id"]: vector(r["text"]) for r in rows}
    prototypes = {}
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 and vectors[r["doc_id"]] is not None:
            prototypes[r["lang"]] = prototypes.get(r["lang"], 0) + vectors[r["doc_id"]]
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    return [d for d, v in vectors.items() if v is not None and max(cosine(v, p) for p in prototypes.values()) >= least]


def brute_near(rows):
    linked = brute_links([(r["doc_id"], r["text"]) for r in rows], NEAR)
    return [d for d, size, root in linked if not size or d == root]


def brute_clean(rows, items):
    """The ids kept: each item is laid at every place of each text, and a run with enough equal words is a passage."""
    words = lambda t: [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in (t or "").split()) if w]
    kept = []
    for r in rows:
        own, found = words(r["text"]), False
        places = {}
        for i, w in enumerate(own):
            places.setdefault(w, []).append(i)
        for item in map(words, items):
            shifts = Counter(i - k for k, w in enumerate(item) for i in places.get(w, ()))
            need = min(decontamination.LEAST_WORDS, max(1, decontamination.LEAST_SHARE * len(item)))
            for shift in (s for s, n in shifts.items() if item and n >= need):
                equal = [own[k + shift] == w for k, w in enumerate(item) if 0 <= k + shift < len(own)]
                score = best = most = count = 0
                for e in equal:
                    score, count = (score + (1 if e else -1), count + e)
                    if score <= 0:
                        score = count = 0
                    if score > best:
                        best, most = score, count
                found |= most >= need
        if not found:
            kept.append(r["doc_id"])
    return kept


def brute_copies(rows):
    """Rate plus chance of each id: naive Bayes and projected gradient steps with dense arrays. The copies are the whole part."""
    own = [re.findall(r"[^ \t\n\x0b\x0c\r]+", r["text"] or "") for r in rows]
    buckets = [[xxhash.xxh64_intdigest(w.lower().rstrip(".,;:!?"), seed=42) % mixing.BUCKETS for w in words] for words in own]
    names = sorted({r["lang"] for r in rows if r["lang"] is not None})
    counts = {n: np.full(mixing.BUCKETS, mixing.PRIOR) for n in names}
    for r, b in zip(rows, buckets):
        if r["lang"] is not None:
            np.add.at(counts[r["lang"]], b, 1)
    labelled = Counter(r["lang"] for r in rows if r["lang"] is not None)
    logits = np.array([[math.log(labelled[n]) + np.log(counts[n] / counts[n].sum())[b].sum() for n in names] for b in buckets])
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    tokens = np.array(list(map(len, own)), float)
    share = np.array([mixing.DOMAINS[n] for n in names]) / sum(mixing.DOMAINS[n] for n in names)
    target = share * max(tokens @ p / share)
    pace = 1 / max(np.linalg.eigvals((p.T * tokens) @ p / np.sqrt(np.outer(target, target))).real)
    rates = np.ones(len(rows))
    while abs(off := ((rates * tokens) @ p - target) / target).max() >= mixing.EXACT:  # until the targets are met, however many steps that takes
        rates = np.maximum(1.0, rates - pace * p @ off)
    chance = [xxhash.xxh64_intdigest(struct.pack("<q", int(n)), seed=xxhash.xxh64_intdigest(str(r["doc_id"]), seed=42)) % (1 << 20) / (1 << 20) for r, n in zip(rows, tokens)]
    return {r["doc_id"]: x + c for r, x, c in zip(rows, rates, chance)}


def brute_tokens(rows):
    tokenizer, at, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        out.append((r["doc_id"], at, len(ids), zlib.crc32(array.array("I", ids).tobytes())))
        at += len(ids)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    text = docs.where("n_chars > 600 and lang = 'en'").orderBy("doc_id").first()["text"]
    extra = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "12 -- 34"), (10**6 + 3, text), (10**6 + 4, text + " ending"), (10**6 + 5, f"{item} and more {item}")]
    return docs.unionByName(spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in extra], docs.schema))


def test_stages_against_brute_force(spark, rows):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    brute = [lambda r: brute_language(r, corpus_pipeline.LEAST_COSINE), brute_near, lambda r: brute_clean(r, items)]
    docs, sizes = rows, []
    for (name, stage), check in zip(corpus_pipeline.STAGES, brute):
        before = docs.collect()
        docs, _ = keep(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        assert docs.columns == rows.columns and set(map(tuple, after)) <= set(map(tuple, before)), name
        assert sorted(r["doc_id"] for r in after) == sorted(check(before)), name
        sizes.append(len(before) - len(after))
    # Three odd rows, and two of three words ("Reorea. Nd."), too short to tell from random letters; each stage had something to drop.
    assert sizes[0] == 5 and min(sizes) > 0

    before = docs.collect()
    mixed, _ = keep(corpus_pipeline.mix(spark, docs, SF), "test-mixing")
    copies, want = Counter(map(tuple, mixed.collect())), brute_copies(before)
    assert set(copies) == set(map(tuple, before))  # no document is lost or changed
    off = [(r["doc_id"], copies[tuple(r)], want[r["doc_id"]]) for r in before if not math.floor(want[r["doc_id"]] - 0.005) <= copies[tuple(r)] <= math.floor(want[r["doc_id"]] + 0.005)]
    assert not off and max(copies.values()) > 1

    got = corpus_pipeline.write_tokens(spark, mixed, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert list(map(tuple, got)) == brute_tokens(mixed.collect())


def test_run_chains_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = keep(stage(spark, docs, SF), f"test-{name}")
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
