"""Fingerprints, languages, rates, toxicity, shingle links, overlaps and archives against plain versions of them; odd rows and clashing columns."""

import hashlib
import itertools
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from epistola.llm import decontamination, fingerprints, language_id, mixing, ngram_join, sharding, toxicity, warc
from epistola.llm._store import Filter, among, range_bounds
from tests.llm.test_llm import SF, brute_links
from tests.llm.test_pipeline import brute_language


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Fingerprints.


def spark_hash(*values):
    """What SQL's xxhash64 gives for texts and whole numbers."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", v), seed=seed)
        seed_signed = seed - (1 << 64) if seed >> 63 else seed
    return seed_signed


def brute_anchors(text):
    """hash: first place. A run of five words is an anchor if the smallest of its four hashes of two words is at either end."""
    alone = "".join(f" {c} " if 0x4E00 <= ord(c) < 0x9FFF or 0x3040 <= ord(c) < 0x3100 else c for c in text)
    words = alone.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
    words = words if len(words) >= 5 else list(text)
    hashed = [spark_hash(w) for w in words]
    pairs = [spark_hash(a, b) for a, b in itertools.pairwise(hashed)]
    found = {}
    for i in range(len(words) - 4):
        inner = pairs[i : i + 4]
        if min(inner) in (inner[0], inner[3]):
            found.setdefault(spark_hash(pairs[i], pairs[i + 2], hashed[i + 4]) >> 24, i)
    return found or ({spark_hash(text, np.int32(5)) >> 24: 0} if text else {})


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    shifts = sorted(a[h] - b[h] for h in a.keys() & b.keys())
    if not shifts:
        return 0.0
    middle = shifts[len(shifts) // 2]
    return sum(abs(s - middle) <= 64 for s in shifts) / len(a.keys() | b.keys())


def test_fingerprints_and_likeness(spark, docs):
    chinese = "".join(chr(0x4E00 + (i * 7919) % 5000) for i in range(560))
    rows = docs.select("doc_id", "text").where("doc_id < 60").unionByName(spark.createDataFrame([(10**6, chinese), (10**6 + 1, "a b"), (10**6 + 2, ""), (10**6 + 3, None), (10**6 + 4, "x " * 3000)], "doc_id long, text string"))
    texts = [r["text"] or "" for r in rows.orderBy("doc_id").collect()]
    got = fingerprints.fingerprint_edits(rows).orderBy("doc_id").collect()
    for i, (g, text) in enumerate(zip(got, texts)):
        following, half = texts[(i + 1) % len(texts)], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = map(brute_anchors, (text, edited, following))
        packed = sorted(((h << 24) | place) - (1 << 64 if ((h << 24) | place) >= 1 << 63 else 0) for h, place in own.items())
        assert g["fingerprint"] == "".join(f"{x & (2**64 - 1):016X}" for x in packed)
        assert g["near_edited"] == pytest.approx(brute_likeness(own, other)) and g["near_next"] == pytest.approx(brute_likeness(own, after))
        assert g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    at = texts.index(chinese)
    assert got[at]["near_edited"] > 0.3  # half of it is as it was


# Languages.


def test_languages_and_scores(spark, docs):
    rows = docs.collect()
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    least = sorted(r["score"] for r in got.values())[len(got) // 2]
    near = {d for d, r in got.items() if abs(r["score"] - least) < 1e-4}
    assert {d for d, r in got.items() if r["score"] >= least} - near == set(brute_language(rows, least)) - near
    one = docs.withColumn("lang", F.lit("en"))
    assert {r["lang_pred"] for r in language_id.identify(one).collect()} <= {"en", "und"}


def test_kept_rows_keep_their_own_columns(docs):
    own = docs.withColumns({"score": F.lit(5.5), "lang_pred": F.lit("mine"), "c_0": F.col("doc_id"), "predicted": F.lit("x"), "held_out": F.lit(7)})
    kept = language_id.keep_known(own)
    assert kept.columns == own.columns and {tuple(r) for r in kept.select("score", "lang_pred", "predicted").distinct().collect()} == {(5.5, "mine", "x")}
    assert kept.where("c_0 <> doc_id").count() == 0
    assert sorted(language_id.identify(own).columns) == ["doc_id", "held_out", "lang_pred", "score"]


def test_equal_cosines_take_the_first_name(spark):
    rows = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["b", "a", "c"] * 4)] + [(99, "same words here " * 30000, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(rows).collect()} == {"a"}


# Rates.


def test_rates_meet_targets_as_projected_gradient_steps_do(docs):
    got = {r["doc_id"]: r for r in mixing.mix_documents(docs).collect()}
    names = sorted(mixing.DOMAINS)
    p = np.array([[r[f"p_{x}"] for x in names] for r in got.values()])
    tokens = np.array([r["n_tokens"] for r in got.values()], float)
    assert np.allclose(p.sum(1), 1)
    share = np.array([mixing.DOMAINS[x] for x in names])
    target = share * max(tokens @ p / share)
    pace = 1 / max(np.linalg.eigvals((p.T * tokens) @ p / np.sqrt(np.outer(target, target))).real)
    rates = np.ones(len(p))
    while abs(off := ((rates * tokens) @ p - target) / target).max() >= 1e-6:
        rates = np.maximum(0.0, rates - pace * p @ off)
    assert np.allclose([r["rate"] for r in got.values()], rates, atol=2e-3)


# Toxicity.


def labelled(f, n, seed, spark):
    random.seed(seed)
    plain = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*random.sample(plain, 30), *["grob"] * (i & 1), *["gruppe"] * (i >> 1 & 1)]), f(i & 1, i >> 1 & 1)) for i in range(n)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), rows


def test_a_pair_of_which_neither_term_tells(spark):
    docs, labels, rows = labelled(lambda a, b: a ^ b, 1800, 3, spark)
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() > 0.95 * got.count()
    # A linear model over the same terms cannot tell them.
    codes = toxicity.Codes()
    x = np.array([[t in toxicity.terms_of(codes.of(text)) for t in toxicity.terms_of(codes.of("grob gruppe"))] for _, text, _ in rows], float)
    y = np.array([r[2] for r in rows])
    w = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
    assert (((np.c_[x, np.ones(len(x))] @ w) >= 0.5) == y).mean() < 0.8


def test_scores_are_sums_over_pairs(spark):
    docs, labels, rows = labelled(lambda a, b: a & b, 900, 5, spark)
    machine = toxicity.train(docs, labels.withColumnRenamed("toxic", "label"))
    long = ("wort " * 50000 + "grob gruppe grob", "")
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*(r[1] for r in rows[:40]), None, "", "!!", *long])], "doc_id long, text string").withColumns({"score": F.lit("mine"), "predicted": F.lit(9)})
    codes = toxicity.Codes()
    for r in toxicity.score(odd, machine).collect():
        at = machine.features(codes.of(r["text"])).tolist()
        total = machine.bias + sum(machine.linear[i] for i in at) + sum(float(machine.factors[i] @ machine.factors[j]) for i, j in itertools.combinations(at, 2))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total))) and r["predicted"] == int(r["score"] >= 0.7)
        terms = toxicity.terms_of(codes.of(r["text"]))
        assert sorted(at) == sorted(machine.place[t] for t in terms if machine.place[t] >= 0)


def test_toxicity_of_odd_tables(spark):
    docs, labels, _ = labelled(lambda a, b: a & b, 90, 5, spark)
    odd = labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (10**9, 1), (2, 5), (0, 1)], "doc_id long, toxic int"))
    assert toxicity.score_documents(docs.unionAll(docs.limit(2)), odd).count() == 92
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.5}


# Links.


def test_texts_of_one_template(spark):
    template = " ".join(f"t{k}" for k in range(20))
    rows = spark.createDataFrame([(i, f"{template} x{i} y{i}") for i in range(300)] + [(1000 + i, f"{template} x7 y7") for i in range(3)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.link_documents(rows).collect()}
    assert got == {(d, c) for d, _, c in brute_links([tuple(r) for r in rows.collect()], ngram_join.Likeness())}


@pytest.mark.parametrize("seed", range(3))
def test_links_among_common_words(spark, seed):
    """Few words, so that n-grams are shared by texts that are not alike."""
    random.seed(seed)
    rows = [[random.choice("abcd") for _ in range(random.randrange(1, 40))] for _ in range(120)]
    rows += [[w if random.random() > 0.03 else random.choice("abcd") for w in random.choice(rows)] for _ in range(120)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    for like in (ngram_join.Likeness(), ngram_join.NEAR):
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(table, like).collect()), key=str)
        assert got == brute_links([tuple(r) for r in table.collect()], like)


# Overlaps.


def test_recall_by_length_and_changed_words(spark):
    """Items of 5 to 40 words with one word in five changed, anywhere the rule still accepts: all are found."""
    random.seed(2)
    items, rows, wanted = [], [], set()
    for n in range(5, 41):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for trial in range(12):
            changed = set(random.sample(range(n), n // 5))
            equal = np.array([k not in changed for k in range(n)])
            text = [f"f{random.randrange(10**6)}" for _ in range(30)] + [w if k not in changed else "anders" for k, w in enumerate(item)] + [f"f{random.randrange(10**6)}" for _ in range(30)]
            rows.append((n * 100 + trial, " ".join(text)))
            if decontamination.stretch(equal)[2] >= decontamination.least_equal(n):
                wanted.add((n * 100 + trial, n))
    found = decontamination.find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == wanted and len(wanted) > 0.8 * len(rows)


def test_items_that_share_an_instruction(spark):
    shared = " ".join(f"s{k}" for k in range(12))
    items = spark.createDataFrame([(i, f"{shared} " + " ".join(f"q{i}x{k}" for k in range(8))) for i in range(3000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{shared} und weiter"), (2, f"vorn {shared} " + " ".join(f"q77x{k}" for k in range(8))), (3, shared * 2000)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["n_matched"]) for r in decontamination.find_overlaps(docs, items).collect()} == {(2, 77, 20)}


# Archives and shards.


def test_archive_bytes_do_not_hang_on_partitions(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    html = pages.orderBy("page_id").first()["html"]
    pages = pages.unionAll(pages.where("page_id < 3")).unionAll(spark.createDataFrame([(1, "http://x/é", None), (None, None, "<p>" + "z" * 300), (10**6, "http://y/", html), (10**6, "http://y/", html), (None, None, html)], pages.schema))
    made = []
    for i, rows in enumerate((pages.repartition(1), pages.repartition(7, "url"), pages.orderBy(F.desc("page_id")).repartition(3))):
        for name, value in (("spark.sql.shuffle.partitions", "4" if i else "9"),):
            before = spark.conf.get(name)
            spark.conf.set(name, value)
        warc.write(rows, f"file://{tmp_path}/{i}", file_bytes=20_000)
        spark.conf.set(name, before)
        made.append({f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in (tmp_path / str(i)).glob("part-*.warc.gz")})
    assert made[0] == made[1] == made[2] and len(made[0]) > 3
    records = [fields for f in (tmp_path / "0").glob("part-*.warc.gz") for fields, _ in warc.parse(f.read_bytes())]
    ids = [r["WARC-Record-ID"] for r in records]
    assert len(ids) == pages.count() == len(set(ids))
    responses = {r["WARC-Record-ID"] for r in records if r["WARC-Type"] == "response"}
    revisits = [r for r in records if r["WARC-Type"] == "revisit"]
    assert revisits and all(r["WARC-Refers-To"] in responses for r in revisits)


def test_a_very_long_page(spark):
    html = "<p>" + "lang " * 400_000
    rows = spark.createDataFrame([(1, "u", html), (2, "u", html), (3, "u", "")], "page_id long, url string, html string")
    assert {(r["page_id"], r["payload_bytes"], r["refers_to"]) for r in warc.archive_pages(rows).collect()} == {(1, len(html), None), (2, len(html), 1), (3, 0, None)}


def test_checksums_of_shards(spark, docs):
    import zlib

    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8 for r in sharding.assign_shards(docs).collect())


# Helpers.


def test_bounds_follow_from_the_rows_alone(spark):
    random.seed(4)
    keys = [random.randrange(10**6) for _ in range(3000)] + [7] * 500 + [2**62, -(2**62), None] + [5 * 10**17 + i for i in range(2000)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    bounds, heavy = range_bounds(rows, "k", F.lit(1), 100)
    assert (bounds, heavy) == range_bounds(rows.repartition(5), "k", F.lit(1), 100) and heavy == [7] and bounds == sorted(bounds)
    sizes = {}
    for k in keys:
        if k is not None:
            at = sum(b < k for b in bounds)
            sizes[at] = sizes.get(at, 0) + 1
    assert all(n <= 100 for at, n in sizes.items() if at != sum(b < 7 for b in bounds))
    assert range_bounds(rows.limit(0), "k", F.lit(1), 100) == ([], [])


def test_filters_and_sets_of_numbers(spark):
    rows = spark.range(2000).select("id")
    keys = rows.where("id % 7 = 0").unionAll(spark.createDataFrame([(None,)], "id long"))
    inside, outside = Filter(keys, F.col("id")).split(rows.unionAll(spark.createDataFrame([(None,)], "id long")), F.col("id"))
    assert keys.join(inside, keys.id.eqNullSafe(inside.id), "left_anti").count() == 0 and inside.count() + outside.count() == 2001 and outside.count() > 1500
    many = [i * 3 for i in range(500)]
    assert rows.where(among(F.col("id"), many)).count() == 500 and rows.where(among(F.col("id"), [])).count() == 0
