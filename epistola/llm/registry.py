"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from epistola.llm import collocations, decontamination, fingerprints, language_id, lexical, minhash, mixing, ngram_join, sharding, token_counts, token_ids, toxicity, warc
from epistola.llm._store import table


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32. Null texts have the end id alone."""
    return token_ids.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by 3-word shingles at a Jaccard of 0.9 or more: doc_id, n_shingles, component_id. Texts without words are linked with nothing."""
    return ngram_join.link_documents(table(spark, sf_dir, "documents"), ngram_join.Likeness(3, 90, 100)).select("doc_id", "n_shingles", "component_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and likenesses. Null texts are empty; equal texts have equal ones."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from four of five: doc_id, held_out, lang_pred, score. Texts without a letter are `und`."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies with which languages meet their target shares of tokens. Texts without words weigh nothing."""
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels of two of three: doc_id, held_out, score, predicted. Empty texts have the score of the bias."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark, and where. Null and empty texts have none."""
    return decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents by their id: doc_id, size, text_crc32, law, shard, slot, grown_shard. Null texts have size 8, a null id counts as 0."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents: doc_id, n_bytes, n_tokens, over_limit. Null texts have none."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty payload."""
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of 2-word shingles at a Jaccard of 0.8 or more: doc_id, n_shingles, component_id, kept. Texts without words are alone and kept."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item: item_id, rank, doc_id, score. Items and documents without a term are in no row."""
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of each language: lang, rank, phrase, a, l, r, n, score. Null texts have no words, a null lang is `und`."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_ids, op2_ngram_join, op3_fingerprints, op4_language_id, op5_mixing, op6_toxicity, op7_decontamination, op8_sharding, op9_token_counts, op10_warc, op11_minhash, op12_lexical_search, op13_collocations)}

#: The letters and digits, in lower case, of each word of a text.
_WORDS = r"list_filter(list_transform(string_split_regex(coalesce(text, ''), '\s+'), lambda x: regexp_replace(lower(x), '[^\pL\pN]', '', 'g')), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
        p AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.g""",
    "op7_decontamination": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        n AS (SELECT item_id, w, len(w) AS size, least(13, greatest(1, CAST(ceil(0.8 * len(w) - 1e-9) AS BIGINT))) AS needed FROM i WHERE len(w) > 0),
        dp AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS at FROM d),
        ip AS (SELECT item_id, size, needed, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS at FROM n),
        line AS (SELECT doc_id, item_id, dp.at - ip.at AS shift FROM dp JOIN ip USING (x) GROUP BY ALL HAVING count(*) >= any_value(needed)),
        laid AS (SELECT doc_id, item_id, shift, n.size, n.needed, k, CASE WHEN d.w[k + shift + 1] = n.w[k + 1] THEN 1 ELSE -1 END AS v
            FROM line JOIN d USING (doc_id) JOIN n USING (item_id), LATERAL (SELECT unnest(generate_series(greatest(0, -shift), least(n.size, len(d.w) - shift) - 1)) AS k)),
        total AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS t FROM laid),
        low AS (SELECT *, least(0, coalesce(min(t) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS m FROM total),
        ends AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY t - m DESC, k) AS rn FROM low),
        e AS (SELECT * FROM ends WHERE rn = 1 AND t - m > 0),
        s AS (SELECT e.doc_id, e.item_id, e.shift, any_value(e.size) AS size, any_value(e.needed) AS needed, any_value(e.k) + 1 AS stop, any_value(e.t - e.m) AS gain,
            CASE WHEN any_value(e.m) = 0 THEN greatest(0, -e.shift) ELSE min(l.k) FILTER (WHERE l.t = e.m) + 1 END AS start
            FROM e LEFT JOIN low l ON l.doc_id = e.doc_id AND l.item_id = e.item_id AND l.shift = e.shift AND l.k < e.k GROUP BY e.doc_id, e.item_id, e.shift),
        found AS (SELECT doc_id, item_id, shift, start + shift AS start, stop - start AS n_span, CAST((stop - start + gain) / 2 AS BIGINT) AS n_matched, size, needed FROM s)
        SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(n_span AS BIGINT) AS n_span, n_matched, CAST(size AS BIGINT) AS n_words
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, shift) AS best FROM found WHERE n_matched >= needed) WHERE best = 1""",
    "op8_sharding": r"""
        WITH RECURSIVE e AS (SELECT unnest(generate_series(0, 255)) AS i, unnest(generate_series(0, 255)) AS c, 0 AS k UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END, k + 1 FROM e WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM e WHERE k = 8),
        d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        sums AS (SELECT doc_id, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), CAST(4294967295 AS BIGINT)) AS crc FROM d, crc),
        j AS (SELECT doc_id, n, CAST(CASE WHEN doc_id < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE doc_id END AS HUGEINT) AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM d, (SELECT unnest([24, 25]) AS n)
          UNION ALL SELECT doc_id, n, (k * 2862933555777941757 + 1) % 18446744073709551616, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / (CAST(((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 AS DOUBLE) + 1))) AS BIGINT) FROM j WHERE j < n),
        f AS (SELECT doc_id, CAST(max(b) FILTER (WHERE n = 24) AS INTEGER) AS shard, CAST(max(b) FILTER (WHERE n = 25) AS INTEGER) AS grown_shard FROM j GROUP BY doc_id)
        SELECT f.doc_id, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY f.doc_id) - 1 AS slot, grown_shard FROM f JOIN sums USING (doc_id)""",
    "op11_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w),
        p AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.a = s.doc_id""",
    "op12_lexical_search": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        a AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), a),
        s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), a GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op13_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
        g AS (SELECT lang, 1 AS k, unnest(w) AS x FROM p
          UNION ALL SELECT lang, 2, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM p
          UNION ALL SELECT lang, 3, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p),
        f AS MATERIALIZED (SELECT lang, k, x AS phrase, count(*) AS f FROM g GROUP BY ALL),
        c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
        often AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 10),
        longer AS (SELECT lang, x, max(a) AS longest FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS x FROM c WHERE k = 3) GROUP BY ALL),
        cuts AS (SELECT lang, k, phrase, a, 1 AS i, w[1] AS lp, CASE WHEN k = 2 THEN w[2] ELSE w[2] || ' ' || w[3] END AS rp FROM c
          UNION ALL SELECT lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
        s AS (SELECT cuts.lang, cuts.k, cuts.phrase, a, i, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
          FROM cuts JOIN often x ON x.lang = cuts.lang AND x.phrase = lp JOIN often y ON y.lang = cuts.lang AND y.phrase = rp),
        worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, i) AS o FROM s) WHERE o = 1),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        ranked AS (SELECT worst.*, row_number() OVER (PARTITION BY worst.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
          FROM worst LEFT JOIN longer ON longer.lang = worst.lang AND longer.x = worst.phrase AND worst.k = 2 WHERE longest IS NULL OR 100 * longest < 50 * a)
        SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000""",
    "op10_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100""",
}
