"""Document fingerprints of closed syncmers, in SQL functions alone.

Words are what blanks divide; each letter of a script without blanks is a word of its own, and so is each character of a text
of fewer than K words. K words in a row are an anchor if the smallest hash of the S-word runs inside them lies at either edge. Whether it does
follows from these K words and nothing around them, so equal passages have equal anchors wherever they stand. A
fingerprint keeps all of them, each hash with its first place, and two are compared by how many they share at one
displacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from epistola.llm._store import among, bucket_of, constants, range_bounds

K, S = 5, 2
#: Bytes of text in a range of documents.
RANGE_BYTES = 8 << 20
#: Bits of a packed anchor that hold its place, and words by which places may differ from the common displacement.
PLACE_BITS, SLACK = 24, 64
_BLANKS = "\t\n\x0b\x0c\r"
#: Letters of scripts that are written without blanks: Thai, Lao, Burmese, Khmer, kana and Chinese letters. Ranges are told faster than scripts.
_ALONE = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"


def add_anchors(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: packed anchors in ascending order, one for each hash.

    A text too short to have an anchor has one of all of it; an empty text has none. text must not be null. A hash that comes
    again is kept once, at its first place. Places of words beyond 2**PLACE_BITS begin anew at 0.
    """
    b, w, h, g, a = (f"{name}_{x}" for x in "bwhga")
    # One column a step, so that none is worked out twice.
    rows = rows.withColumn(b, F.translate(text, _BLANKS, " " * len(_BLANKS)))
    rows = rows.withColumn(b, F.when(F.col(b).rlike(_ALONE), F.regexp_replace(b, _ALONE, " $0 ")).otherwise(F.col(b)))
    rows = rows.withColumn(w, F.split(b, " "))
    rows = rows.withColumn(w, F.when(F.size(w) < K, F.split(F.col(text), "")).otherwise(F.col(w)))
    rows = rows.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    rows = rows.withColumn(g, F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))))
    inner = K - S  # the last place of an S-word run
    edge = lambda i: F.least(F.get(g, i), F.get(g, i + inner)) <= F.least(*[F.get(g, i + j) for j in range(1, inner)])
    pack = lambda hashed, place: F.shiftleft(F.shiftright(hashed, PLACE_BITS), PLACE_BITS).bitwiseOR(place.cast("long").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    found = F.filter(F.sequence(F.lit(0), F.size(h) - K), edge)
    packed = F.transform(found, lambda i: pack(F.xxhash64(F.get(g, i), F.get(g, i + 2), F.get(h, i + 4)), i))
    rows = rows.withColumn(a, F.when(F.size(h) >= K, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    first = F.filter(a, lambda x, i: (i == 0) | (F.shiftright(x, PLACE_BITS) != F.shiftright(F.get(a, i - 1), PLACE_BITS)))
    whole = F.when(F.col(text) == "", F.array().cast("array<bigint>")).otherwise(F.array(pack(F.xxhash64(text, F.lit(K)), F.lit(0))))
    return rows.withColumn(name, F.when(F.size(a) > 0, first).otherwise(whole)).drop(b, w, h, g, a)


def as_text(anchors: str) -> Column:
    """Sixteen hexadecimal digits for each anchor."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def add_likeness(rows: DataFrame, one: str, other: str, name: str) -> DataFrame:
    """Adds `name`, 0 to 1: of the hashes of either fingerprint, the share that both have, at places that differ by the median displacement, give or take SLACK words.

    Two fingerprints without anchors are alike (1); one without is unlike any with anchors (0).
    """
    merged, both, middle = f"{name}_m", f"{name}_b", f"{name}_d"
    tagged = lambda c, side: F.transform(c, lambda v: F.struct(F.shiftright(v, PLACE_BITS).alias("h"), F.lit(side).alias("side"), v.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place")))
    rows = rows.withColumn(merged, F.sort_array(F.concat(tagged(one, 0), tagged(other, 1))))
    at = lambda i, part: F.get(merged, i)[part]
    # A hash is once in a fingerprint, so one of both stands beside itself.
    shared = F.filter(F.sequence(F.lit(0), F.size(merged) - 1), lambda i: at(i, "h") == at(i + 1, "h"))
    rows = rows.withColumn(both, F.sort_array(F.transform(shared, lambda i: at(i, "place") - at(i + 1, "place"))))
    rows = rows.withColumn(middle, F.get(both, F.floor(F.size(both) / 2).cast("int")))
    agreed = F.size(F.filter(both, lambda d: (d >= F.col(middle) - SLACK) & (d <= F.col(middle) + SLACK)))
    return rows.withColumn(name, F.when(F.size(merged) == 0, F.lit(1.0)).otherwise(agreed / (F.size(merged) - F.size(both)))).drop(merged, both, middle)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, anchors and those of the next row in ascending order of the id, the first row's after the last.

    Rows are dealt out by ranges of the id, with the first row of the following range after each: no task holds more than a
    range. Null ids come first; equal ids are ordered by their text; null texts are empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    bounds, _ = range_bounds(rows, "doc_id", F.octet_length("text") + 64, RANGE_BYTES)
    rows = rows.withColumns({"k": key, "bucket": bucket_of(F.col("doc_id"), bounds)})
    least = {r["bucket"]: r["k"] for r in rows.groupBy("bucket").agg(F.min("k").alias("k")).collect()}  # one a range
    used = sorted(least)
    before = dict(zip(used, [used[-1], *used[:-1]])) if used else {}
    heads = rows.where(among(F.col("k"), list(least.values()))).groupBy("bucket", "doc_id", "k").agg(F.min("text").alias("text"))
    heads = heads.withColumn("bucket", F.get(constants([before.get(i, 0) for i in range(len(bounds) + 1)]), F.col("bucket")).cast("int"))
    marked = rows.withColumn("mark", F.lit(0)).unionByName(heads.withColumn("mark", F.lit(1)))
    marked = add_anchors(marked.repartitionById(len(bounds) + 1, F.col("bucket")), "text", "anchors")
    w = Window.partitionBy("bucket").orderBy("mark", "k", "text")
    return marked.withColumns({"next_text": F.lead("text").over(w), "next_anchors": F.lead("anchors").over(w)}).where("mark = 0").drop("mark", "k", "bucket")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the last half of the code points replaced by the first as many, or all, of the next row's text. No
    rows give no rows; a single row is its own next.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("text", "next_text")
    rows = add_anchors(rows, "edited", "edited_anchors").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    rows = add_likeness(rows, "anchors", "edited_anchors", "near_edited")
    rows = add_likeness(rows, "anchors", "next_anchors", "near_next")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text("anchors").alias("fingerprint"), as_text("edited_anchors").alias("edited_fingerprint"), "near_edited", "near_next")
