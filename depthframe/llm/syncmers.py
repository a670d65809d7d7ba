"""Document fingerprints from closed syncmers, in column expressions only.

A k-mer is K words in a row; its inner substrings are the pairs of neighbouring words in
it. It is kept if the smallest of their hashes is that of the first or of the last pair.
Whether a k-mer is kept depends on its own words alone, so equal passages give equal
anchors wherever they stand, and of any K - 1 neighbouring k-mers at least one is kept.
K - 1 empty places before the first word and after the last one belong to the text, so that
texts of any length, down to none, have k-mers of the same kind.

``placed_anchors`` has the places that positional matching needs; ``likeness`` compares sets
of anchors and not their places, so passages in another order are as like.

Defined results: a null text counts as empty. A text without words has one empty word, so
equal texts have equal fingerprints and two blank texts are alike. Words are what white
space parts; a text without white space is one word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 5
#: Bytes of text in a bucket of neighbouring documents, about, and buckets in a partition.
BUCKET_BYTES, BUCKETS = 4 << 20, 16
#: Stretches of ids with about as many rows each. Buckets are even parts of these; their number follows the size of the texts.
KNOTS = 256


def _let(value: Column, body) -> Column:
    """Evaluates value once, for all uses in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kept(x: Column, i: Column, pairs: Column) -> Column:
    b, c, d = (F.get(pairs, i + j) for j in (1, 2, 3))
    return (x <= F.least(b, c, d)) | (d <= F.least(x, b, c))


def _scan(text: Column, of_kmer) -> Column:
    words = F.split(F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f\v")), r"\s+")
    edge = F.array(*[F.lit(0).cast("long")] * (K - 1))

    def pairs(h: Column) -> Column:
        return _let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))), lambda m: kept(h, m, F.size(h)))

    def kept(h: Column, m: Column, n: Column) -> Column:
        found = F.transform(m, lambda x, i: F.when((i <= n - K) & _kept(x, i, m), of_kmer(F.xxhash64(x, F.get(m, i + 2), F.get(h, i + (K - 1))), i)))
        return F.filter(found, lambda x: x.isNotNull())

    return _let(F.concat(edge, F.transform(words, lambda w: F.xxhash64(w)), edge), pairs)


def anchors(text: Column) -> Column:
    """The hashes of the kept k-mers in the order of the text: array<long>."""
    return _scan(text, lambda h, i: h)


def placed_anchors(text: Column) -> Column:
    """The same with the number of the first word (below 0 for empty places): array<struct<word:int, hash:long>>, for positional matching."""
    return _scan(text, lambda h, i: F.struct((i - (K - 1)).alias("word"), h.alias("hash")))


def as_text(found: Column) -> Column:
    """A fingerprint as a string: eight hexadecimal digits for each anchor."""
    return F.array_join(F.transform(found, lambda h: F.substring(F.hex(h.bitwiseOR(F.lit(-1 << 63))), 9, 8)), "")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard index of two sets of anchors."""
    return _let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both))


def _bucket(doc_id: Column, bounds: list[int], each: int) -> Column:
    """A bucket that never falls as the id rises: the stretch between two bounds, in even parts. Null ids are before all others."""
    if len(bounds) < 2:
        return F.when(doc_id.isNull(), -1).otherwise(0).cast("long")
    edges = F.array(*map(F.lit, bounds))
    knot = F.greatest(F.lit(0), F.least(F.lit(len(bounds) - 2), F.size(F.filter(edges, lambda b: b < doc_id)) - 1))
    low, high = F.get(edges, knot).cast("double"), F.get(edges, knot + 1).cast("double")
    part = F.floor((doc_id.cast("double") - low) / (high - low) * each)
    return F.when(doc_id.isNull(), -1).otherwise(knot * each + F.greatest(F.lit(0), F.least(F.lit(each - 1), part))).cast("long")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, knots: int = KNOTS) -> DataFrame:
    """doc_id, text and next_text, the text of the next document by id (after the last: the first).

    One shuffle of the texts, into buckets of neighbours; no window needs more than one. The last
    row of a bucket gets the first text of the next bucket by a join on buckets, so nothing
    that grows with their number goes to the driver. Null ids come first; rows of the same id
    come in the order of their texts.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    row = src.agg(F.sum(F.octet_length("text").cast("long")).alias("size"), F.percentile_approx("doc_id", [i / knots for i in range(knots + 1)], 100 * knots).alias("bounds")).first()
    n = max(1, math.ceil((row["size"] or 0) / bucket_bytes))
    bounds = sorted(set((row["bounds"] or [])[:: max(1, knots // n)] + (row["bounds"] or [])[-1:]))
    each = max(1, math.ceil(n / max(1, len(bounds) - 1)))
    src = src.withColumn("bucket", _bucket(F.col("doc_id"), bounds, each))
    dealt = src.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / BUCKETS)), "bucket")
    inside = dealt.withColumn("next_text", F.lead("text").over(Window.partitionBy("bucket").orderBy("doc_id", "text")))
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "text"))["text"].alias("first_text"))
    # The bucket before each one: within its stretch of ids, else the last one of the stretches before; of the first bucket it is the last one of all.
    used = src.select("bucket", F.floor(F.col("bucket") / each).alias("knot")).distinct()
    tops = used.groupBy("knot").agg(F.max("bucket").alias("top"))
    order = Window.orderBy("knot")
    tops = tops.select("knot", F.coalesce(F.lag("top").over(order), F.max("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("top"))
    before = used.join(tops, "knot").select("bucket", F.coalesce(F.lag("bucket").over(Window.partitionBy("knot").orderBy("bucket")), F.col("top")).alias("before"))
    nexts = firsts.join(before, "bucket").select(F.col("before").alias("bucket"), "first_text")
    return inside.join(nexts, "bucket").select("doc_id", "text", F.coalesce("next_text", "first_text").alias("next_text"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit: the second half replaced by the beginning of the next text.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), anchors(F.col("text")).alias("a"), anchors(F.col("edited")).alias("e"), anchors(F.col("next_text")).alias("x"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("x")).alias("near_next"))
