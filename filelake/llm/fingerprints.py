"""Document fingerprints by winnowing, in DataFrame expressions only.

A text's k-grams of characters get rolling hashes, polynomials over GF(2) of 64-bit hashes of the characters: the hash of
2m characters is that of the first m, shifted by m bits, xor that of the next m, so all k-grams are hashed in log2(k) passes
over an array. The upper 32 bits count, on which all of up to 32 characters bear. Of every window of w successive hashes the smallest is selected, of equal ones the
rightmost, by minima over 2, 4, 8, ... hashes; selections keep their positions. Two texts that share
w + k - 1 characters in a row share a selection, whatever stands around them.

A selection is one long: 32 bits of hash above 31 bits of (2^31 - 1 - position), so that the least
long is the least hash and, among equal ones, the rightmost. Texts of more than ``BLOCK`` characters are hashed block by
block with an overlap, so scratch arrays stay small however long a text is.

Nulls are empty texts, which have an empty fingerprint; a text shorter than k is padded with zero hashes to
one k-gram, one with fewer than w k-grams is one window.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, table

#: Characters of a k-gram and k-grams of a window, powers of two: shared runs of 47 characters are never missed, six of a hundred positions are kept.
K, W = 16, 32
BLOCK = 1 << 16
LAST = (1 << 31) - 1


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def _joined(h: Column, m: int) -> Column:
    """Hashes of 2m characters from those of m; what stands beyond the end is null."""
    return F.transform(h, lambda x, i: F.shiftleft(x, m).bitwiseXOR(F.get(h, i + F.lit(m))))


def _hashes(chars: Column, k: int) -> Column:
    """Hashes of the k-grams of an array of characters, at least one; nulls fill the array up to its length."""
    out, size = F.transform(chars, lambda c: F.xxhash64(c)), 1
    out = _let(out, lambda h: F.when(F.size(h) >= k, h).otherwise(F.concat(h, F.array_repeat(F.lit(0).cast("long"), k - F.size(h)))))
    while size < k:
        out, size = _let(out, partial(_joined, m=size)), 2 * size
    return out


def _least(m: Column, size: int) -> Column:
    """Minima of 2 size keys from those of size; what stands beyond the end is left out."""
    return F.transform(m, lambda x, i: F.least(x, F.get(m, i + F.lit(size))))


def _minima(keys: Column, k: int, w: int) -> Column:
    """The least key of each window of w keys, of all if there are fewer; the last k - 1 keys are null."""
    size, out = 1, keys
    while size < w:
        out, size = _let(out, partial(_least, size=size)), 2 * size
    return _let(out, lambda m: F.slice(m, 1, F.greatest(F.size(m) - (k + w - 2), F.lit(1))))


def _winnow_block(text: Column, start: Column | None, k: int, w: int) -> Column:
    """Selections of one block of text that begins at position ``start``, 0 without it."""
    place = lambda i: i.cast("long") if start is None else start + i
    # LAST less the place is LAST xor the place
    pack = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), 31).bitwiseOR(place(i).bitwiseXOR(F.lit(LAST).cast("long")))
    return F.array_distinct(_minima(F.transform(_hashes(F.split(text, ""), k), pack), k, w))


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """Selections of a text as array<long>, by position."""
    if k & (k - 1) or w & (w - 1) or not 1 <= k <= 32 or w < 1 or w + k > BLOCK:
        raise ValueError("k and w must be powers of two, k at most 32")
    over = w + k - 2
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def block(parts: Column, part: Column, i: Column) -> Column:
        # windows that begin in a block end in the first characters of the one behind it; the last needs a whole window
        whole = F.concat(part, F.coalesce(F.left(F.get(parts, i + F.lit(1)), F.lit(over)), F.lit("")))
        return F.when((i > 0) & (F.length(whole) <= over), F.array().cast("array<long>")).otherwise(_winnow_block(whole, i.cast("long") * BLOCK, k, w))

    long = _let(blocks, lambda parts: F.array_distinct(F.flatten(F.transform(parts, lambda part, i: block(parts, part, i)))))
    none = F.array().cast("array<long>")
    return F.when(F.coalesce(text, F.lit("")) == "", none).when(F.length(text) <= BLOCK, _winnow_block(text, None, k, w)).otherwise(long)


def hash_of(selection: Column) -> Column:
    return F.shiftright(selection, 31)


def position_of(selection: Column) -> Column:
    return F.lit(LAST) - selection.bitwiseAND(F.lit(LAST))


def selections(marks: Column) -> Column:
    """A fingerprint as array<struct<hash, position>>."""
    return F.transform(marks, lambda x: F.struct(hash_of(x).alias("hash"), position_of(x).alias("position")))


def as_text(marks: Column) -> Column:
    """A fingerprint as text: hashes in hex, each with its position."""
    return F.array_join(F.transform(marks, lambda x: F.concat(F.lpad(F.lower(F.hex(hash_of(x))), 8, "0"), F.lit("@"), position_of(x).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Common hashes of two fingerprints over all their hashes, whatever their positions; 1 where both are empty."""
    own, other = (F.array_distinct(F.transform(x, hash_of)) for x in (a, b))
    return _let(F.struct(own.alias("a"), other.alias("b")), lambda s: _share(s["a"], s["b"]))


def _share(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return _let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def _within(marks: Column, length: Column, k: int, w: int) -> Column:
    """Selections made by windows of a text's first ``length`` characters; ``marks`` must be a column, not an expression.

    A selection begins to count where it enters the window, if it is no greater than the one before it, else where that one leaves.
    """
    entered = lambda x, y: F.when(y.isNull(), F.lit(0)).when(hash_of(x) <= hash_of(y), position_of(x) - (w - 1)).otherwise(position_of(y) + 1)
    kept = F.filter(marks, lambda x, i: entered(x, F.get(marks, i - F.lit(1))) <= length - (w + k - 1))
    return F.when(length >= w + k - 1, kept).otherwise(F.array().cast("array<long>"))


def _moved(marks: Column, by: Column) -> Column:
    return F.transform(marks, lambda x: x - by.cast("long"))


def next_documents(docs: DataFrame) -> DataFrame:
    """(bucket, last, doc_id, text): documents dealt in ranges of descending ids.

    After each bucket's documents comes the first of the next one, marked ``last``, so that every document has the one
    that follows it in its own bucket; after the smallest id comes the largest. Only ids are sorted to find the ranges; where they are few they are
    broadcast to the texts, else texts are joined by hash. Rows of one id keep together.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id").distinct()
    n = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // 100_000)
    ranged = small(ids.repartitionByRange(n, F.col("doc_id").desc()).select("doc_id", F.spark_partition_id().alias("bucket")), 16)
    edges = ranged.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"))
    # the ranges are as many as the buckets, whatever the input
    w = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(w), F.max("bucket").over(Window.partitionBy()))
    ghosts = F.broadcast(edges.select(F.col("first.doc_id").alias("__first"), before.alias("__before")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.join(ranged.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")))
    placed = placed.join(ghosts, F.col("doc_id").eqNullSafe(F.col("__first")), "left")
    copies = F.filter(F.array(F.struct("bucket", F.lit(False).alias("last")), F.struct(F.col("__before").alias("bucket"), F.lit(True).alias("last"))), lambda x: x["bucket"].isNotNull())
    return placed.select(F.explode(copies).alias("at"), "doc_id", "text").select("at.bucket", "at.last", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of documents.

    The edited text ends with the beginning of the next document, by descending doc_id (rows of equal ids by text, null ids last). Windows of its first part are windows of the
    document, those of its second part windows of the next one: only the seam is hashed again, which gives what hashing the whole edited text gives.
    Columns besides doc_id and text are ignored; repeated rows follow each other; no rows give none.
    """
    none, over = F.array().cast("array<long>"), w + k - 2
    order = Window.partitionBy("bucket").orderBy("last", F.col("doc_id").desc_nulls_last(), "text")
    rows = next_documents(docs).withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("tail", F.left("next_text", F.col("half"))).withColumn("kept", (F.col("n_chars") - F.col("half")).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("kept")), F.col("tail")))
    seam = F.substr("edited", F.greatest(F.col("kept") - over, F.lit(0)) + 1, F.least(F.col("kept"), F.lit(over)) + over)
    rows = rows.select(
        "bucket", "last", "doc_id", "text", "n_chars", "kept", F.length("tail").alias("taken"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), k, w).alias("marks"), F.when(F.col("half") > 0, fingerprint(seam, k, w)).otherwise(none).alias("seam"),
    )
    rows = rows.withColumn("next_marks", F.coalesce(F.lead("marks").over(order), none)).where("not last").drop("text")
    rows = rows.withColumns({"head": _within(F.col("marks"), F.col("kept"), k, w), "rest": _within(F.col("next_marks"), F.col("taken"), k, w)})
    joined = F.array_distinct(F.concat("head", _moved(F.col("seam"), F.greatest(F.col("kept") - over, F.lit(0))), _moved(F.col("rest"), F.col("kept"))))
    rows = rows.withColumn("edited_marks", F.when(F.col("kept") == F.col("n_chars"), F.col("marks")).otherwise(joined))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("marks")).alias("fingerprint"), as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Documents with ``selections array<struct<hash, position>>``, map-only; a column of that name is replaced."""
    return docs.withColumn("selections", selections(fingerprint(F.coalesce("text", F.lit("")), k, w)))


def op11_fingerprints(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_fingerprints": op11_fingerprints}
ORACLES: dict[str, str] = {}
