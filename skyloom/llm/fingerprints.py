"""Threshold-scaled fingerprints.

A text's fingerprint holds every five-word shingle hash below a fixed fraction
of the hash range, and always the smallest one, so that a short text has a
fingerprint too.  The fraction is the same for all texts: fingerprints of very
unequal texts can be compared, and the fingerprint of a union is the union of
the fingerprints.  Likeness is the estimated containment of the smaller in the
larger.

The next document is found among narrow rows (id, hash of the text), sorted in
ranges of even size; texts only move by hash, each once as a whole and once as
the part that the document before it needs, so no task grows with the table.

Words are split at ASCII white space as written.  Edge cases: a text of one to
four words has the whole sequence as its shingle; a null, empty or white-space
text has an empty fingerprint, like 1 to another empty one and 0 to any other;
ids are ordered as their own type orders them; rows of one id, or without id
(which come last), follow each other in order of a hash of the text; rows equal in both are one
key with copies, each copy the next of the one before; a single row is its own next document; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import bind, partitions_for, stored, table, text_or_empty

WORDS = 5
#: One of so many hashes is kept.
SCALE = 8
#: Rows (id and hash) of a sorted range, about.
RANGE_ROWS = 2_000_000
#: Bytes of text that one task joins, on average.
PART_BYTES = 64 << 20
KEY = ["id_key", "no_id", "rank"]


def sketch(text: Column) -> Column:
    """Sorted distinct hashes of the fingerprint (non-negative longs)."""
    limit = F.lit((1 << 63) // SCALE)

    def shingles(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WORDS)]).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))
        one = F.array(F.xxhash64(F.array_join(w, " ")).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))
        return F.when(n >= WORDS, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))

    def kept(hashes: Column) -> Column:
        # the sign bit is dropped; a fixed fraction of the remaining range is kept
        return bind(F.filter(hashes, lambda h: h < limit), lambda below: F.when((F.size(below) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(F.array_sort(F.array_distinct(below))))

    # white space at either end leaves an empty word; inner runs leave none
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    return bind(bind(words, shingles), kept)


def merge(a: Column, b: Column) -> Column:
    """The fingerprint of all shingles of two texts."""
    both = F.array_sort(F.array_union(a, b))
    limit = F.lit((1 << 63) // SCALE)
    below = F.filter(both, lambda h: h < limit)
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the smaller set in the larger, 0 to 1."""
    least = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(shared)


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def keyed(docs: DataFrame) -> DataFrame:
    """text and the columns ``KEY``: the id as text, whether it is null, and a hash of the text."""
    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    return rows.select("text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("rank"))


def _id(kind: str) -> Column:
    """The id of a key."""
    return F.when(~F.col("no_id"), F.col("id_key").cast(kind))


def neighbours(rows: DataFrame, kind: str) -> tuple[DataFrame, int]:
    """Of every key of ``keyed`` rows: its copies, and ``before``: the key before it by descending
    id (before the first: the last one) with its characters; and the bytes of all texts.

    Sorted in ranges; the first key of a range takes the last one of the range before it.
    """
    narrow = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.max(F.char_length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))
    narrow = stored(narrow, "neighbour-keys")
    keys, size = narrow.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    order = [_id(kind).desc_nulls_last(), F.col("rank")]
    width = max(partitions_for(rows.sparkSession), keys // RANGE_ROWS)
    ranged = narrow.repartitionByRange(width, *order).sortWithinPartitions(*order)
    placed = stored(ranged.select(*KEY, "copies", "chars", F.monotonically_increasing_id().alias("place")), "neighbour-places")
    placed = placed.withColumn("range", F.shiftright("place", 33)).withColumn("self", F.struct(*KEY, "chars"))
    lasts = placed.groupBy("range").agg(F.max_by("self", "place").alias("last"))
    # one row for each range
    final = F.last("last").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lasts = lasts.select("range", F.coalesce(F.lag("last").over(Window.orderBy("range")), final).alias("outer"))
    inner = F.lag("self").over(Window.partitionBy("range").orderBy("place"))
    found = placed.withColumn("inner", inner).join(F.broadcast(lasts), "range").select(*KEY, "copies", F.coalesce("inner", "outer").alias("before"))
    return stored(found, "neighbours"), size or 0


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, own fingerprint, and of the next row by descending doc_id (of the first one after the last)
    ``part``: its first floor(n_chars / 2) code points, n_chars being this text's, and ``following``: its fingerprint.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed(docs)
    near, size = neighbours(rows, kind)
    # both sides of the join below need the same columns of the texts, so that they are moved once
    dealt = rows.repartition(max(partitions_for(docs.sparkSession), size // PART_BYTES), *KEY)
    known = dealt.join(near, KEY).withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("copies")))
    needed = F.floor(F.col("before.chars") / 2).cast("int")
    answers = known.where("place = 1").select(*[F.col(f"before.{c}").alias(c) for c in KEY], F.substring("text", F.lit(1), needed).alias("part"), sketch(F.col("text")).alias("following"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    # of copies each is the next of the one before, and the last one has the next key
    last = F.col("place") == F.col("copies")
    both = known.join(answers, KEY).withColumn("own", sketch(F.col("text")))
    return both.select(_id(kind).alias("doc_id"), "text", "own", F.when(last, F.col("part")).otherwise(F.substring("text", F.lit(1), half)).alias("part"), F.when(last, F.col("following")).otherwise(F.col("own")).alias("following"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint (array of longs) of every row."""
    return docs.select("doc_id", sketch(text_or_empty(F.col("text"))).alias("fingerprint"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next one, with likenesses."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    rows = rows.select("doc_id", "n_chars", "own", "following", F.concat(kept, "part").alias("edited"))
    made = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", sketch(F.col("edited")).alias("other"), "following")
    return made.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))
