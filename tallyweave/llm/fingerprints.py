"""Threshold-scaled document sketches, in DataFrame operations only.

A sketch keeps every distinct shingle hash that lies below a fixed share of the hash range (one in 2**SCALE_BITS), and
no other. As the threshold is the same for all, the union of two sketches is the sketch of both texts, and the share of
one sketch found in another estimates containment however unequal the two documents are. A text of few shingles may
keep none; such a sketch says nothing of how alike it is to another, and likeness() falls back on equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, shared_dir, table, text_of

SHINGLE = 5
#: Half of the hashes: short texts need many, and a text's sketch still has fewer numbers than the text has words.
SCALE_BITS = 1
HEX = 8
#: Rows in a range of ids in which a document's neighbour is looked up.
RANGE_ROWS = 250_000


def with_sketch(df: DataFrame, text: Column, name: str, shingle: int = SHINGLE, scale_bits: int = SCALE_BITS) -> DataFrame:
    """df with `name`: the sorted array of the text's retained hashes, their 32 bits below the threshold's as int.

    Words are what white space parts, in lower case. A text of fewer words than a shingle has one shingle: all of
    them. A null text is empty. The order is that of unsigned numbers; `name` replaces a column of that name.
    """
    w, h = scratch("words"), scratch("hashes")
    df = df.withColumn(w, F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), ""))
    rolled = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(shingle)]))
    df = df.withColumn(h, F.when(F.size(w) >= shingle, rolled).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<long>")))
    low = F.filter(h, lambda x: F.shiftrightunsigned(x, 64 - scale_bits) == 0) if scale_bits else F.col(h)
    # 32 bits as a number from 0 sort by value, and as an int (a shift of the sign) they take half the room.
    short = lambda x: (F.shiftrightunsigned(x, 64 - 32 - scale_bits).bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")
    return df.withColumn(name, F.array_sort(F.array_distinct(F.transform(low, short)))).drop(w, h)


def sketch_text(sketch: Column) -> Column:
    """A sketch as a string: 8 hex digits for each hash, in order."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x.cast("long") + F.lit(1 << 31)), HEX, "0"))), "")


def merge(a: Column, b: Column) -> Column:
    """The sketch of two documents taken together."""
    return F.array_sort(F.array_union(a, b))


def contained(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a in an empty b, 0 for an empty a in any other."""
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def likeness(a: Column, b: Column, same: Column | None = None) -> Column:
    """Containment of the smaller sketch in the larger one, 0 to 1.

    An empty sketch, of a text without words or with too few to keep a hash, allows no estimate: then 1 if the texts
    are the `same` (or, where that is not said, both sketches are empty) and else 0.
    """
    some = F.when(F.size(a) <= F.size(b), contained(a, b)).otherwise(contained(b, a))
    return some if same is None else F.when((F.size(a) == 0) | (F.size(b) == 0), same.cast("double")).otherwise(some)


def next_in_order(keys: DataFrame) -> DataFrame:
    """keys (doc_id, h, n), unique in (doc_id, h), with (next_id, next_h): the one after it in descending order, the first one after the last.

    Keys are dealt to ranges of about RANGE_ROWS rows by their order, so a task orders one range, whatever ids repeat;
    the first key of each range (one row a range) closes the gaps between them. Null ids come last.
    """
    shared_dir(keys.sparkSession)
    ranges = max(keys.sparkSession.sparkContext.defaultParallelism, -(-keys.count() // RANGE_ROWS))
    order = (F.desc_nulls_last("doc_id"), F.desc("h"))
    # Ranges are drawn at cuts that Spark samples; the checkpoint keeps both uses of them the same.
    keys = keys.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()).checkpoint()
    key = F.struct("doc_id", "h")
    firsts = keys.groupBy("range").agg(F.max(key).alias("first"))
    ring = Window.orderBy("range")
    gaps = firsts.select("range", F.coalesce(F.lead("first").over(ring), F.first("first").over(ring)).alias("after"))
    inside = F.lead(key).over(Window.partitionBy("range").orderBy(*order))
    out = keys.withColumn("inside", inside).join(F.broadcast(gaps), "range").withColumn("next", F.coalesce("inside", "after"))
    return out.select("doc_id", "h", "n", F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Sketches of every text, of its edited form and of its neighbour: doc_id, text, n_chars, edited, sketch, edited_sketch, next_sketch, next_same.

    The edited form takes the first floor(n_chars / 3) code points of the next document (by descending doc_id, ties
    by the text's hash) in place of its own last ones. Rows equal in id and text share one neighbour and one result
    each; null texts are empty; a lone document is its own neighbour (next_same: whether the texts are equal); an empty
    table has no rows, and other columns are not looked at. The ids alone are ordered; a text is dealt once by its key,
    and of a neighbour only the needed prefix and the sketch move on.
    """
    # Keys without nulls, the same in every step, so that rows once dealt by them need not move again.
    named = lambda c, to: (F.coalesce(F.col(c), F.lit(0)).alias(f"{to}_id"), F.col(c).isNull().alias(f"{to}_null"))
    key = lambda to: [f"{to}_id", f"{to}_null", f"{to}_h"]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    keys = base.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).groupBy("doc_id", "h").agg(F.max("n").alias("n"))
    asked = next_in_order(keys).select(*named("next_id", "own"), F.col("next_h").alias("own_h"), *named("doc_id", "for"), F.col("h").alias("for_h"), F.floor(F.col("n") / 3).cast("int").alias("need"))
    # Both uses take the same columns, so the texts are dealt once. A sketch is made where it is used: sent along with
    # the text it would be a third of what is moved.
    own = base.select("text", *named("doc_id", "own"), F.xxhash64("text").alias("own_h"))
    met = with_sketch(own.join(asked, key("own")), F.col("text"), "sketch")
    lent = met.select(*key("for"), F.struct(F.substring("text", F.lit(1), F.col("need")).alias("prefix"), F.col("sketch").alias("next_sketch"), F.col("own_h").alias("next_h")).alias("lent"))
    lent = lent.groupBy(*key("for")).agg(F.first("lent").alias("lent"))  # copies of the neighbour lend the same
    both = own.join(lent.select(*[F.col(f).alias(o) for f, o in zip(key("for"), key("own"), strict=True)], "lent"), key("own"))
    n = F.length("text")
    both = both.select(
        F.when(~F.col("own_null"), F.col("own_id")).alias("doc_id"), "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("lent.prefix")).alias("edited"),
        F.col("lent.next_sketch").alias("next_sketch"), (F.col("lent.next_h") == F.col("own_h")).alias("next_same"),
    )
    return with_sketch(with_sketch(both, F.col("text"), "sketch"), F.col("edited"), "edited_sketch")


def compared(docs: DataFrame) -> DataFrame:
    """Per row of docs: its size, the edited text's digest, both fingerprints, and its likeness to the edited text and to the next document."""
    d = compare_edited(docs)
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch_text(F.col("sketch")).alias("fingerprint"), sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch"), F.col("next_same")).alias("near_next"),
    )


def op6_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of documents, its edited text, and its likeness to that and to the next document."""
    return compared(table(spark, sf_dir, "documents").select("doc_id", "text"))
