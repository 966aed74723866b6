"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Labelled rows that a classifier is fitted on at most.
QUALITY_ROWS, TOXIC_ROWS = 20_000, 8_000


def held_out(doc_id: Column) -> Column:
    """Rows from which no label is ever learnt: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled documents, those of the least hashes of their ids.

    Held-out rows and null labels are left out; an id labelled twice counts with its larger label, and a document
    that repeats counts once, with the text of the least hash where its id has several. The ids chosen are at most
    `rows`, so they are broadcast.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)
    met = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    one = met.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", F.col("t.text").alias("text"), "y")
