"""Bounded samples of labelled documents for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id="doc_id"):
    """Rows whose labels no model may learn from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def usable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) that may be learnt from, one row for each id."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out())
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label, fold) of at most ``most`` labelled training ids of each class.

    The ids with the smallest hash are taken; a null id or label takes no part, of repeated
    ids the larger label counts. They are few enough to broadcast by that bound, so the
    texts aren't shuffled. Rows of documents that share an id come as they are; use
    ``one_text`` where each id may count once only.
    """
    by_hash = usable(labels, label).withColumn("at", F.xxhash64("doc_id"))
    one, zero = (by_hash.where(F.col("label") == k).orderBy("at", "doc_id").limit(most) for k in (1, 0))
    picked = one.unionByName(zero).select("doc_id", "label", F.pmod("at", F.lit(2)).cast("int").alias("fold"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label", "fold")


def one_text(rows: DataFrame) -> DataFrame:
    """One row for each id of a sample, that of the smallest text."""
    return rows.groupBy("doc_id", "label", "fold").agg(F.min("text").alias("text"))


def within_bytes(rows: DataFrame, most_bytes: int) -> DataFrame:
    """Of a written sample with one row an id, the rows of each class by hash of the id while
    their texts together have at most ``most_bytes`` bytes; whole texts or none.

    Texts of over a sixteenth of the bound come last, by size, so that a long one is left out
    alone and takes no other's place. If not even the first fits, it stands for its class
    with as many of its characters as do. Places are found from sizes alone.
    """
    size = F.octet_length("text")
    order = [F.when(size > most_bytes // 16, size).otherwise(0), F.xxhash64("doc_id"), F.col("doc_id")]
    sizes = rows.select("doc_id", "label", size.alias("_size"), F.struct(*order).alias("_order"))
    own = Window.partitionBy("label").orderBy("_order")
    upto = F.sum("_size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = sizes.select("doc_id", "label", upto.alias("_upto"), F.row_number().over(own).alias("_nth")).where(f"_upto <= {most_bytes} or _nth = 1")
    text = F.when(size > most_bytes, F.substring("text", 1, most_bytes // 4)).otherwise(F.col("text"))  # a character has 4 bytes at most
    return rows.join(F.broadcast(picked.select("doc_id", "label")), ["doc_id", "label"]).withColumn("text", text)


def class_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """Ids of label 0 and 1 that may be learnt from."""
    n = {r["label"]: r["count"] for r in usable(labels, label).groupBy("label").count().collect()}  # two rows
    return n.get(0, 0), n.get(1, 0)


def class_weights(labels: DataFrame, label: str, most: int) -> tuple[float, float]:
    """How many usable ids of label 0 and 1 stand behind each one that ``sample`` takes."""
    zero, one = class_counts(labels, label)
    return max(1.0, zero / most), max(1.0, one / most)
