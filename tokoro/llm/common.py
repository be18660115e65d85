"""What several operators share: the scratch folder, written tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokoro.storage import scratch as shared_dir  # noqa: F401  the one scratch folder of the library

#: Python operators work on slices of at most this many rows and, beyond a row, bytes of
#: Spark's Arrow batches (which Spark itself bounds by rows and bytes).
SLICE_ROWS, SLICE_BYTES = 256, 8 << 20


def written(df: DataFrame, at: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut."""
    df.write.parquet(at, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut small, so that what a worker makes of one is bounded; the
    session's own batch settings stay as they are."""
    for batch in batches:
        at, n = 0, rows
        while at < batch.num_rows:
            part = batch.slice(at, n)
            if n > 1 and part.nbytes > SLICE_BYTES:
                n = max(1, n // 2)
                continue
            yield part
            at, n = at + part.num_rows, rows


def map_arrow(df: DataFrame, make: Callable, schema, rows: int = SLICE_ROWS) -> DataFrame:
    return df.mapInArrow(lambda batches: make(slices(batches, rows)), schema)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text, null as empty; further columns don't reach the workers."""
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot from this share of a table's rows on: there are at most so many hot keys,
#: and a task is dealt about this share of one key.
HOT_KEYS = 4096


def spread_join(left: DataFrame, right: DataFrame, key: str, size: str, total: int, by: str, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key, whatever share of ``left`` a
    key has.

    ``size`` (a column of ``right``, dropped) counts the key's rows in ``left``, which has
    ``total``. Rows of a hot key are dealt to as many places as the key is times over the
    share, by column ``by`` and partition, and the key's row of ``right`` goes to each; how
    many, ``left`` knows from a broadcast of at most ``HOT_KEYS`` rows. Rows without a key
    meet nothing and are dealt out as well. ``right`` grows with the data and is never
    broadcast, so that the plan is one at every size.
    """
    least = max(1, -(-total // HOT_KEYS))
    right = right.where(F.col(key).isNotNull()).withColumn("_places", F.greatest(F.lit(1), F.ceil(F.col(size) / least)).cast("int")).drop(size)
    hot = right.where("_places > 1").select(key, "_places")
    places = F.when(F.col(key).isNull(), HOT_KEYS).otherwise(F.coalesce("_places", F.lit(1)))
    place = F.pmod(F.xxhash64(by, F.spark_partition_id()), places).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_place", place).drop("_places")
    every = right.withColumn("_place", F.explode(F.sequence(F.lit(0), F.col("_places") - 1))).drop("_places")
    return dealt.join(every.hint("shuffle_merge"), [key, "_place"], how).drop("_place")


def ranked(rows: DataFrame, order: list, at: str) -> DataFrame:
    """Rows with their gapless position (from 0) in an order, by range partitions and the
    place inside them; what comes before a partition is joined to it by its number."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("_place", F.monotonically_increasing_id()), at)
    dealt = dealt.withColumn("_part", F.shiftright("_place", 33))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("_part", before.alias("_base"))
    place = F.col("_base") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return dealt.join(F.broadcast(bases), "_part").withColumn("position", place).drop("_part", "_place", "_base")


_HELD: dict = {}


def held_alone(name, make: Callable):
    """A worker's large state by name: a model, a coder, a table. A worker holds one at a
    time, so that what a stage of a pipeline leaves behind goes when the next one begins."""
    if _HELD.get("name") != name:
        let_go()
        _HELD["value"] = make()
        _HELD["name"] = name
    return _HELD["value"]


def let_go() -> None:
    """Drop what an earlier stage left in this worker, and return it to the system."""
    if _HELD:
        _HELD.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system; allocators keep what the largest batches took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a GNU function
    if trim is not None:
        trim(0)


class WorkerCache(dict):
    """Values by key, made on demand, in two generations, each of at most ``limit`` entries
    and ``limit_bytes`` bytes of keys and values.

    When the young generation is full it becomes the old one, so that memory is bounded
    while keys in steady use stay. A key of over ``LONG`` bytes or characters is never
    kept: it is seldom met again, and texts without spaces are one such key each.
    """

    LONG = 1 << 10

    def __init__(self, make: Callable, limit: int, limit_bytes: int = 48 << 20):
        super().__init__()
        self.make, self.limit, self.limit_bytes = make, limit, limit_bytes
        self.old, self.held = {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        size = (len(key) if isinstance(key, (bytes, str)) else 16) + (len(value) if isinstance(value, (bytes, str)) else 8)
        if size > self.LONG:
            return value
        if len(self) >= self.limit or self.held > self.limit_bytes:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += size
        return value
