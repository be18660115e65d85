"""Prefix joins as hash joins and look-ups in sorted blocks.

``text starts with key`` planned directly is a nested loop over all pairs. The prefixes of a
text (of the lengths that keys have) are made rows instead and joined by equality. Where the
keys are too large to broadcast, a bit map of them is sent instead, and only prefixes that
it lets through are dealt out.

``key starts with text`` is an interval of the sorted keys. These are kept in blocks, whose
first keys say by binary search which blocks a text's interval lies in.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokoro.config import BROADCAST_BYTES
from tokoro.storage import stored

#: What a row of a broadcast table takes beside its texts.
ROW_BYTES = 64
#: Bits a key in a bit map, positions set for each, and the most bits that are sent (16 MB);
#: with more keys than these have room for, more misses are let through.
KEY_BITS, PROBES, MOST_BITS = 16, 5, 1 << 27


@dataclass(frozen=True)
class Bloom:
    """A bit map of keys, as one row with an array of 64-bit words."""

    words: DataFrame
    bits: int

    def lets_through(self, columns: Sequence[str]) -> Column:
        """False only for what is no key; evaluated where the row is."""
        words = self.words.scalar()
        word = lambda at: F.element_at(words, F.shiftright(at, 6).cast("int") + 1)
        bit = lambda at: F.call_function("shiftright", word(at), at.bitwiseAND(63).cast("int")).bitwiseAND(1)
        return functools.reduce(Column.__and__, [bit(at) == 1 for at in positions(columns, self.bits)])


def positions(columns: Sequence[str], bits: int) -> list[Column]:
    """Where a key's bits are: sums of two hashes."""
    first, step = (F.xxhash64(*c).bitwiseAND((1 << 40) - 1) for c in (columns, [F.lit(1), *columns]))
    return [(first + k * step).bitwiseAND(bits - 1) for k in range(PROBES)]


def bloom(table: DataFrame, columns: Sequence[str], n: int) -> Bloom:
    """The bit map of a table's ``n`` keys, by one aggregation over words and one over the
    (bounded) map."""
    bits = 64
    while bits < min(MOST_BITS, n * KEY_BITS):
        bits *= 2
    at = F.explode(F.array(*positions(columns, bits)))
    words = table.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set"))
    every = table.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    row = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0)).alias("set")))), lambda x: x["set"]).alias("words"))
    return Bloom(stored(row), bits)


@dataclass(frozen=True)
class Lookup:
    """A table of keys with its keys' lengths; ``table`` bears a broadcast hint if small, else
    there is a bit map of it."""

    table: DataFrame
    shortest: int
    longest: int
    known: Bloom | None = None

    def possible(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """The rows that may have a key in the table."""
        return rows if self.known is None else rows.where(self.known.lets_through(columns))


def lookup(table: DataFrame, key: str = "key", most_bytes: int = BROADCAST_BYTES, columns: Sequence[str] | None = None) -> Lookup:
    """``columns``: those that are looked up, if more than the key."""
    n, size, low, high = table.agg(F.count("*"), F.sum(F.octet_length(key)), F.min(F.length(key)), F.max(F.length(key))).first()
    small = n * ROW_BYTES + (size or 0) <= most_bytes
    return Lookup(F.broadcast(table) if small else table, low or 0, high or 0, None if small else bloom(table, columns or [key], n))


def digits_meet(text: str, n: str):
    """Whether the cut after n characters falls between two digits."""
    return F.substring(text, F.col(n), F.lit(1)).rlike(r"[0-9]") & F.substring(text, F.col(n) + 1, F.lit(1)).rlike(r"[0-9]")


def prefix_join(texts: DataFrame, keys: Lookup, qid: str = "qid", text: str = "norm") -> DataFrame:
    """(qid, text, n, splits, key, ...): all rows of ``keys`` whose key a text begins with;
    ``splits``: a number would be split there."""
    longest = F.least(F.length(text), F.lit(keys.longest))
    lengths = F.when(longest >= keys.shortest, F.sequence(F.lit(keys.shortest), longest))
    cut = texts.select(qid, text, F.explode(lengths).alias("n")).withColumn("key", F.substring(text, F.lit(1), F.col("n")))
    return keys.possible(cut, ["key"]).join(keys.table, "key").withColumn("splits", digits_meet(text, "n"))


def longest_prefix(texts: DataFrame, keys: DataFrame, value: str) -> DataFrame:
    """(qid, n, value): the longest key that each text begins with, ties to the smaller
    value (an int)."""
    packed = F.max(F.shiftleft(F.col("n").cast("long"), 32) + (F.lit((1 << 31) - 1) - F.col(value)))
    best = prefix_join(texts, lookup(keys)).groupBy("qid").agg(packed.alias("_best"))
    return best.select("qid", F.shiftright("_best", 32).cast("int").alias("n"), (F.lit((1 << 31) - 1) - F.col("_best").bitwiseAND((1 << 31) - 1)).cast("int").alias(value))


#: Keys of a block, at least, and blocks, at most: their first keys are sent to every task.
BLOCK, MOST_BLOCKS = 256, 1 << 16
#: The last character there is: what begins with a text lies before the text and this.
LAST = "\U0010ffff"


@dataclass(frozen=True)
class SortedKeys:
    """Keys in order, cut into numbered blocks (block, entries), and the blocks' first keys as
    an array in one row."""

    blocks: DataFrame
    firsts: DataFrame
    n: int

    def before(self, firsts: str, text: Column) -> Column:
        """How many of the first keys lie before a text: a binary search, a fold over its steps."""
        powers = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, self.n.bit_length())))))
        below = lambda at: F.when(at <= self.n, F.element_at(firsts, at) < text).otherwise(False)
        return F.aggregate(powers, F.lit(0), lambda at, step: F.when(below(at + step), at + step).otherwise(at))


def sorted_keys(keys: DataFrame) -> SortedKeys:
    """Blocks of keys (key, row_id): range partitions, sorted and numbered inside."""
    spark = keys.sparkSession
    keys = stored(keys.select("key", "row_id"))
    size = max(BLOCK, -(-keys.count() // MOST_BLOCKS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.repartitionByRange(parts, "key", "row_id").sortWithinPartitions("key", "row_id").withColumn("at", F.monotonically_increasing_id())
    part, nth = F.shiftright("at", 33), F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / size)
    entry = F.struct("key", "row_id")
    cut = stored(placed.groupBy(part.alias("part"), nth.alias("nth")).agg(F.array_sort(F.collect_list(entry)).alias("entries")))
    firsts = cut.select("part", "nth", F.col("entries")[0]["key"].alias("first"))
    numbers = firsts.withColumn("block", F.row_number().over(Window.orderBy("part", "nth")))  # at most MOST_BLOCKS and a partition's last ones
    blocks = stored(cut.join(F.broadcast(numbers.select("part", "nth", "block")), ["part", "nth"]).select("block", "entries"))
    row = blocks.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", F.col("entries")[0]["key"].alias("first")))), lambda x: x["first"]).alias("firsts"))
    return SortedKeys(blocks, stored(row), blocks.count())


def extension_join(stems: DataFrame, keys: SortedKeys) -> DataFrame:
    """Rows of ``stems`` (with a column stem) with the keys that begin with the stem: the
    blocks in which these lie are rows, joined by number, and cut down to the stem's keys."""
    own = stems.where("stem <> ''")
    cut = own.withColumn("_firsts", keys.firsts.scalar())
    cut = cut.withColumn("_last", keys.before("_firsts", F.concat("stem", F.lit(LAST)))).withColumn("_first", F.greatest(F.lit(1), keys.before("_firsts", F.col("stem"))))
    touched = cut.select(*own.columns, F.explode(F.when(F.col("_last") >= F.col("_first"), F.sequence("_first", "_last"))).alias("block"))
    met = touched.join(keys.blocks, "block")
    found = F.filter("entries", lambda e: e["key"].startswith(F.col("stem")))
    return met.select(*own.columns, F.inline(found))
