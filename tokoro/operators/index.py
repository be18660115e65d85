"""The tables that geocoding reads. What is derived from them is computed when first asked
for, so that a look-up of numbers, say, doesn't measure keys."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokoro.config import BROADCAST_BYTES
from tokoro.operators.aliases import city_keys, joined_keys, pref_keys, split_keys
from tokoro.operators.prefix_join import Lookup, SortedKeys, lookup, sorted_keys
from tokoro.storage import stored

KIND_PREF, KIND_CITY, KIND_TOWN, KIND_HEAD = 0, 1, 2, 3


@dataclass
class Index:
    towns: DataFrame
    heads: DataFrame  # head, place
    keys: DataFrame  # place, tail, row_id
    cities: DataFrame
    prefs: DataFrame
    numbers: DataFrame
    broadcast_bytes: int = BROADCAST_BYTES

    @cached_property
    def city_keys(self) -> DataFrame:
        return city_keys(self.cities)

    @cached_property
    def pref_keys(self) -> DataFrame:
        return pref_keys(self.prefs)

    @cached_property
    def names(self) -> Lookup:
        """Heads, cities and prefectures by name (key, id, kind): a few for each municipality."""
        one = lambda df, key, ident, kind: df.select(F.col(key).alias("key"), F.col(ident).alias("id"), F.lit(kind).alias("kind"))
        union = one(self.heads, "head", "place", KIND_HEAD).unionByName(one(self.city_keys, "key", "lg_code", KIND_CITY))
        return lookup(union.unionByName(one(self.pref_keys, "key", "lg_code", KIND_PREF)), most_bytes=self.broadcast_bytes)

    @cached_property
    def tails(self) -> Lookup:
        return lookup(self.keys, "tail", self.broadcast_bytes, ["place", "tail"])

    @cached_property
    def ends(self) -> Lookup:
        """(place, tail, first_row, last_row): the smallest and largest town of each tail."""
        ends = self.keys.groupBy("place", "tail").agg(F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))
        return lookup(stored(ends), "tail", self.broadcast_bytes, ["place", "tail"])

    @cached_property
    def members(self) -> DataFrame:
        """(alike, row_id, at, size): towns with the same keys, numbered from 1 in the order of
        their rows, under the smallest of them. A text that begins with, or is the beginning
        of, a key of one town meets all that are alike, so joins need only look up one."""
        own = self.keys.groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("place", "tail"))).alias("k"))
        same = Window.partitionBy("k")
        numbered = F.row_number().over(same.orderBy("row_id"))
        return stored(own.select(F.min("row_id").over(same).alias("alike"), "row_id", numbered.alias("at"), F.count("*").over(same).alias("size")))

    @cached_property
    def alike_keys(self) -> DataFrame:
        """(place, tail, alike)"""
        firsts = self.members.where("at = 1").select("alike")
        return stored(self.keys.withColumnRenamed("row_id", "alike").join(firsts, "alike", "left_semi").select("place", "tail", "alike"))

    @cached_property
    def alike_tails(self) -> Lookup:
        return lookup(self.alike_keys, "tail", self.broadcast_bytes, ["place", "tail"])

    @cached_property
    def sorted_keys(self) -> SortedKeys:
        """The full keys in order, for what begins with a text; put together once. Of towns that
        are alike only the first is there."""
        return sorted_keys(joined_keys(self.heads, self.alike_keys.withColumnRenamed("alike", "row_id")))

    @classmethod
    def of_towns(cls, towns: DataFrame, cities: DataFrame, prefs: DataFrame, numbers: DataFrame) -> Index:
        """An index over towns that still have all name columns."""
        return cls(towns, *split_keys(towns), cities, prefs, numbers)
