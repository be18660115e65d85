"""Keys under which towns, cities and prefectures are found.

A town's keys are all its place's heads (prefecture or none, county or none, city, ward)
with all its tails (area, chome, inner area, in their spellings). Heads and tails are kept
apart: a text is first cut at the few heads, and a tail need not be stored for each head.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokoro.functions.names import chome_variants, city_cores, pref_variants, prefix_styles
from tokoro.functions.text import by_stability

PLACE = ["pref", "county", "city", "ward"]


def _names(*columns: str):
    return F.concat(*(F.coalesce(F.col(c), F.lit("")) for c in columns))


def _heads(rows: DataFrame, value: list[str]) -> DataFrame:
    """(head, value): row by row, each part exploded, so that nothing is computed twice."""
    parts = rows.select(*value, pref_variants("pref").alias("_ps"), city_cores("county", "city", "ward").alias("_cs"))
    return parts.select(*value, "_cs", F.explode("_ps").alias("_p")).select(*value, "_p", F.explode("_cs").alias("_c")).select(F.concat("_p", "_c").alias("head"), *value)


def _tails(rows: DataFrame, value: list[str]) -> DataFrame:
    parts = rows.select(*value, prefix_styles("oaza_cho", "koaza").alias("_ss"), chome_variants("chome", "chome_number").alias("_hs"))
    each = parts.select(*value, "_hs", F.explode("_ss").alias("_s")).select(*value, "_s", F.explode("_hs").alias("_h"))
    return each.select(F.concat("_s.oaza", "_h", "_s.koaza").alias("tail"), *value)


def head_keys(places: DataFrame, value: list[str]) -> DataFrame:
    """(head, value) of rows with the four place names; no pair twice."""
    return by_stability(places, _names(*PLACE), lambda df, norm: _heads(df, value).withColumn("head", norm(F.col("head")))).distinct()


def tail_keys(towns: DataFrame, value: list[str]) -> DataFrame:
    """(tail, value) of rows with the four town names."""
    names = _names("oaza_cho", "chome", "chome_number", "koaza")
    return by_stability(towns, names, lambda df, norm: _tails(df, value).withColumn("tail", norm(F.col("tail")))).distinct()


def split_keys(towns: DataFrame, value: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(heads: head, place) and (keys: place, tail, value) of towns with the eight name
    columns. Places are numbered by name; there are as many as municipalities."""
    names = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in PLACE]
    places = towns.select(*names).distinct().withColumn("place", F.row_number().over(Window.orderBy(*PLACE)))
    own = tail_keys(towns.select(value, *names, "oaza_cho", "chome", "chome_number", "koaza"), [value, *PLACE])
    return head_keys(places, ["place"]), own.join(places, PLACE).select("place", "tail", value)


def joined_keys(heads: DataFrame, keys: DataFrame, value: str = "row_id") -> DataFrame:
    """(key, value): every head of a place with every tail."""
    whole = heads.join(keys, "place").select(F.concat("head", "tail").alias("key"), value)
    return whole.where("key <> ''").distinct()


def town_keys(towns: DataFrame, value: str = "row_id") -> DataFrame:
    """(key, value) of towns with the eight name columns; no pair twice."""
    names = _names(*PLACE, "oaza_cho", "chome", "chome_number", "koaza")

    def make(df: DataFrame, norm) -> DataFrame:
        tails = _tails(df, [value, *PLACE])
        parts = tails.select(value, "tail", pref_variants("pref").alias("_ps"), city_cores("county", "city", "ward").alias("_cs"))
        each = parts.select(value, "tail", "_cs", F.explode("_ps").alias("_p")).select(value, "tail", "_p", F.explode("_cs").alias("_c"))
        return each.select(norm(F.concat("_p", "_c", "tail")).alias("key"), value)

    return by_stability(towns, names, make).where("key <> ''").distinct()


def city_keys(cities: DataFrame) -> DataFrame:
    return head_keys(cities, ["lg_code"]).select(F.col("head").alias("key"), "lg_code").where("key <> ''")


def pref_keys(prefs: DataFrame) -> DataFrame:
    return by_stability(prefs, _names("pref"), lambda df, norm: df.select(F.explode(pref_variants("pref")).alias("key"), "lg_code").withColumn("key", norm(F.col("key")))).where("key <> ''").distinct()
