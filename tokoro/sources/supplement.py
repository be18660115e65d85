"""The supplementary town list: an eight-column CSV with Japanese headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: where the list is published.
SUPPLEMENT_URL = "https://raw.githubusercontent.com/geolonia/japanese-addresses/master/data/latest.csv"
SUPPLEMENT_ATTRIBUTION = "Contains the open town list 'japanese-addresses' (CC BY 4.0)."
#: Headers and the names used here.
HEADERS = {"都道府県名": "pref", "市区町村名": "city", "大字町丁目名": "town", "小字・通称名": "koaza", "緯度": "lat", "経度": "lon"}


def read_supplement(spark: SparkSession, path: str) -> DataFrame:
    """(ord, pref, city, town, koaza, lat, lon) in file order; rows without a town are
    dropped, coordinates that aren't numbers are null."""
    rows = spark.read.csv(path, header=True, escape='"')  # quotes inside quotes are doubled
    text = lambda h: F.trim(F.coalesce(F.col(f"`{h}`"), F.lit("")))
    out = rows.select(F.monotonically_increasing_id().alias("ord"), *(text(h).alias(n) if n not in ("lat", "lon") else text(h).try_cast("double").alias(n) for h, n in HEADERS.items()))
    return out.where("town <> ''")
